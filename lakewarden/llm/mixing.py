"""Mixing sources to target weights.

The token shares of the sources are raised to an exponent and normalised. The exponent is found by bisection: 1 keeps
the shares, 0 gives every source the same weight, and in between the entropy of the weights falls and the number of
times a source is repeated falls as the exponent grows. The weights are then realised: each source is a stream of its
documents in a random order, a new order in each epoch, and block after block takes from every stream its share of the
block's tokens. Only built-in functions run.

Defined results: tokens are the words of the text. A null source is a source of its own; null and empty texts have no
tokens and take their place in the order of their source. A source without any token has weight 0 and is scheduled in
the first epoch only if every document is kept (no budget). A null id is a document like any other; ids that repeat take
their places in an order fixed by the text. Nothing is dropped but what lies beyond a given budget.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewarden.llm.common import WORD, Scratch

#: Hash buckets of one source and epoch: the running totals go over these, then inside each.
BUCKETS = 4096
#: Exponents tried at once in one pass over the shares, and passes: (1/64)**5 is below 1e-9.
FAN, PASSES = 64, 5


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A text that differs for the null source and for every value."""
    return F.when(source.isNull(), "-").otherwise(F.concat(F.lit("+"), source.cast("string")))


def _measures(shares: DataFrame, exponents: list[float], budget: float | None) -> dict[float, tuple[float, float]]:
    """Entropy and largest repetition for each exponent; one row per exponent reaches the driver."""
    grid = F.explode(F.array(*[F.lit(float(x)) for x in exponents])).alias("x")
    rows = (
        shares.where("share > 0")
        .select("share", grid)
        .groupBy("x")
        .agg(
            F.sum(F.pow("share", "x")).alias("mass"),
            F.sum(F.pow("share", "x") * F.ln("share") * F.col("x")).alias("logs"),
            F.max(F.pow(F.col("share"), F.col("x") - 1)).alias("high"),
            F.min(F.pow(F.col("share"), F.col("x") - 1)).alias("low"),
        )
        .collect()
    )
    out = {}
    for r in rows:
        entropy = math.log(r["mass"]) - r["logs"] / r["mass"]
        # without a budget, the least repeated source is read once
        repeated = r["high"] / r["low"] if budget is None else r["high"] / r["mass"] * budget
        out[r["x"]] = (entropy, repeated)
    return out


def exponent(
    shares: DataFrame,
    target_entropy: float | None = None,
    max_repetition: float | None = None,
    budget: float | None = None,
) -> float:
    """The least exponent in 0..1 whose weights keep to the limits.

    ``target_entropy`` in nats is the entropy to reach: the weights are no flatter than that. ``max_repetition`` is how
    often a source may be read, with ``budget`` in units of all tokens. If not even the plain shares keep to a limit,
    the result is 1; if the equal weights do, it is 0. Each pass narrows the interval to one of its 64 parts.
    """

    def fits(measure: tuple[float, float]) -> bool:
        entropy, repeated = measure
        return (target_entropy is None or entropy <= target_entropy) and (
            max_repetition is None or repeated <= max_repetition
        )

    low, high = 0.0, 1.0
    for i in range(PASSES):
        grid = [low + (high - low) * k / FAN for k in range(FAN + 1)]
        found = _measures(shares, grid, budget)
        if not found:
            return 1.0
        first = next((k for k, x in enumerate(grid) if fits(found[x])), FAN)
        if not first:
            return low if i == 0 else grid[0]
        low, high = grid[first - 1], grid[first]
    return high


def weights(
    sized: DataFrame,
    target_entropy: float | None = None,
    max_repetition: float | None = None,
    budget: float | None = None,
    evenness: float | None = None,
) -> DataFrame:
    """One row per source: its tokens, weight and quota of tokens.

    ``sized`` has one row per document with ``key`` and ``tokens``. ``budget`` is a multiple of all tokens; without one
    the quotas are the least for which every document is read at least once. ``evenness`` gives the target entropy as a
    part of the entropy of equal weights.
    """
    scratch = Scratch(sized.sparkSession, "weights")
    by_source = scratch.keep(
        sized.groupBy("key").agg(F.sum("tokens").alias("total"), F.count("*").alias("documents")), "sources", light=True
    )
    all_sources = by_source.agg(
        F.sum("total").alias("t"), F.count(F.when(F.col("total") > 0, 1)).alias("n")
    ).first()
    everything = all_sources["t"] or 0
    if evenness is not None:
        target_entropy = evenness * math.log(max(1, all_sources["n"]))
    shares = by_source.withColumn("share", F.col("total") / F.lit(float(max(1, everything))))
    x = exponent(shares, target_entropy, max_repetition, budget)
    powered = shares.withColumn("power", F.when(F.col("share") > 0, F.pow("share", F.lit(x))).otherwise(0.0))
    stats = powered.agg(
        F.sum("power").alias("mass"), F.max(F.when(F.col("share") > 0, F.col("share") / F.col("power"))).alias("first")
    ).first()
    mass, first = stats["mass"] or 1.0, stats["first"] or 1.0
    scale = everything * (mass * first if budget is None else budget)
    weight = F.round(F.col("power") / F.lit(mass), 9)
    quota = F.round(weight * F.lit(float(scale))).cast("long")
    if budget is None:  # the rounding must not cost the last document of the source that is read once
        quota = F.greatest(quota, F.col("total"))
    return powered.select("key", "total", "documents", weight.alias("weight"), quota.alias("quota"))


def schedule(docs: DataFrame, per_source: DataFrame, block_tokens: int, all_kept: bool, seed: str = "mix") -> DataFrame:
    """Each scheduled copy of a document with its ``epoch``, ``offset`` in its source's stream and ``block``.

    ``docs`` has ``row`` (identifies a document), ``key`` and ``tokens``. The place in the stream is a running total over
    the documents in the order of a hash: first over the buckets of the hash, at most ``BUCKETS`` rows of a source and
    epoch, then inside one bucket. So a source with a third of all documents is spread over all of its buckets.
    """
    wanted = per_source.where((F.col("quota") > 0) | F.lit(all_kept)).select(
        "key", "total", "weight", "quota",
        F.greatest(F.lit(1), F.ceil(F.col("quota") / F.greatest(F.col("total"), F.lit(1)))).cast("int").alias("epochs"),
    )
    copies = docs.join(wanted, "key").select(
        "*", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)).alias("epoch")
    )
    copies = copies.withColumn("place", F.md5(F.concat_ws("|", F.lit(seed), F.col("epoch").cast("string"), "row")))
    copies = copies.withColumn("bucket", F.conv(F.substring("place", 1, 3), 16, 10).cast("int") % BUCKETS)
    sums = copies.groupBy("key", "epoch", "bucket").agg(F.sum("tokens").alias("t"))
    over = Window.partitionBy("key", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("key", "epoch", "bucket", F.coalesce(F.sum("t").over(over), F.lit(0)).alias("before"))
    inside = (
        Window.partitionBy("key", "epoch", "bucket").orderBy("place", "row")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = copies.join(before, ["key", "epoch", "bucket"]).withColumn(
        "offset",
        F.col("epoch") * F.col("total") + F.col("before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)),
    )
    inside_quota = F.col("offset") < F.col("quota")
    if all_kept:
        inside_quota |= F.col("epoch") == 0
    share = F.greatest(F.lit(1), F.round(F.col("weight") * block_tokens).cast("long"))
    return placed.where(inside_quota).withColumn("block", F.floor(F.col("offset") / share).cast("long")).drop(
        "bucket", "before", "epochs"
    )


def _row(by: str, text: str) -> Column:
    """A text that identifies a document by id and content."""
    return F.concat_ws("|", F.coalesce(F.col(by).cast("string"), F.lit("-")), F.md5(F.coalesce(F.col(text), F.lit(""))))


def _sized(docs: DataFrame, by: str, text: str, source: str) -> DataFrame:
    """Every document with its source and tokens, written once: the texts are read no more for the schedule."""
    sized = docs.select(
        F.col(by).alias("id"), source_key(F.col(source)).alias("key"), words(F.col(text)).alias("tokens"),
        _row(by, text).alias("row"),
    )
    return Scratch(docs.sparkSession, "mix").keep(sized, "sized")


def mix(
    docs: DataFrame,
    by: str = "doc_id",
    text: str = "text",
    source: str = "source",
    target_entropy: float | None = None,
    max_repetition: float | None = None,
    budget: float | None = None,
    evenness: float | None = None,
    block_tokens: int = 100_000,
) -> DataFrame:
    """The whole mix without texts: ``by``, ``source``, ``tokens``, ``weight``, ``epoch``, ``offset``, ``block`` and
    ``place``, the order inside a block."""
    sized = _sized(docs, by, text, source)
    per_source = weights(sized, target_entropy, max_repetition, budget, evenness)
    out = schedule(sized, per_source, block_tokens, budget is None)
    return out.select(
        F.col("id").alias(by),
        F.when(F.col("key") != "-", F.col("key").substr(F.lit(2), F.length("key"))).alias("source"),
        "tokens", "weight", "epoch", "offset", "block", "place",
    )


def mixed(
    docs: DataFrame,
    by: str = "doc_id",
    text: str = "text",
    source: str = "source",
    max_repetition: float = 2.0,
    block_tokens: int = 100_000,
) -> DataFrame:
    """The documents with all their columns, repeated and ordered as the mix without a budget has them: every document at
    least once, no source more than ``max_repetition`` times."""
    sized = _sized(docs, by, text, source)
    per_source = weights(sized, max_repetition=max_repetition)
    order = schedule(sized, per_source, block_tokens, True).select(
        F.col("row").alias("__row"), F.col("epoch").alias("__epoch"), F.col("block").alias("__block"),
        F.col("place").alias("__place"),
    )
    # rows that repeat id and text have one place in each epoch
    order = order.dropDuplicates(["__row", "__epoch"])
    own = docs.select(*[F.col(c).alias(f"own_{c}") for c in docs.columns], _row(by, text).alias("__row"))
    whole = own.join(order, "__row").repartitionByRange("__block", "__place").sortWithinPartitions("__block", "__place")
    return whole.select(*[F.col(f"own_{c}").alias(c) for c in docs.columns])
