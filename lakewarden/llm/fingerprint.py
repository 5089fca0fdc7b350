"""Document fingerprints by consistent weighted sampling.

The terms of a text are its words, weighted by how often they occur. For each sample every term draws two gamma values
and a uniform one from its hash; with them its weight is rounded to a level that small changes of the weight leave alone,
and the term with the least arrival wins. Two texts agree in a sample with a probability equal to their generalised Jaccard
similarity, the sum of the lesser weights over the sum of the greater ones. Only built-in functions run.

A fingerprint is the hex form of one 32-bit number per sample (four bytes while it is computed), so equal texts have equal fingerprints and the likeness of
two fingerprints is the part of the samples in which they agree.

Defined results: a null text counts as empty; a text without words has the empty fingerprint, which is fully like the
empty one and unlike all others. Documents follow each other by descending id, a null id comes last; where an id repeats,
the next document of each of its rows is the next smaller id, and of the rows of that id the one with the smallest text.
A single document is its own next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewarden.llm.common import Scratch

SAMPLES = 24
#: Ranges of the id that are put in order independently of each other.
RANGES = 256
LANE = 4  # bytes of a sample


def _unit(bits: Column, shift: int, width: int) -> Column:
    """A number strictly between 0 and 1 from ``width`` bits of a hash."""
    part = F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1))
    return (part.cast("double") + 0.5) / float(1 << width)


def arrival(term: Column, weight_ln: Column, sample: int) -> Column:
    """Order and identity of one sample in one long: the logarithm of the arrival above, 32 bits of hash below."""
    one, two = F.xxhash64(term, F.lit(2 * sample)), F.xxhash64(term, F.lit(2 * sample + 1))
    r = -F.ln(_unit(one, 0, 32) * _unit(one, 32, 32))  # gamma with shape 2
    c = F.ln(-F.ln(_unit(two, 0, 24) * _unit(two, 24, 24)))
    beta = _unit(two, 48, 16)
    level = F.floor(weight_ln / r + beta)
    ln_a = c - r * (level - beta) - r
    high = ((F.greatest(F.least(ln_a, F.lit(60.0)), F.lit(-60.0)) + 64.0) * float(1 << 23)).cast("long")
    low = F.hash(term, level).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftleft(high, 32).bitwiseOR(low)


def terms(text: Column) -> Column:
    """Sorted hashes of all words, repeats included."""
    words = F.array_remove(F.split(text, "[\x20\t-\r]+"), "")
    return F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))


def _starts(hashes: Column) -> Column:
    places = F.when(F.size(hashes) > 0, F.sequence(F.lit(0), F.size(hashes) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: (i == 0) | (F.get(hashes, i) != F.get(hashes, i - 1)))


def _weighted(hashes: Column, starts: Column, variant: int) -> Column:
    """One struct per distinct term with its number of occurrences, from the places where a run of equal hashes starts."""

    def one(start: Column, i: Column) -> Column:
        until = F.coalesce(F.get(starts, i + 1), F.size(hashes))
        return F.struct(F.lit(variant).alias("v"), F.get(hashes, start).alias("h"), (until - start).alias("n"))

    return F.transform(starts, one)


def signatures(rows: DataFrame, keys: list[str], texts: list[str], samples: int = SAMPLES) -> DataFrame:
    """One line per value of ``keys`` with ``sign0``, ``sign1``, ... for the columns ``texts``; null for no words.

    The occurrences are counted inside the row, and if ``rows`` is already partitioned by a part of ``keys``, the minima
    need no shuffle.
    """
    df = rows.select(*keys, *[terms(F.col(t)).alias(f"h{i}") for i, t in enumerate(texts)])
    df = df.select("*", *[_starts(F.col(f"h{i}")).alias(f"s{i}") for i in range(len(texts))])
    all_terms = F.concat(*[_weighted(F.col(f"h{i}"), F.col(f"s{i}"), i) for i in range(len(texts))])
    flat = df.select(*keys, F.explode(all_terms).alias("t")).select(
        *keys, "t.v", "t.h", F.ln(F.col("t.n").cast("double")).alias("w")
    )
    least = flat.groupBy(*keys, "v").agg(
        *[F.min(arrival(F.col("h"), F.col("w"), k)).alias(f"a{k}") for k in range(samples)]
    )
    lanes = [F.unhex(F.lpad(F.hex(F.col(f"a{k}").bitwiseAND(F.lit(0xFFFFFFFF))), 2 * LANE, "0")) for k in range(samples)]
    named = least.select(*keys, "v", F.concat(*lanes).alias("sign"))
    picks = [F.max(F.when(F.col("v") == i, F.col("sign"))).alias(f"sign{i}") for i in range(len(texts))]
    return named.groupBy(*keys).agg(*picks)


def likeness(one: Column, other: Column, samples: int = SAMPLES) -> Column:
    """Part of the samples in which two fingerprints agree."""
    lanes = F.sequence(F.lit(0), F.lit(samples - 1))
    same = F.size(
        F.filter(lanes, lambda k: one.substr(k * LANE + 1, F.lit(LANE)) == other.substr(k * LANE + 1, F.lit(LANE)))
    )
    empty, void = F.length(one) == 0, F.length(other) == 0
    return F.when(empty & void, 1.0).when(empty | void, 0.0).otherwise(same / float(samples))


def following(ids: DataFrame, by: str, ranges: int = RANGES) -> DataFrame:
    """Each distinct id with ``next_id``, the next smaller one; the smallest, or null, is followed by the greatest.

    Ids are dealt to ranges of about equal size, ordered inside each, and the ends are closed with the greatest id of each
    range: at most ``ranges`` values reach the driver.
    """
    steps = [i / ranges for i in range(1, ranges)]
    bounds = ids.agg(F.percentile_approx(by, steps, 10_000).alias("b")).first()["b"] or []
    edges = sorted(set(bounds))
    place = F.size(F.filter(F.array(*[F.lit(x) for x in edges]), lambda b: b < F.col(by))) if edges else F.lit(0)
    dealt = ids.select(by).distinct().withColumn("range", F.when(F.col(by).isNull(), -1).otherwise(place))
    firsts = {r["range"]: r["first"] for r in dealt.groupBy("range").agg(F.max(by).alias("first")).collect()}
    order = sorted(firsts, reverse=True)
    after = {a: firsts[b] for a, b in zip(order, order[1:] + order[:1], strict=True)}
    inner = F.lead(by).over(Window.partitionBy("range").orderBy(F.desc(by)))
    pairs = [F.lit(x) for a, b in after.items() for x in (a, b)]
    end = F.element_at(F.create_map(*pairs), F.col("range")) if pairs else F.lit(None)
    return dealt.select(by, F.coalesce(inner, end).alias("next_id"))


def edited(docs: DataFrame, nexts: DataFrame) -> DataFrame:
    """``id``, ``text``, ``digest`` and ``edited``: the last third of each text replaced by as many first letters of the
    next document.

    ``docs`` has ``id``, ``text`` and ``digest``, ``nexts`` has ``id``, ``next_id`` and ``wanted``, the greatest number of
    letters that a row of the id can ask for. Only that many are sent.
    """
    asked = nexts.select(F.col("next_id").alias("giver"), F.col("id").alias("taker"), "wanted")
    heads = (
        docs.join(asked, docs["id"].eqNullSafe(asked["giver"]))
        .select("taker", F.struct("digest", F.left("text", F.col("wanted")).alias("text")).alias("head"))
        .groupBy("taker")
        .agg(F.min("head")["text"].alias("head"))
    )
    third = F.floor(F.length("text") / 3).cast("int")
    changed = F.concat(F.left("text", F.length("text") - third), F.left("head", third))
    return docs.join(heads, docs["id"].eqNullSafe(heads["taker"])).select("id", "text", "digest", changed.alias("edited"))


def fingerprints(docs: DataFrame, by: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how like they are to each other and to the next document."""
    scratch = Scratch(docs.sparkSession, "fingerprint")
    rows = docs.select(F.col(by).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sizes = scratch.keep(rows.groupBy("id").agg(F.max(F.length("text")).alias("n")), "sizes", light=True)
    pairs = following(sizes, "id").withColumnRenamed("id", "one")
    nexts = scratch.keep(
        pairs.join(sizes, pairs["one"].eqNullSafe(sizes["id"])).select(
            "id", "next_id", F.floor(F.col("n") / 3).cast("int").alias("wanted")
        ),
        "nexts",
        light=True,
    )
    both = edited(rows.withColumn("digest", F.xxhash64("text")), nexts)
    signs = signatures(both, ["id", "digest"], ["text", "edited"], samples).withColumnRenamed("id", "one")
    signs = signs.withColumnRenamed("digest", "of")
    plain = both.select("id", "digest", F.length("text").cast("long").alias("n_chars"), F.unhex(F.sha2("edited", 256)).alias("edited_sha256"))
    signed = scratch.keep(
        plain.join(signs, plain["id"].eqNullSafe(signs["one"]) & (plain["digest"] == signs["of"]), "left").select(
            "id", "digest", "n_chars", "edited_sha256",
            F.coalesce("sign0", F.lit(b"")).alias("fingerprint"),
            F.coalesce("sign1", F.lit(b"")).alias("edited_fingerprint"),
        ),
        "signed",
    )
    giver = signed.groupBy(F.col("id").alias("giver")).agg(
        F.min(F.struct("digest", "fingerprint"))["fingerprint"].alias("next_fingerprint")
    )
    links = nexts.select(F.col("id").alias("taker"), F.col("next_id"))
    given = links.join(giver, links["next_id"].eqNullSafe(giver["giver"])).select("taker", "next_fingerprint")
    near = signed.join(given, signed["id"].eqNullSafe(given["taker"])).select(
        F.col("id").alias(by), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint"), samples).alias("near_next"),
    )
    # in a step of its own: a new column of the same name would take the place of the old one inside the lambdas
    shown = {c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")}
    return near.withColumns(shown)
