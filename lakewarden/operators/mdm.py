"""Duplicate master records: exact keys, similar names or equal e-mails, golden records."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.similarity import indel_edits, lcs_similarity, partitions, reaches, sort_tokens
from ..functions.text import is_missing, normalize_email, normalize_text, strip
from ..rules import Entity, RulePack
from ..session import cut, uncut
from .skew import HOT_ROWS, join_per_key
from .values import as_text, from_text

#: Meetings of names at keys that are always paired, or that each name may have; nodes of the first batch where there are more;
#: leaders that may meet every open name directly.
MOST_PAIRS, PAIRS_PER_NAME, FIRST_BATCH, MOST_BESIDE = 2_000_000, 64, 1000, 4096
#: Open nodes and edges between names that one task settles.
TASK_NODES, TASK_EDGES = 100_000, 1_000_000

MEMBER_SCHEMA = "entity string, group_id string, match_type string, member_id string"


def _present(df: DataFrame, name: str | None) -> str | None:
    return {c.lower(): c for c in df.columns}.get((name or "").lower())


def _base(entity: Entity, df: DataFrame, order_col: str) -> DataFrame:
    """``ord, member_id, key, digest, name, email`` of every record; keys can be long, so digests of them are shuffled."""
    id_col = _present(df, entity.id_column)
    key_col = _present(df, entity.exact_key)
    email_col = _present(df, entity.email_column)
    names = [c for c in (_present(df, n) for n in entity.name_columns) if c]
    order = F.col(f"`{order_col}`")
    fallback = F.concat(F.lit("row_"), order.cast("string"))
    nothing = F.lit(None).cast("string")
    key = strip(as_text(df, key_col)) if key_col else nothing
    email = normalize_email(as_text(df, email_col)) if email_col else nothing
    raw_name = F.concat_ws(" ", *[as_text(df, c) for c in names]) if names else F.lit("")
    return df.select(
        order.alias("ord"),
        (F.coalesce(as_text(df, id_col), fallback) if id_col else fallback).alias("member_id"),
        F.when(~key.isin("", "nan", "None"), key).alias("key"),
        F.when(~key.isin("", "nan", "None"), F.unhex(F.sha2(key, 256))).alias("digest"),
        sort_tokens(normalize_text(raw_name)).alias("name"),
        F.when(~is_missing(email), email).alias("email"),
    )


def key_groups(base: DataFrame) -> DataFrame:
    """M1: ``digest, key, size`` of every key that two or more records share; the text stands once for each group."""
    shared = (
        base.filter("digest IS NOT NULL")
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("size"), F.min("ord").alias("first"))
        .filter("size >= 2")
    )
    shared = cut(shared, "shared-keys")
    shown = base.select("digest", F.col("ord").alias("first"), "key").join(shared, ["digest", "first"])
    return shown.groupBy("digest").agg(F.first("size").alias("size"), F.first("key").alias("key"))


def _not_in_key_group(base: DataFrame, groups: DataFrame, hot_rows: int) -> DataFrame:
    """Records left for the name stage. Records without a key never meet the join."""
    base = base.select("digest", "ord", "member_id", "name", "email")
    hot = F.broadcast(groups.filter(F.col("size") > hot_rows).select("digest"))
    cold = groups.filter(F.col("size") <= hot_rows).select("digest")
    keyed = base.filter("digest IS NOT NULL").join(hot, "digest", "left_anti")
    return keyed.join(cold, "digest", "left_anti").unionByName(base.filter("digest IS NULL"))


def name_nodes(rest: DataFrame) -> DataFrame:
    """Records with equal name and equal e-mail behave alike, so they become one node.

    The node carries the earliest record; records with a blank name take no part.
    """
    return (
        rest.filter("name <> ''")
        .groupBy("name", "email")
        .agg(F.min("ord").alias("node"), F.count(F.lit(1)).alias("size"))
        .withColumn("len", F.char_length("name"))
    )


def name_pairs(names: DataFrame, threshold: int) -> DataFrame:
    """``x, y``: pairs of names that share a piece where similar ones do; a shorter name comes first, equal lengths in either
    order. Keys are numbers, names are carried beside them once for each key."""
    short, long = partitions("name", "len", threshold)
    one = names.select(F.col("name").alias("x"), F.explode(short).alias("key"))
    two = names.select(F.col("name").alias("y"), F.explode(long).alias("key"))
    return one.join(two, "key").filter("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def similar_names(pairs: DataFrame, threshold: int) -> DataFrame:
    """M2 on candidate pairs ``(x, y)``: those whose similarity reaches the threshold.

    Length, character and Levenshtein filters run in the JVM and drop no true pair: a character that one name has more often costs
    an edit each time, and the Levenshtein distance never exceeds the indel distance. The rest reaches the Arrow function
    once per pair.
    """
    short = F.least(F.char_length("x"), F.char_length("y"))
    total = F.char_length("x") + F.char_length("y")
    edits = indel_edits(total, threshold)
    # of each name the characters that the other one doesn't have at all
    lacking = F.expr("char_length(translate(x, y, '')) + char_length(translate(y, x, ''))")
    return (
        pairs.filter(reaches(short, total, threshold))
        .withColumn("edits", edits)
        .filter(lacking <= F.col("edits"))
        .filter(F.expr("levenshtein(x, y, edits) >= 0"))
        .withColumn("lcs", lcs_similarity(F.col("x"), F.col("y")))
        .filter(reaches(F.col("lcs"), total, threshold))
        .drop("lcs", "edits")
    )


def _beside(few: DataFrame, names: DataFrame) -> DataFrame:
    """``x, y``: every one of a few names beside every name, over all cores however few files hold them."""
    spread = names.repartition(names.sparkSession.sparkContext.defaultParallelism)
    return spread.select(F.col("name").alias("y")).crossJoin(F.broadcast(few.select(F.col("name").alias("x"))))


def similar_edges(names: DataFrame, threshold: int, directly: bool = False) -> DataFrame:
    """M2: similar names ``(x, y)``, in both directions; found once. A few names that would meet more often than there are pairs
    can meet ``directly``."""
    pairs = _beside(names, names).filter("x < y") if directly else name_pairs(names, threshold)
    edges = cut(similar_names(pairs, threshold).select("x", "y"), "one-way")
    return edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))


def _meetings(one: DataFrame, two: DataFrame, threshold: int) -> int:
    """How many rows the join of two tables of names on their keys would have; counted per key, nothing is joined."""
    sides = []
    for names, short, long in ((one, "a", "b"), (two, "c", "d")):
        for column, keys in zip((short, long), partitions("name", "len", threshold)):
            sides.append(names.select(F.explode(keys).alias("key"), F.lit(column).alias("side")))
    per = reduce(DataFrame.unionByName, sides).groupBy("key").agg(
        *[F.count_if(F.col("side") == c).cast("double").alias(c) for c in "abcd"]
    )
    return int(per.agg(F.sum(F.col("a") * F.col("d") + F.col("b") * F.col("c"))).first()[0] or 0)


def _near_leaders(leaders: DataFrame, names: DataFrame, threshold: int) -> DataFrame:
    """``x, y``: a leader's name and another similar one.

    A few leaders meet every name directly where their keys would bring more pairs than that; else they meet at keys.
    """
    few, all_names = leaders.count(), names.count()
    if few <= PAIRS_PER_NAME or few <= MOST_BESIDE and _meetings(leaders, names, threshold) >= few * all_names:
        return similar_names(_beside(leaders, names).filter("x <> y"), threshold)
    sides = []
    for own, other in (partitions("name", "len", threshold), partitions("name", "len", threshold)[::-1]):
        one = leaders.select(F.col("name").alias("x"), F.explode(own).alias("key"))
        two = names.select(F.col("name").alias("y"), F.explode(other).alias("key"))
        sides.append(one.join(two, "key").filter("x <> y").select("x", "y"))
    return similar_names(sides[0].unionByName(sides[1]).distinct(), threshold)


def _without(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among ``keys``; those without a key never meet the join."""
    return rows.filter(F.col(key).isNull()).unionByName(
        rows.filter(F.col(key).isNotNull()).join(keys.select(key), key, "left_anti").select(rows.columns)
    )


def _batch_leaders(open_nodes: DataFrame, all_edges: DataFrame) -> DataFrame | None:
    """``name, email, node`` of the leaders among ``open_nodes`` (``node, name, email``), whose similar names are ``all_edges``.

    Each round works on open nodes and on edges between names that have some: a node leads if it is the earliest open node of its
    name, of all similar names and of its e-mail. All nodes of those names and of that e-mail come later, so they are closed. The
    earliest open node always leads, so every round closes something, and there are as many rounds as the longest chain of nodes
    that wait for each other. The driver sees three numbers per round. What is small enough for one task is settled there at once.
    """
    given, open_edges = open_nodes, all_edges
    found, left = [], open_nodes.count()
    while left:
        if left <= TASK_NODES and _fits_task(open_nodes, open_edges):
            found.append(_leaders_in_task(open_nodes, open_edges))
            break
        firsts = open_nodes.groupBy("name").agg(F.min(F.struct("node", "email")).alias("at"))
        firsts = cut(firsts.select("name", F.col("at.node").alias("node"), F.col("at.email").alias("email")), "firsts")
        start = firsts.select(F.col("name").alias("x"), F.col("node").alias("other"))
        end = firsts.select(F.col("name").alias("y"))
        edges = cut(open_edges.join(start.select("x"), "x", "left_semi").join(end, "y", "left_semi").select("x", "y"), "open-edges")
        nearest = edges.join(start, "x").groupBy(F.col("y").alias("name")).agg(F.min("other").alias("nearest"))
        mail = open_nodes.filter("email IS NOT NULL").groupBy("email").agg(F.min("node").alias("first"))
        ready = firsts.join(nearest, "name", "left").filter("nearest IS NULL OR node < nearest").select("name", "email", "node")
        first_of_mail = ready.filter("email IS NOT NULL").join(mail, "email").filter("node = first").select("name", "email", "node")
        leaders = cut(ready.filter("email IS NULL").unionByName(first_of_mail), "leaders")
        reached = edges.join(leaders.select(F.col("name").alias("x")), "x", "left_semi").select(F.col("y").alias("name"))
        after = cut(_still_open(open_nodes, reached.union(leaders.select("name")), leaders), "open")
        found.append(leaders)
        before, left = left, after.count()
        if left >= before:
            raise RuntimeError("a round closed no node")
        uncut(firsts, *[open_nodes] * (open_nodes is not given), *[open_edges] * (open_edges is not all_edges))
        open_nodes, open_edges = after, edges
    return cut(reduce(DataFrame.unionByName, found), "batch-leaders") if found else None


def _fits_task(nodes: DataFrame, edges: DataFrame) -> bool:
    """Few edges, and an order without nulls or ties."""
    seen = nodes.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("node").alias("places")).first()
    return seen["n"] == seen["places"] and edges.count() <= TASK_EDGES


def _leaders_in_task(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The leaders of a bounded table, by going through it in order."""
    schema = nodes.select("name", "email", "node").schema
    arrow = to_arrow_schema(schema)

    def settle(_, rows: pa.Table, pairs: pa.Table) -> pa.Table:
        near: dict[str, list[str]] = {}
        for x, y in zip(pairs.column("x").to_pylist(), pairs.column("y").to_pylist()):
            near.setdefault(x, []).append(y)
        rows = rows.sort_by("node")
        names, emails, taken = set(), set(), []
        for at, (name, email) in enumerate(zip(rows.column("name").to_pylist(), rows.column("email").to_pylist())):
            if name not in names and (email is None or email not in emails):
                taken.append(at)
                names.update(near.get(name, ()), (name,))
                emails.add(email)
        return rows.take(pa.array(taken, pa.int64())).select(arrow.names).cast(arrow)

    one = nodes.withColumn("all", F.lit(0)).groupBy("all")
    return one.cogroup(edges.withColumn("all", F.lit(0)).groupBy("all")).applyInArrow(settle, schema)


def _still_open(open_nodes: DataFrame, closed: DataFrame, leaders: DataFrame) -> DataFrame:
    """Nodes without a name in ``closed`` and without a leader's e-mail."""
    rest = open_nodes.join(closed.distinct(), "name", "left_anti")
    return _without(rest, leaders.filter("email IS NOT NULL"), "email").select("node", "name", "email")


class _Places:
    """Nodes by their place in the order; the driver sees a row count for each partition and one node for each question."""

    def __init__(self, nodes: DataFrame) -> None:
        ordered = nodes.select("node").orderBy("node").withColumn("part", F.spark_partition_id())
        at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        self.rows = cut(ordered.withColumn("at", at), "places")
        self.sizes = sorted((r["part"], r["count"]) for r in self.rows.groupBy("part").count().collect())
        self.total = sum(n for _, n in self.sizes)

    def node(self, place: int):
        for part, n in self.sizes:
            if place < n:
                return self.rows.filter((F.col("part") == part) & (F.col("at") == place)).first()["node"]
            place -= n
        return None


def _named(nodes: DataFrame) -> DataFrame:
    return nodes.select("name").distinct().withColumn("len", F.char_length("name"))


def leader_clusters(
    nodes: DataFrame, threshold: int, hot_rows: int = HOT_ROWS, most_pairs: int = MOST_PAIRS, first_batch: int = FIRST_BATCH
) -> DataFrame:
    """M3 and M4: ``node, leader``; a leader names itself.

    A node leads exactly when no earlier similar node leads, and every other node belongs to its earliest similar leader. Nodes are
    similar through equal or similar names or through their e-mail.

    Where names would meet more than ``most_pairs`` times (and more than ``PAIRS_PER_NAME`` times each), the nodes are taken in
    batches by their order. Leaders of a batch are found from the pairs inside it and close all nodes that are similar to
    them, early or late, so that those are never paired with each other. Later leaders come later in the order: a node's earliest
    one is in the batch that closed it. Batches grow fourfold, and shrink while their names would meet too often.
    """
    counted = F.count(F.lit(1)).alias("n_nodes")
    names = cut(nodes.groupBy("name", "len").agg(counted), "names")
    emails = nodes.filter("email IS NOT NULL").groupBy("email").agg(counted)
    emails = cut(emails.filter("n_nodes > 1"), "emails")
    marked = join_per_key(nodes.filter("email IS NOT NULL"), emails, "email", "n_nodes", hot_rows).select("node", "name", "email")
    # an e-mail that no other node has counts for nothing
    alone = _without(nodes, emails, "email").select("node", "name", F.lit(None).cast("string").alias("email"))
    open_nodes = cut(marked.unionByName(alone), "open")
    found, claims, places, taken, size = [], [], None, 0, first_batch
    while not open_nodes.isEmpty():
        left = cut(_named(open_nodes), "open-names")
        batch, some, whole, dense = open_nodes, left, True, not _meets_little(left, threshold, most_pairs)
        if dense:
            places = places or _Places(nodes)
        while dense and size >= first_batch:
            last = places.node(taken + size - 1) if taken + size < places.total else None
            whole = last is None
            batch = open_nodes if whole else open_nodes.filter(F.col("node") <= F.lit(last))
            some = left if whole else _named(batch)
            dense = not _meets_little(some, threshold, most_pairs)
            if not dense or size // 4 < first_batch:
                break
            size //= 4
        batch, some = (batch, some) if whole else (cut(batch, "batch"), cut(some, "batch-names"))
        edges = cut(similar_edges(some, threshold, dense and some.count() <= MOST_BESIDE), "edges")
        leaders = _batch_leaders(batch, edges)
        taken, size = taken + size, size * 4
        if leaders is None:
            continue
        lead = leaders.select(F.col("name").alias("x"), "node")
        if not whole:
            own = cut(leaders.select("name", F.char_length("name").alias("len")).distinct(), "leader-names")
            edges = cut(_near_leaders(own, left, threshold), "near-leaders")
        named = edges.join(lead, "x").select(F.col("y").alias("name"), "node").unionByName(leaders.select("name", "node"))
        named = cut(named.groupBy("name").agg(F.min("node").alias("claim")), "claims")
        found.append(leaders)
        claims.append(named)
        if whole:
            break
        after = cut(_still_open(open_nodes, named.select("name"), leaders), "open")
        uncut(open_nodes, left, batch)
        open_nodes = after
    if not found:
        return nodes.select("node", F.col("node").alias("leader"))
    leaders = cut(reduce(DataFrame.unionByName, found), "all-leaders")
    named = reduce(DataFrame.unionByName, claims).groupBy("name").agg(F.min("claim").alias("claim"))
    named = named.join(names.select("name", "n_nodes"), "name")
    mailed = leaders.filter("email IS NOT NULL").select("email", F.col("node").alias("claim")).join(emails, "email")
    by_name = join_per_key(nodes.select("node", "name"), named, "name", "n_nodes", hot_rows).select("node", "claim")
    by_mail = join_per_key(
        nodes.filter("email IS NOT NULL").select("node", "email"), mailed, "email", "n_nodes", hot_rows
    ).select("node", "claim")
    own = leaders.select("node", F.col("node").alias("own"))
    claims = by_name.unionByName(by_mail).groupBy("node").agg(F.min("claim").alias("claim"))
    return claims.join(own, "node", "left").select("node", F.coalesce("own", "claim").alias("leader"))


def _meets_little(names: DataFrame, threshold: int, most_pairs: int) -> bool:
    """Whether all pairs of names that share a key may be written: so many in all, or so many for each name."""
    return _meetings(names, names, threshold) // 2 <= max(most_pairs, PAIRS_PER_NAME * names.count())


def _node_key(name: Column, email: Column) -> Column:
    return F.concat(name, F.lit("\0"), F.coalesce(email, F.lit("")))


def find_members(
    entity: Entity,
    df: DataFrame,
    order_col: str,
    threshold: int = 88,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """M1 to M4 and M7: one row per record that belongs to a group of two or more.

    ``group_id`` names the shared key or the leading record, ``ord`` gives the order in the group.
    Groups stay in long form, so their size does not matter to any task.
    """
    base = cut(_base(entity, df, order_col), "records")
    out = []
    rest = base
    if _present(df, entity.exact_key):
        groups = cut(key_groups(base), "key-groups")
        matched = join_per_key(
            base.select("digest", "ord", "member_id"), groups, "digest", "size", hot_rows
        )
        out.append(
            matched.select(
                F.lit(entity.name).alias("entity"),
                F.concat(F.lit("key:"), F.col("key")).alias("group_id"),
                F.lit("exact_key").alias("match_type"),
                "ord",
                "member_id",
                "size",
            )
        )
        rest = _not_in_key_group(base, groups, hot_rows)
    if any(_present(df, n) for n in entity.name_columns):
        rest = rest.filter("name <> ''")
        nodes = cut(name_nodes(rest), "nodes")
        clusters = leader_clusters(nodes, threshold, hot_rows)
        placed = nodes.join(clusters, "node")
        totals = placed.groupBy("leader").agg(
            F.count(F.lit(1)).alias("nodes"), F.sum("size").alias("group_size")
        )
        placed = join_per_key(
            placed.select("leader", "name", "email", "size"),
            totals.filter("group_size > 1"),
            "leader",
            "nodes",
            hot_rows,
        ).select(
            _node_key(F.col("name"), F.col("email")).alias("node_key"),
            "leader",
            "size",
            "group_size",
        )
        keyed = rest.select(
            _node_key(F.col("name"), F.col("email")).alias("node_key"), "ord", "member_id"
        )
        out.append(
            join_per_key(keyed, placed, "node_key", "size", hot_rows).select(
                F.lit(entity.name).alias("entity"),
                F.concat(F.lit("name:"), F.col("leader").cast("string")).alias("group_id"),
                F.lit("fuzzy_name").alias("match_type"),
                "ord",
                "member_id",
                F.col("group_size").alias("size"),
            )
        )
    if not out:
        kind = base.schema["ord"].dataType.simpleString()
        return df.sparkSession.createDataFrame(
            [], f"{MEMBER_SCHEMA.replace('member_id', f'ord {kind}, member_id')}, size bigint"
        )
    return reduce(DataFrame.unionByName, out)


def group_table(members: DataFrame, threshold: int = 88) -> DataFrame:
    """M5 and M7: one row per group with match type, confidence, size and evidence."""
    size = F.col("size")
    similar = F.round(F.least(F.lit(0.97), F.lit(threshold / 100) + 0.02 * (size - 1)), 2)
    exact = F.col("match_type") == "exact_key"
    return members.groupBy("entity", "group_id", "match_type").agg(
        F.count(F.lit(1)).alias("size"), F.min("ord").alias("first_ord")
    ).select(
        "entity",
        "group_id",
        "match_type",
        F.when(exact, F.lit(0.98)).otherwise(similar).alias("confidence"),
        "size",
        F.when(
            exact,
            F.concat(
                F.expr("substr(group_id, 5)"),
                F.lit(" shared by "),
                size.cast("string"),
                F.lit(" records"),
            ),
        )
        .otherwise(F.concat(size.cast("string"), F.lit(" records with very similar names or the same e-mail")))
        .alias("evidence"),
        "first_ord",
    )


def duplicates_detected(groups: DataFrame) -> DataFrame:
    """M8 per entity."""
    return groups.groupBy("entity").agg(
        F.sum(F.greatest(F.lit(0), F.col("size") - 1)).alias("duplicates_detected"),
        F.count(F.lit(1)).alias("n_groups"),
    )


def golden_records(df: DataFrame, members: DataFrame, order_col: str) -> DataFrame:
    """M6: per group and column the most frequent non-blank value.

    If no value repeats, the longest one wins; ties go to the earliest record. The three
    aggregations combine map-side, so a group that holds most of the table is no single task.
    """
    columns = df.columns
    texts = [as_text(df, c).alias(f"c{i}") for i, c in enumerate(columns)]
    placed = df.select(F.col(f"`{order_col}`").alias("ord"), *texts).join(
        members.select("group_id", "ord"), "ord"
    )
    long = placed.unpivot(
        ["group_id", "ord"], [f"c{i}" for i in range(len(columns))], "slot", "value"
    ).filter(F.col("value").isNotNull() & (strip(F.col("value")) != ""))
    counted = long.groupBy("group_id", "slot", "value").agg(
        F.count(F.lit(1)).alias("n"), F.min("ord").alias("first")
    )
    rank = F.struct(
        (-F.col("n")).alias("n"),
        F.when(F.col("n") == 1, -F.char_length("value")).otherwise(0).alias("len"),
        "first",
    )
    best = counted.groupBy("group_id", "slot").agg(F.min_by("value", rank).alias("value"))
    typed = [
        from_text(F.max(F.when(F.col("slot") == f"c{i}", F.col("value"))), df.schema[c].dataType).alias(c)
        for i, c in enumerate(columns)
    ]
    return best.groupBy("group_id").agg(*typed)


def detect_duplicates(
    entity: str, df: DataFrame, pack: RulePack, order_col: str, **options: int
) -> dict[str, DataFrame]:
    """M1 to M8 for one entity: ``members``, ``groups`` and ``golden``; none for unknown entities."""
    rule = pack.entity(entity)
    if rule is None:
        rule = Entity(entity, "", "", ())
    members = cut(
        find_members(rule, df, order_col, pack.similarity_threshold, **options), "members"
    )
    return {
        "members": members,
        "groups": group_table(members, pack.similarity_threshold),
        "golden": golden_records(df, members, order_col),
    }
