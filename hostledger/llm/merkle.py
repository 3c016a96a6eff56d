"""A Merkle manifest whose nodes are labelled with the interval of leaf ranks they cover.

Rows are leaves, ranked within their group; a node covers the ranks from ``lo`` up to ``hi``, and its
parent is the node one level up whose interval contains it. Levels are handled in bands: the bucket
of a node is its interval's place at the top of the band, so containment within a band is an
equality of buckets, and a bucket holds a bounded number of nodes whatever the group. What a
parent's interval holds besides the node's own are the siblings. Shuffled rows shrink from band to band by
the number of nodes in a bucket; the levels of a bucket are arrays of one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.numbering import number_rows
from ..session import cut_lineage

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN_OUT = 2
BAND = 8  # levels handled by one shuffle, 256 nodes of fan-out two in a bucket
SMALL = 10_000  # groups whose sizes may be sent to every task
STEP = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """H: lowercase hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def framed(value: Column) -> Column:
    """A value as its number of UTF-8 bytes, a colon and itself; a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    return digest(*map(framed, values))


def joined(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda node: node["hash"]), "")


def parents(level: Column, fan_out: int) -> Column:
    """The nodes above ``level``: every ``fan_out`` consecutive ones, the last run may be shorter."""

    def parent(i: Column) -> Column:
        run = F.slice(level, i * fan_out + 1, fan_out)
        return F.struct(
            F.element_at(run, 1)["lo"].alias("lo"), F.element_at(run, -1)["hi"].alias("hi"), digest(joined(run)).alias("hash")
        )

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / fan_out).cast("int")), parent)


def chunked(entries: DataFrame, unit: int, fan_out: int, band: int) -> DataFrame:
    """The buckets of a band over ``entries`` (tree, n, pos, hash, item), which cover ``unit`` leaves each.

    tree, n, bucket, top (whether the bucket ends its tree), items and levels, an array of arrays of
    (lo, hi, hash).
    """
    span = fan_out**band
    steps = sum((F.when(F.lit(unit * fan_out**k) < F.col("n"), 1).otherwise(0) for k in range(band)), F.lit(0))
    grouped = entries.groupBy("tree", "n", F.floor(F.col("pos") / span).alias("bucket")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "hash", "item"))).alias("items")  # ``span`` at most
    )
    lo = lambda x: x["pos"] * unit
    base = F.transform(
        "items", lambda x: F.struct(lo(x).alias("lo"), F.least(lo(x) + unit, F.col("n")).alias("hi"), x["hash"].alias("hash"))
    )
    climb = F.slice(F.sequence(F.lit(1), F.lit(band)), 1, F.col("steps"))
    levels = F.aggregate(climb, F.array("base"), lambda made, _: F.concat(made, F.array(parents(F.element_at(made, -1), fan_out))))
    made = grouped.withColumn("steps", steps).withColumn("base", base).withColumn("levels", levels)
    return made.select("tree", "n", "bucket", (F.col("n") <= unit * span).alias("top"), "items", "levels")


def grown(leaves: DataFrame, fan_out: int, band: int) -> list[DataFrame]:
    """The bands of all trees over ``leaves`` (tree, n, pos, hash, item), from the leaves up; each is a written table."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    made, entries, unit = [], leaves, 1
    while True:
        made.append(cut_lineage(chunked(entries, unit, fan_out, band)))
        unit *= fan_out**band
        if unit >= most:
            return made
        item = F.lit(None).cast("string").alias("item")
        entries = made[-1].where(~F.col("top")).select("tree", "n", F.col("bucket").alias("pos"), last_hash().alias("hash"), item)


def last_hash() -> Column:
    return F.element_at(F.element_at("levels", -1), 1)["hash"]


def tops(made: list[DataFrame]) -> DataFrame:
    """tree and hash of the last node of every tree."""
    ends = [chunks.where("top").select("tree", last_hash().alias("hash")) for chunks in made]
    for more in ends[1:]:
        ends[0] = ends[0].unionByName(more)
    return ends[0]


def siblings(at: Column, fan_out: int) -> Column:
    """One step per level of the bucket for the item ``at``: hashes that its parent covers before and after its own interval."""

    def step(k: Column) -> Column:
        place = lambda up: F.floor(at / F.pow(F.lit(fan_out), up)).cast("int")
        below = F.get("levels", k - 1)
        own, parent = F.get(below, place(k - 1)), F.get(F.get("levels", k), place(k))
        within = F.filter(F.slice(below, place(k) * fan_out + 1, fan_out), lambda c: (parent["lo"] <= c["lo"]) & (c["hi"] <= parent["hi"]))
        before, after = F.filter(within, lambda c: c["hi"] <= own["lo"]), F.filter(within, lambda c: own["hi"] <= c["lo"])
        return F.struct(joined(before).alias("before"), joined(after).alias("after"))

    ups = F.slice(F.sequence(F.lit(1), F.greatest(F.size("levels"), F.lit(1))), 1, F.size("levels") - 1)
    return F.transform(ups, step)


def descended(made: list[DataFrame], crowns: DataFrame, fan_out: int) -> DataFrame:
    """tree, pos, hash, item, path, crown of every leaf; ``crowns`` has tree, path and crown for every tree.

    From the top band down, the items of a bucket get the steps within it, then those of the node it
    is under.
    """
    above = None
    for chunks in reversed(made):
        ended = chunks.where("top").select("tree", "bucket").join(crowns, "tree")
        above = ended if above is None else above.unionByName(ended)
        own = F.transform("items", lambda x, i: F.struct(x["pos"], x["hash"], x["item"], siblings(i, fan_out)))
        rows = chunks.withColumn("own", own).join(above, ["tree", "bucket"])
        rows = rows.select("tree", "path", "crown", F.inline("own").alias("pos", "hash", "item", "steps"))
        rows = rows.select("tree", "pos", "hash", "item", F.concat("steps", "path").alias("path"), "crown")
        if chunks is not made[0]:
            above = cut_lineage(rows.select("tree", F.col("pos").alias("bucket"), "path", "crown"))
    return rows


def ranked(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with tree (one number per group, in the order of groups), n and pos, the rank within the group from 0."""
    numbered = number_rows(rows, [F.col(c).asc_nulls_first() for c in (group, *order)], "number")
    numbered = numbered.withColumn("number", F.col("number").cast("long"))
    sizes = cut_lineage(numbered.groupBy(group).agg(F.min("number").alias("tree"), F.count("*").alias("n")))
    few = sizes.count() <= SMALL  # else the sizes are joined by a shuffle
    sizes = sizes.withColumnRenamed(group, "_group")
    with_sizes = numbered.join(F.broadcast(sizes) if few else sizes, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")
    return with_sizes.withColumn("pos", F.col("number") - F.col("tree")).drop("number")


def trees(
    documents: DataFrame, fields: Sequence[str], group: str, order: str, changed: dict[str, Column], fan_out: int, band: int
) -> tuple[list[DataFrame], list[DataFrame]]:
    """The bands of the trees of all groups, and those of the tree over their subroots, whose items are the trees' numbers."""
    was = leaf_digest([F.col(c) for c in fields])
    now = leaf_digest([changed.get(c, F.col(c)) for c in fields]) if changed else was
    key = F.col(order)
    leaves = documents.select(key.alias("key"), F.col(group).alias("grp"), was.alias("hash"), now.alias("now"))
    leaves = cut_lineage(leaves.withColumn("now", F.when(F.col("now") != F.col("hash"), F.col("now"))))
    placed = ranked(leaves, "grp", ["key", "hash"])
    made = grown(placed.select("tree", "n", "pos", "hash", F.struct("key", "grp", "now").alias("item")), fan_out, band)
    subroots = number_rows(tops(made), ["tree"], "number", total="n")
    over = subroots.select(
        F.lit(0).cast("long").alias("tree"), F.col("n").cast("long").alias("n"), (F.col("number") - 1).cast("long").alias("pos"), "hash", F.col("tree").alias("item")
    )
    return made, grown(over, fan_out, band)


def prove(
    documents: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", order: str = "doc_id",
    changed: dict[str, Column] | None = None, fan_out: int = FAN_OUT, band: int = BAND,
) -> DataFrame:
    """One row per row of ``documents``: its key (named like ``order``), leaf, changed_leaf, subroot, root and path.

    A leaf is H of the ``fields``. Per ``group``, leaves ascend by ``order`` (null first, then by leaf) and
    every ``fan_out`` consecutive nodes become their H until one is left, the subroot; subroots, in the
    order of groups (null first), become the root in the same way. ``path`` has one step per level: the hashes of the siblings
    before and after the node. ``changed`` gives other values for some fields; changed_leaf is the
    leaf that they would give where it differs, else null, and has no part in the trees. Repeated
    rows are leaves of their own; a null value counts as a dash, an empty one does not; any text
    length goes. An empty table gives no rows; columns that are not fields are ignored.
    """
    made, over = trees(documents, fields, group, order, changed or {}, fan_out, band)
    whole = tops(over).select("tree", F.lit(None).cast(STEP).alias("path"), F.col("hash").alias("crown"))
    whole = whole.withColumn("path", F.coalesce("path", F.array().cast(STEP)))
    crowns = cut_lineage(descended(over, whole, fan_out).select(
        F.col("item").alias("tree"), "path", F.struct(F.col("hash").alias("subroot"), F.col("crown").alias("root")).alias("crown")
    ))
    return descended(made, crowns, fan_out).select(
        F.col("item.key").alias(order), F.col("hash").alias("leaf"), F.col("item.now").alias("changed_leaf"), "crown.subroot", "crown.root", "path"
    )


def manifest(
    documents: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", order: str = "doc_id",
    fan_out: int = FAN_OUT, band: int = BAND,
) -> DataFrame:
    """The nodes of the trees below the subroots: tree (number of the group), level, lo, hi, hash; level 0 are leaves."""
    made, _ = trees(documents, fields, group, order, {}, fan_out, band)
    nodes = None
    for at, chunks in enumerate(made):
        levels = chunks.select("tree", F.posexplode("levels").alias("level", "nodes"))
        if at:  # the lowest level of a band is the top of the one below
            levels = levels.where("level > 0")
        found = levels.select("tree", (F.col("level") + at * band).alias("level"), F.inline("nodes"))
        nodes = found if nodes is None else nodes.unionByName(found)
    return nodes


def proof_digest(path: Column) -> Column:
    """H of all siblings, level by level and left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""))


def folded(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and its siblings give."""
    return F.aggregate(path, leaf, lambda h, s: digest(s["before"], h, s["after"]))
