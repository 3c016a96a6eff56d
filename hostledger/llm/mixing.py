"""Mix sources to target weights: fixed-length blocks drawn by multinomial counts per shard.

Every source is one stream of words, its documents in a hashed order, cut into blocks of
``block_words``. Each output shard draws how many of its slots go to each source; the slots of a
source are numbered through all shards, and slot ``k`` takes block ``perm(k mod blocks)``, where
``perm`` is a pseudorandom permutation of the block numbers, a new one for each pass over the
source. So a block is taken as often as any other of its source, give or take one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, StringType

from ..session import cut_lineage
from .batches import send_small_batches

WORD = r"[^\x20\x09-\x0D]+"
ROUNDS = 12  # of the swap-or-not permutation


@dataclass(frozen=True)
class MixPlan:
    """Settings of a mix.

    A shard has ``shard_blocks`` slots, more once there would be over ``max_shards`` shards. The
    driver holds the table of sources and their counts by shard, which ``max_sources`` bounds.
    """

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    max_repeats: int = 3
    block_words: int = 64
    shard_blocks: int = 2048
    max_shards: int = 256
    seed: int = 17
    max_sources: int = 1_000_000


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Shares of the sum of ``sizes`` by weight; a share stops at ``most`` times its size and its excess is reshared."""
    target = [0.0] * len(sizes)
    open_, left = set(range(len(sizes))), float(sum(sizes))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if weights[i] * unit > most * sizes[i]}
        if not over:
            for i in open_:
                target[i] = weights[i] * unit
            break
        for i in over:
            target[i] = float(most * sizes[i])
            left -= target[i]
        open_ -= over
    return target


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """``index`` under a pseudorandom permutation of 0 … n-1 chosen by ``key`` (a swap-or-not shuffle)."""

    def one_round(x: Column, i: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(i, *key), n) - x, n)
        swap = F.pmod(F.xxhash64(F.greatest(x, mirror), i, *key), F.lit(2)) == 1
        return F.when(swap, mirror).otherwise(x)

    return F.aggregate(F.array([F.lit(i) for i in range(ROUNDS)]), index, one_round)


def draw_counts(blocks: np.ndarray, shards: int, seed: int, most: np.ndarray) -> np.ndarray:
    """Slots of each shard (row) for each source (column), expected to add up to ``blocks``.

    A shard gets the whole part of each source's expectation; its other slots are multinomial draws
    by the fractions. A source never gets more than ``most`` slots in all.
    """
    counts = np.zeros((shards, len(blocks)), dtype=np.int64)
    expected = blocks / shards
    base = np.floor(expected + 1e-9)
    rest = np.maximum(expected - base, 0)
    draws = rest.sum()
    left = most.astype(np.int64).copy()
    for shard in range(shards):
        counts[shard] = base
        n = int(np.floor((shard + 1) * draws + 0.5) - np.floor(shard * draws + 0.5))
        if n:
            counts[shard] += np.random.default_rng([seed, shard]).multinomial(n, rest / draws)
        counts[shard] = np.minimum(counts[shard], left)
        left -= counts[shard]
    return counts


def sized_documents(documents: DataFrame) -> DataFrame:
    """doc_id, source, size and a hash of the text of every row, written once so that the texts are read once."""
    return cut_lineage(
        documents.select("doc_id", "source", words_in(F.col("text")).alias("size"), F.xxhash64("text").alias("mark"))
    )


def source_table(sized: DataFrame, plan: MixPlan) -> list[dict]:
    """One entry per source with its size, target, blocks and slots per shard."""
    rows = (
        sized.groupBy("source")
        .agg(F.sum("size").alias("size"))
        .orderBy(F.col("source").asc_nulls_last())
        .limit(plan.max_sources + 1)
        .collect()
    )
    if len(rows) > plan.max_sources:
        raise ValueError(f"more than {plan.max_sources} sources; raise max_sources")
    sizes = [r["size"] for r in rows]
    weights = [plan.weights[i % len(plan.weights)] for i in range(len(rows))]
    targets = water_fill(sizes, weights, plan.max_repeats)
    blocks = [-(-s // plan.block_words) for s in sizes]
    wanted = np.array([b * t / s if s else 0.0 for b, t, s in zip(blocks, targets, sizes, strict=True)])
    most = np.array([b * plan.max_repeats for b in blocks], dtype=np.int64)
    shards = int(min(plan.max_shards, max(1, wanted.sum() // plan.shard_blocks)))
    counts = draw_counts(wanted, shards, plan.seed, most) if rows else np.zeros((shards, 0), dtype=np.int64)
    return [
        {
            "source": r["source"], "source_id": i, "source_size": r["size"], "target": targets[i],
            "blocks": blocks[i], "counts": counts[:, i].tolist(),
        }
        for i, r in enumerate(rows)
    ]


def source_frame(sized: DataFrame, table: list[dict]) -> DataFrame:
    return sized.sparkSession.createDataFrame(
        [(t["source"], t["source_id"], t["source_size"], t["target"], t["blocks"]) for t in table],
        "source string, source_id int, source_size long, target double, blocks long",
    )


def slots(sized: DataFrame, table: list[dict], plan: MixPlan) -> DataFrame:
    """One row per slot of the mix: shard, source_id, slot (its number in the source), pass, block."""
    ranges = []
    for t in table:
        ends = np.cumsum(t["counts"])
        ranges += [
            (shard, t["source_id"], t["blocks"], int(end - n), int(end))
            for shard, (n, end) in enumerate(zip(t["counts"], ends, strict=True))
            if n
        ]
    frame = sized.sparkSession.createDataFrame(
        ranges, "shard int, source_id int, blocks long, first long, end long"
    )
    numbered = frame.select(
        "shard", "source_id", "blocks", F.explode(F.sequence("first", F.col("end") - 1)).alias("slot")
    )
    turn = F.floor(F.col("slot") / F.col("blocks")).cast("long")
    block = permuted(F.pmod("slot", "blocks"), F.col("blocks"), F.lit(plan.seed), F.col("source_id"), turn)
    return numbered.select("shard", "source_id", "slot", turn.alias("turn"), block.alias("block"))


def placed_documents(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Every row with its place ``at`` in the stream of its source.

    Equal rows (doc_id, source, text) are counted before anything is sorted and lie side by side.
    Streams are summed up by buckets of about the square root of all rows, so neither a bucket nor
    the list of buckets of a source becomes one large task.
    """
    groups = sized.groupBy("doc_id", "source", "size", "mark").agg(F.count("*").alias("copies"))
    groups = cut_lineage(groups)
    buckets = max(1, int(groups.count() ** 0.5))
    known = groups.join(F.broadcast(sources), groups["source"].eqNullSafe(sources["source"])).select(
        "doc_id", groups["source"], "source_id", "size", "mark", "copies", "source_size", "target", "blocks",
        F.pmod(F.xxhash64("doc_id", "mark"), F.lit(buckets)).alias("bucket"),
    )
    words = F.col("size") * F.col("copies")
    ahead = Window.partitionBy("source_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        known.groupBy("source_id", "bucket")
        .agg(F.sum(words).alias("n"))
        .select("source_id", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset"))
    )
    inside = (
        Window.partitionBy("source_id", "bucket").orderBy("doc_id", "mark")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = known.withColumn("before", F.coalesce(F.sum(words).over(inside), F.lit(0))).join(
        offsets, ["source_id", "bucket"]
    )
    return placed.select(
        "doc_id", "source", "source_id", "size", "mark", "source_size", "target", "blocks",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"),
        (F.col("offset") + F.col("before")).alias("start"),
    ).withColumn("at", F.col("start") + F.col("copy") * F.col("size")).drop("start")


def mix(documents: DataFrame, plan: MixPlan = MixPlan()) -> DataFrame:
    """What the mix takes of every row: doc_id, source, mark, copy, size, source_size, target, taken, pieces.

    ``pieces`` lists (turn, first word, words) of the row that each pass over its source takes,
    ``taken`` is the sum of their words. Null or blank texts have size 0 and nothing taken, a null
    source is a source, ``mark`` is a hash of the text, and rows with equal doc_id, source and text
    are told apart by ``copy`` (0, 1, …), an empty table gives no rows, columns other than doc_id, text
    and source are ignored. Reruns give the same rows. ``taken`` never exceeds ``max_repeats`` times
    ``size``.
    """
    sized = sized_documents(documents)
    table = source_table(sized, plan)
    sources = source_frame(sized, table)
    length = plan.block_words
    placed = placed_documents(sized, sources)
    first, last = F.floor(F.col("at") / length), F.floor((F.col("at") + F.col("size") - 1) / length)
    parts = placed.withColumn(
        "block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last)))
    )
    begin = F.greatest(F.col("block") * length, F.col("at"))
    end = F.least((F.col("block") + 1) * length, F.col("at") + F.col("size"))
    parts = parts.withColumns({"begin": begin - F.col("at"), "words": end - begin})
    uses = slots(sized, table, plan).groupBy("source_id", "block").agg(F.collect_list("turn").alias("turns"))
    piece = F.transform("turns", lambda t: F.struct(t.alias("turn"), F.col("begin"), F.col("words")))
    rows = parts.join(uses, ["source_id", "block"], "left").groupBy(
        "doc_id", "source", "mark", "copy", "size", "source_size", "target"
    )
    return rows.agg(
        F.coalesce(F.sum(F.col("words") * F.coalesce(F.size("turns"), F.lit(0))), F.lit(0)).alias("taken"),
        F.array_sort(F.flatten(F.collect_list(F.when(F.col("turns").isNotNull(), piece)))).alias("pieces"),
    )


@F.pandas_udf(ArrayType(StringType()))
def taken_texts(texts: pd.Series, pieces: pd.Series) -> pd.Series:
    """For each pass over the source that takes something of a text, in order: what it takes."""
    out = []
    for text, taken in zip(texts, pieces, strict=True):
        spans, by_turn = [m.span() for m in re.finditer(WORD, text or "")], {}
        for piece in sorted(taken, key=lambda p: (p["turn"], p["begin"])):
            ranges = by_turn.setdefault(piece["turn"], [])
            if ranges and ranges[-1][1] == piece["begin"]:
                ranges[-1][1] += piece["words"]
            else:
                ranges.append([piece["begin"], piece["begin"] + piece["words"]])
        out.append(
            [
                text if ranges == [[0, len(spans)]] else "\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in ranges)
                for _, ranges in sorted(by_turn.items())
            ]
        )
    return pd.Series(out)


def mixed_documents(documents: DataFrame, plan: MixPlan = MixPlan()) -> DataFrame:
    """The mix as documents: a row of ``documents`` for each pass that takes words of it, its text cut to these words.

    A row is there up to ``max_repeats`` times, or not at all; parts of a text that do not touch are
    joined by a line feed, and n_chars, if there is such a column, is counted anew.
    """
    send_small_batches(documents.sparkSession)
    columns = documents.columns
    taken = mix(documents, plan).where(F.size("pieces") > 0).select("doc_id", "source", "mark", "pieces")
    taken = taken.toDF("_id", "_source", "_mark", "_pieces")
    # one of equal rows stands for all of them; the copies are in ``taken``
    marked = documents.withColumn("_mark", F.xxhash64("text"))
    own = marked.groupBy("doc_id", "source", "_mark").agg(F.min(F.struct(*columns)).alias("_row"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source"))
    rows = own.join(taken.withColumnRenamed("_mark", "_of"), same & (F.col("_mark") == F.col("_of")))
    cut = rows.select("_row", F.explode(taken_texts(F.col("_row.text"), F.col("_pieces"))).alias("_text"))
    fresh = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return cut.select(*[fresh.get(c, F.col(f"_row.`{c}`")).alias(c) for c in columns])


def mix_amounts(documents: DataFrame, plan: MixPlan = MixPlan()) -> DataFrame:
    """``mix`` without the pieces: only sums travel."""
    return mix(documents, plan).select("doc_id", "source", "size", "source_size", "target", "taken")
