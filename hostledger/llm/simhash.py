"""SimHash near-duplicates by a self-join of a binary trie of fingerprints.

The trie is cut into cells: a cell is a prefix whose fingerprints fit into one block. Pairs of cells
whose prefixes differ in no more bits than allowed are found by equal keys (a prefix and its
variants within the budget), and each pair of cells is one unit of work: two subtries traversed
together, a level at a time, dropping every pair of nodes whose bits differ too often. A unit
reports a spanning forest of what it links, so a group of near-copies costs no more rows than it has
members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .batches import portions, send_small_batches
from .components import connected_components, local_roots

BITS = 64
SEED = 42
SPACE = " \t\n\x0b\x0c\r"
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
BLOCK = 8192  # fingerprints a cell may hold
CUTS = (0, 4, 8, 12, 16, 20, 24, 28, 32, 36, 40, 44, 48, 52, 56, 60, 64)  # depths a cell may have
STEP = 1 << 20  # shingles turned into bits at a time
NO_SPACES = str.maketrans({c: " " for c in SPACE})


def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    """Bit i is set if it is set in over half of the 64-bit hashes of the shingles; 0 without words."""
    words = [w for w in (text or "").translate(LOWER).translate(NO_SPACES).split(" ") if w]
    if not words:
        return 0
    k = words_per_shingle
    count = max(1, len(words) - k + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, count, STEP):
        stop = min(count, start + STEP)
        parts = words[start : stop + k - 1]
        shingles = map(" ".join, zip(*[parts[i:] for i in range(k)], strict=False)) if len(words) >= k else [" ".join(words)]
        hashes = np.fromiter(map(digest, shingles, repeat(SEED)), dtype="<u8", count=stop - start)
        # column sums of the bits, 255 rows of bytes at a time
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    set_ = np.flatnonzero(2 * ones > count)
    return int(sum(1 << int(i) for i in set_))


def fingerprints(documents: DataFrame, words_per_shingle: int = 3, mark: bool = False) -> DataFrame:
    """doc_id and ``fp`` (the 64 bits as a signed long) of every row, and on demand ``mark``, a hash of its text."""
    send_small_batches(documents.sparkSession)
    kept = ["doc_id", *["mark"] * mark]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            fps = [fingerprint(t.as_py(), words_per_shingle) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], [*kept, "fp"]
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", "text", *[F.xxhash64("text").alias("mark")] * mark)
    return rows.mapInArrow(hashed, f"doc_id {kind}, {'mark long, ' * mark}fp long")


def prefix(fp: Column, depth: int) -> Column:
    """The ``depth`` first bits of ``fp``, with zeros after them."""
    mask = ((1 << depth) - 1) << (BITS - depth)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask).cast("long"))


def cells(fps: DataFrame, block: int = BLOCK) -> tuple[DataFrame, list[int]]:
    """``fps`` (distinct ``fp``) with depth and cell: the shortest prefix of at most ``block`` members.

    The number of members of a prefix is counted one cut at a time, only below prefixes that are
    still too large, until none is. Also returns the depths in use.
    """
    done, depths = None, []
    rest = fps
    for depth in CUTS:
        placed = rest.withColumn("cell", prefix(F.col("fp"), depth))
        sizes = placed.groupBy("cell").agg(F.count("*").alias("n"))
        small = sizes.where((F.col("n") <= block) | F.lit(depth == BITS)).select("cell")
        fits = placed.join(small, "cell", "left_semi").select("fp", F.lit(depth).alias("depth"), "cell")
        done = fits if done is None else done.unionAll(fits)
        depths.append(depth)
        rest = cut_lineage(placed.join(small, "cell", "left_anti").select("fp"))
        if rest.isEmpty():
            break
    return done, depths


def variants(bits: int, depth: int) -> list[int]:
    """Masks of up to ``bits`` flipped bits among the first ``depth`` ones, as signed longs."""
    masks = [sum(1 << (BITS - 1 - i) for i in at) for n in range(bits + 1) for at in combinations(range(depth), n)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def cell_pairs(members: DataFrame, depths: list[int], bits: int) -> DataFrame:
    """(depth_a, cell_a, depth_b, cell_b) that may hold a link, each unordered pair once.

    At the depth of the shallower cell, the prefix of the deeper one is within the budget of it.
    """
    own = cut_lineage(members.select("depth", "cell").distinct())
    found = None
    for depth in depths:
        here = own.where(F.col("depth") == depth).select(F.col("depth").alias("depth_a"), F.col("cell").alias("cell_a"))
        near = here.withColumn("flip", F.explode(F.array([F.lit(m).cast("long") for m in variants(bits, depth)])))
        near = near.withColumn("key", F.col("cell_a").bitwiseXOR(F.col("flip"))).drop("flip")
        deeper = own.where(F.col("depth") >= depth).select(
            F.col("depth").alias("depth_b"), F.col("cell").alias("cell_b"), prefix(F.col("cell"), depth).alias("key")
        )
        pairs = near.join(deeper, "key").where("depth_b > depth_a or cell_b >= cell_a").drop("key")
        found = pairs if found is None else found.unionAll(pairs)
    return found


def trie_pairs(a: np.ndarray, b: np.ndarray, bits: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices i, j with at most ``bits`` differing bits between sorted unsigned a[i] and b[j]; i < j if ``same``.

    The tries of both are walked together from the root: a node is a range of equal prefixes, a pair
    of nodes has the number of bits in which their prefixes differ, and the pair goes when that
    exceeds the budget.
    """
    alo, ahi = np.array([0]), np.array([len(a)])
    blo, bhi = np.array([0]), np.array([len(b)])
    spent = np.array([0])
    for level in range(BITS - 1, -1, -1):
        bit = np.uint64(1 << level)

        def split(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64 = bit) -> np.ndarray:
            """Where the ones start inside each range."""
            pivot = values[lo] & ~(bit + (bit - np.uint64(1))) | bit
            return np.searchsorted(values, pivot).clip(lo, hi)

        am, bm = split(a, alo, ahi), split(b, blo, bhi)
        parts = []
        for (al, ah), (bl, bh), cost in (
            ((alo, am), (blo, bm), 0), ((am, ahi), (bm, bhi), 0), ((alo, am), (bm, bhi), 1), ((am, ahi), (blo, bm), 1)
        ):
            keep = (al < ah) & (bl < bh) & (spent + cost <= bits)
            parts.append((al[keep], ah[keep], bl[keep], bh[keep], spent[keep] + cost))
        alo, ahi, blo, bhi, spent = (np.concatenate(p) for p in zip(*parts, strict=True))
        if same:  # a pair of nodes and its mirror image are one pair
            keep = alo <= blo
            alo, ahi, blo, bhi, spent = alo[keep], ahi[keep], blo[keep], bhi[keep], spent[keep]
        if not len(alo):
            break
    if same:
        keep = alo < blo
        return alo[keep], blo[keep]
    return alo, blo


def forest(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Links of each pair of cells, every linked fingerprint to the first one of its group there."""
    for batch in batches:
        ends_a, ends_b = [], []
        for left, right in zip(batch.column("left"), batch.column("right"), strict=True):
            a = np.sort(np.asarray(left.values).view(np.uint64))
            same = not right.is_valid
            b = a if same else np.sort(np.asarray(right.values).view(np.uint64))
            i, j = trie_pairs(a, b, bits, same)
            nodes = a if same else np.concatenate([a, b])
            root = local_roots(len(nodes), i, j if same else j + len(a))
            linked = np.flatnonzero(root != np.arange(len(nodes)))
            ends_a.append(nodes[root[linked]])
            ends_b.append(nodes[linked])
        a, b = (np.concatenate(x).view(np.int64) if x else np.empty(0, np.int64) for x in (ends_a, ends_b))
        yield pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b)})


def fingerprint_links(fps: DataFrame, bits: int = 2, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join all distinct ``fp`` within ``bits`` differing bits into their components."""
    members, depths = cells(fps, block)
    members = cut_lineage(members)
    packed = members.groupBy("depth", "cell").agg(F.collect_list("fp").alias("fps"))  # a block at most
    packed = cut_lineage(packed)
    left = packed.select(F.col("depth").alias("depth_a"), F.col("cell").alias("cell_a"), F.col("fps").alias("left"))
    right = packed.select(F.col("depth").alias("depth_b"), F.col("cell").alias("cell_b"), F.col("fps").alias("right"))
    units = cell_pairs(members, depths, bits).join(left, ["depth_a", "cell_a"]).join(right, ["depth_b", "cell_b"])
    itself = (F.col("depth_a") == F.col("depth_b")) & (F.col("cell_a") == F.col("cell_b"))
    units = units.withColumn("right", F.when(~itself, F.col("right")))
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by work, not by size
    units = units.repartition(tasks, "depth_a", "cell_a", "depth_b", "cell_b").select("left", "right")
    return units.mapInArrow(lambda batches: forest(batches, bits), "a long, b long")


def grouped_fingerprints(hashed: DataFrame, bits: int, block: int) -> DataFrame:
    """fp and ``root``, the fingerprint that names its group, for the distinct ``fp`` of ``hashed``."""
    classes = cut_lineage(hashed.select("fp").distinct())
    linked = connected_components(fingerprint_links(classes, bits, block)).withColumnRenamed("node", "fp")
    return classes.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(documents: DataFrame, bits: int = 2, words_per_shingle: int = 3, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``documents``.

    component_id is the smallest doc_id reachable over links of at most ``bits`` differing bits.
    A null text counts as empty, texts without words have fingerprint zero and link like any other.
    Rows with a null doc_id take part and never name a component unless all its rows are null.
    Repeated rows are kept, an empty table gives no rows, other columns are ignored.
    """
    hashed = cut_lineage(fingerprints(documents, words_per_shingle))
    rooted = cut_lineage(grouped_fingerprints(hashed, bits, block))
    firsts = hashed.groupBy("fp").agg(F.min("doc_id").alias("first"))
    by_root = firsts.join(rooted, "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(by_root, "root").select("fp", "component_id")
    return hashed.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def first_of_groups(documents: DataFrame, bits: int = 2, words_per_shingle: int = 3, block: int = BLOCK) -> DataFrame:
    """``documents`` with one row of each group of near-duplicates, the one with the smallest doc_id.

    A null doc_id comes last; rows of one doc_id are told apart by their text, of equal rows one stays.
    """
    marked = fingerprints(documents, words_per_shingle, mark=True)
    hashed = cut_lineage(marked)
    rooted = grouped_fingerprints(hashed, bits, block)
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    firsts = hashed.groupBy("fp").agg(F.min(row).alias("first")).join(rooted, "fp")
    return rows_of(documents, firsts.groupBy("root").agg(F.min("first").alias("first")))


def rows_of(documents: DataFrame, firsts: DataFrame) -> DataFrame:
    """One row of ``documents`` for each ``first`` (none, doc_id, mark) of ``firsts``."""
    columns = documents.columns
    kept = firsts.select(F.col("first.doc_id").alias("_id"), F.col("first.mark").alias("_of"))
    own = documents.withColumn("_mark", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_of"))
    found = own.join(kept, same, "left_semi").groupBy("doc_id", "_mark").agg(F.min(F.struct(*columns)).alias("_row"))
    return found.select(*[F.col(f"_row.`{c}`").alias(c) for c in columns])
