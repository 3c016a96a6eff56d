"""Exact cosine near-duplicates by cover trees that are traversed together.

Vectors on the unit sphere are covered by nested nodes whose radii halve from level to level. The
upper levels are tables: nodes with too many members for one block are split around a net of
sampled centres, level by level, and pairs of nodes are followed down while their covering radii
allow a link. What is left are pairs of blocks; each is one unit of work, two cover trees in memory
traversed together. A pair of nodes too far apart is dropped, one close enough is counted whole, and
a unit reports per vector its number of links and one link into its group, never all pairs. Two
leaves are compared by one product in single precision, and what that cannot decide in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .components import connected_components, local_roots
from .vectors import matrix, usable

BLOCK = 2048  # vectors of a leaf of the tables
CHUNK = 1024  # members of a node that are assigned together
CENTRES = 64  # most centres that split a node at once; more only means more pairs of blocks
MARGIN = 1e-9  # of the bounds; what is that close is compared itself
MOST_LEVELS = 24
LEAF = 256  # vectors of a leaf in memory, compared by one product
POOR = 32  # centres with too few rows around them after which a node is not split further
EXACT = 1 << 14  # pairs checked in double precision at a time


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def chord(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosines))


class CoverTree:
    """Nodes over the rows of a unit matrix, each with a centre and the radius that covers its rows; the last one is the root.

    A node of up to ``LEAF`` rows is a leaf. A larger one is split around rows that are over half the
    radius apart; rows around which too few others lie are dealt into leaves of their own, so a node
    whose rows lie far from each other does not fall apart into single rows.
    """

    def __init__(self, x: np.ndarray):
        self.x, self.short = x, x.astype(np.float32)
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.members: list[np.ndarray] = []
        self.root = self._cover(np.arange(len(x)), 2.0)

    def _node(self, rows: np.ndarray, far: np.ndarray, children: list[int]) -> int:
        """A node whose centre is its first row, and ``far`` the distances to it."""
        self.centre.append(int(rows[0]))
        self.radius.append(float(far.max()))
        self.children.append(children)
        self.members.append(rows)
        return len(self.centre) - 1

    def _far(self, rows: np.ndarray, centre: int) -> np.ndarray:
        far = chord(self.x[rows] @ self.x[centre])
        far[rows == centre] = 0.0
        return far

    def _cover(self, rows: np.ndarray, radius: float) -> int:
        """The node of ``rows``, which lie within ``radius`` of the first of them."""
        own = self._far(rows, rows[0])
        if len(rows) <= LEAF or own.max() == 0:
            return self._node(rows, own, [])
        while radius / 2 >= own.max():  # levels at which nothing would be split
            radius /= 2
        children, loose, rest, poor = [], [], rows, 0
        while len(rest) and poor < POOR:
            near = self._far(rest, rest[0]) <= radius / 2
            if near.sum() * 8 >= LEAF:
                children.append(self._cover(rest[near], radius / 2))
            else:
                loose.append(rest[near])
                poor += 1
            rest = rest[~near]
        loose = np.concatenate([*loose, rest])
        for at in range(0, len(loose), LEAF):
            part = loose[at : at + LEAF]
            children.append(self._node(part, self._far(part, part[0]), []))
        return self._node(rows, own, children)


class DualTraversal:
    """Links of cosine ``least`` or more between the rows of two trees, or within one."""

    def __init__(self, vectors: tuple[np.ndarray, np.ndarray], weights: tuple[np.ndarray, np.ndarray], same: bool, least: float):
        self.originals, self.weights, self.same = vectors, weights, same
        self.a = CoverTree(unit(vectors[0]))
        self.b = self.a if same else CoverTree(unit(vectors[1]))
        self.least, self.reach = least, float(np.sqrt(2 - 2 * least))
        # of a product of unit vectors in single precision: each component and each sum is rounded once
        self.doubt = 4 * (vectors[0].shape[1] + 4) * float(np.finfo(np.float32).eps)
        self.links = (np.zeros(len(self.a.x), dtype=np.int64), np.zeros(len(self.b.x), dtype=np.int64))
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self.compared = 0  # pairs of rows whose product was taken

    def run(self) -> None:
        stack = [(self.a.root, self.b.root)]
        while stack:
            stack += self._expand(*stack.pop())

    def _link(self, i: np.ndarray, j: np.ndarray) -> None:
        """Count the pairs i[k], j[k]."""
        np.add.at(self.links[0], i, self.weights[1][j])
        np.add.at(self.links[0 if self.same else 1], j, self.weights[0][i])
        self.edges.append((i, j))

    def _link_all(self, p: int, q: int) -> None:
        """Count every pair of a member of p and one of q; two stars join them."""
        i, j = self.a.members[p], self.b.members[q]
        if self.same and p == q:
            total = self.weights[0][i].sum()
            self.links[0][i] += total - self.weights[0][i]
            self.edges.append((np.full(len(i) - 1, i[0]), i[1:]))
            return
        self.links[0][i] += self.weights[1][j].sum()
        self.links[0 if self.same else 1][j] += self.weights[0][i].sum()
        self.edges += [(i, np.full(len(i), j[0])), (np.full(len(j), i[0]), j)]

    def _compare(self, p: int, q: int) -> None:
        """Every pair of a row of leaf p and one of leaf q: single precision first, double where that could decide."""
        rows, columns = self.a.members[p], self.b.members[q]
        self.compared += len(rows) * len(columns)
        i, j = np.nonzero(self.a.short[rows] @ self.b.short[columns].T >= self.least - self.doubt)
        i, j = rows[i], columns[j]
        if self.same and p == q:
            i, j = i[i < j], j[i < j]
        if len(i):
            keep = self.exact(i, j)
            if keep.any():
                self._link(i[keep], j[keep])

    def _expand(self, p: int, q: int) -> list[tuple[int, int]]:
        """What is left to do for a pair of nodes whose rows may lie within reach."""
        a, b = self.a, self.b
        if self.same and p == q:
            if 2 * a.radius[p] <= self.reach - MARGIN:
                self._link_all(p, p)
                return []
            if not a.children[p]:
                self._compare(p, p)
                return []
            below = a.children[p]
            return [(c, c) for c in below] + self._near([(c, d) for k, c in enumerate(below) for d in below[k + 1 :]])
        if not a.children[p] and not b.children[q]:
            self._compare(p, q)
            return []
        return self._near([(c, d) for c in a.children[p] or [p] for d in b.children[q] or [q]])

    def _near(self, pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The pairs that may lie within reach; those that do with all their rows are counted at once."""
        if not pairs:
            return []
        a, b = self.a, self.b
        left, right = (np.array(side) for side in zip(*pairs, strict=True))
        xa, xb = (tree.x[np.array(tree.centre)[side]] for tree, side in ((a, left), (b, right)))
        far = chord(np.einsum("ij,ij->i", xa, xb))
        room = np.array(a.radius)[left] + np.array(b.radius)[right]
        whole = far + room <= self.reach - MARGIN
        for k in np.flatnonzero(whole):
            self._link_all(*pairs[k])
        return [pairs[k] for k in np.flatnonzero(~whole & (far <= self.reach + room + MARGIN))]

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the cosine of the rows as given, in double precision, is ``least`` or more."""
        keep = np.empty(len(i), dtype=bool)
        for at in range(0, len(i), EXACT):
            x, y = self.originals[0][i[at : at + EXACT]], self.originals[1][j[at : at + EXACT]]
            dot, xx, yy = (np.einsum("ij,ij->i", u, v) for u, v in ((x, y), (x, x), (y, y)))
            keep[at : at + EXACT] = dot / (np.sqrt(xx) * np.sqrt(yy)) >= self.least
        return keep


def unit_links(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """cid, links and one linked ``root`` for every vector that has links within a pair of blocks."""
    for batch in batches:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for row in range(batch.num_rows):
            dim = batch.column("dim")[row].as_py()
            blocks = []
            for side in ("left", "right"):
                block = batch.column(side)[row]
                if block.is_valid:
                    parts = block.values
                    x = matrix(parts.field("embedding"), dim)
                    blocks.append((np.asarray(parts.field("cid")), np.asarray(parts.field("n")), x))
            (ids, weight, x), (ids_b, weight_b, y) = blocks[0], blocks[-1]
            same = len(blocks) == 1
            work = DualTraversal((x, y), (weight, weight_b), same, least)
            work.run()
            shift = 0 if same else len(ids)
            nodes = ids if same else np.concatenate([ids, ids_b])
            links = work.links[0] if same else np.concatenate(work.links)
            i = np.concatenate([e[0] for e in work.edges] or [np.empty(0, np.int64)]).astype(np.int64)
            j = np.concatenate([e[1] for e in work.edges] or [np.empty(0, np.int64)]).astype(np.int64)
            root = local_roots(len(nodes), i, j + shift)
            linked = np.flatnonzero(links)
            out.append((nodes[linked], links[linked], nodes[root[linked]]))
        columns = [np.concatenate(c) if out else np.empty(0, np.int64) for c in (zip(*out, strict=True) if out else [()] * 3)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["cid", "links", "root"])


def net(sample: np.ndarray, radius: float, most: int) -> np.ndarray:
    """Rows of ``sample`` (unit vectors) that are over ``radius`` apart; the radius halves until there are two."""
    while True:
        chosen, rest = [], np.arange(len(sample))
        while len(rest) and len(chosen) < most:
            chosen.append(rest[0])
            rest = rest[chord(sample[rest] @ sample[rest[0]]) > radius]
        if len(chosen) > 1 or radius < 1e-6 or len(sample) < 2:
            return sample[chosen]
        radius /= 2


def split_nodes(members: DataFrame, big: DataFrame, level: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Members of the ``big`` nodes in child nodes, and the child nodes with centre and radius.

    The centres are a net over a bounded hashed sample of the node; every member goes to the nearest
    one. A node that cannot be told apart by centres is dealt out evenly instead.
    """
    wanted = F.least(F.lit(CENTRES), F.ceil(2 * F.col("count") / block)).cast("int")
    own = members.join(big, "node").withColumn("wanted", wanted)
    draw = F.pmod(F.xxhash64("cid", F.lit(level)), F.lit(1 << 40)) / float(1 << 40)
    sample = own.where(draw < F.col("wanted") * 8 / F.col("count")).select("node", "dim", "wanted", "embedding")
    radius = 1.2 / 2**level

    def centres(table: pa.Table) -> pa.Table:
        dim, wanted = (table.column(c)[0].as_py() for c in ("dim", "wanted"))
        found = net(unit(matrix(table.column("embedding").combine_chunks(), dim)), radius, wanted)
        return pa.table({"node": table.column("node")[:1], "centres": pa.array([found.tolist()], pa.list_(pa.list_(pa.float64())))})

    nets = cut_lineage(sample.groupBy("node").applyInArrow(centres, "node long, centres array<array<double>>"))
    # members travel in chunks, so the centres of a node are sent once for each chunk
    chunks = F.ceil(F.col("count") / CHUNK)
    packed = own.withColumn("chunk", F.pmod(F.xxhash64("cid"), chunks)).groupBy("node", "dim", "chunk").agg(
        F.collect_list(F.struct("cid", "n", "embedding")).alias("rows"),  # about a chunk
        F.first(F.ceil(2 * F.col("count") / block)).alias("many"),
    )

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                node, dim, chunk, many = (batch.column(c)[row].as_py() for c in ("node", "dim", "chunk", "many"))
                rows, held = batch.column("rows")[row].values, batch.column("centres")[row]
                x, n = matrix(rows.field("embedding"), dim), len(rows)
                if held.is_valid and len(held) > 1:
                    d = chord(unit(x) @ np.array(held.as_py()).T)
                    at, far = d.argmin(axis=1), d.min(axis=1)
                else:
                    at, far = (np.arange(n) + chunk) % many, np.full(n, 2.0)
                kept = [rows.field(c) for c in ("cid", "n", "embedding")]
                same = [pa.array(np.full(n, dim), pa.int32()), pa.array(np.full(n, node), pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [*kept, *same, pa.array(at, pa.int64()), pa.array(far)], ["cid", "n", "embedding", "dim", "node", "at", "far"]
                )

    schema = "cid long, n long, embedding array<float>, dim int, node long, at long, far double"
    schema = schema.replace("array<float>", members.schema["embedding"].dataType.simpleString())
    placed = packed.join(nets, "node", "left").mapInArrow(assign, schema)
    placed = cut_lineage(placed.withColumn("child", F.xxhash64("node", "at")))
    stats = placed.groupBy("node", "at", "child").agg(F.max("far").alias("radius"))
    known = nets.where(F.size("centres") > 1).select("node", F.posexplode("centres").alias("at", "centre"))
    nodes = stats.join(known, ["node", "at"], "left").select(
        F.col("child").alias("node"), F.col("node").alias("parent"), "centre", F.col("radius") + MARGIN
    ).toDF("node", "parent", "centre", "radius")
    return placed.select("cid", "n", "embedding", "dim", F.col("child").alias("node")), nodes


def node_distance(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot))


def linked_classes(classes: DataFrame, least: float, block: int) -> DataFrame:
    """cid, links, root for ``classes`` (cid, n, embedding, dim, node: what may be compared at all)."""
    reach = float(np.sqrt(2 - 2 * least))
    members, leaves, tables, level = classes, None, [], 0
    roots = classes.select("node").distinct()
    while True:
        sizes = cut_lineage(members.groupBy("node").agg(F.count("*").alias("count")))
        big = sizes.where(F.col("count") > block)
        fits = members.join(sizes.where(F.col("count") <= block).select("node"), "node", "left_semi")
        leaves = fits if leaves is None else leaves.unionByName(fits)
        if big.isEmpty():
            break
        level += 1
        if level > MOST_LEVELS:  # what centres have not parted is dealt out evenly, and compared with all that its parent is
            many = F.ceil(2 * F.col("count") / block)
            dealt = members.join(big, "node").withColumn("child", F.xxhash64("node", F.pmod(F.xxhash64("cid"), many)))
            dealt = cut_lineage(dealt.select(*[c for c in members.columns if c != "node"], F.col("child").alias("node"), F.col("node").alias("parent")))
            none = F.lit(None).cast("array<double>").alias("centre")
            tables.append(cut_lineage(dealt.select("node", "parent").distinct().select("node", "parent", none, F.lit(4.0).alias("radius"))))
            leaves = leaves.unionByName(dealt.drop("parent"))
            break
        members, nodes = split_nodes(members, big, level, block)
        tables.append(cut_lineage(nodes))
    packed = cut_lineage(
        leaves.groupBy("node", "dim").agg(F.collect_list(F.struct("cid", "n", "embedding")).alias("block"))  # a block at most
    )
    pairs = roots.select(F.col("node").alias("a"), F.col("node").alias("b"))
    if tables:
        tree = tables[0]
        for more in tables[1:]:
            tree = tree.unionByName(more)
        tree = cut_lineage(tree)
        inner = tree.select(F.col("parent").alias("node")).distinct()
        ends = tree.unionByName(roots.select("node", F.lit(None).cast("long").alias("parent"), F.lit(None).cast("array<double>").alias("centre"), F.lit(4.0).alias("radius")))
        ends = ends.join(inner, "node", "left_anti").withColumn("parent", F.col("node"))
        steps = cut_lineage(tree.unionByName(ends))
        side = lambda x: steps.select(F.col("parent").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("node", "centre", "radius")])
        for _ in range(level):
            near = F.coalesce(node_distance(F.col("centre_a"), F.col("centre_b")) <= reach + F.col("radius_a") + F.col("radius_b"), F.lit(True))
            once = (F.col("a") != F.col("b")) | (F.col("node_a") <= F.col("node_b"))
            pairs = cut_lineage(pairs.join(side("a"), "a").join(side("b"), "b").where(once & near).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))
    left = packed.select(F.col("node").alias("a"), "dim", F.col("block").alias("left"))
    right = packed.select(F.col("node").alias("b"), F.col("block").alias("right"))
    units = pairs.join(left, "a").join(right, "b").withColumn("right", F.when(F.col("a") != F.col("b"), F.col("right")))
    tasks = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by work, not by size
    units = units.repartition(tasks, "a", "b").select("dim", "left", "right")
    return units.mapInArrow(lambda batches: unit_links(batches, least), "cid long, links long, root long")


def near_duplicates(embeddings: DataFrame, least: float = 0.93, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``embeddings`` (vec_id, embedding, label).

    Rows of equal label and equally many components link if their cosine in double precision is
    ``least`` or more. Rows with a null label, or whose vector is null, empty, zero or holds null or
    non-finite components, link with nothing and stand alone. Equal vectors of a label are compared
    once and counted as often as they occur, repeated rows included. component_id is the smallest
    vec_id of the group; a row with a null vec_id takes part and names no group. An empty table gives
    no rows, other columns are ignored.
    """
    rows = embeddings.select("vec_id", "embedding", "label")
    ok = usable(F.col("embedding")) & F.col("label").isNotNull()
    same = rows.where(ok).groupBy("label", "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
    classes = cut_lineage(same.withColumn("cid", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")))
    found = linked_classes(
        classes.select("cid", "n", "embedding", "dim", F.xxhash64("label", "dim").alias("node")), least, block
    )
    found = cut_lineage(found)
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("root").alias("a"), F.col("cid").alias("b")))
    named = (
        classes.join(counts, "cid", "left")
        .join(roots.withColumnRenamed("node", "cid"), "cid", "left")
        .withColumn("root", F.coalesce("root", "cid"))
    )
    firsts = named.groupBy("root").agg(F.min("first").alias("component"))
    links = (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")
    answer = named.join(firsts, "root").select("label", "embedding", links, "component")
    linked = rows.where(ok).join(answer, ["label", "embedding"]).select("vec_id", "n_links", F.col("component").alias("component_id"))
    alone = rows.where(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
