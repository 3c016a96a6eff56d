"""Roots, proofs and intervals against trees built in one piece."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from hostledger.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, grp string, tree string, hash int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, more=0):
    doc_id, source, lang, n_chars, text = row[:5]
    return h(*map(framed, (doc_id, source, lang, n_chars if n_chars is None else n_chars + more, text)))


def levels_of(nodes, fan_out):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i : i + fan_out]) for i in range(0, len(last), fan_out)])
    return levels


def path_of(levels, at, fan_out):
    path = []
    for level in levels[:-1]:
        run = level[at // fan_out * fan_out :][:fan_out]
        path.append(("".join(run[: at % fan_out]), "".join(run[at % fan_out + 1 :])))
        at //= fan_out
    return path


def brute_force(rows, fan_out=2):
    """The rows that ``prove`` gives, sorted by text form."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees.append(levels_of([leaf_of(r) for r in groups[g]], fan_out))
    crown = levels_of([t[-1][0] for t in trees], fan_out)
    out = []
    for i, (g, tree) in enumerate(zip(order, trees, strict=True)):
        for at, row in enumerate(groups[g]):
            path = path_of(tree, at, fan_out) + path_of(crown, i, fan_out)
            out.append((row[0], tree[0][at], tree[-1][0], crown[-1][0], path))
    return sorted(map(str, out))


def shown(df):
    return sorted(str((r.doc_id, r.leaf, r.subroot, r.root, [tuple(s) for s in r.path])) for r in df.collect())


def rows_of(sizes):
    made, at = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            made.append((at * 7 % 1009, f"s{at % 3}", lang, at, "é" * (at % 5), "x", None, 1))
            at += 1
    return made


@pytest.mark.parametrize("fan_out, band", [(2, 8), (2, 2), (3, 1)])
def test_trees_of_many_sizes(frame, fan_out, band):
    rows = rows_of({"en": 37, "de": 1, None: 2, "": 3, "fr": 16, "é": 17, "zz": 5})
    assert shown(merkle.prove(frame(rows, SCHEMA), fan_out=fan_out, band=band)) == brute_force(rows, fan_out)


def test_nulls_repeats_ties_and_long_texts(frame):
    rows = [
        (None, None, None, None, None, "a", "b", 0), (None, None, None, None, None, "a", "b", 0), (None, "s", "en", 1, "", "a", "b", 0),
        (5, "s", "en", 3, "one", "a", "b", 0), (5, "s", "en", 3, "one", "a", "b", 0), (5, "s", "en", 3, "two", "a", "b", 0),
        (-7, "", "en", 2**63 - 1, "long " * 200_000, "a", "b", 0), (6, "s", "e", 1, "n1:x", "a", "b", 0),
    ]
    assert shown(merkle.prove(frame(rows, SCHEMA), band=1)) == brute_force(rows)


def test_one_row_and_none(frame):
    alone = merkle.prove(frame([(1, "s", "en", 3, "abc", "", "", 0)], SCHEMA)).collect()[0]
    assert alone.leaf == alone.subroot == alone.root == leaf_of((1, "s", "en", 3, "abc")) and alone.path == []
    assert merkle.prove(frame([], SCHEMA)).count() == 0
    assert merkle.manifest(frame([], SCHEMA)).count() == 0


def test_a_changed_field_breaks_the_root(frame):
    rows = rows_of({"en": 21, "de": 4})
    proved = merkle.prove(frame(rows, SCHEMA), changed={"n_chars": F.when(F.col("doc_id") % 2 == 0, -1).otherwise(F.col("n_chars"))})
    for r in proved.withColumn("found", merkle.folded(F.coalesce("changed_leaf", "leaf"), F.col("path"))).collect():
        assert (r.changed_leaf is None) == (r.doc_id % 2 == 1) == (r.found == r.root)


@pytest.mark.parametrize("band", [1, 8])
def test_intervals_are_nested(frame, band):
    nodes = merkle.manifest(frame(rows_of({"en": 37, "de": 1, "fr": 16}), SCHEMA), band=band).collect()
    by_tree = {}
    for n in nodes:
        by_tree.setdefault(n.tree, {}).setdefault(n.level, []).append((n.lo, n.hi, n.hash))
    assert sorted(max(t) for t in by_tree.values()) == [0, 4, 6]
    for tree in by_tree.values():
        for level, found in tree.items():
            found.sort()
            assert [a[1] for a in found[:-1]] == [b[0] for b in found[1:]] and found[0][0] == 0
            if level:
                for lo, hi, node in found:
                    assert node == h(*[c[2] for c in sorted(tree[level - 1]) if lo <= c[0] and c[1] <= hi])


def test_many_groups_are_not_broadcast(frame, monkeypatch):
    monkeypatch.setattr(merkle, "SMALL", 3)
    rows = [(i, "s", f"lang{i % 11}", i, "t", "", "", 0) for i in range(60)]
    assert shown(merkle.prove(frame(rows, SCHEMA))) == brute_force(rows)


def test_query(spark, sf_dir):
    """Digests of the query from the paths of brute force; tampered rows are found, all others hold."""
    rows = {r.doc_id: r for r in queries.table(spark, sf_dir, "documents").collect()}
    for r in queries.op12_merkle(spark, sf_dir).collect():
        row = rows[r.doc_id]
        altered = zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and row.n_chars is not None
        assert r.verified == (not altered) and r.leaf == leaf_of((row.doc_id, row.source, row.lang, row.n_chars, row.text))
