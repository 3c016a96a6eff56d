import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostledger.llm import queries
from hostledger.llm.mixing import MixPlan, draw_counts, mix, mix_amounts, mixed_documents, permuted, water_fill

SCHEMA = "doc_id long, text string, source string, n_chars long"


def by_steps(sizes, weights, most):
    """The rule as it is told: share by weight, cap, share the excess of the capped among the others, again."""
    target, capped = [0.0] * len(sizes), set()
    rest = float(sum(sizes))
    while rest > 1e-9 and len(capped) < len(sizes):
        free = [i for i in range(len(sizes)) if i not in capped]
        total = sum(weights[i] for i in free)
        for i in free:
            target[i] += rest * weights[i] / total
        rest = 0.0
        for i in free:
            if target[i] > most * sizes[i]:
                rest += target[i] - most * sizes[i]
                target[i] = most * sizes[i]
                capped.add(i)
    return target


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 100, 1000, 5, 0], [0, 0], [7], [3, 1, 1, 1, 200, 50]])
def test_water_fill(sizes):
    weights = [(5.0, 2.0, 1.0)[i % 3] for i in range(len(sizes))]
    got = water_fill(sizes, weights, 3)
    assert got == pytest.approx(by_steps(sizes, weights, 3)) and sum(got) == pytest.approx(sum(sizes))


@pytest.mark.parametrize("n", [1, 2, 7, 100, 1000])
def test_permutation(spark, n):
    rows = spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("at")).collect()
    assert sorted(r.at for r in rows) == list(range(n))
    if n == 1000:
        assert abs(np.corrcoef(range(n), [r.at for r in rows])[0, 1]) < 0.1


def test_draw_counts():
    blocks = np.array([1000.5, 20.25, 0.0, 300.25])
    counts = draw_counts(blocks, 16, 1, np.array([10**6, 20, 0, 10**6]))
    assert counts[:, 1].sum() <= 20 and counts[:, 2].sum() == 0
    assert np.abs(counts[:, 0] - blocks[0] / 16).max() < 4 and abs(counts[:, 0].sum() - 1000) < 12


def test_mix(frame):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 400))), rng.choice(["a", "b", "B", "z"]), 1) for i in range(300)]
    rows += [(900, "x y z", None, 1), (901, None, "a", 1), (5, "again " * 50, "a", 1), (5, "again " * 50, "a", 1), (None, "no id here", "b", 1)]
    plan = MixPlan(block_words=8, shard_blocks=64)
    df = frame(rows, SCHEMA)
    got = mix_amounts(df, plan).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((d, s, size(t)) for d, t, s, _ in rows)
    sizes = defaultdict(int)
    for _, t, s, _ in rows:
        sizes[s] += size(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, by_steps([sizes[s] for s in order], [(5.0, 2.0, 1.0)[i % 3] for i in range(len(order))], 3), strict=True))
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"] and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - want[s]) < 0.02 * want[s] + 40
    assert Counter(map(tuple, mix_amounts(df, plan).collect())) == Counter(map(tuple, got))  # reruns agree
    texts = mixed_documents(df, plan).collect()
    words = defaultdict(int)
    for r in texts:
        words[r.source] += size(r.text)
        assert r.n_chars == len(r.text)
    assert words == {s: n for s, n in taken.items() if n}
    original = defaultdict(set)
    for d, t, s, _ in rows:
        original[d, s].add(t)
    assert all(any(part in t for t in original[r.doc_id, r.source] if t) for r in texts for part in r.text.split("\n"))


def test_blocks_are_taken_evenly(frame):
    rows = [(i, " ".join(f"{i}-{j}" for j in range(80)), "abc"[i % 3], 0) for i in range(90)]
    pieces = mix(frame(rows, SCHEMA), MixPlan(block_words=16, shard_blocks=16)).collect()
    uses = defaultdict(Counter)
    for r in pieces:
        per_word = Counter(w for p in r.pieces for w in range(p.begin, p.begin + p.words))
        uses[r.source].update(per_word.get(w, 0) for w in range(80))
    for counts in uses.values():
        assert max(counts) - min(counts) <= 1


def test_odd_tables(frame):
    assert mix_amounts(frame([], SCHEMA)).count() == 0
    assert [r.taken for r in mix_amounts(frame([(1, "", "a", 0), (2, None, None, 0)], SCHEMA)).collect()] == [0, 0]
    rows = [(1, "one two three", "a", 0)] * 50  # one row many times, and clashing columns
    got = mix_amounts(frame([(*r, 9, 9) for r in rows], SCHEMA + ", size int, taken int")).collect()
    assert len(got) == 50 and abs(sum(r.taken for r in got) - 150) <= 64


def test_query(spark, sf_dir):
    by_source = defaultdict(lambda: [0, 0, 0.0])
    rows = queries.op10_mixing(spark, sf_dir).collect()
    sources = {r.doc_id: r.source for r in queries.table(spark, sf_dir, "documents").collect()}
    for r in rows:
        s = by_source[sources[r.doc_id]]
        s[0] += r["size"]
        s[1] += r.taken
        s[2] = r.target
        assert r.taken <= 3 * r["size"]
    assert len(rows) == len(sources) and sum(s[2] for s in by_source.values()) == pytest.approx(sum(s[0] for s in by_source.values()))
    assert all(abs(taken - target) < 0.05 * target + 64 for _, taken, target in by_source.values())
