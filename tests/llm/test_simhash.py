import random

import numpy as np
import pytest
import xxhash

from hostledger.llm.components import connected_components, local_roots
from hostledger.llm.simhash import fingerprint, fingerprint_links, near_duplicates, trie_pairs


def by_hand(text):
    words = (text or "").lower().split()
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "a b c a b c a b c", "x " * 50, "\x0bq\x0cw e\tr"])
def test_fingerprint(text):
    assert fingerprint(text) == by_hand(text)


def test_spaces_are_the_six_ascii_ones():
    assert fingerprint("a\xa0b c d") == fingerprint("a\xa0b\nc d") != fingerprint("a b c d")
    assert fingerprint("É A") != fingerprint("é a") and fingerprint("é A") == fingerprint("é a")


def near_values(rng, n, centres):
    out = {0, 2**64 - 1}
    while len(out) < n:
        v = rng.choice(centres)
        for _ in range(rng.randrange(5)):
            v ^= 1 << rng.randrange(64)
        out.add(v)
    return np.array(sorted(out), dtype=np.uint64)


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_trie_pairs_against_all_pairs(bits):
    rng = random.Random(bits)
    centres = [rng.getrandbits(64) for _ in range(6)]
    a, b = near_values(rng, 150, centres), near_values(rng, 170, centres)
    far = lambda x, y: bin(int(x) ^ int(y)).count("1") <= bits
    i, j = trie_pairs(a, a, bits, True)
    assert sorted(zip(i, j, strict=True)) == [(x, y) for x in range(len(a)) for y in range(x + 1, len(a)) if far(a[x], a[y])]
    i, j = trie_pairs(a, b, bits, False)
    assert sorted(zip(i, j, strict=True)) == [(x, y) for x in range(len(a)) for y in range(len(b)) if far(a[x], b[y])]


def test_local_roots():
    rng = random.Random(3)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    root = local_roots(200, *np.array(links).T)
    assert {x: root[x] for x in groups(links)} == groups(links)


def test_components(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(1000, 1400)]
    star = [(5000, 5000 + i) for i in range(1, 300)]
    rest = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(7, 7), (None, 3)]
    rows = connected_components(spark.createDataFrame(chain + star + rest, "a long, b long")).collect()
    want = groups([(a, b) for a, b in chain + star + rest if a is not None and a != b])
    label = {}
    assert len(rows) == len(want)
    assert all(label.setdefault(r.root, want[r.node]) == want[r.node] for r in rows)
    assert len(label) == len(set(want.values()))
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_small_cells_find_the_same(spark):
    rng = random.Random(9)
    values = near_values(rng, 400, [rng.getrandbits(64) for _ in range(5)]).view(np.int64).tolist()
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    u = [v & (2**64 - 1) for v in values]
    want = groups([(x, y) for x in u for y in u if x < y and bin(x ^ y).count("1") <= 2])
    for block in (16, 10_000):
        got = groups([(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in fingerprint_links(fps, 2, block).collect()])
        assert got == want


def test_documents(spark, frame):
    rng = random.Random(1)
    base = [f"w{rng.randrange(900)}" for _ in range(300)]
    near = base[:150] + ["changed"] + base[151:]
    rows = [
        (5, " ".join(base), "x"), (3, " ".join(base), "y"), (9, " ".join(near), None), (4, None, "n"), (8, "", "n"),
        (None, " ".join(base), "x"), (5, " ".join(base), "x"), (None, "only here", "z"), (12, "of its own " * 40, "q"),
    ]
    got = near_duplicates(frame(rows, "doc_id long, text string, component_id string")).collect()
    assert len(got) == len(rows)
    fps = [(r.doc_id, int(r.fingerprint, 16)) for r in got]
    for r in got:
        reach, grown = {int(r.fingerprint, 16)}, True
        while grown:
            more = {f for _, f in fps if any(bin(f ^ x).count("1") <= 2 for x in reach)}
            grown, reach = more != reach, more
        ids = [i for i, f in fps if f in reach and i is not None]
        assert r.component_id == (min(ids) if ids else None)
    assert {r.fingerprint for r in got if r.doc_id in (4, 8)} == {"0" * 16}
    assert near_duplicates(frame([], "doc_id long, text string")).count() == 0
