import random

import numpy as np
import pytest

from hostledger.llm import lines, queries
from hostledger.llm.lines import SPACES, dedup_lines, halves_of, hashed_lines, variant_hashes, within_one


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        ahead, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            ahead, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, ahead + (x != y))
    return row[-1]


def by_hand(rows, min_words=5):
    """doc_id, text -> sorted (doc_id, text left, dropped) by comparing each line with all others."""
    key = lambda d, i: (d is None, d or 0, i)
    lines = [(key(d, i), tuple(x.lower().split())) for d, t in rows if t is not None for i, x in enumerate(t.split("\n"))]
    lines = [(k, w) for k, w in lines if len(w) >= min_words]
    gone = {k for k, w in lines if any(o < k and abs(len(v) - len(w)) < 2 and edit_distance(v, w) <= 1 for o, v in lines)}
    out = []
    for d, t in rows:
        parts = [] if t is None else t.split("\n")
        drop = [i for i in range(len(parts)) if key(d, i) in gone]
        out.append((d, None if t is None else "\n".join(x for i, x in enumerate(parts) if i not in drop), drop, len(parts)))
    return sorted(out, key=str)


def run(df, **settings):
    got = dedup_lines(df, **settings).collect()
    assert all(r.n_dropped == len(r.dropped) for r in got)
    return sorted(((r.doc_id, r.text, r.dropped, r.n_lines) for r in got), key=str)


def test_variant_hashes_are_those_of_the_sequences():
    values = np.random.default_rng(0).integers(0, 2**64, 50, dtype=np.uint64)
    whole, without = variant_hashes(values)
    assert whole == variant_hashes(values)[0]
    for i in range(50):
        assert without[i] == variant_hashes(np.delete(values, i))[0]


def test_within_one():
    rng = random.Random(1)
    for _ in range(3000):
        a = [rng.choice("abc") for _ in range(rng.randrange(7))]
        b = [rng.choice("abc") for _ in range(rng.randrange(7))]
        assert within_one(a, b) == (edit_distance(a, b) <= 1)


@pytest.mark.parametrize("bitmap", [64, 1 << 20])
def test_against_all_pairs(frame, bitmap):
    rng = random.Random(bitmap)
    base = [[rng.choice("abcdefgh") + str(rng.randrange(4)) for _ in range(rng.randint(3, 14))] for _ in range(25)]

    def line():
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(2)] = [rng.choice("xyz")] * rng.randrange(2)
        return rng.choice([" ", "  ", "\t"]).join(words).upper() + rng.choice(["", " ", "\r"])

    rows = [(i, "\n".join(line() for _ in range(rng.randrange(6)))) for i in rng.sample(range(500), 90)]
    assert run(frame(rows, "doc_id long, text string"), bitmap=bitmap) == by_hand(rows)


def test_many_lines_that_differ_in_one_word(frame):
    rows = [(i, f"item number {i} of the long list") for i in range(300)]
    assert [r[2] for r in sorted(run(frame(rows, "doc_id long, text string")))] == [[]] + [[0]] * 299


def test_odd_rows(frame):
    long_line = " ".join(f"w{i}" for i in range(30_000))
    rows = [
        (4, None), (5, ""), (6, "\n\n"), (7, "a b c d e\nA  B c d E\nshort one"), (8, "short one\n\na b c d e"), (8, "short one\n\na b c d e"),
        (None, "a b c d e\nonly here in the null row"), (None, "one more row without an id"), (9, long_line), (10, long_line + " end"),
        (11, "é è à ü ß"), (12, "É È À Ü ß"),
    ]
    got = run(frame([(*r, 1, [9]) for r in rows], "doc_id long, text string, n_lines int, dropped array<int>"))
    short = by_hand([r for r in rows if r[0] not in (9, 10)])
    assert got == sorted([*short, (9, long_line, [], 1), (10, "", [0], 1)], key=str)
    assert dedup_lines(frame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("min_words", [0, 1, 5])
def test_hashed_lines_are_those_of_their_words(frame, min_words):
    spaces = [c for c in map(chr, range(0x110000)) if c.isspace()]
    assert all(c.encode()[0] in SPACES for c in spaces)
    rng = random.Random(2)
    pieces = [*spaces, *[" "] * 20, *["\n"] * 5, *["A", "é", "Σ", "İ", "’", "Ω x", "Word", "two words"] * 6]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(60)))) for i in range(60)] + [(60, None), (61, " a b"), (62, "")]
    want = {(i, n): line.split() for i, t in rows for n, line in enumerate((t or "").lower().split("\n"))}
    want = {at: words for at, words in want.items() if len(words) >= min_words}
    got = {(r.doc_id, r.line): r for r in hashed_lines(frame(rows, "doc_id long, text string"), min_words).collect()}
    assert got.keys() == want.keys()
    assert all(sorted(h % 2**64 for h in got[at].halves) == sorted(halves_of(words)) for at, words in want.items())
    hashes = {(tuple(words), got[at].h, got[at].g) for at, words in want.items()}
    assert len(hashes) == len({h[0] for h in hashes}) == len({h[1:] for h in hashes})


def test_only_lines_that_may_have_a_partner_are_read_again_and_variants_are_made_once(spark, frame, monkeypatch):
    rows = [(i, "\n".join(f"w{i}x{j} b{i}x{j} c{i}x{j} d{i}x{j} e{i}x{j}" for j in range(20))) for i in range(50)]
    rows += [(50 + i, f"this one line is there {'twice' if i else 'once'}") for i in range(2)]
    taken, made = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counted_halves(words, real=lines.halves_of):
        taken.add(1)
        return real(words)

    def counted_hashes(values, real=lines.variant_hashes):
        made.add(1)
        return real(values)

    monkeypatch.setattr(lines, "halves_of", counted_halves)
    monkeypatch.setattr(lines, "variant_hashes", counted_hashes)
    assert [r[2] for r in run(frame(rows, "doc_id long, text string")) if r[2]] == [[0]]
    assert (taken.value, made.value) == (2, 2)


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, sf_dir, "documents").collect()]
    words = {}
    for d, t in docs:
        for i, x in enumerate((t or "").split("\n")):
            w = tuple(x.lower().split())
            if len(w) >= 5:
                words.setdefault(w, []).append((d, i))
    first = {w: min(at) for w, at in words.items()}
    gone = {at for w, every in words.items() for at in every if at > first[w]}
    by_variant = {}
    for w in first:
        for i in range(len(w)):
            by_variant.setdefault(w[:i] + w[i + 1 :], []).append(w)
    for v, near in by_variant.items():
        for w in near:
            if any(first[o] < first[w] and edit_distance(o, w) <= 1 for o in near if o != w) or (v in first and first[v] < first[w]):
                gone.add(first[w])
            if v in first and first[w] < first[v]:
                gone.add(first[v])
    got = queries.op3_line_dedup(spark, sf_dir).collect()
    assert {(r.doc_id, i) for r in got for i in r.dropped} == gone and len(got) == len(docs)
