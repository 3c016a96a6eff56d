"""Base spans against plain patterns, marginals against all labelings, and what the random field adds."""

import hashlib
import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from hostledger.llm import personal, queries
from hostledger.llm.personal import KINDS, LABELS, Field, base_spans, described, find_personal_data, marginals, masked, one_edit, skip_edges

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    def holds(kind, found):
        digits = re.sub("[^0-9]", "", found)
        if kind == "ip":
            return all(int(p) <= 255 for p in found.split("."))
        if kind == "card":
            total = sum(sum(map(int, str(2 * int(d)))) if i % 2 else int(d) for i, d in enumerate(digits[::-1]))
            return 12 <= len(digits) <= 19 and total % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    found = [(m.start(), KINDS.index(k), k, m.end()) for k, p in PLAIN.items() for m in p.finditer(text) if holds(k, m[0])]
    return [(s, e, i + 1) for s, i, _, e in sorted(found)]


CASES = [
    "", "a@b.c", "a@b.c_d@e.f", "@b.c x@y", "a@b@c.d", "x.y+z%1@mail-1.example.co.uk.", "é@é.com ü.a@b.de", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4", "1.2.3 1..2.3.4 9999.1.2.3.4",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111 1111 1111 1111", "4111111111111112", "41111111111111111111111", "+1 (743) 555-3824", "+1 (743) 555-3824 +49 30 123456",
    "+1 (743) 555-3824 4111111111111111", "++1 22 33 44 55", "+12345678", "+123456789", "+1 ((((((((((((((((((((", "a" * 9000 + "@" + "b" * 9000, "1" * 9000, "1." * 4000, "+1" * 4000,
]


@pytest.mark.parametrize("text", CASES)
def test_base_spans(text):
    assert base_spans(text) == plain_spans(text)


@settings(max_examples=1500, deadline=None)
@given(st.text(st.sampled_from("a@.+-_ 0127(é"), max_size=40))
def test_base_spans_of_any_text(text):
    assert base_spans(text) == plain_spans(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("a@.+- 0123456789(t"), max_size=80))
def test_open_mentions_stay_outside(text):
    mentions, edges = described(text)
    taken = [m for m in mentions if m[2]]
    free = [m for m in mentions if not m[2]]
    assert all(a[1] <= b[0] or b[1] <= a[0] for a in free for b in taken)
    assert all(a[1] <= b[0] for a, b in itertools.pairwise(sorted(free)))
    assert all(0 <= i < j < len(mentions) for i, j, _ in edges)


def by_all_labelings(nodes, edges, potentials):
    out = np.zeros_like(nodes)
    for labels in itertools.product(range(nodes.shape[1]), repeat=len(nodes)):
        weight = sum(nodes[i, y] for i, y in enumerate(labels)) + sum(potentials[k][labels[i], labels[j]] for i, j, k in edges)
        for i, y in enumerate(labels):
            out[i, y] += np.exp(weight)
    return out / out.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("edges, close", [([], 1e-9), ([(0, 1, 0), (1, 2, 1), (1, 3, 0), (3, 4, 2)], 1e-4), ([(0, 1, 0), (1, 2, 1), (2, 3, 1), (3, 4, 1), (0, 3, 0)], 0.05)])
def test_marginals(edges, close):
    rng = np.random.default_rng(3)
    nodes, potentials = rng.normal(size=(5, 3)), rng.normal(size=(3, 3, 3)) * 0.7
    got = marginals(nodes, np.array(edges, np.int64).reshape(-1, 3), potentials)
    assert np.abs(got - by_all_labelings(nodes, edges, potentials)).max() < close


def test_edges():
    keys = ["17435553824", "x", "7435553824", "17435553824", "4111111111111111", "4111111111111121", "411111111111112", "x"]
    assert skip_edges(keys) == {(0, 2): 1, (1, 7): 0, (0, 3): 0, (2, 3): 1, (4, 5): 1, (5, 6): 1}
    assert skip_edges(["17435553824", "5553824", "995553824"]) == {(0, 2): 2}
    for a, b, want in [("abc", "abc", False), ("abc", "abd", True), ("abc", "ab", True), ("abc", "xabc", True), ("abc", "acb", False), ("a", "abc", False)]:
        assert one_edit(a, b) == one_edit(b, a) == want


def test_equal_evidence_gives_no_span():
    node = Field({}, {}).node("number |16", 0, False)
    assert node.argmax() == 0 and len(node) == LABELS


TEACH = [
    "call +1 (743) 555-1111 or mail ab.c@mail.example.com from 10.20.30.40 with 4111 1111 1111 1111 please",
    "call +1 (212) 555-2222 or mail dd.e@mail.example.org from 10.20.30.41 with 4111111111111111 please",
] * 20
ADDED = {
    "two cards 4111111111111111 4012888888881881 in a row": ["card:10:26", "card:27:43"],
    "+1 (743) 555-3824 as said, (743) 555-3824 and 743.555.3824 too": ["phone:0:17", "phone:27:41", "phone:46:58"],
    "write than.92@mail2.example.com, that is than.92 [at] mail2 [dot] example [dot] com only": ["email:6:31", "email:41:83"],
    "from 70.23.22.157 and again 70[.]23[.]22[.]157": ["ip:5:17", "ip:28:46"],
    "+1 (843) 555-7672 170.106.47.218 is both": ["phone:0:17", "ip:18:32"],
    "card 4012888888881881 or was it 4012888888881882": ["card:5:21", "card:32:48"],
}
CLEAN = [
    "in 2024 some 1,234,567 of 7654321 people, or 12 34 56 78 90 12 34 56", "order 4111111111111112 is no card", "look at example.com at noon", "version 1.2.300.4567",
    "(743) 555-3824", "10.20.30", "", None, "plain words only " * 50,
]


def test_the_field_adds_repeated_and_swallowed_mentions(frame):
    rows = [(i, t, "n", 1) for i, t in enumerate([*ADDED, *CLEAN, *TEACH, "4111111111111111 " * 4000])]
    got = {r.doc_id: r for r in find_personal_data(frame(rows, "doc_id int, text string, spans string, mentions int")).withColumn("all", personal.shown(F.col("spans"))).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        base = [(s.start, s.end, 1 + KINDS.index(s.kind)) for s in got[i].spans if s.base]
        assert base == plain_spans(text or "")
        if text in ADDED:
            assert got[i]["all"].split(",") == ADDED[text], text
        elif text in CLEAN:
            assert got[i]["all"] == ""
    assert len(got[len(rows) - 1].spans) == 4000


def test_nulls_repeats_and_no_rows(frame):
    rows = [(None, "a@b.c"), (1, "a@b.c"), (1, "a@b.c"), (None, None)]
    assert sorted(len(r.spans) for r in find_personal_data(frame(rows, "doc_id long, text string")).collect()) == [0, 1, 1, 1]
    assert find_personal_data(frame([], "doc_id long, text string")).count() == 0


def test_masked_texts(frame):
    df = frame([("x a@b.c y +1 22 333 4444 z",), ("none",), ("é a@b.c",)], "text string").withColumn("doc_id", F.lit(1))
    texts = df.select("text", "doc_id").collect()
    spans = [[(KINDS[k - 1], s, e) for s, e, k in base_spans(t.text)] for t in texts]
    held = frame([(t.text, s) for t, s in zip(texts, spans, strict=True)], "text string, spans array<struct<kind:string,start:bigint,end:bigint>>")
    assert sorted(r[0] for r in held.select(masked(F.col("text"), F.col("spans"))).collect()) == ["none", "x [email] y [phone] z", "é [email]"]


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in queries.table(spark, sf_dir, "documents").collect()}
    got = queries.op11_personal_data(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        base = [(KINDS[k - 1], s, e) for s, e, k in plain_spans(texts[r.doc_id])]
        assert [r[f"n_{k}"] for k in KINDS] == [sum(b[0] == k for b in base) for k in KINDS]
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))
