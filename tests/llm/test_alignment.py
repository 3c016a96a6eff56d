"""Groups, links and their counts against a plain version over the libraries' own tokens."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from hostledger.llm import alignment, queries
from hostledger.llm.alignment import Aligner, Side, align_documents, aligned, overlaps

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A = Tokenizer.from_file(PATHS[0])
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
ALIGNER = Aligner(*PATHS)


def plain_tokens(text):
    """(id, bytes) of both sides by the libraries."""
    side_b = []
    for i in B.encode(text):
        piece = B.id_to_piece(i)
        side_b.append((i, bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()))
    return [(i, ALIGNER.encoder.a.bytes[i]) for i in A.encode(" " + text, add_special_tokens=False).ids], side_b


def plain_groups(text):
    """[(ids of a, ids of b)] of the groups; empty if a side does not give the text back."""
    if not text:
        return []
    sides = plain_tokens(text)
    if any(b"".join(x for _, x in side) != (" " + text).encode() for side in sides):
        return []
    ends = [set(np.cumsum([len(x) for _, x in side]).tolist()) for side in sides]
    cuts = sorted(ends[0] & ends[1])
    out = [([], []) for _ in cuts]
    for s, side in enumerate(sides):
        at, group = 0, 0
        for i, x in side:
            at += len(x)
            out[group][s].append(i)
            group += at == cuts[group]
    return out


def plain_rows(texts):
    grouped = [plain_groups(t) for t in texts]
    links = [Counter((a, b) for ga, gb in groups for a in ga for b in gb) for groups in grouped]
    count = Counter(pair for found in links for pair in found)
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    rows = []
    for groups, found in zip(grouped, links, strict=True):
        shown = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        rows.append((
            sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(found.values()),
            sum(n for p, n in found.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in found.items()),
            hashlib.sha256(shown.encode()).hexdigest() if groups else "",
        ))
    return rows


TEXTS = [
    "", "a", " ", "  two  spaces ", "Hello world, it's fine.", "line\nline\n\n\tx", "<|endoftext|> and </s> <s> <unk>", "a▁b c", "x" * 999, "日本語のテキスト 一二三", "😀🙂 emoji 🙂",
    "naïve café – “quoted”", "nul\x00byte", "1234567 89", "ﬁ ①", "​﻿", "aaaa" * 50 + " " + "ab" * 300, "é", "<0x41> [x]", "\r\n", "tab\tend ", "ü" * 40, "▁", " ▁x", "don’t I'll", "а б в",
    "d'tune l'reau ''s 'ss' x'lle", "5². 5².² a;\r\nb),\r", "\n\nword \n word\r\r", "a1b22c.d,e(f)g", "x\n 's", "12.34,5", "...?!”, “a”.", "\t\t if (x) {\r\n}",
]


@pytest.mark.parametrize("text", TEXTS)
def test_groups_of_texts(text):
    found = aligned([text], ALIGNER)[0]
    assert found.row()[:5] == tuple(plain_rows([text])[0][i] for i in (0, 1, 2, 3, 6))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("aeZé '’slt1² \n\t\r.-;<>|▁\xa0日😀"), max_size=40), max_size=6))
def test_groups_of_any_texts(texts):
    for text, found in zip(texts, aligned(texts, ALIGNER), strict=True):
        assert found.row()[:5] == tuple(plain_rows([text])[0][i] for i in (0, 1, 2, 3, 6))


def test_overlaps_are_the_tokens_that_share_a_byte():
    rng = np.random.default_rng(5)
    cuts = [np.unique(np.append(rng.integers(1, 400, n), [100, 250, 400])) for n in (60, 90)]
    doc = lambda end: np.searchsorted([100, 250, 400], end)
    a, b = (Side(doc(c), c, np.concatenate([[0], c[:-1]]), c) for c in cuts)
    want = {(i, j) for i in range(len(a.id)) for j in range(len(b.id)) if max(a.start[i], b.start[j]) < min(a.end[i], b.end[j])}
    assert set(zip(*overlaps(a, b), strict=True)) == want


@settings(max_examples=1500, deadline=None)
@given(st.text(st.sampled_from("aesltvrdéß''’12½²  \n\t\r.;,)(-“”–€x"), max_size=30))
def test_units_give_the_ids_of_whole_texts(text):
    ids = [np.frombuffer(b"".join(side), np.uint32).tolist() for side in ALIGNER.encoder.encode([" " + text])]
    assert ids == [A.encode(" " + text, add_special_tokens=False).ids, B.encode(text) if text else B.encode("x ")[-1:]]


def test_cache_of_two_generations(monkeypatch):
    monkeypatch.setattr(alignment, "CACHE_SIZE", 12)
    small, texts = Aligner(*PATHS), [" ".join(f"w{i * i % 90} and" for i in range(n)) for n in range(60)]
    assert [f.row()[4] for t in texts for f in aligned([t], small)] == [f.row()[4] for f in aligned(texts, ALIGNER)]
    assert len(small.encoder.held) <= 24


def test_small_portions_give_the_same(monkeypatch):
    texts = ["some words, and  more  words\n\nit's 12 " * 30, "x▁" * 99 + " end " * 99, "plain text " * 50 + "x" * 300, None, "aa"]
    want = [tuple(map(str, f.row()[:5])) + (f.row()[5].tolist(), f.row()[6].tolist()) for f in aligned(texts, ALIGNER)]
    monkeypatch.setattr(alignment, "AT_ONCE", 100)
    monkeypatch.setattr(alignment, "LINKS_AT_ONCE", 7)
    monkeypatch.setattr(alignment, "LARGE_GROUP", 3)
    monkeypatch.setattr("hostledger.llm.tokens.CHUNK", 40)
    assert [tuple(map(str, f.row()[:5])) + (f.row()[5].tolist(), f.row()[6].tolist()) for f in aligned(texts, ALIGNER)] == want


@pytest.mark.parametrize("frequent", [1 << 18, 40, 0])
def test_documents(frame, frequent):
    texts = [*TEXTS, None, "Hello world, it's fine.", "Hello there", "fine " * 3000, "a", None]
    rows = [(None if i % 9 == 4 else i % 20, t, "x", i, 1.5) for i, t in enumerate(texts)]
    got = align_documents(frame(rows, "doc_id int, text string, row string, a int, times double"), *PATHS, frequent=frequent).collect()
    want = [(r[0], *p) for r, p in zip(rows, plain_rows(texts), strict=True)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_no_documents(frame):
    assert align_documents(frame([], "doc_id long, text string"), *PATHS).count() == 0


def test_query(spark, sf_dir):
    rows = queries.table(spark, sf_dir, "documents").collect()
    want = {r.doc_id: p for r, p in zip(rows, plain_rows([r.text for r in rows]), strict=True)}
    got = queries.op13_alignment(spark, sf_dir).collect()
    assert len(got) == len(rows) and all(tuple(r)[1:] == want[r.doc_id] for r in got)
