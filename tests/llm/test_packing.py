import random
import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hostledger.llm import queries
from hostledger.llm.packing import WordIds, best_fit, pack_documents, sequences

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [1]


def check(rows, texts, library, window):
    """Pieces cover each document once, windows are gapless, ids are the library's."""
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == texts.keys()
    for doc_id, parts in pieces.items():
        ids, at = ids_of(library, texts[doc_id]), 0
        for r in sorted(parts, key=lambda r: r.start):
            own = ids[r.start : r.start + r.length]
            assert (r.start, r.doc_tokens) == (at, len(ids)) and 0 < r.length == len(own)
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
            at += r.length
        assert at == len(ids)
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return windows


@pytest.mark.parametrize("window", [7, 64, 100])
def test_best_fit_takes_the_tightest_window(window):
    rng = random.Random(window)
    lengths = sorted((rng.randint(1, window) for _ in range(500)), reverse=True)
    left = []
    for length, (number, offset) in zip(lengths, best_fit(lengths, window), strict=True):
        fitting = [c for c in left if c >= length]
        if not fitting:
            assert (number, offset) == (len(left), 0)
            left.append(window)
        else:
            assert left[number] == min(fitting) and offset == window - left[number]
        left[number] -= length


@pytest.mark.parametrize(
    "text",
    ["", "a", "It's 12½ o'clock — DON'T", "ÀÉÎ ŸſŞ µªº", "<|endoftext|> in <|startoftext|>text", "日本語 テスト", "é́ İI", "x" * 5000,
     "tab\tnew\nline \r\n  end  ", "a\x1cb\x85c\xa0d", "😀🙂 ok", "​ zero", "ĐđŁł " * 300, "''s 'll'll 'S"],
)
def test_ids_equal_the_library(library, text):
    assert WordIds(PATH).encode(text) == struct.pack(f"<{len(ids_of(library, text)) - 1}I", *ids_of(library, text)[:-1])


def test_documents(spark, frame, library):
    rng = random.Random(2)
    texts = {i: " ".join(rng.choice(["one", "Two", "trié", "x1"]) for _ in range(rng.choice([0, 1, 5, 90, 700]))) for i in range(120)}
    texts |= {500: None, 501: "", 502: "word " * 5000, None: "no id"}
    rows = [(i, t, "clash") for i, t in texts.items()]
    packed = pack_documents(frame(rows, "doc_id long, text string, offset string"), PATH, window=64, group=100, keep_ids=True)
    got = packed.collect()
    windows = check(got, texts, library, 64)
    tokens = sum(r.length for r in got)
    assert len(windows) < 1.05 * tokens / 64 + len(got) / 100 + 1
    whole = {r.sequence_id: r.ids for r in sequences(packed, 64).collect()}
    for r in got:
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == ids_of(library, texts[r.doc_id])[r.start : r.start + r.length]
    for number, parts in windows.items():
        n = sum(length for _, length in parts)
        assert len(whole[number]) == (n if n & (n - 1) == 0 else 64)


def test_repeated_rows_and_empty_table(frame):
    rows = [(1, "same words"), (1, "same words"), (1, "other")]
    got = pack_documents(frame(rows, "doc_id long, text string"), PATH).collect()
    assert len(got) == 3 and len({(r.sequence_id, r.offset) for r in got}) == 3
    assert pack_documents(frame([], "doc_id long, text string"), PATH).count() == 0


def test_query(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in queries.table(spark, sf_dir, "documents").collect()}
    rows = queries.op4_packing(spark, sf_dir).collect()
    windows = check(rows, texts, library, 2048)
    tokens = sum(r.length for r in rows)
    assert len(windows) * 2048 < 1.02 * tokens + 2048
