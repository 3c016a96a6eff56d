import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from hostledger.llm import queries, tokens
from hostledger.llm.tokens import Lengths, chunks, count_tokens, frequent_lengths

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def by_library(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


TEXTS = [
    "", "Hello world", "it's we'll  they've   I'd", " leading", "trailing  ", "a\n\n b\t\tc \r\n", "x" * 3000, "1234567 12½²", "ÀÉÎ straße ſ",
    "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "日本語のテキスト", "😀🙂 emoji", "nb\xa0sp", "a\x1cb\x85c", "é combining",
    "soft\xadhyphen", "İıŸ", "---- ==== ????", "don’t “quote” – dash…", "   ", "\n", " \n ", "a  b", "’s 's",
]


@pytest.mark.parametrize("text", TEXTS)
def test_counts_equal_the_library(text):
    assert Lengths(PATH, {}).count(text) == by_library(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aZé '’sldt1²½ \n\t\r.-!|<>\xa0ĳß$"), max_size=60))
def test_counts_equal_the_library_on_any_text(text):
    assert Lengths(PATH, {}).count(text) == by_library(text)


def test_long_texts_are_split_where_tokens_end(monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK", 50)
    text = "some words, and  more  words\n\nit's 12 " * 40 + "x" * 200 + " end"
    assert len(list(chunks(text))) > 10 and "".join(chunks(text)) == text
    assert Lengths(PATH, {}).count(text) == by_library(text)


def test_cache_is_dropped_when_full(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_SIZE", 10)
    held = Lengths(PATH, {"word": 1})
    text = " ".join(f"w{i}" for i in range(200))
    assert held.count(text) == by_library(text) and len(held) <= 12 and held["word"] == 1


def test_documents(frame):
    rows = [(i, t, -1) for i, t in enumerate(TEXTS)] + [(900, None, -1), (None, "no id", -1), (1, TEXTS[1], -1), (901, "tok " * 513, -1), (902, "tok " * 511, -1)]
    df = frame(rows, "doc_id long, text string, n_tokens int")
    table = frequent_lengths(df.select("text"), PATH)
    assert table and all(n == len(LIBRARY.encode(p, add_special_tokens=False).ids) for p, n in table.items())
    got = count_tokens(df, PATH)
    assert sorted(map(str, got.collect())) == sorted(
        f"Row(doc_id={d}, text={t!r}, n_tokens={by_library(t)}, n_bytes={len((t or '').encode())}, over_limit={by_library(t) > 512})" for d, t, _ in rows
    )
    assert count_tokens(frame([], "doc_id long, text string"), PATH).count() == 0


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in queries.table(spark, sf_dir, "documents").collect()}
    rows = queries.op2_token_counts(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = by_library(texts[r.doc_id])
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((texts[r.doc_id] or "").encode()), n > 512)
