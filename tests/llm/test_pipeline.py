import re
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before and after each stage over the smallest tables."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs.collect()]
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(at))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "SimHash near-dedup", "mixing sources", "packing"]
    for rows in stages[1:-1]:
        assert rows[0].asDict().keys() == stages[0][0].asDict().keys()


def test_toxicity_only_removes(stages):
    before, after = Counter(stages[0]), Counter(stages[1])
    assert not after - before and len(stages[1]) > 0.7 * len(stages[0])


def test_line_dedup_keeps_documents_and_leaves_no_equal_long_lines(stages):
    assert sorted(r.doc_id for r in stages[2]) == sorted(r.doc_id for r in stages[1])
    long_lines = [" ".join(w) for r in stages[2] for x in r.text.split("\n") if len(w := x.lower().split()) >= 5]
    assert len(long_lines) == len(set(long_lines)) and all(r.n_chars == len(r.text) for r in stages[2])


def test_near_dedup_keeps_one_of_each_group(stages):
    from hostledger.llm.simhash import fingerprint

    prints = {r.doc_id: fingerprint(r.text) for r in stages[2]}
    kept = {r.doc_id for r in stages[3]}
    near = lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 2
    assert len(kept) == len(stages[3])
    for a in kept:
        assert not any(near(a, b) for b in kept if b != a)
    for a in prints.keys() - kept:
        assert any(near(a, b) for b in prints if b != a)


def test_mix_takes_parts_of_documents(stages):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    texts = {r.doc_id: r.text for r in stages[3]}
    taken = Counter()
    for r in stages[4]:
        assert all(part in texts[r.doc_id] for part in r.text.split("\n"))
        taken[r.doc_id] += size(r.text)
    assert all(n <= 3 * size(texts[d]) for d, n in taken.items())
    assert abs(sum(taken.values()) / sum(map(size, texts.values())) - 1) < 0.05


def test_packing_holds_every_token(stages):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted = sum(len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in stages[4])
    assert sum(r.length for r in stages[5]) == wanted


def test_run_equals_the_stages(spark, stages):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
    assert Counter(map(key, rows)) == Counter(map(key, stages[5]))
