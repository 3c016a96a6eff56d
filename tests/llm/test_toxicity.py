import random
import zlib

import numpy as np
import pytest

from hostledger.llm.toxicity import OTHER, SIGN_OF, SIGNS, Channel, Decoder, Features, best_cut, fit, fit_logistic, language_model, score_documents, trigram_counts

WORDS = "the cat sat on a mat and saw that it was not so bad to be here with all of them".split()


def corpus(n=400):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(5, 40))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(["grumble", "snotface", "dimwit"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def decoder(spark):
    rows, _ = corpus()
    return Decoder(language_model(trigram_counts(spark.createDataFrame([(t,) for _, t in rows], "text string"))), Channel())


def test_trigram_counts_cover_whole_texts(spark):
    texts = ["ab", None, "", "ab " * 600_000]
    counts = trigram_counts(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert counts[0, 2, 3] == 600_001


@pytest.mark.parametrize(
    ("token", "words"),
    [("d1mw1t", ["dimwit"]), ("gruuumble", ["grumble"]), ("sn0tf4ce", ["snotface"]), ("d.i.m.w.i.t", ["dimwit"]), ("dim-wit", ["dimwit"]),
     ("d!mwit!!", ["dimwit"]), ("that", ["that"]), ("2024", []), ("dimwіt", ["dimwit"]), ("", []), ("...", [])],
)
def test_restored_words(decoder, token, words):
    assert decoder.restore(token) == words


def test_long_tokens_are_decoded(decoder):
    assert decoder.restore("gr" + "u" * 100 + "mble") == ["grumble"]
    marked = ".".join("the cat was a dimwit and a grumble on that mat".replace(" ", ""))
    assert len(marked) > 64 and {"dimwit", "grumble"} <= set(decoder.restore(marked))
    long = "sn0tf4ce-" * 5_000  # over many steps, with the same result as word by word
    assert decoder.restore(long) == ["snotface"] * 5_000
    for token in ["d1mw1t.4nd-" * 9, "gr.u" * 40, "1!0$" * 30 + "a"]:
        states = {(0, 0): (0.0, "")}  # without putting anything aside
        for options in [*decoder.lattice(token), [(" ", 0.0)]]:
            after = {}
            for (a, b), (score, text) in states.items():
                for written, cost in options:
                    x, y, total = a, b, score + cost
                    for c in written:
                        z = SIGN_OF.get(c, OTHER)
                        total += decoder.model[(x * SIGNS + y) * SIGNS + z]
                        x, y = y, z
                    if (x, y) not in after or after[x, y][0] < total:
                        after[x, y] = (total, text + written)
            states = after
        assert decoder.decode(token) == max(states.values())[1].strip()


def test_words_of_spaced_out_text(decoder):
    found = Features(decoder).of("  ".join(" ".join(w) for w in "that cat was not a dimwit but it sat on a grumble".split()))
    assert {"dimwit", "grumble"} <= found
    assert {"dimwit", "grumble"} <= Features(decoder).of(" ".join("thatcatwasadimwitandthatmatwasagrumble"))


def test_viterbi_finds_the_best_of_all_readings(decoder):
    def readings(lattice):
        if not lattice:
            yield "", 0.0
            return
        for text, cost in readings(lattice[:-1]):
            for written, more in lattice[-1]:
                yield text + written, cost + more

    from hostledger.llm.toxicity import OTHER, SIGN_OF, SIGNS

    def value(text):
        a = b = total = 0
        for c in text + " ":
            z = SIGN_OF.get(c, OTHER)
            total += decoder.model[(a * SIGNS + b) * SIGNS + z]
            a, b = b, z
        return total

    for token in ["s4t", "d1mw1t", "tthh3", "a-b.c", "0n$1", "l1ll|1"]:
        best = max(readings(decoder.lattice(token)), key=lambda r: r[1] + value(r[0]))
        assert decoder.decode(token) == best[0].strip()


def test_spaced_words(decoder):
    found = Features(decoder).of("so d i m w i t  there")
    assert "dimwit" in found and "there" in found


def test_logistic_and_cut():
    rng = np.random.default_rng(0)
    rows = [[0] if i % 3 == 0 else [1] for i in range(600)]
    labels = np.array([float(r == [0]) for r in rows])
    weights, bias = fit_logistic(rows, labels, 2, Channel())
    assert bias + weights[0] > 2 and bias + weights[1] < -2
    z, y = rng.normal(size=200).round(1), (rng.random(200) < 0.5).astype(float)
    cut = best_cut(z, y)
    assert ((z >= cut) != y).sum() == min(((z >= c) != y).sum() for c in [*z, 9.0])
    assert best_cut(np.array([0.0, 1.0, 4.0]), np.array([0.0, 0.0, 1.0])) == 2.0


def test_held_out_accuracy(frame):
    rows, labels = corpus()
    rows += [(1000, "so you are a d1mw1t"), (1001, "he is a s n o t f a c e"), (1002, None), (1003, ""), (None, "the cat"), (1000, "so you are a d1mw1t")]
    got = score_documents(frame([(*r, 7.0) for r in rows], "doc_id long, text string, score double"), frame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(rows)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    special = {r.doc_id: r.predicted for r in got if r.doc_id is None or r.doc_id >= 1000}
    assert special == {1000: 1, 1001: 1, 1002: 0, 1003: 0, None: 0}


def test_held_out_labels_do_not_teach(frame):
    rows, labels = corpus(200)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    turned = [(i, 1 - t if held(i) else t) for i, t in labels]
    docs, schema = frame(rows, "doc_id long, text string"), "doc_id long, toxic int"
    a, b = fit(docs, frame(labels, schema)), fit(docs, frame(turned, schema))
    assert a.known == b.known and np.allclose(a.weights, b.weights) and a.bias == pytest.approx(b.bias)


def test_without_labels(frame):
    docs = frame([(1, "a b")], "doc_id long, text string")
    none = frame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert [r.predicted for r in score_documents(docs, none).collect()] == [0]
    assert score_documents(frame([], "doc_id long, text string"), none).count() == 0
