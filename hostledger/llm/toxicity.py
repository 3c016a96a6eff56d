"""Toxicity: a noisy channel is decoded, then the restored words are scored.

Leetspeak, inserted marks or spaces and repeated letters make a lattice of what each character may
stand for. Viterbi finds the reading that is best under a character trigram model of the whole
corpus and the costs of the channel. A logistic model over restored words and their beginnings,
fitted on labelled rows, gives the score.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from math import log
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..session import cut_lineage
from .batches import kept_in_worker, portions, send_small_batches

SIGNS = 64  # of the language model: 0 boundary, 1 digit or sign, 2-27 a-z, then ß … ÿ, 61 other letters
BOUNDARY, SIGN, OTHER = 0, 1, 61
HIDDEN = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])  # invisible characters
# Letters that a character is written for.
READS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "(": "c", "<": "c", "{": "c",
}
# Cyrillic and Greek letters that look like Latin ones.
LOOKS = str.maketrans("аеорсухіѕјԁкмтвнαοιν", "aeopcyxisjdkmtbhaoiv")
MARKS = ".-_*~'/\\,:;^=#"
TRIM = ".,;:!?\"'()[]{}…%*#&-_~«»„“”"
SPACED = re.compile(r"(?<!\S)[^\s,;:?\"](?:[ \t]+[^\s,;:?\"]){2,}(?!\S)")
LATIN, FOREIGN = re.compile("[a-z]"), re.compile("[Ͱ-ӿ]")
RUN = re.compile(r"(.)\1+", re.DOTALL)
WORDS = re.compile(r"[^\W\d_]+")
GAP = re.compile(r"[ \t]+")
LONGEST = 64  # characters of a token whose features are cached; longer ones are decoded every time
SETTLED = 64  # runs decoded before what all readings share is put aside
STARTS = (4, 5, 6)


@dataclass(frozen=True)
class Channel:
    """Log costs of the channel, and the settings of the classifier."""

    read: float = log(0.5)
    drop: float = log(0.05)
    repeat: float = log(0.05)
    train_rows: int = 40_000  # labelled rows at most that the classifier is fitted on
    features: int = 4096
    least_gain: float = 8.0  # likelihood ratio that a feature needs
    steps: int = 300
    penalty: float = 0.005
    keep: float = 0.3  # of the features of a row at each step, so that one word alone counts too


def sign_table() -> np.ndarray:
    """The sign of each code point below 0x2070; higher ones are other letters."""
    table = np.full(0x2070, OTHER, dtype=np.uint8)
    table[:0x180] = [SIGN if chr(c).isdigit() or chr(c) in READS else OTHER if chr(c).isalpha() else BOUNDARY for c in range(0x180)]
    table[ord("a") : ord("z") + 1] = np.arange(2, 28)
    table[0xDF:0x100] = np.where(np.arange(0xDF, 0x100) == 0xF7, BOUNDARY, np.arange(28, 28 + 0x21))
    table[0x2000:] = BOUNDARY
    return table


TABLE = sign_table()
SIGN_OF = {chr(c): int(TABLE[c]) for c in range(len(TABLE))}


def trigram_counts(texts: DataFrame) -> np.ndarray:
    """Counts of all sign trigrams of all texts; each task sums up its own, Spark adds them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIGNS**3, dtype=np.int64)
        for batch in portions(batches):
            whole = "  ".join(["", *(t.as_py() for t in batch.column(0) if t.is_valid), ""]).lower()
            for at in range(0, max(0, len(whole) - 2), 1 << 21):
                part = whole[at : at + (1 << 21) + 2]
                points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                signs = np.where(points < len(TABLE), TABLE[np.minimum(points, len(TABLE) - 1)], OTHER).astype(np.int64)
                total += np.bincount((signs[:-2] * SIGNS + signs[1:-1]) * SIGNS + signs[2:], minlength=SIGNS**3)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"gram": pa.array(used), "n": pa.array(total[used])})

    rows = texts.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SIGNS**3)  # SIGNS**3 rows at most
    counts[rows["gram"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.float64)
    return counts.reshape(SIGNS, SIGNS, SIGNS)


def language_model(counts: np.ndarray) -> list[float]:
    """log P(third | first, second), trigrams backed by bigrams and single signs."""
    one = counts.sum(axis=(0, 1)) + 1.0
    one /= one.sum()
    pairs = counts.sum(axis=0)
    two = (pairs + 8 * one) / (pairs.sum(axis=1, keepdims=True) + 8)
    three = (counts + 8 * two[None, :, :]) / (counts.sum(axis=2, keepdims=True) + 8)
    return np.log(three).ravel().tolist()


class Decoder:
    """Restores words under a language model."""

    def __init__(self, model: list[float], channel: Channel):
        self.model, self.channel = model, channel

    def lattice(self, token: str) -> list[list[tuple[str, float]]]:
        """For each run of equal characters: what it may stand for, with its cost."""
        return list(self.steps(token))

    def steps(self, token: str) -> Iterator[list[tuple[str, float]]]:
        """The lattice of ``token``, one run at a time."""
        at = 0
        while at < len(token):
            c, end = token[at], at + 1
            while end < len(token) and token[end] == c:
                end += 1
            n, again = end - at, self.channel.repeat
            if c.isalpha():
                options = [(c, 0.0 if n == 1 else again)]
                if n > 1:
                    options.append((c * 2, 0.0 if n == 2 else again))
            elif c in READS:
                extra = self.channel.read + (again if n > 2 else 0.0)
                options = [(c, 0.0)] + [(r * k, extra) for r in READS[c] for k in range(1, min(n, 2) + 1)]
            else:
                options = [(" ", 0.0), ("", self.channel.drop)]
            yield options
            at = end

    def decode(self, token: str) -> str:
        """The best reading of ``token``; marks that stay are spaces.

        What all readings still in question begin with is final, so of a long token only the open ends
        are held.
        """
        model, done = self.model, []
        states = {(BOUNDARY, BOUNDARY): (0.0, "")}
        for at, options in enumerate(chain(self.steps(token), [[(" ", 0.0)]]), 1):
            after: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (score, text) in states.items():
                for written, cost in options:
                    x, y, total = a, b, score + cost
                    for c in written:
                        z = SIGN_OF.get(c, OTHER)
                        total += model[(x * SIGNS + y) * SIGNS + z]
                        x, y = y, z
                    if (x, y) not in after or after[x, y][0] < total:
                        after[x, y] = (total, text + written)
            states = after
            if at % SETTLED == 0:
                common = commonprefix([text for _, text in states.values()])
                done.append(common)
                states = {k: (score, text[len(common) :]) for k, (score, text) in states.items()}
        return ("".join(done) + max(states.values())[1]).strip()

    def restore(self, token: str) -> list[str]:
        """Words of a lower-case token without white space."""
        if not token.isascii():
            token = token.translate(HIDDEN)
            if FOREIGN.search(token) and LATIN.search(token):
                token = token.translate(LOOKS)
        plain = token.strip(TRIM)
        if plain.isalpha() and not RUN.search(plain):
            return [plain]
        token = token.lstrip(TRIM.replace("!", "").replace("(", "").replace("{", "")).rstrip(TRIM)
        if not token or not any(c.isalpha() for c in token):
            return WORDS.findall(token)
        return WORDS.findall(self.decode(token))


def features_of(words: list[str]) -> list[str]:
    return [f for w in words for f in (w, *(f"{w[:k]}…" for k in STARTS if len(w) >= k))]


class Features(dict):
    """What each token of a text contributes; of the tokens seen, the last ``room`` to twice as many are kept."""

    def __init__(self, decoder: Decoder, known: dict[str, int] | None = None, room: int = 150_000):
        super().__init__()
        self.decoder, self.known, self.room = decoder, known, room
        self.before: dict[str, tuple] = {}

    def __missing__(self, token: str) -> tuple:
        value = self.before.get(token)
        if value is None:
            found = features_of(self.decoder.restore(token))
            value = tuple(found) if self.known is None else tuple(self.known[f] for f in found if f in self.known)
        if len(self) >= self.room:
            self.before = dict(self)
            self.clear()
        if len(token) <= LONGEST:
            self[token] = value
        return value

    def of(self, text: str | None) -> set:
        """Features of a whole text."""
        out: set = set()
        lower = (text or "").lower()
        for token in set(lower.replace(", ", " ").replace(". ", " ").replace(".\n", "\n").split()):
            out.update(self[token])
        for spaced in SPACED.findall(lower):
            out.update(self["".join(spaced.split())])
            out.update(self[".".join(spaced.split())])
            narrow = min(map(len, GAP.findall(spaced)))
            for word in re.split(rf"[ \t]{{{narrow + 1},}}", spaced):  # wider gaps may be ends of words
                out.update(self["".join(word.split())])
        return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def training_rows(documents: DataFrame, labels: DataFrame, channel: Channel) -> DataFrame:
    """text, toxic of labelled rows outside the held-out fold, for ``train_rows`` labels at most, written once."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(channel.train_rows)
    rows = documents.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    # as many rows as labels: of repeated documents one
    return cut_lineage(rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"))


def feature_counts(rows: DataFrame, model: list[float], channel: Channel) -> DataFrame:
    """feature, toxic, clean: in how many rows of either kind it occurs."""
    sent, key = rows.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, counts = kept_in_worker(key, lambda: Features(Decoder(sent.value, channel), room=50_000)), (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            names = list(counts[0].keys() | counts[1].keys())
            columns = {"feature": pa.array(names, pa.string())}
            for label, name in ((1, "toxic"), (0, "clean")):
                columns[name] = pa.array([counts[label][f] for f in names], pa.int64())
            counts[0].clear()
            counts[1].clear()
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic"), strict=True):
                counts[1 if toxic.as_py() else 0].update(cache.of(text.as_py()))
                if len(counts[0]) + len(counts[1]) > 300_000:
                    yield flush()
        yield flush()

    parts = rows.mapInArrow(count, "feature string, toxic long, clean long")
    return parts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def choose_features(counts: DataFrame, toxic: int, clean: int, channel: Channel) -> list[str]:
    """The features that tell the classes apart best, by the likelihood ratio."""
    share = F.lit(toxic / max(1, toxic + clean))
    n = F.col("toxic") + F.col("clean")
    term = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    gain = term(F.col("toxic"), n * share) + term(F.col("clean"), n * (1 - share))
    gain += term(toxic - F.col("toxic"), (toxic + clean - n) * share) + term(clean - F.col("clean"), (toxic + clean - n) * (1 - share))
    top = counts.withColumn("gain", gain).where(F.col("gain") >= channel.least_gain)
    top = top.orderBy(F.desc("gain"), "feature").limit(channel.features)
    return [r["feature"] for r in top.select("feature").collect()]


def fit_logistic(rows: list[list[int]], labels: np.ndarray, size: int, channel: Channel) -> tuple[np.ndarray, float]:
    """Weights and intercept of a penalised logistic regression on sets of features.

    Gradient descent with momentum; every step sees a random part of each row's features.
    """
    draw = np.random.default_rng(size)
    lengths = np.array([len(r) for r in rows], dtype=np.int64)
    all_who, all_what = np.repeat(np.arange(len(rows)), lengths), np.fromiter((f for r in rows for f in r), np.int64, lengths.sum())
    weights, n = np.zeros(size), max(1, len(rows))
    rate = np.clip(labels.mean() if len(rows) else 0.5, 1e-3, 1 - 1e-3)
    bias = log(rate / (1 - rate))
    first, second, seen = np.zeros(size + 1), np.zeros(size + 1), 0
    for _ in range(channel.steps):
        kept = draw.random(len(all_what)) < channel.keep
        who, what = all_who[kept], all_what[kept]
        z = bias + np.bincount(who, weights[what], minlength=len(rows))
        wrong = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels
        slope = np.append(np.bincount(what, wrong[who], minlength=size) + channel.penalty * weights, wrong.sum()) / n
        seen += 1
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope * slope
        step = 0.1 * (first / (1 - 0.9**seen)) / (np.sqrt(second / (1 - 0.999**seen)) + 1e-8)
        weights, bias = weights - step[:-1], bias - step[-1]
    if not 0 < labels.sum() < len(labels):
        return weights, float(bias)
    return weights, -best_cut(np.bincount(all_who, weights[all_what], minlength=len(rows)), labels)


def best_cut(z: np.ndarray, labels: np.ndarray) -> float:
    """The value from which rows count as toxic with fewest errors; between two rows, nearer to the clean one."""
    order = np.argsort(z, kind="stable")
    z, labels = z[order], labels[order]
    # errors if the first i rows count as clean and the others as toxic
    errors = np.concatenate([[0], np.cumsum(labels)]) + (len(labels) - labels.sum()) - np.concatenate([[0], np.cumsum(1 - labels)])
    below, above = np.concatenate([[z[0] - 1], z]), np.concatenate([z, [z[-1] + 1]])
    errors[below >= above] = np.inf  # no cut between equal values
    least = np.flatnonzero(errors == errors.min())
    at = least[(above - below)[least].argmax()]
    return float(below[at] + (above[at] - below[at]) / 3)


@dataclass(frozen=True)
class Model:
    """What is sent to the tasks: a trigram table and ``features`` weights, bounded whatever the corpus."""

    language: list[float]
    known: dict[str, int]
    weights: list[float]
    bias: float
    channel: Channel


def fit(documents: DataFrame, labels: DataFrame, channel: Channel = Channel()) -> Model:
    """The language model from all texts, the classifier from labelled rows outside the held-out fold."""
    send_small_batches(documents.sparkSession)
    language = language_model(trigram_counts(documents.select("text")))
    rows = training_rows(documents, labels, channel)
    n = {r["toxic"]: r["count"] for r in rows.select((F.col("toxic") > 0).cast("int").alias("toxic")).groupBy("toxic").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return Model(language, {}, [], 40.0 if toxic else -40.0, channel)
    names = choose_features(feature_counts(rows, language, channel), toxic, clean, channel)
    known = {f: i for i, f in enumerate(names)}
    sent, key = documents.sparkSession.sparkContext.broadcast(language), uuid.uuid4().hex

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = kept_in_worker(key, lambda: Features(Decoder(sent.value, channel), known))
        for batch in batches:
            found = [sorted(cache.of(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column("toxic")], ["found", "toxic"])

    fitted = rows.mapInArrow(indexed, "found array<int>, toxic int").collect()  # train_rows at most
    weights, bias = fit_logistic([r["found"] for r in fitted], np.array([float(r["toxic"] > 0) for r in fitted]), len(names), channel)
    return Model(language, known, weights.tolist(), bias, channel)


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` with ``score``, from the text alone."""
    sent, key = documents.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    names = [c for c in documents.columns if c != "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        cache, weights = kept_in_worker(key, lambda: Features(Decoder(held.language, held.channel), held.known)), held.weights
        for batch in portions(batches):
            z = np.array([held.bias + sum(weights[i] for i in sorted(cache.of(t.as_py()))) for t in batch.column("text")])
            score = pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))), pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], score], [*names, "score"])

    own = documents.select(*names)
    return own.mapInArrow(run, StructType([*own.schema, StructField("score", DoubleType())]))


def score_documents(documents: DataFrame, labels: DataFrame, channel: Channel = Channel()) -> DataFrame:
    """``documents`` with held_out, score (0 to 1) and predicted (1 from 0.5 on).

    Only the text of a row enters its score; a null text scores as an empty one. ``labels`` (doc_id,
    toxic) teach outside the held-out fold, where crc32 of doc_id as text is no multiple of 5; a
    doc_id labelled twice counts as toxic if one label says so, null labels teach nothing. Without
    labels of both kinds every row gets the score of the kind there is, 0 if there is none. Rows with
    a null doc_id are scored and held_out is false. Every row is kept, an empty table gives no rows,
    and columns of the input named like a new one are replaced.
    """
    model = fit(documents, labels, channel)
    result = scored(documents, model)
    return result.withColumns(
        {"held_out": held_out(F.col("doc_id")), "predicted": (F.col("score") >= 0.5).cast("int")}
    )
