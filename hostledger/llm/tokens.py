"""Token counts by a two-tier lookup of pre-token lengths, without a shuffle of pre-tokens.

Tier one is a broadcast table of the most frequent pre-tokens and their numbers of tokens; tier two
is a cache in each Python worker, filled by encoding what the table misses. A text is split by the
tokenizer's own rule, so a count is a sum of looked-up lengths.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from .batches import kept_in_worker, send_small_batches

TABLE_SIZE = 32_768  # entries of tier one, under 1 MB when sent
SUMMARY_SIZE = 8_192  # pre-tokens each task reports
CACHE_SIZE = 150_000  # entries of tier two; when full, it is the one before, and a new one is filled
LONGEST_KEPT = 64  # characters of a pre-token worth keeping
CHUNK = 1 << 20  # characters split at a time

# Letters, digits and white space of these blocks are classed alike by Python and the tokenizers;
# texts with other characters are encoded by the library.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-įı-ſ"
DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-įı-ſ‐-‧€]*")
SPACE_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
# Fixed: the split rule and the byte alphabet of byte-level pair encoding.
BYTE_SPLIT = re.compile(
    rf"'(?:[sdmt]|ll|ve|re)| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^\s{LETTERS}{DIGITS}]+|\s+(?!\S)|\s+"
)


def byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte: itself if printable, else the next free one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


ALPHABET = byte_alphabet()


def as_bytes(piece: str) -> str:
    return piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(ALPHABET)


def chunks(text: str) -> Iterator[str]:
    """``text`` in parts of about a million characters, cut before single spaces, where no token crosses."""
    start = 0
    while len(text) - start > CHUNK:
        cut = SPACE_BETWEEN.search(text, start + CHUNK)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


class Lengths(dict):
    """Numbers of tokens by pre-token; a miss is encoded and kept while there is room."""

    def __init__(self, path: str, table: dict[str, int]):
        super().__init__(table)
        self.table = table
        self.before: dict[str, int] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def __missing__(self, piece: str) -> int:
        n = self.before.get(piece) or len(self.tokenizer.model.tokenize(as_bytes(piece)))
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= CACHE_SIZE + len(self.table):
                self.before = dict(self)
                self.clear()
                self.update(self.table)
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        if not PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return sum(len(self.tokenizer.encode(c, add_special_tokens=False).ids) for c in chunks(text))
        return sum(sum(map(self.__getitem__, BYTE_SPLIT.findall(c))) for c in chunks(text))


def frequent_pieces(texts: DataFrame) -> DataFrame:
    """(piece, n) of up to ``SUMMARY_SIZE`` frequent pre-tokens of each task, from all its texts."""

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text and PLAIN.fullmatch(text):
                    for c in chunks(text):
                        seen.update(BYTE_SPLIT.findall(c))
                    if len(seen) > 8 * SUMMARY_SIZE:
                        seen = Counter(dict(seen.most_common(2 * SUMMARY_SIZE)))
        top = [(p, n) for p, n in seen.most_common(SUMMARY_SIZE) if n > 1 and len(p) <= LONGEST_KEPT]
        yield pa.RecordBatch.from_pydict(
            {"piece": pa.array([p for p, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())}
        )

    return texts.mapInArrow(summaries, "piece string, n long")


def frequent_lengths(texts: DataFrame, path: str) -> dict[str, int]:
    """Tier one: lengths of the most frequent pre-tokens; it decides the speed, never a count."""
    top = (
        frequent_pieces(texts).groupBy("piece").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "piece").limit(TABLE_SIZE).collect()
    )
    model = Tokenizer.from_file(path).model
    return {r["piece"]: len(model.tokenize(as_bytes(r["piece"]))) for r in top}


def token_counter(path: str, table: dict[str, int], spark: SparkSession) -> Callable[[Column], Column]:
    """A column function: tokens of a text column, 0 for null."""
    sent = spark.sparkContext.broadcast(table)
    key = uuid.uuid4().hex

    @F.pandas_udf("long")
    def counted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = kept_in_worker(key, lambda: Lengths(path, sent.value)).count
        for part in parts:
            yield pd.Series([count(t) if t else 0 for t in part], dtype="int64")

    return counted


def count_tokens(documents: DataFrame, path: str, limit: int = 512, text: str = "text") -> DataFrame:
    """``documents`` with n_bytes, n_tokens and over_limit (more than ``limit`` tokens).

    ``path`` is a byte-level BPE file of the tokenizers library. Counts equal the library's without
    begin, end or added special tokens and without truncation; strings of special tokens inside a
    text count as the library counts them by default. A null text counts as empty. Every row is
    kept, repeated or not, an empty table gives an empty result, and columns of the input named like
    a new one are replaced.
    """
    spark = documents.sparkSession
    send_small_batches(spark)
    tokens = token_counter(path, frequent_lengths(documents.select(F.col(text)), path), spark)
    n_bytes: Column = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    return documents.withColumns({"n_bytes": n_bytes, "n_tokens": tokens(F.col(text))}).withColumn(
        "over_limit", F.col("n_tokens") > limit
    )
