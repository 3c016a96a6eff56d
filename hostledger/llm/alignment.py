"""Align the tokens of two tokenizers over the same bytes, and score links by how many documents hold them.

Per batch of texts, pandas.merge_asof keyed by document finds for each token start the other side's
covering token; both directions together are the overlaps, and overlapping tokens with equal ends
close a group. Which ids are linked in a document is written once; counts of id pairs are an
ordinary aggregation, read back by documents in two tiers: a broadcast table of the most frequent
pairs, of bounded size, and a join for the rest, which no frequent pair can skew.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from ..session import cut_lineage
from .batches import kept_in_worker, portions, send_small_batches
from .packing import as_ids
from .tokens import ALPHABET, BYTE_SPLIT, CACHE_SIZE, DIGITS, LETTERS, LONGEST_KEPT, PLAIN, as_bytes, chunks

AT_ONCE = 1 << 18  # characters aligned at a time
LINKS_AT_ONCE = 1 << 22  # links expanded at a time
LARGE_GROUP = 1 << 12  # links of a group from which equal ids are merged first
FREQUENT = 1 << 18  # id pairs looked up without a join, 5 MB when sent
ID_BITS = 20  # of a token id; both vocabularies must be smaller
DOT = "▁"
LETTER = re.compile(f"[{LETTERS}{DIGITS}]")
UNIT = re.compile(rf"\s*(?<! )'(?:[sdmt]|ll|ve|re)[{LETTERS}]*|\s*(?:[{LETTERS}]+|[{DIGITS}]+|[^\s{LETTERS}{DIGITS}]+)|\s+")


class ByteLevel:
    """A byte-level BPE file of the tokenizers library; strings of special tokens are plain text."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        back = {c: b for b, c in ALPHABET.items()}
        vocabulary = self.tokenizer.get_vocab()
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, at in vocabulary.items():
            if all(c in back for c in entry):
                self.bytes[at] = bytes(back[c] for c in entry)

    def encode_units(self, units: list[str]) -> list[bytes]:
        tokenize = self.tokenizer.model.tokenize
        return [as_ids([t.id for piece in BYTE_SPLIT.findall(unit) for t in tokenize(as_bytes(piece))]) for unit in units]

    def encode(self, chunk: str) -> bytes:
        return as_ids(self.tokenizer.encode(chunk, add_special_tokens=False).ids)


class WithSpace:
    """A sentencepiece model that puts a space before a text, and none of whose pieces spans words."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes: list[bytes] = []
        self.across: set[str] = set()  # pairs of characters that a piece joins over the end of a unit
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_control(i) or self.model.is_unknown(i):
                self.bytes.append(b"")
            elif self.model.is_byte(i):
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            else:
                if DOT in piece.lstrip(DOT):
                    raise ValueError("a piece spans words")
                text = piece.replace(DOT, " ")
                self.bytes.append(text.encode())
                ends = [m.end() for m in UNIT.finditer(text)][:-1]
                self.across |= {text[end - 1 : end + 1] for end in ends}
        self.ahead = {before: len(self.model.encode(before)) for before in "x."}

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Ids of units, each behind a character that no piece joins with its first one."""
        before = ["." if LETTER.match(unit) else "x" for unit in units]
        found = self.model.encode([x + unit for x, unit in zip(before, units, strict=True)], num_threads=1)
        return [as_ids(ids[self.ahead[x] :]) for x, ids in zip(before, found, strict=True)]

    def encode(self, chunk: str) -> bytes:
        """The ids of a chunk that starts with a space."""
        return as_ids(self.model.encode(chunk[1:]))


class Encoder:
    """Ids of chunks on both sides, unit by unit from a cache of two generations.

    A unit is a word, a number or a run of signs with the white space before it. Both tokenizers end
    a token where a unit ends, in chunks of characters that all sides class alike and without the
    pairs of characters over which a piece of side b goes on; other chunks are encoded whole.
    """

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), WithSpace(path_b)
        self.held: dict[str, tuple[bytes, bytes]] = {}
        self.before: dict[str, tuple[bytes, bytes]] = {}

    def look_up(self, units: list[str]) -> list[tuple[bytes, bytes]]:
        found = list(map(self.held.get, units))
        if None not in found:
            return found
        missing = {unit: self.before.get(unit) for unit, ids in zip(units, found, strict=True) if ids is None}
        fresh = [unit for unit, ids in missing.items() if ids is None]
        missing |= zip(fresh, zip(self.a.encode_units(fresh), self.b.encode_units(fresh), strict=True), strict=True)
        if len(self.held) + len(missing) > CACHE_SIZE:
            self.before, self.held = self.held, {}
        self.held |= {unit: ids for unit, ids in missing.items() if len(unit) <= LONGEST_KEPT}
        return [missing[unit] if ids is None else ids for unit, ids in zip(units, found, strict=True)]

    def encode(self, parts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """The ids of every chunk on side a and on side b."""
        plain = [bool(PLAIN.fullmatch(part)) and not any(pair in part for pair in self.b.across) for part in parts]
        units = [UNIT.findall(part) if good else [] for part, good in zip(parts, plain, strict=True)]
        found = self.look_up([unit for own in units for unit in own])
        at, out = 0, ([], [])
        for part, own, good in zip(parts, units, plain, strict=True):
            ids = found[at : at + len(own)] if good else [(self.a.encode(part), self.b.encode(part))]
            at += len(own)
            for side in (0, 1):
                out[side].append(b"".join([pair[side] for pair in ids]))
        return out


@dataclass
class Side:
    """Tokens of a batch on one side: their document, id, first byte and the byte after the last."""

    doc: np.ndarray
    id: np.ndarray
    start: np.ndarray
    end: np.ndarray

    @staticmethod
    def of(doc: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> Side:
        end = np.cumsum(sizes[ids])
        return Side(doc, ids, end - sizes[ids], end)


def overlaps(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``a`` and ``b`` of tokens of one document that share a byte; some pairs come twice."""
    left = pd.DataFrame({"start": a.start, "doc": a.doc, "at_a": np.arange(len(a.id))})
    right = pd.DataFrame({"start": b.start, "doc": b.doc, "at_b": np.arange(len(b.id))})
    over = pd.merge_asof(left, right, on="start", by="doc")
    under = pd.merge_asof(right, left, on="start", by="doc")
    both = pd.concat([over[["at_a", "at_b"]], under[["at_a", "at_b"]]])
    return both["at_a"].to_numpy(np.int64), both["at_b"].to_numpy(np.int64)


def groups(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """The group number of every token of ``a`` and of ``b``; overlapping tokens with equal ends close a group."""
    i, j = overlaps(a, b)
    closing = a.end[i] == b.end[j]
    last_a, last_b = np.zeros(len(a.id), np.int64), np.zeros(len(b.id), np.int64)
    last_a[i[closing]] = 1
    last_b[j[closing]] = 1
    return np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b


def merged(keys: np.ndarray, weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``keys`` in order and the sum of their weights, one each if there are none."""
    if weights is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    if weights is None:
        return keys[first], np.diff(first, append=len(keys))
    return keys[first], np.add.reduceat(weights, first) if len(first) else weights


def linked_ids(a: Side, b: Side, group_a: np.ndarray, group_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, id of a, id of b) of all links as one number, and how many links each has."""
    n = int(group_a[-1]) + 1
    doc_of = np.empty(n, np.int64)
    doc_of[group_a] = a.doc
    id_a, id_b, weigh_a, weigh_b = a.id, b.id, None, None
    if (np.bincount(group_a, minlength=n) * np.bincount(group_b, minlength=n)).max() > LARGE_GROUP:
        mask = (1 << ID_BITS) - 1
        keys, weigh_a = merged(group_a << ID_BITS | id_a, None)
        group_a, id_a = keys >> ID_BITS, keys & mask
        keys, weigh_b = merged(group_b << ID_BITS | id_b, None)
        group_b, id_b = keys >> ID_BITS, keys & mask
    many = np.bincount(group_b, minlength=n)
    first = np.cumsum(many) - many
    each = many[group_a]  # links of every token of a
    until = np.cumsum(each)
    parts, at = [], 0
    while at < len(id_a):
        done = int(until[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(until, done + LINKS_AT_ONCE, "right")))
        of = slice(at, stop)
        total = int(until[stop - 1]) - done
        inner = np.arange(total) - np.repeat(until[of] - each[of] - done, each[of])
        j = np.repeat(first[group_a[of]], each[of]) + inner
        ids = np.repeat(doc_of[group_a[of]] << 2 * ID_BITS | id_a[of] << ID_BITS, each[of]) | id_b[j]
        weights = None if weigh_a is None else np.repeat(weigh_a[of], each[of]) * weigh_b[j]
        parts.append(merged(ids, weights))
        at = stop
    if len(parts) == 1:
        return parts[0]
    return merged(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


@dataclass
class Found:
    """What is known of a document so far."""

    bad: bool = False
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    seen: Any = field(default_factory=hashlib.sha256)
    pairs: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def row(self) -> tuple:
        if self.bad or not self.n_a:
            return 0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64)
        pairs = self.pairs[0]
        if len(self.pairs) > 1:
            pairs = merged(np.concatenate([p[0] for p in self.pairs]), np.concatenate([p[1] for p in self.pairs]))
        return self.n_a, self.n_b, self.n_groups, self.n_links, self.seen.hexdigest(), *pairs


class Aligner:
    """Both tokenizers with the bytes of their ids, and the text forms of groups."""

    def __init__(self, path_a: str, path_b: str):
        self.encoder = Encoder(path_a, path_b)
        sides = self.encoder.a, self.encoder.b
        self.tables = [pa.array(side.bytes, pa.binary()) for side in sides]
        self.sizes = [np.array([len(x) for x in side.bytes], np.int64) for side in sides]
        if max(map(len, self.sizes)) > 1 << ID_BITS:
            raise ValueError("a vocabulary is too large")
        forms = [f"{i}{mark}" for side, end in zip(self.sizes, "|;", strict=True) for i in range(len(side)) for mark in ("," + end)]
        self.forms = pa.array(forms, pa.string())

    def align(self, parts: list[tuple[int, str]], found: list[Found]) -> None:
        """Add the ``parts`` (document, chunk that starts with a space) to what is known of their documents."""
        ids, docs = [], []
        for data in self.encoder.encode([chunk for _, chunk in parts]):
            ids.append(np.frombuffer(b"".join(data), np.uint32).astype(np.int64))
            docs.append(np.repeat([doc for doc, _ in parts], [len(d) // 4 for d in data]))
        whole = [chunk.encode("utf-8", "surrogatepass") for _, chunk in parts]
        joined = b"".join(whole)
        if any(joined_bytes(t, i) != joined for t, i in zip(self.tables, ids, strict=True)):
            for doc, first, stop in runs(np.array([doc for doc, _ in parts])):
                own = b"".join(whole[first:stop])
                found[doc].bad |= any(joined_bytes(t, i[d == doc]) != own for t, i, d in zip(self.tables, ids, docs, strict=True))
            for s in (0, 1):
                keep = ~np.isin(docs[s], [doc for doc, _ in parts if found[doc].bad])
                ids[s], docs[s] = ids[s][keep], docs[s][keep]
            if not len(ids[0]):
                return
        a, b = (Side.of(d, i, s) for d, i, s in zip(docs, ids, self.sizes, strict=True))
        group_a, group_b = groups(a, b)
        many_a, many_b = np.bincount(group_a), np.bincount(group_b)
        keys, times = linked_ids(a, b, group_a, group_b)
        self._add_texts(a, b, group_a, group_b, many_a, many_b, found)
        doc_of = np.empty(len(many_a), np.int64)
        doc_of[group_a] = a.doc
        key_doc = keys >> 2 * ID_BITS
        for doc, first, stop in runs(doc_of):
            f = found[doc]
            f.n_a += int(many_a[first:stop].sum())
            f.n_b += int(many_b[first:stop].sum())
            f.n_groups += stop - first
            f.n_links += int((many_a[first:stop] * many_b[first:stop]).sum())
        for doc, first, stop in runs(key_doc):
            found[doc].pairs.append((keys[first:stop] & ((1 << 2 * ID_BITS) - 1), times[first:stop]))

    def _add_texts(self, a: Side, b: Side, group_a, group_b, many_a, many_b, found: list[Found]) -> None:
        """Hash ``a1,a2|b1;a3|b2,b3``: tokens in the order of groups, each with the mark that follows it."""
        closing_a, closing_b = (np.append(g[1:] != g[:-1], True) for g in (group_a, group_b))
        place_a = np.arange(len(a.id)) + (np.cumsum(many_b) - many_b)[group_a]
        place_b = np.arange(len(b.id)) + np.cumsum(many_a)[group_b]
        code, doc = np.empty(len(a.id) + len(b.id), np.int64), np.empty(len(a.id) + len(b.id), np.int64)
        code[place_a], doc[place_a] = 2 * a.id + closing_a, a.doc
        code[place_b], doc[place_b] = 2 * (len(self.sizes[0]) + b.id) + closing_b, b.doc
        text = self.forms.take(pa.array(code))
        at, data = np.frombuffer(text.buffers()[1], np.int32, len(code) + 1), memoryview(text.buffers()[2])
        for own, first, stop in runs(doc):
            if found[own].n_a:  # the group before ended with an earlier part
                found[own].seen.update(b";")
            found[own].seen.update(data[at[first] : at[stop] - 1])


def joined_bytes(table: pa.Array, ids: np.ndarray) -> bytes:
    if not len(ids):
        return b""
    taken = table.take(pa.array(ids))
    return taken.buffers()[2].to_pybytes()[: np.frombuffer(taken.buffers()[1], np.int32)[len(ids)]]


def runs(values: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, first, stop) of every run of equal values."""
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
    first, stop = np.concatenate([[0], cuts]), np.append(cuts, len(values))
    return [(int(values[f]), int(f), int(s)) for f, s in zip(first, stop, strict=True)] if len(values) else []


def aligned(texts: list[str | None], aligner: Aligner) -> list[Found]:
    """What is found of each of ``texts``, aligned about ``AT_ONCE`` characters at a time."""
    found = [Found() for _ in texts]
    parts, held = [], 0
    for doc, text in enumerate(texts):
        for chunk in chunks(" " + text) if text else ():
            parts.append((doc, chunk))
            held += len(chunk)
            if held >= AT_ONCE:
                aligner.align(parts, found)
                parts, held = [], 0
    if parts:
        aligner.align(parts, found)
    return found


PAIRS = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("times", pa.int64())])
SCHEMA = "row long, doc_id {}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<struct<a:int,b:int,times:bigint>>"


def linked_pairs(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document its counts, groups_sha256 and the distinct id pairs linked in it, with their numbers of links."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = kept_in_worker(f"{path_a} {path_b}", lambda: Aligner(path_a, path_b))
        for batch in portions(batches):
            rows = [f.row() for f in aligned(batch.column("text").to_pylist(), aligner)]
            stats = list(zip(*rows, strict=True))
            offsets = pa.array(np.cumsum([0, *map(len, stats[5])]), pa.int32())
            keys, times = np.concatenate(stats[5]), np.concatenate(stats[6])
            low = keys & ((1 << ID_BITS) - 1)
            values = pa.StructArray.from_arrays([pa.array(keys >> ID_BITS, pa.int32()), pa.array(low, pa.int32()), pa.array(times, pa.int64())], fields=list(PAIRS))
            columns = [batch.column("row"), batch.column("doc_id"), *(pa.array(s, pa.int64()) for s in stats[:4])]
            columns += [pa.array(stats[4], pa.string()), pa.ListArray.from_arrays(offsets, values)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    numbered = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return numbered.mapInArrow(align, SCHEMA.format(kind))


def most_frequent(counts: DataFrame, most: int) -> tuple[int, np.ndarray, np.ndarray]:
    """A least count that at most ``most`` of ``counts`` (a, b, n) reach, and keys and counts of those, by key."""
    step = F.floor(F.log2("n") * 4).cast("int")  # 256 steps at most
    sizes = counts.groupBy(step.alias("step")).agg(F.count("*").alias("pairs"), F.min("n").alias("least")).collect()
    least, total = None, 0
    for r in sorted(sizes, key=lambda r: -r["step"]):
        total += r["pairs"]
        if total > most:
            break
        least = r["least"]
    if least is None:
        least = 1 << 62
    found = counts.where(F.col("n") >= least).select((F.shiftleft(F.col("a").cast("long"), ID_BITS) + F.col("b")).alias("key"), "n").toArrow()
    key, n = (found.column(c).to_numpy().astype(np.int64) for c in ("key", "n"))
    order = np.argsort(key)
    return least, key[order], n[order]


def scored_links(found: DataFrame, counts: DataFrame, frequent: int) -> DataFrame:
    """row, n_best and count_sum of every row of ``found`` (row, pairs)."""
    spark = found.sparkSession
    least, keys, numbers = most_frequent(counts, frequent)
    tops = counts.groupBy("a").agg(F.max("n").alias("n")).toArrow()  # an entry for each id of the vocabulary at most
    best = np.zeros(1 << ID_BITS, np.int64)
    best[tops.column("a").to_numpy()] = tops.column("n").to_numpy()
    sent = spark.sparkContext.broadcast((keys, numbers, best[: int(np.flatnonzero(best).max(initial=0)) + 1]))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, numbers, best = sent.value
        for batch in batches:
            lists = batch.column("pairs")
            flat = lists.flatten()
            a, b, times = (np.asarray(flat.field(c)).astype(np.int64) for c in ("a", "b", "times"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            key = a << ID_BITS | b
            at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            hit = keys[at] == key if len(keys) else np.zeros(len(key), bool)
            n = np.where(hit, numbers[at], 0) if len(keys) else np.zeros(len(key), np.int64)
            sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            np.add.at(sums[0], row, times * (hit & (n == best[a])))
            np.add.at(sums[1], row, times * n)
            rest = flat.filter(pa.array(~hit))
            top = pa.array(best[a[~hit]], pa.int64())
            values = pa.StructArray.from_arrays([*rest.flatten(), top], names=["a", "b", "times", "best"])
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row[~hit], minlength=batch.num_rows))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), *(pa.array(s) for s in sums), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)],
                ["row", "n_best", "count_sum", "rest"],
            )

    schema = "row long, n_best long, count_sum long, rest array<struct<a:int,b:int,times:bigint,best:bigint>>"
    looked = cut_lineage(found.select("row", "pairs").mapInArrow(look_up, schema))
    rare = looked.select("row", F.inline("rest")).join(counts.where(F.col("n") < least), ["a", "b"])
    more = rare.groupBy("row").agg(
        F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
        F.sum(F.col("times") * F.col("n")).alias("more_sum"),
    )
    return looked.drop("rest").join(more, "row", "left").select(
        "row", *((F.col(c) + F.coalesce(m, F.lit(0))).alias(c) for c, m in (("n_best", "more_best"), ("count_sum", "more_sum")))
    )


def align_documents(documents: DataFrame, path_a: str, path_b: str, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of ``documents``.

    Side a encodes a space and the text by the byte-level file at ``path_a``, side b the text by the
    sentencepiece model at ``path_b``, which adds the space; strings of special tokens are plain text.
    Byte offsets where tokens of both sides end cut them into groups, and all tokens of a group are
    linked. The count of an id pair is the number of rows that hold it linked; n_best is how many of a row's
    links have the highest count that the id of side a has anywhere, count_sum the sum over its
    links. A null or empty text, and one that a side does not reproduce, has zeros and an empty
    groups_sha256. Repeated rows and rows with a null doc_id count like others, an empty table
    gives no rows, and other columns are ignored. ``frequent`` bounds the pairs that are looked up
    without a join, and changes no result.
    """
    send_small_batches(documents.sparkSession)
    found = cut_lineage(linked_pairs(documents, path_a, path_b))
    counts = cut_lineage(found.select(F.inline("pairs")).groupBy("a", "b").agg(F.count("*").alias("n")))
    scores = scored_links(found, counts, frequent)
    return found.drop("pairs").join(scores, "row").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
