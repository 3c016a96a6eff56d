"""Pack token ids of documents into windows of fixed length by best-fit decreasing.

A document is cut into full windows and a rest. Rests are dealt out evenly to groups of bounded
size; each group takes its pieces from long to short and puts each into the open window with the
least room that still fits, found in a segment tree over the remaining capacities.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from ..session import cut_lineage
from .batches import kept_in_worker, portions, send_small_batches
from .tokens import CACHE_SIZE, DIGITS, LETTERS, LONGEST_KEPT, PLAIN, as_bytes, chunks

WINDOW = 2048
END_ID = 1
GROUP = 50_000  # pieces packed together
# Fixed: the split rule of the tokenizer file, over lower-cased text.
WORD_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^\s{LETTERS}{DIGITS}]+")


class WordIds(dict):
    """The ids of a word as little-endian 32-bit bytes; a miss is encoded and kept while there is room."""

    def __init__(self, path: str):
        super().__init__()
        self.before: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word) or as_ids(t.id for t in self.tokenizer.model.tokenize(as_bytes(word)))
        if len(word) <= LONGEST_KEPT:
            if len(self) >= CACHE_SIZE:
                self.before = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as the library gives them."""
        if not PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return b"".join(as_ids(self.tokenizer.encode(c, add_special_tokens=False).ids) for c in chunks(text))
        return b"".join(b"".join(map(self.__getitem__, WORD_SPLIT.findall(c.lower()))) for c in chunks(text))


def as_ids(ids) -> bytes:
    packed = array("I", ids)
    if packed.itemsize != 4:
        packed = array("L", packed)
    return packed.tobytes()


def cut_documents(documents: DataFrame, path: str, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``window`` ids: doc_id, start, length, ids_crc32, doc_tokens, dealt[, ids].

    ``dealt`` numbers the pieces of a task one after the other, from a start that depends on the task.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept_in_worker(path, lambda: WordIds(path))
        end = END_ID.to_bytes(4, "little")
        dealt = TaskContext.get().partitionId() * 7919
        for batch in portions(batches):
            source, start, length, crc, total, number, ids = [], [], [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                value = text.as_py()
                data = (words.encode(value) if value else b"") + end
                n = len(data) // 4
                for at in range(0, n, window):
                    piece = data[4 * at : 4 * (at + window)]
                    source.append(i)
                    start.append(at)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
                    number.append(dealt)
                    dealt += 1
                    if keep_ids:
                        ids.append(array("I", piece).tolist())
            columns = [batch.column("doc_id").take(pa.array(source, pa.int64()))]
            columns += [pa.array(x, pa.int64()) for x in (start, length, crc, total, number)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "dealt"]
            if keep_ids:
                columns, names = [*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, dealt long"
    return documents.select("doc_id", "text").mapInArrow(cut, schema + (", ids array<int>" if keep_ids else ""))


class Capacities:
    """Open windows by remaining capacity, with a segment tree that finds the tightest one."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.filled = bytearray(2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        node = self.leaves + capacity
        while node and not self.filled[node]:
            self.filled[node] = 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (capacity, window) of least capacity not under ``need``, or None."""
        filled, node = self.filled, self.leaves + need
        if not filled[node]:
            while node > 1 and (node & 1 or not filled[node + 1]):  # up, until a right neighbour has windows
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if filled[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        window = self.windows[capacity].pop()
        if not self.windows[capacity]:
            filled[node] = 0
            node >>= 1
            while node and not (filled[2 * node] or filled[2 * node + 1]):
                filled[node] = 0
                node >>= 1
        return capacity, window


def best_fit(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """(window number, offset) of each of ``lengths``, which come from long to short."""
    open_, placed, windows = Capacities(window), [], 0
    for length in lengths:
        found = open_.take(length)
        capacity, number = found or (window, windows)
        windows += found is None
        placed.append((number, window - capacity))
        if capacity > length:
            open_.put(capacity - length, number)
    return placed


def pack_documents(
    documents: DataFrame, path: str, window: int = WINDOW, group: int = GROUP, keep_ids: bool = False
) -> DataFrame:
    """Every piece of every document with its place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of the tokenizers library for the file at ``path`` without added
    special tokens, then id 1; a null or empty text is id 1 alone. Every row is packed, repeated or
    not and with a null doc_id too; an empty table gives no rows; columns other than doc_id and text
    are ignored. ``keep_ids`` adds the ids of each piece. Equal input files give equal sequences.
    """
    send_small_batches(documents.sparkSession)
    pieces = cut_lineage(cut_documents(documents, path, window, keep_ids))
    groups = max(1, -(-pieces.count() // group))
    schema = pieces.drop("dealt").schema.add("sequence_id", "long").add("offset", "long")

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("dealt", "ascending"), ("start", "ascending")])
        placed = best_fit(table.column("length").to_pylist(), window)
        first = table.column("group")[0].as_py() << 40
        sequence = pa.array([first + number for number, _ in placed], pa.int64())
        offset = pa.array([at for _, at in placed], pa.int64())
        table = table.drop_columns(["dealt", "group"])
        return table.append_column("sequence_id", sequence).append_column("offset", offset)

    dealt = pieces.withColumn("group", F.pmod("dealt", F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(pack, schema)


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """sequence_id and ids of each window; padded to ``window`` unless its length is a power of two."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # a window at most
    joined = pieces.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
    n = F.size("ids")
    whole = n.bitwiseAND(n - 1) == 0
    padding = F.array_repeat(F.lit(pad_id), F.when(whole, 0).otherwise(window - n))
    return joined.withColumn("ids", F.concat("ids", padding))
