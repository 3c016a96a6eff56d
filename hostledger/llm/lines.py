"""Line dedup by a join of deletion neighbourhoods, the earliest line kept.

Lines are compared as lower-cased words. Two lines are near if one word changed, added or removed
turns one into the other: then they share a variant, the words of a line without one of them.
Variants are emitted as hashed keys with the place of the missing word, so lines with an equal key
differ in that word only, and the earliest of a key is all the others need to know; nothing is
paired up within a key.

Most lines have no near partner, and their variants need not be written: a near pair agrees on its
first or on its last half. Halves that different lines share are put into a bitmap of fixed size, and
a line emits only the variants without a word outside a half it shares. The bitmap lets some more
variants pass, never fewer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, StringType

from ..operators.numbering import number_rows
from ..session import cut_lineage
from .batches import portions, send_small_batches

MIN_WORDS = 5  # one word of five: a similarity of 0.8 or more
BITMAP = 1 << 26  # bits
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
SPACES = b"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \xc2\xe1\xe2\xe3"  # first UTF-8 bytes of all white space, and of more
MAY_PART = bytes(byte in SPACES for byte in range(256))


def halves_of(words: list[str]) -> list[int]:
    """Hashes of the halves that a line one word away shares: first and last, for either rounding of the half."""
    n, out = len(words), []
    for k in {n // 2, (n + 1) // 2}:
        for side, part in (("f", words[:k]), ("l", words[n - k :])):
            out.append(xxhash.xxh64_intdigest(" ".join(part), k) & ~1 | (side == "l"))
    return out


def order_of() -> Column:
    """The order of lines: doc_id, null last, then the number of the line."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line")


def normal_lines(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All lines of ``texts`` as lower-cased words, one space between two and a newline at the end, in UTF-8.

    With the places of the newlines and of the spaces. Only lines that may hold other white space than
    single spaces between words are taken apart.
    """
    data = ("\n".join([text.lower() for text in texts]) + "\n").encode()
    places = np.flatnonzero(np.frombuffer(data.translate(MAY_PART), bool))
    kinds = np.frombuffer(data, np.uint8)[places]
    space, newline = kinds == 32, kinds == 10
    odd = ~(space | newline)
    odd[1:] |= (np.diff(places) == 1) & (space[1:] | space[:-1])  # two spaces, or one at an end of a line
    odd[0] |= places[0] == 0 and space[0]
    if not odd.any():
        return data, places[newline], places[space]
    lines = data.split(b"\n")
    for at in np.unique(np.searchsorted(places[newline], places[odd])):
        lines[at] = " ".join(lines[at].decode().split()).encode()
    data = b"\n".join(lines)
    found = np.frombuffer(data, np.uint8)
    return data, np.flatnonzero(found == 10), np.flatnonzero(found == 32)


def hashes_of(data: bytes, starts: np.ndarray, ends: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    parts = zip(starts.tolist(), ends.tolist(), seeds.tolist(), strict=True)
    return np.frombuffer(b"".join([xxhash.xxh64_digest(data[a:z], k) for a, z, k in parts]), ">u8").astype(np.uint64)


def halves_within(
    data: bytes, starts: np.ndarray, ends: np.ndarray, sizes: np.ndarray, spaces: np.ndarray, ahead: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """``halves_of`` each line between ``starts`` and ``ends``, and where those of each line end.

    ``sizes`` are the numbers of words, ``ahead`` those of the ``spaces`` before each line.
    """
    each = 2 + 2 * (sizes & 1)
    stops = np.cumsum(each)
    out = np.empty(each.sum(), dtype=np.uint64)
    odd = np.flatnonzero(sizes & 1)
    spaces = np.append(spaces, 0)  # lines without a space look up one that is not used
    for lines, k, at in ((slice(None), sizes // 2, 0), (odd, (sizes + 1) // 2, 2)):
        k, n, a, z, s, to = (x[lines] for x in (k, sizes, starts, ends, ahead, stops - each + at))
        head = np.select([k == 0, k == n], [a, z], spaces[s + k - 1])
        tail = np.select([k == 0, k == n], [z, a], spaces[s + n - k - 1] + 1)
        out[to] = hashes_of(data, a, head, k) & ~np.uint64(1)
        out[to + 1] = hashes_of(data, tail, z, k) | np.uint64(1)
    return out, stops


def hashed_lines(documents: DataFrame, min_words: int) -> DataFrame:
    """doc_id, line (from 0), two hashes h and g and the halves of every line of ``min_words`` words or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            texts = [text or "" for text in batch.column("text").to_pylist()]
            data, ends, spaces = normal_lines(texts)
            starts = np.concatenate([[0], ends[:-1] + 1])
            until = np.searchsorted(spaces, ends)
            ahead = np.concatenate([[0], until[:-1]])
            sizes = np.where(ends > starts, until - ahead + 1, 0)
            counts = np.array([text.count("\n") + 1 for text in texts])
            rows = np.repeat(np.arange(len(texts)), counts)
            numbers = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
            kept = np.flatnonzero(sizes >= min_words)
            starts, ends, sizes, ahead = starts[kept], ends[kept], sizes[kept], ahead[kept]
            whole = b"".join([xxhash.xxh3_128_digest(data[a:z]) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)])
            h, g = np.frombuffer(whole, np.int64).reshape(-1, 2).T.copy()
            flat, stops = halves_within(data, starts, ends, sizes, spaces, ahead)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows[kept])), pa.array(numbers[kept].astype(np.int32)), pa.array(h), pa.array(g),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]).astype(np.int32)), pa.array(flat.view(np.int64))),
                ],
                ["doc_id", "line", "h", "g", "halves"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, line int, h long, g long, halves array<long>"
    return documents.select("doc_id", "text").mapInArrow(run, schema)


def contested_halves(lines: DataFrame) -> DataFrame:
    """Keys of halves that different lines share."""
    keys = lines.select("h", F.explode("halves").alias("key"))
    spread = keys.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    return spread.where("low < high").select("key")


def bits_of(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    keys = keys.view(np.uint64)
    return (keys & np.uint64(bits - 1)).astype(np.int64), (keys >> np.uint64(32) & np.uint64(bits - 1)).astype(np.int64)


def bitmap_of(keys: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of ``bits`` bits with two bits set for each key; its words are put together by Spark."""
    places = F.array(F.col("key").bitwiseAND(bits - 1), F.shiftrightunsigned("key", 32).bitwiseAND(bits - 1))
    words = (
        keys.select(F.explode(places).alias("place"))
        .groupBy(F.shiftright("place", 5).alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(31).cast("int"))).alias("value"))
    )
    table = words.toPandas()  # bits / 32 rows at most
    out = np.zeros(bits // 32, dtype=np.uint32)
    out[table["word"].to_numpy(dtype=np.int64)] = table["value"].to_numpy(dtype=np.int64).astype(np.uint32)
    return out


def in_bitmap(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    hit = np.ones(len(keys), dtype=bool)
    for place in bits_of(keys, len(table) * 32):
        hit &= (table[place >> 5] >> (place & 31).astype(np.uint32) & np.uint32(1)).astype(bool)
    return hit


def place_of(code: Column) -> Column:
    """The key of a line: the hash ``code`` of its doc_id, with its number in either half."""
    line = F.col("line").cast("long")
    return code.bitwiseXOR(line).bitwiseXOR(F.shiftleft(line, 32))


def candidate_places(lines: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """Of equal lines that have one of their halves in the bitmap, the ``key`` of the first one's place."""
    sent = lines.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            halves = batch.column("halves")
            total = np.concatenate([[0], np.cumsum(in_bitmap(np.asarray(halves.flatten()), sent.value))])
            ends = np.concatenate([[0], np.cumsum(np.asarray(halves.value_lengths()))])
            hit = total[ends[1:]] > total[ends[:-1]]
            yield batch.drop_columns(["halves"]).filter(pa.array(hit))

    kind = lines.schema["doc_id"].dataType.simpleString()
    found = lines.mapInArrow(run, f"doc_id {kind}, line int, h long, g long")
    first = found.groupBy("h", "g").agg(F.min(order_of()).alias("at")).select("at.doc_id", "at.line")
    return first.select(place_of(F.xxhash64("doc_id")).alias("key"))


def candidates(documents: DataFrame, places: np.ndarray, bitmap: np.ndarray, min_words: int) -> DataFrame:
    """Distinct lines with a half that others share: doc_id, line, id (in the order of lines), words, first, last.

    ``places`` is a bitmap of the places of their first ones, ``bitmap`` one of the halves; first and
    last say which half is shared.
    """
    sent = documents.sparkSession.sparkContext.broadcast((places, bitmap))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, shared = sent.value
        for batch in portions(batches):
            texts = [text or "" for text in batch.column("text").to_pylist()]
            counts = np.array([text.count("\n") + 1 for text in texts])
            at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            hit = np.flatnonzero(in_bitmap(np.repeat(np.asarray(batch.column("code")), counts) ^ at ^ at << 32, known))
            rows, numbers, found, sides = [], [], [], ([], [])
            lines, opened = [], -1
            for row, number in zip(np.repeat(np.arange(len(texts)), counts)[hit].tolist(), at[hit].tolist(), strict=True):
                if row != opened:
                    lines, opened = texts[row].split("\n"), row
                words = lines[number].lower().split()
                if len(words) < min_words:
                    continue
                keys = np.array(halves_of(words), dtype=np.uint64)
                contested = keys[in_bitmap(keys.view(np.int64), shared)] & np.uint64(1)
                if len(contested):
                    rows.append(row)
                    numbers.append(number)
                    found.append(" ".join(words))
                    for side in (0, 1):
                        sides[side].append(bool((contested == side).any()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(found, pa.string()),
                    pa.array(sides[0], pa.bool_()), pa.array(sides[1], pa.bool_()),
                ],
                ["doc_id", "line", "words", "first", "last"],
            )

    coded = documents.select("doc_id", "text", F.xxhash64("doc_id").alias("code"))
    lines = coded.mapInArrow(run, f"doc_id {kind}, line int, words string, first boolean, last boolean")
    distinct = lines.groupBy("words").agg(
        F.min(order_of()).alias("at"), F.bool_or("first").alias("first"), F.bool_or("last").alias("last")
    )
    distinct = distinct.select("at.none", "at.doc_id", "at.line", "words", "first", "last")
    return cut_lineage(number_rows(distinct, ["none", "doc_id", "line", "words"], "id"))


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def variant_hashes(values: np.ndarray) -> tuple[int, np.ndarray]:
    """The hash of a sequence and of the sequence without each of its members, in one pass."""
    powers = np.full(len(values) + 1, BASE, dtype=np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    ahead = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers[:-1], dtype=np.uint64, out=ahead[1:])
    return ahead[-1], ahead[:-1] + (ahead[-1] - ahead[1:]) * np.uint64(INVERSE)


def variants(lines: DataFrame) -> DataFrame:
    """key, place of the missing word (-1: none) and id of the lines (id, words, first, last) and their variants.

    Words of a half that is shared are not left out, unless both halves are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            ids, keys, places = [], [], []
            for row, text in enumerate(batch.column("words")):
                values = word_hashes(text.as_py().split(" "))
                n = len(values)
                first, last = batch.column("first")[row].as_py(), batch.column("last")[row].as_py()
                start, stop = (0 if last else n // 2), (n if first else (n + 1) // 2)
                whole, without = variant_hashes(values)
                at = np.arange(start, stop)
                ids.append(np.full(len(at) + 1, batch.column("id")[row].as_py()))
                # the length takes part in the key
                keys += [mixed(np.array([whole], dtype=np.uint64), n), mixed(without[start:stop], n - 1)]
                places += [np.array([-1]), at]
            join = lambda parts, kind: pa.array(np.concatenate([np.empty(0, kind), *parts]).astype(kind))
            yield pa.RecordBatch.from_pydict(
                {"key": join([k.view(np.int64) for k in keys], np.int64), "place": join(places, np.int32), "id": join(ids, np.int64)}
            )

    return lines.select("id", "words", "first", "last").mapInArrow(run, "key long, place int, id long")


def mixed(values: np.ndarray, length: int) -> np.ndarray:
    return values ^ np.uint64((length * BASE) & 0xFFFFFFFFFFFFFFFF)


def within_one(a: list[str], b: list[str]) -> bool:
    """Whether one word changed, added or removed turns ``a`` into ``b``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    same = 0
    while same < len(a) and a[same] == b[same]:
        same += 1
    return a[same:] == b[same + 1 :] or a[same + 1 :] == b[same + 1 :]


@F.udf(BooleanType())
def verified(a, b):
    return within_one(a.split(" "), b.split(" "))


def near_repeats(lines: DataFrame, bitmap: int) -> DataFrame:
    """doc_id, line of each of the candidate ``lines`` that has an earlier near line."""
    found = cut_lineage(variants(lines))  # read several times
    missing, whole = found.where("place >= 0"), found.where("place < 0").select("key", F.col("id").alias("shorter"))
    # one word changed: equal variants with the same word missing
    earliest = missing.groupBy("key", "place").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    earliest = cut_lineage(earliest)
    changed = missing.join(earliest, ["key", "place"]).where("id > first").select("id", "first")
    # one word added or removed: a variant that equals a whole line; most variants equal none
    sent = lines.sparkSession.sparkContext.broadcast(bitmap_of(whole.select("key"), bitmap))

    def equal_some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(np.asarray(batch.column("key")), sent.value)))

    longer = missing.select("key", "id").mapInArrow(equal_some, "key long, id long").join(whole, "key")
    pair = F.greatest("id", "shorter").alias("id"), F.least("id", "shorter").alias("first")
    pairs = changed.unionAll(longer.select(*pair)).groupBy("id").agg(F.min("first").alias("first"))
    own = lines.select("id", order_of().alias("at"), "words")
    other = own.select(F.col("id").alias("first"), F.col("at").alias("at2"), F.col("words").alias("words2"))
    both = pairs.join(own, "id").join(other, "first").where("at > at2")
    return both.where(verified("words", "words2")).select("at.doc_id", "at.line")


def repeated_lines(documents: DataFrame, min_words: int = MIN_WORDS, bitmap: int = BITMAP) -> DataFrame:
    """doc_id and the sorted numbers ``dropped`` of its lines that repeat an earlier line or are near one."""
    lines = cut_lineage(hashed_lines(documents, min_words))
    # a written table, so that the join has two plain shuffles and a very frequent line can be split
    same = cut_lineage(
        lines.groupBy("h", "g").agg(F.min(order_of()).alias("first"), F.count("*").alias("n")).where("n > 1")
    )
    # the smaller side is hashed, so neither lines nor texts are sorted
    exact = lines.select("doc_id", "line", "h", "g").join(same.hint("shuffle_hash"), ["h", "g"]).where(order_of() > F.col("first"))
    table = bitmap_of(contested_halves(lines), bitmap)
    places = bitmap_of(candidate_places(lines, table), bitmap)
    near = near_repeats(candidates(documents, places, table, min_words), bitmap)
    dropped = cut_lineage(exact.select("doc_id", "line").unionByName(near))
    return dropped.groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("dropped"))  # no more than it has lines


@F.pandas_udf(StringType())
def without_lines(texts: pd.Series, drops: pd.Series) -> pd.Series:
    out = []
    for text, drop in zip(texts, drops, strict=True):
        if text is None or drop is None:
            out.append(None)
            continue
        gone = set(drop)
        out.append("\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone))
    return pd.Series(out, dtype=object)


def dedup_lines(documents: DataFrame, min_words: int = MIN_WORDS, bitmap: int = BITMAP) -> DataFrame:
    """``documents`` with ``text`` less its repeated lines, and ``n_lines``, ``n_dropped``, ``dropped`` (numbers from 0).

    A line is what stands between ``\\n``; case and white space do not count. A line of ``min_words``
    words or more is dropped if an equal line, or one that differs by one word, comes before it in the
    order of doc_id (null last) and line number; whether that line is itself dropped does not matter.
    Shorter lines stay. Rows that share a doc_id share their numbers too: at the same number neither
    is earlier, so repeated rows lose the same lines. A null text stays null with no lines, a text
    whose lines all go becomes empty. An empty table gives no rows, and columns of the input named
    like a new one are replaced.
    """
    kept = [c for c in documents.columns if c not in ("n_lines", "n_dropped", "dropped")]
    documents = documents.select(*kept)
    send_small_batches(documents.sparkSession)
    drops = repeated_lines(documents.select("doc_id", "text"), min_words, bitmap)
    drops = drops.select(F.col("doc_id").alias("_id"), "dropped")
    joined = documents.join(drops.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    joined = joined.withColumn("n_lines", F.coalesce(breaks + 1, F.lit(0)))
    sized = joined.withColumn("dropped", F.when(F.col("text").isNotNull(), F.filter("dropped", lambda i: i < F.col("n_lines"))))
    cut = without_lines(F.when(F.size("dropped") > 0, F.col("text")), F.col("dropped"))
    cut = F.when(F.size("dropped") > 0, cut).otherwise(F.col("text"))
    return sized.withColumns(
        {"text": cut, "n_dropped": F.greatest(F.size("dropped"), F.lit(0)), "dropped": F.coalesce("dropped", F.array().cast("array<int>"))}
    )
