"""What changed between two versions of a page, line by line.

Lines that both versions have once are anchors; the longest run of anchors in the order of both
versions stays, and each gap between two of them is aligned again in the same way. Texts are joined
once, by URL, and only of URLs whose hash changed; the alignment sees hashes of their lines.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .content import content_changes, normal_lines


def plain_lines(content: Column) -> Column:
    """The lines of a text as they are."""
    return F.split(content, "\n", -1)


def longest_rise(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence of distinct ``values``."""
    tails: list[int] = []  # the least last value of a run of each length
    ends: list[int] = []
    before: list[int] = []
    for at, value in enumerate(values):
        n = bisect_left(tails, value)
        before.append(ends[n - 1] if n else -1)
        tails[n : n + 1] = [value]
        ends[n : n + 1] = [at]
    at, chosen = ends[-1] if ends else -1, []
    while at >= 0:
        chosen.append(at)
        at = before[at]
    return chosen[::-1]


def matched_lines(old: list[int], new: list[int]) -> list[tuple[int, int]]:
    """Pairs of places of lines that stay, in order: equal ends of a gap, then its anchors, then the gaps between them."""
    found, gaps = [], [(0, len(old), 0, len(new))]
    while gaps:
        a, a_end, b, b_end = gaps.pop()
        while a < a_end and b < b_end and old[a] == new[b]:
            found.append((a, b))
            a, b = a + 1, b + 1
        while a < a_end and b < b_end and old[a_end - 1] == new[b_end - 1]:
            a_end, b_end = a_end - 1, b_end - 1
            found.append((a_end, b_end))
        if a == a_end or b == b_end:
            continue
        seen_a, seen_b = Counter(old[a:a_end]), Counter(new[b:b_end])
        place = {new[j]: j for j in range(b, b_end) if seen_b[new[j]] == 1}
        shared = [(i, place[old[i]]) for i in range(a, a_end) if seen_a[old[i]] == 1 and old[i] in place]
        anchors = [shared[k] for k in longest_rise([j for _, j in shared])]
        if anchors:
            found += anchors
            edges = [(a - 1, b - 1), *anchors, (a_end, b_end)]
            gaps += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(found)


def steps(old: list[int], new: list[int]) -> list[tuple[int, int]]:
    """Line numbers (old, new) of every step from one version to the other; 0 where a line is only on one side.

    Between two lines that stay, what goes comes before what is new.
    """
    out, a, b = [], 0, 0
    for i, j in [*matched_lines(old, new), (len(old), len(new))]:
        out += [(k + 1, 0) for k in range(a, i)] + [(0, k + 1) for k in range(b, j)]
        out.append((i + 1, j + 1))
        a, b = i + 1, j + 1
    return out[:-1]


STEP = pa.struct([("old", pa.int64()), ("new", pa.int64())])


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1)
            found = steps(row.column("old_keys")[0].as_py(), row.column("new_keys")[0].as_py())
            made = pa.array([[{"old": a, "new": b} for a, b in found]], pa.list_(STEP))
            columns = [row.column(c) for c in ("url", "old_lines", "new_lines")]
            yield pa.RecordBatch.from_arrays([*columns, made], ["url", "old_lines", "new_lines", "steps"])


def line_edit_script(
    history: DataFrame, old_ts, new_ts, lines: Callable[[Column], Column] = normal_lines, one_sided: bool = True
) -> DataFrame:
    """The steps from a page's old version to its new one, as (url, seq, operation, line, old_line, new_line).

    ``operation`` is equal, delete or insert; line numbers start at 1 and are null on the side that
    does not have the line. A moved block is deleted where it was and inserted where it is. Pages
    with the same hash have no rows; a new or vanished page is all insert or delete, or has no rows
    without ``one_sided``. ``lines`` splits a text: blanks and comments aside (the default) or
    ``plain_lines``. Of repeated rows of a fetch the one with the greatest hash counts, as in
    ``content_changes``; a null content has no lines.
    """
    changes = content_changes(history, old_ts, new_ts).where(F.col("change") != "identical")
    if not one_sided:
        changes = changes.where("change = 'changed'")
    side = lambda t: F.max_by(F.when(F.col("ts") == t, F.col("content")), F.when(F.col("ts") == t, F.col("hash")))
    texts = history.where(F.col("ts").isin(old_ts, new_ts)).join(changes.select("url"), "url", "left_semi")
    split = lambda c: F.coalesce(lines(F.col(c)), F.array().cast("array<string>")).alias(f"{c}_lines")
    both = texts.groupBy("url").agg(side(old_ts).alias("old"), side(new_ts).alias("new")).select("url", split("old"), split("new"))
    keys = [F.transform(f"{c}_lines", lambda line: F.xxhash64(line)).alias(f"{c}_keys") for c in ("old", "new")]
    url = history.schema["url"].dataType.simpleString()
    aligned = both.select("*", *keys).mapInArrow(
        _align, f"url {url}, old_lines array<string>, new_lines array<string>, steps array<struct<old:bigint,new:bigint>>"
    )

    def step(operation: str, line: Column, old: Column | None, new: Column | None) -> Column:
        none = F.lit(None).cast("long")
        return F.struct(
            F.lit(operation).alias("operation"), line.alias("line"), (none if old is None else old).alias("old_line"), (none if new is None else new).alias("new_line")
        )

    def written(s: Column) -> Column:
        old, new = (F.get(f"{c}_lines", s[c].cast("int") - 1) for c in ("old", "new"))
        gone, fresh = step("delete", old, s["old"], None), step("insert", new, None, s["new"])
        return (
            F.when(s["new"] == 0, F.array(gone))
            .when(s["old"] == 0, F.array(fresh))
            .when(old == new, F.array(step("equal", new, s["old"], s["new"])))
            .otherwise(F.array(gone, fresh))  # different lines of one hash
        )

    script = aligned.select("url", F.posexplode(F.flatten(F.transform("steps", written))).alias("seq", "step"))
    return script.select("url", (F.col("seq") + 1).cast("long").alias("seq"), "step.*")


def edit_segments(script: DataFrame) -> DataFrame:
    """Runs of one operation as (url, segment, operation, text, n_lines); ``text`` has their lines, one below the other.

    A line belongs to the segment that starts at the last change of operation before it. Segments of
    a page are numbered from 1.
    """
    ahead = Window.partitionBy("url").orderBy("seq")
    starts = F.coalesce(F.col("operation") != F.lag("operation").over(ahead), F.lit(True))
    marked = script.withColumn("starts", starts).withColumn("segment", F.count_if("starts").over(ahead))
    lines = F.array_sort(F.collect_list(F.struct("seq", "line")))
    return marked.groupBy("url", "segment", "operation").agg(
        F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"), F.count("*").alias("n_lines")
    )


def edit_summary(script: DataFrame) -> DataFrame:
    """url, lines_added, lines_deleted, lines_changed, lines_equal.

    Lines deleted and inserted at the same place are changed lines, as many as there are on the side that has fewer;
    they count as added and deleted as well.
    """
    ahead = Window.partitionBy("url").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    # what lies between two equal lines has as many equal lines before it
    marked = script.withColumn("gap", F.coalesce(F.count_if(F.col("operation") == "equal").over(ahead), F.lit(0)))
    count = lambda name: F.count_if(F.col("operation") == name)
    gaps = marked.groupBy("url", "gap").agg(*(count(n).alias(n) for n in ("insert", "delete", "equal")))
    return gaps.groupBy("url").agg(
        F.sum("insert").alias("lines_added"),
        F.sum("delete").alias("lines_deleted"),
        F.sum(F.least("insert", "delete")).alias("lines_changed"),
        F.sum("equal").alias("lines_equal"),
    )


def replayed(script: DataFrame) -> DataFrame:
    """Both texts of each page, rebuilt from its script, as (url, old_text, new_text); null if a side has no lines."""

    def side(number: str) -> Column:
        lines = F.array_sort(F.collect_list(F.when(F.col(number).isNotNull(), F.struct(number, "line"))))
        return F.when(F.size(lines) > 0, F.array_join(F.transform(lines, lambda x: x["line"]), "\n"))

    return script.groupBy("url").agg(side("old_line").alias("old_text"), side("new_line").alias("new_text"))
