"""Edit scripts: the alignment itself, replays of random edits, and what the frames hold."""

import itertools
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from hostledger.operators import content as C
from hostledger.operators import editscript as E

LINES = st.lists(st.integers(0, 6), max_size=14)


def best_rise(values):
    return max((len(c) for n in range(len(values) + 1) for c in itertools.combinations(values, n) if list(c) == sorted(c)), default=0)


@settings(max_examples=200, deadline=None)
@given(st.permutations(range(8)))
def test_longest_rise(values):
    places = E.longest_rise(values)
    run = [values[p] for p in places]
    assert places == sorted(places) and run == sorted(run) and len(run) == best_rise(values)


@settings(max_examples=500, deadline=None)
@given(LINES, LINES)
def test_steps_lead_from_old_to_new(old, new):
    steps = E.steps(old, new)
    assert [a for a, _ in steps if a] == list(range(1, len(old) + 1))
    assert [b for _, b in steps if b] == list(range(1, len(new) + 1))
    assert all(old[a - 1] == new[b - 1] for a, b in steps if a and b)
    matched = E.matched_lines(old, new)
    assert all(a < c and b < d for (a, b), (c, d) in itertools.pairwise(matched))
    if old == new:
        assert len(matched) == len(old)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 99), unique=True, max_size=9), st.data())
def test_as_many_unique_lines_stay_as_can(old, data):
    new = data.draw(st.permutations(old))
    assert len(E.matched_lines(old, new)) == best_rise([old.index(x) for x in new])


CASES = {
    "a moved block goes and comes": (["a", "b", "c", "d", "e"], ["c", "d", "e", "a", "b"], "-1 -2 =31 =42 =53 +4 +5"),
    "repeated lines stay at both ends": (["x", "x", "k", "x"], ["x", "x", "x"], "=11 =22 -3 =43"),
    "a repeated line is unique between two anchors": (["a", "}", "b", "}", "c", "}"], ["a", "}", "n", "b", "}", "m", "c", "}"], "=11 =22 +3 =34 =45 +6 =57 =68"),
    "nothing in common": (["a"], ["b", "c"], "-1 +1 +2"),
    "all gone": (["a", "b"], [], "-1 -2"),
    "all new": ([], ["a"], "+1"),
    "nothing": ([], [], ""),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    old, new, want = CASES[name]
    ids = {line: i for i, line in enumerate(sorted({*old, *new}))}
    steps = E.steps([ids[x] for x in old], [ids[x] for x in new])
    assert " ".join(f"={a}{b}" if a and b else f"-{a}" if a else f"+{b}" for a, b in steps) == want


def history(spark, rows):
    return C.content_history(spark.createDataFrame(rows, "url string, ts int, content string"))


def test_scripts_of_random_edits_replay(spark):
    draw = random.Random(7)
    rows, texts = [], {}
    for n in range(60):
        old = [draw.choice(["}", "", "x = 1", f"line {i}", f"line {i}"]) for i in range(draw.randint(0, 60))]
        new = list(old)
        for _ in range(draw.randint(0, 8)):
            at = draw.randint(0, len(new))
            kind = draw.choice(["cut", "add", "move", "edit"])
            if kind == "cut":
                del new[at : at + draw.randint(1, 6)]
            elif kind == "add":
                new[at:at] = [draw.choice(["}", f"added {draw.random()}"]) for _ in range(draw.randint(1, 6))]
            elif kind == "move":
                block = new[at : at + 5]
                del new[at : at + 5]
                at = draw.randint(0, len(new))
                new[at:at] = block
            elif at < len(new):
                new[at] += " edited"
        texts[f"u{n}"] = ("\n".join(old), "\n".join(new))
        rows += [(f"u{n}", 1, texts[f"u{n}"][0]), (f"u{n}", 2, texts[f"u{n}"][1]), (f"u{n}", 3, "later")]
    script = E.line_edit_script(history(spark, rows), 1, 2, E.plain_lines)
    got = {r.url: (r.old_text, r.new_text) for r in E.replayed(script).collect()}
    assert got == {u: t for u, t in texts.items() if t[0] != t[1]}
    summary = {r.url: r for r in E.edit_summary(script).collect()}
    for url, (old, new) in got.items():
        s = summary[url]
        assert s.lines_equal + s.lines_deleted == len(old.split("\n")) and s.lines_equal + s.lines_added == len(new.split("\n"))
        assert s.lines_changed <= min(s.lines_added, s.lines_deleted)


def test_pages_on_one_side_repeats_and_nulls(spark):
    rows = [
        ("new", 2, "a\nb"), ("gone", 1, "a"), ("same", 1, "a"), ("same", 2, "a"), ("twice", 1, "a\nb"), ("twice", 1, "a\nb"), ("twice", 2, "b"),
        ("empty", 1, None), ("empty", 2, "a"), ("blank", 1, "a  b\n\n// c"), ("blank", 2, "a b"), ("none", 1, None), ("none", 3, "z"),
    ]
    script = E.line_edit_script(history(spark, rows), 1, 2)
    got = sorted((r.url, r.seq, r.operation, r.line, r.old_line, r.new_line) for r in script.collect())
    assert got == [
        ("blank", 1, "equal", "a b", 1, 1), ("empty", 1, "insert", "a", None, 1), ("gone", 1, "delete", "a", 1, None), ("new", 1, "insert", "a", None, 1),
        ("new", 2, "insert", "b", None, 2), ("twice", 1, "delete", "a", 1, None), ("twice", 2, "equal", "b", 2, 1),
    ]
    assert sorted({r.url for r in E.line_edit_script(history(spark, rows), 1, 2, one_sided=False).collect()}) == ["blank", "twice"]
    assert E.line_edit_script(history(spark, rows), 7, 8).count() == 0


def test_segments(spark):
    rows = [("u", 1, "a\nb\nc\nd"), ("u", 2, "a\nx\ny\nc\nd\nz")]
    script = E.line_edit_script(history(spark, rows), 1, 2)
    got = sorted((r.segment, r.operation, r.text, r.n_lines) for r in E.edit_segments(script).collect())
    assert got == [(1, "equal", "a", 1), (2, "delete", "b", 1), (3, "insert", "x\ny", 2), (4, "equal", "c\nd", 2), (5, "insert", "z", 1)]
    s = E.edit_summary(script).collect()[0]
    assert (s.lines_added, s.lines_deleted, s.lines_changed, s.lines_equal) == (3, 1, 1, 3)


def test_lines_of_one_hash_are_not_equal(spark, monkeypatch):
    monkeypatch.setattr(E.F, "xxhash64", lambda line: F.length(line).cast("long"))
    script = E.line_edit_script(history(spark, [("u", 1, "ab\nc"), ("u", 2, "xy\nc")]), 1, 2)
    assert sorted((r.seq, r.operation, r.line) for r in script.collect()) == [(1, "delete", "ab"), (2, "insert", "xy"), (3, "equal", "c")]


def test_texts_are_shuffled_once(spark, tmp_path):
    path = str(tmp_path / "h")
    history(spark, [("u", 1, "a"), ("u", 2, "b")]).write.parquet(path)
    plan = E.line_edit_script(spark.read.parquet(path), 1, 2)._jdf.queryExecution().optimizedPlan().toString()
    scans = [line for line in plan.splitlines() if "Relation [" in line]
    assert len(scans) == 2 and plan.count("MapInArrow") == 1 and "Window" not in plan
