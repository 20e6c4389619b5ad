"""Links, names, turns, citations and times on tiny tables."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import dates, text
from corpusloom.operators import dialogue, links


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_mentions_leave_out_embeds_and_nulls(spark):
    n = spark.createDataFrame([(1, "[[a#s|d]] ![[b]] [[c]] [[c]]"), (2, None), (3, "")], "id int, body string")
    assert rows(links.mentions(n, "id", "body")) == [(1, "a", "s", "d"), (1, "c", "", "")]


def test_links_resolve_once_or_say_why_not(spark):
    n = spark.createDataFrame([("x/a.md",), ("y/b.md",), ("z/b.md",), ("x/a.md",)], "path string")
    f = spark.createDataFrame([("a",), ("b",), ("y/b",), ("q",), (None,)], "target string")
    assert rows(links.resolve_links(f, n)) == sorted([("a", "x/a.md", "resolved"), ("b", None, "ambiguous"), ("y/b", "y/b.md", "resolved"), ("q", None, "unresolved"), (None, None, "unresolved")], key=str)


def test_paths_resolve_by_the_first_tier(spark):
    n = spark.createDataFrame([("x/A.md",), ("y/z/b.md",), ("w/b.md",), ("y/c.canvas",)], "path string")
    r = spark.createDataFrame([("x/A.md",), ("x/A",), ("X/a",), ("B",), ("z/b",), ("C",), ("gone",)], "request string")
    got = {r[0]: tuple(r[1:]) for r in links.resolve_paths(r, n).collect()}
    assert got == {"x/A.md": (1, 1, "x/A.md"), "x/A": (2, 1, "x/A.md"), "X/a": (3, 1, "x/A.md"), "B": (4, 2, None), "z/b": (5, 1, "y/z/b.md"), "C": (4, 1, "y/c.canvas"), "gone": (None, 0, None)}
    assert links.resolve_paths(r.limit(0), n).count() == 0


def test_census_counts_distinct_others(spark):
    n = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    e = spark.createDataFrame([(1, 2), (1, 2), (2, 1), (3, 3), (3, 1)], "src int, dst int")
    assert rows(links.census(n, e, "id")) == [(1, 1, 2, False), (2, 1, 1, False), (3, 1, 0, True)]


def test_tasks(spark):
    n = spark.createDataFrame([(1, "- [ ] a\n  * [x] b\n- c"), (2, None)], "id int, body string")
    assert rows(links.tasks(n, "id", "body")) == [(1, 1, False, "a"), (1, 2, True, "b")]


def test_tabs_keep_the_latest_known_title(spark):
    t = spark.createDataFrame([(1, "https://a.org/p/", "old", True), (2, "https://A.org/p#x", None, False), (3, "https://b.org/", "b", True)], "n int, url string, title string, active boolean")
    assert [r[1:] for r in rows(links.merge_tabs(t, ["title"], "n"))] == [("old", False), ("b", True)]


def test_turns_pair_a_question_with_the_next_answer(spark):
    m = spark.createDataFrame([(1, 0, "user", "a"), (1, 2, "user", "b"), (1, 5, "assistant", "c"), (1, 6, "assistant", "d"), (2, 0, "user", "e"), (1, None, "user", "f")], "chat int, turn int, role string, text string")
    assert rows(dialogue.turn_pairs(m, "chat", "turn")) == [(1, 2, "b", 5, "c")]


def test_citations_and_blocks(spark):
    c = spark.createDataFrame([(1, 1, 7), (1, 2, 3), (1, 3, 7)], "doc int, pos int, number int")
    assert rows(dialogue.renumber_citations(c, "doc", "pos", "number")) == [(1, 3, 2), (1, 7, 1)]
    b = spark.createDataFrame([(1, 1, 0, 9), (1, 2, 2, 5), (1, 3, 0, 9), (1, 4, 5, 12)], "doc int, id int, start int, end int")
    assert [r[1] for r in rows(dialogue.outermost(b, "doc"))] == [1, 4]


def test_reranked_head_goes_first(spark):
    h = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.8, 5), (1, "c", 0.7, 9), (1, "d", 0.6, None)], "q int, id string, score double, new int")
    got = dialogue.splice_reranked(h, "q", "score", "new", "id", head=2, limit=3)
    assert [r["id"] for r in got.orderBy("rank").collect()] == ["b", "a", "c"]


@pytest.mark.parametrize(("said", "minutes"), [("+8", 480), ("UTC+5:30", 330), ("gmt-0330", -210), ("+15", None), ("UTC", None), ("+5:75", None), (None, None)])
def test_offsets(spark, said, minutes):
    assert spark.range(1).select(dates.utc_offset(F.lit(said).cast("string"))).first()[0] == minutes


@pytest.mark.parametrize(("said", "seconds"), [("PT1H2M3S", 3723), ("PT45S", 45), ("PT", None), ("1h", None), (None, None)])
def test_durations(spark, said, seconds):
    assert spark.range(1).select(dates.duration_seconds(F.lit(said).cast("string"))).first()[0] == seconds


def test_tags_below(spark):
    t = spark.createDataFrame([(["#A/b"],), (["#ab"],), (None,)], "tags array<string>")
    assert [r[0] for r in t.select(text.tag_matches(F.col("tags"), "a")).collect()] == [True, False, False]
