"""Functions and operators whose edge cases the given tables don't hold."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import dates, paths, text
from corpusloom.operators import context, ranking, upkeep
from corpusloom.operators.retrieval import merged_search


def value(spark, column, **given):
    names = list(given)
    row = spark.createDataFrame([tuple(given.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in given.items())) if names else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_byte_prefix_ends_with_a_whole_character(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("aé日😀") for _ in range(r.randint(0, 12))) for _ in range(60)]
    rows = spark.createDataFrame([(t, n) for t in texts for n in range(-1, 14)], "t string, n int")
    for x in rows.select("t", "n", text.byte_prefix(F.col("t"), F.col("n")).alias("p")).collect():
        want = max((x["t"][:k] for k in range(len(x["t"]) + 1) if len(x["t"][:k].encode()) <= max(x["n"], 0)), key=len)
        assert x["p"] == want


def test_file_names_keep_their_extension(spark):
    assert value(spark, text.file_name_within(F.col("p"), 10), p="a/b/short.md") == "a/b/short.md"
    assert value(spark, text.file_name_within(F.col("p"), 10), p="a/long-name.md") == "a/long-na.md"
    assert value(spark, text.file_name_within(F.col("p"), 4), p="x.longextension") == "x.lo"


def test_ellipsis_cuts_at_sentences_paragraphs_and_words(spark):
    cut = lambda t, n: value(spark, text.ellipsis(F.col("t"), n), t=t)
    assert cut("short", 10) == "short" and cut("a" * 20, 10) == "a" * 10 + "..."
    assert cut("One two. Three four five", 12) == "One two. ..."
    assert cut("One two thr\n\nfour five six", 16) == "One two thr\n\n..."
    assert cut("aaaa bbbb ccccc", 10) == "aaaa bbbb ..."


def test_edits(spark):
    edit = lambda t, o, n: tuple(value(spark, text.edited(F.col("t"), F.col("o"), F.col("n")), t=t, o=o, n=n))
    assert edit("a b c", "b", "x") == ("exact", "a x c") and edit("a b b", "b", "x") == ("ambiguous", "a b b") and edit("a", "z", "x") == ("not_found", "a")
    assert edit("say \u201chi\u201d  \nend", 'say "hi"', "said") == ("fuzzy", "said\nend")
    assert edit("\ufeffa\r\nb\r\n", "a\nb", "c\nd") == ("exact", "\ufeffc\r\nd\r\n")
    assert edit("a", "", "x") == ("not_found", "a")
    do = lambda t, k, f, p: value(spark, text.edit_applied(F.col("t"), F.col("k"), F.col("f"), F.col("p")), t=t, k=k, f=f, p=p)
    assert do("a b b", "delete", "b", "") == "a  b" and do(None, "create", "", "new") == "new" and do("a", "replace", "z", "x") is None and do("a", "replace", "", "x") is None


def test_messages_for_copy(spark):
    t = "<think>x</think>a\n```xml\n<writeToFile>f</writeToFile>\n```\n\n\n\nb<!--TOOL_CALL_START:i:n:d:e::x-->in<!--TOOL_CALL_END:i:r-->"
    assert value(spark, text.message_for_copy(F.col("t")), t=t) == "a\n\nb"


def test_paths(spark):
    holds = lambda p, w: value(spark, paths.holds_parts(F.col("p"), F.col("w")), p=p, w=w)
    assert holds("A/b/c/d.md", "a/c") and not holds("a/b/c/d.md", "c/a") and holds("a/b", "/") and holds("a/b/x.md", "/a/a/") and not holds("a/b", "a/x")
    safe = lambda p: value(spark, paths.safe(F.col("p")), p=p)
    assert [safe(p) for p in ("a/v1..2.md", "../a", "a/../b", "a/..", "/a", "")] == [True, False, False, False, False, False]
    assert value(spark, paths.partition_of(F.col("k"), 1000), k="abc") == 96354 % 1000


def test_partition_hash_wraps_the_shift_only(spark):
    key = "a long identifier / with é and more than six characters"
    h = 0
    for c in key:
        h = ((h & 0xFFFFFFFF) << 5 & 0xFFFFFFFF ^ 0x80000000) - 0x80000000 - h + ord(c)
    assert value(spark, paths.partition_of(F.col("k"), 97), k=key) == abs(h) % 97


def test_time_ranges(spark):
    now = F.lit("2024-05-15 12:00:00").cast("timestamp")

    def span(said):
        r = value(spark, dates.time_range(F.col("t"), now), t=said)
        return r and tuple(str(x)[:10] for x in r)

    assert span("jan") == ("2024-01-01", "2024-01-31") and span("Sept") == ("2023-09-01", "2023-09-30") and span("december 2024") == ("2023-12-01", "2023-12-31")
    assert span("last 2 weeks") == ("2024-05-01", "2024-05-15") and span("past 0 days") is None and span("YEAR 2023") == ("2023-01-01", "2023-12-31") and span("2025") == ("2024-01-01", "2024-12-31")
    assert span("Q1 2024") == ("2024-01-01", "2024-03-31") and span("2023 q4") == ("2023-10-01", "2023-12-31") and span("yesterday") == ("2024-05-14", "2024-05-14") and span("next month") == ("2024-06-01", "2024-06-30")
    assert span("week of july 1st") == ("2023-07-01", "2023-07-07") and span("week of 2024-05-01") == ("2024-04-29", "2024-05-05") and span("2024-02-28 to 2024-03-01") == ("2024-02-28", "2024-03-01")
    assert span("march 5th, or so") is None and span("") is None and span("week of nothing") is None and span("2024-02-31") is None
    assert value(spark, dates.valid_range(F.col("a"), F.col("b")), a=0, b=5) is None and value(spark, dates.valid_range(F.col("a"), F.col("b")), a=6, b=5) is None


def test_title_dates_are_real_days_on_their_own(spark):
    day = lambda n: str(value(spark, dates.title_date(F.col("n")), n=n))
    assert [day(n) for n in ("x 2024-01-05 y.md", "20240105.md", "a/2024.01.05.md", "2024-01.05", "120240105", "2024-13-01", "2024-02-30 2024-03-01", "v1.2 note")] == ["2024-01-05"] * 3 + ["None"] * 5


def test_layers_skip_blank_segments_and_unknown_layers(spark):
    s = spark.createDataFrame([(1, "L2", 2, "b\r\nc "), (1, "L2", 1, "a"), (1, "L1", 1, " "), (1, "LX", 1, "no"), (1, "L5", 1, "end")], "m int, layer string, ord int, content string")
    got = context.layered(s, ["m"], ["L1", "L2", "L5"]).first()
    assert got["text"] == "a\n\nb\nc\n\nend" and sorted(got["hashes"]) == ["L2", "L5"]


def test_diverse_cutoff_equals_a_plain_loop(spark):
    def plain(hits, floor, ceiling, relative):
        hits = sorted(hits, key=lambda h: (-h[2], h[3]))
        least = max(hits[0][2] * relative, 0.01)
        chosen, seen, rest = [], set(), []
        for k, h in enumerate(hits):
            if h[1] not in seen and (len(chosen) < floor or h[2] >= least):
                seen.add(h[1])
                chosen.append(h)
                if len(chosen) >= ceiling:
                    break
            else:
                rest.append(h)
        if len(chosen) < ceiling:
            for h in rest:
                if len(chosen) >= ceiling or h[2] < least and len(chosen) >= floor:
                    break
                chosen.append(h)
        return {h[3] for h in chosen}

    r = random.Random(2)
    for trial in range(8):
        hits = [(1, f"n{r.randint(0, 6)}", r.randint(0, 20) / 20, i) for i in range(r.randint(1, 40))]
        floor, ceiling, relative = r.choice([(3, 30, 0.3), (5, 8, 0.7), (2, 4, 0.0), (3, 12, 0.95)])
        df = spark.createDataFrame(hits, "q int, note string, score double, tie int")
        got = {x["tie"] for x in ranking.diverse_cutoff(df, "q", "note", "score", "tie", floor, ceiling, relative).collect()}
        assert got == plain(hits, floor, ceiling, relative), (trial, hits)


def test_within_size_halves_until_it_fits(spark):
    rows = spark.range(200).select(F.col("id"), F.repeat(F.lit("x"), F.lit(90)).alias("t"))
    kept = [context.within_size(rows, [F.col("id")], n).count() for n in (10**6, 12_000, 5_500, 100)]
    assert kept == [200, 100, 50, 0] and context.within_size(rows.limit(0), [F.col("id")], 10).count() == 0


def test_batches_number_every_chunk_once(spark):
    c = spark.range(300).select(F.col("id").cast("string").alias("path"), F.lit("t").alias("title"), F.lit("c").alias("content"))
    got = upkeep.index_batches(c, ["path"], 16, 8).collect()
    assert sorted(g["place"] for g in got) == list(range(1, 301)) and {g["batch"] for g in got} == set(range(19)) and sum(g["checkpoint"] for g in got) == 2


def test_segments_of_blocks_without_source_are_counted(spark):
    t = "<selected_text>a</selected_text><web-content url=\"http://u\">x</web-content><selected_text>b</selected_text><embedded_pdf><name>f.pdf</name></embedded_pdf>"
    got = context.context_segments(spark.createDataFrame([(1, t), (2, None), (3, "plain")], "k int, t string"), "k", "t").orderBy("pos").collect()
    assert [(g["tag"], g["id"]) for g in got] == [("selected_text", "selected_text"), ("web-content", "http://u"), ("selected_text", "selected_text:2"), ("embedded_pdf", "f.pdf")]


def test_replies_that_cannot_be_read_are_empty(spark):
    assert value(spark, text.parsed_scores(F.col("t"), 5), t="no json") == [] and value(spark, text.parsed_scores(F.col("t"), 2), t='{"scores": [11, "a", 3]}') == [10.0]
    assert value(spark, text.parsed_memories(F.col("t"), ["fact"]), t="[broken") == [] and value(spark, text.fenced_json(F.col("t"), "v int"), t='{"v": 3}')["v"] == 3
    assert value(spark, text.parsed_expansion(F.col("t"), F.lit("big #tag/x plan")), t="nothing")["terms"] == ["big", "tag", "plan", "#tag/x"]


def test_merged_search_adds_ranks(spark):
    a = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (1, 3, 0.0)], "query int, note int, score double")
    b = spark.createDataFrame([(1, 2, 0.7), (1, 4, 0.1)], "query int, note int, score double")
    assert [(r["note"], r["rank"]) for r in merged_search(a, b).orderBy("rank").collect()] == [(2, 1), (1, 2), (4, 3)]


def test_within_size_stops_after_the_halvings_given(spark):
    rows = spark.range(800).select(F.col("id"), F.repeat(F.lit("x"), F.lit(90)).alias("t"))
    assert [context.within_size(rows, [F.col("id")], 12_000, halvings=h).count() for h in (None, 2, 3)] == [100, 0, 100]


@pytest.mark.parametrize(("name", "mark", "most"), [("small_texts", "Repartition", 1), ("parse_replies", "from_json(", 3), ("citation_texts", "(?is)", 3)])
def test_costly_texts_are_worked_out_once_a_row_in_dealt_tasks(spark, name, mark, most):
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan and plan.count(mark) <= most
