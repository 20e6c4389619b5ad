"""Fuzzy ranking and block compaction against plain versions."""

import random
import re

from pyspark.sql import functions as F

from corpusloom.operators import compaction, fuzzy


def plain_alignment(q, t):
    at, score = 0, 0
    for c in q:
        p = t.find(c, at) + 1
        if not p:
            return None
        score += 10 + (15 if at and p == at + 1 else 0) + (10 if p == 1 or re.match(r"[\s/_.-]", t[p - 2]) else 0) - (min(p - 1, 20) if not at else 0)
        at = p
    return score - (len(t) - len(q))


def test_fuzzy_ranking_equals_a_plain_one(spark):
    r = random.Random(8)
    names = ["src", "Notes", "daily", "été", "a_b", "2024-01", "x", "README", "plan.md"]
    targets = [(i, "/".join(r.choice(names) for _ in range(r.randint(1, 4)))) for i in range(150)] + [(900, None), (901, "")]
    queries = [(1, "sn"), (2, "daily 2"), (3, "ÉT"), (4, "zz"), (5, ""), (6, "  "), (7, "aa"), (8, "x"), (9, "rdme")]
    got = fuzzy.fuzzy_top(spark.createDataFrame(queries, "query int, text string"), spark.createDataFrame(targets, "id int, text string"), 5)
    want = []
    for q, text in queries:
        text = re.sub(r"\s", "", text.lower())
        hits = sorted((-s, i) for i, t in targets if text and t is not None and (s := plain_alignment(text, t.lower())) is not None)
        want += [(q, i, -s, k + 1) for k, (s, i) in enumerate(hits[:5])]
    assert sorted((x["query"], x["id"], x["score"], x["rank"]) for x in got.collect()) == sorted(want)
    assert fuzzy.fuzzy_top(spark.createDataFrame([], "query int, text string"), spark.createDataFrame(targets, "id int, text string")).count() == 0


def block(kind, content, extra="<path>p/q.md</path>"):
    return f"<{kind}>{extra}<content>{content}</content></{kind}>"


def test_compaction_is_guarded_and_spliced_in_place(spark):
    big, small = "b" * 30, "s" * 5
    nested = block("note_context", f"{big}{block('embedded_note', big)}")
    texts = {
        1: f"a {block('note_context', big)} m {block('note_context', big)} {block('selected_text', small, '')} z",
        2: block("note_context", "fail" + big) + block("url_content", "fail" + big) + block("web-search", big, ""),
        3: "no blocks",
        4: nested,
        5: None,
        6: f"{block('url_content', big, '<title>T</title><url>u</url><ctime>1</ctime>')}<note_context>never closed",
        7: "",
    }
    rewrite = lambda content, title, path: F.when(~content.startswith("fail"), F.concat(title, F.lit(":"), F.left(content, F.lit(3))))
    df = spark.createDataFrame(list(texts.items()), "id int, text string").withColumn("made", F.lit("clash"))
    got = {x["id"]: x for x in compaction.compact(df, rewrite, least=20, most=25).collect()}
    new = "<note_context>\n<title>q.md</title>\n<path>p/q.md</path>\n<content>[SUMMARIZED]\nq.md:bbb</content>\n</note_context>"
    assert got[1]["compacted"] == f"a {new} m {new} {block('selected_text', small, '')} z" and (got[1]["items"], got[1]["rewritten"]) == (3, 2)
    assert [got[i]["compacted"] for i in (2, 3, 5, 7)] == [texts[i] for i in (2, 3, 5, 7)] and not any(got[i]["was_compacted"] for i in (2, 3, 5, 7))
    assert got[4]["compacted"] == new and got[4]["items"] == 1
    assert got[6]["compacted"].startswith("<url_content>\n<title>T</title>\n<url>u</url>\n<ctime>1</ctime>\n<content>[SUMMARIZED]\nT:bbb</content>") and got[6]["compacted"].endswith("<note_context>never closed")


def test_fuzzy_ranking_in_blocks_reads_no_target_for_a_missing_beginning(spark):
    r = random.Random(9)
    targets = [(i, f"{r.choice(['en', 'de'])}/src{i % 5}/doc_{r.randint(0, 3000)}.md" if i % 3 else "same/x_1.md") for i in range(400)]
    queries = [(i, f"{r.choice('ed')}{r.randint(0, 5000)}") for i in range(80)] + [(900, "sm"), (901, "sm"), (902, "x"), (902, "sm")]
    got = fuzzy.fuzzy_top(spark.createDataFrame(queries, "query int, text string"), spark.createDataFrame(targets, "id int, text string"), 4, letters=60, part=50).collect()
    want = []
    for q in {q for q, _ in queries}:
        hits = sorted((-s, i) for k, text in set(queries) if k == q for i, t in targets if (s := plain_alignment(text, t)) is not None)
        want += [(q, i, -s, n) for n, (s, i) in enumerate(hits[:4], 1)]
    assert sorted((x["query"], x["id"], x["score"], x["rank"]) for x in got) == sorted(want)

    class Counted(str):
        tried = 0

        def find(self, *a):
            Counted.tried += 1
            return str.find(self, *a)

    words = [f"q{i:05}" for i in range(0, 90000, 9)]
    found = sorted(words[k] for k, _ in fuzzy.alignments(fuzzy.tree(words), Counted("q/10800.md")))
    assert found == ["q10800"] and Counted.tried < 1000  # 10,000 words that share the first letter
