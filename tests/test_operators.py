"""Operators on tiny tables."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import corpus, ranking, retrieval, vectors
from corpusloom.sources import canvas, chunks, memories
from corpusloom.sources.html import extract_html, extract_pages
from corpusloom.sources.markdown import chunk_note, line_windows, read_tables, table_markdown


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_fusion_adds_ranks(spark):
    lists = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "b", 1)], "q int, id string, rank int")
    got = dict((r["id"], r["score"]) for r in ranking.reciprocal_rank_fusion(lists, "q", "id", "rank").collect())
    assert got == {"a": pytest.approx(1 / 61), "b": pytest.approx(1 / 62 + 1 / 61)}


def test_filter_rows_win_and_null_paths_stay(spark):
    f = spark.createDataFrame([("a", 1)], "path string, x int")
    s = spark.createDataFrame([("a", 2), (None, 3), ("b", 4)], "path string, x int")
    assert {(r["path"], r["x"]) for r in ranking.filter_over_search(f, s).collect()} == {("a", 1), (None, 3), ("b", 4)}


def test_normalisers_of_equal_and_single_scores(spark):
    h = spark.createDataFrame([(1, 1, 5.0), (1, 2, 5.0), (2, 3, 1.0), (3, 4, 1.0), (3, 5, 3.0)], "q int, id int, s double")
    assert [r[-1] for r in rows(ranking.min_max(h, "q", "s"), "id")] == [0.5, 0.5, 0.5, 0.02, 0.98]
    assert [r["normalised"] for r in ranking.percentile(h, "q", "s", "id").orderBy("id").collect()][2] == 0.5
    assert all(0.02 <= r["normalised"] <= 0.98 for r in ranking.z_score(h, "q", "s").collect())


def test_numbered_counts_like_row_number(spark):
    import random

    r = random.Random(4)
    data = [(k, i, float(r.choice([1, 1, 2, 50, 1000]))) for k in (1, 2) for i in range(60)]
    df = spark.createDataFrame(data, "k int, i int, v double")
    got = {(x["k"], x["i"]): x["place"] for x in ranking.numbered(df, ["k"], [F.col("v"), F.col("i")]).collect()}
    for k in (1, 2):
        order = sorted((v, i) for kk, i, v in data if kk == k)
        assert [got[k, i] for _, i in order] == list(range(1, 61))


def test_diverse_top_covers_notes_first(spark):
    h = spark.createDataFrame([(1, "a", 0.9, 1), (1, "a", 0.8, 2), (1, "b", 0.1, 3)], "q int, note string, s double, tie int")
    assert [(r["note"], r["s"]) for r in ranking.diverse_top(h, "q", "note", "s", "tie", 2).orderBy("rank").collect()] == [("a", 0.9), ("b", 0.1)]


def test_cutoff_keeps_floor_and_cuts_at_ceiling(spark):
    h = spark.createDataFrame([(1, i, s) for i, s in enumerate([1.0, 0.2, 0.1, 0.05])], "q int, id int, s double")
    assert ranking.adaptive_cutoff(h, "q", "s", "id").count() == 3
    assert ranking.adaptive_cutoff(h, "q", "s", "id", floor=1).count() == 1


def test_hash_diff_and_upsert(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("n", "9")], "path string, hash string")
    old = spark.createDataFrame([("a", "1"), ("b", "0"), ("d", "3")], "path string, hash string")
    assert rows(corpus.hash_diff(now, old)) == [("b", "changed"), ("d", "deleted"), ("n", "new")]
    assert rows(corpus.upsert(old, now.where("path = 'b'"), "path", now.select(F.lit("d").alias("path")))) == [("a", "1"), ("b", "2")]


def test_duplicate_queries_name_the_first(spark):
    q = spark.createDataFrame([(1, "find my notes"), (2, "find notes"), (3, "other thing"), (4, "my notes find")], "ord int, text string")
    assert [(r["ord"], r["first"]) for r in corpus.duplicate_queries(q, 0.6).orderBy("ord").collect()] == [(2, 1), (4, 1)]


def test_duplicate_queries_equal_all_pairs(spark):
    r = random.Random(4)
    texts = [" ".join({r.choice("abcdefghij") for _ in range(r.randint(0, 7))} | {"the"}) for _ in range(60)] + ["", "a a A"]
    for t in (0.3, 0.6, 1.0):
        want = []
        sets = [set(x.lower().split()) for x in texts]
        for i, a in enumerate(sets):
            for j in range(i):
                c = len(a & sets[j])
                if a and sets[j] and max(c / len(a | sets[j]), c / min(len(a), len(sets[j]))) >= t:
                    want.append((i, j))
                    break
        got = corpus.duplicate_queries(spark.createDataFrame(list(enumerate(texts)), "ord int, text string"), t)
        assert sorted((x["ord"], x["first"]) for x in got.collect()) == want


def test_containment_includes_borders(spark):
    r = spark.createDataFrame([("g", 0.0, 0.0, 10.0, 10.0)], "group string, x0 double, y0 double, x1 double, y1 double")
    n = spark.createDataFrame([("in", 10.0, 0.0), ("out", 10.1, 5.0), ("g", 5.0, 5.0)], "node string, x double, y double")
    assert rows(corpus.contained(r, n)) == [("g", "in")]


def test_containment_of_rectangles_of_all_sizes(spark):
    g = random.Random(7)
    rects = [(f"r{i}", x := g.uniform(-2e6, 2e6), y := g.uniform(-2e6, 2e6), x + w, y + w * g.random()) for i in range(150) for w in [g.choice([0.0, 1e-3, 1.0, 64.0, 5000.0, 1e6])]]
    points = [(f"p{i}", *(g.choice([(r[1], r[2]), (r[3], r[4]), ((r[1] + r[3]) / 2, (r[2] + r[4]) / 2), (g.uniform(-2e6, 2e6), g.uniform(-2e6, 2e6))]))) for i in range(300) for r in [g.choice(rects)]]
    r = spark.createDataFrame([*rects, ("bad", 1.0, 1.0, 0.0, 2.0), ("null", None, 0.0, 1.0, 1.0)], "group string, x0 double, y0 double, x1 double, y1 double")
    got = rows(corpus.contained(r, spark.createDataFrame(points, "node string, x double, y double")))
    assert got == sorted((a, p) for a, x0, y0, x1, y1 in rects for p, x, y in points if x0 <= x <= x1 and y0 <= y <= y1)


def test_as_of_takes_the_latest_mark(spark):
    e = spark.createDataFrame([(1, 1, "x"), (1, 5, "y"), (1, 9, "z")], "k int, at int, id string")
    m = spark.createDataFrame([(1, 5, "c1"), (1, 8, "c2")], "k int, at int, label string")
    assert {(r["id"], r["label"]) for r in corpus.as_of(e, m, ["k"]).collect()} == {("x", None), ("y", "c1"), ("z", "c2")}


def test_as_of_carries_marks_over_ranges(spark):
    r = random.Random(6)
    marks = {(k, at): f"m{at}" for k in (1, 2, None) for at in r.sample(range(400), 9 if k else 3)}
    events = [(r.choice([1, 1, 1, 2, 3]), r.randint(0, 400), i) for i in range(500)]
    got = corpus.as_of(spark.createDataFrame(events, "k int, at int, id int"), spark.createDataFrame([(k, at, m) for (k, at), m in marks.items()], "k int, at int, label string"), ["k"]).collect()
    want = {i: max(((a, m) for (x, a), m in marks.items() if x == k and a <= at), default=(0, None))[1] for k, at, i in events}
    assert {g["id"]: g["label"] for g in got} == want


def test_paragraphs_end_after_enough_words(spark):
    s = spark.createDataFrame([(v, float(i), i, "w " * n) for v in ("a", "b") for i, n in enumerate([50, 29, 1, 80, 3, 200, 1])], "v string, at double, ord int, text string")
    assert [(x["v"], x["paragraph"], x["n"]) for x in corpus.paragraphs(s, ["v"]).orderBy("v", "paragraph").collect()] == [(v, p, n) for v in ("a", "b") for p, n in enumerate([3, 1, 2, 1])]


def test_paragraphs_break_on_gaps_and_sentence_ends(spark):
    s = spark.createDataFrame([(1, 0.0, 1, "a"), (1, 1.0, 2, "b."), (1, 2.0, 3, "c"), (1, 9.0, 4, "d"), (1, 9.5, 5, "  ")], "v int, at double, ord int, text string")
    assert [r["text"] for r in corpus.paragraphs(s, ["v"]).orderBy("start").collect()] == ["a b.", "c", "d"]


def test_paragraphs_of_a_hot_key_equal_a_plain_fold(spark):
    r = random.Random(11)
    segments = []
    for key in ["hot"] * 6 + ["a", "b", None]:
        base = segments and 1e6 * len(segments) or 0.0
        segments += [(key, base + i * 2.0 + r.choice([0, 0, 0, 5]) * (r.random() < 0.02), len(segments) + i, " ".join(["word"] * r.randint(0, 7)) + r.choice(["", "", "", "", "", ".", " ", "?"])) for i in range(r.choice([1, 300]) if key != "hot" else 200)]
    got = sorted((x["k"] or "", x["paragraph"], x["start"], x["n"], x["text"]) for x in corpus.paragraphs(spark.createDataFrame(segments, "k string, at double, ord long, text string"), ["k"], most_words=30).collect())
    want = []
    for key in {s[0] for s in segments}:
        done, last = [], None
        for _, at, _, text in sorted((s for s in segments if s[0] == key and s[3].strip(" ")), key=lambda s: (s[1], s[2])):
            text = text.strip(" ")
            if last is None or at - last[0] >= 4 or last[1][-1] in ".?!" or done[-1][2] >= 30:
                done.append([at, 0, 0, []])
            done[-1][1] += 1
            done[-1][2] += len(text.split())
            done[-1][3].append(text)
            last = (at, text)
        want += [(key or "", i, d[0], d[1], " ".join(d[3])) for i, d in enumerate(done)]
    assert got == sorted(want) and len(want) > 50


def test_similar_vectors_in_blocks_and_cells_match_cosine(spark):
    import numpy as np

    v = np.random.default_rng(1).standard_normal((40, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")
    got = vectors.top_similar(df.where("id < 5"), df, 3, pivots=4, block=8)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    for r in got.collect():
        assert r["row"] == np.argsort(-s[r["query"]])[r["rank"] - 1]
    c = df.crossJoin(F.broadcast(df.where("id = 1").select(F.col("vector").alias("q")))).select("id", vectors.cosine(F.col("vector"), F.col("q")).alias("c")).where("id = 2").first()["c"]
    assert c == pytest.approx(s[2, 1])


def test_similar_vectors_without_direction_and_of_other_lengths(spark):
    rows_ = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [1.0, 0.0, 0.0]), (9, [1.0, 1.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows_, "id long, vector array<double>")
    got = vectors.top_similar(df, df, 2, least=0.5).collect()
    assert sorted((g["query"], g["row"], g["similarity"]) for g in got) == [(1, 2, 1.0), (1, 9, 0.707107), (2, 1, 1.0), (2, 9, 0.707107), (9, 1, 0.707107), (9, 2, 0.707107)]
    assert vectors.top_similar(df.limit(0), df, 2).count() == 0 and vectors.top_similar(df, df.limit(0), 2).count() == 0


def test_pivots_leave_out_cells_of_clustered_vectors_and_lose_nothing(spark):
    import numpy as np

    r = np.random.default_rng(4)
    centres = r.standard_normal((20, 12))
    v = np.concatenate([np.repeat(centres, 60, axis=0) + 0.05 * r.standard_normal((1200, 12)), np.repeat(centres[:1], 600, axis=0)])  # and a third of all rows equal
    v = v[r.permutation(len(v))]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -2)
    asked = range(0, len(v), 20)
    want = {(q, int(x), k + 1, s[q, x]) for q in asked for k, x in enumerate(np.lexsort((np.arange(len(v)), -s[q]))[:4])}
    got = vectors.top_similar(df.where("id % 20 = 0"), df, 4, pivots=32, block=100)
    assert {(g["query"], g["row"], g["rank"], g["similarity"]) for g in got.collect()} == want
    cells = u[:32]
    a = vectors._angles(u, cells)
    own = a.argmin(axis=1)
    radii = np.array([a[own == c, c].max(initial=-np.inf) for c in range(32)])
    bound = np.array([s[q][np.argsort(-s[q])[3]] for q in asked])
    hit = vectors.reached(a[list(asked)], radii, bound, 1e-6)
    assert hit.mean() < 0.3
    for i, q in enumerate(asked):
        assert hit[i][own[np.flatnonzero(s[q] >= bound[i])]].all()


def test_bm25_prefers_rare_terms_and_titles(spark):
    n = spark.createDataFrame([(1, "x.md", "rare word", "t"), (2, "y.md", "word word", "t"), (3, "z.md", "word", "rare")], "ord int, path string, body string, title string")
    q = spark.createDataFrame([(1, "rare"), (1, "word")], "query int, term string")
    got = {r["ord"]: r["score"] for r in retrieval.bm25_plus(retrieval.postings(n, {"body": "body", "title": "title"}), q).collect()}
    assert got[3] > got[1] > got[2]


def test_bm25_finds_cjk_tags_and_prefixes(spark):
    n = spark.createDataFrame([(1, "東京都の本", ["#work/big"]), (2, "retrieval of words", None), (3, "words", ["#home"]), (4, None, [])], "ord int, body string, tags array<string>")
    q = spark.createDataFrame([(1, "京都"), (2, "#work"), (3, "retr"), (4, "words")], "query int, text string").select("query", F.explode(T.terms(F.col("text"))).alias("term"))
    index = retrieval.postings(n, {"body": "body", "tags": "tags"})
    found = retrieval.bm25_plus(index, q).collect()
    got = {(r["query"], r["ord"]): r["score"] for r in found}
    assert set(got) == {(1, 1), (2, 1), (3, 2), (4, 2), (4, 3)}
    assert [tuple(m) for r in found if r["query"] == 2 for m in r["matches"]] == [("tags", "#work", 4.0), ("tags", "#work/big", 4.0), ("tags", "work", 4.0), ("tags", "work/big", 4.0)]
    whole = {(r["query"], r["ord"]): r["score"] for r in retrieval.bm25_plus(index, q, prefix=False).collect()}
    assert set(whole) == set(got) - {(3, 2)} and whole[4, 3] == pytest.approx(got[4, 3])
    asked = spark.createDataFrame([(3, "retrieval")], "query int, term string")
    full = retrieval.bm25_plus(index, asked).first()["score"]
    assert got[3, 2] == pytest.approx(full * 0.375 * 9 / (9 + 0.3 * 5))


def test_bm25_counts_candidates_only(spark):
    n = spark.createDataFrame([(i, "rare word" if i < 2 else "word") for i in range(20)], "ord int, body string")
    index = retrieval.postings(n, {"body": "body"})
    q = spark.createDataFrame([(1, "rare"), (2, "rare")], "query int, term string")
    pairs = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 5), (2, 6), (2, 7)], "query int, ord int")
    got = {(r["query"], r["ord"]): r["score"] for r in retrieval.bm25_plus(index, q, pairs).collect()}
    assert set(got) == {(1, 0), (1, 1), (2, 0)} and got[2, 0] > got[1, 0]


def test_grep_puts_path_hits_first(spark):
    n = spark.createDataFrame([(1, "a.md", "alpha beta"), (2, "alpha.md", "none"), (3, "c.md", "x")], "ord int, path string, body string")
    q = spark.createDataFrame([(7, ["alpha", "b"])], "query int, terms array<string>")
    assert [(r["ord"], r["tier"]) for r in retrieval.grep(n, q).orderBy("rank").collect()] == [(2, 0), (1, 1)]


def test_grep_finds_parts_of_words_and_phrases_as_plain_search_does(spark):
    r = random.Random(3)
    words = ["alpha", "beta", "Gamma-ray", "del", "delta", "é"]
    bodies = [" ".join(r.choice(words) for _ in range(6)) for _ in range(80)] + [None, "", "alpha\nbeta"]
    n = spark.createDataFrame([(i, f"f{i % 7}/n{i}.md", b) for i, b in enumerate(bodies)], "ord int, path string, body string")
    bodies += ["a b x y", "a  b", "xa b", "xy z\tw", "del é"]
    n = spark.createDataFrame([(i, f"f{i % 7}/n{i}.md", b) for i, b in enumerate(bodies)], "ord int, path string, body string")
    asked = [(7, ["a b", "y z"]), (8, ["l é", "b x y"]), (9, ["no such", "zz", "el"]), (1, ["lph", "delta beta"]), (2, ["GAMMA", "n1"]), (3, ["alpha beta del"]), (4, ["x", "é"]), (5, []), (6, ["del", "del"])]
    got = [(x["query"], x["ord"], x["tier"], x["matches"], x["rank"]) for x in retrieval.grep(n, spark.createDataFrame(asked, "query int, terms array<string>"), 10).collect()]
    want = []
    for q, terms in asked:
        terms = {t.lower() for t in terms if len(t) > 1}
        hits = []
        for i, b in enumerate(bodies):
            m = sum(t in f"f{i % 7}/n{i}.md" for t in terms)
            if m or any(t in (b or "").lower() for t in terms):
                hits.append((0 if m else 1, -m, i))
        want += [(q, i, tier, -m, k + 1) for k, (tier, m, i) in enumerate(sorted(hits)[:10])]
    assert sorted(got) == sorted(want)
    plan = retrieval.grep(n, spark.createDataFrame(asked[3:4], "query int, terms array<string>"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_chunks_follow_headings_outside_fences():
    note = "---\ntags: x\n---\nlost\n# A\none\n```\n# no\n```\n## B\ntwo"
    got = chunk_note(note)
    assert [(c[0], c[1], c[2]) for c in got] == [("A", 5, 9), ("A > B", 10, 11)]
    assert chunk_note("") == [] and chunk_note("just text")[0][3] == "just text"


def test_sections_hold_every_word_in_windows():
    r = random.Random(9)
    for _ in range(60):
        note = "".join(r.choice(["one two. ", "three four! ", "five\n", "\n\n", "\n# H a\n", "\n### H b\n", "six. ", "```\n# code\n```\n"]) for _ in range(r.randint(0, 40)))
        got = chunk_note(note, most_words=6, overlap=0)
        lines = note.split("\n")
        heads, fence = [], False
        for i, x in enumerate(lines):
            fence ^= x.startswith("```")
            if not fence and re.match(r"#{1,6}\s+\S", x):
                heads.append(i)
        kept = "\n".join(lines[heads[0] :] if heads else lines)
        assert " ".join(" ".join(c[3] for c in got).split()) == " ".join(kept.split())
        for path, a, b, content in got:
            assert 1 <= a <= b <= len(lines) and (not heads or path)
            assert len(content.split()) <= 6 or len([u for u in re.split(r"\n\s*\n|(?<=[.!?])\s+", content) if u.strip()]) == 1


def test_line_windows_know_what_comes_next(spark):
    n = spark.createDataFrame([("p", "\n".join(["# T", *map(str, range(4))]))], "path string, body string")
    assert [(r["window"], r["heading"], r["lines"], r["next"]) for r in line_windows(n, 2).orderBy("window").collect()] == [(0, "T", 2, 1), (1, None, 2, 2), (2, None, 1, None)]


def test_table_markdown_trims_and_escapes(spark):
    t = spark.createDataFrame([("s", 0, ["", ""]), ("s", 1, ["a|b", "c", ""]), ("s", 2, ["d"])], "sheet string, r int, cells array<string>")
    assert table_markdown(t, "sheet", "r", "cells").first()["markdown"] == "## Sheet: s\n\n| a\\|b | c |\n| --- | --- |\n| d |  |"


def test_delimited_files_become_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,"y, z"\n"1\n2",\n')
    (tmp_path / "b.tsv").write_text("p\tq\n")
    both = [read_tables(spark, str(tmp_path / "a.csv")), read_tables(spark, str(tmp_path / "b.tsv"), "\t")]
    got = [table_markdown(t, "sheet", "row", "cells").first()["markdown"] for t in both]
    assert got == ["## Sheet: a\n\n| x | y, z |\n| --- | --- |\n| 1<br>2 |  |", "## Sheet: b\n\n| p | q |\n| --- | --- |"]


def test_html_skips_scripts_and_keeps_structure():
    title, _, body, status = extract_html("<title>T</title><nav>x</nav><h2>H</h2><p>a &amp; b<script>no</script></p><ul><li>i</li></ul>")
    assert (title, status) == ("T", "ok") and body.startswith("## H") and "a & b" in body and "- i" in body and "no" not in body
    assert extract_html(None)[3] == "failed"


def test_html_loses_no_content_to_wrappers_and_unclosed_elements():
    assert extract_html("<body><form><p>all</p></form></body>")[2:] == ("all", "ok")
    assert extract_html("<div><nav><a>menu</a></div><article><p>text</p></article>")[2] == "text"
    assert extract_html("<body><nav><a>menu</a><article><p>text</p></article></body>")[2] == "text"
    assert extract_html("<aside>only this</aside>")[2:] == ("only this", "ok")
    assert extract_html("<p>a<br/>b<img src=x>c<svg><title>no</title></svg>d")[2] == "a\nbcd"
    assert extract_html("<script>var t = '</p>';</script><p>x</p><noscript>no")[2] == "x"


def test_page_signals(spark):
    pages = [(1, "u", '<div id="root"></div>Loading'), (2, "u", "<p>" + "long text " * 50 + "loading</p>"), (3, "u", "<p>Access Denied</p>"), (4, "u", None), (5, "u", "<p>fine</p>")]
    got = {r["page_id"]: (r["status"], r["needs_rendering"], r["blocked"]) for r in extract_pages(spark.createDataFrame(pages, "page_id int, url string, html string")).collect()}
    assert got == {1: ("ok", True, False), 2: ("ok", False, False), 3: ("ok", False, True), 4: ("failed", True, False), 5: ("ok", False, False)}


def naive_pieces(text, size, seps=("\n\n", "\n", ". ", " ", "")):
    """What split_text does, piece by piece and without groups."""
    sep = next(x for x in seps if x == "" or x in text)
    rest = seps[seps.index(sep) + 1 :]
    runs, now = [], []
    for part in text.split(sep) if sep else text:
        if len(part) < size or not sep:
            now.append(part)
        else:
            runs += [(now, None), (None, part)]
            now = []
    out = []
    for parts, large in [*runs, (now, None)]:
        if large is not None:
            out += naive_pieces(large, size, rest)
            continue
        held = ""
        for part in filter(None, parts):
            if held and len(held) + len(sep) + len(part) > size:
                out.append(held.strip())
                held = part
            else:
                held = held + sep + part if held else part
        out.append(held.strip())
    return [x for x in out if x]


def test_lexical_chunks_against_plain_splitting(spark):
    r = random.Random(5)
    texts = ["", "short", "# only heading", "a" * 150, "# A\n" + "word " * 60 + "\n# B\n\n# C\n" + "text. " * 40]
    for _ in range(60):
        texts.append("".join(r.choice(["word", " ", " ", ". ", "\n", "\n\n", "\n# Head\n", "\n## Sub\n", "x" * 30, "é"]) for _ in range(r.randint(1, 120))))
    for t in texts:
        if t:
            assert chunks.split_text(t, 100) == naive_pieces(t, 100)
        made = chunks.note_chunks("t", t, 200)
        head = "\n\nNOTE TITLE: [[t]]\n\nNOTE BLOCK CONTENT:\n\n"
        assert all(c.startswith(head) and len(c) <= 200 + len(head) for _, c in made)
        body = chunks.split_frontmatter(t)[0] if t.strip() else ""
        letters = lambda x: re.sub(r"[\s.]", "", x)
        assert letters("".join(c[len(head) :] for _, c in made)) == letters(body)
        if len(head) + len(body) <= 200:
            assert [c for _, c in made] == ([head + body] if t.strip() else [])
    assert chunks.join_slight(["# A", "body", "# B"], 50) == ["# A\n\nbody\n\n# B"] and chunks.join_slight(["# A", "b" * 50], 50) == ["# A", "b" * 50]
    n = spark.createDataFrame([("f/t.md", texts[4]), ("../x.md", "no"), ("/abs.md", "no"), ("e.md", " "), ("n.md", None)], "path string, body string")
    got = chunks.lexical_chunks(n, 200).collect()
    assert [(g["heading"], g["content"]) for g in got] == chunks.note_chunks("t", texts[4], 200)
    assert [g["id"] for g in got] == [f"f/t.md#{i}" for i in range(len(got))] and all(g["content_hash"] == hashlib.md5(g["content"].encode()).hexdigest() for g in got)


def test_memories_round_trip(spark, tmp_path):
    p = tmp_path / "m.jsonl"
    p.write_text('{"id":"a","content":"x","category":"fact","createdAt":0}\n\nbroken\n{"id":"b","deleted":true}\n{"id":"c","content":"y","category":"fact","createdAt":1,"sensitive":true}\n')
    m = memories.read_memories(spark, str(p))
    assert rows(m.select("id")) == [("a",), ("c",)]
    assert rows(memories.export_markdown(m)) == [("fact", "1970-01", "## fact\n\n- [1970-01-01] x")]
    memories.save_index(m, str(tmp_path / "i"), 3)
    assert memories.load_index(spark, str(tmp_path / "i")).count() == 2


def test_canvas_groups(spark):
    j = '{"nodes":[{"id":"g","type":"group","x":0,"y":0,"width":10,"height":10},{"id":"n","type":"file","file":"a.md","x":1,"y":1,"width":2,"height":2}],"edges":[]}'
    c = spark.createDataFrame([("c", j)], "canvas string, json string")
    n = canvas.nodes(c, spark.createDataFrame([("a.md", "body")], "path string, body string"))
    assert n.where("id = 'n'").first()["text"] == "body" and rows(canvas.group_edges(n)) == [("c", "g", "n")]


def test_containment_meets_copies_as_one(spark):
    nodes = spark.range(2000).select(F.concat(F.lit("p"), "id").alias("node"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    rects = spark.range(30).select(F.concat(F.lit("p"), "id").alias("group"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(3.0).alias("x1"), F.lit(3.0).alias("y1"))
    found = corpus.contained(rects, nodes, most=100)
    assert found.count() == found.distinct().count() == 30 * 1999
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(nodes") < plan.index("Join Inner")  # rows are unfolded after the join


def test_containment_deals_a_full_cell_to_tasks(spark):
    nodes = spark.range(20_001).select(F.col("id").alias("node"), (F.col("id") / 10_000).alias("x"), F.lit(1.0).alias("y"))
    rects = spark.range(30).select(F.col("id").alias("group"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(3.0).alias("x1"), F.lit(3.0).alias("y1"))
    found = corpus.contained(rects, nodes)
    tasks = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 1 and sum(t["count"] for t in tasks) == 30 * 20_000
    assert found._jdf.queryExecution().optimizedPlan().toString().startswith("Generate explode(nodes")  # no filter over the unfolded rows


def test_containment_in_tiles_equals_all_pairs(spark):
    g = random.Random(5)
    points = [(i, float(g.randint(0, 6)), g.choice([0.0, 0.5, 1.0, 40.0])) for i in range(150)]
    rects = [(i, x, y, x + 3, y + 3) for i, x, y in points if i % 3] + [(900 + i, 0.0, 0.0, g.choice([3.0, 50.0]), 2.0) for i in range(20)]
    want = sorted((a, p) for a, x0, y0, x1, y1 in rects for p, x, y in points if a != p and x0 <= x <= x1 and y0 <= y <= y1)
    for ids in (("long", "long"), ("long", "int"), ("double", "double")):
        r, n = (spark.createDataFrame(d, s).withColumn(c, F.col(c).cast(i)) for d, s, c, i in zip((rects, points), ("group long, x0 double, y0 double, x1 double, y1 double", "node long, x double, y double"), ("group", "node"), ids, strict=True))
        found = corpus.contained(r, n, most=3, side=7)
        assert [k for _, k in found.dtypes] == ["bigint" if i == "long" else i for i in ids] and rows(found) == want


def test_best_with_bounds_equals_a_plain_ranking(spark):
    g = random.Random(3)
    hits = [(q, i, float(g.randint(0, 30))) for q in (1, 2, None) for i in range(60 if q else 2)]
    got = ranking.best_with_bounds(spark.createDataFrame(hits, "query int, ord int, raw double").repartition(5), "query", "raw", "ord", 7).collect()
    want = []
    for q in (1, 2, None):
        own = sorted((h for h in hits if h[0] == q), key=lambda h: (-h[2], h[1]))
        want += [(q or 0, h[1], h[2], n, own[-1][2], own[0][2]) for n, h in enumerate(own[:7], 1)]
    assert sorted((r["query"] or 0, r["ord"], r["raw"], r["rank"], r["lo"], r["hi"]) for r in got) == sorted(want)


def test_scores_over_all_notes_equal_the_explained_ones(spark):
    notes = spark.createDataFrame([(i, f"planet plan {'walk ' * (i % 3)} n{i}", "plan" if i % 4 else "walks") for i in range(40)], "ord int, body string, title string")
    index = retrieval.postings(notes, {"body": "body", "title": "title"})
    asked = spark.createDataFrame([(q, t) for q, ts in ((1, ["plan", "pla"]), (2, ["walk", "n"])) for t in ts], "query int, term string")
    scores = lambda df: {(r["query"], r["ord"]): round(r["score"], 9) for r in df.collect()}
    got = retrieval.bm25_plus(index, asked, explain=False)
    assert scores(got) == scores(retrieval.bm25_plus(index, asked)) and len(scores(got)) == 80
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [ord" in plan  # a note's terms are summed before the queries come in


def test_grep_reads_common_terms_from_the_first_notes_only(spark, monkeypatch):
    g = random.Random(4)
    words = ["alpha", "beta gamma", "rare", "xalphax"]
    notes = [(i, f"p{i}/alpha.md" if i % 50 == 0 else f"p{i}.md", " ".join(g.choice(words[:2]) for _ in range(4)) + (" rare end" if i > 150 and i % 9 == 0 else "") if i % 7 else None) for i in range(300)]
    queries = [(1, ["Alpha", "rare"]), (2, ["beta gamma"]), (3, ["rare end", "nowhere"]), (4, ["a"])]
    read = []
    whole = retrieval.in_bodies
    monkeypatch.setattr(retrieval, "in_bodies", lambda n, t: read.append((n.count(), sorted(r["term"] for r in t.collect()))) or whole(n, t))
    frames = spark.createDataFrame(notes, "ord int, path string, body string"), spark.createDataFrame(queries, "query int, terms array<string>")
    got = retrieval.grep(*frames, limit=5, early=40).collect()
    want = []
    for q, terms in queries:
        terms = [t.lower() for t in terms if len(t) > 1]
        hits = [(sum(t in p for t in terms), any(t in (b or "") for t in terms), i) for i, p, b in notes]
        hits = sorted((0 if a else 1, -a, i) for a, b, i in hits if a or b)
        want += [(q, i, tier, -a, n) for n, (tier, a, i) in enumerate(hits[:5], 1)]
    assert sorted(tuple(r[c] for c in ("query", "ord", "tier", "matches", "rank")) for r in got) == sorted(want)
    assert read == [(40, ["alpha", "beta gamma", "nowhere", "rare", "rare end"]), (300, ["nowhere", "rare", "rare end"])]


def test_lexical_chunks_leave_a_task_in_small_batches():
    import pyarrow as pa

    texts = [f"# H{i}\n" + f"word{i} " * 2000 for i in range(150)] + [None, "short"]
    batch = pa.RecordBatch.from_pydict({"path": [f"p{i}" for i in range(len(texts))], "title": ["t"] * len(texts), "body": pa.array(texts, pa.string())})
    made = list(chunks._chunked(500, 20_000)(iter([batch, batch.slice(0, 0)])))
    assert max(sum(map(len, b.column("content").to_pylist())) for b in made) < 21_000
    want = [(f"p{i}", n, *c) for i, t in enumerate(texts) for n, c in enumerate(chunks.note_chunks("t", t, 500))]
    assert [tuple(r.values()) for b in made for r in b.to_pylist()] == want


def test_blocks_of_vectors_need_little_memory():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    g = np.random.default_rng(2)
    v = g.normal(size=(4096, 32)).astype(np.float32)
    table = lambda name: pa.table({name: np.arange(len(v)), "vector": pa.FixedSizeListArray.from_arrays(v.ravel(), 32).cast(pa.list_(pa.float32()))})
    asked, held = table("query"), table("id")
    tracemalloc.start()
    got = vectors._best(3)(asked, held).to_pandas()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20_000_000
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    s = np.round(u[:50] @ u.T, 6)
    s[np.arange(50), np.arange(50)] = -np.inf
    assert got["row"][:150].tolist() == np.argsort(-s, axis=1, kind="stable")[:, :3].ravel().tolist()
    odd = pa.array([[1.0, None], None, [], [0.0, 0.0], [3.0, 4.0], [2.0], [float("nan"), 1.0]], pa.list_(pa.float64()))
    found = {d: (p.tolist(), u.tolist()) for d, (p, u) in vectors.unit_vectors(pa.chunked_array([odd.slice(0, 2), odd.slice(2)])).items()}
    assert found == {1: ([5], [[1.0]]), 2: ([4], [[0.6, 0.8]])}


def test_diverse_top_deals_out_few_rows(spark):
    import pyarrow as pa

    g = random.Random(6)
    hits = [(g.choice(["a", "b"]), g.randint(0, 400), g.choice([float(g.randint(0, 99)), None]) if i % 50 == 0 else float(g.randint(0, 99)), i) for i in range(6000)]
    hits += [("few", i % 3, float(i % 40), 10_000 + i) for i in range(500)] + [(None, i, 1.0, 20_000 + i) for i in range(30)]
    g.shuffle(hits)
    df = spark.createDataFrame(hits, "query string, note int, score double, tie int").repartition(7)
    got = ranking.diverse_top(df, "query", "note", "score", "tie", 5).collect()
    want = []
    for q in ("a", "b", "few", None):
        own = sorted((h for h in hits if h[0] == q), key=lambda h: (h[2] is None, -(h[2] or 0), h[3]))
        seen, first, again = set(), [], []
        for h in own:
            (again if h[1] in seen else first).append(h)
            seen.add(h[1])
        top = sorted((first + again)[:5], key=lambda h: (h[2] is None, -(h[2] or 0), h[3]))
        want += [(*h, n) for n, h in enumerate(top, 1)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    batches = [pa.RecordBatch.from_pydict(dict(zip(("query", "note", "score", "tie"), zip(*hits[i : i + 500])))) for i in range(0, len(hits), 500)]
    kept = sum(b.num_rows for b in ranking._contenders("query", "note", "score", "tie", 5, 1000)(iter(batches)))
    assert kept < 4 * 15 + sum(h[2] is None for h in hits) + 1
