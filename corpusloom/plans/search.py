"""Lexical search as queries, with their DuckDB SQL. Part of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import ranking, retrieval
from corpusloom.plans import views as V
from corpusloom.plans.catalogue import query
from corpusloom.tables import saved

FIELDS = {"title": "basename", "heading": "heading", "tags": "tags", "path": "names", "body": "body"}
_TAG = r"#[\p{L}\p{N}_/-]+"
_CJK = r"[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]+"


def _notes(spark, sf_dir):
    return V.notes(spark, sf_dir).withColumn("names", F.replace(F.regexp_replace("path", r"\.md$", ""), F.lit("/"), F.lit(" ")))


def terms_sql(column: str) -> str:
    parts = "list_filter(string_split(substr(t, 2), '/'), lambda p: p <> '')"
    prefixes = f"list_transform(range(1, len({parts}) + 1), lambda i: array_to_string(list_slice({parts}, 1, i), '/'))"
    tags = f"flatten(list_transform(regexp_extract_all(lower({column}), '{_TAG}'), lambda t: list_concat([t, substr(t, 2)], list_concat(list_transform({prefixes}, lambda p: '#' || p), list_concat({prefixes}, {parts})))))"
    plain = f"regexp_extract_all(regexp_replace(lower({column}), '{_TAG}', ' ', 'g'), '[a-z0-9_]+')"
    cjk = f"flatten(list_transform(regexp_extract_all({column}, '{_CJK}'), lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END))"
    return f"list_filter(list_distinct(list_concat({tags}, list_concat({plain}, {cjk}))), lambda t: t NOT IN ('', '#'))"


def salient_sql(column: str) -> str:
    words = rf"list_filter(regexp_split_to_array(regexp_replace(lower({column}), '[^a-z0-9_\s-]', ' ', 'g'), '\s+'), lambda w: length(w) >= 2)"
    return f"list_distinct(flatten(list_transform({words}, lambda v: CASE WHEN contains(v, '-') THEN list_concat([v], list_filter(string_split(v, '-'), lambda p: length(p) >= 2)) ELSE [v] END)))"


_INDEX = f"""f AS MATERIALIZED (SELECT ord, 'body' AS field, 1.0 AS w, {terms_sql("coalesce(body, '')")} AS t FROM notes UNION ALL SELECT ord, 'heading', 2.5, {terms_sql("heading")} FROM notes
  UNION ALL SELECT ord, 'path', 1.5, {terms_sql("replace(replace(path, '.md', ''), '/', ' ')")} FROM notes UNION ALL SELECT ord, 'title', 5.0, {terms_sql("basename")} FROM notes
  UNION ALL SELECT ord, 'tags', 4.0, {terms_sql("array_to_string(tags, ' ')")} FROM notes),
p AS MATERIALIZED (SELECT ord, field, w, len(t) AS n_terms, unnest(t) AS term FROM f)"""
_NEAR = """near AS MATERIALIZED (SELECT v.term, q.term AS asked, CASE WHEN v.term = q.term THEN 1.0::DOUBLE ELSE 0.375::DOUBLE * length(v.term) / (length(v.term) + 0.3::DOUBLE * (length(v.term) - length(q.term))) END AS nearness
  FROM (SELECT DISTINCT term FROM q) q JOIN (SELECT DISTINCT term FROM p) v ON starts_with(v.term, q.term))"""
_SCORE = "w * ln(1 + (n - df + 0.5) / (df + 0.5)) * (2.2 / (1 + 1.2 * (1 - 0.7 + 0.7 * n_terms / mean)) + 0.5) * nearness"
_MATCHES = "md5(array_to_string(list_sort(list_distinct(list(field || ':' || p.term || ':' || w))), ' '))"


def _matches(column: str = "matches"):
    return F.md5(F.array_join(F.array_sort(F.transform(column, lambda m: F.concat_ws(":", m["field"], m["term"], m["weight"].cast("string")))), " "))


@query(f"""
WITH {V.NOTES_SQL}, {V.QUESTIONS_SQL}, {_INDEX},
s AS (SELECT field, count(DISTINCT ord) AS n, count(*) / count(DISTINCT ord) AS mean FROM p GROUP BY field),
q AS (SELECT DISTINCT query, unnest({terms_sql("text")}) AS term FROM questions), {_NEAR},
df AS (SELECT field, term, count(*) AS df FROM p GROUP BY field, term),
sc AS (SELECT q.query, p.ord, sum({_SCORE}) AS score, {_MATCHES} AS matches
  FROM q JOIN near ON q.term = near.asked JOIN p ON p.term = near.term JOIN df ON df.field = p.field AND df.term = p.term JOIN s ON s.field = p.field GROUP BY q.query, p.ord),
r AS (SELECT query, ord, round(score, 6) AS score, matches FROM sc),
m AS (SELECT *, min(score) OVER (PARTITION BY query) AS lo, max(score) OVER (PARTITION BY query) AS hi FROM r)
SELECT query, ord, round(CASE WHEN hi = lo THEN 0.5 ELSE 0.02 + (score - lo) / (hi - lo) * 0.96 END, 6) AS score, matches,
  row_number() OVER (PARTITION BY query ORDER BY score DESC, ord) AS rank FROM m
QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, ord) <= 10""".replace("field || ':' || p.term", "p.field || ':' || p.term"))
def bm25_topk(spark, sf_dir):
    """The ten best notes for every whole benchmark text, over all notes and fields, with terms by prefix and what they matched."""
    q = V.questions(spark, sf_dir).select("query", F.explode(text.terms(F.col("text"))).alias("term"))
    index = saved(retrieval.postings(_notes(spark, sf_dir), FIELDS), "postings")
    hits = retrieval.bm25_plus(index, q, explain=False).withColumn("raw", F.round("score", 6))
    best = saved(ranking.best_with_bounds(hits, "query", "raw", "ord", 10), "best")
    why = retrieval.bm25_plus(index.join(best.select("ord").distinct(), "ord", "left_semi"), q, best).select("query", "ord", "matches")
    score = F.when(F.col("hi") == F.col("lo"), 0.5).otherwise(0.02 + F.try_divide(F.col("raw") - F.col("lo"), F.col("hi") - F.col("lo")) * 0.96)
    return best.join(why, ["query", "ord"]).select("query", "ord", F.round(score, 6).alias("score"), _matches().alias("matches"), "rank")


_RECALL = f"""q0 AS (SELECT query, left(trim(text), 1000) AS text FROM questions WHERE trim(text) <> ''),
g AS (SELECT query, list_distinct(list_filter(list_concat([lower(text)], {salient_sql("text")}), lambda t: length(t) > 1)) AS terms FROM q0),
gh AS (SELECT query, ord, len(list_filter(terms, lambda t: contains(lower(path), t))) AS a, len(list_filter(terms, lambda t: contains(lower(body), t))) AS b FROM g, notes),
gt AS (SELECT query, ord, CASE WHEN a > 0 THEN 0 ELSE 1 END AS tier, CAST(a AS BIGINT) AS matches FROM gh WHERE a > 0 OR b > 0),
c AS MATERIALIZED (SELECT query, ord, tier, matches, row_number() OVER (PARTITION BY query ORDER BY tier, matches DESC, ord) AS rank FROM gt QUALIFY row_number() OVER (PARTITION BY query ORDER BY tier, matches DESC, ord) <= 200)"""


@query(f"WITH {V.NOTES_SQL}, {V.QUESTIONS_SQL}, {_RECALL} SELECT query, ord, tier, matches, rank FROM c")
def grep_recall(spark, sf_dir):
    q = V.questions(spark, sf_dir).where(F.trim("text") != "").select("query", retrieval.recall_terms(F.col("text")).alias("terms"))
    return retrieval.grep(V.notes(spark, sf_dir), q, 200)


@query(f"""WITH {V.NOTES_SQL.replace("FROM documents", "FROM documents")}, {V.QUESTIONS_SQL}, {V.EDGES_SQL}, {_RECALL}, {_INDEX},
q AS (SELECT DISTINCT query, unnest({terms_sql(f"CASE WHEN len({salient_sql('text')}) > 0 THEN array_to_string({salient_sql('text')}, ' ') ELSE text END")}) AS term FROM q0), {_NEAR},
s AS (SELECT query, field, count(*) AS n, sum(len(t)) / count(*) AS mean FROM c JOIN f USING (ord) WHERE len(t) > 0 GROUP BY query, field),
cp AS MATERIALIZED (SELECT c.query, p.* FROM c JOIN p USING (ord)), qn AS MATERIALIZED (SELECT q.query, near.term, nearness FROM q JOIN near ON q.term = near.asked),
df AS MATERIALIZED (SELECT query, field, term, count(*) AS df FROM cp GROUP BY query, field, term),
sc AS (SELECT query, ord AS note, round(sum({_SCORE}), 6) AS score, {_MATCHES.replace("p.term", "term")} AS matches FROM cp JOIN qn USING (query, term) JOIN df USING (query, field, term) JOIN s USING (query, field) GROUP BY query, ord),
h AS MATERIALIZED (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, note) <= 90),
tot AS (SELECT folder, count(*) AS total FROM notes GROUP BY folder), hf AS (SELECT h.*, folder FROM h JOIN notes ON ord = note),
fb AS (SELECT query, folder, count(DISTINCT note) AS n, count(DISTINCT note) / any_value(total) AS r FROM hf JOIN tot USING (folder) GROUP BY query, folder),
b AS (SELECT query, note, matches, score * CASE WHEN n >= 2 AND r >= 0.4 THEN least(1 + log2(n + 1) * sqrt(r), 1.15) ELSE 1.0 END AS score FROM hf JOIN fb USING (query, folder)),
k AS MATERIALIZED (SELECT query, note, score FROM b QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, note) <= 20),
bk AS (SELECT k.query, k.note, count(DISTINCT src) AS n FROM k JOIN edges ON k.note = dst JOIN k o ON o.query = k.query AND o.note = src WHERE src <> k.note GROUP BY 1, 2),
ct AS (SELECT query, note, src FROM k JOIN edges ON note = dst), co AS (SELECT x.query, x.note, count(DISTINCT y.note) AS n FROM ct x JOIN ct y ON x.query = y.query AND x.src = y.src AND x.note <> y.note GROUP BY 1, 2),
tg AS (SELECT query, k.note, unnest(tags) AS tag FROM k JOIN notes ON ord = k.note), st AS (SELECT x.query, x.note, count(DISTINCT y.note) AS n FROM tg x JOIN tg y ON x.query = y.query AND x.tag = y.tag AND x.note <> y.note GROUP BY 1, 2),
gb AS (SELECT k.query, k.note, k.score * least(1 + 0.1 * ln(1 + coalesce(bk.n, 0) * 1.0 + coalesce(co.n, 0) * 0.5 + coalesce(st.n, 0) * 0.3), 1.15) AS boosted
  FROM k LEFT JOIN bk USING (query, note) LEFT JOIN co USING (query, note) LEFT JOIN st USING (query, note)),
e AS (SELECT b.query, b.note, b.matches, round(coalesce(boosted, b.score), 6) AS score FROM b LEFT JOIN gb USING (query, note)),
z AS (SELECT *, min(score) OVER (PARTITION BY query) AS lo, max(score) OVER (PARTITION BY query) AS hi FROM e),
y AS (SELECT query, note, matches, round(CASE WHEN hi = lo THEN 0.5 ELSE 0.02 + (score - lo) / (hi - lo) * 0.96 END, 6) AS score FROM z)
SELECT query, note, score, matches, row_number() OVER (PARTITION BY query ORDER BY score DESC, note) AS rank FROM y QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, note) <= 30""")
def search_pipeline(spark, sf_dir):
    """The whole lexical search of every benchmark text: recall, scores over its candidates, boosts, normalised scores, 30 notes."""
    found = retrieval.search(_notes(spark, sf_dir), V.edges(spark, sf_dir), V.questions(spark, sf_dir), FIELDS)
    return found.select("query", "note", "score", _matches().alias("matches"), "rank")
