"""Queries on links, names, turns, citations, tabs and rescored hits, each with its DuckDB SQL. Part of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import dates, text
from corpusloom.operators import corpus, dialogue, links
from corpusloom.plans import catalogue
from corpusloom.plans import views as V
from corpusloom.plans.catalogue import query

_LINKED = r"""l AS (SELECT ord, path, 'See [[doc_' || (ord * 7 + 1) % n || '|first]] and [[doc_' || (ord * 11 + 3) % n || '#part]], again [[doc_' || (ord * 7 + 1) % n || '|first]]; ![[doc_' || ord || ']]'
  || CASE WHEN ord % 10 = 0 THEN ' [[lost_' || ord || ']]' ELSE '' END AS body FROM notes, (SELECT max(ord) + 1 AS n FROM notes))"""


def _linked(spark, sf_dir):
    notes = V.notes(spark, sf_dir).select("ord", "path")
    rows = notes.crossJoin(F.broadcast(notes.agg((F.max("ord") + 1).alias("n"))))  # one row
    body = "concat('See [[doc_', (ord * 7 + 1) % n, '|first]] and [[doc_', (ord * 11 + 3) % n, '#part]], again [[doc_', (ord * 7 + 1) % n, '|first]]; ![[doc_', ord, ']]', if(ord % 10 = 0, concat(' [[lost_', ord, ']]'), ''))"
    return rows.select("ord", "path", F.expr(body).alias("body"))


@query(rf"""WITH {V.NOTES_SQL}, {_LINKED}, m AS (SELECT ord, unnest(regexp_extract_all(regexp_replace(body, '!\[\[[^\]]*\]\]', '', 'g'), '\[\[[^\]]+\]\]')) AS raw FROM l),
d AS (SELECT DISTINCT ord, regexp_extract(raw, '^\[\[([^\]|#]*)', 1) AS target, regexp_extract(raw, '^\[\[[^\]|#]*#([^\]|]*)', 1) AS section, regexp_extract(raw, '\|([^\]]*)', 1) AS display FROM m),
b AS (SELECT basename AS target, min(path) AS a, max(path) AS z FROM notes GROUP BY basename)
SELECT d.*, CASE WHEN a = z THEN a END AS path, CASE WHEN a = z THEN 'resolved' WHEN a IS NULL THEN 'unresolved' ELSE 'ambiguous' END AS status FROM d LEFT JOIN b USING (target)""")
def link_resolve(spark, sf_dir):
    notes = _linked(spark, sf_dir)
    return links.resolve_links(links.mentions(notes, "ord", "body"), notes)


_REQUESTS = """r AS (SELECT DISTINCT CASE ord % 6 WHEN 0 THEN path WHEN 1 THEN replace(path, '.md', '') WHEN 2 THEN upper(path) WHEN 3 THEN upper(basename) WHEN 4 THEN split_part(folder, '/', 2) || '/' || basename ELSE basename || '_gone' END AS request FROM notes)"""


@query(rf"""WITH {V.NOTES_SQL}, {_REQUESTS}, p AS (SELECT path, replace(path, '.md', '') AS stem, string_split(lower(path), '/') AS s FROM notes),
t AS (SELECT path, array_to_string(list_slice(s, i, len(s)), '/') AS tail FROM (SELECT path, s, unnest(range(1, len(s) + 1)) AS i FROM p)),
k AS (SELECT 1 AS tier, path AS key, path FROM p UNION ALL SELECT 2, stem, path FROM p UNION ALL SELECT 3, lower(path), path FROM p UNION ALL SELECT 3, lower(stem), path FROM p
  UNION ALL SELECT 4, replace(s[-1], '.md', ''), path FROM p UNION ALL SELECT 5, tail, path FROM t UNION ALL SELECT 5, replace(tail, '.md', ''), path FROM t),
h AS (SELECT request, tier, count(DISTINCT path) AS matches, min(path) AS path FROM r JOIN k ON k.key = CASE WHEN tier < 3 THEN request ELSE lower(request) END GROUP BY request, tier),
b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY request ORDER BY tier) = 1)
SELECT request, tier, coalesce(matches, 0) AS matches, CASE WHEN matches = 1 THEN path END AS path FROM r LEFT JOIN b USING (request)""")
def path_resolve(spark, sf_dir):
    notes = V.notes(spark, sf_dir)
    request = "CASE ord % 6 WHEN 0 THEN path WHEN 1 THEN replace(path, '.md', '') WHEN 2 THEN upper(path) WHEN 3 THEN upper(basename) WHEN 4 THEN concat(split_part(folder, '/', 2), '/', basename) ELSE concat(basename, '_gone') END"
    return links.resolve_paths(notes.select(F.expr(request).alias("request")), notes)


@query(f"""WITH {V.EDGES_SQL}, b AS (SELECT src AS note, dst AS other, true AS o FROM edges UNION ALL SELECT dst, src, false FROM edges)
SELECT note, other, bool_or(o) AS links, bool_or(NOT o) AS backlinks FROM b WHERE note <> other GROUP BY note, other""")
def link_directions(spark, sf_dir):
    return links.directions(V.edges(spark, sf_dir))


@query(f"""WITH {V.NOTES_SQL}, {V.EDGES_SQL}, e AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst), o AS (SELECT src AS ord, count(*) AS n FROM e GROUP BY src), i AS (SELECT dst AS ord, count(*) AS n FROM e GROUP BY dst)
SELECT ord, coalesce(o.n, 0) AS outgoing, coalesce(i.n, 0) AS incoming, i.n IS NULL AS orphan FROM (SELECT DISTINCT ord FROM notes) LEFT JOIN o USING (ord) LEFT JOIN i USING (ord)""")
def link_census(spark, sf_dir):
    return links.census(V.notes(spark, sf_dir), V.edges(spark, sf_dir), "ord")


@query(rf"""WITH {V.NOTES_SQL}, b AS (SELECT ord, string_split(regexp_replace(body, '\n([A-Za-z])', chr(10) || '- [x] \1', 'g'), chr(10)) AS s FROM notes),
l AS (SELECT ord, unnest(s) AS line, unnest(range(1, len(s) + 1)) AS pos FROM b)
SELECT ord, CAST(pos AS INTEGER) AS line, regexp_extract(line, '^\s*[-*+] \[(.)\] +(.*)$', 1) <> ' ' AS done, md5(regexp_extract(line, '^\s*[-*+] \[(.)\] +(.*)$', 2)) AS task FROM l WHERE regexp_matches(line, '^\s*[-*+] \[(.)\] +(.*)$')""")
def note_tasks(spark, sf_dir):
    n = V.notes(spark, sf_dir).select("ord", F.regexp_replace("body", r"\n([A-Za-z])", "\n- [x] $1").alias("body"))
    return links.tasks(n, "ord", "body").withColumn("task", F.md5("task"))


@query(f"""WITH {V.NOTES_SQL}, m AS (SELECT path, 1 AS origin FROM notes WHERE starts_with(basename, 'doc_1') UNION ALL SELECT path, 2 FROM notes WHERE len(list_filter(tags, lambda t: t = '#lang/en' OR starts_with(t, '#lang/en/'))) > 0
  UNION ALL SELECT path, 3 FROM notes WHERE len(list_filter(tags, lambda t: t = '#lang' OR starts_with(t, '#lang/'))) > 0) SELECT path, min(origin) AS origin FROM m GROUP BY path""")
def guaranteed_matches(spark, sf_dir):
    n = V.notes(spark, sf_dir).select("path", "basename", "tags")
    by_tag = [n.where(text.tag_matches(F.col("tags"), t)) for t in ("#LANG/en", "lang")]
    return links.ordered_union([n.where(F.col("basename").startswith("doc_1")), *by_tag], "path")


@query(f"""WITH u AS ({catalogue.SQL["url_normalize"]}), t AS (SELECT u.url, page_id, CASE WHEN page_id % 3 = 0 THEN substr(html, 16, 20) END AS title, page_id % 5 = 0 AS active FROM u JOIN pages USING (page_id)),
g AS (SELECT url, arg_max(title, page_id) FILTER (title IS NOT NULL) AS title, max(page_id) FILTER (active) AS latest FROM t GROUP BY url)
SELECT url, title, coalesce(latest = (SELECT max(page_id) FROM t WHERE active), false) AS active FROM g""")
def tab_merge(spark, sf_dir):
    p = V.table(spark, sf_dir, "pages")
    tabs = p.select("page_id", "url", F.when(F.col("page_id") % 3 == 0, F.substring("html", 16, 20)).alias("title"), (F.col("page_id") % 5 == 0).alias("active"))
    return links.merge_tabs(tabs, ["title"], "page_id")


@query("""WITH c AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS r, lead(turn) OVER w AS t, lead(text) OVER w AS x FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, turn AS asked, t AS answered, md5(text) AS question, md5(x) AS answer FROM c WHERE role = 'user' AND r = 'assistant'""")
def turn_pairs(spark, sf_dir):
    return dialogue.turn_pairs(V.table(spark, sf_dir, "conversations"), "conv_id", "turn").withColumns({"question": F.md5("question"), "answer": F.md5("answer")})


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value, min(event_id) AS first FROM events GROUP BY 1, 2")
def segment_latest(spark, sf_dir):
    return dialogue.latest_segments(V.table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id", "value")


@query("""WITH f AS (SELECT l_orderkey AS doc, l_partkey % 7 AS number, min(l_linenumber) AS p FROM lineitem GROUP BY 1, 2)
SELECT doc, number, row_number() OVER (PARTITION BY doc ORDER BY p, number) AS renumbered FROM f""")
def citation_renumber(spark, sf_dir):
    c = V.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("pos"), (F.col("l_partkey") % 7).alias("number"))
    return dialogue.renumber_citations(c, "doc", "pos", "number")


@query("""WITH b AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS id, l_linenumber * 5 AS s, l_linenumber * 5 + CAST(l_quantity AS BIGINT) AS e FROM lineitem)
SELECT doc, id, s AS start, e AS "end" FROM b WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.doc = b.doc AND o.s <= b.s AND o.e >= b.e AND (o.s < b.s OR o.e > b.e OR o.id < b.id))""")
def outer_blocks(spark, sf_dir):
    b = V.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("id"), (F.col("l_linenumber") * 5).alias("start"), (F.col("l_linenumber") * 5 + F.col("l_quantity").cast("long")).alias("end"))
    return dialogue.outermost(b, "doc")


@query(f"""WITH {catalogue._TWO_LISTS}, u AS (SELECT query, ord, 0.3::DOUBLE / rank AS s FROM a UNION ALL SELECT query, ord, 0.7::DOUBLE / (rank + 1) FROM b)
SELECT query, ord, round(sum(s), 9) AS score FROM u GROUP BY query, ord""")
def hybrid_weighted(spark, sf_dir):
    a, b = catalogue._two_lists(spark, sf_dir)
    lex = a.select("query", "ord", (1 / F.col("rank")).alias("score"))
    sem = b.select("query", "ord", (1 / (F.col("rank") + 1)).alias("score"))
    return dialogue.hybrid_scores(lex, sem, ["query", "ord"], 0.3).withColumn("score", F.round("score", 9))


@query(f"""WITH {V.NOTES_SQL}, {V.HITS_SQL}, o AS (SELECT query, ord, score, CASE WHEN ord % 4 <> 0 THEN (ord * 13) % 11 END AS fresh, row_number() OVER (PARTITION BY query ORDER BY score DESC, ord) AS old FROM hits QUALIFY old <= 30)
SELECT query, ord, row_number() OVER (PARTITION BY query ORDER BY old > 20, CASE WHEN old <= 20 THEN fresh END DESC NULLS LAST, old) AS rank FROM o""")
def rerank_splice(spark, sf_dir):
    h = V.hits(spark, sf_dir).withColumn("fresh", F.when(F.col("ord") % 4 != 0, (F.col("ord") * 13) % 11))
    return dialogue.splice_reranked(h, "query", "score", "fresh", "ord").select("query", "ord", "rank")


@query("SELECT vec_id // 5 AS path FROM embeddings GROUP BY 1 HAVING bool_or(vec_id % 17 = 0 OR embedding IS NULL OR len(embedding) = 0)")
def index_integrity(spark, sf_dir):
    e = V.table(spark, sf_dir, "embeddings")
    return corpus.incomplete_paths(e.select(F.expr("vec_id div 5").alias("path"), F.when(F.col("vec_id") % 17 != 0, F.col("embedding")).alias("embedding")))


@query("""SELECT o_orderkey, date_trunc('day', CAST(o_orderdate AS TIMESTAMP)) - INTERVAL 10 DAY AS days, date_trunc('day', CAST(o_orderdate AS TIMESTAMP)) - INTERVAL 3 MONTH AS months, CAST((o_orderkey % 5) * 3600 + (o_orderkey % 60) * 60 AS BIGINT) AS seconds,
CASE WHEN o_orderkey % 20 <= 14 THEN CAST(-(o_orderkey % 20) * 60 AS INTEGER) END AS minutes FROM orders""")
def relative_times(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders")
    day, key = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey")
    start = lambda count, unit: dates.relative_range(count, unit, day)[0].cast("timestamp_ntz").alias(unit)
    length = F.concat(F.lit("PT"), (key % 5).cast("string"), F.lit("H"), (key % 60).cast("string"), F.lit("M"))
    return o.select("o_orderkey", start(10, "days"), start(3, "months"), dates.duration_seconds(length).alias("seconds"), dates.utc_offset(F.concat(F.lit("utc-"), (key % 20).cast("string"))).alias("minutes"))
