"""The library's operators as queries over the given tables, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import dates, text, urls
from corpusloom.operators import corpus, links, ranking, vectors
from corpusloom.plans import views as V
from corpusloom.sources import chats
from corpusloom.sources.html import extract_pages
from corpusloom.sources.markdown import line_windows, section_chunks
from corpusloom.streaming import events as feed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_TWO_LISTS = f"""{V.NOTES_SQL}, {V.HITS_SQL},
a AS (SELECT query, ord, row_number() OVER (PARTITION BY query ORDER BY score DESC, ord) AS rank FROM hits QUALIFY rank <= 50),
b AS (SELECT query, ord, row_number() OVER (PARTITION BY query ORDER BY length(body) DESC, ord) AS rank FROM hits JOIN notes USING (ord) QUALIFY rank <= 50)"""


def _two_lists(spark, sf_dir):
    h = V.hits(spark, sf_dir).join(V.notes(spark, sf_dir).select("ord", F.length("body").alias("n")), "ord")
    rank = lambda *o: F.row_number().over(Window.partitionBy("query").orderBy(*o))
    return (h.select("query", "ord", "score", rank(*o).alias("rank")).where("rank <= 50") for o in ((F.desc("score"), "ord"), (F.desc("n"), "ord")))


@query(f"WITH {_TWO_LISTS} SELECT query, ord, round(sum(1 / (60 + rank)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY query, ord")
def rrf_fusion(spark, sf_dir):
    a, b = _two_lists(spark, sf_dir)
    return ranking.reciprocal_rank_fusion(a.unionByName(b), "query", "ord", "rank").withColumn("score", F.round("score", 9))


@query(f"""WITH {_TWO_LISTS},
l AS (SELECT query, ord, 1 / rank * CASE WHEN ord % 3 = 0 THEN 1.1 ELSE 1.0 END AS lex FROM a), s AS (SELECT query, ord, 1 / (rank + 1) AS sem FROM b)
SELECT query, ord, round(greatest(lex, sem), 9) AS score, CASE WHEN lex IS NOT NULL AND sem IS NOT NULL THEN 'hybrid' WHEN lex IS NOT NULL THEN 'lexical' ELSE 'semantic' END AS source
FROM l FULL JOIN s USING (query, ord)""")
def merge_lex_sem(spark, sf_dir):
    a, b = _two_lists(spark, sf_dir)
    lex = a.select("query", "ord", (1 / F.col("rank")).alias("score"), (F.col("ord") % 3 == 0).alias("by_tag"))
    sem = b.select("query", "ord", (1 / (F.col("rank") + 1)).alias("score"))
    return ranking.merge_lexical_semantic(lex, sem, ["query", "ord"]).withColumn("score", F.round("score", 9))


@query(f"""WITH {V.NOTES_SQL}, f AS (SELECT path, ord FROM notes WHERE list_contains(tags, '#src1')),
s AS (SELECT CASE WHEN ord % 50 = 0 THEN NULL ELSE path END AS path, ord FROM notes WHERE mtime >= 1704067200000 + 360000000)
SELECT path, ord, 'filter' AS origin FROM f UNION ALL SELECT path, ord, 'search' FROM s WHERE path IS NULL OR path NOT IN (SELECT path FROM f)""")
def filter_search_merge(spark, sf_dir):
    n = V.notes(spark, sf_dir)
    f = n.where(F.exists("tags", lambda t: F.lower(t) == "#src1")).select("path", "ord")
    s = n.where(F.col("mtime") >= 1704067200000 + 360000000).select(F.when(F.col("ord") % 50 != 0, F.col("path")).alias("path"), "ord")
    return ranking.filter_over_search(f, s)


@query(f"""WITH {V.NOTES_SQL}, c AS (SELECT path, md5(body) AS h FROM notes WHERE ord % 11 <> 0),
i AS (SELECT path, md5(CASE WHEN ord % 7 = 0 THEN body || ' old' ELSE body END) AS h FROM notes WHERE ord % 13 <> 0)
SELECT path, CASE WHEN i.h IS NULL THEN 'new' WHEN c.h IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM c FULL JOIN i USING (path) WHERE c.h IS DISTINCT FROM i.h""")
def hash_diff(spark, sf_dir):
    n = V.notes(spark, sf_dir)
    now = n.where("ord % 11 <> 0").select("path", F.md5("body").alias("hash"))
    old = n.where("ord % 13 <> 0").select("path", F.md5(F.when(F.col("ord") % 7 == 0, F.concat("body", F.lit(" old"))).otherwise(F.col("body"))).alias("hash"))
    return corpus.hash_diff(now, old)


@query(f"""WITH {V.NOTES_SQL} SELECT path, ord FROM notes WHERE NOT ((starts_with(path, 'en/') OR starts_with(path, 'de/') OR list_contains(tags, '#lang/fr')) AND NOT starts_with(path, 'en/src3/') AND basename <> 'doc_8')""")
def index_gc(spark, sf_dir):
    n = V.notes(spark, sf_dir)
    eligible = n.where(text.indexable(F.col("path"), F.col("tags"), ["en", "de/", "#lang/FR"], ["en/src3", "[[doc_8]]"]))
    return corpus.collect_garbage(n.select("path", "ord"), eligible)


_UNIT_SQL = "v AS (SELECT vec_id, vec_id // 5 AS note, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


@query(f"""WITH {_UNIT_SQL}, nn AS (SELECT max(note) + 1 AS n FROM v),
k AS (SELECT q.note AS query, q.vec_id AS chunk, r.note AS note, r.vec_id, round(list_cosine_similarity(q.e, r.e), 6) AS s FROM v q, v r WHERE q.note IN (SELECT note FROM v WHERE vec_id % 20 = 0) AND q.vec_id <> r.vec_id
  QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, r.e), 6) DESC, r.vec_id) <= 20),
b AS (SELECT query, note, max(s) AS s FROM k WHERE query <> note GROUP BY query, note QUALIFY row_number() OVER (PARTITION BY query ORDER BY max(s) DESC, note) <= 20),
e AS (SELECT DISTINCT note AS src, unnest([(note * 7 + 1) % n, (note * 11 + 3) % n]) AS dst FROM v, nn),
l AS (SELECT query, note, CASE WHEN count(DISTINCT way) = 2 THEN 0.3 ELSE 0.24 END AS bonus FROM (
  SELECT src AS query, dst AS note, 1 AS way FROM e UNION ALL SELECT dst, src, 2 FROM e) WHERE query <> note AND query IN (SELECT note FROM v WHERE vec_id % 20 = 0) GROUP BY query, note),
c AS (SELECT query, note, round(coalesce(0.7 * s, 0) + coalesce(bonus, 0), 9) AS score, CASE WHEN coalesce(s, 0) > 0.7 THEN 3 WHEN coalesce(s, 0) > 0.55 THEN 2 ELSE 1 END AS category FROM b FULL JOIN l USING (query, note))
SELECT *, row_number() OVER (PARTITION BY query ORDER BY category DESC, score DESC, note) AS place FROM c""")
def knn_related(spark, sf_dir):
    v = V.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    note = F.expr("id div 5")
    all_notes = v.select(note.alias("src")).distinct()
    n = all_notes.agg((F.max("src") + 1).alias("n"))
    edges = all_notes.crossJoin(F.broadcast(n)).select("src", F.explode(F.array_distinct(F.array((F.col("src") * 7 + 1) % F.col("n"), (F.col("src") * 11 + 3) % F.col("n")))).alias("dst"))
    asked = v.where("id % 20 = 0").select(note.alias("query")).distinct()
    near = links.directions(edges).withColumnsRenamed({"note": "query", "other": "note"}).join(asked, "query", "left_semi")
    return vectors.related_notes(v, note, near, asked).select("query", "note", "score", "category", "place")


@query(f"""WITH {_UNIT_SQL}, k AS (SELECT q.vec_id AS id, r.vec_id AS other, round(list_cosine_similarity(q.e, r.e), 6) AS s FROM v q, v r WHERE q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id)
SELECT q.vec_id AS id, CASE WHEN max(s) IS NULL THEN 'insert' ELSE 'update' END AS action, arg_max(other, (s, -other)) AS target, max(s) AS similarity
FROM (SELECT vec_id FROM v WHERE vec_id % 20 = 0) q LEFT JOIN (SELECT * FROM k WHERE s >= 0.45) k ON k.id = q.vec_id GROUP BY q.vec_id""")
def memory_dedup(spark, sf_dir):
    v = V.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    new = v.where("id % 20 = 0")
    best = vectors.top_similar(new, v, 1, least=0.45).select(F.col("query").alias("id"), F.col("row").alias("target"), "similarity")
    return new.select("id").join(best, "id", "left").select("id", F.when(F.col("target").isNull(), "insert").otherwise("update").alias("action"), "target", "similarity")


@query(f"""WITH {_UNIT_SQL}, k AS (SELECT q.vec_id AS query, r.vec_id AS id, round(list_cosine_similarity(q.e, r.e), 6) AS similarity FROM v q, v r WHERE q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id)
SELECT query, id, similarity, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS rank FROM k WHERE similarity >= 0.1 QUALIFY rank <= 10""")
def memory_retrieve(spark, sf_dir):
    """The ten memories most similar to each asking one, at 0.1 or more."""
    v = V.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vectors.top_similar(v.where("id % 20 = 0"), v, 10, least=0.1).withColumnRenamed("row", "id").select("query", "id", "similarity", "rank")


@query("""WITH m AS (SELECT c_custkey AS id, CAST(c_nationkey AS DOUBLE) AS a, c_acctbal AS l, CAST((c_custkey * 7919) % 1000 AS DOUBLE) AS c FROM customer),
b AS (SELECT count(*) AS n, min(a) AS la, max(a) AS ha, min(l) AS ll, max(l) AS hl, min(c) AS lc, max(c) AS hc FROM m),
s AS (SELECT id, round(0.4 * (CASE WHEN ha = la THEN 0.5 ELSE (a - la) / (ha - la) END) + 0.3 * (1 - CASE WHEN hl = ll THEN 0.5 ELSE 1 - (l - ll) / (hl - ll) END) + 0.3 * (1 - CASE WHEN hc = lc THEN 0.5 ELSE 1 - (c - lc) / (hc - lc) END), 9) AS score, n FROM m, b)
SELECT id, score, row_number() OVER (ORDER BY score, id) AS place FROM s QUALIFY row_number() OVER (ORDER BY score, id) <= ceil(n * 0.1)""")
def memory_prune(spark, sf_dir):
    c = V.table(spark, sf_dir, "customer")
    m = c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("double").alias("accesses"), F.col("c_acctbal").alias("last_access"), ((F.col("c_custkey") * 7919) % 1000).cast("double").alias("created"))
    return corpus.prune_memories(m, F.lit(0), most=10)


@query(f"""WITH {V.NOTES_SQL}, {V.HITS_SQL}, h AS (SELECT * FROM hits WHERE score >= 0.3), t AS (SELECT folder, count(*) AS total FROM notes GROUP BY folder),
f AS (SELECT query, folder, count(DISTINCT note) AS n, count(DISTINCT note) / any_value(total) AS r FROM h JOIN t USING (folder) GROUP BY query, folder)
SELECT query, note, folder, score, round(score * CASE WHEN n >= 2 AND r >= 0.05 THEN least(1 + log2(n + 1) * sqrt(r), 1.15) ELSE 1.0 END, 9) AS boosted FROM h JOIN f USING (query, folder)""")
def folder_boost(spark, sf_dir):
    h = V.hits(spark, sf_dir).where("score >= 0.3").drop("ord")
    totals = V.notes(spark, sf_dir).groupBy("folder").agg(F.count("*").alias("total"))
    return ranking.folder_boost(h, totals, ratio=0.05).select("query", "note", "folder", "score", F.round("boosted", 9).alias("boosted"))


@query(f"""WITH {V.NOTES_SQL}, {V.HITS_SQL}, {V.EDGES_SQL}, c AS (SELECT query, note, score FROM hits QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, note) <= 20),
bk AS (SELECT c.query, c.note, count(DISTINCT src) AS n FROM c JOIN edges ON c.note = dst JOIN c o ON o.query = c.query AND o.note = src WHERE src <> c.note GROUP BY 1, 2),
ct AS (SELECT query, note, src FROM c JOIN edges ON note = dst), co AS (SELECT a.query, a.note, count(DISTINCT b.note) AS n FROM ct a JOIN ct b ON a.query = b.query AND a.src = b.src AND a.note <> b.note GROUP BY 1, 2),
tg AS (SELECT query, c.note, unnest(tags) AS tag FROM c JOIN notes ON ord = c.note), st AS (SELECT a.query, a.note, count(DISTINCT b.note) AS n FROM tg a JOIN tg b ON a.query = b.query AND a.tag = b.tag AND a.note <> b.note GROUP BY 1, 2)
SELECT c.query, c.note, c.score, coalesce(bk.n, 0) AS backlinks, coalesce(co.n, 0) AS co_citations, coalesce(st.n, 0) AS shared_tags,
round(c.score * least(1 + 0.1 * ln(1 + coalesce(bk.n, 0) * 1.0 + coalesce(co.n, 0) * 0.5 + coalesce(st.n, 0) * 0.3), 1.15), 9) AS boosted
FROM c LEFT JOIN bk USING (query, note) LEFT JOIN co USING (query, note) LEFT JOIN st USING (query, note)""")
def graph_boost(spark, sf_dir):
    top = Window.partitionBy("query").orderBy(F.desc("score"), "note")
    c = V.hits(spark, sf_dir).withColumn("rn", F.row_number().over(top)).where("rn <= 20").select("query", "note", "score")
    tags = V.notes(spark, sf_dir).select(F.col("ord").alias("note"), F.explode("tags").alias("tag"))
    return ranking.graph_boost(c, V.edges(spark, sf_dir), tags).withColumn("boosted", F.round("boosted", 9))


@query(f"""WITH {V.LINES_SQL}, a AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY query, note ORDER BY score DESC, tie) > 1 THEN 1 ELSE 0 END AS again FROM lines),
t AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY query ORDER BY again, score DESC, tie) <= 25)
SELECT query, note, score, tie, row_number() OVER (PARTITION BY query ORDER BY score DESC, tie) AS rank FROM t""")
def diverse_topk(spark, sf_dir):
    return ranking.diverse_top(V.lines(spark, sf_dir).drop("part"), "query", "note", "score", "tie", 25)


@query(f"""WITH {V.LINES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY note ORDER BY score DESC, tie) AS rank, greatest(max(score) OVER (PARTITION BY note) * 0.6, 0.01) AS threshold FROM lines)
SELECT note, tie, score, rank, round(threshold, 6) AS threshold FROM r WHERE rank <= 5 AND (rank <= 2 OR score >= threshold)""")
def adaptive_cutoff(spark, sf_dir):
    out = ranking.adaptive_cutoff(V.lines(spark, sf_dir), "note", "score", "tie", floor=2, ceiling=5, relative=0.6)
    return out.select("note", "tie", "score", "rank", F.round("threshold", 6).alias("threshold"))


def _orders(spark, sf_dir):
    return V.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("query"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"))


_ORDERS = "o AS (SELECT o_orderpriority AS query, o_orderkey AS id, o_totalprice AS score FROM orders)"


@query(f"WITH {_ORDERS}, b AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM o WINDOW w AS (PARTITION BY query)) SELECT query, id, score, round(CASE WHEN hi = lo THEN 0.5 ELSE 0.02 + (score - lo) / (hi - lo) * 0.96 END, 9) AS normalised FROM b")
def norm_minmax(spark, sf_dir):
    return ranking.min_max(_orders(spark, sf_dir), "query", "score").withColumn("normalised", F.round("normalised", 9))


@query(f"WITH {_ORDERS}, b AS (SELECT *, avg(score) OVER w AS m, stddev_pop(score) OVER w AS s FROM o WINDOW w AS (PARTITION BY query)) SELECT query, id, score, round(CASE WHEN s = 0 THEN 0.5 ELSE least(0.98, greatest(0.02, 0.5 + 0.5 * tanh((score - m) / s / 2.5))) END, 6) AS normalised FROM b")
def norm_zscore(spark, sf_dir):
    return ranking.z_score(_orders(spark, sf_dir), "query", "score").withColumn("normalised", F.round("normalised", 6))


@query(f"WITH {_ORDERS} SELECT query, id, score, round(CASE WHEN count(*) OVER (PARTITION BY query) = 1 THEN 0.5 ELSE 0.02 + (row_number() OVER (PARTITION BY query ORDER BY score, id) - 1) / (count(*) OVER (PARTITION BY query) - 1) * 0.96 END, 9) AS normalised FROM o")
def norm_percentile(spark, sf_dir):
    return ranking.percentile(_orders(spark, sf_dir), "query", "score", "id").withColumn("normalised", F.round("normalised", 9))


@query(f"""WITH {_ORDERS}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score, id) AS rn, count(*) OVER (PARTITION BY query) AS c FROM o)
SELECT query, count(*) AS n, round(avg(score), 4) AS mean, round(stddev_pop(score), 4) AS std, min(score) AS min, max(score) AS max, max(score) FILTER (rn = c // 2 + 1) AS median FROM r GROUP BY query""")
def score_stats(spark, sf_dir):
    return ranking.statistics(_orders(spark, sf_dir), "query", "score", "id").withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query("""WITH p AS (SELECT p_brand, (p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()) AS s FROM part)
SELECT p_brand AS query, count(*) FILTER (s >= 0.7) AS high, count(*) FILTER (s >= 0.3 AND s < 0.7) AS medium, count(*) FILTER (s < 0.3) AS low, round(avg(s), 6) AS mean FROM p GROUP BY p_brand""")
def quality_summary(spark, sf_dir):
    p = V.table(spark, sf_dir, "part").select("p_brand", "p_retailprice")
    b = p.agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    s = p.crossJoin(F.broadcast(b)).select(F.col("p_brand").alias("query"), F.try_divide(F.col("p_retailprice") - F.col("lo"), F.col("hi") - F.col("lo")).alias("s"))
    return s.groupBy("query").agg(F.count_if(F.col("s") >= 0.7).alias("high"), F.count_if((F.col("s") >= 0.3) & (F.col("s") < 0.7)).alias("medium"), F.count_if(F.col("s") < 0.3).alias("low"), F.round(F.avg("s"), 6).alias("mean"))


@query(f"WITH {V.LINES_SQL} SELECT part, score, tie, note, query FROM lines QUALIFY row_number() OVER (PARTITION BY part ORDER BY score DESC, tie) = 1")
def dedupe_sources(spark, sf_dir):
    return ranking.best_per_key(V.lines(spark, sf_dir), ["part"], "score", "tie")


@query(f"""WITH {V.NOTES_SQL}, t AS (SELECT unnest(tags) AS tag, 1 AS f, 0 AS i FROM notes UNION ALL SELECT unnest(inline_tags), 0, 1 FROM notes)
SELECT lower(tag) AS tag, count(*) AS occurrences, CAST(sum(f) AS BIGINT) AS frontmatter, CAST(sum(i) AS BIGINT) AS inline FROM t GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 500""")
def tag_counts(spark, sf_dir):
    return corpus.tag_counts(V.notes(spark, sf_dir))


@query(f"""WITH {V.NOTES_SQL}, p AS (SELECT string_split(path, '/') AS s, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS extension FROM notes)
SELECT array_to_string(list_slice(s, 1, i), '/') AS folder, extension, count(*) AS files FROM (SELECT s, extension, unnest(range(0, len(s))) AS i FROM p) GROUP BY 1, 2""")
def folder_tree_counts(spark, sf_dir):
    return corpus.folder_counts(V.notes(spark, sf_dir).select("path"))


@query(r"""WITH q AS (SELECT item_id AS ord, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS w FROM benchmark),
m AS (SELECT a.ord, b.ord AS first, len(list_intersect(a.w, b.w)) AS c, len(a.w) AS n, len(b.w) AS m FROM q a JOIN q b ON b.ord < a.ord),
s AS (SELECT *, greatest(c / (n + m - c), c / least(n, m)) AS overlap FROM m WHERE c > 0)
SELECT ord, first, round(overlap, 6) AS overlap FROM s WHERE overlap >= 0.1 QUALIFY row_number() OVER (PARTITION BY ord ORDER BY first) = 1""")
def word_overlap_dups(spark, sf_dir):
    b = V.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ord"), "text")
    return corpus.duplicate_queries(b, 0.1).withColumn("overlap", F.round("overlap", 6))


@query(r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9_\s-]', ' ', 'g'), '\s+'), lambda w: length(w) >= 2) AS w, text FROM documents),
x AS (SELECT doc_id, list_distinct(flatten(list_transform(w, lambda v: CASE WHEN contains(v, '-') THEN list_concat([v], list_filter(string_split(v, '-'), lambda p: length(p) >= 2)) ELSE [v] END))) AS t, text FROM d)
SELECT doc_id, len(t) AS n_terms, md5(array_to_string(list_sort(t), ' ')) AS terms, len(regexp_extract_all(text, '[\p{L}\p{N}]+(?:[''’-][\p{L}\p{N}]+)*')) AS words FROM x""")
def term_extract(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    t = text.salient_terms(F.col("text"))
    return d.select("doc_id", F.size(t).cast("long").alias("n_terms"), F.md5(F.array_join(F.array_sort(t), " ")).alias("terms"), text.word_count(F.col("text")).cast("long").alias("words"))


def _redact_sql(column: str) -> str:
    for p in text.SENSITIVE_PATTERNS:
        q = p.replace("'", "''")
        column = f"regexp_replace({column}, '{q}', '[REDACTED]', 'g')"
    return column


@query(f"SELECT doc_id, md5({_redact_sql('text')}) AS filtered, {_redact_sql('text')} <> text AS had_sensitive FROM documents")
def redact_sensitive(spark, sf_dir):
    clean = text.redact(F.col("text"))
    return V.table(spark, sf_dir, "documents").select("doc_id", F.md5(clean).alias("filtered"), (clean != F.col("text")).alias("had_sensitive"))


@query(r"SELECT conv_id, turn, regexp_replace(text || '<|im_end|>' || role || '</s>', '" + text.SPECIAL_TOKENS_PATTERN + r"', '', 'g') AS text, CAST(ceil(len(regexp_extract_all(text, '\S+')) * 1.35) AS BIGINT) AS tokens FROM conversations")
def strip_tokens(spark, sf_dir):
    c = V.table(spark, sf_dir, "conversations")
    marked = F.concat("text", F.lit("<|im_end|>"), "role", F.lit("</s>"))
    return c.select("conv_id", "turn", text.strip_special_tokens(marked).alias("text"), text.token_estimate(text.spaced_words(F.col("text"))).alias("tokens"))


@query("""WITH p AS (SELECT p_partkey, lower(p_name) AS a, lower(p_type) AS b, lower(p_brand) AS c FROM part)
SELECT p_partkey, levenshtein(a, b) AS distance, round(CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0 ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b)) END, 9) AS similarity, regexp_replace(a, '(es|s)$', '') = regexp_replace(c, '(es|s)$', '') AS same FROM p""")
def levenshtein_match(spark, sf_dir):
    p = V.table(spark, sf_dir, "part")
    return p.select("p_partkey", F.levenshtein(F.lower("p_name"), F.lower("p_type")).cast("long").alias("distance"), F.round(text.similarity(F.col("p_name"), F.col("p_type")), 9).alias("similarity"), (text.without_plural(F.col("p_name")) == text.without_plural(F.col("p_brand"))).alias("same"))


@query(r"""WITH u AS (SELECT page_id, trim(url) AS t FROM pages),
p AS (SELECT page_id, lower(regexp_extract(t, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS s, lower(regexp_extract(t, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS h,
  regexp_extract(t, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS pa, regexp_extract(t, '^[^?#]*\?([^#]*)', 1) AS q FROM u)
SELECT page_id, s || '://' || (CASE s WHEN 'http' THEN regexp_replace(h, ':80$', '') WHEN 'https' THEN regexp_replace(h, ':443$', '') ELSE h END)
  || (CASE WHEN pa IN ('', '/') THEN '/' ELSE regexp_replace(pa, '/+$', '') END)
  || (CASE WHEN len(list_filter(string_split(q, '&'), lambda x: x <> '')) > 0 THEN '?' || array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '')), '&') ELSE '' END) AS url,
  regexp_replace(regexp_replace(h, '^.*@', ''), ':.*$', '') AS domain FROM p""")
def url_normalize(spark, sf_dir):
    return V.table(spark, sf_dir, "pages").select("page_id", urls.matching_url(F.col("url")).alias("url"), urls.domain(F.col("url")).alias("domain"))


@query()
def html_extract(spark, sf_dir):
    return extract_pages(V.table(spark, sf_dir, "pages"))


@query(rf"""WITH {V.NOTES_SQL}, l AS (SELECT path, unnest(string_split(body, chr(10))) AS line, unnest(range(0, len(string_split(body, chr(10))))) AS pos, len(string_split(body, chr(10))) AS n FROM notes)
SELECT path, CAST(pos // 20 AS INTEGER) AS w, count(*) AS lines, md5(string_agg(line, chr(10) ORDER BY pos)) AS content, CASE WHEN pos // 20 + 1 < ceil(any_value(n) / 20) THEN CAST(pos // 20 + 1 AS INTEGER) END AS next FROM l GROUP BY path, pos // 20""")
def line_window(spark, sf_dir):
    return line_windows(V.notes(spark, sf_dir), 20).select("path", F.col("window").alias("w"), F.col("lines").cast("long").alias("lines"), F.md5("content").alias("content"), "next")


@query()
def chunk_sections(spark, sf_dir):
    return section_chunks(V.notes(spark, sf_dir), most_words=200)


@query("""SELECT o_orderkey, CAST(CASE o_orderkey % 3 WHEN 0 THEN o_orderdate WHEN 1 THEN o_orderdate END AS DATE) AS day FROM orders""")
def title_date(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 3
    stamp = F.when(k == 0, F.date_format("o_orderdate", "yyyyMMdd")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM.dd"))
    return o.select("o_orderkey", dates.title_date(F.concat(F.lit("notes/call "), stamp, F.lit(" about x.md"))).alias("day"))


@query("""SELECT event_id, round(greatest(0.3, least(1.0, 1 - date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') / 30)), 9) AS recency FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00' OR (event_type = 'signup' AND ts >= TIMESTAMP '2024-01-25 00:00:00')""")
def time_filter(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    ts = F.col("ts")
    inside = ts.between(F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-20").cast("timestamp")) | ((F.col("event_type") == "signup") & (ts >= F.lit("2024-01-25").cast("timestamp")))
    return e.where(inside).select("event_id", F.round(dates.recency(F.to_date("ts"), F.lit("2024-01-31").cast("date")), 9).alias("recency"))


@query("""WITH u AS (SELECT user_id, CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS b FROM events GROUP BY user_id)
SELECT user_id, '[[' || strftime(d, '%Y-%m-%d') || ']]' AS note FROM (SELECT user_id, unnest(generate_series(greatest(a, CAST(b - INTERVAL 9 DAY AS DATE)), b, INTERVAL 1 DAY)) AS d FROM u)""")
def daily_sequence(spark, sf_dir):
    u = V.table(spark, sf_dir, "events").groupBy("user_id").agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b"))
    return u.select("user_id", F.explode(dates.daily_notes(F.col("a"), F.col("b"), 10)).alias("note"))


@query("""SELECT o_orderkey, date_trunc('week', o_orderdate) AS week_start, date_trunc('month', o_orderdate) - INTERVAL 1 MONTH AS month_start, date_trunc('month', o_orderdate) - INTERVAL 1 MILLISECOND AS month_end,
date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH AS quarter_start, CAST(last_day(make_date(year(o_orderdate), quarter(o_orderdate) * 3, 1)) AS DATE) AS quarter_end, date_trunc('year', o_orderdate) - INTERVAL 1 YEAR AS year_start FROM orders""")
def named_ranges(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders")
    d = F.col("o_orderdate").cast("timestamp_ntz")
    last_month = dates.named_range("last month", d)
    quarter = dates.quarter_range(F.year(d), F.quarter(d))
    plain = lambda c: c.cast("timestamp_ntz")
    return o.select("o_orderkey", plain(dates.named_range("this week", d)[0]).alias("week_start"), plain(last_month[0]).alias("month_start"), plain(last_month[1]).alias("month_end"), plain(dates.named_range("next quarter", d)[0]).alias("quarter_start"), quarter[1].alias("quarter_end"), plain(dates.named_range("last year", d)[0]).alias("year_start"))


@query("""SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rank FROM events WHERE ts + INTERVAL 480 HOUR > TIMESTAMP '2024-01-31 00:00:00' QUALIFY rank <= 5""")
def recent_n(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    return corpus.evict(e, ["user_id"], "ts", F.lit("2024-01-31").cast("timestamp"), F.expr("INTERVAL 480 HOURS"), 5, "event_id").select("event_id", "user_id", "rank")


@query("""WITH m AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'signup' QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) = 1),
c AS (SELECT user_id, ts, event_id, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS until FROM m)
SELECT e.event_id, c.event_id AS chapter FROM events e LEFT JOIN c ON c.user_id = e.user_id AND c.ts <= e.ts AND (c.until IS NULL OR e.ts < c.until) WHERE e.event_type <> 'signup'""")
def chapter_asof(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").withColumn("at", F.col("ts"))
    marks = e.where("event_type = 'signup'").groupBy("user_id", "at").agg(F.min("event_id").alias("label"))
    return corpus.as_of(e.where("event_type <> 'signup'").select("user_id", "at", "event_id"), marks, ["user_id"]).select("event_id", F.col("label").alias("chapter"))


@query(r"""WITH RECURSIVE s AS (SELECT conv_id, turn * 3.0 AS t0, turn AS ord, trim(regexp_replace(text, '[.?!](\s*)$', '\1')) AS t FROM conversations WHERE trim(text) <> ''),
c AS (SELECT *, coalesce(t0 - lag(t0) OVER w >= 4, false) OR coalesce(regexp_matches(lag(t) OVER w, '[.?!]$'), false) AS cut, len(regexp_extract_all(t, '\S+')) AS words, row_number() OVER w AS n FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY t0, ord)),
f AS (SELECT conv_id, n, 0 AS paragraph, words FROM c WHERE n = 1 UNION ALL
  SELECT c.conv_id, c.n, f.paragraph + CASE WHEN c.cut OR f.words >= 80 THEN 1 ELSE 0 END, CASE WHEN c.cut OR f.words >= 80 THEN c.words ELSE f.words + c.words END FROM f JOIN c ON c.conv_id = f.conv_id AND c.n = f.n + 1)
SELECT conv_id, CAST(paragraph AS BIGINT) AS paragraph, CAST(min(t0) AS DOUBLE) AS start, count(*) AS n, md5(trim(regexp_replace(string_agg(t, ' ' ORDER BY n), '\s+', ' ', 'g'))) AS text FROM f JOIN c USING (conv_id, n) GROUP BY conv_id, paragraph""")
def paragraph_sessions(spark, sf_dir):
    c = V.table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") * 3.0).alias("at"), F.col("turn").alias("ord"), F.regexp_replace("text", r"[.?!](?=\s*$)", "").alias("text"))
    return corpus.paragraphs(c, ["conv_id"]).withColumn("text", F.md5("text")).select("conv_id", "paragraph", "start", "n", "text")


@query("""WITH r AS (SELECT p_partkey AS g, p_retailprice AS x0, p_size AS y0, p_retailprice + 3 AS x1, p_size + 3 AS y1 FROM part), n AS (SELECT p_partkey AS node, p_retailprice AS x, p_size AS y FROM part)
SELECT g AS "group", node FROM r, n WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND g <> node""")
def canvas_containment(spark, sf_dir):
    p = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y"))
    r = p.select(F.col("node").alias("group"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 3).alias("x1"), (F.col("y") + 3).alias("y1"))
    return corpus.contained(r, p)


@query(f"""WITH {V.NOTES_SQL}, r AS (SELECT ord % 10 AS query, ord, body, row_number() OVER (PARTITION BY ord % 10 ORDER BY mtime DESC, ord) AS rank FROM notes),
t AS (SELECT *, sum(length(body)) FILTER (rank <= 15) OVER (PARTITION BY query) AS total FROM r)
SELECT query, ord, CASE WHEN rank <= 15 THEN 1 ELSE 2 END AS tier, CASE WHEN rank <= 15 THEN md5(substr(body, 1, CAST(floor(length(body) * least(1.0::DOUBLE, 20000::DOUBLE / total)) AS INTEGER))) END AS content FROM t""")
def context_tiers(spark, sf_dir):
    n = V.notes(spark, sf_dir).withColumn("query", F.col("ord") % 10)
    return corpus.context_tiers(n, ["query"], "mtime", "ord", 15, 20_000).select("query", "ord", "tier", F.md5("content").alias("content"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_events_window(spark, sf_dir):
    return feed.windowed(V.table(spark, sf_dir, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
x AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", count(*) AS n FROM x GROUP BY user_id, k""")
def event_sessions(spark, sf_dir):
    s = feed.sessions(V.table(spark, sf_dir, "events"), "12 hours")
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query(r"""WITH m AS (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'ai' ELSE 'user' END AS sender, coalesce(text, '') AS t FROM conversations),
l AS (SELECT conv_id, turn, '**' || sender || '**: ' || CASE sender WHEN 'ai' THEN regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') ELSE t END || chr(10) || '[Timestamp: turn ' || turn || ']' AS line FROM m)
SELECT conv_id, CAST(floor(turn / 500) AS BIGINT) AS part, count(*) AS messages, md5(string_agg(line, chr(10) || chr(10) ORDER BY turn, line)) AS content FROM l GROUP BY 1, 2""")
def chat_transcript(spark, sf_dir):
    return chats.transcripts(_messages(spark, sf_dir)).select(F.col("chat").alias("conv_id"), "part", "messages", F.md5("content").alias("content"))


@query(r"""WITH m AS (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'ai' ELSE 'user' END AS sender, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM conversations)
SELECT conv_id, sender, 'turn ' || turn AS "at", md5(CASE sender WHEN 'ai' THEN regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g') ELSE t END) AS message FROM m""")
def chat_parse(spark, sf_dir):
    back = chats.parse_transcripts(chats.transcripts(_messages(spark, sf_dir)))
    return back.select(F.col("chat").alias("conv_id"), "sender", "at", F.md5("message").alias("message"))


def _messages(spark, sf_dir):
    sender = F.when(F.col("role") == "assistant", "ai").otherwise("user")
    return V.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chat"), F.col("turn").alias("ord"), sender.alias("sender"), F.col("text").alias("message"), F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("at"), F.lit(None).cast("string").alias("context"))
