"""Pages, chunks, memories, canvases, addresses, text functions and streams as queries, with DuckDB SQL where SQL can express them. Part of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import dates, text, urls
from corpusloom.operators import corpus
from corpusloom.plans import views as V
from corpusloom.plans.catalogue import query
from corpusloom.sources import canvas, memories
from corpusloom.sources.chunks import lexical_chunks
from corpusloom.streaming import events
from corpusloom.tables import new_folder


@query()
def note_chunks(spark, sf_dir):
    """Lexical chunks of every note, 2,000 characters at most, the last tenth of the notes with headings."""
    n = V.notes(spark, sf_dir)
    body = F.when(F.col("ord") % 10 == 0, F.regexp_replace("body", r"\n", "\n## Part\n")).otherwise(F.col("body"))
    return lexical_chunks(n.select("path", body.alias("body")), 2000).select("id", "chunk", "title", "heading", F.length("content").alias("characters"), "content_hash")


@query("""SELECT page_id, page_id % 3 = 0 AS post, CASE page_id % 3 WHEN 1 THEN 'abcdefgh' || lpad(CAST(page_id % 1000 AS VARCHAR), 3, '0') END AS video, CASE page_id % 3 WHEN 1 THEN CAST(page_id % 60 * 60 + 5 AS INTEGER) WHEN 2 THEN CAST(page_id AS INTEGER) END AS seconds FROM pages""")
def media_links(spark, sf_dir):
    p = V.table(spark, sf_dir, "pages")
    i = F.col("page_id")
    video = F.concat(F.lit("https://www.youtube.com/watch?v=abcdefgh"), F.lpad((i % 1000).cast("string"), 3, "0"), F.lit("&t="), (i % 60).cast("string"), F.lit("m5s"))
    url = F.when(i % 3 == 0, F.concat(F.lit("https://mobile.twitter.com/a/status/"), (i + 1).cast("string"))).when(i % 3 == 1, video).otherwise(F.concat(F.lit("https://youtu.be/?start="), i.cast("string")))
    return p.select("page_id", urls.is_social_post(url).alias("post"), urls.video_id(url).alias("video"), urls.start_seconds(url).alias("seconds"))


@query("""WITH c AS (SELECT c_custkey, c_nationkey FROM customer) SELECT 'n' || c_nationkey AS canvas, 'g' AS src, 'c' || c_custkey AS dst, 'holds' AS kind FROM c WHERE c_custkey % 50 < 20
UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'g', 'edge' FROM c WHERE c_custkey % 2 = 0 UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, md5('text ' || c_custkey), 'text' FROM c""")
def canvas_graph(spark, sf_dir):
    c = V.table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("canvas"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_custkey").alias("k"))
    node = F.to_json(F.struct("id", F.lit("file").alias("type"), F.concat("id", F.lit(".md")).alias("file"), ((F.col("k") % 50) * 10).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(2.0).alias("width"), F.lit(2.0).alias("height")))
    edge = F.when(F.col("k") % 2 == 0, F.to_json(F.struct(F.col("id").alias("fromNode"), F.lit("g").alias("toNode"))))
    group = F.lit('{"id": "g", "type": "group", "x": 0, "y": 0, "width": 198, "height": 10}')
    whole = F.concat(F.lit('{"nodes": ['), group, F.lit(", "), F.array_join(F.collect_list(node), ", "), F.lit('], "edges": ['), F.array_join(F.collect_list(edge), ", "), F.lit("]}"))
    canvases = c.groupBy("canvas").agg(whole.alias("json"))
    placed = canvas.nodes(canvases, c.select(F.concat("id", F.lit(".md")).alias("path"), F.concat(F.lit("text "), F.col("k").cast("string")).alias("body")))
    held = canvas.group_edges(placed).select("canvas", "src", "dst", F.lit("holds").alias("kind"))
    drawn = canvas.edges(canvases).select("canvas", "src", "dst", F.lit("edge").alias("kind"))
    return held.unionByName(drawn).unionByName(placed.where("type = 'file'").select("canvas", F.col("id").alias("src"), F.md5("text").alias("dst"), F.lit("text").alias("kind")))


@query("""WITH m AS (SELECT c_custkey AS id, 'about ' || c_name AS content, lower(c_mktsegment) AS category, c_custkey * 86400000 AS made FROM customer WHERE c_custkey % 10 <> 3)
SELECT category || ' ' || strftime(epoch_ms(made), '%Y-%m') AS name, md5('## ' || any_value(category) || chr(10) || chr(10) || string_agg('- [' || strftime(epoch_ms(made), '%Y-%m-%d') || '] ' || content, chr(10) ORDER BY made, CAST(id AS VARCHAR))) AS content, count(*) AS n FROM m WHERE id % 7 <> 0 GROUP BY category, strftime(epoch_ms(made), '%Y-%m')
UNION ALL SELECT 'vectors', 'model ' || max(c_nationkey), count(*) FROM customer UNION ALL SELECT 'index', CAST(sum(id) AS VARCHAR), count(*) FROM m""")
def memory_files(spark, sf_dir):
    """Memories and vectors written as JSON lines in two steps, read back without deleted and broken lines, exported, and saved as an index by partitions."""
    c = V.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    m = c.select(k.cast("string").alias("id"), F.concat(F.lit("about "), "c_name").alias("content"), F.lower("c_mktsegment").alias("category"), (k * 86400000).alias("createdAt"), (k % 7 == 0).alias("sensitive"), (k % 10 == 3).alias("deleted"))
    path = new_folder(spark, "memories")
    memories.write_memories(m.where(k % 2 == 0), path)
    memories.write_memories(m.where(k % 2 == 1), path, append=True)
    spark.range(1).select(F.lit("not json").alias("value")).write.mode("append").text(path)
    back = memories.read_memories(spark, path)
    out = memories.export_markdown(back).select(F.concat_ws(" ", "category", "month").alias("name"), F.md5("markdown").alias("content"), F.size(F.split("markdown", "\n- ")).cast("long").alias("n")).withColumn("n", F.col("n") - 1)
    vectors = c.select(F.lit("vector").alias("_type"), k.cast("string").alias("memoryId"), F.array(F.lit(1.0)).alias("vector"), k.alias("createdAt"))
    header = c.agg(F.max("c_nationkey").alias("x")).select(F.lit("header").alias("_type"), F.concat(F.lit("model "), F.col("x").cast("string")).alias("model"), F.lit(1).alias("dimension"))
    place = new_folder(spark, "vectors")
    memories.write_memories(header, place)
    memories.write_memories(vectors, place, append=True)
    memories.write_memories(vectors.where("createdAt % 5 = 0").withColumn("createdAt", F.col("createdAt") + 1), place, append=True)
    head, held = memories.read_vectors(spark, place)
    counted = head.select(F.lit("vectors").alias("name"), F.col("model").alias("content")).crossJoin(held.agg(F.count("*").alias("n")))  # one row each
    index = new_folder(spark, "index")
    memories.save_index(back.select("id", "content"), index, 4)
    saved = memories.load_index(spark, index).agg(F.lit("index").alias("name"), F.sum(F.col("id").cast("long")).cast("string").alias("content"), F.count("*").alias("n"))
    return out.unionByName(counted).unionByName(saved)


@query(r"""WITH c AS (SELECT conv_id, turn, role, text AS t, string_split(text, chr(10)) AS l FROM conversations)
SELECT conv_id, turn, md5(array_to_string(list_filter(l, lambda x: true), chr(10))) AS no_roles, 'w' AS tags, md5(replace(replace(replace(replace(replace(t, '&', '&amp;'), '"', '&quot;'), '''', '&apos;'), '<', '&lt;'), '>', '&gt;')) AS escaped,
md5(CASE WHEN octet_length(encode(t)) > 200 THEN left(t, 150) || chr(10) || chr(10) || '[... truncated ...]' || chr(10) || chr(10) || right(t, 30) ELSE t END) AS ends, md5(CASE WHEN length(t) > 100 THEN left(t, 100) || chr(10) || '... [' || (length(t) - 100) || ' more characters]' ELSE t END) AS cut,
len(regexp_extract_all(trim(t), '[.!?]\s+')) + 1 AS sentences, md5(t) AS uncited, CASE WHEN turn * 700 >= 3600 THEN lpad(CAST(turn * 700 // 3600 AS VARCHAR), 2, '0') || ':' ELSE '' END || lpad(CAST(turn * 700 % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(turn * 700 % 60 AS VARCHAR), 2, '0') AS clock FROM c""")
def text_functions(spark, sf_dir):
    c = V.table(spark, sf_dir, "conversations")
    t, nl = F.col("text"), F.lit("\n")
    roles = text.strip_role_lines(F.concat(F.lit("User\n"), F.replace(t, nl, F.lit("\nassistant\n")), F.lit("\n SYSTEM ")))
    tags = F.array_join(F.array_except(text.tag_terms(F.lit("see #w/x")), F.array(*map(F.lit, ("#w/x", "w/x", "#w", "x")))), ",")
    cited = F.concat(F.regexp_replace(t, r"$", "[^1][2, 3]"), F.lit("\n[^1]: source"))
    uncited = F.regexp_replace(text.citations_removed(cited), r"\n$", "")
    return c.select("conv_id", "turn", F.md5(roles).alias("no_roles"), tags.alias("tags"), F.md5(text.xml_escape(t)).alias("escaped"), F.md5(text.head_and_tail(t, 200)).alias("ends"), F.md5(text.truncated(t, 100)).alias("cut"), F.size(text.sentences(F.trim(t))).cast("long").alias("sentences"), F.md5(uncited).alias("uncited"), dates.clock(F.col("turn") * 700).alias("clock"))


@query("""WITH d AS (SELECT doc_id, len(regexp_extract_all(text, '\\n')) + 1 AS n FROM documents) SELECT doc_id, CASE WHEN n > 3 THEN 3 ELSE n END AS shown, CASE WHEN n > 3 THEN '[' || (n - 3) || ' sections omitted]' ELSE '' END AS more, CAST(doc_id * 1000 AS BIGINT) AS millis FROM d""")
def section_previews(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    short = text.sections_compacted(F.concat(F.lit("# a\n"), F.replace("text", F.lit("\n"), F.lit("\n## b\n"))), preview=40, sections=3, verbatim=0)
    parts = F.split(F.regexp_replace(short, r"\n\n\[\d+ sections omitted\]$", ""), r"\n\n(?=#)")
    return d.select("doc_id", F.size(parts).cast("long").alias("shown"), F.regexp_extract(short, r"(\[\d+ sections omitted\])$", 1).alias("more"), F.unix_millis(dates.epoch(F.col("doc_id") * 1000)).alias("millis"))


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS version FROM documents WHERE doc_id % 5 <> 1 OR doc_id % 3 = 0""")
def index_upsert(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    new = d.where("id % 3 = 0").withColumn("version", F.lit("new"))
    return corpus.upsert(d.withColumn("version", F.lit("old")), new, "id", d.where("id % 5 = 1"))


@query("""SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def stream_windows(spark, sf_dir):
    """Daily counts through a stream whose files come in any order; a last event far later moves the watermark beyond all days."""
    e = V.table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    later = e.agg((F.max("ts") + F.expr("INTERVAL 62 DAYS")).alias("ts")).select("ts", F.lit("end").alias("event_type"), F.lit(0.0).alias("value"))
    place = new_folder(spark, "events")
    e.repartition(4).write.parquet(place)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(place)
    seen = _run_then(stream, place, later, "windows")
    return seen.where("event_type <> 'end'").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def _run_then(stream: DataFrame, place: str, later: DataFrame, name: str) -> DataFrame:
    """The stream's windows after its files, and after another one that moves the watermark beyond them."""
    spark = stream.sparkSession
    windows = events.windowed(stream, late="60 days")
    out, kept = new_folder(spark, name), new_folder(spark, "progress")
    for step in (None, later):
        if step is not None:
            step.write.mode("append").parquet(place)
        windows.writeStream.format("parquet").option("path", out).option("checkpointLocation", kept).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(windows.schema).parquet(out)
