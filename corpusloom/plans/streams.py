"""Queries over real streams of the given tables: model output, bursts of changes, caches, index upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans import views as V
from corpusloom.plans.catalogue import query
from corpusloom.streaming import blocks, index, keyed
from corpusloom.tables import new_folder


def _replayed(spark: SparkSession, rows: DataFrame, tick: DataFrame, act, name: str, files: int = 6) -> DataFrame:
    """What ``act`` makes of ``rows`` as a stream of several files in no order, and of a later row that moves the watermark past them."""
    place, out, kept = (new_folder(spark, x) for x in (name, f"{name}_out", f"{name}_progress"))
    rows.repartition(files).write.parquet(place)
    stream = act(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(place))
    for later in (None, tick):
        if later is not None:
            later.select(rows.columns).write.mode("append").parquet(place)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", kept).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query(r"""
WITH c AS (SELECT conv_id * 1000 + turn AS stream_id, turn, (conv_id + turn) % 5 AS form, text FROM conversations WHERE role = 'assistant')
SELECT stream_id, md5(CASE form WHEN 1 THEN text || ' <w' WHEN 2 THEN text || '<writeFile>never ' || turn ELSE text END) AS spoken,
  md5(CASE WHEN form IN (0, 3, 4) THEN 'plan ' || turn ELSE '' END) AS thought, CASE form WHEN 0 THEN md5('file ' || turn) END AS written,
  form = 2 AS truncated, CAST(CASE WHEN form IN (0, 2, 4) THEN length(text) ELSE 0 END AS BIGINT) AS tokens
FROM c""")
def stream_blocks(spark, sf_dir):
    """Answers streamed in chunks of seven characters, in any order: whole thoughts and files, ends inside a mark, a block and a thought, a thought without its beginning."""
    c = V.table(spark, sf_dir, "conversations").where("role = 'assistant'").withColumn("form", (F.col("conv_id") + F.col("turn")) % 5).withColumn("turn", F.col("turn"))
    whole = F.expr("""CASE form WHEN 0 THEN '<think>plan ' || turn || '</think>' || text || '<writeFile>file ' || turn || '</writeFile>' WHEN 1 THEN text || ' <w'
        WHEN 2 THEN text || '<writeFile>never ' || turn WHEN 3 THEN text || '<think>plan ' || turn ELSE 'plan ' || turn || '</think>' || text END""")
    cut = F.regexp_extract_all(whole, F.lit(r"(?s).{1,7}"), F.lit(0))
    pieces = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("stream_id"), "form", F.length("text").cast("long").alias("tokens"), F.size(cut).alias("n"), F.posexplode(cut).alias("seq", "content"))
    finish = F.when((F.col("seq") == F.col("n") - 1) & F.col("form").isin(0, 2, 4), F.when(F.col("form") == 2, "length").otherwise("stop"))
    rows = pieces.select("stream_id", F.col("seq").cast("long").alias("seq"), "content", finish.alias("finish"), F.when(finish.isNotNull(), F.col("tokens")).alias("tokens"), F.timestamp_millis(F.col("seq") + F.lit(10**9)).alias("at"))
    tick = spark.range(1).select(F.lit(-1).cast("long").alias("stream_id"), F.lit(0).cast("long").alias("seq"), F.lit("").alias("content"), F.lit("stop").alias("finish"), F.lit(0).cast("long").alias("tokens"), F.timestamp_seconds(F.lit(10**8)).alias("at"))
    out = _replayed(spark, rows, tick, lambda s: blocks.fold_stream(s, late="1 day"), "blocks").where("stream_id >= 0")
    piece = F.struct("seq", "part", "kind", "text")
    held = out.groupBy("stream_id").agg(F.array_sort(F.collect_list(piece)).alias("p"), F.max("truncated").alias("truncated"), F.max("tokens").alias("tokens"))
    opened = F.get(F.transform(F.filter("p", lambda x: x["kind"] == "unopened"), lambda x: F.struct(x["seq"], x["part"])), F.lit(0))
    thought = lambda x: (x["kind"] == "thought") | ((x["kind"] == "text") & F.coalesce(F.struct(x["seq"], x["part"]) < opened, F.lit(False)))
    joined = lambda p: F.md5(F.array_join(F.transform(F.filter("p", p), lambda x: x["text"]), ""))
    written = F.filter("p", lambda x: x["kind"] == "file")
    return held.select("stream_id", joined(lambda x: (x["kind"] == "text") & ~thought(x)).alias("spoken"), joined(thought).alias("thought"), F.when(F.size(written) > 0, F.md5(F.get(written, F.lit(0))["text"])).alias("written"), "truncated", "tokens")


def _changes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Events as changes to their users' notes, and one far later."""
    e = V.table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), F.col("event_type").alias("payload"), F.col("ts").cast("timestamp").alias("at"))
    return rows, rows.agg((F.max("at") + F.expr("INTERVAL 62 DAYS")).alias("at")).select(F.lit("tick").alias("key"), F.lit(-1).cast("long").alias("id"), F.lit("tick").alias("payload"), "at")


_BURSTS = """
WITH g AS (SELECT user_id, event_id, event_type, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS begins FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM g),
r AS (SELECT *, count(*) OVER (PARTITION BY user_id, burst) AS n, row_number() OVER (PARTITION BY user_id, burst ORDER BY ts, event_id) AS nth FROM b)"""


@query(f"""{_BURSTS} SELECT CAST(user_id AS VARCHAR) AS key, 'last' AS edge, ts AS at, event_id AS id, event_type AS payload, n FROM r WHERE nth = n""")
def change_bursts(spark, sf_dir):
    """Changes less than six hours apart give one, the last; from a stream whose files come in any order."""
    rows, tick = _changes(spark, sf_dir)
    return _local(_replayed(spark, rows, tick, lambda s: keyed.debounced(s, 6 * 3_600_000, late="60 days"), "bursts"))


def _local(out: DataFrame) -> DataFrame:
    return out.where("key <> 'tick'").withColumn("at", F.col("at").cast("timestamp_ntz"))


@query(f"""{_BURSTS} SELECT CAST(user_id AS VARCHAR) AS key, CASE WHEN nth = 1 THEN 'first' ELSE 'last' END AS edge, ts AS at, event_id AS id, event_type AS payload, CASE WHEN nth = 1 THEN 1 ELSE n END AS n
FROM r WHERE nth = 1 OR nth = n""")
def burst_edges(spark, sf_dir):
    """The first change of a burst at once, and the last one after the quiet time where there is another."""
    rows, tick = _changes(spark, sf_dir)
    return _local(_replayed(spark, rows, tick, lambda s: keyed.debounced(s, 6 * 3_600_000, leading=True, late="60 days"), "edges"))


@query("""
WITH e AS (SELECT user_id, event_id, ts, props, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events),
p AS (SELECT *, lag(nth) OVER w AS before, lag(ts) OVER w AS used FROM e WINDOW w AS (PARTITION BY user_id, props ORDER BY nth)),
d AS (SELECT p.user_id, p.event_id, count(DISTINCT o.props) AS others FROM p JOIN e o ON o.user_id = p.user_id AND o.nth > p.before AND o.nth < p.nth GROUP BY ALL)
SELECT CAST(p.user_id AS VARCHAR) AS key, p.event_id AS id, p.props AS item, coalesce(ts - used <= INTERVAL 12 DAYS AND coalesce(others, 0) < 20, false) AS hit
FROM p LEFT JOIN d ON d.user_id = p.user_id AND d.event_id = p.event_id""")
def cache_replay(spark, sf_dir):
    """Each user's lookups of properties through a cache of 20 that live for twelve days after their last use."""
    e = V.table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), F.col("props").alias("payload"), F.col("ts").cast("timestamp").alias("at"))
    out = _replayed(spark, rows, _changes(spark, sf_dir)[1], lambda s: keyed.cached(s, 20, 12 * 86_400_000, late="60 days"), "cache")
    return out.where("key <> 'tick'").select("key", "id", "item", "hit")


@query("""WITH c AS (SELECT doc_id AS path, CASE WHEN doc_id % 4 = 0 THEN 'v2' ELSE 'v1' END AS version FROM documents WHERE doc_id % 9 <> 5) SELECT * FROM c""")
def stream_upkeep(spark, sf_dir):
    """An index kept by a stream of changes: all notes, then newer versions of a fourth, then a ninth deleted. Each step is several files, so batches have several tasks."""
    d = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"))
    change = lambda rows, version, deleted, at: rows.select("path", F.lit(version).alias("version"), F.lit(deleted).alias("deleted"), F.lit(at).alias("at"))
    steps = [change(d, "v1", False, 1), change(d.where("path % 4 = 0"), "v2", False, 2), change(d.where("path % 9 = 5"), "v3", True, 3)]
    place, kept_index, kept = (new_folder(spark, x) for x in ("changes", "index", "progress"))
    for rows in steps:
        rows.repartition(4).write.mode("append").parquet(place)
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(place)
        index.maintain(stream, kept_index, kept, parts=16).awaitTermination()
    return index.read_index(spark, kept_index)
