"""Fuzzy ranking of paths and guarded rewriting of blocks as queries. Part of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import compaction, fuzzy
from corpusloom.plans import views as V
from corpusloom.plans.catalogue import query


@query(rf"""WITH RECURSIVE {V.NOTES_SQL}, q AS (SELECT ord AS query, lower(left(path, 1) || regexp_replace(path, '[^0-9]', '', 'g')) AS q FROM notes WHERE ord % 20 = 0),
a AS (SELECT query, q, ord AS id, lower(path) AS t, 0 AS i, 0 AS pos, 0 AS score FROM q, notes
  UNION ALL SELECT query, q, id, t, i + 1, pos + p, score + 10 + CASE WHEN i > 0 AND p = 1 THEN 15 ELSE 0 END
    + CASE WHEN pos + p = 1 OR regexp_matches(substr(t, CAST(pos + p - 1 AS BIGINT), 1), '[\s/_.-]') THEN 10 ELSE 0 END - CASE WHEN i = 0 THEN least(p - 1, 20) ELSE 0 END
  FROM (SELECT *, strpos(substr(t, CAST(pos + 1 AS BIGINT)), substr(q, i + 1, 1)) AS p FROM a WHERE i < length(q)) WHERE p > 0),
s AS (SELECT query, id, CAST(score - (length(t) - length(q)) AS INTEGER) AS score FROM a WHERE i = length(q))
SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10""")
def fuzzy_paths(spark, sf_dir):
    """The ten best paths for the first letter and the digits of every twentieth note's own path."""
    n = V.notes(spark, sf_dir)
    asked = n.where("ord % 20 = 0").select(F.col("ord").alias("query"), F.concat(F.left("path", F.lit(1)), F.regexp_replace("path", "[^0-9]", "")).alias("text"))
    return fuzzy.fuzzy_top(asked, n.select(F.col("ord").alias("id"), F.col("path").alias("text")), 10)


@query(r"""
WITH d AS (SELECT doc_id AS id, text AS c, length(text) >= 800 AS big, NOT regexp_matches('a/' || doc_id || '.md', '[05]\.md$') AS ok1, NOT regexp_matches('http://x/' || doc_id, '[0369]$') AS ok2,
    '<note_context><title>T' || doc_id || '</title><path>a/' || doc_id || '.md</path><content>' || text || '</content></note_context>' AS b1,
    '<url_content><url>http://x/' || doc_id || '</url><content>' || replace(text, 'e', 'E') || '</content></url_content>' AS b2 FROM documents WHERE text IS NOT NULL),
r AS (SELECT *, CASE WHEN big AND ok1 THEN E'<note_context>\n<title>T' || id || E'</title>\n<path>a/' || id || E'.md</path>\n<content>[SUMMARIZED]\n' || trim(left(c, 100)) || E'</content>\n</note_context>' ELSE b1 END AS n1,
    CASE WHEN big AND ok2 THEN E'<url_content>\n<title>' || id || E'</title>\n<url>http://x/' || id || E'</url>\n<content>[SUMMARIZED]\n' || trim(left(replace(c, 'e', 'E'), 100)) || E'</content>\n</url_content>' ELSE b2 END AS n2,
    CASE WHEN big THEN CAST(ok1 AS BIGINT) + CAST(ok2 AS BIGINT) ELSE 0 END AS rewritten FROM d)
SELECT id, md5('intro ' || n1 || ' between ' || n2 || ' end') AS compacted, rewritten > 0 AS was_compacted, CASE WHEN rewritten > 0 THEN 2 ELSE 0 END AS items, rewritten FROM r""")
def blocks_compacted(spark, sf_dir):
    """Whole texts as two context blocks each, of which the large ones are cut to 100 characters where that succeeds."""
    d = V.table(spark, sf_dir, "documents").where("text is not null")
    whole = F.expr("""concat('intro <note_context><title>T', doc_id, '</title><path>a/', doc_id, '.md</path><content>', text, '</content></note_context> between <url_content><url>http://x/', doc_id,
        '</url><content>', replace(text, 'e', 'E'), '</content></url_content> end')""")
    cut = lambda content, title, path: F.when(~path.rlike(r"[05]\.md$|x/\d*[0369]$"), F.left(content, F.lit(100)))
    done = compaction.compact(d.select(F.col("doc_id").alias("id"), whole.alias("text")), cut, least=800)
    return done.select("id", F.md5("compacted").alias("compacted"), "was_compacted", "items", "rewritten")
