"""Links and names of notes: mentions in text, lookup of names and paths, directions and counts of links, tasks, tabs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import paths, urls


def mentions(notes: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct (key, target, section, display) of the [[target#section|display]] in a text; embeds (![[..]]) don't count.

    Absent parts are empty, a null text mentions nothing.
    """
    plain = F.regexp_replace(text, r"!\[\[[^\]]*\]\]", "")
    found = notes.select(key, F.explode(F.regexp_extract_all(plain, F.lit(r"\[\[[^\]]+\]\]"), F.lit(0))).alias("_raw"))
    part = lambda pattern, name: F.regexp_extract("_raw", pattern, 1).alias(name)
    return found.select(key, part(r"^\[\[([^\]|#]*)", "target"), part(r"^\[\[[^\]|#]*#([^\]|]*)", "section"), part(r"\|([^\]]*)", "display")).distinct()


def _stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.(md|canvas)$", "")


def resolve_links(found: DataFrame, notes: DataFrame) -> DataFrame:
    """Adds path and status (resolved, ambiguous or unresolved) to rows with a ``target``: a path, one without extension, or a name.

    Names are aggregated to one row each before the join, so a name that many notes share meets a link once.
    """
    path = F.col("path")
    every = F.array(path, _stem(path), F.element_at(F.split(_stem(path), "/"), -1))
    names = notes.select("path", F.explode(F.array_distinct(every)).alias("target")).groupBy("target").agg(F.min("path").alias("_a"), F.max("path").alias("_z"))
    one = F.col("_a") == F.col("_z")
    status = F.when(one, "resolved").when(F.col("_a").isNull(), "unresolved").otherwise("ambiguous")
    return found.join(names, "target", "left").select(*found.columns, F.when(one, F.col("_a")).alias("path"), status.alias("status"))


def resolve_paths(requests: DataFrame, notes: DataFrame) -> DataFrame:
    """(request, tier, matches, path) of distinct requested paths, by the first tier with a match.

    Tiers: the path itself (1), with .md or .canvas added (2), either in any case (3), a name (4), the end of a path at
    a folder's border (5). ``path`` is set for a single match; ``matches`` is 0 and tier null where nothing fits. Keys of
    notes are aggregated before the join.
    """
    low = F.lower("path")
    parts = F.split(low, "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    tails = F.array_distinct(F.concat(tails, F.transform(tails, _stem)))
    tiers = [F.array("path"), F.array(_stem(F.col("path"))), F.array(low, _stem(low)), F.array(F.element_at(F.split(_stem(low), "/"), -1)), tails]
    tagged = lambda tier, keys: F.transform(keys, lambda k: F.struct(F.lit(tier).alias("tier"), k.alias("key")))
    keyed = F.flatten(F.array(*(tagged(tier, keys) for tier, keys in enumerate(tiers, 1))))
    table = notes.select("path", F.explode(keyed).alias("k")).groupBy("k.tier", "k.key").agg(F.count_distinct("path").alias("matches"), F.min("path").alias("path"))
    asked = requests.select("request").distinct()
    wanted = F.array(*(F.struct(F.lit(t).alias("tier"), (F.col("request") if t < 3 else F.lower("request")).alias("key")) for t in range(1, 6)))
    hits = asked.select("request", F.inline(wanted)).join(table, ["tier", "key"])
    best = hits.groupBy("request").agg(F.min(F.struct("tier", "matches", "path")).alias("b")).select("request", "b.*")
    found = asked.join(best, "request", "left")
    return found.select("request", "tier", F.coalesce("matches", F.lit(0)).alias("matches"), F.when(F.col("matches") == 1, F.col("path")).alias("path"))


def directions(edges: DataFrame) -> DataFrame:
    """(note, other, links, backlinks) of linked pairs, seen from both sides; links to itself don't count."""
    side = lambda a, b, out: edges.select(F.col(a).alias("note"), F.col(b).alias("other"), F.lit(out).alias("out"))
    both = side("src", "dst", True).unionByName(side("dst", "src", False)).where("note <> other")
    return both.groupBy("note", "other").agg(F.bool_or("out").alias("links"), F.bool_or(~F.col("out")).alias("backlinks"))


def census(notes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, outgoing, incoming, orphan): distinct notes linked to and from; an orphan is linked from none."""
    counts = directions(edges).groupBy(F.col("note").alias(key)).agg(F.count_if("links").alias("outgoing"), F.count_if("backlinks").alias("incoming"))
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return notes.select(key).distinct().join(counts, key, "left").select(key, n("outgoing"), n("incoming"), (F.coalesce("incoming", F.lit(0)) == 0).alias("orphan"))


def tasks(notes: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, done, task) of the checkbox items of a text; lines count from 1."""
    lines = notes.select(key, F.posexplode(F.split(text, "\n")).alias("_pos", "_line"))
    item = r"^\s*[-*+] \[(.)\] +(.*)$"
    return lines.where(F.col("_line").rlike(item)).select(key, (F.col("_pos") + 1).alias("line"), (F.regexp_extract("_line", item, 1) != " ").alias("done"), F.regexp_extract("_line", item, 2).alias("task"))


def ordered_union(frames: list[DataFrame], key: str) -> DataFrame:
    """(key, origin): each key once, with the number from 1 of the first frame that holds it."""
    numbered = [f.select(key, F.lit(i).alias("origin")) for i, f in enumerate(frames, 1)]
    return reduce(DataFrame.unionByName, numbered).groupBy(key).agg(F.min("origin").alias("origin"))


def merge_tabs(tabs: DataFrame, fields: list[str], order: str) -> DataFrame:
    """One row a page by its matching URL: the latest value of each field that isn't null, and whether it is the tab active last."""
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in fields]
    merged = tabs.groupBy(urls.matching_url(F.col("url")).alias("url")).agg(*latest, F.max(F.when(F.col("active"), F.col(order))).alias("_at"))
    last = tabs.where("active").agg(F.max(order).alias("_last"))
    return merged.crossJoin(F.broadcast(last)).select("url", *fields, F.coalesce(F.col("_at") == F.col("_last"), F.lit(False)).alias("active"))  # one row


def read_windows(requests: DataFrame, notes: DataFrame, windows: DataFrame) -> DataFrame:
    """(request, window, status, path, content, next) of requested windows (request, window) of notes.

    Paths are resolved by ``resolve_paths``. Status: ok, invalid_path (blank, absolute or with a part ..), not_found, not_unique or out_of_range; all but ok
    have no content. windows: (path, window, content, next).
    """
    fine = paths.safe(F.col("request")) & (F.trim("request") != "")
    asked = requests.select("request", "window").distinct()
    found = resolve_paths(asked.where(fine), notes)
    met = asked.join(found, "request", "left").join(windows.select("path", "window", "content", "next"), ["path", "window"], "left")
    matches = F.coalesce("matches", F.lit(0))
    status = F.when(~F.coalesce(fine, F.lit(False)), "invalid_path").when(matches == 0, "not_found").when(matches > 1, "not_unique").when(F.col("content").isNull(), "out_of_range").otherwise("ok")
    return met.select("request", "window", status.alias("status"), "path", "content", "next")
