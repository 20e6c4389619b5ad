"""Putting together what an assistant reads: documents of several retrievers, layers and segments, citations, variables, sorted lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import paths as P
from corpusloom.functions import text as T
from corpusloom.operators.ranking import numbered


def above(hits: DataFrame, score: str, threshold: float) -> DataFrame:
    """Hits at or above the threshold; a score that isn't a number stays, a null one goes."""
    return hits.where((F.col(score) >= threshold) | F.isnan(score))


def inclusion(score: Column, least: float | None = None) -> Column:
    """Whether a hit goes into the context: above the least similarity, 0.1 if that is unset or 0."""
    return score > (least or 0.1)


def result_kinds(docs: DataFrame, key: list[str], source: str) -> DataFrame:
    """(key, filter_only, time_dominant): whether all documents come from filters, and whether some come from the time filter."""
    filtered = F.coalesce(F.col(source).isin("time-filtered", "tag-match"), F.lit(False))
    return docs.groupBy(*key).agg(F.every(filtered).alias("filter_only"), F.bool_or(F.coalesce(F.col(source) == "time-filtered", F.lit(False))).alias("time_dominant"))


def matching_projects(projects: DataFrame, query: str, case: bool = False, in_name: bool = True, in_description: bool = True) -> DataFrame:
    """Projects whose name or description holds the query; all for a blank one."""
    if not query.strip():
        return projects
    held = lambda c: F.coalesce(F.contains(F.col(c) if case else F.lower(c), F.lit(query if case else query.lower())), F.lit(False))
    return projects.where((held("name") if in_name else F.lit(False)) | (held("description") if in_description else F.lit(False)))


def project_chats(chats: DataFrame, project: str | None) -> DataFrame:
    """Chats whose name starts with the project's id and two underscores; without a project, those with no such prefix."""
    return chats.where(F.startswith("name", F.lit(f"{project}__")) if project else ~F.col("name").rlike(r"^[A-Za-z0-9-]+__"))


def remote_filter(rows: DataFrame, start: Column | None = None, end: Column | None = None, tags: list[str] | None = None) -> DataFrame:
    """Rows within the range of mtime, with any of the tags: plain predicates, which reach the scan where the format can take them."""
    for bound, keep in ((start, lambda b: F.col("mtime") >= b), (end, lambda b: F.col("mtime") <= b)):
        if bound is not None:
            rows = rows.where(keep(bound))
    return rows.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags)))) if tags else rows


def first_by(frames: list[DataFrame], keys: list[str], order: str) -> DataFrame:
    """Rows of all frames, one for each key: of the first frame that holds it, the first by ``order``. Null keys stay apart. Adds origin."""
    parts = [f.withColumn("origin", F.lit(i)) for i, f in enumerate(frames, 1)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    others = [c for c in every.columns if c not in keys]
    some = every.dropna(subset=keys)
    best = some.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct("origin", order)).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in others))
    null = every.where(" or ".join(f"{k} is null" for k in keys))
    return best.unionByName(null.select(*best.columns)).select(*every.columns)


def daily_and_filtered(daily: DataFrame, filtered: DataFrame, limit: int) -> DataFrame:
    """Daily notes and notes of a range, each path once, the best ``limit`` by score."""
    return first_by([daily, filtered], ["path"], "ord").orderBy(F.desc("score"), "ord").limit(limit)


def best_per_name(docs: DataFrame, score: str, tie: str) -> DataFrame:
    """The best document of each path (title where there is none) in lower case, the first on ties."""
    key = F.lower(F.coalesce("path", "title"))
    return docs.groupBy(key.alias("key")).agg(F.max_by(F.struct(*docs.columns), F.struct(F.col(score), -F.col(tie))).alias("_r")).select("key", "_r.*")


def with_metadata(chunks: DataFrame, notes: DataFrame) -> DataFrame:
    """Chunks with their note's tags and properties, empty where the note is gone."""
    none = F.array().cast("array<string>")
    return chunks.join(notes.select("path", "tags", "props"), "path", "left").withColumns({"tags": F.coalesce("tags", none), "props": F.coalesce("props", none)})


def new_in_turn(turn: DataFrame, earlier: DataFrame, key: str = "path") -> DataFrame:
    """Notes of a turn that no earlier turn of the chat holds."""
    return turn.join(earlier.select("chat", key).distinct(), ["chat", key], "left_anti")


def chapters(marks: DataFrame, video: str = "video") -> DataFrame:
    """Adds end: the start of the video's next chapter, null for the last one. A video has few chapters."""
    return marks.withColumn("end", F.lead("start").over(Window.partitionBy(video).orderBy("start", "title")))


def consolidated(sources: DataFrame, doc: str, number: str, title: str) -> DataFrame:
    """(doc, number, renumbered): sources of one title (in any case) share the number of its first, counted anew without the others."""
    low = F.lower(F.coalesce(F.nullif(F.regexp_extract(title, r"\[\[(.*?)\]\]", 1), F.lit("")), F.col(title)))
    first = sources.withColumn("_t", low).groupBy(doc, "_t").agg(F.min(number).alias("_first"), F.collect_list(number).alias("_all"))
    order = F.row_number().over(Window.partitionBy(doc).orderBy("_first", "_t"))
    return first.withColumn("renumbered", order).select(doc, F.explode("_all").alias(number), "renumbered")


def change_blocks(lines: DataFrame, doc: str, at: str, changed: str) -> DataFrame:
    """Adds block: changed lines next to each other share one, every other line has its own; numbered from 1 in a document."""
    w = Window.partitionBy(doc).orderBy(at)
    opens = ~(F.col(changed) & F.coalesce(F.lag(changed).over(w), F.lit(False)))
    return lines.withColumn("_o", opens.cast("int")).withColumn("block", F.sum("_o").over(w)).drop("_o")


def layered(segments: DataFrame, key: list[str], layers: list[str]) -> DataFrame:
    """(key, text, hash, hashes): a prompt's segments joined by blank lines, layer by layer, with SHA-256 of each layer and of the whole.

    segments: (key, layer, ord, content). Segments without text are left out, unknown layers too; a prompt is bounded by its model's window.
    """
    clean = F.regexp_replace(F.regexp_replace("content", r"\r\n", "\n"), r"^\s+|\s+$", "")
    rows = segments.where(F.col("layer").isin(layers)).withColumn("_c", clean).where("_c <> ''")
    one = rows.groupBy(*key, "layer").agg(F.array_sort(F.collect_list(F.struct("ord", "_c"))).alias("_s"))
    one = one.select(*key, F.array_position(F.array(*map(F.lit, layers)), F.col("layer")).alias("_l"), "layer", F.array_join(F.transform("_s", lambda x: x["_c"]), "\n\n").alias("_t"))
    all_layers = one.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_l", "layer", "_t"))).alias("_a"))
    text = F.array_join(F.transform("_a", lambda x: x["_t"]), "\n\n")
    return all_layers.select(*key, text.alias("text"), F.sha2(text, 256).alias("hash"), F.map_from_entries(F.transform("_a", lambda x: F.struct(x["layer"], F.sha2(x["_t"], 256)))).alias("hashes"))


def context_segments(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, tag, id, content) of the context blocks in a text: named by their source, else by their tag and its count from the second on."""
    tags = [*T.CONTEXT_BLOCKS, "prior_context"]
    blocks = F.regexp_extract_all(text, F.lit(rf"(?s)(<({'|'.join(tags)})(?:\s[^>]*)?>.*?</\2>)"), F.lit(1))
    rows = texts.select(key, F.posexplode(blocks).alias("pos", "content")).withColumn("tag", F.regexp_extract("content", r"^<([\w-]+)", 1))
    given = F.regexp_extract("content", 'source="([^"]+)"', 1)
    source = F.when(F.col("tag") == "prior_context", F.when(given != "", given).otherwise("prior_context")).otherwise(T.block_source(F.col("content"), F.col("tag")))
    rows = rows.withColumn("_s", source)
    nth = F.row_number().over(Window.partitionBy(key, "tag", F.col("_s") == "").orderBy("pos"))  # a text has few blocks
    named = F.when(F.col("_s") != "", F.col("_s")).when(nth == 1, F.col("tag")).otherwise(F.concat_ws(":", "tag", nth.cast("string")))
    return rows.select(key, "pos", "tag", named.alias("id"), "content")


def sorted_items(items: DataFrame, strategy: str) -> DataFrame:
    """Items (name, created, last_used, manual) by the strategy (recent, created, name or manual), then by name, created and recent use."""
    created = F.coalesce("created", F.lit(0))
    recent = F.coalesce(F.when(F.col("last_used") > 0, F.col("last_used")), created)
    name = F.trim("name")
    first = {"recent": recent.desc(), "created": created.desc(), "name": name.asc(), "manual": F.coalesce("manual", F.lit(0)).asc()}
    return items.orderBy(first[strategy], name.asc(), created.desc(), recent.desc())


def near_ties(hits: DataFrame, query: str, score: str, note: str, chunk: str, step: float = 0.01) -> DataFrame:
    """Adds rank: by score in steps of ``step``, then a note's chunks in their order, then by score.

    Comparing pairs by whether their scores differ by a step is no order; steps of equal width are one, and differ from it where a pair straddles a border.
    """
    return numbered(hits, [query], [F.floor(F.col(score) / step).desc(), F.col(note), F.col(chunk), F.desc(score)]).withColumnRenamed("place", "rank")


def within_size(rows: DataFrame, order: list[Column], limit: int, fewest: int = 50, halvings: int | None = None) -> DataFrame:
    """The first rows, halved in number until their JSON holds no more than ``limit`` characters; none if ``fewest`` still hold more.

    With ``halvings``, so many halvings are tried at most, and none are left if what they leave still holds more.

    Sizes are summed for each number of rows that halving can reach; what reaches the driver are those sums.
    """
    n = rows.count()
    sizes = [n]
    while sizes[-1] > fewest and (halvings is None or len(sizes) <= halvings):
        sizes.append(max(fewest, sizes[-1] // 2))
    placed = numbered(rows, [], order).withColumnRenamed("place", "_n").withColumn("_c", F.length(F.to_json(F.struct(*rows.columns))) + 1)
    sums = placed.agg(*(F.coalesce(F.sum(F.when(F.col("_n") <= k, F.col("_c"))), F.lit(0)).alias(f"s{i}") for i, k in enumerate(sizes))).first()
    fits = next((k for i, k in enumerate(sizes) if sums[i] + 1 <= limit), 0)
    return placed.where(F.col("_n") <= fits).drop("_n", "_c")


def capped(filtered: DataFrame, searched: DataFrame, query: str, limit: int) -> DataFrame:
    """Filter hits first, then search hits, ``limit`` a query, with place and the number of all (cut where it is larger)."""
    both = filtered.withColumn("_o", F.lit(0)).unionByName(searched.withColumn("_o", F.lit(1)))
    n = both.groupBy(query).agg(F.count("*").alias("found"))
    place = F.row_number().over(Window.partitionBy(query).orderBy("_o", F.desc("score"), "ord"))
    return both.withColumn("place", place).where(F.col("place") <= limit).join(n, query).withColumn("cut", F.col("found") > limit).drop("_o")


def needs_rerank(hits: DataFrame, query: str, score: str, threshold: float) -> DataFrame:
    """(query, rerank): whether a query's best score lies below the threshold, or none is a number."""
    fine = F.when(~F.isnan(score), F.col(score))
    return hits.groupBy(query).agg(F.coalesce(F.max(fine) < threshold, F.lit(True)).alias("rerank"))


def salient_boost(hits: DataFrame, terms: str, factor: float = 1.1) -> DataFrame:
    """Scores times ``factor`` where the content or the title holds any of the terms, in any case."""
    held = F.exists(terms, lambda t: F.contains(F.lower("content"), F.lower(t)) | F.contains(F.lower("title"), F.lower(t)))
    return hits.withColumn("boosted", F.col("score") * F.when(held, factor).otherwise(1.0))


def variables(prompts: DataFrame, notes: DataFrame) -> DataFrame:
    """(prompt, variable, path) of the notes that a prompt's variables name: {#tag, #tag}, {[[note]]} and {folder}.

    prompts (prompt, text); notes (path, tags). Tags match exactly, a note by its path or, if only one has it, by its name, a folder by its
    parts in order. Variables are matched as distinct names, tags and names by equality; folders are a stated set, sent to every task after a count.
    """
    found = prompts.select("prompt", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\{([^{}]+)\}"), F.lit(1)))).alias("variable")).withColumn("variable", F.trim("variable"))
    kind = F.when(F.startswith("variable", F.lit("#")), "tag").when(F.col("variable").rlike(r"^\[\[.*\]\]$"), "note").otherwise("folder")
    names = found.select("variable").distinct().withColumn("kind", kind)
    wanted = names.where("kind = 'tag'").select("variable", F.explode(F.transform(F.split("variable", ","), lambda t: F.trim(t))).alias("key"))
    tags = wanted.join(notes.select("path", F.explode("tags").alias("key")), "key").select("variable", "path")
    title = F.regexp_replace(F.regexp_replace("variable", r"^\[\[|\]\]$", ""), r"\.md$", "")
    keys = notes.select("path", F.explode(F.array_distinct(F.array(F.regexp_replace("path", r"\.md$", ""), P.stem(F.col("path"))))).alias("key")).groupBy("key").agg(F.min("path").alias("path"), F.count_distinct("path").alias("n")).where("n = 1")
    titles = names.where("kind = 'note'").select("variable", title.alias("key")).join(keys, "key").select("variable", "path")
    folders = names.where("kind = 'folder'")
    folders = F.broadcast(folders) if folders.count() <= 10_000 else folders
    placed = notes.select("path").join(folders, P.holds_parts(F.col("path"), F.col("variable"))).select("variable", "path")
    return found.join(tags.unionByName(titles).unionByName(placed).distinct(), "variable").select("prompt", "variable", "path")


def tool_calls(chunks: DataFrame, key: list[str], order: str) -> DataFrame:
    """(key, name, arguments): the parts of a streamed call joined in order."""
    held = F.array_sort(F.collect_list(F.struct(order, "name", "arguments")))
    whole = lambda c: F.array_join(F.transform("_p", lambda x: F.coalesce(x[c], F.lit(""))), "").alias(c)
    return chunks.groupBy(*key).agg(held.alias("_p")).select(*key, whole("name"), whole("arguments"))


def embedded_sections(embeds: DataFrame, notes: DataFrame) -> DataFrame:
    """(path, heading, content): the section under an embed's heading, up to the next heading of its level or a higher one; whole notes without heading.

    embeds (path, heading, may be null), notes (path, body). Headings compare in lower case, without punctuation at their ends; only
    notes with an embed are split into lines. The first of equal headings counts; what isn't found gives a null content.
    """
    clean = lambda c: F.lower(F.regexp_replace(c, r"^[\s#]+|[\s#:.,;!?]+$", ""))
    asked = embeds.select("path", "heading").distinct()
    near = notes.join(asked.select("path").distinct(), "path", "left_semi").select("path", "body")
    lines = near.select("path", F.posexplode(F.split("body", "\n")).alias("pos", "line"))
    marks = lines.where(F.col("line").rlike(r"^#{1,6}\s+\S")).select("path", "pos", F.length(F.regexp_extract("line", "^(#+)", 1)).alias("level"), clean(F.col("line")).alias("title"))
    wanted = asked.where("heading is not null").select("path", "heading", clean(F.col("heading")).alias("title"))
    at = wanted.join(marks, ["path", "title"]).groupBy("path", "heading").agg(F.min(F.struct("pos", "level")).alias("a")).select("path", "heading", "a.*")
    later = at.alias("x").join(marks.select("path", F.col("pos").alias("next"), F.col("level").alias("other")), "path").where("next > pos and other <= level").groupBy("path", "heading").agg(F.min("next").alias("end"))
    spans = at.join(later, ["path", "heading"], "left")
    parts = F.split("body", "\n")
    cut = F.slice(parts, F.col("pos") + 1, F.coalesce("end", F.size(parts)) - F.col("pos"))
    found = spans.join(near, "path").select("path", "heading", F.array_join(cut, "\n").alias("content"))
    missing = wanted.join(found.select("path", "heading"), ["path", "heading"], "left_anti").select("path", "heading", F.lit(None).cast("string").alias("content"))
    whole = asked.where("heading is null").join(near, "path", "left").select("path", "heading", F.col("body").alias("content"))
    return found.unionByName(missing).unionByName(whole)


def folder_tree(files: DataFrame, limit: int = 500_000) -> DataFrame:
    """(folder, files, counts as JSON): the names in each folder and how many files of each extension lie in or below it.

    The names are left out where all rows together hold more than ``limit`` characters as JSON: one sum reaches the driver.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    each = files.select(F.explode(above).alias("folder"), P.extension(F.col("path")).alias("e")).groupBy("folder", "e").agg(F.count("*").alias("n"))
    counts = each.groupBy("folder").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("e", "n"))))).alias("counts"))
    own = files.select(P.folder(F.col("path")).alias("folder"), P.name(F.col("path")).alias("f"))
    size = own.agg(F.coalesce(F.sum(F.length("f") + 3), F.lit(0))).first()[0]
    if size > limit:
        return counts.select("folder", F.lit(None).cast("array<string>").alias("files"), "counts")
    names = own.groupBy("folder").agg(F.array_sort(F.collect_list("f")).alias("files"))
    return counts.join(names, "folder", "left").select("folder", "files", "counts")


def local_search(filtered: DataFrame, searched: DataFrame, limit: int) -> DataFrame:
    """(query, path, score, source, place): a query's filter hits, then its search hits that aren't among them, each path's best once, ``limit`` in all.

    Both (query, path, score, ord); null paths stay apart.
    """
    rest = searched.join(filtered.select("query", "path").distinct(), ["query", "path"], "left_anti").select(*searched.columns)
    best = F.max_by(F.struct("score", "ord", "path"), F.struct(F.col("score"), -F.col("ord")))
    once = rest.groupBy("query", F.coalesce(F.lower("path"), F.col("ord").cast("string")).alias("_k")).agg(best.alias("_b")).select("query", F.col("_b.path").alias("path"), F.col("_b.score").alias("score"), F.col("_b.ord").alias("ord"))
    both = filtered.select("query", "path", "score", "ord", F.lit("filter").alias("source")).unionByName(once.withColumn("source", F.lit("search")))
    place = F.row_number().over(Window.partitionBy("query").orderBy("source", F.desc("score"), "ord"))
    return both.withColumn("place", place).where(F.col("place") <= limit).drop("ord")


def unified_search(asked: DataFrame, timed: DataFrame, lexical: DataFrame, semantic: DataFrame, limit: int = 30) -> DataFrame:
    """(query, note, score, path of the search): asked (query, ranged, semantic) tells for each query whether it has a time range, and whether vectors are used.

    With a range, the notes of the range (query, note, score); else with vectors, lexical and semantic hits by their summed reciprocal ranks;
    else the lexical hits.
    """
    from corpusloom.operators.retrieval import merged_search

    of = lambda rows, which: rows.join(asked.where(which).select("query"), "query", "left_semi")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "note")
    first = lambda rows, name: rows.select("query", "note", "score").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit).withColumn("way", F.lit(name))
    fused = merged_search(of(lexical, "not ranged and semantic"), of(semantic, "not ranged and semantic"), limit).select("query", "note", "score", "rank", F.lit("hybrid").alias("way"))
    return first(of(timed, "ranged"), "time").unionByName(fused).unionByName(first(of(lexical, "not ranged and not semantic"), "lexical"))


def in_time(notes: DataFrame, ranges: DataFrame, daily: DataFrame) -> DataFrame:
    """(query, path, daily): notes changed within a query's range, borders included, and the daily notes of its days; of both, the daily one.

    ranges (query, start, end) in milliseconds; daily (query, path). A stated set of ranges meets all notes: it is sent to every task after a count.
    """
    few = F.broadcast(ranges) if ranges.count() <= 10_000 else ranges
    inside = notes.select("path", "mtime").join(few, F.col("mtime").between(F.col("start"), F.col("end"))).select("query", "path", F.lit(False).alias("daily"))
    named = daily.join(notes.select("path").distinct(), "path", "left_semi").select("query", "path", F.lit(True).alias("daily"))
    return inside.unionByName(named).groupBy("query", "path").agg(F.bool_or("daily").alias("daily"))
