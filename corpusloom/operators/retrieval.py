"""Lexical retrieval: grep recall, fielded BM25+ and the search that composes both with boosts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import ranking
from corpusloom.tables import saved

#: Weights of the fields of a note.
FIELD_WEIGHTS = {"title": 5.0, "tags": 4.0, "heading": 2.5, "path": 1.5, "body": 1.0}


def postings(notes: DataFrame, fields: dict[str, str], terms: Callable[[Column], Column] = T.terms) -> DataFrame:
    """(ord, field, n_terms, first, term): a term counts once for a field, ``first`` marks one row of each field of a note.

    fields maps a field's name to a column of strings or of arrays (tags). Notes are read once for all fields.
    """
    text = lambda c: F.concat_ws(" ", c) if notes.schema[c].dataType.typeName() == "array" else F.coalesce(F.col(c), F.lit(""))
    made = F.array(*(F.struct(F.lit(f).alias("field"), terms(text(c)).alias("t")) for f, c in fields.items()))
    rows = notes.select("ord", F.inline(made))
    return rows.select("ord", "field", F.size("t").alias("n_terms"), F.posexplode("t").alias("_at", "term")).withColumn("first", F.col("_at") == 0).drop("_at")


def prefix_matches(words: DataFrame, asked: DataFrame, share: float = 0.375) -> DataFrame:
    """(term, asked, nearness): distinct index terms that start with an asked term; longer ones count ``share`` and less the more they add."""
    longest = asked.agg(F.max(F.length("term")).alias("_longest"))
    some = words.crossJoin(F.broadcast(longest)).where("_longest > 0 and length(term) > 0")  # one row
    starts = some.select("term", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("term"), "_longest")), lambda i: F.substring("term", F.lit(1), i))).alias("asked"))
    n, more = F.length("term"), F.length("term") - F.length("asked")
    return starts.join(asked.select(F.col("term").alias("asked")), "asked").select("term", "asked", F.when(more == 0, 1.0).otherwise(share * n / (n + 0.3 * more)).alias("nearness"))


def bm25_plus(index: DataFrame, queries: DataFrame, candidates: DataFrame | None = None, k1: float = 1.2, b: float = 0.7, delta: float = 0.5, prefix: bool = True, explain: bool = True) -> DataFrame:
    """(query, ord, score, matches) for queries (query, term) over a written index of ``postings``; any of a query's terms may match.

    ``candidates`` (query, ord): each query then has its own candidates only, and counts and mean lengths are of them. With ``prefix``, index
    terms that start with a query's term count too. ``matches`` lists the (field, term, weight) that a score rests on, if asked to ``explain``. Only postings of
    asked terms are shuffled.
    """
    asked = queries.select("query", "term").distinct()
    terms = asked.select("term").distinct()
    if prefix:
        near = prefix_matches(index.select("term").distinct(), terms)
    else:
        near = terms.select("term", F.col("term").alias("asked"), F.lit(1.0).alias("nearness"))
    near = saved(near, "near_terms")
    if candidates is None and not explain:
        return _summed(index, near, asked, k1, b, delta)
    met = index.join(near.select("term").distinct(), "term", "left_semi")
    by = []
    if candidates is None:
        sizes = index.groupBy("field").agg(F.count_if("first").alias("n"), F.count("*").alias("total"))
    else:
        by, pairs = ["query"], candidates.select("query", "ord").distinct()
        sizes = index.where("first").join(pairs, "ord").groupBy("query", "field").agg(F.count("*").alias("n"), F.sum("n_terms").alias("total"))
        met = met.join(pairs, "ord")
    sizes = sizes.select(*by, "field", "n", (F.col("total") / F.col("n")).alias("mean"))
    df = met.groupBy(*by, "field", "term").agg(F.count("*").alias("df"))
    weight, idf, tf = _parts(k1, b, delta)
    scored = met.join(df.join(sizes, [*by, "field"]), [*by, "field", "term"]).select(*by, "ord", "term", "field", weight.alias("weight"), (weight * idf * tf).alias("s"))
    reached = scored.join(near, "term").join(asked.withColumnRenamed("term", "asked"), [*by, "asked"])
    # A term of the index may be reached from several of a query's terms: it counts for each, and is listed once.
    if not explain:
        return reached.groupBy("query", "ord").agg(F.sum(F.col("s") * F.col("nearness")).alias("score"))
    hits = reached.groupBy("query", "ord").agg(F.sum(F.col("s") * F.col("nearness")).alias("score"), F.collect_set(F.struct("field", "term", "weight")).alias("matches"))
    return hits.withColumn("matches", F.array_sort("matches"))


def _parts(k1: float, b: float, delta: float) -> tuple[Column, Column, Column]:
    weight = F.element_at(F.create_map(*(F.lit(x) for kv in FIELD_WEIGHTS.items() for x in kv)), F.col("field"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = (k1 + 1) / (1 + k1 * (1 - b + b * F.col("n_terms") / F.col("mean"))) + delta
    return weight, idf, tf


def _summed(index: DataFrame, near: DataFrame, asked: DataFrame, k1: float, b: float, delta: float) -> DataFrame:
    """(query, ord, score) over all notes: what a note gives to an asked term is summed before queries come in, so no row for a posting and a query is shuffled.

    A note's rows then lie in one task, where the queries' terms meet them; these are sent to every task after a count.
    """
    sizes = index.groupBy("field").agg(F.count_if("first").alias("n"), F.count("*").alias("total")).select("field", "n", (F.col("total") / F.col("n")).alias("mean"))
    df = index.groupBy("field", "term").agg(F.count("*").alias("df"))
    weight, idf, tf = _parts(k1, b, delta)
    reached = df.join(near, "term").join(F.broadcast(sizes), "field").select("field", "term", "asked", "mean", (weight * idf * F.col("nearness")).alias("_w"))  # sizes: a row a field
    given = index.select("ord", "field", "term", "n_terms").join(reached, ["field", "term"]).select("ord", "asked", (F.col("_w") * tf).alias("s"))
    given = given.repartition("ord").groupBy("ord", "asked").agg(F.sum("s").alias("s"))
    asked = saved(asked.select("query", F.col("term").alias("asked")), "asked_terms")
    few = F.broadcast(asked) if asked.count() <= 1_000_000 else asked
    return given.join(few, "asked").groupBy("query", "ord").agg(F.sum("s").alias("score"))


def recall_terms(query: Column, most_chars: int = 1000) -> Column:
    """The trimmed query, cut to ``most_chars``, and its salient terms, in lower case, each once."""
    whole = F.left(F.trim(query), F.lit(most_chars))
    return F.array_distinct(F.filter(F.concat(F.array(F.lower(whole)), T.salient_terms(whole)), lambda t: F.length(t) > 1))


def _grams(text: Column, n: int) -> Column:
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def substrings(units: DataFrame, terms: DataFrame) -> DataFrame:
    """(unit, term) for all terms of two characters or more that lie in a unit; both tables hold distinct values.

    Units are indexed by the three-character grams that some term holds (and by two-character ones for terms of two). A term takes the postings of its rarest
    gram, and what these hold is checked for the whole term; a term with a gram that no unit has is dropped unread.
    """
    three = F.length("term") > 2
    wanted = terms.where(F.length("term") > 1).select("term", F.explode(F.array_distinct(F.when(three, _grams(F.col("term"), 3)).otherwise(F.array("term")))).alias("gram"))
    wanted = saved(wanted, "wanted_grams")
    two = not wanted.where("length(gram) = 2").isEmpty()
    grams = F.concat(_grams(F.col("unit"), 3), _grams(F.col("unit"), 2)) if two else _grams(F.col("unit"), 3)
    postings = units.select("unit", F.explode(F.array_distinct(grams)).alias("gram")).join(wanted.select("gram").distinct(), "gram", "left_semi")
    postings = saved(postings, "gram_postings")
    often = postings.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = wanted.join(often, "gram", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0")
    return postings.join(rarest.select("term", F.col("r.gram").alias("gram")), "gram").where("contains(unit, term)").select("unit", "term")


def in_bodies(notes: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, ord) for terms (lower case, two characters or more) in the notes' bodies; one row each.

    Bodies are split at white space into words, and the index is of the distinct words. A term without white space lies in a body exactly if it lies in a
    word. One with white space holds its inner words whole, so the notes of the rarest of them are checked, and without inner words
    those whose words hold the longer of its ends.
    """
    words = saved(notes.select("ord", F.explode(F.array_distinct(F.split(F.lower("body"), r"\s+"))).alias("word")), "words")
    often = saved(words.groupBy("word").agg(F.count("*").alias("n")), "vocabulary")
    tokens = F.split("term", r"\s+")
    inner = F.when(F.size(tokens) > 2, F.slice(tokens, 2, F.size(tokens) - 2)).otherwise(F.array().cast("array<string>"))
    ends = F.when(F.length(F.get(tokens, F.lit(0))) >= F.length(F.get(tokens, F.lit(1))), F.get(tokens, F.lit(0))).otherwise(F.get(tokens, F.lit(1)))
    parsed = saved(terms.select("term", F.array_distinct(inner).alias("inner"), F.when(F.size(tokens) == 1, F.col("term")).otherwise(ends).alias("part"), (F.size(tokens) > 1).alias("phrase")), "parsed")
    whole = parsed.where(F.size("inner") > 0)
    anchors = whole.select("term", F.explode("inner").alias("word")).join(often, "word", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("r")).where("r.n > 0").select("term", F.col("r.word").alias("word"))
    others = parsed.where(F.size("inner") == 0)
    parts = substrings(often.select(F.col("word").alias("unit")), others.select(F.col("part").alias("term")).distinct())
    by_part = others.join(parts.select(F.col("unit").alias("word"), F.col("term").alias("part")), "part")
    sought = saved(anchors.withColumn("phrase", F.lit(True)).unionByName(by_part.select("term", "word", "phrase")), "sought_words")
    sought = F.broadcast(sought) if sought.count() <= 1_000_000 else sought  # then the words are neither shuffled nor sorted
    single = words.join(sought.where("not phrase"), "word").select("term", "ord").distinct()
    bodies = notes.select("ord", F.lower("body").alias("_b"))
    maybe = words.join(sought.where("phrase"), "word").select("term", "ord").distinct()
    # Bodies stream past the hits, unsorted.
    found = single.unionByName(maybe.hint("shuffle_hash").join(bodies, "ord").where("contains(_b, term)").select("term", "ord"))
    bare = parsed.where((F.size("inner") == 0) & (F.length("part") < 2))  # single characters about a gap: no word narrows these down
    if not bare.isEmpty():
        found = found.unionByName(bodies.join(bare.select("term"), F.expr("contains(_b, term)")).select("term", "ord"))
    return found


def first_in_bodies(notes: DataFrame, terms: DataFrame, most: int, early: int) -> DataFrame:
    """(term, ord): the ``most`` notes with the least ord of each term of ``in_bodies``.

    A common term has them among the first ``early`` notes already. Terms that don't are looked for in eight times as many, and so on up to all, so that no term
    meets many more than 8 ``most`` notes at a time where its hits lie about evenly.
    """
    first = F.row_number().over(Window.partitionBy("term").orderBy("ord"))
    cut = lambda found: found.withColumn("_n", first).where(F.col("_n") <= most).drop("_n")
    n, out = notes.count(), None
    while 2 * early < n:
        last = notes.agg(F.percentile_approx("ord", early / n).alias("_last"))
        begin = notes.crossJoin(F.broadcast(last)).where("ord is null or ord <= _last").drop("_last")  # one row
        found = saved(cut(in_bodies(begin, terms)), "early_hits")
        done = saved(found.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= most).select("term"), "early_terms")
        found = found.join(done, "term", "left_semi")
        out = found if out is None else out.unionByName(found)
        terms, early = saved(terms.join(done, "term", "left_anti"), "late_terms"), 8 * early
    rest = cut(in_bodies(notes, terms))
    return rest if out is None else out.unionByName(rest)


def grep(notes: DataFrame, queries: DataFrame, limit: int = 200, early: int = 10_000) -> DataFrame:
    """(query, ord, tier, matches, rank): path hits by number of terms first, then content hits in scan order, ``limit`` a query.

    queries (query, terms array). The distinct terms of all queries meet the distinct paths and the distinct words of all bodies through an index of character grams
    (``substrings``). Since content hits count in scan order, the first 2 ``limit`` of a term are enough: if fewer than ``limit`` of them miss the
    path, path hits alone fill the list. Common terms have them among the first ``early`` notes. Null bodies and paths hold nothing; terms of one character are left out.
    """
    asked = queries.select("query", F.explode(F.array_distinct(F.filter(F.transform("terms", F.lower), lambda t: F.length(t) > 1))).alias("term"))
    asked = saved(asked, "asked")
    terms = asked.select("term").distinct()
    paths = notes.select("ord", F.lower("path").alias("unit"))
    in_path = paths.join(substrings(paths.select("unit").where("unit is not null").distinct(), terms), "unit").select("term", "ord")
    in_body = first_in_bodies(notes, terms, 2 * limit, early).select("term", "ord", F.lit(0).alias("p"))
    both = in_path.select("term", "ord", F.lit(1).alias("p")).unionByName(in_body).join(asked, "term")
    hits = both.groupBy("query", "ord").agg(F.sum("p").alias("matches"))
    hits = hits.select("query", "ord", F.when(F.col("matches") > 0, 0).otherwise(1).alias("tier"), "matches")
    w = Window.partitionBy("query").orderBy("tier", F.desc("matches"), "ord")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def search(notes: DataFrame, edges: DataFrame, queries: DataFrame, fields: dict[str, str], results: int = 30, candidates: int = 200, boosts: bool = True) -> DataFrame:
    """(query, note, score, rank, matches): recall by grep, BM25+ over a query's candidates, boosts by folder and links, min-max, diverse top.

    notes (ord, path, folder, tags, body and the columns of ``fields``), edges (src, dst), queries (query, text; only its first 1,000 characters are searched). Results are clamped to 1 to 100,
    candidates to 10 to 1000; three times the results go into the boosts. A query whose candidates match no term has no results; blank queries have
    none either.
    """
    results, candidates = min(max(1, results), 100), min(max(10, candidates), 1000)
    asked = queries.where(F.trim("text") != "")
    found = saved(grep(notes, asked.select("query", recall_terms(F.col("text")).alias("terms")), candidates).select("query", "ord"), "candidates")
    near = notes.join(found.select("ord").distinct(), "ord", "left_semi")
    index = saved(postings(near, fields), "postings")
    words = asked.select("query", T.salient_terms(F.left(F.trim("text"), F.lit(1000))).alias("t"), "text")
    terms = words.select("query", F.explode(T.terms(F.when(F.size("t") > 0, F.array_join("t", " ")).otherwise(F.col("text")))).alias("term"))
    top = Window.partitionBy("query").orderBy(F.desc("score"), "ord")
    hits = bm25_plus(index, terms, found).withColumn("score", F.round("score", 6)).withColumn("_rn", F.row_number().over(top)).where(F.col("_rn") <= 3 * results)
    hits = saved(hits.select("query", F.col("ord").alias("note"), "score", "matches"), "hits")
    if boosts:
        near = notes.join(hits.select(F.col("note").alias("ord")).distinct(), "ord", "left_semi")
        placed = hits.join(near.select(F.col("ord").alias("note"), "folder"), "note")
        totals = notes.groupBy("folder").agg(F.count("*").alias("total"))
        boosted = ranking.folder_boost(placed, totals).select("query", "note", F.col("boosted").alias("score"), "matches")
        tags = near.select(F.col("ord").alias("note"), F.explode("tags").alias("tag"))
        first = Window.partitionBy("query").orderBy(F.desc("score"), "note")
        numbered = saved(boosted.withColumn("_rn", F.row_number().over(first)), "boosted")
        # Links among a query's 20 best notes raise their scores; the others keep theirs.
        best = ranking.graph_boost(numbered.where("_rn <= 20").select("query", "note", "score"), edges, tags).select("query", "note", "boosted")
        hits = numbered.join(best, ["query", "note"], "left").select("query", "note", F.round(F.coalesce("boosted", "score"), 6).alias("score"), "matches")
    scaled = ranking.min_max(hits, "query", "score").select("query", "note", F.round("normalised", 6).alias("score"), "matches", F.col("note").alias("_tie"))
    return ranking.diverse_top(scaled, "query", "note", "score", "_tie", results).drop("_tie")


def merged_search(lexical: DataFrame, semantic: DataFrame, limit: int = 30, k: int = 60) -> DataFrame:
    """(query, note, score, rank): reciprocal ranks of both lists (query, note, score) summed, the best ``limit``."""
    ranked = lambda rows: rows.where("score > 0").withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "note")))
    fused = ranking.reciprocal_rank_fusion(ranked(lexical).select("query", "note", "r").unionByName(ranked(semantic).select("query", "note", "r")), "query", "note", "r", k)
    top = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "note")
    return fused.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= limit)
