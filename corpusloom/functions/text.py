"""Text functions as Column expressions; all but balanced_json run inside the JVM."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The secrets that redaction finds, in the order of their application.
SENSITIVE_PATTERNS = [
    r"""(?i)(?:api[_-]?key|apikey)\s*[:=]\s*["']?[A-Za-z0-9\-_]{16,}["']?""",
    r"""(?i)Bearer\s+[A-Za-z0-9_.-]{20,}""",
    r"""\b(?:AKIA|ASIA)[A-Z0-9]{16}\b""",
    r"""(?i)(?:secret|password|passwd|pwd|token|auth)\s*[:=]\s*["']?[^\s"']{8,}["']?""",
    r"""\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b""",
    r"""-----BEGIN\s+(?:RSA|DSA|EC|OPENSSH)?\s*PRIVATE\s+KEY-----""",
    r"""(?i)(?:mongodb|postgres|mysql|redis)://[^:]+:[^@]+@[^\s]+""",
    r"""(?i)\b[0-9a-f]{32,}\b""",
]

# Chat template tokens that must not reach a reader.
SPECIAL_TOKENS = [
    "<|im_end|>",
    "<|im_start|>",
    "<|eot_id|>",
    "<|start_header_id|>",
    "<|end_header_id|>",
    "<end_of_turn>",
    "<start_of_turn>",
    "<|end|>",
    "<|assistant|>",
    "<|user|>",
    "<|system|>",
    "</s>",
    "[INST]",
    "[/INST]",
    "<|endoftext|>",
    "<|end▁of▁sentence|>",
    "<|END_OF_TURN_TOKEN|>",
    "<|START_OF_TURN_TOKEN|>",
]


def escaped(literal: str) -> str:
    """A pattern for the literal that Java and RE2 read alike."""
    return "".join(f"\\{c}" if c in r"\.[]{}()*+?^$|/" else c for c in literal)


SPECIAL_TOKENS_PATTERN = "|".join(map(escaped, SPECIAL_TOKENS))


def redact(text: Column) -> Column:
    """Every match of the sensitive patterns, one pattern after the other, becomes [REDACTED]."""
    for p in SENSITIVE_PATTERNS:
        text = F.regexp_replace(text, p, "[REDACTED]")
    return text


def strip_special_tokens(text: Column) -> Column:
    return F.regexp_replace(text, SPECIAL_TOKENS_PATTERN, "")


def strip_thinking(text: Column) -> Column:
    """Without <think> blocks, closed or cut off."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>\s*", ""), r"(?s)<think>.*$", ""))


def strip_role_lines(text: Column) -> Column:
    """Without lines that are a role's name and nothing else."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.lower(F.trim(x)).isin("user", "assistant", "system")), "\n")


def ascii_terms(text: Column) -> Column:
    """Distinct words of [a-z0-9_], in lower case: a term counts once for a field."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0)))


def cjk_bigrams(text: Column) -> Column:
    """Overlapping pairs of CJK characters, single characters as they are."""
    found = F.regexp_extract_all(text, F.lit(r"[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]+"), F.lit(0))
    pairs = lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2))))
    return F.array_distinct(F.flatten(F.transform(found, pairs)))


def tag_terms(text: Column) -> Column:
    """#a/b gives #a/b, a/b, every prefix with and without the sign, and every segment."""
    tags = F.regexp_extract_all(F.lower(text), F.lit(r"#[\p{L}\p{N}_/-]+"), F.lit(0))
    return F.array_distinct(F.flatten(F.transform(tags, hierarchy)))


def hierarchy(tag: Column) -> Column:
    body = F.regexp_replace(tag, "^#", "")
    parts = F.filter(F.split(body, "/"), lambda p: p != "")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    every = F.concat(F.array(tag, body), F.transform(prefixes, lambda p: F.concat(F.lit("#"), p)), prefixes, parts)
    return F.filter(F.array_distinct(every), lambda t: ~t.isin("", "#"))


def terms(text: Column) -> Column:
    """The set of terms that a field is indexed by: tags with their hierarchy, plain words, CJK pairs."""
    plain = F.regexp_replace(F.lower(text), r"#[\p{L}\p{N}_/-]+", " ")
    return F.array_distinct(F.concat(tag_terms(text), ascii_terms(plain), cjk_bigrams(text)))


def query_tags(query: Column) -> Column:
    return F.filter(F.array_distinct(F.regexp_extract_all(F.lower(query), F.lit(r"#[\p{L}\p{N}_/-]+"), F.lit(0))), lambda t: F.length(t) > 1)


def salient_terms(query: Column) -> Column:
    """Words of two characters or more of the query's [A-Za-z0-9_-] and, of hyphenated ones, their parts."""
    words = F.filter(F.split(F.regexp_replace(F.lower(query), r"[^a-z0-9_\s-]", " "), r"\s+"), lambda w: F.length(w) >= 2)
    parts = F.flatten(F.transform(words, lambda w: F.concat(F.array(w), F.when(F.contains(w, F.lit("-")), F.filter(F.split(w, "-"), lambda p: F.length(p) >= 2)).otherwise(F.array().cast("array<string>")))))
    return F.array_distinct(parts)


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, of lower-case texts; 1 for two empty ones."""
    a, b = F.lower(a), F.lower(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.try_divide(F.levenshtein(a, b), longest))


def fuzzy_match(a: Column, b: Column, least: float = 0.8) -> Column:
    """Whether two words are alike enough, as they are or without plural endings."""
    return (similarity(a, b) >= least) | (without_plural(a) == without_plural(b)) | (similarity(without_plural(a), without_plural(b)) >= least)


def without_plural(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "(es|s)$", "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*"))


def spaced_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def token_estimate(words: Column) -> Column:
    """1.35 tokens a word, rounded up, in whole numbers: as a double, 140 * 1.35 is above 189."""
    return F.ceil(words.cast("decimal(20,0)") * F.lit(135) / F.lit(100)).cast("long")


def xml_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ('"', "&quot;"), ("'", "&apos;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def head_and_tail(text: Column, limit: int, head: float = 0.75, tail: float = 0.15, marker: str = "\n\n[... truncated ...]\n\n") -> Column:
    """Texts over ``limit`` bytes keep their first and last shares of the limit, in characters."""
    return F.when(F.octet_length(text) > limit, F.concat(F.left(text, F.lit(int(limit * head))), F.lit(marker), F.right(text, F.lit(int(limit * tail))))).otherwise(text)


def truncated(text: Column, limit: int = 10_000) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("\n... ["), (F.length(text) - limit).cast("string"), F.lit(" more characters]"))).otherwise(text)


def sections_compacted(text: Column, preview: int = 500, sections: int = 20, verbatim: int = 5000) -> Column:
    """Every section's heading and first characters; short texts as they are."""
    parts = F.filter(F.split(text, r"\n(?=#{1,6} )"), lambda p: F.trim(p) != "")
    short = F.transform(F.slice(parts, 1, sections), lambda p: F.when(F.length(p) > preview, F.concat(F.left(p, F.lit(preview)), F.lit("..."))).otherwise(p))
    more = F.when(F.size(parts) > sections, F.concat(F.lit("\n\n["), (F.size(parts) - sections).cast("string"), F.lit(" sections omitted]"))).otherwise("")
    return F.when(F.length(text) <= verbatim, text).otherwise(F.concat(F.array_join(short, "\n\n"), more))


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def citations_removed(text: Column) -> Column:
    """Without footnote marks, bracketed numbers that aren't links, and footnote definitions."""
    text = F.regexp_replace(text, r"(?m)^\[\^\d+\]:.*$\n?", "")
    return F.regexp_replace(F.regexp_replace(text, r"\[\^\d+\]", ""), r"\[\d+(?:\s*,\s*\d+)*\](?!\()", "")


def pattern_predicate(pattern: str, path: Column, tags: Column) -> Column:
    """#tag, *.ext, [[note]] or folder, each matched by its own rule."""
    base = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    if pattern.startswith("#"):
        return F.coalesce(F.exists(tags, lambda t: F.lower(t) == pattern.lower()), F.lit(False))
    if pattern.startswith("*."):
        return F.endswith(F.lower(path), F.lit(pattern[1:].lower()))
    if pattern.startswith("[[") and pattern.endswith("]]"):
        return base == pattern[2:-2]
    folder = pattern.rstrip("/")
    return (path == folder) | F.startswith(path, F.lit(folder + "/"))


def indexable(path: Column, tags: Column, inclusions: list[str], exclusions: list[str], project: bool = False) -> Column:
    """An exclusion vetoes; then an inclusion is needed if there are any. A project without inclusions has nothing."""
    keep = F.lit(not project)
    if inclusions:
        keep = F.lit(False)
        for p in inclusions:
            keep = keep | pattern_predicate(p, path, tags)
    for p in exclusions:
        keep = keep & ~pattern_predicate(p, path, tags)
    return keep


def tag_matches(tags: Column, wanted: str) -> Column:
    """Whether some tag is the wanted one or lies below it (#a holds #a/b), in any case."""
    name = "#" + wanted.lstrip("#").lower()
    return F.coalesce(F.exists(tags, lambda t: (F.lower(t) == name) | F.lower(t).startswith(name + "/")), F.lit(False))


def valid_term(term: Column, least: int = 2) -> Column:
    """A word of letters, digits, _ and -, or a tag with / as well; ``least`` characters or more."""
    return (F.length(term) >= least) & F.when(F.startswith(term, F.lit("#")), term.rlike(r"^#[\p{L}\p{N}_/-]+$")).otherwise(term.rlike(r"^[\p{L}\p{N}_-]+$"))


def combined_terms(base: Column, tags: Column, query: Column) -> Column:
    """Base terms and tags, without the bodies of tags that the query doesn't hold as words of their own."""
    plain = F.split(F.regexp_replace(F.lower(query), r"#[\p{L}\p{N}_/-]+", " "), r"[^\p{L}\p{N}_-]+")
    bodies = F.array_except(F.transform(tags, lambda t: F.substr(t, F.lit(2))), plain)
    return F.array_except(F.array_distinct(F.concat(base, tags)), bodies)


def first_spellings(terms: Column) -> Column:
    """Trimmed terms without blank ones, each once whatever its case, in its first spelling."""
    clean = F.filter(F.transform(terms, lambda t: F.trim(t)), lambda t: t != "")
    low = F.transform(clean, lambda t: F.lower(t))
    return F.filter(clean, lambda t, i: F.array_position(low, F.lower(t)) == i + 1)


#: What begins and ends the blocks that a copied message leaves out.
WRITE_TAGS = ("writeFile", "writeToFile")
CALL_MARKS = ("<!--TOOL_CALL_START:", "<!--TOOL_CALL_END:", "-->")
_HOLE = "\ue000"  # stands where a block was


def message_for_copy(text: Column) -> Column:
    """Without thinking, write blocks (with the xml fence around one), tool calls and reasoning marks; at most one blank line in a row."""
    text = strip_thinking(text)
    for tag in WRITE_TAGS:
        text = F.regexp_replace(text, f"(?s)<{tag}>.*?</{tag}>", _HOLE)
    fences = F.regexp_replace(text, f"(?s)```xml(?:(?!```)[^{_HOLE}])*{_HOLE}.*?```", "")
    start, end, close = CALL_MARKS
    calls = F.regexp_replace(F.translate(fences, _HOLE, ""), f"(?s){start}.*?{close}.*?{end}.*?{close}", "")
    spoken = F.regexp_replace(calls, r"<!--AGENT_REASONING:\w+:\d+:.*-->", "")  # the list of steps may hold the mark's own end
    return F.regexp_replace(F.array_join(F.split(spoken, r"\n{3,}"), "\n\n"), r"^\s+|\s+$", "")


def joined_transcript(parts: Column) -> Column:
    """Trimmed parts without blank ones, white space as single spaces."""
    clean = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")
    return F.trim(F.regexp_replace(F.array_join(clean, " "), r"\s+", " "))


def byte_prefix(text: Column, limit: int | Column) -> Column:
    """The longest prefix of whole characters within ``limit`` bytes of UTF-8."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    data = F.encode(text, "UTF-8")
    last = F.hex(F.substring(data, F.greatest(limit - 3, F.lit(1)), F.least(limit, F.lit(4))))
    # A character that the cut leaves without its last bytes: a first byte with fewer followers than it announces.
    torn = F.regexp_extract(last, "(?:[CD].|E.(?:[89AB].)?|F.(?:[89AB].){0,2})$", 0)
    cut = F.decode(F.substring(data, F.lit(1), limit - F.floor(F.length(torn) / 2).cast("int")), "UTF-8")
    return F.when(limit <= 0, "").when(F.octet_length(text) <= limit, text).otherwise(cut)


def file_name_within(path: Column, most: int = 255) -> Column:
    """The path with its last part cut to ``most`` bytes, before the extension if that leaves room."""
    name = F.element_at(F.split(path, "/"), -1)
    folder = F.substring(path, F.lit(1), F.length(path) - F.length(name))
    ext = F.regexp_extract(name, r"(?s)(\.[^.]*)$", 1)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
    room = F.lit(most) - F.octet_length(ext)
    cut = F.when(room <= 0, byte_prefix(name, most)).otherwise(F.concat(byte_prefix(stem, room), ext))
    return F.when(F.octet_length(name) <= most, path).otherwise(F.concat(folder, cut))


def ellipsis(text: Column, limit: int) -> Column:
    """Cut after the last sentence past half of the limit, else at the last paragraph past half, else at the last space past four fifths."""
    cut = F.left(text, F.lit(limit))
    last = lambda pattern: F.length(F.regexp_extract(cut, pattern, 1))
    sentence, paragraph, space = last(r"(?s)^(.*)[.!?]\s+"), last(r"(?s)^(.*)\n\n"), last(r"(?s)^(.*) ")
    shorter = (
        F.when(sentence > limit * 0.5, F.concat(F.left(cut, sentence + 1), F.lit(" ...")))
        .when(paragraph > limit * 0.5, F.concat(F.left(cut, paragraph), F.lit("\n\n...")))
        .when(space > limit * 0.8, F.concat(F.left(cut, space), F.lit(" ...")))
        .otherwise(F.concat(cut, F.lit("...")))
    )
    return F.when(F.length(text) <= limit, text).otherwise(shorter)


def chat_title(name: Column) -> Column:
    """A file's name without project prefix, days and times, @ and _ as spaces."""
    prefix = F.substring_index(name, "__", 1)
    named = F.contains(name, F.lit("__")) & ~prefix.rlike("[^A-Za-z0-9-]|^$")
    rest = F.when(named, F.substr(name, F.length(prefix) + 3)).otherwise(name)
    # Of a run of digits, eights are days and a six left over is a time.
    undated = F.regexp_replace(rest, r"(?:\d{8})+(?:\d{6})?|\d{6}|\{\$(?:date|time)\}", "")
    return F.array_join(F.filter(F.split(undated, r"[\s@_]+"), lambda w: w != ""), " ")


# Characters that compare as their plain counterparts.
PLAIN_CHARACTERS = {"'": "\u2018\u2019", '"': "\u201c\u201d", "-": "\u2010\u2011\u2012\u2013\u2014\u2015\u2212", " ": "\u00a0\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"}


def fuzzy_text(text: Column) -> Column:
    """Smart quotes, dashes and special spaces as plain ones, lines without white space at their ends. Compatible characters are left alone."""
    for plain, others in PLAIN_CHARACTERS.items():
        text = F.translate(text, others, plain * len(others))
    return F.regexp_replace(text, r"(?m)[^\S\n]+$", "")


def edited(text: Column, old: Column, new: Column) -> Column:
    """struct(status, text): the single occurrence of ``old`` replaced, exactly or else in ``fuzzy_text``; not_found and ambiguous change nothing.

    Matches don't overlap. A leading byte order mark and the kind of line ends of the text are kept.
    """
    mark = F.when(F.startswith(text, F.lit("\ufeff")), F.lit("\ufeff")).otherwise("")
    crlf = F.contains(text, F.lit("\r\n"))
    unix = lambda c: F.replace(c, F.lit("\r\n"), F.lit("\n"))
    body, old, new = unix(F.regexp_replace(text, "^\ufeff", "")), unix(old), unix(new)
    count = lambda hay, needle: F.when(needle == "", 0).otherwise(F.try_divide(F.length(hay) - F.length(F.replace(hay, needle, F.lit(""))), F.length(needle)).cast("int"))
    exact, near = count(body, old), count(fuzzy_text(body), fuzzy_text(old))
    swap = lambda hay, needle: F.concat(F.left(hay, F.instr(hay, needle) - 1), new, F.substring(hay, F.instr(hay, needle) + F.length(needle), F.length(hay)))
    done = F.when(exact == 1, swap(body, old)).when((exact == 0) & (near == 1), swap(fuzzy_text(body), fuzzy_text(old)))
    status = F.when(exact > 1, "ambiguous").when(exact == 1, "exact").when(near > 1, "ambiguous").when(near == 1, "fuzzy").otherwise("not_found")
    ended = F.when(crlf, F.replace(done, F.lit("\n"), F.lit("\r\n"))).otherwise(done)
    return F.struct(status.alias("status"), F.coalesce(F.concat(mark, ended), text).alias("text"))


def edit_applied(text: Column, kind: Column, find: Column, put: Column) -> Column:
    """replace and delete the first occurrence, insert after it, create in place of a null text; null where nothing fits."""
    at = F.when(find != "", F.instr(text, find)).otherwise(0)
    left, right = F.left(text, at - 1), F.substring(text, at + F.length(find), F.length(text))
    return (
        F.when((kind == "create") & text.isNull(), put)
        .when((kind == "replace") & (at > 0), F.concat(left, put, right))
        .when((kind == "insert") & (at > 0), F.concat(left, find, put, right))
        .when((kind == "delete") & (at > 0), F.concat(left, right))
    )


def log_sections(text: Column) -> Column:
    """The sections of a log that start with ## lines, trimmed; what precedes the first one is left out."""
    parts = F.split(text, r"\n(?=[^\S\n]*## )")
    return F.transform(F.filter(parts, lambda p: F.ltrim(p).startswith("## ")), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))


# The tags of context blocks and the element that names their source (null: none).
CONTEXT_BLOCKS = {
    "note_context": "path",
    "active_note": "path",
    "embedded_note": "path",
    "vault_note": "path",
    "retrieved_document": "path",
    "url_content": "url",
    "web-content": "url",
    "web-search": None,
    "web_tab_context": "url",
    "active_web_tab": "url",
    "youtube_video_context": "url",
    "twitter_content": "url",
    "embedded_pdf": "name",
    "selected_text": None,
    "web_selected_text": "url",
    "localSearch": None,
}


def block_tag(block: Column) -> Column:
    return F.nullif(F.regexp_extract(block, r"^<(\w+)[\s>]", 1), F.lit(""))


def block_source(block: Column, tag: Column) -> Column:
    """What names the source of a block with this tag: the text of its path, url or name element, else its attribute url; empty if there is nothing."""
    found = F.lit("")
    for element in ("path", "url", "name"):
        tags = [t for t, e in CONTEXT_BLOCKS.items() if e == element]
        inner = F.regexp_extract(block, f"<{element}>([^<]+)</{element}>", 1)
        if element == "url":
            inner = F.when(inner != "", inner).otherwise(F.regexp_extract(block, r'\surl="([^"]+)"', 1))
        found = F.when(tag.isin(tags), inner).otherwise(found)
    return found


def block_content(block: Column) -> Column:
    """What its element content holds; the whole block if it has none."""
    pattern = r"(?s)<content>(.*?)</content>"
    return F.when(block.rlike(pattern), F.regexp_extract(block, pattern, 1)).otherwise(block)


def search_block_compacted(block: Column, preview: int = 500) -> Column:
    """The documents of a search block as a numbered list with the start of each; a block without documents as it is."""
    docs = F.regexp_extract_all(block, F.lit(r"(?s)<document>(.*?)</document>"), F.lit(1))
    part = lambda d, tag: F.regexp_extract(d, f"(?s)<{tag}>(.*?)</{tag}>", 1)

    def line(d, i):
        path, title, content = part(d, "path"), part(d, "title"), part(d, "content")
        title = F.when(title != "", title).otherwise(F.element_at(F.split(path, "/"), -1))
        short = F.when(F.length(content) > preview, F.concat(F.left(content, F.lit(preview)), F.lit("..."))).otherwise(content)
        return F.concat((i + 1).cast("string"), F.lit(". [["), title, F.lit("]] ("), path, F.lit(")\n   "), F.regexp_replace(short, r"^\s+|\s+$", ""))

    head = F.concat(F.lit('<prior_context source="localSearch" type="note">\n['), F.size(docs).cast("string"), F.lit(" search results - use localSearch to re-query]\n\n"))
    return F.when(F.size(docs) == 0, block).otherwise(F.concat(head, F.array_join(F.transform(docs, line), "\n\n"), F.lit("\n</prior_context>")))


def context_trailer(text: Column) -> Column:
    """struct(notes, urls, tags, folders, tabs) of "Notes: a, b | URLs: c | ..."; absent kinds are empty arrays."""
    parts = F.transform(F.split(text, r" \| "), lambda p: F.trim(p))

    def kind(*names: str) -> Column:
        pattern = f"^(?:{'|'.join(names)}): "
        lists = F.transform(F.filter(parts, lambda p: p.rlike(pattern)), lambda p: F.split(F.regexp_replace(p, pattern, ""), ", "))
        return F.filter(F.transform(F.flatten(lists), lambda x: F.trim(x)), lambda x: x != "")

    return F.struct(kind("Notes").alias("notes"), kind("URLs").alias("urls"), kind("Tags").alias("tags"), kind("Folders").alias("folders"), kind("Web Tabs", "WebTabs").alias("tabs"))


def document_xml(number: Column, title: Column, path: Column, modified: Column, content: Column) -> Column:
    """A search result as an element: path where it isn't the title, time where there is one."""
    line = lambda tag, c: F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>\n"))
    title = F.when(title != "", title).otherwise("Untitled")
    shown = F.when((path != "") & (path != title), line("path", path)).otherwise("")
    at = F.when(modified.isNotNull(), line("modified", F.date_format(modified, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))).otherwise("")
    return F.concat(F.lit("<document>\n"), line("id", number.cast("string")), line("title", title), F.coalesce(shown, F.lit("")), at, F.lit("<content>\n"), F.coalesce(content, F.lit("")), F.lit("\n</content>\n</document>"))


def catalog_line(title: Column, path: Column) -> Column:
    name = F.when(title != "", title).when(path != "", path).otherwise("Untitled")
    return F.concat(F.lit("- [["), name, F.lit("]] ("), F.when(path != "", path).otherwise(name), F.lit(")"))


def explained(matches: Column, folder: Column, links: Column, base: Column, final: Column) -> Column:
    """What a score rests on, in parts with a pipe between; absent parts are left out.

    matches: array of struct(field, term, weight); folder and links: factors above 1 count.
    """
    fields = F.array_sort(F.array_distinct(F.transform(matches, lambda m: F.concat(m["field"], F.lit(": "), m["term"]))))
    boost = lambda name, c: F.when(c > 1, F.concat(F.lit(f"{name} x"), F.format_number(c, 2)))
    change = F.when(base != final, F.concat(F.lit("score "), F.format_number(base, 2), F.lit(" to "), F.format_number(final, 2)))
    return F.concat_ws(" | ", F.when(F.size(fields) > 0, F.array_join(fields, ", ")), boost("folder", folder), boost("links", links), change)


def parsed_scores(reply: Column, expected: int) -> Column:
    """The numbers of the field scores of a reply's first JSON object, between 0 and 10; what isn't a finite number is left out."""
    held = F.from_json(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), "scores array<string>")["scores"]
    numbers = F.transform(F.slice(held, 1, expected), lambda x: x.try_cast("double"))
    fine = F.filter(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.transform(fine, lambda x: F.least(F.lit(10.0), F.greatest(F.lit(0.0), x))), F.array().cast("array<double>"))


def parsed_memories(reply: Column, categories: list[str]) -> Column:
    """array of struct(content, category, is_update, updated_id) from a reply's JSON array; items without content are left out.

    The first category stands for unknown ones; an id counts for updates only.
    """
    items = F.from_json(F.regexp_extract(reply, r"(?s)(\[.*\])", 1), "array<struct<content:string,category:string,isUpdate:boolean,updatedMemoryId:string>>")
    fine = F.filter(items, lambda x: F.trim(F.coalesce(x["content"], F.lit(""))) != "")

    def item(x):
        low = F.lower(F.coalesce(x["category"], F.lit("")))
        update = F.coalesce(x["isUpdate"], F.lit(False))
        return F.struct(F.trim(x["content"]).alias("content"), F.when(low.isin(categories), low).otherwise(categories[0]).alias("category"), update.alias("is_update"), F.when(update, x["updatedMemoryId"]).alias("updated_id"))

    return F.coalesce(F.transform(fine, item), F.array().cast("array<struct<content:string,category:string,is_update:boolean,updated_id:string>>"))


def parsed_expansion(reply: Column, query: Column, most: int = 3) -> Column:
    """struct(queries, terms): the query and other ones in <query>, and valid terms in <salient>, of a reply; terms of the query if it has none."""
    others = F.filter(F.transform(F.regexp_extract_all(reply, F.lit("<query>(.*?)</query>"), F.lit(1)), lambda q: F.trim(q)), lambda q: (q != "") & (q != query))
    held = F.regexp_extract(reply, r"(?s)<salient>(.*?)</salient>", 1)
    terms = F.transform(F.regexp_extract_all(held, F.lit("<term>(.*?)</term>"), F.lit(1)), lambda t: F.lower(F.trim(t)))
    terms = F.array_distinct(F.filter(terms, lambda t: valid_term(t)))
    found = F.when(F.size(terms) > 0, F.array_distinct(F.concat(terms, query_tags(query)))).otherwise(combined_terms(salient_terms(query), query_tags(query), query))
    return F.struct(F.concat(F.array(query), F.slice(others, 1, most)).alias("queries"), found.alias("terms"))


def fenced_json(reply: Column, schema: str) -> Column:
    """The JSON in a reply's first code fence, or the reply itself, by ``schema``; null if it can't be read."""
    fence = r"(?s)```(?:json)?\s*(.*?)```"
    return F.from_json(F.when(reply.rlike(fence), F.regexp_extract(reply, fence, 1)).otherwise(reply), schema)


def same_model(a: Column, b: Column) -> Column:
    """Equal names, names of the nomic embedder, and the two names of one hosted model; null and empty ones are never the same."""
    both = lambda name: F.contains(a, F.lit(name)) & F.contains(b, F.lit(name))
    alias = F.array_sort(F.array(a, b)) == F.array(F.lit("cohereai"), F.lit("small"))
    return F.coalesce((a != "") & (b != "") & (both("nomic-embed-text") | alias | (a == b)), F.lit(False))


def model_name(key: Column) -> Column:
    return F.element_at(F.split(key, r"\|"), 1)


# The keys next to each letter's on a keyboard.
NEXT_KEYS = {"a": "sqwz", "b": "vghn", "c": "xdfv", "d": "serfcx", "e": "wrds", "f": "drtgvc", "g": "ftyhbv", "h": "gyujnb", "i": "uokj", "j": "huikmn", "k": "jiolm", "l": "kop", "m": "njk", "n": "bhjm", "o": "iplk", "p": "ol", "q": "wa", "r": "etfd", "s": "awedxz", "t": "rygf", "u": "yijh", "v": "cfgb", "w": "qesa", "x": "zsdc", "y": "tuhg", "z": "asx"}


def term_variants(term: Column, most: int = 10) -> Column:
    """Spellings of a term: its cases, joined words, singular or plural, and then one letter replaced by one on a key next to it, ``most`` in all."""
    low = F.lower(term)
    big = lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))
    words = F.split(low, r"[\s_-]+")
    pascal = F.array_join(F.transform(words, big), "")
    camel = F.concat(words[0], F.array_join(F.transform(F.slice(words, F.lit(2), F.size(words)), big), ""))
    some = F.when(low.rlike(r"[ _-]") & (F.size(words) > 1), F.array(camel, pascal)).otherwise(F.array().cast("array<string>"))
    ends = F.when(F.endswith(low, F.lit("s")), F.array(F.left(low, F.length(low) - 1))).when(F.endswith(low, F.lit("y")), F.array(F.concat(low, F.lit("s")), F.concat(F.left(low, F.length(low) - 1), F.lit("ies")))).otherwise(F.array(F.concat(low, F.lit("s"))))
    keys = F.create_map(*(F.lit(x) for kv in NEXT_KEYS.items() for x in kv))
    at = F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1)))
    near = lambda i: F.filter(F.split(F.coalesce(F.try_element_at(keys, F.substr(low, i, F.lit(1))), F.lit("")), ""), lambda c: c != "")
    swapped = F.flatten(F.transform(at, lambda i: F.transform(near(i), lambda c: F.concat(F.left(low, i - 1), c, F.substr(low, i + 1)))))
    return F.slice(F.array_distinct(F.concat(F.array(term, low, F.upper(term), big(low)), some, ends, swapped)), 1, most)


_CITATION = r"^\[\^?\d+(?:\s*,\s*\^?\d+)*\]$"


def _by_citation(content: Column) -> Column:
    """The text in pieces, of which each citation is one."""
    return F.split(content, r"(?<=\])|(?=\[\^?\d)")


def _numbers(piece: Column) -> Column:
    return F.transform(F.regexp_extract_all(piece, F.lit(r"\d+"), F.lit(0)), lambda n: n.cast("int"))


def _cited(numbers: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(numbers, lambda n: n.cast("string")), ", "), F.lit("]"))


def has_citations(content: Column, inline: bool = False) -> Column:
    """Whether a text has marks [^n] in it or, unless ``inline``, a section of sources or definitions of marks."""
    if inline:
        return content.rlike(r"\[\^\d+\]")
    return content.rlike(r"(?i)(?:^|\n)\s*#{1,6}\s*Sources\b|(?:^|\n)\s*Sources\s*(?:[:-]\s*)?(?:\n|$)|<summary[^>]*>\s*Sources\s*</summary>") | content.rlike(r"(?:^|\n)\s*\[\^\d+\]:\s*")


def sources_section(content: Column) -> Column:
    """struct(main, sources): what follows a line Sources, or a rule or blank line if it holds definitions of marks and nothing else; null if there is none."""
    named = r"(?is)^(.*?)\n+(?:####\s*)?Sources\s*:?\s*\n+(.*)$"
    only = r"\s*(?:\[\^\d+\]:[^\n]*\s*)+"
    ruled, bare = rf"(?s)^(.*?)\n+---+[^\S\n]*\n+({only})$", rf"(?s)^(.*?)\n{{2,}}({only})$"
    out = F.lit(None).cast("struct<main:string,sources:string>")
    for pattern in (bare, ruled, named):
        out = F.when(content.rlike(pattern), F.struct(F.regexp_extract(content, pattern, 1).alias("main"), F.regexp_replace(F.regexp_extract(content, pattern, 2), r"^\s+|\s+$", "").alias("sources"))).otherwise(out)
    return out


def citations_numbered(content: Column, numbers: Column) -> Column:
    """Marks [^n] and [^n, ^m] as [k] and [j, k] by a map of old to new numbers, in ascending order; others keep theirs. A point after [n] goes."""

    def piece(p):
        new = F.array_sort(F.transform(_numbers(p), lambda n: F.coalesce(F.try_element_at(numbers, n), n)))
        return F.when(p.rlike(_CITATION) & F.startswith(p, F.lit("[^")), _cited(new)).otherwise(p)

    return F.regexp_replace(F.array_join(F.transform(_by_citation(content), piece), ""), r"\[(\d+)\]\.", "[$1]")


def citations_consolidated(content: Column, numbers: Column) -> Column:
    """Numbers in [n, m] by a map of old to new ones, each once in a bracket."""

    def piece(p):
        new = F.array_distinct(F.transform(_numbers(p), lambda n: F.coalesce(F.try_element_at(numbers, n), n)))
        return F.when(p.rlike(_CITATION) & ~F.startswith(p, F.lit("[^")), _cited(new)).otherwise(p)

    return F.array_join(F.transform(_by_citation(content), piece), "")


def adjacent_citations_joined(content: Column) -> Column:
    """A bracket whose numbers are all in the one before it goes, with a comma, "and" or white space between them."""
    none = F.array().cast("array<int>")
    state = lambda out, held, last, gap: F.struct(out.alias("out"), held.alias("held"), last.alias("last"), gap.alias("gap"))

    def step(s, p):
        cited = p.rlike(_CITATION) & ~F.startswith(p, F.lit("[^"))
        again = (F.size(s["last"]) > 0) & s["gap"].rlike(r"^(?:\s*(?:and|,)\s*|\s*)$") & (F.size(F.array_except(_numbers(p), s["last"])) == 0)
        opened = state(F.concat(s["out"], s["held"], s["gap"]), p, _numbers(p), F.lit(""))
        return F.when(cited & again, state(s["out"], _cited(F.array_distinct(s["last"])), s["last"], F.lit(""))).when(cited, opened).otherwise(state(s["out"], s["held"], s["last"], F.concat(s["gap"], p)))

    return F.aggregate(_by_citation(content), state(F.lit(""), F.lit(""), none, F.lit("")), step, lambda s: F.concat(s["out"], s["held"], s["gap"]))


def footnote_items(sources: Column, numbers: Column) -> Column:
    """array of struct(number, item) of the definitions of marks, in the order of their new numbers: links as anchors (torn ones too), notes as [[a]], others without a last bracket."""
    lines = F.filter(F.split(sources, "\n"), lambda x: x.rlike(r"^\[\^\d+\]:"))

    def item(x):
        n, t = F.regexp_extract(x, r"^\[\^(\d+)\]:", 1).cast("int"), F.regexp_replace(x, r"^\[\^\d+\]:\s*", "")
        part = lambda pattern, g: F.regexp_extract(t, pattern, g)
        anchor = lambda url, label: F.concat(F.lit('<a href="'), url, F.lit('">'), label, F.lit("</a>"))
        link, note, torn = r"\[([^\]]+)\]\(([^)]+)\)", r"\[\[(.*?)\]\]", r"^(.*?)\]\s*\(([^)]+)\)\s*$"
        shown = F.when(t.rlike(link), anchor(part(link, 2), part(link, 1))).when(t.rlike(note), F.concat(F.lit("[["), part(note, 1), F.lit("]]"))).when(t.rlike(torn), anchor(F.trim(part(torn, 2)), F.trim(part(torn, 1)))).otherwise(F.regexp_replace(t, r"\s*\([^)]*\)\s*$", ""))
        return F.struct(F.coalesce(F.try_element_at(numbers, n), n).alias("number"), shown.alias("item"))

    return F.array_sort(F.transform(lines, item))


def block_compacted(block: Column, tag: Column, limit: int = 5000, preview: int = 500, sections: int = 20) -> Column:
    """A long block whose source can be read again as its sections' starts under its source; all others as they are."""
    kept = [t for t in CONTEXT_BLOCKS if t in ("selected_text", "web_selected_text")]
    short = sections_compacted(block_content(block), preview, sections, 0)
    wrapped = F.concat(F.lit('<prior_context source="'), xml_escape(block_source(block, tag)), F.lit('">\n'), short, F.lit("\n</prior_context>"))
    return F.when(tag.isin(kept) | ~tag.isin(list(CONTEXT_BLOCKS)) | (F.length(block) <= limit), block).otherwise(wrapped)


def list_markdown(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.array_join(F.transform(values, lambda v: F.concat(F.lit("- "), F.coalesce(v, F.lit("")))), "\n")).otherwise("No results")


def tasks_markdown(tasks: Column) -> Column:
    """tasks: array of struct(done, text)."""
    line = lambda t: F.concat(F.when(t["done"], "- [x] ").otherwise("- [ ] "), F.coalesce(t["text"], F.lit("")))
    return F.when(F.size(tasks) > 0, F.array_join(F.transform(tasks, line), "\n")).otherwise("No results")


def rows_markdown(headers: Column, rows: Column) -> Column:
    """rows: array of arrays of strings."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | "), F.lit(" |\n"))
    body = F.array_join(F.transform(rows, line), "")
    return F.when(F.size(rows) > 0, F.concat(line(headers), line(F.transform(headers, lambda h: F.lit("---"))), body)).otherwise("No results")


def template_links(text: Column) -> Column:
    """The names in {[[name]]}, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\{\[\[([^\]]+)\]\]\}"), F.lit(1)))


def frontmatter(text: Column) -> Column:
    """What lies between the --- lines that a text begins with; empty if it doesn't."""
    return F.regexp_extract(text, r"(?s)^---[^\S\n]*\r?\n(.*?\n)?---[^\S\n]*(?:\r?\n|$)", 1)


def _listed(value: Column, below: Column) -> Column:
    """The items of a value [a, b], of a scalar, or of the - lines below."""
    clean = lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", "")
    inside = F.regexp_replace(F.regexp_replace(F.trim(value), r"^\[", ""), r"\]$", "")
    dashes = F.regexp_extract_all(below, F.lit(r"(?m)^\s*-\s+(.*)$"), F.lit(1))
    items = F.when(F.startswith(F.trim(value), F.lit("[")), F.split(inside, ",")).when(F.trim(value) != "", F.array(value)).otherwise(dashes)
    return F.filter(F.transform(items, clean), lambda x: x != "")


def markdown_tags(text: Column) -> Column:
    """Tags of the frontmatter (in brackets, as one value, or in - lines) and of the text, in lower case with a #, each once."""
    held = r"(?m)^tags:[^\S\n]*([^\n]*)\n?((?:\s*-\s+[^\n]*\n?)*)"
    front = frontmatter(text)
    body = F.substr(text, F.when(front != "", F.length(front) + 8).otherwise(1))
    own = _listed(F.regexp_extract(front, held, 1), F.regexp_extract(front, held, 2))
    inline = F.regexp_extract_all(body, F.lit(r"(?<!\w)#[\p{L}\p{N}_/-]+"), F.lit(0))
    return F.array_distinct(F.transform(F.concat(own, inline), lambda t: F.concat(F.lit("#"), F.lower(F.regexp_replace(t, "^#+", "")))))


def frontmatter_values(text: Column, most: int = 10) -> Column:
    """The scalars of the frontmatter and up to ``most`` items of each of its lists, as texts; nested objects are left out."""
    entries = F.regexp_extract_all(frontmatter(text), F.lit(r"(?m)^[A-Za-z_][\w -]*:[^\S\n]*(?:[^\n]*)(?:\n[^\S\n]*-[^\S\n]+[^\n]*)*"), F.lit(0))
    first = lambda e: F.regexp_extract(e, r"^[^:\n]+:[^\S\n]*([^\n]*)", 1)
    plain = F.filter(entries, lambda e: ~F.startswith(first(e), F.lit("{")))
    return F.flatten(F.transform(plain, lambda e: F.slice(_listed(first(e), F.regexp_replace(e, r"^[^\n]*\n?", "")), 1, most)))


def transcript_file(title: Column, video: Column) -> Column:
    """A transcript's file name: the title without characters that names can't have, 120 at most, and the video's id."""
    clean = F.trim(F.left(F.regexp_replace(F.regexp_replace(F.trim(title), r'[<>:"/\\|?*]', "-"), r"\s+", " "), F.lit(120)))
    return F.concat(F.when(clean != "", clean).otherwise("Transcript"), F.lit(" - "), video)


def transcript_note(title: Column, video: Column, url: Column, transcript: Column, details: dict[str, Column], summary: Column | None = None) -> Column:
    """A transcript as a note: frontmatter with its details (null ones left out), a mark of its source, the summary if there is one, the text."""
    quoted = lambda c: F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    entry = lambda k, c: F.concat(F.lit(f'{k}: "'), quoted(c), F.lit('"'))
    front = F.concat_ws("\n", F.lit("---"), entry("title", title), entry("videoId", video), entry("sourceUrl", url), *(entry(k, c) for k, c in details.items()), F.lit("---"))
    parts = [F.concat(F.lit("# "), title), F.concat(F.lit("Source: "), url)]
    if summary is not None:
        parts.append(F.when(F.trim(summary) != "", F.concat(F.lit("## Summary\n\n"), F.trim(summary))))
    return F.concat(front, F.lit("\n<!-- source: "), url, F.lit(" -->\n"), F.concat_ws("\n\n", *parts, F.lit("## Transcript"), transcript), F.lit("\n"))


def balanced_json(text: Column) -> Column:
    """The first {...} of a text whose braces, outside its strings, are balanced; null if there is none."""
    def first(t: str | None) -> str | None:
        start = (t or "").find("{")
        while t and start >= 0:
            depth, quoted, at = 0, False, start
            while at < len(t):
                c = t[at]
                if quoted and c == "\\":
                    at += 1
                elif c == '"':
                    quoted = not quoted
                elif not quoted and c in "{}":
                    depth += 1 if c == "{" else -1
                    if not depth:
                        return t[start : at + 1]
                at += 1
            start = t.find("{", start + 1)
        return None

    @F.pandas_udf("string")
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(first)

    return find(text)


def frontmatter_properties(text: Column) -> Column:
    """Map of the frontmatter's entries to their items, joined by a comma and a space; the last of repeated names counts."""
    entries = F.regexp_extract_all(frontmatter(text), F.lit(r"(?m)^[A-Za-z_][\w -]*:[^\S\n]*(?:[^\n]*)(?:\n[^\S\n]*-[^\S\n]+[^\n]*)*"), F.lit(0))
    first = lambda e: F.regexp_extract(e, r"^[^:\n]+:[^\S\n]*([^\n]*)", 1)
    name = lambda e: F.trim(F.regexp_extract(e, "^([^:\n]+):", 1))
    value = lambda e: F.array_join(_listed(first(e), F.regexp_replace(e, r"^[^\n]*\n?", "")), ", ")
    kept = F.filter(entries, lambda e, i: F.size(F.filter(F.slice(entries, i + 2, F.size(entries)), lambda o: name(o) == name(e))) == 0)
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(name(e), value(e))))
