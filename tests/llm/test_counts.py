"""Token counts, the filter audit and collocations against the libraries and plain calculations."""

import collections
import itertools
import random
import re

from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm import collocations, filter_audit, token_counts
from corpusloom.llm.queries import TOKENIZERS

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORD_BPE = f"{TOKENIZERS}/word_bpe_49k.json"
ODDITIES = ["", None, " ", "Don't STOP!! we're 12345 l'été", "ﬁne ÉTÉ été İstanbul KK", "a<|endoftext|>b <|startoftext|>", "tab\tnew\nline\x1c\x85 end", "你好 мир house,house", "x" * 5000, "the  of   and\xa0so", "0" * 300 + "</w> w</w>"]


def docs_of(spark, texts, sources=("s",), ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", sources[k % len(sources)], None) for k, (i, t) in enumerate(zip(ids, texts))], DOC)


# --- token counts


def test_token_counts_are_the_library_s(spark):
    r = random.Random(4)
    alphabet = list("abcdefgh ABC.,'!?-0123\n\t éßÜ中") + [" the", " of", "house", "'s", "</w>"]
    texts = ODDITIES + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 200))) for _ in range(1500)]
    lib = Tokenizer.from_file(WORD_BPE)
    got = {x["doc_id"]: x for x in token_counts.count_tokens(docs_of(spark, texts).withColumn("n_tokens", F.lit("clash")), WORD_BPE, limit=100).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 100), t


def test_token_counts_of_a_byte_level_tokenizer(spark):
    path = f"{TOKENIZERS}/byte_bpe_50k.json"
    lib = Tokenizer.from_file(path)
    got = {x["doc_id"]: x["n_tokens"] for x in token_counts.count_tokens(docs_of(spark, ODDITIES), path, keeps_space=True).collect()}
    assert got == {i: len(lib.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(ODDITIES)}


def test_proven_strings_are_one_token_and_need_no_merging():
    lib, whole = Tokenizer.from_file(WORD_BPE), token_counts.whole_tokens(WORD_BPE)
    assert len(whole) > 20_000 and "the" in whole and "house" in whole
    assert all(len(e.ids) == 1 for e in lib.encode_batch(whole, add_special_tokens=False))
    held = token_counts.Counts(WORD_BPE, False, whole)
    assert held.count("The house, the HOUSE of the river.") == 9 and held.merged == 0
    assert held.count("zqxjzq") == len(lib.encode("zqxjzq", add_special_tokens=False).ids) and held.merged == 1


def test_token_counts_of_long_texts_repeated_rows_null_ids_and_nothing(spark):
    text = "Lorem ipsum, the house of 12 rivers. " * 40_000
    n = len(Tokenizer.from_file(WORD_BPE).encode(text, add_special_tokens=False).ids)
    got = sorted((x["doc_id"] or -1, x["n_tokens"]) for x in token_counts.count_tokens(docs_of(spark, [text, "the", "the"], ids=[7, None, None]), WORD_BPE).collect())
    assert got == [(-1, 1), (-1, 1), (7, n)]
    assert token_counts.count_tokens(docs_of(spark, ["x"]).limit(0), WORD_BPE).count() == 0


# --- filter audit


def plain_audit(rows, labels):
    """rows: (doc_id, text, source)."""
    word, least = re.compile(r"[^\x20\x09-\x0D]+"), {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    fails = []
    for i, t, s in rows:
        t = t or ""
        w = word.findall(t)
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and least[t] < i}
        own = [x for x in labels if i is not None and x[0] == i]
        fails.append((s or "", {k for k in f if f[k]}, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out, shapley = {}, collections.Counter()
    for part in {s for s, *_ in fails}:
        for order in itertools.permutations("ABCDE"):
            left = [x for x in fails if x[0] == part]
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[part, f] += len(gone)
                all_f = sum(f in x[1] for x in fails if x[0] == part)
                out[part, "".join(order), k + 1] = [len(left), len(gone), all_f - len(gone), sum(x[1] == {f} for x in fails if x[0] == part), sum(x[2] for x in gone), sum(x[3] for x in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(df):
    return {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in df.collect()}


LABELS = "doc_id long, quality int, toxic int, text string"


def test_filter_audit_equals_a_plain_calculation(spark):
    r = random.Random(9)
    words = [f"w{i}" for i in range(300)] + ["UP", "A#", "x|y", "CAPS"]
    texts = [None, "", "same text", "\x0b\x1c   word"]
    for _ in range(250):
        pool = words[: r.choice([20, 304])]
        texts.append(" ".join(r.choice(pool) for _ in range(r.choice([10, 49, 50, 51, 80, 200]))))
    texts += [r.choice(texts) for _ in range(120)]
    rows = [(r.choice([i, i, i, r.randint(0, 400), None]), t, r.choice(["a", "b", "", None, "ß"])) for i, t in enumerate(texts)]
    rows += rows[:40]
    labels = [(r.choice([r.randint(0, 400), None]), r.choice([0, 1, None]), r.choice([0, 1, None]), "clash") for _ in range(300)]
    docs = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], DOC).withColumn("part", F.lit("clash")).withColumn("hash", F.lit(0))
    assert audited(filter_audit.audit(docs, spark.createDataFrame(labels, LABELS))) == plain_audit(rows, labels)


def test_filter_audit_deals_a_hot_text_and_takes_long_ones(spark):
    rows = [(i, "hot", "a") for i in range(3000)] + [(5000 + i, "word " * 200_000 + str(i % 2), "b") for i in range(4)]
    docs = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], DOC)
    marks = filter_audit._rows(docs).select("doc_id", "part", "hash")
    assert filter_audit.repeated_ids(docs, marks, deal=100, small=0).count() == 2999 + 2
    assert audited(filter_audit.audit(docs, spark.createDataFrame([], LABELS))) == plain_audit(rows, [])


def test_filter_audit_of_nothing(spark):
    assert filter_audit.audit(docs_of(spark, ["x"]).limit(0), spark.createDataFrame([], LABELS)).count() == 0


# --- collocations


def plain_collocations(rows, top, least):
    """rows: (text, lang)."""
    n, f = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in (1, 2, 3, 4):
                for i in range(len(words) - m + 1):
                    f[lang, *words[i : i + m]] += 1
    longest = collections.Counter()
    for (lang, *w), a in f.items():
        if a >= least and len(w) > 2:
            for m in range(2, len(w)):
                for i in range(len(w) - m + 1):
                    longest[lang, *w[i : i + m]] = max(a, longest[lang, *w[i : i + m]])
    found = collections.defaultdict(list)
    for (lang, *w), a in f.items():
        if a >= least and len(w) > 1 and 100 * longest[lang, *w] < 80 * a:
            s, _, l, r = min((2_000_000 * a // (f[lang, *w[:k]] + f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w)))
            found[lang].append((-s, -a, " ".join(w).encode(), l, r))
    return {(lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, x in found.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top], 1)}


def mined(df):
    rows = [tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def phrases_of(r, words):
    out = []
    for _ in range(r.randint(3, 12)):
        out += r.choice([[r.choice(words)], ["new", "York", "city"], ["state", "of", "the", "art"], ["as", "well", "as"], ["a", "b", "a", "b"], [r.choice(words), "of"]])
        out.append(r.choice(["", "", "", ",", ". ", "\n", "\x0b", "\t"]))
    return r.choice([" ", "  "]).join(out)


def test_collocations_equal_a_plain_calculation(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["état", "ÉTAT", "\x1cx", "<b>", "Ünter"]
    rows = [(phrases_of(r, words), r.choice(["en", "en", "en", "de", None, "und", ""])) for _ in range(500)] + [(None, "en"), ("", None), ("x" * 20_000, "de")]
    docs = spark.createDataFrame([(i, t, lang, "s", 1) for i, (t, lang) in enumerate(rows)], DOC).withColumn("phrase", F.lit("clash")).withColumn("words", F.lit(1)).repartition(3)
    for top, least, options in ((15, 3, {"block_words": 200}), (8, 2, {"reach": 0.2, "filter_bits": 64})):
        assert mined(collocations.collocations(docs, top, least, **options)) == plain_collocations(rows, top, least), (top, least)


def test_collocations_settle_ties_and_prune(spark):
    rows = [(f"p{i} q{i}. p{i} q{i}", "en") for i in range(30)] + [("far away. far away. far. away", "en")] * 5 + [("rare pair", "en")] + [(f"common z{i}", "en") for i in range(40) for _ in range(3)]
    docs = spark.createDataFrame([(i, t, lang, "s", 1) for i, (t, lang) in enumerate(rows)], DOC)
    got = mined(collocations.collocations(docs, 12, 2))
    assert got == plain_collocations(rows, 12, 2) and {x[7] for x in got} == {1_000_000}
    coded, often, _ = collocations.code_corpus(docs, 2, 1 << 18, 1 << 16)
    assert collocations.scan(coded, often, None, 2, 1 << 16).count() == 71
    marks = spark.createDataFrame([("right", "en", "p1 q1"), ("left", "en", "p2 q2"), ("count", "en", "p3 q3"), ("count", "de", "p4 q4")], "kind string, lang string, phrase string")
    assert [(x["phrase"], x["len"], x["f"]) for x in collocations.scan(coded, often, marks, 2, 1 << 16).collect()] == [("p3 q3", 2, 2)]  # nothing extends the other two


def test_collocation_scores_pass_64_bits(spark):
    a, l, r = 9 * 10**15, 10**16, 9 * 10**15 + 7
    got = spark.createDataFrame([(a, l, r), (30, 30, 30), (30, 31, 30)], "a long, l long, r long").select(collocations.score_of(F.col("a"), F.col("l"), F.col("r"))).collect()
    assert [x[0] for x in got] == [2_000_000 * a // (l + r), 1_000_000, 60_000_000 // 61]


def test_collocations_of_long_texts_hot_languages_and_nothing(spark):
    text = "alpha beta gamma delta " * 60_000
    docs = docs_of(spark, [text, text.replace(" ", ". ")])
    assert {x[2] for x in mined(collocations.collocations(docs, 10, 30))} == {"alpha beta gamma delta", "beta gamma delta alpha", "delta alpha beta gamma", "gamma delta alpha beta"}
    assert collocations.collocations(docs.limit(0)).count() == 0
    assert collocations.collocations(docs_of(spark, ["too few words", None])).count() == 0
