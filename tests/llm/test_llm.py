"""The training-data operators against brute force, round trips and held-out labels; edge cases of every input."""

import base64
import collections
import hashlib
import json
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm import compression_quality, exact_dedup, itq, langid, linking, mixing, ngram_join, packing, token_file, toxicity, warc
from corpusloom import tables
from corpusloom.llm.common import join_counted, new_folder, open_fs, range_shards, saved
from corpusloom.llm.pieces import pieces
from corpusloom.llm.queries import TOKENIZERS

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["un", "deux", "trois", "alpha", "beta", "gamma", "delta", "maison", "house", "tree", "river", "stone", "cloud", "night", "morning", "bread"]


def frame(spark, rows, schema=DOC):
    return spark.createDataFrame(rows, schema)


def docs_of(spark, texts, first=0):
    return frame(spark, [(first + i, t, "en", "s", None) for i, t in enumerate(texts)])


def sentence(r, n):
    return " ".join(r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(n))


# --- WARC


def test_warc_round_trip_with_nulls_copies_and_repeated_rows(spark):
    rows = [(1, "http://a", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://c", None), (4, "http://d", ""), (None, "http://n", "x"), (5, "http://e", "y" * 50_000), (2, None, "<p>é</p>")]
    out = new_folder(spark, "warc")
    files = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")), out, shard_bytes=2000, roll_bytes=300)
    got = [r.asDict() for r in warc.read_warc(spark, out).collect()]
    assert len(files) > 1 and sum(f["records"] for f in files) == len(got) == len(rows)
    of = collections.defaultdict(list)
    for g in got:
        of[g["page_id"]].append(g)
    assert of[1][0]["record_type"] == "revisit" and of[1][0]["refers_to"] == 2 and of[1][0]["payload_bytes"] == len("<p>é</p>".encode())
    assert sorted(g["record_type"] for g in of[2]) == ["response", "revisit"]
    assert of[3][0]["refers_to"] == 4 and of[4][0]["record_type"] == "response" and of[4][0]["payload"] == b""
    assert of[5][0]["payload_digest"] == base64.b32encode(hashlib.sha1(b"y" * 50_000).digest()).decode()
    again = new_folder(spark, "warc")
    assert [f["sha256"] for f in warc.write_warc(spark.createDataFrame(rows[::-1], "page_id long, url string, html string"), again, shard_bytes=2000, roll_bytes=300)] == [f["sha256"] for f in files]
    fs, base = open_fs(out)
    with fs.open_input_stream(f"{base}/manifest.json") as f:
        assert json.loads(f.read())["files"] == files


def test_warc_keeps_one_response_of_a_payload_without_ids(spark):
    rows = [(None, "http://a", "same"), (None, "http://b", "same"), (None, "http://a", "same"), (None, None, "other"), (3, "http://c", None), (None, "http://d", "")]
    out = new_folder(spark, "warc")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), out)
    got = collections.Counter((r["page_id"], r["record_type"], r["payload_bytes"], r["refers_to"]) for r in warc.read_warc(spark, out).collect())
    assert got == {(None, "response", 4, None): 1, (None, "revisit", 4, None): 2, (None, "response", 5, None): 1, (3, "response", 0, None): 1, (None, "revisit", 0, 3): 1}


def test_warc_of_nothing(spark):
    out = new_folder(spark, "warc")
    assert warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), out) == []
    assert warc.read_warc(spark, out).count() == 0


# --- tokens


@pytest.mark.parametrize(("name", "keeps"), [("byte_bpe_50k", True), ("word_bpe_49k", False)])
def test_pieces_equal_one_call_on_the_whole_text(name, keeps):
    p, fresh = pieces(f"{TOKENIZERS}/{name}.json", keeps), Tokenizer.from_file(f"{TOKENIZERS}/{name}.json")
    added = [t.content for t in fresh.get_added_tokens_decoder().values()]
    r = random.Random(2)
    texts = ["", " ", "  a  b\n\n c ", "it's WE'LL 'll x'd", "a\tb \t c\r\n d", "123 4567,foo1bar", "é́ ñ̃ ﬁ İ ΣΑΣ ß", "日本語 テスト。한국어", " x  y", "<|endoftext|> a", "a <|endoftext|> b", "x<|EndOfText|>", *(f"a {t}b" for t in added), *(f"É{t.upper()} c" for t in added), "\x1cx\x1d y\x85z", "x" * 400, "a|b%%% c&&&"]
    texts += ["".join(r.choice("aé B\n\t.,'1!|日́") for _ in range(r.randint(0, 60))) for _ in range(400)]
    for t in texts:
        assert p.encode(t).tolist() == fresh.encode(t, add_special_tokens=False).ids, repr(t)


def test_token_file_round_trip(spark):
    r = random.Random(1)
    rows = [(i, sentence(r, r.randint(0, 300)), "en", "s", 1) for i in range(60)] + [(60, None, None, None, None), (61, "", "en", "s", 0), (5, "again", "en", "s", 5)]
    out = new_folder(spark, "tokens")
    shards = token_file.write_tokens(frame(spark, rows).withColumn("shard", F.lit(9)), out, f"{TOKENIZERS}/byte_bpe_50k.json", seq_len=64, batch_rows=4, shard_bytes=20_000)
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids"], r["ids_crc32"]) for r in token_file.read_tokens(spark, out).collect()), key=lambda x: x[1])
    assert len(shards) > 1 and len(got) == len(rows)
    p, at = pieces(f"{TOKENIZERS}/byte_bpe_50k.json", True), 0
    for (doc, start, n, ids, crc), (i, t) in zip(got, sorted((x[0], x[1] or "") for x in rows), strict=True):
        want = [*p.tokenizer.encode(t, add_special_tokens=False).ids, 2]
        assert (doc, start, n, np.frombuffer(ids, "<u4").tolist(), crc) == (i, at, len(want), want, zlib.crc32(ids))
        at += n
    fs, base = open_fs(out)
    f = token_file.open_sequences(fs, f"{base}/{shards[0]['ids']}")
    assert f.schema.field("ids").type.list_size == 64 and f.get_batch(0).column("mask").type.list_size == 64
    assert not fs.get_file_info(f"{base}/tmp").is_file and fs.get_file_info(f"{base}/tmp").type.name == "NotFound"
    seq, stream = token_file.Sequences(out), []
    for i in range(len(seq)):
        ids, mask = seq[i]
        stream += ids[np.array(mask)].tolist()
    assert stream == [x for g in got for x in np.frombuffer(g[3], "<u4").tolist()]
    ids, mask = seq[len(seq) // 2]
    assert len(ids) == len(mask) == 64 and not ids.flags.owndata and not ids.flags.writeable
    assert any(lo <= ids.__array_interface__["data"][0] < hi for lo, hi in mapped(".arrow"))  # a view of the mapped file
    assert any(lo <= mask.buffers()[1].address < hi for lo, hi in mapped(".arrow"))
    with pytest.raises(IndexError):
        seq[len(seq)]


def mapped(suffix):
    with open("/proc/self/maps") as f:
        return [tuple(int(x, 16) for x in line.split()[0].split("-")) for line in f if line.rstrip().endswith(suffix)]


@pytest.mark.parametrize("keys", [[*range(2000), 1 << 60], [*range(1000), *range(1 << 50, (1 << 50) + 1000)], [None] * 700 + [7] * 700 + [*range(600)], [-(1 << 63), (1 << 63) - 1, *range(500)]])
def test_shards_hold_their_target_wherever_the_ids_lie(spark, keys):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key long, x long").withColumn("tie", F.xxhash64("x"))
    assign, weights = range_shards(rows.withColumn("weight", F.lit(10).cast("long")), 500)
    got = assign(rows).groupBy("shard").agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy("shard").collect()
    assert [10 * g["n"] for g in got] == weights and sum(weights) == 10 * len(keys)
    assert max(weights) <= 500 and len(weights) <= 4 * len(keys) // 50
    assert all(a["hi"] is None or a["hi"] <= b["lo"] for a, b in zip(got, got[1:], strict=False))


def test_packing_keeps_every_id_once(spark):
    r = random.Random(3)
    rows = [(i, sentence(r, r.choice([0, 1, 5, 60, 400, 1500])), "en", "s", 1) for i in range(80)] + [(80, None, None, None, None), (7, "again", "en", "s", 5)]
    got = packing.pack_documents(frame(spark, rows).withColumn("g", F.lit(1)), f"{TOKENIZERS}/word_bpe_49k.json", capacity=256, slack=16, group_bytes=20_000).collect()
    p = pieces(f"{TOKENIZERS}/word_bpe_49k.json", False)
    want = collections.Counter((i, tuple([*p.tokenizer.encode(t or "", add_special_tokens=False).ids, 1])) for i, t, *_ in rows)
    of = collections.defaultdict(dict)
    for x in got:
        if x["doc_id"] != 7:
            of[x["doc_id"]][x["start"]] = np.frombuffer(x["ids"], "<u4").tolist()
    for i, parts in of.items():
        assert want[i, tuple(v for _, ids in sorted(parts.items()) for v in ids)] == 1
    assert sum(x["length"] for x in got) == sum(len(k[1]) for k in want.elements())
    for held in (sorted((x["offset"], x["length"]) for x in got if x["sequence_id"] == s) for s in {x["sequence_id"] for x in got}):
        assert [o for o, _ in held] == np.cumsum([0, *(n for _, n in held)])[:-1].tolist()
        fill = sum(n for _, n in held)
        assert fill <= 256 and (256 - fill <= 16 or fill & (fill - 1) == 0)


def test_first_fit_by_tournament_equals_a_scan():
    r = random.Random(5)
    sizes = [r.randint(1, 100) for _ in range(300)]
    tree, free = packing.Tournament(len(sizes), 100), [100] * len(sizes)
    for s in sizes:
        want = next(i for i, f in enumerate(free) if f >= s)
        free[want] -= s
        assert tree.take(s)[0] == want


# --- near and exact copies


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((60, 32))
    v = [b + rng.standard_normal(32) * s for b in base for s in (0, 0.05, 0.12, 0.3)] + [base[0] + rng.standard_normal(32) * 0.1 for _ in range(300)]
    rows = [(i, [float(np.float32(a)) for a in x], i % 2) for i, x in enumerate(v)] + [(9000, rows_v := [1.0] * 32, 0), (9001, rows_v, 0), (9002, rows_v, 1), (9003, None, 0), (9004, [0.0] * 32, 0), (9005, [None] * 32, 0), (9006, [float("nan")] * 32, 0), (9007, [1.0], 0), (9008, rows_v, None), (None, [0.0, 1.0], 0), (None, [0.0, 1.0], 0), (9011, [0.0, 1.0], 5)]
    got = {r["vec_id"]: r for r in itq.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("uid", F.lit(1)), 0.93).collect()}
    good = [r for r in rows if r[1] and len(r[1]) == 32 and None not in r[1] and np.isfinite(r[1]).all() and any(r[1]) and r[2] is not None]
    x = np.array([r[1] for r in good], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in good])
    hit = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(hit, False)
    root = linking.roots(len(good), zip(*np.nonzero(hit), strict=True))
    for k, r in enumerate(good):
        assert (got[r[0]]["n_links"], got[r[0]]["component_id"]) == (hit[k].sum(), good[root[k]][0])
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(9003, 9009)) and len(got) == len(rows) - 1
    assert (got[None]["n_links"], got[None]["component_id"], got[9011]["n_links"]) == (1, None, 0)
    assert itq.near_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def spread_vectors(lengths):
    """Half of the vectors lie anywhere and half close together, where vectors at the threshold differ in far more bits; each has a partner just above it."""
    rng = np.random.default_rng(5)
    unit = lambda a: a / np.linalg.norm(a, axis=-1, keepdims=True)
    out = []
    for d in lengths:
        x = unit(rng.standard_normal((300, d)))
        x[150:] = unit(math.sqrt(0.8) * unit(np.ones(d)) + math.sqrt(0.2) * x[150:])
        y = rng.standard_normal(x.shape)
        y = unit(y - (y * x).sum(axis=1, keepdims=True) * x)
        out += [*x, *(0.935 * x + math.sqrt(1 - 0.935**2) * y)]
    return [(i, [float(np.float32(a)) for a in v], 0) for i, v in enumerate(out)]


def test_embeddings_find_pairs_of_uneven_spread_and_of_every_length(spark):
    rows = spread_vectors([64, 48])
    got = {r["vec_id"]: r for r in itq.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), 0.93).collect()}
    want = found = 0
    for d in (64, 48):
        ids = [r[0] for r in rows if len(r[1]) == d]
        x = np.array([r[1] for r in rows if len(r[1]) == d], np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        n = (x @ x.T >= 0.93).sum(axis=1) - 1
        want += n.sum()
        assert n.min() >= 1 and all(got[i]["n_links"] <= k for i, k in zip(ids, n, strict=True))
        found += sum(got[i]["n_links"] for i in ids)
    assert found >= 0.999 * want


def test_table_plan_meets_its_recall_or_fails():
    x = np.array([r[1] for r in spread_vectors([64])])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes, width, tables, most = itq.plan_tables(x, 0.93, 1_000_000, 0.999, 11)
    for a, b in itq.pairs_at(x, 0.93, 77):
        d = np.unpackbits(codes.encode(a) ^ codes.encode(b), axis=1)[:, : codes.bits]
        met = (d[:, : tables * width].reshape(len(d), tables, width).sum(axis=2) == 0).any(axis=1)
        assert (met & (d.sum(axis=1) <= most)).mean() >= 0.997
    assert itq.plan_tables(x, 0.0, 600, 0.999, 11, most_tables=1)[1:3] == (0, 1)
    assert itq.plan_tables(x, 0.0, 1_000_000, 0.999, 11, most_tables=1)[1:3] == (0, 1)


def test_labels_without_a_plan_are_compared_whole(spark, monkeypatch):
    r = np.random.default_rng(8)
    x = r.standard_normal((2600, 16)).astype(np.float32)
    x[2000:] = x[:600] + 0.1 * r.standard_normal((600, 16)).astype(np.float32)
    rows = [(i, v.tolist(), "hot" if i % 13 else "other") for i, v in enumerate(x)]
    monkeypatch.setattr(itq, "plan_tables", lambda sample, *a: (itq.fit_itq(sample, 1), 0, 1, 16))
    got = {g["vec_id"]: g["n_links"] for g in itq.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string"), 0.9).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    same = np.array([bool(i % 13) for i in range(len(x))])
    links = (unit @ unit.T >= 0.9) & (same[:, None] == same[None, :])
    assert got == {i: int(n) - 1 for i, n in enumerate(links.sum(axis=1))} and sum(got.values()) > 1000


def test_components_of_a_long_chain_and_a_star(spark):
    e = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 80)] + [(5, 5)]
    got = {r["uid"]: r["component"] for r in linking.components(spark.createDataFrame(e, "a long, b long").repartition(7)).collect()}
    assert {got[i] for i in range(1, 61)} == {1} and {got[i] for i in range(100, 180)} == {100}


def jaccard(a, b):
    sa, sb = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for t in (a or "", b or ""))
    return len(sa & sb) / len(sa | sb) if sa and sb else 0.0


def test_similar_documents_against_brute_force(spark):
    r = random.Random(8)
    texts = []
    for _ in range(25):
        words = sentence(r, r.choice([4, 8, 60, 200])).split()
        texts.append(" ".join(words))
        for k in (0, 1, 2, 6):
            w = list(words)
            for _ in range(k):
                w[r.randrange(len(w))] = "changed" + str(r.randint(0, 9))
            texts.append(" ".join(w))
    hot = sentence(r, 150).split()
    texts += [" ".join(hot[:i] + ["x"] + hot[i + 1 :]) for i in range(150)]
    texts += [None, "", "  ", "one", "ONE", texts[0] + " "]
    got = {x["doc_id"]: x for x in ngram_join.similar_documents(docs_of(spark, texts).withColumn("uid", F.lit(3)), 0.8).collect()}
    links = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8 - 1e-12]
    n = collections.Counter(x for e in links for x in e)
    root = linking.roots(len(texts), links)
    assert {i: (got[i]["n_links"], got[i]["class_id"]) for i in range(len(texts))} == {i: (n[i], root[i]) for i in range(len(texts))}
    assert sum(x["kept"] for x in got.values()) == len(set(root.tolist()))
    assert ngram_join.similar_documents(frame(spark, [])).count() == 0


def test_similar_documents_keep_one_of_repeated_rows(spark):
    rows = [(1, "a b c d e f", "en", "s", 1)] * 3 + [(1, "other words here now ok", "en", "s", 1)]
    got = ngram_join.similar_documents(frame(spark, rows)).collect()
    assert len(got) == 4 and sum(x["kept"] for x in got) == 2


def test_pruning_bound():
    assert ngram_join.fewest_matches(100, 0.8, 1e-4) < 80 < 100
    assert ngram_join.fewest_matches(25, 0.8, 1e-4) <= ngram_join.fewest_matches(50, 0.8, 1e-4)


def test_exact_dedup_wherever_the_line_is_drawn(spark):
    r = random.Random(6)
    texts = [r.choice(["a", "b", "", None, "é" * 5000, f"t{r.randint(0, 80)}"]) for _ in range(400)]
    d = docs_of(spark, texts).withColumn("digest", F.lit("clash"))
    groups = collections.defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    want = {i: (max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    for past in (exact_dedup.earlier_half(d), F.lit(True), F.lit(False), F.col("doc_id") % 3 == 0):
        got = {x["doc_id"]: (x["keep_id"], x["group_size"], x["kept"], x["text_sha256"]) for x in exact_dedup.exact_dedup(d, past, shard_digests=20).collect()}
        assert got == want
    assert exact_dedup.exact_dedup(frame(spark, []), F.lit(True)).count() == 0


def test_minimal_perfect_hash_is_a_permutation_and_refuses_strangers():
    for n in (1, 2, 3, 50, 3000):
        d = np.frombuffer(b"".join(hashlib.sha256(b"%d" % i).digest() for i in range(n)), np.uint8).reshape(-1, 32)
        seed, displacements, slots = exact_dedup.build_hash(d)
        assert sorted(slots.tolist()) == list(range(n))
        held = np.empty_like(d)
        held[slots] = d
        assert (exact_dedup.look_up(d, n, seed, displacements, held) == slots).all()
        other = np.frombuffer(hashlib.sha256(b"x").digest() * 2, np.uint8).reshape(-1, 32)
        assert (exact_dedup.look_up(other, n, seed, displacements, held) == -1).all()


# --- mixing


def test_mixing_reaches_targets_and_repeats_at_most_thrice(spark):
    r = random.Random(9)
    rows = [(i, sentence(r, r.randint(0, 40)), "en", s, 1) for i, s in enumerate(r.choices(["a", "b", "c", None, "tiny"], [60, 20, 10, 8, 2], k=400))] + [(1000, None, "en", "none", None), (1001, "w " * 5000, "en", "a", 1)]
    d = frame(spark, rows).withColumn("size", F.lit(1))
    got = {x["doc_id"]: x for x in mixing.mix(d, bucket_docs=16).collect()}
    assert all(x["taken"] <= 3 * x["size"] and x["taken"] == sum(y["words"] for y in x["taken_by"]) for x in got.values())
    for s in {x[3] for x in rows}:
        own = [got[x[0]] for x in rows if x[3] == s]
        assert abs(sum(x["taken"] for x in own) - own[0]["target"]) <= 1 and own[0]["target"] <= 3 * own[0]["source_size"]
    assert {k: v["taken"] for k, v in got.items()} == {x["doc_id"]: x["taken"] for x in mixing.mix(d.repartition(9), bucket_docs=16).collect()}
    assert mixing.mix(frame(spark, [])).count() == 0


def test_mixing_overlapping_sources(spark):
    rows = [(i, "w " * 10, ["x"] if i < 10 else ["x", "y"] if i < 40 else ["y", "z"] if i < 50 else []) for i in range(60)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, in array<string>"), F.col("in"), weights={"x": 1, "y": 2, "z": 2}).collect()
    taken = collections.Counter()
    for x in got:
        for y in x["taken_by"]:
            taken[y["source"]] += y["words"]
    assert taken == {"x": 100, "y": 200, "z": 200} and all(x["taken"] == 0 for x in got if x["doc_id"] >= 50)


def test_flow_prefers_fresh_text():
    f = mixing.min_cost_flow([(10, [0]), (10, [0, 1])], [10, 10], 3)
    assert f == [{0: 10}, {1: 10}]
    assert sum(mixing.min_cost_flow([(10, [0])], [25], 3)[0].values()) == 25


def plain_flow(supply: list[tuple[int, list[int]]], quotas: list[int], copies: int) -> list[dict[int, int]]:
    """One cheapest path after another."""
    n, m = len(supply), len(quotas)
    start, end = n + m, n + m + 1
    to, cap, cost, arcs = [], [], [], collections.defaultdict(list)

    def arc(a: int, b: int, c: int, w: int) -> int:
        for x, y, k, v in ((a, b, c, w), (b, a, 0, -w)):
            arcs[x].append(len(to))
            to.append(y)
            cap.append(k)
            cost.append(v)
        return len(to) - 2

    routes = []
    for i, (words, sources) in enumerate(supply):
        for k in range(copies):
            arc(start, i, words, k)
        routes.append({s: arc(i, n + s, words * copies, 0) for s in sources})
    for s, q in enumerate(quotas):
        arc(n + s, end, q, 0)
    while True:
        dist, via, queue, queued = {start: 0}, {}, collections.deque([start]), {start}
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for e in arcs[a]:
                if cap[e] and dist[a] + cost[e] < dist.get(to[e], 1 << 60):
                    dist[to[e]], via[to[e]] = dist[a] + cost[e], e
                    if to[e] not in queued:
                        queue.append(to[e])
                        queued.add(to[e])
        if end not in dist:
            return [{s: cap[e ^ 1] for s, e in r.items() if cap[e ^ 1]} for r in routes]
        path, at = [], end
        while at != start:
            path.append(via[at])
            at = to[via[at] ^ 1]
        least = min(cap[e] for e in path)
        for e in path:
            cap[e] -= least
            cap[e ^ 1] += least


def test_flow_is_as_large_and_cheap_as_path_by_path():
    r = random.Random(12)
    for _ in range(60):
        m, n = r.randint(1, 6), r.randint(1, 12)
        supply = [(r.randint(0, 30), sorted(r.sample(range(m), r.randint(0, m)))) for _ in range(n)]
        quotas = [r.randint(0, 90) for _ in range(m)]
        totals = []
        for flow in (mixing.min_cost_flow(supply, quotas, 3), plain_flow(supply, quotas, 3)):
            used = [sum(f.values()) for f in flow]
            assert all(u <= 3 * w and set(f) <= set(x) for u, f, (w, x) in zip(used, flow, supply, strict=True))
            assert all(sum(f.get(s, 0) for f in flow) <= q for s, q in enumerate(quotas))
            totals.append((sum(used), sum(max(0, u - k * w) for u, (w, _) in zip(used, supply, strict=True) for k in (1, 2))))
        assert totals[0] == totals[1]


def test_flow_of_many_sets():
    r = random.Random(1)
    supply = [(r.randint(1, 10**6), sorted(r.sample(range(20), r.randint(1, 8)))) for _ in range(50_000)]
    total = sum(w for w, _ in supply)
    quotas = [total * 2 * (s + 1) // (20 * 21) for s in range(20)]
    flow = mixing.min_cost_flow(supply, quotas, 3)
    assert sum(sum(f.values()) for f in flow) == sum(quotas)


# --- classifiers


def test_quality_on_held_out_texts(spark):
    r = random.Random(4)
    good = [sentence(r, 80) for _ in range(150)]
    bad = [" ".join(w.upper() + "!!" for w in sentence(r, 80).split()) for _ in range(150)]
    labelled = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate([(t, 1) for t in good[:100]] + [(t, 0) for t in bad[:100]])], "doc_id long, text string, quality int")
    model = compression_quality.fit_quality(labelled)
    got = [x["predicted"] for x in compression_quality.score_quality(docs_of(spark, [*good[100:], *bad[100:], "", None]).withColumn("score", F.lit(0)), model).orderBy("doc_id").collect()]
    assert sum(a == b for a, b in zip(got, [1] * 50 + [0] * 50, strict=False)) >= 97 and len(got) == 102
    assert {x["score"] for x in compression_quality.score_quality(docs_of(spark, ["a"]), compression_quality.fit_quality(labelled.limit(0))).collect()} == {0.5}


def test_toxicity_grades_rise_and_clean_texts_stay(spark):
    r = random.Random(7)
    bad = ["nasty", "vile", "rotten"]
    texts = [(sentence(r, 60) + (" " + " ".join(r.choice(bad) for _ in range(k)) if (k := r.choice([0, 0, 1, 4, 9])) else ""), int(k > 0)) for _ in range(400)]
    model = toxicity.fit_toxicity(spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(texts[:300])], "doc_id long, text string, toxic int"))
    assert model.thresholds == sorted(model.thresholds)
    got = toxicity.score_toxicity(docs_of(spark, [*(t for t, _ in texts[300:]), "", None, "vile", "vile " * 20]), model).orderBy("doc_id").collect()
    assert sum(x["predicted"] == y for x, (_, y) in zip(got, texts[300:], strict=False)) >= 97
    assert got[100]["predicted"] == got[101]["predicted"] == 0 and got[103]["expected_severity"] > got[102]["expected_severity"] > got[100]["expected_severity"]
    assert toxicity.fit_ordinal([]).probabilities("x") == [1.0]


def test_languages_on_held_out_texts(spark):
    en = "the and of house is with for this that river night stone".split()
    fr = "le la les des maison est avec pour cette rivière nuit pierre".split()
    r = random.Random(3)
    make = lambda w: " ".join(r.choice(w) for _ in range(30))
    rows = [(i, make(en if i % 2 else fr), "en" if i % 2 else "fr", "s", 1) for i in range(200)]
    model = langid.fit_languages(frame(spark, rows[:120]))
    got = langid.predict_language(frame(spark, [*rows[120:], (900, None, "en", "s", 0), (901, "123 -- !", "en", "s", 0), (902, "日本語のテキスト", None, None, 0), (903, "", "fr", "s", 0)]).withColumn("score", F.lit("x")), model).orderBy("doc_id").collect()
    assert all(x["lang_pred"] == y[2] and not x["rejected"] for x, y in zip(got, rows[120:], strict=False))
    assert [(x["lang_pred"], x["rejected"]) for x in got[-4:]][::3] == [("und", True), ("und", True)] and got[-3]["lang_pred"] == "und" and got[-2]["rejected"]
    assert {x["lang_pred"] for x in langid.predict_language(frame(spark, rows[:3]), langid.fit_languages(frame(spark, []))).collect()} == {"und"}


# --- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    r = random.Random(12)
    texts = [sentence(r, r.randint(30, 120)) for _ in range(60)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    rows += [(100, texts[0], "en", "s0", 1), (101, texts[1] + " end", "en", "s1", 1), (102, "12345", None, None, 5), (103, None, None, None, None), rows[2]]
    docs = frame(spark, rows)
    ids = lambda d: sorted(x["doc_id"] for x in d.select("doc_id").collect())
    a = p.language(spark, docs, "")
    assert a.columns == docs.columns and not {102, 103} & set(ids(a))
    b = p.exact_copies(spark, a, "")
    assert ids(b) == sorted({*range(1, 60), 100, 101} & set(ids(a)))
    c = p.near_copies(spark, b, "")
    assert ids(c) == [i for i in ids(b) if i != 101]
    m = p.mixture(spark, c, "")
    want = {x["doc_id"]: int(x["taken"] / x["size"] + 0.5) for x in mixing.mix(c).collect() if x["size"]}
    assert m.columns == docs.columns and collections.Counter(ids(m)) == collections.Counter({i: n for i, n in want.items() if n})
    assert {(x["doc_id"], x["text"], x["n_chars"]) for x in m.collect()} <= {(x[0], x[1], x[4]) for x in rows}
    e = p.packed(spark, m, "")
    enc = pieces(f"{TOKENIZERS}/word_bpe_49k.json", False)
    assert e.agg(F.sum("length")).first()[0] == sum(len(enc.encode(x["text"])) + 1 for x in m.collect())


CLASHES = ["size", "taken", "key", "_sha", "_key", "_id", "_gone", "h", "label", "c0", "n", "count", "copies", "copy", "number", "shard", "tie", "cell", "digest", "uid", "text_key", "text_", "rejected", "Dropped_Id"]


def test_pipeline_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline as p

    r = random.Random(13)
    rows = [(i, sentence(r, r.randint(30, 60)), "en", f"s{i % 2}", 9) for i in range(12)]
    rows += [(20, rows[0][1], "en", "s0", 9), (None, rows[1][1] + " end", "en", None, 9), rows[3], (3, rows[3][1], "en", "s1", 8), (21, "", "en", "s1", 0), (22, None, "en", "s1", None)]
    docs = frame(spark, rows)
    for k, c in enumerate(CLASHES):
        docs = docs.withColumn(c, F.concat(F.lit(f"{k} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        for x in out.collect():
            assert [x[c] for c in CLASHES] == [f"{k} {'none' if x['doc_id'] is None else x['doc_id']}" for k in range(len(CLASHES))], name
        assert stage(spark, docs.limit(0), "").count() == 0, name
    assert p.packed(spark, docs, "").count() >= len(rows) and p.packed(spark, docs.limit(0), "").count() == 0
    kept = p.exact_copies(spark, docs, "").select("doc_id", "text").collect()
    assert collections.Counter(x["doc_id"] for x in kept) == collections.Counter([*range(1, 12), 20, None, 22])
    kept = p.near_copies(spark, docs, "")
    assert sorted(str(x["doc_id"]) for x in kept.select("doc_id").collect()) == sorted(map(str, [0, None, *range(2, 12), 21, 22]))


def test_mixture_of_repeated_rows_takes_each_once(spark):
    import corpus_pipeline as p

    docs = frame(spark, [(1, "a b c d", "en", "s", 7)] * 5 + [(2, "e f g h", "en", "t", 7)] * 5)
    want = sum(int(x["taken"] / x["size"] + 0.5) for x in mixing.mix(docs).collect())
    assert p.mixture(spark, docs, "").count() == want


def test_empty_tables(spark):
    none = frame(spark, [])
    assert token_file.write_tokens(none, new_folder(spark, "t"), f"{TOKENIZERS}/byte_bpe_50k.json") == []
    assert packing.pack_documents(none, f"{TOKENIZERS}/word_bpe_49k.json").count() == 0
    labelled = spark.createDataFrame([(i, "good text here" if i % 2 else "BAD!! TEXT!!", i % 2) for i in range(40)], "doc_id long, text string, label int")
    assert compression_quality.score_quality(none, compression_quality.fit_quality(labelled, "label")).count() == 0
    assert toxicity.score_toxicity(none, toxicity.fit_toxicity(labelled, "label")).count() == 0
    assert langid.predict_language(none, langid.fit_languages(labelled.select("doc_id", "text", F.lit("en").alias("lang")))).count() == 0


def test_texts_of_ten_megabytes(spark):
    r = random.Random(1)
    long = " ".join(r.choice(WORDS) for _ in range(1_800_000))
    docs = docs_of(spark, [long, long, "short text", None])
    assert [x["class_id"] for x in ngram_join.similar_documents(docs).orderBy("doc_id").collect()] == [0, 0, 2, 3]
    assert [x["keep_id"] for x in exact_dedup.exact_dedup(docs, F.lit(True)).orderBy("doc_id").collect()] == [1, 1, 2, 3]
    enc = Tokenizer.from_file(f"{TOKENIZERS}/word_bpe_49k.json")
    n = len(enc.encode(long, add_special_tokens=False).ids) + 1
    assert packing.pack_documents(docs, f"{TOKENIZERS}/word_bpe_49k.json").where("doc_id < 2").agg(F.sum("length")).first()[0] == 2 * n
    labelled = spark.createDataFrame([(i, "good text here" if i % 2 else "BAD!! TEXT!!", i % 2) for i in range(40)], "doc_id long, text string, label int")
    assert compression_quality.score_quality(docs, compression_quality.fit_quality(labelled, "label")).count() == 4
    assert langid.predict_language(docs, langid.fit_languages(labelled.select("doc_id", "text", F.lit("en").alias("lang")))).count() == 4


# --- classifiers against plain calculations


def test_quality_scores_equal_plain_compression(spark):
    import zstandard

    r = random.Random(4)
    texts = [(sentence(r, 80), 1) if i % 2 else (" ".join(w.upper() + "!!" for w in sentence(r, 80).split()), 0) for i in range(120)]
    model = compression_quality.fit_quality(spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "doc_id long, text string, quality int"))
    asked = [*(t for t, _ in texts[:20]), "", None, "é" * 500, texts[0][0], " ".join(t for t, _ in texts[:40])]
    got = compression_quality.score_quality(docs_of(spark, asked).unionByName(docs_of(spark, ["x"]).withColumn("doc_id", F.lit(None).cast("long"))), model).collect()
    assert len(got) == len(asked) + 1
    for x in got:
        data = (asked[x["doc_id"]] or "" if x["doc_id"] is not None else "x").encode()
        plain = [zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (model.good, model.bad)]
        good, bad = (sum(len(c.compress(data[i : i + 2000])) for i in range(0, len(data), 2000)) for c in plain)
        d = [(bad - good) / (bad + good), (bad - good) / len(data)] if data else [0.0, 0.0]
        score = 1 / (1 + math.exp(-(sum(w * v for w, v in zip(model.weights, d, strict=True)) + model.bias)))
        assert math.isclose(x["score"], score, rel_tol=1e-9) and x["predicted"] == int(score >= 0.5) and x["difference"] == d[0]


def test_ordinal_likelihood_and_gradient():
    rng = np.random.default_rng(2)
    x, y = rng.random((30, 4)), rng.integers(0, 4, 30)
    share, p = rng.random(30), rng.standard_normal(4 + 3) * 0.5
    loss, gradient = toxicity.loss_and_gradient(p, x, y, share, 3, 0.1)
    theta = [p[4], p[4] + math.exp(p[5]), p[4] + math.exp(p[5]) + math.exp(p[6])]
    want = 0.05 * sum(w * w for w in p[:4])
    for row, grade, weight in zip(x, y, share, strict=True):  # a plain loop over the grades
        below = [0.0, *(1 / (1 + math.exp(-(t - sum(a * w for a, w in zip(row, p, strict=False))))) for t in theta), 1.0]
        want -= weight * math.log(below[grade + 1] - below[grade])
    assert math.isclose(loss, want, rel_tol=1e-9)
    for k in range(len(p)):
        e = np.zeros(len(p))
        e[k] = 1e-6
        slope = (toxicity.loss_and_gradient(p + e, x, y, share, 3, 0.1)[0] - toxicity.loss_and_gradient(p - e, x, y, share, 3, 0.1)[0]) / 2e-6
        assert math.isclose(gradient[k], slope, rel_tol=1e-4, abs_tol=1e-7)


def test_toxicity_takes_given_grades_and_scores_repeated_rows_alike(spark):
    texts = [" ".join(["calm", "words"] * 5 + ["bad"] * g) for g in (0, 1, 2) for _ in range(30)]
    labelled = spark.createDataFrame([(i, t, i // 30) for i, t in enumerate(texts)], "doc_id long, text string, toxic int")
    model = toxicity.fit_toxicity(labelled, grades=True)
    got = toxicity.score_toxicity(frame(spark, [(1, texts[0], "en", "s", 1), (2, texts[40], "en", "s", 1), (3, texts[-1], "en", "s", 1), (3, texts[-1], "en", "s", 1), (None, texts[-1], "en", "s", 1)]), model).collect()
    want = {t: model.probabilities(t) for t in (texts[0], texts[40], texts[-1])}
    assert [x["probabilities"] for x in got] == [want[texts[0]], want[texts[40]], *[want[texts[-1]]] * 3]
    assert [x["grade"] for x in got] == [max(range(3), key=x["probabilities"].__getitem__) for x in got]
    assert got[0]["expected_severity"] < got[1]["expected_severity"] < got[2]["expected_severity"]


def test_languages_equal_a_plain_cosine_over_all_centroids(spark):
    r = random.Random(3)
    words = {"en": "the and of house is with for this that river".split(), "fr": "le la les des maison est avec pour cette rivière".split(), "de": "der die das und haus ist mit für dieser fluss".split()}
    rows = [(i, " ".join(r.choice(words[x]) for _ in range(20)), x, "s", 1) for i, x in enumerate(["en", "fr", "de"] * 40)]
    model = langid.fit_languages(frame(spark, rows[:90]))
    asked = [*rows[90:], (500, rows[95][1], None, None, None), (500, rows[95][1], None, None, None), (None, "haus und 12 Fluss", None, None, None)]
    got = langid.predict_language(frame(spark, asked), model).collect()
    assert len(got) == len(asked)
    for x, row in zip(sorted(got, key=lambda g: (g["doc_id"] is None, g["doc_id"] or 0)), sorted(asked, key=lambda g: (g[0] is None, g[0] or 0)), strict=True):
        v = [math.log1p(float(c)) * float(w) for c, w in zip(langid.gram_counts(row[1]), model.idf, strict=True)]
        size = math.sqrt(sum(a * a for a in v))
        cos = [sum(a * float(b) for a, b in zip(v, c, strict=True) if a) / size for c in model.centroids]
        best = max(range(len(cos)), key=cos.__getitem__)
        assert x["lang_pred"] == model.langs[best] and math.isclose(x["score"], cos[best], abs_tol=1e-5) and x["rejected"] == (x["score"] < model.least[x["lang_pred"]])


def test_embeddings_recall_on_planted_pairs(spark):
    """Most vectors have no partner; copies lie at a cosine of 0.93 to 0.97, in groups of up to four."""
    rng = np.random.default_rng(17)
    unit = lambda a: a / np.linalg.norm(a, axis=-1, keepdims=True)
    x = unit(rng.standard_normal((3000, 64)))
    out = [*x]
    for b in x[:600]:
        for c in rng.uniform(0.93, 0.97, rng.integers(1, 4)):
            y = rng.standard_normal(64)
            out.append(c * b + math.sqrt(1 - c * c) * unit(y - (y @ b) * b))
    rows = [(i, [float(np.float32(a)) for a in v], i % 3) for i, v in enumerate(out)]
    for i in range(3000, len(rows)):  # a copy has its original's label, and so do most others' neighbours
        rows[i] = (i, rows[i][1], 0)
    rows[:600] = [(i, v, 0) for i, v, _ in rows[:600]]
    got = {r["vec_id"]: r for r in itq.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), 0.93).collect()}
    z = unit(np.array([r[1] for r in rows]))
    label = np.array([r[2] for r in rows])
    hit = (z @ z.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(hit, False)
    n = hit.sum(axis=1)
    assert n.sum() >= 1200 and all(got[i]["n_links"] <= k for i, k in enumerate(n.tolist()))
    assert sum(g["n_links"] for g in got.values()) >= 0.995 * n.sum()


def test_embeddings_of_doubles_are_compared_as_doubles(spark):
    a = [1.0] + [0.0] * 7
    b = [0.93 - 1e-10] + [math.sqrt(1 - (0.93 - 1e-10) ** 2)] + [0.0] * 6  # below the threshold by less than a float can tell
    got = itq.near_embeddings(spark.createDataFrame([(1, a, 0), (2, b, 0), (3, a, 0)], "vec_id long, embedding array<double>, label int"), 0.93).orderBy("vec_id").collect()
    assert [(g["n_links"], g["component_id"]) for g in got] == [(1, 1), (0, 2), (1, 1)]


def test_hot_keys_are_joined_apart(spark):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 60 + [2] * 5 + [3])], "k long, x long")
    table = saved(rows.groupBy("k").agg(F.count("*").alias("n")), "counts")
    got = join_counted(rows, table.where("k < 3"), ["k"], "n", hot=10).collect()
    assert collections.Counter((g["k"], g["n"]) for g in got) == {(1, 60): 60, (2, 5): 5}
    assert join_counted(rows, table.where("k < 3"), ["k"], "n", how="left", hot=10).where("n is null").count() == 1


def test_sums_before_equal_a_plain_running_sum(spark):
    r = random.Random(2)
    rows = [(k, i, r.randint(0, 9)) for k in "ab" for i in range(300)]
    got = mixing.sums_before(spark.createDataFrame(rows, "k string, i long, v long"), ["k"], "i", "v", fan=16).collect()
    assert all(g["before"] == sum(v for k, i, v in rows if k == g["k"] and i < g["i"]) for g in got) and len(got) == len(rows)


def test_operators_leave_no_more_tables_than_their_result_reads(spark):
    before = set(tables._TABLES.values())
    ngram_join.similar_documents(docs_of(spark, ["a b c d e f g", "a b c d e f g h", "other words"])).collect()
    itq.near_embeddings(spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0)], "vec_id long, embedding array<float>, label int")).collect()
    names = sorted(p.rsplit("/", 1)[1] for p in set(tables._TABLES.values()) - before)
    assert names == ["per_class", "per_class", "signatures", "vectors"]


# --- very long texts


def test_very_long_texts_stay_whole_in_archives_token_files_and_mixes(spark):
    text = "alpha beta gamma, " * 150_000
    out = new_folder(spark, "warc")
    warc.write_warc(spark.createDataFrame([(1, "http://a", text), (2, "http://b", text[:-1])], "page_id long, url string, html string"), out)
    assert {r["page_id"]: r["payload_bytes"] for r in warc.read_warc(spark, out).collect()} == {1: len(text), 2: len(text) - 1}
    path, out = f"{TOKENIZERS}/byte_bpe_50k.json", new_folder(spark, "tokens")
    token_file.write_tokens(docs_of(spark, [text, "x"]), out, path, end_id=2)
    ids = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids + [2]
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in token_file.read_tokens(spark, out).collect()}
    assert got[0] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert {r["doc_id"]: r["size"] for r in mixing.mix(docs_of(spark, [text, "x"])).collect()} == {0: 450_000, 1: 1}
