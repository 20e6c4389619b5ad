"""Streams against plain replays: folded model output, bursts, caches, and the index of bases and deltas."""

import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from corpusloom.streaming import blocks, index, keyed
from corpusloom.tables import new_folder

CHUNK = "stream_id long, seq long, content string, finish string, tokens long, at timestamp"


def replay(spark, parts, schema, act):
    """What a stream gives that gets each of ``parts`` (lists of rows, with seconds as times) as a micro-batch or more."""
    place, out, kept = (new_folder(spark, x) for x in ("in", "out", "progress"))
    result = None
    for rows in parts:
        df = spark.createDataFrame(rows, schema.replace("at timestamp", "at double")).withColumn("at", F.timestamp_seconds("at"))
        df.repartition(3).write.mode("append").parquet(place)
        stream = act(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(place))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", kept).trigger(availableNow=True).start().awaitTermination()
        result = stream.schema
    return spark.read.schema(result).parquet(out)


def plain_fold(text, end=True):
    return blocks.fold("", False, text, end)[0]


def joined(pieces):
    """Neighbouring pieces of one kind together: how they were cut doesn't matter."""
    out = []
    for kind, text in pieces:
        if out and out[-1][0] == kind and kind in ("text", "thought"):
            out[-1] = (kind, out[-1][1] + text)
        else:
            out.append((kind, text))
    return out


def folded(rows):
    of = {}
    for r in sorted(rows, key=lambda r: (r["stream_id"], r["seq"], r["part"])):
        of.setdefault(r["stream_id"], []).append(r)
    return {k: (joined([(r["kind"], r["text"]) for r in v if r["kind"] != "end"]), [(r["truncated"], r["tokens"]) for r in v if r["kind"] == "end"]) for k, v in of.items()}


def test_long_shuffled_and_unfinished_streams_equal_a_plain_fold(spark):
    r = random.Random(2)
    words = ["plain ", "<think>", "deep ", "</think>", "<writeFile>", "body ", "</writeFile>", "<", "thi", "</wr", "x < y "]
    texts = {1: "".join(r.choice(words) for _ in range(45_000)), 2: "ends with a <w", 3: "x <writeFile>never closed", 4: "y <think>never closed </thi", 5: "plan</think>answer", 6: "", 7: "<think>a</think>b<writeFile>c</writeFile>d"}
    rows = []
    for k, text in texts.items():
        size = max(1, len(text) // 30_000) if k == 1 else 3
        cuts = [text[i : i + size] for i in range(0, len(text), size)] or [""]
        finish = {1: "stop", 7: "max_tokens"}.get(k)
        rows += [(k, i, c, finish if i == len(cuts) - 1 else None, 11 if i == len(cuts) - 1 else None, 1e6 + i / 1000) for i, c in enumerate(cuts)]
    assert sum(x[0] == 1 for x in rows) >= 30_000
    rows += r.sample(rows, 500)  # delivered twice
    r.shuffle(rows)
    got = folded(replay(spark, [rows, [(99, 0, "late", "stop", None, 1e8)]], CHUNK, lambda s: blocks.fold_stream(s, late="1 hour")).where("stream_id < 99").collect())
    assert set(got) == set(texts)
    for k, text in texts.items():
        assert got[k] == (joined(plain_fold(text)), [(k == 7, 11)]), k


def test_streams_with_gaps_end_by_silence_and_thoughts_can_be_left_out(spark):
    rows = [(1, 0, "a<think>b", None, None, 1e6), (1, 1, "c</think>d", None, None, 1e6), (1, 3, "e", "length", 5, 1e6), (None, 0, "n", "stop", None, 1e6), (2, None, "lost", None, None, 1e6), (2, 0, None, "stop", None, 1e6)]
    got = folded([dict(x.asDict(), stream_id=x["stream_id"] or 0) for x in replay(spark, [rows, [(99, 0, "", "stop", None, 1e8)]], CHUNK, lambda s: blocks.fold_stream(s, thoughts=False)).where("coalesce(stream_id, 0) < 99").collect()])
    assert got == {0: ([("text", "n")], [(False, 0)]), 1: ([("text", "ade")], [(True, 5)]), 2: ([], [(False, 0)])}


@pytest.mark.parametrize("cut", range(1, 12))
def test_fold_doesnt_depend_on_chunks(cut):
    s = "hi<think>plan</think> a <writeFile>body</writeFile> b</think>c <wri"
    buffer, thinking, out = "", False, []
    for i in range(0, len(s), cut):
        got, buffer, thinking = blocks.fold(buffer, thinking, s[i : i + cut])
        out += got
    out += blocks.fold(buffer, thinking, "", True)[0]
    assert joined(out) == [("text", "hi"), ("thought", "plan"), ("text", " a "), ("file", "body"), ("text", " b"), ("unopened", ""), ("text", "c <wri")]


CHANGE = "key string, id long, payload string, at timestamp"


def changes(r, n):
    rows = [(r.choice(["a", "a", "a", "b", "c", None]), i, r.choice("xyzuvw"), 1e6 + r.choice([r.randint(0, 4000), r.randint(0, 40) * 50])) for i in range(n)]
    r.shuffle(rows)
    return rows


def test_bursts_equal_a_plain_replay(spark):
    rows = changes(random.Random(5), 400)
    out = replay(spark, [rows[:250], rows[250:], [("tick", 0, "", 1e8)]], CHANGE, lambda s: keyed.debounced(s, 20_000, leading=True, late="2 days"))
    got = sorted((x["key"] or "", x["at"].timestamp(), x["id"], x["edge"], x["n"]) for x in out.where("coalesce(key, '') <> 'tick'").collect())
    expected = []
    for key in {x[0] for x in rows}:
        bursts = []
        for row in sorted((x for x in rows if x[0] == key), key=lambda x: (x[3], x[1])):
            if not bursts or row[3] - bursts[-1][-1][3] >= 20:
                bursts.append([])
            bursts[-1].append(row)
        for b in bursts:
            expected += [(key or "", b[0][3], b[0][1], "first", 1)] + ([(key or "", b[-1][3], b[-1][1], "last", len(b))] if len(b) > 1 else [])
    assert got == sorted(expected)
    with pytest.raises(ValueError):
        keyed.debounced(out, 1, False, False)


def test_cache_equals_a_plain_replay(spark):
    rows = changes(random.Random(6), 500)
    out = replay(spark, [rows[:200], rows[200:], [("tick", 0, "", 1e8)]], CHANGE, lambda s: keyed.cached(s, 3, 100_000, late="2 days"))
    got = sorted((x["key"] or "", x["id"], x["item"], x["hit"], x["removed"], x["size"]) for x in out.where("coalesce(key, '') <> 'tick'").collect())
    expected = []
    for key in {x[0] for x in rows}:
        held = OrderedDict()
        for _, i, item, at in sorted((x for x in rows if x[0] == key), key=lambda x: (x[3], x[1])):
            for old in [k for k, t in held.items() if at - t > 100]:
                del held[old]
            hit, removed = item in held, None
            if not hit and len(held) == 3:
                removed = min(held, key=lambda k: list(held).index(k))
                del held[removed]
            held.pop(item, None)
            held[item] = at
            expected.append((key or "", i, item, hit, removed, len(held)))
    assert got == sorted(expected)


def test_index_touches_only_parts_that_change(spark):
    place = new_folder(spark, "index")
    frame = lambda rows: spark.createDataFrame(rows, "path string, body string, deleted boolean, at long")
    apply = lambda rows, n, **o: index.apply_changes(frame(rows), n, place, "path", parts=8, **o)
    state = {f"p{i}": "old" for i in range(200)}
    apply([(k, v, False, 0) for k, v in state.items()], 0)
    before = index.version(spark, place, 0)
    assert len(before["of"]) == 8 and not any(p["deltas"] for p in before["of"].values())
    apply([("p7", "first", False, 1), ("p7", "new", False, 2)], 1)
    after = index.version(spark, place, 1)
    touched = [p for p in after["of"] if after["of"][p] != before["of"][p]]
    assert len(touched) == 1 and after["of"][touched[0]]["base"] == before["of"][touched[0]]["base"] and len(after["of"][touched[0]]["deltas"]) == 1
    state["p7"] = "new"
    read = lambda: {r["path"]: r["body"] for r in index.read_index(spark, place).collect()}
    assert read() == state
    apply([("p7", "again", False, 1)], 1)  # a batch that is repeated
    assert read() == state
    r = random.Random(1)
    for n in range(2, 9):
        rows = [(f"p{r.randint(0, 250)}", f"v{n}.{i}", r.random() < 0.3, i) for i in range(r.choice([1, 40]))]
        apply(rows, n, most_deltas=3)
        for k, v, gone, _ in rows:
            state.pop(k, None)
            if not gone:
                state[k] = v
        assert read() == state and len(index.versions(spark, place)) <= index.KEPT
    kept = set().union(*(index._folders(index.version(spark, place, n)) for n in index.versions(spark, place)))
    assert set(index._names(spark, f"{place}/rows")) == kept
    apply([(k, None, True, 9) for k in state], 9)
    assert read() == {}


def test_waiting_chunks_are_kept_in_groups_and_folded_as_one(spark):
    text = "a<think>b</think>" + "word " * 2000
    cuts = [text[i : i + 3] for i in range(0, len(text), 3)]
    rows = [(1, i, c, "stop" if i == len(cuts) - 1 else None, None, 1e6) for i, c in enumerate(cuts)]
    out = replay(spark, [rows[1:], rows[:1] + rows[5:9], [(99, 0, "", "stop", None, 1e8)]], CHUNK, lambda s: blocks.fold_stream(s, late="1 hour")).where("stream_id = 1").collect()
    assert folded(out) == {1: (joined(plain_fold(text)), [(False, 0)])} and len(out) < 20
