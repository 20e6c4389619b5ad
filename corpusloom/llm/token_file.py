"""Token ids as Arrow files of fixed-size lists, for zero-copy random access to equal-length sequences.

Documents are range-sorted by id into shards. Each shard is one Arrow file (the random-access form of the stream format)
with record batches of two fixed-size-list columns, ``ids`` and ``mask``, ``seq_len`` long; the last sequence of a shard
is padded with id 0 and mask false. A second Arrow file for each shard has a row for each document: its id, the ids
before it in the shard and its own number of ids. The manifest has each shard's first position in the whole stream.
Ids are stored in 16 bits where the vocabulary allows, else in 32.

Null texts are empty: their document has the end id alone. Null ids come first; rows that repeat an id stay, next to each other unless they
fill several shards. Texts of any length are read whole, one at a time in a task. An empty table gives a manifest without shards. Columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import discard, open_fs, range_shards, saved, text_batches
from corpusloom.llm.pieces import pieces

MANIFEST_SCHEMA = "shard int, ids_tmp string, docs_tmp string, documents long, n_ids long"


def _writer(out: str, tokenizer: str, end_id: int, seq_len: int, batch_rows: int, keeps_space: bool):
    def write(batches):
        import pyarrow as pa

        fs, base = open_fs(out)
        fs.create_dir(f"{base}/tmp", recursive=True)
        enc = pieces(tokenizer, keeps_space)
        item = pa.uint16() if enc.kind.itemsize == 2 else pa.uint32()
        schema = pa.schema([("ids", pa.list_(item, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        end = np.array([end_id], enc.kind)
        now, done = None, []

        def flush(f: dict, last: bool) -> None:
            ids = np.concatenate(f["held"]) if f["held"] else np.zeros(0, enc.kind)
            n = len(ids) if last else len(ids) // (seq_len * batch_rows) * seq_len * batch_rows
            full, rest = ids[:n], ids[n:]
            for i in range(0, len(full), seq_len * batch_rows):
                part = full[i : i + seq_len * batch_rows]
                pad = -len(part) % seq_len
                mask = np.arange(len(part) + pad) < len(part)
                part = np.concatenate([part, np.zeros(pad, enc.kind)])
                arrays = [pa.FixedSizeListArray.from_arrays(pa.array(part), seq_len), pa.FixedSizeListArray.from_arrays(pa.array(mask), seq_len)]
                f["file"].write_batch(pa.RecordBatch.from_arrays(arrays, schema=schema))
            f["held"], f["n_held"] = ([] if last else [rest]), (0 if last else len(rest))

        def start(shard: int) -> dict:
            name = uuid.uuid4().hex
            to = fs.open_output_stream(f"{base}/tmp/{name}.arrow", compression=None)
            return {"shard": shard, "tmp": name, "to": to, "file": pa.ipc.new_file(to, schema), "held": [], "n_held": 0, "ids": [], "n": []}

        def close(f: dict) -> None:
            flush(f, True)
            f["file"].close()
            f["to"].close()
            n = np.array(f["n"], np.int64)
            table = pa.table({"doc_id": pa.array(f["ids"], pa.int64()), "start": np.cumsum(n) - n, "n_tokens": n})
            with fs.open_output_stream(f"{base}/tmp/{f['tmp']}.docs.arrow", compression=None) as to, pa.ipc.new_file(to, table.schema) as w:
                w.write_table(table)
            done.append({"shard": f["shard"], "ids_tmp": f"tmp/{f['tmp']}.arrow", "docs_tmp": f"tmp/{f['tmp']}.docs.arrow", "documents": len(n), "n_ids": int(n.sum())})

        for batch in batches:
            for shard, doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if now is None or now["shard"] != shard:
                    if now is not None:
                        close(now)
                    now = start(shard)
                ids = enc.encode(text)
                now["held"] += [ids, end]
                now["n_held"] += len(ids) + 1
                now["ids"].append(doc_id)
                now["n"].append(len(ids) + 1)
                if now["n_held"] >= 2 * seq_len * batch_rows:
                    flush(now, False)
        if now is not None:
            close(now)
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("shard", pa.int32()), ("ids_tmp", pa.string()), ("docs_tmp", pa.string()), ("documents", pa.int64()), ("n_ids", pa.int64())]))

    return write


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int = 2, seq_len: int = 1024, batch_rows: int = 256, shard_bytes: int = 16 << 20, keeps_space: bool = True) -> list[dict]:
    """Writes the ids of (doc_id, text) in ascending doc_id order and returns the manifest, one entry for each shard."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), F.col("text").cast("string")).withColumn("tie", F.xxhash64("text"))
    keys = saved(rows.select("key", "tie", (F.coalesce(F.octet_length("text"), F.lit(0)) + 64).cast("long").alias("weight")), "keys")
    assign, weights = range_shards(keys, shard_bytes)
    discard(keys)
    dealt = assign(rows).select("shard", "key", "text").repartitionById(len(weights), F.col("shard")).sortWithinPartitions("shard", "key", "text")
    tasks = dealt.mapInArrow(_writer(out, tokenizer, end_id, seq_len, batch_rows, keeps_space), MANIFEST_SCHEMA)
    fs, base = open_fs(out)
    fs.create_dir(base, recursive=True)
    entries, before = [], 0
    manifest = saved(tasks, "manifest")
    for r in manifest.orderBy("shard").collect():
        e = {"shard": r["shard"], "ids": f"shard-{r['shard']:06d}.arrow", "docs": f"shard-{r['shard']:06d}.docs.arrow", "documents": r["documents"], "n_ids": r["n_ids"], "start": before}
        fs.move(f"{base}/{r['ids_tmp']}", f"{base}/{e['ids']}")
        fs.move(f"{base}/{r['docs_tmp']}", f"{base}/{e['docs']}")
        entries.append(e)
        before += r["n_ids"]
    discard(manifest)
    if entries:
        fs.delete_dir(f"{base}/tmp")  # files of lost attempts
    with fs.open_output_stream(f"{base}/manifest.json.tmp") as f:
        f.write(json.dumps({"seq_len": seq_len, "batch_rows": batch_rows, "shards": entries}, indent=1).encode())
    fs.move(f"{base}/manifest.json.tmp", f"{base}/manifest.json")
    return entries


class Sequences:
    """Random access to the sequences at ``out`` in the order of the stream: opens a shard's file at its first use.

    Of local files, what comes back are views of the mapped file: nothing is copied.
    """

    def __init__(self, out: str):
        self.fs, self.base = open_fs(out)
        with self.fs.open_input_stream(f"{self.base}/manifest.json") as f:
            held = json.loads(f.read())
        self.seq_len, self.batch_rows, self.shards = held["seq_len"], held["batch_rows"], held["shards"]
        self.ends = np.cumsum([-(-e["n_ids"] // self.seq_len) for e in self.shards])
        self.files: dict = {}

    def __len__(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def __getitem__(self, i: int):
        """(ids as a numpy array, mask as a boolean Arrow array) of sequence ``i``."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        k = int(np.searchsorted(self.ends, i, side="right"))
        if k not in self.files:
            self.files[k] = open_sequences(self.fs, f"{self.base}/{self.shards[k]['ids']}")
        batch, row = divmod(i - (int(self.ends[k - 1]) if k else 0), self.batch_rows)
        b = self.files[k].get_batch(batch)
        part = slice(row * self.seq_len, (row + 1) * self.seq_len)
        ids, mask = (b.column(c).flatten() for c in ("ids", "mask"))
        return ids.to_numpy(zero_copy_only=True)[part], mask.slice(part.start, self.seq_len)


def open_sequences(fs, path: str):
    """The record batches of a shard; of a local file they are views of the mapped file."""
    import pyarrow as pa
    from pyarrow import fs as pafs

    return pa.ipc.open_file(pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path))


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit), ids_crc32 of every document in the files at ``out``."""
    fs, base = open_fs(out)
    with fs.open_input_stream(f"{base}/manifest.json") as f:
        shards = json.loads(f.read())["shards"]

    def read(batches):
        import pyarrow as pa

        fs, base = open_fs(out)
        for batch in batches:
            for ids_name, docs_name, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                docs = pa.ipc.open_file(fs.open_input_file(f"{base}/{docs_name}")).read_all()
                start, n = docs["start"].to_numpy(), docs["n_tokens"].to_numpy()
                file = open_sequences(fs, f"{base}/{ids_name}")
                held, at, k = np.zeros(0, "<u4"), 0, 0  # held: the ids from position ``at`` on
                doc_ids = docs["doc_id"].combine_chunks()
                for b in range(file.num_record_batches):
                    x = file.get_batch(b)
                    ids, mask = x.column("ids").flatten().to_numpy(), x.column("mask").flatten().to_numpy(zero_copy_only=False)
                    held = np.concatenate([held, ids[mask].astype("<u4")])
                    k0, bodies = k, []
                    while k < len(n) and start[k] + n[k] <= at + len(held):
                        bodies.append(held[start[k] - at : start[k] - at + n[k]].tobytes())
                        k += 1
                    if bodies:
                        cols = [doc_ids.slice(k0, k - k0), pa.array(start[k0:k] + first), pa.array(n[k0:k]), pa.array(bodies, pa.binary()), pa.array([zlib.crc32(x) for x in bodies], pa.int64())]
                        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids", "ids_crc32"])
                        cut = start[k - 1] + n[k - 1] - at
                        held, at = held[cut:], at + cut

    rows = [(e["ids"], e["docs"], e["start"]) for e in shards]
    names = spark.createDataFrame(rows, "ids string, docs string, start long")
    return names.repartition(max(1, len(rows))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")
