"""WARC archives: a deterministic sharded writer and a reader.

Records are range-sorted by id into shards whose cuts follow from the rows alone. A task writes the shards it holds to
temporary files and rolls to a new file once the compressed size passes ``roll_bytes``. Headers and digests are made
anew for every record. A file counts only once the manifest names it: each task returns the files it finished, Spark keeps
those of the attempts that succeeded, the driver renames them and then writes the manifest, itself under a temporary name
first. Files of lost or repeated attempts stay outside the manifest.

Equal payloads are stored once, in the record with the largest id (a ``response``); the others become ``revisit`` records
that refer to it. The winner of each payload is found by aggregating digests only, and very common digests are sent to all
tasks, so a payload shared by a third of all rows meets in no task.

Null html is an empty payload. Rows with a null id come first and never win against an id; if all rows of a payload have a null id, one
of them is the response and the others refer to a null id. Rows that repeat an id and a
payload give one response, the rest revisits of it. Payloads of any length are whole records, one at a time in a task. Empty tables give an
empty archive. Columns beyond id, url and html are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import discard, join_counted, open_fs, range_shards, saved, text_batches

FIXED_DATE = "2024-01-01T00:00:00Z"
MANIFEST_SCHEMA = "shard int, part int, tmp string, name string, records long, bytes long, sha256 string"
RECORD_SCHEMA = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary, file string, offset long"


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _head(fields: list[tuple[str, object]]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in fields).encode()


def _record(page_id, url, payload: bytes, digest: str, winner, revisit: bool, date: str) -> bytes:
    """One gzip member with a record; every length and digest is computed here."""
    http = b"HTTP/1.1 200 OK\r\n" + _head([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))]) + b"\r\n"
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", "".join(c for c in url or "" if c > " ")),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()),
        ("X-Page-Id", "" if page_id is None else page_id),
        ("X-Payload-Length", len(payload)),
    ]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(winner, digest)), ("X-Refers-To-Page-Id", "" if winner is None else winner)]
    raw = b"WARC/1.1\r\n" + _head([*fields, ("Content-Length", len(block))]) + b"\r\n" + block + b"\r\n\r\n"
    return gzip.compress(raw, 6, mtime=0)


def _tasks_files(out: str, roll_bytes: int, date: str):
    """The function that writes the shards of one sorted partition and returns the rows of the manifest."""

    def write(batches):
        import pyarrow as pa

        fs, base = open_fs(out)
        fs.create_dir(f"{base}/tmp", recursive=True)
        file = last = None
        done = []

        def start(shard: int, part: int) -> dict:
            tmp = f"tmp/{uuid.uuid4().hex}.warc.gz"
            f = {"shard": shard, "part": part, "tmp": tmp, "name": f"shard-{shard:06d}-{part:05d}.warc.gz", "records": 0, "bytes": 0, "sha": hashlib.sha256(), "to": fs.open_output_stream(f"{base}/{tmp}", compression=None)}
            info = gzip.compress(b"WARC/1.1\r\n" + _head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f['name'])}>"), ("WARC-Date", date), ("WARC-Filename", f["name"]), ("Content-Type", "application/warc-fields"), ("Content-Length", 0)]) + b"\r\n\r\n\r\n", 6, mtime=0)
            put(f, info)
            return f

        def put(f: dict, raw: bytes) -> None:
            f["to"].write(raw)
            f["sha"].update(raw)
            f["bytes"] += len(raw)

        def close(f: dict) -> None:
            f["to"].close()
            done.append({k: f[k] for k in ("shard", "part", "tmp", "name", "records", "bytes")} | {"sha256": f["sha"].hexdigest()})

        for batch in batches:
            for row in batch.to_pylist():
                payload = (row["html"] or "").encode("utf-8", "surrogatepass")
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                if file is None or file["shard"] != row["shard"] or file["bytes"] >= roll_bytes:
                    part = 0
                    if file is not None:
                        part = file["part"] + 1 if file["shard"] == row["shard"] else 0
                        close(file)
                    file = start(row["shard"], part)
                now = (row["page_id"], digest)
                revisit = row["repeated"] and (row["page_id"] != row["winner"] or now == last)
                last = now
                put(file, _record(row["page_id"], row["url"], payload, digest, row["winner"], revisit, date))
                file["records"] += 1
        if file is not None:
            close(file)
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("tmp", pa.string()), ("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    return write


def write_warc(pages: DataFrame, out: str, shard_bytes: int = 16 << 20, roll_bytes: int = 1 << 20, min_payload: int = 0, date: str = FIXED_DATE) -> list[dict]:
    """Writes (page_id, url, html) as WARC files under ``out`` and returns the manifest, one entry for each file.

    ``shard_bytes`` is the uncompressed size of a shard, ``roll_bytes`` the compressed size after which a file ends and the shard goes on in
    another one; at the defaults a shard of html is a few files.
    Payloads below ``min_payload`` bytes are all responses. The manifest grows with the number of files, not of records.
    """
    text_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("key"), F.col("url").cast("string"), F.col("html").cast("string"))
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = rows.withColumn("digest", F.unhex(F.sha1(body))).withColumn("tie", F.xxhash64("digest"))
    digests = saved(rows.select("key", "tie", "digest", (F.octet_length(body) + 512).cast("long").alias("weight")), "digests")
    # Written first, so that its size is known when the join is planned: small, it is broadcast and the html isn't shuffled for it.
    best = digests.groupBy("digest").agg(F.max("key").alias("winner"), F.count("*").alias("copies"))
    best = saved(best.where("copies > 1"), "shared")
    assign, weights = range_shards(digests, shard_bytes)
    keyed = join_counted(rows, best, ["digest"], "copies", how="left")
    again = F.col("copies").isNotNull() & (F.octet_length(body) >= min_payload)
    dealt = assign(keyed.withColumn("repeated", again)).repartitionById(len(weights), F.col("shard")).sortWithinPartitions("shard", "key", "digest", "url")
    tasks = dealt.select("shard", F.col("key").alias("page_id"), "url", "html", "winner", "repeated").mapInArrow(_tasks_files(out, roll_bytes, date), MANIFEST_SCHEMA)
    manifest = saved(tasks, "manifest")
    entries = [r.asDict() for r in manifest.orderBy("shard", "part").collect()]
    discard(digests, best, manifest)
    fs, base = open_fs(out)
    fs.create_dir(base, recursive=True)
    for e in entries:
        fs.move(f"{base}/{e['tmp']}", f"{base}/{e['name']}")
        del e["tmp"]
    if entries:
        fs.delete_dir(f"{base}/tmp")  # files of lost attempts
    with fs.open_output_stream(f"{base}/manifest.json.tmp") as f:
        f.write(json.dumps({"files": entries}, indent=1).encode())
    fs.move(f"{base}/manifest.json.tmp", f"{base}/manifest.json")
    return entries


def _parse(data: bytes):
    """(offset, WARC fields, payload) of the records of an archive file."""
    at = 0
    while at < len(data):
        z, parts, nxt = zlib.decompressobj(31), [], at
        while not z.eof:
            piece = memoryview(data)[nxt : nxt + 16384]
            parts.append(z.decompress(piece))
            nxt += len(piece) - len(z.unused_data)
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        block = rest[: int(fields["Content-Length"])]
        yield at, fields, block
        at = nxt


def read_warc(spark: SparkSession, out: str) -> DataFrame:
    """The response and revisit records of the archive at ``out``: RECORD_SCHEMA. Only files that the manifest names are read."""
    fs, base = open_fs(out)
    with fs.open_input_stream(f"{base}/manifest.json") as f:
        files = json.loads(f.read())["files"]

    def read(batches):
        import pyarrow as pa

        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("file", pa.string()), ("offset", pa.int64())])
        fs, base = open_fs(out)
        whole = lambda x: int(x) if x else None
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                    data = f.read()
                rows, held = [], 0
                for offset, h, block in _parse(data):
                    if h["WARC-Type"] == "warcinfo":
                        continue
                    revisit = h["WARC-Type"] == "revisit"
                    if "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() != h["WARC-Block-Digest"]:
                        raise ValueError(f"{name}: the block at {offset} doesn't match its digest")
                    payload = block.partition(b"\r\n\r\n")[2]
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit:
                        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    size = int(h["X-Payload-Length"]) if revisit else len(payload)
                    rows.append({"page_id": whole(h["X-Page-Id"]), "url": h["WARC-Target-URI"], "record_type": h["WARC-Type"], "payload_digest": digest, "payload_bytes": size, "refers_to": whole(h.get("X-Refers-To-Page-Id")), "payload": None if revisit else payload, "file": name, "offset": offset})
                    held += len(payload)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    names = spark.createDataFrame([(e["name"],) for e in files], "name string")
    return names.repartition(max(1, len(files))).mapInArrow(read, RECORD_SCHEMA)
