"""Deterministic sharded WARC writer and reader.

Rows are range-sorted by key, then digest, and written as gzip-per-record WARC/1.1 files that roll at a compressed size.
Headers and SHA-256 digests are regenerated from the payload. The shards' bounds are taken from exact counts by key range,
refined where a range is heavy, and from those by digest where one key is: not from a sample, so that every run of the same
rows and shards writes the same files. Tasks write under temporary names; the files of the attempts that Spark accepted are
renamed, the rest removed, and a manifest is written last. The reader reads what the manifest names and nothing else, so
that a folder without a manifest is not read, and a lost executor leaves nothing behind. A folder with a manifest is written
again only with overwrite, and has no manifest until the new one is whole. Of equal payloads of MIN_REVISIT bytes or more
the row with the smallest key holds the payload as a response; the others are revisit records that name it.

The payload crosses the network once: notes about repeated digests travel as rows of their own through the same exchange
and reach the writer just before the pages they belong to. Only slim (key, digest) rows are grouped by digest.

Null payloads are empty; null keys come first, never are a response that others name, and are written without a page
header; null URLs become urn:page: names; control characters in URLs are escaped. Rows that repeat a key and a payload:
the first is the response, the others revisit it. A very long payload is one record, held whole by its task, in a file of
its own if it is over the size at which files roll. Empty tables give an empty manifest. Further columns are not stored.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import partitions, shared_dir, table

MIN_REVISIT = 100
ROLL_BYTES = 512 << 20
#: Key ranges counted at first are 2^CELL_BITS at most, those into which a heavy one is parted 2^FINER_BITS.
CELL_BITS, FINER_BITS = 14, 8
#: Bytes that a record takes besides its payload, for the shards' balance.
RECORD_BYTES = 400
DATE = "2000-01-01T00:00:00Z"
LEVEL = 6
NAMESPACE = uuid.UUID("6f3c1f0e-0d2b-5a57-9a43-5b1f5a0c7e11")
MANIFEST = "manifest.json"


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store of an output folder: file:, hdfs:, s3: and others that Arrow knows."""
    return pafs.FileSystem.from_uri(uri if re.match(r"\w+:", uri) else f"file://{uri}")


def _record_id(key: int | None, digest: str, n: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{key}:{digest}:{n}')}>"


def _record(kind: str, key: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, n: int) -> bytes:
    """One record; n tells rows with equal key and payload apart."""
    uri = quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else f"urn:page:{'null' if key is None else key}"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_record_id(key, digest, n)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if key is not None:
        head.append(f"X-Page-Id: {key}")
    if kind == "revisit":
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_record_id(refers, digest, 0)}",
            f"X-Refers-To-Page-Id: {refers}",
        ]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    return gzip.compress(record, LEVEL, mtime=0)


def _order(key: Column) -> Column:
    """Longs whose unsigned order is that of the keys; null counts as the smallest key."""
    return F.coalesce(key, F.lit(-(1 << 63))).bitwiseXOR(F.lit(-(1 << 63)))


def _prefix(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 4), 16, 10).cast("long")


def bounds(slim: DataFrame, n: int) -> list[tuple[int, int]]:
    """First places (key as _order gives it, digest prefix) of the second to the last of n shards of about equal weight.

    slim is (key, digest, weight). Weights are summed exactly by range: at most 2^CELL_BITS ranges, then those of more than
    half a shard are parted by further bits of the key, and single keys of more than that by digest.
    """
    rows = slim.select(_order(F.col("key")).alias("u"), _prefix(F.col("digest")).alias("d"), "weight")
    wrap = lambda x: x & ((1 << 64) - 1)
    total, low, high = rows.agg(F.sum("weight"), F.min(F.col("u").bitwiseXOR(F.lit(-(1 << 63)))), F.max(F.col("u").bitwiseXOR(F.lit(-(1 << 63))))).first()
    if not total or n < 2:
        return []
    shift = max(0, (wrap(low ^ -(1 << 63)) ^ wrap(high ^ -(1 << 63))).bit_length() - CELL_BITS)
    cells: list[tuple[int, int, int]] = []  # (key, digest prefix, weight)
    heavy: list[int] | None = None
    before = 0
    while True:
        part = rows if heavy is None else rows.filter(F.shiftrightunsigned("u", before).isin([h - (1 << 64) if h >> 63 else h for h in heavy]))
        found = part.groupBy(F.shiftrightunsigned("u", shift).alias("c")).agg(F.sum("weight").alias("w")).collect()
        cells += [(wrap(r["c"]) << shift, 0, r["w"]) for r in found]
        heavy = [wrap(r["c"]) for r in found if r["w"] * 2 * n > total]
        gone = {h << shift for h in heavy}
        cells = [c for c in cells if c[0] not in gone]
        if not heavy:
            break
        if shift == 0:
            keys = [h - (1 << 64) if h >> 63 else h for h in heavy]
            cells += [(wrap(r["u"]), r["d"], r["w"]) for r in rows.filter(F.col("u").isin(keys)).groupBy("u", "d").agg(F.sum("weight").alias("w")).collect()]
            break
        before, shift = shift, max(0, shift - FINER_BITS)
    out, done, shard = [], 0, 1
    for u, d, w in sorted(cells):
        if done * n >= shard * total:
            out.append((u, d))
            shard = done * n // total + 1
        done += w
    return out


def shard_of(key: Column, digest: Column, first: list[tuple[int, int]]) -> Column:
    """The number of shards that begin at or before (key, digest)."""
    us, ds = np.array([u for u, _ in first], np.uint64), np.array([d for _, d in first], np.int64)

    @F.pandas_udf("int")
    def find(u: pd.Series, d: pd.Series) -> pd.Series:
        key, digest = u.to_numpy(np.int64).view(np.uint64), d.to_numpy(np.int64)
        left, right = np.searchsorted(us, key, "left"), np.searchsorted(us, key, "right")
        for i, j in set(zip(left[left < right].tolist(), right[left < right].tolist(), strict=True)):  # shards that begin inside one key
            at = np.flatnonzero((left == i) & (right == j))
            right[at] = i + np.searchsorted(ds[i:j], digest[at], "right")
        return pd.Series(right.astype(np.int32))

    return find(_order(key), _prefix(digest)) if first else F.lit(0)


MADE = "name string, temp string, records long, bytes long, sha256 string"


def _writer(folder: str, roll: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        attempt = TaskContext.get().taskAttemptId()
        out, done, state = None, [], {}
        at, refers, seen = None, None, 0  # the shard, key and digest at hand, the smallest key of the digest, rows so far
        shard, files = None, 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((state["name"], state["temp"], state["rows"], state["bytes"], state["hash"].hexdigest()))
                out = None

        for batch in batches:
            for own, key, url, payload, digest, first in zip(*(batch.column(c).to_pylist() for c in ("shard", "key", "url", "payload", "digest", "refers")), strict=True):
                if own != shard:
                    close()
                    shard, files = own, 0
                if (own, key, digest) != at:
                    at, refers, seen = (own, key, digest), None, 0
                if payload is None:  # a note
                    refers = first
                    continue
                n, seen = seen, seen + 1
                kind = "revisit" if refers is not None and (refers != key or n) else "response"
                member = _member(_record(kind, key, url, payload, digest, refers, n))
                if out is not None and state["bytes"] + len(member) > roll:
                    close()
                if out is None:
                    name = f"part-{shard:05d}-{files:05d}.warc.gz"
                    files += 1
                    state = {"bytes": 0, "rows": 0, "hash": hashlib.sha256(), "name": name, "temp": f".tmp-{attempt}-{name}"}
                    out = fs.open_output_stream(f"{base}/{state['temp']}", compression=None)
                out.write(member)
                state["hash"].update(member)
                state["bytes"] += len(member)
                state["rows"] += 1
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done]) for i in range(5)], ["name", "temp", "records", "bytes", "sha256"])

    return write


def _mover(folder: str):
    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        for batch in batches:
            for name, temp in zip(batch.column("name").to_pylist(), batch.column("temp").to_pylist(), strict=True):
                if fs.get_file_info(f"{base}/{temp}").type != pafs.FileType.NotFound:  # else an earlier attempt of this task has done it
                    fs.move(f"{base}/{temp}", f"{base}/{name}")
            yield batch.select(["name"])

    return move


def write_warc(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", roll: int = ROLL_BYTES, shards: int | None = None, overwrite: bool = False) -> list[dict]:
    """Writes pages to folder and returns its manifest: one entry a file, as bounded as the number of files."""
    spark = pages.sparkSession
    fs, base = _filesystem(folder)
    fs.create_dir(base, recursive=True)
    if fs.get_file_info(f"{base}/{MANIFEST}").type != pafs.FileType.NotFound and not overwrite:
        raise FileExistsError(f"{folder} holds a finished archive")
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("refers", F.lit(None).cast("long"))
    slim = rows.filter(F.octet_length("payload") >= MIN_REVISIT).select("key", "digest")
    twice = slim.groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND first IS NOT NULL").select("digest", "first")
    notes = (
        slim.join(twice, "digest")
        .groupBy("key", "digest")
        .agg(F.min("first").alias("refers"))
        .select("key", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "refers")
    )
    n = shards or partitions(spark)
    first = bounds(rows.select("key", "digest", (F.octet_length("payload") + RECORD_BYTES).cast("long").alias("weight")), n)
    dealt = rows.unionByName(notes).withColumn("page", F.col("payload").isNotNull()).withColumn("shard", shard_of(F.col("key"), F.col("digest"), first))
    ordered = dealt.repartitionById(n, F.col("shard")).sortWithinPartitions("shard", F.col("key").asc_nulls_first(), "digest", "page", "url")
    made = ordered.select("shard", "key", "url", "payload", "digest", "refers").mapInArrow(_writer(folder, roll), MADE).collect()
    made = sorted(made, key=lambda r: r["name"])
    accepted = {r["temp"] for r in made}
    if overwrite and fs.get_file_info(f"{base}/{MANIFEST}").type != pafs.FileType.NotFound:
        fs.delete_file(f"{base}/{MANIFEST}")
    for info in fs.get_file_info(pafs.FileSelector(base)):  # of attempts that Spark did not accept, and of earlier archives
        if info.type == pafs.FileType.File and info.base_name not in accepted:
            fs.delete_file(info.path)
    if made:
        names = spark.createDataFrame([(r["name"], r["temp"]) for r in made], "name string, temp string")
        names.repartition(min(len(made), n)).mapInArrow(_mover(folder), "name string").collect()
    manifest = [{k: r[k] for k in ("name", "records", "bytes", "sha256")} for r in made]
    with fs.open_output_stream(f"{base}/.{MANIFEST}") as f:
        f.write(json.dumps(manifest, indent=1).encode())
    fs.move(f"{base}/.{MANIFEST}", f"{base}/{MANIFEST}")
    return manifest


def _members(file, step: int = 1 << 16) -> Iterator[bytes]:
    """The records of a file, read in pieces of step bytes."""
    fed = file.read(step)
    while fed:
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if not fed:
                raise ValueError("the last record is cut off")
            parts.append(z.decompress(fed))
            fed = z.unused_data if z.eof else file.read(step)
        yield b"".join(parts)
        fed = fed or file.read(step)


def _parse(record: bytes) -> tuple:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"].removeprefix("sha256:"):
        raise ValueError(f"block digest differs in {fields['WARC-Record-ID']}")
    payload, digest = block.partition(b"\r\n\r\n")[2], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload digest differs in {fields['WARC-Record-ID']}")
    key, refers = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
    return (int(key) if key else None, int(fields["X-Payload-Length"]), digest, fields["WARC-Type"], int(refers) if refers else None, fields["WARC-Target-URI"], payload)


#: Rows and payload bytes that a reader gives at once, and bytes of archives that a task reads at least.
PACK_ROWS, PACK_BYTES = 1000, 4 << 20
READ_BYTES = 128 << 20


def _reader(folder: str, with_payload: bool):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri", *["payload"] * with_payload]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def pack(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], types[i]) for i in range(len(names))], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                found, size = [], 0
                with fs.open_input_stream(f"{base}/{name}", compression=None) as file:
                    for record in _members(file):
                        found.append(_parse(record)[: len(names)])
                        size += len(record) * with_payload
                        if len(found) == PACK_ROWS or size > PACK_BYTES:
                            yield pack(found)
                            found, size = [], 0
                if found:
                    yield pack(found)

    return read


def read_warc(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of the files that a folder's manifest names; every digest is checked on the way."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string" + ", payload binary" * with_payload
    fs, base = _filesystem(folder)
    with fs.open_input_stream(f"{base}/{MANIFEST}") as f:
        manifest = json.loads(f.read())
    tasks = min(len(manifest), max(spark.sparkContext.defaultParallelism, sum(x["bytes"] for x in manifest) // READ_BYTES))
    files = spark.createDataFrame([(x["name"],) for x in manifest], "name string").repartition(max(1, tasks))
    return files.mapInArrow(_reader(folder, with_payload), schema)


def op1_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), folder)
    return read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to FROM f"""

QUERIES = {"op1_warc_writer": op1_warc_writer}
ORACLES = {"op1_warc_writer": _SQL}
