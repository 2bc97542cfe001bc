"""WARC archives: a deterministic sharded writer, and reading them back (operator 8)."""

from __future__ import annotations

import base64
import hashlib
import io
import posixpath
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm._shared import drop_stored, fresh_path, stored

#: A file is closed when it holds this many compressed bytes; a shard has about so many payload bytes.
ROLL_BYTES, SHARD_BYTES = 16 << 20, 64 << 20
#: More shards than this are not made: they grow instead, so that the driver's list of edges stays short.
MOST_SHARDS = 65_536
#: Bins in which a range of ids is counted at least, or a full bin is cut again at most, and bins of all full ones together.
BINS, MOST_BINS = 1024, 1_000_000
#: Fixed, so that equal input gives equal bytes.
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
#: Up to so many repeated contents (40 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
MANIFEST = "shard long, slice int, part int, path string, records long, bytes long, sha256 string"


#: Names by which Spark knows storage that Arrow knows by another.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def _file(uri: str):
    """(file system, path) of a URI, local or remote, by Arrow's file systems (local, HDFS, S3, GCS, Azure)."""
    from pyarrow import fs

    scheme, mark, rest = uri.partition("://")
    if mark:
        return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")
    return fs.FileSystem.from_uri(uri if uri.startswith(("file:", "/")) else f"/{uri}")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(row: dict) -> bytes:
    """One WARC/1.1 record; a revisit carries the digest and the target's id, and no payload."""
    revisit = row["refers_to"] is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if revisit else row["payload"])
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{row['page_id']}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((row['url'] or '').split())}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{row['payload_digest']}",
        f"WARC-Block-Digest: sha1:{digest_of(block)}",
        f"X-Payload-Length: {row['payload_bytes']}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{row['refers_to']}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip_member(data: bytes) -> bytes:
    """A gzip member without a time stamp."""
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class _Shard:
    """Writes the files of one shard: temporary names first, final names when closed."""

    def __init__(self, folder: str, key: tuple[int, int], roll: int, attempt: str):
        self.folder, self.key, self.roll, self.attempt, self.part, self.out = folder, key, roll, attempt, 0, None
        self.shard, self.slice = key
        self.manifest: list[dict] = []

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.name = f"shard-{self.shard:08d}-{self.slice:05d}-{self.part:05d}.warc.gz"
            self.fs, at = _file(f"{self.folder}/{self.name}")
            self.final, self.temporary = at, posixpath.join(posixpath.dirname(at), f".{self.name}.{self.attempt}")
            self.fs.create_dir(posixpath.dirname(at), recursive=True)
            self.out, self.hash, self.bytes, self.records = self.fs.open_output_stream(self.temporary, compression=None), hashlib.sha256(), 0, 0
        member = _gzip_member(record)
        self.out.write(member)
        self.hash.update(member)
        self.bytes += len(member)
        self.records += 1
        if self.bytes >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temporary, self.final)
            self.manifest.append({"shard": self.shard, "slice": self.slice, "part": self.part, "path": f"{self.folder}/{self.name}", "records": self.records, "bytes": self.bytes, "sha256": self.hash.hexdigest()})
            self.part, self.out = self.part + 1, None


def _write(folder: str, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        attempt = f"{context.stageId()}-{context.partitionId()}-{context.taskAttemptId()}"
        shard, done = None, []
        for b in batches:
            for row in b.to_pylist():
                key = (row["shard"], row["slice"])
                if shard is None or shard.key != key:
                    if shard is not None:
                        shard.close()
                        done += shard.manifest
                    shard = _Shard(folder, key, roll, attempt)
                if row["refers_to"] is None:
                    row["payload"] = row["payload"] or b""
                row["payload_digest"] = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
                shard.add(record_bytes(row))
        if shard is not None:
            shard.close()
            done += shard.manifest
        if done:
            yield pa.RecordBatch.from_pylist(done, pa.schema([("shard", pa.int64()), ("slice", pa.int32()), ("part", pa.int32()), ("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    return run


def _ordinal(ids: np.ndarray) -> np.ndarray:
    """64-bit ids as unsigned numbers in the same order."""
    return ids.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)


def shard_edges(rows: DataFrame, target: int) -> tuple[np.ndarray, dict[int, int]]:
    """First ids (as ordinals) of the shards, in order, ranges of about `target` bytes each; and in how many slices single ids over that are cut.

    rows has page_id and payload_bytes. The range of ids is counted in equal
    bins, about four a shard; bins that hold more than two shards are cut again
    until they don't or are a single id, so ids may be spread as they like: a
    round cuts a bin by at least two, and 64 bits end. Counts are exact, so the
    edges are the same in every run. Beyond MOST_SHARDS shards the target grows
    with the table, so the driver sees a bounded number of bins a round.
    """
    known = rows.where("page_id is not null")
    low, high, total = known.agg(F.min("page_id"), F.max("page_id"), F.sum(F.col("payload_bytes") + 512)).first()
    if low is None:
        return np.empty(0, np.uint64), {}
    target = max(target, -(-total // MOST_SHARDS))
    bins = int(max(BINS, 4 * total // target))
    cells, out = [tuple(int(x) for x in _ordinal(np.array([low, high])))], []  # first and last of each
    while cells:
        first, last = (np.array(side, np.uint64) for side in zip(*cells))
        width = (last - first) // np.uint64(bins) + np.uint64(1)

        @F.pandas_udf("long")
        def cell(ids: pd.Series) -> pd.Series:
            x = _ordinal(ids.to_numpy())
            at = np.clip(np.searchsorted(first, x, side="right").astype(np.int64) - 1, 0, None)
            start = first[at] + (x - first[at]) // width[at] * width[at]
            return pd.Series((start ^ np.uint64(1 << 63)).view(np.int64)).where(pd.Series((x >= first[at]) & (x <= last[at]))).astype("Int64")

        found = known.groupBy(cell("page_id").alias("cell")).agg(F.sum(F.col("payload_bytes") + 512).alias("weight")).where("cell is not null").collect()
        finer = []
        for start, weight in sorted((int(_ordinal(np.array([r["cell"]]))[0]), r["weight"]) for r in found):
            c = int(np.searchsorted(first, np.uint64(start), side="right")) - 1
            end = min(int(last[c]), start + int(width[c]) - 1)
            if weight > 2 * target and end > start:
                finer.append((start, end))
            else:
                out.append((start, weight))
        cells = finer
        bins = max(2, min(BINS, MOST_BINS // max(1, len(cells))))
    edges, held = [], target
    for start, weight in sorted(out):
        if held + weight / 2 >= target:
            edges.append(start)
            held = 0
        held += weight
    return np.array(edges, np.uint64), {start: -(-weight // target) for start, weight in out if weight > 2 * target}


def write_warc(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Write a record for each page into sharded, compressed archives; returns the manifest.

    pages has page_id, url and html. Of records with equal payloads (the html
    in UTF-8; null is empty) the one with the largest page_id is a response and
    the others revisit it. Shards are ranges of page_id whose edges come from
    exact counts; in a shard, records are sorted by page_id and files roll by
    compressed size, so equal tables give equal files whatever the cluster. A
    task writes under temporary names and renames closed files, so a lost or
    doubled task leaves whole files or hidden ones. The manifest, written last,
    is the commit: readers open what it lists.

    Rows with a null page_id go first, into shard 0, as responses. Of repeated
    rows with the largest id each is a response. Rows of one id, or of null ids,
    that outgrow a shard are cut into slices by their payloads' digests and
    URLs. An empty table gives an empty manifest. A page is held whole by its
    task, as a row is in Spark.
    """
    content = F.coalesce(F.col("html"), F.lit(""))
    key = F.unhex(F.sha2(content, 256)).alias("content")
    ids = pages.select("page_id", F.octet_length(content).cast("long").alias("payload_bytes"), key)
    repeated = stored(ids.groupBy("content").agg(F.max("page_id").alias("newest"), F.count("*").alias("n")).where("n > 1").select("content", "newest"), "newest")
    edges, heavy = shard_edges(ids, shard_bytes)
    large, cuts = np.array(sorted(heavy), np.uint64), np.array([n for _, n in sorted(heavy.items())], np.int64)
    nulls = ids.where("page_id is null").agg(F.sum(F.col("payload_bytes") + 512)).first()[0] or 0

    @F.pandas_udf("long")
    def shard(page_ids: pd.Series) -> pd.Series:
        return pd.Series(np.clip(np.searchsorted(edges, _ordinal(page_ids.to_numpy()), side="right").astype(np.int64) - 1, 0, None))

    @F.pandas_udf("long")
    def parts(page_ids: pd.Series) -> pd.Series:
        x = _ordinal(page_ids.to_numpy())
        at = np.clip(np.searchsorted(large, x), 0, max(0, len(large) - 1))
        return pd.Series(np.where(large[at] == x, cuts[at], 1) if len(large) else np.ones(len(x), np.int64))

    id_or_least = F.coalesce(F.col("page_id"), F.lit(-(1 << 63)))  # a column with nulls would come as floats
    slices = F.when(F.col("page_id").isNull(), F.lit(-(-nulls // shard_bytes) or 1)).otherwise(parts(id_or_least))
    rows = pages.select("page_id", "url", content.cast("binary").alias("payload"), key)
    rows = rows.join(F.broadcast(repeated) if repeated.count() <= broadcast_rows else repeated, "content", "left")
    refers_to = F.when(F.col("page_id") < F.col("newest"), F.col("newest"))
    rows = rows.select(
        shard(id_or_least).alias("shard"), F.pmod(F.xxhash64("content", "url"), slices).cast("int").alias("slice"), "page_id", "url", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("sha1"),
        refers_to.alias("refers_to"), F.when(refers_to.isNull(), F.col("payload")).alias("payload"),
    )
    dealt = rows.repartitionByRange(max(1, len(edges)), "shard", "slice").sortWithinPartitions("shard", "slice", "page_id", "url", "sha1")
    manifest = dealt.mapInArrow(_write(folder.rstrip("/"), roll_bytes), MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")
    drop_stored(repeated)
    _drop_temporary(pages.sparkSession, folder)
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _drop_temporary(spark: SparkSession, folder: str) -> None:
    """Delete what failed or doubled tasks have left under temporary names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/.shard-*")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for left in fs.globStatus(at) or ():
        fs.delete(left.getPath(), False)


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, stream.read(int(headers["content-length"]))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import gzip

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    number = lambda urn: None if urn == "<urn:page:None>" else int(urn.rpartition(":")[2].rstrip(">"))
    for b in batches:
        for path in b.column("path").to_pylist():
            fs, at = _file(path)
            out: list[dict] = []
            with fs.open_input_stream(at, compression=None) as raw, gzip.open(raw) as stream:
                for headers, block in parse_records(stream):
                    if digest_of(block) != headers["warc-block-digest"].removeprefix("sha1:"):
                        raise ValueError(f"{path}: a block doesn't match its digest")
                    response = headers["warc-type"] == "response"
                    out.append({
                        "page_id": number(headers["warc-record-id"]), "url": headers["warc-target-uri"], "payload": block.partition(b"\r\n\r\n")[2] if response else None,
                        "payload_bytes": int(headers["x-payload-length"]), "payload_digest": headers["warc-payload-digest"].removeprefix("sha1:"),
                        "record_type": headers["warc-type"], "refers_to": None if response else number(headers["warc-refers-to"]),
                    })
                    if len(out) >= 256:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)


def read_warc(manifest: DataFrame) -> DataFrame:
    """The records of the files that a manifest lists, checked against their digests.

    Files are dealt one to a task at most times; a file is read as a stream.
    """
    files = manifest.select("path")
    n = files.count()
    return files.repartition(max(1, min(n, 10_000))).mapInArrow(_read, RECORD)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to archives in shared storage and read back."""
    manifest = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), fresh_path(spark, "warc"))
    return read_warc(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
