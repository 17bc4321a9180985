"""A deterministic sharded WARC writer, and a reader for what it wrote.

Records are ordered by page_id and url. Shards are cut from that order at exact sums of payload bytes, so
which records stand in which shard hangs on the rows alone, not on partitions or sampling. Each shard's
task writes gzip members one after another and starts a new file when one reaches ``roll_bytes``
compressed. A file is written under a temporary name of the attempt and renamed to its final name; where a
first attempt has put it in place already, it holds the same bytes and stays. A manifest, written by Spark
after all files are in place, lists files with sizes and digests, and readers open nothing else.

Of records with equal payloads the one with the largest page_id is the response; the others are revisits,
which carry headers and digests but no payload. Several rows of one page_id are several records, numbered in
their order.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treefuse.llm.shared import cut, shared_dir

DATE = "1970-01-01T00:00:00Z"
MANIFEST = "shard int, seq int, file string, bytes bigint, records bigint, sha256 string"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), *fields, ("WARC-Block-Digest", f"sha1:{sha1(block)}"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def plain(url: str | None) -> str:
    """A header's value: characters that would end the line are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def page_record(name: str, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    fields = [
        ("WARC-Record-ID", f"<urn:page:{name}>"), ("WARC-Date", DATE), ("WARC-Target-URI", plain(url)),
        ("WARC-Payload-Digest", f"sha1:{sha1(payload)}"), ("WARC-Payload-Length", str(len(payload))), ("Content-Type", "application/http;msgtype=response"),
    ]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        return record("response", fields, head + payload)
    return record("revisit", [*fields, ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)], head)


def gzipped(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class ShardWriter:
    """Writes one shard's files; ``done`` has a manifest row for each."""

    def __init__(self, out: str, shard: int, roll_bytes: int, level: int):
        self.fs, self.root = pafs.FileSystem.from_uri(out)
        self.shard, self.roll, self.level = shard, roll_bytes, level
        self.parts, self.size, self.records, self.done = [], 0, 0, []

    def add(self, data: bytes) -> None:
        if not self.parts:
            name = f"{self.shard:06d}-{len(self.done):05d}.warc.gz"
            info = b"software: treefuse\r\nformat: WARC File Format 1.1\r\n"
            head = [("WARC-Record-ID", f"<urn:file:{name}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
            self.name = name
            self.parts = [gzipped(record("warcinfo", head, info), self.level)]
            self.size = len(self.parts[0])
        self.parts.append(gzipped(data, self.level))
        self.size += len(self.parts[-1])
        self.records += 1
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if not self.parts:
            return
        data = b"".join(self.parts)
        context = TaskContext.get()
        temporary = f"{self.root}/.{self.name}.{context.taskAttemptId() if context else 0}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(temporary) as f:
            f.write(data)
        final = f"{self.root}/{self.name}"
        if self.fs.get_file_info(final).size == len(data):  # an earlier attempt's: renamed whole, and the same
            self.fs.delete_file(temporary)
        else:
            self.fs.move(temporary, final)
        self.done.append((self.shard, len(self.done), self.name, len(data), self.records, hashlib.sha256(data).hexdigest()))
        self.parts, self.size, self.records = [], 0, 0


def shard_starts(light: DataFrame, shard_bytes: int) -> list[int]:
    """The first page_id of each shard: page_ids in order, a new shard whenever the sum of bytes before a
    page_id passes another ``shard_bytes``. The list has one entry a shard, none a row."""
    ordered = cut(light.groupBy("page_id").agg(F.sum("n").alias("n")).repartitionByRange("page_id")).withColumn("p", F.spark_partition_id())
    sums = cut(ordered.groupBy("p").agg(F.sum("n").alias("n"), F.min("page_id").alias("low")))
    offsets = sums.select("p", (F.sum("n").over(Window.orderBy("low")) - F.col("n")).alias("offset"))  # a row a partition
    inner = F.sum("n").over(Window.partitionBy("p").orderBy("page_id"))
    shards = ordered.withColumn("inner", inner - F.col("n")).join(F.broadcast(offsets), "p")
    return [r["low"] for r in shards.groupBy(F.floor((F.col("inner") + F.col("offset")) / shard_bytes).alias("s")).agg(F.min("page_id").alias("low")).orderBy("s").collect()]


def record_name(page_id: Column, k: Column) -> Column:
    return F.concat(page_id.cast("string"), F.when(k > 0, F.concat(F.lit(":"), k.cast("string"))).otherwise(""))


def write_archives(pages: DataFrame, out: str, min_revisit_bytes: int = 0, shard_bytes: int = 64 << 20, roll_bytes: int = 8 << 20, level: int = 6) -> DataFrame:
    """pages(page_id, url, html) -> the manifest, read back from ``out``/manifest.

    Null html is an empty payload, a null url an empty one. Rows without page_id are left out. Every other row
    is a record: rows of one page_id are numbered from 0 by url and payload digest, the first being named by
    its page_id alone. Payloads of fewer than ``min_revisit_bytes`` bytes are always responses. Of equal payloads
    under one page_id the row with the highest number is the response. An empty table gives a manifest without
    files. Other columns are ignored.

    A digest that a great many pages have is one row on its side of a join that Spark splits on the other.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.where("page_id is not null").select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"))
    digest = F.sha1(F.encode("html", "UTF-8")).alias("digest")
    light = pages.select("page_id", "url", digest, F.octet_length("html").cast("bigint").alias("n"))
    light = cut(light.withColumn("k", F.row_number().over(Window.partitionBy("page_id").orderBy("url", "digest")) - 1))
    first = light.groupBy("digest", "n").agg(F.max(F.struct("page_id", "k")).alias("w"), F.count(F.lit(1)).alias("c")).where((F.col("c") > 1) & (F.col("n") >= min_revisit_bytes))
    refs = light.join(first, ["digest", "n"]).where(F.struct("page_id", "k") != F.col("w")).select("page_id", "k", record_name(F.col("w.page_id"), F.col("w.k")).alias("refers_to"))
    starts = np.asarray(shard_starts(light, shard_bytes), np.int64)

    @F.pandas_udf("int")
    def shard_of(page_id: pd.Series) -> pd.Series:
        return pd.Series(np.maximum(np.searchsorted(starts, page_id.to_numpy(), "right") - 1, 0).astype(np.int32))

    # A page_id's references stand before its rows, which are numbered as they come.
    text, number = F.lit(None).cast("string"), F.lit(None).cast("int")
    rows = refs.select("page_id", F.lit(0).alias("kind"), "k", "refers_to", text.alias("url"), text.alias("digest"), text.alias("html")).unionByName(
        pages.select("page_id", F.lit(1).alias("kind"), number.alias("k"), text.alias("refers_to"), "url", digest, "html")
    )
    # A partition for each shard, whatever its number's hash.
    rows = rows.withColumn("shard", shard_of("page_id")).repartitionById(max(1, len(starts)), "shard").sortWithinPartitions("shard", "page_id", "kind", "url", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, page, k, refers = None, None, 0, {}
        for batch in batches:
            for shard, page_id, kind, number, refers_to, url, text in zip(*(batch.column(c) for c in ("shard", "page_id", "kind", "k", "refers_to", "url", "html")), strict=True):
                if writer is None or writer.shard != shard.as_py():
                    if writer is not None:
                        writer.close()
                        yield manifest_rows(writer.done)
                    writer = ShardWriter(out, shard.as_py(), roll_bytes, level)
                if page_id.as_py() != page:
                    page, k, refers = page_id.as_py(), 0, {}
                if kind.as_py() == 0:
                    refers[number.as_py()] = refers_to.as_py()
                else:
                    writer.add(page_record(f"{page}:{k}" if k else str(page), url.as_py(), text.as_buffer().to_pybytes(), refers.get(k)))
                    k += 1
        if writer is not None:
            writer.close()
            yield manifest_rows(writer.done)

    fs, root = pafs.FileSystem.from_uri(out)
    fs.create_dir(root, recursive=True)
    rows.mapInArrow(run, MANIFEST).write.parquet(f"{out}/manifest")
    return spark.read.parquet(f"{out}/manifest")


def manifest_rows(done: list[tuple]) -> pa.RecordBatch:
    kinds = [("shard", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()), ("sha256", pa.string())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, (_, t) in enumerate(kinds)], names=[k for k, _ in kinds])


def members(f) -> Iterator[bytes]:
    """The gzip members of a file, one at a time."""
    z, out = zlib.decompressobj(31), []
    while data := f.read(1 << 20):
        while data:
            out.append(z.decompress(data))
            data = z.unused_data
            if z.eof:
                yield b"".join(out)
                z, out = zlib.decompressobj(31), []
    if out and any(out):
        raise ValueError("a member is cut short")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or fields["WARC-Block-Digest"] != f"sha1:{sha1(block)}":
        raise ValueError("a record's block differs from its digest")
    return fields, block


def read_archives(manifest: DataFrame, out: str, most_tasks: int = 100_000) -> DataFrame:
    """Manifest -> page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for
    revisits). Each file's size, each block's and each payload's digest are checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(out)
        number = lambda x: int(x.strip("<>").split(":")[2])
        for batch in batches:
            for name, size in zip(batch.column("file").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                if fs.get_file_info(f"{root}/{name}").size != size:
                    raise ValueError(f"{name} differs from the manifest")
                rows, held = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    for fields, block in map(parse, members(f)):
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        payload = block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else None
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if payload is not None and sha1(payload) != digest:
                            raise ValueError(f"{name}: a payload differs from its digest")
                        refers = number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
                        rows.append((number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], int(fields["WARC-Payload-Length"]), digest, fields["WARC-Type"], refers, payload))
                        held += len(payload or b"")
                        if held > 4 << 20:
                            yield record_rows(rows)
                            rows, held = [], 0
                if rows:
                    yield record_rows(rows)

    files = manifest.select("file", "bytes")
    files = files.repartition(min(max(1, files.count()), most_tasks), "file")  # a number that Spark keeps: small rows here stand for whole files
    return files.mapInArrow(run, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary")


def record_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], names=[k for k, _ in kinds])


def op2_warc(spark, sf_dir: str) -> DataFrame:
    out = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), out)
    return read_archives(manifest, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BASE32 = " || ".join(f"substr('{_LETTERS}', ((('0x' || substr(h, {5 * i + 1}, 5))::BIGINT >> {b}) & 31)::INTEGER + 1, 1)" for i in range(8) for b in (15, 10, 5, 0))
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages), w AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to FROM w
"""
