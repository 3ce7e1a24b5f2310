"""WARC archives: writing, normalising monolithic gzip files, and reading back by offset.

Pages become response and revisit records of archives that are one gzip stream a file. The normaliser inflates such
a file once, front to back, writes every record as a gzip member of its own into a new file, and beside it a sidecar index
of offsets; memory stays at a few buffers, whatever the size of a file or a record. Files are dealt out as rows of paths;
a task writes under a name of its own and renames at the end, so a task that runs again leaves one whole file.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_folder, materialize, scratch_path, with_defaults

#: Equal payloads of at least so many bytes are stored once.
REVISIT_BYTES = 100

#: Records of an archive file at most, level of compression, bytes that are read at once.
FILE_RECORDS, LEVEL, BUFFER = 200_000, 6, 1 << 18

END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, n_bytes, digest, refers_to (null for responses); of equal payloads the smallest id is the response.

    Null html is empty. Rows that repeat the smallest id are responses too; a null id revisits any other.
    """
    rows = with_defaults(pages, page_id="long", url="string", html="string").select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumns({"n_bytes": F.octet_length("payload").cast("long"), "digest": F.sha2(F.col("payload").cast("binary"), 256)})
    first = rows.where(F.col("n_bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    # written, and only payloads that repeat: the join can then deal a payload that many pages share to several tasks
    first = materialize(first.where("n > 1 and first is not null").select("digest", "first"), "payloads")
    return rows.join(first, "digest", "left").withColumn("refers_to", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))).drop("first")


def _record_id(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page "), F.coalesce(page_id.cast("string"), F.lit("none"))))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(date: str) -> Column:
    """A record without the line ends that close it. Only the length says where its block ends, so any payload may follow."""
    revisit = F.col("refers_to").isNotNull()
    block = F.concat(F.lit(HTTP), F.when(revisit, "").otherwise(F.col("payload")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]+", "%20")
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", _record_id(F.col("refers_to"))), line("X-Refers-To-Page", F.col("refers_to").cast("string")))).otherwise(""),
        F.when(F.col("page_id").isNotNull(), line("X-Page", F.col("page_id").cast("string"))).otherwise(""),
        line("X-Payload-Length", F.col("n_bytes").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a record for each page into files below path, each one gzip stream, by Spark's own writer and its commits."""
    with_revisits(pages).select(_record(date).alias("value")).write.option("compression", "gzip").option("lineSep", END).option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri("file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri)


class _Inflated:
    """The bytes of a gzip file of one or more members, front to back."""

    def __init__(self, source):
        self.source, self.inflate, self.held = source, zlib.decompressobj(31), b""

    def more(self) -> bool:
        while True:
            if self.inflate.eof and self.inflate.unused_data:
                rest, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
            else:
                rest = self.inflate.unconsumed_tail or self.source.read(BUFFER)
                if not rest:
                    return False
                if self.inflate.eof:
                    self.inflate = zlib.decompressobj(31)
            got = self.inflate.decompress(rest, 4 * BUFFER)
            if got:
                self.held += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        """From the next byte that is no line end through the mark; None at the end."""
        while not (rest := self.held.lstrip(b"\r\n")):
            self.held = b""
            if not self.more():
                return None
        self.held, seen = rest, 0
        while (at := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                raise ValueError("the archive ends within a record's head")
        out, self.held = self.held[: at + len(mark)], self.held[at + len(mark) :]
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self.more():
                raise ValueError("the archive ends within a record")
            out, self.held = self.held[:n], self.held[n:]
            n -= len(out)
            yield out


def head_fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").lstrip("\r\n").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record begins with {lines[0][:40]!r}")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def _normalise(uri: str, folder: str) -> int:
    """Rewrite one file and write its index beside it, record by record; the number of records."""
    files, at = _open(uri)
    out_files, out_folder = _open(folder)
    name = at.rpartition("/")[2].split(".")[0]
    target = f"{out_folder}/{name}.warc.gz"
    mine = f"{out_folder}/.{name}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}"
    offset = records = 0
    with files.open_input_stream(at, compression=None) as raw, out_files.open_output_stream(f"{mine}.gz", compression=None) as out, out_files.open_output_stream(f"{mine}.idx", compression=None) as sidecar:
        source = _Inflated(raw)
        while (head := source.until(b"\r\n\r\n")) is not None:
            fields = head_fields(head)
            member = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            size = out.write(member.compress(head))
            for piece in source.pieces(int(fields["content-length"])):
                size += out.write(member.compress(piece))
            size += out.write(member.compress(b"\r\n\r\n") + member.flush())
            sidecar.write((json.dumps({"offset": offset, "length": size, "record_id": fields["warc-record-id"], "type": fields["warc-type"]}) + "\n").encode())
            offset, records = offset + size, records + 1
    out_files.move(f"{mine}.gz", target)
    out_files.move(f"{mine}.idx", f"{target}.idx")
    return records


_INDEX = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("type", pa.string())])


def normalise_archives(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Rewrite the gzip files below path to out, a member a record and a sidecar index (.idx) a file.

    Returns archive, offset, length, record_id, type of each record, read from the sidecars. A broken file fails.
    """
    out_files, folder = _open(out)
    out_files.create_dir(folder, recursive=True)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                yield pa.record_batch([pa.array([uri]), pa.array([_normalise(uri, out)], pa.int64())], names=["path", "records"])

    paths = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path")
    # dealt round, not by hash: as many files to each task
    paths.repartition(max(spark.sparkContext.defaultParallelism, 2)).mapInArrow(work, "path string, records long").write.format("noop").mode("overwrite").save()
    sidecars = spark.read.schema("offset long, length long, record_id string, type string").option("pathGlobFilter", "*.idx").json(out)
    return sidecars.withColumn("archive", F.regexp_replace(F.input_file_name(), r"\.idx$", "")).select(*_INDEX.names)


_READ = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("head", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])


def read_records(index: DataFrame) -> DataFrame:
    """archive, offset, head (fields), payload (without the HTTP head) of the records of an index, each read by its offset."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, opened = None, None
        for batch in batches:
            rows, size = [], 0
            for archive, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if archive != opened:
                    files, at = _open(archive)
                    source, opened = files.open_input_file(at), archive
                raw = zlib.decompress(source.read_at(length, offset), 31)
                head, _, rest = raw.partition(b"\r\n\r\n")
                fields = head_fields(head)
                payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")[2]
                rows.append({"archive": archive, "offset": offset, "head": list(fields.items()), "payload": payload})
                size += len(payload)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, _READ)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, _READ)

    return index.select("archive", "offset", "length").mapInArrow(work, "archive string, offset long, head map<string,string>, payload binary")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to as read back from normalised archives of pages.

    For a response the payload itself is measured, for a revisit its record says what the payload was. Repeated rows and
    null ids are records of their own; null html is an empty payload; extra columns are ignored.
    """
    spark = pages.sparkSession
    raw, folder = scratch_path(spark, "warc-raw"), scratch_path(spark, "warc")
    write_archives(pages, raw)
    index = normalise_archives(spark, raw, folder)
    drop_folder(spark, raw)
    records = read_records(index)
    get = lambda name: F.element_at("head", name)
    response = get("warc-type") == "response"
    return records.select(
        get("x-page").cast("long").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(get("x-payload-length").cast("long")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.substring_index(get("warc-payload-digest"), ":", -1)).alias("payload_digest"),
        get("warc-type").alias("record_type"),
        get("x-refers-to-page").cast("long").alias("refers_to"),
    )


def oracle() -> str:
    """DuckDB SQL for archive_round_trip() over the view pages."""
    return f"""with p as (select page_id, coalesce(html, '') as html from pages),
  d as (select page_id, strlen(html)::bigint as payload_bytes, sha256(html) as payload_digest from p),
  f as (select payload_digest, min(page_id) as first from d where payload_bytes >= {REVISIT_BYTES} group by 1)
select page_id, payload_bytes, d.payload_digest, case when first is distinct from page_id and first is not null then 'revisit' else 'response' end as record_type,
  case when first is distinct from page_id then first end as refers_to from d left join f using (payload_digest)"""
