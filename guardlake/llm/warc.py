"""WARC archives: writing with segments and revisits, reading with segment reassembly.

An archive is a plain text-sink file of whole records: the two line ends that close a record are
the sink's line separator, so any file system that Spark writes to will do.  A block longer than
`segment_bytes` is cut into a first record and continuation records.  Reading parses each archive
file where it lies; only the segments of cut blocks are grouped, by origin identifier, put in order
of their numbers, checked against the total length, and joined.  Bodies in chunked transfer framing
are decoded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guardlake.llm.common import bounded_batches
from guardlake.session import new_folder, stored

SEGMENT_BYTES, CHUNK_BYTES, ARCHIVE_BYTES, MIN_REVISIT_BYTES = 16384, 4096, 8 << 20, 1000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
RECORD = ("record_id string, type string, page_id long, uri string, digest string, "
          "refers_to_id string, origin_id string, segment int, total_bytes long, block binary")


def planned(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, record_id, type, refers_to_id) per page.

    Of equal payloads of at least `min_bytes`, the largest page_id (null first) is the response.
    The pages are read twice, so that payloads are never shuffled: once for the digests that
    come more than once, once for the records.  Rows have to come in the same order both times, as
    tables do; if they don't, reading finds a revisit without its response and says so.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    # the number makes identifiers differ where rows repeat a page_id
    number = F.monotonically_increasing_id()
    rows = pages.select("page_id", "url", payload.alias("payload"), number.alias("number"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("record_id", F.concat(
        F.lit("urn:md5:"), F.md5(F.concat_ws("-", F.col("page_id").cast("string"),
                                             F.col("number").cast("string"), "digest"))))
    large = F.octet_length("payload") >= min_bytes
    order = F.struct(F.col("page_id").isNotNull(), "page_id", "number")
    first = stored(rows.where(large).groupBy("digest")
                   .agg(F.max_by("record_id", order).alias("first_id"),
                        F.max("page_id").alias("top"), F.count("*").alias("copies"))
                   .where("copies > 1").drop("copies"), "warc-first")
    revisit = F.col("first_id").isNotNull() & large & ~F.col("page_id").eqNullSafe(F.col("top"))
    return rows.join(first, "digest", "left").select(
        "page_id", "url", "digest", "record_id",
        F.when(revisit, "revisit").otherwise("response").alias("type"),
        F.when(revisit, F.col("first_id")).alias("refers_to_id"),
        F.when(~revisit, F.col("payload")).alias("payload"))


def chunked(payload: bytes, size: int) -> bytes:
    """A payload in chunked transfer framing."""
    parts = [payload[i:i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing; extensions and trailers are passed over."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(parts)
        part = body[end + 2:end + 2 + size]
        if len(part) < size or body[end + 2 + size:end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut short")
        parts.append(part)
        at = end + 4 + size


def _head(fields: list[tuple[str, object]]) -> bytes:
    lines = [f"{k}: {v}" for k, v in fields if v is not None]
    return ("WARC/1.0\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode()


def records_of(page: dict, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The records of one page, without the line ends that close them."""
    own = [("WARC-Record-ID", f"<{page['record_id']}>"), ("WARC-Page-ID", page["page_id"]),
           ("WARC-Target-URI", re.sub(r"[\r\n]", " ", page["url"]) if page["url"] else None),
           ("WARC-Payload-Digest", f"sha1:{page['digest']}")]
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if page["type"] == "revisit":
        yield _head([("WARC-Type", "revisit"), *own, ("WARC-Profile", REVISIT_PROFILE),
                     ("WARC-Refers-To", f"<{page['refers_to_id']}>"),
                     ("Content-Type", "application/http; msgtype=response"),
                     ("Content-Length", len(status) + 2)]) + status + b"\r\n"
        return
    block = (status + b"Transfer-Encoding: chunked\r\n\r\n"
             + chunked(page["payload"], chunk_bytes))
    cuts = range(0, len(block), segment_bytes)
    for number, start in enumerate(cuts, 1):
        part, last = block[start:start + segment_bytes], number == len(cuts)
        if number == 1:
            fields = [("WARC-Type", "response"), *own,
                      ("Content-Type", "application/http; msgtype=response"),
                      ("WARC-Segment-Number", None if last else 1)]
        else:
            fields = [("WARC-Type", "continuation"),
                      ("WARC-Record-ID", f"<{page['record_id']}:{number}>"),
                      ("WARC-Segment-Origin-ID", f"<{page['record_id']}>"),
                      ("WARC-Segment-Number", number),
                      ("WARC-Segment-Total-Length", len(block) if last else None)]
        yield _head([*fields, ("Content-Length", len(part))]) + part


def write_archives(plan: DataFrame, folder: str, segment_bytes: int = SEGMENT_BYTES,
                   chunk_bytes: int = CHUNK_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write the planned pages as archives of at most about `archive_bytes` each below `folder`."""
    bounded_batches(plan.sparkSession)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, size = [], 0
            for page in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                for record in records_of(page, segment_bytes, chunk_bytes):
                    made.append(record)
                    size += len(record)
                if size >= 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["record"])
                    made, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["record"])

    records = plan.mapInArrow(build, "record binary").select(F.col("record").cast("string"))
    (records.write.option("lineSep", "\r\n\r\n")
     .option("maxRecordsPerFile", max(1, archive_bytes // segment_bytes)).text(folder))


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The (lower-case header fields, block) of every record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start = end + 4
        at = start + int(fields["content-length"])
        yield fields, data[start:at]
        if data[at:at + 4] != b"\r\n\r\n":
            raise ValueError(f"the record that ends at byte {at} isn't closed")
        at += 4


def _bare(value: str | None) -> str | None:
    return value.strip("<>") if value else None


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the archives below `folder`, in the columns of `RECORD`."""
    names = [x.split()[0] for x in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for h, block in parsed(content.as_py()):
                    number, page = h.get("warc-segment-number"), h.get("warc-page-id")
                    total = h.get("warc-segment-total-length")
                    rows.append((
                        _bare(h.get("warc-record-id")), h.get("warc-type"),
                        int(page) if page else None, h.get("warc-target-uri"),
                        (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
                        _bare(h.get("warc-refers-to")), _bare(h.get("warc-segment-origin-id")),
                        int(number) if number else None, int(total) if total else None, block))
                    size += len(block)
                    if size >= 8 << 20:
                        yield _batch(rows, names)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, names)

    bounded_batches(spark)
    files = spark.read.format("binaryFile").load(folder).where("length > 0").select("content")
    return files.mapInArrow(run, RECORD)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(),
             pa.string(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names)


def reassembled(records: DataFrame) -> DataFrame:
    """The records whose blocks were cut, each with its whole block, in the columns of `RECORD`.

    Raises if a number is missing or comes twice, or if the length is not the total.
    """
    def join(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("segment").drop_columns("origin")
        numbers = table.column("segment").to_pylist()
        block = b"".join(table.column("block").to_pylist())
        total = table.column("total_bytes").to_pylist()[-1]
        if numbers != list(range(1, len(numbers) + 1)) or total != len(block):
            raise ValueError(f"record {key[0].as_py()}: segments {numbers[:20]}, "
                             f"{len(block)} of {total} bytes")
        first = table.slice(0, 1).drop_columns(["segment", "total_bytes", "block"])
        return (first.append_column("segment", pa.array([None], pa.int32()))
                .append_column("total_bytes", pa.array([total], pa.int64()))
                .append_column("block", pa.array([block], pa.binary())))

    cut = records.where("segment is not null").withColumn(
        "origin", F.coalesce("origin_id", "record_id"))
    return cut.groupBy("origin").applyInArrow(join, RECORD)


def payload_of(block: Column) -> Column:
    """The decoded body of an HTTP response block, by a Python function over Arrow batches."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("binary")
    def decode(blocks: pa.Array) -> pa.Array:
        out = []
        for value in blocks:
            head, _, body = value.as_py().partition(b"\r\n\r\n")
            framed = re.search(rb"(?im)^transfer-encoding:[ \t]*chunked[ \t]*\r?$", head)
            out.append(dechunked(body) if framed else body)
        return pa.array(out, pa.binary())

    return decode(block)


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(record_id, page_id, uri, type, digest, refers_to_id, payload) of all archived pages.

    Whole blocks are decoded where they are read; only the segments of cut blocks are shuffled.
    """
    names = ["record_id", "page_id", "uri", "type", "digest", "refers_to_id"]
    records = read_records(spark, folder)
    whole = records.where("type <> 'continuation' and segment is null").select(*names, "block")
    joined = reassembled(records).select(*names, "block")
    blocks = whole.unionByName(joined)
    responses = blocks.where("type = 'response'").select(*names, payload_of(
        F.col("block")).alias("payload"))
    return responses.unionByName(blocks.where("type <> 'response'").select(
        *names, F.lit(None).cast("binary").alias("payload")))


def archived(pages: DataFrame) -> DataFrame:
    """Write the pages (page_id, url, html) to archives, read them back, and report per page.

    A null html is an empty payload; a null url or page_id is left out of the record and comes
    back as null.  Rows that repeat a page_id have records of their own; those that repeat the
    page_id of the response of their payload are responses, too.
    """
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    write_archives(planned(pages), folder)
    found = stored(read_pages(spark, folder).select(
        "record_id", "page_id", "type", "refers_to_id", F.octet_length("payload").alias("size"),
        F.sha1("payload").alias("found"), "digest"), "warc-pages")
    wrong = found.where("type = 'response' and found <> digest").limit(1).collect()
    if wrong:
        raise ValueError(f"payload differs from its digest: {wrong[0]}")
    first = found.where("type = 'response'").select(
        F.col("record_id").alias("first_id"), F.col("page_id").alias("first_page"),
        F.col("size").alias("first_size"), F.col("found").alias("first_found"))
    # only pages that are referred to take part in the join
    used = found.where("type = 'revisit'").select(
        F.col("refers_to_id").alias("first_id")).distinct()
    first = stored(first.join(used, "first_id"), "warc-referred")
    if used.join(first, "first_id", "left_anti").limit(1).count():
        raise ValueError("a revisit refers to a record that isn't there")
    return found.join(first, found.refers_to_id == first.first_id, "left").select(
        "page_id", F.coalesce("size", "first_size").cast("long").alias("payload_bytes"),
        F.coalesce("found", "first_found").alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("first_page").alias("refers_to"))


ORACLE = f"""
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes,
             sha1(coalesce(html, '')) as payload_digest from pages),
m as (select *, case when payload_bytes >= {MIN_REVISIT_BYTES} then
        max(page_id) over (partition by payload_digest) end as top from p)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
  case when top <> page_id then 'revisit' else 'response' end as record_type,
  case when top <> page_id then top end as refers_to from m"""
