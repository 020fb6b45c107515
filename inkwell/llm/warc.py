"""Operator 12: WARC archives of web pages, with revisit records in place of repeated payloads.

Archives are written by Spark's own text writer: a record is a text of headers, a blank line and the block, and
the two line ends that close it are the line separator of the write. So they can go to any file system that
Spark reaches, tasks that fail leave nothing, and every file is a gzip stream. Reading cuts the files at the
version line, the line separator of the read; a block that holds a version line itself is put together again by
its Content-Length. A gzip file is read by one task from its start, in order, so that takes no shuffle and
holds one record at a time.

Revisits: the headers alone, not the payloads, are shuffled by payload digest, to the record with the smallest
``order`` of each digest; every later record of at least ``MIN_BYTES`` is joined to it. A digest with very many
records gives one row for each task there, and the join is one that Spark splits. Only the revisits, mostly
few, are then joined to the archive that is read again; Spark broadcasts them where their table is
below its threshold, and shuffles otherwise. The new archive holds other records as they were, and revisits
with fresh headers, the HTTP header and no payload.

Defined cases: a null payload is an empty one; a null URL gives a record without target; control characters in a
URL are percent-encoded, so no URL adds a header line; records without ``order`` are never the original, and
revisit one that has it; records that share the smallest order (rows of one id) all stay responses; records that
are no responses (warcinfo, revisits of before) pass as they are; a record cut short or without length is read
with ``complete`` false and passes too; an empty table gives an archive without records; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace, table

# Fixed values of the format.
VERSION, END = "WARC/1.1\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http;msgtype=response"
MIN_BYTES = 100
_RECORD = "path string, head string, http binary, payload binary, complete boolean"


def _head(*fields: tuple[str, Column]) -> Column:
    """Header lines of a record; a field without value has none."""
    line = lambda k, v: F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))).otherwise("")
    return F.concat(*[line(k, v) for k, v in fields])


def _uri(c: Column) -> Column:
    """A URL with its control characters and blanks percent-encoded."""
    clean = c
    for code in (*range(0x21), 0x7F):
        clean = F.replace(clean, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(c.rlike(r"[\x00-\x20\x7F]"), clean).otherwise(c)


def _named(c: Column) -> Column:
    return F.concat(F.lit("<"), c, F.lit(">"))


def response_text(record_id: Column, uri: Column, date: Column, payload: Column) -> Column:
    """A response record without the line ends that close it."""
    said = F.coalesce(payload, F.lit(""))
    size = F.octet_length(said)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit(END))
    head = _head(
        ("WARC-Type", F.lit("response")), ("WARC-Record-ID", _named(record_id)), ("WARC-Date", date), ("WARC-Target-URI", _uri(uri)),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.sha2(said.cast("binary"), 256))), ("Content-Type", F.lit(HTTP_TYPE)),
        ("Content-Length", (F.octet_length(http) + size).cast("string")),
    )
    return F.concat(F.lit(VERSION), head, F.lit("\r\n"), http, said)


def revisit_text(record_id: Column, uri: Column, date: Column, digest: Column, http: Column, first: Column) -> Column:
    """A revisit record: fresh headers that name the first response, the HTTP header, no payload."""
    head = _head(
        ("WARC-Type", F.lit("revisit")), ("WARC-Record-ID", _named(record_id)), ("WARC-Date", date), ("WARC-Target-URI", uri),
        ("WARC-Refers-To", _named(first["record_id"])), ("WARC-Refers-To-Target-URI", first["uri"]), ("WARC-Refers-To-Date", first["date"]),
        ("WARC-Profile", F.lit(PROFILE)), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)), ("Content-Type", F.lit(HTTP_TYPE)),
        ("Content-Length", F.octet_length(http).cast("string")),
    )
    return F.concat(F.lit(VERSION), head, F.lit("\r\n"), http.cast("string"))


def write_archives(texts: DataFrame, folder: str, text: str = "value") -> None:
    """Write record texts as gzip archives, one file a task; compressed for speed, as they are written and read more than once."""
    out = texts.select(F.col(text).alias("value")).write.mode("overwrite").option("lineSep", END)
    out.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(folder)


def _records(batches: Iterator) -> Iterator:
    """Whole records from the pieces between version lines, which come in the order of each file."""
    import pyarrow as pa

    length, version = re.compile(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$"), VERSION.encode()
    names = [c.split(" ")[0] for c in _RECORD.split(", ")]
    path, held, need = None, None, 0

    def cut(piece: bytes, whole: bool) -> tuple:
        head, _, block = piece.partition(END.encode())
        block = block[: -len(END)] if block.endswith(END.encode()) else block
        is_http = re.search(rb"(?im)^content-type:[ \t]*application/http", head)
        http, end, payload = block.partition(END.encode()) if is_http else (b"", b"", block)
        return path, head.decode("utf-8", "replace"), http + end, payload, whole

    def size(piece: bytes) -> int:
        """Bytes of the record that begins with this piece, 0 if it has no length."""
        at = piece.find(END.encode())
        found = length.search(piece, 0, at + 1) if at >= 0 else None
        return at + len(END) + int(found[1]) + len(END) if found else 0

    for batch in batches:
        out = []
        for at, piece in zip(batch["path"].to_pylist(), batch["value"].to_pylist(), strict=True):
            if at != path:
                if held is not None:
                    out.append(cut(held, False))
                path, held = at, None  # what stands before the first version line of a file is no record
                continue
            if held is None:
                held, need = bytearray(piece), size(piece)
            else:
                held += version + piece
            if len(held) >= need:
                out.append(cut(bytes(held), len(held) == need))
                held = None
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 5, (pa.string(), pa.string(), pa.binary(), pa.binary(), pa.bool_()), strict=True)], names)
    if held is not None:
        last = [[v] for v in cut(bytes(held), False)]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(last, (pa.string(), pa.string(), pa.binary(), pa.binary(), pa.bool_()), strict=True)], names)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """path, head, http, payload, complete of every record, and its fields: type, record_id, uri, date, digest, bytes, refers_to.

    ``bytes`` is the length of the full payload, as the HTTP header has it.
    """
    pieces = spark.read.option("lineSep", VERSION).text(folder)
    records = pieces.select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("value")).mapInArrow(_records, _RECORD)

    def field(name: str, value: str = "(.*?)", of: Column = F.col("head")) -> Column:
        return F.nullif(F.regexp_extract(of, rf"(?im)^{name}:[ \t]*{value}[ \t]*\r?$", 1), F.lit(""))

    return records.withColumns(
        {
            "type": F.lower(field("WARC-Type")), "record_id": field("WARC-Record-ID", "<(.*?)>"), "uri": field("WARC-Target-URI"), "date": field("WARC-Date"),
            "digest": field("WARC-Payload-Digest", "sha256:(.*?)"), "bytes": field("Content-Length", r"(\d+)", F.col("http").cast("string")).cast("long"),
            "refers_to": field("WARC-Refers-To", "<(.*?)>"),
        }
    )


def resolve_revisits(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """record_id, digest, first: the revisits among response headers (record_id, uri, date, digest, bytes, order)."""
    large = headers.filter(F.col("bytes") >= min_bytes)
    known = F.when(F.col("order").isNotNull(), F.struct("order", "record_id", "uri", "date"))
    first = large.groupBy("digest").agg(F.min(known).alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL")
    later = large.join(first, "digest").filter(~F.col("order").eqNullSafe(F.col("first.order")))
    return later.select("record_id", "digest", "first").distinct()


def deduplicate(spark: SparkSession, folder: str, out: str, order: Column, space: Workspace, min_bytes: int = MIN_BYTES) -> None:
    """Write the archives of a folder anew, later records of a payload as revisits; ``order`` is over the fields of a record."""
    records = read_archives(spark, folder)
    mine = (F.col("type") == "response") & F.col("complete")
    headers = records.filter(mine).select("record_id", "uri", "date", "digest", "bytes", order.alias("order"))
    found = space.save(resolve_revisits(headers, min_bytes), "revisits")
    found = found.select(F.col("record_id").alias("_id"), F.col("digest").alias("_digest"), "first")
    again = records.join(found, mine & (F.col("record_id") == F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    same = F.concat(F.lit(VERSION), F.col("head"), F.lit(END), F.col("http").cast("string"), F.col("payload").cast("string"))
    new = revisit_text(*map(F.col, ("record_id", "uri", "date", "digest", "http", "first")))
    write_archives(again.select(F.when(F.col("first").isNotNull(), new).otherwise(same).alias("value")), out)


def page_archives(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z", min_bytes: int = MIN_BYTES,
) -> DataFrame:
    """Write pages as archives, deduplicate them, and read back what was written."""
    spark, space = pages.sparkSession, Workspace(pages.sparkSession, "warc")
    record_id = F.concat(F.lit("urn:page:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    write_archives(pages.select(response_text(record_id, F.col(url), F.lit(date), F.col(html)).alias("value")), f"{space.root}/crawled")
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    deduplicate(spark, f"{space.root}/crawled", f"{space.root}/archives", number(F.col("record_id")), space, min_bytes)
    space.drop("crawled")
    back = read_archives(spark, f"{space.root}/archives")
    return back.withColumns({"page_id": number(F.col("record_id")), "refers_to_page": number(F.col("refers_to"))})


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = page_archives(table(spark, sf_dir, "pages"))
    read = F.when(F.col("type") == "response", F.sha2("payload", 256)).otherwise(F.col("digest"))
    return back.select(
        "page_id", F.col("bytes").alias("payload_bytes"), read.alias("payload_digest"), F.col("type").alias("record_type"),
        F.col("refers_to_page").alias("refers_to"),
    )


OP12_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS bytes FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, bytes AS payload_bytes, digest AS payload_digest,
    CASE WHEN bytes >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN bytes >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to FROM f
"""
