"""Archives written and read back; revisits against plain grouping; foreign records."""

import gzip
import hashlib
import os

from inkwell.llm import warc as W
from inkwell.llm.workspace import Workspace
from pyspark.sql import functions as F

LONG = "é" * 60 + "<p>long enough to be revisited, by its bytes</p>"
#: A page that quotes a whole record, in the middle and at its end.
QUOTE = "x" * 80 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\n"


def pages(spark):
    rows = [
        (7, "http://a/7", LONG), (3, "http://a/3", LONG), (5, None, LONG), (9, "http://a/\r\nX: y", QUOTE), (8, "http://a/8", QUOTE), (1, "u", None), (2, "u", ""),
        (4, "u", "short"), (6, "u", "short"), (None, "u", LONG), (11, "u", "y" * 100), (10, "u", "y" * 100), (12, "u", "z" * 99), (13, "u", "z" * 99), (14, "u", "\r\n\r\n" * 30),
        (15, "u", "w" * 200), (15, "u", "w" * 200), (16, "u", "w" * 200), (15, "u", "v" * 200), (None, "u", "n" * 200), (None, "u", "n" * 200), (20, "u", "long " * 400_000),
    ]
    return spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, record_id string")


def plain(rows):
    first = {}
    for r in rows:
        if r.page_id is not None:
            first[r.html or ""] = min(r.page_id, first.get(r.html or "", r.page_id))
    for r in rows:
        data = (r.html or "").encode()
        f = first.get(r.html or "")
        again = len(data) >= 100 and f is not None and r.page_id != f
        yield r.page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", f if again else None


def test_pages_round_trip(spark):
    df = pages(spark)
    back = W.page_archives(df.repartition(3)).cache()
    assert back.filter("NOT complete").count() == 0
    got = back.select("page_id", "bytes", "digest", "type", "refers_to_page").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain(df.collect())))
    texts = {(r.page_id, bytes(r.payload)) for r in back.filter("type = 'response'").collect()}
    assert (8, QUOTE.encode()) in texts and (20, ("long " * 400_000).encode()) in texts
    assert all(not r.payload and r.http for r in back.filter("type = 'revisit'").collect())
    assert back.filter("page_id = 9").first().uri == "http://a/%0D%0AX:%20y"
    assert back.filter("page_id = 7").first().head.count("WARC-Refers-To: <urn:page:3>") == 1
    assert W.page_archives(df.filter("false")).count() == 0


def test_the_files_are_warc(spark, tmp_path):
    text = W.response_text(F.lit("urn:x"), F.lit("http://x"), F.lit("2024-01-01T00:00:00Z"), F.col("html"))
    W.write_archives(pages(spark).coalesce(1).select(text.alias("value")), str(tmp_path / "a"))
    [name] = [x for x in os.listdir(tmp_path / "a") if x.endswith(".gz")]
    data, at, n = gzip.open(tmp_path / "a" / name).read(), 0, 0
    while at < len(data):  # by lengths alone, as the format has it
        assert data.startswith(b"WARC/1.1\r\n", at)
        end = data.index(b"\r\n\r\n", at)
        length = int(data[at:end].split(b"Content-Length: ")[1].split(b"\r\n")[0])
        at, n = end + 4 + length + 4, n + 1
        assert data[at - 4 : at] == b"\r\n\r\n"
    assert n == pages(spark).count()


def test_foreign_records_pass(spark, tmp_path):
    info = "WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:i>\r\nContent-Type: application/warc-fields\r\nContent-Length: 7\r\n\r\na: b\r\n\x00"
    odd = "WARC/1.1\r\nwarc-type: Response\r\nwarc-record-id: <urn:o>\r\ncontent-type: application/http; msgtype=response\r\ncontent-length: 900\r\n\r\nHTTP/1.1 200\r\nContent-Length: 1\r\n\r\ncut"
    none = "WARC/1.1\r\nWARC-Type: response\r\n\r\nno length"
    W.write_archives(spark.createDataFrame([(info,), (none,), (odd,)], "value string").coalesce(1), str(tmp_path / "a"))
    W.deduplicate(spark, str(tmp_path / "a"), str(tmp_path / "b"), F.col("record_id"), Workspace(spark, "warc"))
    for folder in "ab":
        got = {r.type: r for r in W.read_archives(spark, str(tmp_path / folder)).collect() if r.record_id}
        assert bytes(got["warcinfo"].payload) == b"a: b\r\n\x00" and got["warcinfo"].complete
        assert not got["response"].complete and bytes(got["response"].payload) == b"cut"
        assert W.read_archives(spark, str(tmp_path / folder)).filter("record_id IS NULL AND NOT complete").count() == 1


def test_many_copies_meet_the_smallest(spark):
    rows = spark.range(5000).select(
        F.concat(F.lit("urn:"), "id").alias("record_id"), F.lit("u").alias("uri"), F.lit("d").alias("date"), F.col("id").alias("order"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("digest"), F.when(F.col("id") == 9, 99).otherwise(100).alias("bytes"),
    )
    found = W.resolve_revisits(rows)
    assert found.count() == 1665 and found.filter("first.order <> 0 OR digest <> 'hot'").count() == 0
