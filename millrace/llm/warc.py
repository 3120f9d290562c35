"""WARC archives: writing, reading, and assembling transactions (operator 6).

A capture is a request, a response (or a revisit of an earlier equal payload) and
a metadata record; the request and the metadata name the response they are
concurrent to. Archives are written and read through Spark's own sources, so they
can lie in any store that Spark reaches.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._skew import hot_keys, salted_join
from ._store import Scratch

EOL = "\r\n"
VERSION = "WARC/1.1"
#: An archive is closed by the record that brings it to so many bytes.
ARCHIVE_BYTES = 64 << 20
#: Digests of payloads that occur again are broadcast up to this number, else joined.
BROADCAST_DIGESTS = 100_000
#: A gzip member of nothing, as text: what stands at the end of each archive where Spark's writer puts a line end.
_NOTHING = gzip.compress(b"", mtime=0).decode("latin-1")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_LAST = 2**63 - 1
#: Revisits of one response are dealt over so many parts.
REVISIT_PARTS = 64
RECORDS = "record_id string, record_type string, date string, uri string, concurrent_to string, refers_to string, content_type string, payload_digest string, payload_bytes long, payload binary"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: 20 bits, four characters, at a time."""
    digits = F.sha1(data)
    group = lambda i: F.translate(F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0"), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    return F.concat(*[group(i) for i in range(8)])


def _urn(kind: str, *parts: Column) -> Column:
    h = F.md5(F.concat_ws(":", F.lit(kind), *[p.cast("string") for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(headers: list[tuple[str, Column | str]], block: Column) -> Column:
    """A record's text; a header whose value is null is left out. The writer adds the two line ends that close it."""
    lines = [F.concat(F.lit(f"{k}: "), F.regexp_replace(F.lit(v) if isinstance(v, str) else v, "[\r\n]+", " "), F.lit(EOL)) for k, v in headers]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(EOL))
    return F.concat(F.lit(VERSION + EOL), *[F.coalesce(x, F.lit("")) for x in lines], length, F.lit(EOL), block)


def write_warc(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least_bytes: int = 0) -> None:
    """Write three records per row of (page_id, url, html) as archives (.warc.gz, a gzip member for each record) under ``path``.

    Of payloads that are equal and of ``least_bytes`` or more, the one with the
    smallest page_id is a response and the others are revisits of it. Null html is
    an empty payload, a null url gives no target, null ids come last. Repeated rows
    give records with the same identifiers, which are read back as captures of their
    own. Other columns are ignored.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), base32_sha1(html.cast("binary")).alias("digest"))
    order = F.struct(F.coalesce("page_id", F.lit(_LAST)).alias("page_id"), F.coalesce("url", F.lit("")).alias("url"))
    # only payloads that occur again are looked up: their digests are broadcast while they are few, and no page is moved; else those of one payload are dealt over tasks
    store = Scratch(pages.sparkSession, "warc_first")
    first = store.keep(rows.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1"), "first")
    few = first.count()
    total = first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = first.select("digest", "first")
    rows = rows.join(F.broadcast(found), "digest", "left") if few <= BROADCAST_DIGESTS else salted_join(rows, found, "digest", F.xxhash64("page_id", "url"), hot_keys(first, "digest", total), "left")
    rows = rows.withColumn("first", F.coalesce("first", order))
    again = (order != F.col("first")) & (F.octet_length("html") >= least_bytes)
    page, link = order["page_id"], order["url"]
    own, earlier = _urn("response", page, link, F.col("digest")), _urn("response", F.col("first.page_id"), F.col("first.url"), F.col("digest"))
    common = [("WARC-Date", date), ("WARC-Target-URI", F.col("url"))]
    host = F.coalesce(F.nullif(F.regexp_extract("url", r"^\w+://([^/]*)", 1), F.lit("")), F.lit("unknown"))
    path_of = F.coalesce(F.nullif(F.regexp_extract("url", r"^\w+://[^/]*(/[^\r\n]*)", 1), F.lit("")), F.lit("/"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.octet_length("html").cast("string"), F.lit(EOL + EOL))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    request = _record([("WARC-Type", "request"), ("WARC-Record-ID", _urn("request", page, link, F.col("digest"))), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/http;msgtype=request")], F.concat(F.lit("GET "), path_of, F.lit(f" HTTP/1.1{EOL}Host: "), host, F.lit(EOL + EOL)))
    response = _record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common, digest, ("Content-Type", "application/http;msgtype=response")], F.concat(http, F.col("html")))
    revisit = _record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, digest, ("WARC-Profile", _PROFILE), ("WARC-Refers-To", earlier), ("Content-Type", "application/http;msgtype=response")], http)
    metadata = _record([("WARC-Type", "metadata"), ("WARC-Record-ID", _urn("metadata", page, link, F.col("digest"))), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/warc-fields")], F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(EOL)))
    records = rows.select(F.explode(F.array(request, F.when(again, revisit).otherwise(response), metadata)).alias("value"))

    def archives(batches):
        held, size = [], 0
        for batch in batches:
            for record in batch.column("value"):
                held.append(gzip.compress(record.as_buffer().to_pybytes() + 2 * EOL.encode(), 6, mtime=0))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])

    # Spark's text writer puts the bytes as they are, a file for each row
    files = records.mapInArrow(archives, "value binary").select(F.col("value").cast("string").alias("value"))
    files.write.option("lineSep", _NOTHING).option("encoding", "ISO-8859-1").option("compression", "none").option("maxRecordsPerFile", 1).text(path)
    store.drop("first")
    _named(pages.sparkSession, path)


def _named(spark: SparkSession, path: str) -> None:
    """Give archives the ending of their kind; files of tasks without records go. One call to the store for each archive."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in store.listStatus(folder):
        own = status.getPath()
        if own.getName().endswith(".txt"):
            if status.getLen():
                store.rename(own, jvm.org.apache.hadoop.fs.Path(folder, own.getName().removesuffix(".txt") + ".warc.gz"))
            else:
                store.delete(own, False)


def parse_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an uncompressed byte stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        length = headers.get("content-length", "")
        if not length.isdigit():
            raise ValueError("a WARC record has no length")
        size = int(length)
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a WARC record is cut short")
        yield headers, block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives (.warc or gzipped) under ``path``, a row each.

    The payload of an HTTP record is what follows the HTTP headers. payload_digest is
    computed for requests, responses and metadata; a revisit, which has no payload, has the
    digest in its header and null payload_bytes. Payloads are bytes as they stand: chunked or encoded bodies
    are not decoded. A record that is read twice gives two rows; a missing header is null; an archive that is
    cut short, without a record's length, or no archive at all is an error. Empty archives, and a folder of none, give no rows.
    """

    def read(batches):
        for batch in batches:
            for content in batch.column("content"):
                data = content.as_buffer()
                stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if bytes(data[:2]) == b"\x1f\x8b" else io.BytesIO(data)
                rows = []
                for headers, block in parse_warc(stream):
                    kind, content_type = headers.get("warc-type"), headers.get("content-type")
                    payload = block.partition(b"\r\n\r\n")[2] if (content_type or "").startswith("application/http") else block
                    digest, size = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
                    if kind == "revisit":
                        payload, digest, size = None, headers.get("warc-payload-digest", "").rpartition(":")[2], None
                    rows.append((headers.get("warc-record-id"), kind, headers.get("warc-date"), headers.get("warc-target-uri"), headers.get("warc-concurrent-to"), headers.get("warc-refers-to"), content_type, digest, size, payload))
                    if len(rows) == 500:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.string()] * 8 + [pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response, request, metadata (structs of a record's columns).

    Requests and metadata join the response or revisit whose identifier they are
    concurrent to. A capture without one of the three has null there. Of several
    requests (or metadata records) of one capture, that of least record_id is kept; responses of one identifier
    stay captures of their own. A record without an identifier or what it is concurrent to stands alone. No records give no captures.
    """
    fields = F.struct(*[c for c in records.columns if c != "concurrent_to"])

    def side(kind: str) -> DataFrame:
        own = records.where(F.col("record_type") == kind).select(F.coalesce("concurrent_to", "record_id").alias("capture_id"), "record_id", fields.alias(kind))
        return own.groupBy("capture_id").agg(F.min_by(kind, "record_id").alias(kind))

    captures = records.where(F.col("record_type").isin("response", "revisit")).select(F.col("record_id").alias("capture_id"), fields.alias("response"))
    return captures.join(side("request"), "capture_id", "full").join(side("metadata"), "capture_id", "full")


def page_digests(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each capture.

    A revisit's size is that of the response it refers to, and refers_to that
    response's page_id.
    """
    page = F.expr("try_cast(regexp_extract(cast(metadata.payload as string), 'page-id: (-?[0-9]+)', 1) as long)")
    own = captures.select("capture_id", page.alias("page_id"), F.col("response.payload_bytes").alias("bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.record_type").alias("record_type"), F.col("response.refers_to").alias("refers"))
    columns = ["page_id", F.col("bytes").alias("payload_bytes"), "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")]
    # only revisits look for another capture; a response that very many revisit has several copies of its two numbers
    again = own.where("refers IS NOT NULL").withColumn("part", F.pmod(F.xxhash64("capture_id"), F.lit(REVISIT_PARTS)).cast("int"))
    first = own.where("record_type = 'response'").select(F.col("capture_id").alias("refers"), F.col("page_id").alias("refers_to"), F.col("bytes").alias("first_bytes")).dropDuplicates(["refers"])
    first = first.join(again.groupBy("refers", "part").count().drop("count"), "refers")
    revisits = again.join(first, ["refers", "part"], "left").select("page_id", F.coalesce("bytes", "first_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return own.where("refers IS NULL").select(*columns).union(revisits)
