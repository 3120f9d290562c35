import base64
import gzip
import hashlib
import io
import zlib

import pytest

from millrace.llm.warc import assemble, page_digests, parse_warc, read_warc, write_warc

PAGES = [
    (5, "http://a.org/x", "<p>one</p>"), (2, "http://b.org/", "<p>one</p>"), (9, None, "<p>one</p>"), (3, "no url", ""), (4, "http://c\r\nX: y", None), (6, "http://d", "line\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nx"),
    (7, "http://e", "é" * 1000), (8, "http://f", "<p>one</p>"), (8, "http://f", "<p>one</p>"), (None, "http://g", "alone"), (None, "http://h", "<p>one</p>"), (10, "http://i", "\ufeffx\r\n\r\n"),
]


def expected(least=0):
    firsts = {}
    for i, _, h in PAGES:
        if i is not None:
            firsts[h or ""] = min(i, firsts.get(h or "", i))
    out = []
    for i, _, h in PAGES:
        data = (h or "").encode()
        first = firsts.get(h or "", i)
        again = i != first and len(data) >= least
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, tmp_path, least):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS first").repartition(3)
    write_warc(df, str(tmp_path / "w"), least_bytes=least)
    records = read_warc(spark, str(tmp_path / "w"))
    captures = assemble(records)
    got = [tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in page_digests(captures).collect()]
    assert sorted(got, key=repr) == expected(least)
    payloads = sorted(bytes(r.response.payload).decode() for r in captures.collect() if r.response.record_type == "response")
    kinds = {(e[0], e[2]): e[3] for e in expected(least)}
    sha = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    assert payloads == sorted(h or "" for i, _, h in PAGES if kinds[i, sha(h)] == "response")
    assert all(r.request.record_type == "request" and r.metadata.record_type == "metadata" for r in captures.collect())


def test_archives_are_plain_warc(spark, tmp_path):
    write_warc(spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    n = members = 0
    assert list((tmp_path / "w").glob("part-*")) == list((tmp_path / "w").glob("part-*.warc.gz"))
    for path in (tmp_path / "w").glob("*.warc.gz"):
        rest = path.read_bytes()
        while rest:  # a member for each record, and an empty one
            one = zlib.decompressobj(31)
            text = one.decompress(rest)
            assert text == b"" or text.startswith(b"WARC/1.1") and len(list(parse_warc(io.BytesIO(text)))) == 1
            members, rest = members + (text != b""), one.unused_data
        for headers, block in parse_warc(io.BytesIO(gzip.decompress(path.read_bytes()))):
            assert headers["warc-record-id"].startswith("<urn:uuid:") and len(block) == int(headers["content-length"])
            n += 1
    assert n == members == 3 * len(PAGES)


def test_captures_without_a_part(spark):
    row = lambda kind, i, to=None: (i, kind, None, "u", to, None, None, "d", 1, None)
    records = spark.createDataFrame([row("response", "a"), row("request", "q", "lost"), row("metadata", "m2", "a"), row("metadata", "m1", "a")], "record_id string, record_type string, date string, uri string, concurrent_to string, refers_to string, content_type string, payload_digest string, payload_bytes long, payload binary")
    got = {r.capture_id: r for r in assemble(records).collect()}
    assert got["a"].request is None and got["a"].metadata.record_id == "m1" and got["lost"].response is None and got["lost"].request.record_id == "q"


def test_cut_and_foreign_streams():
    with pytest.raises(ValueError):
        list(parse_warc(io.BytesIO(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nab")))
    with pytest.raises(ValueError):
        list(parse_warc(io.BytesIO(b"hello\r\n")))
    with pytest.raises(ValueError, match="no length"):
        list(parse_warc(io.BytesIO(b"WARC/1.1\r\nWARC-Type: response\r\n\r\nab")))
    assert list(parse_warc(io.BytesIO(b""))) == []


def test_empty_table(spark, tmp_path):
    write_warc(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert page_digests(assemble(read_warc(spark, str(tmp_path / "w")))).count() == 0
