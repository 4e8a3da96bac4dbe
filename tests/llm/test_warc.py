"""Archives: written, read back, and broken on purpose."""

import base64
import gzip
import hashlib
import os
from collections import Counter, defaultdict

import pytest

from pagewright.llm import warc


@pytest.fixture(scope="module")
def make_pages(spark):
    def make(rows):
        return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, type string")

    return make


def digest(body):
    return base64.b32encode(hashlib.sha1(body).digest()).decode()


def plain(rows, least=0):
    last = {}
    order = lambda i: (i is not None, i or 0)
    for i, _, html in rows:
        last[html or ""] = max(last.get(html or "", None), i, key=order)
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        response = len(body) < least or i == last[html or ""]
        out.append((i, len(body), digest(body), "response" if response else "revisit", None if response else last[html or ""]))
    return Counter(out)


LONG = "<p>Straße 日本語 WARC/1.1\r\n\r\n</p>" * 9000
ROWS = [
    (1, "http://a.example/", "<p>one</p>"), (2, "http://b.example/x y\r\nz", "<p>one</p>"), (3, None, LONG), (4, "http://c.example/", None), (5, "http://c.example/", ""), (None, "http://n.example/", "<p>none</p>"),
    (None, None, "<p>one</p>"), (6, "http://d.example/", "é" * 8192), (7, "u", "é" * 8191 + "x"), (8, "u", "x" * 4096), (9, "u", "x" * 4095), (10, "u", "0\r\n\r\n"), (11, "u", "HTTP/1.1 200 OK\r\n\r\n"), (3, None, LONG), (12, "u", LONG), (2, "u", "<p>one</p>"),
]


@pytest.mark.parametrize("how", [{}, {"segment_bytes": 61, "chunk_bytes": 7}, {"min_bytes": 10}, {"segment_bytes": 1 << 30, "chunk_bytes": 1 << 30}])
def test_round_trip(make_pages, how):
    rows = [r for r in ROWS if r[2] != LONG] if how.get("segment_bytes") == 61 else ROWS
    got = warc.archived_payloads(make_pages(rows), **how).collect()
    assert {r.defect for r in got} == {None}
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == plain(rows, how.get("min_bytes", 0))


def test_payloads_come_back(make_pages, spark):
    path = warc.archive_pages(make_pages(ROWS))
    back = warc.reassemble(warc.read_archives(spark, path)).filter("type = 'response'").collect()
    assert {(r.page, bytes(r.payload).decode()) for r in back} == {("2", "<p>one</p>"), ("12", LONG), ("5", ""), (None, "<p>none</p>"), ("6", ROWS[7][2]), ("7", ROWS[8][2]), ("8", "x" * 4096), ("9", "x" * 4095), ("10", "0\r\n\r\n"), ("11", "HTTP/1.1 200 OK\r\n\r\n")}
    assert {r.target for r in back if r.page == "2"} <= {"http://b.example/x%20y%0D%0Az", "u"}


def test_archives_are_warc_files(make_pages):
    """Read by the rules of the format alone."""
    path = warc.archive_pages(make_pages(ROWS), segment_bytes=5000).removeprefix("file:")
    kinds, parts = Counter(), defaultdict(dict)
    for name in os.listdir(path):
        if not name.endswith(".gz"):
            continue
        data = gzip.open(f"{path}/{name}").read()
        while data:
            head, _, data = data.partition(b"\r\n\r\n")
            version, *lines = head.decode().split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines)
            assert version == "WARC/1.1" and {"WARC-Type", "WARC-Record-ID", "WARC-Date"} <= set(fields)
            size = int(fields["Content-Length"])
            block, end, data = data[:size], data[size : size + 4], data[size + 4 :]
            assert end == b"\r\n\r\n" and size <= 5000
            kinds[fields["WARC-Type"]] += 1
            if "WARC-Segment-Number" in fields:
                parts[fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"])][int(fields["WARC-Segment-Number"])] = block, fields.get("WARC-Segment-Total-Length")
    assert kinds["response"] == 11 and kinds["revisit"] == len(ROWS) - 11 and kinds["continuation"] > 30
    for segments in parts.values():
        assert sorted(segments) == list(range(1, len(segments) + 1))
        assert [n for n in sorted(segments) if segments[n][1]] == [len(segments)] and int(segments[len(segments)][1]) == sum(len(b) for b, _ in segments.values())


def record(kind, ident, block, **fields):
    return warc.written_record({"WARC-Type": kind, "WARC-Record-ID": ident, **{k.replace("_", "-"): str(v) for k, v in fields.items()}}, block) + b"\r\n\r\n"


def segmented(ident, payload, cuts, total=None, numbers=None):
    block = warc.HTTP_HEAD + b"".join(warc.chunked(payload, 5))
    edges = [0, *cuts, len(block)]
    out = []
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        n = (numbers or range(1, len(edges)))[k]
        more = {"WARC_Segment_Number": n, "Page_ID": ident} if k == 0 else {"WARC_Segment_Number": n, "WARC_Segment_Origin_ID": ident}
        if k == len(cuts):
            more["WARC_Segment_Total_Length"] = len(block) if total is None else total
        out.append(record("response" if k == 0 else "continuation", ident if k == 0 else f"{ident}-{k}", block[a:b], **more))
    return out


def test_segments_in_any_order_and_file(spark, tmp_path):
    a, b = segmented("a", b"alpha " * 40, [3, 90, 91, 200]), segmented("b", b"beta " * 40, [100])
    whole = record("response", "c", b"HTTP/1.0 200 OK\r\nX: y\r\n\r\nplain", Page_ID="c")
    (tmp_path / "1.warc").write_bytes(a[3] + b[1] + whole + a[0])
    (tmp_path / "2.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in (a[4], b[0], a[1], a[2])))  # a member a record
    (tmp_path / "3.warc").write_bytes(b"")
    got = warc.reassemble(warc.read_archives(spark, str(tmp_path))).collect()
    assert {(r.page, bytes(r.payload), r.defect) for r in got} == {("a", b"alpha " * 40, None), ("b", b"beta " * 40, None), ("c", b"plain", None)}


def test_defects(spark, tmp_path):
    good = segmented("good", b"fine" * 20, [50])
    rows = {
        "segments": [segmented("gap", b"gap" * 20, [50, 80])[i] for i in (0, 2)] + segmented("double", b"double" * 9, [50], numbers=[1, 1]) + segmented("lost", b"lost" * 20, [50])[1:],
        "total": segmented("sum", b"sum" * 20, [50], total=7) + segmented("open", b"open" * 20, [50, 60])[:2],
        "framing": [record("response", "f", warc.HTTP_HEAD + b"5\r\nabc\r\n0\r\n\r\n", Page_ID="f"), record("response", "g", warc.HTTP_HEAD + b"zz\r\nabc\r\n0\r\n\r\n"), record("response", "h", b"no head"), record("response", "i", warc.HTTP_HEAD + b"3\r\nabc\r\n")],
        "digest": [record("response", "d", warc.HTTP_HEAD + b"3\r\nabc\r\n0\r\n\r\n", WARC_Payload_Digest="sha1:AAAA")],
    }
    (tmp_path / "a.warc").write_bytes(b"".join(good + [r for rs in rows.values() for r in rs]))
    (tmp_path / "b.warc").write_bytes(record("response", "x", b"HTTP/1.1 200 OK\r\n\r\nkept") + record("response", "y", b"HTTP/1.1 200 OK\r\n\r\ncut")[:-9])
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(record("response", "z", b"HTTP/1.1 200 OK\r\n\r\nkept too"))[:-20])
    (tmp_path / "d.warc").write_bytes(b"GET / HTTP/1.1\r\n\r\n")
    got = warc.reassemble(warc.read_archives(spark, str(tmp_path))).collect()
    assert Counter(r.defect for r in got) == {None: 2, "segments": 3, "total": 2, "framing": 4, "digest": 1, "length": 1, "compression": 1, "head": 1}
    assert {bytes(r.payload) for r in got if r.payload is not None} == {b"fine" * 20, b"kept"}


def test_framing():
    assert warc.dechunked(b"3;name=x\r\nabc\r\n2\r\nde\r\n0\r\nTrailer: 1\r\n\r\n") == b"abcde"
    assert warc.dechunked(b"0\r\n\r\n") == b"" and warc.dechunked(b"") is None and warc.dechunked(b"A\r\n0123456789\r\n0\r\n\r\n") == b"0123456789"
    for size in (1, 3, 1000):
        assert warc.dechunked(b"".join(warc.chunked(b"x" * 999, size))) == b"x" * 999


def test_empty_table(make_pages):
    assert warc.archived_payloads(make_pages([])).count() == 0
