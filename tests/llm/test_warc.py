import base64
import hashlib
import io

from fluxmesh.llm.warc import MAGIC, build_record, decode_member, gzip_member, read_warc, records_in_range, write_warc


class Source(io.BytesIO):
    def read_at(self, n, at):
        self.seek(at)
        return self.read(n)


def test_ranges_own_each_record_once():
    members = [gzip_member(build_record(i, f"http://h/{i}", b"<p>" + bytes([65 + i % 26]) * (37 * i), None, False)) for i in range(40)]
    data = b"".join(members)
    for step in (1 + len(data) // 3, 97, 1000, 13):
        got = [r for a in range(0, len(data), step) for r in records_in_range(Source(data), len(data), a, min(a + step, len(data)), chunk=256)]
        assert got == [decode_member(m)[0] for m in members]


def test_false_magic_and_nested_archives():
    inner = gzip_member(build_record(1, "http://in", b"inner", None, False))
    outer = gzip_member(build_record(2, "http://out", inner * 3, None, False))
    data = outer + gzip_member(build_record(3, "x", MAGIC * 50, None, False))
    got = [r for a in range(0, len(data), 60) for r in records_in_range(Source(data), len(data), a, min(a + 60, len(data)))]
    assert [b"http://out" in r for r in got] == [True, False] and inner in got[0]


def test_round_trip(spark):
    rows = [(5, "http://a", "same"), (2, "http://b", "same"), (9, "http://c", None), (1, "http://d", ""), (7, None, "é ü\r\n\r\nWARC/1.1"), (None, "u", "same"), (2, "again", "same"), (11, "line\nbreak", "x" * 300000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("clash"))
    out = read_warc(spark, write_warc(pages), split_bytes=300, with_payload=True).collect()
    assert len(out) == len(rows)
    payloads = {}
    for i, _, h in rows:
        payloads.setdefault(h or "", []).append(i)
    for r in out:
        text = next(h or "" for i, _, h in rows if i == r.page_id and hashlib.sha1((h or "").encode()).digest() == base64.b32decode(r.payload_digest))
        first = min(i for i in payloads[text] if i is not None)
        later = r.page_id is not None and r.page_id > first
        assert (r.record_type, r.refers_to) == (("revisit", first) if later else ("response", None))
        assert r.payload_bytes == len(text.encode()) and (later or r.payload == text.encode())
    assert read_warc(spark, write_warc(pages.limit(0))).count() == 0


def test_small_payloads_can_stay_whole(spark):
    pages = spark.createDataFrame([(1, "a", "xx"), (2, "b", "xx"), (3, "c", "longer text"), (4, "d", "longer text")], "page_id long, url string, html string")
    out = {r.page_id: r.record_type for r in read_warc(spark, write_warc(pages, min_payload=5)).collect()}
    assert out == {1: "response", 2: "response", 3: "response", 4: "revisit"}
