import base64
import gzip
import hashlib

import pytest

from corpusmill.llm import warc


def pages(spark):
    rows = [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (3, "http://a/3", None), (4, "http://a/4", ""), (5, None, "é 日本\r\n\r\nWARC/1.1\r\n" * 50), (9, "http://a/9", "<p>one</p>"), (9, "http://a/9b", "<p>one</p>"), (None, "x", "alone"), (None, "y", "<p>one</p>")]
    return spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, digest int")


def test_round_trip_and_revisits(spark):
    got = warc.write_and_read(pages(spark)).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert len(got) == 9
    for r in got:
        want = {x.page_id: x.html for x in pages(spark).collect() if x.page_id is not None}
        if r.page_id is not None:
            assert (r.payload_bytes, r.payload_digest) == (len((want[r.page_id] or "").encode()), digest(want[r.page_id]))
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got)
    assert kinds == [(0, "response", None), (0, "revisit", 9), (1, "revisit", 9), (2, "revisit", 9), (3, "revisit", 4), (4, "response", None), (5, "response", None), (9, "response", None), (9, "response", None)]
    assert warc.write_and_read(pages(spark).limit(0)).count() == 0


def test_small_payloads_may_stay(spark):
    assert {r.record_type for r in warc.write_and_read(pages(spark), least_bytes=11).collect()} == {"response"}


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_source_filters_and_headers(spark, tmp_path, compression):
    warc.register(spark)
    path = f"file://{tmp_path}/w"
    warc.archive_rows(pages(spark)).repartition(2).write.format("warc").option("compression", compression).mode("append").save(path)
    frame = spark.read.format("warc").load(path)
    assert frame.where("record_type = 'revisit'").count() == 4
    assert frame.where("record_type = 'response' and payload_bytes > 100").select("uri").collect()[0].uri is None
    assert {bytes(r.payload) for r in frame.where("payload_bytes >= 5 and payload_bytes < 11 and record_type = 'response'").collect()} == {b"<p>one</p>", b"alone"}
    heads = spark.read.format("warc").option("headers_only", "true").load(path).select("payload_bytes", "payload").collect()
    assert len(heads) == 9 and all(r.payload is None for r in heads)


def test_ranges_of_a_plain_archive_give_each_record_once(tmp_path, monkeypatch):
    rows = [warc.record_of({"record_id": f"r{i}", "record_type": "response", "uri": f"u{i}", "date": None, "payload": b"x" * (i * 37 % 500), "payload_bytes": None, "payload_digest": None, "refers_to": None}) for i in range(200)]
    (tmp_path / "a.warc").write_bytes(b"".join(rows))
    monkeypatch.setattr(warc, "RANGE", 1000)
    reader = warc.WarcReader({"path": f"file://{tmp_path}"})
    parts = reader.partitions()
    assert len(parts) > 20
    got = [r["record_id"] for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert got == [f"r{i}" for i in range(200)]


def test_excluded_blocks_are_not_kept(tmp_path):
    """A block that a filter excludes is passed over without being taken."""
    rows = [{"record_id": str(i), "record_type": kind, "uri": None, "date": None, "payload": b"y" * 100_000, "payload_bytes": None, "payload_digest": None, "refers_to": None} for i, kind in enumerate(["request", "response", "request"])]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(warc.record_of(r)) for r in rows))
    taken = []
    stream = warc._Stream((tmp_path / "a.warc.gz").open("rb"), 0, True)
    take = stream.take
    stream.take = lambda n: taken.append(n) or take(n)
    got = list(warc.read_records(stream, None, lambda row: row[1] == "response", True))
    assert [r[0] for r in got] == ["1"] and taken == [100_000]


def one(i, payload, kind="response"):
    return {"record_id": f"r{i}", "record_type": kind, "uri": f"u{i}", "date": None, "payload": payload, "payload_bytes": None, "payload_digest": None, "refers_to": None}


@pytest.mark.parametrize("compression", ["gzip", "none", None])
def test_ranges_with_records_inside_payloads(spark, tmp_path, monkeypatch, compression):
    """Payloads that hold whole records and marks of records; each record is read once, whatever the ranges. None: an archive that others wrote."""
    inner = warc.record_of(one("inner", b"inside")) + b"\r\n\r\nWARC/1.1\r\nnot a header"
    rows = [one(i, inner * (i % 5) + b"x" * (i * 31 % 400)) for i in range(120)]
    if compression is None:
        (tmp_path / "a.warc").write_bytes(b"".join(map(warc.record_of, rows)))
        monkeypatch.setattr(warc, "RANGE", 700)
    else:
        warc.register(spark)
        frame = spark.createDataFrame([tuple(r[c] for c in warc.NAMES) for r in rows], warc.SCHEMA).repartition(2)
        frame.write.format("warc").option("compression", compression).option("range", 700).mode("append").save(f"file://{tmp_path}")
    reader = warc.WarcReader({"path": f"file://{tmp_path}"})
    parts = reader.partitions()
    assert len(parts) > 10
    got = [(r["record_id"], r["payload"]) for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(got) == sorted((r["record_id"], r["payload"]) for r in rows)


def test_a_failed_job_leaves_nothing(tmp_path):
    writer = warc.WarcWriter({"path": f"file://{tmp_path}"}, False)
    batch = warc._batch([tuple(one(1, b"x")[c] for c in warc.NAMES)])
    writer.write(iter([batch]))  # an attempt whose message never arrives
    writer.abort([None])
    assert warc.WarcReader({"path": f"file://{tmp_path}"}).partitions() == []


def test_what_is_no_archive_is_an_error(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "MOST_HEADER", 1000)
    (tmp_path / "a.warc").write_bytes(b"no header" * 1_000_000)
    reader = warc.WarcReader({"path": f"file://{tmp_path}"})
    with pytest.raises(ValueError, match="not a WARC record"):
        list(reader.read(reader.partitions()[0]))
