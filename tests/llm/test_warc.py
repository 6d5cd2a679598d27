"""WARC archives: round trip and salvage."""

import gzip

import pytest
from pyspark.sql import functions as F

from kickframe.llm import queries, warc
from tests.llm import plain
from tests.llm.conftest import SF


def test_query(spark, same):
    pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()]
    same(queries.op6_warc(spark, SF), plain.warc_rows(pages))


@pytest.mark.parametrize("gzipped", [True, False])
def test_odd_pages(spark, tmp_path, gzipped):
    page = "<p>é\r\n\r\nWARC/1.1\r\n" * 20
    rows = [(1, None), (2, ""), (3, page), (4, page), (4, page), (5, "x" * 99), (6, "x" * 99), (7, "y" * 100), (None, "y" * 100), (None, "z" * 500), (9, "w" * 3_000_000)]
    names = "page_id bigint, html string, url string, id int, digest int, body string, n int, first_id int"
    df = spark.createDataFrame([(*r, "http://a\nb", 1, 2, "b", 3, 4) for r in rows], names)
    warc.write(df, str(tmp_path / "w"), gzipped=gzipped, archive_records=3)
    got = warc.read(spark, str(tmp_path / "w"))
    assert got.where("gap is not null").count() == 0 and got.count() == len(rows)
    kinds = {}
    for r in got.collect():
        kinds.setdefault(r.record_id, []).append((r.record_type, r.refers_to, bytes(r.payload)))
    assert sorted(kinds["<urn:page:4>"]) == [("revisit", "<urn:page:3>", b"")] * 2
    assert kinds["<urn:page:6>"] == [("response", None, b"x" * 99)] and kinds["<urn:page:1>"] == [("response", None, b"")]
    assert kinds["<urn:page:3>"] == [("response", None, page.encode())]
    assert sorted((k[0], k[1] or "") for k in kinds["<urn:page:none>"]) == [("response", ""), ("revisit", "<urn:page:7>")]
    warc.write(df.limit(0), str(tmp_path / "e"), gzipped=gzipped)
    assert warc.read(spark, str(tmp_path / "e")).count() == 0


def _archive(spark, tmp_path, gzipped, n=6):
    df = spark.range(n).select(F.col("id").alias("page_id"), F.concat(F.lit("page "), F.repeat(F.col("id").cast("string"), 300)).alias("html"), F.lit("u").alias("url"))
    warc.write(df.coalesce(1), str(tmp_path / "w"), gzipped=gzipped)
    (file,) = (tmp_path / "w").glob("part-*")
    return file.read_bytes()


@pytest.mark.parametrize("gzipped", [True, False])
@pytest.mark.parametrize("harm", ["flip", "cut", "junk", "header"])
def test_salvage(spark, tmp_path, gzipped, harm):
    data = _archive(spark, tmp_path, gzipped)
    whole = [r for r in warc.salvage(data) if r.headers]
    assert len(whole) == 6 and all(r.gap is None for r in whole)
    third = whole[2]
    middle = third.offset + third.length // 2
    if harm == "flip":
        data = data[:middle] + bytes([data[middle] ^ 0xFF]) + data[middle + 1 :]
    elif harm == "cut":
        data = data[:middle] + data[third.offset + third.length :]
    elif harm == "junk":
        data = data[: third.offset] + b"junk \x1f\x8b\x08 WARC/9" + data[third.offset :]
    else:
        data = data[: third.offset] + b"\x00\x00" + data[third.offset + 2 :]
    out = list(warc.salvage(data))
    kept = {r.headers["warc-record-id"] for r in out if r.headers}
    lost = {r.headers["warc-record-id"] for r in whole} - kept
    assert lost == (set() if harm == "junk" else {third.headers["warc-record-id"]})
    gaps = [r for r in out if r.gap]
    assert gaps and all(third.offset <= g.offset for g in gaps)
    # records, gaps and empty members tile the file
    at = 0
    for r in sorted(out, key=lambda r: r.offset):
        assert data[at : r.offset].replace(gzip.compress(b"", mtime=0), b"") == b""
        at = r.offset + r.length


def test_random_bytes_never_fail():
    import random

    rng = random.Random(3)
    for _ in range(300):
        data = bytes(rng.choices(b"WARC/1.1\r\n\x1f\x8b\x08: x0", k=rng.randrange(200)))
        assert all(r.gap for r in warc.salvage(data) if not r.headers)


def _one_member(spark, tmp_path):
    plain_data = _archive(spark, tmp_path, False)
    return plain_data, [r.headers["warc-record-id"] for r in warc.salvage(plain_data)]


def test_a_member_of_many_records_loses_only_the_damaged_one(spark, tmp_path):
    data, names = _one_member(spark, tmp_path)
    harmed = data.replace(b"Content-Length: 305", b"Content-Length: 999", 1)
    assert harmed != data
    for archive in (harmed, gzip.compress(harmed, mtime=0)):
        out = list(warc.salvage(archive))
        assert [r.headers["warc-record-id"] for r in out if not r.gap] == names[1:] and any(r.gap for r in out)
    packed = gzip.compress(data, mtime=0)
    assert [r.headers["warc-record-id"] for r in warc.salvage(packed)] == names
    out = list(warc.salvage(packed[:-20]))
    assert [r.headers["warc-record-id"] for r in out if not r.gap] == names[: len([r for r in out if not r.gap])] and len(out) >= 5 and out[-1].gap


def test_records_before_a_fault_in_a_member_are_kept():
    import random

    rng = random.Random(1)
    records = []
    for i in range(60):
        body = bytes(rng.choices(range(256), k=5000))
        records.append(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, len(body), body))
    packed = gzip.compress(b"".join(records), mtime=0)
    cut = list(warc.salvage(packed[: len(packed) // 2] + gzip.compress(records[7], mtime=0)))
    kept = [r.headers["warc-record-id"] for r in cut if not r.gap]
    assert kept[:-1] == [f"<{i}>" for i in range(len(kept) - 1)] and len(kept) > 25 and kept[-1] == "<7>"


def test_a_large_archive_is_read_in_linear_time():
    import time

    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 20000\r\n\r\n" + b"x" * 20000 + b"\r\n\r\n"
    noise = __import__("random").Random(2).randbytes(20000)
    member = gzip.compress(record.replace(b"x" * 20000, noise), mtime=0)
    began = time.perf_counter()
    assert sum(not r.gap for r in warc.salvage(member * 3000)) == 3000
    assert time.perf_counter() - began < 20


def test_archives_are_closed_by_bytes(spark, tmp_path):
    df = spark.range(40).select(F.col("id").alias("page_id"), F.expr("repeat(sha2(cast(id as string), 512), 800)").alias("html"), F.lit("u").alias("url")).coalesce(1)
    warc.write(df, str(tmp_path / "b"), gzipped=False, archive_bytes=500_000)
    sizes = [f.stat().st_size for f in (tmp_path / "b").glob("part-*")]
    assert len(sizes) > 5 and max(sizes) < 700_000 and warc.read(spark, str(tmp_path / "b")).where("gap is null").count() == 40


@pytest.mark.parametrize("gzipped", [True, False])
def test_a_very_long_url_is_kept(spark, tmp_path, gzipped):
    url = "http://a.example/" + "q" * 1_200_000
    df = spark.createDataFrame([(1, url, "x" * 200), (2, "http://b.example/", "y" * 200)], "page_id bigint, url string, html string")
    warc.write(df, str(tmp_path / "w"), gzipped=gzipped)
    got = warc.read(spark, str(tmp_path / "w"))
    assert {(r.gap, r.target_uri, bytes(r.payload)) for r in got.collect()} == {(None, url, b"x" * 200), (None, "http://b.example/", b"y" * 200)}
