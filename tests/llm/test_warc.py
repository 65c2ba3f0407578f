"""Archives against a plain reader, Spark's own filters, and pages compared one by one."""

import base64
import gzip
import hashlib
import io
import random
import re

import pytest
from palisade.llm import warc
from palisade.llm.common import table
from pyspark.errors import PySparkException
from pyspark.sql import functions as F


def sha1(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def brute(pages):
    last = {}
    for p in pages:
        html = p.html or ""
        if p.page_id is not None:
            last[html] = max(last.get(html, p.page_id), p.page_id)
    out = []
    for p in pages:
        html = p.html or ""
        revisit = html in last and last[html] != p.page_id
        data = html.encode()
        out.append((p.page_id, len(data), sha1(data), "revisit" if revisit else "response", last[html] if revisit else None))
    return sorted(out, key=str)


def round_trip(spark, pages, folder, **options):
    warc.write(warc.page_records(pages), folder, **options)
    rows = warc.archived_pages(spark, folder).collect()
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str)


def test_given_pages(spark, tmp_path):
    pages = table(spark, "/root/testdata/sf0.001", "pages")
    assert round_trip(spark, pages, f"file://{tmp_path}/a", file_bytes="65536") == brute(pages.collect())
    for name, size in warc.listed(f"{tmp_path}/a"):
        path = tmp_path / "a" / name
        assert path.stat().st_size == size <= 65536
        check_plain(gzip.decompress(path.read_bytes()))


def check_plain(data):
    """Every record by the letter: lengths, digests, ids."""
    at = kinds = 0
    while at < len(data):
        head, _, rest = data[at:].partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        block = rest[: int(fields["Content-Length"])]
        at += len(head) + 4 + len(block) + 4
        assert rest[len(block) : len(block) + 4] == b"\r\n\r\n"
        assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", fields["WARC-Record-ID"])
        kinds += 1
        if fields["WARC-Type"] == "warcinfo":
            continue
        assert fields["WARC-Block-Digest"] == "sha1:" + sha1(block)
        if fields["WARC-Type"] == "response":
            assert fields["WARC-Payload-Digest"] == "sha1:" + sha1(block.partition(b"\r\n\r\n")[2])
        else:
            assert fields["WARC-Profile"].endswith("identical-payload-digest") and fields["WARC-Refers-To"]
    assert kinds


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_nulls_copies_long_pages_and_clashing_columns(spark, tmp_path, compression):
    chance = random.Random(5)
    htmls = [None, "", "<p>é🙂\r\n\r\nWARC/1.1\r\n</p>", "x" * 3_000_000, "WARC/1.0\r\n\r\n\r\n\r\n", *(chance.randbytes(9000).hex() for _ in range(4))]
    urls = [None, "", "http://a/\r\nWARC-Type: revisit", "http://ä b/", "http://a/ \x85"]
    ids = [None, -1, 2**63 - 1, -(2**63), *range(80)]
    rows = [(chance.choice(ids), chance.choice(urls), chance.choice(htmls), "r", "s", 1) for _ in range(150)]
    rows += [(5, "u", "twice", "r", "s", 1)] * 2 + [(None, "u", "none", "r", "s", 1)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_id string, same string, last long")
    folder = f"{tmp_path}/a"
    assert round_trip(spark, pages, folder, compression=compression) == brute(pages.collect())
    back = warc.read(spark, folder, "target_uri", "payload", "record_type")
    assert back.filter("record_type = 'response' and payload is null").count() == 0
    assert {r[0] for r in back.filter("record_type <> 'warcinfo'").select("target_uri").distinct().collect()} <= {
        None, "", "u", "http://a/%0D%0AWARC-Type:%20revisit", "http://ä%20b/", "http://a/%20%C2%85"
    }


def test_smaller_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    rows = warc.page_records(pages, min_bytes=3).select("record_type", warc.page_of(F.col("refers_to"))).collect()
    assert sorted(map(tuple, rows), key=str) == [("response", None)] * 3 + [("revisit", 4)]


def test_no_pages_and_overwriting(spark, tmp_path):
    folder = f"{tmp_path}/a"
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert round_trip(spark, none, folder) == []
    one = spark.createDataFrame([(1, "u", "one")], none.schema)
    warc.write(warc.page_records(one), folder)
    (tmp_path / "a" / "part-lost.warc.gz").write_bytes(b"left by a lost attempt")
    assert warc.archived_pages(spark, folder).count() == 1
    warc.write(warc.page_records(one), folder)
    assert warc.archived_pages(spark, folder).count() == 2
    warc.write(warc.page_records(one), folder, overwrite=True)
    assert warc.archived_pages(spark, folder).count() == 1
    assert len([p for p in (tmp_path / "a").iterdir() if ".warc" in p.name and not p.name.endswith(".crc")]) == 1


FOREIGN = [
    b"WARC/1.0\nWARC-Type: resource\nWARC-Record-ID: <urn:x:1>\nWARC-Target-URI: http://a/1\nContent-Length: 5\r\n\r\nhello\r\n\r\n",
    b"WARC/1.0\r\nwarc-type: response\r\nX-Folded: one\r\n two\r\nWARC-Record-ID: <urn:x:2>\r\nWARC-Target-URI: http://b/2\r\n"
    b"Content-Type: application/http; msgtype=response\r\nContent-Length: 28\r\n\r\nHTTP/1.1 200 OK\r\nA: b\r\n\r\nhi\n\r\n\r\n",
    b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <urn:x:3>\r\nContent-Length: 0\r\n\r\n\r\n\r\n",
]


@pytest.mark.parametrize("pack", [bytes, gzip.compress, warc._member])
def test_archives_of_others(spark, tmp_path, pack):
    """One member a record without skip-lengths, with them, and plain files."""
    end = ".warc" if pack is bytes else ".warc.gz"
    for i in range(3):
        (tmp_path / f"{i}{end}").write_bytes(b"".join(map(pack, FOREIGN)))
    back = warc.read(spark, str(tmp_path), partition_bytes="1")
    assert back.rdd.getNumPartitions() == 3 and back.count() == 9
    rows = {r.record_id: r for r in back.collect()}
    assert bytes(rows["<urn:x:1>"].payload) == b"hello" and rows["<urn:x:1>"].payload_length == 5
    assert bytes(rows["<urn:x:2>"].payload) == b"hi\n" and rows["<urn:x:2>"].headers["x-folded"] == "one two"
    assert bytes(rows["<urn:x:3>"].payload) == b"" and rows["<urn:x:3>"].target_uri is None
    assert warc.read(spark, str(tmp_path)).rdd.getNumPartitions() == 1


@pytest.mark.parametrize("where, sql", [
    ([("record_type", "=", "response")], "record_type = 'response'"),
    ([("record_type", "in", ["resource", "metadata"])], "record_type in ('resource', 'metadata')"),
    ([("record_type", "not in", ["resource"]), ("target_uri", "!=", "x")], "record_type not in ('resource') and target_uri <> 'x'"),
    ([("target_uri", "null", None)], "target_uri is null"),
    ([("target_uri", "not null", None), ("target_uri", "starts", "http://a")], "target_uri like 'http://a%'"),
    ([("target_uri", "ends", "2")], "target_uri like '%2'"),
    ([("target_uri", "contains", "//b")], "target_uri like '%//b%'"),
    ([("content_length", ">", 4), ("content_length", "<=", 5)], "content_length > 4 and content_length <= 5"),
    ([("record_id", ">=", "<urn:x:2>"), ("record_id", "<", "<urn:x:3>")], "record_id >= '<urn:x:2>' and record_id < '<urn:x:3>'"),
    ([("headers.X-Folded", "=", "one two")], "headers['x-folded'] = 'one two'"),
])
def test_conditions_are_those_of_sql(spark, tmp_path, where, sql):
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(warc._member, FOREIGN)))
    ids = lambda df: sorted(r.record_id for r in df.collect())
    every = warc.read(spark, str(tmp_path))
    assert ids(warc.read(spark, str(tmp_path), where=where)) == ids(every.filter(sql))
    assert every.count() == 3


def test_no_such_column_or_condition(spark, tmp_path):
    for where in ([("payload", "=", "x")], [("record_type", "like", "x")], [("content_length", "=", "5")]):
        with pytest.raises(ValueError):
            warc.read(spark, str(tmp_path), where=where)


def test_unwanted_payloads_are_not_inflated(spark, tmp_path):
    """A record with a broken payload does no harm to those who don't want it."""
    good = warc.record("response", "<urn:x:1>", "u", None, b"good", "2020-01-01T00:00:00Z")
    bad = bytearray(warc._member(warc.record("response", "<urn:x:2>", "u", None, random.Random(1).randbytes(60_000), "2020-01-01T00:00:00Z")))
    bad[30_000:40_000] = bytes(10_000)
    (tmp_path / "a.warc.gz").write_bytes(warc._member(good) + bytes(bad) + warc._member(good))
    assert warc.read(spark, str(tmp_path), where=[("record_id", "=", "<urn:x:1>")]).count() == 2
    with pytest.raises(PySparkException, match="byte"):
        warc.read(spark, str(tmp_path)).collect()
    assert warc.read(spark, str(tmp_path), torn="skip").count() == 1


def test_torn_files():
    whole = b"".join(map(warc._member, FOREIGN))
    for n in range(1, len(whole)):
        seen, torn = [], False
        try:
            for fields, _ in warc.records(io.BytesIO(whole[:n]), n):
                seen.append(fields["warc-record-id"])
        except warc.Torn:
            torn = True
        assert seen == ["<urn:x:1>", "<urn:x:2>", "<urn:x:3>"][: len(seen)]
        assert torn == (n not in {sum(len(warc._member(r)) for r in FOREIGN[:k]) for k in (1, 2)})
