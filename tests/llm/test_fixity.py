import glob
import hashlib
import os
import re

from tesseral.llm import fixity

PAGES = "page_id long, url string, html string, status string"


def made(spark, n=150):
    rows = [(i * 7, f"https://x.example/{i}", f"<p>é {i}</p>" * (i % 9), "clash") for i in range(n)]
    rows += [(100_000, None, None, None), (None, "u", "h", None), (14, "again", "same number", None)]
    return spark.createDataFrame(rows, PAGES)


def test_equal_replicas_have_no_findings(spark):
    records = fixity.warc_records(made(spark))
    assert fixity.audit(records, records.repartition(7)).collect() == []


def test_every_fault_is_found(spark):
    records = fixity.warc_records(made(spark, 1500))
    rows = {(r.record_no, r.record) for r in records.collect()}
    told = fixity.report(records, fixity.damaged(records)).collect()
    assert len(told) == len(rows)
    first = lambda x: hashlib.sha256(x.encode()).hexdigest()[:2]
    want = {(n, hashlib.sha256(x.encode()).hexdigest()): {"00": "corrupt", "01": "missing"}.get(first(x)) for n, x in rows}
    assert set(want.values()) == {"corrupt", "missing", None}
    for r in told:
        assert want[r.record_no, r.record_sha256] in (r.status, None) and (r.status in ("corrupt", "missing")) == bool(want[r.record_no, r.record_sha256])
    gone = {n for (n, _), s in want.items() if s == "missing" and n < fixity.ARCHIVE_RECORDS}
    for r in told:
        if r.archive == 0 and r.status in ("intact", "moved"):
            assert (r.status == "moved") == any(n < r.record_no for n in gone)


def test_added_records_and_empty_replicas(spark):
    pages = made(spark, 20)
    records = fixity.warc_records(pages)
    less = records.where("record_no <> 100000")
    assert [(r.record_no, r.status) for r in fixity.audit(less, records).collect()] == [(100_000, "added")]
    none = fixity.warc_records(spark.createDataFrame([], PAGES))
    assert fixity.audit(none, none).collect() == []
    assert {r.status for r in fixity.audit(records, none).collect()} == {"missing"}


def test_written_archives_can_be_read(spark, tmp_path):
    records = fixity.warc_records(made(spark, 30))
    fixity.write_warc(records, f"{tmp_path}/out")
    data = b"".join(open(f, "rb").read() for f in sorted(glob.glob(f"{tmp_path}/out/part-*")))
    seen = 0
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        n = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert head.startswith(b"WARC/1.0\r\n") and rest[n : n + 4] == b"\r\n\r\n"
        data, seen = rest[n + 4 :], seen + 1
    assert seen == records.count()


def test_replicas_on_disk_are_audited(spark, tmp_path):
    records = fixity.warc_records(made(spark, 400))
    for name in ("first", "second"):
        fixity.write_warc(records, f"{tmp_path}/{name}", archives=3)
    first, second = (fixity.read_warc(spark, f"{tmp_path}/{name}") for name in ("first", "second"))
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, records.collect()))
    assert fixity.audit(first, second).collect() == []
    for f in glob.glob(f"{tmp_path}/second/.*crc"):
        os.remove(f)
    damaged = []
    for f in sorted(glob.glob(f"{tmp_path}/second/part-*")):
        data = bytearray(open(f, "rb").read())
        if at := data.find(b"<p>") + 1:
            damaged.append(int(re.findall(rb"urn:page:(\d+)", data[:at])[-1]))
            data[at - 1] = ord("?")
            open(f, "wb").write(data)
    assert damaged and sorted(r.record_no for r in fixity.audit(first, second).where("status = 'corrupt'").collect()) == sorted(damaged)


def test_a_very_long_record(spark):
    records = fixity.warc_records(spark.createDataFrame([(1, "u", "é" * 2_000_000, ""), (2, "u", "", "")], PAGES))
    told = {r.record_no: (r.lo, r.hi, r.status) for r in fixity.report(records, fixity.warc_records(spark.createDataFrame([(1, "u", "é" * 1_999_999 + "e", ""), (2, "u", "", "")], PAGES))).collect()}
    assert told[1][2] == "corrupt" and told[1][1] == told[2][0] and told[2][2] == "moved" and told[1][1] > 4_000_000


def test_negative_numbers_have_a_root(spark):
    records = fixity.warc_records(spark.createDataFrame([(n, "u", f"h{n}", "") for n in (-100_000, -4096, -1, 0, 5000)], PAGES))
    assert fixity.audit(records, records).collect() == []
    assert {r.record_no: r.status for r in fixity.audit(records, records.where("record_no <> -100000")).collect()} == {-100_000: "missing"}


def test_bodies_that_quote_records(spark, tmp_path):
    inner = "<pre>\r\n\r\nWARC/1.0\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\nContent-Length: 999999\r\n\r\n</pre>"
    rows = [(1, "u", inner, ""), (2, "u", "plain", ""), (3, "u", inner + "é" + inner, ""), (4, "u", "", ""), (5, "u", "ends\r\n\r\n", "")]
    records = fixity.warc_records(spark.createDataFrame(rows, PAGES))
    fixity.write_warc(records, f"{tmp_path}/w", archives=1)
    read = fixity.read_warc(spark, f"{tmp_path}/w")
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, records.collect()))
    assert fixity.audit(records, read).collect() == []


def test_a_broken_header_blames_its_own_archive(spark, tmp_path):
    records = fixity.warc_records(spark.createDataFrame([(n, "u", f"body {n}", "") for n in [*range(26), *range(4096, 4110)]], PAGES))
    fixity.write_warc(records, f"{tmp_path}/w", archives=1)
    for f in glob.glob(f"{tmp_path}/w/.*crc"):
        os.remove(f)
    for f in glob.glob(f"{tmp_path}/w/part-*"):
        data = open(f, "rb").read()
        # a number that cannot be read, and a length that leads nowhere
        data = data.replace(b"<urn:page:4100>", b"<urn:page:41?0>").replace(b"Content-Length: 9\r\n\r\nbody 4102", b"Content-Length: 8\r\n\r\nbody 4102")
        open(f, "wb").write(data)
    told = fixity.audit(records, fixity.read_warc(spark, f"{tmp_path}/w")).collect()
    assert not [r for r in told if r.archive == 0]
    by = {r.record_no: r.status for r in told}
    assert by[4100] == "missing" and by[fixity.UNREADABLE] == "added" and by[4102] == "corrupt"
    assert {by.get(n) for n in range(4096, 4100)} == {None} and {by[n] for n in (4101, *range(4103, 4110))} == {"moved"}
