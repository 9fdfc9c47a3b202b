import hashlib
import io
import struct
import zipfile

import pytest

from rackline.llm import warc

SCHEMA = "page_id long, url string, html string, more int"


def expected(rows):
    first = {}
    for page, _, html, _ in rows:
        data = (html or "").encode()
        if len(data) >= 100:
            first[data] = min(page, first.get(data, page))
    out = []
    for page, _, html, _ in rows:
        data = (html or "").encode()
        other = first.get(data, page)
        kind = "response" if other == page else "revisit"
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), kind, None if kind == "response" else other))
    return sorted(out)


def test_round_trip(spark):
    same, short = "<p>" + "ä" * 100, "<p>short</p>"
    rows = [
        (7, "http://x/7", same, 1),
        (3, "http://x/3", same, 1),
        (9, None, same, 1),
        (4, "http://x/ 4\n", short, 1),
        (5, "", short, 1),
        (6, "http://x/6", None, 1),
        (8, "http://x/8", "", 1),
        (10, "http://x/10", "line\r\n\r\nWARC/1.1\r\n" * 2000, 1),
        (3, "http://x/3", same, 1),
    ]
    back = warc.archive_pages(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back)
    assert got == expected(rows)
    for r in back:
        assert (r.payload is None) == (r.record_type == "revisit")
        assert r.payload is None or hashlib.sha256(r.payload).hexdigest() == r.payload_digest


def test_page_0_is_the_response_of_revisits(spark):
    same = "<p>" + "x" * 200
    rows = [(0, "http://x/0", same, 1), (1, "http://x/1", same, 1), (-2, "http://x/-2", "other" * 40, 1), (0, "http://x/0", same, 1)]
    back = warc.archive_pages(spark.createDataFrame(rows, SCHEMA)).collect()
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back]
    assert sorted(got) == sorted(expected(rows)) and (1, "revisit", 0) in {(x[0], x[3], x[4]) for x in got}


def test_null_page_id_and_payloads_beyond_a_read(spark, monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 1 << 10)
    big = "<p>" + "".join(chr(97 + i * i % 23) for i in range(200_000))
    rows = [(None, "http://x/n", big, 1), (2, "http://x/2", big, 1), (5, "http://x/5", big, 1), (None, None, None, 1)]
    back = warc.archive_pages(spark.createDataFrame(rows, SCHEMA).repartition(2)).collect()
    digest = hashlib.sha256(big.encode()).hexdigest()
    got = {(r.page_id, r.url, r.payload_bytes, r.record_type, r.refers_to) for r in back}
    assert got == {
        (None, "http://x/n", len(big), "response", None),
        (2, "http://x/2", len(big), "response", None),
        (5, "http://x/5", len(big), "revisit", 2),
        (None, "about:blank", 0, "response", None),
    }
    assert all(r.payload_digest == digest for r in back if r.payload_bytes)
    assert all(r.payload == big.encode() for r in back if r.payload_bytes and r.record_type == "response")


def test_packages_lie_in_sparks_own_file_system(spark, tmp_path):
    folder = warc.package_folder(spark, f"{tmp_path}/a folder/ä")
    where, root = warc.fs.FileSystem.from_uri(folder)
    assert folder.startswith("file:///") and root == f"{tmp_path}/a folder/ä"
    assert warc.package_folder(spark, f"file:{tmp_path}/x") == warc.package_folder(spark, f"{tmp_path}/x")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.defaultFS", "viewfs://shared/")
    conf.set("fs.viewfs.mounttable.shared.link./jobs", f"file:{tmp_path}")
    try:
        assert warc.package_folder(spark, "/jobs/packages") == "viewfs://shared/jobs/packages"
    finally:
        conf.set("fs.defaultFS", "file:///")
        conf.unset("fs.viewfs.mounttable.shared.link./jobs")


def test_empty_table(spark):
    assert warc.archive_pages(spark.createDataFrame([], SCHEMA)).count() == 0


def zipped(limit, comment=b"", **members):
    data = io.BytesIO()
    old = zipfile.ZIP64_LIMIT, zipfile.ZIP_FILECOUNT_LIMIT
    zipfile.ZIP64_LIMIT, zipfile.ZIP_FILECOUNT_LIMIT = limit
    try:
        with zipfile.ZipFile(data, "w", zipfile.ZIP_STORED) as package:
            package.comment = comment
            for name, content in members.items():
                package.writestr(name, content)
    finally:
        zipfile.ZIP64_LIMIT, zipfile.ZIP_FILECOUNT_LIMIT = old
    return data.getvalue()


@pytest.mark.parametrize("limit", [((1 << 31) - 1, 65535), (10, 65535), (10, 1)])
@pytest.mark.parametrize("comment", [b"", b"PK\x05\x06 a comment that looks like an end record"])
def test_directory_with_and_without_zip64(limit, comment):
    members = {"a": b"x" * 100, "b": b"", "ü": b"y" * 33}
    data = zipped(limit, comment, **members)
    if limit[0] == 10:
        # Mark what Python stored in 64 bits as such in the end record, too.
        assert b"PK\x06\x06" in data
    found = warc.members(io.BytesIO(data), len(data))
    assert [m.name for m in found] == list(members)
    for m in found:
        assert warc.read_range(io.BytesIO(data), m.start, m.length) == members[m.name]


def test_broken_packages_are_refused():
    good = zipped(((1 << 31) - 1, 65535), a=b"x" * 50)
    for data in (b"", b"no zip at all", good[:-10], good[:40]):
        with pytest.raises((ValueError, struct.error)):
            warc.members(io.BytesIO(data), len(data))


def test_compressed_members_are_not_read_as_archives(tmp_path):
    path = tmp_path / "x.wacz"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as package:
        package.writestr(warc.ARCHIVE, b"x" * 100)
        package.writestr(warc.INDEX, b"")
    with pytest.raises(ValueError):
        list(warc.index_entries(f"file://{path}"))
