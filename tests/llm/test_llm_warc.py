import hashlib

import pytest

from cuesheet.llm import warc

LONG = "<p>" + "word " * 60 + "</p>"


def test_build_archive_is_a_dictionary_frame_and_a_frame_per_record():
    records = [warc.warc_record(i, f"http://a/{i}", (LONG + str(i)).encode(), 0, "d", None, "x") for i in range(200)]
    data = warc.build_archive(records)
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC
    frames = list(warc._frames(data))
    assert [kind for kind, _ in frames] == [True] + [False] * 200
    assert frames[0][1][:4] == b"\x37\xa4\x30\xec"  # a trained dictionary
    assert list(warc.archive_records(data)) == records
    # the writer's line separator is an empty frame that readers pass over
    assert list(warc.archive_records(data + warc.EMPTY_FRAME.encode())) == records


def test_few_short_records_have_an_empty_leading_frame():
    data = warc.build_archive([b"a", b""])
    assert data[:8] == warc.DICTIONARY_MAGIC.to_bytes(4, "little") + b"\0\0\0\0"
    assert list(warc.archive_records(data)) == [b"a", b""]


def test_damaged_payload_is_noticed():
    record = warc.warc_record(1, None, b"x" * 10, 10, hashlib.sha256(b"y").hexdigest(), None, "d")
    with pytest.raises(ValueError, match="damaged"):
        warc.parse_record(record)


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        (5, "http://a/5", LONG), (3, "http://a/3", LONG), (9, None, LONG), (9, None, LONG),  # 9 repeats
        (1, "http://a/\r\nX: 1", "short"), (2, "u", "short"),  # short: no revisit
        (7, "u", None), (8, "u", ""), (None, "u", LONG), (10, "u", "é" * 49), (11, "u", "é" * 49), (12, "u", "é" * 50),
        (13, "u", "é" * 50), (14, "u", "x\r\n\r\n" * 30_000), (15, "u", "WARC/1.1\r\n\r\nP*M\x18\0\0\0\0" * 20),
    ]
    return spark.createDataFrame([(*r, 0, "z") for r in rows], "page_id long, url string, html string, payload long, refers_to string")


@pytest.mark.parametrize("archive_bytes", [1, 2000, 1 << 20])
def test_round_trip(spark, tmp_path, pages, archive_bytes):
    path = str(tmp_path / "w")
    warc.write_warc(pages, path, archive_bytes=archive_bytes)
    got = warc.read_warc(spark, path).collect()
    html = {(r.page_id, r.html or "") for r in pages.collect()}
    assert len(got) == 15
    want = {3: None, 5: 3, 9: 3, None: 3, 1: None, 2: None, 7: None, 8: None, 10: None, 11: None, 12: None, 13: 12, 14: None, 15: None}
    for r in got:
        assert r.refers_to == want[r.page_id], r.page_id
        assert r.record_type == ("response" if r.refers_to is None else "revisit")
        text = next(h for p, h in html if p == r.page_id)
        assert r.payload_bytes == len(text.encode()) and r.payload_digest == hashlib.sha256(text.encode()).hexdigest()
        assert (None if r.payload is None else bytes(r.payload)) == (text.encode() if r.refers_to is None else None)
        assert r.target_uri is None if r.page_id == 9 else "\n" not in r.target_uri


def test_empty_table(spark, tmp_path, pages):
    path = str(tmp_path / "w")
    warc.write_warc(pages.limit(0), path)
    assert warc.read_warc(spark, path).count() == 0


def test_repeated_first_capture_is_a_response_each(spark, tmp_path):
    rows = [(1, "u", LONG), (1, "u", LONG), (2, "u", LONG)]
    path = str(tmp_path / "w")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.read_warc(spark, path).collect())
    assert got == [(1, "response", None), (1, "response", None), (2, "revisit", 1)]
