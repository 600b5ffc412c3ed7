import gzip
import hashlib

from crawlwright.llm import warc


def test_edges_and_layout(spark, tmp_path):
    folder = f"file://{tmp_path}/archives"
    big = "<p>" + "x\r\n\r\n" * 60_000
    rows = [(1, "http://a/1", "h" * 100), (2, "http://a/2", "h" * 100), (None, "u", "h" * 100), (3, None, "short"), (4, "b", "short"),
            (5, "c", None), (6, "d", ""), (7, "a\r\nb", big), (7, "a\r\nb", big), (8, "é", big), (9, "z", "ü" * 50), (10, "z", "ü" * 49)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id bigint, url string, html string, payload string, offset int")
    index = warc.write_archives(warc.records_of(df), folder)
    got = sorted(map(tuple, warc.read_records(index, folder).collect()), key=str)
    want = []
    for p, u, h in rows:
        data = (h or "").encode()
        same = [q for q, _, x in rows if (x or "").encode() == data and q is not None]
        first = min(same) if len(data) >= 100 else p
        kind = "response" if p == first else "revisit"
        want.append((p, None if u is None else " ".join(u.split()), kind, None if kind == "response" else first,
                     hashlib.sha256(data).hexdigest(), len(data), bytearray(data) if kind == "response" else None))
    assert got == sorted(want, key=str)
    # any part of the index can be read alone, and every archive is a chain of whole records
    some = index.where("page_id in (2, 9)")
    assert sorted(r["page_id"] for r in warc.read_records(some, folder).collect()) == [2, 9]
    records = 0
    for name in warc.archive_names(folder):
        with gzip.open(name) as f:
            records += f.read().count(b"WARC/1.1\r\n")
    assert records == len(rows)


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.archived(none, f"file://{tmp_path}/none").count() == 0


def test_ranges_join_neighbours():
    rows = [{"archive": "a", "offset": o, "length": 10} for o in (0, 10, 40, 20 + warc.GAP_BYTES * 2)] + [{"archive": "b", "offset": 5, "length": 1}]
    assert [(a, len(s)) for a, s in warc._ranges(rows)] == [("a", 3), ("a", 1), ("b", 1)]
