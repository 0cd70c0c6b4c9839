import base64
import gzip
import hashlib

import pytest
from pyarrow import fs

from sitewright.llm.common import fresh_folder
from sitewright.llm.warc import Index, archive, build_index, parse_record, read_captures, record, surt, write_archives

PAGES = [
    (3, "http://b.example.com/x?q=1#f", "<p>same</p>", "a"), (1, "https://a.example.com/", "<p>same</p>", None), (2, "http://b.example.com/x?q=1", "<p>żółw 漢</p>\r\n\r\nWARC/1.1", "c"),
    (4, None, None, "d"), (5, "http://a.example.com/", "", "e"), (6, "odd url\twith\nblanks", "x" * 100_000, "f"), (7, "http://b.example.com/x", "<p>same</p>", "g"),
] + [(100 + i, "http://hot.example.org/p", f"body {i % 40}", "h") for i in range(300)]


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def brute(pages, least=0):
    first = {}
    for i, _, h, _ in pages:
        first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h, _ in pages:
        b = (h or "").encode()
        again = first[h or ""] != i and len(b) >= least
        out.append((i, len(b), digest(b), "revisit" if again else "response", first[h or ""] if again else None))
    return sorted(out)


def rows(df):
    return sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect())


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string, file string").repartition(3)


def test_keys():
    assert surt("http://User@WWW.Example.com:8080/A/b?c=D#e") == "com,example,www:8080)/A/b?c=D"
    assert surt(None) == ")/" and surt("x.org?q") == "org,x)/?q" and "\t" not in surt("a\tb\n")


def test_records_are_readable_gzip_members():
    raw = record(1, "http://a/ b", b"pay\r\n\r\nload", digest(b"pay\r\n\r\nload"), None) + record(2, None, b"x", digest(b"x"), 1)
    plain = gzip.decompress(raw)
    assert plain.count(b"WARC/1.1\r\n") == 2 and b"WARC-Refers-To: <urn:page:1>" in plain
    bad = record(1, None, b"x", digest(b"y"), None)
    with pytest.raises(ValueError):
        parse_record(bad)


@pytest.mark.parametrize("lines", [3, 1000])
def test_round_trip(pages, lines):
    got = archive(pages, payload=True, block_lines=lines)
    assert rows(got) == brute(PAGES)
    text = {i: (h or "").encode() for i, _, h, _ in PAGES}
    for r in got.collect():
        assert (r["payload"] is None) == (r["record_type"] == "revisit") and (r["payload"] is None or bytes(r["payload"]) == text[r["page_id"]])


def test_small_payloads_are_not_revisited(pages):
    assert rows(archive(pages, least=9)) == brute(PAGES, 9)


def test_repeated_rows_and_empty_tables(spark, pages):
    twice = rows(archive(pages.union(pages)))
    assert twice == sorted(brute(PAGES) * 2)
    assert archive(pages.limit(0)).count() == 0
    none = spark.createDataFrame([(None, "http://a/", "x", "y")], pages.schema)
    assert rows(archive(pages.union(none))) == brute(PAGES)


def test_index_finds_single_keys(spark, pages):
    folder = fresh_folder(spark, "warc-test")
    parts = build_index(write_archives(pages, folder), folder, block_lines=2)
    index = Index(folder, parts)
    assert len(index.find(surt("http://hot.example.org/p"), 100)) == 1
    assert index.find("com,nowhere)/", 1) == [] and index.find("a", 1) == [] and index.find("zz", 1) == []
    one = spark.createDataFrame([("http://hot.example.org/p", 120), ("http://no.example.org/", 1)], "url string, page_id long")
    assert [r["page_id"] for r in read_captures(one, folder, parts).collect()] == [120]
    system, path = fs.FileSystem.from_uri(folder)
    assert any(f.path.endswith(".warc.gz") for f in system.get_file_info(fs.FileSelector(path)))


def test_pages_without_an_id_are_archived(spark, tmp_path):
    from sitewright.llm.queries import QUERIES

    none = [(None, "http://a/", "x", "y"), (None, "https://a/", "x", "y"), (None, "http://a/", "<p>same</p>", "y"), (None, None, None, "y"), (None, "http://z/ b", "", "y")]
    df = spark.createDataFrame([*PAGES, *none, none[0]], "page_id long, url string, html string, file string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["op4_warc_index"](spark, str(tmp_path))
    least = lambda h: min((i for i, _, x, _ in PAGES if (x or "").encode() == h), default=None)
    want = [(None, len(h := (r[2] or "").encode()), digest(h), "response" if least(h) is None else "revisit", least(h)) for r in [*none, none[0]]]
    assert {w[3] for w in want} == {"response", "revisit"}
    assert sorted(map(tuple, got.where("page_id is null").collect()), key=str) == sorted(want, key=str)
    assert rows(got.where("page_id is not null")) == brute(PAGES)
    kept = archive(df, payload=True, unnamed=True, block_lines=2).where("page_id is null").collect()
    texts = [(r[2] or "").encode() for r in [*none, none[0]]]
    assert sorted(bytes(r["payload"]) for r in kept if r["record_type"] == "response") == sorted(h for h in texts if least(h) is None)
    assert all(r["payload"] is None for r in kept if r["record_type"] == "revisit")


def test_one_id_under_urls_of_one_key_is_returned_once_per_row(spark):
    data = [(7, f"{scheme}://h.org/{i % 3}", f"{scheme}{i}", "f") for i in range(12) for scheme in ("http", "https")]
    got = archive(spark.createDataFrame(data, "page_id long, url string, html string, file string"), payload=True)
    assert sorted(bytes(r["payload"]).decode() for r in got.collect()) == sorted(r[2] for r in data)
