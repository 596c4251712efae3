import gzip
import hashlib
import random
from collections import defaultdict

import pytest
from pyarrow import fs

from rewardloom.llm import warc

KINDS = "page_id long, url string, html string, digest string, payload string, n_bytes string, size string, chunk string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    big = "".join(rng.choice("abcdefgh\r\n é😀") for _ in range(300_000))
    copy = "<p>" + "same " * 40 + "</p>"
    out = [(i, f"http://x/{i}", rng.choice([copy, copy[:99], f"<p>{i}</p>" * i, "é" * 50, big])) for i in range(1, 80)]
    out += [(90, None, None), (91, "http://x/a\r\nWARC-Type: hidden", ""), (92, "u", "WARC/1.0\r\n\r\n" * 20), (93, "u", big), (93, "u", big), (None, "u", copy)]
    return out


@pytest.fixture(scope="module")
def archives(spark, rows):
    pages = spark.createDataFrame([(*r, *["clash"] * 5) for r in rows], KINDS).repartition(3)
    return warc.archived(pages)


def brute(rows):
    payloads = [(r[0], (r[2] or "").encode()) for r in rows]
    first = defaultdict(list)
    for page, data in payloads:
        if len(data) >= 100 and page is not None:
            first[data].append(page)
    out = []
    for page, data in payloads:
        least = min(first.get(data, [page]), key=lambda p: (p is None, p))
        revisit = least != page
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", least if revisit else None))
    return sorted(out, key=str)


def test_archives_equal_brute_force(archives, rows):
    last = warc.read(archives, with_data=False).where("last").collect()
    assert sorted([(r.page_id, r.n_bytes, r.digest, r.type, r.refers_to) for r in last], key=str) == brute(rows)


def test_chunks_carry_running_digests_and_the_payload(archives, rows):
    by = defaultdict(list)
    for r in warc.read(archives).where("type = 'response' and page_id <> 93").collect():
        by[r.page_id].append(r)
    texts = {r[0]: (r[2] or "").encode() for r in rows}
    assert any(len(x) > 3 for x in by.values())
    for page, chunks in by.items():
        whole = b""
        for n, r in enumerate(sorted(chunks, key=lambda r: r.chunk)):
            whole += bytes(r.data)
            assert (r.chunk, r.n_bytes, r.digest) == (n, len(whole), hashlib.sha256(whole).hexdigest())
            assert len(r.data) <= 2**25
        assert whole == texts[page] and r.last


def test_files_are_plain_gzip_members(archives, rows):
    found = archives.collect()
    assert sum(r.records for r in found) == len(rows)
    for r in found:
        files, path = fs.FileSystem.from_uri(r.uri)
        data = gzip.decompress(files.open_input_stream(path, compression=None).read())
        assert data.startswith(b"WARC/1.0\r\nWARC-Type: ") and data.endswith(b"\r\n\r\n")


def test_a_changed_archive_is_an_error(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "<p>" + "a" * 500 + "</p>")], "page_id long, url string, html string")
    uri = warc.archived(pages).first().uri
    files, path = fs.FileSystem.from_uri(uri)
    data = gzip.decompress(files.open_input_stream(path, compression=None).read()).replace(b"aaaa", b"aaba", 1)
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(data))
    with pytest.raises(ValueError, match="digest"):
        list(warc.records(str(tmp_path / "x.warc.gz")))
    (tmp_path / "y.warc.gz").write_bytes(gzip.compress(data[:200]))
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.records(str(tmp_path / "y.warc.gz")))


def test_large_archives_are_closed(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    pages = spark.createDataFrame([(i, "u", "".join(random.Random(i).choices("abcdef", k=3000))) for i in range(9)], "page_id long, url string, html string")
    found = warc.archived(pages.coalesce(1))
    assert found.count() > 2
    assert warc.read(found, with_data=False).where("last").count() == 9


def test_empty(spark):
    assert warc.read(warc.archived(spark.createDataFrame([], "page_id long, url string, html string"))).collect() == []
