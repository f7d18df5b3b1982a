import base64
import hashlib
import random

import pytest
import zstandard

from strandline.llm import shared, warc

PAGES = "page_id long, url string, html string, first string, shared int"


def pages():
    rnd = random.Random(4)
    rows = [
        (3, "u", "<a>", "x", 1), (1, "v\r\n w", "<a>", "x", 1), (1, "v", "<a>", "x", 1), (5, None, None, "x", 1), (6, "x", "", None, None),
        (None, "n", "only", "x", 1), (None, "n", "only", "x", 1), (None, "m", "<a>", "x", 1), (9, "ü", "äö\r\n\r\n" * 200_000, "x", 1), (10, "z", "q" * 100, "x", 1),
    ]
    rows += [(100 + k, f"http://h/{k}", "copy" if k % 3 == 0 else rnd.randbytes(400).hex(), None, None) for k in range(600)]
    return rows


def plain(rows, least=0):
    out, by = [], {}
    for k, r in enumerate(rows):
        by.setdefault((r[2] or "").encode(), []).append((r[0] is None, r[0] or 0, r[1] is not None, r[1] or "", k))
    for data, found in by.items():
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        for n, x in enumerate(sorted(found)):
            response = n == 0 or len(data) < least
            out.append((rows[x[-1]][0], len(data), digest, "response" if response else "revisit", None if response else rows[min(found)[-1]][0]))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


@pytest.mark.parametrize("least", [0, 4, 101])
def test_pages_come_back(spark, monkeypatch, least):
    monkeypatch.setattr(warc, "SALTS", 5)
    path = shared.new_path(spark, "test-warc")
    warc.write_archives(spark.createDataFrame(pages(), PAGES), path, least=least)
    assert rows_of(warc.read_archives(spark, path)) == plain(pages(), least)


def test_records_are_found_through_index_and_seek_table(spark):
    path = shared.new_path(spark, "test-warc")
    warc.write_archives(spark.createDataFrame(pages(), PAGES), path)
    index = warc.archive_index(spark, path)
    entries = index.collect()
    assert len({r.record_id for r in entries}) == len(entries) == len(pages()) + len({r.bundle for r in entries})
    wanted = [r.record_id for r in entries if r.frame > 0 or ":10:" in r.record_id]
    ids = spark.createDataFrame([(x,) for x in [*wanted, wanted[0], "<urn:none>", None]], "record_id string")
    found = {r.record_id: r for r in warc.lookup(index, ids).collect()}
    assert set(found) == set(wanted)
    for name, r in found.items():
        fields, block = warc.parse(bytes(r.record))
        assert fields["warc-record-id"] == name and block == bytes(r.block)
    assert warc.lookup(index, ids.limit(0)).count() == 0


def test_any_reader_of_zstandard_reads_a_bundle(spark):
    """Frames one after the other are the records one after the other; skippable frames hold nothing."""
    path = shared.new_path(spark, "test-warc")
    warc.write_archives(spark.createDataFrame(pages(), PAGES), path)
    for r in spark.read.format("binaryFile").load(path).collect():
        content = bytes(r.content)
        plain = zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True).read()
        bundle = warc.Bundle(content)
        assert plain == b"".join(x for _, x in bundle.records()) and content[-4:] == warc.SEEK_MAGIC
        assert plain.count(b"WARC/1.1\r\n") == bundle.index.num_rows


def bundle(n=40):
    out = warc.BundleWriter("t")
    for k in range(n):
        out.add(*warc.page_record(k, "u", warc.payload_digest(b"x" * k), 0, k, b"x" * k, None))
    return out.done() + warc.SEEK_MAGIC


def test_frames_are_reached_alone(monkeypatch):
    monkeypatch.setattr(warc, "FRAME", 1000)
    b = warc.Bundle(bundle())
    assert len(b.table) > 5
    seen = []
    monkeypatch.setattr(warc.Bundle, "frame", lambda self, k, f=warc.Bundle.frame: seen.append(k) or f(self, k))
    last = b.index.slice(b.index.num_rows - 1)
    ((_, data),) = b.records(last)
    assert warc.page_facts(data)[:2] == (39, 39) and seen == [last["frame"][0].as_py()]


def test_unsound_bundles_are_told(monkeypatch):
    monkeypatch.setattr(warc, "FRAME", 1000)
    good = bundle()
    for bad in (b"", good[:-1], good[:-4] + b"abcd", good[:40] + bytes([good[40] ^ 255]) + good[41:]):
        with pytest.raises((warc.WarcError, zstandard.ZstdError)):
            list(warc.Bundle(bad).records())
    name, data = warc.page_record(1, None, warc.payload_digest(b"abc"), 0, 3, b"abd", None)
    for bad in (data, data[:-1], b"x" + data, data.replace(b"Content-Length", b"Content-Width")):
        with pytest.raises(warc.WarcError):
            warc.page_facts(bad)
    assert warc.page_facts(warc.record("warcinfo", "<urn:bundle:0>", [], b"x")) is None


def test_no_pages(spark):
    path = shared.new_path(spark, "test-warc")
    warc.write_archives(spark.createDataFrame([], PAGES), path)
    assert warc.read_archives(spark, path).count() == 0 and warc.archive_index(spark, path).count() == 0
