import gzip
import hashlib
import io

import pytest

from newsmill.llm import common, files, warc
from newsmill.llm.common import new_folder

SCHEMA = "page_id long, url string, html string, digest string, payload string"


def go(spark, rows, partitions=3):
    df = spark.createDataFrame([(i, u, h, "d", "p") for i, u, h in rows], SCHEMA).repartition(partitions)
    whole, normal = new_folder(spark, "t"), new_folder(spark, "t")
    names = warc.write_monolithic(warc.with_revisits(df), whole)
    done = warc.normalise(names, whole, normal)
    index = warc.index_of(spark, normal, done.count() > 0)
    return warc.read_indexed(index, normal), index, whole, normal


@pytest.fixture
def rows():
    big = "ä" * 600
    return [
        (1, "https://a/ü?x y", big), (2, None, big), (3, "u", big), (3, "u", big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (None, "u", big), (None, None, None),
        (8, "line\r\nbreak: x", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 50), (9, "u", "z" * 3_000_000),
    ]


def test_round_trip(spark, rows):
    out, index, whole, normal = go(spark, rows)
    got = out.collect()
    payload = {i: (h or "").encode() for i, _, h in rows if i is not None}
    assert sorted((r.page_id for r in got), key=repr) == sorted((i for i, _, _ in rows), key=repr)
    for r in got:
        if r.page_id is not None:
            p = payload[r.page_id]
            assert (r.payload_bytes, r.payload_digest) == (len(p), hashlib.sha1(p).hexdigest())
            assert (r.record_type, r.refers_to) == (("revisit", 3) if r.page_id in (1, 2) else ("response", None))
            assert bytes(r.payload) == (p if r.record_type == "response" else b"")
    # The written file is one member; the normalised one has a member at every offset of its index.
    for name in {r.file for r in index.collect()}:
        data = files.reading(f"{whole}/{name}").read()
        plain = gzip.decompress(data)
        assert data.count(b"\x1f\x8b\x08") >= 1 and len(list(warc.records([plain]))) == plain.count(b"WARC-Record-ID")
        new = files.reading(f"{normal}/{name}").read()
        assert gzip.decompress(new) == plain
        at = sorted((r.offset, r.length) for r in index.where(index.file == name).collect())
        assert at[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(at, at[1:])) and sum(at[-1]) == len(new)


def test_empty(spark):
    assert go(spark, [])[0].count() == 0


@pytest.mark.parametrize("crowd", [500, 2])
def test_shuffled_digests(spark, rows, monkeypatch, crowd):
    """Beyond what is broadcast, the records are the same, and pages that no other page repeats aren't shuffled."""
    rows = rows + [(100 + i, "u", "a copied page " * 100) for i in range(40)] + [(200 + i, "u", f"page {i} " * 200) for i in range(20)]
    read = lambda: sorted((repr(r) for r in go(spark, rows)[0].collect()))
    want = read()
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "CROWD", crowd)
    assert read() == want
    df = spark.createDataFrame([(i, u, h) for i, u, h in rows], "page_id long, url string, html string")
    seen = []
    monkeypatch.setattr(warc, "joined", lambda left, *rest: seen.append(left.count()) or common.joined(left, *rest))
    assert warc.with_revisits(df).count() == len(rows) and 45 <= seen[0] < 50


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_inflate_any_members(chunk):
    a, b = (warc.record(i, "u", b"x" * 100 * i, hashlib.sha1(b"x" * 100 * i).hexdigest(), None, "d") for i in (1, 2))
    for data in (gzip.compress(a + b), gzip.compress(a) + gzip.compress(b)):
        assert [w for _, w in warc.records(warc.inflated(io.BytesIO(data), chunk))] == [a, b]
    with pytest.raises(ValueError):
        list(warc.records(warc.inflated(io.BytesIO(gzip.compress(a[:-9])), chunk)))
