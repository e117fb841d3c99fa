from __future__ import annotations

import gzip
import hashlib

import pytest

from sylva.llm import common, warc

PAGES = "page_id long, url string, html string"


def chunks(data, n=7):
    return (data[i : i + n] for i in range(0, len(data), n))


def records():
    payloads = [b"", b"x" * 100, "é\r\n\r\nWARC/1.1\r\n".encode() * 50, bytes(range(256)) * 3000]
    return payloads, [warc.encode_record(i, f"http://e.x/{i}?q=é\r\nX: y", p, hashlib.sha256(p).hexdigest(), None) for i, p in enumerate(payloads)]


def test_round_trip_in_small_chunks():
    payloads, members = records()
    for n in (1, 7, 1 << 20):
        got = list(warc.read_records(chunks(b"".join(members), n)))
        assert [r.payload for r in got] == payloads
        assert all("\r" not in v and r.payload_length == len(r.payload) for r in got for v in r.headers.values())
    assert all(gzip.decompress(m).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") for m in members)


def test_damage_is_refused():
    _, members = records()
    plain = gzip.decompress(members[1])
    bad = [members[1][:-3], members[1] + b"x", gzip.compress(plain.replace(b"xxx", b"xyx", 1)), gzip.compress(plain[:-1]), gzip.compress(plain * 2), gzip.compress(b"no record")]
    for data in bad:
        with pytest.raises(warc.WarcError):
            list(warc.read_records(chunks(data)))


@pytest.mark.parametrize("most", (warc.BROADCAST_GROUPS, 0))
def test_pages(spark, monkeypatch, most):
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", most)
    monkeypatch.setattr(common, "HOT", 2)
    big, other = "b" * 150, "é" * 60
    rows = [(5, "u", big), (3, "u", big), (9, None, big), (9, None, big), (1, "u", "small"), (2, "u", "small"), (4, "u", None), (6, "u", ""), (None, "u", big), (7, "u", other), (None, "u", "n" * 200), (None, "u", "n" * 200), (8, "u", "z" * 3_000_000)]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as payload", "2 as digest", "3 as first").repartition(3)
    archives = warc.write_archives(df, archive_bytes=200)
    assert archives.count() > 3
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in warc.page_records(archives).collect())

    def want(i, html):
        data = (html or "").encode()
        visit = html == big and i != 3
        return (str(i), len(data), hashlib.sha256(data).hexdigest(), "revisit" if visit else "response", "3" if visit else "None")

    assert got == sorted(want(i, html) for i, _, html in rows)
    kept = warc.read_archives(archives, with_payload=True).filter("record_type = 'response'").collect()
    assert {bytes(r.payload) for r in kept} == {(h or "").encode() for _, _, h in rows}


def test_no_pages(spark):
    assert warc.page_records(warc.write_archives(spark.createDataFrame([], PAGES))).count() == 0
