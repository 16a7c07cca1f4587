import gzip
import pathlib
import random
import re

import pytest

from seriesmith.llm import warc as W


def record(i, payload, refers=None):
    return W.record_bytes(i, f"http://x/{i}", None if refers is not None else payload, len(payload), W.digest32(payload), refers)


def whole(data):
    assert W.members(data)[-1] == 0
    return W.members(data)


def found(data):
    return [(a, b, x if isinstance(x, str) else int(x.headers["x-page-id"])) for a, b, x in W.salvage(data)]


def test_members_are_gzip():
    data = b"".join(whole(record(i, b"p%d" % i)) for i in range(5))
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 5
    assert [x[2] for x in found(data)] == list(range(5))


def test_plain_archives():
    data = b"".join(record(i, b"WARC/1.1\r\n inside \x1f\x8b\x08 %d" % i) for i in range(4))
    assert [x[2] for x in found(data)] == [0, 1, 2, 3]


@pytest.mark.parametrize("form", [whole, bytes])
def test_salvage(form):
    parts = [form(record(i, random.Random(i).randbytes(200))) for i in range(6)]
    broken = list(parts)
    broken[1] = bytes([*parts[1][:-60], parts[1][-60] ^ 0xFF, *parts[1][-59:]])
    broken[3] = parts[3][:-40]
    got = found(b"".join(broken))
    assert [x[2] for x in got if not isinstance(x[2], str)] == [0, 2, 4, 5]
    gaps = [(a, b) for a, b, x in got if isinstance(x, str)]
    at = [sum(map(len, broken[:k])) for k in range(7)]
    assert gaps == [(at[1], at[2]), (at[3], at[4])]
    assert all(a == b for (_, b, _), (a, _, _) in zip(got, got[1:], strict=False)), "records and gaps tile the archive"


def test_garbage_around():
    a, b = whole(record(1, b"one")), whole(record(2, b"two"))
    got = found(b"junk\x1f\x8b\x08junk" + a + b"WARC/1.1\r\nfoo: bar\r\n" + b + b"tail")
    assert [x[2] for x in got if not isinstance(x[2], str)] == [1, 2] and len(got) == 5
    assert found(b"") == [] and len(found(b"nothing at all")) == 1


def test_large_records_span_members(monkeypatch):
    monkeypatch.setattr(W, "MEMBER_BYTES", 1000)
    data = b"".join(whole(record(i, random.Random(i).randbytes(3500 if i == 1 else 10))) for i in range(3))
    assert [x[2] for x in found(data)] == [0, 1, 2]


PAGES = [(1, "http://a/", "same"), (2, "http://b/\r\nx", "same"), (3, None, "other"), (4, "u", None), (5, "u", ""), (None, "u", "same"), (6, "ü", "é" * 9)]


def brute(pages, least=0):
    out = []
    for i, _, html in pages:
        payload = (html or "").encode()
        same = [j for j, _, h in pages if (h or "").encode() == payload]
        head = max((j for j in same if j is not None), default=None)
        revisit = len(payload) >= least and len(same) > 1 and head is not None and i != head
        out.append((i, len(payload), W.digest32(payload), "revisit" if revisit else "response", head if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_pages(table, least):
    got = W.archive_pages(table(PAGES, "page_id long, url string, html string"), least)
    rows = [tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(rows, key=str) == brute(PAGES, least)


def test_real_pages_and_payloads(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    W.write_archives(pages.union(pages.selectExpr("page_id + 1000", "url", "html")), str(tmp_path / "w"))
    got = W.read_archives(spark, str(tmp_path / "w"), with_payload=True)
    assert got.filter("kind = 'gap'").count() == 0 and got.filter("record_type = 'revisit'").count() == 50
    html = {r["page_id"] + 1000: r["html"].encode() for r in pages.collect()}
    assert {r["page_id"]: bytes(r["payload"]) for r in got.filter("record_type = 'response'").collect()} == html


def damaged(spark, table, path):
    W.write_archives(table([(i, "u", f"page {i} " * 30) for i in range(40)], "page_id long, url string, html string").coalesce(1), path)
    (file,) = pathlib.Path(path).glob("part-*")
    data = bytearray(file.read_bytes())
    data[len(data) // 2] ^= 0xFF
    for crc in pathlib.Path(path).glob(".*.crc"):
        crc.unlink()
    file.write_bytes(bytes(data))


def test_damaged_files(spark, table, tmp_path):
    damaged(spark, table, str(tmp_path / "w"))
    got = W.read_archives(spark, str(tmp_path / "w")).collect()
    assert sum(r["kind"] == "record" for r in got) == 39 and sum(r["kind"] == "gap" and r["reason"] != "" for r in got) == 1


def test_gaps_are_logged(spark, table, tmp_path):
    damaged(spark, table, str(tmp_path / "w"))
    with pytest.warns(UserWarning, match="1 gaps.*39 of 40"):
        got = W.salvaged(spark, str(tmp_path / "w"), str(tmp_path / "gaps"), 40)
    assert got.count() == 39 and {r["kind"] for r in got.collect()} == {"record"}
    (gap,) = spark.read.parquet(str(tmp_path / "gaps")).collect()
    assert 0 < gap["start"] < gap["end"] and gap["reason"] and gap["archive"].endswith(".txt")


def test_files_are_rolled_by_bytes(spark, table, tmp_path, monkeypatch):
    rng = random.Random(5)
    pages = table([(i, "u", rng.randbytes(rng.choice([10, 40_000])).hex()) for i in range(200)], "page_id long, url string, html string").coalesce(1)
    monkeypatch.setattr(W, "ROWS_PER_FILE", 2)
    W.write_archives(pages, str(tmp_path / "w"))
    sizes = [f.stat().st_size for f in (tmp_path / "w").glob("part-*")]
    assert len(sizes) > 2 and max(sizes) < 2 * (W.ROW_BYTES + 60_000)
    assert W.read_archives(spark, str(tmp_path / "w")).filter("kind = 'record'").count() == 200


def test_headers(spark, table, tmp_path):
    rows = [(1, "http://a/", "same", 1), (2, "http://b/", "same", 2), (2, "http://b/", "same", 3)]
    W.write_archives(table(rows, "page_id long, url string, html string, head int").coalesce(1), str(tmp_path / "w"))
    (file,) = (tmp_path / "w").glob("part-*")
    heads = [x.headers for _, _, x in W.salvage(file.read_bytes())]
    assert len({h["warc-record-id"] for h in heads}) == 3 and all(re.fullmatch(r"\d{4}-\d\d-\d\dT[\d:]{8}Z", h["warc-date"]) for h in heads)
    (again,) = (h for h in heads if h["warc-type"] == "revisit")
    assert again["warc-refers-to-target-uri"] == "http://b/" and again["x-refers-to-page"] == "2"


def test_empty(table):
    assert W.archive_pages(table([], "page_id long, url string, html string")).count() == 0
