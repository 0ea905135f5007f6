"""Salvage against what was written."""

import base64
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import warc


class Bytes:
    def __init__(self, raw):
        self.raw = raw

    def read_at(self, n, at):
        return self.raw[at : at + n]


def read(raw, splits=1, **caps):
    """As read_warc does it: guessed beginnings, then the chain until it holds, then the records."""
    reader = warc.Reader(warc.View(Bytes(raw), len(raw)), **caps)
    cuts = [len(raw) * i // splits for i in range(splits + 1)]
    spans = list(zip(cuts, cuts[1:]))
    known, asked = {}, [(a, reader.next_valid(a, b) if a else 0) for a, b in spans]
    while asked:
        known |= {(a, begin): reader.end(begin, dict(spans)[a]) for a, begin in asked}
        begins, asked = warc.chain(spans, known)
    return [x for a, b in spans for x in reader.salvage(begins[a], b)]


def records(n, compress=True):
    # a block may hold what looks like a record or a member
    tricky = b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + warc.MEMBER
    return [warc.record({"WARC-Type": "resource", "N": str(i)}, (b"block %d " % i) * (i * 40) + (tricky if i % 3 == 0 else b""), compress) for i in range(n)]


def whole(rows, raw):
    at = 0
    for _, offset, length, *_ in rows:
        assert offset == at
        at += length
    assert at == len(raw)


@pytest.mark.parametrize("compress", [True, False])
def test_sound_files(compress):
    raw = b"".join(records(20, compress))
    rows = read(raw)
    whole(rows, raw)
    assert [r[3]["n"] for r in rows] == [str(i) for i in range(20)] and all(r[0] == "record" for r in rows)


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("kind", ["flip", "cut", "junk", "headless"])
def test_later_records_are_recovered(compress, kind):
    parts = records(20, compress)
    middle = len(parts[7]) // 2
    bad = {"flip": parts[7][:middle] + bytes([parts[7][middle] ^ 0x41]) + parts[7][middle + 1 :], "cut": parts[7][:middle], "junk": parts[7] + b"\0" * 50 + b"WARC/1.x" + warc.MEMBER + b"zz", "headless": parts[7][5:]}[kind]
    raw = b"".join([*parts[:7], bad, *parts[8:]])
    rows = read(raw)
    whole(rows, raw)
    got = {r[3]["n"] for r in rows if r[0] == "record"}
    assert {str(i) for i in range(20)} - got <= {"7"}
    assert any(r[0] == "gap" and r[5] for r in rows)


def nested(compress):
    """Records whose stored blocks are whole records and members, broken ones and junk between them."""
    inner = b"".join(records(3)) + b"".join(records(3, False))
    out = []
    for i in range(12):
        raw = warc.record({"WARC-Type": "resource", "N": str(i)}, inner if i % 3 == 1 else b"x" * 50 * i, False)
        if compress:
            stored = zlib.compressobj(0, zlib.DEFLATED, 31)
            raw = stored.compress(raw) + stored.flush()
        out.append(raw[: len(raw) // 2] if i == 6 else raw + b"junk" * 9 if i == 9 else raw)
    return out


@pytest.mark.parametrize("compress", [True, False])
def test_splits_read_what_one_reader_reads(compress):
    for parts in (nested(compress), [b"" if i == 4 else (p[: len(p) // 2] if i % 5 == 2 else p) for i, p in enumerate(records(30, compress))]):
        raw = b"".join(parts)
        one = read(raw)
        whole(one, raw)
        assert sum(r[0] == "record" for r in one) >= 10
        for n in (2, 3, 7, 40, 200):
            assert read(raw, n) == one


@pytest.mark.parametrize("compress", [True, False])
def test_digests_line_ends_and_caps(compress):
    block = b"some block\n" * 9

    def made(digest, end="\r\n"):
        raw = end.join(["WARC/1.1", f"WARC-Block-Digest: {digest}", f"Content-Length: {len(block)}", "", ""]).encode() + block + 2 * end.encode()
        deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
        return deflate.compress(raw) + deflate.flush() if compress else raw

    good = ["sha1:" + hashlib.sha1(block).hexdigest(), "SHA-256:" + hashlib.sha256(block).hexdigest().upper(), "md5:" + hashlib.md5(block).hexdigest(), "sha256:" + base64.b32encode(hashlib.sha256(block).digest()).decode(), "other:x"]
    raw = b"".join([*map(made, good), *(made(d, "\n") for d in good)])
    assert [r[0] for r in read(raw)] == ["record"] * 10
    assert [r[5] for r in read(made("sha1:" + hashlib.sha1(b"").hexdigest()) + raw)][:2] == ["block digest differs", None]
    assert {r[5] for r in read(raw, max_record=60)} == {"record too long"} and {r[5] for r in read(raw, max_header=20)} == {"headers do not end"}


def test_files_of_every_kind_and_split(spark, tmp_path):
    """Compressed and plain files, with misleading names, are read the same in splits of any size."""
    (tmp_path / "w").mkdir()
    for name, parts in {"a.gz": nested(False), "b.warc": nested(True), "c.gz": nested(True), "d.warc": nested(False), "e.gz": [], "f.gz": [b"no record"]}.items():
        (tmp_path / "w" / name).write_bytes(b"".join(parts))
    got = [sorted((r.path, r.offset, r.length, r.kind, r.reason, r.block) for r in warc.read_warc(spark, f"file://{tmp_path}/w", n).collect()) for n in (1 << 20, 700, 150)]
    assert got[0] == got[1] == got[2] and sum(r[3] == "record" for r in got[0]) == 44
    for name in "abcdf":
        raw = next((tmp_path / "w").glob(f"{name}.*")).read_bytes()
        assert [r[1:4] for r in got[0] if f"/{name}." in r[0]] == [(o, n, k) for k, o, n, *_ in read(raw)]


def test_empty_and_hopeless_files():
    assert read(b"") == []
    assert [r[:3] for r in read(b"no record at all" * 100)] == [("gap", 0, 1600)]


@pytest.mark.parametrize("compress", [True, False])
def test_pages_round_trip(spark, tmp_path, compress):
    rows = [(i, f"http://x/{i}", "ä" * i) for i in range(120)] + [(500, None, None), (None, "u", "lost"), (501, "same", "row"), (501, "same", "row"), (502, "long", "z" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit(1))
    folder = f"file://{tmp_path}/w"
    written = warc.write_pages(pages, folder, pages_per_file=50, compress=compress).collect()
    assert sum(r.records for r in written) == 125
    got = warc.read_warc(spark, folder, split_bytes=700).collect()
    assert {r.kind for r in got} == {"record"}
    assert sorted((r.headers["warc-target-uri"], bytes(r.block).decode()) for r in got) == sorted((u or "", h or "") for p, u, h in rows)
    assert warc.write_pages(pages.where("false"), f"{folder}2").collect() == []


def test_damaged_pages(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i}</p>" * 30) for i in range(600)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    warc.write_pages(pages, folder, damage=warc.wear).collect()
    got = warc.read_warc(spark, folder, split_bytes=5000).collect()
    sound = {i for i in range(600) if warc.wear(i, b"x" * 10)[:10] == b"x" * 10}
    ids = [int(r.headers["warc-record-id"][10:-1]) for r in got if r.kind == "record"]
    assert sorted(ids) == sorted(sound) and 550 < len(sound) < 600 and any(r.kind == "gap" for r in got)
