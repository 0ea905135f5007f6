"""Plain WARC files, without digests and in the registered query."""

from collections import Counter

import pyarrow.parquet as pq
import pytest
from test_warc import read, records, whole

from tessera.llm import queries, warc

DATA = "/root/testdata/sf0.001"


def without_digest(raw):
    head, end, block = raw.partition(b"\r\n\r\n")
    return b"\r\n".join(x for x in head.split(b"\r\n") if not x.startswith(b"WARC-Block-Digest")) + end + block


@pytest.mark.parametrize("kind", ["cut", "junk", "headless", "length"])
def test_only_the_damaged_record_is_lost(kind):
    parts = [without_digest(p) for p in records(20, compress=False)]
    for i in (4, 7, 11):
        bad = {"cut": parts[i][: len(parts[i]) // 2], "junk": parts[i] + b"\0" * 50 + b"WARC/1.x", "headless": parts[i][5:], "length": parts[i].replace(b"Content-Length: ", b"Content-Length: 9")}
        parts[i] = bad[kind]
    raw = b"".join(parts)
    rows = read(raw)
    whole(rows, raw)
    got = [int(r[3]["n"]) for r in rows if r[0] == "record"]
    assert got == [i for i in range(20) if kind == "junk" or i not in (4, 7, 11)]
    assert sum(r[0] == "gap" for r in rows) == 3


def test_the_query_reads_plain_files_too(spark):
    got = queries.QUERIES["op3_warc"](spark, DATA).collect()
    ids = pq.read_table(f"{DATA}/pages.parquet", columns=["page_id"])["page_id"].to_pylist()
    sound = Counter(i for i in ids if warc.wear(i, b"x" * 10)[:10] == b"x" * 10)
    assert Counter(r.page_id for r in got if r.kind == "record") == sound
    plain = {r.page_id for r in got if r.kind == "record" and r.file.endswith(".warc")}
    assert plain == {i for i in sound if i % 8 == 0} != set()
