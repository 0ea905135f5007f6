"""Salvage reader for WARC files.

Records are read one after another, plain or one gzip member each.  A record
that fails a check is quarantined: the reader looks for the next gzip member or
version line that begins a valid record, goes on there, and reports the bytes between as a gap.

Checks: the member inflates and its CRC and length agree; the version line,
header lines and Content-Length are well formed; the block is as long as stated
and ends in two line ends; WARC-Block-Digest, if it is of a kind that hashlib knows, agrees, in base 32 or in
hexadecimal.  Lines may end in LF alone.  What follows a record says nothing about it.

Large files are split, and read as one task would read them: each split first looks for a place where it may begin and says where the
records from there end, which is narrow; these are chained by file, and a split whose beginning is not where the one before
ended is looked at again from there.  For what looks like a record may lie inside another one.  Then the records are read, each split from its true beginning.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged

SPLIT_BYTES = 64 << 20
BLOCK = 1 << 20
#: Bytes of headers, and bytes of a record, inflated, beyond which it counts as broken by default.
MAX_HEADER, MAX_RECORD = 1 << 20, (1 << 31) - (1 << 21)
MEMBER, VERSION = b"\x1f\x8b\x08", b"WARC/1."
SCHEMA = "path string, kind string, offset long, length long, headers map<string,string>, block binary, reason string"


class Broken(ValueError):
    """Why a record fails."""


class View:
    """Bytes of a file, read and kept by block."""

    def __init__(self, file, size: int):
        self.file, self.size, self.blocks = file, size, {}

    def block(self, i: int) -> bytes:
        if i not in self.blocks:
            if len(self.blocks) > 16:
                del self.blocks[min(self.blocks)]
            self.blocks[i] = self.file.read_at(min(BLOCK, self.size - i * BLOCK), i * BLOCK)
        return self.blocks[i]

    def pieces(self, at: int) -> Iterator[bytes]:
        while at < self.size:
            piece = self.block(at // BLOCK)[at % BLOCK :]
            yield piece
            at += len(piece)

    def get(self, at: int, n: int) -> bytes:
        out = bytearray()
        for piece in self.pieces(at):
            out += piece[: n - len(out)]
            if len(out) >= n:
                break
        return bytes(out)

    def find(self, what: bytes, at: int) -> int:
        """Where it is next, or the file's size."""
        tail = b""
        for piece in self.pieces(at):
            area = tail + piece
            if (i := area.find(what)) >= 0:
                return at - len(tail) + i
            at += len(piece)
            tail = area[-(len(what) - 1) :]
        return self.size


def header_end(data: bytes) -> tuple[int, int]:
    """Where the first empty line begins, line end before it included, and where it ends; -1 where there is none."""
    found = [(i, i + len(x)) for x in (b"\r\n\r\n", b"\n\n") if (i := data.find(x)) >= 0]
    return min(found, default=(-1, -1))


def headers(head: bytes) -> tuple[dict[str, str], int]:
    """Header fields, names in lower case, and Content-Length, from the bytes up to the empty line."""
    lines = [x.removesuffix(b"\r") for x in head.split(b"\n")]
    if not lines[0].startswith(VERSION) or not lines[0][len(VERSION) :].isdigit():
        raise Broken("no version line")
    out: dict[str, str] = {}
    last = None
    for line in lines[1:]:
        if line[:1] in (b" ", b"\t") and last:
            out[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise Broken("bad header line")
        last = name.strip().decode("utf-8", "replace").lower()
        out.setdefault(last, value.strip().decode("utf-8", "replace"))
    if not (out.get("content-length", "").isascii() and out["content-length"].isdigit()):
        raise Broken("no content length")
    return out, int(out["content-length"])


def check_digest(fields: dict[str, str], block: bytes) -> None:
    kind, _, value = fields.get("warc-block-digest", "").partition(":")
    kind = kind.lower().replace("-", "")
    if kind not in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"):
        return
    digest = hashlib.new(kind, block).digest()
    if value.lower() != digest.hex() and value.upper().rstrip("=") != base64.b32encode(digest).decode().rstrip("="):
        raise Broken("block digest differs")


class Reader:
    """Steps through a file from a given place, as one reader of the whole file does."""

    def __init__(self, view: View, max_header: int = MAX_HEADER, max_record: int = MAX_RECORD):
        self.view, self.max_header, self.max_record = view, max_header, max_record
        gz = view.get(0, 2) == MEMBER[:2] or view.get(0, len(VERSION)) != VERSION and view.find(MEMBER, 0) < view.find(VERSION, 0)
        self.read, self.mark = (self.member, MEMBER) if gz else (self.plain, VERSION)

    def member(self, at: int) -> tuple[dict[str, str], bytes, int]:
        """(headers, block, end) of the gzip member at this place."""
        if self.view.get(at, 3) != MEMBER:
            raise Broken("no member")
        inflate, out, used, held = zlib.decompressobj(31), [], 0, 0
        try:
            for piece in self.view.pieces(at):
                data = inflate.decompress(piece, self.max_record + 1 - held)
                out.append(data)
                held += len(data)
                used += len(piece)
                if held > self.max_record:
                    raise Broken("record too long")
                if inflate.eof:
                    break
                if len(out) == 1 and held >= len(VERSION) and not data.startswith(VERSION):
                    raise Broken("no version line")
        except zlib.error as e:
            raise Broken("member is damaged: " + str(e).rpartition(": ")[2]) from None
        if not inflate.eof:
            raise Broken("member is cut off")
        data, end = b"".join(out), at + used - len(inflate.unused_data)
        if not data.startswith(VERSION):
            raise Broken("no version line")
        head, body = header_end(data[: self.max_header])
        if head < 0:
            raise Broken("headers do not end")
        fields, n = headers(data[:head])
        block = data[body : body + n]
        if len(block) != n or data[body + n :] not in (b"\r\n\r\n", b"\n\n"):
            raise Broken("content length differs")
        check_digest(fields, block)
        return fields, block, end

    def plain(self, at: int) -> tuple[dict[str, str], bytes, int]:
        """(headers, block, end) of the uncompressed record at this place."""
        if self.view.get(at, len(VERSION)) != VERSION:
            raise Broken("no version line")
        # most headers are short
        head, body = header_end(self.view.get(at, min(4096, self.max_header)))
        if head < 0:
            head, body = header_end(self.view.get(at, self.max_header))
        if head < 0:
            raise Broken("headers do not end")
        fields, n = headers(self.view.get(at, head))
        end = at + body + n
        if body + n + 4 > self.max_record:
            raise Broken("record too long")
        tail = self.view.get(end, 4) if end <= self.view.size else b""
        close = 4 if tail == b"\r\n\r\n" else 2 if tail[:2] == b"\n\n" else 0
        if not close:
            raise Broken("content length differs")
        block = self.view.get(at + body, n)
        check_digest(fields, block)
        return fields, block, end + close

    def next_valid(self, at: int, limit: int) -> int:
        """Where the next valid record begins, or limit."""
        while (at := self.view.find(self.mark, at)) < limit:
            try:
                self.read(at)
                return at
            except Broken:
                at += 1
        return limit

    def salvage(self, begin: int, stop: int) -> Iterator[tuple[str, int, int, dict | None, bytes | None, str | None]]:
        """("record", offset, length, headers, block, None) and ("gap", offset, length, None, None, reason) from begin on, of which each begins before stop."""
        at = begin
        while at < min(stop, self.view.size):
            try:
                fields, block, end = self.read(at)
                yield "record", at, end - at, fields, block, None
            except Broken as e:
                end = self.next_valid(at + 1, self.view.size)
                yield "gap", at, end - at, None, None, str(e)
            at = end

    def end(self, begin: int, stop: int) -> int:
        """Where the records and gaps end that salvage() gives."""
        at = begin
        for _, offset, length, *_ in self.salvage(begin, stop):
            at = offset + length
        return at


def chain(splits: list[tuple[int, int]], known: dict[tuple[int, int], int]) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """The beginnings of a file's splits [start, stop), and the (start, begin) of which the end has to be known first.

    known: (start, begin) -> end.  The beginnings hold if nothing is missing.
    """
    begins, missing, at = {}, [], 0
    guess = {start: end for (start, _), end in known.items()}
    for start, stop in sorted(splits):
        begins[start] = at
        if at >= stop:
            continue
        if (start, at) not in known:
            missing.append((start, at))
        at = max(at, known.get((start, at), guess.get(start, stop)))
    return begins, missing


def _opened(row: dict, max_header: int, max_record: int) -> Iterator[Reader]:
    where, path = fs.FileSystem.from_uri(row["path"])
    with where.open_input_file(path) as file:
        yield Reader(View(file, row["size"]), max_header, max_record)


def _ends(max_header: int, max_record: int):
    """Splits with begin and end; a begin that is null is looked for first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                for reader in _opened(row, max_header, max_record):
                    if row["begin"] is None:
                        row["begin"] = reader.next_valid(row["start"], min(row["stop"], row["size"])) if row["start"] else 0
                    row["end"] = reader.end(row["begin"], row["stop"])
            yield pa.RecordBatch.from_pylist(rows, batch.schema)

    return run


def _chained(rows: pd.DataFrame) -> pd.DataFrame:
    """All splits of one file with their beginnings, and whether the end from there is known."""
    spans = list(set(zip(rows["start"].tolist(), rows["stop"].tolist())))
    begins, missing = chain(spans, dict(zip(zip(rows["start"].tolist(), rows["begin"].tolist()), rows["end"].tolist())))
    lost = {s for s, _ in missing}
    first = rows.iloc[0]
    out = [(first["path"], first["size"], s, e, begins[s], s in lost) for s, e in spans]
    return pd.DataFrame(out, columns=["path", "size", "start", "stop", "begin", "missing"])


def _read(max_header: int, max_record: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for reader in _opened(row, max_header, max_record):
                    rows, held = [], 0
                    for x in reader.salvage(row["begin"], row["stop"]):
                        rows.append(x)
                        held += len(x[4] or b"")
                        if held > 8 << 20 or len(rows) >= 2000:
                            yield _batch(row["path"], rows)
                            rows, held = [], 0
                    yield _batch(row["path"], rows)

    return run


def _batch(path: str, rows: list) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.string()]
    cols = list(zip(*rows)) or [[]] * 6
    cols[3] = [None if h is None else list(h.items()) for h in cols[3]]
    return pa.RecordBatch.from_arrays(
        [pa.array([path] * len(rows), pa.string()), *[pa.array(list(c), k) for c, k in zip(cols, kinds)]],
        names=["path", "kind", "offset", "length", "headers", "block", "reason"],
    )


def read_warc(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, max_header: int = MAX_HEADER, max_record: int = MAX_RECORD) -> DataFrame:
    """Records and gaps of the WARC files at a path or glob: (path, kind, offset, length, headers, block, reason).

    Every byte of a file is in exactly one record or gap, and these are the same however the file is split.  Header names are in lower case.
    Blocks are bytes as stored.  An empty file has no rows, a file without any valid record is one gap.  A file is gzip or plain by its bytes, whatever
    its name.  A record with headers of more than max_header bytes, or of more than max_record bytes in all, is a gap; max_record may be
    2 GB at most, for a block is one value of an Arrow column.  Files above split_bytes are read twice, the first time for the places where splits begin.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").where("length > 0")
    splits = files.select(
        F.regexp_replace("path", "^file:/+", "file:///").alias("path"), F.col("length").alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("start")
    )
    splits = splits.select("path", "size", "start", (F.col("start") + split_bytes).alias("stop"), F.lit(None).cast("long").alias("begin"), F.lit(None).cast("long").alias("end"))
    # few bytes of description each, and long tasks: spread over the cluster's cores
    spread = lambda x: x.repartition(spark.sparkContext.defaultParallelism * 4, "path", "start")
    single = splits.where("size <= stop - start").withColumn("begin", F.lit(0).cast("long"))
    several = splits.where("size > stop - start")
    if not several.isEmpty():
        known = staged(spread(several).mapInArrow(_ends(max_header, max_record), splits.schema), "warc-splits")
        while True:
            schema = "path string, size long, start long, stop long, begin long, missing boolean"
            chained = staged(known.groupBy("path").applyInPandas(_chained, schema), "warc-chain")
            again = chained.where("missing")
            if again.isEmpty():
                break
            asked = again.select("path", "size", "start", "stop", "begin", F.lit(None).cast("long").alias("end"))
            known = known.unionByName(staged(spread(asked).mapInArrow(_ends(max_header, max_record), splits.schema), "warc-splits"))
        single = single.unionByName(chained.where("begin < stop").select("path", "size", "start", "stop", "begin", F.lit(None).cast("long").alias("end")))
    return spread(single).mapInArrow(_read(max_header, max_record), SCHEMA)


def record(fields: dict[str, str], block: bytes, compress: bool = True) -> bytes:
    """One WARC record, with Content-Length and WARC-Block-Digest."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
    lines = ["WARC/1.0", *[f"{k}: {v}" for k, v in (fields | {"WARC-Block-Digest": digest, "Content-Length": str(len(block))}).items()]]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    if not compress:
        return raw
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(raw) + deflate.flush()


def write_pages(pages: DataFrame, folder: str, pages_per_file: int = 500, damage=None, compress: bool = True) -> DataFrame:
    """Writes pages(page_id, url, html) as WARC files under a folder that all executors share; (path, records) of each.

    Every partition writes files of its own, with so many pages each, in the rows' order; nothing is shuffled.  A task that runs again writes the
    same files again.  damage(page_id, record) may change a record's bytes.  A null url or html becomes empty, a null page_id is written as None;
    an empty table writes no file; a record of any length is written.
    """
    ending = ".warc.gz" if compress else ".warc"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = fs.FileSystem.from_uri(folder)
        where.create_dir(path, recursive=True)
        context, out, written, n = TaskContext.get(), None, [], 0

        def close() -> None:
            out.close()
            where.move(f"{written[-1]}.{context.taskAttemptId()}", written[-1])

        for batch in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    written.append(f"{path}/part-{context.partitionId():06d}-{len(written):06d}{ending}")
                    out, n = where.open_output_stream(f"{written[-1]}.{context.taskAttemptId()}"), 0
                fields = {"WARC-Type": "resource", "WARC-Target-URI": url or "", "WARC-Record-ID": f"<urn:page:{page_id}>", "Content-Type": "text/html"}
                raw = record(fields, (html or "").encode(), compress)
                out.write(raw if damage is None else damage(page_id, raw))
                n += 1
                if n == pages_per_file:
                    close()
                    out = None
                    yield pa.RecordBatch.from_arrays([pa.array([written[-1]]), pa.array([n])], names=["path", "records"])
        if out is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array([written[-1]]), pa.array([n])], names=["path", "records"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "path string, records long")


def wear(page_id: int | None, raw: bytes) -> bytes:
    """Damage as storage and transfers do it, fixed by page_id: flipped bytes, lost tails, foreign bytes between records."""
    lot = int.from_bytes(hashlib.md5(str(page_id).encode()).digest()[:2], "big") % 64
    middle = len(raw) // 2
    if lot == 0:
        return raw[:middle] + bytes([raw[middle] ^ 0x5A]) + raw[middle + 1 :]
    if lot == 1:
        return raw[:middle]
    if lot == 2:
        return raw + b"\x00" * 97 + MEMBER + b"junk"
    return raw
