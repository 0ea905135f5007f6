"""Repeated passages of at least THRESHOLD tokens, by a suffix array over tokens.

Sorting every position of a corpus is wasteful where most of it never repeats,
so positions that cannot begin a repeat are left out first, without loss:
among the SEED-grams of any THRESHOLD tokens the one of least hash is their
anchor, which depends on these tokens alone.  Two equal passages have equal
anchors, so only windows whose anchor repeats somewhere take part.

Nor do equal texts take part more than once: the least document with a text stands for it, and all the others are later copies from
end to end.

The rest is prefix doubling (see ``doubling``): ranks at START tokens, from
hashes made where the text is, then sorted pairs (rank here, rank START tokens later),
until a position is unique or the threshold is reached.  Hashes that very many positions have are found first (see kernel.often), so
that no task sorts all positions of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import dense_ids
from . import doubling, kernel
from .common import fresh, staged
from .doubling import Numbered, Placed

THRESHOLD, SEED = 50, 16
#: Bytes of anchors that are sent to every task at most; beyond, the texts that have some are joined by shuffle.
BROADCAST_BYTES = 64 << 20
#: Lists of passages are broadcast up to so many documents, and joined by shuffle beyond.
BROADCAST_DOCS = 300_000
#: Hashes of at least so many positions are hot; so many of them, the most frequent, are sent to every task at most.
HOT, MAX_HOT = 50_000, 1_000_000
#: Hashes a task counts before it passes on the frequent ones.
WINDOW = 2_000_000
#: Bits that tell most texts without anchors from those with some.
FILTER_BITS = 26


def windows(h: np.ndarray, rows: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, row, anchor, anchor's hash) of every window of `threshold` tokens within a row."""
    seed = min(SEED, threshold)
    g = kernel.grams(h, seed)
    width = threshold - seed + 1
    least, where = g, np.arange(len(g))
    done = 1
    while done < width and len(least):
        step = min(done, width - done)
        k = max(0, len(least) - step)
        right = least[step : step + k] < least[:k]
        least, where = np.where(right, least[step : step + k], least[:k]), np.where(right, where[step : step + k], where[:k])
        done += step
    start, row = kernel.gram_rows(rows, threshold, len(h))
    at = where[start] if len(start) else start
    return start, row, at, g[at] if len(start) else g[:0]


def _columns(names: list[str], *columns) -> pa.RecordBatch:
    kinds = {"pos": pa.int32(), "kind": pa.int8()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, columns)], names=names)


def _anchors(threshold: int, least: int):
    """Of every text of at least `threshold` tokens its anchors (kind 0) and its number of tokens (1, as pos); and frequent anchors (2, their count as pos).

    A text that a task has seen is passed over.
    """
    names = ["content", "pos", "hash", "kind"]

    def frequent(held: list[np.ndarray], texts: int) -> pa.RecordBatch:
        h, n = kernel.often(held, texts, least)
        return _columns(names, np.zeros(len(h), np.int64), n, h.view(np.int64), np.full(len(h), 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        held, texts = [], 0
        for batch in batches:
            contents = batch.column(0).to_numpy()
            for first, text, offsets in kernel.chunks(batch.column(1)):
                h, _, _, rows = kernel.tokens(text, offsets)
                mine, size = contents[first : first + len(offsets) - 1], np.diff(rows)
                new = np.zeros(len(mine), bool)
                for i, c in enumerate(mine.tolist()):
                    if size[i] >= threshold and c not in seen:
                        seen.add(c)
                        new[i] = True
                if len(seen) > 1_000_000:
                    seen.clear()
                _, row, at, g = windows(h, rows, threshold)
                change = np.ones(len(at), bool)
                change[1:] = at[1:] != at[:-1]
                change &= new[row]
                at, g, row = at[change], g[change], row[change]
                yield _columns(names, mine[row], at - rows[row], g.view(np.int64), np.zeros(len(at)))
                yield _columns(names, mine[new], size[new], np.zeros(new.sum(), np.int64), np.ones(new.sum()))
                held.append(g)
                texts += int(new.sum())
                if sum(map(len, held)) > WINDOW:
                    yield frequent(held, texts)
                    held, texts = [], 0
        yield frequent(held, texts)

    return run, "content long, pos int, hash long, kind byte"


def _ranks(threshold: int, start: int, least: int):
    """Positions whose window's anchor repeats, and those a second half can begin at, with the hash of `start` tokens; and frequent hashes with `at` as count."""
    names = ["at", "hash", "kind"]

    def frequent(held: list[np.ndarray], texts: int) -> pa.RecordBatch:
        h, n = kernel.often(held, texts, least)
        return _columns(names, n, h.view(np.int64), np.full(len(h), 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts = [], 0
        for batch in batches:
            numbers, anchors = batch.column(0).to_numpy(), batch.column(1)
            for first, text, offsets in kernel.chunks(batch.column(2)):
                h, _, _, rows = kernel.tokens(text, offsets)
                if np.diff(rows).max(initial=0) >= Numbered.SPAN:
                    raise ValueError(f"a text has {Numbered.SPAN} tokens or more")
                at, row, anchor, _ = windows(h, rows, threshold)
                known = np.zeros(len(h) + 1, bool)
                part = anchors.slice(first, len(offsets) - 1)
                known[part.flatten().to_numpy() + np.repeat(rows[:-1], np.diff(part.offsets.to_numpy()))] = True
                active = np.zeros(len(h) + 1, bool)
                mine = known[anchor]
                active[at[mine]] = True
                active[at[mine] + (threshold - start)] = True
                pos, row = kernel.gram_rows(rows, start, len(h))
                keep = active[pos]
                pos, row = pos[keep], row[keep]
                g = kernel.grams(h, start)[pos]
                yield _columns(names, numbers[row + first] * Numbered.SPAN + pos - rows[row], g.view(np.int64), np.zeros(len(g)))
                held.append(g)
                texts += len(offsets) - 1
                if sum(map(len, held)) > WINDOW:
                    yield frequent(held, texts)
                    held, texts = [], 0
        yield frequent(held, texts)

    return run, "at long, hash long, kind byte"


def _among(texts: DataFrame, contents: DataFrame) -> DataFrame:
    """texts(doc_id, content, text) of which the content may be among the given ones; none that is goes."""
    bit = F.col("content").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = contents.groupBy(F.shiftright(bit, 5).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(31)).cast("int"))).alias("bits"))
    rows = words.toPandas()  # 2^21 at most
    table = np.zeros(1 << (FILTER_BITS - 5), np.int64)
    table[rows["word"]] = rows["bits"]
    sent = texts.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = batch.column(1).to_numpy() & ((1 << FILTER_BITS) - 1)
            yield batch.filter(pa.array((sent.value[b >> 5] >> (b & 31)) & 1 == 1))

    return texts.mapInArrow(run, texts.schema)


def repeated_passages(
    docs: DataFrame, threshold: int = THRESHOLD, hot: int = HOT, max_hot: int = MAX_HOT, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """(doc_id, seq, start_token, end_token, n_tokens, source_doc_id, source_token) of every later copy.

    Tokens are numbered from 0 and end_token is included.  A row is a maximal stretch
    of tokens that lie in windows of `threshold` tokens, at least 2, which also begin at
    an earlier position, by doc_id and then token; the source is the earliest copy of the stretch's first window.

    Null texts and texts of fewer than `threshold` tokens have no rows; 2^28 tokens in one text, or 2^35 texts with repeats, are an error.  Repeated rows of one document count
    once; rows with one doc_id and different texts are different documents, told apart by seq, a hash of the text.  Null doc_ids come first.
    doc_id may be of any type with an order.
    """
    if threshold < 2:
        raise ValueError("threshold must be at least 2")
    start, least = (threshold + 1) // 2, max(2, min(16, hot))
    texts = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("content"), "text")
    run, schema = _anchors(threshold, least)
    found = staged(texts.select("content", "text").mapInArrow(run, schema), "anchors")
    counted = lambda x, n: x.where("kind = 2").select("hash", F.col(n).cast("long").alias("n"))
    hot_anchors = staged(doubling.hot_keys(counted(found, "pos"), hot, max_hot), "hot")
    rows, is_hot = doubling.marked(found.where("kind = 0"), "hash", hot_anchors)
    repeated = doubling.rerank(rows, ["hash"], Placed, is_hot)

    # the least document of each text, nulls first, and how many others there are
    names = texts.select("doc_id", "content").distinct()
    tokens = found.where("kind = 1").select("content", F.col("pos").alias("tokens")).distinct()
    least_doc = names.groupBy("content").agg(F.min(F.struct("doc_id")).alias("least"), F.count(F.lit(1)).alias("docs"))
    contents = staged(least_doc.join(tokens, "content").select("content", "least.doc_id", "docs", "tokens"), "texts")
    per_text = repeated.groupBy("content").agg(F.collect_set("pos").alias("anchors")).join(contents.select("content", "doc_id"), "content")
    numbered = staged(dense_ids(per_text, ["doc_id", "content"], "number"), "numbers")
    n, n_anchors = numbered.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("anchors")), F.lit(0))).first()
    if n >= 1 << 35:
        raise ValueError("2^35 texts or more have repeats")

    side = numbered.select("number", F.col("content").alias("c"), F.col("doc_id").alias("d"), "anchors")
    if 4 * n_anchors + 48 * n <= broadcast_bytes:
        side = F.broadcast(side)
    else:
        texts = _among(texts, numbered.select("content"))
    chosen = texts.join(side, (F.col("content") == F.col("c")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("number", "anchors", "text")
    run, schema = _ranks(threshold, start, least)
    hashed = staged(chosen.mapInArrow(run, schema), "ranks")
    hot_hashes = staged(doubling.hot_keys(counted(hashed, "at"), hot, max_hot), "hot")
    rows, is_hot = doubling.marked(hashed.where("kind = 0"), "hash", hot_hashes)
    hot_firsts = staged(rows.where(is_hot).groupBy("hash").agg(F.min("at").alias("hot")).select("hot"), "hot")
    ranks = doubling.rerank(rows, ["hash"], Numbered, is_hot)
    runs = staged(doubling.later_runs(doubling.double(ranks, start, threshold, Numbered, hot_firsts), threshold, Numbered), "runs")

    by_number = numbered.select("number", "doc_id", "content")
    pos = lambda c: F.col(c).bitwiseAND(F.lit(Numbered.SPAN - 1)).cast("int")
    rows = (
        runs.join(by_number.withColumnRenamed("number", "sequence"), "sequence")
        .withColumn("number", F.shiftright("first", 28))
        .join(by_number.select("number", F.col("doc_id").alias("source_doc_id")), "number")
        .select(
            "doc_id", F.col("content").alias("seq"), pos("start").alias("start_token"), pos("end").alias("end_token"),
            (F.col("end") - F.col("start") + 1).cast("int").alias("n_tokens"), "source_doc_id", pos("first").alias("source_token"),
        )
    )
    # where the least document's first window is a copy, so are the first ones of all documents with this text
    rows = staged(rows, "rows")
    begun = rows.where("start_token = 0").select("seq", F.col("source_doc_id").alias("from_doc"), F.col("source_token").alias("from_token"))
    copied = contents.where("docs > 1").select("content", F.col("doc_id").alias("least"), "tokens").join(begun, F.col("content") == F.col("seq"), "left").drop("seq")
    copies = names.join(copied, "content").where(~F.col("doc_id").eqNullSafe(F.col("least"))).select(
        "doc_id", F.col("content").alias("seq"), F.lit(0).alias("start_token"), (F.col("tokens") - 1).alias("end_token"), F.col("tokens").alias("n_tokens"),
        F.when(F.col("from_token").isNull(), F.col("least")).otherwise(F.col("from_doc")).alias("source_doc_id"), F.coalesce("from_token", F.lit(0)).alias("source_token"),
    )
    return rows.unionByName(copies)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for first, text, offsets in kernel.chunks(batch.column(0)):
            _, a, b, rows = kernel.tokens(text, offsets)
            for i in range(len(offsets) - 1):
                spans = batch.column(1)[first + i].as_py() or []
                raw, at, kept = text[offsets[i] : offsets[i + 1]].tobytes(), 0, []
                for s in sorted(spans, key=lambda s: s["start_token"]):
                    kept.append(raw[at : a[rows[i] + s["start_token"]] - offsets[i]])
                    at = b[rows[i] + s["end_token"]] - offsets[i]
                kept.append(raw[at:])
                out.append(b"".join(kept).decode())
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), batch.column(2)], names=["text", "row"])


def remove_passages(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """docs with the later copies cut out of text, from first to last token; other columns and rows, those with null texts among them, are unchanged."""
    gone, key, of, row = (fresh(docs, c) for c in ("gone", "seq", "of", "row"))
    per_doc = staged(repeated_passages(docs, threshold).groupBy(F.col("doc_id").alias(of), F.col("seq").alias(key)).agg(F.collect_list(F.struct("start_token", "end_token")).alias(gone)), "passages")
    if per_doc.count() <= BROADCAST_DOCS:
        per_doc = F.broadcast(per_doc)
    joined = docs.join(per_doc, (F.xxhash64("text") == F.col(key)) & docs["doc_id"].eqNullSafe(F.col(of)), "left")
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias(row)
    rest = joined.where(F.col(gone).isNull()).select(*[docs[f"`{c}`"] for c in docs.columns])
    wide = joined.where(F.col(gone).isNotNull()).select("text", gone, whole)
    kind = wide.schema[row].dataType.simpleString()
    cut = wide.mapInArrow(_cut, f"text string, row {kind}")
    return rest.unionByName(cut.select(*[(F.col("text") if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]))
