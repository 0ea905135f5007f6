"""N-gram Jaccard self-join.

Documents become sets of hashed word n-grams.  Documents with equal sets are one *content*, and only contents are
compared.  No pair at or above the threshold is lost:

1. Grams that one content alone has are in no overlap.  They are told from the others by sorting all grams in
   parts, and dropped.  A content of n grams needs an overlap of at least threshold * n with whatever it is similar
   to, so a content with fewer shared grams than that is dropped as well; most are.
2. Of the shared grams, rarest first, all but threshold * n - 1 are a content's *prefix*.  Similar contents have a gram
   of their prefixes in common.  Every gram's label is the least content with it in the prefix; contents meet in a
   *tile* if they have a label in common, and are compared in the tile of their least one.
   So a group of copies, which share hundreds of grams, meets once or twice.
3. In a tile, contents are in order of size, and each meets the band of sizes that the threshold allows.  Hashed
   bitmap signatures are compared first: if S_a and S_b are hit by r_a and r_b shared grams, the overlap is at most
   (r_a + r_b - popcount(S_a xor S_b)) / 2.  Pairs below the needed overlap go.
4. The other pairs are settled exactly by intersecting their sorted arrays, a whole band at a time.  A tile of more than BLOCK contents is
   compared in pairs of blocks.  What leaves a tile is one row for each content: its links, and its component.

Grams that very many contents have are known before (see hot_grams) and kept out of the parts, so that no part depends on how
often a gram occurs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import fresh, staged

N, THRESHOLD = 3, 0.5
#: Grams that a part holds on average; what a task needs of memory follows from it.
PART_GRAMS = 1_000_000
#: Grams in at least so many contents are hot; so many of them, the most frequent, are sent to every task at most.
HOT, MAX_HOT = 50_000, 1_000_000
#: Grams gathered before a task passes them on.
GATHERED = 1_000_000
#: Contents in a block of comparisons.
BLOCK = 1024
#: Edges of the graph of similar contents that the driver takes at most.
DRIVER_EDGES = 1_000_000
#: Ids are broadcast up to so many, and joined by shuffle beyond.
BROADCAST_IDS = 4_000_000
_U = np.uint64
_LOW = _U((1 << 48) - 1)


def gram_sets(column, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct hashes, row offsets).  Texts of fewer than n tokens count as one gram; without tokens, none."""
    for first, text, offsets in kernel.chunks(column):
        h, _, _, rows = kernel.tokens(text, offsets)
        pos, row = kernel.gram_rows(rows, n, len(h))
        g = kernel.grams(h, n)[pos]
        counts = np.diff(rows)
        short = np.flatnonzero((counts > 0) & (counts < n))
        if len(short):
            whole = np.array([np.bitwise_xor.reduce(kernel.mix(h[rows[r] : rows[r + 1]] + np.arange(1, counts[r] + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))) for r in short], _U)
            row, g = np.concatenate([row, short]), np.concatenate([g, whole])
        hashes, at = kernel.distinct(row, g, len(offsets) - 1)
        yield first, hashes, at


def bitmaps(code: np.ndarray, starts: np.ndarray, bits: int) -> np.ndarray:
    """A row of bits / 64 words for each set; set i has the codes from starts[i] to starts[i + 1]."""
    out = np.zeros((len(starts) - 1, bits), bool)
    out[np.repeat(np.arange(len(starts) - 1), np.diff(starts)), (code & _U(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, axis=1).view(_U)


def overlap_needed(a, b, threshold: float):
    """Least overlap of sets of sizes a and b that reaches the threshold."""
    return np.ceil(threshold / (1 + threshold) * (a + b) - 1e-9)


def content_ids(h: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64 bits that stand for each set: equal sets have equal ones."""
    sums = [np.add.reduceat(kernel.mix(x), starts) for x in (h + _U(1), h ^ _U(0x5851F42D4C957F2D))]
    return kernel.mix(sums[0] ^ kernel.mix(sums[1] + size.astype(_U))).view(np.int64)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... so many as sizes says, for every i."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - starts, sizes)


def _unseen(ids: np.ndarray, seen: set) -> np.ndarray:
    """Positions of the ids that are not in seen, which then has them; it is emptied before it grows too large."""
    if len(seen) > 1_000_000:
        seen.clear()
    new = []
    for i, x in enumerate(ids.tolist()):
        if x not in seen:
            seen.add(x)
            new.append(i)
    return np.array(new, np.int64)


def _contents(n: int, least: int):
    """A row for each document with its content; rows without document give grams that many contents of a window have."""

    def frequent(grams: list[np.ndarray], contents: int) -> pa.RecordBatch:
        g, count = kernel.often(grams, contents, least)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(g), -1)), pa.array(g.view(np.int64)), pa.array(count.astype(np.int32))], names=["row", "content", "size"])

    @kernel.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        held, grams, contents = 0, [], 0
        for batch in batches:
            ids = batch.column(0)
            for first, h, at in gram_sets(batch.column(1), n):
                size = np.diff(at)
                some = np.flatnonzero(size)
                if not len(some):
                    continue
                content = content_ids(h, at[some], size[some])
                yield _named(ids.take(pa.array(some + first)), pa.RecordBatch.from_arrays([pa.array(some), pa.array(content), pa.array(size[some].astype(np.int32))], names=["row", "content", "size"]))
                new = some[_unseen(content, seen)]
                grams.append(h[ranges(at[new], size[new])])
                contents += len(new)
                held += len(grams[-1])
                if held > 2 * GATHERED:
                    found = frequent(grams, contents)
                    yield _named(pa.nulls(len(found), ids.type), found)
                    held, grams, contents = 0, [], 0
            last = ids.type
        if grams:
            found = frequent(grams, contents)
            yield _named(pa.nulls(len(found), last), found)

    return run


def _named(ids: pa.Array, rest: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, rest.column(1), rest.column(2), pa.array(rest.column(0).to_numpy() < 0)], names=["doc", "content", "size", "gram"])


_PARTS = "part int, kind int, contents binary, counts binary, sizes binary, low binary, extra binary"


def _six(g: np.ndarray) -> bytes:
    return np.ascontiguousarray(g.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _eight(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = raw.reshape(-1, 6)
    return out.view(_U).ravel()


def _flat(column, kind) -> np.ndarray:
    """All bytes of a binary column, one value after another, as numbers."""
    parts = [np.frombuffer(x, kind) for x in column.to_pylist() if x]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _spread(hashes: np.ndarray, n: int) -> np.ndarray:
    """A number from 0 to n - 1 by the upper half of 64 bits."""
    return ((hashes.view(_U) >> _U(32)) * _U(n) >> _U(32)).astype(np.int64)


def _packed(part: np.ndarray, kind: int, content: np.ndarray, low: np.ndarray, extra: np.ndarray | None) -> Iterator[dict]:
    """Rows of (content, gram) by part, a content's grams in a run of their own; the order within a part stays."""
    order = np.argsort(part, kind="stable")
    part, content, low = part[order], content[order], low[order]
    extra = None if extra is None else extra[order]
    bounds = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(bounds, [*bounds[1:], len(part)]):
        c = content[a:b]
        runs = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        yield {
            "part": int(part[a]), "kind": kind, "contents": c[runs].tobytes(), "counts": np.diff(runs, append=len(c)).astype(np.int32).tobytes(), "sizes": b"",
            "low": _six(low[a:b]), "extra": b"" if extra is None else extra[a:b].tobytes(),
        }


def _table(rows: list[dict]) -> pa.Table:
    kinds = {"part": pa.int32(), "kind": pa.int32()}
    names = [x.split()[0] for x in _PARTS.split(", ")]
    return pa.table({c: pa.array([r[c] for r in rows], kinds.get(c, pa.binary())) for c in names})


def _by_gram(n: int, parts: int, hot):
    """Rows of kind 0 with the grams that are not hot, by part; rows of kind 1 with sizes and hot grams of the contents."""

    def rows(content, size, n_hot, hot_grams, owner, grams) -> Iterator[pa.RecordBatch]:
        content, size, n_hot = map(np.concatenate, (content, size, n_hot))
        hot_grams, owner, grams = map(np.concatenate, (hot_grams, owner, grams))
        out = list(_packed(_spread(grams, parts), 0, owner, grams & _LOW, None))
        where, begins = _spread(content, parts), np.cumsum(n_hot) - n_hot
        for p in np.unique(where):
            mine = np.flatnonzero(where == p)
            out.append({"part": int(p), "kind": 1, "contents": content[mine].tobytes(), "counts": n_hot[mine].astype(np.int32).tobytes(), "sizes": size[mine].astype(np.int32).tobytes(),
                        "low": b"", "extra": hot_grams[ranges(begins[mine], n_hot[mine])].tobytes()})
        yield from _table(out).to_batches()

    @kernel.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, gathered = set(), 0, []
        known = hot.value[0]
        for batch in batches:
            for _, h, at in gram_sets(batch.column(0), n):
                size = np.diff(at)
                some = np.flatnonzero(size)
                if not len(some):
                    continue
                content = content_ids(h, at[some], size[some])
                new = _unseen(content, seen)
                if not len(new):
                    continue
                content, size, some = content[new], size[some[new]], some[new]
                g, owner = h[ranges(at[some], size)], np.repeat(np.arange(len(some)), size)
                is_hot = np.isin(g, known) if len(known) else np.zeros(len(g), bool)
                gathered.append((content, size, np.bincount(owner[is_hot], minlength=len(some)), g[is_hot], content[owner[~is_hot]], g[~is_hot]))
                held += len(g)
                if held > GATHERED:
                    yield from rows(*zip(*gathered))
                    held, gathered = 0, []
        if gathered:
            yield from rows(*zip(*gathered))

    return run


def _shared(buckets: int):
    """One part's grams of at least two contents, by the contents' buckets; rows of kind 1 go on as they are."""

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        out = []
        mine = table.filter(pa.array(kind == 0))
        if len(mine):
            part = mine.column("part")[0].as_py()
            low = _eight(_flat(mine.column("low"), np.uint8))
            content = np.repeat(_flat(mine.column("contents"), np.int64), _flat(mine.column("counts"), np.int32))
            order = np.argsort(low)
            low = low[order]
            again = np.zeros(len(low), bool)
            again[1:] = low[1:] == low[:-1]
            again[:-1] |= again[1:]
            low, content = low[again], content[order[again]]
            order = np.lexsort((content, low))
            low, content = low[order], content[order]
            new = np.ones(len(low), bool)
            new[1:] = (low[1:] != low[:-1]) | (content[1:] != content[:-1])
            low, content = low[new], content[new]
            _, at, count = np.unique(low, return_inverse=True, return_counts=True)
            count = count[at] if len(at) else count
            keep = np.flatnonzero(count > 1)
            keep = keep[np.argsort(content[keep], kind="stable")]
            for r in _packed(_spread(content[keep], buckets), 0, content[keep], low[keep], np.minimum(count[keep], 65535).astype(np.uint16)):
                out.append(r | {"sizes": np.array([part], np.int64).tobytes()})
        heads = table.filter(pa.array(kind == 1))
        if len(heads):
            content, n_hot = _flat(heads.column("contents"), np.int64), _flat(heads.column("counts"), np.int32)
            size, grams = _flat(heads.column("sizes"), np.int32), _flat(heads.column("extra"), _U)
            where, begins = _spread(content, buckets), np.cumsum(n_hot) - n_hot
            for p in np.unique(where):
                m = np.flatnonzero(where == p)
                out.append({"part": int(p), "kind": 1, "contents": content[m].tobytes(), "counts": n_hot[m].tobytes(), "sizes": size[m].tobytes(), "low": b"", "extra": grams[ranges(begins[m], n_hot[m])].tobytes()})
        return _table(out)

    return run


def _prefixes(threshold: float, hot):
    """(content, size, prefix, grams) of one bucket's contents that have enough shared grams."""

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        heads = table.filter(pa.array(kind == 1))
        content, n_hot = _flat(heads.column("contents"), np.int64), _flat(heads.column("counts"), np.int32)
        size, hot_grams = _flat(heads.column("sizes"), np.int32), _flat(heads.column("extra"), _U)
        begins = np.cumsum(n_hot) - n_hot
        content, at = np.unique(content, return_index=True)
        size, n_hot, begins = size[at], n_hot[at], begins[at]
        known, often = hot.value
        hot_grams = hot_grams[ranges(begins, n_hot)]
        mine = table.filter(pa.array(kind == 0))
        owner = np.repeat(_flat(mine.column("contents"), np.int64), _flat(mine.column("counts"), np.int32))
        of = np.array([len(x) // 6 for x in mine.column("low").to_pylist()], np.int64)
        # a gram is its part and 48 bits; hot ones have none
        gram = _eight(_flat(mine.column("low"), np.uint8)) ^ np.repeat(kernel.mix(_flat(mine.column("sizes"), np.int64).view(_U)), of)
        count = np.minimum(np.concatenate([_flat(mine.column("extra"), np.uint16), often[np.searchsorted(known, hot_grams)]]), 65535)
        gram = np.concatenate([gram, hot_grams])
        row = np.concatenate([np.searchsorted(content, owner), np.repeat(np.arange(len(content)), n_hot)])
        shared = np.bincount(row, minlength=len(content))
        needed = np.ceil(threshold * size - 1e-9).astype(np.int64)
        alive = shared >= needed
        keep = alive[row]
        row, gram, count = row[keep], gram[keep], count[keep]
        order = np.lexsort((gram, count, row))
        starts = np.searchsorted(row[order], np.arange(len(content) + 1))
        within = np.arange(len(order)) - starts[row[order]]
        first = order[within < (shared - needed + 1)[row[order]]]
        alive = np.flatnonzero(alive)
        sizes = np.diff(starts)[alive]
        lists = lambda values, n: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(values.view(np.int64)))
        by_gram = np.lexsort((gram, row))
        prefix = np.bincount(row[first], minlength=len(content))[alive]
        return pa.table({"content": pa.array(content[alive]), "size": pa.array(size[alive]), "prefix": lists(gram[first], prefix), "grams": lists(gram[by_gram], sizes)})

    return run, "content long, size int, prefix array<long>, grams array<long>"


def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n nodes and edges (a, b), the least node of each one's component."""
    root = np.arange(n)
    while True:
        before = root.copy()
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        root = root[root]
        if (root == before).all():
            return root


def _compare(threshold: float):
    """(content, links, root) of the contents with links that meet in one or more tiles or pairs of blocks."""

    def tile(label: int, across: bool, content, size, docs, block, code, starts, labels) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(content)
        shared = np.diff(starts)
        maps = bitmaps(code, starts, 1 << min(16, max(6, math.ceil(math.log2(2 * shared.max())))))
        values, code = np.unique(code, return_inverse=True)
        # labels before this one: two contents that share one of them are compared there
        earlier, early = np.unique(np.concatenate([np.zeros(0, np.int64), *[x[x < label] for x in labels]]), return_inverse=True)
        n_early = np.array([(x < label).sum() for x in labels])
        early_at = np.concatenate([[0], np.cumsum(n_early)])
        mark, known = np.zeros(len(values), np.int32), np.zeros(len(earlier), np.int32)
        high = np.searchsorted(size, size / threshold + 1e-6, "right")
        left, right = [], []
        for i in range(n - 1):
            j = np.arange(i + 1, high[i])
            if across:
                j = j[block[j] != block[i]]
            if not len(j):
                continue
            needed = overlap_needed(size[i], size[j], threshold)
            bound = (shared[i] + shared[j] - np.bitwise_count(maps[i] ^ maps[j]).sum(axis=1, dtype=np.int64)) // 2
            j = j[bound >= needed]
            if n_early[i] and len(j):
                mine = early[early_at[i] : early_at[i + 1]]
                known[mine] = 1
                met = np.concatenate([[0], np.cumsum(known[early[ranges(early_at[j], n_early[j])]])])
                known[mine] = 0
                ends = np.cumsum(n_early[j])
                j = j[met[ends] == met[ends - n_early[j]]]
            if not len(j):
                continue
            mine = code[starts[i] : starts[i + 1]]
            mark[mine] = 1
            met = np.concatenate([[0], np.cumsum(mark[code[ranges(starts[j], shared[j])]])])
            mark[mine] = 0
            ends = np.cumsum(shared[j])
            overlap = met[ends] - met[ends - shared[j]]
            j = j[overlap >= overlap_needed(size[i], size[j], threshold)]
            left.append(np.full(len(j), i))
            right.append(j)
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (left, right))
        links = np.bincount(a, docs[b], minlength=n) + np.bincount(b, docs[a], minlength=n)
        some = np.flatnonzero(links)
        return content[some], links[some].astype(np.int64), content[_components(n, a, b)[some]]

    def run(table: pa.Table) -> pa.Table:
        label, a, b = (table.column(c).to_numpy() for c in ("label", "a", "b"))
        content, size, docs, block = (table.column(c).to_numpy() for c in ("content", "size", "docs", "block"))
        order = np.lexsort((content, size, b, a, label))
        grams, labels = (table.column(c).combine_chunks() for c in ("grams", "labels"))
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(label[order]) != 0) | (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)]))
        out = []
        for x, y in zip(cut, [*cut[1:], len(order)]):
            rows = order[x:y]
            if len(rows) > 1:
                mine = grams.take(pa.array(rows))
                starts = np.concatenate([[0], np.cumsum(np.diff(mine.offsets.to_numpy()))])
                seen = [v.values.to_numpy() for v in labels.take(pa.array(rows))]
                out.append(tile(label[rows[0]], a[rows[0]] != b[rows[0]], content[rows], size[rows].astype(np.int64), docs[rows], block[rows], mine.flatten().to_numpy().view(_U), starts, seen))
        cols = [np.concatenate(c) for c in zip(*out)] or [np.zeros(0, np.int64)] * 3
        return pa.table({c: pa.array(v) for c, v in zip(("content", "links", "root"), cols)})

    return run, "content long, links long, root long"


def hot_grams(counted: DataFrame, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams of at least `least` contents, in order, and in how many they are; of more than `most` such grams the most frequent ones.

    counted(gram, n) has the counts of windows of about a thousand contents and more, where a gram in fewer than one in a thousand is left
    out.  So every gram with a larger share of the corpus is there; a gram that is not found to be hot is sorted like all others.
    """
    total = counted.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    top = total.orderBy(F.desc("n"), "gram").limit(most).toPandas()
    gram = top["gram"].to_numpy(np.int64).view(_U)
    order = np.argsort(gram)
    return gram[order], top["n"].to_numpy(np.int64)[order]


def similar_documents(
    docs: DataFrame, n: int = N, threshold: float = THRESHOLD, part_grams: int = PART_GRAMS, hot: int = HOT, max_hot: int = MAX_HOT, block: int = BLOCK
) -> DataFrame:
    """(doc_id, class_id, n_links) of every document that is similar to another: the Jaccard similarity of their n-gram sets is at least the threshold.

    A class is a connected group of similar documents, named by its least doc_id.  n_links counts the other documents similar
    to this one, copies with an equal set among them.  Documents without links have no row.  The sets are compared by 64-bit hashes of their grams,
    and the method loses no pair.

    Rows with null doc_id, and texts that are null or without tokens, have no row; texts of fewer
    than n tokens are compared as one gram.  Rows with the same doc_id and equal sets are one document.  Where a doc_id's texts differ, its row
    adds up the links of each, one between two of its own texts included, and joins their classes.  doc_id may be of any type with an order.
    """
    spark = docs.sparkSession
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").alias("doc"), "text")
    kind = texts.schema["doc"].dataType.simpleString()
    signed = staged(texts.mapInArrow(_contents(n, max(2, min(16, hot))), f"doc {kind}, content long, size int, gram boolean"), "contents")
    known = hot_grams(signed.where("gram").select(F.col("content").alias("gram"), F.col("size").alias("n")), hot, max_hot)
    sent = spark.sparkContext.broadcast(known)
    members = signed.where("NOT gram").select("doc", "content", "size").distinct()
    contents = staged(members.groupBy("content").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("docs")), "sizes")
    total = contents.agg(F.sum("size")).first()[0] or 0
    parts = total // part_grams + 1
    buckets = parts // 2 + 1

    by_gram = texts.select("text").mapInArrow(_by_gram(n, parts, sent), _PARTS)
    by_content = by_gram.groupBy("part").applyInArrow(_shared(buckets), _PARTS)
    run, schema = _prefixes(threshold, sent)
    alive = staged(by_content.groupBy("part").applyInArrow(run, schema), "shared-grams")

    keys = alive.select("content", F.explode("prefix").alias("gram"))
    least = keys.groupBy("gram").agg(F.min("content").alias("label"), F.count(F.lit(1)).alias("n")).where("n > 1")
    tiles = staged(keys.join(least, "gram").select("label", "content").distinct(), "tiles")
    sizes = tiles.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    labels = tiles.groupBy("content").agg(F.collect_set("label").alias("labels"))
    placed = tiles.join(sizes, "label").withColumn("block", F.pmod(F.hash("content"), "blocks"))
    # every pair of blocks, an own block with itself; small tiles go many to a task
    tasks = tiles.count() // 4096 + 1
    at = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least("block", x).alias("a"), F.greatest("block", x).alias("b"))))
    met = placed.select("label", "content", "block", "blocks", at.alias("at")).select(
        "label", "content", "block", "at.a", "at.b", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("label"), F.lit(tasks))).otherwise(F.xxhash64("label", "at.a", "at.b")).alias("task")
    )
    sets = alive.select("content", "size", "grams").join(labels, "content").join(contents.select("content", "docs"), "content")
    run, schema = _compare(threshold)
    compared = staged(met.join(sets, "content").groupBy("task").applyInArrow(run, schema), "compared")

    # texts of one doc_id are one class as well
    several = members.groupBy("doc").agg(F.min("content").alias("root"), F.max("content").alias("last")).where("root <> last")
    within = members.join(several, "doc").select("content", "root")
    edges = compared.select("content", "root").union(within).where("content <> root").distinct()
    linked = groups(edges.select(F.col("content").alias("doc_a"), F.col("root").alias("doc_b"))).select(F.col("doc").alias("content"), F.col("least").alias("root"))
    links = compared.groupBy("content").agg(F.sum("links").alias("links"))
    marked = contents.select("content", "docs").join(links, "content", "left").join(linked, "content", "left")
    marked = marked.where("docs > 1 OR links IS NOT NULL OR root IS NOT NULL").select(
        "content", (F.col("docs") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("root", "content").alias("root")
    )
    rows = staged(members.join(marked, "content").select("doc", "root", "links"), "links")
    names = rows.groupBy("root").agg(F.min("doc").alias("class_id"))
    return rows.join(names, "root").groupBy(F.col("doc").alias("doc_id")).agg(F.min("class_id").alias("class_id"), F.sum("links").alias("n_links")).where("n_links > 0")


def groups(pairs: DataFrame, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """(doc, least): every document of the pairs but the least of its connected group, with that one.

    Up to driver_edges different pairs are connected by the driver, which saves dozens of small jobs.  More of them are connected where they are:

    this alternates large-star and small-star steps (Kiveris et al. 2014) until nothing
    changes, each a groupBy; the rounds grow with the logarithm of the longest chain.
    """
    edges = staged(pairs.select(F.greatest("doc_a", "doc_b").alias("u"), F.least("doc_a", "doc_b").alias("v")).where("u <> v").distinct(), "edges")
    if edges.count() <= driver_edges:
        table = edges.toArrow()
        u, v = (table.column(c).combine_chunks() for c in ("u", "v"))
        nodes = pa.concat_arrays([u, v]).unique()
        nodes = nodes.take(pa.compute.sort_indices(nodes))
        a, b = (pa.compute.index_in(x, nodes).to_numpy().astype(np.int64) for x in (u, v))
        root = _components(len(nodes), a, b)
        other = np.flatnonzero(root != np.arange(len(nodes)))
        found = pa.table({"doc": nodes.take(pa.array(other)), "least": nodes.take(pa.array(root[other]))})
        return edges.sparkSession.createDataFrame(found, f"doc {edges.dtypes[0][1]}, least {edges.dtypes[0][1]}")
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = staged(small, "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("doc"), F.col("v").alias("least"))


def keep_one(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the documents that are not the least doc_id of their group of similar documents; columns unchanged.

    Rows with null doc_id, and texts that are null or without tokens, stay; repeated rows of a document that stays all do.
    """
    name = fresh(docs, "gone")
    gone = staged(similar_documents(docs, n, threshold).where("doc_id <> class_id").select(F.col("doc_id").alias(name)), "near-copies")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"] == F.col(name), "left_anti")
