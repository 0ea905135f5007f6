"""Token counts of documents, without encoding them.

A byte-level BPE first cuts a text into pre-tokens by a pattern and then encodes
each on its own, so a document's count is the sum over its pre-tokens of
frequency times pieces.  Pieces are counted once for every distinct pre-token of the
corpus and joined to the documents' pre-token frequencies; ids are never kept.

The HOT most frequent pre-tokens, whose number does not grow with the corpus, are
joined where the texts are read; only the other ones, which are mostly rare words, go through a shuffle.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
HOT = 300_000
#: Distinct pre-tokens a task holds before it passes them on.
HELD = 400_000
#: Texts of more characters are cut one pre-token at a time, to save memory.
LONG = 1 << 20

_encodings: dict[tuple[int, str], object] = {}


def encoding(ranks: bytes, pattern: str):
    """A tiktoken encoding without special tokens, made once per worker."""
    import tiktoken

    key = (hash(ranks), pattern)
    if key not in _encodings:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _encodings[key] = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
    return _encodings[key]


def frequencies(cut: regex.Pattern, text: str) -> Counter:
    """Pre-tokens of a text and how often they occur."""
    return Counter(m.group() for m in cut.finditer(text)) if len(text) > LONG else Counter(cut.findall(text))


def _vocabulary(pattern: str):
    def emit(count: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["pretoken", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, count = regex.compile(pattern), Counter()
        for batch in batches:
            for text in batch.column(0):
                count.update(frequencies(cut, text.as_py()))
                if len(count) > HELD:
                    yield emit(count)
                    count = Counter()
        yield emit(count)

    return run


def _pieces(ranks, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoding(ranks.value, pattern)
        for batch in batches:
            pieces = [len(bpe.encode_ordinary(w)) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pieces, pa.int64())], names=["pretoken", "n", "pieces"])

    return run


def _frequencies(hot, pattern: str):
    """Per document the sum over hot pre-tokens, and a row for every other distinct one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, known = regex.compile(pattern), hot.value
        get = known.get
        for batch in batches:
            doc, word, freq, sums = [], [], [], []
            for i, text in enumerate(batch.column(1)):
                total = 0
                for w, n in frequencies(cut, text.as_py()).items():
                    p = get(w)
                    if p is None:
                        doc.append(i)
                        word.append(w)
                        freq.append(n)
                    else:
                        total += p * n
                sums.append(total)
            n = len(sums)
            ids = pa.concat_arrays([batch.column(0), batch.column(0).take(pa.array(doc, pa.int64()))])
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([None] * n + word, pa.string()), pa.array(sums + freq, pa.int64())], names=["doc_id", "pretoken", "n"]
            )

    return run


def vocabulary(texts: DataFrame, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """(pretoken, n, pieces): every distinct pre-token of texts(text), its frequency, and its number of tokens."""
    with open(ranks, "rb") as f:
        merges = texts.sparkSession.sparkContext.broadcast(f.read())
    counted = texts.select("text").mapInArrow(_vocabulary(pattern), "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))
    return counted.mapInArrow(_pieces(merges, pattern), "pretoken string, n long, pieces long")


def frequent(words: DataFrame, most: int) -> DataFrame:
    """At most so many of words(n, ...), the most frequent ones; of words with frequencies as good as equal all or none.

    The cut is found on a histogram of the frequencies, of a few hundred rows whatever the corpus.
    """
    step = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    cut, so_far = None, 0
    for row in words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("step")).collect():
        so_far += row["words"]
        if so_far > most:
            break
        cut = row["step"]
    return words.where(F.lit(False) if cut is None else step >= cut)


def count_tokens(docs: DataFrame, ranks: str = RANKS, pattern: str = PATTERN, hot: int = HOT) -> DataFrame:
    """(doc_id, n_tokens) of every doc_id of docs; ranks is a tiktoken rank file that the driver reads.

    Null and empty texts have 0 tokens.  Rows with the same doc_id are added up, those with a null
    doc_id as well.  Strings of special tokens are ordinary text.  A text is counted whole; one of more than LONG characters is cut one pre-token at a
    time, and a pre-token of any length is encoded as one.  An empty table has no rows.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = staged(vocabulary(texts, ranks, pattern), "pretokens")
    top = frequent(words, hot).select("pretoken", "pieces").toPandas()
    known = spark.sparkContext.broadcast(dict(zip(top["pretoken"], top["pieces"].tolist())))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = texts.mapInArrow(_frequencies(known, pattern), f"doc_id {kind}, pretoken string, n long")
    # a row without pre-token is a document's finished sum
    joined = rows.join(words.select("pretoken", "pieces"), "pretoken", "left")
    return joined.groupBy("doc_id").agg(F.sum(F.col("n") * F.coalesce("pieces", F.lit(1))).alias("n_tokens"))
