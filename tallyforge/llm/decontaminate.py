"""Operator 2: benchmark decontamination by winnowing.

Words are runs of letters, digits and non-ASCII characters, lower-cased.  A window is ``window``
consecutive words of a benchmark item; an item with fewer words, but not none, is one window of its
own length.  A document word is hit when an occurrence of a window covers it.

Winnowing keeps, of each run of ``window - k + 1`` successive k-grams, the one with the smallest hash
(the rightmost on ties).  The choice depends on the run's words alone, so every span of ``window`` words
that a document shares with an item has a kept k-gram in both: no long shared span is missed.  Kept
k-grams of documents join those of items, and each hit is extended word by word, on the words
themselves, to the left and right as far as a window can reach; runs that reach the window's length
mark their words.  Items with fewer words than a window are fingerprinted as a whole, and documents
at that length at every position.

Documents are read once.  A bitmap of fixed size (2^22 bytes) of the items' fingerprints drops most
document fingerprints before they leave the task; it only saves work, the join decides.  The join is
Spark's, so a large benchmark is shuffled, and a small one broadcast, by its measured size.

Defined results: null or wordless texts and items have no words and no hits; an empty benchmark
leaves every document clean; each input row gives one output row and is answered by its own text (rows are
numbered), so neither a doc_id that repeats with another text nor a null doc_id mixes with others; an item_id
that repeats counts once in ``n_items``; an item without an id has windows that hit words, but cannot be named in
``n_items`` and its digest; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as tx
from ._spark import durable, merged, packed

BITMAP_BYTES = 1 << 22
FINGERPRINT = "array<struct<print:long,long:boolean,at:int,lead:int,words:string>>"
#: Sets the fingerprints of whole short items apart from k-grams.
SHORT = np.uint64(0xA24BAED4963EE407)


def winnow(grams: np.ndarray, at: np.ndarray, docs: np.ndarray, span: int) -> np.ndarray:
    """Indexes of the kept k-grams: the rightmost smallest of each run of ``span`` in one document."""
    m = len(grams) - span + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    best, where = grams[:m].copy(), np.arange(m)
    for j in range(1, span):
        lower = grams[j : j + m] <= best
        best[lower] = grams[j : j + m][lower]
        where[lower] = np.flatnonzero(lower) + j
    inside = docs[:m] == docs[span - 1 :]
    return np.unique(where[inside])


def _prints(column: pa.Array, k: int, window: int, lengths: list[int], items: bool, bitmap: np.ndarray | None) -> Iterator[tuple[tx.Piece, list]]:
    """For each piece, (document, fingerprint, is it a k-gram, first word, words before it, words around) of what is kept.

    Of items, only those with a full window give k-grams, and shorter ones just one fingerprint of all
    their words; documents give the runs of each of ``lengths`` at every position.
    """
    mask = np.uint64(BITMAP_BYTES * 8 - 1)

    def wanted(g: np.ndarray) -> np.ndarray:
        if bitmap is None:
            return np.ones(len(g), bool)
        b = (g & mask).astype(np.int64)
        return (bitmap[b >> 3] >> (b & 7).astype(np.uint8) & 1).astype(bool)

    for piece in tx.pieces(column, tx.NON_ALNUM):
        hashes, doc, o = piece.hashes(), piece.doc_of_word(), piece.word_offsets
        grams, at = tx.ngrams(hashes, o, k)
        kept = winnow(grams, at, doc[at], window - k + 1)
        kept = kept[wanted(grams[kept])]
        rows = []
        for gram, first in zip(grams[kept].view(np.int64).tolist(), at[kept].tolist(), strict=True):
            d = int(doc[first])
            left, right = max(int(o[d]), first - window + k), min(int(o[d + 1]), first + window)
            rows.append((d, gram, True, first - int(o[d]), first - left, piece.text(left, right)))
        for n in lengths:
            grams, at = tx.ngrams(hashes, o, n)
            grams = grams ^ SHORT
            keep = wanted(grams) & ((piece.counts[doc[at]] == n) if items else True)
            for gram, first in zip(grams[keep].view(np.int64).tolist(), at[keep].tolist(), strict=True):
                d = int(doc[first])
                rows.append((d, gram, False, first - int(o[d]), 0, piece.text(first, first + n)))
        yield piece, rows


def _bitmap(items: DataFrame) -> np.ndarray:
    """The fingerprints' low bits, or-ed over all tasks: a fixed size, whatever the benchmark."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITMAP_BYTES, np.uint8)
        for batch in batches:
            at = np.asarray(batch.column(0)) & (BITMAP_BYTES * 8 - 1)
            np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        if bits.any():
            yield packed(bits)

    return merged(items.select("print").mapInArrow(mark, "part int, data binary"), BITMAP_BYTES, np.uint8, np.bitwise_or)


_TYPES = (("print", pa.int64()), ("long", pa.bool_()), ("at", pa.int32()), ("lead", pa.int32()), ("words", pa.string()))


def item_prints(benchmark: DataFrame, k: int, window: int) -> DataFrame:
    """item_id, print, long, lead and words: the kept k-grams of items, and short items whole."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, rows in _prints(batch.column(1), k, window, list(range(1, window)), True, None):
                ids = batch.column(0).slice(piece.first, piece.n).take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_TYPES, 1))], ["item_id", *(c for c, _ in _TYPES)])

    source = benchmark.select(F.col("item_id").cast("string"), "text")
    found = source.mapInArrow(prints, "item_id string, print long, long boolean, at int, lead int, words string")
    return found.drop("at").dropDuplicates()


def contamination(docs: DataFrame, benchmark: DataFrame, k: int = 5, window: int = 10) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, n_words) of each row of docs, and the hits (row, item_id, first, last) in words, last exclusive."""
    items = durable(item_prints(benchmark, k, window), "decon-items")
    short = items.filter("not long").select(F.size(F.split("words", " ")).alias("n")).distinct()
    lengths = sorted(r["n"] for r in short.collect())  # under ``window`` of them
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(items))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, rows in _prints(batch.column(1), k, window, lengths, False, bitmap.value):
                each: list[list] = [[] for _ in range(piece.n)]
                for d, *r in rows:
                    each[d].append({c: x for (c, _), x in zip(_TYPES, r, strict=True)})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.first, piece.n), pa.array(piece.counts), pa.array(each, pa.list_(pa.struct(_TYPES)))], ["doc_id", "n_words", "prints"])

    read = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(prints, f"doc_id long, n_words long, prints {FINGERPRINT}")
    read = durable(read.withColumn("row", F.monotonically_increasing_id()), "decon-docs")
    d = read.select("row", F.inline("prints")).select("row", "print", "long", "at", "lead", F.split("words", " ").alias("w"))
    i = items.select("item_id", "print", "long", F.col("lead").alias("ilead"), F.split("words", " ").alias("iw"))
    both = d.join(i, ["print", "long"])
    # words that match to the left of the fingerprint, and from its first word on
    run = "aggregate(sequence({}), struct(0 as n, true as same), (s, j) -> struct(s.n + int(s.same and w[lead {} j] <=> iw[ilead {} j]) as n, s.same and w[lead {} j] <=> iw[ilead {} j] as same), s -> s.n)"
    back = run.format("1, least(lead, ilead)", "-", "-", "-", "-")
    ahead = run.format("0, least(size(w) - lead, size(iw) - ilead) - 1", "+", "+", "+", "+")
    both = both.select("row", "item_id", "long", "at", F.size("iw").alias("n"), F.expr(f"if(least(lead, ilead) > 0, {back}, 0)").alias("l"), F.expr(ahead).alias("r"))
    hits = both.filter((F.col("r") >= F.when(F.col("long"), F.lit(k)).otherwise(F.col("n"))) & (F.col("l") + F.col("r") >= F.when(F.col("long"), F.lit(window)).otherwise(F.col("n"))))
    return read.select("row", "doc_id", "n_words"), hits.select("row", "item_id", (F.col("at") - F.col("l")).alias("first"), (F.col("at") + F.col("r")).alias("last")).distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = 5, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each row of ``docs``."""
    read, hits = contamination(docs, benchmark, k, window)
    hits = durable(hits, "decon-hits")
    before = Window.partitionBy("row").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select("row", "first", "last").distinct().withColumn("reached", F.max("last").over(before))
    new = F.greatest(F.lit(0), F.col("last") - F.greatest("first", F.coalesce("reached", F.lit(0))))
    words = spans.groupBy("row").agg(F.sum(new).cast("long").alias("n_hit"))
    items = hits.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    out = read.join(words, "row", "left").join(items, "row", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
