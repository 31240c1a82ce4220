"""Operator 11: lines that many documents share stay in one of them (range partitions, secondary sort, keep bitmaps).

A line's key is the line without white space at its ends, A-Z in lower case.  A key of at least ``least``
code points that several documents hold loses its lines everywhere but in the document with the smallest doc_id.

1. Every line with such a key becomes a row of numbers: a 128-bit hash of the key, the document, the place.  No text moves.
2. The rows are range-partitioned and sorted by hash, then document, then place.  The ranges cut inside a hash
   too, so a line that a third of all documents hold is spread over as many tasks as it fills.
3. Each task streams over its sorted rows and keeps only the first document of the present hash in memory.  What does not
   belong to that document is dropped.  Only a task's first hash may have begun in an earlier range: its rows wait, and
   each task names the first document of its first and last hash, two rows a range, which decide the rows that wait.
4. The dropped places of each document become a compressed bitmap of the lines to keep.

Documents that lose nothing have no bitmap.  ``keep_lines`` applies the bitmaps to the texts.

Defined results: null or empty text is one empty line.  Rows that repeat a doc_id are one document: a key found only in them
loses nothing, and where theirs is the smallest id, all of them keep it.  Rows with a null doc_id are one document that comes after
all others.  A row is found again by its doc_id and a 64-bit hash of its text; equal rows get equal bitmaps.  Extra columns are
ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import durable

SPACES = " \t\n\x0b\x0c\r"
#: Texts that are cut into lines at once.
TEXTS = 256
#: What a task says of a row: dropped, waiting for earlier ranges, or the first document of a hash.
DROPPED, WAITS, FIRST = 0, 1, 2
ROW = ["h1", "h2", "no_id", "doc", "of", "place", "n_lines"]


def _named(docs: DataFrame) -> DataFrame:
    """no_id, doc, of (hash of the text) and text of each row: what finds a row again."""
    text, doc = F.coalesce("text", F.lit("")), F.col("doc_id").cast("long")
    return docs.select(doc.isNull().alias("no_id"), F.coalesce(doc, F.lit(0)).alias("doc"), F.xxhash64(text).alias("of"), text.alias("text"))


def line_key(line: bytes) -> bytes:
    return line.strip(SPACES.encode()).lower()  # of bytes: A-Z only


def line_rows(docs: DataFrame, least: int) -> DataFrame:
    """A row of numbers (ROW) for each line whose key has at least ``least`` code points."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                block = batch.slice(at, TEXTS)
                rows, places, counts, digests = [], [], [], []
                for i, text in enumerate(block.column(3).cast(pa.large_binary())):
                    lines = text.as_py().split(b"\n")
                    for place, line in enumerate(lines):
                        key = line_key(line)
                        # a code point has four bytes at the most
                        if len(key) >= 4 * least or len(key) >= least and len(key.decode()) >= least:
                            rows.append(i)
                            places.append(place)
                            counts.append(len(lines))
                            digests.append(hashlib.blake2b(key, digest_size=16).digest())
                both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                named = [block.column(k).take(pa.array(rows, pa.int64())) for k in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1])), *named, pa.array(places, pa.int32()), pa.array(counts, pa.int32())], ROW)

    return _named(docs).mapInArrow(each, "h1 long, h2 long, no_id boolean, doc long, of long, place int, n_lines int")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over the sorted rows of one range: those to drop, those of its first hash, and the first document of its first and last hash."""
    names = ["said", *ROW]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    opening = last = None  # (h1, h2, no_id, doc) that a hash begins with
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, no_id, doc = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new[0] = last is None or (h1[0], h2[0]) != last[:2]
        starts = np.flatnonzero(new)
        group = np.cumsum(new) - new[0]  # 0: the hash that was open, or the first of this batch
        heads = [last] if not new[0] else []
        first_no, first_doc = (np.concatenate([np.array([h[k] for h in heads], x.dtype), x[starts]]) for k, x in ((2, no_id), (3, doc)))
        other = (no_id != first_no[group]) | (doc != first_doc[group])
        if opening is None:
            opening = (h1[0], h2[0], no_id[0], doc[0])
        waits = (h1 == opening[0]) & (h2 == opening[1])
        if len(starts):
            s = starts[-1]
            last = (h1[s], h2[s], no_id[s], doc[s])
        chosen = np.flatnonzero(other | waits)
        if len(chosen):
            rows = batch.take(pa.array(chosen))
            yield pa.RecordBatch.from_arrays([pa.array(np.where(waits[chosen], WAITS, DROPPED), pa.int32()), *rows.columns], names)
    if opening is not None:
        both = [opening] if opening[:2] == last[:2] else [opening, last]
        columns = [[FIRST] * len(both), *([b[k] for b in both] for k in range(4)), *([0] * len(both) for _ in range(3))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def _dropped(rows: DataFrame) -> DataFrame:
    """The lines (no_id, doc, of, place, n_lines) that are not in the first document of their key."""
    # ranges are found by a pass of their own: it reads the numbers, not the texts
    ranged = durable(rows, "line-rows").repartitionByRange("h1", "h2", "no_id", "doc", "of", "place").sortWithinPartitions("h1", "h2", "no_id", "doc", "of", "place")
    said = durable(ranged.mapInArrow(_stream, "said int, h1 long, h2 long, no_id boolean, doc long, of long, place int, n_lines int"), "line-firsts")
    # two rows a range at the most
    first = said.filter(F.col("said") == FIRST).groupBy("h1", "h2").agg(F.min(F.struct("no_id", "doc")).alias("first"))
    waiting = said.filter(F.col("said") == WAITS).join(F.broadcast(first), ["h1", "h2"]).filter("no_id != first.no_id or doc != first.doc")
    kept = ["no_id", "doc", "of", "place", "n_lines"]
    return said.filter(F.col("said") == DROPPED).select(*kept).unionByName(waiting.select(*kept))


def pack_bitmap(n_lines: int, dropped: np.ndarray) -> bytes:
    """The lines to keep as a compressed bitmap, the first line in the highest bit of the first byte."""
    keep = np.ones(n_lines, np.uint8)
    keep[dropped] = 0
    return zlib.compress(np.packbits(keep).tobytes())


def unpack_bitmap(data: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(data), np.uint8), count=n_lines).astype(bool)


def keep_bitmaps(docs: DataFrame, least: int = 10) -> DataFrame:
    """no_id, doc, of, n_lines, n_dropped and keep (a compressed bitmap) of each document of ``docs`` (doc_id, text) that loses lines."""
    places = _dropped(line_rows(docs, least)).groupBy("no_id", "doc", "of", "n_lines").agg(F.collect_set("place").alias("places"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.array(x.as_py(), np.int64) for x in batch.column(4)]
            maps = [pack_bitmap(n.as_py(), x) for n, x in zip(batch.column(3), lists)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(3).cast(pa.int64()), pa.array([len(x) for x in lists], pa.int64()), pa.array(maps, pa.binary())], ["no_id", "doc", "of", "n_lines", "n_dropped", "keep"])

    return places.mapInArrow(pack, "no_id boolean, doc long, of long, n_lines long, n_dropped long, keep binary")


def keep_lines(docs: DataFrame, bitmaps: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of each row of ``docs``, and kept: the lines that its bitmap leaves, joined."""
    names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"] + ["kept"] * with_text
    joined = _named(docs).join(bitmaps.select("no_id", "doc", "of", "keep"), ["no_id", "doc", "of"], "left").select("no_id", "doc", "text", "keep")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                block = batch.slice(at, TEXTS)
                ids = [None if no.as_py() else d.as_py() for no, d in zip(block.column(0), block.column(1))]
                counts, dropped, texts = [], [], []
                for text, keep in zip(block.column(2), block.column(3)):
                    text = text.as_py()
                    n = text.count("\n") + 1
                    left = n
                    if keep.is_valid:
                        bits = unpack_bitmap(keep.as_py(), n)
                        text = "\n".join([x for x, k in zip(text.split("\n"), bits.tolist()) if k])
                        left = int(bits.sum())
                    counts.append(n)
                    dropped.append(n - left)
                    texts.append(text)
                digests = [hashlib.sha256(x.encode()).hexdigest() for x in texts]
                columns = [pa.array(x, t) for x, t in zip((ids, counts, dropped, digests, texts), (*[pa.int64()] * 3, pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays(columns[: len(names)], names)

    return joined.mapInArrow(apply, "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", kept string" * with_text)


def dedupe_lines(docs: DataFrame, least: int = 10, with_text: bool = True) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 and kept (the text that is left) of each row of ``docs`` (doc_id, text, ...)."""
    return keep_lines(docs, keep_bitmaps(docs, least), with_text)
