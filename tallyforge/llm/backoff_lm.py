"""Operator 6: language-model scores by stupid backoff, computed relationally.

S(w | u v) = c(u v w) / c(u v) if the longest n-gram occurs, else ``backoff`` * S(w | v), and so on down to
c(w) / N; a word that does not occur at all gets ``backoff`` / N.  Counts are of all other documents of the table (a
document's own n-grams are taken off), so what only it says is unseen and backs off.  No count is cut off.  A
document's score is the mean of log10 S over its words.

Documents are gathered into blocks of ``BLOCK_PARTS`` times ``block_words`` words or up to half as many more.  A block counts its
n-grams of all orders part by part (``block_words`` words), merges the parts' counts and sends a sorted list of distinct hashes and counts to every hash bucket.  A bucket holds the count table of
its hashes: it sums the lists, and answers each with the sums, in the list's order.  Blocks meet their answers again
and sum the logs per document, again part by part, so a larger block sends fewer n-grams and takes little more memory.  So an n-gram moves once a block, not once an occurrence: the hottest n-gram
is one number a block, and buckets are even.  Blocks and buckets are bounded (``block_words``, ``bucket_entries``) whatever the
input; where their product grows too large (beyond some TB), raise both with the executors' memory.

N-grams are 64-bit hashes of their words.

Defined results: a null or wordless text has n_words 0 and a null score; each input row gives one output row and is a document of
its own (so repeated rows see each other's n-grams, and null ids do not mix); extra columns are ignored; an empty table
gives an empty result; N is 1 at least.  Words are lower-cased (A-Z) runs of anything but white space.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._spark import durable, new_path

BLOCK_WORDS = 1_000_000
BLOCK_PARTS = 3
BLOCK_ROWS = 100_000
BUCKET_ENTRIES = 4_000_000
BATCH_BYTES = 4_000_000
_CODEC = "zstd"


def _pack(values: np.ndarray) -> bytes:
    """An array as bytes: one plane a byte of its numbers, so that high bytes cost little, compressed."""
    raw = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T)
    return raw.nbytes.to_bytes(8, "little") + pa.compress(raw.tobytes(), codec=_CODEC, asbytes=True)


def _unpack(data: bytes, dtype: type) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec=_CODEC), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype)


def _pack_steps(keys: np.ndarray) -> bytes:
    """Numbers as steps from one to the next, which are small where they ascend; where they fall, the step wraps around."""
    return _pack(np.diff(keys, prepend=keys[:1] - keys[:1]))


def _unpack_steps(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.uint64), dtype=np.uint64)


def _blocks(docs: DataFrame, block_words: int) -> DataFrame:
    """Blocks of whole documents: doc_id and size (words) of each document, and packed the distinct words' hashes, the frequent ones first, and the words as places among these.

    A rest of less than half a block goes with the block before it.
    """

    def block(ids: list[pa.Array], sizes: list[np.ndarray], words: list[np.ndarray]) -> pa.RecordBatch:
        every, place, times = np.unique(np.concatenate(words), return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        size = np.concatenate(sizes).astype(np.int32)
        one = pa.array([0, len(size)], pa.int32())
        lists = [pa.ListArray.from_arrays(one, x) for x in (pa.concat_arrays(ids), pa.array(size))]
        # words that occur equally often, above all those that occur once, stand by hash: their steps take fewer bytes
        return pa.RecordBatch.from_arrays([*lists, pa.array([_pack_steps(every[order])], pa.binary()), pa.array([_pack(rank[place])], pa.binary())], ["doc_id", "size", "vocabulary", "word"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full, own, n, rows = None, ([], [], []), 0, 0
        for batch in batches:
            for piece in tx.pieces(batch.column(1), tx.SPACES):
                h = piece.hashes()
                if rows and (n + len(h) > block_words or rows + piece.n > BLOCK_ROWS):
                    if full:
                        yield block(*full)
                    full, own, n, rows = own, ([], [], []), 0, 0
                # ids are copied, as a slice would hold the texts of its batch
                ids = pa.array(batch.column(0).slice(piece.first, piece.n).to_pylist(), pa.int64())
                for found, x in zip(own, (ids, piece.counts, h), strict=True):
                    found.append(x)
                n, rows = n + len(h), rows + piece.n
        if full and 2 * n < block_words and 2 * rows < BLOCK_ROWS:
            full, own = None, tuple(x + y for x, y in zip(full, own, strict=True))
        for x in (full, own):
            if x and x[0]:
                yield block(*x)

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(read, "doc_id array<long>, size array<int>, vocabulary binary, word binary")
    return found.withColumn("block", F.monotonically_increasing_id())


def _parts(size: pa.Array, vocabulary: bytes, word: bytes, part_words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The parts of a block, whole documents of about ``part_words`` words: word offsets and the words' hashes."""
    offsets, words, place = np.concatenate([[0], np.cumsum(np.asarray(size), dtype=np.int64)]), _unpack_steps(vocabulary), _unpack(word, np.int32)
    first = [0]
    while first[-1] < len(size):
        first.append(max(first[-1] + 1, int(np.searchsorted(offsets, offsets[first[-1]] + part_words, "right")) - 1))
    for a, b in pairwise(first):
        yield offsets[a : b + 1] - offsets[a], words[place[offsets[a] : offsets[b]]]


def _all_grams(offsets: np.ndarray, hashes: np.ndarray, order: int) -> np.ndarray:
    return np.concatenate([tx.ngrams(hashes, offsets, n)[0] for n in range(1, order + 1)])


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes, ascending, and the place of the first of each; sorts in place, as copies count here."""
    hashes.sort()
    new = np.ones(len(hashes), bool)
    np.not_equal(hashes[1:], hashes[:-1], out=new[1:])
    first = np.flatnonzero(new)
    return hashes[first], first


def _edges(keys: np.ndarray, bits: int) -> list[int]:
    """Where each bucket begins in ascending hashes, and the end."""
    inner = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist() if bits else []
    return [0, *inner, len(keys)]


def _merged(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of several ascending lists, and their counts in all of them."""
    if len(keys) == 1:
        return keys[0], n[0]
    every, n = np.concatenate(keys), np.concatenate(n)
    if not len(every):
        return every, n
    order = np.argsort(every, kind="stable")
    every = every[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    return every[first], np.add.reduceat(n[order], first, dtype=np.int32)


def _asked(blocks: DataFrame, order: int, bits: int, part_words: int) -> DataFrame:
    """bucket, block and, packed, the block's distinct n-grams (all orders) of that bucket, ascending, with their counts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, size, vocabulary, word in zip(*batch.columns, strict=True):
                parts = []
                for offsets, hashes in _parts(size.values, vocabulary.as_py(), word.as_py(), part_words):
                    grams = _all_grams(offsets, hashes, order)
                    keys, at = _distinct(grams)
                    parts.append((keys, np.diff(at, append=len(grams)).astype(np.int32), _edges(keys, bits)))
                    del grams, at
                found, held = [], 0
                for bucket in range(1 << bits):
                    spans = [slice(edge[bucket], edge[bucket + 1]) for _, _, edge in parts]
                    keys, n = _merged([k[x] for (k, _, _), x in zip(parts, spans, strict=True)], [n[x] for (_, n, _), x in zip(parts, spans, strict=True)])
                    if len(keys):
                        found.append((bucket, block.as_py(), _pack_steps(keys), _pack(n)))
                        held += len(found[-1][2]) + len(found[-1][3])
                    if found and (held > BATCH_BYTES or bucket == (1 << bits) - 1):
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "block", "key", "n"])
                        found, held = [], 0

    return blocks.select("block", "size", "vocabulary", "word").mapInArrow(ask, "bucket int, block long, key binary, n binary")


def _answered(asked: DataFrame) -> DataFrame:
    """block, bucket and, packed, the corpus counts of the n-grams that the block asked for, in its order."""

    def count(table: pa.Table) -> pa.Table:
        # one bucket's part of the count table, and its join with the lists
        keys = [_unpack_steps(x.as_py()) for x in table.column("key")]
        at = np.unique(np.concatenate(keys), return_inverse=True)[1]
        total = np.bincount(at, weights=np.concatenate([_unpack(x.as_py(), np.int32) for x in table.column("n")])).astype(np.int64)
        edge = np.cumsum([0, *map(len, keys)])
        counts = [_pack(total[at[a:b]]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "count": pa.array(counts, pa.binary())})

    return asked.groupBy("bucket").applyInArrow(count, "block long, bucket int, count binary")


def _scored(blocks: DataFrame, answers: DataFrame, order: int, backoff: float, total: int, bits: int, part_words: int) -> DataFrame:
    """doc_id, n_words, n_backoff and score of each document of each block."""

    def part(offsets: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that back off, and the sum of logs, of each document of a part; counts: of its distinct n-grams, ascending."""
        keys = _distinct(_all_grams(offsets, hashes, order))[0]
        size, m = np.diff(offsets), int(offsets[-1])
        doc = np.repeat(np.arange(len(size)), size)
        others = np.zeros((order + 1, m), np.int64)  # of the n-gram that begins at a word: its count in other documents
        for n in range(1, order + 1):
            found, at = tx.ngrams(hashes, offsets, n)
            sort = np.argsort(found)  # look-ups in order are three times as fast
            place = np.empty(len(found), np.int64)
            place[sort] = np.searchsorted(keys, found[sort])
            del found, sort
            _, own, times = np.unique(doc[at] * len(keys) + place, return_inverse=True, return_counts=True)
            others[n, at] = counts[place] - times[own]
        del keys, counts, at, place, own, times
        longest = np.minimum(np.arange(m) - offsets[doc] + 1, order)  # the longest n-gram that ends at a word
        rest = np.maximum(1, total - size)[doc]
        logs, steps, left_over = np.zeros(m), np.zeros(m, np.int64), np.ones(m, bool)
        for n in range(order, 0, -1):
            here = np.flatnonzero(left_over & (longest >= n))
            first = here - n + 1
            c = others[n, first]
            seen = c > 0
            hit = here[seen]
            logs[hit] = np.log10(c[seen]) - np.log10(others[n - 1, first[seen]] if n > 1 else rest[hit])
            left_over[hit] = False
            steps[here[~seen]] += 1
        logs[left_over] = -np.log10(rest[left_over])
        logs += steps * np.log10(backoff)
        back, sums = (np.concatenate([[0], np.cumsum(x)]) for x in (steps > 0, logs))
        return tuple(x[offsets[1:]] - x[offsets[:-1]] for x in (back, sums))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        size = left.column("size")[0].values
        parts = lambda: _parts(size, left.column("vocabulary")[0].as_py(), left.column("word")[0].as_py(), part_words)
        # what the block asked for, bucket by bucket, and of it what each part holds
        keys = [_distinct(_all_grams(*x, order))[0] for x in parts()]
        edges, counts = [_edges(k, bits) for k in keys], [np.zeros(len(k), np.uint32 if total < 1 << 32 else np.int64) for k in keys]
        for bucket, answer in zip(right.column("bucket").to_pylist(), right.column("count"), strict=True):
            spans = [slice(edge[bucket], edge[bucket + 1]) for edge in edges]
            every, answer = _distinct(np.concatenate([k[x] for k, x in zip(keys, spans, strict=True)]))[0], _unpack(answer.as_py(), np.int64)
            for k, c, x in zip(keys, counts, spans, strict=True):
                c[x] = answer[np.searchsorted(every, k[x])]
        del keys, edges
        back, sums = (np.concatenate(x) for x in zip(*(part(*x, counts.pop(0)) for x in parts()), strict=True))
        n = np.asarray(size).astype(np.int64)
        mean = np.divide(sums, n, out=np.zeros(len(n)), where=n > 0)
        return pa.table({"doc_id": left.column("doc_id")[0].values, "n_words": pa.array(n), "n_backoff": pa.array(back), "score": pa.array(mean, mask=n == 0)})

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, "doc_id long, n_words long, n_backoff long, score double")


def backoff_scores(docs: DataFrame, order: int = 3, backoff: float = 0.4, block_words: int = BLOCK_WORDS, bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """doc_id, n_words, n_backoff (words not scored in their longest context) and score of each row of ``docs`` (doc_id, text, ...)."""
    spark = docs.sparkSession
    # a table that is dealt by block, so that blocks stay where they are when their answers come
    name, parts = f"lm_blocks_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        _blocks(docs, BLOCK_PARTS * block_words).write.bucketBy(parts, "block").option("path", new_path(spark, "lm-blocks")).saveAsTable(name)
        blocks = spark.table(name)
        total = blocks.agg(F.sum(F.aggregate("size", F.lit(0).cast("long"), lambda s, x: s + x))).first()[0] or 0
        bits = max(0, (-(-total * order // bucket_entries) - 1).bit_length())
        found = _scored(blocks, _answered(_asked(blocks, order, bits, block_words)), order, backoff, total, bits, block_words)
        return durable(found.withColumn("score", F.round("score", 6)), "lm-scores")
    finally:
        spark.sql(f"drop table if exists {name}")
