"""Operator 9: token ids in Parquet list columns, for selective reads of tokens and of metadata.

``write_tokens`` range-partitions documents by doc_id, encodes whole texts with the ``tokenizers`` library,
appends an end id to each, and writes one row a document (doc_id, n_tokens, ids) in ascending doc_id
order.  The layout is Parquet's own: dictionary-encoded ids (a page holds a few thousand distinct ids, so
an id takes the bits of its dictionary index), delta-encoded doc_id and n_tokens, row groups and pages of a
given size, and the column and offset indexes that Spark's writer adds.  ``read_tokens`` selects columns and
doc_id ranges; both reach the scan.

Encoding: a text is cut only where the vocabulary's pre-tokeniser always cuts: before white space whose next
character is none, and before ASCII punctuation that follows an ASCII letter.  Each distinct piece is
encoded once per worker and found again by its hash; a piece whose bytes are not those that were remembered is encoded
anew, so the ids are the same as of the whole text.
A text that holds a special token's string is one piece.

Defined results: a null or empty text is just the end id; rows that repeat a doc_id are written one after
another, ordered by text; a null doc_id sorts first; an empty table writes a file without rows; extra columns
are not written.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _text as tx
from ._spark import durable, new_path

#: Entries of a worker's memory of encoded pieces; a full one starts anew.
MEMORY = 1_000_000
#: Input bytes of one range of documents: at least, and at most; between them, so many that each core gets RANGES_A_CORE.
RANGE_BYTES, MOST_RANGE_BYTES, RANGES_A_CORE = 24 << 20, 1 << 30, 32

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
#: A byte after white space that surely starts a character which is no white space itself.
_SOLID = ~_WHITE
_SOLID[[0xC2, 0xE1, 0xE2, 0xE3]] = False
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[np.frombuffer(b".,;:!?|&%$#*", np.uint8)] = True


class Encoder:
    """Encodes pieces with a tokenizer file, remembering what it has encoded."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Strings that are one token wherever they stand; a text that holds one is not cut.
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    #: A 64-bit hash of each piece; it only finds pieces, their bytes decide.
    hashes = staticmethod(tx.span_hashes)

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.rows = np.zeros((0, 4), np.int64)  # start and length in ids, and in bytes
        self.ids = np.zeros(0, np.int32)
        self.bytes = np.zeros(0, np.uint8)

    def learn(self, keys: np.ndarray, texts: list[bytes]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in texts], add_special_tokens=False)]
        length, size = np.fromiter(map(len, found), np.int64, len(found)), np.fromiter(map(len, texts), np.int64, len(texts))
        start, begin = (len(old) + np.concatenate([[0], np.cumsum(n)[:-1]]) for old, n in ((self.ids, length), (self.bytes, size)))
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in found for i in x), np.int32, int(length.sum()))])
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(texts), np.uint8)])
        self.keys = np.concatenate([self.keys, keys])
        self.rows = np.concatenate([self.rows, np.stack([start, length, begin, size], 1)])
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.rows = self.keys[order], self.rows[order]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each key, and whether it is known."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def differing(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The pieces whose bytes are not those remembered at their places."""
        begin, size = self.rows[at, 2], self.rows[at, 3]
        wrong = size != ends - starts
        if not wrong.any() and len(starts) and starts[0] == 0 and ends[-1] == len(data):  # the pieces cover the data
            unlike = self.bytes[np.repeat(begin - starts, size) + np.arange(len(data))] != data
            return np.unique(np.searchsorted(starts, np.flatnonzero(unlike), "right") - 1) if unlike.any() else np.zeros(0, np.int64)
        return np.array([i for i in range(len(starts)) if self.bytes[begin[i] : begin[i] + size[i]].tobytes() != data[starts[i] : ends[i]].tobytes()], np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents in a row, and where each one's ids begin (one more at the end)."""
        start = np.zeros(len(data), bool)
        if len(data):
            white, solid = _WHITE[data], _SOLID[data]
            start[:-1] = white[:-1] & solid[1:]
            start[1:] |= _PUNCTUATION[data[1:]] & _LETTER[data[:-1]]
            last = offsets[1:][np.diff(offsets) > 0] - 1
            start[last] = _PUNCTUATION[data[last]] & (last > 0) & _LETTER[data[np.maximum(last - 1, 0)]]
            start[offsets[:-1][np.diff(offsets) > 0]] = True
            whole = data.tobytes()
            if any(s in whole for s in self.special):
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    if any(s in whole[a:b] for s in self.special):
                        start[a + 1 : b] = False
        starts = np.flatnonzero(start)
        ends = np.concatenate([starts[1:], [len(data)]]) if len(starts) else starts
        keys, first, back = np.unique(self.hashes(data, starts, ends), return_index=True, return_inverse=True)
        at, known = self.find(keys)
        new = np.flatnonzero(~known)
        if len(new):
            if len(self.keys) + len(new) > MEMORY:
                self.clear()
                new = np.arange(len(keys))
            raw = data.tobytes()
            self.learn(keys[new], [raw[starts[i] : ends[i]] for i in first[new]])
            at, _ = self.find(keys)
        place = at[back]
        begin, length = (self.rows[place, k] for k in (0, 1))
        edge = np.concatenate([[0], np.cumsum(length)])
        ids = self.ids[np.repeat(begin - edge[:-1], length) + np.arange(edge[-1])]
        odd = self.differing(data, starts, ends, place)
        if len(odd):  # another piece has the same hash
            own = [self.tokenizer.encode(data[starts[i] : ends[i]].tobytes().decode("utf-8", "replace"), add_special_tokens=False).ids for i in odd]
            each = np.split(ids, edge[1:-1])
            for i, x in zip(odd.tolist(), own, strict=True):
                each[i] = np.array(x, np.int32)
            ids, edge = np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])
        return ids, edge[np.searchsorted(starts, offsets, "left")]


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """doc_id, n_tokens and ids (with the end id) of each row, in the order and partitions of ``docs``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        for batch in batches:
            for piece in tx.pieces(batch.column(1), tx.separator_table(dropped=b""), lower=False):
                ids, edge = encoder.encode(piece.data, piece.offsets)
                ids = np.insert(ids, edge[1:], end_id)
                edge = edge + np.arange(len(edge))
                lists = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.first, piece.n), pa.array(np.diff(edge), pa.int32()), lists], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id long, n_tokens int, ids array<int>")


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, ranges: int | None = None, row_group_bytes: int = 16 << 20, page_bytes: int = 1 << 20) -> None:
    """Write the token file of ``docs`` (doc_id, text, ...) to ``path``."""
    source = docs.select(F.col("doc_id").cast("long"), "text")
    if ranges is None:
        total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        share = total // (RANGES_A_CORE * docs.sparkSession.sparkContext.defaultParallelism)
        ranges = max(1, -(-total // min(max(share, RANGE_BYTES), MOST_RANGE_BYTES)))
    ordered = source.repartitionByRange(int(ranges), "doc_id").sortWithinPartitions("doc_id", "text")
    tokens = encode_documents(ordered, tokenizer_path, end_id)
    writer = tokens.write.option("compression", "zstd").option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes)
    writer = writer.option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "true")
    for column in ("doc_id", "n_tokens"):
        writer = writer.option(f"parquet.enable.dictionary#{column}", "false")
    writer.parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "n_tokens", "ids"), first_id: int | None = None, last_id: int | None = None) -> DataFrame:
    """Selected columns of a token file, of documents from first_id to last_id (both included)."""
    table = spark.read.schema("doc_id long, n_tokens int, ids array<int>").parquet(path)
    if first_id is not None:
        table = table.filter(F.col("doc_id") >= first_id)
    if last_id is not None:
        table = table.filter(F.col("doc_id") <= last_id)
    return table.select(*columns)


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, all read back from the file."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ids = np.asarray(lists.flatten()).astype("<u4")
            edge = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(edge)), batch.column(2), pa.array(crc, pa.int64())], ["file", "row", "n", "doc_id", "crc"])

    table = read_tokens(spark, path, ("doc_id", "ids", "_metadata"))
    table = table.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), "doc_id", "ids")
    rows = durable(table.mapInArrow(digest, "file string, row long, n long, doc_id long, crc long"), "token-digest")
    files = rows.groupBy("file").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", "file")).alias("first"), F.sum("n").alias("total"))
    before = Window.partitionBy().orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    # one row a range; their number follows the cores or, at 1 GB a range, stays small enough for one task
    files = files.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(files, "file")
    return rows.select("doc_id", (F.col("base") + F.col("inside")).cast("long").alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def token_file(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Write ``docs`` as a token file in the shared folder and digest what is read back."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer_path, end_id)
    return token_digest(spark, path)
