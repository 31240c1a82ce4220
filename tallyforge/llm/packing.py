"""Operator 3: packing into length buckets whose boundaries minimise padding.

A document's length is its number of words (``[^\\x20\\x09-\\x0D]+``) and one end mark.  Documents longer than
``max_length`` are cut into pieces of ``max_length`` and a rest.  The global histogram of piece lengths, at
most ``max_length`` numbers, goes to a dynamic programme that places ``buckets`` upper bounds so that the
padding of all pieces to their bucket's bound is smallest (ties: the smaller bound).  Inside each bucket,
batches of floor(token_budget / bound) pieces form in a fixed order, so no batch is over the budget and only
the last one of a bucket can be short.

Positions inside a bucket are counted in two steps, over (bucket, slice) and over the slices of a bucket, so
that a bucket with most of the pieces is no single task's work.  Slices are dealt by a hash of the numbered row, so
no pattern in doc_id, nor one that repeats, fills a slice; their number grows with the pieces.

Defined results: a null or wordless text is one piece of length 1; rows that repeat a doc_id, or have none, each keep
their pieces; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import durable

#: Slices at least, and pieces of a slice at most (on average) beyond that.
SLICES, SLICE_PIECES = 512, 200_000


def bucket_bounds(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper bounds that minimise the padding of a histogram {length: pieces}, by dynamic programming.

    cost[k][j] is the least padding of the shortest j lengths in k buckets.  Padding of lengths i..j-1 in one
    bucket is length[j-1] * pieces - tokens, from running sums.
    """
    lengths = np.array(sorted(histogram), np.int64)
    if not len(lengths):
        return []
    number = np.array([histogram[x] for x in lengths.tolist()], np.int64)
    pieces, tokens = np.concatenate([[0], np.cumsum(number)]), np.concatenate([[0], np.cumsum(number * lengths)])
    m, most = len(lengths), min(buckets, len(lengths))
    far = np.iinfo(np.int64).max // 4
    cost = np.full((most + 1, m + 1), far)
    cost[0, 0] = 0
    cut = np.zeros((most + 1, m + 1), np.int64)
    for k in range(1, most + 1):
        for j in range(k, m + 1):
            total = cost[k - 1, :j] + lengths[j - 1] * (pieces[j] - pieces[:j]) - (tokens[j] - tokens[:j])
            cut[k, j] = i = int(total.argmin())
            cost[k, j] = total[i]
    bounds, j = [], m
    for k in range(int(cost[:, m].argmin()), 0, -1):
        bounds.append(int(lengths[j - 1]))
        j = int(cut[k, j])
    return bounds[::-1]


def pack(docs: DataFrame, token_budget: int = 8192, max_length: int = 2048, buckets: int = 12, slices: int | None = None) -> DataFrame:
    """doc_id, piece, first (word), length, bucket (its bound), batch and slot of each piece of each row."""
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != ""))
    sized = docs.select(F.col("doc_id").cast("long"), (words + 1).cast("long").alias("total"))
    sized = sized.withColumn("row", F.monotonically_increasing_id())
    pieces = sized.select("doc_id", "row", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / max_length))).alias("piece"))
    pieces = pieces.select("doc_id", "row", "piece", (F.col("piece") * max_length).alias("first"), F.least(F.lit(max_length), F.col("total") - F.col("piece") * max_length).cast("long").alias("length"))
    pieces = durable(pieces, "packing-pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # max_length rows at most
    bounds = bucket_bounds(histogram, buckets)
    if not bounds:
        return pieces.select("doc_id", "piece", "first", "length", F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("slot"))
    slices = slices or max(SLICES, -(-sum(histogram.values()) // SLICE_PIECES))
    bound = F.element_at(F.filter(F.array(*map(F.lit, bounds)), lambda b: b >= F.col("length")), 1).cast("long")
    placed = pieces.withColumn("bucket", bound).withColumn("slice", F.pmod(F.xxhash64("row", "piece"), F.lit(slices)))
    inside = Window.partitionBy("bucket", "slice").orderBy("doc_id", "piece", "row")
    counts = placed.groupBy("bucket", "slice").count()  # buckets x slices rows
    before = Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    at = placed.withColumn("rank", F.row_number().over(inside) - 1).join(F.broadcast(offsets), ["bucket", "slice"]).withColumn("rank", F.col("rank") + F.col("offset"))
    capacity = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(token_budget) / F.col("bucket")))
    return at.select("doc_id", "piece", "first", "length", "bucket", F.floor(F.col("rank") / capacity).cast("long").alias("batch"), F.pmod(F.col("rank"), capacity).cast("long").alias("slot"))
