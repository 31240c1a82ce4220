"""Operator 1: n-gram Jaccard join (rare-first prefix filter, length, positional and suffix filters).

A document's set holds its distinct shingles of ``n`` words; two documents link when the Jaccard
similarity of their sets reaches ``percent`` / 100.  The result names each document's connected
component.  The steps, each a Spark job over the whole table:

1. A count sketch of all shingles (fixed width, summed over all tasks) gives the order "rare first".
   Any total order keeps the prefix filter exact; the sketch only makes prefixes selective.
2. One pass over the texts yields, per document, the set's size, a 128-bit signature of the set, a
   parity bitmap and the prefix, which any linked pair must share a shingle of.
3. Rows with equal sets collapse into one class, which has a number of its own.
4. Prefix shingles found in one class only are dropped.  Classes that share a shingle are candidates.
   Large groups are dealt at random into small blocks first, and only pairs inside blocks are checked;
   that does small groups completely, and connects most of a group of near copies at a cost linear in its size.
5. What is still apart is then joined exactly: only pairs from different components, only from
   groups that hold several, each pair at its first common shingle only, and dealt to tasks in squares of sizes that can link.
6. Length, positional and suffix filters (the suffix filter is a lower bound of the symmetric
   difference, from the parity bitmaps) thin out candidates inside the join; survivors are verified
   once, on the sets themselves.  What moves for that is the compressed texts, of which the tasks make the sets anew.

Tables of two or three numbers a row are broadcast where they were counted to be small; beyond that Spark shuffles both sides, with
the same result, and its skew handling splits shingles that many classes hold.

Hash collisions: shingles are 64-bit hashes, classes 128-bit signatures; a row is found again by its doc_id and a 64-bit
hash of its text.

Defined results: null or wordless text has an empty set, ``n_shingles`` 0, and is its own component.
Rows that repeat a doc_id are one document, linked through all their texts; each input row gives one output row.  A null doc_id cannot
name a component: the row is returned with a null ``component_id``.  Extra columns are ignored.
An empty table gives an empty result.  Equal sets tie to the smallest doc_id.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._spark import broadcast_if_small, durable, merged, packed
from .components import connected_components

SKETCH_BITS = 20
BITMAP_WORDS = 16
#: Mean size of the blocks into which a group of candidates is dealt at first; smaller groups are one block.
BLOCK = 12
#: Sides of the squares of pairs that one task checks of a group whose classes are still apart.
X_ROWS, Y_ROWS = 256, 2048
#: Size of the bitmap of rows whose texts are wanted.
MARK_BYTES = 1 << 22
#: Texts that a task holds compressed at once while packing, and pairs whose texts it holds while checking.
PACKED_ROWS, CHECKED_PAIRS = 256, 16


def _sets(piece: tx.Piece, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document of a piece: hashes and document indexes, by document."""
    words = piece.hashes()
    grams, at = tx.ngrams(words, piece.word_offsets, n)
    docs = piece.doc_of_word()[at]
    short = np.flatnonzero((piece.counts > 0) & (piece.counts < n))
    if len(short):
        o = piece.word_offsets
        grams = np.concatenate([grams, np.array([tx.whole(words[o[d] : o[d + 1]]) for d in short], np.uint64)])
        docs = np.concatenate([docs, short])
    order = np.lexsort((grams, docs))
    grams, docs = grams[order], docs[order]
    first = np.ones(len(grams), bool)
    first[1:] = (grams[1:] != grams[:-1]) | (docs[1:] != docs[:-1])
    return grams[first], docs[first]


def _shingle_sketch(docs: DataFrame, n: int) -> np.ndarray:
    """Counts of shingle hashes modulo 2^SKETCH_BITS over all documents: 8 MB whatever the input."""
    width = 1 << SKETCH_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            for piece in tx.pieces(batch.column(0), tx.SPACES):
                total += np.bincount((_sets(piece, n)[0] & np.uint64(width - 1)).astype(np.int64), minlength=width)
        if total.any():
            yield packed(total)

    return merged(docs.select("text").mapInArrow(count, "part int, data binary"), width, np.int64, np.add)


def _profiles(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, h, size, signature, bitmap and rare-first prefix of each row of docs (doc_id, text, h)."""
    sketch = docs.sparkSession.sparkContext.broadcast(_shingle_sketch(docs, n))
    bits = BITMAP_WORDS * 64
    names = [f"b{i}" for i in range(BITMAP_WORDS)]

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = sketch.value
        mask = np.uint64(len(rarity) - 1)
        for batch in batches:
            for piece in tx.pieces(batch.column(1), tx.SPACES):
                grams, of = _sets(piece, n)
                size = np.bincount(of, minlength=piece.n)
                edge = np.concatenate([[0], np.cumsum(size)])
                sums = []
                for salt in (0, 0x5851F42D4C957F2D):
                    total = np.concatenate([[np.uint64(0)], np.cumsum(tx.mix(grams + np.uint64(salt)))])
                    sums.append((total[edge[1:]] - total[edge[:-1]]).view(np.int64))
                parity = np.bincount(of * bits + (grams >> np.uint64(54)).astype(np.int64), minlength=piece.n * bits) & 1
                maps = np.packbits(parity.astype(np.uint8).reshape(piece.n, bits), axis=1).view(np.int64)
                order = np.lexsort((grams, rarity[(grams & mask).astype(np.int64)], of))
                keep = size - (size * percent + 99) // 100 + 1
                keep[size == 0] = 0
                place = np.arange(len(grams)) - edge[of]
                chosen = order[place < keep[of]]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(keep)]), pa.int32()), pa.array(grams[chosen].view(np.int64)))
                ids, texts = (batch.column(k).slice(piece.first, piece.n) for k in (0, 2))
                yield pa.RecordBatch.from_arrays([ids, texts, pa.array(size), *map(pa.array, sums), *(pa.array(np.ascontiguousarray(maps[:, i])) for i in range(BITMAP_WORDS)), lists], ["doc_id", "h", "n", "s1", "s2", *names, "prefix"])

    schema = "doc_id long, h long, n long, s1 long, s2 long, " + ", ".join(f"{x} long" for x in names) + ", prefix array<long>"
    return docs.select("doc_id", "text", "h").mapInArrow(profile, schema)


def _marks(wanted: DataFrame) -> np.ndarray:
    """The low bits of a hash of each wanted row, or-ed over all tasks: MARK_BYTES, whatever the input."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(MARK_BYTES, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy() & (MARK_BYTES * 8 - 1)
            np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        if bits.any():
            yield packed(bits)

    return merged(wanted.select(F.xxhash64("doc_id", "h")).mapInArrow(mark, "part int, data binary"), MARK_BYTES, np.uint8, np.bitwise_or)


def _packed_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and the compressed text of the rows of docs (doc_id, text, h) that are wanted (doc_id, h, node): a set of hashes takes several times the bytes.

    A bitmap of the wanted rows leaves most other texts where they are; the join decides.
    """
    marks = docs.sparkSession.sparkContext.broadcast(_marks(wanted))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(3).to_numpy() & (MARK_BYTES * 8 - 1)
            kept = np.flatnonzero(marks.value[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            for k in range(0, len(kept), PACKED_ROWS):
                block = batch.take(pa.array(kept[k : k + PACKED_ROWS]))
                data = pa.array([zlib.compress(x.as_py() or b"") for x in block.column(2).cast(pa.binary())], pa.binary())
                yield pa.RecordBatch.from_arrays([*block.columns[:2], data], ["doc_id", "h", "data"])

    rows = docs.select("doc_id", "h", "text", F.xxhash64("doc_id", "h").alias("mark")).mapInArrow(pack, "doc_id long, h long, data binary")
    return rows.join(broadcast_if_small(wanted), ["doc_id", "h"]).select("node", "data")


def _set_of_each(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Distinct shingles of each text in order."""
    for piece in tx.pieces(texts, tx.SPACES):
        grams, of = _sets(piece, n)
        edge = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=piece.n))])
        yield from (grams[edge[d] : edge[d + 1]] for d in range(piece.n))


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that link, each verified once on the whole sets of its texts (node, data)."""
    first = texts.select(F.col("node").alias("a"), F.col("data").alias("ta")).join(broadcast_if_small(pairs), "a")
    asked = broadcast_if_small(pairs.select("b").distinct())
    second = texts.select(F.col("node").alias("b"), F.col("data").alias("tb")).join(asked, "b", "left_semi")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHECKED_PAIRS):
                block = batch.slice(at, CHECKED_PAIRS)
                both = [zlib.decompress(x.as_py()) for pair in zip(block.column(2), block.column(3)) for x in pair]
                sets = _set_of_each(pa.array(both, pa.large_binary()), n)
                linked = []
                for x, y in zip(sets, sets):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    linked.append(common * 100 >= (len(x) + len(y) - common) * percent)
                yield block.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    both = first.join(second, "b").select("a", "b", "ta", "tb")
    return durable(both.mapInArrow(check, "a long, b long").distinct(), "jaccard-links")


def _apart(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Those of ``pairs`` whose ends are not in one component yet."""
    side = lambda x: known.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    placed = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return placed.filter("ca is null or cb is null or ca != cb").select("a", "b")


def _may_link(percent: int, first_common: bool) -> Column:
    """Length and positional filters on a pair of rows x and y that share a shingle."""
    nx, ny = F.col("x.n"), F.col("y.n")
    length = F.least(nx, ny) * 100 >= F.greatest(nx, ny) * percent
    after = F.least(nx - F.col("x.pos"), ny - F.col("y.pos"))
    before = F.lit(0) if first_common else F.least("x.pos", "y.pos")
    # |x n y| >= percent (|x| + |y|) / (100 + percent)
    return length & ((after + before) * (100 + percent) >= (nx + ny) * percent)


def _size_class(n: str, percent: int) -> Column:
    """Sizes that link are of one class or of two that follow each other; classes are a little wider than the ratio, so that rounding does no harm."""
    return F.floor(F.log(F.col(n)) / (math.log(100 / min(percent, 99)) * 1.000001)).cast("int")


def _near_enough(percent: int, prefix: str = "b", words: int = BITMAP_WORDS) -> Column:
    """Suffix filter: differing parity bits are a lower bound of the symmetric difference."""
    apart = sum((F.bit_count(F.col(f"x.{prefix}{i}").bitwiseXOR(F.col(f"y.{prefix}{i}"))) for i in range(words)), F.lit(0))
    return apart * (100 + percent) <= (F.col("x.n") + F.col("y.n")) * (100 - percent)


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of ``docs`` (doc_id, text, ...)."""
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    profiles = durable(_profiles(docs, n, percent), "jaccard-profiles")
    maps = [f"b{i}" for i in range(BITMAP_WORDS)]
    with_sets = profiles.filter("n > 0 and doc_id is not null")
    # each class has a number of its own, and is read from the row (doc_id, hash of its text) with the smallest doc_id
    classes = with_sets.groupBy("s1", "s2", "n").agg(F.min(F.struct("doc_id", "h")).alias("r")).select("s1", "s2", "n", F.col("r.doc_id").alias("doc_id"), F.col("r.h").alias("h"))
    classes = durable(classes.withColumn("node", F.monotonically_increasing_id()), "jaccard-classes")
    chosen = with_sets.join(broadcast_if_small(classes), ["doc_id", "h", "s1", "s2", "n"])
    copied = not profiles.groupBy("doc_id", "h").count().filter("count > 1 and doc_id is not null").isEmpty()
    if copied:
        chosen = chosen.dropDuplicates(["node"])
    reps = chosen.select("node", F.posexplode("prefix").alias("pos", "shingle"))
    shared = reps.groupBy("shingle").agg(F.count("*").alias("c")).filter("c > 1")
    lists = reps.join(shared, "shingle").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("pos", "shingle", "c"))).alias("g"))
    cards = durable(lists.join(chosen.select("node", "n", *maps), "node"), "jaccard-cards")

    # candidates inside random blocks
    # parity bits fold: the exclusive or of the map's quarters is the map of a quarter of the size
    quarter = BITMAP_WORDS // 4
    folded = [reduce(Column.bitwiseXOR, [F.col(f"b{i + k * quarter}") for k in range(4)]).alias(f"q{i}") for i in range(quarter)]
    small = [f"q{i}" for i in range(quarter)]
    rows = cards.select("node", "n", *folded, F.explode("g").alias("g")).select("node", "n", *small, "g.pos", "g.shingle", F.pmod(F.xxhash64("node", "g.shingle"), F.ceil(F.col("g.c") / BLOCK)).alias("block"))
    x, y = rows.alias("x"), rows.alias("y")
    near = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.node") < F.col("y.node")) & _may_link(percent, False) & _near_enough(percent, "q", quarter))
    near = near.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    bits = cards.select("node", "n", *maps)
    near = near.join(bits.alias("x"), F.col("a") == F.col("x.node")).join(bits.alias("y"), F.col("b") == F.col("y.node")).filter(_near_enough(percent)).select("a", "b")
    near = durable(near, "jaccard-near")
    large = cards.filter(F.exists("g", lambda e: e["c"] > BLOCK)).select("node")
    asked = large.unionByName(near.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    wanted = durable(classes.select("doc_id", "h", "node").join(asked, "node", "left_semi"), "jaccard-ids")
    texts = _packed_texts(docs, wanted)
    texts = durable(texts.dropDuplicates(["node"]) if copied else texts, "jaccard-texts")

    # one or two partners of each class first: that connects most, and spares most other checks
    star = near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").unionByName(near.groupBy("a").agg(F.max("b").alias("b"))).distinct()
    star = durable(star, "jaccard-star")
    links = _verified(star, texts, n, percent)
    known = connected_components(links)
    rest = durable(_apart(near.join(star, ["a", "b"], "left_anti"), known), "jaccard-rest")
    links = links.unionByName(_verified(rest, texts, n, percent))
    known = connected_components(links)

    # every other candidate pair whose classes are still apart; groups of one block are done
    placed = cards.withColumn("g", F.filter("g", lambda e: e["c"] > BLOCK)).filter(F.size("g") > 0)
    placed = placed.join(known, "node", "left").withColumn("component", F.coalesce("component", "node")).withColumn("sizes", _size_class("n", percent))
    held = placed.select("component", "sizes", F.explode("g.shingle").alias("shingle")).groupBy("shingle", "component", "sizes").agg(F.count("*").alias("m"))
    held = durable(held, "jaccard-held")
    mixed = held.groupBy("shingle", "component").agg(F.sum("m").alias("m")).groupBy("shingle").agg(F.max_by("component", F.struct("m", "component")).alias("major"), F.count("*").alias("k")).filter("k > 1")
    # linked sets are of the same size class or the next, so a class of a large group is dealt to squares of X_ROWS by Y_ROWS with its neighbours only
    counts = held.join(mixed.select("shingle", "major"), "shingle").groupBy("shingle", "major", "sizes").agg(F.sum("m").alias("all"), F.coalesce(F.sum(F.when(F.col("component") != F.col("major"), F.col("m"))), F.lit(0)).alias("apart"))
    to = lambda: F.explode(F.array(F.col("sizes") - 1, F.col("sizes"), F.col("sizes") + 1)).alias("to")
    squares = counts.select("shingle", "major", "apart", "all", "sizes", to()).groupBy("shingle", "major", "to").agg(F.sum("apart").alias("xs"), F.sum(F.when(F.col("to") == F.col("sizes"), F.col("all"))).alias("ys"))
    squares = squares.filter("xs > 0 and ys > 0").select("shingle", "to", "major", F.ceil(F.col("xs") / X_ROWS).cast("int").alias("kx"), F.ceil(F.col("ys") / Y_ROWS).cast("int").alias("ky"))
    squares = durable(squares, "jaccard-squares")
    order = placed.select("node", "n", "component", "sizes", *maps, F.expr("transform(g, e -> e.shingle)").alias("s"), F.posexplode("g").alias("k", "g"))
    order = order.select("node", "n", "component", "sizes", *maps, "g.pos", "g.shingle", F.expr("slice(s, 1, k)").alias("earlier"))
    own = lambda k: F.pmod(F.xxhash64("node", "shingle"), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    # where few groups are left, the rows of all others go before anything is shuffled
    few = broadcast_if_small(squares)
    y = order.withColumn("to", F.col("sizes")).join(few, ["shingle", "to"]).withColumn("by", own("ky")).withColumn("bx", every("kx")).alias("y")
    x = order.select("*", to()).join(few, ["shingle", "to"]).filter("component != major").withColumn("bx", own("kx")).withColumn("by", every("ky")).alias("x")
    apart = (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.major")) | (F.col("x.node") < F.col("y.node")))
    square = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.to") == F.col("y.to")) & (F.col("x.bx") == F.col("y.bx")) & (F.col("x.by") == F.col("y.by"))
    far = x.join(y, square & apart & _may_link(percent, True) & _near_enough(percent) & ~F.arrays_overlap("x.earlier", "y.earlier"))
    far = far.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    far = durable(far.join(near, ["a", "b"], "left_anti"), "jaccard-far")
    links = links.unionByName(_verified(far, texts, n, percent))

    # rows that repeat a doc_id are one document: its classes are linked
    twice = durable(profiles.groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1 and doc_id is not null").select("doc_id"), "jaccard-twice")
    repeats = not twice.isEmpty()
    if repeats:
        of = with_sets.select("doc_id", "s1", "s2", "n").join(twice, "doc_id", "left_semi").distinct().join(classes.select("s1", "s2", "n", "node"), ["s1", "s2", "n"])
        of = durable(of.select("doc_id", "node"), "jaccard-repeated")
        least = of.groupBy("doc_id").agg(F.min("node").alias("a"))
        links = links.unionByName(of.join(least, "doc_id").filter("a != node").select("a", F.col("node").alias("b")))
    final = durable(connected_components(links).join(classes.select("node", "doc_id"), "node"), "jaccard-final")
    smallest = final.groupBy("component").agg(F.min("doc_id").alias("smallest"))
    linked = final.join(smallest, "component").select("node", "smallest")
    named = classes.join(linked, "node", "left").select("s1", "s2", "n", F.coalesce("smallest", "doc_id").alias("smallest"))
    out = profiles.select("doc_id", "n", "s1", "s2").join(named, ["s1", "s2", "n"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("smallest", "doc_id")).alias("component_id"))
    if repeats:
        out = durable(out, "jaccard-rows")
        one = out.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("one"))
        out = out.join(one, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("one", "component_id").alias("component_id"))
    return out
