"""Operator 13: fill-in-the-middle transformation; cuts are found with a Fenwick tree over blocks of text.

A text is a run of units (``[A-Za-z]+`` or one other code point).  Two units, drawn from a hash of the doc_id, end
the prefix and the middle.  The text is laid out as prefix, suffix, middle (psm) or suffix, prefix, middle (spm) behind
marks, or stays plain.

The text's UTF-8 bytes are dealt into blocks of fixed size.  A Fenwick tree holds, for each block, how many units and how
many code points begin in it.  Binary lifting goes down the tree to the block in which a cut's unit begins, and
carries the code points before that block along; the place inside the block is then found in that block alone.
``append`` and ``replace_block`` keep the tree up to date in logarithmic time where a text is edited in place.

Everything is per row, so nothing is shuffled; a task holds one Arrow batch.

Defined results: a null or empty text is plain with n = 0.  A text that holds a mark is plain, so that every other output can be
taken apart again.  A null doc_id counts as an empty decimal.  Rows that repeat a doc_id are cut by the same draws.  Extra
columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a block.
BLOCK = 1024

_LETTER = np.zeros(256, bool)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = True


def begins(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each byte of a UTF-8 text: does a unit begin there, and does a code point."""
    point = (data & 0xC0) != 0x80
    letter = _LETTER[data]
    unit = point.copy()
    unit[1:] &= ~(letter[1:] & letter[:-1])
    return unit, point


class UnitIndex:
    """A Fenwick tree over the blocks of a text: counts of units and of code points that begin in each."""

    def __init__(self, data: np.ndarray, block: int = BLOCK) -> None:
        self.data, self.block = data, block
        self.blocks = max(1, -(-len(data) // block))
        unit, point = begins(data)
        at = np.arange(0, len(data), block)
        counts = np.stack([np.add.reduceat(x, at, dtype=np.int64) if len(at) else np.zeros(1, np.int64) for x in (unit, point)], axis=1)
        total = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(counts, axis=0)])
        k = np.arange(self.blocks + 1)
        #: Node k holds the sums of the blocks from k - (lowest bit of k) on, up to block k - 1.
        self.tree = total - total[k - (k & -k)]
        self.units, self.points = (int(x) for x in total[-1])

    def add(self, block: int, units: int, points: int) -> None:
        """Change a block's counts in every node that covers it."""
        k = block + 1
        while k <= self.blocks:
            self.tree[k] += (units, points)
            k += k & -k
        self.units += units
        self.points += points

    def _own(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Beginnings inside one block; the byte before it decides whether a run of letters goes on."""
        start = block * self.block
        first = max(0, start - 1)
        unit, point = begins(self.data[first : start + self.block])
        return unit[start - first :], point[start - first :]

    def replace_block(self, block: int, data: bytes) -> None:
        """Overwrite a block by as many bytes of whole code points; the next block's first unit may change with it."""
        touched = [k for k in (block, block + 1) if k < self.blocks]
        before = [[int(x.sum()) for x in self._own(k)] for k in touched]
        self.data = self.data.copy()
        self.data[block * self.block : block * self.block + len(data)] = np.frombuffer(data, np.uint8)
        for k, (units, points) in zip(touched, before):
            unit, point = self._own(k)
            self.add(k, int(unit.sum()) - units, int(point.sum()) - points)

    def append(self, data: bytes) -> None:
        """More text at the end; a node of a new block sums the nodes below it."""
        old = len(self.data)
        self.data = np.concatenate([self.data, np.frombuffer(data, np.uint8)])
        full = max(1, -(-len(self.data) // self.block))
        last = self.blocks - 1
        known = self._prefix(self.blocks) - self._prefix(last)
        unit, point = self._own(last)
        self.add(last, int(unit.sum()) - int(known[0]), int(point.sum()) - int(known[1]))
        if full > self.blocks:
            self.tree = np.concatenate([self.tree, np.zeros((full - self.blocks, 2), np.int64)])
            for k in range(self.blocks + 1, full + 1):
                unit, point = self._own(k - 1)
                own = np.array([int(unit.sum()), int(point.sum())])
                self.tree[k] = own + self._prefix(k - 1) - self._prefix(k - (k & -k))
                self.units += int(own[0])
                self.points += int(own[1])
            self.blocks = full
        assert len(self.data) == old + len(data)

    def _prefix(self, k: int) -> np.ndarray:
        """Units and code points that begin in the first k blocks."""
        total = np.zeros(2, np.int64)
        while k:
            total += self.tree[k]
            k -= k & -k
        return total

    def cut(self, k: int) -> tuple[int, int]:
        """Where the first k units end: in bytes and in code points."""
        if k <= 0:
            return 0, 0
        if k >= self.units:
            return len(self.data), self.points
        # unit k (from 0) begins where the first k end: the last block with at most k units before it
        block, left, points = 0, k, 0
        step = 1 << (self.blocks.bit_length() - 1)
        while step:
            if block + step <= self.blocks and self.tree[block + step, 0] <= left:
                block += step
                left -= int(self.tree[block, 0])
                points += int(self.tree[block, 1])
            step >>= 1
        unit, point = self._own(block)
        at = int(np.flatnonzero(unit)[left])
        return block * self.block + at, points + int(np.count_nonzero(point[:at]))


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 from the hash of a doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 1, rate: int = 90, spm: int = 20, block: int = BLOCK) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output of each row of ``docs`` (doc_id, text, ...).

    ``rate`` percent of the texts are rearranged, ``spm`` percent of those with the suffix first.
    """
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def arrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, s, m = marks
        for batch in batches:
            ns, forms, prefixes, middles, outputs = [], [], [], [], []
            h = [batch.column(2 + k).to_numpy() for k in range(4)]
            for i, text in enumerate(batch.column(1).cast(pa.large_binary())):
                raw = text.as_py()
                index = UnitIndex(np.frombuffer(raw, np.uint8), block)
                ns.append(index.units)
                if not raw or any(x in raw for x in marks) or h[2][i] % 100 >= rate:
                    forms.append("plain")
                    prefixes.append(None)
                    middles.append(None)
                    outputs.append(raw)
                    continue
                (a, a_points), (b, b_points) = (index.cut(int(k)) for k in sorted((h[0][i] % (index.units + 1), h[1][i] % (index.units + 1))))
                first = h[3][i] % 100 < spm
                forms.append("spm" if first else "psm")
                prefixes.append(a_points)
                middles.append(b_points - a_points)
                outputs.append(s + raw[b:] + p + raw[:a] + m + raw[a:b] if first else p + raw[:a] + s + raw[b:] + m + raw[a:b])
            columns = [pa.array(ns, pa.int64()), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()), pa.array(outputs, pa.large_binary()).cast(pa.large_string()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    drawn = draws(F.col("doc_id"), seed)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *(d.alias(f"h{k}") for k, d in enumerate(drawn)))
    return rows.mapInArrow(arrange, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made of, taken apart at its marks."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        one = F.substr(output, F.lit(len(PREFIX) + 1))
        a = F.substring_index(one, first, 1)
        two = F.substr(one, F.length(a) + len(first) + 1)
        b = F.substring_index(two, second, 1)
        return a, b, F.substr(two, F.length(b) + len(second) + 1)

    prefix, suffix, middle = parts(SUFFIX, MIDDLE)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(PREFIX, MIDDLE)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


def middle_digests(docs: DataFrame, seed: int = 1, rate: int = 90, spm: int = 20) -> DataFrame:
    """``fill_in_middle`` with the digests of its outputs and of the texts taken back from them, instead of the outputs."""
    found = fill_in_middle(docs, seed, rate, spm)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
