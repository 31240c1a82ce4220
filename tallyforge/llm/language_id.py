"""Operator 8: language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 (seeded by its code point).  A run of ``n`` letters is bound
into one vector: the letters' vectors, rotated by their distance from the run's end, multiplied
element by element.  A document is bundled as the sum of its runs' vectors, a language prototype as the
sum over all its training documents, and a document takes the language whose prototype has the largest
cosine with it.  Letters are lower-cased; a stretch of anything else is one boundary letter.

Sums are linear, so tasks count runs first and multiply once, a bounded block of distinct runs at a time; prototypes
are summed by Spark per (language, dimension), a table of languages x dimensions whatever the input.  A text begins and
ends with boundary letters, so that one letter already makes a run.

Defined results: a null text, or one without a letter, is ``und`` with score 0, and so is any text when nothing was learned; documents with a null language,
or without letters, teach nothing; ties go to the language that sorts first; each input row gives one
output row; extra columns are ignored.  The score is the cosine, 0 if it is negative.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as tx

DIMENSIONS = 1024
UNKNOWN = "und"
#: Languages that a model may have; a table with more distinct values is refused.
MAX_LANGUAGES = 1000
#: Documents and distinct runs that are multiplied at once.
_BLOCK, _RUNS = 256, 8192


class _Letters:
    """Lower-case letter of each code point (0: none), and the letters' random vectors."""

    def __init__(self) -> None:
        self.lower = np.zeros(0x110000, np.int32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                self.lower[c] = ord(low) if len(low) == 1 else c
        self.vectors: dict[tuple[int, int], np.ndarray] = {}

    def vector(self, letter: int, dimensions: int) -> np.ndarray:
        key = (letter, dimensions)
        if key not in self.vectors:
            self.vectors[key] = np.random.Generator(np.random.PCG64([8128, letter])).integers(0, 2, dimensions, np.int8) * 2 - 1
        return self.vectors[key]


_letters: list[_Letters] = []


def _alphabet() -> _Letters:
    if not _letters:
        _letters.append(_Letters())
    return _letters[0]


def _runs(piece: tx.Piece, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct letters, the runs as base-(number of letters) numbers, and each run's document."""
    points = np.frombuffer(piece.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((piece.data & 0xC0) != 0x80)])
    size = np.diff(lead[piece.offsets])
    if len(points) != size.sum():  # not valid UTF-8: decode one by one
        each = [np.frombuffer(piece.data[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for a, b in zip(piece.offsets[:-1], piece.offsets[1:], strict=True)]
        points, size = np.concatenate(each), np.array([len(x) for x in each], np.int64)
    # boundaries before and behind each document
    pad, edge = n // 2, np.concatenate([[0], np.cumsum(size)])
    low = np.insert(_alphabet().lower[points], np.repeat(edge, [pad, *[2 * pad] * (piece.n - 1), pad]), 0)
    doc = np.repeat(np.arange(piece.n), size + 2 * pad)
    begin = edge[:-1] + 2 * pad * np.arange(piece.n)
    keep = low > 0
    keep[1:] |= (low[:-1] > 0) & (doc[1:] == doc[:-1])  # one boundary behind each stretch of letters
    for k in range(pad):
        keep[begin + k] = True
        if k:
            keep[begin + size + 2 * pad - k] = True
    keep &= (np.bincount(doc[low > 0], minlength=piece.n) > 0)[doc]
    low, doc = low[keep], doc[keep]
    letters, index = np.unique(low, return_inverse=True)
    m = max(0, len(low) - n + 1)
    code = np.zeros(m, np.int64)
    for j in range(n):
        code = code * len(letters) + index[j : j + m]
    inside = doc[:m] == doc[n - 1 :] if m else np.zeros(0, bool)
    return letters, code[inside], doc[:m][inside]


def _bundled(piece: tx.Piece, n: int, dimensions: int, group_of: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the runs' vectors of each group of a piece's documents, and the groups that have a run."""
    out = np.zeros((groups, dimensions))
    letters, code, doc = _runs(piece, n)
    group = group_of[doc]
    if not len(code):
        return out, np.zeros(0, np.int64)
    seen = np.unique(group)
    runs, code = np.unique(code, return_inverse=True)
    table = np.stack([_alphabet().vector(int(c), dimensions) for c in letters])
    order = np.lexsort((group, code // _RUNS))
    code, group = code[order], group[order]
    for first in range(0, len(runs), _RUNS):
        own = runs[first : first + _RUNS].copy()
        vectors = np.ones((len(own), dimensions), np.int8)
        for distance in range(n):
            vectors *= np.roll(table, distance, axis=1)[own % len(letters)]
            own //= len(letters)
        vectors = vectors.astype(np.float32)
        i, j = np.searchsorted(code // _RUNS, [first // _RUNS, first // _RUNS + 1])
        for a in range(0, groups, _BLOCK):
            b = min(groups, a + _BLOCK)
            p, q = i + np.searchsorted(group[i:j], [a, b])
            if p < q:
                counts = np.bincount((group[p:q] - a) * len(vectors) + code[p:q] - first, minlength=(b - a) * len(vectors))
                out[a:b] += counts.reshape(b - a, len(vectors)).astype(np.float32) @ vectors
    return out, seen


def in_fold(doc_id: Column) -> Column:
    """Is the document held out: crc32 of its id as text, modulo 4, is 2 (a null id is not)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learn_prototypes(docs: DataFrame, n: int = 3, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Language prototypes from all rows of docs (text, lang)."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for piece in tx.pieces(batch.column(0), tx.SPACES, lower=False):
                own = langs[piece.first : piece.first + piece.n]
                names = sorted(set(own))
                place = {x: k for k, x in enumerate(names)}
                sums, _ = _bundled(piece, n, dimensions, np.array([place[x] for x in own]), len(names))
                for lang, row in zip(names, sums, strict=True):
                    total[lang] = total.get(lang, 0) + row
        if total:
            names = sorted(total)
            values = np.concatenate([np.rint(total[x]).astype(np.int64) for x in names])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, dimensions).tolist(), pa.string()), pa.array(np.tile(np.arange(dimensions), len(names)), pa.int32()), pa.array(values)], ["lang", "dim", "value"])

    summed = docs.filter("text is not null and lang is not null").select("text", "lang").mapInArrow(bundle, "lang string, dim int, value long").groupBy("lang", "dim").agg(F.sum("value").alias("value"))
    found: dict[str, np.ndarray] = {}
    for row in summed.limit(MAX_LANGUAGES * dimensions + 1).collect():
        found.setdefault(row["lang"], np.zeros(dimensions, np.int64))[row["dim"]] = row["value"]
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return {x: v for x, v in found.items() if v.any()}


def predict_language(docs: DataFrame, prototypes: dict[str, np.ndarray], n: int = 3, dimensions: int = DIMENSIONS) -> DataFrame:
    """``docs`` columns doc_id, with lang_pred and score, for each row."""
    names = sorted(prototypes)
    matrix = np.stack([prototypes[x] / np.linalg.norm(prototypes[x].astype(np.float64)) for x in names], axis=1) if names else np.zeros((dimensions, 0))
    model = docs.sparkSession.sparkContext.broadcast(matrix.astype(np.float32))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            for piece in tx.pieces(batch.column(1), tx.SPACES, lower=False):
                bundled, seen = _bundled(piece, n, dimensions, np.arange(piece.n), piece.n)
                if names and len(seen):
                    size = np.linalg.norm(bundled[seen], axis=1)
                    cosine = (bundled[seen] @ model.value) / np.maximum(size, 1e-9)[:, None]
                    best = cosine.argmax(axis=1)
                    langs[piece.first + seen] = np.array(names, object)[best]
                    scores[piece.first + seen] = np.clip(cosine[np.arange(len(seen)), best], 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs.tolist(), pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")


def identify_languages(docs: DataFrame, n: int = 3, dimensions: int = DIMENSIONS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row; learned from the rows that are not held out."""
    prototypes = learn_prototypes(docs.filter(~in_fold(F.col("doc_id"))), n, dimensions)
    found = predict_language(docs, prototypes, n, dimensions)
    return found.select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def language_bounds(found: DataFrame, share: float = 0.1) -> DataFrame:
    """lang_pred and bound, from rows of ``identify_languages``: that share of the median score of the training rows.

    A text of fifty words in a learned language scores well above it; one in none of them has a cosine near zero.  The
    median does not mind the few training rows that are in no learned language.
    """
    taught = found.filter((F.col("lang_pred") != UNKNOWN) & ~F.col("held_out"))
    return taught.groupBy("lang_pred").agg((F.percentile_approx("score", 0.5, 10_000) * share).alias("bound"))
