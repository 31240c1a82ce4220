"""Operator 5: licence scans by patience alignment with templates.

A template and a stretch of a text are aligned by patience: words that occur once in both are anchors, the
longest increasing subsequence of their places keeps the order, and the gaps between anchors are aligned
the same way (a gap without anchors falls back to matching equal words at its two ends).  Coverage is the
share of the template's words that are aligned.

Templates are the full texts of ten public licences (packaged text files), their opening notices, and one-line notices.

A stretch is at most ``SLACK`` times as long as the template.  It can only reach ``coverage`` if it has that share
of the template's words, each as often as the template at most, so stretches are first looked for with that bound, on
hashed words of the whole text.  A longer stretch can align fewer words than one inside it, as words that occur once
in the shorter one may be repeated in the longer.  So for templates of up to ``EVERY`` words, every stretch within the bound is
aligned, and the best is the best of all stretches.  Longer templates have unique words enough: there the longest stretches are
aligned, those with most words first, each also where the diagonal of most of its unique words lies, and once more around its own
aligned words as long as that gains; one that shares more than half of a place that was found is not aligned again.

All hits of a document are kept: the best is taken, then the best of those that do not overlap it, and so on, and what
lies between taken hits is searched anew until nothing is found.

Defined results: each input row gives one output row; ``hits`` has all its hits by place, and licence, coverage and place
are those of the best hit.  A null or wordless text, or one without a template that reaches ``coverage``, has no hits, null
licence and place and coverage 0.  Of overlapping hits the one with most aligned words wins,
then the best coverage, then the first name, then the first place; extra columns are ignored.  Words are runs of letters, digits and
non-ASCII characters, lower-cased.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx

SLACK = 1.5
#: Templates of up to so many words are aligned with every stretch that has words enough.
EVERY = 64

#: Well-known public notices (one-line ones end in -line, longer ones in -notice).
NOTICES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-line": "under the BSD License",
    "BSD-2-Clause-line": "under the BSD 2-Clause License",
    "BSD-3-Clause-line": "under the BSD 3-Clause License",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "ISC-notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "ISC-line": "under the ISC License",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "MIT-line": "under the MIT License",
    "MPL-2.0-line": "under the Mozilla Public License 2.0",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}


def full_texts() -> dict[str, str]:
    """The packaged full texts by licence name."""
    return {p.name.removesuffix(".txt"): p.read_text() for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}


def patience_align(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places (in a, in b) of equal words, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        once_a, once_b = Counter(a[i:j]), Counter(b[k:m])
        at = {w: p for p, w in enumerate(b[k:m], k) if once_b[w] == 1}
        anchors = [(p, at[w]) for p, w in enumerate(a[i:j], i) if once_a[w] == 1 and w in at]
        if not anchors:
            continue
        # longest increasing subsequence of the places in b: piles with back links
        tops: list[int] = []
        piles: list[int] = []
        back: list[int] = []
        for n, (_, q) in enumerate(anchors):
            pile = bisect_left(tops, q)
            back.append(piles[pile - 1] if pile else -1)
            if pile == len(tops):
                tops.append(q)
                piles.append(n)
            else:
                tops[pile], piles[pile] = q, n
        kept, n = [], piles[-1]
        while n >= 0:
            kept.append(anchors[n])
            n = back[n]
        kept.reverse()
        out += kept
        left = (i, k)
        for p, q in [*kept, (j, m)]:
            todo.append((left[0], p, left[1], q))
            left = (p + 1, q + 1)
    return sorted(out)


class _Template:
    """A template's words as places in the sorted words of all templates, and how often it has each."""

    def __init__(self, name: str, words: np.ndarray, every: np.ndarray) -> None:
        self.name, self.n = name, len(words)
        at = np.searchsorted(every, words)
        self.words = at.tolist()
        self.counts = np.bincount(at, minlength=len(every))


def _hashes(text: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *(p.hashes() for p in tx.pieces(pa.array([text]), tx.NON_ALNUM))])


def _windows(words: list[int], template: _Template, needed: int) -> list[tuple[int, int, int]]:
    """(words of the template, first, last exclusive) of the longest stretches that have at least ``needed`` of its words."""
    width, most = int(template.n * SLACK) + 1, template.counts.tolist()
    spots = [i for i, w in enumerate(words) if w >= 0 and most[w]]
    seen: Counter[int] = Counter()
    out, start, common = [], 0, 0
    for end, place in enumerate(spots):
        w = words[place]
        seen[w] += 1
        common += seen[w] <= most[w]
        while spots[start] <= place - width:
            w = words[spots[start]]
            common -= seen[w] <= most[w]
            seen[w] -= 1
            start += 1
        # a stretch counts once it is about to lose a word: every other one is part of such a one
        if common >= needed and (end + 1 == len(spots) or spots[start] <= spots[end + 1] - width):
            out.append((common, spots[start], place + 1))
    return out


def _stretches(words: list[int], template: _Template, needed: int) -> Iterator[tuple[int, int]]:
    """First and last (exclusive) of every stretch that has at least ``needed`` of the template's words."""
    width, most = int(template.n * SLACK) + 1, template.counts.tolist()
    ends: dict[int, int] = {}
    for _, first, last in _windows(words, template, needed):
        # one more word at either end stands for any that are not of the template
        for a in range(max(0, first - 1), last - needed + 1):
            ends[a] = max(ends.get(a, 0), min(last + 1, len(words)))
    for a, end in ends.items():
        seen: Counter[int] = Counter()
        common = 0
        for b in range(a + 1, min(end, a + width) + 1):
            w = words[b - 1]
            if w >= 0 and most[w]:
                seen[w] += 1
                common += seen[w] <= most[w]
            if common >= needed:
                yield a, b


def _around(words: list[int], template: _Template, a: int, b: int) -> list[tuple[int, int]]:
    """The best alignment (places in the template, in the text) that a stretch leads to."""
    width = b - a
    pairs = patience_align(template.words, words[a:b])
    once = Counter(template.words)
    at = {w: p for p, w in enumerate(template.words) if once[w] == 1}
    diagonals = Counter(k - at[w] for k, w in enumerate(words[a:b], a) if w in at)
    best = [(p, a + q) for p, q in pairs]
    if diagonals:
        start = max(0, max(diagonals.items(), key=lambda x: (x[1], -x[0]))[0])
        other = [(p, start + q) for p, q in patience_align(template.words, words[start : start + template.n])]
        best = max(best, other, key=len)
    while best:
        first, last = best[0][1], best[-1][1] + 1
        again = [(p, first + q) for p, q in patience_align(template.words, words[first : min(last, first + width)])]
        if len(again) <= len(best):
            break
        best = again
    return best


def _places(words: list[int], template: _Template, coverage: float) -> set[tuple[float, int, int]]:
    """Coverage, first and last (exclusive) word of the places of the template in the text (words as places in all templates' words, or -1)."""
    found: set[tuple[float, int, int]] = set()
    least = coverage * template.n - 1e-9
    needed = max(1, int(np.ceil(least)))
    if template.n <= EVERY:
        aligned: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for a, b in _stretches(words, template, needed):
            own = tuple(words[a:b])
            if own not in aligned:
                aligned[own] = patience_align(template.words, list(own))
            pairs = aligned[own]
            if len(pairs) >= least:
                found.add((len(pairs) / template.n, a + pairs[0][1], a + pairs[-1][1] + 1))
        return found
    for _, a, b in sorted(_windows(words, template, needed), key=lambda x: (-x[0], x[1])):
        if any(2 * (min(b, last) - max(a, first)) > last - first for _, first, last in found):
            continue
        pairs = _around(words, template, a, b)
        if len(pairs) >= least:
            found.add((len(pairs) / template.n, pairs[0][1], pairs[-1][1] + 1))
    return found


def _hits(words: list[int], known: list[_Template], coverage: float) -> list[tuple[str, float, int, int]]:
    """Name, coverage, first and last (exclusive) word of the hits that do not overlap, the best one first."""
    hits: list[tuple] = []
    todo = [(0, len(words))]
    while todo:
        a, b = todo.pop()
        found = sorted((-round(share * x.n), -share, x.name, a + first, a + last) for x in known for share, first, last in _places(words[a:b], x, coverage))
        taken: list[tuple[int, int]] = []
        for hit in found:
            first, last = hit[3:]
            k = bisect_left(taken, (first, last))
            if (k == 0 or taken[k - 1][1] <= first) and (k == len(taken) or last <= taken[k][0]):
                insort(taken, (first, last))
                hits.append(hit)
        if taken:
            todo += [(p, q) for p, q in zip([a, *(last for _, last in taken)], [*(first for first, _ in taken), b], strict=True) if p < q]
    return [(name, -share, first, last) for _, share, name, first, last in sorted(hits)]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.85) -> DataFrame:
    """doc_id, license, coverage, first_word and last_word (exclusive) of the best hit, and all hits, of each row of ``docs``."""
    hit = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())])
    texts = dict(templates if templates is not None else full_texts() | NOTICES)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {name: _hashes(texts[name]) for name in sorted(texts)}
        every = np.unique(np.concatenate([np.zeros(0, np.uint64), *own.values()]))
        known = [_Template(name, words, every) for name, words in own.items() if len(words)]
        counts = np.stack([x.counts for x in known]) if known else np.zeros((0, 0), np.int64)
        needed = coverage * np.array([x.n for x in known]) - 1e-9
        for batch in batches:
            for piece in tx.pieces(batch.column(1), tx.NON_ALNUM):
                hashes = piece.hashes()
                at = np.searchsorted(every, hashes)
                at[at == len(every)] = 0
                at = np.where(every[at] == hashes, at, -1) if len(every) else np.full(len(hashes), -1)
                rows: list[tuple] = []
                for a, b in zip(piece.word_offsets[:-1].tolist(), piece.word_offsets[1:].tolist(), strict=True):
                    kinds, times = np.unique(at[a:b], return_counts=True)
                    kinds, times = kinds[kinds >= 0], times[kinds >= 0]
                    # the whole text must have the words before any stretch of it can
                    fit = np.flatnonzero(np.minimum(counts[:, kinds], times).sum(axis=1) >= needed) if known else []
                    found = _hits(at[a:b].tolist(), [known[k] for k in fit], coverage) if len(fit) else []
                    rows.append((*(found[0] if found else (None, 0.0, None, None)), [dict(zip(hit.names, x, strict=True)) for x in sorted(found, key=lambda x: x[2])]))
                columns = zip(*rows, strict=True)
                types = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.list_(hit))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.first, piece.n), *(pa.array(x, t) for x, t in zip(columns, types, strict=True))], ["doc_id", "license", "coverage", "first_word", "last_word", "hits"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, "doc_id long, license string, coverage double, first_word long, last_word long, hits array<struct<license: string, coverage: double, first_word: long, last_word: long>>")
