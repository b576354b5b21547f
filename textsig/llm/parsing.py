"""Document fingerprints by locally consistent parsing.

A document's bytes are parsed into phrases, the phrases' names into longer phrases, and so on up to one name. In each
round runs of one symbol become a single one, deterministic coin tossing (the lowest bit in which a symbol differs from its
left neighbour, and its value, four times over) gives each symbol one of six labels of which neighbours never have the same,
and a phrase begins wherever a label exceeds those on both sides. Whether a place begins a phrase thus depends on a few symbols
about it and on nothing else: equal substrings are cut alike, wherever they stand, but for their margins, and so share
the names of the phrases inside. Phrases have 2 to 11 runs (the first of a document 1 to 11).

A document's signatures are the distinct phrase names of level LEVEL (some 80 bytes each), or of its last level if it has fewer;
its root is the name of the whole, equal only for equal texts (64-bit hashes).

Defined results: a null text gives null levels, root and signatures; an empty one level 0, a null root and no signatures; every
row gives one row; null ids are carried; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec

LEVEL = 4
U = np.uint64
_RUN, _PLACE = U(0x9E3779B97F4A7C15), U(0xD1B54A32D192ED03)


def _toss(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """2 * (lowest bit in which x differs from its left neighbour) + that bit of x; the first of a row is held against its own complement."""
    differ = np.empty_like(x)
    differ[1:] = x[1:] ^ x[:-1]
    differ[first] = 1
    low = differ & (~differ + U(1))
    bit = np.frexp(low.astype(np.float64))[1].astype(np.int64) - 1
    return (2 * bit + ((x & low) != 0)).astype(np.uint64)


def parse(symbols: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names of phrases, offsets) one level up. off: where each row begins and the last ends."""
    if not len(symbols):
        return symbols, off
    some = off[:-1][np.diff(off) > 0]
    new = np.ones(len(symbols), bool)
    new[1:] = symbols[1:] != symbols[:-1]
    new[some] = True
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, len(symbols))).astype(np.uint64)
    run = symbols[at]
    off = np.searchsorted(at, off)
    first = off[:-1][np.diff(off) > 0]
    label = run
    for _ in range(4):
        label = _toss(label, first)
    label = label.astype(np.int8)
    peak = np.zeros(len(run), bool)
    peak[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    peak[first - 1] = False  # the last of the row before
    peak[-1] = False
    peak[first] = True
    start = np.flatnonzero(peak)
    size = np.diff(np.append(start, len(run)))
    place = np.arange(len(run)) - np.repeat(start, size)
    each = vec.mix(vec.mix(run + length * _RUN) + place.astype(np.uint64) * _PLACE)
    return vec.mix(np.add.reduceat(each, start) + size.astype(np.uint64)), np.searchsorted(start, off)


def fingerprints(data: np.ndarray, off: np.ndarray, level: int = LEVEL) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By row: levels, root; and signatures with their offsets."""
    rows = len(off) - 1
    levels, root = np.zeros(rows, np.int32), np.zeros(rows, np.int64)
    x, place, names, owner = data.astype(np.uint64), np.arange(rows), [], []
    keep = np.diff(off) > 0
    off, place = np.append(off[:-1][keep], off[-1]), place[keep]
    depth = 0
    while len(place):
        x, off = parse(x, off)
        depth += 1
        size = np.diff(off)
        done = size == 1
        levels[place[done]], root[place[done]] = depth, x[off[:-1][done]].view(np.int64)
        if depth == level:
            names.append(x)
            owner.append(np.repeat(place, size))
        elif depth < level:
            names.append(x[off[:-1][done]])
            owner.append(place[done])
        x = x[np.repeat(~done, size)]
        place, off = place[~done], np.concatenate([[0], np.cumsum(size[~done])])
    name, who = (np.concatenate(v) if v else np.zeros(0, t) for v, t in ((names, np.uint64), (owner, np.int64)))
    name = name.view(np.int64)
    order = np.lexsort((name, who))
    name, who = name[order], who[order]
    one = np.ones(len(name), bool)
    one[1:] = (name[1:] != name[:-1]) | (who[1:] != who[:-1])
    return levels, root, name[one], np.searchsorted(who[one], np.arange(rows + 1))


def fingerprint(docs: DataFrame, level: int = LEVEL) -> DataFrame:
    """doc_id, levels, root, signatures (distinct, ascending): a row for each of docs."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vec.sliced(batches):
            text = batch.column("text")
            for a, b, data, off in vec.chunked(text):
                levels, root, names, cut = fingerprints(data, off, level)
                null = np.asarray(text.slice(a, b - a).is_null())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(levels, mask=null), pa.array(root, mask=null | (levels == 0)), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(names), mask=pa.array(null))],
                    names=["doc_id", "levels", "root", "signatures"],
                )

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(scan, "doc_id long, levels int, root long, signatures array<long>")
