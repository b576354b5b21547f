"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared as lower-case words with single spaces between and around them. An item of n characters may
occur with up to k = floor(RATE * n) edits; it is cut into k + 1 pieces, one of which every such occurrence holds exactly.
One Aho-Corasick automaton finds the pieces of all items. A hit is verified upwards through a binary tree over the pieces,
where a node of j pieces allows j - 1 edits (if neither half kept to its share, the node can't), each time by Myers'
bit-parallel distance on a window of text; the root is the whole item with its k edits.

Items are collected and broadcast in bundles of BUNDLE characters, each with its own scan, so a benchmark of any size does.

Defined results: a null or empty text, and a null item or one without words, match nothing; null ids are carried; each
row of the documents gives its own result rows; items that repeat an item_id count as one, the least edits hold; further columns are ignored by `find` and passed through by
`clean`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import vec

RATE, BUNDLE = 0.1, 400_000
_SQUASH = np.where(vec.WORD, np.arange(256), 32).astype(np.uint8)


def normal(text: pa.Array) -> Iterator[str]:
    """Each text as ' word word ... ', one character a byte; '' for one without words."""
    for a, b, data, off in vec.chunked(pc.utf8_lower(text.fill_null("").cast(pa.large_string()))):
        x = _SQUASH[data]
        start, end, count = vec.runs(data, off, vec.WORD)
        keep = x != 32
        keep[end[end < len(x)]] = True  # the byte after a word, unless it opens the next row
        keep[off[1:-1][(off[1:-1] < len(x))]] = x[off[1:-1][(off[1:-1] < len(x))]] != 32
        size = np.concatenate([[0], np.cumsum(keep)])[off]
        squeezed = x[keep].tobytes().decode("latin-1")
        for i in range(b - a):
            s = squeezed[size[i] : size[i + 1]]
            yield f" {s.rstrip(' ')} " if count[i] else ""


def distance(masks: dict[str, int], m: int, text: str, most: int) -> int:
    """Least edit distance of the pattern to any part of text (Myers, one machine word as long as the pattern); most + 1 if it is more."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best = score
        ph <<= 1
        pv = ((mh << 1) | ~(xv | ph)) & full
        mv = ph & xv & full
    return min(best, most + 1)


class Matcher:
    def __init__(self, items: list[tuple[int | None, str]], rate: float):
        """items: (item_id, normal text)."""
        self.items = [(i, s) for i, s in items if s]
        self.pieces: list[np.ndarray] = []
        self._masks: dict[tuple[int, int, int], dict[str, int]] = {}
        found: dict[str, list[tuple[int, int]]] = {}
        for n, (_, s) in enumerate(self.items):
            k = int(rate * (len(s) - 2) + 1e-9)
            cuts = (np.arange(k + 2) * len(s) // (k + 1)).tolist()
            self.pieces.append(cuts)
            for p in range(k + 1):
                found.setdefault(s[cuts[p] : cuts[p + 1]], []).append((n, p))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def _node(self, n: int, a: int, b: int) -> tuple[dict[str, int], int]:
        s, cuts = self.items[n][1], self.pieces[n]
        masks = self._masks.get((n, a, b))
        if masks is None:
            if len(self._masks) > 50_000:
                self._masks.clear()
            masks = self._masks[n, a, b] = {}
            for i, c in enumerate(s[cuts[a] : cuts[b]]):
                masks[c] = masks.get(c, 0) | (1 << i)
        return masks, cuts[b] - cuts[a]

    def _verify(self, n: int, p: int, at: int, text: str) -> int | None:
        """Edits of item n about the place where its piece p begins in text; None if they are too many."""
        cuts = self.pieces[n]
        path, lo, hi = [], 0, len(cuts) - 1
        while hi - lo > 1:
            path.append((lo, hi))
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if p < mid else (mid, hi)
        best = 0
        for a, b in reversed(path):
            masks, m = self._node(n, a, b)
            most = b - a - 1
            left = at - (cuts[p] - cuts[a]) - most
            best = distance(masks, m, text[max(0, left) : at + cuts[b] - cuts[p] + most], most)
            if best > most:
                return None
        return best

    def matches(self, text: str) -> dict[int, int]:
        """{number of item: least edits}"""
        best: dict[int, int] = {}
        done: dict[int, list[tuple[int, int]]] = {}
        if not self.items:
            return best
        for end, (size, where) in self.automaton.iter(text):
            for n, p in where:
                at = end + 1 - size
                origin = at - self.pieces[n][p]
                if best.get(n) == 0 or any(abs(origin - o) <= e for o, e in done.get(n, ())):
                    continue
                got = self._verify(n, p, at, text)
                if got is not None:
                    best[n] = min(got, best.get(n, got))
                    done.setdefault(n, []).append((origin, 0))
        return best


def bundles(items: DataFrame, size: int) -> Iterator[list[tuple[int | None, str]]]:
    """The distinct items' ids and normal texts, in lists of bounded size but for the texts of one id; one empty list if there are none."""
    out, chars, some = [], 0, False
    rows = items.selectExpr("cast(item_id as bigint) item_id", "text").where("text is not null").distinct().orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        s = next(normal(pa.array([r.text])))
        if out and chars + len(s) > size and out[-1][0] != r.item_id:  # the texts of one id stay together
            yield out
            out, chars, some = [], 0, True
        out.append((r.item_id, s))
        chars += len(s)
    if out or not some:
        yield out


def _named(items: list[tuple[int | None, str]]) -> tuple[bytes, list[tuple[int | None, str]]]:
    """The items with a digest of them all, by which a worker knows them."""
    return hashlib.sha256(repr(items).encode("utf-8", "surrogatepass")).digest(), items


def _matcher(shared, rate: float) -> Matcher:
    name, items = shared.value
    return vec.held(("leaks", name, rate), lambda: Matcher(items, rate))


def find(docs: DataFrame, items: DataFrame, rate: float = RATE, bundle: int = BUNDLE) -> DataFrame:
    """doc_id, item_id, edits: each item that a document holds within its error budget, with the least edits of its occurrences."""
    out = None
    for some in bundles(items, bundle):
        shared = docs.sparkSession.sparkContext.broadcast(_named(some))

        def match(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = _matcher(shared, rate)
            for batch in vec.sliced(batches):
                ids, rows = batch.column("doc_id"), []
                for i, text in enumerate(normal(batch.column("text"))):
                    best: dict[int | None, int] = {}
                    for n, e in m.matches(text).items():
                        best[m.items[n][0]] = min(e, best.get(m.items[n][0], e))
                    rows += [(i, item, e) for item, e in best.items()]
                if rows:
                    i, item, e = zip(*rows)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), pa.array(item, pa.int64()), pa.array(e, pa.int32())], names=["doc_id", "item_id", "edits"])

        part = docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(match, "doc_id long, item_id long, edits int")
        out = part if out is None else out.unionAll(part)
    return out


def clean(docs: DataFrame, items: DataFrame, rate: float = RATE, bundle: int = BUNDLE) -> DataFrame:
    """The rows of docs, all columns, that hold no item."""
    for some in bundles(items, bundle):
        shared = docs.sparkSession.sparkContext.broadcast(_named(some))

        def sift(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = _matcher(shared, rate)
            for b in vec.sliced(batches):
                text = b.column(b.schema.get_field_index("text"))
                yield b.filter(pa.array([not m.matches(t) for t in normal(text)], pa.bool_()))

        docs = docs.mapInArrow(sift, docs.schema)
    return docs
