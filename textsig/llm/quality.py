"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A bounded sample of the labelled documents (SAMPLE rows, a documented parameter) is the labelled set. Terms (words,
their first bytes, runs of punctuation, and marks for words in capitals and for the share of words said twice) are weighted by how far the sample's labels
depend on them, the weighted term matrix is reduced by a singular value decomposition, and the sample's vectors in that
latent space go to all executors. Their size is bounded by SAMPLE x DIMS numbers. Every document's exact cosines with all of
them are blocked matrix products; its K nearest (all of those tied with the K-th too) vote with weight cosine ** POWER.

Defined results: a null or empty text has only the constant term and is judged by the sample's plainest documents; a
document without doc_id is judged like any other; repeated rows are judged alike, row by row; of several labels of a document the worst
counts (least quality, greatest toxic); without labels both votes are null and everything is kept. Further columns of
the input are ignored by `classify` and passed through by `keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec

SAMPLE, TERMS, DIMS, K, POWER = 4096, 1024, 48, 25, 4
_PUNCT = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
_CAPS, _TWICE, _BIAS = (np.uint64(x) for x in (11, 20, 13))
STEMS, _STEM = (4, 5, 6), np.uint64(0x5BD1E995)


def _terms(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, row, term hash) for each occurrence of a term."""
    lower = pc.utf8_lower(column.fill_null("").cast(pa.large_string()))
    raw, raw_off = vec.strings(column)
    for a, b, data, off in vec.chunked(lower):
        start, end, n = vec.runs(data, off, vec.WORD)
        total = vec.prefix_sums(data)
        h = vec.hash_between(total, start, end)
        row = np.repeat(np.arange(b - a), n)
        ps, pe, pn = vec.runs(data, off, _PUNCT)
        rows, terms = [row, np.repeat(np.arange(b - a), pn)], [h, vec.hash_between(total, ps, np.minimum(pe, ps + 4))]
        for stem in STEMS:
            longer = np.flatnonzero(end - start > stem)
            rows.append(row[longer])
            terms.append(vec.hash_between(total, start[longer], start[longer] + stem) ^ _STEM)
        if len(h) > 1:
            again = np.flatnonzero((h[1:] == h[:-1]) & (row[1:] == row[:-1])) + 1
            share = (10 * np.bincount(row[again], minlength=b - a)) // np.maximum(n, 1)
            rows.append(np.flatnonzero(share))
            terms.append(_TWICE + share[share > 0].astype(np.uint64))
        # words in capitals, by their places in the text as it is: folding may change a letter's number of bytes
        own = raw[raw_off[a] : raw_off[b]]
        s, e, n = vec.runs(own, raw_off[a : b + 1] - raw_off[a], vec.WORD)
        capital = np.concatenate([[0], np.cumsum((own >= 65) & (own <= 90), dtype=np.int64)])
        caps = np.flatnonzero((capital[e] - capital[s] >= 2) & (capital[e] - capital[s] == e - s))
        rows.append(np.repeat(np.arange(b - a), n)[caps])
        terms.append(np.full(len(caps), _CAPS))
        rows.append(np.arange(b - a))
        terms.append(np.full(b - a, _BIAS))
        yield a, b, np.concatenate(rows), np.concatenate(terms)


def _counts(row: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, index, occurrences) of distinct (row, index) pairs; indices under 2 ** 31."""
    key, n = np.unique((row.astype(np.int64) << 31) | term.astype(np.int64), return_counts=True)
    return key >> 31, key & ((1 << 31) - 1), n


class Model:
    """What a task needs: sorted term hashes, their rows of the projection, the sample's unit vectors and labels."""

    def __init__(self, texts: list[str | None], quality: np.ndarray, toxic: np.ndarray, terms: int, dims: int):
        column = pa.array(texts, pa.large_string())
        rows, hashes = [], []
        for a, _, row, term in _terms(column):
            rows.append(row + a)
            hashes.append(term)
        row, (vocabulary, term) = np.concatenate(rows), np.unique(np.concatenate(hashes), return_inverse=True)
        row, term, n = _counts(row, term)
        size = len(vocabulary)
        df = np.bincount(term, minlength=size)
        weight = np.zeros(size)
        for y in (1 - quality, toxic):
            pos, total = np.bincount(term[y[row] == 1], minlength=size), max(1, int(y.sum()))
            p, q = (pos + 0.5) / (total + 1), (df - pos + 0.5) / (len(y) - total + 1)
            var = 1 / (pos + 0.5) + 1 / (df - pos + 0.5)
            z = np.abs(np.log(p / q)) / np.sqrt(var)
            weight = np.maximum(weight, np.where((df >= 3) & (z >= 3.0), np.abs(np.log(p / q)), 0))
        bias = np.searchsorted(vocabulary, _BIAS)
        weight[bias] = 1.0
        score = weight * np.sqrt(np.minimum(df, len(texts) - df + 1))
        score[bias] = np.inf
        order = np.lexsort((vocabulary, -score))[:terms]
        chosen = np.sort(order[weight[order] > 0])
        self.vocabulary, self.weight = vocabulary[chosen], weight[chosen].astype(np.float32)
        x = np.zeros((len(texts), len(chosen)), np.float32)
        at = np.searchsorted(chosen, term)
        hit = (at < len(chosen)) & (chosen[np.minimum(at, len(chosen) - 1)] == term)
        x[row[hit], at[hit]] = (1 + np.log(n[hit])) * self.weight[at[hit]]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        values, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
        self.basis = np.ascontiguousarray(vectors[:, ::-1][:, : min(dims, int((values > 1e-8).sum()))]).astype(np.float32)
        self.points = _unit(x @ self.basis)
        self.labels = np.stack([quality, toxic], axis=1).astype(np.float32)

    def vectors(self, column: pa.Array) -> np.ndarray:
        """The documents' unit vectors in the latent space."""
        out = np.zeros((len(column), self.basis.shape[1]), np.float32)
        maybe = np.zeros(1 << 16, bool)
        maybe[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
        for a, b, row, term in _terms(column):
            some = np.flatnonzero(maybe[(term & np.uint64(0xFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.vocabulary, term[some]), len(self.vocabulary) - 1)
            hit = self.vocabulary[at] == term[some]
            r, t, n = _counts(row[some[hit]], at[hit])
            if len(r):
                part = self.basis[t] * ((1 + np.log(n)) * self.weight[t]).astype(np.float32)[:, None]
                first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
                out[a + r[first]] = np.add.reduceat(part, first, axis=0)
        return _unit(out)

    def votes(self, column: pa.Array, k: int = K, block: int = 1024) -> np.ndarray:
        """(quality, toxic) votes in 0..1 of each document."""
        x, out = self.vectors(column), np.zeros((len(column), 2))
        k = min(k, len(self.points))
        for a in range(0, len(x), block):
            near = x[a : a + block] @ self.points.T
            kth = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k, None]
            w = np.where(near >= kth - 1e-6, np.maximum(near, 1e-3), 0) ** POWER
            out[a : a + block] = (w @ self.labels) / w.sum(axis=1, keepdims=True)
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: int = TERMS, dims: int = DIMS) -> Model | None:
    """The model of the `sample` labelled documents that come first in the order of a hash of their doc_id; None without labels."""
    lab = labels.select("doc_id", "quality", "toxic").dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    chosen = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality", "toxic").agg(F.min("text").alias("text"))  # broadcast of `sample` rows at most
    rows = sorted(found.collect(), key=lambda r: r.doc_id)
    if not rows:
        return None
    return Model([r.text for r in rows], np.array([int(r.quality > 0) for r in rows]), np.array([int(r.toxic > 0) for r in rows]), terms, dims)


def classify(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """doc_id, quality_vote, toxic_vote, quality, toxic, keep: one row for each of docs. keep: quality of 0.5 and not toxic of 0.5."""
    model = fit(docs, labels, **parameters)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in vec.sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *_verdict(shared.value, b.column("text"))], names=["doc_id", "quality_vote", "toxic_vote", "quality", "toxic", "keep"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(judge, "doc_id long, quality_vote double, toxic_vote double, quality int, toxic int, keep boolean")


def _verdict(model: Model | None, text: pa.Array) -> list[pa.Array]:
    n = len(text)
    if model is None:
        return [pa.nulls(n, pa.float64())] * 2 + [pa.nulls(n, pa.int32())] * 2 + [pa.array([True] * n, pa.bool_())]
    v = np.round(model.votes(text), 6)
    good, bad = v[:, 0] >= 0.5, v[:, 1] >= 0.5
    return [pa.array(v[:, 0]), pa.array(v[:, 1]), pa.array(good.astype(np.int32)), pa.array(bad.astype(np.int32)), pa.array(good & ~bad)]


def keep_good(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """The rows of docs, all columns, whose text is of quality and not toxic."""
    model = fit(docs, labels, **parameters)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in vec.sliced(batches):
            yield b.filter(_verdict(shared.value, b.column(b.schema.get_field_index("text")))[-1])

    return docs.mapInArrow(sift, docs.schema)
