"""Token counts without token ids.

Every distinct pre-token of the corpus is counted once: tasks pass on the pre-tokens they meet, a shuffle removes what
several tasks met, and the pieces of each are counted into a table (hash of the pre-token, pieces). That table is joined to
each document's pre-token frequencies, and products are summed by document. A table of up to BROADCAST_ROWS entries (12 bytes
each; its size is checked) goes to every executor and the join is a search in sorted arrays. A larger one is cut by
hash into parts, which meet the packed frequencies of their part, and the partial sums are added up by document.

Pre-tokens are named by 64-bit hashes: with 10 ** 9 distinct ones the chance that two share a name is 3 %.

Defined results: a null text gives null counts, an empty one zeros; every row gives one row; null ids are carried; further
columns are ignored. The input must be a table or checkpoint, as it is read twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, vec
from .shared import written

BROADCAST_ROWS, PART_ROWS, REMEMBERED = 8_000_000, 2_000_000, 2_000_000


def frequencies(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, row, hash, frequency, bytes, start and end of one occurrence), sorted by hash and row."""
    for a, b, data, off in vec.chunked(column):
        start, end, count = bpe.pretokens(data, off)
        h = vec.hash_runs(data, start, end) if len(start) else np.zeros(0, np.uint64)
        row = np.repeat(np.arange(b - a), count)
        order = np.argsort(h, kind="stable")  # rows stay in order
        h, row = h[order], row[order]
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])) if len(h) else np.zeros(0, np.int64)
        yield a, b, row[first], h[first], np.diff(np.append(first, len(h))), data, start[order[first]], end[order[first]]


def distinct_pretokens(docs: DataFrame) -> DataFrame:
    """h, piece: every pre-token of the texts once."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.uint64)
        for batch in vec.sliced(batches):
            for _, _, _, h, _, data, start, end in frequencies(batch.column("text")):
                if not len(h):
                    continue
                one = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                if len(seen):
                    at = np.minimum(np.searchsorted(seen, h[one]), len(seen) - 1)
                    one = one[seen[at] != h[one]]
                if not len(one):
                    continue
                raw = data.tobytes()
                pieces = [raw[a:b] for a, b in zip(start[one].tolist(), end[one].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(h[one].view(np.int64)), pa.array(pieces, pa.binary())], names=["h", "piece"])
                seen = np.sort(np.concatenate([seen, h[one]]), kind="stable") if len(seen) < REMEMBERED else np.zeros(0, np.uint64)

    return docs.select("text").mapInArrow(scan, "h long, piece binary").groupBy("h").agg(F.first("piece").alias("piece"))


def piece_counts(pieces: DataFrame, path: str = bpe.RANKS) -> DataFrame:
    """h, n: the number of tokens of each pre-token."""
    shared = pieces.sparkSession.sparkContext.broadcast(bpe.load(path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell = bpe.encoder(shared.value).transducer
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("h"), pa.array([len(spell.encode(p)) for p in b.column("piece").to_pylist()], pa.int32())], names=["h", "n"])

    return pieces.mapInArrow(count, "h long, n int")


def _summed(column: pa.Array, sums: list[np.ndarray], sizes: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    null = np.asarray(column.is_null())
    join = lambda x: pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64), mask=null)
    return join(sizes), join(sums)


def count_tokens(docs: DataFrame, path: str = bpe.RANKS, broadcast_rows: int = BROADCAST_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """doc_id, n_pretokens, n_tokens: a row for each of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = written(piece_counts(distinct_pretokens(docs), path), "count-pieces")
    entries = table.count()
    if entries <= broadcast_rows:
        got = table.toArrow()
        h = got.column("h").to_numpy().view(np.uint64)
        order = np.argsort(h)
        shared = docs.sparkSession.sparkContext.broadcast((h[order], got.column("n").to_numpy().astype(np.int32)[order]))
        del got, h, order

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, pieces = shared.value
            for batch in vec.sliced(batches):
                sums, sizes = [], []
                for a, b, row, h, f, *_ in frequencies(batch.column("text")):
                    n = pieces[np.searchsorted(names, h)] if len(h) else np.zeros(0)
                    sums.append(np.bincount(row, n * f, b - a))
                    sizes.append(np.bincount(row, f, b - a))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_summed(batch.column("text"), sums, sizes)], names=["doc_id", "n_pretokens", "n_tokens"])

        return docs.mapInArrow(add, "doc_id long, n_pretokens long, n_tokens long")

    parts = 1 + entries // part_rows
    numbered = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vec.sliced(batches):
            ids = batch.column("row_id").to_numpy()
            for a, b, row, h, f, *_ in frequencies(batch.column("text")):
                part = np.mod(h.view(np.int64), parts)
                order = np.argsort(part, kind="stable")
                cut = np.searchsorted(part[order], np.arange(parts + 1))
                some = np.flatnonzero(np.diff(cut))
                pieces = [order[cut[p] : cut[p + 1]] for p in some]
                columns = [[int(p) for p in some], [ids[a + row[o]].tobytes() for o in pieces], [h[o].tobytes() for o in pieces], [f[o].astype(np.int32).tobytes() for o in pieces]]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["part", "ids", "names", "freq"])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        names, pieces = right.column("h").to_numpy().view(np.uint64), right.column("n").to_numpy()
        order = np.argsort(names)
        names, pieces, ids, sums = names[order], pieces[order], [], []
        for i, h, f in zip(left.column("ids"), left.column("names"), left.column("freq")):
            who, back = np.unique(np.frombuffer(i.as_py(), np.int64), return_inverse=True)
            n = pieces[np.searchsorted(names, np.frombuffer(h.as_py(), np.uint64))]
            f = np.frombuffer(f.as_py(), np.int32)
            ids.append(who)
            sums.append(np.stack([np.bincount(back, f), np.bincount(back, n * f)]).astype(np.int64))
        if not ids:
            return pa.table({"row_id": pa.array([], pa.int64()), "p": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        s = np.concatenate(sums, axis=1)
        return pa.table({"row_id": np.concatenate(ids), "p": s[0], "n": s[1]})

    packed = numbered.select("row_id", "text").mapInArrow(pack, "part int, ids binary, names binary, freq binary")
    cut = table.withColumn("part", F.pmod("h", F.lit(parts)).cast("int"))
    met = packed.groupBy("part").cogroup(cut.groupBy("part")).applyInArrow(meet, "row_id long, p long, n long")
    sums = met.groupBy("row_id").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    there = numbered.select("row_id", "doc_id", F.col("text").isNotNull().alias("there"))
    some = lambda c: F.when(F.col("there"), F.coalesce(c, F.lit(0)))
    return there.join(sums, "row_id", "left").select("doc_id", some("p").alias("n_pretokens"), some("n").alias("n_tokens"))
