"""N-gram Jaccard join: all pairs of documents whose sets of word n-grams have a Jaccard similarity of THRESHOLD or more.

Universe partition with pigeonhole. Sets fall into size bands (a factor of 4 each). The scheme of a band cuts the hash
universe into m segments; a set meets partners of its own band there, and those of the next band in that band's scheme.
A pair of Jaccard t or more differs in at most D = (1-t)/(1+t) * (|x|+|y|) n-grams, so:

* k of the segments are indexed with their one-deletion neighbourhood; a pair without a hit there spends 2k of D;
* of the other, non-empty segments each set indexes the D-2k+1 cheapest of one global order (corpus frequency of the
  rarest n-gram, from a count sketch over all documents, then hash). If x and y shared none of these, D-2k+1 of x's segments
  would differ from y's, one n-gram each, which is more than is left.

One entry is often shared by chance, the more often the more sets there are. Where nearly every segment has one n-gram and k is 0, sets of LONG n-grams or more
therefore index SHARED - 1 entries more, and a pair of two of these must share SHARED: the first SHARED segments that the two have in common
have at most D others before them in either, so they are among those indexed in both. Shared entries are added up over all parts of the index.

Sets that share an entry are held against each other there and then, where they are few, by size. A pair need only be found by the
first entries in the global order that its sets share, so an entry counts no longer for a pair whose sets have too many segments of
one n-gram before it: all but the shared ones among the first SHARED are differences. An entry
travels with its place, six bytes in all, and the fingerprint and size of a set once for all of its entries in one part of the index: from 7 bytes an
entry where there are few parts to 20 where there are as many as a set has entries.

m and k of each band minimise the expected index entries plus expected hits (`allocate`). Candidates that share an entry gather in blocks named
by the least fingerprint; blocks over TILE sets or TILE_BYTES are cut into tiles, each pair of which is one piece of work. There first the
sets' n-gram counts by hash bucket are compared, whose difference is at most that of the sets: what these leave of a block's pairs
links sets to new, smaller blocks, at a sixteenth of the bytes; then every pair in these is verified exactly by products of 0/1
matrices of the n-grams (48-bit hashes). What is asked of the pairs (`links`, `keep_one`) is counted where they are verified, so
that a group of near copies is never written out as pairs.

Equal sets have one fingerprint and travel once.

Defined results: a text of fewer than n words has one n-gram, of all its words; a null, empty or wordless text matches
nothing; rows without doc_id are in no pair; rows that repeat a doc_id pair with others once, never with each other; further columns are ignored.
The input must be a table or checkpoint, as it is read three times and rows are known by their place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .shared import written

N, THRESHOLD = 2, 0.7
BANDS = 24
#: Buckets of the count sketch, in chunks of CHUNK, of which FAN are added up at a time.
SKETCH, CHUNK, FAN = 1 << 24, 1 << 16, 64
#: Index entries in a part, sets and bytes of sets in a tile of a block, bytes of sets in a group of blocks, and row ids that may be broadcast (8 bytes each).
ENTRIES, TILE, TILE_BYTES, GROUP_BYTES, BROADCAST_ROWS = 4_000_000, 8192, 16_000_000, 12_000_000, 4_000_000
#: Sets that are held against each other in one matrix product.
SQUARE = 512
#: Index entries, and n-grams to be counted, that a task holds before it packs them.
PACK, COUNT = 1 << 20, 1 << 22
#: Sets of an index entry up to which its pairs are compared one by one.
FEW = 128
#: Entries that sets of LONG n-grams or more share, if they are a pair.
SHARED, LONG = 3, 16
#: Turns in which a part of the index is worked off, for the sake of memory.
SLICES = 4
U = np.uint64


def _sets(text: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, row, sorted distinct n-gram, size by row)."""
    for a, b, data, off in vec.chunked(pc.utf8_lower(text.fill_null("").cast(pa.large_string())), rows=4095):
        start, end, count = vec.runs(data, off, vec.WORD)
        row, h = vec.distinct(*vec.grams(vec.hash_runs(data, start, end), count, n))
        yield a, b, row, h, np.bincount(row, minlength=b - a)


def _fingerprints(row: np.ndarray, h: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = np.zeros(len(size), np.uint64)
    some = np.flatnonzero(size)
    if len(some):
        out[some] = np.add.reduceat(vec.mix(h * U(0x9E3779B97F4A7C15)), (np.cumsum(size) - size)[some])
    return vec.mix(out + size.astype(np.uint64)).view(np.int64)


def _bits(size: np.ndarray) -> np.ndarray:
    """log2 of the number of buckets of a set's profile: two to four n-grams a bucket."""
    return np.clip(np.floor(np.log2(np.maximum(size, 1)) + 1e-12).astype(np.int64) - 1, 3, 12)


def _profiles(row: np.ndarray, h: np.ndarray, size: np.ndarray) -> list[bytes]:
    """Each set's number of n-grams by bucket (upper bits of the hash), 255 at most."""
    bits = _bits(size)
    ends = np.concatenate([[0], np.cumsum(1 << bits)])
    at = ends[row] + (h >> (U(48) - bits[row].astype(np.uint64))).astype(np.int64)
    data = np.minimum(np.bincount(at, minlength=ends[-1]), 255).astype(np.uint8).tobytes()
    return [data[ends[i] : ends[i + 1]] if size[i] else b"" for i in range(len(size))]


def _possible(profiles: list[bytes], size: np.ndarray, threshold: float) -> np.ndarray:
    """The least place that each set is linked with, by way of others too, by pairs that their profiles don't rule out."""
    label, bits = np.arange(len(size)), _bits(size)

    def join(which: np.ndarray) -> None:
        some = np.unique(label[which])
        if len(some) > 1:
            label[np.isin(label, some[1:])] = some[0]

    share = (1 - threshold) / (1 + threshold)
    read = lambda which: np.frombuffer(b"".join(profiles[i] for i in which), np.uint8).reshape(len(which), -1).astype(np.int16)
    low = np.flatnonzero(size < 1 / max(1e-9, 1 - threshold) + 8)  # few buckets: these are left to the exact check
    if len(low):
        join(low)
    for b in np.unique(bits):
        mine, more = np.flatnonzero(bits == b), np.flatnonzero(bits == b + 1)
        both = np.concatenate([mine, more])
        x = read(mine)
        if len(more):
            x = np.concatenate([x, read(more).reshape(len(more), -1, 2).sum(axis=2, dtype=np.int16)])
        for i in range(len(mine)):
            apart = np.abs(x[i + 1 :] - x[i]).sum(axis=1, dtype=np.int64)
            hit = np.flatnonzero(apart <= np.floor(share * (size[both[i]] + size[both[i + 1 :]]) + 1e-9))
            if len(hit):
                join(both[np.append(hit + i + 1, i)])
    return label


def _packed(counts: np.ndarray) -> bytes:
    """Counts as compressed byte planes, of which the upper ones are nearly empty."""
    return pa.compress(np.ascontiguousarray(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * CHUNK, "zstd", asbytes=True), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def fingerprints(docs: DataFrame, n: int = N) -> DataFrame:
    """row_id, doc_id, fp, size and profile of the n-gram set of each row; and, with fp null, each task's count sketch of the n-grams of
    all its sets (task, chunk, counts)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, some = [], 0

        def flush() -> pa.RecordBatch:
            at = np.sort(np.concatenate(held))
            cuts = np.searchsorted(at, np.arange(0, SKETCH + 1, CHUNK))
            full = np.flatnonzero(np.diff(cuts))
            packs = [_packed(np.bincount(at[cuts[c] : cuts[c + 1]] - c * CHUNK, minlength=CHUNK)) for c in full]
            nothing = [pa.nulls(len(full), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())]
            task = pa.array(np.full(len(full), TaskContext.get().partitionId(), np.int32))
            return pa.RecordBatch.from_arrays([*nothing, task, pa.array(full.astype(np.int32)), pa.array(packs, pa.binary())], names=names)

        for batch in vec.sliced(batches):
            fp, size, profile = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int32), []
            for a, b, row, h, each in _sets(batch.column("text"), n):
                fp[a:b], size[a:b] = _fingerprints(row, h, each), each
                profile += _profiles(row, h, each)
                held.append((h & U(SKETCH - 1)).astype(np.int32))
                some += len(h)
            if some > COUNT:
                yield flush()
                held, some = [], 0
            nothing = [pa.nulls(len(fp), t) for t in (pa.int32(), pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("doc_id"), pa.array(fp), pa.array(size), pa.array(profile, pa.binary()), *nothing], names=names)
        if some:
            yield flush()

    names = ["row_id", "doc_id", "fp", "size", "profile", "task", "chunk", "counts"]
    return numbered(docs).mapInArrow(scan, "row_id long, doc_id long, fp long, size int, profile binary, task int, chunk int, counts binary")


def frequencies(found: DataFrame) -> np.ndarray:
    """Of each bucket of the count sketch of all sets, twice the binary logarithm of its count (63 at most): SKETCH bytes, whatever the input.
    The tasks' sketches are added up in a tree, those of FAN tasks at a time."""

    def total(table: pa.Table) -> np.ndarray:
        return sum(_unpacked(x.as_py()) for x in table.column("counts"))

    def add(table: pa.Table) -> pa.Table:
        return pa.table({"task": table.column("task").slice(0, 1), "chunk": table.column("chunk").slice(0, 1), "counts": pa.array([_packed(total(table))], pa.binary())})

    def code(table: pa.Table) -> pa.Table:
        codes = np.minimum(63, 2 * np.log2(np.maximum(total(table), 1))).astype(np.uint8).tobytes()
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "codes": pa.array([codes], pa.binary())})

    part = found.where("chunk is not null").select("task", "chunk", "counts")
    tasks = part.agg(F.max("task")).first()[0]
    if tasks is None:
        return np.zeros(SKETCH, np.uint8)
    tasks += 1
    while tasks > FAN:
        part = part.withColumn("task", F.expr(f"cast(task div {FAN} as int)")).groupBy("chunk", "task").applyInArrow(add, "task int, chunk int, counts binary")
        part = written(part, "near-counts")
        tasks = -(-tasks // FAN)

    out = np.zeros((SKETCH // CHUNK, CHUNK), np.uint8)
    for r in part.groupBy("chunk").applyInArrow(code, "chunk int, codes binary").collect():  # SKETCH bytes
        out[r.chunk] = np.frombuffer(r.codes, np.uint8)
    return out.ravel()


def numbered(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def allocate(codes: np.ndarray, threshold: float, segments: float | None = None, deletions: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(m, k) of each band: the cheapest of a few numbers of segments and of one-deletion neighbourhoods, where an index entry
    costs 1 and a hit 0.1. The frequency of an n-gram is its sketch count beyond the median, which is what others add to it."""
    buckets, count = np.bincount(codes, minlength=64), np.where(np.arange(64) > 0, 2.0 ** (np.arange(64) / 2), 0)
    total = max(1, (buckets * count).sum())
    median = count[np.searchsorted(np.cumsum(buckets), buckets.sum() / 2)]
    share, freq = np.cumsum(buckets * count) / total, np.maximum(1, count - median)
    at = lambda q: freq[np.minimum(np.searchsorted(share, np.minimum(q, 1)), len(freq) - 1)]
    ms, ks = np.zeros(BANDS, np.uint64), np.zeros(BANDS, np.int64)
    for band in range(BANDS):
        s = 2.0 * 4**band
        need = int((1 - threshold) / (1 + threshold) * (s + min(4 ** (band + 1), s / threshold))) + 1
        best = (np.inf, 1, 0)
        for per in (8.0, 4.0, 2.0, 1.0, 0.5) if segments is None else (segments,):
            m = max(8, int(4 ** (band + 1) * per))
            mean, filled = s / m, m * (1 - np.exp(-s / m))
            if segments is None and filled - 5 * np.sqrt(filled) < need * 1.1 and per < 8:
                continue  # sets with too few filled segments would lose the guarantee
            for k in sorted({0, need // 8, need // 4, need // 2}) if deletions is None else (min(deletions, m // 2),):
                rest = max(0, need - 2 * k)
                q = np.linspace(0, min(1, rest / max(filled, 1)), 64)
                empty = np.exp(-mean) * total / max(s, 1)
                cost = rest * (1 + 0.1 * at(q).mean()) + k * (1 + mean + 0.1 * ((1 - np.exp(-mean)) * (1 + mean) * at(np.linspace(0, 1, 64)).mean() + np.exp(-mean) * (1 + mean) * empty))
                best = min(best, (cost, m, k))
        ms[band], ks[band] = best[1], best[2]
    return ms, ks


def _band(size: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(size, 1)) / 2 + 1e-12).astype(np.int64)


def _shift(size: np.ndarray) -> np.ndarray:
    """By how many bits places are shortened to fit a byte."""
    return np.maximum(0, np.floor(np.log2(np.maximum(size, 1)) + 1e-12).astype(np.int64) - 7)


def _sparse(ms: np.ndarray, ks: np.ndarray) -> np.ndarray:
    """Whether nearly every segment of a band's scheme has one n-gram, and k is 0, by band."""
    return (ks == 0) & (ms >= (8 * 4.0 ** np.arange(1, BANDS + 1)).astype(np.uint64))


def _entries(row: np.ndarray, h: np.ndarray, size: np.ndarray, up: int, cost: np.ndarray, ms: np.ndarray, ks: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, 40-bit index entry, whose second bit is the scheme's lowest if that is sparse, place) in each row's own scheme, or (up = 1) in that of the next band, for rows with partners there.
    place: how many of the row's entries before it are segments of one n-gram, shortened."""
    scheme = np.minimum(_band(size) + up, BANDS - 1)
    part = np.floor(size / threshold + 1e-9)
    if up:
        keep = (part >= 4.0**scheme) & (size > 0)
        h, row = h[keep[row]], row[keep[row]]
    if not len(h):
        return row[:0], h[:0], np.zeros(0, np.uint8)
    most = np.floor((1 - threshold) / (1 + threshold) * (size + np.minimum(4.0 ** (scheme + 1) - 1, part)) + 1e-9).astype(np.int64)
    k = ks[scheme]
    segment = ((h >> U(8)) * ms[scheme][row]) >> U(40)
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (segment[1:] != segment[:-1])]))
    single = (np.diff(np.append(first, len(h))) == 1).astype(np.uint64)
    mixed = vec.mix(h + U(0x632BE59BD9B4E019))
    total, r, g = np.add.reduceat(mixed, first), row[first], segment[first]
    salt = (g + (scheme[r].astype(np.uint64) << U(40))) * U(0xD1342543DE82EF95)
    rare = np.minimum.reduceat(cost[(h & U(len(cost) - 1)).astype(np.int64)], first).astype(np.uint64)
    entry = (vec.mix(total + salt) >> U(25) << U(1)) | single
    near = g.astype(np.int64) < k[r]
    sparse = _sparse(ms, ks)[scheme]
    entry = np.where(sparse[r], (entry & ~U(2)) | ((scheme[r].astype(np.uint64) & U(1)) << U(1)), entry)
    more = np.where(sparse & (size >= LONG), SHARED - 1, 0)
    key = np.sort((r[~near].astype(np.uint64) << U(52)) | (rare[~near] << U(46)) | entry[~near])
    kr = (key >> U(52)).astype(np.int64)
    n = np.bincount(kr, minlength=len(size))
    begin = (np.cumsum(n) - n)[kr]
    chosen = np.arange(len(key)) - begin < (most + 1 + more - 2 * k)[kr]
    singles = np.concatenate([[0], np.cumsum(key & U(1))]).astype(np.int64)
    place = np.minimum((singles[:-1] - singles[begin]) >> _shift(size)[kr], 255).astype(np.uint8)
    rows, out, places = [kr[chosen]], [key[chosen] & U((1 << 46) - 1)], [place[chosen]]
    if k.any():
        rows.append(r[near])
        out.append(entry[near])
        seg = np.cumsum(np.concatenate([[False], (row[1:] != row[:-1]) | (segment[1:] != segment[:-1])]))
        gone = np.flatnonzero(near[seg])
        rows.append(row[gone])
        out.append(vec.mix(total[seg[gone]] - mixed[gone] + salt[seg[gone]]) >> U(25) << U(1))
        # what one deletion leaves of a segment is held against whole segments of any size
        rows.append(r[near])
        out.append(entry[near] & ~U(1))
        # segments of the first k that are empty are an entry too
        there = np.unique(row)
        kk = k[there]
        er, eg = np.repeat(there, kk), np.arange(kk.sum()) - np.repeat(np.cumsum(kk) - kk, kk)
        full = np.isin((er << 32) + eg, (r[near] << 32) + g[near].astype(np.int64))
        er, eg = er[~full], eg[~full].astype(np.uint64)
        rows.append(er)
        out.append(vec.mix((eg + (scheme[er].astype(np.uint64) << U(40))) * U(0xD1342543DE82EF95)) >> U(25) << U(1))
        places.append(np.zeros(sum(map(len, rows[1:])), np.uint8))
    return np.concatenate(rows), np.concatenate(out), np.concatenate(places)


def _code(size: np.ndarray) -> np.ndarray:
    """Sizes in 16 bits: the binary logarithm, rounded down, and eleven bits of what is beyond it; exact below 4,096."""
    e = np.floor(np.log2(np.maximum(size, 1)) + 1e-12).astype(np.int64)
    return ((e << 11) + (((size - (1 << e)) << 11) >> e)).astype(np.uint16)


def _between(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) size of a code."""
    e, m = code.astype(np.int64) >> 11, code.astype(np.int64) & 2047
    low = (1 << e) + ((m << e) >> 11)
    return low, low + np.maximum(0, (1 << np.maximum(0, e - 11)) - 1)


def _edges(docs: DataFrame, n: int, threshold: float, cost: np.ndarray, ms: np.ndarray, ks: np.ndarray, parts: int) -> DataFrame:
    """Distinct pairs (a, b) of fingerprints, a < b, that share SHARED index entries, or one where a set is short or the scheme isn't sparse. Of sets that do so in one part, directly or
    by way of others, the least fingerprint with every other; the same of all sets of an entry with over FEW, which need share no other."""
    shared = docs.sparkSession.sparkContext.broadcast((cost, ms, ks))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, ms, ks = shared.value
        held, some = [], 0

        def flush() -> pa.RecordBatch:
            entry, place, code, fp = (np.concatenate(x) for x in zip(*held))
            held.clear()
            part = ((entry >> U(2)) % U(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")  # a set's entries of a part stay together
            part, entry, place, code, fp = part[order], entry[order], place[order], code[order], fp[order]
            own = np.concatenate([[True], (part[1:] != part[:-1]) | (fp[1:] != fp[:-1])])
            first, sets = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), np.flatnonzero(own)
            cut = np.append(np.searchsorted(sets, first), len(sets))
            number = np.diff(np.append(sets, len(part))).astype(np.uint32)
            rows = {"entries": [], "sets": []}
            for k, (i, j) in enumerate(zip(first, np.append(first[1:], len(part)))):
                e, s = entry[i:j], sets[cut[k] : cut[k + 1]]
                rows["entries"].append(b"".join(x.tobytes() for x in (e.astype(np.uint32), (e >> U(32)).astype(np.uint8), place[i:j])))
                rows["sets"].append(b"".join(x.tobytes() for x in (fp[s], number[cut[k] : cut[k + 1]], code[s])))
            return pa.RecordBatch.from_arrays([pa.array(part[first]), *(pa.array(x, pa.binary()) for x in rows.values())], names=["part", *rows])

        for batch in vec.sliced(batches):
            for _, _, row, h, size in _sets(batch.column("text"), n):
                fp, code = _fingerprints(row, h, size), _code(size)
                for up in (0, 1):
                    row_, entry, place = _entries(row, h, size, up, cost, ms, ks, threshold)
                    held.append((entry, place, code[row_], fp[row_]))
                    some += len(entry)
                if some >= PACK:
                    yield flush()
                    some = 0
        if some:
            yield flush()

    def meet(table: pa.Table) -> pa.Table:
        def read(name: str, kind: type, at: int, of: int) -> np.ndarray:
            """Of packs of arrays with `of` bytes an element in all, the one that has `at` bytes an element before it."""
            return np.concatenate([np.frombuffer(x, kind, len(x) // of, len(x) // of * at) for x in (y.as_buffer() for y in table.column(name))])

        low, high, place = read("entries", np.uint32, 0, 6), read("entries", np.uint8, 4, 6), read("entries", np.uint8, 5, 6)
        names, where, back = np.unique(read("sets", np.int64, 0, 14), return_index=True, return_inverse=True)  # in order of fp
        least, most = _between(read("sets", np.uint16, 12, 14)[where])
        shift, total, who = _shift(least), len(names), np.repeat(back.astype(np.int32), read("sets", np.uint32, 8, 14))
        share, band, sparse = (1 - threshold) / (1 + threshold), np.minimum(_band(least), BANDS - 1), _sparse(ms, ks)
        found, times, sure = [], [], []
        for q in range(SLICES):  # a share of the entries at a time
            here = (low >> np.uint32(16)) % SLICES == q
            entry, mine = low[here].astype(np.uint64) | (high[here].astype(np.uint64) << U(32)), who[here]
            slack = (share * most[mine] - (place[here].astype(np.int64) << shift[mine]) + (SHARED - 1) * (least[mine] >= LONG)).astype(np.float32)
            key = (entry << U(24)) | mine.astype(np.uint64)  # a part has fewer than 2 ** 24 sets
            order = np.argsort(key)
            key = key[order]
            order = order[np.concatenate([[True], key[1:] != key[:-1]])] if len(order) else order  # copies count once
            entry, mine, slack = entry[order], mine[order], slack[order]
            for _ in range(2):  # members that no other can make up for drop out
                first = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]])) if len(entry) else np.zeros(0, np.int64)
                k = np.diff(np.append(first, len(entry)))
                best = np.repeat(np.maximum.reduceat(slack, first), k) if len(first) else slack
                left = (np.repeat(k, k) > 1) & (slack + best >= -0.5)
                entry, mine, slack = entry[left], mine[left], slack[left]
            first = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]])) if len(entry) else np.zeros(0, np.int64)
            k = np.diff(np.append(first, len(entry)))
            for i in np.flatnonzero(k > FEW):
                some = np.unique(mine[first[i] : first[i] + k[i]]).astype(np.int64)
                sure.append(some[0] * total + some[1:])
            here = [np.zeros(0, np.int64)]
            for few in range(2, FEW + 1):
                i, j = np.triu_indices(few, 1)
                rows, step = first[k == few], max(1, 300_000 // len(i))
                for at in range(0, len(rows), step):
                    x = rows[at : at + step, None] + np.arange(few)
                    s, x = slack[x], mine[x].astype(np.int64)
                    a, b = x[:, i], x[:, j]
                    near = (np.minimum(most[a], most[b]) >= threshold * np.maximum(least[a], least[b]) - 1e-9) & (s[:, i] + s[:, j] >= -0.5)
                    scheme = np.maximum(band[a], band[b])  # that in which the pair counts, so that no n-gram counts twice
                    near &= ~sparse[scheme] | (scheme & 1 == ((entry[rows[at : at + step]] >> U(1)) & U(1)).astype(np.int64)[:, None])
                    here.append((a * total + b)[near])  # a < b, as x ascends within an entry
            key, n = np.unique(np.concatenate(here), return_counts=True)
            found.append(key)
            times.append(n)
        key, back = np.unique(np.concatenate(found), return_inverse=True)
        n = np.bincount(back, np.concatenate(times), len(key)).astype(np.int64)
        a, b = key // max(total, 1), key % max(total, 1)
        enough = n >= np.where(sparse[np.maximum(band[a], band[b])] & (np.minimum(least[a], least[b]) >= LONG), SHARED, 1)
        group = _components(total, a[enough], b[enough])
        member = np.flatnonzero(group != np.arange(total))
        sure = np.unique(np.concatenate([*sure, group[member] * total + member]))
        a, b = np.concatenate([a[~enough], sure // max(total, 1)]), np.concatenate([b[~enough], sure % max(total, 1)])
        return pa.table({"a": names[a], "b": names[b], "n": np.concatenate([n[~enough], np.full(len(sure), SHARED)]).astype(np.int32)})

    packed = numbered(docs).select("text").mapInArrow(index, "part int, entries binary, sets binary")
    met = packed.groupBy("part").applyInArrow(meet, "a long, b long, n int")
    return met.groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= SHARED).select("a", "b")


def _verify(sets: list[np.ndarray], threshold: float, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, place, Jaccard) of the pairs that reach the threshold; with side, only pairs of unlike sides."""
    if len(sets) > SQUARE:  # square by square
        got = []
        for a in range(0, len(sets), SQUARE):
            for b in range(a, len(sets), SQUARE):
                i, j, s = _square(sets[a : a + SQUARE], None if a == b else sets[b : b + SQUARE], threshold)
                got.append((a + i, b + j, s))
        i, j, s = (np.concatenate(x) for x in zip(*got))
    else:
        i, j, s = _square(sets, None, threshold)
    if side is not None:
        keep = side[i] != side[j]
        i, j, s = i[keep], j[keep], s[keep]
    return i, j, s


def _square(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in left, place in right, Jaccard) of pairs that reach the threshold; without right, of the pairs within left."""
    sets = left + (right or [])
    size, n = np.array([len(s) for s in sets]), len(left)
    a, b = size[:n], size[n:] if right else size
    if len(sets) == 2:
        both = np.concatenate(sets)
        both.sort()
        same = np.count_nonzero(both[1:] == both[:-1])
        common = np.array([[same]]) if right else np.array([[0, same], [0, 0]])
    else:
        row = np.repeat(np.arange(len(sets)), size)
        names, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        base = int(np.count_nonzero(times == len(sets)))  # n-grams of all sets count without a column
        keep = (times[col] > 1) & (times[col] < len(sets))
        row, col = row[keep], (np.cumsum((times > 1) & (times < len(sets))) - 1)[col[keep]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        common, width = np.full((len(a), len(b)), base, np.float32), max(1, 4_000_000 // len(sets))
        for c in range(0, int(col[-1]) + 1 if len(col) else 0, width):
            i, j = np.searchsorted(col, [c, c + width])
            m = np.zeros((len(sets), min(width, int(col[-1]) + 1 - c)), np.float32)
            m[row[i:j], col[i:j] - c] = 1
            common += m[:n] @ m[n:].T if right else m @ m.T
    union = a[:, None] + b[None, :] - common
    hit = (common >= threshold * union - 1e-9) & (common > 0)
    i, j = np.nonzero(hit if right else np.triu(hit, 1))
    return i, j, common[i, j] / union[i, j]


def _components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least place that each of n places is linked with, by way of others too."""
    label = np.arange(n)
    while len(i):
        before = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if (label == before).all():
            break
    return label


def similar_sets(docs: DataFrame, found: DataFrame, n: int, threshold: float, segments: float | None = None, deletions: int | None = None, tile: int | None = None, entries: int = ENTRIES, broadcast_rows: int = BROADCAST_ROWS, links: bool = False) -> DataFrame:
    """Pairs (a, b, jaccard), a < b, of fingerprints of unlike sets; found: what `fingerprints` gave.

    With links, what the pairs come to, in a number of rows that grows with the sets and not with the pairs: (a, null, n), the rows with
    a doc_id of sets that are linked with set a, in parts to be added up; (a, b, null), a set b of the group of sets linked with a."""
    spark = docs.sparkSession
    cost = frequencies(found)
    ms, ks = allocate(cost, threshold, segments, deletions)
    grams = found.agg(F.sum("size")).first()[0] or 0
    edges = written(_edges(docs, n, threshold, cost, ms, ks, 1 + int(0.6 * grams / entries)), "near-edges")
    label = edges.groupBy(F.col("b").alias("x")).agg(F.min("a").alias("l"))
    blocks = edges.join(label.withColumnRenamed("x", "a"), "a", "left").select(F.coalesce("l", "a").alias("block"), F.explode(F.array("a", "b")).alias("fp")).distinct()
    blocks = written(blocks, "near-blocks")
    own = found.where("fp is not null and size > 0").groupBy("fp").agg(F.min("row_id").alias("row_id"), F.first("size").alias("size"), F.count("doc_id").alias("rows"))
    wanted = written(blocks.select("fp").distinct().join(own, "fp"), "near-wanted")

    def placed(blocks: DataFrame, size: str) -> DataFrame:
        """Each member of a block at each pair of tiles that it is needed for, in groups of work of bounded bytes."""
        sizes = blocks.join(wanted.select("fp", "size"), "fp")
        groups = 1 + int((sizes.agg(F.sum(F.expr(size))).first()[0] or 0) / GROUP_BYTES)
        tiles = F.count("*") / F.lit(tile) if tile else F.greatest(F.count("*") / F.lit(TILE), F.sum(F.expr(size)) / F.lit(TILE_BYTES))
        tiles = sizes.groupBy("block").agg(F.ceil(tiles).cast("int").alias("tiles"))
        out = blocks.join(tiles, "block").withColumn("t", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
        out = out.withColumn("u", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        out = out.select("block", "fp", "t", F.least("t", "u").alias("i"), F.greatest("t", "u").alias("j"))
        return out.withColumn("work", F.pmod(F.xxhash64("block", "i", "j"), F.lit(groups)))

    def pieces(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """The rows of each piece of work of two or more sets, in order of fp; and their sides, if only pairs of unlike sides count."""
        block, i, j, t, fp = (table.column(x).to_numpy() for x in ("block", "i", "j", "t", "fp"))
        order = np.lexsort((fp, j, i, block))
        block, i, j, t = block[order], i[order], j[order], t[order]
        first = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])) if len(block) else []
        for a, b in zip(first, np.append(first[1:], len(block))):
            if b - a > 1:
                yield order[a:b], t[a:b] if i[a] != j[a] else None

    def sift(table: pa.Table) -> pa.Table:
        fp, size, profile = (table.column(x).to_numpy() for x in ("fp", "size", "profile"))
        out = [(fp[:0], fp[:0])]
        for rows, _ in pieces(table):
            label = _possible([profile[x] for x in rows], size[rows], threshold)
            left = np.flatnonzero(np.bincount(label, minlength=len(rows))[label] > 1)
            out.append((fp[rows[label[left]]], fp[rows[left]]))
        block, fp = (np.concatenate(x) for x in zip(*out))
        return pa.table({"block": block, "fp": fp})

    profiles = wanted.join(found.where("fp is not null").select("row_id", "profile"), "row_id").select("fp", "size", "profile")
    blocks = written(placed(blocks, "size / 2").join(profiles, "fp").groupBy("work").applyInArrow(sift, "block long, fp long").distinct(), "near-sifted")
    wanted = written(blocks.select("fp").distinct().join(wanted, "fp"), "near-members")

    # the sets of the candidates, one row for each
    rows = wanted.count()
    few = rows <= broadcast_rows
    ids = spark.sparkContext.broadcast(np.sort(np.array([r.row_id for r in wanted.select("row_id").toLocalIterator()], np.int64)) if few else None)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vec.sliced(batches):
            if ids.value is not None:
                batch = batch.filter(pa.array(np.isin(batch.column("row_id").to_numpy(), ids.value)))
            for a, b, row, h, size in _sets(batch.column("text"), n):
                ends = np.concatenate([[0], np.cumsum(size)])
                fp = _fingerprints(row, h, size)
                low, high = h.astype(np.uint32), (h >> U(32)).astype(np.uint16)
                grams = [low[ends[i] : ends[i + 1]].tobytes() + high[ends[i] : ends[i + 1]].tobytes() for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column("row_id").slice(a, b - a), pa.array(fp), pa.array(grams, pa.binary())], names=["row_id", "fp", "grams"])

    sets = numbered(docs).select("row_id", "text").mapInArrow(members, "row_id long, fp long, grams binary")
    if not few:
        sets = sets.join(wanted.select("row_id"), "row_id", "left_semi")

    def unpack(grams: bytes) -> np.ndarray:
        k = len(grams) // 6
        return np.frombuffer(grams, np.uint32, k).astype(np.uint64) | (np.frombuffer(grams, np.uint16, k, 4 * k).astype(np.uint64) << U(32))

    def check(table: pa.Table) -> pa.Table:
        fp, grams, got = table.column("fp").to_numpy(), table.column("grams"), []
        for at, side in pieces(table):
            i, j, s = _verify([unpack(grams[int(x)].as_py()) for x in at], threshold, side)
            got.append((fp[at[i]], fp[at[j]], s))
        x, y, s = (np.concatenate(c) for c in zip(*got)) if got else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y), "jaccard": s.astype(np.float64)})

    def link(table: pa.Table) -> pa.Table:
        """(kind, a, b, n): 0, links of a; 1, b is of the group of a; 2, a pair of sets that both are in several blocks, and so may come again."""
        fp, grams, rows, own = table.column("fp").to_numpy(), table.column("grams"), table.column("rows").to_numpy(), table.column("one").to_numpy(zero_copy_only=False)
        none = np.zeros(0, np.int64)
        got = [(none, none, none, none)]
        for at, side in pieces(table):
            i, j, _ = _verify([unpack(grams[int(x)].as_py()) for x in at], threshold, side)
            once = own[at[i]] | own[at[j]]
            total = np.bincount(i[once], rows[at[j[once]]], len(at)) + np.bincount(j[once], rows[at[i[once]]], len(at))
            some, group = np.flatnonzero(total), _components(len(at), i, j)
            member = np.flatnonzero(group != np.arange(len(at)))
            for kind, a, b, n in ((0, fp[at[some]], fp[at[some]], total[some]), (1, fp[at[group[member]]], fp[at[member]], 0), (2, fp[at[i[~once]]], fp[at[j[~once]]], 0)):
                got.append((np.full(len(a), kind), a, b, np.full(len(a), n, np.int64)))
        kind, a, b, n = (np.concatenate(c) for c in zip(*got))
        return pa.table({"kind": kind.astype(np.int32), "a": a, "b": b, "n": n})

    if not links:
        work = placed(blocks, "size * 6").join(sets.select("fp", "grams"), "fp").groupBy("work").applyInArrow(check, "a long, b long, jaccard double")
        return work.groupBy("a", "b").agg(F.max("jaccard").alias("jaccard"))
    stays = blocks.groupBy("fp").agg((F.count("*") == 1).alias("one")).join(wanted.select("fp", "rows"), "fp")
    work = placed(blocks, "size * 6").join(sets.select("fp", "grams"), "fp").join(stays, "fp").groupBy("work").applyInArrow(link, "kind int, a long, b long, n long")
    work = written(work, "near-links")
    sums = work.where("kind = 0").select("a", F.lit(None).cast("long").alias("b"), "n")
    trees = work.where("kind = 1").select("a", "b", F.lit(None).cast("long").alias("n"))
    more = work.where("kind = 2").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = more.unionAll(more.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(stays.select(F.col("fp").alias("b"), "rows"), "b")
    return sums.unionAll(trees).unionAll(both.groupBy("a").agg(F.sum("rows").alias("n")).select("a", F.lit(None).cast("long").alias("b"), "n"))


def links(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, **limits) -> DataFrame:
    """doc_id, class_id, n_links of each row with a doc_id: the least doc_id of all that it is linked with, by way of others too, and how
    many other rows with a doc_id reach the threshold with it. A row of its own, without words too, has its doc_id and 0. Copies, and near
    copies of one another, are counted and not written out, so that the result has a row for each row of docs."""
    found = written(fingerprints(docs, n), "near-prints")
    got = written(similar_sets(docs, found, n, threshold, links=True, **limits), "near-found")
    label = groups(got.where("b is not null").select("a", "b")).withColumnRenamed("x", "fp")
    rows = found.where("fp is not null and doc_id is not null").select("doc_id", "fp", "size")
    sets = rows.where("size > 0").groupBy("fp").agg(F.count("*").alias("rows"), F.min("doc_id").alias("least"))
    sets = sets.join(got.where("b is null").groupBy(F.col("a").alias("fp")).agg(F.sum("n").alias("n")), "fp", "left").join(label, "fp", "left")
    sets = written(sets.select("fp", "least", F.coalesce("label", "fp").alias("label"), (F.col("rows") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")), "near-sets")
    classes = sets.groupBy("label").agg(F.min("least").alias("class_id"))
    linked = sets.where("n_links > 0").join(classes, "label").select("fp", "class_id", "n_links")
    out = rows.where("size > 0").join(linked, "fp", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return out.unionAll(rows.where("size = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, **limits) -> DataFrame:
    """doc_a < doc_b, jaccard (six decimals): every pair of unlike doc_id that reaches the threshold, exact copies included."""
    found = written(fingerprints(docs, n), "near-prints")
    pairs = similar_sets(docs, found, n, threshold, **limits)
    ids = found.where("fp is not null and size > 0 and doc_id is not null").select("fp", "doc_id").distinct()
    again = written(ids.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "near-again")  # ids of several unlike texts
    some = again.count() > 0
    if some:
        ids = ids.join(again.withColumn("again", F.lit(True)), "doc_id", "left")
    one = F.struct("doc_id", F.coalesce("again", F.lit(False)).alias("again") if some else F.lit(False).alias("again"))
    docs_of = written(ids.groupBy("fp").agg(F.collect_list(one).alias("docs")), "near-ids")
    alike = docs_of.where(F.size("docs") > 1).select("docs", F.col("docs").alias("others"), F.lit(1.0).alias("jaccard"))
    unlike = pairs.join(docs_of.toDF("a", "docs"), "a").join(docs_of.toDF("b", "others"), "b").select("docs", "others", "jaccard")
    every = alike.withColumn("same", F.lit(True)).unionByName(unlike.withColumn("same", F.lit(False)))
    every = every.select(F.explode("docs").alias("x"), "others", "jaccard", "same").select("x", F.explode("others").alias("y"), "jaccard", "same")
    every = every.where("x.doc_id <> y.doc_id and (not same or x.doc_id < y.doc_id)")
    out = every.select(F.expr("least(x.doc_id, y.doc_id)").alias("doc_a"), F.expr("greatest(x.doc_id, y.doc_id)").alias("doc_b"), F.round("jaccard", 6).alias("jaccard"), F.expr("x.again or y.again").alias("again"))
    if not some:  # no pair can come twice
        return out.drop("again")
    out = written(out, "near-pairs")
    return out.where("not again").drop("again").unionByName(out.where("again").groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard")))


def groups(pairs: DataFrame) -> DataFrame:
    """(x, label): for every x in the pairs (a, b) the least member of its connected component, by alternating large-star and
    small-star steps, each step a written table."""
    edges = written(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "near-graph")
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).withColumn("w", F.least("u", "w"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("w").alias("v")).where("u <> v").distinct()
        large = written(large, "near-large")
        least = large.groupBy("u").agg(F.min("v").alias("w"))
        edges = written(large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("w").alias("v")), F.struct(F.col("v").alias("u"), F.col("w").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct(), "near-small")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("x"), F.col("v").alias("label"))
        before = state


def keep_one(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, broadcast_rows: int = BROADCAST_ROWS, **limits) -> DataFrame:
    """The rows of docs, all columns, less all but one of each group of similar texts: the least doc_id stays (of equals, the
    first row). Rows whose text is null or has no word all stay."""
    found = written(fingerprints(docs, n), "near-prints")
    got = similar_sets(docs, found, n, threshold, broadcast_rows=broadcast_rows, links=True, **limits)
    label = groups(got.where("b is not null").select("a", "b"))
    rows = found.where("fp is not null and size > 0").join(label.withColumnRenamed("x", "fp"), "fp", "left")
    key = F.struct(F.col("doc_id").isNull(), "doc_id", "row_id")
    rows = rows.select("row_id", key.alias("k"), F.coalesce("label", "fp").alias("g"))
    best = rows.groupBy("g").agg(F.min("k").alias("best"), F.count("*").alias("n")).where("n > 1")
    drop = written(rows.join(best, "g").where("k <> best").select("row_id"), "near-drop")
    name = max(docs.columns, key=len) + "_row_id"  # no column of docs
    out = docs.withColumn(name, F.monotonically_increasing_id())
    drop = drop.withColumnRenamed("row_id", name)
    return out.join(F.broadcast(drop) if drop.count() <= broadcast_rows else drop, name, "left_anti").select(*docs.columns)
