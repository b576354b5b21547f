"""A codebook of atoms (sets of bits): normalising, decoding, threshold pursuit and how well it reconstructs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import written

NUMERATOR, DENOMINATOR, MOST_FIRED = 9, 10, 32
#: Bits of a codebook, over all atoms, that may go to every task.
CELLS = 20_000_000
#: Bits of a codebook, over all atoms, that are joined with signatures' bits without moving these.
SMALL = 1_000_000
#: Atoms of a codebook that many signatures are matched with at once; larger ones are searched signature by signature.
TOGETHER = 4096
#: Signatures times atoms, and bits times the atoms that hold one, that are held at once.
PIECE = 1 << 21


def normalised(atoms: DataFrame, width: int) -> DataFrame:
    """atom_id, bits: sorted, distinct, the `width` lowest."""
    return atoms.select("atom_id", F.slice(F.array_sort(F.array_distinct("bits")), 1, width).alias("bits"))


def decoded(fired: DataFrame, codebook: DataFrame) -> DataFrame:
    """id, bits: the union of each signature's fired atoms; ids that are no atoms count for nothing. fired: id, atoms."""
    bits = fired.select("id", F.explode("atoms").alias("atom_id")).distinct().join(codebook, "atom_id")
    union = bits.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("bits")))).alias("bits"))
    return fired.select("id").distinct().join(union, "id", "left").select("id", F.coalesce("bits", F.array().cast("array<int>")).alias("bits"))


def scores(bits: DataFrame, codebook: DataFrame, weights: DataFrame) -> DataFrame:
    """id, atom_id, wdot, ic: each signature (id, bit) with every atom that shares weight with it."""
    long = codebook.select("atom_id", F.explode("bits").alias("bit")).join(weights.select("bit", "w"), "bit")
    if (codebook.agg(F.sum(F.size("bits"))).first()[0] or 0) <= SMALL:
        long = F.broadcast(long)  # else all signatures' bits meet by bit, of which there may be few
    ic = long.groupBy("atom_id").agg(F.sum("w").cast("long").alias("ic"))
    return bits.join(long, "bit").groupBy("id", "atom_id").agg(F.sum("w").cast("long").alias("wdot")).join(ic, "atom_id").where("wdot > 0 and ic > 0")


def first_round(bits: DataFrame, codebook: DataFrame, weights: DataFrame, num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """id, atom_id: atoms whose match reaches num / den of the best one's, by exact integers."""
    return best_of(scores(bits, codebook, weights), num, den)


def best_of(s: DataFrame, num: int, den: int) -> DataFrame:
    """id, atom_id of the scores that reach num / den of their signature's best."""
    s = s.withColumn("ratio", F.col("wdot").cast("decimal(18,0)") / F.col("ic").cast("decimal(18,0)"))
    s = s.withColumn("best", F.max_by(F.struct("wdot", "ic"), F.col("ratio")).over(Window.partitionBy("id")))  # a row for each atom at most
    return s.where(F.col("wdot") * den * F.col("best.ic") >= F.lit(num) * F.col("best.wdot") * F.col("ic")).select("id", "atom_id")


def sets(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(bits per row, all bits) of sets of bits; ascending and distinct in each row, null as empty."""
    size, flat = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64), np.asarray(pc.list_flatten(lists)).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    if len(flat) and not ((flat[1:] > flat[:-1]) | (row[1:] > row[:-1])).all():
        low = flat.min()
        span = int(flat.max() - low) + 1
        key = np.unique(row * span + (flat - low))
        size, flat = np.bincount(key // span, minlength=len(size)), key % span + low
    return size, flat


class Matcher:
    """Threshold pursuit of many signatures at once: each bit lends its weight to the atoms that hold it, and goes when one of these fires. Sums are whole numbers,
    exact as floats."""

    def __init__(self, atoms: dict[int, list[int]], weigh: Callable[[np.ndarray], np.ndarray]):
        self.names = np.array(sorted(atoms), np.int64)
        held = [atoms[k] for k in self.names.tolist()]
        atom, bit = np.repeat(np.arange(len(held)), [len(x) for x in held]), np.array([e for x in held for e in x], np.int64)
        self.info = np.bincount(atom, weigh(bit), len(held)).astype(np.int64) if len(held) else np.zeros(0, np.int64)
        bit, atom = np.unique(np.stack([bit, atom]), axis=1) if len(bit) else (bit, atom)
        self.atom, (self.known, self.start, self.count) = atom, np.unique(bit, return_index=True, return_counts=True)
        self.w = weigh(self.known)

    def match(self, size: np.ndarray, flat: np.ndarray, num: int = NUMERATOR, den: int = DENOMINATOR, most: int = MOST_FIRED) -> tuple[pa.Array, np.ndarray]:
        """(the atoms of each signature, which of the bits they cover). size, flat: as of `sets`."""
        gone, ends, count, atoms, at = np.zeros(len(flat), bool), np.concatenate([[0], np.cumsum(size)]), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        step, bits = max(1, PIECE // max(1, len(self.names))), PIECE // max(1, int(self.count.max(initial=1)))
        while at < len(size):
            to = min(max(at + 1, int(np.searchsorted(ends, ends[at] + bits, side="right")) - 1), at + step, len(size))
            fired = self._fired(size[at:to], flat[ends[at] : ends[to]], gone[ends[at] : ends[to]], num, den, most)
            row, k = np.nonzero(fired)
            count.append(np.bincount(row, minlength=to - at))
            atoms.append(self.names[k])
            at = to
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(count))])
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.concatenate(atoms).astype(np.int32))), gone

    def _fired(self, size: np.ndarray, flat: np.ndarray, gone: np.ndarray, num: int, den: int, most: int) -> np.ndarray:
        fired = np.zeros((len(size), len(self.names)), bool)
        if not len(self.known) or not len(flat):
            return fired
        col = np.minimum(np.searchsorted(self.known, flat), len(self.known) - 1)
        hit = np.flatnonzero(self.known[col] == flat)
        n = self.count[col[hit]]
        of = np.repeat(hit, n)
        atom = self.atom[np.repeat(self.start[col[hit]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        row, w, open_, info = np.repeat(np.arange(len(size)), size)[of], self.w[col[of]].astype(np.float64), np.arange(len(size)), self.info
        while len(row):
            key = row * len(info) + atom
            dots = np.bincount(key, w, len(open_) * len(info)).astype(np.int64).reshape(-1, len(info))
            dots[:, info <= 0] = 0
            best = (dots / np.maximum(info, 1)).argmax(axis=1)[:, None]
            new = (dots > 0) & (dots * (den * info[best]) >= num * np.take_along_axis(dots, best, 1) * info)
            new &= np.cumsum(new, axis=1) <= most - fired[open_].sum(axis=1, keepdims=True)
            fired[open_] |= new
            gone[of[new.ravel()[key]]] = True
            going = new.any(axis=1)
            left = going[row] & ~gone[of]
            row, atom, w, of = (np.cumsum(going) - 1)[row[left]], atom[left], w[left], of[left]
            open_ = open_[going]
        return fired


def pursuit(signatures: DataFrame, codebook: DataFrame, weights: DataFrame, num: int = NUMERATOR, den: int = DENOMINATOR, most: int = MOST_FIRED, cells: int = CELLS) -> DataFrame:
    """id, atoms: rounds of matching the bits not yet covered. signatures: id, bits. A codebook of up to CELLS bits in all goes to every executor; a larger
    one is joined round by round."""
    if (codebook.agg(F.sum(F.size("bits"))).first()[0] or 0) > cells:
        return pursuit_by_joins(signatures, codebook, weights, num, den, most)
    atoms = {r.atom_id: tuple(r.bits) for r in codebook.collect()}
    held = codebook.select(F.explode("bits").alias("bit")).distinct()
    w = {r.bit: int(r.w) for r in weights.select("bit", "w").join(held, "bit").collect()}  # of the codebook's bits
    by_bit: dict[int, list[int]] = {}
    for k, bits in atoms.items():
        for e in bits:
            by_bit.setdefault(e, []).append(k)
    ic = {k: sum(w.get(e, 0) for e in bits) for k, bits in atoms.items()}
    shared = signatures.sparkSession.sparkContext.broadcast((atoms, w, by_bit, ic))

    def run(signature: list[int]) -> list[int]:
        atoms, w, by_bit, ic = shared.value
        fired: set[int] = set()
        left = set(signature)
        while left and len(fired) < most:
            dots: dict[int, int] = {}
            for e in left:
                for k in by_bit.get(e, ()):
                    if k not in fired:
                        dots[k] = dots.get(k, 0) + w.get(e, 0)
            scored = sorted((k, d) for k, d in dots.items() if d and ic[k])
            if not scored:
                break
            bd, bi = 0, 1
            for k, d in scored:
                if d * bi > bd * ic[k]:
                    bd, bi = d, ic[k]
            new = [k for k, d in scored if d * den * bi >= num * bd * ic[k]][: most - len(fired)]
            fired.update(new)
            left -= {e for k in new for e in atoms[k]}
        return sorted(fired)

    many = len(atoms) <= TOGETHER

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        atoms, w, *_ = shared.value
        matcher = Matcher(atoms, lambda bits: np.array([w.get(e, 0) for e in bits.tolist()], np.int64)) if many else None
        for b in batches:
            if many:
                fired, _ = matcher.match(*sets(b.column("bits")), num, den, most)
                yield pa.RecordBatch.from_arrays([b.column("id"), fired], names=["id", "atoms"])
                continue
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([run(x or []) for x in b.column("bits").to_pylist()], pa.list_(pa.int32()))], names=["id", "atoms"])

    return signatures.select(F.col("id").cast("long").alias("id"), "bits").mapInArrow(encode, "id long, atoms array<int>")


def pursuit_by_joins(signatures: DataFrame, codebook: DataFrame, weights: DataFrame, num: int = NUMERATOR, den: int = DENOMINATOR, most: int = MOST_FIRED) -> DataFrame:
    """As `pursuit`, for codebooks of any size: each round is a join of the bits not yet covered with the atoms that hold them, and a written table."""
    given = signatures.select(F.col("id").cast("long").alias("id"), "bits")
    left = written(given.select("id", F.explode("bits").alias("bit")).distinct(), "pursuit-left")
    fired = left.select("id", F.lit(None).cast("int").alias("atom_id")).limit(0)
    order = Window.partitionBy("id").orderBy("atom_id")
    while True:
        s = scores(left, codebook, weights).join(fired, ["id", "atom_id"], "left_anti")
        new = best_of(s, num, den).join(fired.groupBy("id").agg(F.count("*").alias("n")), "id", "left").na.fill(0, ["n"])
        new = written(new.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.lit(most) - F.col("n")).select("id", "atom_id"), "pursuit-new")
        if new.isEmpty():
            break
        fired = written(fired.unionByName(new), "pursuit-fired")
        covered = new.join(codebook, "atom_id").select("id", F.explode("bits").alias("bit")).distinct()
        left = written(left.join(covered, ["id", "bit"], "left_anti"), "pursuit-left")
    got = fired.groupBy("id").agg(F.array_sort(F.collect_list("atom_id")).alias("atoms"))
    return given.select("id").join(got, "id", "left").select("id", F.coalesce("atoms", F.array().cast("array<int>")).alias("atoms"))


def accumulated(bits: DataFrame, fired: DataFrame, weights: DataFrame) -> DataFrame:
    """atom_id, bit, mass: the weights of the bits of the signatures for which each atom fired. bits: id, bit; fired: id, atom_id."""
    long = bits.join(weights.select("bit", "w"), "bit")
    return fired.select("id", "atom_id").join(long, "id").groupBy("atom_id", "bit").agg(F.sum("w").cast("double").alias("mass"))


def quality(bits: DataFrame, fired: DataFrame, codebook: DataFrame, weights: DataFrame) -> DataFrame:
    """atoms, used, utilisation (the share of atoms that fire at all), mean_recall (of the weight of each signature that has any, the share its fired atoms
    cover, on average). bits: id, bit; fired: id, atom_id."""
    used = codebook.select("atom_id").join(fired.select("atom_id").distinct().withColumn("hit", F.lit(1)), "atom_id", "left").agg(F.count("*").alias("atoms"), F.count("hit").alias("used"))
    covered = fired.join(codebook, "atom_id").select("id", F.explode("bits").alias("bit")).distinct().withColumn("hit", F.lit(True))
    w = bits.join(weights.select("bit", "w"), "bit").join(covered, ["id", "bit"], "left")
    recall = w.groupBy("id").agg(F.sum("w").alias("ic"), F.sum(F.when(F.col("hit"), F.col("w")).otherwise(0)).alias("wd")).where("ic > 0").agg(F.coalesce(F.avg(F.col("wd") / F.col("ic")), F.lit(0.0)).alias("mean_recall"))
    return used.withColumn("utilisation", F.coalesce(F.col("used") / F.nullif("atoms", F.lit(0)), F.lit(0.0))).crossJoin(recall)  # a row each


def reconstruction(truth: DataFrame, recon: DataFrame, weights: DataFrame, size: int) -> DataFrame:
    """id and weighted recall and precision by band (left, current, right) and in all; an empty band counts as 1. truth, recon: id, bit."""
    t = truth.select("id", "bit", F.lit(True).alias("t"))
    both = t.join(recon.select("id", "bit", F.lit(True).alias("r")), ["id", "bit"], "full").join(weights.select("bit", "w"), "bit", "left").na.fill(0, ["w"])
    band = F.when(F.col("bit") < size, "left").when(F.col("bit") < 2 * size, "current").otherwise("right")
    sums = []
    for name in ("left", "current", "right", "all"):
        here = F.lit(True) if name == "all" else band == name
        total = lambda c: F.sum(F.when(here & c, F.col("w")).otherwise(0))  # noqa: B023, E731
        hit = total(F.col("t").isNotNull() & F.col("r").isNotNull())
        sums += [F.coalesce(hit / F.nullif(total(F.col(c).isNotNull()), F.lit(0)), F.lit(1.0)).alias(f"{what}_{name}") for what, c in (("recall", "t"), ("precision", "r"))]
    return both.groupBy("id").agg(*sums)


def bit_degree(codebook: DataFrame) -> DataFrame:
    """bit, atoms: the number of atoms that hold it."""
    return codebook.select(F.explode("bits").alias("bit"), "atom_id").groupBy("bit").agg(F.countDistinct("atom_id").alias("atoms"))
