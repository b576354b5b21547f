"""The ordered dictionary of word parts: its fixed atoms, training by peeling, reordering and word decomposition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tokens import _strings
from ..plans.tables import written
from . import thresholds

SHORTEST, LONGEST, WHOLE_MOST, ROUNDS = 2, 7, 16, 20
CONNECTORS = "-'&,.$"
SIGNS = "abcdefghijklmnopqrstuvwxyz0123456789" + CONNECTORS
#: Parts of a dictionary that may go to every task; a larger one is joined.
BROADCAST_PARTS = 1_000_000
KINDS = ("Start", "End", "Mid", "Letter", "Whole", "Delimiter")
SCHEMA = "part_id int, kind string, value string"


def atoms() -> list[tuple[str, str]]:
    """(kind, value) of the parts that every dictionary has: single signs as words, at the start, middle and end of words, and as delimiters."""
    return [*(("Whole", c) for c in SIGNS), *(("Letter", x) for c in SIGNS for x in (f"{c}##", f"##{c}##", f"##{c}")), *(("Delimiter", c) for c in CONNECTORS)]


def numbered(spark: SparkSession, parts: list[tuple[str, str]]) -> DataFrame:
    """part_id, kind, value: distinct parts in order of first occurrence."""
    return spark.createDataFrame([(i, *p) for i, p in enumerate(dict.fromkeys(parts))], SCHEMA)


def rendered(parts: DataFrame) -> DataFrame:
    """part_id, text: parts as they are shown."""
    v = F.col("value")
    shown = F.when(F.col("kind") == "Start", F.concat(v, F.lit("##"))).when(F.col("kind") == "Mid", F.concat(F.lit("##"), v, F.lit("##"))).when(F.col("kind") == "End", F.concat(F.lit("##"), v)).when(F.col("kind") == "Delimiter", F.concat(F.lit("[delim:"), v, F.lit("]"))).otherwise(v)
    return parts.select("part_id", shown.alias("text"))


def reordered(parts: DataFrame, by: str) -> DataFrame:
    """New part_id, kind, value, old_id. by: type, type_level or level_type; starts, ends and mids come after all others."""
    movable = F.col("kind").isin("Start", "Mid", "End").cast("int")
    kind = F.when(F.col("kind") == "Start", 0).when(F.col("kind") == "End", 1).when(F.col("kind") == "Mid", 2).otherwise(0) * movable
    level = -F.length("value") * movable
    keys = {"type": [kind], "type_level": [kind, level], "level_type": [level, kind]}[by]
    order = Window.orderBy(movable, *keys, "part_id")  # a dictionary is small
    return parts.select((F.row_number().over(order) - 1).alias("part_id"), "kind", "value", F.col("part_id").alias("old_id"))


class Decomposer:
    """Words to parts: a whole word if there is one; else candidates in order of part id claim their places (one start and one
    end at most), and single signs fill what is left."""

    def __init__(self, parts: list[tuple[int, str, str]]):
        self.ids: dict[str, dict[str, int]] = {k: {} for k in KINDS}
        for i, kind, value in parts:
            self.ids[kind].setdefault(value, i)

    def candidates(self, word: str) -> list[tuple[int, int, int, str]]:
        """(part id, first place, place after, kind), in order of part id."""
        n, start, mid, end = len(word), self.ids["Start"], self.ids["Mid"], self.ids["End"]
        out = []
        for size in range(SHORTEST, min(LONGEST, n) + 1):
            if (i := start.get(word[:size])) is not None:
                out.append((i, 0, size, "Start"))
            if (i := end.get(word[n - size :])) is not None:
                out.append((i, n - size, n, "End"))
            out += [(i, p, p + size, "Mid") for p in range(n - size + 1) if (i := mid.get(word[p : p + size])) is not None]
        return sorted(out)

    def _claim(self, word: str, candidates: list[tuple[int, int, int, str]] | None = None) -> tuple[list[tuple[int, int]], int, set[str]]:
        taken, used, found = 0, set(), []
        for i, a, b, kind in self.candidates(word) if candidates is None else sorted(candidates):
            mask = (1 << b) - (1 << a)
            if not (kind in used or taken & mask):
                taken |= mask
                found.append((a, i))
                if kind != "Mid":
                    used.add(kind)
        return found, taken, used

    def parts(self, word: str, candidates: list[tuple[int, int, int, str]] | None = None) -> list[int]:
        """Ids in order of place. candidates: those of the word, where the dictionary itself has single signs alone."""
        if not word:
            return []
        if (i := self.ids["Whole"].get(word)) is not None:
            return [i]
        found, taken, used = self._claim(word, candidates)
        letter, last = self.ids["Letter"], len(word) - 1
        for p, c in enumerate(word):
            if not taken >> p & 1:
                name = f"{c}##" if p == 0 and "Start" not in used else f"##{c}" if p == last and "End" not in used else f"##{c}##"
                if (i := letter.get(name)) is not None:
                    found.append((p, i))
        return [i for _, i in sorted(found)]

    def runs(self, word: str, candidates: list[tuple[int, int, int, str]] | None = None) -> list[tuple[int, int]]:
        """Stretches that no part claims."""
        if not word or word in self.ids["Whole"]:
            return []
        _, taken, _ = self._claim(word, candidates)
        out, p = [], 0
        while p < len(word):
            q = p
            while q < len(word) and not taken >> q & 1:
                q += 1
            if q > p:
                out.append((p, q))
            p = q + 1
        return out

    def delimiter(self, value: str) -> list[int]:
        """The whole delimiter, or else its ASCII signs that are delimiters."""
        known = self.ids["Delimiter"]
        return [known[value]] if value in known else [known[c] for c in value if c < "\x80" and c in known]


class Speller:
    """A `Decomposer` of many words at once: the pieces of all words are looked up as numbers, and each word's first candidate that is left claims its places, until
    none is left. A start holds a word's first place and an end its last, so one of each follows from the places. Words with other than ASCII signs, and very long ones,
    are left to a `Decomposer`."""

    MOST = 62

    def __init__(self, parts: list[tuple[int, str, str]]):
        self.one = Decomposer(parts)
        ids = self.one.ids
        pieces: dict[bytes, list[int]] = {}
        for k, kind in enumerate(("Start", "Mid", "End")):
            for value, i in ids[kind].items():
                if value.isascii() and SHORTEST <= len(value) <= LONGEST and "\0" not in value:
                    pieces.setdefault(value.encode(), [-1, -1, -1])[k] = i
        key = np.array([int.from_bytes(v, "little") for v in pieces], np.uint64)
        order = np.argsort(key)
        self.key, self.ids = key[order], np.array(list(pieces.values()), np.int64).reshape(-1, 3)[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self._hash(self.key)] = True
        self.sizes = sorted({len(v) for v in pieces})
        self.whole, self.whole_ids = pa.array(list(ids["Whole"]), pa.large_string()), np.array(list(ids["Whole"].values()), np.int64)
        self.letters = np.array([[ids["Letter"].get(shape.format(chr(c)), -1) for c in range(128)] for shape in ("{}##", "##{}##", "##{}")], np.int64)

    @staticmethod
    def _hash(key: np.ndarray) -> np.ndarray:
        return (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)

    def _claimed(self, words: pa.Array, firsts: np.ndarray | None = None, lasts: np.ndarray | None = None) -> tuple:
        """(whole word ids or -1, words left to the Decomposer, rows, places, bytes and places to the end of the others' signs, whether claimed; rows, places
        and ids of what is claimed). firsts, lasts: which words may have a start, and an end."""
        data, off = _strings(words)
        size = np.diff(off)
        whole = np.full(len(words), -1)
        if len(self.whole):
            at = pc.fill_null(pc.index_in(words.cast(pa.large_string()), self.whole), -1).to_numpy(zero_copy_only=False)
            whole[at >= 0] = self.whole_ids[at[at >= 0]]
        odd = np.concatenate([[0], np.cumsum((data >= 128) | (data == 0))])
        slow = (whole < 0) & ((size > self.MOST) | (odd[off[1:]] > odd[off[:-1]]))
        plain = (whole < 0) & ~slow
        row = np.repeat(np.arange(len(words)), size)
        of = np.flatnonzero(plain[row])
        row, byte, place = row[of], data[of].astype(np.uint64), of - off[:-1][row[of]]
        left = size[row] - place
        key, padded, found = byte, np.concatenate([byte, np.zeros(LONGEST, np.uint64)]), []
        for n in range(2, LONGEST + 1):
            key = key | (padded[n - 1 : n - 1 + len(byte)] << np.uint64(8 * (n - 1)))
            if n not in self.sizes:
                continue
            at = np.flatnonzero(left >= n)
            at = at[self.seen[self._hash(key[at])]]
            spot = np.minimum(np.searchsorted(self.key, key[at]), len(self.key) - 1)
            same = self.key[spot] == key[at]
            at, spot = at[same], spot[same]
            for k in range(3):
                ids = self.ids[spot, k]
                fits = ids >= 0
                if k == 0:
                    fits &= (place[at] == 0) & (True if firsts is None else firsts[row[at]])
                if k == 2:
                    fits &= (left[at] == n) & (True if lasts is None else lasts[row[at]])
                found.append((row[at[fits]], ids[fits], place[at[fits]], np.full(int(fits.sum()), n)))
        r, i, a, n = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in range(4))
        order = np.lexsort((a, i, r))
        r, i, a, n = r[order], i[order], a[order], n[order].astype(np.uint64)
        mask = ((np.uint64(1) << n) - np.uint64(1)) << a.astype(np.uint64)
        taken, claims = np.zeros(len(words), np.uint64), []
        while len(r):
            head = np.concatenate([[True], r[1:] != r[:-1]])
            claims.append((r[head], a[head], i[head]))
            taken[r[head]] |= mask[head]
            stay = ~head & ((mask & taken[r]) == 0)
            r, i, a, mask = r[stay], i[stay], a[stay], mask[stay]
        claims = [np.concatenate([x[k] for x in claims]) if claims else np.zeros(0, np.int64) for k in range(3)]
        return whole, np.flatnonzero(slow), row, place, byte.astype(np.int64), left, ((taken[row] >> place.astype(np.uint64)) & np.uint64(1)) > 0, claims

    def parts(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(how many parts each word has, all ids in order of place); null counts as empty."""
        whole, slow, row, place, byte, left, taken, claims = self._claimed(words)
        ids = self.letters[np.where(place == 0, 0, np.where(left == 1, 2, 1)), byte]
        own = ~taken & (ids >= 0)
        known = np.flatnonzero(whole >= 0)
        odd = [self.one.parts(w) for w in words.take(pa.array(slow)).to_pylist()]
        n = [len(x) for x in odd]
        rows = np.concatenate([claims[0], row[own], known, np.repeat(slow, n)]).astype(np.int64)
        places = np.concatenate([claims[1], place[own], np.zeros(len(known), np.int64), [k for x in n for k in range(x)]]).astype(np.int64)
        every = np.concatenate([claims[2], ids[own], whole[known], [i for x in odd for i in x]]).astype(np.int64)
        return np.bincount(rows, minlength=len(words)), every[np.lexsort((places, rows))]

    def runs(self, words: pa.Array, firsts: np.ndarray | None = None, lasts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, first place, place after) of the stretches that no part claims, in order."""
        _, slow, row, place, _, left, taken, _ = self._claimed(words, firsts, lasts)
        opens = ~taken & ((place == 0) | np.concatenate([[True], taken[:-1]])[: len(taken)])
        closes = ~taken & ((left == 1) | np.concatenate([taken[1:], [True]])[: len(taken)])
        found = []
        for k, w in zip(slow.tolist(), words.take(pa.array(slow)).to_pylist()):
            some = [c for c in self.one.candidates(w) if not (c[3] == "Start" and firsts is not None and not firsts[k] or c[3] == "End" and lasts is not None and not lasts[k])]
            found += [(k, p, q) for p, q in self.one.runs(w, some)]
        odd = np.array(found, np.int64).reshape(-1, 3)
        r, a, b = (np.concatenate([x, odd[:, k]]) for k, x in enumerate((row[opens], place[opens], place[closes] + 1)))
        order = np.lexsort((a, r))
        return r[order], a[order], b[order]


def collected(parts: DataFrame, limit: int = BROADCAST_PARTS) -> list[tuple[int, str, str]] | None:
    """The dictionary as a list, or None if it has more than `limit` parts and so is to be joined and not sent to every task."""
    rows = parts.select("part_id", "kind", "value").limit(limit + 1).collect()
    return [tuple(r) for r in rows] if len(rows) <= limit else None


def spelling(parts: DataFrame, limit: int = BROADCAST_PARTS):  # noqa: ANN201
    """(a broadcast of the dictionary's parts, or of its single signs alone where it is too large; whether it is whole)"""
    known = collected(parts, limit)
    few = known if known is not None else [tuple(r) for r in parts.where("kind = 'Letter'").select("part_id", "kind", "value").collect()]  # of SIGNS
    return parts.sparkSession.sparkContext.broadcast(few), known is not None


def matched(words: DataFrame, parts: DataFrame, column: str) -> DataFrame:
    """The rows of words with whole (the id of the part that is the whole word) and found (the candidates in it): by joins, for dictionaries of any size."""
    w = words.select(F.col(column).alias("word")).where("word <> ''").distinct()
    cand = candidates(w, parts).groupBy("word").agg(F.collect_list(F.struct("part_id", F.col("place").alias("a"), (F.col("place") + F.col("length")).alias("b"), "kind")).alias("found"))
    whole = parts.where("kind = 'Whole'").groupBy(F.col("value").alias("word")).agg(F.min("part_id").alias("whole"))
    return words.join(w.join(cand, "word", "left").join(whole, "word", "left").withColumnRenamed("word", column), column, "left")


def decomposed(words: DataFrame, parts: DataFrame, column: str = "value", limit: int = BROADCAST_PARTS) -> DataFrame:
    """The rows of words with part_ids (in order of place) and bag (distinct ids, ascending). A dictionary of up to `limit` parts goes to every
    executor; a larger one is joined with the substrings of the distinct words."""
    shared, every = spelling(parts, limit)
    known: list[Decomposer | Speller] = []

    @F.arrow_udf("array<int>")
    def split(values: pa.Array) -> pa.Array:
        if not known:
            known.append(Speller(shared.value))
        count, flat = known[0].parts(values)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(flat, pa.int32()))
        return pc.if_else(values.is_null(), pa.scalar(None, lists.type), lists) if values.null_count else lists

    @F.pandas_udf("array<int>")
    def fold(values, wholes, found):  # noqa: ANN001, ANN202
        if not known:
            known.append(Decomposer(shared.value))
        given = [None if w is None else [int(i)] if i == i and i is not None else known[0].parts(w, [tuple(c[k] for k in ("part_id", "a", "b", "kind")) for c in (cs if cs is not None else ())]) for w, i, cs in zip(values, wholes, found)]
        return values.__class__(given, dtype=object)

    if every:
        out = words.withColumn("part_ids", split(F.col(column)))
    else:
        out = matched(words, parts, column).withColumn("part_ids", fold(F.col(column), F.col("whole"), F.col("found"))).drop("whole", "found")
    return out.withColumn("bag", F.array_sort(F.array_distinct("part_ids")))


def decomposed_delimiters(delimiters: DataFrame, parts: DataFrame) -> DataFrame:
    """The rows of delimiters (value) with part_ids: the whole delimiter's, or else those of its ASCII signs that are delimiters, in order of place."""
    d = parts.where("kind = 'Delimiter'").groupBy(F.col("value").alias("sign")).agg(F.min("part_id").alias("id"))
    given = delimiters.where("value is not null")
    v = given.select("value").distinct()
    whole = v.join(d, v["value"] == d["sign"], "left").select("value", F.col("id").alias("whole"))
    signs = whole.where("whole is null").select("value", F.posexplode(F.split("value", "")).alias("i", "sign")).where("sign <> '' and ascii(sign) < 128").join(d, "sign")
    spelt = signs.groupBy("value").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "id"))), lambda x: x["id"]).alias("spelt"))
    ids = whole.join(spelt, "value", "left").select("value", F.when(F.col("whole").isNotNull(), F.array("whole")).otherwise(F.coalesce("spelt", F.array().cast("array<int>"))).alias("part_ids"))
    return given.join(ids, "value")


def unclaimed(words: DataFrame, parts: DataFrame, limit: int = BROADCAST_PARTS) -> DataFrame:
    """value, n, a, b: the stretches [a, b) of each word that no part claims."""
    shared, every = spelling(parts, limit)
    given = words.select("value", F.col("n").cast("long").alias("n"))
    if not every:
        given = matched(given, parts, "value").where("whole is null").drop("whole")

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = Speller(shared.value) if every else Decomposer(shared.value)
        for b in batches:
            if every:
                row, p, q = d.runs(b.column("value"))
                yield pa.RecordBatch.from_arrays([b.column("value").take(pa.array(row)), b.column("n").take(pa.array(row)), pa.array(p, pa.int32()), pa.array(q, pa.int32())], names=["value", "n", "a", "b"])
                continue
            rows = [(w, n, p, q) for w, n, cs in zip(b.column("value").to_pylist(), b.column("n").to_pylist(), b.column("found").to_pylist()) if w for p, q in d.runs(w, [tuple(c.values()) for c in cs or ()])]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.int32()))], names=["value", "n", "a", "b"])

    return given.mapInArrow(stretches, "value string, n long, a int, b int")


def first_of(rows: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """key, words: the first k values of each key, in order. Only k values of a key are ever held together."""
    order = Window.partitionBy(key).orderBy(value)
    few = rows.select(key, value).distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return few.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("words"))


def candidates(words: DataFrame, parts: DataFrame) -> DataFrame:
    """word, part_id, kind, place (from 0), length: every start, end and mid of a word that is a part. words: word."""
    sized = words.withColumn("length", F.explode(F.sequence(F.lit(SHORTEST), F.least(F.lit(LONGEST), F.length("word"))))).where("length <= length(word)")
    placed = sized.withColumn("place", F.explode(F.sequence(F.lit(0), F.length("word") - F.col("length")))).withColumn("value", F.expr("substring(word, place + 1, length)"))
    fits = (F.col("kind") == "Mid") | ((F.col("kind") == "Start") & (F.col("place") == 0)) | ((F.col("kind") == "End") & (F.col("place") + F.col("length") == F.length("word")))
    return placed.join(parts, "value").where(fits).select("word", "part_id", "kind", "place", "length")


def open_runs(words: DataFrame, parts: DataFrame, limit: int = BROADCAST_PARTS) -> DataFrame:
    """run, first, last, n: the stretches that no part claims, of two signs and more, and whether they touch their word's start and end; n adds up the frequencies of
    the words that have them."""
    runs = unclaimed(words, parts, limit).where(F.col("b") - F.col("a") >= SHORTEST)
    return runs.groupBy(F.expr("substring(value, a + 1, b - a)").alias("run"), (F.col("a") == 0).alias("first"), (F.col("b") == F.length("value")).alias("last")).agg(F.sum("n").alias("n"))


def still_open(runs: DataFrame, new: list[tuple[int, str, str]]) -> DataFrame:
    """What new parts leave of `open_runs`: older parts have claimed before these, so that words aren't spelt again. new: of a few thousand parts a round."""
    shared = runs.sparkSession.sparkContext.broadcast(new)

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = Speller(shared.value)
        for b in batches:
            run, first, last = b.column(0), *(b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            row, p, q = d.runs(run, first, last)
            some = q - p >= SHORTEST
            row, p, q = row[some], p[some], q[some]
            at, size = pa.array(row), np.asarray(pc.utf8_length(run)).astype(np.int64)[row]
            own, cut = run.take(at), np.flatnonzero((p > 0) | (q < size))
            if len(cut):
                pieces = [w[i:j] for w, i, j in zip(own.take(pa.array(cut)).to_pylist(), p[cut].tolist(), q[cut].tolist())]
                mask = np.zeros(len(row), bool)
                mask[cut] = True
                own = pc.replace_with_mask(own, pa.array(mask), pa.array(pieces, own.type))
            yield pa.RecordBatch.from_arrays([own, pa.array(first[row] & (p == 0)), pa.array(last[row] & (q == size)), b.column(3).take(at)], names=["run", "first", "last", "n"])

    return runs.select("run", "first", "last", "n").mapInArrow(stretches, "run string, first boolean, last boolean, n long").groupBy("run", "first", "last").agg(F.sum("n").alias("n"))


def bins(words: DataFrame, parts: DataFrame, limit: int = BROADCAST_PARTS) -> DataFrame:
    """length, kind, value, weight: pieces of the stretches that no part claims, counted with their words' frequencies (n)."""
    return pieces_of(open_runs(words, parts, limit))


def pieces_of(runs: DataFrame) -> DataFrame:
    """length, kind, value, weight: the pieces of `open_runs`."""
    sized = runs.withColumn("length", F.explode(F.sequence(F.lit(SHORTEST), F.least(F.lit(LONGEST), F.length("run")))))
    # starts and ends are the pieces at the first and last place of a stretch that touches its word's start or end
    placed = sized.withColumn("p", F.explode(F.sequence(F.lit(1), F.length("run") - F.col("length") + 1)))
    kinds = F.array_compact(F.array(F.lit("Mid"), F.when(F.col("first") & (F.col("p") == 1), "Start"), F.when(F.col("last") & (F.col("p") == F.length("run") - F.col("length") + 1), "End")))
    pieces = placed.select("length", F.explode(kinds).alias("kind"), F.expr("substring(run, p, length)").alias("value"), "n")
    return pieces.groupBy("length", "kind", "value").agg(F.sum("n").alias("weight"))


def peel(words: DataFrame, parts: DataFrame, limit: int = BROADCAST_PARTS) -> DataFrame:
    """length, kind, value, weight, rank: the pieces that one round of peeling promotes."""
    return best_pieces(bins(words, parts, limit))


def best_pieces(pieces: DataFrame) -> DataFrame:
    return thresholds.kept(written(pieces, "bins"), ["length", "kind"], "weight", "value")


def whole_atoms(words: DataFrame, most: int = WHOLE_MOST) -> DataFrame:
    """value, n, rank: the words that become parts as they are. words: value, n."""
    return thresholds.kept(words.where(F.length("value").between(2, most)), [], "n", "value")


def seeded(words: DataFrame, delimiters: DataFrame) -> DataFrame:
    """The dictionary before the first round of peeling: whole words, single signs, delimiters."""
    spark = words.sparkSession
    whole = whole_atoms(words.where("value <> ''")).select(F.lit(0).alias("g"), F.col("rank").cast("long").alias("r"), F.lit("Whole").alias("kind"), "value")
    own, ends = atoms()[: len(SIGNS) * 4], [("Delimiter", c) for c in CONNECTORS]
    signs = spark.createDataFrame([(1, i, *p) for i, p in enumerate(own)] + [(3, i, *p) for i, p in enumerate(ends)], "g int, r long, kind string, value string")
    seen = delimiters.where("value <> ''").select(F.lit(2).alias("g"), (-F.col("n")).alias("r"), F.lit("Delimiter").alias("kind"), "value")
    return arranged(whole.unionAll(signs).unionAll(seen), "g", "r", "value")


def arranged(parts: DataFrame, *order: str) -> DataFrame:
    """part_id, kind, value: the distinct parts, numbered from 0 by the first of each in a total order of the columns named."""
    first = parts.groupBy("kind", "value").agg(F.min(F.struct(*[F.col(c) for c in order], F.col("value").alias("tie"), F.col("kind").alias("tie2"))).alias("at"))
    number = F.row_number().over(Window.orderBy("at")) - 1  # in one task: cut-offs bound a dictionary
    return written(first.select(number.cast("int").alias("part_id"), "kind", "value"), "dictionary")


def promoted(words: DataFrame, parts: DataFrame, limit: int = BROADCAST_PARTS) -> DataFrame:
    """The dictionary after one more round of peeling: new parts come last, by length from the longest, then starts, mids and ends, then by rank."""
    return extended(parts, peel(words, parts, limit))


def extended(parts: DataFrame, peeled: DataFrame) -> DataFrame:
    """The dictionary with what a round of peeling promotes."""
    kind = F.when(F.col("kind") == "Start", 0).when(F.col("kind") == "Mid", 1).otherwise(2)
    new = peeled.select(F.lit(1).alias("g"), (-F.col("length")).cast("long").alias("a"), kind.alias("b"), F.col("rank").cast("long").alias("c"), "kind", "value")
    old = parts.select(F.lit(0).alias("g"), F.col("part_id").cast("long").alias("a"), F.lit(0).alias("b"), F.lit(0).cast("long").alias("c"), "kind", "value")
    return arranged(old.unionAll(new), "g", "a", "b", "c")


def train(words: DataFrame, delimiters: DataFrame, rounds: int = ROUNDS, limit: int = BROADCAST_PARTS) -> DataFrame:
    """The dictionary of a corpus from word and delimiter frequencies (value, n), which are read once. It is a table that each round writes anew;
    the words are spelt in the first round, and what no part claims in them, a table too, is all that later rounds read. Only new parts come to the driver;
    a dictionary of over `limit` parts is joined where it is needed."""
    words = written(words.where("value <> ''").select("value", F.col("n").cast("long").alias("n")), "train-words")
    parts = seeded(words, delimiters)
    size, before, runs = parts.count(), None, None
    for _ in range(rounds):
        if size > limit:  # the words are spelt by joins, from the whole dictionary
            runs = open_runs(words, parts, limit)
        elif runs is None:
            runs = written(open_runs(words, parts, limit), "runs")
        else:
            new = [tuple(r) for r in parts.where(F.col("part_id") >= before).select("part_id", "kind", "value").collect()]  # of one round
            runs = written(still_open(runs, new), "runs")
        parts = extended(parts, best_pieces(pieces_of(runs)))
        before, size = size, parts.count()
        if size == before:
            break
    return parts
