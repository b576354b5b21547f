"""Set signatures of word occurrences: the parts of the words before, of the word, and of the words after it in its sentence or
paragraph, as bits of three bands; document frequencies and surprisal weights of the bits; plain and weighted Jaccard.

A text's sentences lie in one row, so signatures are made where the text is cut into words (`scan`), without moving a word: a part is before
all words after its first one in a span, and after all words before its last. Document frequencies follow from the same first and
last places without making the signatures. `encoded` and `of_bags` are the same for words that are a table already.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens as tok
from . import dictionary

#: Greatest weight of a bit.
CAP = 8
#: Bits of signatures that are made at once.
PIECE = 4_000_000


class Spans:
    """The words of a slice of texts by span: row, span (a number in the row), idx (token), place (from 0) and words of the span; and the parts of the words' bags
    as (word, part), with first and last place of each (span, part)."""

    def __init__(self, cut: tok.Cut, bags: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], scale: str, size: int):
        which = np.flatnonzero(cut.word)
        self.size, self.row, self.idx = size, cut.row[which], cut.idx[which]
        self.span = cut.segments()[1 if scale == "sentence" else 2][which]
        self.values = cut.values(which)
        n = len(which)
        opens = np.ones(n, bool)
        opens[1:] = (self.row[1:] != self.row[:-1]) | (self.span[1:] != self.span[:-1])
        first = np.flatnonzero(opens)
        self.words = np.diff(np.append(first, n))
        self.of = np.repeat(np.arange(len(first)), self.words)
        self.place = np.arange(n) - first[self.of] if n else np.zeros(0, np.int64)
        self.first = first
        words = self.values.dictionary_encode()
        count, flat = bags(words.dictionary)
        at = np.cumsum(count) - count
        code = np.asarray(words.indices).astype(np.int64)
        k = count[code]
        self.word = np.repeat(np.arange(n), k)
        self.part = flat[np.repeat(at[code] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))] if n else np.zeros(0, np.int64)
        self.word_ends = np.concatenate([[0], np.cumsum(k)]).astype(np.int64)
        key = self.of[self.word] * size + self.part
        order = np.argsort(key, kind="stable")  # words of a key stay in order
        key, place = key[order], self.place[self.word[order]]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        tail = np.append(head[1:], len(key))[: len(head)] - 1
        self.group, self.group_part, self.n = key[head] // size, key[head] % size, tail - head + 1
        self.group_first, self.group_last = place[head], place[tail]

    def frequencies(self) -> np.ndarray:
        """How many of the words' signatures have each bit."""
        bit = np.concatenate([self.group_part + k * self.size for k in range(3)])
        n = np.concatenate([self.words[self.group] - 1 - self.group_first, self.n, self.group_last])
        return np.bincount(bit, n, 3 * self.size).astype(np.int64)

    def signatures(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first word, word after the last, bits per word, bits): bits ascend within each word."""
        before, after = self.words[self.group] - 1 - self.group_first, self.group_last
        bits = np.bincount(self.group, before + after, len(self.words)) + np.bincount(self.of[self.word], minlength=len(self.words)) if len(self.words) else np.zeros(0)
        at, ends = 0, np.append(self.first, len(self.row))
        starts = np.searchsorted(self.group, np.arange(len(self.words) + 1))
        while at < len(self.words):
            to = max(at + 1, int(np.searchsorted(np.cumsum(bits[at:]), PIECE, side="right")) + at)
            g = slice(starts[at], starts[to])
            base, part = self.first[self.group[g]], self.group_part[g]
            keys = []
            # before: from the word after the first one with the part on; after: up to the word before the last one
            for k, low, count in ((0, base + self.group_first[g] + 1, before[g]), (2, base, after[g])):
                word = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                keys.append(word * (3 * self.size) + np.repeat(part + k * self.size, count))
            i, j = np.searchsorted(self.word, [ends[at], ends[to]])
            keys.append(self.word[i:j] * (3 * self.size) + self.part[i:j] + self.size)
            key = np.sort(np.concatenate(keys))
            yield int(ends[at]), int(ends[to]), np.bincount(key // (3 * self.size) - ends[at], minlength=ends[to] - ends[at]), key % (3 * self.size)
            at = to

    def sums(self, weights: list[np.ndarray]) -> list[np.ndarray]:
        """Of each word's signature, the sum of each of the given whole numbers by bit, without making it: a part counts from the word after its first one in a span
        on, and up to the word before its last."""
        n, out = len(self.row), []
        start = self.first[self.group]
        for w in weights:
            w = w.astype(np.int64)
            before, after = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
            np.add.at(before, start + self.group_first + 1, w[self.group_part])  # one place after a span's last word at most, which is taken back below
            np.add.at(after, start + self.group_last, w[self.group_part + 2 * self.size])
            # running sums begin anew with each span: what has come before it is taken off
            opened = np.zeros(n + 1, np.int64)
            np.add.at(opened, start, w[self.group_part + 2 * self.size])
            begun, ended = np.cumsum(before), np.cumsum(opened) - np.cumsum(after)
            first = np.concatenate([[0], np.cumsum(np.bincount(self.group, minlength=len(self.words)).astype(np.int64))])
            gone = np.concatenate([[0], np.cumsum(w[self.group_part])])[first[:-1]]
            own = np.concatenate([[0], np.cumsum(w[self.part + self.size])])
            out.append(begun[:n] - gone[self.of] + ended[:n] + own[self.word_ends[1:]] - own[self.word_ends[:-1]])
        return out


def _bags(shared) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:  # noqa: ANN001
    """Words to sorted, distinct part ids: how many of each word, and all."""
    speller = dictionary.Speller(shared.value)

    def of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        count, flat = speller.parts(words)
        most = int(flat.max(initial=0)) + 1
        key = np.unique(np.repeat(np.arange(len(words)), count) * most + flat)
        return np.bincount(key // most, minlength=len(words)), key % most

    return of


def scan(docs: DataFrame, parts: DataFrame, columns: str, work: Callable[[Spans], Iterator[list]], last: Callable[[], Iterator[list]] | None = None, scale: str = "sentence", text: str = "text", key: str = "doc_id") -> DataFrame:
    """The columns of a schema from the spans of all texts: work gives their arrays, the first of which names the rows of the texts if the schema begins with
    the key; last gives more when a task ends. The dictionary goes to all tasks, so it has BROADCAST_PARTS parts at most: beyond that, words
    are a table (`tok.words`), spelt by joins (`dictionary.decomposed`) and encoded by `encoded`."""
    known = dictionary.collected(parts)
    if known is None:
        raise ValueError(f"over {dictionary.BROADCAST_PARTS} parts: use dictionary.decomposed and signatures.encoded")
    size = max((i for i, _, _ in known), default=-1) + 1
    shared, hidden = docs.sparkSession.sparkContext.broadcast(known), key + "_text"
    keyed = columns.startswith(key + " ")
    given = docs.select(F.col(key).alias(key), F.col(text).cast("string").alias(hidden))
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags = _bags(shared)
        for batch in batches:
            for i, j in tok.sliced(batch.column(1)):
                spans = Spans(tok.Cut(batch.column(1).slice(i, j - i)), bags, scale, size)
                for arrays in work(spans):
                    if keyed:
                        arrays[0] = batch.column(0).slice(i, j - i).take(pa.array(arrays[0]))
                    if len(arrays[0]):
                        yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in arrays], names=names)
        for arrays in last() if last else ():
            if len(arrays[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=names)

    if keyed:
        columns = f"`{key}` {given.schema[key].dataType.simpleString()}, " + columns.split(", ", 1)[1]
    return given.mapInArrow(run, columns)


def _lists(count: np.ndarray, flat: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(flat.astype(np.int32)))


def bags(docs: DataFrame, parts: DataFrame, **names) -> DataFrame:  # noqa: ANN003
    """doc_id, sentence, idx, value, bag of each word of the texts."""
    key = names.get("key", "doc_id")

    def work(s: Spans) -> Iterator[list]:
        order = np.lexsort((s.part, s.word))
        yield [s.row, pa.array(s.span.astype(np.int32)), pa.array(s.idx.astype(np.int32)), s.values, _lists(np.bincount(s.word, minlength=len(s.row)), s.part[order])]

    return scan(docs, parts, f"{key} long, sentence int, idx int, value string, bag array<int>", work, **names)


def encoded_texts(docs: DataFrame, parts: DataFrame, **names) -> DataFrame:  # noqa: ANN003
    """doc_id, sentence, idx, bits (ascending: before from 0, current from the dictionary's size, after from twice that) of each word of the texts."""
    key = names.get("key", "doc_id")

    def work(s: Spans) -> Iterator[list]:
        for i, j, count, bits in s.signatures():
            yield [s.row[i:j], pa.array(s.span[i:j].astype(np.int32)), pa.array(s.idx[i:j].astype(np.int32)), _lists(count, bits)]

    return scan(docs, parts, f"{key} long, sentence int, idx int, bits array<int>", work, **names)


def summed_texts(docs: DataFrame, parts: DataFrame, weights: dict[str, np.ndarray], **names) -> DataFrame:  # noqa: ANN003
    """doc_id, sentence, idx and, of each word's signature, the sum of each of the given whole numbers by bit, without making the signatures."""
    key = names.get("key", "doc_id")
    shared = docs.sparkSession.sparkContext.broadcast(list(weights.values()))  # a number for each bit of a dictionary that is sent itself

    def work(s: Spans) -> Iterator[list]:
        yield [s.row, pa.array(s.span.astype(np.int32)), pa.array(s.idx.astype(np.int32)), *s.sums(shared.value)]

    return scan(docs, parts, f"{key} long, sentence int, idx int, " + ", ".join(f"{n} long" for n in weights), work, **names)


def text_frequencies(docs: DataFrame, parts: DataFrame, **names) -> DataFrame:  # noqa: ANN003
    """bit, df: how many signatures of words have each bit; and as bit -1 the number of signatures. Tasks add up, so that each sends a number for each bit."""
    total: list[np.ndarray] = []
    words = [0]

    def work(s: Spans) -> Iterator[list]:
        total[:] = [s.frequencies() + (total[0] if total else 0)]
        words[0] += len(s.row)
        return iter(())

    def last() -> Iterator[list]:
        some = np.flatnonzero(total[0]) if total else np.zeros(0, np.int64)
        yield [np.append(some, -1).astype(np.int32), np.append(total[0][some] if total else some, words[0])]
        total.clear()
        words[0] = 0

    found = scan(docs, parts, "bit int, df long", work, last, **names)
    return found.groupBy("bit").agg(F.sum("df").alias("df")).where("df > 0")


def ranges(docs: DataFrame, parts: DataFrame, **names) -> DataFrame:  # noqa: ANN003
    """doc_id, sentence, part, first, last, n: the first and last place (from 0) of each part in each sentence, and how many words have it."""
    key = names.get("key", "doc_id")

    def work(s: Spans) -> Iterator[list]:
        opens = s.first[s.group]
        yield [s.row[opens], pa.array(s.span[opens].astype(np.int32)), *(pa.array(x.astype(np.int32)) for x in (s.group_part, s.group_first, s.group_last)), pa.array(s.n.astype(np.int64))]

    return scan(docs, parts, f"{key} long, sentence int, part int, first int, last int, n long", work, **names)


def inspected(docs: DataFrame, parts: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id, sentence, idx, value, shown (the word's parts as text), n_before, n_current, n_after: how each word is spelt, and how many bits its signature has in
    each band."""
    words = bags(docs, parts, key=key)
    size = dictionary.collected(parts)
    dim = max((i for i, _, _ in size), default=-1) + 1
    band = np.repeat(np.eye(3, dtype=np.int64), dim, axis=0)
    sums = summed_texts(docs, parts, {"n_before": band[:, 0], "n_current": band[:, 1], "n_after": band[:, 2]}, key=key)
    shown = dictionary.decomposed(words.select("value").distinct(), parts).select("value", F.posexplode("part_ids").alias("i", "part_id"))
    shown = shown.join(dictionary.rendered(parts), "part_id").groupBy("value").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), " ").alias("shown"))
    return words.select(key, "sentence", "idx", "value").join(shown, "value", "left").join(sums, [key, "sentence", "idx"]).select(key, "sentence", "idx", "value", F.coalesce("shown", F.lit("")).alias("shown"), "n_before", "n_current", "n_after")


def encoded(words: DataFrame, size: int, span: list[str], place: str = "idx") -> DataFrame:
    """span, place, before, current, after: bits 0.., size.. and 2 * size.. of each word. words: span columns, place, bag; size: parts in the dictionary.

    A span's parts, with the first and last place of each, come once to each of its words."""
    held = words.select(*span, place, F.explode("bag").alias("part")).groupBy(*span, "part").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    held = held.groupBy(*span).agg(F.array_sort(F.collect_list(F.struct("part", "first", "last"))).alias("held"))  # one entry for each part of the dictionary at most
    out = words.join(held, span, "left")
    moved = lambda which, by: F.coalesce(F.transform(F.filter("held", which), lambda x: x["part"] + by), F.array().cast("array<int>"))
    before, after = moved(lambda x: x["first"] < F.col(place), 0), moved(lambda x: x["last"] > F.col(place), 2 * size)
    return out.select(*span, place, before.alias("before"), F.transform("bag", lambda x: x + size).alias("current"), after.alias("after"))


def frequencies(words: DataFrame, size: int, span: list[str], place: str = "idx") -> DataFrame:
    """bit, df: how many signatures have each bit, without making them. A part is before all words after its first, and after all
    words before its last, of a span."""
    n = words.withColumn("ord", F.row_number().over(Window.partitionBy(*span).orderBy(place))).withColumn("words", F.count("*").over(Window.partitionBy(*span)))
    part = n.select(*span, "ord", "words", F.explode("bag").alias("part")).groupBy(*span, "part").agg(F.min("ord").alias("first"), F.max("ord").alias("last"), F.count("*").alias("n"), F.first("words").alias("words"))
    bands = F.array(F.struct(F.col("part").alias("bit"), (F.col("words") - F.col("first")).alias("df")), F.struct((F.col("part") + size).alias("bit"), F.col("n").alias("df")), F.struct((F.col("part") + 2 * size).alias("bit"), (F.col("last") - 1).cast("long").alias("df")))
    return part.select(F.explode(bands).alias("b")).groupBy("b.bit").agg(F.sum("b.df").cast("long").alias("df")).where("df > 0")


def surprisal_weights(df: DataFrame, n: int, cap: int = CAP) -> DataFrame:
    """bit, df, w: surprisal ln(n / df) scaled to 1..cap. n: the number of signatures."""
    s = F.round(F.log(F.lit(float(n)) / F.col("df")), 12)
    most = F.max("s").over(Window.partitionBy())  # a row for each bit of the dictionary
    w = F.when(F.col("most") <= 0, 1).otherwise(F.least(F.greatest(F.floor(1.5 + (max(cap, 1) - 1.0) * (F.col("s") / F.col("most"))), F.lit(1)), F.lit(max(cap, 1))))
    return df.withColumn("s", s).withColumn("most", most).select("bit", "df", w.cast("int").alias("w"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct bits; 0 where both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(both / F.nullif(F.size(a) + F.size(b) - both, F.lit(0)), F.lit(0.0))


def dense_jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of 64-bit words."""
    count = lambda f: F.aggregate(F.zip_with(a, b, f), F.lit(0), lambda s, x: s + F.bit_count(x))
    return F.coalesce(count(lambda x, y: x.bitwiseAND(y)) / F.nullif(count(lambda x, y: x.bitwiseOR(y)), F.lit(0)), F.lit(0.0))


def dense(bits: DataFrame) -> DataFrame:
    """id, word (from 0), bits: sets of bits (id, bit) as 64-bit words, of which those without a bit are left out."""
    return bits.groupBy("id", F.expr("bit div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))


def dense_arrays(bits: DataFrame) -> DataFrame:
    """id, bits: sets of bits (id, bit) as arrays of 64-bit words, all as long as the greatest bit needs."""
    d = dense(bits)
    most = d.agg(F.max("word")).first()[0] or 0
    words = d.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))  # one entry for each word of an id
    return words.select("id", F.transform(F.sequence(F.lit(0), F.lit(most)), lambda k: F.coalesce(F.element_at("m", k), F.lit(0).cast("long"))).alias("bits"))


def information(bits: DataFrame, weights: DataFrame, key: list[str]) -> DataFrame:
    """key, ic: the sum of the weights of each signature's bits. bits: key, bit."""
    return bits.join(weights, "bit").groupBy(*key).agg(F.sum("w").cast("long").alias("ic"))


def weighted_jaccard(pairs: DataFrame, bits: DataFrame, weights: DataFrame) -> DataFrame:
    """a, b, wdot, jaccard of pairs (a, b) of signature ids. bits: id, bit."""
    w = bits.join(weights.select("bit", "w"), "bit")
    ic = w.groupBy("id").agg(F.sum("w").cast("long").alias("ic"))
    common = pairs.join(w.select(F.col("id").alias("a"), "bit", "w"), "a").join(bits.select(F.col("id").alias("b"), "bit"), ["b", "bit"]).groupBy("a", "b").agg(F.sum("w").cast("long").alias("wdot"))
    out = pairs.join(common, ["a", "b"], "left").join(ic.toDF("a", "ia"), "a", "left").join(ic.toDF("b", "ib"), "b", "left").na.fill(0, ["wdot", "ia", "ib"])
    return out.select("a", "b", "wdot", F.when(F.col("wdot") > 0, F.col("wdot") / (F.col("ia") + F.col("ib") - F.col("wdot"))).otherwise(0.0).alias("jaccard"))
