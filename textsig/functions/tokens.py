"""Word and delimiter tokens of texts, with the sentence and paragraph that each belongs to, in one scan without a shuffle.

Words are ASCII letters and digits, joined by connectors inside them (hyphen, ampersand, apostrophe; comma or point between
digits; points of acronyms), with a sign or currency before a number, in lower case. All else is a delimiter: a run of white
space by its kind, or of other signs.

Whether a byte belongs to a word depends on the bytes next to it and, for an apostrophe after a word, on those before: so a whole batch of
texts is cut at once, by comparisons of arrays over its bytes. What is asked of the tokens is counted where they are cut, as far as it can
be (`counts`, `totals`, `spans`), so that tokens are only moved to the JVM where they are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ABBREVIATIONS = frozenset(
    "mr mrs ms miss dr prof sr jr st sen rep gov pres gen rev hon capt cpl sgt lt col maj adm jan feb mar apr jun jul aug sep sept oct nov dec "
    "mon tue tues wed thu thur thurs fri sat sun vs etc ave blvd rd mt ft inc ltd co corp dept no vol ch pg pp ed eds".split()
)
MAX_PARAGRAPH = 4096
#: Bytes of text that are cut at once, or one longer text.
SLICE = 1 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_DIGIT, _LETTER, _JOIN, _PART, _SIGN, _MONEY, _SPACE = 1, 2, 4, 8, 16, 32, 128
_ALNUM = _DIGIT | _LETTER
_CLASS = np.zeros(256, np.uint8)
for _chars, _bit in (("0123456789", _DIGIT), (_UPPER + _LOWER, _LETTER), ("-&'", _JOIN), (",.", _PART), ("+-", _SIGN), ("$", _MONEY), (" \t\r\n", _SPACE)):
    _CLASS[[ord(x) for x in _chars]] |= _bit
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_HYPHEN, _POINT, _QUOTE, _LINE = (ord(x) for x in "-.'\n")
_COMMON = pa.array(sorted(ABBREVIATIONS))


def ascii_lower(c: Column) -> Column:
    """Lower case of ASCII letters alone."""
    return F.translate(c, _UPPER, _LOWER)


def space_kind(c: Column) -> Column:
    """A run of white space as paragraph break, line break, blank or tab."""
    lines = F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    return F.when(lines >= 2, F.lit("\n\n")).when(lines == 1, F.lit("\n")).when(c == " ", F.lit(" ")).otherwise(F.lit("\t"))


def sign_kind(c: Column) -> Column:
    """A run of other signs, with three or more points as one ellipsis and two or more hyphens as one dash."""
    return F.when(c.rlike(r"^\.{3,}$"), "...").when(c.rlike("^-{2,}$"), "--").otherwise(c)


def _strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string column; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def sliced(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes of text, or of one longer row."""
    off, i = _strings(column)[1], 0
    while i < len(column):
        j = min(len(column), max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1))
        yield i, j
        i = j


def _sum(flag: np.ndarray) -> np.ndarray:
    """How many before each place, with one place more."""
    out = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=out[1:])
    return out


class Cut:
    """The tokens of a column of texts: row, idx (from 0 in each row), word (or delimiter), value; `first`: each row's first token, and their number."""

    def __init__(self, column: pa.Array):
        data, off = _strings(column)
        self.data, self.off = data, off
        c = _CLASS[data]
        word, opens = self._words(c)
        kind = np.where(word, np.uint8(1), np.where(c & _SPACE, np.uint8(2), np.uint8(0)))
        start = np.ones(len(data), bool)
        start[1:] = kind[1:] != kind[:-1]
        start[opens] = True
        start[off[:-1][off[:-1] < len(data)]] = True
        self.start = np.flatnonzero(start)
        self.end = np.append(self.start[1:], len(data))[: len(self.start)]
        self.kind = kind[self.start]
        self.word, self.space = self.kind == 1, self.kind == 2
        self.first = np.searchsorted(self.start, off)
        self.row = np.repeat(np.arange(len(off) - 1), np.diff(self.first))
        self.idx = np.arange(len(self.start)) - self.first[self.row]
        lines = _sum(data == _LINE)
        self.lines = lines[self.end] - lines[self.start]

    def _words(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which bytes belong to words, where a token begins besides where bytes of another kind do)."""
        data, off = self.data, self.off
        word = (c & _ALNUM) > 0

        def near(at: np.ndarray):  # noqa: ANN202
            row = np.searchsorted(off, at, side="right") - 1
            low, high = off[row], off[row + 1]

            def beside(k: int, of: np.ndarray) -> np.ndarray:
                i = at + k
                return np.where((i >= low) & (i < high), of[np.clip(i, 0, len(of) - 1)], 0)

            return row, low, beside

        # connectors inside words
        at = np.flatnonzero(c & (_JOIN | _PART))
        _, _, beside = near(at)
        l1, l2, l3, r1 = (beside(k, c) for k in (-1, -2, -3, 1))
        alone = (beside(-2, data) == _POINT) | ~(((l2 & _ALNUM) > 0) | (((l2 & _JOIN) > 0) & ((l3 & _ALNUM) > 0)))
        inner = ((c[at] & _JOIN) > 0) & ((l1 & _ALNUM) > 0) & ((r1 & _ALNUM) > 0)
        inner |= ((c[at] & _PART) > 0) & ((l1 & _DIGIT) > 0) & ((r1 & _DIGIT) > 0)
        inner |= (data[at] == _POINT) & ((l1 & _LETTER) > 0) & ((r1 & _ALNUM) > 0) & alone
        word[at[inner]] = True
        # an apostrophe after a word belongs to it unless a quotation is open: one that does so, or closes one, ends it
        at = np.flatnonzero(data == _QUOTE)
        row, _, beside = near(at)
        after, before = (beside(-1, c) & _ALNUM) > 0, (beside(1, c) & _ALNUM) > 0
        closes, turns = after & ~before, ~after
        turned = _sum(turns)[:-1]
        k = np.arange(len(at))
        last = np.maximum.accumulate(np.where(closes, k, -1)) if len(at) else k
        last = np.concatenate([[-1], last[:-1]]).astype(np.int64) if len(at) else last
        head = np.searchsorted(row, row)  # the row's first apostrophe
        since = turned - turned[np.maximum(last, head)]
        taken = at[closes & (since % 2 == 0)]
        word[taken] = True
        # signs and currency before numbers, unless a hyphen goes on a run of hyphens after a word, white space or nothing
        at = np.flatnonzero(c & (_SIGN | _MONEY))
        row, low, beside = near(at)
        l1, r1, r2 = beside(-1, c), beside(1, c), beside(2, c)
        sign = ((c[at] & _SIGN) > 0) & (((r1 & _DIGIT) > 0) | (((r1 & _MONEY) > 0) & ((r2 & _DIGIT) > 0)))
        sign |= ((c[at] & _MONEY) > 0) & ((r1 & _DIGIT) > 0)
        sign &= (l1 & _ALNUM) == 0
        hyphens = np.flatnonzero(sign & (data[at] == _HYPHEN) & (beside(-1, data) == _HYPHEN))
        if len(hyphens):
            dash = data == _HYPHEN
            solid = np.maximum.accumulate(np.where(dash, -1, np.arange(len(data))))[at[hyphens]]
            sign[hyphens] = ~((solid < low[hyphens]) | word[solid] | ((c[solid] & _SPACE) > 0))
        signs = at[sign]
        word[signs] = True
        mark = np.zeros(len(data) + 1, bool)
        mark[signs] = True
        second = mark[signs - 1] & ((c[signs] & _MONEY) > 0) & ((c[signs - 1] & _SIGN) > 0) & (signs > low[sign])
        after = taken + 1
        return word, np.concatenate([signs[~second], after[after < len(data)]])

    def __len__(self) -> int:
        return len(self.start)

    def values(self, which: np.ndarray | None = None) -> pa.Array:
        """The tokens' values, or those of the tokens at these places."""
        start, end = (self.start, self.end) if which is None else (self.start[which], self.end[which])
        kind, lines = (self.kind, self.lines) if which is None else (self.kind[which], self.lines[which])
        size, data = end - start, _FOLD[self.data]
        if which is None:
            offsets = np.append(start, len(data))
        else:
            offsets = np.concatenate([[0], np.cumsum(size)])
            data = data[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])]
        raw = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        head = self.data[np.minimum(start, max(0, len(self.data) - 1))] if len(self.data) else np.zeros(0, np.uint8)
        points, hyphens = _sum(self.data == _POINT), _sum(self.data == _HYPHEN)
        long = size > 1
        code = np.full(len(start), -1)
        code[(kind == 2) & (long | (head == 13))] = 3
        code[(kind == 2) & (lines == 1) & long] = 1
        code[(kind == 2) & (lines > 1)] = 0
        code[(kind == 0) & (size > 2) & (points[end] - points[start] == size)] = 4
        code[(kind == 0) & long & (hyphens[end] - hyphens[start] == size)] = 5
        other = code >= 0
        if other.any():
            given = pa.array(["\n\n", "\n", " ", "\t", "...", "--"], pa.large_string()).take(pa.array(code[other]))
            raw = pc.replace_with_mask(raw, pa.array(other), given)
        return raw.cast(pa.string()) if raw.nbytes < 1 << 31 else raw

    def ends(self) -> np.ndarray:
        """Which tokens end a sentence: a delimiter with a full stop, question or exclamation mark and no comma or semicolon after that; not after an
        abbreviation; after an acronym only at the end of a line or text; not inside what has an @ or :// since the last white space."""
        n = len(self)
        out = np.zeros(n, bool)
        if not n:
            return out
        marks, pauses = np.flatnonzero(np.isin(self.data, np.frombuffer(b".!?", np.uint8))), np.flatnonzero(np.isin(self.data, np.frombuffer(b",;", np.uint8)))
        i = np.flatnonzero(self.kind == 0)
        at = np.searchsorted(marks, self.start[i])
        some = at < np.searchsorted(marks, self.end[i])
        i, at = i[some], marks[at[some]]
        i = i[np.searchsorted(pauses, at) == np.searchsorted(pauses, self.end[i])]
        prior = np.maximum(i - 1, 0)
        behind = (self.idx[i] > 0) & self.word[prior]
        short = np.zeros(len(i), bool)
        short[behind] = np.asarray(pc.is_in(self.values(prior[behind]), _COMMON.cast(pa.string())))
        points = _sum(self.data == _POINT)
        dotted = behind & (points[self.end[prior]] > points[self.start[prior]])
        last = self.idx[i] + 1 == np.diff(self.first)[self.row[i]]
        then = np.minimum(i + 1, n - 1)
        line = ~last & self.space[then] & (self.lines[then] > 0)
        # the last token before i that opens a stretch without sentence ends, and the last white space
        opens = np.zeros(n, bool)
        d = self.data
        at_sign = (self.kind == 0) & (self.end - self.start == 1) & (d[self.start] == ord("@"))
        opens |= at_sign
        colon = np.flatnonzero((d[:-2] == ord(":")) & (d[1:-1] == ord("/")) & (d[2:] == ord("/"))) if len(d) > 2 else np.zeros(0, np.int64)
        own = np.searchsorted(self.start, colon, side="right") - 1
        opens[own[colon + 2 < self.end[own]]] = True
        k = np.arange(n)
        before = lambda flag: np.concatenate([[-1], np.maximum.accumulate(np.where(flag, k, -1))[:-1]])[i]
        opened = before(opens)
        url = (opened >= self.first[self.row[i]]) & (opened > before(self.space))
        out[i] = ~short & np.where(dotted, last | line, ~(url & ~last & self.word[then]))
        return out

    def segments(self, most: int = MAX_PARAGRAPH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether it ends a sentence, its sentence, its paragraph) of each token. Paragraphs over `most` tokens are cut."""
        ends = self.ends()
        before = _sum(ends)[:-1]
        base = self.first[self.row]
        breaks = self.space & (self.lines > 1)
        opens = self.idx == 0
        opens[1:] |= breaks[:-1]
        k = np.arange(len(self))
        since = k - np.maximum.accumulate(np.where(opens, k, 0)) if len(self) else k
        new = (opens & (self.idx > 0)) | ((since > 0) & (since % max(1, most) == 0))
        number = np.cumsum(new)
        return ends, before - before[base], number - number[base]


def tokenize(text: str) -> list[tuple[str, str]]:
    """(W or D, value) of each token."""
    cut = Cut(pa.array([text]))
    return list(zip(np.where(cut.word, "W", "D").tolist(), cut.values().to_pylist()))


def segment(text: str, most: int = MAX_PARAGRAPH) -> tuple[list[bool], list[int], list[int]]:
    """Of each token of a text: whether it ends a sentence, its sentence and its paragraph."""
    return tuple(x.tolist() for x in Cut(pa.array([text])).segments(most))


def _mapped(docs: DataFrame, text: str, key: str, columns: list[tuple[str, str, pa.DataType]], work, keyed: bool = True, keys: bool = False) -> DataFrame:  # noqa: ANN001
    """key (if keyed), columns: work(cut), or with keys work(cut, the rows' keys), gives (row of each result, columns) for each slice of the texts."""
    hidden = key + "_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in sliced(batch.column(1)):
                cut = Cut(batch.column(1).slice(i, j - i))
                row, *got = work(cut, batch.column(0).slice(i, j - i)) if keys else work(cut)
                arrays = [x if isinstance(x, pa.Array) else pa.array(x) for x in got]
                arrays = [x.cast(t) for x, (_, _, t) in zip(arrays, columns)]
                if keyed:
                    arrays.insert(0, batch.column(0).slice(i, j - i).take(pa.array(row)))
                if len(arrays[0]):
                    yield pa.RecordBatch.from_arrays(arrays, names=names)

    given = docs.select(F.col(key).alias(key), F.col(text).cast("string").alias(hidden))
    names = [key] * keyed + [n for n, _, _ in columns]
    schema = (f"`{key}` {given.schema[key].dataType.simpleString()}, " if keyed else "") + ", ".join(f"{n} {t}" for n, t, _ in columns)
    return given.mapInArrow(run, schema)


_KINDS = pa.array(["D", "W"])


def tokens(docs: DataFrame, text: str = "text", key: str = "doc_id", most: int = MAX_PARAGRAPH, segmented: bool = True) -> DataFrame:
    """key, idx, type, value and, if segmented, ends (a sentence), sentence, paragraph: a row for each token. Null texts have none."""
    columns = [("idx", "int", pa.int32()), ("type", "string", pa.string()), ("value", "string", pa.string())]
    if segmented:
        columns += [("ends", "boolean", pa.bool_()), ("sentence", "int", pa.int32()), ("paragraph", "int", pa.int32())]
    return _mapped(docs, text, key, columns, lambda cut: (cut.row, cut.idx, _KINDS.take(pa.array(cut.word.astype(np.int8))), cut.values(), *(cut.segments(most) if segmented else ())))


def words(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, sentence, idx, value: a row for each word."""

    def work(cut: Cut):  # noqa: ANN202
        which = np.flatnonzero(cut.word)
        return cut.row[which], cut.segments()[1][which], cut.idx[which], cut.values(which)

    return _mapped(docs, text, key, [("sentence", "int", pa.int32()), ("idx", "int", pa.int32()), ("value", "string", pa.string())], work)


def frequencies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """type, value, n: the frequency of each word (type W) and delimiter (D), counted by slices of the texts before they are shuffled."""

    def work(cut: Cut):  # noqa: ANN202
        w, d = (cut.values(np.flatnonzero(cut.word == kind)).value_counts() for kind in (True, False))
        kinds = np.repeat([1, 0], [len(w), len(d)]).astype(np.int8)
        return None, _KINDS.take(pa.array(kinds)), *(pa.concat_arrays([w.field(x), d.field(x)]) for x in ("values", "counts"))

    part = _mapped(docs, text, key, [("type", "string", pa.string()), ("value", "string", pa.string()), ("n", "long", pa.int64())], work, keyed=False)
    return part.groupBy("type", "value").agg(F.sum("n").alias("n"))


def counts(docs: DataFrame, kind: str = "W", text: str = "text", key: str = "doc_id") -> DataFrame:
    """value, n: the frequency of each word (kind W) or delimiter (D)."""

    def work(cut: Cut):  # noqa: ANN202
        found = cut.values(np.flatnonzero(cut.word == (kind == "W"))).value_counts()
        return None, found.field("values"), found.field("counts")

    part = _mapped(docs, text, key, [("value", "string", pa.string()), ("n", "long", pa.int64())], work, keyed=False)
    return part.groupBy("value").agg(F.sum("n").alias("n"))


def distinct_words(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, value: the distinct words of each key, found by slices of the texts before they are shuffled."""

    def work(cut: Cut, keys: pa.Array):  # noqa: ANN202
        which = np.flatnonzero(cut.word)
        values, keys = cut.values(which).dictionary_encode(), keys.dictionary_encode()
        own = np.asarray(keys.indices.fill_null(-1)).astype(np.int64)[cut.row[which]]
        unlike = np.unique((own + 1) << 32 | np.asarray(values.indices).astype(np.int64))
        first = np.full(len(keys.dictionary) + 1, -1)  # a row of each key
        at = np.asarray(keys.indices.fill_null(-1)).astype(np.int64) + 1
        first[at[::-1]] = np.arange(len(at))[::-1]
        return first[unlike >> 32], values.dictionary.take(pa.array(unlike & 0xFFFFFFFF))

    return _mapped(docs, text, key, [("value", "string", pa.string())], work, keys=True).distinct()


def totals(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, tokens, words, delims, distinct_words of each row that has a token."""

    def work(cut: Cut):  # noqa: ANN202
        which = np.flatnonzero(cut.word)
        n = len(cut.off) - 1
        code = np.asarray(cut.values(which).dictionary_encode().indices).astype(np.int64)
        unlike = np.unique(cut.row[which] << 32 | code) >> 32
        every, own = np.diff(cut.first), np.bincount(cut.row[which], minlength=n)
        some = np.flatnonzero(every)
        return some, every[some], own[some], (every - own)[some], np.bincount(unlike, minlength=n)[some]

    return _mapped(docs, text, key, [(n, "long", pa.int64()) for n in ("tokens", "words", "delims", "distinct_words")], work)


def spans(docs: DataFrame, scale: str = "sentence", text: str = "text", key: str = "doc_id", most: int = MAX_PARAGRAPH) -> DataFrame:
    """key, span, start_tok, end_tok (excluded), words: the sentences or paragraphs of each row."""

    def work(cut: Cut):  # noqa: ANN202
        span = cut.segments(most)[1 if scale == "sentence" else 2]
        first = np.flatnonzero((cut.idx == 0) | np.concatenate([[True], span[1:] != span[:-1]])[: len(span)])
        inside = _sum(cut.word)
        end = np.append(first[1:], len(cut))[: len(first)]
        return cut.row[first], span[first], cut.idx[first], cut.idx[first] + end - first, inside[end] - inside[first]

    return _mapped(docs, text, key, [("span", "int", pa.int32()), ("start_tok", "int", pa.int32()), ("end_tok", "int", pa.int32()), ("words", "long", pa.int64())], work)
