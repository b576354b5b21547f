"""Byte-level BPE encoding and decoding.

The merges are compiled into a transducer over bytes. While it reads a pre-token it keeps the boundaries at which a
vocabulary entry may still begin that reaches past the place read so far, each with the last token of the encoding of all
before it. That token is the one entry that ends there and is compatible with what precedes it (two tokens are if merging
their bytes gives the two again), so a step needs only the boundaries that are alive. What all of them share is certain and is
emitted; the wait is bounded by the longest entry. Sets of live boundaries are named as states when they first occur, up to
STATES of them, and transitions are tables from then on: the automaton is determinised lazily. Each distinct pre-token of a task runs through it
once. Large corpora have more states than there are names; from then on the new pre-tokens of a chunk go through the transducer side by
side, in arrays (`Transducer.together`): what follows each boundary in the trie is found for all of them, and then at each step the last token at one
boundary of each.

Decoding joins the tokens' bytes and turns them to text piece by piece; `Utf8` holds back an unfinished character until
its other bytes arrive.

Defined results: a null text encodes to null, an empty one to no tokens; every row gives one row, repeated rows too; null ids
are carried; further columns are ignored. Ids outside the vocabulary, and null ids, decode to U+FFFD.
"""

from __future__ import annotations

import hashlib
import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vec

#: The rank file of a public tokenizer: base64 of the bytes and the rank, a line for each entry.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
STATES, REMEMBERED = 60_000, 600_000
#: Pre-tokens from which on, and bytes of pre-tokens up to which, they go through the transducer side by side; pairs of tokens whose compatibility is kept then.
SEVERAL, BESIDE, PAIRS = 32, 1 << 15, 1 << 18
_LETTER, _NUMBER, _SPACE = 1, 2, 3
_classes: list[np.ndarray] = []


def load(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _class_table() -> np.ndarray:
    """0 other, 1 letter, 2 number, 3 white space, by code point."""
    if not _classes:
        table, every = np.zeros(0x110000, np.uint8), "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                a, b = (x + 0x800 * (x >= 0xD800) for x in (m.start(), m.end() - 1))
                table[a : b + 1] = kind
        _classes.append(table)
    return _classes[0]


def pretokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, number by row) of the pre-tokens of UTF-8 rows: contractions, letters, numbers and other signs, each
    with one blank before it, and white space, as the pattern of the rank files has them."""
    rows = len(off) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(rows, np.int64)
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(cp)
    if n == len(data):
        at = np.arange(n + 1)
        roff = off
    else:
        at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        roff = np.searchsorted(at, off)
    kind = _class_table()[cp]
    edge = np.zeros(n + 1, bool)
    edge[roff] = True
    turn = edge[:-1].copy()
    turn[1:] |= kind[1:] != kind[:-1]
    start = turn.copy()
    after = np.append(turn[1:], True)  # the last of its run
    inner = after & ~edge[1:] & (kind == _SPACE)  # the last blank of a run before something else
    start[inner] = True
    glued = np.flatnonzero(inner & (cp == 32)) + 1
    start[glued] = False
    mark = np.flatnonzero((cp == 39) & start)
    if len(mark):
        nxt = lambda k: np.where(mark + k < n, cp[np.minimum(mark + k, n - 1)], 0) * ~np.logical_or.reduce([edge[np.minimum(mark + j, n)] for j in range(1, k + 1)])
        one, two = nxt(1), nxt(2)
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        for pair in ("re", "ve", "ll"):
            size = np.where((one == ord(pair[0])) & (two == ord(pair[1])), 2, size)
        m, size = mark[size > 0], size[size > 0]
        start[m + 1] = False
        end = m + 1 + size
        start[end[end < n]] = True
    s = np.flatnonzero(start)
    begin = at[s]
    return begin, np.append(begin[1:], len(data)), np.diff(np.searchsorted(s, roff))


class Table:
    """Values (0 or more) of distinct 64-bit keys, of which many are looked up at a time: -1 where there is none. Open addressing, a quarter full."""

    FREE = np.uint64(2**64 - 1)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = (4 * len(keys) + 15).bit_length()
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, self.FREE), np.full(1 << bits, -1, np.int32)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] == self.FREE
            self.keys[at[free]] = keys[free]  # of several with one slot, one gets it
            got = self.keys[at] == keys
            self.values[at[got]] = values[got]
            at, keys, values = (at[~got] + 1) & self.last, keys[~got], values[~got]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        there = self.keys[at]
        hit = there == keys
        out = np.where(hit, self.values[at], -1)
        left = np.flatnonzero(~hit & (there != self.FREE))
        at = at[left]
        while len(left):
            at = (at + 1) & self.last
            there, want = self.keys[at], keys[left]
            hit = there == want
            out[left[hit]] = self.values[at[hit]]
            more = ~hit & (there != self.FREE)
            left, at = left[more], at[more]
        return out


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pair: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self._spell(ranks)
        self.child: list[dict[int, int]] = [{}]
        self.token = [-1]
        for word, t in ranks.items():
            if t not in self.halves:
                continue  # the merges never make this entry
            node = 0
            for byte in word:
                following = self.child[node].get(byte)
                if following is None:
                    following = self.child[node][byte] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                node = following
            self.token[node] = t
        self._compatible: dict[tuple[int, int], bool] = {}
        self._arrays: tuple | None = None
        self._reset()

    def _spell(self, ranks: dict[bytes, int]) -> None:
        """The merge that makes each entry, in order of rank."""
        for word, t in sorted(ranks.items(), key=lambda x: x[1]):
            if len(word) == 1:
                self.halves[t] = (t, t)
                continue
            parts = [ranks.get(word[i : i + 1], -1) for i in range(len(word))]
            while len(parts) > 2:
                best, where = 1 << 60, -1
                for i in range(len(parts) - 1):
                    r = self.pair.get((parts[i], parts[i + 1]))
                    if r is not None and r < best:
                        best, where = r, i
                if where < 0:
                    break
                parts[where : where + 2] = [best]
            if len(parts) == 2 and -1 not in parts:
                self.halves[t] = (parts[0], parts[1])
                self.pair[parts[0], parts[1]] = t

    def compatible(self, a: int, b: int) -> bool:
        """Whether the bytes of a then b encode to a, b: undoing merges from the latest on, no pair across the border may have been due earlier."""
        key = (a, b)
        known = self._compatible.get(key)
        if known is None:
            due, pair, halves = 1 << 60, self.pair, self.halves
            while True:
                made = pair.get((a, b))
                if made is not None and made < due:
                    known = False
                    break
                left, right = halves[a][1], halves[b][0]
                if left == a and right == b:
                    known = True
                    break
                if right == b or (left != a and a > b):
                    a, due = left, a
                else:
                    b, due = right, b + 1
            if len(self._compatible) > 3 * STATES:
                self._compatible.clear()
            self._compatible[key] = known
        return known

    def _reset(self) -> None:
        start = ((-1, -1, 0),)  # boundaries: (which it follows, the token between, node of the trie of what came since or -1)
        self.names: dict[tuple, int] = {start: 0}
        self.states: list[tuple] = [start]
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]
        self.ends: list[tuple[int, ...] | None] = [None]

    def _step(self, state: tuple, byte: int) -> tuple[tuple, tuple[int, ...]]:
        child, token, known, moved, new, alive = self.child, self.token, self._compatible, [], None, 0
        for i, (parent, last, node) in enumerate(state):
            if node >= 0:
                node = child[node].get(byte, -1)
                if node >= 0:
                    alive += 1
                    if new is None and (t := token[node]) >= 0 and (last < 0 or (known[last, t] if (last, t) in known else self.compatible(last, t))):
                        new = (i, t, 0)
            moved.append((parent, last, node))
        if new is None:
            raise ValueError(f"the vocabulary has no entry for byte {byte}")
        moved.append(new)
        if not alive:  # all is certain but what follows the new boundary
            return ((-1, new[1], 0),), self._path(moved)
        n = len(moved)
        needed = [node >= 0 for _, _, node in moved]
        children = [0] * n
        for i in range(n - 1, 0, -1):
            if needed[i]:
                parent = moved[i][0]
                needed[parent] = True
                children[parent] += 1
        # a path shared by all that is alive is certain
        root, out = 0, ()
        while moved[root][2] < 0 and children[root] == 1:
            needed[root] = False
            root = next(i for i in range(root + 1, n) if needed[i] and moved[i][0] == root)
            out += (moved[root][1],)
        at = [0] * n
        kept = [(-1, moved[root][1], moved[root][2])]
        for i in range(root + 1, n):
            if needed[i]:
                parent, last, node = moved[i]
                at[i] = len(kept)
                kept.append((at[parent], last, node))
        return tuple(kept), out

    @staticmethod
    def _path(bounds) -> tuple[int, ...]:  # noqa: ANN001
        """The tokens up to the last boundary."""
        out, i = [], len(bounds) - 1
        while bounds[i][0] >= 0:
            out.append(bounds[i][1])
            i = bounds[i][0]
        return tuple(reversed(out))

    def _name(self, state: tuple) -> int:
        """The state's name; -1 if it has none and there is room for no more."""
        name = self.names.get(state, -1)
        if name < 0 and len(self.states) < STATES:
            name = self.names[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
            self.ends.append(None)
        return name

    def move(self, state: int, byte: int) -> tuple[int | tuple, tuple[int, ...]]:
        """(next state, by name if it has one, and what is emitted)"""
        got = self.moves[state].get(byte)
        if got is None:
            following, out = self._step(self.states[state], byte)
            name = self._name(following)
            got = (name, out) if name >= 0 else (following, out)
            if name >= 0:
                self.moves[state][byte] = got
        return got

    def end(self, state: int | tuple) -> tuple[int, ...]:
        """What is still to be emitted when the input ends here."""
        if isinstance(state, tuple):
            return self._path(state)
        if self.ends[state] is None:
            self.ends[state] = self._path(self.states[state])
        return self.ends[state]

    def encode(self, piece: bytes) -> list[int]:
        """The tokens of one pre-token. States come by name as far as there are names, and are made on the way beyond."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        out, state, moves = [], 0, self.moves
        for byte in piece:
            if type(state) is int:
                state, some = moves[state].get(byte) or self.move(state, byte)
            else:
                state, some = self._step(state, byte)
                state = self.names.get(state, state)
            if some:
                out.extend(some)
        out.extend(self.end(state))
        return out

    def encode_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all pre-tokens, number by pre-token): one by one as long as there are names for new states, and beyond that side by side,
        but for the few that are much longer than the others."""
        out: list[list[int] | None] = [None] * len(pieces)
        k = 0
        while k < len(pieces) and (len(self.states) < STATES or len(pieces) - k < SEVERAL):
            out[k] = self.encode(pieces[k])
            k += 1
        length = np.array([0 if x is None else len(x) for x in out], np.int64)
        if k == len(pieces):
            return np.fromiter((t for x in out for t in x), np.int32, int(length.sum())), length
        size = np.array([len(p) for p in pieces[k:]], np.int64)
        most = min(BESIDE, max(SEVERAL, int(np.partition(size, -SEVERAL)[-SEVERAL])))
        for i in (k + np.flatnonzero(size > most)).tolist():
            out[i] = self.encode(pieces[i])
        rest = [i for i in range(k, len(pieces)) if out[i] is None]
        for i in rest:
            whole = self.ranks.get(pieces[i])
            if whole is not None:
                out[i] = [whole]
        rest = np.array([i for i in rest if out[i] is None], np.int64)
        cut = np.cumsum(size[rest - k]) // BESIDE
        first = np.flatnonzero(np.concatenate([[True], cut[1:] != cut[:-1]])) if len(rest) else []
        for a, b in zip(first, np.append(first[1:], len(rest))):
            flat, number = self.together([pieces[i] for i in rest[a:b].tolist()])
            ends = np.cumsum(number)
            for i, x, y in zip(rest[a:b].tolist(), (ends - number).tolist(), ends.tolist()):
                out[i] = flat[x:y]
        length = np.array([len(x) for x in out], np.int64)
        return np.concatenate([np.asarray(x, np.int32) for x in out]), length

    def _tables(self) -> tuple[Table, np.ndarray, np.ndarray, Table, np.ndarray, np.ndarray]:
        """The trie (children by node * 512 + byte, tokens), lengths of entries, merges by pair, halves, and pairs known to be compatible or not."""
        if self._arrays is None:
            key = np.array([(node << 9) | byte for node, x in enumerate(self.child) for byte in x], np.uint64)
            child = Table(key, np.array([y for x in self.child for y in x.values()], np.int32))
            most = 1 + max(self.halves, default=-1)
            size, halves = np.zeros(most, np.int64), np.zeros((2, most), np.int64)
            for word, t in self.ranks.items():
                if t in self.halves:
                    size[t], halves[:, t] = len(word), self.halves[t]
            pair = np.array([(a << 32) | b for a, b in self.pair], np.uint64)
            self._arrays = child, np.array(self.token, np.int32), size, Table(pair, np.array([*self.pair.values()], np.int32)), halves, np.full(PAIRS, Table.FREE)
        return self._arrays

    def _all_compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """`compatible` of many pairs. Those asked for lately are kept, each at a place that its bits name, with the answer as the lowest bit."""
        *_, pair, halves, kept = self._tables()
        key = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        at = (vec.mix(key) & np.uint64(PAIRS - 1)).astype(np.int64)
        there = kept[at]
        out = (there & np.uint64(1)).astype(bool)
        new = np.flatnonzero(there >> np.uint64(1) != key)
        left, a, b, due = new, a[new].astype(np.int64), b[new].astype(np.int64), np.full(len(new), 1 << 60)
        while len(left):
            made = pair.get((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64))
            x, y = halves[1][a], halves[0][b]
            wrong = (made >= 0) & (made < due)
            right = ~wrong & (x == a) & (y == b)
            out[left[wrong]], out[left[right]] = False, True
            go = ~(wrong | right)
            left, a, b, x, y = left[go], a[go], b[go], x[go], y[go]
            undo = (y == b) | ((x != a) & (a > b))
            due, a, b = np.where(undo, a, b + 1), np.where(undo, x, a), np.where(undo, b, y)
        kept[at[new]] = (key[new] << np.uint64(1)) | out[new].astype(np.uint64)
        return out

    def together(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all pre-tokens, number by pre-token), none of them empty. There is a boundary before each byte and at the end of each."""
        child, token, length, *_ = self._tables()
        size = np.array([len(p) for p in pieces], np.int64)
        end = np.cumsum(size + 1) - 1
        begin = end - size
        byte = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.uint64)
        byte[end] = 256  # no entry goes on there
        place = np.arange(len(byte)) - np.repeat(begin, size + 1)
        start = np.flatnonzero(byte != 256)
        at, node, found = start, np.zeros(len(start), np.int64), []
        while len(at):
            node = child.get((node.astype(np.uint64) << np.uint64(9)) | byte[at])
            on = node >= 0
            start, at, node = start[on], at[on] + 1, node[on]
            t = token[node]
            some = t >= 0
            found.append((start[some], at[some], t[some]))
        start, at, t = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(place[start], kind="stable")
        start, at, t = start[order], at[order], t[order]
        last = np.full(len(byte), -2, np.int64)  # the last token of the encoding up to each boundary
        last[begin] = -1
        steps = np.searchsorted(place[start], np.arange(int(size.max()) + 1))
        for i, j in zip(steps[:-1], steps[1:]):  # boundaries of one place, which none before can reach any more
            open_ = np.flatnonzero(last[at[i:j]] == -2) + i
            before, t_ = last[start[open_]], t[open_]
            fits = before == -1
            more = np.flatnonzero(before >= 0)
            fits[more] = self._all_compatible(before[more], t_[more])
            last[at[open_[fits]]] = t_[fits]
        lost = np.flatnonzero(last == -2)
        if len(lost):
            raise ValueError(f"the vocabulary has no entry for byte {int(byte[lost[0] - 1])}")
        used, back = np.zeros(len(byte), bool), end
        while len(back):
            used[back] = True
            back = back - length[last[back]]
            back = back[last[back] >= 0]
        return last[used].astype(np.int32), np.add.reduceat(used.astype(np.int64), begin)


class Encoder:
    """Encodes columns of texts, each distinct pre-token once while it is remembered."""

    def __init__(self, ranks: dict[bytes, int]):
        self.transducer = Transducer(ranks)
        self._forget()
        words = sorted(ranks, key=ranks.get)
        ids = [ranks[w] for w in words]
        size = np.zeros((max(ids) if ids else -1) + 2, np.int64)
        size[ids] = [len(w) for w in words]
        size[-1] = 3
        self.start = np.concatenate([[0], np.cumsum(size)])
        self.bytes = np.frombuffer(b"".join(words) + "�".encode(), np.uint8)
        self.size = size

    def _forget(self) -> None:
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.first, self.length, self.flat, self.total = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), 0

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        if len(self.known) > REMEMBERED:
            self._forget()
        flat, length = self.transducer.encode_all(pieces)
        first = self.total + np.cumsum(length) - length
        if self.total + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.total], flat, np.zeros(self.total + len(flat), np.int32)])
        else:
            self.flat[self.total : self.total + len(flat)] = flat
        self.total += len(flat)
        slot = len(self.first) + np.arange(len(hashes))
        self.first, self.length = np.concatenate([self.first, first]), np.concatenate([self.length, length])
        known, slots = np.concatenate([self.known, hashes]), np.concatenate([self.slot, slot])
        order = np.argsort(known, kind="stable")
        self.known, self.slot = known[order], slots[order]

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all rows, number by row)."""
        start, end, count = pretokens(data, off)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(off) - 1, np.int64)
        h = vec.hash_runs(data, start, end)
        distinct, where, back = np.unique(h, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, distinct), max(0, len(self.known) - 1))
        new = self.known[at] != distinct if len(self.known) else np.ones(len(distinct), bool)
        if new.any():
            if len(self.known) > REMEMBERED:
                self._forget()
                new[:] = True
            raw = data.tobytes()
            self._learn(distinct[new], [raw[a:b] for a, b in zip(start[where[new]].tolist(), end[where[new]].tolist())])
            at = np.searchsorted(self.known, distinct)
        slot = self.slot[at][back]
        each = self.length[slot]
        ends = np.cumsum(each)
        flat = self.flat[np.arange(ends[-1]) + np.repeat(self.first[slot] - (ends - each), each)]
        row = np.concatenate([[0], np.cumsum(count)])
        return flat, np.diff(np.concatenate([[0], ends])[row])

    def join(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, where each token begins and the last ends)."""
        ids = np.where((ids < 0) | (ids >= len(self.size) - 1), len(self.size) - 1, ids)
        ids = np.where(self.size[ids] == 0, len(self.size) - 1, ids)
        each = self.size[ids]
        off = np.concatenate([[0], np.cumsum(each)])
        return self.bytes[np.arange(off[-1]) + np.repeat(self.start[ids] - off[:-1], each)], off


class Utf8:
    """Text from bytes that arrive in pieces. Its state is the unfinished character; bytes that are no UTF-8 give U+FFFD."""

    def __init__(self) -> None:
        self.rest = b""

    @staticmethod
    def _unfinished(x: bytes) -> int:
        """How many bytes at the end begin a character that may still be completed."""
        for k in range(1, min(3, len(x)) + 1):
            lead, tail = x[-k], x[len(x) - k + 1 :]
            if 0x80 <= lead < 0xC0:
                continue
            need = 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 1
            low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF))
            return k if need > k and (not tail or low <= tail[0] <= high) else 0
        return 0

    def push(self, piece: bytes) -> str:
        x = self.rest + piece if self.rest else piece
        k = self._unfinished(x)
        self.rest = x[len(x) - k :] if k else b""
        return (x[: len(x) - k] if k else x).decode("utf-8", "replace")

    def finish(self) -> str:
        out, self.rest = self.rest.decode("utf-8", "replace"), b""
        return out


def text_of(encoder: Encoder, ids: np.ndarray, piece: int = 1 << 16) -> str:
    """The text of token ids, decoded in pieces of so many tokens."""
    machine, out = Utf8(), []
    for i in range(0, len(ids), piece):
        out.append(machine.push(encoder.join(ids[i : i + piece])[0].tobytes()))
    return "".join(out) + machine.finish()


def digest(ranks: dict[bytes, int]) -> bytes:
    """Of all entries of a vocabulary."""
    h = hashlib.sha256()
    for piece, rank in ranks.items():
        h.update(b"%d %d " % (len(piece), rank) + piece)
    return h.digest()


def encoder(ranks: dict[bytes, int], key: bytes | None = None) -> Encoder:
    """The encoder that a Python worker keeps for a vocabulary; key: its `digest`, where that is known."""
    return vec.held(("bpe", key or digest(ranks)), lambda: Encoder(ranks))


def _tokens(column: pa.Array, enc: Encoder) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    flat, number = [], []
    for _, _, data, off in vec.chunked(column):
        f, n = enc.encode(data, off)
        flat.append(f)
        number.append(n)
    flat = np.concatenate(flat) if flat else np.zeros(0, np.int32)
    number = np.concatenate(number) if number else np.zeros(0, np.int64)
    off = np.concatenate([[0], np.cumsum(number)])
    null = column.is_null()
    out = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat), mask=null)
    return out, pa.array(number.astype(np.int32), mask=np.asarray(null)), flat, off


def with_tokens(docs: DataFrame, columns: list[str], path: str = RANKS) -> DataFrame:
    """The given columns of docs, and: tokens, n_tokens, exact (whether the tokens decode to the very text)."""
    ranks = load(path)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, digest(ranks)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(*shared.value)
        for b in vec.sliced(batches, hidden):
            text = b.column(b.num_columns - 1)
            tokens, number, flat, off = _tokens(text, enc)
            exact = [None if t is None else text_of(enc, flat[i:j]) == t for t, i, j in zip(text.to_pylist(), off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], tokens, number, pa.array(exact, pa.bool_())], names=[*b.schema.names[:-1], "tokens", "n_tokens", "exact"])

    hidden = max([*columns, ""], key=len) + "_text"  # none of the columns
    given = docs.select(*[F.col(f"`{c}`") for c in columns], F.col("text").cast("string").alias(hidden))
    schema = T.StructType(given.schema.fields[:-1]).add("tokens", T.ArrayType(T.IntegerType())).add("n_tokens", T.IntegerType()).add("exact", T.BooleanType())
    return given.mapInArrow(encode, schema)


def encode(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """doc_id, tokens, n_tokens, exact: a row for each of docs."""
    return with_tokens(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], path)


def decode(encoded: DataFrame, path: str = RANKS) -> DataFrame:
    """doc_id, text of rows with doc_id, tokens."""
    ranks = load(path)
    shared = encoded.sparkSession.sparkContext.broadcast((ranks, digest(ranks)))

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(*shared.value)
        for b in batches:
            texts = [None if x is None else text_of(enc, np.array([-1 if t is None else t for t in x], np.int64)) for x in b.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("tokens").cast("array<int>").alias("tokens")).mapInArrow(back, "doc_id long, text string")
