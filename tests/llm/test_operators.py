"""Each operator against a brute-force version, and its defined results for nulls, empty and long texts, repeated rows and clashing columns."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
import numpy as np
import pyarrow as pa
from textsig.llm import bpe, chats, counts, leaks, licenses, near, parsing, pii, quality, vec, warc
from textsig.llm.shared import written

WORDS = "the of river stone light of and green amber walks under seven bridges öde été niño while quiet harbours drift".split()
#: Columns whose names clash with those the operators use inside.
EXTRA = ["fp", "row_id", "tokens", "h", "label", "__row_id"]
SCHEMA = "doc_id long, text string, lang string, " + ", ".join(f"`{c}` string" for c in EXTRA)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.choice(["", "", ",", "."])) for _ in range(n))


def table(spark, rows, name="docs"):
    return written(spark.createDataFrame([(i, t, "en", *["x"] * len(EXTRA)) for i, t in rows], SCHEMA), name)


ODD = [(None, "no id at all"), (1, None), (2, ""), (3, "   \n\t "), (4, "word"), (4, "word"), (5, "word"), (6, "é" * 20_000), (7, "!!! ???")]


# --- 1


def test_patience_alignment_finds_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randint(0, 9) for _ in range(rng.randint(0, 15))] for _ in range(2))
        got = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
    unique = list(range(30))
    rng.shuffle(unique)
    assert len(licenses.align(unique, unique)) == 30
    # without repeated words the alignment is a longest common subsequence
    for _ in range(100):
        a, b = (rng.sample(range(12), rng.randint(0, 12)) for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        got = len(licenses.align(a, b))
        assert got <= best[-1][-1] and (got > 0) == (best[-1][-1] > 0)


def test_license_scan(spark):
    rng = random.Random(2)
    notice = "Released under the MIT License."
    long = prose(rng, 3000)
    docs = table(spark, [(10, long + "\n" + notice), (11, long), (12, licenses.TEMPLATES["mit"].replace("charge", "cost")), (12, notice), *ODD])
    got = {(r.doc_id, r.license) for r in licenses.scan(docs).collect()}
    assert (10, "mit-notice") in got and (12, "mit") in got and (12, "mit-notice") in got
    assert not {i for i, _ in got} & {11, 1, 2, 3, 4, 5, 6, 7, None}
    assert licenses.scan(docs.limit(0)).count() == 0 and licenses.scan(docs, {}).count() == 0 and licenses.scan(docs, {"x": "..."}).count() == 0


def brute_scan(text, template, coverage=0.8):
    """The most words of the template aligned in any run of the text's words."""
    a, b = licenses.words(text), licenses.words(template)
    best = max((len(licenses.align(a[i:j], b)) for i in range(len(a)) for j in range(i + 1, min(len(a), i + licenses.SPREAD * len(b)) + 1)), default=0)
    return round(best / len(b), 6) if best / len(b) >= coverage - 1e-9 else None


def test_license_scan_against_brute_force(spark):
    rng = random.Random(23)
    names = ["mit-notice", "apache-2.0-notice", "cc-by-nc-4.0-notice"]
    templates = {n: licenses.TEMPLATES[n] for n in names}
    texts = []
    for k in range(60):
        w = licenses.words(templates[rng.choice(names)])
        w = [x for x in w if rng.random() < 0.95] if k % 2 else [y for x in w for y in [x, *(["filler"] * rng.choice([0, 0, 0, 1, 3]))]]
        texts.append(" ".join(rng.choices("the a license under version of mit word".split(), k=rng.randint(0, 12)) + w + rng.choices("the released licensed 4 0 word".split(), k=rng.randint(0, 12))))
    got = {(r.doc_id, r.license): r.coverage for r in licenses.scan(table(spark, list(enumerate(texts))), templates).collect()}
    want = {(i, n): c for i, x in enumerate(texts) for n in names if (c := brute_scan(x, templates[n]))}
    assert got == want and 20 < len(want) < 180


def test_words_strewn_over_a_long_text_are_no_license(spark):
    strewn = [f"w{k}" for k in range(20_000)]
    for at, w in zip((100, 6000, 12_000, 19_000), ("released", "under", "the", "license")):
        strewn[at] = w
    assert licenses.scan(table(spark, [(1, " ".join(strewn))])).count() == 0


def test_license_scan_finds_adjacent_notices(spark):
    rng = random.Random(21)
    the, notice, mit = "the " * 12, "Released under the MIT License. ", licenses.TEMPLATES["mit"]
    texts = [the + notice * 2 + the, f"{mit}\nCopyright (c) 2020 the authors of the software\n{mit}", the + notice.replace("Released", "Distributed") * 3 + the]
    texts.append(prose(rng, 400) + " the license " + f"{mit} and the {mit} ".replace("charge", "cost") + "of the software and the license " * 9 + prose(rng, 400))
    docs = table(spark, list(enumerate(texts)))
    got = {(r.doc_id, r.license): r.coverage for r in licenses.scan(docs).collect()}
    assert got[0, "mit-notice"] == 1 and got[1, "mit"] == 1 and got[2, "mit-notice"] == 0.8 and got[3, "mit"] == round(1 - 1 / len(licenses.words(mit)), 6)


def test_license_scan_is_the_best_of_all_windows():
    rng = random.Random(22)
    scanner, found = licenses.Scanner({"t": "a b a c d e b"}, 0.7), 0
    b = scanner.terms[0].tolist()
    for _ in range(400):
        x = [w for _ in range(rng.randint(1, 4)) for w in [*rng.choices(b, k=rng.randint(0, 6)), *(y for y in b if rng.random() < 0.8)]]
        place = sorted(rng.sample(range(2 * len(x)), len(x))) if rng.random() < 0.5 else list(range(len(x)))  # with other words between
        best = max(len(licenses.align(x[i:j], b)) for i in range(len(x)) for j in range(i + 1, len(x) + 1) if place[j - 1] - place[i] < licenses.SPREAD * len(b))
        got = scanner.match(x, place, 0)
        assert (got[0] if got else 0) == (best if best >= scanner.need[0] else 0)
        found += got is not None
    assert 50 < found


# --- 2


def brute_pairs(rows, n=2, t=0.7):
    sets = []
    for i, text in rows:
        w = licenses.words(text or "")
        g = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
        if i is not None and g:
            sets.append((i, g))
    out = {}
    for x in range(len(sets)):
        for y in range(x + 1, len(sets)):
            (i, a), (j, b) = sets[x], sets[y]
            s = len(a & b) / len(a | b)
            if i != j and s >= t - 1e-9:
                key = (min(i, j), max(i, j))
                out[key] = max(out.get(key, 0), round(s, 6))
    return out


def near_rows(seed, base=40):
    rng = random.Random(seed)
    rows = list(ODD)
    for k in range(base):
        w = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([1, 2, 3, 8, 30, 120, 400]))]
        rows.append((100 + 10 * k, " ".join(w)))
        for c in range(1, rng.randint(1, 5)):
            v = list(w)
            for _ in range(int(len(v) * rng.choice([0, 0.02, 0.05, 0.1, 0.2]))):
                v[rng.randrange(len(v))] = f"x{rng.randint(0, 99)}"
            rows.append((100 + 10 * k + c, " ".join(v)))
    return [*rows, (100, "another text of that id"), (101, "another text of that id")]


@pytest.mark.parametrize("limits", [{}, {"tile": 2, "entries": 300, "broadcast_rows": 0}, {"segments": 2.0, "deletions": 1}])
def test_jaccard_join(spark, limits):
    rows = near_rows(3)
    got = near.jaccard_join(table(spark, rows), **limits).collect()
    assert len({(r.doc_a, r.doc_b) for r in got}) == len(got)
    assert {(r.doc_a, r.doc_b): r.jaccard for r in got} == brute_pairs(rows)


def brute_links(rows, n=2, t=0.7):
    sets = []
    for i, text in rows:
        w = licenses.words(text or "")
        sets.append((i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())))
    near_to = lambda a, b: len(a & b) / len(a | b) >= t - 1e-9
    out, seen = [], {}
    for x, (i, a) in enumerate(sets):
        if x not in seen:
            todo, mine = [x], {x}
            while todo:
                y = todo.pop()
                new = {z for z in range(len(sets)) if z not in mine and sets[y][1] and sets[z][1] and near_to(sets[y][1], sets[z][1])}
                mine |= new
                todo += new
            seen |= dict.fromkeys(mine, min((sets[y][0] for y in mine if sets[y][0] is not None), default=None))
        if i is not None:
            out.append((i, seen[x], sum(z != x and j is not None and bool(a) and bool(b) and near_to(a, b) for z, (j, b) in enumerate(sets))))
    return sorted(out)


@pytest.mark.parametrize("limits", [{}, {"tile": 3, "entries": 300, "broadcast_rows": 0}, {"segments": 2.0, "deletions": 1}])
def test_links(spark, monkeypatch, limits):
    if limits:
        monkeypatch.setattr(near, "FEW", 4)
    rows = near_rows(6, 30) + [(None, "one two three four five six seven eight nine ten")] + [(1000 + k, "one two three four five six seven eight nine ten " + f"v{k % 30}") for k in range(60)]
    docs = table(spark, rows)
    assert sorted(tuple(r) for r in near.links(docs, **limits).collect()) == brute_links(rows)


def test_size_codes():
    size = np.unique(np.concatenate([np.arange(1, 20_000), np.random.default_rng(0).integers(1, 1 << 30, 2000)]))
    least, most = near._between(near._code(size))
    assert (least <= size).all() and (size <= most).all() and (most - least <= size / 2048).all()


def test_jaccard_join_of_large_blocks(spark, monkeypatch):
    monkeypatch.setattr(near, "FEW", 4)
    rows = [(i, t) for i, t in near_rows(5, 8)] + [(1000 + k, "one two three four five six seven eight nine ten " + f"v{k % 30}") for k in range(60)]
    assert {(r.doc_a, r.doc_b): r.jaccard for r in near.jaccard_join(table(spark, rows), tile=8).collect()} == brute_pairs(rows)


def test_near_chance_entries_make_no_candidates(spark):
    """Two rare n-grams in common make no candidate pair; the pairs within the bound are all found."""
    rng, rows = random.Random(11), []
    for i in range(60):  # each text shares a rare run of three words with the next one
        words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        words[:3], words[-3:] = (f"run{i}{x}" for x in "abc"), (f"run{(i + 1) % 60}{x}" for x in "abc")
        rows.append((i, " ".join(words)))
    for i in range(0, 60, 3):
        words = rows[i][1].split()
        for at in rng.sample(range(5, 55), rng.randrange(1, 6)):
            words[at] = f"v{rng.randrange(10**6)}"
        rows.append((100 + i, " ".join(words)))
    docs = table(spark, rows)
    found = written(near.fingerprints(docs), "prints")
    limits, cost = near.allocate(near.frequencies(found), near.THRESHOLD), np.zeros(near.SKETCH, np.uint8)  # all n-grams count as equally rare
    edges = near._edges(docs, near.N, near.THRESHOLD, cost, *limits, 7).collect()
    text = {r.fp: r.doc_id for r in found.where("fp is not null").collect()}
    assert all(text[r.a] % 100 == text[r.b] % 100 for r in edges)
    pairs = {(r.doc_a, r.doc_b): r.jaccard for r in near.jaccard_join(docs).collect()}
    assert pairs == brute_pairs(rows) and 5 < len(pairs)


def test_keep_one(spark):
    rows = near_rows(4)
    docs = table(spark, rows)
    kept = near.keep_one(docs)
    assert kept.dtypes == docs.dtypes
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    texts = [tuple(sorted(set(zip(w, w[1:])) or {tuple(w)})) if (w := licenses.words(t or "")) else None for _, t in rows]
    for x in range(len(rows)):
        for y in range(x):
            if texts[x] and texts[y]:
                a, b = set(texts[x]), set(texts[y])
                if len(a & b) / len(a | b) >= 0.7 - 1e-9:
                    parent[root(x)] = root(y)
    groups = defaultdict(list)
    for x in range(len(rows)):
        groups[root(x) if texts[x] else ("odd", x)].append(x)
    want = sorted(((i is None, i or 0) for g in groups.values() for i in [min((rows[x][0] for x in g), key=lambda i: (i is None, i))]))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == want
    assert near.keep_one(docs.limit(0)).count() == 0 and near.jaccard_join(written(docs.limit(0), "none")).count() == 0


# --- 3 and 7


def library_encoding():
    tiktoken = pytest.importorskip("tiktoken")
    tokenizers = pytest.importorskip("public_tokenizers")
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.load(), special_tokens={})


def odd_texts(n, seed=5):
    rng = random.Random(seed)
    signs = [*"ab  \n\t'sdmtrevl19é中  !?..--🙂́x", "hello", " the", "'ll", "''s", " 's", "　", "\r\n"]
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_bpe_matches_the_library_and_decodes(spark):
    enc, texts = library_encoding(), [*odd_texts(2000), "a" * 5000, "the " * 3000, " \n" * 2000, "Ünïcödé" * 500]
    rows = [*enumerate(texts), (None, "no id"), (-1, None), (-1, None)]
    encoded = bpe.encode(table(spark, rows)).collect()
    assert len(encoded) == len(rows)
    by = {r.doc_id: r for r in encoded}
    for i, t in enumerate(texts):
        assert list(by[i].tokens) == enc.encode_ordinary(t) and by[i].exact and by[i].n_tokens == len(by[i].tokens)
    assert by[-1].tokens is None and by[-1].n_tokens is None and by[None].exact
    back = bpe.decode(spark.createDataFrame([(r.doc_id, r.tokens) for r in encoded], "doc_id long, tokens array<int>"))
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter(rows)
    assert bpe.encode(table(spark, [])).count() == 0


def test_transducer_emits_early_and_survives_empty_tables(monkeypatch):
    monkeypatch.setattr(bpe, "STATES", 50)
    ranks, enc = bpe.load(), library_encoding()
    t = bpe.Transducer(ranks)
    rng = random.Random(9)
    for _ in range(300):
        piece = "".join(rng.choice("aeinorstlhd") for _ in range(rng.randint(1, 60)))
        assert t.encode(piece.encode()) == enc.encode_ordinary(piece)
    monkeypatch.setattr(bpe, "STATES", 10_000)
    state, emitted, waits = 0, 0, []
    t._reset()
    for byte in b"internationalization" * 5:
        state, some = t.move(state, byte)
        emitted += sum(len(enc.decode_single_token_bytes(x)) for x in some)
        waits.append(len(waits) + 1 - emitted)
    assert max(waits) < 60


def test_pretokens_beyond_the_named_states_go_side_by_side(monkeypatch):
    monkeypatch.setattr(bpe, "STATES", 50)
    ranks, enc, rng, steps, one = bpe.load(), library_encoding(), random.Random(11), [], bpe.Transducer._step
    monkeypatch.setattr(bpe.Transducer, "_step", lambda t, state, byte: steps.append(byte) or one(t, state, byte))
    words = ["".join(rng.choice("aeinorstlhdé中🙂") for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    texts = [" ".join(words), "a" * 3000, "=" * 3000, *(" " * k + "-" * k for k in range(2, 300, 9)), "", *odd_texts(300, 12)]
    data = "".join(texts).encode()
    flat, number = bpe.Encoder(ranks).encode(np.frombuffer(data, np.uint8), np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]))
    assert [x.tolist() for x in np.split(flat, np.cumsum(number)[:-1])] == [enc.encode_ordinary(t) for t in texts]
    assert len(steps) < len(data) / 4  # those of the first and of the longest few
    t = bpe.Transducer({b"a": 0, b"b": 1, b"ab": 2, b"aba": 3})
    small = [b"a", b"aab", b"abab", b"aaba", b"b"]
    want = [t.encode(p) for p in small if p not in t.ranks]
    flat, number = t.together([p for p in small if p not in t.ranks])
    assert [x.tolist() for x in np.split(flat, np.cumsum(number)[:-1])] == want
    with pytest.raises(ValueError):
        t.together([b"ab", b"acb"])


def test_utf8_machine():
    rng = random.Random(6)
    for _ in range(500):
        data = bytes(rng.choice([0x41, 0xC3, 0xA9, 0xE4, 0xB8, 0xAD, 0xF0, 0x9F, 0x99, 0x82, 0xFF, 0xED, 0xA0]) for _ in range(rng.randint(0, 12)))
        machine, out, i = bpe.Utf8(), "", 0
        while i < len(data):
            k = rng.randint(1, 3)
            out += machine.push(data[i : i + k])
            i += k
        assert out + machine.finish() == data.decode("utf-8", "replace")


@pytest.mark.parametrize("limits", [{}, {"broadcast_rows": 0, "part_rows": 50}])
def test_token_counts(spark, limits):
    enc = library_encoding()
    rows = [*enumerate(odd_texts(300, 8)), *[(i, t) for i, t in ODD if i not in (1,)], (9_000, None)]
    got = Counter((r.doc_id, r.n_tokens) for r in counts.count_tokens(table(spark, rows), **limits).collect())
    assert got == Counter((i, None if t is None else len(enc.encode_ordinary(t))) for i, t in rows)
    assert counts.count_tokens(table(spark, []), **limits).count() == 0


# --- 4


def test_reply_trees(spark):
    rows = [
        (1, 1, None, "user", "q", 1.0), (1, 2, 1, "assistant", "a", 5.0), (1, 3, 1, "assistant", "b", 5.0), (1, 4, 2, "user", "c", 0.0), (1, 5, 3, None, None, 3.0), (1, 5, 3, None, None, 3.0),
        (2, 1, 77, "user", "orphan", None), (3, 1, 2, "user", "circle", 1.0), (3, 2, 1, "user", "circle", 1.0), (None, 1, None, "user", "x", 1.0), (4, None, None, "user", "x", 1.0),
        *[(5, k, k - 1 if k else None, "user", f"t{k}", 1.0) for k in range(300)],
    ]
    m = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "tree_id long, message_id long, parent_id long, role string, text string, score double, path string, rank string")
    got = {(r.tree_id, r.rank): r for r in chats.conversations(m, top=3).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1), (5, 1)}
    assert (got[1, 1].leaf_id, got[1, 1].score, got[1, 1].n_turns) == (5, 9.0, 3)
    assert got[1, 2].text == "<|user|>\nq\n<|end|>\n<|assistant|>\na\n<|end|>\n<|user|>\nc\n<|end|>\n"
    assert got[5, 1].n_turns == 300 and got[5, 1].text.index("t0\n") < got[5, 1].text.index("t299\n")
    assert chats.conversations(m.limit(0)).count() == 0
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 2, "assistant", "one two"), (1, 2, "assistant", "one"), (1, 2, "assistant", "one"), (None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert sorted((r.rank, r.score) for r in chats.conversations(chats.turns(turns)).collect()) == [(1, 3.0), (2, 2.0)]
    assert {r.message_id: r.parent_id for r in chats.branching(turns).collect()} == {0: None, 2 << 20: 0, (2 << 20) + 1: 2 << 20}


def test_reply_trees_against_a_walk(spark):
    rng = random.Random(8)
    rows = [(t, i, rng.choice([None, *range(i)][-6:]) if i else None, rng.choice(["user", None]), f"{t}.{i}", float(rng.randint(0, 3))) for t in range(6) for i in range(rng.choice([1, 2, 9, 70]))]
    by, kids = {(t, i): (p, r, x, s) for t, i, p, r, x, s in rows}, {(t, p) for t, _, p, *_ in rows}
    want = []
    for t in {r[0] for r in rows}:
        own = []
        for tree, i in by:
            if tree == t and (t, i) not in kids:
                path, at = [], i
                while at is not None:
                    path.append(by[t, at])
                    at = by[t, at][0]
                own.append((-sum(x[3] for x in path), i, len(path), "".join(f"<|{r or 'user'}|>\n{x}\n<|end|>\n" for _, r, x, _ in path[::-1])))
        want += [(t, k, i, -s, n, text) for k, (s, i, n, text) in enumerate(sorted(own), 1)]
    m = spark.createDataFrame(rows, "tree_id long, message_id long, parent_id long, role string, text string, score double")
    names = ["tree_id", "rank", "leaf_id", "score", "n_turns", "text"]
    assert sorted(tuple(r) for r in chats.conversations(m).select(names).collect()) == sorted(want)
    assert sorted(tuple(r) for r in chats.conversations(m, top=2).select(names).collect()) == sorted(w for w in want if w[1] <= 2)


# --- 5


def brute_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_decontamination(spark):
    rng = random.Random(7)
    items = [(k, prose(rng, 12)) for k in range(6)] + [(6, None), (7, ""), (8, "..."), (0, prose(rng, 9))]
    rows = list(ODD)
    for k in range(40):
        passage = list(rng.choice(items[:6])[1])
        for _ in range(rng.randint(0, 9)):
            passage[rng.randrange(len(passage))] = rng.choice("qxz")
        rows.append((100 + k, prose(rng, rng.randint(0, 20)) + " " + "".join(passage) + " " + prose(rng, 5)))
    docs = table(spark, rows)
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string")
    plain = lambda t: next(leaks.normal(pa.array([t])))
    want = {}
    for i, t in rows:
        for item, s in items:
            if s and t and (n := plain(s)) and (e := brute_distance(n, plain(t))) <= int(0.1 * (len(n) - 2) + 1e-9):
                want[i, item] = min(e, want.get((i, item), e))
    for bundle in (leaks.BUNDLE, 100):
        rows_found = leaks.find(docs, bench, bundle=bundle).collect()
        got = {(r.doc_id, r.item_id): r.edits for r in rows_found}
        assert len(rows_found) == len(got)
        assert got == want
    kept = leaks.clean(docs, bench)
    assert kept.dtypes == docs.dtypes
    hit = {i for i, _ in want}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _ in rows if i not in hit)
    assert leaks.find(docs, bench.limit(0)).count() == 0 and leaks.clean(docs, bench.limit(0)).count() == len(rows) and leaks.find(docs.limit(0), bench).count() == 0


# --- 6


def test_archive(spark):
    big = "x" * 200_000
    rows = [(1, "http://a", "<p>same"), (2, "http://b", "<p>same"), (3, None, ""), (4, "http://d", None), (None, "http://e", "<p>é"), (1, "http://a", "<p>same"), (5, "http://f", big)]
    pages = written(spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string"), "pages")
    records = warc.records_of_pages(pages)
    for limit in (warc.BROADCAST_ROWS, -1):
        headers, payloads = warc.archive(records, broadcast_rows=limit)
        assert payloads.count() == 4 and headers.count() == len(rows)
        got = Counter(bytes(r.record) for r in warc.restore(headers, payloads).collect())
        want = Counter(bytes(r.header) + bytes(r.payload or b"") + b"\r\n\r\n" for r in records.collect())
        assert got == want
        assert {r.verified for r in warc.restore(headers, payloads).where("digest is not null").collect()} == {True}
    whole = b"".join(got.elements())
    assert len(list(warc.parse(whole))) == len(rows)
    parsed = Counter(h + p + b"\r\n\r\n" for _, h, p in warc.parse(whole))
    assert parsed == want
    assert warc.restore(*warc.archive(warc.records_of_pages(written(pages.limit(0), "none")))).count() == 0


def test_warc_files(spark, tmp_path):
    one = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 4\r\n\r\nab\x00\xff\r\n\r\n"
    squeeze = zlib.compressobj(wbits=31)
    (tmp_path / "a.warc").write_bytes(one * 2 + b"WARC/1.0\r\nContent-Length: 99\r\n\r\nshort")
    (tmp_path / "b.warc.gz").write_bytes((squeeze.compress(one) + squeeze.flush()) * 2)
    got = warc.read(spark, str(tmp_path)).collect()
    assert len(got) == 4 and {bytes(r.payload) for r in got} == {b"ab\x00\xff"}


def test_damaged_archives():
    make = lambda x: b"WARC/1.0\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(x), x)
    squeeze = lambda x: (z := zlib.compressobj(wbits=31)).compress(x) + z.flush()
    good, payloads = [make(b"one"), make(b"two\r\n\r\nWARC?"), make(b"")], [b"one", b"two\r\n\r\nWARC?", b""]
    bad = [b"WARC/1.0\r\nContent-Length: x\r\n\r\nlost\r\n\r\n", b"WARC/1.0\r\n\r\nno length\r\n\r\n", b"WARC/1.0\r\nContent-Length: 2\r\n\r\ntoo long\r\n\r\n", b"WARC/1.0\r\nContent-Length: 9999\r\n\r\ntoo short\r\n\r\n", b"WARC/1.0\r\ncut off in its header\r\n"]
    for b in bad:
        for k in range(4):
            data = b"".join([*good[:k], b, *good[k:]])
            assert [p for _, _, p in warc.parse(data)] == payloads, (b, k)
            assert all(data.startswith(h + p, at) for at, h, p in warc.parse(data))
    members = [squeeze(x) for x in good]
    broken = bytearray(squeeze(make(b"some longer text, " * 9)))
    broken[20:40] = b"\x00" * 20
    for k in range(4):
        assert [p for _, _, p in warc.parse(b"".join([*members[:k], bytes(broken), *members[k:]]))] == payloads
    assert list(warc.parse(members[0][:-9])) == [] and list(warc.parse(b"")) == [] and list(warc.parse(b"no archive")) == []


# --- 8


def brute_parse(x):
    runs = []
    for s in x:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    label = [s for s, _ in runs]
    for _ in range(4):
        new = []
        for i, v in enumerate(label):
            d = v ^ label[i - 1] if i else 1
            bit = (d & -d).bit_length() - 1
            new.append(2 * bit + (v >> bit & 1))
        label = new
    assert all(a != b for a, b in zip(label, label[1:])) and max(label) < 6
    starts = [i for i in range(len(runs)) if i == 0 or (i < len(runs) - 1 and label[i] > label[i - 1] and label[i] > label[i + 1])]
    return [tuple(map(tuple, runs[a:b])) for a, b in zip(starts, [*starts[1:], len(runs)])]


def test_phrases_are_cut_as_by_hand():
    import numpy as np

    rng = random.Random(11)
    for _ in range(200):
        x = bytes(rng.choice(b"abcab   ") for _ in range(rng.randint(1, 60)))
        names, off = parsing.parse(np.frombuffer(x + x, np.uint8).astype(np.uint64), np.array([0, len(x), 2 * len(x)]))
        phrases = brute_parse(list(x))
        assert off.tolist() == [0, len(phrases), 2 * len(phrases)] and (names[: off[1]] == names[off[1] :]).all()
        assert len(set(names.tolist())) == len(set(phrases))


def test_fingerprints(spark):
    rng = random.Random(12)
    passage = " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(200))
    rows = [(10, prose(rng, 90) + passage + prose(rng, 31)), (11, prose(rng, 7) + passage), (12, prose(rng, 300)), (13, passage), (14, passage), *ODD]
    got = {r.doc_id: r for r in parsing.fingerprint(table(spark, rows)).collect()}
    own = set(got[13].signatures)
    assert got[13].root == got[14].root and len(own) > 5
    for i in (10, 11):
        assert len(own & set(got[i].signatures)) >= len(own) - 4
        assert got[i].root != got[13].root
    assert not own & set(got[12].signatures)
    assert got[1].levels is None and got[1].signatures is None and (got[2].levels, got[2].root, got[2].signatures) == (0, None, [])
    assert got[4].root == got[5].root and got[6].levels >= 1
    assert parsing.fingerprint(table(spark, [])).count() == 0


# --- 9


def test_personal_data(spark):
    rng = random.Random(13)
    things = {"EMAIL": "io.33@mail4.example.com", "PHONE": "+1 (017) 555-7713", "IP": "97.51.17.173", "CARD": "9807915762804490", "SECRET": '"2abc3ff2ca8fb1e4c565a0eb63815530a948bdde"'}
    rows, want = list(ODD), {}
    for k in range(60):
        kind = rng.choice(list(things))
        rows.append((100 + k, prose(rng, rng.randint(0, 30)) + " " + things[kind] + rng.choice(["", "!!", "%%%", "."]) + " " + prose(rng, rng.randint(0, 30))))
        want[100 + k] = (kind, things[kind].strip('"'))
    clean = "In 1999 there were 1,000,000 of 25 kinds. Version 2.0. of it has 3 parts, see 12.3."
    rows += [(900, clean), (901, "7 " * 5000)]
    docs = table(spark, rows)
    texts = dict(rows)
    found = pii.find(docs).collect()
    assert {r.doc_id: (r.kind, texts[r.doc_id][r.start : r.end]) for r in found} == want and len(found) == len(want)
    masked = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert all(f"<{kind}>" in masked[i] and what not in masked[i] for i, (kind, what) in want.items())
    assert masked[900] == clean and masked[1] is None and masked[2] == "" and pii.redact(docs).dtypes == docs.dtypes
    assert pii.find(docs.limit(0)).count() == 0


def test_labelled_table_is_a_parameter(spark):
    lines = ["see [ID: AB12] here", "id [ID: CD34] there", "in 1999 it was", "of 20 or 30"] * 3
    model = pii.train(steps=100, table=spark.createDataFrame([(x,) for x in lines], "sentence string"))
    found = pii.find(table(spark, [(1, "see EF56 in 2001")]), model).collect()
    assert [(r.kind, r.start, r.end) for r in found] == [("ID", 4, 8)]


def test_viterbi_is_the_best_path():
    import itertools

    model, rng = pii.train(steps=5), np.random.default_rng(1)
    k = len(pii.KINDS)
    size = np.array([1, 3, 2, 4, 1])
    e = rng.normal(size=(size.sum(), k))
    model.a = rng.normal(size=(k, k))
    got, at = model.viterbi(e, size), 0
    for n in size:
        score = lambda y: sum(e[at + i, v] for i, v in enumerate(y)) + sum(model.a[p, q] for p, q in zip((0, *y), (*y, 0)))  # noqa: B023, E731
        best = max(itertools.product(range(k), repeat=int(n)), key=score)
        assert tuple(got[at : at + n]) == best
        at += n


# --- 10


def test_quality(spark):
    rng = random.Random(14)
    rows, labels = list(ODD), []
    for k in range(400):
        kind = k % 4
        text = prose(rng, 60)
        if kind == 1:
            text = " ".join(w + "$$$" for w in text.split())
        if kind == 2:
            text += " idiot scum idiot"
        rows.append((1000 + k, text))
        labels.append((1000 + k, int(kind != 1), int(kind == 2)))
    docs = table(spark, rows)
    held_in = spark.createDataFrame([*labels[:300], labels[0], (1000, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(docs, held_in).collect()}
    assert len(got) == len(dict(rows))
    right = [got[i].keep == bool(q and not t) for i, q, t in labels[300:]]
    assert sum(right) >= 0.95 * len(right)
    kept = quality.keep_good(docs, held_in)
    assert kept.dtypes == docs.dtypes and {r.doc_id for r in kept.collect()} >= {i for i, r in got.items() if r.keep and i is not None}
    assert quality.classify(docs, held_in.limit(0)).where("keep").count() == len(rows) and quality.keep_good(docs.limit(0), held_in).count() == 0


def test_verdicts_do_not_depend_on_neighbours():
    odd = ["straße ẞ İ", "THIS IS LOUD text here", "plain", "", None, "ȺȺ LOUD ẞ ÉCOLE", "İİ Kelvin K LOUD"] * 3
    terms = lambda texts: [sorted(t[r == i].tolist()) for _, n, r, t in quality._terms(pa.array(texts, pa.large_string())) for i in range(n)]
    assert terms(odd) == [terms([x])[0] for x in odd]
    assert terms(["THIS IS LOUD text here"])[0].count(int(quality._CAPS)) == 3


def test_votes_are_those_of_the_nearest():
    rng = random.Random(15)
    texts = [prose(rng, 40) + (" idiot" if k % 3 == 0 else "") + ("***" * 3 if k % 5 == 0 else "") for k in range(90)]
    q, t = np.array([int(k % 5 != 0) for k in range(90)]), np.array([int(k % 3 == 0) for k in range(90)])
    model = quality.Model(texts, q, t, 64, 8)
    column = pa.array(texts[:20], pa.large_string())
    x, got = model.vectors(column), model.votes(column, k=7, block=6)
    for i in range(20):
        cos = model.points @ x[i]
        kth = np.sort(cos)[-7]
        w = np.where(cos >= kth - 1e-6, np.maximum(cos, 1e-3), 0) ** quality.POWER
        assert np.allclose(got[i], [(w * q).sum() / w.sum(), (w * t).sum() / w.sum()], atol=1e-4)


def test_hashes_depend_on_bytes_alone():
    data, off = vec.strings(pa.array(["ab abc ab", "xab ab"]))
    start, end, n = vec.runs(data, off, vec.WORD)
    h = vec.hash_runs(data, start, end)
    assert n.tolist() == [3, 2] and h[0] == h[2] == h[4] and len(set(h.tolist())) == 3
