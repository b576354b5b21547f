import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textsig.functions import tokens as tok
from textsig.operators import codebook, dictionary, learner, matrices, signatures, thresholds, uniqueness
from textsig.plans import queries

N = 2048


def cliff(at, n=N):
    return [100.0] * at + [1.0] * (n - at)


GOLDEN = [
    ([42.0], 1), ([10.0, 1.0], 2), ([5.0] * N, N), ([0.0] * 100, 100), ([2048.0 - i for i in range(N)], 1320), ([2048 - i / 2 for i in range(N)], 1888), ([2048 - i / 10 for i in range(N)], N),
    ([100.0 - i for i in range(100)], 66), ([1 / math.sqrt(i + 1) for i in range(N)], 102), ([1 / (i + 1) for i in range(N)], 44), ([math.exp(-0.01 * i) for i in range(N)], 302),
    *[(cliff(k), k) for k in (1900, 1500, 1000, 500, 100)], (cliff(30, 100), 30), ([2048.0 - i if i < 1800 else 1.0 for i in range(N)], 1800), ([1000.0] + [1.0] * (N - 1), 1),
    ([100.0] * 30 + [50.0] * 970 + [1.0] * 1048, 1000), ([1.0, 0.99, 0.98, 0.97], 4), ([0.9, 0.01, 0.01, 0.01], 1),
]


def test_cut_offs(spark):
    rows = [(k, v) for k, (vs, _) in enumerate(GOLDEN) for v in vs]
    got = {r.k: r for r in thresholds.cut_offs(spark.createDataFrame(rows, "k int, x double"), ["k"], "x").collect()}
    assert [got[k].adaptive for k in range(len(GOLDEN))] == [n for _, n in GOLDEN]
    assert got[11].adaptive_threshold == 1.0 and got[2].adaptive_threshold == 0.0
    lists = [([0.25] * 4, "entropy", 4), ([0.5, 0.5, 0, 0, 0], "entropy", 2), ([0.999, 0.0001, 0.0001], "entropy", 2), ([0.8] + [0.05] * 4, "entropy", 3), ([0.0] * 5, "entropy", 0)]
    lists += [([0.85, 0.82, 0.80, 0.20, 0.15], "gap_ratio", 3), ([0.9, 0.3, 0.3, 0.3], "gap_ratio", 1), ([0.85, 0.80, 0.75, 0.70], "gap_ratio", 4), ([0.90, 0.25, 0.20, 0.02], "gap_ratio", 3), ([0.85, 0.80, 1e-12], "gap_ratio", 2)]
    rows = [(k, float(v)) for k, (vs, *_) in enumerate(lists) for v in vs]
    got = {r.k: r for r in thresholds.cut_offs(spark.createDataFrame(rows, "k int, x double"), ["k"], "x", min_gap=3.0).collect()}
    assert [got[k][what] for k, (_, what, _) in enumerate(lists)] == [n for *_, n in lists]
    assert thresholds.cut_offs(spark.createDataFrame([], "k int, x double"), ["k"], "x").count() == 0


SMALL = [("Whole", "the"), ("Start", "un"), ("Start", "run"), ("Start", "ing"), ("End", "ing"), ("End", "ed"), ("Mid", "port")]


def test_decomposition():
    parts = SMALL + dictionary.atoms()
    d = dictionary.Decomposer([(i, *p) for i, p in enumerate(parts)])
    shown = lambda w: [parts[i] for i in d.parts(w)]
    assert shown("the") == [("Whole", "the")] and shown("a") == [("Whole", "a")] and d.parts("") == []
    assert shown("running") == [("Start", "run"), ("Letter", "##n##"), ("End", "ing")]
    assert shown("unported") == [("Start", "un"), ("Mid", "port"), ("End", "ed")]
    assert shown("xy") == [("Letter", "x##"), ("Letter", "##y")]
    assert shown("xéy") == [("Letter", "x##"), ("Letter", "##y")]
    assert d.runs("running") == [(3, 4)] and d.runs("xyz") == [(0, 3)] and d.runs("the") == []
    assert [parts[i] for i in d.delimiter("-é.")] == [("Delimiter", "-"), ("Delimiter", ".")]
    assert len(dictionary.atoms()) == 174


def test_training(spark):
    rng = random.Random(4)
    stems, ends = ["walk", "talk", "jump", "play"], ["ing", "ed", "er", "s"]
    words = spark.createDataFrame([(rng.choice(stems) + rng.choice(ends) + rng.choice(["", "ly", "ness"]) * (k % 2), 1 + k % 7) for k in range(200)], "value string, n long").groupBy("value").agg(F.sum("n").alias("n"))
    delims = spark.createDataFrame([(" ", 50), (".", 9)], "value string, n long")
    parts = dictionary.train(words, delims).orderBy("part_id").collect()
    assert [r.part_id for r in parts] == list(range(len(parts))) and len({(r.kind, r.value) for r in parts}) == len(parts)
    assert {"Start", "Mid", "End"} <= {r.kind for r in parts}
    again = dictionary.train(words, delims).orderBy("part_id").collect()
    assert parts == again
    none = spark.createDataFrame([], "value string, n long")
    assert dictionary.train(none, none).count() == 174


def test_signatures(spark):
    rng = random.Random(5)
    bags = [[sorted(rng.sample(range(9), rng.randint(1, 4))) for _ in range(rng.randint(1, 12))] for _ in range(20)]
    rows = [(s, i, b) for s, x in enumerate(bags) for i, b in enumerate(x)]
    words = spark.createDataFrame(rows, "span int, idx int, bag array<int>")
    got = {(r.span, r.idx): r for r in signatures.encoded(words, 9, ["span"]).collect()}
    df = {}
    for s, x in enumerate(bags):
        for i, b in enumerate(x):
            before, after = set().union(*x[:i]), set().union(*x[i + 1 :])
            r = got[s, i]
            assert (r.before, r.current, r.after) == (sorted(before), [e + 9 for e in b], sorted(e + 18 for e in after))
            for e in [*r.before, *r.current, *r.after]:
                df[e] = df.get(e, 0) + 1
    assert {r.bit: r.df for r in signatures.frequencies(words, 9, ["span"]).collect()} == df
    w = {r.bit: r.w for r in signatures.surprisal_weights(signatures.frequencies(words, 9, ["span"]), len(rows)).collect()}
    top = max(math.log(len(rows) / v) for v in df.values())
    assert w == {b: min(8, max(1, math.floor(1.5 + 7 * math.log(len(rows) / v) / top))) for b, v in df.items()}


@pytest.mark.parametrize("scale", ["sentence", "paragraph"])
def test_signatures_of_texts(spark, monkeypatch, scale):
    """Made where texts are cut, against unions of bags word by word."""
    monkeypatch.setattr(signatures, "PIECE", 500)
    rng = random.Random(11)
    texts = [None, "", "...", *(" ".join(rng.choice(["the", "unported", "running", "xy", "a", "7", "run.", "Mr.", "it!\n\n"]) for _ in range(rng.randint(0, 40))) for _ in range(25)), "run " * 300]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, bits string")
    parts = dictionary.numbered(spark, SMALL + dictionary.atoms())
    d, size = dictionary.Decomposer([tuple(r) for r in parts.collect()]), parts.count()
    spans = {}
    for r in tok.tokens(docs).collect():
        if r.type == "W":
            spans.setdefault((r.doc_id, r[scale]), []).append((r.idx, set(d.parts(r.value)), r.sentence))
    want, df = {}, Counter()
    for (doc, _), words in spans.items():
        words.sort()
        for k, (idx, own, _) in enumerate(words):
            before, after = set().union(*(b for _, b, _ in words[:k])), set().union(*(b for _, b, _ in words[k + 1 :]))
            want[doc, idx] = sorted(before) + sorted(e + size for e in own) + sorted(e + 2 * size for e in after)
            df.update(want[doc, idx])
    got = signatures.encoded_texts(docs, parts, scale=scale).collect()
    assert {(r.doc_id, r.idx): list(r.bits) for r in got} == want and len(got) == len(want)
    found = {r.bit: r.df for r in signatures.text_frequencies(docs, parts, scale=scale).collect()}
    assert found.pop(-1) == len(want) and found == df
    sums = signatures.summed_texts(docs, parts, {"n": np.ones(3 * size, np.int64), "s": np.arange(3 * size)}, scale=scale).collect()
    assert {(r.doc_id, r.idx): (r.n, r.s) for r in sums} == {k: (len(v), sum(v)) for k, v in want.items()}
    if scale == "sentence":
        assert {(r.doc_id, r.idx): list(r.bag) for r in signatures.bags(docs, parts).collect()} == {(doc, idx): sorted(own) for (doc, _), words in spans.items() for idx, own, _ in words}
    assert signatures.encoded_texts(docs.limit(0), parts).count() == 0 and signatures.text_frequencies(docs.limit(0), parts).count() == 0
    with pytest.raises(ValueError):
        monkeypatch.setattr(dictionary, "BROADCAST_PARTS", 3)
        dictionary.collected.__defaults__ = (3,)
        try:
            signatures.bags(docs, parts)
        finally:
            dictionary.collected.__defaults__ = (1_000_000,)


def test_large_dictionaries_are_joined(spark):
    rng = random.Random(12)
    words = spark.createDataFrame([(w, 2) for w in {"", "the", "a", "running", "unported", "xy", "ported", "unun", "x1-é", *("".join(rng.choice("unporteding") for _ in range(rng.randint(1, 12))) for _ in range(200))}] + [(None, 1)], "value string, n long")
    parts = dictionary.numbered(spark, SMALL + [("Mid", "un"), ("End", "un"), ("Start", "unp"), ("Mid", "por")] + dictionary.atoms())
    small, large = ({r.value: (r.part_ids, r.bag) for r in dictionary.decomposed(words, parts, limit=n).collect()} for n in (1000, 5))
    assert small == large and len(small) == words.count()
    runs, again = (sorted(tuple(r) for r in dictionary.unclaimed(words.where("value is not null"), parts, n).collect()) for n in (1000, 5))
    assert runs == again and len(runs) > 20
    d = dictionary.Decomposer([tuple(r) for r in parts.collect()])
    delims = spark.createDataFrame([("-",), ("-é.",), (" ",), ("!",), ("$$",)], "value string")
    assert {r.value: r.part_ids for r in dictionary.decomposed_delimiters(delims, parts).collect()} == {r.value: d.delimiter(r.value) for r in delims.collect()}


def test_uniqueness(spark):
    bags = [("ab", [1, 2]), ("ba", [1, 2]), ("abc", [1, 2, 3]), ("x", [4]), ("y", [4]), ("z", [4]), ("none", [])]
    words = spark.createDataFrame(bags, "value string, bag array<int>")
    r = uniqueness.collisions(words, []).collect()[0]
    assert tuple(r) == (6, 3, 2, 5, round(500 / 6, 6))
    r = uniqueness.sizes(words).collect()[0]
    assert tuple(r) == (6, 1, round(10 / 6, 6), 2, 3, 3, 3)
    assert [(r["rank"], r.bag, r.k, r.words) for r in uniqueness.largest(words, 2, 2).orderBy("rank").collect()] == [(1, [4], 3, ["x", "y"]), (2, [1, 2], 2, ["ab", "ba"])]
    assert uniqueness.sizes(words.limit(0)).count() == 0 and uniqueness.largest(words.limit(0)).count() == 0
    assert uniqueness.hashed([]) == 0xCBF29CE484222325 and uniqueness.hashed([0x61]) == uniqueness.hashed([0x61]) != uniqueness.hashed([0x62])


def test_pursuit_covers_an_exact_union(spark):
    book = spark.createDataFrame([(0, [1, 2, 3]), (1, [4, 5]), (2, [1, 9])], "atom_id int, bits array<int>")
    weights = spark.createDataFrame([(b, 1, 2) for b in range(10)], "bit int, df int, w int")
    sigs = spark.createDataFrame([(7, [1, 2, 3, 4, 5]), (8, []), (9, None), (10, [77])], "id long, bits array<int>")
    assert {r.id: r.atoms for r in codebook.pursuit(sigs, book, weights).collect()} == {7: [0, 1], 8: [], 9: [], 10: []}
    dec = codebook.decoded(spark.createDataFrame([(7, [0, 1, 99]), (8, [])], "id long, atoms array<int>").where("size(atoms) > 0"), book)
    assert dec.collect()[0].bits == [1, 2, 3, 4, 5]


def test_sketch_bounds(spark):
    rng = np.random.default_rng(6)
    lists = [sorted(set(rng.integers(0, 40, 6).tolist())) for _ in range(400)] + [[], [99]]
    s = matrices.sketched(spark.createDataFrame([(x,) for x in lists], "bits array<int>").repartition(5), "bits", 40, 10)
    sigma, rows = s.finish()
    a = np.zeros((len(lists), 40))
    for i, x in enumerate(lists):
        a[i, [e for e in x if e < 40]] = 1
    gap = np.linalg.eigvalsh(a.T @ a - (rows.T @ rows).astype(float))
    assert gap.min() > -1e-2 and gap.max() <= (a**2).sum() / 10 and len(sigma) <= 10


def test_product_with_a_small_matrix(spark):
    rng = np.random.default_rng(8)
    rows = [(i, x) for i, x in enumerate(rng.normal(size=(50, 6)).tolist())] + [(50, None), (51, [1.0, None, 2.0]), (51, [])]
    e, b = spark.createDataFrame(rows, "k long, v array<double>"), rng.normal(size=(6, 3))
    want = sorted((k, c, round(float(np.array([y or 0 for y in x] + [0.0] * (6 - len(x))) @ b[:, c]), 6)) for k, x in rows if x is not None for c in range(3))
    got = sorted((r.row, r.col, round(r.x, 6)) for r in matrices.multiplied(e, "k", "v", b).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-5)
    joined = {(r.row, r.col): r.x for r in matrices.multiplied(e.where("k < 50"), "k", "v", b, 0).collect()}
    assert len(joined) == 150 and all(abs(joined[k, c] - x) < 1e-5 for k, c, x in want if k < 50)


def test_product_of_all_rows(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = [(i, i % 10, x) for i, x in enumerate(rng.normal(size=(60, 8)).tolist())] + [(60, 1, None), (61, 1, []), (62, 1, [1.0, None, 2.0]), (5, 3, [1.0] * 8), (None, 0, [2.0] * 8)]
    e = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    sums = {}
    for k, _, x in rows:
        if x:
            sums[k] = sums.get(k, 0) + np.array([v or 0 for v in x] + [0.0] * (8 - len(x)))
    want = {(a, b): x @ y for a, x in sums.items() for b, y in sums.items()}
    for block in (7, 1024):
        got = matrices.rows_gram(e, "vec_id", "embedding", block).collect()
        assert len(got) == len(want) == 62**2 and all(abs(r.x - want[r.row, r.col]) < 1e-9 for r in got)
    e.write.parquet(f"{tmp_path}/embeddings.parquet")
    whole = {(r.row, r.col): r.x for r in queries.queries()["gram_rows"](spark, str(tmp_path)).collect()}
    assert whole.keys() == want.keys() and all(abs(x - want[k]) < 1e-4 for k, x in whole.items())


@pytest.mark.parametrize("by", ["type", "type_level", "level_type"])
def test_reordering_keeps_all_parts(spark, by):
    parts = dictionary.numbered(spark, SMALL + dictionary.atoms())
    got = dictionary.reordered(parts, by).orderBy("part_id").collect()
    assert sorted(r.old_id for r in got) == list(range(181)) and [r.kind for r in got[:1]] == ["Whole"]
    assert [r.value for r in got[-6:]] == {"type": ["un", "run", "ing", "ing", "ed", "port"], "type_level": ["run", "ing", "un", "ing", "ed", "port"], "level_type": ["port", "run", "ing", "ing", "un", "ed"]}[by]


def test_learner_takes_every_signature(spark, monkeypatch):
    """In order of seq, those without first, `batch` at a time, whatever the values of seq."""
    rows = [(k, seq, [k % 5, 5 + k % 3]) for k, seq in enumerate([None, None, -1, -4097, 0, 4095, 4096, 64 * 4096, 10**9, 10**9 + 4096])]
    seen, pursuit = [], codebook.pursuit

    def spy(some, *rest):
        seen.append(sorted(r.id for r in some.select("id").collect()))
        return pursuit(some, *rest)

    monkeypatch.setattr(codebook, "pursuit", spy)
    weights = spark.createDataFrame([(b, 1 + b % 3) for b in range(8)], "bit int, w int")
    book = learner.learn(spark.createDataFrame(rows, "id long, seq long, bits array<int>"), weights, learner.Settings(atoms=3, width=2, batch=4))
    assert book.count() == 3
    assert seen == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]


def learnt(spark, patterns, dim=128, times=3, warm=None, **settings):
    """The codebook of patterns said several times, their fired atoms and quality."""
    rows = [(t * len(patterns) + k, t * len(patterns) + k, p) for t in range(times) for k, p in enumerate(patterns)]
    weights = spark.createDataFrame([(b, 3) for b in range(dim)], "bit int, w int")
    given = spark.createDataFrame(rows, "id long, seq long, bits array<int>")
    first = given.where(f"id < {warm}") if warm else given.where(f"id < {len(patterns)}")
    book = learner.learn(given, weights, learner.Settings(directions=32, **settings), dim, first)
    sigs = spark.createDataFrame(list(enumerate(patterns)), "id long, bits array<int>")
    fired = codebook.pursuit(sigs, book, weights).select("id", F.explode("atoms").alias("atom_id"))
    q = codebook.quality(sigs.select("id", F.explode("bits").alias("bit")), fired, book, weights).first()
    return {r.atom_id: list(r.bits) for r in book.collect()}, q


DISJOINT = [[3 * k, 3 * k + 1, 3 * k + 2] for k in range(40)]


def test_learner_covers_patterns_and_is_deterministic(spark):
    book, q = learnt(spark, DISJOINT, atoms=32, width=8, batch=40)
    assert len(book) == 32 and all(len(b) <= 8 for b in book.values())
    assert q.utilisation > 0.8 and q.mean_recall > 0.6
    assert learnt(spark, DISJOINT, atoms=32, width=8, batch=40)[0] == book


def test_learner_separates_atoms(spark):
    hub = [[0, 1, 2, 3, 10 + p, 40 + p, 70 + p] for p in range(20)]
    overlap = {}
    for congestion in (0.0, 2.0):
        book = list(learnt(spark, hub, atoms=20, width=8, batch=10_000, decay=1.0, congestion=congestion)[0].values())
        overlap[congestion] = sum(len(set(a) & set(b)) for i, a in enumerate(book) for b in book[:i])
    assert overlap[0.0] > 0 and overlap[2.0] < overlap[0.0] / 2


def test_learner_strips_hubs(spark):
    hub = [[0, 10 + p, 30 + p] for p in range(20)]
    for strip, some in ((0.0, True), (0.05, False)):
        book, _ = learnt(spark, hub, atoms=20, width=8, batch=20, congestion=0.0, strip=strip)
        assert any(0 in b for b in book.values()) == some


def test_learner_sets_dead_atoms_anew(spark):
    recall = {n: learnt(spark, DISJOINT, times=4, warm=28, atoms=40, width=8, batch=40, reservoir=n)[1].mean_recall for n in (0, 4096)}
    assert recall[4096] > recall[0] + 0.1


def test_learner_emphasises_the_middle_band(spark):
    patterns = [[0, 1, 2, 3, 4, 10 + p] for p in range(10)]
    own = {}
    for boost in (1.0, 50.0):
        book, _ = learnt(spark, patterns, dim=30, times=4, atoms=10, width=4, batch=20, congestion=0.0, boost=boost)
        own[boost] = sum(any(10 <= e < 20 for e in b) for b in book.values())
    assert own[50.0] > own[1.0]


def test_ring_is_that_of_one_signature_at_a_time():
    rng = random.Random(14)
    for _ in range(300):
        ring, held, head, places, seen = learner.Ring(rng.randint(0, 5)), [], 0, None, 0
        places = ring.places
        for _ in range(6):
            n = rng.randint(0, 12)
            free, last = ring.wanted(n)
            ring.add({k: [seen + k] for k in range(n) if k < free or k >= last}, n)
            for k in range(n):
                if len(held) < places:
                    held.append([seen + k])
                elif held:
                    held[head % places] = [seen + k]
                    head += 1
            seen += n
            if held and rng.random() < 0.5:
                assert ring.next() == held[head % len(held)]
                head += 1
            assert ring.held == held


def test_uses_of_the_sketch(spark):
    rng = np.random.default_rng(15)
    a = (rng.random((60, 30)) < 0.2).astype(float)
    lists = [np.flatnonzero(x).tolist() for x in a] + [[]]
    sigs = spark.createDataFrame(list(enumerate(lists)), "id long, bits array<int>")
    sigma, factor = matrices.sketched(sigs, "bits", 30, 8).finish()
    cells = matrices.factor_cells(sigma, factor, spark)
    f = factor.astype(float)
    s2 = (f * f).sum(axis=1)
    want = [sum((f[r, x].sum()) ** 2 / (s2[r] * (s2[r] + s2.mean())) for r in range(len(f))) for x in lists]
    for limit in (1 << 26, 0):
        got = {r.id: r.leverage for r in matrices.leverage(sigs, cells, limit).collect()}
        assert len(got) == len(lists) and all(abs(got[k] - want[k]) < 1e-6 for k in got)
    energy = (f * f).sum(axis=0)
    p = {r.bit: r.promiscuity for r in matrices.promiscuity(cells).collect()}
    assert all(abs(p[e] - f[0, e] ** 2 / energy[e]) < 1e-9 for e in p) and set(p) == set(np.flatnonzero(energy > 0).tolist())
    assert [r.bit for r in matrices.hubs(cells, 0.2).collect()] == sorted(p, key=lambda e: (-round(p[e], 9), e))[: int(0.2 * len(p))]
    pairs = spark.createDataFrame([(0, 1), (2, 2), (99, 1)], "i int, j int")
    got = {(r.i, r.j): r.x for r in matrices.correlation(cells, pairs).collect()}
    assert abs(got[0, 1] - f[:, 0] @ f[:, 1]) < 1e-6 and abs(got[2, 2] - energy[2]) < 1e-6 and got[99, 1] == 0


def test_pursuit_by_joins_is_pursuit(spark):
    rng = random.Random(16)
    book = spark.createDataFrame([(k, sorted(rng.sample(range(20), rng.randint(0, 5)))) for k in range(12)], "atom_id int, bits array<int>")
    weights = spark.createDataFrame([(b, 1 + b % 4) for b in range(18)], "bit int, w int")
    sigs = spark.createDataFrame([(k, sorted(rng.sample(range(20), rng.randint(0, 9)))) for k in range(60)] + [(99, None)], "id long, bits array<int>")
    for most in (2, 32):
        a, b = ({r.id: list(r.atoms) for r in codebook.pursuit(sigs, book, weights, most=most, cells=n).collect()} for n in (10**6, 0))
        assert a == b and len(a) == 61


def test_cut_offs_of_the_first_values(spark):
    """max_cut against a walk over the values."""
    rng = random.Random(17)

    def entropy(v, cap):
        v = [x for x in v[:cap] if x > 0]
        if not v:
            return 0
        s = sum(v)
        return min(len(v), max(1, math.ceil(round(math.exp(math.log(s) - sum(x * math.log(x) for x in v) / s), 9))))

    def gap(v, cap, least=1.5, eps=1e-10):
        if len(v) < 2:
            return len(v)
        cut, most, i = cap, 0.0, 1
        while i < cap and v[i - 1] > eps:
            g = math.inf if v[i] <= 0 else v[i - 1] / v[i]
            if g > most:
                most = g
                if g >= least:
                    cut = i
            i += 1
            if g == math.inf:
                break
        return max(1, min(cut, i))

    lists = [sorted((rng.choice([0.0, 1e-12, 1.0, 2.0, 5.0, rng.random(), 9 * rng.random()]) for _ in range(rng.randint(1, 12))), reverse=True) for _ in range(60)]
    df = spark.createDataFrame([(k, v) for k, vs in enumerate(lists) for v in vs], "k int, x double")
    for most in (None, 0, 3, 6):
        got = {r.k: r for r in thresholds.cut_offs(df, ["k"], "x", max_cut=most).collect()}
        for k, v in enumerate(lists):
            cap = len(v) if most is None else min(max(most, 1), len(v))
            e, g = entropy(v, cap), gap(v, cap)
            assert (got[k].entropy, got[k].gap_ratio) == (e, g), (v, most)
            assert (got[k].entropy_threshold, got[k].gap_threshold) == (v[e] if e < len(v) else 0.0, v[g] if g < len(v) else 0.0)


def test_factors_of_many_directions(spark):
    """Leverage and correlation of a factor that has more directions than bits, against the sums written out; no step holds signatures by directions."""
    rng = np.random.default_rng(21)
    f = rng.normal(size=(300, 7)) * (rng.random((300, 7)) < 0.8)
    f[5] = 0
    cells = spark.createDataFrame([(r, e, float(x)) for (r, e), x in np.ndenumerate(f) if x], "r int, bit int, x double")
    lists = [sorted(rng.choice(9, rng.integers(0, 8), replace=False).tolist()) for _ in range(50)] + [None, [-1, 3], [8]]
    sigs = spark.createDataFrame(list(enumerate(lists)), "id long, bits array<int>")
    s2 = (f * f).sum(axis=1)
    s2, some = s2[s2 > 0], f[s2 > 0]
    want = [sum(some[r, [e for e in x or [] if 0 <= e < 7]].sum() ** 2 / (s2[r] * (s2[r] + s2.mean())) for r in range(len(some))) for x in lists]
    assert all(abs(r.leverage - want[r.id]) < 1e-9 for r in matrices.leverage(sigs, cells).collect())
    assert matrices.leverage(sigs, cells).count() == len(lists)
    plan = matrices.correlation(cells, spark.createDataFrame([(1, 4), (9, 9)], "i int, j int"))
    assert "SortMergeJoin [j" not in plan._jdf.queryExecution().executedPlan().toString() and "r#" not in plan._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.i, r.j): r.x for r in plan.collect()}
    assert abs(got[1, 4] - f[:, 1] @ f[:, 4]) < 1e-9 and got[9, 9] == 0
    shared = []
    broadcast = spark.sparkContext.__class__.broadcast
    try:
        spark.sparkContext.__class__.broadcast = lambda self, x: shared.append(x[0].shape) or broadcast(self, x)
        matrices.leverage(sigs, cells)
    finally:
        spark.sparkContext.__class__.broadcast = broadcast
    assert shared == [(8, 7)]


@pytest.mark.parametrize(("boost", "strip", "reservoir"), [(6.0, 0.1, 5)])
def test_learner_of_many_batches_is_that_of_jobs(spark, monkeypatch, boost, strip, reservoir):
    """One task that takes batch after batch, a few batches a job, learns what jobs for each batch do; and needs no job for each."""
    rng = random.Random(22)
    kinds = [sorted(rng.sample(range(30), rng.randint(3, 9))) for _ in range(12)]
    rows = [(k, rng.choice([None, *range(5)]), rng.choice([None, [], *[sorted(set(x) | set(rng.sample(range(33), 2))) for x in kinds]])) for k in range(95)]
    given = spark.createDataFrame(rows, "id long, seq long, bits array<int>").repartition(3)
    weights = spark.createDataFrame([(b, 1 + b % 5) for b in range(31)], "bit int, w int")
    s = learner.Settings(atoms=7, width=4, batch=20, boost=boost, strip=strip, reservoir=reservoir, directions=8)
    monkeypatch.setattr(learner, "CHUNK", 50)
    got, jobs = [], []
    pursuit = codebook.pursuit
    monkeypatch.setattr(codebook, "pursuit", lambda *a: jobs.append(1) or pursuit(*a))
    for few in (100, 0):
        monkeypatch.setattr(learner, "FEW", few)
        got.append({r.atom_id: list(r.bits) for r in learner.learn(given, weights, s, 30).collect()})
    assert got[0] == got[1] and len(jobs) == 5 and sum(map(bool, got[0].values())) > 4


def test_sets_of_a_sketch_come_in_groups():
    """Large groups of sets keep the bounds, and take far fewer products than a row each of all bits."""
    rng = np.random.default_rng(23)
    a = (rng.random((700, 90)) < rng.random(90) ** 3).astype(float)
    count, flat = a.sum(axis=1).astype(int), np.nonzero(a)[1]
    s = matrices.Sketch(90, 12)
    s.add_sets(count, flat)
    gap = np.linalg.eigvalsh(a.T @ a - (s.rows.T @ s.rows).astype(float))
    assert len(s.rows) <= 24 and gap.min() > -1e-1 and gap.max() <= a.sum() / 12
    few = matrices.Sketch(90, 12)
    few.add_sets(count[:20], flat[: count[:20].sum()])
    assert np.array_equal(few.rows, a[:20])


def test_spelling_many_words_at_once():
    """Against a Decomposer word by word; and stretches left open by older parts, cut by new ones, are those of the whole dictionary."""
    import pyarrow as pa

    rng = random.Random(31)
    some = lambda: "".join(rng.choice("abcab-'1") for _ in range(rng.randint(2, 8)))
    new = list(dict.fromkeys((rng.choice(["Start", "Mid", "End"]), some()) for _ in range(90)))
    parts = [(i, *p) for i, p in enumerate([("Whole", "abc"), ("Whole", "é")] + new[:40] + dictionary.atoms()[:150] + new[40:] + [("Mid", "éa")])]
    words = ["", None, "a", "abc", "é", "aéab", "ab\0ab", "abcab" * 20, *("".join(rng.choice("abcab-'1z") for _ in range(rng.randint(1, 70))) for _ in range(600))]
    d, s = dictionary.Decomposer(parts), dictionary.Speller(parts)
    count, flat = s.parts(pa.array(words))
    assert [x.tolist() for x in np.split(flat, np.cumsum(count)[:-1])] == [d.parts(w or "") for w in words]
    spelt = [[] for _ in words]
    for k, a, b in zip(*(x.tolist() for x in s.runs(pa.array(words)))):
        spelt[k].append((a, b))
    assert spelt == [d.runs(w or "") for w in words]
    assert dictionary.Speller([]).parts(pa.array(["ab", ""]))[0].tolist() == [0, 0]


def test_training_goes_on_from_what_is_open(spark, monkeypatch):
    """Words are spelt once, whatever the number of rounds, and the dictionary is that of spelling all words in each."""
    rng = random.Random(32)
    stems, ends = ["walk", "talk", "jump", "plaé"], ["ing", "ed", "er", "s"]
    words = spark.createDataFrame([(k, 1 + i % 7) for i, k in enumerate(sorted({rng.choice(stems) * rng.randint(1, 2) + rng.choice(ends) + rng.choice(["", "ly", "ness", "xq7"]) for _ in range(200)}))], "value string, n long")
    delims = spark.createDataFrame([(" ", 50)], "value string, n long")
    parts = dictionary.seeded(words, delims)
    for _ in range(3):
        parts = dictionary.promoted(words, parts)
    calls, unclaimed = [], dictionary.unclaimed
    monkeypatch.setattr(dictionary, "unclaimed", lambda *a: calls.append(1) or unclaimed(*a))
    got = dictionary.train(words, delims, 3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, parts.collect())) and len(calls) == 1 and got.where("kind = 'Mid'").count() > 3


def test_sums_need_no_signatures(spark, monkeypatch):
    """Sums by bit of signatures of long sentences, which aren't made."""
    docs = spark.createDataFrame([(1, " ".join(f"w{k % 7} x{k % 5}" for k in range(300)) + ". a b")], "doc_id long, text string")
    parts = dictionary.numbered(spark, dictionary.atoms())
    size = len(dictionary.atoms())
    w = np.arange(3 * size) ** 2
    want = {(r.doc_id, r.idx): int(w[r.bits].sum()) for r in signatures.encoded_texts(docs, parts).collect()}
    monkeypatch.setattr(signatures.Spans, "signatures", None)
    got = signatures.summed_texts(docs, parts, {"x": w}).collect()
    assert {(r.doc_id, r.idx): r.x for r in got} == want and len(want) == 602


def test_small_codebooks_go_to_the_signatures(spark, monkeypatch):
    """Signatures' bits don't meet by bit, and are scored once."""
    rng = random.Random(41)
    book = spark.createDataFrame([(k, sorted(rng.sample(range(20), rng.randint(0, 5)))) for k in range(12)], "atom_id int, bits array<int>")
    weights = spark.createDataFrame([(b, 1 + b % 4) for b in range(18)], "bit int, w int")
    bits = spark.createDataFrame([(k, b) for k in range(60) for b in rng.sample(range(20), rng.randint(0, 9))], "id long, bit int")
    got, plans = [], []
    for small in (0, 10**6):
        monkeypatch.setattr(codebook, "SMALL", small)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        try:
            first = codebook.first_round(bits, book, weights)
            plans.append(first._jdf.queryExecution().executedPlan().toString())
            got.append((sorted(map(tuple, codebook.scores(bits, book, weights).collect())), sorted(map(tuple, first.collect()))))
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got[0] == got[1] and len(got[0][1]) > 40
    assert "BroadcastHashJoin" in plans[1] and "BroadcastHashJoin" not in plans[0] and plans[1].count("max_by") <= 2
