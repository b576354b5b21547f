import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from textsig.functions import tokens as tok

W, D = "W", "D"
FOLD = {c: c + 32 for c in range(65, 91)}
CASES = [
    ("", []), ("I am Running.", [(W, "i"), (D, " "), (W, "am"), (D, " "), (W, "running"), (D, ".")]), ("a  b", [(W, "a"), (D, "\t"), (W, "b")]),
    ("a\nb", [(W, "a"), (D, "\n"), (W, "b")]), ("a\n  \nb", [(W, "a"), (D, "\n\n"), (W, "b")]), ("hello.... world", [(W, "hello"), (D, "..."), (D, " "), (W, "world")]),
    ("hello.. x", [(W, "hello"), (D, ".."), (D, " "), (W, "x")]), ("yes---no", [(W, "yes"), (D, "--"), (W, "no")]), ("rock'n'roll", [(W, "rock'n'roll")]),
    ("boys' room", [(W, "boys'"), (D, " "), (W, "room")]), ("'hi'", [(D, "'"), (W, "hi"), (D, "'")]), ("'90s", [(D, "'"), (W, "90s")]), ("-bar", [(D, "-"), (W, "bar")]), ("co-", [(W, "co"), (D, "-")]),
    ("555-123-4567", [(W, "555-123-4567")]), ("R&D's", [(W, "r&d's")]), ("&c", [(D, "&"), (W, "c")]), ("cis-1,4-cyclohexadiene", [(W, "cis-1,4-cyclohexadiene")]), ("Bob,Alice", [(W, "bob"), (D, ","), (W, "alice")]),
    ("3.14.15", [(W, "3.14.15")]), ("1.000,50", [(W, "1.000,50")]), ("X.5", [(W, "x.5")]), ("5.x", [(W, "5"), (D, "."), (W, "x")]), ("abc.def", [(W, "abc"), (D, "."), (W, "def")]), ("U.S.A.", [(W, "u.s.a"), (D, ".")]),
    ("-$1,234.50", [(W, "-$1,234.50")]), ("5 -10", [(W, "5"), (D, " "), (W, "-10")]), ("5+5", [(W, "5"), (D, "+"), (W, "5")]), ("--5", [(D, "--"), (W, "5")]), ("--$5", [(D, "--"), (W, "$5")]), ("- 5", [(D, "-"), (D, " "), (W, "5")]),
    ("(-$5)", [(D, "("), (W, "-$5"), (D, ")")]), ("$$", [(D, "$$")]), ("5$", [(W, "5"), (D, "$")]), ("a$5", [(W, "a"), (D, "$"), (W, "5")]), ("\r", [(D, "\t")]), ("Éa", [(D, "É"), (W, "a")]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_tokens(text, want):
    assert tok.tokenize(text) == want


def space(run):
    n = run.count("\n")
    return "\n\n" if n > 1 else "\n" if n else " " if run == " " else "\t"


def signs(run):
    if len(run) > 1 and run[0] in ".-" and run == run[0] * len(run):
        return "--" if run[0] == "-" else "..." if len(run) > 2 else run
    return run


def step_by_step(text):
    """The tokens by one pass over the characters with a quote state."""
    word, digit, letter = (lambda c: c.isascii() and c.isalnum()), (lambda c: c in "0123456789" and c != ""), (lambda c: c.isascii() and c.isalpha())
    at = lambda k: text[k] if 0 <= k < len(text) else ""

    def sign(p):
        if word(at(p - 1)) if p else False:
            return 0
        k = 1 if at(p) in ("+", "-") else 0
        k += at(p + k) == "$"
        return k if k and digit(at(p + k)) else 0

    out, i, quoted = [], 0, False
    while i < len(text):
        k, c = sign(i), at(i)
        if k or word(c):
            j = i + (k or 1)
            while j < len(text):
                c, left, right = at(j), at(j - 1), at(j + 1)
                inner = word(c) or (c in "-&'" and word(right)) or (c in ",." and digit(left) and digit(right)) or (c == "." and word(right) and letter(left) and (j == i + 1 or at(j - 2) == "."))
                if not inner:
                    j += c == "'" and not quoted
                    break
                j += 1
            out.append((W, text[i:j].translate(FOLD)))
        else:
            blank = c in " \t\r\n"
            j = i + 1
            while j < len(text) and not word(at(j)) and (at(j) in " \t\r\n") == blank and not (not blank and sign(j) and set(text[i : j + 1]) != {"-"}):
                j += 1
            run = text[i:j]
            out.append((D, space(run) if blank else signs(run)))
            quoted ^= not blank and run.count("'") % 2 == 1
        i = j
    return out


def segment_step_by_step(tokens, most):
    ends, sentences, paragraphs, s, p, size, url = [], [], [], 0, 0, 0, False
    for i, (kind, value) in enumerate(tokens):
        end, m = False, re.search("[.!?]", value)
        if kind == D and m and not re.search("[,;]", value[m.end() :]):
            last = i + 1 == len(tokens)
            before = tokens[i - 1][1] if i and tokens[i - 1][0] == W else ""
            if before in tok.ABBREVIATIONS:
                end = False
            elif "." in before:
                end = last or (tokens[i + 1][0] == D and "\n" in tokens[i + 1][1])
            else:
                end = not (url and not last and tokens[i + 1][0] == W)
        if kind == D:
            url = not re.search("[ \t\r\n]", value) and (url or value == "@" or "://" in value)
        ends.append(end)
        sentences.append(s)
        paragraphs.append(p)
        s, size = s + end, size + 1
        if (kind, value) == (D, "\n\n") or size >= max(1, most):
            p, size = p + 1, 0
    return ends, sentences, paragraphs


@pytest.mark.parametrize("most", [1, 5, 4096])
def test_random_strings_in_one_batch(most):
    rng = random.Random(most)
    pieces = [*"aB5 .,-'&$+\n!é@:/;", "Mr", "etc", "U.S.A", "://", "\n\n", "...."]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 24))) for _ in range(20_000)]
    texts = [None if rng.random() < 0.01 else t for t in texts]
    cut = tok.Cut(pa.array(texts))
    kinds, values, segments = np.where(cut.word, W, D).tolist(), cut.values().to_pylist(), [x.tolist() for x in cut.segments(most)]
    assert cut.values(np.arange(len(cut))).to_pylist() == values
    for r, t in enumerate(texts):
        a, b = cut.first[r], cut.first[r + 1]
        found = list(zip(kinds[a:b], values[a:b]))
        assert found == step_by_step(t or ""), repr(t)
        assert tuple(x[a:b] for x in segments) == segment_step_by_step(found, most), repr(t)


def test_counts_are_those_of_the_tokens(spark):
    rng = random.Random(9)
    texts = [None, "", *("".join(rng.choice(["a", "B", "cd", " ", ". ", "\n\n", "!"]) for _ in range(rng.randint(0, 60))) for _ in range(80)), "word " * 20_000]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, value string")
    rows = tok.tokens(docs).collect()
    count = lambda it: dict(Counter(it))
    assert {(r.type, r.value): r.n for r in tok.frequencies(docs).collect()} == count((r.type, r.value) for r in rows)
    for kind in (W, D):
        assert {r.value: r.n for r in tok.counts(docs, kind).collect()} == count(r.value for r in rows if r.type == kind)
    for scale in ("sentence", "paragraph"):
        want = {}
        for r in rows:
            a, b, n = want.get((r.doc_id, r[scale]), (r.idx, 0, 0))
            want[r.doc_id, r[scale]] = (min(a, r.idx), max(b, r.idx + 1), n + (r.type == W))
        assert {(r.doc_id, r.span): (r.start_tok, r.end_tok, r.words) for r in tok.spans(docs, scale).collect()} == want
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert {r.doc_id: tuple(r)[1:] for r in tok.totals(docs).collect()} == {k: (len(x), sum(r.type == W for r in x), sum(r.type == D for r in x), len({r.value for r in x if r.type == W})) for k, x in by.items()}
    assert sorted(tuple(r) for r in tok.words(docs).collect()) == sorted((r.doc_id, r.sentence, r.idx, r.value) for r in rows if r.type == W)


def test_runs_by_kind(spark):
    runs = spark.createDataFrame([(" ",), ("  ",), ("\n",), ("\n \n",), ("\r",), ("...",), ("....",), ("..",), ("---",), ("-",), ("!?",)], "run string").collect()
    df = spark.createDataFrame(runs)
    got = {r.run: (r.a, r.b) for r in df.select("run", tok.space_kind(df.run).alias("a"), tok.sign_kind(df.run).alias("b")).collect()}
    assert all(got[r][0] == space(r) for r in got if not r.strip()) and all(got[r][1] == signs(r) for r in got if r.strip())


def test_tokens_of_random_strings():
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice("aB5 .,-'&$+\n!é") for _ in range(rng.randint(0, 14)))
        assert tok.tokenize(text) == step_by_step(text), repr(text)


@pytest.mark.parametrize(
    ("text", "n"),
    [("", 0), ("One. Two! Three?", 3), ("No end", 1), ("Mr. Smith left. He ran.", 2), ("In the U.S.A. we", 1), ("He is in the U.S.A.", 1), ("U.S.A.\nNext", 2), ("a.b@c.example.com is. It", 2), ("see http://x.example.com now. Yes", 2), ("wait.; no", 1), ("etc., so on.", 1), ("end ... more", 2)],
)
def test_sentences(text, n):
    assert len(set(tok.segment(text)[1])) == n


def test_paragraphs_are_cut():
    text = "a b\n\nc d e f g"
    assert tok.segment(text)[2] == [0] * 4 + [1] * 9
    assert tok.segment(text, 3)[2] == [0, 0, 0, 1, 2, 2, 2, 3, 3, 3, 4, 4, 4]


def test_table(spark):
    docs = spark.createDataFrame([(1, "A b. C"), (2, None), (3, ""), (None, "x"), (1, "A b. C")], "doc_id long, text string")
    rows = tok.tokens(docs).collect()
    assert len(rows) == 2 * 6 + 1 and {r.doc_id for r in rows} == {1, None}
    assert tok.tokens(docs.limit(0)).count() == 0


def test_distinct_words_by_key(spark, monkeypatch):
    """Of each key, null too, and however texts are sliced; only distinct ones leave a slice."""
    texts = [("en", "a b a"), (None, "a c"), ("de", "b b b"), ("en", "c b"), ("fr", "..."), ("en", None), (None, "c")]
    docs = spark.createDataFrame(texts, "lang string, text string").coalesce(1)
    want = {(k, w) for k, t in texts for w in (t or "").replace(".", "").split()}
    for size in (4, 1 << 20):
        monkeypatch.setattr(tok, "SLICE", size)
        monkeypatch.setattr(tok.sliced, "__defaults__", (size,))
        got = [tuple(r) for r in tok.distinct_words(docs, key="lang").collect()]
        assert set(got) == want and len(got) == len(want)
