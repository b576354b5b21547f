"""The pipeline's stages on a small table, against the operators one by one."""

import corpus_pipeline
from textsig.llm import bpe


def test_pipeline(spark, tmp_path):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    words = base.split()
    docs = [(k, f"{base} number{k} " + " ".join(words[(k * j) % 12] + str(k) for j in range(40)), "en", "s", 1) for k in range(30)]
    docs += [(100, docs[0][1] + " more", "en", "s", 1), (101, "mail io.33@mail4.example.com to " + " ".join(f"q{j}" for j in range(50)), "en", "s", 1), (102, " ".join(f"z{j}" for j in range(30)) + " the benchmark item has this very text in it", "en", "s", 1), (103, None, "en", "s", None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "The benchmark item has this very text in it.")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == {*range(30), 101, 103}
    enc = bpe.encoder(bpe.load())
    assert bpe.text_of(enc, __import__("numpy").array(out[101].tokens)).startswith("mail <EMAIL> to q0")
    assert out[103].tokens is None and all(r.exact for i, r in out.items() if i != 103)


SCHEMA = "doc_id long, text string, lang string, " + ", ".join(f"`{c}` string" for c in ["fp", "row_id", "tokens", "n_tokens", "exact", "__text", "tokens_text", "label", "keep"])
BASE = " ".join(f"w{k}" for k in range(40))
ROWS = [(None, "no id"), (None, "no id"), (1, None), (2, ""), (3, " \n"), (4, BASE), (4, BASE), (5, BASE + " more"), (None, BASE), (6, "word " * 30_000), (7, "mail io.33@mail4.example.com today"), (8, " ".join(f"z{k}" for k in range(30)) + " the benchmark item has this very text in it"), (9, "é" * 20_000)]


def made(spark, tmp_path, rows, labels=True, items=True):
    docs = spark.createDataFrame([(i, t, "en", *["x"] * 9) for i, t in rows], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, 1, 0), (None, 1, 0), (5, None, 0)] if labels else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "The benchmark item has this very text in it."), (2, None), (None, ""), (1, "The benchmark item has this very text in it.")] if items else [], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return spark.read.parquet(f"{tmp_path}/documents.parquet")


def test_stages_on_odd_rows(spark, tmp_path):
    docs = made(spark, tmp_path, ROWS)
    some = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    every = sorted(ROWS, key=repr)
    stage = dict(corpus_pipeline.STAGES)
    for name, f in stage.items():
        out = f(spark, docs, str(tmp_path))
        if name != "byte-level BPE":
            assert out.dtypes == docs.dtypes, name
    assert some(stage["quality classifier"](spark, docs, str(tmp_path))) == every  # one good label: nothing is rejected
    kept = [(4, BASE), (None, "no id"), (1, None), (2, ""), (3, " \n"), *ROWS[9:]]
    assert some(stage["n-gram Jaccard join"](spark, docs, str(tmp_path))) == sorted(kept, key=repr)
    assert some(stage["benchmark decontamination"](spark, docs, str(tmp_path))) == sorted((r for r in ROWS if r[0] != 8), key=repr)
    masked = [(i, "mail <EMAIL> today" if i == 7 else t) for i, t in ROWS]
    assert some(stage["PII"](spark, docs, str(tmp_path))) == sorted(masked, key=repr)
    last = stage["byte-level BPE"](spark, docs, str(tmp_path))
    assert last.columns == [c for c in docs.columns if c not in ("text", "tokens", "n_tokens", "exact")] + ["tokens", "n_tokens", "exact"]
    rows = last.collect()
    assert len(rows) == len(ROWS) and all(r.exact and r.n_tokens == len(r.tokens) for r in rows if r.doc_id != 1)
    assert [(r.tokens, r.n_tokens, r.exact) for r in rows if r.doc_id == 1] == [(None, None, None)]


def test_stages_on_empty_tables(spark, tmp_path):
    docs = made(spark, tmp_path, [], labels=False, items=False)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, docs, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
