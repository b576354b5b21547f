import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from textsig.operators import codebook, dictionary, learner, matrices
from textsig.sources import formats
from textsig.streaming import counts

PARTS = [("Whole", "the"), ("Start", "un"), ("Mid", "port"), ("End", "ing"), ("Delimiter", "\n\n"), ("Delimiter", "\t\x01\\"), ("Delimiter", " ")]
ALL = list(dict.fromkeys([*PARTS, *dictionary.atoms()]))


def test_dictionary_round_trips(spark, tmp_path):
    assert formats.to_text(ALL) == "the\nun##\n##port##\n##ing\n[delim]\n\\n\\n\n\\t\\x01\\\\\n \n"
    assert formats.from_text(formats.to_text(ALL)) == ALL == formats.from_binary(formats.to_binary(ALL)) == formats.from_table(formats.to_table(ALL))
    assert set(formats.from_blocks(formats.to_blocks(ALL))) == set(ALL)
    for name in ("d.txt", "d.bin"):
        formats.save_dictionary(dictionary.numbered(spark, ALL), f"{tmp_path}/{name}")
        assert formats.parts_of(formats.load_dictionary(spark, f"{tmp_path}/{name}")) == ALL
    good = formats.to_binary(ALL)
    for bad in (b"XXXX" + good[4:], good[:4] + b"\x02" + good[5:], good[:-1], good[:8] + b"\x09" + good[9:]):
        with pytest.raises(ValueError):
            formats.from_binary(bad)


def test_older_forms(spark):
    assert formats.from_table("0\tWhole\ta\\x41\\n\\\\\n") == [("Whole", "a\\x41\n\\")]  # no hexadecimal signs there
    assert formats.from_text("a\n[delim]\n\\x41\n")[:2] == [("Whole", "a"), ("Delimiter", "A")]
    good = formats.to_blocks(ALL)
    for bad in (good[:-1], good[:20], b"XXXX" + good[4:], good[:12] + b"\x09" + good[13:]):
        with pytest.raises(ValueError):
            formats.from_blocks(bad)


def test_text_form_as_a_table(spark):
    lines = formats.text_lines(dictionary.numbered(spark, ALL)).orderBy("line").collect()
    assert "".join(r.text + "\n" for r in lines) == formats.to_text(ALL) and [r.line for r in lines] == list(range(len(lines)))


def test_binary_cache_of_a_text(spark, tmp_path):
    text, binary = f"{tmp_path}/d.txt", f"{tmp_path}/d.bin"
    formats.save_dictionary(dictionary.numbered(spark, ALL), text)
    assert formats.parts_of(formats.cached_dictionary(spark, text)) == ALL and os.path.exists(binary)
    other = [("Whole", "other"), *dictionary.atoms()]
    formats.save_dictionary(dictionary.numbered(spark, other), binary)
    os.utime(binary, (os.path.getmtime(text) + 9,) * 2)
    assert formats.parts_of(formats.cached_dictionary(spark, text)) == [("Whole", "other"), *[a for a in dictionary.atoms()]]
    os.utime(binary, (1, 1))
    assert formats.parts_of(formats.cached_dictionary(spark, text)) == ALL
    (tmp_path / "d.bin").write_bytes(b"damaged")
    os.utime(binary, (os.path.getmtime(text) + 9,) * 2)
    assert formats.parts_of(formats.cached_dictionary(spark, text)) == ALL


def test_reports(spark, tmp_path):
    formats.report(spark.createDataFrame([(1, 0.5, ["a", "b"], None)], "n long, x double, words array<string>, y string"), f"{tmp_path}/r.tsv")
    assert (tmp_path / "r.tsv").read_text() == "n\tx\twords\ty\n1\t0.5000\ta b\t\n"


def test_streams(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"a b{k % 3}. a!") for k in range(30)], "doc_id long, text string").repartition(3)
    docs.write.parquet(f"{tmp_path}/docs")
    stream = lambda df, path: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    run = lambda out, name, mode="complete": out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    run(counts.token_counts(stream(docs, f"{tmp_path}/docs")), "words")
    assert {r.value: r.n for r in spark.table("words").collect()} == {"a": 60, "b0": 10, "b1": 10, "b2": 10}
    rng = np.random.default_rng(3)
    bits = spark.createDataFrame([(k, sorted(set(rng.integers(0, 20, 4).tolist()))) for k in range(60)], "id long, bits array<int>").repartition(3)
    bits.write.parquet(f"{tmp_path}/bits")
    run(counts.bit_counts(stream(bits, f"{tmp_path}/bits")), "bits_seen")
    want = {}
    for r in bits.collect():
        for b in r.bits:
            want[b] = want.get(b, 0) + 1
    assert {r.bit: r.df for r in spark.table("bits_seen").collect()} == want
    sketch = counts.StreamedSketch("bits", 20, 8)
    stream(bits, f"{tmp_path}/bits").writeStream.foreachBatch(sketch.update).trigger(availableNow=True).start().awaitTermination()
    sketch.update(bits, 0)  # again: left out
    a = np.zeros((60, 20))
    for r in bits.collect():
        a[r.id, r.bits] = 1
    sigma, rows = sketch.finish()
    gap = np.linalg.eigvalsh(a.T @ a - rows.T.astype(float) @ rows)
    assert gap.min() > -1e-2 and gap.max() <= (a**2).sum() / 8 and isinstance(sketch.sketch, matrices.Sketch)
    events = spark.createDataFrame([(f"2024-01-01 00:{m:02d}:00", m % 2) for m in range(60)] + [("2024-01-01 02:00:00", 0), ("2024-01-01 05:00:00", 0)], "t string, k int").select(F.to_timestamp("t").alias("t"), "k").coalesce(1)
    events.write.parquet(f"{tmp_path}/events")
    run(counts.windowed_counts(stream(events, f"{tmp_path}/events"), "t", ["k"], "30 minutes"), "windows", "append")
    got = {(str(r.start), r.k): r.n for r in spark.table("windows").collect()}
    assert got["2024-01-01 00:00:00", 0] == got["2024-01-01 00:30:00", 1] == 15


def test_tables_of_bits(spark, tmp_path):
    w, cap = formats.weights_from_bytes(formats.weights_to_bytes({0: 3, 9: 16}, 10, 16))
    assert w.tolist() == [3, *[0] * 8, 16] and cap == 16
    atoms = [[1, 5], [], [70000]]
    assert formats.codebook_from_bytes(formats.codebook_to_bytes(atoms, 70001, 8)) == (atoms, 70001, 8)
    rows = [(k, sorted({(k * 7919 + j * 131) % 140000 for j in range(k % 9)})) for k in range(50)]
    path = f"{tmp_path}/x.cnd"
    assert formats.write_signatures(spark.createDataFrame(rows, "sig_id long, bits array<int>").repartition(4), 140000, path) == 50
    assert [(r.sig_id, r.bits) for r in formats.read_signatures(spark, path).orderBy("sig_id").collect()] == rows
    with pytest.raises(ValueError):
        formats.codebook_from_bytes(b"CBK2" + bytes(20))
    for beyond in ([140000], [-1]):
        with pytest.raises(ValueError):
            formats.signature_bytes(beyond, 140000)


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\r\n\nthree")
    assert formats.documents(spark, f"{tmp_path}/a.txt").collect()[0].text == "one\ntwo\r\n\nthree"
    assert [r.word for r in formats.word_list(spark, f"{tmp_path}/a.txt").collect()] == ["one", "two", "three"]


def test_learner_finds_planted_atoms(spark):
    planted = [list(range(10 * k, 10 * k + 6)) for k in range(4)]
    rows = [(i, i, sorted(planted[i % 4] + planted[(i // 4) % 4]) if i % 3 else planted[i % 4]) for i in range(240)]
    rows = [(i, s, sorted(set(b))) for i, s, b in rows]
    sigs = spark.createDataFrame(rows, "id long, seq long, bits array<int>")
    weights = spark.createDataFrame([(b, 1, 4) for b in range(40)], "bit int, df int, w int")
    s = learner.Settings(atoms=8, width=6, batch=80, congestion=0.05)
    book = learner.learn(sigs, weights, s)
    assert book.count() == 8 and all(len(r.bits) <= 6 for r in book.collect())
    fired = codebook.pursuit(sigs, book, weights)
    long = sigs.select("id", F.explode("bits").alias("bit"))
    recon = codebook.decoded(fired.where("size(atoms) > 0"), book).select("id", F.explode("bits").alias("bit"))
    assert codebook.reconstruction(long, recon, weights, 0).agg(F.avg("recall_all")).first()[0] > 0.6
    assert learner.utilisation(fired, book).first().used >= 3


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, "a b a"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/in/1")
    spark.createDataFrame([(3, "b c.")], "doc_id long, text string").write.parquet(f"{tmp_path}/in/2")
    stream = spark.readStream.schema("doc_id long, text string").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = counts.token_counts(stream).writeStream.format("memory").queryName("counted").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.value, r.n) for r in spark.table("counted").collect()} == {("a", 2), ("b", 2), ("c", 1)}
