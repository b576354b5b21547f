"""The registered queries of the library's own operators."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tokens as tok
from ..operators import codebook, dictionary, learner, matrices, signatures, thresholds, uniqueness
from ..sources import formats
from .oracles import SQL
from .tables import ranked, spread, written

_found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f):  # noqa: ANN001, ANN202
    _found[f.__name__] = f
    return f


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _freq(spark: SparkSession, sf_dir: str, kind: str = "W") -> DataFrame:
    return tok.counts(_documents(spark, sf_dir), kind)


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Word and delimiter frequencies, from one scan."""
    both = written(tok.frequencies(_documents(spark, sf_dir)), "frequencies")
    return tuple(both.where(F.col("type") == k).select("value", "n") for k in "WD")


def _atoms(spark: SparkSession) -> DataFrame:
    return dictionary.numbered(spark, dictionary.atoms())


def _dictionary(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(word frequencies, dictionary after one round of peeling): what SQL can learn too."""
    words, delims = _both(spark, sf_dir)
    return words, dictionary.train(words, delims, 1)


@_query
def scan_documents(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes"))


@_query
def ascii_lower(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", tok.ascii_lower(F.col("text")).alias("lower_text"))


@_query
def tokenize(spark, sf_dir):
    return tok.tokens(_documents(spark, sf_dir), segmented=False)


@_query
def word_freq(spark, sf_dir):
    return _freq(spark, sf_dir)


@_query
def delim_freq(spark, sf_dir):
    return _freq(spark, sf_dir, "D")


@_query
def token_totals(spark, sf_dir):
    return tok.totals(_documents(spark, sf_dir))


@_query
def token_totals_all(spark, sf_dir):
    """Over all documents."""
    d = written(tok.totals(_documents(spark, sf_dir)), "totals")
    distinct = _freq(spark, sf_dir).agg(F.count("*").alias("distinct_words"))
    return d.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "words", "delims")]).crossJoin(distinct)  # a row each


@_query
def words_only(spark, sf_dir):
    return tok.words(_documents(spark, sf_dir))


@_query
def sentence_ends(spark, sf_dir):
    return tok.tokens(_documents(spark, sf_dir)).where("ends").select("doc_id", "idx")


@_query
def sentences(spark, sf_dir):
    return tok.spans(_documents(spark, sf_dir)).select("doc_id", F.col("span").alias("sentence"), "start_tok", "end_tok")


@_query
def paragraphs(spark, sf_dir):
    return tok.spans(_documents(spark, sf_dir), "paragraph").select("doc_id", F.col("span").alias("paragraph"), "start_tok", "end_tok")


@_query
def candidate_count(spark, sf_dir):
    return tok.totals(_documents(spark, sf_dir)).select("doc_id", (2 * F.col("words")).alias("candidates"))


@_query
def multiscale_candidates(spark, sf_dir):
    both = [tok.spans(_documents(spark, sf_dir), scale).select(F.lit(scale).alias("scale"), "doc_id", "span", F.col("words").alias("signatures")) for scale in ("sentence", "paragraph")]
    return both[0].unionByName(both[1]).where("signatures > 0")


@_query
def cut_offs(spark, sf_dir):
    return thresholds.cut_offs(_order_counts(spark, sf_dir), ["o_orderpriority"], "v").drop("entropy_threshold", "gap_threshold")


def _order_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderpriority", "o_custkey").agg(F.count("*").alias("v"))


@_query
def entropy_threshold(spark, sf_dir):
    return thresholds.cut_offs(_order_counts(spark, sf_dir), ["o_orderpriority"], "v").select("o_orderpriority", F.col("entropy_threshold").alias("threshold"))


@_query
def log_gap_threshold(spark, sf_dir):
    """The least gap is 0.25 in logarithms."""
    return thresholds.cut_offs(_order_counts(spark, sf_dir), ["o_orderpriority"], "v", min_gap=float(np.exp(0.25))).select("o_orderpriority", F.col("gap_threshold").alias("threshold"))


@_query
def cut_offs_limited(spark, sf_dir):
    """Entropy and gap of the 5 largest counts of each priority."""
    return thresholds.cut_offs(_order_counts(spark, sf_dir), ["o_orderpriority"], "v", max_cut=5).select("o_orderpriority", "n", "entropy", "gap_ratio")


@_query
def top_k_indices(spark, sf_dir):
    order = Window.partitionBy("l_returnflag").orderBy(F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_orderkey", "l_linenumber", F.row_number().over(order).alias("rank")).where("rank <= 10")


@_query
def whole_atoms(spark, sf_dir):
    return dictionary.whole_atoms(_freq(spark, sf_dir)).select("value", "n", "rank")


@_query
def vocab_ranked(spark, sf_dir):
    return ranked(_freq(spark, sf_dir), F.col("n").desc(), "value")


@_query
def augment_set(spark, sf_dir):
    return _atoms(spark)


@_query
def render_parts(spark, sf_dir):
    return dictionary.rendered(_dictionary(spark, sf_dir)[1])


@_query
def kind_counts(spark, sf_dir):
    return _dictionary(spark, sf_dir)[1].groupBy("kind").agg(F.count("*").alias("n"))


@_query
def dict_ids(spark, sf_dir):
    """The dictionary of one round of peeling."""
    return _dictionary(spark, sf_dir)[1]


def _seeded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    words, delims = _both(spark, sf_dir)
    return words, dictionary.seeded(words, delims)


@_query
def peel_bins(spark, sf_dir):
    return dictionary.bins(*_seeded(spark, sf_dir))


@_query
def peel_iteration_1(spark, sf_dir):
    return dictionary.peel(*_seeded(spark, sf_dir)).select("length", "kind", "value", "weight", "rank")


@_query
def peel_iteration_2(spark, sf_dir):
    return dictionary.peel(*_dictionary(spark, sf_dir)).select("length", "kind", "value", "weight", "rank")


@_query
def singleton_runs(spark, sf_dir):
    return dictionary.unclaimed(*_dictionary(spark, sf_dir)).select("value", "a", "b")


def _trained(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    words, delims = _both(spark, sf_dir)
    return words, dictionary.train(words, delims)


@_query
def train_dictionary(spark, sf_dir):
    """All rounds."""
    return _trained(spark, sf_dir)[1]


@_query
def decompose_words(spark, sf_dir):
    d = dictionary.decomposed(*_dictionary(spark, sf_dir))
    return d.select("value", "n", F.array_join("part_ids", ",").alias("part_ids"), F.array_join("bag", ",").alias("bag"))


@_query
def decompose_words_trained(spark, sf_dir):
    return dictionary.decomposed(*_trained(spark, sf_dir))


@_query
def decompose_delims(spark, sf_dir):
    """In terms of the fixed signs alone, so that most fall into signs."""
    d = dictionary.decomposed_delimiters(_freq(spark, sf_dir, "D"), _atoms(spark))
    return d.select("value", "n", F.array_join("part_ids", ",").alias("part_ids"))


@_query
def bag_size_percentiles(spark, sf_dir):
    return uniqueness.sizes(dictionary.decomposed(*_dictionary(spark, sf_dir)))


@_query
def top_collisions(spark, sf_dir):
    g = uniqueness.largest(dictionary.decomposed(*_dictionary(spark, sf_dir)))
    return g.select("rank", F.array_join("bag", ",").alias("bag"), "k", F.array_join("words", " ").alias("words"))


@_query
def bag_collisions_by_lang(spark, sf_dir):
    """Collisions among the words of each language."""
    _, parts = _dictionary(spark, sf_dir)
    docs = _documents(spark, sf_dir)
    words = tok.distinct_words(docs.withColumn("lang", F.coalesce("lang", F.lit(""))), key="lang")
    return uniqueness.collisions(dictionary.decomposed(words, parts), ["lang"])


@_query
def strategy_summary(spark, sf_dir):
    """How well bags tell words apart under the dictionary's four orders."""
    return uniqueness.strategies(*_dictionary(spark, sf_dir))


@_query
def strategy_summary_trained(spark, sf_dir):
    """The same for the dictionary of all rounds."""
    return uniqueness.strategies(*_trained(spark, sf_dir))


@_query
def word_bags(spark, sf_dir):
    return signatures.bags(_documents(spark, sf_dir), _dictionary(spark, sf_dir)[1]).select("doc_id", "sentence", "idx", F.array_join("bag", ",").alias("bag"))


@_query
def bag_collisions(spark, sf_dir):
    return uniqueness.collisions(dictionary.decomposed(_freq(spark, sf_dir), _atoms(spark)), []).select("words", "bags", "colliding_bags", "colliding_words")


def _sums(docs: DataFrame, parts: DataFrame) -> DataFrame:
    bit = np.arange(3 * parts.count())
    return signatures.summed_texts(docs, parts, {"n_bits": np.ones_like(bit), "bit_sum": bit, "bit_squares": bit * bit})


@_query
def encode_3f(spark, sf_dir):
    """Number, sum and sum of squares of the bits of each word's signature."""
    return _sums(_documents(spark, sf_dir), _dictionary(spark, sf_dir)[1])


@_query
def encode_3f_trained(spark, sf_dir):
    """The signatures themselves, in terms of the dictionary of all rounds."""
    return signatures.encoded_texts(_documents(spark, sf_dir), _trained(spark, sf_dir)[1])


def _band(low: int):  # noqa: ANN202
    def run(spark, sf_dir):
        parts = _dictionary(spark, sf_dir)[1]
        size = parts.count()
        inside = np.zeros(3 * size, np.int64)
        inside[low * size : (low + 1) * size] = 1
        return signatures.summed_texts(_documents(spark, sf_dir), parts, {"n_bits": inside, "bit_sum": inside * np.arange(3 * size)})

    run.__name__ = f"sig_{('before', 'current', 'after')[low]}"
    return _query(run)


for _k in range(3):
    _band(_k)


@_query
def bit_df(spark, sf_dir):
    return signatures.text_frequencies(_documents(spark, sf_dir), _dictionary(spark, sf_dir)[1]).where("bit >= 0")


def _weights(docs: DataFrame, parts: DataFrame) -> DataFrame:
    df = written(signatures.text_frequencies(docs, parts), "bit-frequencies")
    n = df.where("bit = -1").first()
    return written(signatures.surprisal_weights(df.where("bit >= 0"), n.df if n else 0), "bit-weights")


@_query
def surprisal_weights(spark, sf_dir):
    return _weights(_documents(spark, sf_dir), _dictionary(spark, sf_dir)[1])


def _by_bit(weights: DataFrame, dim: int) -> np.ndarray:
    """The weights as an array: a number for each bit of a dictionary that goes to all tasks itself."""
    out = np.zeros(dim, np.int64)
    for r in weights.select("bit", "w").collect():
        out[r.bit] = r.w
    return out


@_query
def info_content(spark, sf_dir):
    docs, parts = _documents(spark, sf_dir), _dictionary(spark, sf_dir)[1]
    return signatures.summed_texts(docs, parts, {"ic": _by_bit(_weights(docs, parts), 3 * parts.count())})


@_query
def jaccard_sparse(spark, sf_dir):
    """Each turn with the next one of its conversation."""
    s = _talk(spark, sf_dir)[0]
    both = _next(s).join(s.toDF("a", "x"), "a").join(s.toDF("b", "y"), "b")
    return both.select("a", "b", F.round(signatures.jaccard(F.col("x"), F.col("y")), 9).alias("jaccard"))


@_query
def jaccard_dense(spark, sf_dir):
    """The same of sets as arrays of 64-bit words."""
    s = _talk(spark, sf_dir)[0]
    d = signatures.dense_arrays(_long(s))
    both = _next(s).join(d.toDF("a", "x"), "a").join(d.toDF("b", "y"), "b")
    return both.select("a", "b", F.round(signatures.dense_jaccard(F.col("x"), F.col("y")), 9).alias("jaccard"))


@_query
def gram(spark, sf_dir):
    """Sums of products of the embeddings' columns."""
    g = matrices.columns_gram(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding")
    return spark.createDataFrame([(i, j, round(float(x), 4)) for i, row in enumerate(g) for j, x in enumerate(row)], "i int, j int, x double")


@_query
def fd_singular_values(spark, sf_dir):
    """Of the sentence signatures' sketch."""
    parts = _dictionary(spark, sf_dir)[1]
    values, _ = matrices.sketched(signatures.encoded_texts(_documents(spark, sf_dir), parts), "bits", 3 * parts.count(), 64).finish()
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "k int, sigma double")


@_query
def pursuit_encode(spark, sf_dir):
    """Words' bags in terms of a codebook of the benchmark items' letters."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").cast("long").alias("doc_id"), "text")
    words = dictionary.decomposed(tok.words(items).select("doc_id", "value"), _atoms(spark))
    book = codebook.normalised(words.groupBy(F.col("doc_id").cast("int").alias("atom_id")).agg(F.flatten(F.collect_list("bag")).alias("bits")), 32)
    bags = dictionary.decomposed(_freq(spark, sf_dir), _atoms(spark))
    df = bags.select(F.explode("bag").alias("bit")).groupBy("bit").agg(F.count("*").alias("df"))
    weights = signatures.surprisal_weights(df, bags.count())
    return codebook.pursuit(bags.select(F.xxhash64("value").alias("id"), F.col("bag").alias("bits")), book, weights)


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary with parts of all movable kinds from the part table, in an arbitrary but fixed order."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.lower("p_type").alias("t")).distinct()
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in (("Whole", F.col("t")), ("Start", F.substring("t", 1, 3)), ("End", F.right("t", F.lit(3))), ("Mid", F.expr("substring(t, 4, 2 + length(t) % 3)")))])
    parts = p.select(F.explode(kinds).alias("k")).select("k.*").where("value <> ''").distinct()
    return parts.select((F.row_number().over(Window.orderBy(F.md5(F.concat("kind", F.lit(" "), "value")))) - 1).alias("part_id"), "kind", "value")


def _reorder(by: str):  # noqa: ANN202
    def run(spark, sf_dir):
        return dictionary.reordered(_mixed(spark, sf_dir), by)

    run.__name__ = f"reorder_{by}"
    return _query(run)


for _by in ("type", "type_level", "level_type"):
    _reorder(_by)


@_query
def part_candidates(spark, sf_dir):
    """Every part that occurs in a word where its kind may stand."""
    return dictionary.candidates(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.lower("p_type").alias("word")).distinct(), _mixed(spark, sf_dir))


@_query
def dict_lookup(spark, sf_dir):
    words = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.lower(F.substring("p_type", 1, 3)).alias("value"), F.lit("Start").alias("kind")).unionByName(spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.lower("n_name").alias("value"), F.lit("Whole").alias("kind"))).distinct()
    return words.join(F.broadcast(_mixed(spark, sf_dir)), ["kind", "value"], "left").select("kind", "value", F.coalesce("part_id", F.lit(-1)).alias("part_id"))


def _word_bits(text) -> F.Column:  # noqa: ANN001
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) * 26 + F.ascii(w) - 97)))


def _talk(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures (id, bits) of conversation turns, a codebook of benchmark items, weights of the bits."""
    s = spark.read.parquet(f"{sf_dir}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), _word_bits("text").alias("bits"))
    book = codebook.normalised(spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").cast("int").alias("atom_id"), _word_bits("text").alias("bits")), 24)
    df = s.select(F.explode("bits").alias("bit")).groupBy("bit").agg(F.count("*").alias("df"))
    return s, book, signatures.surprisal_weights(df, s.count())


def _long(s: DataFrame) -> DataFrame:
    return s.select("id", F.explode("bits").alias("bit"))


@_query
def atom_normalize(spark, sf_dir):
    return _talk(spark, sf_dir)[1].select("atom_id", F.array_join("bits", ",").alias("bits"))


@_query
def bit_degree(spark, sf_dir):
    return codebook.bit_degree(_talk(spark, sf_dir)[1])


@_query
def pursuit_candidates(spark, sf_dir):
    s, book, w = _talk(spark, sf_dir)
    return codebook.scores(_long(s), book, w).select("id", "atom_id", "wdot", "ic")


@_query
def pursuit_round1(spark, sf_dir):
    s, book, w = _talk(spark, sf_dir)
    return codebook.first_round(_long(s), book, w)


def _decoded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s, book, w = _talk(spark, sf_dir)
    fired = codebook.first_round(_long(s), book, w).groupBy("id").agg(F.collect_list("atom_id").alias("atoms"))
    return s, codebook.decoded(fired, book), w


@_query
def union_decode(spark, sf_dir):
    return _decoded(spark, sf_dir)[1].select("id", F.array_join("bits", ",").alias("bits"))


@_query
def residual_bits(spark, sf_dir):
    s, d, _ = _decoded(spark, sf_dir)
    return _long(s).join(_long(d), ["id", "bit"], "left_anti")


@_query
def recon_metrics(spark, sf_dir):
    s, d, w = _decoded(spark, sf_dir)
    m = codebook.reconstruction(_long(s), _long(d), w, 150)
    return m.select("id", *[F.round(c, 9).alias(c) for c in m.columns if c != "id"])


@_query
def info_jaccard(spark, sf_dir):
    """Each turn with the next one of its conversation."""
    s, _, w = _talk(spark, sf_dir)
    out = signatures.weighted_jaccard(_next(s), _long(s), w)
    return out.select("a", "b", "wdot", F.round("jaccard", 9).alias("jaccard"))


@_query
def top_d_bits(spark, sf_dir):
    s, _, w = _talk(spark, sf_dir)
    order = Window.partitionBy("id").orderBy(F.col("w").desc(), "bit")
    return _long(s).join(F.broadcast(w.select("bit", "w")), "bit").withColumn("rank", F.row_number().over(order)).where("rank <= 8").select("id", "bit", "rank")


@_query
def weights_rescaled(spark, sf_dir):
    w = _talk(spark, sf_dir)[2]
    return w.select("bit", F.round(F.col("w") / F.max("w").over(Window.partitionBy()), 9).alias("scaled"))


@_query
def surprisal(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_discount").cast("double")).alias("p")).distinct()
    return p.select("p", F.when(F.col("p") > 0, F.round(-F.log("p"), 9)).otherwise(F.lit(float("inf"))).alias("bits"))


@_query
def bit_cooccurrence(spark, sf_dir):
    bits = _long(_talk(spark, sf_dir)[0])
    return bits.select("id", F.col("bit").alias("i")).join(bits.select("id", F.col("bit").alias("j")), "id").where("i <= j").groupBy("i", "j").agg(F.count("*").alias("n"))


@_query
def matmul(spark, sf_dir):
    """All embeddings times the sums of products of their columns."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return matrices.multiplied(e, "vec_id", "embedding", matrices.columns_gram(e, "embedding")).select("row", "col", (F.round("x", 3) + 0.0).alias("x"))


@_query
def gram_rows(spark, sf_dir):
    """All embeddings times their transpose: rows by rows, as the product has."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return matrices.rows_gram(e, "vec_id", "embedding").select("row", "col", (F.round("x", 5) + 0.0).alias("x"))


@_query
def context_jaccard(spark, sf_dir):
    """Signatures of a word that occurs in several sentences of an item, pair by pair."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    words = signatures.bags(items, _atoms(spark), key="item_id")
    s = signatures.encoded(words, len(dictionary.atoms()), ["item_id", "sentence"]).join(words.select("item_id", "sentence", "idx", "value"), ["item_id", "sentence", "idx"]).select("item_id", "sentence", "idx", "value", F.concat("before", "current", "after").alias("bits"))
    s = s.groupBy("item_id", "value", "sentence").agg(F.min_by("bits", "idx").alias("bits"))
    a, b = (s.select("item_id", "value", F.col("sentence").alias(f"{x}"), F.col("bits").alias(f"bits_{x}")) for x in "ab")
    return a.join(b, ["item_id", "value"]).where("a < b").select("item_id", "value", "a", "b", F.round(signatures.jaccard(F.col("bits_a"), F.col("bits_b")), 9).alias("jaccard"))


@_query
def scan_words(spark, sf_dir):
    """The lines of the documents as lists of words."""
    lines = _documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "word"))
    return formats.stripped(lines, "word")


def _kinds_of(spark: SparkSession, sf_dir: str, space: bool) -> DataFrame:
    own = F.col("value").isin(" ", "\t", "\n", "\n\n")
    return _freq(spark, sf_dir, "D").where(own if space else ~own)


@_query
def tok_ws_class(spark, sf_dir):
    return _kinds_of(spark, sf_dir, True)


@_query
def tok_punct_class(spark, sf_dir):
    return _kinds_of(spark, sf_dir, False)


@_query
def tok_number_prefix(spark, sf_dir):
    return tok.words(_documents(spark, sf_dir)).where(F.substring("value", 1, 1).isin("+", "-", "$")).select("doc_id", "idx", "value")


@_query
def dict_trained_only(spark, sf_dir):
    return _dictionary(spark, sf_dir)[1].join(F.broadcast(_atoms(spark).select("kind", "value")), ["kind", "value"], "left_anti").select("part_id", "kind", "value")  # fixed signs


@_query
def dict_text_lines(spark, sf_dir):
    return formats.text_lines(_dictionary(spark, sf_dir)[1])


@_query
def dict_text_roundtrip(spark, sf_dir):
    return dictionary.numbered(spark, formats.from_text(formats.to_text(formats.parts_of(_dictionary(spark, sf_dir)[1]))))


@_query
def dict_binary_roundtrip(spark, sf_dir):
    return dictionary.numbered(spark, formats.from_binary(formats.to_binary(formats.parts_of(_dictionary(spark, sf_dir)[1]))))


@_query
def dict_tsv_roundtrip(spark, sf_dir):
    return dictionary.numbered(spark, formats.from_table(formats.to_table(formats.parts_of(_dictionary(spark, sf_dir)[1]))))


@_query
def context_range_join(spark, sf_dir):
    return signatures.ranges(_documents(spark, sf_dir), _dictionary(spark, sf_dir)[1])


@_query
def inspect_sentence(spark, sf_dir):
    """The benchmark items, word by word, in terms of the fixed signs."""
    return signatures.inspected(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), _atoms(spark), "item_id")


def _next(s: DataFrame) -> DataFrame:
    """a, b: each turn with the next one of its conversation."""
    return s.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).join(s.select(F.col("id").alias("b")), "b", "left_semi")


@_query
def bit_intersection(spark, sf_dir):
    s = _talk(spark, sf_dir)[0]
    both = _next(s).join(s.toDF("a", "x"), "a").join(s.toDF("b", "y"), "b")
    return both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("n"))


@_query
def weighted_dot(spark, sf_dir):
    s, _, w = _talk(spark, sf_dir)
    return signatures.weighted_jaccard(_next(s), _long(s), w).select("a", "b", "wdot")


@_query
def containment_match(spark, sf_dir):
    s, book, w = _talk(spark, sf_dir)
    return codebook.scores(_long(s), book, w).select("id", "atom_id", F.round(F.col("wdot") / F.col("ic"), 9).alias("match"))


@_query
def atom_accumulate(spark, sf_dir):
    s, book, w = _talk(spark, sf_dir)
    return codebook.accumulated(_long(s), codebook.first_round(_long(s), book, w), w)


@_query
def atom_refresh(spark, sf_dir):
    s, book, w = _talk(spark, sf_dir)
    new = learner.refreshed(book, codebook.accumulated(_long(s), codebook.first_round(_long(s), book, w), w), w, 24, 2.0)
    return new.select("atom_id", F.array_join("bits", ",").alias("bits"))


@_query
def codebook_quality(spark, sf_dir):
    s, book, w = _talk(spark, sf_dir)
    q = codebook.quality(_long(s), codebook.first_round(_long(s), book, w), book, w)
    return q.select("atoms", "used", F.round("utilisation", 9).alias("utilisation"), F.round("mean_recall", 9).alias("mean_recall"))


@_query
def recon_average(spark, sf_dir):
    s, d, w = _decoded(spark, sf_dir)
    m = codebook.reconstruction(_long(s), _long(d), w, 150)
    return m.agg(*[F.round(F.avg(F.round(c, 9)), 6).alias(c) for c in m.columns if c != "id"])


@_query
def dense_bits(spark, sf_dir):
    """Turns' bits as 64-bit words, and how many of these are set."""
    s = _long(_talk(spark, sf_dir)[0])
    return signatures.dense(s).select("id", "word", "bits", F.bit_count("bits").alias("n"), F.getbit("bits", F.lit(3)).cast("int").alias("fourth"))


def _factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """r, bit, x: the embeddings as a factor, a direction for each in order of vec_id."""
    e = ranked(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), "vec_id")
    return written(e.select((F.col("rank") - 1).cast("int").alias("r"), F.posexplode("embedding").alias("bit", "x")).withColumn("x", F.col("x").cast("double")), "factor")


@_query
def fd_leverage(spark, sf_dir):
    """Leverage of turns' bits (modulo 64) in the factor."""
    s = _talk(spark, sf_dir)[0].select("id", F.array_distinct(F.transform("bits", lambda b: b % 64)).alias("bits"))
    return matrices.leverage(s, _factor(spark, sf_dir)).select("id", F.round("leverage", 6).alias("leverage"))


@_query
def bit_promiscuity(spark, sf_dir):
    return matrices.promiscuity(_factor(spark, sf_dir)).select("bit", F.round("energy", 6).alias("energy"), F.round("promiscuity", 9).alias("promiscuity"))


@_query
def hub_bits(spark, sf_dir):
    return matrices.hubs(_factor(spark, sf_dir), 0.25)


@_query
def bit_correlation(spark, sf_dir):
    """Of all pairs of the factor's columns."""
    cells = _factor(spark, sf_dir)
    bits = cells.select(F.col("bit").alias("i")).distinct()
    return matrices.correlation(cells, bits.join(bits.toDF("j"), F.col("i") <= F.col("j"))).select("i", "j", (F.round("x", 5) + 0.0).alias("x"))  # pairs of columns are the result


def _spoken(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    """(signatures of all words of conversations: id, seq, bits; weights; number of bits), in terms of the dictionary of one round over the conversations."""
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet").select((F.col("conv_id") * 4096 + F.col("turn")).cast("long").alias("doc_id"), "text")
    both = written(tok.frequencies(talk), "frequencies")
    words, delims = (both.where(F.col("type") == k).select("value", "n") for k in "WD")
    parts = dictionary.train(words, delims, 1)
    s = signatures.encoded_texts(talk, parts).select(F.col("doc_id").alias("seq"), (F.col("doc_id") * 65536 + F.col("idx")).alias("id"), "bits")
    return written(s, "spoken"), _weights(talk, parts), 3 * parts.count()


@_query
def train_codebook_3f(spark, sf_dir):
    """A codebook of the signatures of all words of conversations, from a sketch of them all, with the words' own band emphasised."""
    s, w, dim = _spoken(spark, sf_dir)
    return learner.learn(s, w, learner.Settings(atoms=64, batch=16_384, boost=20.0, strip=0.01), dim)


@_query
def recon_metrics_3f(spark, sf_dir):
    """How well a codebook that is learnt so gives back the signatures, on average: by band and in all."""
    s, w, dim = _spoken(spark, sf_dir)
    book = written(learner.learn(s, w, learner.Settings(atoms=64, batch=16_384, boost=20.0), dim), "book")
    fired = written(codebook.pursuit(s.select("id", "bits"), book, learner.boosted(w, dim, 20.0)), "fired")
    m = codebook.reconstruction(_long(s), _long(codebook.decoded(fired.where("size(atoms) > 0"), book)), w, dim // 3)
    return m.agg(*[F.round(F.avg(c), 6).alias(c) for c in m.columns if c != "id"]).crossJoin(learner.utilisation(fired, book))  # a row each


@_query
def train_codebook(spark, sf_dir):
    """A codebook learnt from conversation turns."""
    s, _, w = _talk(spark, sf_dir)
    ordered = s.select("id", F.floor(F.col("id") / 1000).alias("seq"), "bits")  # by conversation
    return learner.learn(ordered, w, learner.Settings(atoms=32, width=24))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_found)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in _found}
