"""Batched encoders: a model function over Arrow batches, and models that need no download."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer, Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.sources.scratch import Scratch

Model = Callable[[list], np.ndarray]

#: Words of letters, digits and underscores of any script, as TF-IDF counts them.
WORD = r"(?U)\w+"
#: Words that every task holds with their counts.
SENT = 1 << 18


def encode(df: DataFrame, load_model: Callable[[], Model], input_col: str, output_col: str = "embedding", batch_size: int = 32, keep_empty: bool = False) -> DataFrame:
    """df with output_col, the model's vector for input_col.

    load_model runs once in each Python worker's task and gives a function from a list of at most batch_size inputs to
    one row of numbers each. Rows whose input is null, or empty unless keep_empty, get null and never reach the model.
    """

    @F.pandas_udf("array<float>")
    def run(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for values in column:
            inputs = _inputs(values)
            out = np.empty(len(inputs), object)
            rows = [i for i, v in enumerate(inputs) if v is not None and (keep_empty or len(v))]
            for a in range(0, len(rows), batch_size):
                part = rows[a : a + batch_size]
                vectors = np.asarray(model([inputs[i] for i in part]), np.float32)
                if len(vectors) != len(part):
                    raise ValueError(f"the model gave {len(vectors)} vectors for {len(part)} inputs")
                for i, v in zip(part, vectors, strict=True):
                    out[i] = v
            yield pd.Series(out)

    return df.withColumn(output_col, run(F.col(input_col)))


def _inputs(values: pd.Series | pd.DataFrame) -> list:
    """The inputs of a batch; a struct comes as a frame and goes as a dict, and one whose fields are all null as None."""
    if isinstance(values, pd.DataFrame):
        return [None if all(v is None for v in row.values()) else row for row in values.astype(object).where(values.notna(), None).to_dict("records")]
    return [None if v is None or (isinstance(v, float) and np.isnan(v)) else v for v in values]


#: Marks around words, which no text has, and the odd numbers of the hash.
_OPEN, _CLOSE = "\x01", "\x02"
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _ODD[1]
    h = (h ^ (h >> np.uint64(27))) * _ODD[2]
    return h ^ (h >> np.uint64(31))


def hash_projection(dims: int = 64, seed: int = 0) -> Callable[[], Model]:
    """A text model: signed hashes of words and of their byte trigrams, summed and scaled to length 1.

    A word counts as itself and, between marks, by every three bytes in a row. All texts of a batch are hashed at once.
    """

    def load() -> Model:
        def model(texts: list) -> np.ndarray:
            marked = ["".join(f"{_OPEN}{w}{_CLOSE}" for w in t.lower().split()).encode() for t in texts]
            flat = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
            owner = np.repeat(np.arange(len(texts)), [len(m) for m in marked])
            if not len(flat):
                return np.zeros((len(texts), dims), np.float32)
            start = np.uint64(seed) * _ODD[0]
            # trigrams lie within a word's marks
            a, b, c = flat[:-2], flat[1:-1], flat[2:]
            at = np.flatnonzero((a != ord(_CLOSE)) & (b != ord(_CLOSE)))
            grams = _spread((a | b << np.uint64(8) | c << np.uint64(16))[at] + start + np.uint64(1 << 32))
            # words: their bytes folded by powers, from the mark that opens each
            opens, closes = np.flatnonzero(flat == ord(_OPEN)), np.flatnonzero(flat == ord(_CLOSE))
            within = np.arange(len(flat)) - np.repeat(opens, closes - opens + 1)
            powers = np.cumprod(np.full(int(within.max()) + 1, _ODD[0]))
            words = _spread(np.add.reduceat(flat * powers[within], opens) + start)
            h, own = np.concatenate([grams, words]), np.concatenate([owner[at], owner[opens]])
            slot = own * dims + (h % np.uint64(dims)).astype(np.int64)
            sign = np.where(h >> np.uint64(63), 1.0, -1.0)
            out = np.bincount(slot, sign, len(texts) * dims).reshape(len(texts), dims)
            return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

        return model

    return load


def pooled_grid(dims: int = 64, how: str = "mean", seed: int = 0) -> Callable[[], Model]:
    """A model for n-dimensional arrays given as (shape, data): pooled over all axes but the last and projected to dims."""
    fold = {"mean": np.mean, "max": np.max, "min": np.min}
    if how not in fold:
        raise NotImplementedError(f"pooling {how!r}")

    def load() -> Model:
        def model(blobs: list) -> np.ndarray:
            out = []
            for b in blobs:
                x = np.asarray(b["data"], np.float32).reshape(tuple(b["shape"]))
                v = fold[how](x.reshape(-1, x.shape[-1]), axis=0)
                lines = np.random.default_rng(seed).standard_normal((len(v), dims)).astype(np.float32)
                out.append(v @ lines)
            return np.stack(out)

        return model

    return load


def fit_tfidf(docs: DataFrame, text_col: str = "text", features: int = 1 << 17) -> PipelineModel:
    """Term counts in hashed slots by inverse document frequency, at length 1; fitted over all rows with a text."""
    rows = docs.where(F.char_length(text_col) > 0)
    return Pipeline(stages=[RegexTokenizer(inputCol=text_col, outputCol="_words", pattern=WORD, gaps=False), HashingTF(inputCol="_words", outputCol="_counts", numFeatures=features), IDF(inputCol="_counts", outputCol="_weights"), Normalizer(inputCol="_weights", outputCol="embedding")]).fit(rows)


def tfidf(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows with a text and their embedding over the exact vocabulary: (word, weight) by word, at length 1.

    Weights are those of fit_tfidf() without its slots: a word's count times log((rows + 1) / (rows with it + 1)).

    The vocabulary is counted first, a word once for each row. Words that most rows have, SENT of them at most, go to all tasks with
    their counts. All others are looked up by joins: (hash of the text, word) goes to the word's count, and the counts
    come back to the rows with that hash. Texts that share a hash get each other's counts too, which changes nothing.
    """
    key, rare = "_key", "_rare"
    while {key, rare} & set(docs.columns):
        key, rare = f"_{key}", f"_{rare}"
    scratch = Scratch(docs.sparkSession)
    rows = docs.where(F.char_length(text_col) > 0)
    words = F.regexp_extract_all(F.lower(text_col), F.lit(WORD), F.lit(0))
    own = F.array_distinct(words)
    vocabulary = scratch.keep(rows.select(F.explode(own).alias("word")).groupBy("word").agg(F.count("*").alias("having")))
    level = F.floor(8 * F.log2("having"))
    least, sent = None, 0
    for at, n in sorted(((r["level"], r["count"]) for r in vocabulary.groupBy(level.alias("level")).count().collect()), reverse=True):  # a few hundred levels
        if sent + n > SENT:
            break
        least, sent = at, sent + n
    common = vocabulary.where(F.lit(False) if least is None else level >= least)
    weighed = _weighed(common.toArrow(), rows.count())
    others = vocabulary if least is None else vocabulary.where(level < least)
    none = F.array().cast("array<struct<word:string,having:bigint>>")
    if others.isEmpty():
        return rows.withColumn("embedding", weighed(words, none))
    asked = rows.select(F.xxhash64(text_col).alias(key), own.alias("words")).select(key, F.explode("words").alias("word"))
    asked = asked.join(F.broadcast(common.select("word")), "word", "left_anti")
    # texts of one hash ask once; joined by word they are where their words are, so that takes no shuffle
    counted = asked.join(others, "word").groupBy("word", key).agg(F.first("having").alias("having"))
    counted = counted.groupBy(key).agg(F.collect_list(F.struct("word", "having")).alias(rare))
    joined = rows.withColumn(key, F.xxhash64(text_col)).join(counted, key, "left")
    return joined.withColumn("embedding", weighed(words, F.coalesce(rare, none))).drop(key, rare)


def _weighed(common: pa.Table, rows: int):
    """A function of columns: the words of each row, in order and as often as they are there, and (word, having) of those that `common` lacks, to (word, weight) by word at length 1."""
    known, having = common.column("word").combine_chunks(), common.column("having").to_numpy()

    @F.arrow_udf("array<struct<word:string,weight:double>>")
    def run(words: pa.Array, rare: pa.Array) -> pa.Array:
        owner = np.repeat(np.arange(len(words)), words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        coded = words.flatten().dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        found = coded.dictionary.take(pa.array(order))
        # counts of the words of this batch, wherever they come from
        more = rare.flatten()
        at = pc.index_in(found, value_set=known).fill_null(-1).to_numpy()
        counts = np.where(at >= 0, np.append(having, 0)[at], 0)
        lacking = np.flatnonzero(at < 0)
        if len(lacking):
            there = pc.index_in(found.take(pa.array(lacking)), value_set=more.field("word"))
            if there.null_count:
                raise ValueError("a word has no count: the rows changed while they were read")
            counts[lacking] = more.field("having").to_numpy()[there.to_numpy()]
        terms, n = np.unique(owner * len(order) + place[coded.indices.to_numpy()], return_counts=True)
        owner, word = np.divmod(terms, max(1, len(order)))
        weight = n * np.log((rows + 1) / (counts[word] + 1))
        size = np.sqrt(np.bincount(owner, weight**2, len(words)))[owner]
        weight = np.divide(weight, size, out=np.zeros(len(weight)), where=size > 0)
        edges = np.append(0, np.cumsum(np.bincount(owner, minlength=len(words))))
        return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays([found.take(pa.array(word)), pa.array(weight)], ["word", "weight"]))

    return run


def fit_word_vectors(docs: DataFrame, text_col: str = "text", dims: int = 96, seed: int = 0, least: int = 2) -> PipelineModel:
    """Skip-gram word vectors and the mean over a document's words."""
    rows = docs.where(F.char_length(text_col) > 0)
    return Pipeline(stages=[RegexTokenizer(inputCol=text_col, outputCol="_words", pattern=r"\w+", gaps=False), Word2Vec(inputCol="_words", outputCol="embedding", vectorSize=dims, seed=seed, minCount=least)]).fit(rows)


def encode_with(model: PipelineModel, docs: DataFrame, text_col: str = "text", dense: bool = False) -> DataFrame:
    """Rows with a text and their embedding: a vector, sparse where the model's is, or an array if dense."""
    out = model.transform(docs.where(F.char_length(text_col) > 0)).drop("_words", "_counts", "_weights")
    return out.withColumn("embedding", vector_to_array("embedding")) if dense else out


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
