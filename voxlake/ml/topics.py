"""Topic classifiers. A classifier is anything that maps texts to label probabilities; the default is linear over hashed TF-IDF."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, SQLTransformer, StringIndexer, VectorAssembler, Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.storage import written

FEATURES = 1 << 12
#: Rows of the word vectors, which words share by hash: the driver holds so many, however many words there are.
VECTORS = 1 << 14
#: Texts from which one task learns word vectors: larger tables make more tasks, whose vectors are averaged.
LEARNED = 1 << 16
#: Texts and phrases of a pack, and pairs of postings that are added up at a time (see nearest_phrases).
PACK, SCRIPTS, MET = 512, 1024, 1 << 20


def held_out(*key: str) -> Column:
    """A fifth of the rows by a hash of their key: they teach nothing, and what is said of a model's worth is said of them."""
    return F.pmod(F.xxhash64(*key), F.lit(5)) == 0


def features(text: str, out: str = "features", embedding: int = 0, more: tuple[str, ...] = (), tasks: int = 1) -> list:
    """Hashed TF-IDF of a text; with embedding also the mean of its words' vectors, of that many numbers, learned by that many tasks, and the columns of more."""
    words = RegexTokenizer(inputCol=text, outputCol="__w", pattern=r"[^\p{L}\p{N}]+")
    tf_idf = [HashingTF(inputCol="__w", outputCol="__tf", numFeatures=FEATURES), IDF(inputCol="__tf", outputCol="__ti" if embedding or more else out, minDocFreq=2)]
    if not embedding and not more:
        return [words, *tf_idf]
    hashed = SQLTransformer(statement=f"SELECT *, transform(__w, w -> cast(pmod(xxhash64(w), {VECTORS}) AS string)) AS __h FROM __THIS__")
    vectors = [hashed, Word2Vec(inputCol="__h", outputCol="__e", vectorSize=embedding, minCount=2, seed=1, numPartitions=tasks)] if embedding else []
    return [words, *tf_idf, *vectors, VectorAssembler(inputCols=["__ti", *(["__e"] if embedding else []), *more], outputCol=out)]


def fit(rows: DataFrame, *, text: str = "text", label: str = "label", kind: str = "bayes", balanced: bool = False, embedding: int = 0, more: tuple[str, ...] = (), settings: dict | None = None) -> PipelineModel:
    """Learns label from text; balanced weights classes inversely to their frequency; embedding and more add features (see features). Rows are read in several passes."""
    if balanced:
        n = rows.groupBy(label).agg(F.count("*").alias("__n"))
        t = n.agg(F.sum("__n").alias("__t"), F.count("*").alias("__k"))
        rows = rows.join(n.crossJoin(F.broadcast(t)).select(label, (F.col("__t") / (F.col("__k") * F.col("__n"))).alias("weight")), label)
    how = ({"weightCol": "weight"} if balanced else {}) | (settings or {})
    model = {"bayes": lambda: NaiveBayes(labelCol="__y", **how), "logistic": lambda: LogisticRegression(labelCol="__y", **({"maxIter": 20, "regParam": 0.01} | how)), "forest": lambda: RandomForestClassifier(labelCol="__y", numTrees=20, seed=1, **how)}[kind]()
    tasks = max(1, -(-rows.count() // LEARNED)) if embedding else 1
    return Pipeline(stages=[StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc", handleInvalid="keep"), *features(text, embedding=embedding, more=more, tasks=tasks), model]).fit(rows)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Adds predicted and confidence."""
    labels = F.array(*map(F.lit, model.stages[0].labels))
    out = model.transform(rows)
    p = vector_to_array("probability")
    return out.select(*rows.columns, F.try_element_at(labels, F.col("prediction").cast("int") + 1).alias("predicted"), F.array_max(p).alias("confidence"), p.alias("probabilities"))


def macro_f1(said: DataFrame, *, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """One row: the mean over labels of 2 * hits / (rows with the label + rows said to have it)."""
    hit = (F.col(label) == F.col(predicted)).cast("long")
    both = said.select(F.explode(F.array(F.struct(F.col(label).alias("y"), hit.alias("hit")), F.struct(F.col(predicted).alias("y"), F.lit(0).cast("long").alias("hit")))).alias("t"))
    return both.groupBy("t.y").agg((2 * F.sum("t.hit") / F.count("*")).alias("f1")).agg(F.avg("f1").alias("macro_f1"))


def search(rows: DataFrame, *, key: str, reg: tuple[float, ...] = (0.001, 0.01, 0.1), elastic: tuple[float, ...] = (0.0, 0.5)) -> list[tuple[float, float, float]]:
    """(reg, elastic, macro F1 on the rows held out) for every setting of a logistic model."""
    learn, judge = (rows.where(c).persist() for c in (~held_out(key), held_out(key)))
    try:
        return [(r, e, macro_f1(predict(fit(learn, kind="logistic", settings={"regParam": r, "elasticNetParam": e}), judge)).first().macro_f1) for r in reg for e in elastic]
    finally:
        learn.unpersist()
        judge.unpersist()


def terms(text: str) -> Column:
    """A text's words, and its pairs of neighbours."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.concat(words, F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b)))


def term_counts(texts: DataFrame, key: str) -> DataFrame:
    """key, term, tf. Texts go by key before their terms are listed, so that counting moves no terms."""
    return texts.select(key, "text").repartition(key).select(key, F.explode(terms("text")).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def term_weights(counts: DataFrame, texts: DataFrame, least: int = 2) -> DataFrame:
    """term, idf over all texts: log((n + 1) / (texts with the term + 1)), for terms of at least that many texts. counts: a row for each term of a text."""
    df = counts.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= least)
    return df.crossJoin(F.broadcast(texts.agg(F.count("*").alias("n")))).select("term", F.ln((F.col("n") + 1) / (F.col("df") + 1)).alias("idf"))


def packed(keys: DataFrame, postings: DataFrame, key: str, most: int) -> DataFrame:
    """Texts in packs of about that many, a row each: keys, and for each posting the place of its text among them, its term's number t and its weight in the text's vector of length 1.

    postings: key, t (null: a term that only lengthens the vector), x. A key without postings is in a pack too.
    """
    packs = max(1, -(-keys.count() // most))
    every = keys.select(key, F.lit(None).cast("long").alias("t"), F.lit(0.0).alias("x")).unionByName(postings.select(key, "t", "x"))
    kind = keys.schema[key].dataType.simpleString()

    def pack(rows: pa.Table) -> pa.Table:
        coded = rows.column(key).combine_chunks().dictionary_encode(null_encoding="encode")
        at, x = coded.indices.to_numpy(zero_copy_only=False), rows.column("x").to_numpy()
        length = np.sqrt(np.bincount(at, x * x, len(coded.dictionary)))
        own = rows.column("t").is_valid().to_numpy() & (x > 0)
        at, x = at[own], x[own]
        lists = [coded.dictionary, pa.array(at, pa.int32()), rows.column("t").filter(pa.array(own)).combine_chunks(), pa.array(x / length[at])]
        return pa.table({name: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for name, v in zip(("keys", "at", "t", "w"), lists, strict=True)})

    return every.groupBy(F.pmod(F.xxhash64(key), F.lit(packs)).alias("pack")).applyInArrow(pack, f"keys array<{kind}>, at array<int>, t array<long>, w array<double>")


def nearest_in(n: int, at: np.ndarray, t: np.ndarray, w: np.ndarray, index: tuple[np.ndarray, ...], phrases: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n texts the k nearest of a pack's phrases, the first of equals first, and their distances to nine decimals: texts x k each. index: see inverted."""
    known, begin, phrase, weight = index
    place = np.searchsorted(known, t)
    have = place < len(known)
    have[have] = known[place[have]] == t[have]
    at, place, w = at[have], place[have], w[have]
    many = begin[place + 1] - begin[place]
    dot = np.zeros(n * phrases)
    cuts = np.searchsorted(np.cumsum(many), np.arange(MET, int(many.sum()) + MET, MET)) + 1
    for lo, hi in zip([0, *cuts], cuts, strict=False):
        own = many[lo:hi]
        met = np.arange(int(own.sum())) + np.repeat(begin[place[lo:hi]] - (np.cumsum(own) - own), own)
        np.add.at(dot, np.repeat(at[lo:hi].astype(np.int64), own) * phrases + phrase[met], np.repeat(w[lo:hi], own) * weight[met])
    far = np.floor(np.sqrt(np.maximum(2 - 2 * dot.reshape(n, phrases), 0)) * 1e9 + 0.5).astype(np.int64)
    first = far * phrases + np.arange(phrases)
    k = min(k, phrases)
    first = np.sort(np.partition(first, k - 1, axis=1)[:, :k], axis=1)
    return first % phrases, first // phrases / 1e9


def inverted(at: np.ndarray, t: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
    """The numbers of the terms that a pack's phrases have, in order; where each one's postings begin, and where the last end; their phrases and weights."""
    order = np.lexsort((at, t))
    known, begin = np.unique(t[order], return_index=True)
    return known, np.append(begin, len(t)), at[order], w[order]


def nearest_phrases(rows: DataFrame, phrases: DataFrame, *, key: str, k: int = 3) -> DataFrame:
    """For each row the k nearest phrases by distance of normalised TF-IDF (of equals the smaller phrase_id): key, topic (of the nearest), confidence = 1 / (mean distance + 1e-5).

    Every row against every phrase, as packs of texts that meet packs of phrases: an inverted index of a pack's phrases gets the terms of a pack's texts, adds up only what
    has a term in common, and returns k phrases for each text. So no pair of a text and a phrase, nor of postings, is ever a row; terms move once to their weights and once
    to their text's pack. Phrases are the query set: work grows with the common terms of texts and phrases. Runs jobs before it returns: counts and packs are written.
    """
    mine, theirs = written(term_counts(rows, key)), written(term_counts(phrases, "phrase_id"))
    idf = term_weights(mine.select("term").unionByName(theirs.select("term")), rows.select("text").unionByName(phrases.select("text")))
    numbers = written(theirs.select("term").distinct().select("term", F.monotonically_increasing_id().alias("t")))
    weights = written(idf.join(numbers, "term", "left"))
    weigh = lambda n: n.join(weights, "term").withColumn("x", F.col("tf") * F.col("idf")).where("x > 0")
    texts = written(packed(rows.select(key).distinct(), weigh(mine), key, PACK))
    scripts = written(packed(phrases.select("phrase_id").distinct(), weigh(theirs), "phrase_id", SCRIPTS))
    kinds = [rows.schema[key].dataType.simpleString(), phrases.schema["phrase_id"].dataType.simpleString()]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                keys, at, t, w, ids, at2, t2, w2 = (batch.column(c)[row].values for c in ("keys", "at", "t", "w", "ids", "at2", "t2", "w2"))
                order = pc.array_sort_indices(ids)
                rank = np.argsort(order.to_numpy())
                phrase, far = nearest_in(len(keys), *(np.array(x) for x in (at, t, w)), inverted(rank[np.array(at2)], np.array(t2), np.array(w2)), len(ids), k)
                whose = np.repeat(np.arange(len(keys)), phrase.shape[1])
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(whose)), ids.take(order.take(pa.array(phrase.ravel()))), pa.array(far.ravel())], names=["key", "phrase_id", "d"])

    second = scripts.select(F.col("keys").alias("ids"), F.col("at").alias("at2"), F.col("t").alias("t2"), F.col("w").alias("w2"))
    near = texts.crossJoin(second).mapInArrow(meet, f"key {kinds[0]}, phrase_id {kinds[1]}, d double")
    first = near.groupBy(F.col("key").alias(key)).agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "phrase_id"))), 1, k).alias("n"))
    mean = F.aggregate("n", F.lit(0.0), lambda t, x: t + x["d"]) / F.size("n")
    named = first.select(key, F.col("n")[0]["phrase_id"].alias("phrase_id"), (1 / (mean + 1e-5)).alias("confidence"))
    return named.join(phrases.select("phrase_id", "topic"), "phrase_id").select(key, "topic", "confidence")


def mixture(rows: DataFrame, columns: list[str], *, k: int = 2, seed: int = 1) -> DataFrame:
    """Adds component: Gaussian mixture over the columns."""
    x = VectorAssembler(inputCols=columns, outputCol="features").transform(rows)
    return GaussianMixture(k=k, seed=seed, maxIter=20).fit(x).transform(x).select(*rows.columns, F.col("prediction").alias("component"))


def label_distances(text: str, labels: list[str]) -> dict[str, Column]:
    """Columns of the edit distance of a text from each label's name, as a share of the longer."""
    far = lambda name: F.levenshtein(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(name.lower())) / F.greatest(F.length(F.coalesce(F.col(text), F.lit(""))), F.lit(max(1, len(name))))
    return {f"__d{k}": far(name) for k, name in enumerate(labels)}
