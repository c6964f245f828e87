"""Toxicity by a classifier chain.

Categories are predicted in order; each model is linear in the words of a text (weighted by their
log-count ratio in the training sample) and, from the second on, in the earlier categories'
probabilities. While training, those earlier outputs come from models that did not see the document
(out of fold), so a later model learns how far to trust them. Training runs on a bounded sample
of labelled documents; scoring runs over all texts in tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, prepare, register, table

TRAIN_DOCS = 6000       # labelled documents fitted, the bound of the sample
FOLDS = 3
STEP = 250              # texts scored at a time, which bounds a worker's memory
MIN_DOCS = 4            # documents of the sample that a word must occur in
# category -> condition on the label columns that makes a document an instance
CHAIN = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))
_WORDS = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    """Distinct lower-case words (runs of letters)."""
    return set(_WORDS.findall((text or "").lower()))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("_t")
        bags = [sorted(words(texts[i].as_py())) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "_t"),
                                          pa.array(bags, pa.list_(pa.string()))],
                                         [*(c for c in batch.schema.names if c != "_t"), "_w"])


class Linear:
    """Logistic regression on weighted word presence and a few dense features."""

    def __init__(self, ratio: np.ndarray, coef: np.ndarray, dense: np.ndarray, bias: float):
        self.word = ratio * coef
        self.dense, self.bias = dense, bias

    def logit(self, rows: np.ndarray, cols: np.ndarray, n: int, extra: np.ndarray) -> np.ndarray:
        z = np.bincount(rows, self.word[cols], minlength=n) if len(cols) else np.zeros(n)
        return z + extra @ self.dense + self.bias


def fit(rows, cols, n_docs: int, n_words: int, y: np.ndarray, extra: np.ndarray, steps: int = 150,
        l2: float = 1e-3) -> Linear:
    """Fit by full-batch Adam; words carry their smoothed log-count ratio between the classes."""
    pos = np.bincount(cols, y[rows], minlength=n_words) + 0.25
    neg = np.bincount(cols, 1 - y[rows], minlength=n_words) + 0.25
    ratio = np.log(pos / (y.sum() + 0.5)) - np.log(neg / ((1 - y).sum() + 0.5))
    value = ratio[cols]
    theta = np.zeros(n_words + extra.shape[1] + 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))    # classes count alike
    for t in range(1, steps + 1):
        z = np.bincount(rows, value * theta[cols], minlength=n_docs).astype(float)    # whole numbers if empty
        z += extra @ theta[n_words:-1] + theta[-1]
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        g = np.concatenate((np.bincount(cols, value * err[rows], minlength=n_words), extra.T @ err, [err.sum()]))
        g[:-1] += l2 * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return Linear(ratio, theta[:n_words], theta[n_words:-1], float(theta[-1]))


def _probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def best_threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The log-odds cut with the best F1 on out-of-fold outputs, in the middle of its gap between distinct outputs."""
    order = np.argsort(-z, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(z) + 1) + max(y.sum(), 1))
    f1[:-1][z[order[1:]] == z[order[:-1]]] = -1     # equal outputs stay on one side
    k = int(np.argmax(f1))
    low = z[order[k + 1]] if k + 1 < len(z) else z[order[k]] - 1
    return float((z[order[k]] + low) / 2)


class Chain:
    """The fitted chain: a vocabulary, one linear model and one log-odds threshold a category."""

    def __init__(self, texts: list[str] | pa.ListArray, labels: np.ndarray, names: list[str]):
        """``texts``: the sample, as texts or as bags of distinct words."""
        self.names = names
        bags = texts if isinstance(texts, pa.Array) else pa.array([sorted(words(t)) for t in texts], pa.list_(pa.string()))
        n = len(bags)
        coded = bags.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        known = np.flatnonzero(np.bincount(code, minlength=len(coded.dictionary)) >= MIN_DOCS)
        found = sorted(zip(coded.dictionary.take(pa.array(known)).to_pylist(), known.tolist()))
        self.vocab = {w: i for i, (w, _) in enumerate(found)}
        column = np.full(len(coded.dictionary), -1, np.int64)
        column[[k for _, k in found]] = np.arange(len(found))
        rows = np.repeat(np.arange(n), bags.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        cols = column[code]
        rows, cols = rows[cols >= 0], cols[cols >= 0]
        self.models: list[Linear | None] = []
        self.cuts: list[float] = []
        extra = np.zeros((n, 0))
        fold = np.arange(n) % FOLDS
        for k in range(labels.shape[1]):
            y = labels[:, k].astype(float)
            if n == 0 or y.min() == y.max():     # nothing to learn: the category never fires
                self.models.append(None)
                self.cuts.append(0.0)
                extra = np.column_stack((extra, np.zeros(n)))
                continue
            out = np.zeros(n)
            for f in range(FOLDS):
                own = fold[rows] != f
                train = fold != f
                index = np.cumsum(train) - 1
                if y[train].min() == y[train].max():
                    continue
                model = fit(index[rows[own]], cols[own], int(train.sum()), len(self.vocab), y[train], extra[train])
                held = ~own
                z = model.logit(rows[held], cols[held], n, extra)
                out[fold == f] = z[fold == f]
            self.models.append(fit(rows, cols, n, len(self.vocab), y, extra))
            self.cuts.append(best_threshold(out, y))
            extra = np.column_stack((extra, _probability(out)))

    def _matrix(self, bags) -> tuple[np.ndarray, np.ndarray]:
        get = self.vocab.get
        rows, cols = [], []
        for i, bag in enumerate(bags):
            found = [c for c in map(get, bag) if c is not None]
            cols.extend(found)
            rows.extend([i] * len(found))
        return np.array(rows, np.int64), np.array(cols, np.int64)

    def score(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(probabilities, decisions) of each category for the texts."""
        parts = [self._score(texts[lo:lo + STEP]) for lo in range(0, len(texts), STEP)]
        k = len(self.models)
        return ([np.concatenate([p[0][i] for p in parts] or [np.zeros(0)]) for i in range(k)],
                [np.concatenate([p[1][i] for p in parts] or [np.zeros(0, bool)]) for i in range(k)])

    def _score(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        n = len(texts)
        keys = self.vocab.keys()
        rows, cols = self._matrix(sorted(words(t) & keys) for t in texts)
        extra, probs, hits = np.zeros((n, 0)), [], []
        for model, cut in zip(self.models, self.cuts):
            z = None if model is None else model.logit(rows, cols, n, extra)
            probs.append(np.zeros(n) if z is None else _probability(z))
            hits.append(np.zeros(n, bool) if z is None else z > cut)
            extra = np.column_stack((extra, probs[-1]))
        return probs, hits


def train(docs: DataFrame, labels: DataFrame, chain=CHAIN, max_docs: int = TRAIN_DOCS) -> Chain:
    """Fit the chain on at most ``max_docs`` labelled documents, chosen by a hash of their id.

    Labels whose condition is null count as not an instance; a document with several label rows
    or several rows enters once. With no labelled document no category ever fires.
    """
    prepare(docs.sparkSession)
    marks = [F.coalesce(F.expr(cond), F.lit(False)).cast("int").alias(f"_y{i}") for i, (_, cond) in enumerate(chain)]
    lab = labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("_id"), *marks)
    lab = lab.groupBy("_id").agg(*[F.max(f"_y{i}").alias(f"_y{i}") for i in range(len(chain))])
    lab = lab.withColumn("_h", F.xxhash64(F.lit(3), "_id")).orderBy("_h", "_id").limit(max_docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("_t"))
    # the sample's ids are bounded by max_docs
    marks = [f"_y{i}" for i in range(len(chain))]
    sample = texts.join(F.broadcast(lab), "_id").groupBy("_h", "_id", *marks).agg(F.min("_t").alias("_t"))
    # words are taken and counted in tasks: the driver gets those that the fit uses, each in MIN_DOCS documents at least
    keys = ["_h", "_id", *marks]
    bags = materialize(sample.mapInArrow(
        _bags, "_h long, _id long, " + ", ".join(f"{m} int" for m in marks) + ", _w array<string>"), "toxicity-words")
    each = bags.select(*keys, F.explode_outer("_w").alias("_v"))
    used = each.groupBy("_v").agg(F.count(F.lit(1)).alias("_c")).where(f"_v is not null and _c >= {MIN_DOCS}").select(
        F.col("_v").alias("_u"))
    got = each.join(used, F.col("_v") == F.col("_u"), "left").groupBy(*keys).agg(F.sort_array(F.collect_list("_u")).alias("_w"))
    got = got.toArrow().sort_by([("_h", "ascending"), ("_id", "ascending")])
    y = np.column_stack([got[m].to_numpy() for m in marks])
    return Chain(got["_w"].combine_chunks(), y, [name for name, _ in chain])


def classify(docs: DataFrame, model: Chain) -> DataFrame:
    """Add, for each category, its probability (``<name>_prob``) and its decision (``<name>``) to ``docs``;
    columns of those names are replaced.

    Defined cases: null and empty texts are scored as texts without words; repeated rows get equal
    results; an empty table gives no rows; all other columns pass through.
    """
    spark = docs.sparkSession
    prepare(spark)
    made = [c for name in model.names for c in (f"{name}_prob", name)]
    keep = [c for c in docs.columns if c not in made]
    shared = spark.sparkContext.broadcast(model)       # bounded by the sample's vocabulary
    kinds = "struct<" + ", ".join(f"p{i}: double, h{i}: boolean" for i in range(len(model.names))) + ">"

    @F.pandas_udf(kinds)
    def score(texts):
        import pandas as pd
        probs, hits = shared.value.score(texts.tolist())
        return pd.DataFrame({k: v for i in range(len(probs)) for k, v in ((f"p{i}", probs[i]), (f"h{i}", hits[i]))})

    out = docs.select(*[F.col(c) for c in keep], score(F.coalesce("text", F.lit(""))).alias("_q_s"))
    return out.select(*keep, *[F.col(f"_q_s.{k}{i}").alias(c) for i, name in enumerate(model.names)
                               for k, c in (("p", f"{name}_prob"), ("h", name))])


@register("op7_toxicity_chain")
def op7_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the chain fitted on its labelled sample."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return classify(docs.select("doc_id", "text"), model).drop("text")
