"""Toxicity by multiple-instance learning: only documents are labelled, the model judges sentences.

A sentence has the probability p = sigmoid(bias + weights of its words), a document 1 - prod(1 - p) over its sentences
(noisy-or: one bad sentence suffices). The likelihood of the document labels is maximised over bias and weights, so the
model finds by itself which sentences made a document toxic, and can name them. A word's features are itself and its
first 4 and 5 letters, which meet the many endings of one stem.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeledger.llm.shared import importable, in_blocks, with_columns_of

#: Bound of the labelled sample that is fitted: documents, taken by a hash of doc_id, and the sample's characters.
TRAIN_DOCS = 5000
TRAIN_CHARS = 30_000_000
REJECT = 0.3
STEPS = 400

_SENTENCE = re.compile(r"[.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[str]:
    out = [word]
    if len(word) >= 4:
        out.append(word[:4] + "*")
    if len(word) >= 5:
        out.append(word[:5] + "*")
    return out


def sentences(text: str | None) -> list[str]:
    """The sentences of a text, lower-case, without those that have nothing but white space."""
    return [s for s in _SENTENCE.split((text or "").lower()) if s and not s.isspace()]


def fit(samples: list[tuple[str | None, int]], *, least_docs: int = 4, least_z: float = 5.5, l2: float = 0.1, steps: int = STEPS) -> tuple[float, dict[str, float]]:
    """Bias and feature weights from (text, label) rows.

    Features are screened on the labels of the same rows: in least_docs documents or more, and more frequent in toxic ones
    by a z-score of least_z or more. Without rows of both classes every score is the share of toxic rows
    of one sentence.
    """
    y = np.array([label for _, label in samples], float)
    n1 = y.sum()
    if not len(y) or n1 in (0, len(y)):
        p = min(max(float(n1 / len(y)) if len(y) else 0.0, 1e-6), 1 - 1e-6)
        return float(np.log(p / (1 - p))), {}
    seen = [Counter(), Counter()]
    for text, label in samples:
        words = set(_WORD.findall((text or "").lower()))
        seen[int(label)].update(words)
        seen[int(label)].update({w[:4] + "*" for w in words if len(w) >= 4})
        seen[int(label)].update({w[:5] + "*" for w in words if len(w) >= 5})
    n0 = len(y) - n1
    keep = {}
    for f, a in sorted(seen[1].items()):
        b = seen[0][f]
        if a + b >= least_docs:
            p = (a + b) / (n0 + n1)
            if (a / n1 - b / n0) / max(np.sqrt(p * (1 - p) * (1 / n0 + 1 / n1)), 1e-12) >= least_z:
                keep[f] = len(keep)
    by_word: dict[str, list[int]] = {}
    idx, size, owner = [], [], []
    for d, (text, _) in enumerate(samples):
        plain = 0
        for s in sentences(text):
            own = []
            for w in _WORD.findall(s):
                at = by_word.get(w)
                if at is None:
                    at = by_word[w] = [keep[f] for f in word_features(w) if f in keep]
                own += at
            if own:
                idx.extend(own)
                size.append(len(own))
                owner.append(d)
            else:
                plain += 1
        if plain:  # so many sentences without a feature
            size.append(-plain)
            owner.append(d)
    size, owner, idx = np.array(size, np.int64), np.array(owner, np.int64), np.array(idx, np.int64)
    times = np.where(size < 0, -size, 1).astype(float)
    size = np.maximum(size, 0)
    row = np.repeat(np.arange(len(size)), size)
    theta = np.zeros(len(keep) + 1)
    theta[-1] = -10.0
    m = v = np.zeros_like(theta)
    for t in range(1, steps + 1):
        z = np.bincount(row, theta[idx], len(size)) + theta[-1]
        soft = np.logaddexp(0, z)
        total = np.bincount(owner, times * soft, len(y))
        up = np.where(y > 0, -1 / np.maximum(np.expm1(np.minimum(total, 500)), 1e-12), 1.0)  # of -log likelihood by total
        gz = up[owner] * times / (1 + np.exp(-np.clip(z, -500, 500)))
        g = np.append(np.bincount(idx, gz[row], len(keep)), gz.sum()) / len(y)
        g[:-1] += l2 * theta[:-1] / len(y)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return float(theta[-1]), {f: float(theta[i]) for f, i in keep.items() if abs(theta[i]) > 1e-4}


class Scorer:
    def __init__(self, bias: float, weights: dict[str, float]):
        self.bias, self.weights, self.plain = bias, weights, float(np.logaddexp(0, bias))
        scorer = self

        class Words(dict):
            def __missing__(self, w):
                x = sum(scorer.weights.get(f, 0.0) for f in word_features(w))
                if len(self) < 300_000:
                    self[w] = x
                return x

        self.words = Words()

    def __call__(self, text: str | None) -> tuple[float, int, list[int]]:
        """The document's score, its sentences, and which of those are offending (their own p is REJECT or more)."""
        total, offending, get = 0.0, [], self.words.__getitem__
        own = sentences(text)
        for i, s in enumerate(own):
            x = sum(map(get, _WORD.findall(s)))
            if x:
                soft = float(np.logaddexp(0, self.bias + x))
                total += soft
                if 1 - np.exp(-soft) >= REJECT:
                    offending.append(i)
            else:
                total += self.plain
        return float(-np.expm1(-total)), len(own), offending


def train(docs: DataFrame, labels: DataFrame, *, max_docs: int = TRAIN_DOCS, max_chars: int = TRAIN_CHARS) -> tuple[float, dict[str, float]]:
    """Fit on labelled documents whose crc32(doc_id as text) mod 4 is not 2; nulls and labels other than 0 and 1 are passed over.

    At most max_docs documents, first by a hash of doc_id, and of those, in that order, each that still fits into max_chars characters.
    """
    spark = docs.sparkSession
    own = F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    ids = with_columns_of(labels, "doc_id", "toxic").where(own & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = ids.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(max_docs)
    chosen = spark.createDataFrame(picked.collect(), picked.schema)  # max_docs narrow rows
    rows = with_columns_of(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "h", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))  # of several texts of one id the least
    sizes = sorted((r["h"], r["doc_id"], r["n"]) for r in rows.select("h", "doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n")).collect())
    total, ok = 0, []
    for _, doc_id, n in sizes:
        if total + n <= max_chars:
            total += n
            ok.append((doc_id,))
    if not ok:
        return fit([])
    fits = rows.join(F.broadcast(spark.createDataFrame(ok, "doc_id long")), "doc_id")
    return fit([(r["text"], r["toxic"]) for r in sorted(fits.select("h", "text", "toxic").collect(), key=lambda r: (r["h"], r["text"] or ""))])


_FIELDS = [("score", pa.float64(), "double"), ("n_sentences", pa.int64(), "long"), ("offending", pa.list_(pa.int32()), "array<int>")]


def score(docs: DataFrame, model: tuple[float, dict[str, float]]) -> DataFrame:
    """docs (all columns) with score, n_sentences, offending (numbers of offending sentences) and predicted.

    Null and empty texts have no sentences and the score 0. Repeated rows are scored each. Columns of docs that have the
    name of a result column are replaced.
    """
    from pyspark.sql import types as T

    importable(docs.sparkSession)
    names = {n for n, _, _ in _FIELDS} | {"predicted"}
    own = [c for c in docs.columns if c.lower() not in names]
    base = docs.select(*[F.col(f"`{c}`") for c in own])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(*sent.value)
        for b in in_blocks(batches, 1000):
            got = [scorer(t) for t in b.column("text").to_pylist()]
            more = [pa.array([x[i] for x in got], t) for i, (_, t, _) in enumerate(_FIELDS)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*own, *(n for n, _, _ in _FIELDS)])

    schema = T.StructType([*base.schema.fields]).add("score", "double").add("n_sentences", "long").add("offending", T.ArrayType(T.IntegerType()))
    return base.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= REJECT).cast("int"))


def op4_toxicity(spark, sf_dir) -> DataFrame:
    """Every document of the table, by a model of the labelled ones that are not held out; a null doc_id is not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out")
    return score(with_columns_of(docs, "doc_id", "text"), model).select("doc_id", held, "score", "predicted", "n_sentences", "offending")
