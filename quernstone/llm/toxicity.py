"""Toxicity by a factorization machine over hashed terms.

A document's terms are its distinct runs of letters, lower-cased, and the first four and
five letters of each, for languages that inflect; all are hashed. Beside
a weight for each term the model has a short vector, so that the product of two
vectors scores the pair: an insult beside a group's name counts for more than both
alone. Vectors are kept for all terms met at least `least` times in the sample, so pairs
tell whose terms alone do not. A weight of its own has only a term whose presence goes
with the label: of a likelihood ratio that chance gives one term in 10,000. It is fitted by one task from
a bounded sample of labelled rows (see samples.py) and carried to all executors, whose
scoring passes over whole texts without a shuffle. The sample holds both classes in equal parts; the intercept is
moved back to the labelled rows' own odds.

The sample's texts are turned into terms where they are read; the driver gets the model
alone, a row for each of at most BINS hashes.

Defined cases: a null text counts as empty; a text without terms scores as the
intercept says. Where labels hold only one class, or none, no term weighs anything
and all texts score alike. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common, samples

TERM = re.compile(r"[^\W\d_]+")
BINS = 1 << 18
FOLDS, FOLD, THRESHOLD = 4, 2, 0.3


def terms(text: str) -> np.ndarray:
    """The hashed distinct terms of a whole text."""
    words = set(TERM.findall(text.lower()))
    found = words | {f"{w[:4]}-" for w in words if len(w) > 4} | {f"{w[:5]}-" for w in words if len(w) > 5}
    return np.unique(np.array([zlib.crc32(t.encode()) % BINS for t in found], np.int32))


@dataclass
class Machine:
    """score = bias + sum w x + sum over pairs of (v_i . v_j) z_i z_j, through a sigmoid.

    x is 1 for a present term with a vector; z is x over the root of their number, so
    that a long text's many pairs do not outweigh its terms. `ids` are the hashes of the
    terms with a vector, ascending."""

    bias: float
    ids: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray

    def logit(self, found: np.ndarray) -> float:
        at = np.searchsorted(self.ids, found)
        at = at[self.ids[np.minimum(at, len(self.ids) - 1)] == found] if len(self.ids) else at[:0]
        own = self.vectors[at]
        pairs = 0.5 * float((own.sum(0) ** 2 - (own**2).sum(0)).sum()) / max(1, len(at))
        return self.bias + float(self.weights[at].sum()) + pairs

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(terms(text)), -30, 30))))


def _counts(rows: list[np.ndarray]) -> np.ndarray:
    """In how many rows each term is; the terms of a row are distinct."""
    out = np.zeros(BINS, np.int64)
    for r in rows:
        out[r] += 1
    return out


def association(rows: list[np.ndarray], known: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The likelihood-ratio statistic of each term's presence against the label."""
    toxic = _counts([r for r, y in zip(rows, labels, strict=True) if y])
    n, n1 = len(rows), int(labels.sum())
    cells = ((toxic, known, n1), (known - toxic, known, n - n1), (n1 - toxic, n - known, n1), (n - n1 - known + toxic, n - known, n - n1))
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * sum(np.nan_to_num(seen * np.log(seen * n / (a * float(b)))) for seen, a, b in cells)


def fit(rows: list[np.ndarray], labels: np.ndarray, odds: float, factors: int = 6, epochs: int = 20, batch: int = 64, rate: float = 0.5, decay: float = 1e-3, least: int = 3) -> Machine:
    """Adagrad over mini-batches of the logistic loss; the seed and order are fixed."""
    random = np.random.default_rng(7)
    known = _counts(rows)
    values = (known >= least).astype(np.float32)
    own = np.flatnonzero(values).astype(np.int32)  # the terms with a vector, which the steps count from 0
    if len(set(labels.tolist())) < 2:
        return Machine(float(np.log(odds)), own[:0], np.zeros(0, np.float32), np.zeros((0, factors), np.float32))
    weighs = association(rows, known, labels)[own] >= 15
    size, place = len(own), np.cumsum(values > 0) - 1
    w, v = np.zeros(size, np.float32), random.normal(0, 0.01, (size, factors)).astype(np.float32)
    gw, gv, bias, gb = np.ones(size, np.float32), np.ones((size, factors), np.float32), 0.0, 1.0
    rows = [place[r[values[r] > 0]].astype(np.int32) for r in rows]
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            # Only the batch's own terms move: all below is over them.
            met, ids = np.unique(np.concatenate([rows[i] for i in part]), return_inverse=True)
            n = np.array([len(rows[i]) for i in part])
            z = 1 / np.sqrt(np.maximum(1, n))
            row, full = np.repeat(np.arange(len(part)), n), np.flatnonzero(n)
            own_v, own_w = v[met], w[met]
            sums = np.zeros((len(part), factors))
            if len(full):
                sums[full] = np.add.reduceat(own_v[ids], (np.cumsum(n) - n)[full], axis=0) * z[full, None]
            squares = np.bincount(row, (own_v**2).sum(1)[ids], len(part)) * z**2
            logit = bias + np.bincount(row, own_w[ids], len(part)) + 0.5 * ((sums**2).sum(1) - squares)
            slope = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[part]
            each = lambda x: np.bincount(ids, np.repeat(x, n), len(met))  # noqa: B023, E731
            dw = (each(slope) + decay * own_w) * weighs[met]
            pull = sums * (slope * z)[:, None]
            dv = np.stack([each(pull[:, f]) for f in range(factors)], 1) + (decay - each(slope * z**2))[:, None] * own_v
            db = float(slope.sum())
            gw[met] += dw**2
            gv[met] += dv**2
            gb += db**2
            w[met] -= (rate * dw / np.sqrt(gw[met])).astype(np.float32)
            v[met] -= (0.1 * rate * dv / np.sqrt(gv[met])).astype(np.float32)
            bias -= rate * db / np.sqrt(gb)
    share = labels.mean()
    return Machine(float(bias + np.log(odds) - np.log(share / (1 - share))), own, w, v)


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", most_per_class: int = 6000) -> Machine:
    """Fits on at most `most_per_class` labelled rows of each class outside the held-out fold.

    One task fits on the bounded sample's terms and returns the model.
    """
    n0, n1 = samples.class_counts(labels, label, FOLDS, FOLD)
    odds = (n1 + 0.5) / (n0 + 0.5)
    rows = samples.labelled(docs, labels, label, FOLDS, FOLD, most_per_class).select("turn", "id", "label", "text")
    kept = rows.schema.fields[:3]
    out = T.StructType([*kept, T.StructField("terms", T.ArrayType(T.IntegerType()))])
    schema = to_arrow_schema(out)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([terms(t.as_py()) for t in b.column(3)], schema.field("terms").type)], schema=schema)

    model = T.StructType([T.StructField("bias", T.DoubleType()), T.StructField("id", T.IntegerType()), T.StructField("weight", T.FloatType()), T.StructField("vector", T.ArrayType(T.FloatType()))])
    model_schema = to_arrow_schema(model)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pa.Table.from_batches(batches, schema).sort_by([("turn", "ascending"), ("id", "ascending")])
        m = fit([t.values.to_numpy() for t in found["terms"]], found["label"].to_numpy().astype(float), odds)
        # A first row without a term, then one for each term.
        vectors = [None, *m.vectors] if len(m.ids) else [None]
        yield pa.RecordBatch.from_arrays([pa.array([m.bias] + [None] * len(m.ids), pa.float64()), pa.array([None, *m.ids.tolist()], pa.int32()), pa.array([None, *m.weights.tolist()], pa.float32()), pa.array(vectors, pa.list_(pa.float32()))], schema=model_schema)

    one = rows.mapInArrow(hashed, out).repartition(1).mapInArrow(fitted, model).toArrow()
    if not len(one):
        return fit([], np.zeros(0), odds)
    size = len(one) - 1
    vectors = one["vector"].combine_chunks().flatten().to_numpy().reshape(size, -1) if size else np.zeros((0, 1), np.float32)
    return Machine(one["bias"][0].as_py(), one["id"].slice(1).to_numpy().astype(np.int32), one["weight"].slice(1).to_numpy().astype(np.float32), vectors)


def scored(df: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """`df` with `score`, from 0 to 1; a column of that name is replaced."""
    model = df.sparkSession.sparkContext.broadcast(machine)  # its size is bounded by BINS
    names = [c for c in df.columns if c != "score"]
    df = df.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{text_col}`").cast("string").alias("score"))
    out = T.StructType([*df.schema.fields[:-1], T.StructField("score", T.DoubleType())])
    schema = to_arrow_schema(out)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for b in batches:
            scores = [own.score(t.as_py() or "") for t in b.columns[-1]]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores, pa.float64())], schema=schema)

    return df.mapInArrow(score, out)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    common.arrow_rows(spark)
    docs = common.documents(spark, sf_dir)
    machine = learn(docs, common.labels(spark, sf_dir))
    return scored(docs.select("doc_id", "text"), machine).select(
        "doc_id", common.held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
