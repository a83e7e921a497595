"""Quality by Bradley-Terry ranking of document pairs.

A pair is a document of label 1 and one of label 0; the first should win. The score
is linear in surface features of the whole text, fitted by the logistic loss of the
feature differences of pairs, as Bradley and Terry's model has it, over all pairs of
all labelled rows outside the held-out fold. The threshold is the exact quantile of
these rows' scores: the rows below it are as many as those of label 0. Scores are moved
so that the threshold is at 0.3.

No pair is formed: rows are summed up, in their partitions, by class and by narrow bins of
their scores, each bin with its moments up to the third, and the loss, its gradient and a
near Hessian over all pairs follow from pairs of bins (error of the loss' terms: below
1e-6 at the usual bin width). A Newton step is one pass over the table of features.

Defined cases: a null text counts as empty; all features of an empty text are 0.
Every row of a repeated identifier counts; of several labels of one the largest.
Where labels hold only one class, or none, all texts score 0.5. An empty table gives
an empty result. A column `score` is replaced; others keep their names.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common

FOLDS, FOLD, THRESHOLD = 5, 0, 0.3
SYMBOL_RUN = re.compile(r"([^\w\s])\1+")
SPLIT = re.compile(r"[ \t-\r]+")

#: Kinds of code points: 0 other, 1 lower case, 2 upper case, 3 digit, 4 space, 5 line feed, 6 end mark, 7 symbol; 8 beyond ASCII.
KINDS = np.zeros(256, np.uint8)
KINDS[97:123], KINDS[65:91], KINDS[48:58], KINDS[9:14], KINDS[32] = 1, 2, 3, 4, 4
KINDS[10] = 5
KINDS[[ord(c) for c in ".,;:?!'\"()-"]] = 6
KINDS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 7
KINDS[128:] = 8


def features(text: str) -> np.ndarray:
    """Shares and log counts that describe a whole text's surface."""
    if not text:
        return np.zeros(22)
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    share = np.bincount(KINDS[np.minimum(code, 255)], minlength=9) / len(code)
    words = [w for w in SPLIT.split(text) if w]
    n = max(1, len(words))
    sizes = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    distinct, low = len(set(words)), [w.lower() for w in words]
    lines = [x for x in text.split("\n") if x]
    runs = sum(1 for _ in SYMBOL_RUN.finditer(text))
    rough = np.bincount((code % 64).astype(np.int64), minlength=64) / len(code)
    some = rough[rough > 0]
    return np.array(
        [
            *share,
            sizes.mean() / 10,
            sizes.std() / 10,
            distinct / n,
            distinct / n**0.8,
            runs / n,
            np.log1p(runs),
            sum(w.isupper() for w in words) / n,
            sum(len(w) == 1 for w in words) / n,
            len(set(lines)) / max(1, len(lines)),
            np.log1p(len(lines) / n),
            np.log1p(n) / 10,
            -float((some * np.log(some)).sum()) / 4,
            sum(a == b for a, b in zip(low, low[1:], strict=False)) / n,
        ]
    )


@dataclass
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    shift: float

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([z, np.abs(z)], axis=-1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        # Summed row by row: a row's value is the same in any batch.
        return np.sum(self.inputs(x) * self.weights, axis=-1)

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.shift, -30, 30)))

    def score(self, text: str) -> float:
        return float(self.chance(features(text)))


def constant(width: int) -> Ranking:
    return Ranking(np.zeros(width), np.ones(width), np.zeros(2 * width), 0.0)


#: Moments of a bin, least width of a bin, and how many bins make a wide one, which has second moments of the inputs.
MOMENTS, BIN, WIDE = 4, 1 / 8, 4


def _grouped(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the values' rows by key, keys in order."""
    order = np.lexsort(keys.T[::-1])
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else np.empty(0, int)
    return keys[first], np.add.reduceat(values, first, axis=0) if len(first) else values


def width_of(model: Ranking) -> float:
    """The bins' width; wider where huge weights would spread rows over too many."""
    return max(BIN, float(np.abs(model.weights).sum()) / 1000)


def summed(x: np.ndarray, labels: np.ndarray, model: Ranking) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """By (class, bin) moments of scores, alone and with the inputs; by (class, wide bin) second moments of the inputs."""
    z, raw, h = model.inputs(x), model.raw(x), width_of(model)
    bins = np.floor(raw / h).astype(np.int64)
    off = raw - (bins + 0.5) * h
    powers = np.stack([off**k for k in range(MOMENTS)], axis=1)
    rows = np.concatenate([powers, (powers[:, :, None] * z[:, None, :]).reshape(len(x), -1)], axis=1)
    narrow = _grouped(np.stack([labels, bins], axis=1), rows)
    wide = np.stack([labels, bins // WIDE], axis=1)
    keys, place = np.unique(wide, axis=0, return_inverse=True)
    place = place.ravel()
    second = [np.concatenate([[float((place == i).sum()), raw[place == i].sum()], z[place == i].sum(0), (z[place == i].T @ z[place == i]).ravel()]) for i in range(len(keys))]
    return {"narrow": narrow, "wide": (keys, np.array(second).reshape(len(keys), -1))}


def added(parts: list[dict]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    return {n: _grouped(np.concatenate([p[n][0] for p in parts]), np.concatenate([p[n][1] for p in parts])) for n in ("narrow", "wide")}


def _sigmoid(t: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(t, -500, 500)))


def pairs_loss(sums: dict, model: Ranking, decay: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean loss over all pairs with its penalty, gradient and near Hessian."""
    width, h = len(model.weights), width_of(model)
    keys, values = sums["narrow"]
    bad, good = (keys[:, 0] == 0), (keys[:, 0] == 1)
    at = (keys[:, 1] + 0.5) * h
    moment, vector = values[:, :MOMENTS], values[:, MOMENTS:].reshape(len(values), MOMENTS, width)
    pairs = moment[bad, 0].sum() * moment[good, 0].sum()
    factor = [1.0, 1.0, 2.0, 6.0]
    loss, toward, away = 0.0, np.zeros(width), np.zeros(width)
    bad_at, bad_moment, bad_vector, good_vector, good_moment = at[bad], moment[bad], vector[bad], vector[good], moment[good]
    for low in range(0, good.sum(), 256):
        gap = bad_at[None, :] - at[good][low : low + 256, None]
        p = _sigmoid(gap)
        q = p * (1 - p)
        # The loss' derivatives by the gap; the fourth only serves the gradient.
        d = [np.logaddexp(0, gap), p, q, q * (1 - 2 * p), q * (1 - 6 * q)]
        for k in range(MOMENTS):
            for m in range(MOMENTS - k):
                c = (-1) ** k / (factor[k] * factor[m])
                g0, g1 = good_moment[low : low + 256, k], bad_moment[:, m]
                loss += c * (g0 @ d[k + m] @ g1)
                toward += c * ((d[k + m + 1] @ g1) @ good_vector[low : low + 256, k])
                away += c * ((g0 @ d[k + m + 1]) @ bad_vector[:, m])
    keys, values = sums["wide"]
    bad, good = keys[:, 0] == 0, keys[:, 0] == 1
    count, place = values[:, 0], values[:, 1] / values[:, 0]
    first, second = values[:, 2 : 2 + width], values[:, 2 + width :]
    p = _sigmoid(place[bad][None, :] - place[good][:, None])
    q = p * (1 - p)
    cross = first[good].T @ q @ first[bad]
    hessian = ((q @ count[bad]) @ second[good] + (count[good] @ q) @ second[bad]).reshape(width, width) - cross - cross.T
    w = model.weights
    return loss / pairs + decay / 2 * float(w @ w), (away - toward) / pairs + decay * w, hessian / pairs + decay * np.eye(width)


def fit(model: Ranking, sums: Callable[[Ranking], dict], decay: float = 1e-4, most_steps: int = 30, near: float = 1e-6) -> Ranking:
    """Newton steps over all pairs until the gradient is `near` 0; `sums` gives `summed` of all rows."""
    best = pairs_loss(sums(model), model, decay)
    size = 1.0
    for _ in range(most_steps):
        loss, gradient, hessian = best
        if np.abs(gradient).max() < near or size < 1e-4:
            break
        step = np.linalg.solve(hessian, gradient)
        new = replace(model, weights=model.weights - size * step)
        found = pairs_loss(sums(new), new, decay)
        if found[0] <= loss + 1e-12:
            model, best, size = new, found, min(1.0, 2 * size)
        else:
            size /= 4
    # Sums differ in their last digits with the partitions; rounded weights do not.
    return replace(model, weights=np.round(model.weights, 6))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def described(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` without its text column, with the features `x`."""
    keep = [c for c in docs.columns if c != text_col]
    df = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text_col}`").cast("string").alias("x"))
    out = T.StructType([*df.schema.fields[:-1], T.StructField("x", T.ArrayType(T.DoubleType()))])
    schema = to_arrow_schema(out)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([features(t.as_py() or "") for t in b.columns[-1]], schema.field("x").type)], schema=schema)

    return df.mapInArrow(describe, out)


def _passed(rows: DataFrame, per_batch: Callable, merge: Callable) -> list:
    """One value a partition of (label, x) rows: `per_batch` of its batches, merged as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = None
        for b in batches:
            if b.num_rows:
                new = per_batch(_matrix(b.column(1)), b.column(0).to_numpy())
                value = new if value is None else merge([value, new])
        if value is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(value)], pa.binary())], ["value"])

    return [pickle.loads(v) for v in rows.mapInArrow(run, "value binary").toArrow()["value"].to_pylist()]


def _moments(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
    return np.concatenate([[len(x), (labels == 1).sum()], x.sum(0), (x * x).sum(0)])


def _ordered_bits(raw: np.ndarray) -> np.ndarray:
    """Whole numbers that are in order as the scores are."""
    bits = (raw + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def _score_of(bits: int) -> float:
    bits = bits & ~(1 << 63) if bits >> 63 else ~bits & ((1 << 64) - 1)
    return float(np.uint64(bits).view(np.float64))


def nth_score(rows: DataFrame, model: Ranking, n: int) -> float:
    """The exact n-th smallest raw score (from 0) of all rows: 16 bits of it in each pass."""
    prefix = 0
    for shift in (48, 32, 16, 0):
        above = prefix >> (shift + 16) if shift < 48 else None

        def counted(x: np.ndarray, _: np.ndarray, shift=shift, above=above) -> tuple[np.ndarray, np.ndarray]:
            bits = _ordered_bits(model.raw(x))
            if above is not None:
                bits = bits[bits >> np.uint64(shift + 16) == np.uint64(above)]
            digits, counts = np.unique((bits >> np.uint64(shift)) & np.uint64(0xFFFF), return_counts=True)
            return digits.astype(np.int64)[:, None], counts[:, None]

        merge = lambda parts: _grouped(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        digits, counts = merge(_passed(rows, counted, merge))
        ends = np.cumsum(counts[:, 0])
        k = int(np.searchsorted(ends, n, side="right"))
        n -= int(ends[k - 1]) if k else 0
        prefix |= int(digits[k, 0]) << shift
    return _score_of(prefix)


def learned(described_docs: DataFrame, labels: DataFrame, label: str = "quality") -> Ranking:
    """The ranking of all labelled rows of (doc_id, x) outside the held-out fold."""
    known = (
        labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~common.held_out(F.col("doc_id"), FOLDS, FOLD))
        .groupBy("id")
        .agg(F.max("label").alias("label"))
    )
    spark, width = described_docs.sparkSession, len(features(""))
    scratch = common.Scratch(spark, "quality-fit")
    rows = scratch.table(described_docs.join(known, F.col("doc_id") == F.col("id")).select("label", "x"), "rows").coalesce(64)
    found = _passed(rows, _moments, sum)
    total = np.sum(found, axis=0) if found else np.zeros(2 + 2 * width)
    n, n1 = int(total[0]), int(total[1])
    if n1 in (0, n):
        scratch.drop_all_but()
        return constant(width)
    mean = np.round(total[2 : 2 + width] / n, 9)
    scale = np.round(np.sqrt(np.maximum(total[2 + width :] / n - (total[2 : 2 + width] / n) ** 2, 0)), 9) + 1e-6
    model = fit(Ranking(mean, scale, np.zeros(2 * width), 0.0), lambda m: added(_passed(rows, lambda x, y: summed(x, y, m), added)))
    cut = min(n - n1 - 1, n - 2)
    model.shift = (nth_score(rows, model, cut) + nth_score(rows, model, cut + 1)) / 2 - float(np.log(THRESHOLD / (1 - THRESHOLD)))
    scratch.drop_all_but()
    return model


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Ranking:
    """Fits on all labelled rows outside the held-out fold."""
    marked = labels.select(F.col("doc_id").alias("id")).where(F.col(label).isNotNull() & ~common.held_out(F.col("doc_id"), FOLDS, FOLD)).distinct()
    texts = docs.select("doc_id", "text").join(marked, F.col("doc_id") == F.col("id"), "left_semi")
    return learned(described(texts), labels, label)


def scored(df: DataFrame, model: Ranking, text_col: str = "text") -> DataFrame:
    """`df` with `score`, from 0 to 1; a column of that name is replaced."""
    names = [c for c in df.columns if c != "score"]
    df = df.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{text_col}`").cast("string").alias("score"))
    out = T.StructType([*df.schema.fields[:-1], T.StructField("score", T.DoubleType())])
    schema = to_arrow_schema(out)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [model.score(t.as_py() or "") for t in b.columns[-1]]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores, pa.float64())], schema=schema)

    return df.mapInArrow(score, out)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    common.arrow_rows(spark)
    scratch = common.Scratch(spark, "quality")
    # Each text is described once, for the fit and for its score.
    rows = scratch.table(described(common.documents(spark, sf_dir).select("doc_id", "text")), "features")
    model = learned(rows, common.labels(spark, sf_dir))
    schema = pa.schema([("doc_id", to_arrow_schema(rows.schema).field(0).type), ("score", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.chance(_matrix(b.column(1))))], schema=schema)

    return rows.mapInArrow(score, T.StructType([rows.schema.fields[0], T.StructField("score", T.DoubleType())])).select(
        "doc_id", common.held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
