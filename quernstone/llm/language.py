"""Language mixtures by expectation-maximisation over n-gram likelihoods.

Each learned language has a smoothed distribution over hashed letter trigrams. A
document's trigrams are taken as drawn from a mixture of languages; EM estimates the
proportions. Then languages leave the set one at a time, the least that can first, as long
as the likelihood lost is below the penalty for a free proportion. The prediction is
the largest proportion of the set that is left.

The distributions are fitted on a bounded sample: about `most_per_language` documents
of each language, by a hash of their identifier. Counting runs on the executors; what
reaches the driver is bounded by languages times BINS. Inference passes over whole
texts without a shuffle.

Defined cases: a text that is null or has no letter is `und` with score 0. Without any
learned language all are `und`. An empty table gives an empty result. The result is
a struct `mixture`, so other columns keep their names; one so called is replaced.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common

FOLDS, FOLD = 4, 2
BINS = 1 << 15
#: Characters that count as word characters but are neither letters nor decimal digits, such as ² and Ⅷ.
NUMERALS = "".join(c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
LETTERS, NUMERAL = re.compile(r"[^\W\d_]+"), re.compile(f"[{NUMERALS}]")

MIXTURE = T.StructType(
    [
        T.StructField("lang", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("shares", T.MapType(T.StringType(), T.DoubleType())),
    ]
)


def trigrams(text: str) -> np.ndarray:
    """Hashed trigrams of a whole text's words, which a space parts; none without letters."""
    words = " ".join(LETTERS.findall(text.lower()))
    if not words.replace(" ", "").isalpha():
        words = " ".join(NUMERAL.sub(" ", words).split())
    if not words:
        return np.empty(0, np.int64)
    code = np.frombuffer(f" {words} ".encode("utf-32-le"), np.uint32)
    mixed = code[:-2] * np.uint32(0x9E3779B1) ^ code[1:-1] * np.uint32(0x85EBCA6B) ^ code[2:] * np.uint32(0xC2B2AE35)
    return ((mixed ^ mixed >> np.uint32(15)) % np.uint32(BINS)).astype(np.int64)


@dataclass
class Mixture:
    langs: list[str]
    chance: np.ndarray  # languages x BINS

    def _em(self, p: np.ndarray, counts: np.ndarray, steps: int = 40) -> tuple[np.ndarray, float]:
        share, total = np.full(len(p), 1 / len(p)), counts.sum()
        mix = share @ p
        for _ in range(steps):
            new = share * (p @ (counts / mix)) / total
            mix = new @ p
            done, share = np.abs(new - share).max() < 1e-3, new
            if done:
                break
        return share, float(counts @ np.log(mix))

    def infer(self, text: str | None) -> tuple[str, float, list[tuple[str, float]]]:
        grams = trigrams(text or "")
        if not len(grams) or not self.langs:
            return "und", 0.0, []
        ids, counts = np.unique(grams, return_counts=True)
        p, own = self.chance[:, ids], np.arange(len(self.langs))
        share, fit = self._em(p, counts)
        penalty = 0.5 * np.log(len(grams)) + 2.0
        some = np.flatnonzero(share > 1e-3)
        if 1 < len(own) - len(some):  # all that hold next to nothing, together, against their penalties
            fewer, less = self._em(p[some], counts)
            if fit - less <= penalty * (len(own) - len(some)):
                own, share, fit = some, fewer, less
        while len(own) > 1:
            for i in share.argsort():
                rest = np.delete(own, i)
                fewer, less = self._em(p[rest], counts)
                if fit - less <= penalty:
                    own, share, fit = rest, fewer, less
                    break
            else:
                break
        best = int(share.argmax())
        return self.langs[own[best]], float(min(1.0, share[best])), [(self.langs[i], float(s)) for i, s in zip(own, share, strict=True)]


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_per_language: int = 3000, most_languages: int = 1000) -> Mixture:
    """Fits on about `most_per_language` documents of each language outside the held-out fold.

    The model holds a row of BINS for each language, so more than `most_languages` are an error.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~common.held_out(F.col("id"), FOLDS, FOLD))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(most_languages + 1).collect()}
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    turn = F.pmod(F.xxhash64("id", F.lit(23)), F.lit(1 << 30))
    if not sizes:
        return Mixture([], np.zeros((0, BINS)))
    bound = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, most_per_language / n) * (1 << 30)))))
    rows = rows.where(turn < F.element_at(bound, F.col("lang"))).select("lang", "text")
    out = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.IntegerType()), T.StructField("n", T.LongType())])
    schema = to_arrow_schema(out)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if lang not in sums:
                    sums[lang] = np.zeros(BINS, np.int64)
                sums[lang] += np.bincount(trigrams(text), minlength=BINS)
        for lang, n in sums.items():
            grams = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.int32()), pa.array(n[grams], pa.int64())], schema=schema)

    found = rows.mapInArrow(counted, out).groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(sizes)
    counts = np.zeros((len(langs), BINS))
    place = {lang: i for i, lang in enumerate(langs)}
    counts[[place[x] for x in found["lang"].to_pylist()], found["gram"].to_numpy()] = found["n"].to_numpy()
    counts += 0.3
    return Mixture(langs, counts / counts.sum(1, keepdims=True))


def inferred(df: DataFrame, model: Mixture, text_col: str = "text") -> DataFrame:
    """`df` without the text, and `mixture`: lang, score and the shares of its set."""
    spread = df.sparkSession.sparkContext.broadcast(model)  # languages times BINS
    names = [c for c in df.columns if c not in (text_col, "mixture")]
    df = df.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{text_col}`").cast("string").alias("mixture"))
    out = T.StructType([*df.schema.fields[:-1], T.StructField("mixture", MIXTURE)])
    schema = to_arrow_schema(out)

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = spread.value
        for b in batches:
            found = [dict(zip(MIXTURE.names, own.infer(t.as_py()), strict=True)) for t in b.columns[-1]]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, schema.field("mixture").type)], schema=schema)

    return df.mapInArrow(infer, out)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    common.arrow_rows(spark)
    docs = common.documents(spark, sf_dir)
    mixture = F.col("mixture")
    return inferred(docs.select("doc_id", "text"), learn(docs)).select(
        "doc_id",
        common.held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"),
        mixture["lang"].alias("lang_pred"),
        mixture["score"].alias("score"),
        F.size(mixture["shares"]).alias("n_langs"),
    )
