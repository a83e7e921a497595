"""Exact token counts of every prefix of a text, by dynamic programming.

For a BPE vocabulary the encoding of a prefix is the encoding of a shorter prefix
and one last token; of all tokens that end the prefix, exactly one is stable beside
the last token of that shorter prefix. So count[i] = count[i - len(token)] + 1, in
one pass over the characters. No piece holds a space sign after another character,
and none holds a line feed, so texts fall into chunks whose encodings are
independent; a worker keeps the counts of short chunks it has met.

The counts are stored as one signed byte for each character: how much the count
changes. Their running sum is the exact count at every prefix, so the length at
which a text must be cut to fit a budget needs no further encoding.

Defined cases: null counts as empty and has 0 tokens. A text of one long chunk is
processed whole, without the memory of chunks. Strings of special tokens inside a
text are ordinary text. An empty table gives an empty result. The result is a
struct `tokens`, so other columns keep their names; one called `tokens` is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common

SPACE = "▁"
#: Longest chunk, and most chunks, that a worker remembers.
LONGEST_KEPT, MOST_KEPT = 48, 500_000

TOKENS = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("fits_chars", T.LongType()),
        T.StructField("deltas", T.BinaryType()),
    ]
)


def vocabulary(model_path: str) -> dict[str, float]:
    """The pieces that merging can make, with their scores."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_path)
    ids = range(model.get_piece_size())
    return {model.id_to_piece(i): model.get_score(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}


class PrefixCounter:
    """Counts for one vocabulary with byte fallback and a space before the text."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.ends = {piece[i:] for piece in scores for i in range(len(piece))}
        inner = any(SPACE in piece.lstrip(SPACE) or "\n" in piece for piece in scores)
        self.chunk = re.compile(r"(?s).+" if inner else rf"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        self.stable: dict = {}
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The encoding of a short text by merging, best score first, then leftmost."""
        parts, scores = list(text), self.scores
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fits(self, left: str, token: str) -> bool:
        key = (left, token)
        known = self.stable.get(key)
        if known is None:
            if len(self.stable) >= MOST_KEPT:
                self.stable.clear()
            known = self.stable[key] = self.merged(left + token) == ([left, token] if left else [token])
        return known

    def counts(self, chunk: str) -> list[int]:
        """Token counts of all prefixes of a chunk, the empty one first."""
        count, last = [0], [""]
        scores, ends, stable = self.scores, self.ends, self.stable
        for i in range(1, len(chunk) + 1):
            start, tokens = i - 1, []
            token = chunk[start:i]
            while token in ends:  # some piece ends with it, so a longer one may
                if token in scores:
                    tokens.append((start, token))
                if not start:
                    break
                start -= 1
                token = chunk[start:i]
            for start, token in reversed(tokens):
                left = last[start]
                fits = stable.get((left, token))
                if self._fits(left, token) if fits is None else fits:
                    count.append(count[start] + 1)
                    last.append(token)
                    break
            else:  # a character without a piece: its bytes, which merge with nothing
                count.append(count[-1] + len(chunk[i - 1].encode()))
                last.append("\0")
        return count

    def _deltas(self, chunk: str) -> bytes:
        known = self.older.get(chunk)
        if known is None:
            count = self.counts(chunk)
            known = bytes([b - a & 255 for a, b in zip(count, count[1:], strict=False)])
        if len(chunk) <= LONGEST_KEPT:
            if len(self.kept) >= MOST_KEPT:
                self.older, self.kept = self.kept, {}
            self.kept[chunk] = known
        return known

    def deltas(self, text: str) -> bytes:
        """One signed byte a character: the change of the count; the first has the added space's too."""
        if not text:
            return b""
        kept, own = self.kept, self._deltas
        parts = b"".join([kept.get(c) or own(c) for c in self.chunk.findall(SPACE + text.replace(" ", SPACE))])
        return bytes(((parts[0] + parts[1]) & 255,)) + parts[2:]


def counts_at(deltas: bytes) -> np.ndarray:
    """The token count of every non-empty prefix."""
    return np.cumsum(np.frombuffer(deltas, np.int8), dtype=np.int64)


def longest_prefix(deltas: bytes, budget: int) -> int:
    """Characters of the longest prefix with at most `budget` tokens."""
    fits = np.flatnonzero(counts_at(deltas) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def prefix_tokens(df: DataFrame, model_path: str, text_col: str = "text", budget: int = 4096) -> DataFrame:
    """`df` without the text, and `tokens`: n_bytes, n_tokens, fits_chars (characters
    of the longest prefix within `budget`) and deltas (the stored counts)."""
    spark = df.sparkSession
    scores = spark.sparkContext.broadcast(vocabulary(model_path))
    names = [c for c in df.columns if c not in (text_col, "tokens")]
    df = df.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{text_col}`").cast("string").alias("tokens"))
    out = T.StructType([*df.schema.fields[:-1], T.StructField("tokens", TOKENS)])
    schema = to_arrow_schema(out)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = common.worker_cache()
        counter = cache.setdefault(("prefix", model_path), None) or cache.update({("prefix", model_path): PrefixCounter(scores.value)}) or cache["prefix", model_path]
        for batch in batches:
            texts, rows = batch.column(batch.num_columns - 1), []
            for i in range(batch.num_rows):
                text = texts[i].as_py() or ""
                deltas = counter.deltas(text)
                total = int(np.frombuffer(deltas, np.int8).sum(dtype=np.int64))
                rows.append({"n_bytes": len(text.encode()), "n_tokens": total, "fits_chars": len(text) if total <= budget else longest_prefix(deltas, budget), "deltas": deltas})
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, schema.field("tokens").type)], schema=schema)

    return df.mapInArrow(count, out)


def op6(spark: SparkSession, sf_dir: str, model_path: str | None = None, limit: int = 4096) -> DataFrame:
    """Token counts of every document, and where it must be cut to fit the limit."""
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    common.arrow_rows(spark)
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    tokens = F.col("tokens")
    return prefix_tokens(docs, str(model_path), budget=limit).select(
        "doc_id",
        tokens["n_bytes"].alias("n_bytes"),
        tokens["n_tokens"].alias("n_tokens"),
        (tokens["n_tokens"] > limit).alias("over_limit"),
        tokens["fits_chars"].alias("fits_chars"),
    )
