"""Registered queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

import corpus_pipeline

from . import entropy_mix, language, length_buckets, licence, near_dedup, quality, stream_dedup, tiff, token_prefix, toxicity

QUERIES = {
    "op1_tiff_pages": tiff.op1,
    "op2_entropy_mix": entropy_mix.op2,
    "op4_length_buckets": length_buckets.op4,
    "op3_toxicity_machine": toxicity.op3,
    "op5_language_mixture": language.op5,
    "op6_token_prefix": token_prefix.op6,
    "op8_stream_dedup": stream_dedup.op8,
    "op7_licence_digest": licence.op7,
    "op9_tensor_minhash": near_dedup.op9,
    "op10_quality_ranking": quality.op10,
    "pipeline": corpus_pipeline.run,
}

ORACLE = {
    "op7_licence_digest": licence.OP7_SQL,
    "op8_stream_dedup": stream_dedup.OP8_SQL,
}
