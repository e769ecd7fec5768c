"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from quern.llm.chat import OP7_SQL, op7_chat_formatting
from quern.llm.forest import OP3_SQL, op3_embedding_near_dedup
from quern.llm.jaccard import op10_ngram_jaccard_join
from quern.llm.licences import OP8_SQL, op8_license_scan
from quern.llm.merkle import op9_merkle_fingerprints
from quern.llm.mixing import OP4_SQL, op4_mixing
from quern.llm.pieces import op2_sentencepiece
from quern.llm.quality import op6_quality_classifier
from quern.llm.toxicity import op5_toxicity
from quern.llm.urls import OP1_SQL, op1_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_url_filter": op1_url_filter,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_embedding_near_dedup": op3_embedding_near_dedup,
        "op4_mixing": op4_mixing,
        "op5_toxicity": op5_toxicity,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_chat_formatting": op7_chat_formatting,
        "op8_license_scan": op8_license_scan,
        "op9_merkle_fingerprints": op9_merkle_fingerprints,
        "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": OP1_SQL,
        "op3_embedding_near_dedup": OP3_SQL,
        "op7_chat_formatting": OP7_SQL,
        "op4_mixing": OP4_SQL,
        "op8_license_scan": OP8_SQL,
    }
