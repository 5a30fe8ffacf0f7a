"""The subpackage's queries and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quaver.llm.bytebpe import q_byte_bpe
from quaver.llm.chatformat import q_chat_format
from quaver.llm.decontam import q_decontamination
from quaver.llm.infill import q_fill_in_middle
from quaver.llm.kneserney import q_lm_score
from quaver.llm.mixing import q_mixing
from quaver.llm.ngramjoin import q_ngram_join
from quaver.llm.quality import q_quality
from quaver.llm.sharding import q_sharding
from quaver.llm.tokenfiles import q_token_files
from quaver.llm.toxicity import q_toxicity
from quaver.llm.urlgraph import q_url_filter
from quaver.llm.whitening import q_whitening


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": q_decontamination,
    "op2_toxicity": q_toxicity,
    "op3_sharding": q_sharding,
    "op4_token_files": q_token_files,
    "op5_quality": q_quality,
    "op6_ngram_join": q_ngram_join,
    "op7_mixing": q_mixing,
    "op8_chat_format": q_chat_format,
    "op9_url_filter": q_url_filter,
    "op10_lm_score": q_lm_score,
    "op11_whitening": q_whitening,
    "op12_byte_bpe": q_byte_bpe,
    "op13_fill_in_middle": q_fill_in_middle,
    "pipeline": _pipeline,
}
ORACLES: dict[str, str] = {}
