"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxspark.llm import op02_html, op04_join, op06_decontaminate, op08_warc, op10_chat, op13_quality
from voxspark.llm.op01_pii import op1_pii
from voxspark.llm.op02_html import op2_html
from voxspark.llm.op03_sharding import op3_sharding
from voxspark.llm.op05_bpe import op5_bpe
from voxspark.llm.op07_audio import op7_audio
from voxspark.llm.op08_warc import op8_warc
from voxspark.llm.op09_language import op9_language
from voxspark.llm.op11_manifest import op11_manifest
from voxspark.llm.op12_alignment import op12_alignment


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name -> query over the tables in a folder."""
    return {
        "op1_pii": op1_pii,
        "op2_html": op2_html,
        "op3_sharding": op3_sharding,
        "op4_jaccard": op04_join.op4_jaccard,
        "op5_bpe": op5_bpe,
        "op6_decontaminate": op06_decontaminate.op6_decontaminate,
        "op7_audio": op7_audio,
        "op8_warc": op8_warc,
        "op9_language": op9_language,
        "op10_chat": op10_chat.op10_chat,
        "op11_manifest": op11_manifest,
        "op12_alignment": op12_alignment,
        "op13_quality": op13_quality.op13_quality,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of those that SQL can express."""
    return {
        "op2_html": op02_html.ORACLE_SQL,
        "op4_jaccard": op04_join.ORACLE_SQL,
        "op6_decontaminate": op06_decontaminate.ORACLE_SQL,
        "op8_warc": op08_warc.ORACLE_SQL,
        "op10_chat": op10_chat.ORACLE_SQL,
        "op13_quality": op13_quality.ORACLE_SQL,
    }
