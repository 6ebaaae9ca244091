"""Operators of a training-data pipeline; nothing else in the library imports this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontamination, url_filters
from .byte_bpe import op4_byte_bpe
from .chat_format import op8_chat_format
from .decontamination import op9_decontamination
from .pii import op3_pii
from .quality_classifier import op1_quality_classifier
from .quality_rules import op2_quality_rules
from .simhash_dedup import op6_simhash_dedup
from .token_counts import op7_token_counts
from .url_filters import op5_url_filters
from .warc import op10_warc_derivatives

#: Every query of this subpackage by name.
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_quality_rules,
        op3_pii,
        op4_byte_bpe,
        op5_url_filters,
        op6_simhash_dedup,
        op7_token_counts,
        op8_chat_format,
        op9_decontamination,
        op10_warc_derivatives,
    )
}

#: DuckDB SQL of those that SQL can express; the others are tested by brute force.
ORACLES: dict[str, str] = {
    "op5_url_filters": url_filters.ORACLE,
    "op8_chat_format": chat_format.ORACLE,
    "op9_decontamination": decontamination.ORACLE,
}
