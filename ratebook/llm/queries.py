"""Registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import OP5_SQL, op5_chat
from .decontaminate import op7_benchmark_decontamination
from .language_id import op1_language_id
from .licenses import OP12_SQL, op12_licenses
from .line_dedup import OP10_SQL, op10_line_dedup
from .media import op8_media
from .repair import OP13_SQL, op13_conversation_repair
from .sentence_pieces import op4_sentence_pieces
from .simhash import op9_simhash_near_dedup
from .token_files import op2_token_files
from .toxicity import op6_toxicity
from .warc import OP3_SQL, op3_warc
from .whitening import op11_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_token_files": op2_token_files,
    "op3_warc": op3_warc,
    "op4_sentence_pieces": op4_sentence_pieces,
    "op5_chat": op5_chat,
    "op6_toxicity": op6_toxicity,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_media": op8_media,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_line_dedup": op10_line_dedup,
    "op11_whitening": op11_whitening,
    "op12_licenses": op12_licenses,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLES: dict[str, str] = {
    "op3_warc": OP3_SQL,
    "op5_chat": OP5_SQL,
    "op10_line_dedup": OP10_SQL,
    "op12_licenses": OP12_SQL,
    "op13_conversation_repair": OP13_SQL,
}
