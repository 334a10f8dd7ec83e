"""The registered queries of this subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op4_byte_bpe
from .conversations import op13_conversation_repair
from .decontaminate import op10_decontaminate
from .langid import op8_language_id
from .lm import op1_lm_score
from .quality import op3_quality_rules
from .sharding import op12_sharding
from .simhash import op6_simhash
from .substring_dedup import op5_substring_dedup
from .token_counts import op9_token_counts
from .toxicity import op7_toxicity
from .url_filter import OP2_SQL, op2_url_filter
from .whitening import op11_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_score": op1_lm_score,
    "op2_url_filter": op2_url_filter,
    "op3_quality_rules": op3_quality_rules,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_simhash": op6_simhash,
    "op7_toxicity": op7_toxicity,
    "op8_language_id": op8_language_id,
    "op9_token_counts": op9_token_counts,
    "op10_decontaminate": op10_decontaminate,
    "op11_whitening": op11_whitening,
    "op12_sharding": op12_sharding,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {"op2_url_filter": OP2_SQL}
