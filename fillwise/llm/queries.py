"""The corpus queries and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fillwise.llm.op1_quality import OP1_SQL, op1_quality
from fillwise.llm.op10_licenses import op10_licenses
from fillwise.llm.op11_secrets import op11_secrets
from fillwise.llm.op12_whitening import op12_whitening
from fillwise.llm.op13_divergence import OP13_SQL, op13_divergence
from fillwise.llm.op2_jaccard import OP2_SQL, op2_jaccard
from fillwise.llm.op3_warc import OP3_SQL, op3_warc
from fillwise.llm.op4_exact_dedup import OP4_SQL, op4_exact_dedup
from fillwise.llm.op5_html import op5_html
from fillwise.llm.op6_mixing import op6_mixing
from fillwise.llm.op7_toxicity import op7_toxicity
from fillwise.llm.op8_substring import OP8_SQL, op8_substring
from fillwise.llm.op9_packing import op9_packing


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_jaccard": op2_jaccard,
        "op3_warc": op3_warc,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_html": op5_html,
        "op6_mixing": op6_mixing,
        "op7_toxicity": op7_toxicity,
        "op8_substring": op8_substring,
        "op9_packing": op9_packing,
        "op10_licenses": op10_licenses,
        "op11_secrets": op11_secrets,
        "op12_whitening": op12_whitening,
        "op13_divergence": op13_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality": OP1_SQL,
        "op2_jaccard": OP2_SQL,
        "op3_warc": OP3_SQL,
        "op4_exact_dedup": OP4_SQL,
        "op8_substring": OP8_SQL,
        "op13_divergence": OP13_SQL,
    }
