"""Queries of the corpus operators and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridlark.llm.conversations import op11_conversation_repair
from gridlark.llm.decontaminate import op10_decontaminate
from gridlark.llm.divergence import DIVERGENCE_SQL, op12_source_divergence
from gridlark.llm.line_dedup import op5_line_dedup
from gridlark.llm.mixing import MIX_SQL, op3_mixing
from gridlark.llm.near_dedup import op4_near_dedup
from gridlark.llm.packing import op13_packing
from gridlark.llm.pii import op8_pii
from gridlark.llm.quality import op1_quality
from gridlark.llm.secrets import op7_secrets
from gridlark.llm.token_counts import op2_token_counts
from gridlark.llm.token_files import op6_token_files
from gridlark.llm.warc import op9_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op2_token_counts": op2_token_counts,
    "op6_token_files": op6_token_files,
    "op9_warc": op9_warc,
    "op1_quality": op1_quality,
    "op7_secrets": op7_secrets,
    "op3_mixing": op3_mixing,
    "op4_near_dedup": op4_near_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op8_pii": op8_pii,
    "op10_decontaminate": op10_decontaminate,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_source_divergence": op12_source_divergence,
    "op13_packing": op13_packing,
}
ORACLE_SQL: dict[str, str] = {"op3_mixing": MIX_SQL, "op12_source_divergence": DIVERGENCE_SQL}
