"""The corpus operators' queries and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tandemlake.llm.op10_minhash_dedup import SQL as NEAR_SQL
from tandemlake.llm.op10_minhash_dedup import op10_minhash_dedup
from tandemlake.llm.op11_periodic_runs import SQL as RUNS_SQL
from tandemlake.llm.op11_periodic_runs import op11_periodic_runs
from tandemlake.llm.op12_line_dedup import SQL as LINES_SQL
from tandemlake.llm.op12_line_dedup import op12_line_dedup
from tandemlake.llm.op13_conversation_repair import SQL as REPAIR_SQL
from tandemlake.llm.op13_conversation_repair import op13_conversation_repair
from tandemlake.llm.op1_language_id import op1_language_id
from tandemlake.llm.op2_sentencepiece import op2_sentencepiece
from tandemlake.llm.op3_pii import op3_pii
from tandemlake.llm.op4_decontamination import SQL as LEAKS_SQL
from tandemlake.llm.op4_decontamination import op4_decontamination
from tandemlake.llm.op5_quality_rules import ABLATIONS_SQL, op5_quality_rules, quality_ablations
from tandemlake.llm.op5_quality_rules import SQL as QUALITY_SQL
from tandemlake.llm.op6_warc_revisits import SQL as WARC_SQL
from tandemlake.llm.op6_warc_revisits import op6_warc_revisits
from tandemlake.llm.op7_sharding import GROWTH_SQL, op7_sharding, slot_map_growth, slot_map_history
from tandemlake.llm.op8_html_extraction import op8_html_extraction
from tandemlake.llm.op9_token_counts import op9_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_pii": op3_pii,
    "op4_decontamination": op4_decontamination,
    "op5_quality_rules": op5_quality_rules,
    "op6_warc_revisits": op6_warc_revisits,
    "op7_sharding": op7_sharding,
    "op8_html_extraction": op8_html_extraction,
    "op9_token_counts": op9_token_counts,
    "op10_minhash_dedup": op10_minhash_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_line_dedup": op12_line_dedup,
    "op13_conversation_repair": op13_conversation_repair,
    "quality_ablations": quality_ablations,
    "slot_map_growth": slot_map_growth,
    "slot_map_history": slot_map_history,
}

ORACLE_SQL: dict[str, str] = {
    "op4_decontamination": LEAKS_SQL,
    "op5_quality_rules": QUALITY_SQL,
    "op6_warc_revisits": WARC_SQL,
    "op10_minhash_dedup": NEAR_SQL,
    "op11_periodic_runs": RUNS_SQL,
    "op12_line_dedup": LINES_SQL,
    "op13_conversation_repair": REPAIR_SQL,
    "quality_ablations": ABLATIONS_SQL,
    "slot_map_growth": GROWTH_SQL,
}
