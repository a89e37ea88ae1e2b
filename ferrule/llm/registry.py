"""The queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ferrule.llm.chat import OP3_SQL, op3_chat_format
from ferrule.llm.decontamination import OP5_SQL, op5_decontamination
from ferrule.llm.embedding_dedup import OP9_SQL, op9_embedding_dedup
from ferrule.llm.licenses import op10_licenses
from ferrule.llm.mixing import OP8_SQL, op8_mixing
from ferrule.llm.pii import op7_pii
from ferrule.llm.quality import op2_quality
from ferrule.llm.simhash import op6_simhash
from ferrule.llm.target_resampling import OP12_SQL, op12_target_resampling
from ferrule.llm.token_counts import op1_token_counts
from ferrule.llm.toxicity import op4_toxicity
from ferrule.llm.turn_repair import OP11_SQL, op11_turn_repair
from ferrule.llm.url_filters import OP13_SQL, op13_url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_counts, op2_quality, op3_chat_format, op4_toxicity, op5_decontamination, op6_simhash, op7_pii, op8_mixing, op9_embedding_dedup, op10_licenses, op11_turn_repair, op12_target_resampling, op13_url_filters)
}

SQL: dict[str, str] = {"op3_chat_format": OP3_SQL, "op5_decontamination": OP5_SQL, "op8_mixing": OP8_SQL, "op9_embedding_dedup": OP9_SQL, "op11_turn_repair": OP11_SQL, "op12_target_resampling": OP12_SQL, "op13_url_filters": OP13_SQL}
