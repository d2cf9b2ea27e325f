"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from vellumetry.llm.bpe import op9_byte_bpe
from vellumetry.llm.divergence import op2_divergence
from vellumetry.llm.mixing import OP8_SQL, op8_mixing
from vellumetry.llm.near_duplicates import op4_bag_min_hash
from vellumetry.llm.neighbours import op5_learned_partitions
from vellumetry.llm.sharding import op1_reshard
from vellumetry.llm.token_files import op7_token_files
from vellumetry.llm.toxicity import op3_toxicity
from vellumetry.llm.url_filter import op6_sql, op6_url_filter
from vellumetry.llm.warc import OP10_SQL, op10_warc

QUERIES = {
    "op1_reshard": op1_reshard,
    "op2_divergence": op2_divergence,
    "op3_toxicity": op3_toxicity,
    "op4_bag_min_hash": op4_bag_min_hash,
    "op5_learned_partitions": op5_learned_partitions,
    "op6_url_filter": op6_url_filter,
    "op7_token_files": op7_token_files,
    "op8_mixing": op8_mixing,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_warc": op10_warc,
}

SQL: dict[str, str] = {"op6_url_filter": op6_sql(), "op8_mixing": OP8_SQL, "op10_warc": OP10_SQL}
