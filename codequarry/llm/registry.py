"""Queries of the pipeline operators and the SQL that some of them can be held against."""

from __future__ import annotations

from codequarry.llm.chat_format import OP10_SQL, op10_chat_format
from codequarry.llm.decontamination import op6_decontamination
from codequarry.llm.license_scan import op2_license_scan
from codequarry.llm.mixing import op5_mixing
from codequarry.llm.ngram_join import OP3_SQL, op3_ngram_join
from codequarry.llm.quality_rules import OP8_SQL, op8_quality_rules
from codequarry.llm.secret_scan import op7_secret_scan
from codequarry.llm.sharding import OP9_SQL, op9_sharding
from codequarry.llm.substring_dedup import op4_substring_dedup
from codequarry.llm.token_counts import op1_token_counts

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_license_scan": op2_license_scan,
    "op3_ngram_join": op3_ngram_join,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_mixing": op5_mixing,
    "op6_decontamination": op6_decontamination,
    "op7_secret_scan": op7_secret_scan,
    "op8_quality_rules": op8_quality_rules,
    "op9_sharding": op9_sharding,
    "op10_chat_format": op10_chat_format,
}

SQL = {"op3_ngram_join": OP3_SQL, "op8_quality_rules": OP8_SQL, "op9_sharding": OP9_SQL, "op10_chat_format": OP10_SQL}
