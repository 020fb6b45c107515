"""Queries and SQL of this subpackage."""

from __future__ import annotations

from .chat_format import OP1_SQL, op1_chat_format
from .decontaminate import op4_decontaminate
from .filter_audit import OP11_SQL, op11_filter_audit
from .jaccard_join import op10_jaccard_join
from .merkle import OP13_SQL, op13_merkle
from .packing import op7_packing
from .quality_classifier import op2_quality_classifier
from .quality_rules import OP3_SQL, op3_quality_rules
from .substring_dedup import op8_substring_dedup
from .token_counts import op5_token_counts
from .toxicity import op9_toxicity
from .url_filter import OP6_RULES_SQL, op6_rules, op6_url_filter
from .warc import OP12_SQL, op12_warc

QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_quality_rules": op3_quality_rules,
    "op4_decontaminate": op4_decontaminate,
    "op5_token_counts": op5_token_counts,
    "op6_url_filter": op6_url_filter,
    "op7_packing": op7_packing,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_filter_audit": op11_filter_audit,
    "op12_warc": op12_warc,
    "op13_merkle": op13_merkle,
    "url_rules": op6_rules,
}
ORACLE_SQL = {"op1_chat_format": OP1_SQL, "op3_quality_rules": OP3_SQL, "op11_filter_audit": OP11_SQL, "op12_warc": OP12_SQL, "op13_merkle": OP13_SQL, "url_rules": OP6_RULES_SQL}
