"""The queries opN_<name> of this subpackage and their SQL."""

from __future__ import annotations

from .byte_bpe import op13_byte_bpe
from .conversations import OP12_SQL, op12_conversation_repair
from .exact_dedup import OP7_SQL, op7_exact_dedup
from .mixing import op3_source_mixing
from .nearest import OP1_SQL, op1_nearest_neighbours
from .ngram_join import OP6_SQL, op6_ngram_jaccard_join
from .packing import op5_best_fit_packing
from .pseudonyms import op4_pii_pseudonyms
from .quality import op10_quality_classifier
from .resampling import OP11_SQL, op11_importance_resampling
from .substring_dedup import OP8_SQL, op8_substring_dedup
from .url_filter import RULES_SQL, op9_url_filter, url_rules
from .warc import OP2_SQL, op2_warc

QUERIES = {
    "op1_nearest_neighbours": op1_nearest_neighbours,
    "op2_warc": op2_warc,
    "op3_source_mixing": op3_source_mixing,
    "op4_pii_pseudonyms": op4_pii_pseudonyms,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_byte_bpe": op13_byte_bpe,
    "url_rules": url_rules,
}

ORACLE_SQL = {
    "op1_nearest_neighbours": OP1_SQL,
    "op2_warc": OP2_SQL,
    "op6_ngram_jaccard_join": OP6_SQL,
    "op7_exact_dedup": OP7_SQL,
    "op8_substring_dedup": OP8_SQL,
    "op11_importance_resampling": OP11_SQL,
    "op12_conversation_repair": OP12_SQL,
    "url_rules": RULES_SQL,
}
