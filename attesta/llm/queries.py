"""Queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from .alignment import op13_alignment
from .exact_dedup import OP6_SQL, op6_exact_dedup
from .language_id import op9_language_id
from .licenses import op7_licenses
from .mixing import OP5_SQL, op5_mixing
from .near_dedup import op3_near_dedup
from .packing import op2_packing
from .phrases import OP12_SQL, op12_phrases
from .quality_model import op4_quality_model
from .quality_rules import op10_quality_rules
from .sharding import op8_sharding
from .warc import OP1_SQL, op1_warc
from .word_bpe import op11_word_bpe

QUERIES = {
    "op1_warc": op1_warc,
    "op2_packing": op2_packing,
    "op3_near_dedup": op3_near_dedup,
    "op4_quality_model": op4_quality_model,
    "op5_mixing": op5_mixing,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_licenses": op7_licenses,
    "op8_sharding": op8_sharding,
    "op9_language_id": op9_language_id,
    "op10_quality_rules": op10_quality_rules,
    "op11_word_bpe": op11_word_bpe,
    "op12_phrases": op12_phrases,
    "op13_alignment": op13_alignment,
}
ORACLE_SQL = {"op1_warc": OP1_SQL, "op5_mixing": OP5_SQL, "op6_exact_dedup": OP6_SQL, "op12_phrases": OP12_SQL}
