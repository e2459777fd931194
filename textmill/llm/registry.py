"""Queries and SQL of this subpackage, for __spark_entry__.py."""

from __future__ import annotations

from textmill.llm.alignment import op13_alignment
from textmill.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from textmill.llm.html_extract import op4_html_extract
from textmill.llm.language_id import op6_language_id
from textmill.llm.language_model import op2_lm_score
from textmill.llm.lexical_search import OP12_SQL, op12_lexical_search
from textmill.llm.license_scan import op8_license_scan
from textmill.llm.line_dedup import OP10_SQL, op10_line_dedup
from textmill.llm.media import op3_media
from textmill.llm.packing import op7_packing
from textmill.llm.piece_bpe import op5_sentencepiece
from textmill.llm.private_data import op11_private_data
from textmill.llm.simhash import op9_simhash

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_lm_score": op2_lm_score,
    "op3_media": op3_media,
    "op4_html_extract": op4_html_extract,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_language_id": op6_language_id,
    "op7_packing": op7_packing,
    "op8_license_scan": op8_license_scan,
    "op9_simhash": op9_simhash,
    "op10_line_dedup": op10_line_dedup,
    "op11_private_data": op11_private_data,
    "op12_lexical_search": op12_lexical_search,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL = {
    "op1_exact_dedup": OP1_SQL,
    "op10_line_dedup": OP10_SQL,
    "op12_lexical_search": OP12_SQL,
}
