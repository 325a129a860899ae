"""Queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from .byte_bpe import op2_byte_bpe
from .collocations import OP11_SQL, op11_collocations
from .curves import op9_nearest_neighbours
from .html_text import op10_html_extraction
from .jaccard import OP4_SQL, op4_jaccard_join
from .jpeg import op7_media_columns
from .language import op8_language_id
from .language_model import OP1_SQL, op1_kneser_ney
from .licenses import OP12_SQL, op12_license_scan
from .packing import op5_packing
from .pii import op6_pii
from .prefix_trie import OP13_SQL, op13_prefix_trie
from .substrings import OP3_SQL, op3_substring_dedup

QUERIES = {
    "op1_kneser_ney": op1_kneser_ney,
    "op10_html_extraction": op10_html_extraction,
    "op11_collocations": op11_collocations,
    "op12_license_scan": op12_license_scan,
    "op13_prefix_trie": op13_prefix_trie,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_packing": op5_packing,
    "op6_pii": op6_pii,
    "op7_media_columns": op7_media_columns,
    "op8_language_id": op8_language_id,
    "op9_nearest_neighbours": op9_nearest_neighbours,
}

ORACLE_SQL: dict[str, str] = {
    "op1_kneser_ney": OP1_SQL,
    "op11_collocations": OP11_SQL,
    "op12_license_scan": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
    "op3_substring_dedup": OP3_SQL,
    "op4_jaccard_join": OP4_SQL,
}
