"""The queries of this subpackage, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from . import chat_format, chat_repair, exact_top_k, line_dedup, ngram_jaccard, prefix_trie
from .byte_bpe import op6_byte_bpe
from .chat_format import op4_chat_format
from .chat_repair import op12_chat_repair
from .exact_top_k import op3_exact_top_k
from .html_extract import op9_html_extract
from .line_dedup import op2_line_dedup
from .nearest import op7_nearest
from .ngram_jaccard import op1_ngram_jaccard_join
from .packing import op10_packing
from .piece_bpe import op13_sentencepiece
from .prefix_trie import op11_prefix_trie
from .quality import op5_quality_classifier
from .token_files import op8_token_files

_ALL = (
    op1_ngram_jaccard_join, op2_line_dedup, op3_exact_top_k, op4_chat_format, op5_quality_classifier,
    op6_byte_bpe, op7_nearest, op8_token_files, op9_html_extract, op10_packing,
    op11_prefix_trie, op12_chat_repair, op13_sentencepiece,
)
QUERIES = {f.__name__: f for f in _ALL}

ORACLES = {
    "op1_ngram_jaccard_join": ngram_jaccard.ORACLE, "op2_line_dedup": line_dedup.ORACLE, "op3_exact_top_k": exact_top_k.ORACLE, "op4_chat_format": chat_format.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE, "op12_chat_repair": chat_repair.ORACLE,
}
