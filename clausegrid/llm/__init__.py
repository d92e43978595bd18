"""Operators for training-data preparation; nothing else in the library imports them."""

from clausegrid.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from clausegrid.llm.filter_audit import OP13_SQL, op13_filter_audit
from clausegrid.llm.html_text import op7_html_text
from clausegrid.llm.line_dedup import op6_line_dedup
from clausegrid.llm.media import op3_media_columns
from clausegrid.llm.near_dedup import op8_near_dedup
from clausegrid.llm.packing import op10_packing
from clausegrid.llm.pii import op5_pii
from clausegrid.llm.pieces import op4_sentencepiece
from clausegrid.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from clausegrid.llm.secret_scan import op12_secret_scan
from clausegrid.llm.sharding import op2_sharding
from clausegrid.llm.toxicity import op9_toxicity

QUERIES = {"op1_exact_dedup": op1_exact_dedup, "op2_sharding": op2_sharding, "op3_media_columns": op3_media_columns, "op4_sentencepiece": op4_sentencepiece, "op5_pii": op5_pii, "op6_line_dedup": op6_line_dedup, "op7_html_text": op7_html_text, "op8_near_dedup": op8_near_dedup, "op9_toxicity": op9_toxicity, "op10_packing": op10_packing, "op11_prefix_trie": op11_prefix_trie, "op12_secret_scan": op12_secret_scan, "op13_filter_audit": op13_filter_audit}
ORACLES = {"op1_exact_dedup": OP1_SQL, "op11_prefix_trie": OP11_SQL, "op13_filter_audit": OP13_SQL}
