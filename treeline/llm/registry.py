"""Queries of this package and their SQL, by name."""

from __future__ import annotations

from treeline.llm.op1_quality import op1_quality_mcd
from treeline.llm.op2_trie import op2_trie
from treeline.llm.op3_warc import ORACLE as OP3_SQL
from treeline.llm.op3_warc import op3_warc
from treeline.llm.op4_minhash import op4_minhash
from treeline.llm.op5_html import op5_html
from treeline.llm.op6_bpe import op6_bpe
from treeline.llm.op7_mixing import op7_mixing
from treeline.llm.op8_chat import ORACLE as OP8_SQL
from treeline.llm.op8_chat import op8_chat
from treeline.llm.op9_language import op9_language
from treeline.llm.op10_graph import op10_graph

QUERIES = {f.__name__: f for f in (op1_quality_mcd, op2_trie, op3_warc, op4_minhash, op5_html, op6_bpe, op7_mixing, op8_chat, op9_language, op10_graph)}
ORACLES = {"op3_warc": OP3_SQL, "op8_chat": OP8_SQL}
