"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from docslice.llm.chat import op2_chat
from docslice.llm.decontam import op9_decontamination
from docslice.llm.embeddings import op4_embeddings
from docslice.llm.html import op5_html
from docslice.llm.mixing import op1_mixing
from docslice.llm.sharding import op10_sharding
from docslice.llm.simhash import op8_simhash
from docslice.llm.tokenbin import op3_token_binary
from docslice.llm.toxicity import op6_toxicity
from docslice.llm.warc import OP7_SQL, op7_warc

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_chat": op2_chat,
    "op3_token_binary": op3_token_binary,
    "op4_embeddings": op4_embeddings,
    "op5_html": op5_html,
    "op6_toxicity": op6_toxicity,
    "op7_warc": op7_warc,
    "op8_simhash": op8_simhash,
    "op9_decontamination": op9_decontamination,
    "op10_sharding": op10_sharding,
}

ORACLE_SQL: dict[str, str] = {"op7_warc": OP7_SQL}
