"""Registered queries of the training-data operators and their independent SQL."""

from __future__ import annotations

from inkfold.llm.bm25 import OP2_SQL, op2_topk_search
from inkfold.llm.bpe import op9_bpe
from inkfold.llm.chat_format import OP1_SQL, op1_chat_format
from inkfold.llm.conversation_repair import OP13_SQL, op13_conversation_repair
from inkfold.llm.fingerprints import op3_fingerprints
from inkfold.llm.license_scan import OP4_SQL, op4_license_scan
from inkfold.llm.merkle import OP12_SQL, op12_merkle
from inkfold.llm.mixing import OP7_SQL, op7_mixing
from inkfold.llm.near_dedup import op6_near_dedup
from inkfold.llm.secret_scan import OP8_SQL, op8_secret_scan
from inkfold.llm.sharding import OP11_SQL, op11_sharding
from inkfold.llm.toxicity import op10_toxicity
from inkfold.llm.url_filter import OP5_SQL, op5_url_filter

QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_topk_search": op2_topk_search,
    "op3_fingerprints": op3_fingerprints,
    "op4_license_scan": op4_license_scan,
    "op5_url_filter": op5_url_filter,
    "op6_near_dedup": op6_near_dedup,
    "op7_mixing": op7_mixing,
    "op8_secret_scan": op8_secret_scan,
    "op9_bpe": op9_bpe,
    "op10_toxicity": op10_toxicity,
    "op11_sharding": op11_sharding,
    "op12_merkle": op12_merkle,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLES = {
    "op1_chat_format": OP1_SQL,
    "op2_topk_search": OP2_SQL,
    "op4_license_scan": OP4_SQL,
    "op5_url_filter": OP5_SQL,
    "op7_mixing": OP7_SQL,
    "op8_secret_scan": OP8_SQL,
    "op11_sharding": OP11_SQL,
    "op12_merkle": OP12_SQL,
    "op13_conversation_repair": OP13_SQL,
}
