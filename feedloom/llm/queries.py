"""Queries of the operators and the SQL that checks those which SQL can express."""

from __future__ import annotations

from corpus_pipeline import run as pipeline
from feedloom.llm.chat import OP6_SQL, op6_chat
from feedloom.llm.decontamination import op10_decontamination
from feedloom.llm.divergence import OP12_SQL, op12_divergence
from feedloom.llm.language import op9_language
from feedloom.llm.mixing import OP13_SQL, op13_mixing
from feedloom.llm.minhash import OP8_SQL, op8_minhash
from feedloom.llm.packing import op4_packing
from feedloom.llm.pii import op5_pii
from feedloom.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from feedloom.llm.secrets import op7_secrets
from feedloom.llm.topk import OP1_SQL, op1_topk
from feedloom.llm.token_counts import op3_token_counts
from feedloom.llm.token_files import op2_token_files

QUERIES = {
    "op1_topk": op1_topk,
    "op2_token_files": op2_token_files,
    "op3_token_counts": op3_token_counts,
    "op4_packing": op4_packing,
    "op5_pii": op5_pii,
    "op6_chat": op6_chat,
    "op7_secrets": op7_secrets,
    "op8_minhash": op8_minhash,
    "op9_language": op9_language,
    "op10_decontamination": op10_decontamination,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_divergence": op12_divergence,
    "op13_mixing": op13_mixing,
    "pipeline": pipeline,
}

CHECKS: dict[str, str] = {"op6_chat": OP6_SQL, "op1_topk": OP1_SQL, "op8_minhash": OP8_SQL, "op11_prefix_trie": OP11_SQL, "op12_divergence": OP12_SQL, "op13_mixing": OP13_SQL}
