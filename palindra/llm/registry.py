"""The queries of this subpackage by name."""

from __future__ import annotations

from palindra.llm import chat, embedding, html_text, langid, lattice, merkle, mixing, negatives, sharding, simhash, suffix, topk, vantage

QUERIES = {
    "op1_sentencepiece": lattice.op1_sentencepiece,
    "op2_mixing": mixing.op2_mixing,
    "op3_chat": chat.op3_chat,
    "op4_embedding": embedding.op4_embedding,
    "op5_html": html_text.op5_html,
    "op6_topk": topk.op6_topk,
    "op7_suffix": suffix.op7_suffix,
    "op8_simhash": simhash.op8_simhash,
    "op9_sharding": sharding.op9_sharding,
    "op10_langid": langid.op10_langid,
    "op11_merkle": merkle.op11_merkle,
    "op12_negatives": negatives.op12_negatives,
    "op13_vantage": vantage.op13_vantage,
}
ORACLES: dict[str, str] = {"op3_chat": chat.ORACLE, "op4_embedding": embedding.ORACLE, "op6_topk": topk.ORACLE, "op10_langid": langid.ORACLE, "op11_merkle": merkle.ORACLE, "op12_negatives": negatives.ORACLE}
