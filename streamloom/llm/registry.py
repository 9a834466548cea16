"""The queries of this subpackage and their SQL where there is one."""

from __future__ import annotations

from . import bpe, chat, exact, lm, minhash, mixing, toxicity, vectors, warc, wrapper

QUERIES = {
    "op1_minhash_near_dedup": minhash.query,
    "op2_warc_derivatives": warc.query,
    "op3_exact_dedup": exact.query,
    "op4_mixing": mixing.query,
    "op5_byte_bpe": bpe.query,
    "op6_chat_format": chat.query,
    "op7_embedding_near_dedup": vectors.query,
    "op8_html_extraction": wrapper.query,
    "op9_toxicity": toxicity.query,
    "op10_lm_score": lm.query,
}

SQL = {
    "op3_exact_dedup": exact.SQL,
    "op6_chat_format": chat.SQL,
}
