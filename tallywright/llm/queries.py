"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from . import jaccard, langid, mixing, packing, passages, quality, secrets, simhash, topk, warc

QUERIES = {
    "op1_ngram_jaccard": jaccard.op1_ngram_jaccard,
    "op2_substring_dedup": passages.op2_substring_dedup,
    "op3_top_k": topk.op3_top_k,
    "op4_simhash": simhash.op4_simhash,
    "op5_pack_documents": packing.op5_pack_documents,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_quality": quality.op7_quality,
    "op8_warc": warc.op8_warc,
    "op9_language": langid.op9_language,
    "op10_secrets": secrets.op10_secrets,
}

#: op1's SQL meets every pair that shares a shingle: it is for tables of up to some thousand documents.
ORACLE_SQL = {
    "op1_ngram_jaccard": jaccard.OP1_SQL,
    "op3_top_k": topk.OP3_SQL,
    "op6_mix_sources": mixing.OP6_SQL,
    "op8_warc": warc.OP8_SQL,
}
