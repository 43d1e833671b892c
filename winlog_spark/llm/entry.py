"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import audit, ctw, dedup, kdtree, langid, mixing, neardup, packing, quality, setjoin, sharding, substring, vectors

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_exact_dedup": dedup.op2_exact_dedup,
    "op3_quality": quality.op3_quality,
    "op4_mix": mixing.op4_mix,
    "op5_lm": ctw.op5_lm,
    "op6_topk": kdtree.op6_topk,
    "op7_sharding": sharding.op7_sharding,
    "op8_passages": substring.op8_passages,
    "op8_substring": substring.op8_substring,
    "op9_langid": langid.op9_langid,
    "op10_neardup": neardup.op10_neardup,
    "op11_codes": vectors.op11_codes,
    "op12_setjoin": setjoin.op12_setjoin,
    "op13_audit": audit.op13_audit,
}

#: Packing, quality, language-model scores and language ID have no SQL; tests hold them against brute force or held-out rows.
SQL = {
    "op2_exact_dedup": dedup.OP2_SQL,
    "op4_mix": mixing.OP4_SQL,
    "op6_topk": kdtree.OP6_SQL,
    "op7_sharding": sharding.OP7_SQL,
    "op8_passages": substring.OP8_PASSAGES_SQL,
    "op8_substring": substring.OP8_SQL,
    "op10_neardup": neardup.OP10_SQL,
    "op11_codes": vectors.OP11_SQL,
    "op12_setjoin": setjoin.OP12_SQL,
    "op13_audit": audit.OP13_SQL,
}
