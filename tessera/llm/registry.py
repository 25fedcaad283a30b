"""Queries of the corpus operators, and SQL where it can say the same."""

from __future__ import annotations

from tessera.llm import bpe, langid, line_crf, lm, mixing, mtree, pii, quality_rules, simhash, warc


def queries():
    return {"op1_quality_rules": quality_rules.op1_quality_rules, "op2_simhash": simhash.op2_simhash, "op3_warc_index": warc.op3_warc_index, "op4_mtree_top_k": mtree.op4_mtree_top_k, "op5_pii": pii.op5_pii, "op6_line_crf": line_crf.op6_line_crf, "op7_byte_bpe": bpe.op7_byte_bpe, "op8_language_id": langid.op8_language_id, "op9_lm_scores": lm.op9_lm_scores, "op10_mix": mixing.op10_mix}


def oracle_sql():
    return {"op1_quality_rules": quality_rules.OP1_SQL, "op3_warc_index": warc.OP3_SQL, "op4_mtree_top_k": mtree.OP4_SQL, "op10_mix": mixing.OP10_SQL}
