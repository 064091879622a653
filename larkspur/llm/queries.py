"""The registered queries of this subpackage and the SQL that holds them to account."""

from __future__ import annotations

from larkspur.llm import decontam, jaccard, langid, lm, mixing, packing, quality, rolling, spelling, tokens, topk, toxicity, warc


def queries() -> dict:
    return {"op1_exact_topk": topk.op1_exact_topk, "op2_mix": mixing.op2_mix, "op3_decontam": decontam.op3_decontam, "op4_toxicity": toxicity.op4_toxicity, "op5_jaccard": jaccard.op5_jaccard, "op6_token_counts": tokens.op6_token_counts, "op7_langid": langid.op7_langid, "op8_quality": quality.op8_quality, "op9_warc": warc.op9_warc, "op10_lm": lm.op10_lm, "op11_rolling_median": rolling.op11_rolling_median, "op12_spelling": spelling.op12_spelling, "op13_packing": packing.op13_packing, "token_counts_words": tokens.token_counts_words}


def oracle_sql() -> dict:
    return {"op1_exact_topk": topk.OP1_SQL, "op2_mix": mixing.OP2_SQL, "op9_warc": warc.OP9_SQL, "op11_rolling_median": rolling.OP11_SQL, "token_counts_words": tokens.WORDS_SQL}
