"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import corpus_pipeline
from helixframe.llm import byte_bpe, decontaminate, exact_dedup, license_scan, lm_score, pseudonyms, quality, simhash, spelling, token_counts, token_output, toxicity

QUERIES = {
    "op1_lm_score": lm_score.op1_lm_score,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_pseudonyms": pseudonyms.op4_pseudonyms,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_quality": quality.op8_quality,
    "op9_simhash": simhash.op9_simhash,
    "op10_byte_bpe": byte_bpe.op10_byte_bpe,
    "op11_spelling": spelling.op11_spelling,
    "op12_token_output": token_output.op12_token_output,
    "pipeline": corpus_pipeline.run,
}
SQL = {"op5_decontamination": decontaminate.OP5_SQL, "op7_exact_dedup": exact_dedup.OP7_SQL}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
