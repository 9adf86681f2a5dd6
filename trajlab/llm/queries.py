"""The queries of this subpackage and, where SQL can state them, the same in DuckDB SQL."""

from trajlab.llm import decontaminate, factor_machine, line_dedup, lm_score, manifest, near_dedup, pieces, quality, repair, substring_dedup, suffix_dedup, token_files, warc

QUERIES = {
    "op2_pieces": pieces.op2_pieces,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op7_lm_scoring": lm_score.op7_lm_scoring,
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op3_quality_rules": quality.op3_quality_rules,
    "op5_token_files": token_files.op5_token_files,
    "op9_warc": warc.op9_warc,
    "op10_decontamination": decontaminate.op10_decontamination,
    "op11_manifest": manifest.op11_manifest,
    "op12_quality_classifier": factor_machine.op12_quality_classifier,
    "op13_conversation_repair": repair.op13_conversation_repair,
}

SQL = {
    "op6_line_dedup": line_dedup.OP6_SQL,
    "op4_near_dedup": near_dedup.OP4_SQL,
    "op1_suffix_dedup": suffix_dedup.OP1_SQL,
    "op8_substring_dedup": substring_dedup.OP8_SQL,
    "op9_warc": warc.OP9_SQL,
    "op10_decontamination": decontaminate.OP10_SQL,
    "op11_manifest": manifest.OP11_SQL,
    "op13_conversation_repair": repair.OP13_SQL,
}
