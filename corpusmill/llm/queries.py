"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, decontaminate, html_extract, langid, license_scan, line_dedup, near_dedup, substring_dedup, topk, toxicity

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_html_extract": html_extract.op4_html_extract,
    "op5_exact_topk": topk.op5_exact_topk,
    "op6_language_id": langid.op6_language_id,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_license_scan": license_scan.op9_license_scan,
    "op10_bpe": bpe.op10_bpe,
}

ORACLES = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op5_exact_topk": topk.ORACLE,
    "op7_substring_dedup": substring_dedup.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
}
