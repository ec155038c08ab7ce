"""One query an operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from loomgrid.llm import brown, decontam, html_extract, langid, packing, pii, quality, simhash, simple8b, toxicity

QUERIES = {
    "op1_html_line_blocks": html_extract.query,
    "op2_best_fit_packing": packing.query,
    "op3_pii_anchor_expansion": pii.query,
    "op4_brown_perplexity": brown.query,
    "op5_toxicity_ftrl": toxicity.query,
    "op6_simhash_near_dedup": simhash.query,
    "op7_language_id": langid.query,
    "op8_decontamination": decontam.query,
    "op9_quality_cascade": quality.query,
    "op10_simple8b_tokens": simple8b.query,
}
SQL = {"op1_html_line_blocks": html_extract.sql(), "op9_quality_cascade": quality.sql()}
