"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from strandline.llm import html, importance, licenses, media, mixing, near, neighbours, packing, pii, quality, rollups, runs, simhash

QUERIES = {
    "op1_media": media.op1_media,
    "op2_licenses": licenses.op2_licenses,
    "op3_packing": packing.op3_packing,
    "op4_quality": quality.op4_quality,
    "op5_token_counts": rollups.op5_token_counts,
    "op6_mixing": mixing.op6_mixing,
    "op7_html": html.op7_html,
    "op8_neighbours": neighbours.op8_neighbours,
    "op9_near": near.op9_near,
    "op10_pii": pii.op10_pii,
    "op11_simhash": simhash.op11_simhash,
    "op12_runs": runs.op12_runs,
    "op13_importance": importance.op13_importance,
}

ORACLE_SQL = {"op6_mixing": mixing.OP6_SQL}
