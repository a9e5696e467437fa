"""The queries of this subpackage, one per operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from courtside.llm import (
    alignment,
    bytepairs,
    decontam,
    htmlmain,
    linededup,
    pieces,
    quality,
    secretscan,
    simhash,
    tokencounts,
    toxicity,
    turnrepair,
    urlrules,
)

QUERIES = {
    "op1_simhash": simhash.query,
    "op2_token_counts": tokencounts.query,
    "op3_line_dedup": linededup.query,
    "op4_html_text": htmlmain.query,
    "op5_secrets": secretscan.query,
    "op6_url_filters": urlrules.query,
    "op7_toxicity": toxicity.query,
    "op8_pieces": pieces.query,
    "op9_decontamination": decontam.query,
    "op10_quality_rules": quality.query,
    "op11_turn_repair": turnrepair.query,
    "op12_byte_pairs": bytepairs.query,
    "op13_alignment": alignment.query,
}
SQL = {"op6_url_filters": urlrules.SQL}
