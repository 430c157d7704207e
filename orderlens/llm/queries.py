"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import ann, chat, decontam, divergence, langid, line_dedup, mixing, pii, quality_rules, simhash, url_filter, warc, whitening

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_simhash": simhash.op2_simhash,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_pii": pii.op4_pii,
    "op5_language_id": langid.op5_language_id,
    "op6_chat": chat.op6_chat,
    "op7_nearest": ann.op7_nearest,
    "op8_decontamination": decontam.op8_decontamination,
    "op9_mixing": mixing.op9_mixing,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_whitening": whitening.op11_whitening,
    "op12_divergence": divergence.op12_divergence,
    "op13_quality_rules": quality_rules.op13_quality_rules,
}

ORACLE_SQL = {
    "op1_warc": warc.ORACLE,
    "op9_mixing": mixing.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
    "op12_divergence": divergence.ORACLE,
    "op13_quality_rules": quality_rules.ORACLE,
}
