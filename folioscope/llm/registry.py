"""Queries of the corpus operators, and their SQL where there is one."""

from __future__ import annotations

from folioscope.llm import crosstoken, decontam, langid, licenses, mixing, nearest, pitman_yor, simhash, syncmers, token_ids, toxicity, warc, whitening

QUERIES = {
    "op1_decontamination": decontam.op1_decontamination,
    "op2_language_id": langid.op2_language_id,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_lm_scoring": pitman_yor.op4_lm_scoring,
    "op5_simhash_near_dedup": simhash.op5_simhash_near_dedup,
    "op6_token_ids": token_ids.op6_token_ids,
    "op8_syncmer_fingerprints": syncmers.op8_syncmer_fingerprints,
    "op7_warc": warc.op7_warc,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_mixing": mixing.op10_mixing,
    "op11_nearest": nearest.op11_nearest,
    "op12_whitening": whitening.op12_whitening,
    "op13_crosstoken": crosstoken.op13_crosstoken,
}

SQL = {
    "op7_warc": warc.SQL,
    "op10_mixing": mixing.SQL,
}


def queries():
    """Query functions by name."""
    return dict(QUERIES)


def oracle_sql():
    """SQL by query name."""
    return dict(SQL)
