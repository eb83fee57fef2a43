"""Queries and SQL of this subpackage, for the entry module."""

from . import hpylm, idfile, langid, minhash, mix, neighbours, pack, phrases, pii, substring, toxicity, vecdedup


def queries() -> dict:
    return {
        "op1_language_id": langid.op1,
        "op2_toxicity": toxicity.op2,
        "op3_mix_sources": mix.op3,
        "op4_personal_data": pii.op4,
        "op5_best_fit_packing": pack.op5,
        "op6_language_model": hpylm.op6,
        "op7_minhash_near_dedup": minhash.op7,
        "op8_substring_dedup": substring.op8,
        "op9_nearest_neighbours": neighbours.op9,
        "op10_vector_near_dedup": vecdedup.op10,
        "op11_phrases": phrases.op11,
        "op12_token_id_files": idfile.op12,
    }


def oracle_sql() -> dict:
    return {
        "op3_mix_sources": mix.SQL,
        "op7_minhash_near_dedup": minhash.SQL,
        "op8_substring_dedup": substring.SQL,
        "op9_nearest_neighbours": neighbours.SQL,
        "op10_vector_near_dedup": vecdedup.SQL,
        "op11_phrases": phrases.SQL,
    }
