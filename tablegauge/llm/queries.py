"""Queries of this package and the SQL that must give the same rows."""

from __future__ import annotations

from tablegauge.llm import decontamination, language, lexical, licenses, ngrams, packing, pieces, secrets, shingles, toxicity, variants, vectors, webarchive

QUERIES = {
    "op1_wu_manber_decontamination": decontamination.op1_wu_manber_decontamination,
    "op2_sentencepiece_codec": pieces.op2_sentencepiece_codec,
    "op3_pstable_vectors": vectors.op3_pstable_vectors,
    "op4_license_sentences": licenses.op4_license_sentences,
    "op5_capture_index": webarchive.op5_capture_index,
    "op6_secret_automaton": secrets.op6_secret_automaton,
    "op7_toxic_span_field": toxicity.op7_toxic_span_field,
    "op8_minhash_forest_join": shingles.op8_minhash_forest_join,
    "op9_elias_fano_scores": ngrams.op9_elias_fano_scores,
    "op10_hierarchical_language": language.op10_hierarchical_language,
    "op11_linear_grouping": packing.op11_linear_grouping,
    "op12_best_position_search": lexical.op12_best_position_search,
    "op13_partenum_variants": variants.op13_partenum_variants,
}
ORACLE = {
    "op1_wu_manber_decontamination": decontamination.OP1_SQL,
    "op3_pstable_vectors": vectors.OP3_SQL,
    "op5_capture_index": webarchive.OP5_SQL,
    "op12_best_position_search": lexical.OP12_SQL,
}
