"""The queries of the corpus operators and their DuckDB counterparts."""

from __future__ import annotations

from docloom.llm import embeddings, jaccard, licenses, media, mixing, negatives, packing, phrases, pieces, quality, secrets, suffixes, toxicity

QUERIES = {
    "op1_suffix_array": suffixes.query,
    "op2_sentencepiece": pieces.query,
    "op3_secret_scan": secrets.query,
    "op4_embedding_neardup": embeddings.query,
    "op5_ngram_jaccard": jaccard.query,
    "op6_license_scan": licenses.query,
    "op7_matroska": media.query,
    "op8_toxicity": toxicity.query,
    "op9_source_mixing": mixing.query,
    "op10_quality": quality.query,
    "op11_packing": packing.query,
    "op12_collocations": phrases.query,
    "op13_hard_negatives": negatives.query,
}
ORACLES = {
    "op6_license_scan": licenses.ORACLE,
    "op9_source_mixing": mixing.ORACLE,
    "op12_collocations": phrases.ORACLE,
    "op13_hard_negatives": negatives.ORACLE,
}
