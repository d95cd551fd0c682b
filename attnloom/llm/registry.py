"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import html_text, licenses, mixing, near_vectors, neighbours, ngram_join, packing, prefix_trie, secrets, token_files, toxicity, warc, whitening
from .oracles import ORACLES

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_embedding_near_dedup": near_vectors.op2_embedding_near_dedup,
    "op3_license_scans": licenses.op3_license_scans,
    "op4_ngram_jaccard_join": ngram_join.op4_ngram_jaccard_join,
    "op5_token_id_output": token_files.op5_token_id_output,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_html_extraction": html_text.op7_html_extraction,
    "op8_nearest_neighbours": neighbours.op8_nearest_neighbours,
    "op9_mixing_sources": mixing.op9_mixing_sources,
    "op10_secret_scans": secrets.op10_secret_scans,
    "op11_conversation_trie": prefix_trie.op11_conversation_trie,
    "op12_warc": warc.op12_warc,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
}

__all__ = ["ORACLES", "QUERIES"]
