"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import bpe, centroids, collocations, exact, html, neardup, neighbours, packing, quality, sharding, substrings, tokenfiles, warc

QUERIES = {
    "op1_sharding": sharding.query,
    "op2_best_fit_packing": packing.query,
    "op3_block_neighbours": neighbours.query,
    "op4_quality_knn": quality.query,
    "op5_warc": warc.query,
    "op6_byte_bpe": bpe.query,
    "op7_token_files": tokenfiles.query,
    "op8_exact_dedup": exact.query,
    "op9_html_text": html.query,
    "op10_minhash_near_dedup": neardup.query,
    "op11_ball_kmeans": centroids.query,
    "op12_substring_dedup": substrings.query,
    "op13_collocations": collocations.query,
}
ORACLES = {"op5_warc": warc.ORACLE, "op3_block_neighbours": neighbours.ORACLE, "op8_exact_dedup": exact.ORACLE, "op10_minhash_near_dedup": neardup.ORACLE, "op11_ball_kmeans": centroids.ORACLE, "op12_substring_dedup": substrings.ORACLE, "op13_collocations": collocations.ORACLE}
