"""The corpus queries by name, and their SQL where DuckDB can express them."""

from . import decontaminate, language, manifest, near_dedup, neighbours, packing, periodic_runs, secret_scan, simhash_dedup, substring_dedup, token_counts, toxicity, warc

QUERIES = {
    "op1_harmonic_packing": packing.op1,
    "op2_language_bloom": language.op2,
    "op3_warc_chain": warc.op3,
    "op4_pruned_graph_search": neighbours.op4,
    "op5_minhash_near_dedup": near_dedup.op5,
    "op6_markov_secrets": secret_scan.op6,
    "op7_relative_lz_dedup": substring_dedup.op7,
    "op8_token_counts": token_counts.op8,
    "op9_simhash_decontamination": decontaminate.op9,
    "op10_pu_toxicity": toxicity.op10,
    "op11_tiled_runs": periodic_runs.op11,
    "op12_popcount_simhash": simhash_dedup.op12,
    "op13_merkle_levels": manifest.op13,
}
ORACLES: dict[str, str] = {
    "op3_warc_chain": warc.OP3_SQL,
    "op5_minhash_near_dedup": near_dedup.OP5_SQL,
    "op7_relative_lz_dedup": substring_dedup.OP7_SQL,
    "op9_simhash_decontamination": decontaminate.OP9_SQL,
    "op11_tiled_runs": periodic_runs.OP11_SQL,
    "op12_popcount_simhash": simhash_dedup.OP12_SQL,
    "op13_merkle_levels": manifest.OP13_SQL,
}
