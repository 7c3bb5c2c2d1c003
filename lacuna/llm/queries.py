"""The registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from lacuna.llm import bpe, chosen_path, divergence, grid_join, hard_negatives, lattice_lm, line_dedup, mixing, ordering, quality, secret_scan, shuffle, toxicity

QUERIES = {
    "op1_training_order": ordering.query,
    "op2_grid_order_join": grid_join.query,
    "op3_quality_outliers": quality.query,
    "op4_toxicity_rnn": toxicity.query,
    "op5_byte_bpe": bpe.query,
    "op6_external_shuffle": shuffle.query,
    "op7_chosen_path_join": chosen_path.query,
    "op8_source_mixing": mixing.query,
    "op9_line_dedup": line_dedup.query,
    "op10_lattice_lm": lattice_lm.query,
    "op11_hard_negatives": hard_negatives.query,
    "op12_source_divergence": divergence.query,
    "op13_ownership_secrets": secret_scan.query,
}
ORACLES = {
    "op2_grid_order_join": grid_join.SQL,
    "op7_chosen_path_join": chosen_path.SQL,
    "op8_source_mixing": mixing.SQL,
    "op9_line_dedup": line_dedup.SQL,
    "op11_hard_negatives": hard_negatives.SQL,
    "op12_source_divergence": divergence.SQL,
    "op13_ownership_secrets": secret_scan.SQL,
}
