"""Queries of this subpackage and their SQL; __spark_entry__ adds them if the subpackage is there."""

from framequill.llm import collocations, exact_dedup, hard_negatives, language_id, mixing, near_dedup, ngram_lm, packing, quality, simhash, substring_dedup, syncmers, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_entropy_mix": mixing.op3_entropy_mix,
    "op4_closed_syncmers": syncmers.op4_closed_syncmers,
    "op5_warc_fixity": warc.op5_warc_fixity,
    "op6_bloom_lm": ngram_lm.op6_bloom_lm,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_ordinal_quality": quality.op8_ordinal_quality,
    "op9_language_id": language_id.op9_language_id,
    "op10_minhash_near_dedup": near_dedup.op10_minhash_near_dedup,
    "op11_golay_simhash": simhash.op11_golay_simhash,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_collocations": collocations.op13_collocations,
}
SQL = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op5_warc_fixity": warc.OP5_SQL,
    "op10_minhash_near_dedup": near_dedup.OP10_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
