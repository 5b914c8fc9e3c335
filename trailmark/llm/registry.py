"""The queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from trailmark.llm import bpe, lexical, mixing, ngram_join, packing, prefix_trie, quality, suffix_dedup, telephony, topk, toxicity, warc, wrapper

QUERIES = {
    "op7_wrapper_induction": wrapper.op7_wrapper_induction,
    "op4_suffix_array_dedup": suffix_dedup.op4_suffix_array_dedup,
    "op1_ngram_jaccard_join": ngram_join.op1_ngram_jaccard_join,
    "op6_ffd_packing": packing.op6_ffd_packing,
    "op9_toxicity_crf": toxicity.op9_toxicity_crf,
    "op8_quality_ftrl": quality.op8_quality_ftrl,
    "op5_pivot_topk": topk.op5_pivot_topk,
    "op2_warc_capture_index": warc.op2_warc_capture_index,
    "op3_telephony_media": telephony.op3_telephony_media,
    "op10_pareto_mix": mixing.op10_pareto_mix,
    "op11_speculative_bpe": bpe.op11_speculative_bpe,
    "op12_heavy_path_trie": prefix_trie.op12_heavy_path_trie,
    "op13_quantised_search": lexical.op13_quantised_search,
}
ORACLES = {
    "op1_ngram_jaccard_join": ngram_join.ORACLE,
    "op5_pivot_topk": topk.ORACLE,
    "op2_warc_capture_index": warc.ORACLE,
    "op10_pareto_mix": mixing.ORACLE,
    "op12_heavy_path_trie": prefix_trie.ORACLE,
    "op13_quantised_search": lexical.ORACLE,
}
