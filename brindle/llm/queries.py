"""The registered queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from . import align, bpe, fim, fingerprints, htmltext, lm, mixing, quality, secrets, simhash, tokenstore, topk, warc

QUERIES = {
    "op1_scaled_sketch": fingerprints.op1_scaled_sketch,
    "op2_random_indexing_quality": quality.op2_random_indexing_quality,
    "op3_content_addressed_store": tokenstore.op3_content_addressed_store,
    "op4_ppm_score": lm.op4_ppm_score,
    "op5_golay_simhash": simhash.op5_golay_simhash,
    "op6_numpy_bpe": bpe.op6_numpy_bpe,
    "op7_dual_tree_top_k": topk.op7_dual_tree_top_k,
    "op8_linked_secrets": secrets.op8_linked_secrets,
    "op9_min_cut_text": htmltext.op9_min_cut_text,
    "op10_water_filling_mix": mixing.op10_water_filling_mix,
    "op11_sharded_warc": warc.op11_sharded_warc,
    "op12_token_alignment": align.op12_token_alignment,
    "op13_fill_in_middle": fim.op13_fill_in_middle,
}
SQL = {"op7_dual_tree_top_k": topk.OP7_SQL, "op10_water_filling_mix": mixing.OP10_SQL, "op11_sharded_warc": warc.OP11_SQL, "op13_fill_in_middle": fim.OP13_SQL}
