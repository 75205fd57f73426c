"""Queries of the numbered operators, and their SQL where SQL can express them."""

from __future__ import annotations

from sheetloom.llm import bloom_dedup, bpe, code_trie, context_tree, factor_quality, filter_audit, gif, host_trust, mixture, secret_scan, sharding, simhash, toxicity

QUERIES = {
    f.__name__: f
    for f in (
        gif.op1_gif_media,
        mixture.op2_budget_mix,
        sharding.op3_rendezvous_shards,
        simhash.op4_simhash_ball,
        toxicity.op5_toxic_segments,
        context_tree.op6_context_tree,
        bpe.op7_prefix_bpe,
        secret_scan.op8_entropy_secrets,
        host_trust.op9_host_trust,
        bloom_dedup.op10_bloom_dedup,
        filter_audit.op11_filter_audit,
        code_trie.op12_code_trie,
        factor_quality.op13_factor_quality,
    )
}

SQL = {"op9_host_trust": host_trust.OP9_SQL, "op10_bloom_dedup": bloom_dedup.OP10_SQL, "op11_filter_audit": filter_audit.OP11_SQL, "op12_code_trie": code_trie.OP12_SQL}
