"""The queries of this subpackage for the driver's entry file."""

from __future__ import annotations

from . import bestfit, divergence, jaccard, language, lines, mixing, packing, suffixes, tokens, trie, urls, vectors

QUERIES = {
    "op1_language_id": language.op1,
    "op2_nearest_neighbours": vectors.op2,
    "op3_suffix_dedup": suffixes.op3,
    "op4_line_dedup": lines.op4,
    "op5_url_filter": urls.op5,
    "op6_source_mix": mixing.op6,
    "op7_top_products": vectors.op7,
    "op8_token_shards": tokens.op8,
    "op9_packing": packing.op9,
    "op10_jaccard_join": jaccard.op10,
    "op11_source_divergence": divergence.op11,
    "op12_prefix_trie": trie.op12,
    "op13_best_fit": bestfit.op13,
}

#: The other operators can't be written in SQL, or not at whole-table cost; tests compare them with brute force.
ORACLES = {
    "op6_source_mix": mixing.SQL,
    "op7_top_products": vectors.SQL,
    "op11_source_divergence": divergence.SQL,
    "op12_prefix_trie": trie.SQL,
}
