"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat_format, exact_dedup, fill_middle, jaccard_join, licences, mixing, neighbours, packing, prefix_trie, quality, secret_scan, token_counts, toxicity

QUERIES = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_secrets": secret_scan.op4_secrets,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_neighbours": neighbours.op6_neighbours,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_licences": licences.op8_licences,
    "op9_mixing": mixing.op9_mixing,
    "op10_packing": packing.op10_packing,
    "op11_fill_middle": fill_middle.op11_fill_middle,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_quality": quality.op13_quality,
}

#: The others can't be said in SQL, or only too slowly: they are tested against brute force.
SQL = {
    "op1_chat_format": chat_format.OP1_SQL,
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op8_licences": licences.OP8_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op11_fill_middle": fill_middle.OP11_SQL,
    "op12_prefix_trie": prefix_trie.OP12_SQL,
}
