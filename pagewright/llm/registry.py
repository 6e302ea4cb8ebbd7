"""The queries of this subpackage, with DuckDB SQL where it can express them."""

from __future__ import annotations

from . import ctw, fim, lines, minhash, mixing, packing, quality, ranking, secrets, substrings, tiff, vectors, warc


def queries() -> dict:
    return {
        "op1_tiff_pages": tiff.op1_tiff_pages,
        "op2_context_tree_scores": ctw.op2_context_tree_scores,
        "op3_minhash_near_dedup": minhash.op3_minhash_near_dedup,
        "op4_credential_links": secrets.op4_credential_links,
        "op5_warc_transactions": warc.op5_warc_transactions,
        "op6_segment_line_dedup": lines.op6_segment_line_dedup,
        "op7_pca_vector_dedup": vectors.op7_pca_vector_dedup,
        "op8_quality_ranking": quality.op8_quality_ranking,
        "op9_bin_slack_packing": packing.op9_bin_slack_packing,
        "op10_source_mix": mixing.op10_source_mix,
        "op11_max_tree_search": ranking.op11_max_tree_search,
        "op12_fill_in_middle": fim.op12_fill_in_middle,
        "op13_suffix_array_dedup": substrings.op13_suffix_array_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_minhash_near_dedup": minhash.OP3_SQL,
        "op4_credential_links": secrets.OP4_SQL,
        "op5_warc_transactions": warc.OP5_SQL,
        "op6_segment_line_dedup": lines.OP6_SQL,
        "op7_pca_vector_dedup": vectors.OP7_SQL,
        "op10_source_mix": mixing.OP10_SQL,
        "op11_max_tree_search": ranking.OP11_SQL,
        "op12_fill_in_middle": fim.OP12_SQL,
        "op13_suffix_array_dedup": substrings.OP13_SQL,
    }
