"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import credentials, dualtree, htmltext, imatch, jaccard, licences, mixing, nearest, packing, pii, quality, suffixes, tries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": mixing.op1,
        "op2_imatch_fingerprints": imatch.op2,
        "op3_html_blocks": htmltext.op3,
        "op4_quality_classifier": quality.op4,
        "op5_jaccard_join": jaccard.op5,
        "op6_license_scan": licences.op6,
        "op7_pack_best_fit": packing.op7,
        "op8_cross_polytope": nearest.op8,
        "op9_suffix_dedup": suffixes.op9,
        "op10_pii_surrogates": pii.op10,
        "op11_dual_tree": dualtree.op11,
        "op12_secret_ownership": credentials.op12,
        "op13_prefix_trie": tries.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mixing.OP1_SQL, "op11_dual_tree": dualtree.OP11_SQL, "op13_prefix_trie": tries.OP13_SQL}
