"""The queries and oracle SQL of the corpus operators, for the registry in __spark_entry__."""

from __future__ import annotations

from . import centroid_clustering, exact_dedup, license_scan, mixing, ngram_join, packing, periodic_runs, personal_data, quality_classifier, quality_rules, sharding, substring_dedup, url_filter

MODULES = {
    "op1_packing": packing,
    "op2_quality_classifier": quality_classifier,
    "op3_ngram_join": ngram_join,
    "op4_quality_rules": quality_rules,
    "op5_substring_dedup": substring_dedup,
    "op6_license_scan": license_scan,
    "op7_mixing": mixing,
    "op8_sharding": sharding,
    "op9_personal_data": personal_data,
    "op10_exact_dedup": exact_dedup,
    "op11_periodic_runs": periodic_runs,
    "op12_centroid_clustering": centroid_clustering,
    "op13_url_filter": url_filter,
}


def queries() -> dict:
    return {name: module.query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for name, module in MODULES.items() if module.SQL}
