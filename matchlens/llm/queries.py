"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import dualtree, licenses, linededup, mixing, packing, pii, quality, simhash, suffixdedup, topk, urlfilter, windows, yinyang


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": simhash.query,
        "op2_packing": packing.query,
        "op3_licenses": licenses.query,
        "op4_line_dedup": linededup.query,
        "op5_topk": topk.query,
        "op6_pii": pii.query,
        "op7_url_filter": urlfilter.query,
        "op8_mixing": mixing.query,
        "op9_suffix_dedup": suffixdedup.query,
        "op10_quality": quality.query,
        "op11_mixture_packing": windows.query,
        "op12_code_compression": yinyang.query,
        "op13_dual_tree": dualtree.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": linededup.ORACLE_SQL, "op5_topk": topk.ORACLE_SQL, "op12_code_compression": yinyang.ORACLE_SQL, "op13_dual_tree": dualtree.ORACLE_SQL}
