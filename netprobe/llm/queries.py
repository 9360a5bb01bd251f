"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from netprobe.llm import dialogue, langid, licenses, lmscore, media, mixing, neardup, packing, quality, spelling, tokenfiles, topk, urlfilter
from netprobe.llm.common import read_table


def _documents(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": _documents(licenses.query),
        "op2_language_id": _documents(langid.query),
        "op3_packing": _documents(packing.query),
        "op4_lm_scoring": _documents(lmscore.query),
        "op5_mixing": _documents(mixing.query),
        "op6_quality_rules": _documents(quality.query),
        "op7_media_columns": _documents(media.query),
        "op8_url_filter": urlfilter.query,
        "op9_token_files": _documents(tokenfiles.query),
        "op10_minhash_neardup": _documents(neardup.query),
        "op11_exact_topk": topk.query,
        "op12_spelling_variants": _documents(spelling.query),
        "op13_dialogue_repair": dialogue.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": licenses.ORACLE,
        "op6_quality_rules": quality.ORACLE,
        "op8_url_filter": urlfilter.ORACLE,
        "op11_exact_topk": topk.ORACLE,
    }
