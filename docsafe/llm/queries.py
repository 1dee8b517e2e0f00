"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docsafe.llm import html_extract, license_scan, media, minhash, mixing, packing, quality_rules, sharding, substring, warc


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_warc": warc.op2_warc,
        "op3_license_scan": license_scan.op3_license_scan,
        "op4_media_columns": media.op4_media_columns,
        "op5_packing": packing.op5_packing,
        "op6_sharding": sharding.op6_sharding,
        "op7_minhash_near_dedup": minhash.op7_minhash_near_dedup,
        "op8_html_extraction": html_extract.op8_html_extraction,
        "op9_mixing": mixing.op9_mixing,
        "op10_substring_dedup": substring.op10_substring_dedup,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": warc.OP2_SQL, "op7_minhash_near_dedup": minhash.OP7_SQL, "op9_mixing": mixing.OP9_SQL, "op10_substring_dedup": substring.OP10_SQL}
