"""The operators of this subpackage as queries over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnsieve.llm.decontaminate import op10_benchmark_decontamination
from tarnsieve.llm.host_rules import OP9_SQL, op9_host_quality_rules
from tarnsieve.llm.host_suffixes import OP3_SQL, op3_html_extraction
from tarnsieve.llm.language_crf import op5_language_id
from tarnsieve.llm.minhash import op7_minhash_near_dedup
from tarnsieve.llm.mixing import op4_mixing_to_target_weights
from tarnsieve.llm.quality_cnn import op1_quality_classifier
from tarnsieve.llm.secrets import OP2_SQL, op2_secret_scan
from tarnsieve.llm.sharding import op8_sharding
from tarnsieve.llm.warc import OP6_SQL, op6_warc_index_first


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_secret_scan,
        op3_html_extraction,
        op4_mixing_to_target_weights,
        op5_language_id,
        op6_warc_index_first,
        op7_minhash_near_dedup,
        op8_sharding,
        op9_host_quality_rules,
        op10_benchmark_decontamination,
        pipeline,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_secret_scan": OP2_SQL,
    "op3_html_extraction": OP3_SQL,
    "op6_warc_index_first": OP6_SQL,
    "op9_host_quality_rules": OP9_SQL,
}
