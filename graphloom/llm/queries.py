"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, fingerprints, language_id, lexical, licenses, line_dedup, minhash_dedup, mixing, packing, quality, secrets, substring_dedup, toxicity



def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # stands beside the package and imports it

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_mixing": mixing.op4_mixing,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_language_id": language_id.op6_language_id,
    "op7_fingerprints": fingerprints.op7_fingerprints,
    "op8_packing": packing.op8_packing,
    "op9_minhash_dedup": minhash_dedup.op9_minhash_dedup,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_lexical_search": lexical.op11_lexical_search,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_tokenizer_alignment": alignment.op13_tokenizer_alignment,
    "pipeline": pipeline,
}

ORACLE_SQL = {
    "op1_secret_scan": secrets.ORACLE,
    "op2_line_dedup": line_dedup.ORACLE,
    "op3_substring_dedup": substring_dedup.ORACLE,
    "op4_mixing": mixing.ORACLE,
    "op9_minhash_dedup": minhash_dedup.ORACLE,
    "op11_lexical_search": lexical.ORACLE,
}
