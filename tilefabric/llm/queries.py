"""The operators' queries over the given tables, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, embedding_dedup, exact_dedup, hard_negatives, langid, mixing, neighbours, packing, quality, sharding, simhash, token_output, url_filter


def over(op, *tables: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return op(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables))

    return query


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # which imports the operators

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_mixing": over(mixing.op1, "documents"),
    "op2_exact_dedup": over(exact_dedup.op2, "documents"),
    "op3_embedding_dedup": over(embedding_dedup.op3, "embeddings"),
    "op4_language_id": over(langid.op4, "documents"),
    "op5_quality": over(quality.op5, "documents", "labels"),
    "op6_simhash": over(simhash.op6, "documents"),
    "op7_sharding": over(sharding.op7, "documents"),
    "op8_token_output": over(token_output.op8, "documents"),
    "op9_packing": over(packing.op9, "documents"),
    "op10_url_filter": over(url_filter.op10, "pages"),
    "op11_hard_negatives": over(hard_negatives.op11, "embeddings"),
    "op12_neighbours": over(neighbours.op12, "embeddings"),
    "op13_alignment": over(alignment.op13, "documents"),
    "pipeline": pipeline,
}
SQL = {"op2_exact_dedup": exact_dedup.OP2_SQL, "op7_sharding": sharding.op7_sql(), "op10_url_filter": url_filter.OP10_SQL, "op11_hard_negatives": hard_negatives.OP11_SQL}
