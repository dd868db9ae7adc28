"""Incremental reply scoring with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from proselens.operators import replies as R

REPLY_SCHEMA = ("candidate_ord bigint, product_id string, model string, iteration int, "
                "prompt_name string, kind string, raw string")


def reply_stream(spark: SparkSession, path: str, fmt: str = "parquet", schema: str = REPLY_SCHEMA,
                 max_files: int = 100) -> DataFrame:
    """Replies arriving as files in ``path`` (schema declared, no inference)."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(fmt).load(path))


def parsed_judge_stream(replies: DataFrame) -> DataFrame:
    """Judge replies parsed into typed columns; stateless, so append mode."""
    p = R.parse_replies(replies.filter(F.col("kind") == "judge"))
    return R.judge_fields(p).drop("raw")


def parsed_factcheck_stream(replies: DataFrame) -> DataFrame:
    p = R.parse_replies(replies.filter(F.col("kind") == "factcheck"))
    return R.factcheck_fields(p).drop("raw").withColumn("hallucinated_claims", F.to_json("hallucinated_claims"))


def write_partitioned(stream: DataFrame, path: str, checkpoint: str, trigger_once: bool = False) -> StreamingQuery:
    """Append each micro-batch to a table partitioned by ``iteration``.
    The checkpoint folder must be on shared storage."""
    w = (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
         .partitionBy("iteration").outputMode("append"))
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
