from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.llm import quality
from affinis.llm.queries import query
from affinis.llm.text import materialise, read


@query("op1_quality_classifier")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = materialise(quality.described(read(spark, sf_dir, "documents")), "statistics")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    classifier = quality.fit(features, read(spark, sf_dir, "labels"), ~held_out)
    return quality.score(features, classifier).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
