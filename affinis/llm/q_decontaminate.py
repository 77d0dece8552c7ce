from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.llm import decontaminate
from affinis.llm.queries import query
from affinis.llm.text import read


@query("op2_decontaminate")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.withColumn("similarity", F.round("similarity", 6))
