from pyspark.sql import DataFrame, SparkSession

from affinis.llm import simhash
from affinis.llm.queries import query
from affinis.llm.text import read


@query("op13_simhash_near_dedup")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))
