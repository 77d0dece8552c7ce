from pyspark.sql import DataFrame, SparkSession

from affinis.llm import jaccard
from affinis.llm.queries import query
from affinis.llm.text import read


@query("op4_jaccard_join")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read(spark, sf_dir, "documents"))
