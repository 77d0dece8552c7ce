from pyspark.sql import DataFrame, SparkSession

from affinis.llm import repair
from affinis.llm.queries import query
from affinis.llm.text import read


@query("op11_conversation_repair")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(read(spark, sf_dir, "conversations"))
