from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.llm import spans
from affinis.llm.queries import query
from affinis.llm.text import read


@query("op5_sentence_spans")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = spans.repeats(read(spark, sf_dir, "documents"), whole=True)
    ranges = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return lost.select("doc_id", F.col("n_spans").cast("long").alias("n_spans"), F.col("n_chars").cast("long").alias("n_chars"), ranges.alias("removed"))
