from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.llm import kneser
from affinis.llm.queries import query
from affinis.llm.text import documents, read


@query("op9_kneser_ney")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(read(spark, sf_dir, "documents"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    model = kneser.fit(docs.where(~held_out))
    return kneser.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.numbers["tokens"]).cast("long").alias("train_tokens"),
        "base_score", "score")
