from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.llm import shards
from affinis.llm.queries import query
from affinis.llm.text import read


@query("op3_hilbert_shards")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out, names = shards.sharded(docs, shards.document_cells(docs))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return out.select(
        "doc_id", shards.size_of(F.col("text")).alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"),
        F.col(names["shard"]).alias("shard"), F.col(names["slot"]).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        F.col(names["curve"]).alias("curve"))
