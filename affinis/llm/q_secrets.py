from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.llm import secrets
from affinis.llm.queries import query
from affinis.llm.text import read


@query("op10_secret_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans, name = secrets.found(read(spark, sf_dir, "documents"), ["doc_id"])
    of = lambda kind: F.size(F.filter(name, lambda s: s["kind"] == kind)).cast("long")
    base = F.filter(name, lambda s: s["kind"] < 3)
    return spans.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col(name)).alias("spans"))
