from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.llm import rules
from affinis.llm.queries import query
from affinis.llm.text import read


@query("op6_quality_rules")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out, name = rules.judged(docs, ["doc_id"])
    r = F.col(name)
    return out.select(
        "doc_id", r["n_words"].alias("n_words"), r["word_chars"].alias("word_chars"), r["n_symbols"].alias("n_symbols"),
        r["n_dup_lines"].alias("n_dup_lines"), r["n_repeat_words"].alias("n_repeat_words"), r["base_failed"].alias("base_failed"),
        r["kept"].alias("kept"), F.round(r["char_distance"], 6).alias("char_distance"),
        F.round(r["word_distance"], 6).alias("word_distance"))
