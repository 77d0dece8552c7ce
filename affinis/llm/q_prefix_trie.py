from pyspark.sql import DataFrame, SparkSession

from affinis.llm import prefix_trie
from affinis.llm.queries import query
from affinis.llm.text import read


@query("op12_prefix_trie")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"))
