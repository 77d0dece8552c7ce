import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from affinis.llm import packing
from affinis.llm.queries import query
from affinis.llm.text import read

VOCABULARY = "word_bpe_49k.json"


@query("op7_best_fit_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
