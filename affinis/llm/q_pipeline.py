import corpus_pipeline
from affinis.llm.queries import query

query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
