import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from affinis.llm import secrets
from affinis.llm.text import materialise, read
from tests.conftest import SF
from tests.llm import cases
from tests.llm.test_decontaminate import similar
from tests.llm.test_rules import counted
from tests.llm.test_secrets import base


def test_stages_one_by_one(spark):
    """Every stage against brute force on what the one before kept."""
    docs = read(spark, SF, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = materialise(stage(spark, docs, SF), name)
        assert docs.columns == columns
        seen[name] = before, {r["doc_id"]: r for r in docs.collect()}
    before, after = seen["quality_rules"]
    assert set(after) <= {i for i, r in before.items() if not counted(r["text"])[5]} and all(after[i] == before[i] for i in after)
    before, after = seen["jaccard_join"]
    want = cases.jaccard_components([(i, r["text"]) for i, r in before.items()])
    assert set(after) == {i for i, c in want.items() if i == c}
    before, after = seen["decontamination"]
    items = [r["text"] for r in read(spark, SF, "benchmark").collect()]
    assert set(after) == {i for i, r in before.items() if max(similar(r["text"], t) for t in items) < 0.75}
    before, after = seen["secret_scan"]
    assert set(after) == set(before)
    for i, r in after.items():
        assert not base(r["text"]) and (r["text"] == before[i]["text"]) == (secrets.MASK not in r["text"])
        assert r["n_chars"] == len(r["text"])
    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    whole = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        whole[r["doc_id"]] = whole.get(r["doc_id"], b"") + bytes(r["ids"])
    assert whole == {
        i: np.array(tokenizer.encode(r["text"], add_special_tokens=False).ids + [0], "<u4").tobytes() for i, r in after.items()}
    ran = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in ran) == sorted(
        (r["doc_id"], r["piece"], zlib.crc32(r["ids"])) for r in rows)


def test_odd_rows_and_empty_tables(spark):
    for docs in (cases.documents(spark), cases.documents(spark, [])):
        docs = materialise(docs, "odd")
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
            docs = materialise(out, name)
        docs.count()
