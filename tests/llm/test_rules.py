from collections import Counter

import pytest
from pyspark.sql import functions as F

from affinis.llm import rules
from tests.conftest import SF
from tests.llm import cases


def counted(text):
    t = text or ""
    w = t.encode().split()
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if x.encode().split()]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_counts_of_odd_rows(spark):
    docs = cases.documents(spark)
    out, name = rules.judged(docs, docs.columns)
    assert name == "quality_rules_"
    got = out.select("doc_id", "text", *[F.col(name)[f] for f in FIELDS]).collect()
    assert len(got) == len(cases.texts())
    for row in got:
        assert tuple(row[2:]) == counted(row["text"]), row["doc_id"]


def test_filter_keeps_columns_and_prose(spark):
    docs = cases.documents(spark)
    kept = rules.passing(docs)
    assert kept.schema == docs.schema or kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert not ids & {6, 7, 8, 9, 13, 14, 16} and set(range(100, 120)) <= ids
    assert rules.passing(docs.limit(0)).count() == 0


def test_large_instances_take_the_struct_path(spark, monkeypatch):
    monkeypatch.setattr(rules, "INDEX_BITS", 3)
    docs = cases.documents(spark).where("doc_id in (14, 1, 17, 16)")
    out, name = rules.judged(docs, ["text"])
    for row in out.select("text", F.col(name)["n_repeat_words"]).collect():
        assert row[1] == counted(row[0])[4]


@pytest.fixture(scope="module")
def whole(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out, name = rules.judged(docs, ["doc_id", "text"])
    return out.select("doc_id", "text", f"{name}.*").join(labels, "doc_id", "left").toPandas()


def test_counts_on_the_table(whole):
    for row in whole.itertuples():
        assert tuple(getattr(row, f) for f in FIELDS) == counted(row.text)


def test_verdicts_follow_the_labels(whole):
    labelled = whole[whole.quality.notna() & ~whole.base_failed]
    assert (labelled.kept == (labelled.quality == 1)).mean() > 0.97


def test_windows_that_agree_in_the_upper_bits_lose_no_repeat(spark, monkeypatch):
    """With few upper bits most windows of a long text mix with others in the packed order."""
    monkeypatch.setattr(rules, "INDEX_BITS", 56)
    texts = [" ".join([*cases.prose(k, 400).split(" "), *cases.prose(k, 60).split(" ")]) for k in range(5)] + [cases.prose(9, 300), "a b c " * 30]
    rows = [(k, t, "en", "a") for k, t in enumerate(texts)]
    got = {r["doc_id"]: r["m"]["words"]["n_repeat_words"] for r in cases.documents(spark, rows).select(
        "doc_id", rules.measures(F.col("text"), F.col("lang")).alias("m")).collect()}
    assert got == {k: counted(t)[4] for k, t in enumerate(texts)} and max(got.values()) > 50
