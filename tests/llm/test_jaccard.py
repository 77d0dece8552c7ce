import time

import pytest

from affinis.llm import jaccard
from affinis.llm.components import components
from affinis.llm.text import materialise
from tests.conftest import SF
from tests.llm import cases


def check(docs, rows):
    got = jaccard.near_duplicates(docs).collect()
    want = cases.jaccard_components(rows)
    assert len(got) == len(rows)
    sizes = sorted((-1 if i is None else i, len(cases.shingle_set(t))) for i, t in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"]) for r in got) == sizes
    assert all(r["component_id"] == want.get(r["doc_id"]) for r in got)


def test_odd_rows(spark):
    check(cases.documents(spark), [(i, t) for i, t, *_ in cases.texts()])


def test_empty(spark):
    assert jaccard.near_duplicates(cases.documents(spark, [])).count() == 0
    assert jaccard.one_of_each(cases.documents(spark, [])).count() == 0


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(docs, [(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize("common", [2, 10**9])
def test_any_order_and_recursion_give_the_same(spark, monkeypatch, common):
    """Chains whose ends don't link, in regions large enough for further pivots."""
    monkeypatch.setattr(jaccard, "COMMON_AT_LEAST", common)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "SLOT", 3)
    base = cases.prose(3, 150)
    rows, text = [], base
    for i in range(40):
        text = cases.changed(text, i, 2)
        rows.append((i, text if i % 3 else cases.changed(base, 100 + i, 5), "en", "a"))
    check(cases.documents(spark, rows), [(i, t) for i, t, *_ in rows])


def test_one_of_each(spark):
    docs = cases.documents(spark)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert_one_of_each(kept, cases.texts())


def assert_one_of_each(kept, rows):
    """One row, of the smallest doc_id, per component of texts; rows without words all stay."""
    component = cases.jaccard_components([(k, t) for k, (_, t, *_) in enumerate(rows)])
    best = {}
    for k, c in component.items():
        key = (rows[k][0] is None, rows[k][0] or 0)
        best[c] = min(best.get(c, (key, rows[k][0])), (key, rows[k][0]))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for _, i in best.values())


def test_one_id_for_two_texts(spark):
    """Two unrelated families that share a doc_id: one row of each stays."""
    a, b = cases.prose(1, 100), cases.prose(2, 100)
    rows = [(1, a, "en", "s"), (1, b, "en", "s"), (2, cases.changed(a, 1, 1), "en", "s"), (3, cases.changed(b, 1, 1), "en", "s"),
            (None, a, "en", "s"), (None, cases.prose(3, 50), "en", "s"), (None, cases.prose(3, 50), "en", "s")]
    kept = jaccard.one_of_each(cases.documents(spark, rows))
    assert_one_of_each(kept, rows)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "None"]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (200, 300)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {200: 200, 300: 200}


def shuffle_files(spark) -> set[str]:
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {name for k in range(blocks.size()) if (name := blocks.apply(k).toString()).startswith("shuffle_")}


def test_written_tables_leave_no_shuffle(spark):
    before = shuffle_files(spark)
    ids = spark.range(10_000)
    held = [materialise(ids.repartition(3, "id"), "ids"), components(ids.selectExpr("id a", "id div 2 b"))]
    for _ in range(100):  # files are deleted in the background
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left and held[0].count() == held[1].count() == 10_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
