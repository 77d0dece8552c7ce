from affinis.llm import decontaminate
from tests.conftest import SF
from tests.llm import cases
from tests.llm.test_decontaminate_short import similar


def test_odd_rows(spark):
    item = cases.prose(77, 60)
    edited = item.split(" ")
    edited[10], edited[11] = "other", "words"
    rows = cases.texts() + [
        (300, "before it " + item.upper() + " after it", "en", "a"), (301, " ".join(edited) + " and more", "en", "a"),
        (302, cases.changed(item, 1, 30), "en", "a"), (303, "so one two three four", "en", "a")]
    benchmark = spark.createDataFrame(
        [(1, item, "x"), (2, None, "x"), (3, "", "x"), (None, "one two three", "x"), (5, item, "x"), (5, cases.prose(9, 30), "x")],
        "item_id long, text string, doc_id string")
    got = decontaminate.leaks(cases.documents(spark, rows), benchmark)
    found = sorted((str(r["doc_id"]), str(r["item_id"]), round(r["similarity"], 9)) for r in got.collect())
    want = sorted(
        (str(i), str(r["item_id"]), round(s, 9)) for i, t, *_ in rows for r in benchmark.collect() if (s := similar(t, r["text"])) >= 0.75)
    assert found == want and ("300", "1", 1.0) in found and any(f[0] == "301" for f in found)
    kept = decontaminate.clean(cases.documents(spark, rows), benchmark)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, *_ in rows} - {int(f[0]) for f in found if f[0] != "None"}


def test_empty(spark):
    benchmark = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    docs = cases.documents(spark)
    assert decontaminate.leaks(docs.limit(0), benchmark).count() == 0
    assert decontaminate.leaks(docs, benchmark.limit(0)).count() == 0


def test_table_and_blocks(spark, monkeypatch):
    docs, benchmark = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    items = benchmark.collect()
    want = {(d["doc_id"], b["item_id"]) for d in docs.collect() for b in items if similar(d["text"], b["text"]) >= 0.75}
    assert want
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, benchmark).collect()} == want
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 15)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, benchmark).collect()} == want
