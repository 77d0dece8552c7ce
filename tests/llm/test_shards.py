import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.llm import shards
from affinis.llm.q_shards import op3
from tests.conftest import SF
from tests.llm import cases


@pytest.mark.parametrize(("bits", "dims"), [(4, 2), (3, 3), (2, 4), (1, 3), (5, 1)])
def test_curve_visits_every_cell_by_unit_steps(bits, dims):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    at = shards.hilbert_index(cells, bits)
    assert sorted(at) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(at)], axis=0)).sum(1) == 1).all()


def check(rows, names, n):
    counts = Counter(r[names["shard"]] for r in rows)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(shards.SHARDS)) <= 1 and sum(counts.values()) == n
    for s, c in counts.items():
        assert sorted(r[names["slot"]] for r in rows if r[names["shard"]] == s) == list(range(c))
    line = sorted(rows, key=lambda r: (r[names["shard"]], r[names["slot"]]))
    assert [r[names["curve"]] for r in line] == sorted(r[names["curve"]] for r in rows)


def test_odd_rows(spark, tmp_path):
    docs = cases.documents(spark)
    out, names = shards.sharded(docs, shards.document_cells(docs))
    assert names == {"curve": "curve_", "shard": "shard_", "slot": "slot_"}
    assert set(docs.columns) < set(out.columns)
    check(out.collect(), names, len(cases.texts()))
    shards.write_shards(docs, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(cases.texts())


def test_empty_and_few(spark):
    docs = cases.documents(spark)
    for n in (0, 1, 3):
        some = docs.orderBy("doc_id").limit(n)
        out, names = shards.sharded(some, shards.document_cells(some))
        rows = out.collect()
        assert len(rows) == n
        if n:
            check(rows, names, n)


def test_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op3(spark, SF).collect()
    check(rows, {"shard": "shard", "slot": "slot", "curve": "curve"}, len(docs))
    for r in rows:
        data = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["grown_shard"], r["law"]) == (len(data) + 1, zlib.crc32(data), None, "rows")


def test_runs_are_narrow_in_every_dimension(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out, names = shards.sharded(docs, shards.document_cells(docs))
    size = shards.size_cell(shards.size_of(F.col("text")))
    spread = out.groupBy(names["shard"]).agg((F.max(size) - F.min(size)).alias("d"), F.count_distinct("lang").alias("n")).collect()
    whole = out.agg((F.max(size) - F.min(size)).alias("d"), F.count_distinct("lang").alias("n")).first()
    assert np.mean([r["d"] for r in spread]) < whole["d"] and np.mean([r["n"] for r in spread]) < whole["n"]
