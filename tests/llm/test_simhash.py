import random

import numpy as np
import pytest
import xxhash

from affinis.llm import simhash
from tests.conftest import SF
from tests.llm import cases


def brute_fingerprint(text) -> int:
    w = cases.words(text)
    if not w:
        return 0
    grams = [b" ".join(w[k : k + 3]) for k in range(max(len(w) - 2, 1))]
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    """doc_id, fingerprint, component_id of every row, by comparing all pairs."""
    prints = [brute_fingerprint(t) for _, t in rows]
    return with_components([i for i, _ in rows], prints)


def with_components(ids, prints):
    distinct = sorted(set(prints))
    x = np.array(distinct, np.uint64)
    label = list(range(len(x)))

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    for k in range(len(x)):
        for m in np.flatnonzero(np.bitwise_count(x ^ x[k]) <= 2).tolist():
            a, b = find(k), find(m)
            label[max(a, b)] = min(a, b)
    least = {}
    where = {f: find(k) for k, f in enumerate(distinct)}
    for i, f in zip(ids, prints, strict=True):
        if i is not None:
            least[where[f]] = min(i, least.get(where[f], i))
    return sorted((str(i), f"{f:016x}", str(least.get(where[f]))) for i, f in zip(ids, prints, strict=True))


def found(df):
    assert df.columns == ["doc_id", "fingerprint", "component_id"]
    return sorted((str(r[0]), r[1], str(r[2])) for r in df.collect())


def test_odd_rows(spark):
    rows = [(i, t) for i, t, *_ in cases.texts()]
    assert found(simhash.near_duplicates(cases.documents(spark))) == brute(rows)


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert found(simhash.near_duplicates(docs)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_empty(spark):
    assert simhash.near_duplicates(cases.documents(spark, [])).count() == 0


def test_a_text_longer_than_a_chunk(monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 7)
    text = cases.prose(4, 200)
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


@pytest.mark.parametrize("cell", [3, 10**6])
def test_every_pair_within_the_radius(spark, monkeypatch, cell):
    """Families of fingerprints around random centres, chains among them, in cells of one and of many slots."""
    monkeypatch.setattr(simhash, "CELL", cell)
    monkeypatch.setattr(simhash, "SMALL", 4)
    monkeypatch.setattr(simhash, "TILE", 5)
    monkeypatch.setattr(simhash, "GATHERED", 50)
    r = random.Random(1)
    prints = [0, (1 << 64) - 1, 1, 3, 7]
    for _ in range(30):
        at = r.getrandbits(64)
        for _ in range(r.randint(1, 25)):
            prints.append(at)
            for b in r.sample(range(64), r.randint(1, 4)):
                at ^= 1 << b
    nodes = spark.createDataFrame([(i, f - (f >> 63 << 64)) for i, f in enumerate(dict.fromkeys(prints))], "id long, fp long")
    joined = simhash.components(simhash.links(nodes, 4)).select("node.id", "label.id").collect()
    got = {n: label for n, label in joined}
    want = {int(i): int(c) for i, _, c in with_components(list(range(len(set(prints)))), list(dict.fromkeys(prints)))}
    assert {i: got.get(i, i) for i in want} == want
    assert len(set(want.values())) < len(want)


def test_fingerprints_beyond_the_radius_are_not_linked(spark):
    far = spark.createDataFrame([(1, 0), (2, 0b111), (3, 0b111 << 20)], "id long, fp long")
    assert simhash.links(far, 2).count() == 0
