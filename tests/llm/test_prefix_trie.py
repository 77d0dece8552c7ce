import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from affinis.llm import prefix_trie
from tests.conftest import SF

SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()), *[T.StructField(c, T.StringType()) for c in "depth digest batch pre first owner".split()]])
COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def table(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 6) for r in rows], SCHEMA).repartition(3)


def brute(rows):
    """All nodes, from a dictionary of every prefix of every rebuilt conversation."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [r[2:] for r in sorted(v)] for c, v in convs.items()}
    members = defaultdict(list)
    built = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(said.get(c - c % 5, [])[:h] + said[c][h:])
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = sum(saved[q] for q in children[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    out = []
    for p, who in members.items():
        ends = ",".join(map(str, sorted(c for c in who if len(built[c]) == len(p))))
        out.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), len(children[p]), leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


def some(seed, n):
    """Conversations over few different turns, so that they branch everywhere."""
    r = random.Random(seed)
    rows = []
    for c in range(n):
        if r.random() < 0.2:
            continue
        for turn in range(r.choice([1, 1, 2, 3, 5, 8, 13, 30])):
            rows.append((c, turn, r.choice(["user", "assistant"]), r.choice(["a", "b", "é" * (turn % 3)])))
    return rows


@pytest.mark.parametrize("batch", [5, 60, 10**6])
def test_branching(spark, monkeypatch, batch):
    monkeypatch.setattr(prefix_trie, "BATCH", batch)
    rows = some(batch, 120)
    assert found(prefix_trie.prefix_trie(table(spark, rows))) == brute(rows)


def test_odd_rows(spark):
    rows = some(3, 30) + [
        (None, 1, "user", "x"), (200, None, "user", "first"), (200, 0, None, None), (200, 1, "", ""), (201, 5, "user", "only"),
        (202, 1, "user", "a"), (10**12, 0, "user", "b"), (-3, 0, "user", "b"), (-4, 7, "user", "ß \U0001f600")]
    rows += [(300, k, "user", f"t{k % 7}") for k in range(700)] + [(305, k, "user", f"t{k % 7}") for k in range(600)]
    rows += [(400 + k, 0, "system", "same") for k in range(40)] + [(205, 0, "user", "twice"), (205, 0, "user", "twice")]
    assert found(prefix_trie.prefix_trie(table(spark, rows))) == brute(rows)


def test_table(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet")
    assert found(prefix_trie.prefix_trie(rows)) == brute([tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()])


def test_empty(spark):
    assert prefix_trie.prefix_trie(table(spark, [])).count() == 0


def test_two_fattest():
    for low in range(40):
        for high in range(low + 1, 60):
            best = max(range(low + 1, high + 1), key=lambda x: x & -x)
            assert prefix_trie.two_fattest(low, high) == best


def test_exit_node_by_handles():
    """Look-ups grow with the logarithm of the length, and the exit is where a linear walk ends."""
    r = random.Random(5)
    trie, all_convs = prefix_trie.ZFastTrie(), []

    class Counted(dict):
        asked = 0

        def get(self, *a):
            Counted.asked += 1
            return dict.get(self, *a)

    trie.handles = Counted()
    for k in range(300):
        conv = prefix_trie.Rebuilt(k)
        base = r.choice(all_convs)[: r.randint(0, 200)] if all_convs else []
        said = base + [bytes([r.randrange(3)]) for _ in range(r.randint(0, 100))]
        for t in said:
            conv.add(t, 1)
        shared = max((next((i for i, (x, y) in enumerate(zip(said, other, strict=False)) if x != y), min(len(said), len(other))) for other in all_convs), default=0)
        Counted.asked = 0
        assert trie.exit_node(conv)[1] == shared
        assert Counted.asked <= max(conv.turns, 1).bit_length() + 1
        trie.insert(conv)
        all_convs.append(said)
