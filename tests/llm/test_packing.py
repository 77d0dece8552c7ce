import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from affinis.llm import packing
from tests.conftest import SF
from tests.llm import cases

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, texts):
    tokenizer = Tokenizer.from_file(PATH)
    want = Counter()
    for doc_id, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4").tobytes()
            want[doc_id, k, at, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    filled = defaultdict(list)
    for r in rows:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in rows)
    assert len(filled) <= math.ceil(total / 2048) * 1.05 + 1


def test_odd_rows(spark):
    texts = [(i, t) for i, t, *_ in cases.texts()] + [(400, "a <|endoftext|> b<|startoftext|>c don't İΣ é")]
    docs = cases.documents(spark, [(i, t, "en", "a") for i, t in texts])
    check(packing.pack(docs, PATH).collect(), texts)
    for r in packing.pack(docs, PATH, with_ids=True).collect():
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]


def test_empty_and_table(spark):
    assert packing.pack(cases.documents(spark, []), PATH).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(packing.pack(docs, PATH).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])


def best(sizes, capacity):
    """Fewest bins, by trying every place for every piece."""
    sizes = sorted(sizes, reverse=True)
    found = len(sizes)

    def place(k, bins):
        nonlocal found
        if len(bins) >= found:
            return
        if k == len(sizes):
            found = len(bins)
            return
        for room in {b for b in bins if b + sizes[k] <= capacity}:
            i = bins.index(room)
            place(k + 1, [*bins[:i], room + sizes[k], *bins[i + 1 :]])
        place(k + 1, [*bins, sizes[k]])

    place(0, [])
    return found


@settings(deadline=None, max_examples=150)
@given(st.lists(st.integers(1, 30), max_size=9), st.integers(30, 60))
def test_fixed_sets_keep_an_optimal_packing(sizes, capacity):
    placed, sequences, fixed = packing.reduce_and_fit(dict(Counter(sizes)), capacity)
    filled, seen = defaultdict(list), Counter()
    for size, first, n, sequence, offset, each in placed:
        for k in range(n):
            filled[sequence + k // each].append((offset + k % each * size, size))
            seen[size, first + k] += 1
    assert sorted(s for (s, _), c in seen.items() for _ in range(c)) == sorted(sizes) and set(seen.values()) <= {1}
    assert sorted(filled) == list(range(sequences))
    for parts in filled.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= capacity
    rest = [size for s in range(fixed, sequences) for _, size in filled[s]]
    assert fixed + best(rest, capacity) == best(sizes, capacity)


def test_many_equal_pieces_are_one_step():
    placed, sequences, _ = packing.reduce_and_fit({1500: 10**9, 300: 3 * 10**9, 7: 10**9})
    assert len(placed) < 40 and sequences >= 10**9


def test_reduction_passes_over_lengths_without_a_dominating_set():
    """Full pieces aside, shorter lengths with exact partners are fixed although a longer one isn't."""
    counts = {90: 1, 61: 5, 39: 5, 52: 4, 48: 4, 3: 6, 2: 6}
    placed, sequences, fixed = packing.reduce_and_fit(counts, 100)
    assert fixed >= 9 and sequences * 100 >= sum(s * n for s, n in counts.items())
    used = {}
    for length, _, n, sequence, offset, each in placed:
        for k in range(n):
            used.setdefault(sequence + k // each, []).append((offset + k % each * length, length))
    assert sorted(used) == list(range(sequences))
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 100


def test_seats_are_found_without_python(spark):
    """Pieces with their ids never go through Arrow batches again; every batch of them would be 80 MB."""
    cut = spark.range(3000).selectExpr(
        "id % 700 AS doc_id", "cast(id % 5 AS int) AS piece", "id AS start", "1 + id * id % 2048 AS length", "cast(repeat('a', 8) AS binary) AS ids")
    out = packing.packed(cut)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "PythonMapInArrow" not in plan
    rows = out.collect()
    want = Counter(tuple(r) for r in cut.collect())
    assert Counter(tuple(r)[:5] for r in rows) == want
    filled = defaultdict(list)
    for r in rows:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(filled) == list(range(len(filled)))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_a_worker_remembers_for_one_operator():
    from affinis.llm.text import kept

    assert kept("first", lambda: [1]) is kept("first", lambda: [2])
    kept("second", list)
    assert kept("first", lambda: [3]) == [3]
