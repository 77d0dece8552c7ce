import random

import pytest

from affinis.llm import spans
from tests.llm import cases


def words(seed, n, stop=None):
    """``n`` words; with ``stop`` a full stop after every so many."""
    r = random.Random(seed)
    out = ["".join(r.choices("bcdfglmnprst", k=6)) for _ in range(n)]
    return [w + "." if stop and k % stop == stop - 1 else w for k, w in enumerate(out)]


def lost(spark, passage, before=(3, 7), joined=" "):
    """Share of the passage's words that the second of two documents loses."""
    rows = []
    for i, n in enumerate(before):
        text = joined.join(["A" + w for w in words(100 + i, n)] + passage + ["z" + w for w in words(200 + i, 9)])
        rows.append((i, text, "en", "a"))
    texts = {r["doc_id"]: r["text"] for r in spans.without_repeats(cases.documents(spark, rows)).collect()}
    assert texts[0] == rows[0][1]
    left = set(texts[1].split())
    assert all(w in left for w in rows[1][1].split() if w[0] in "Az")
    return sum(w not in left for w in passage) / len(passage)


@pytest.mark.parametrize("stop,n", [(None, 90), (None, 51), (20, 60), (33, 98), (17, 51), (5, 51)])
def test_passages_mid_sentence(spark, stop, n):
    assert lost(spark, words(0, n, stop)) * n >= spans.MIN_WORDS


def test_short_lines(spark):
    lines = [" ".join(words(k, 3)) for k in range(30)]
    assert lost(spark, [w for line in lines for w in line.split()], joined=" ") > 0
    rows = [(i, "\n".join([f"own line {i}", *lines, f"last one {i}"]), "en", "a") for i in range(2)]
    got = {r["doc_id"]: r["text"] for r in spans.without_repeats(cases.documents(spark, rows)).collect()}
    assert got[0] == rows[0][1] and got[1].split() == "own line 1 last one 1".split()


@pytest.mark.parametrize("stop", [None, 4, 13, 20, 21, 45, (3, 30)])
def test_any_51_words_hold_a_run(stop):
    for seed in range(60):
        r = random.Random(seed)
        passage = words(seed, 51, r.randint(*stop) if isinstance(stop, tuple) else stop)
        found = []
        for k in range(2):
            text = " ".join([*words(1000 + 2 * seed + k, r.randint(0, 70)), *passage, *words(5000 + 2 * seed + k, r.randint(0, 70))])
            cut = spans.sentences(text)
            assert max(p[2] for p in cut) <= spans.CUT_WORDS or stop
            found.append({tuple(p[3] for p in cut[a:b]) for a, b in spans.shortest_runs([p[2] for p in cut])})
        assert found[0] & found[1]


def test_every_piece_of_a_common_sequence_is_covered():
    r = random.Random(3)
    for _ in range(300):
        inner = [r.randint(1, 9) for _ in range(r.randint(2, 9))]
        if sum(inner) < spans.MIN_WORDS:
            continue
        runs = spans.shortest_runs([4, *inner, 4])
        inside = [x for x in runs if x[0] >= 1 and x[1] <= len(inner) + 1]
        assert {k for a, b in inside for k in range(a, b)} == set(range(1, len(inner) + 1))
