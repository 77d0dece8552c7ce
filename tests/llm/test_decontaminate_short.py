from collections import Counter

import pytest

from affinis.llm import decontaminate
from tests.llm import cases


def similar(text, item):
    """Best weighted similarity of an item-sized window, or of all of a shorter text."""
    w, b = cases.words(text), cases.words(item)
    if not w or not b:
        return 0.0
    width = min(5, len(b))
    grams = lambda x: Counter(tuple(x[k : k + width]) for k in range(len(x) - width + 1))
    want, best = grams(b), 0.0
    for at in range(max(len(w) - len(b), 0) + 1):
        window = grams(w[at : at + len(b)])
        both = sum((window & want).values())
        best = max(best, both / (sum(window.values()) + sum(want.values()) - both))
    return best


@pytest.mark.parametrize("few", [0, 64])
def test_documents_shorter_than_the_item(spark, monkeypatch, few):
    monkeypatch.setattr(decontaminate, "FEW", few)
    item = cases.prose(77, 59).split(" ")
    rows = [(k, " ".join(item[:k] + item[k + 1 :]), "en", "a") for k in (0, 20, 58)]
    rows += [(100 + k, " ".join(item[k:]), "en", "a") for k in range(59)] + [(200 + k, " ".join(item[: 59 - k]), "en", "a") for k in range(1, 59)]
    rows += [(300 + k, cases.changed(" ".join(item[:57]), k, k % 5), "en", "a") for k in range(20)] + [(400, "", "en", "a"), (401, None, "en", "a")]
    items = [(1, " ".join(item)), (2, "one two three"), (3, cases.prose(5, 55)), (4, " ".join(item[3:]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = cases.documents(spark, rows)
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.leaks(docs, benchmark).collect()}
    want = {(i, j): x for i, t, *_ in rows for j, b in items if (x := similar(t, b)) >= 0.75}
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}
    assert got[0, 1] == 54 / 55 and (20, 1) in got and (58, 1) in got
    kept = {r["doc_id"] for r in decontaminate.clean(docs, benchmark).collect()}
    assert kept == {i for i, *_ in rows} - {i for i, _ in want}
