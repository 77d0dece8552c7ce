import math
from collections import Counter, defaultdict

import pytest

from affinis.llm import kneser
from tests.llm import cases


def test_pairs_seen_once_are_in_the_model(spark):
    texts = [cases.prose(i, 60) for i in range(12)]
    train = kneser.documents(cases.documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]))
    model = kneser.fit(train)
    tokens = [[b"  ", *cases.words(t), b" "] for t in texts]
    pairs = Counter(p for t in tokens for p in zip(t, t[1:], strict=False))
    uni, n1 = Counter(w for t in tokens for w in t[1:]), Counter(w for _, w in pairs)
    assert model.bigrams.rows == len(pairs) and sum(c == 1 for c in pairs.values()) > 50
    d = kneser.discounts([sum(c == k for c in pairs.values()) for k in range(1, 5)])
    e = kneser.discounts([sum(c == k for c in n1.values()) for k in range(1, 5)])
    off = lambda c, by: by[min(c, 3) - 1] if c else 0.0
    taken, followed = defaultdict(float), Counter()
    for (v, _), c in pairs.items():
        taken[v] += off(c, d)
        followed[v] += c
    low = lambda w: (n1[w] - off(n1[w], e)) / len(pairs) + sum(off(c, e) for c in n1.values()) / len(pairs) / (len(uni) + 1)
    p = lambda v, w: (pairs[v, w] - off(pairs[v, w], d)) / followed[v] + taken[v] / followed[v] * low(w)
    want = {i: sum(math.log10(p(v, w)) for v, w in zip(t, t[1:], strict=False)) for i, t in enumerate(tokens)}
    got = {r["doc_id"]: r["score"] for r in kneser.score(train, model).collect()}
    assert got == pytest.approx(want, rel=1e-9)
