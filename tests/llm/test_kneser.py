import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from affinis.llm import kneser
from tests.conftest import SF
from tests.llm import cases

START, END = b"  ", b" "


class Plain:
    """The same model from dictionaries."""

    def __init__(self, texts):
        self.uni, pairs = Counter(), Counter()
        for t in texts:
            tokens = [*cases.words(t), END]
            self.uni.update(tokens)
            pairs.update(zip([START, *tokens], tokens, strict=False))
        self.texts, self.pairs = len(texts), pairs
        self.d = kneser.discounts([sum(c == k for c in pairs.values()) for k in range(1, 5)])
        self.n1, self.s = Counter(w for _, w in pairs), defaultdict(float)
        for (v, _), c in pairs.items():
            self.s[v] += c - self.d[min(c, 3) - 1]
        self.d1 = kneser.discounts([sum(c == k for c in self.n1.values()) for k in range(1, 5)])
        taken = sum(self.d1[min(c, 3) - 1] for c in self.n1.values())
        self.types = max(len(pairs), 1)
        self.g1 = taken / self.types if pairs else 1.0

    def lower(self, w):
        n = self.n1[w]
        return (n - (self.d1[min(n, 3) - 1] if n else 0)) / self.types + self.g1 / (len(self.uni) + 1)

    def p(self, v, w):
        followed = self.texts if v == START else self.uni[v]
        c = self.pairs[v, w]
        own = (c - self.d[min(c, 3) - 1]) / followed if c else 0.0
        return own + (1 - self.s[v] / followed if followed else 1.0) * self.lower(w)

    def score(self, t):
        tokens = [*cases.words(t), END]
        n, v = sum(self.uni.values()), len(self.uni)
        base = sum(math.log10((self.uni[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        own = sum(math.log10(self.p(a, w)) for a, w in zip([START, *tokens], tokens, strict=False))
        return len(tokens), sum(self.uni[w] > 0 for w in tokens), base, own


def check(scored, plain, texts):
    got = sorted(((r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in scored.collect()))
    want = sorted(plain.score(t) for t in texts)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=1e-9)


@pytest.mark.parametrize("mounted", [True, False])
def test_odd_rows(spark, monkeypatch, mounted):
    monkeypatch.setattr(kneser, "CHUNK", 3000)
    monkeypatch.setattr(kneser, "GROUP", 500)
    monkeypatch.setattr(kneser, "HOT_SHARE", 1 / 100)
    docs = cases.documents(spark)
    train = docs.where("doc_id is null or pmod(doc_id, 3) != 1")
    texts = [t for i, t, *_ in cases.texts() if i is None or i % 3 != 1]
    plain = Plain(texts)
    check(kneser.score(docs, kneser.fit(kneser.documents(train), mounted)), plain, [t for _, t, *_ in cases.texts()])


def test_probabilities_sum_to_one():
    plain = Plain([cases.prose(i, 200) for i in range(5)])
    words = [*plain.uni, b"never seen"]
    for v in (START, b"the", b"never seen", *list(plain.uni)[:5]):
        assert sum(plain.p(v, w) for w in words) == pytest.approx(1.0)


def test_no_training_rows(spark):
    docs = cases.documents(spark)
    model = kneser.fit(kneser.documents(docs.limit(0)))
    rows = kneser.score(docs.where("doc_id = 9"), model).collect()
    assert rows[0]["score"] == 0.0 and rows[0]["base_score"] == 0.0 and rows[0]["n_known"] == 0
    assert kneser.score(docs.limit(0), model).count() == 0


def test_table_beats_the_base(spark):
    docs = kneser.documents(spark.read.parquet(f"{SF}/documents.parquet"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    rows = docs.collect()
    train = [r["text"] for r in rows if cases.crc(r["doc_id"]) % 5 != 1]
    scored = kneser.score(docs, kneser.fit(docs.where(~held)))
    check(scored, Plain(train), [r["text"] for r in rows])
    total = scored.where(held).agg(F.sum("base_score"), F.sum("score")).first()
    assert total[1] > total[0]


def test_counts_of_any_size_are_found():
    """Pieces laid side by side, counts beyond a byte, keys that aren't there."""
    import numpy as np

    from affinis.llm.mapped import MappedCounts

    r = np.random.default_rng(1)
    bits, shift = 6, 4
    keys = np.unique(r.integers(0, 1 << 46, 3000, dtype=np.uint64))
    counts = r.choice([1, 2, 254, 255, 256, 70_000], len(keys))
    top, rest = keys >> np.uint64(40), keys & np.uint64((1 << 40) - 1)
    pieces = [MappedCounts.packed(top[at], rest[at], counts[at], b << shift, 1 << shift) for b in range(4) if (at := top >> np.uint64(shift) == b).any()]
    whole = [np.concatenate([np.frombuffer(p[k], kind) for p in pieces]) for k, kind in enumerate([np.uint32, np.uint8, np.uint8, np.uint32])]
    starts = np.cumsum([0] + [len(p[1]) for p in pieces])
    wide = [np.concatenate([np.frombuffer(p[k], np.int64) + (at if k == 4 else 0) for p, at in zip(pieces, starts, strict=False)]) for k in (4, 5)]
    arrays = {"low": whole[0], "high": whole[1], "count": whole[2], "offsets": np.r_[0, np.cumsum(whole[3])].astype(np.uint32), "wide": np.stack(wide)}
    assert (MappedCounts.find(arrays, top, rest) == counts).all()
    absent = np.setdiff1d(r.integers(0, 1 << 46, 3000, dtype=np.uint64), keys)
    assert not MappedCounts.find(arrays, absent >> np.uint64(40), absent & np.uint64((1 << 40) - 1)).any()
