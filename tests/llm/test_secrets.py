import hashlib
import random
import re
from collections import Counter

from affinis.llm import secrets
from affinis.llm.q_secrets import op10
from tests.conftest import SF
from tests.llm import cases

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    t = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return sorted(spans + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32])


def test_odd_rows(spark):
    docs = cases.documents(spark)
    spans, name = secrets.found(docs, docs.columns)
    assert name == "secret_scan_"
    rows = spans.collect()
    assert len(rows) == len(cases.texts())
    for row in rows:
        assert [(s["start"], s["kind"], s["end"]) for s in row[name] if s["kind"] < 3] == base(row["text"])
    assert secrets.found(docs.limit(0), ["doc_id"])[0].count() == 0


def test_query_digest(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = op10(spark, SF).collect()
    assert len(rows) == len(text)
    for r in rows:
        spans = base(text[r["doc_id"]])
        n = Counter(k for _, k, _ in spans)
        listed = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (n[0], n[1], n[2])
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()


def test_markov_finds_bare_random_strings(spark):
    r = random.Random(4)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    make = lambda n: "".join(r.choices(alphabet, k=n))
    rows = [(i, f"note {cases.prose(i, 30)} token={make(40)} internationalisation counterrevolutionaries", "en", "a") for i in range(80)]
    bare = make(40)
    rows += [(1000, f"see {bare} here", "en", "a"), (1001, "see internationalisation2counterrevolutionaries here", "en", "a")]
    spans, name = secrets.found(cases.documents(spark, rows), ["doc_id"])
    found = {row["doc_id"]: [(s["start"], s["end"]) for s in row[name] if s["kind"] == 3] for row in spans.collect()}
    assert found[1000] == [(4, 44)] and found[1001] == []


def test_masked(spark):
    docs = cases.documents(spark)
    out = secrets.masked(docs)
    assert out.columns == docs.columns
    rows = {r["doc_id"]: r for r in out.collect() if r["doc_id"] is not None}
    assert rows[6]["text"] is None
    for i, t, *_ in cases.texts():
        if i not in (None, 18, 19, 20):
            assert rows[i]["text"] == t
    for i in (18, 19, 20):
        assert secrets.MASK in rows[i]["text"] and not base(rows[i]["text"]) and rows[i]["n_chars"] == len(rows[i]["text"])


def test_one_very_long_run(spark):
    """A blob of 200,000 characters takes seconds: characters are cut up once."""
    import random
    import string
    import time

    blob = "".join(random.Random(1).choices(string.ascii_letters + string.digits, k=200_000))
    plain = "internationalisation characteristically misunderstanding straightforwardness " * 40
    rows = [(1, "see " + blob + " there", "en", "a"), (2, cases.prose(3, 80), "en", "a"), *[(k, plain, "en", "a") for k in range(3, 40)]]
    start = time.perf_counter()
    out, name = secrets.found(cases.documents(spark, rows), ["doc_id", "text"])
    spans = {r["doc_id"]: r["spans"] for r in out.select("doc_id", secrets.listed(out[name]).alias("spans")).collect()}
    assert spans[1] == "markov:4:200004" and spans[2] == ""
    assert time.perf_counter() - start < 120
