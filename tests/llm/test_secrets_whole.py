import random
import string

from affinis.llm import secrets
from tests.llm import cases

LOWER, DIGITS = string.ascii_lowercase, string.digits
KINDS = {
    "base62": (string.ascii_letters + DIGITS, 40), "base62 of 64": (string.ascii_letters + DIGITS, 64),
    "base64": (string.ascii_letters + DIGITS + "+/", 32), "url": (string.ascii_letters + DIGITS + "-_", 32),
    "lower": (LOWER + DIGITS, 40), "base32": (string.ascii_uppercase + "234567", 32), "upper hex": (DIGITS + "ABCDEF", 40)}
ORDINARY = [
    "see internationalisation2counterrevolutionaries here", "see MAXIMUM_INTERNATIONALISATION_2 here",
    "see /2023/05/12/internationalisation-of-counterrevolutionaries here", "see counterrevolutionaries_2023_internationalisation here"]


def spans_of(spark, rows):
    spans, name = secrets.found(cases.documents(spark, rows), ["doc_id"])
    return {r["doc_id"]: [(s["start"], s["end"], s["kind"]) for s in r[name]] for r in spans.collect()}


def corpus():
    """Base spans of hex only."""
    r = random.Random(4)
    hexes = ["".join(r.choices("0123456789abcdef", k=40)) for _ in range(80)]
    return [(i, f"note {cases.prose(i, 30)} token={h} internationalisation counterrevolutionaries", "en", "a") for i, h in enumerate(hexes)]


def test_bare_strings_where_all_base_spans_are_hex(spark):
    r, rows, want = random.Random(5), corpus(), {}
    for kind, (alphabet, n) in KINDS.items():
        made = 0
        while made < 40:
            s = "".join(r.choices(alphabet, k=n))
            if any(c.isdigit() for c in s) and any(c.isalpha() for c in s):
                i, made = 1000 + len(want), made + 1
                rows.append((i, f"see {s} here", "en", "a"))
                want[i] = kind, (4, 4 + n, 3)
    rows += [(5000 + k, text, "en", "a") for k, text in enumerate(ORDINARY)]
    got = spans_of(spark, rows)
    for kind in KINDS:
        share = sum(span in got[i] for i, (k, span) in want.items() if k == kind) / 40
        assert share >= 0.9, (kind, share)
    assert not any(got[5000 + k] for k in range(len(ORDINARY)))


def test_what_base_spans_leave_of_a_run_is_judged(spark):
    r = random.Random(6)
    key = "".join(r.choices(string.ascii_letters + DIGITS, k=40))
    text = "see " + "deadbeef" * 4 + "/" + key + " here"
    got = spans_of(spark, [*corpus(), (1000, text, "en", "a")])[1000]
    assert (4, 36, 2) in got and any(a <= 38 and b == 77 and k == 3 for a, b, k in got)
    out = secrets.masked(cases.documents(spark, [*corpus(), (1000, text, "en", "a")])).where("doc_id = 1000").first()
    assert key[4:] not in out["text"]
