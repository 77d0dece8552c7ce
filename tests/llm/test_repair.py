import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from affinis.llm import repair
from tests.conftest import SF

SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()), *[T.StructField(c, T.StringType()) for c in "key kind audit copies place seq cost".split()]])
COLUMNS = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
WHITE = " \t\n\x0b\f\r"
GOOD = re.compile(r"(s?(ua)+)?")


def table(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 7) for r in rows], SCHEMA).repartition(3)


def after_damage(conv_id, rows):
    """Rows in order; ties as the operator's docstring says."""
    out = []
    spelled = lambda v: " " if v is None else str(v)
    for turn, role, text in rows:
        code = zlib.crc32(f"{spelled(conv_id)}:{spelled(turn)}".encode()) % 20
        role, text = spelled(role), spelled(text)
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        role = "user" if code == 4 else role
        key = hashlib.sha256(f"{spelled(conv_id)}:{len(role.encode())}:{role}{text}".encode()).digest()[:16]
        out += [(turn is not None, turn or 0, key, role, text)] * (2 if code == 3 else 1)
    return [(r[1] if r[0] else None, *r[3:]) for r in sorted(out)]


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        said = text.rstrip(WHITE)
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "ok")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """The least (cost, audit), and the rows left, by a programme over whole strings."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    now = {0: (0, "", ())}

    def inserted(now):
        for _ in range(4):
            for p, (cost, audit, left) in list(now.items()):
                for role in ("user", "assistant"):
                    q = step.get((p, role[0]))
                    if q is not None:
                        new = (cost + 3, audit + "I", (*left, (role, "")))
                        now[q] = min(now.get(q, new), new)
        return now

    for (_, role, text), fault in zip(rows, found, strict=True):
        after = {}
        for p, (cost, audit, left) in inserted(now).items():
            ways = [(p, 4, "D", left)]
            if fault in ("ok", "truncated"):
                extra = 3 if fault == "truncated" else 0
                for to, price, letter in ((role, 0, "K"), ("user", 3, "R"), ("assistant", 3, "R")):
                    q = step.get((p, to[:1]))
                    if q is not None:
                        ways.append((q, price + extra, letter, (*left, (to, text))))
            for q, price, letter, rest in ways:
                new = (cost + price, audit + letter, rest)
                after[q] = min(after.get(q, new), new)
        now = after
    now = inserted(now)
    return min(now[q] for q in (0, 3) if q in now)


def brute(rows):
    convs = defaultdict(list)
    for c, *row in rows:
        convs[c].append(row)
    out = []
    for c, given in convs.items():
        left = after_damage(c, given)
        found = faults(left)
        turns = [t for t, *_ in left if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for _, r, _ in left]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, kept = cheapest(left, found)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out.append((c, gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, digest))
    return sorted(out, key=str)


def got(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


def some(seed, n, longest=12):
    r = random.Random(seed)
    return [
        (c, turn, r.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None]),
         r.choice(["One.", "Two!", "cut off", "Why?", " ", None, f"t{r.randrange(9)}."]))
        for c in range(n) for turn in range(r.randint(1, longest))]


@pytest.mark.parametrize("bits,fold", [(10, 64), (1, 2), (2, 3)])
def test_all_kinds(spark, monkeypatch, bits, fold):
    """Strings of any cut, folded at several levels, against whole-string programmes."""
    monkeypatch.setattr(repair, "SEGMENT_BITS", bits)
    monkeypatch.setattr(repair, "FOLD", fold)
    rows = some(bits, 150) + [(1000, k, "user" if k % 2 else "assistant", f"{k % 11}.") for k in range(120)]
    assert got(repair.repaired(table(spark, rows))) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "x"), (None, None, None, None), (None, 1, "assistant", "y."), (5, None, "user", "n."), (5, 2, "user", "a."),
        (5, 2, "assistant", "b."), (5, 2, "assistant", "b."), (6, 9, "system", "only."), (7, 0, "sage", "a."), (7, 1, "umpire", "b"),
        (7, 2, "agent", "c\x85."), (7, 9, "agent", "　 \x0b"), (-8, 3, "user", "é" * 70_000 + "?\n\n")]
    rows += [(c, 0, "user", "a.") for c in range(100, 160)]
    assert got(repair.repaired(table(spark, rows))) == brute(rows)
    assert any(r[7] == "" and r[8] == hashlib.sha256(b"").hexdigest() for r in brute(rows))


def test_table(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet")
    assert got(repair.repaired(rows)) == brute([tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()])


def test_empty(spark):
    assert got(repair.repaired(table(spark, []))) == []


def test_every_sequence_of_edits():
    """Short conversations, all edits tried one by one; rules don't change the result."""
    kinds = [(role, fault) for role in range(4) for fault in ("ok", "truncated", "duplicate")]
    r = random.Random(2)
    for _ in range(150):
        rows = [r.choice(kinds) for _ in range(r.randint(0, 3))]
        best = None
        choices = []
        for role, fault in rows:
            extra = 3 if fault == "truncated" else 0
            ways = [("D", 4, "")]
            if fault != "duplicate":
                ways += [("K", extra, "sua."[role]), ("R", 3 + extra, "u"), ("R", 3 + extra, "a")]
            choices.append(ways)
        gaps = ["", "u", "a", "ua", "au"]
        for inserts in itertools.product(gaps, repeat=len(rows) + 1):
            for picks in itertools.product(*choices):
                said = inserts[0] + "".join(p[2] + i for p, i in zip(picks, inserts[1:], strict=True))
                if GOOD.fullmatch(said):
                    audit = "I" * len(inserts[0]) + "".join(p[0] + "I" * len(i) for p, i in zip(picks, inserts[1:], strict=True))
                    tried = (sum(p[1] for p in picks) + 3 * sum(map(len, inserts)), audit)
                    best = min(best or tried, tried)
        seq = "".join(chr(repair.FIRST + 4 * role + repair.FAULTS.index(fault)) for role, fault in rows)
        for rules in ([], [seq[:2], chr(repair.RULE_NAMES) + seq[2:3]] if len(seq) == 3 else []):
            known = repair.grammar_matrices(rules)
            matrix = repair.balanced([known[c] for c in repair.packed(seq, rules)] or [repair.identity()])
            cost, audit = repair.closed(matrix[0])
            assert (cost, repair.flat(audit)) == best


def test_ropes_compare_like_strings():
    r = random.Random(3)

    def rope(text):
        if len(text) < 2 or r.random() < 0.2:
            return text
        k = r.randint(0, len(text))
        return rope(text[:k]), rope(text[k:])

    for _ in range(2000):
        a, b = ("".join(r.choices("DK", k=r.randint(0, 6))) for _ in "ab")
        assert repair.before(rope(a), rope(b)) == (a < b)
