"""Conversation structure repair (operator 11): a grammar-compressed dynamic programme.

A conversation's rows are symbols, a role's initial with the row's first fault. The
cheapest edits that make the roles spell ``(s?(ua)+)?`` are found by a min-plus product
of one 4 x 4 matrix per symbol (states of that expression; an entry is the cost of
getting from one state to another and the edits that do it, as a rope).

1. Rows without their texts are sorted by conversation and turn over all tasks, and
   numbered. Repeated rows are found by an aggregate over digests and joined back.
2. Rows become strings of symbols, cut at every ``SEGMENT`` numbers, so that a
   conversation of any length is worked on by many tasks. Each distinct string is
   evaluated once, however many conversations have it.
3. Re-Pair: the most frequent pairs of neighbouring symbols over all distinct strings get
   a symbol of their own, in ``ROUNDS`` rounds of up to ``RULES`` pairs that don't overlap.
   Each rule has one matrix, the product of its two symbols' matrices, bottom-up; a string
   is the product of the few symbols it is left with. The number of rules changes speed,
   never results.
4. Matrices of a cut conversation are multiplied in groups of ``FOLD`` neighbours, again
   and again, until one is left.
5. Rows with their texts are shuffled once, and meet their conversation's edits in order.
   SHA-256 takes its input one byte after the other, so a conversation passes through one
   task here; it streams through, sorted by Spark, and is never held.

Ties between edits of equal cost go to the least string of initials, compared along the
ropes. Two different strings of equal cost over the same rows are never one a prefix of
the other (what is longer has one more insertion), so parts can be compared alone.

Defined cases: a null conv_id is a conversation of its own; null conv_id, turn, role and
text are one space where they are spelled out. Rows of equal turn come in the order of the
digests of their role and text after damage. A role whose initial isn't s, u or a can only
be changed or deleted. Repeated rows are rows. An empty table gives no rows. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinis.llm.text import batches, materialise, pairs_of, tasks_for

SPACE = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
# Symbols: chr(FIRST + 4 * role + fault).
ROLES, FAULTS, FIRST = "sua", ("ok", "blank", "duplicate", "truncated"), 0x41
OTHER = len(ROLES)
# Names of rules count up from here.
RULE_NAMES = 0x4E00
ROUNDS, RULES, CANDIDATES = 6, 16, 256
# Rows of a string of symbols (a power of two), and matrices multiplied in one go.
SEGMENT_BITS, FOLD = 10, 64
LEGAL = {"su", "ua", "au"}
# States: nothing yet, after s, after u, after ua. Both initials lead where a role of that name may stand.
STATES = range(4)
STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ACCEPTED = (0, 3)

_EVALUATED = pa.schema([
    ("seq", pa.string()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
    ("first", pa.string()), ("last", pa.string()), ("cost", pa.int64()), ("audit", pa.string()),
    ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])
_EVALUATED_DDL = (
    "seq string, blank long, duplicate long, truncated long, illegal long, first string, last string, cost long, audit string, "
    "costs array<long>, audits array<string>")
_PART = ["blank", "duplicate", "truncated", "illegal", "first", "last", "costs", "audits"]
_FOLDED = pa.schema([("conv_id", pa.int64()), ("ord", pa.int64()), *[_EVALUATED.field(c) for c in _PART]])
_REPAIRED = pa.schema([
    ("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
    ("audit", pa.string()), ("repaired_sha256", pa.string())])


# Ropes and matrices: a rope is a string or a pair of ropes, an entry (cost, rope) or None.

def leaves(rope) -> Iterator[str]:
    todo = [rope]
    while todo:
        rope = todo.pop()
        if isinstance(rope, str):
            yield rope
        else:
            todo += (rope[1], rope[0])


def joined(a, b):
    if a == "" or b == "":
        return b if a == "" else a
    return a + b if isinstance(a, str) and isinstance(b, str) and len(a) + len(b) <= 32 else (a, b)


def before(a, b) -> bool:
    """Whether rope ``a`` spells a smaller string than ``b``."""
    if a is b:
        return False
    if isinstance(a, str) and isinstance(b, str):
        return a < b
    chars = lambda rope: (c for leaf in leaves(rope) for c in leaf)
    xs, ys = chars(a), chars(b)
    for x in xs:
        y = next(ys, None)
        if x != y:
            return y is not None and x < y
    return next(ys, None) is not None


def better(x, y):
    if x is None or y is None:
        return y if x is None else x
    if x[0] != y[0]:
        return x if x[0] < y[0] else y
    return y if before(y[1], x[1]) else x


def product(a: list, b: list) -> list:
    """Min-plus product of two lists of rows of entries."""
    out = []
    for row in a:
        line = [None] * len(STATES)
        for r, x in enumerate(row):
            if x is not None:
                for q, y in enumerate(b[r]):
                    if y is not None and (line[q] is None or x[0] + y[0] <= line[q][0]):
                        line[q] = better(line[q], (x[0] + y[0], joined(x[1], y[1])))
        out.append(line)
    return out


def balanced(matrices: list) -> list:
    while len(matrices) > 1:
        matrices = [product(*matrices[k : k + 2]) if k + 1 < len(matrices) else matrices[k] for k in range(0, len(matrices), 2)]
    return matrices[0]


def identity(cost: int = 0, letter: str = "") -> list:
    return [[(cost, letter) if p == q else None for q in STATES] for p in STATES]


def insertions() -> list:
    """Any number of inserted rows: the cheapest way between two states by u and a alone."""
    one = identity()
    for role in "ua":
        for p, q in STEPS[role].items():
            one[p][q] = better(one[p][q], (INSERT, "I"))
    return balanced([one] * len(STATES))


def terminal(role: int, fault: str) -> list:
    """Insertions, then the cheapest edit of one row."""
    edits = identity(DELETE, "D")
    extra = TRUNCATED if fault == "truncated" else 0
    if fault in ("ok", "truncated"):
        ways = [("u", REROLE, "R"), ("a", REROLE, "R")] + ([(ROLES[role], KEEP, "K")] if role != OTHER else [])
        for to, cost, letter in ways:
            for p, q in STEPS[to].items():
                edits[p][q] = better(edits[p][q], (cost + extra, letter))
    return product(insertions(), edits)


def grammar_matrices(rules: list[str]) -> dict[str, list]:
    """symbol -> matrix, for the symbols of rows and, bottom-up, one for every rule."""
    known = {chr(FIRST + 4 * r + f): terminal(r, fault) for r in range(OTHER + 1) for f, fault in enumerate(FAULTS)}
    for k, pair in enumerate(rules):
        known[chr(RULE_NAMES + k)] = product(known[pair[0]], known[pair[1]])
    return known


def closed(row: list) -> tuple:
    """The best entry of a row of states after closing insertions."""
    line, best = product([row], insertions())[0], None
    for q in ACCEPTED:
        best = better(best, line[q])
    return best


def flat(rope) -> str:
    return "".join(leaves(rope))


def packed(seq: str, rules: list[str]) -> str:
    for k, pair in enumerate(rules):
        seq = seq.replace(pair, chr(RULE_NAMES + k))
    return seq


# Rows

def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies, key``: rows after damage; ``copies`` is 0, 1 or 2 and
    ``key`` a digest of conversation, role and text."""
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    spelled = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    code = F.crc32(F.concat(spelled(conv), F.lit(":"), spelled(turn)).cast("binary")) % 20
    rows = conversations.select(
        conv.alias("conv_id"), turn.alias("turn"), code.alias("code"), spelled(F.col("role")).alias("role"), spelled(F.col("text")).alias("text"))
    rows = rows.select(
        "conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("code").isin(0, 1), "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("code") == 0, 0).when(F.col("code") == 3, 2).otherwise(1).alias("copies"))
    said = F.concat_ws(":", spelled(F.col("conv_id")), F.octet_length("role").cast("string"), F.concat("role", "text"))
    return rows.withColumn("key", F.unhex(F.substring(F.sha2(said, 256), 1, 32)))


def _symbol(role: Column, fault: Column | int) -> Column:
    return F.chr(F.lit(FIRST) + 4 * role + fault)


def segments(rows: DataFrame, tasks: int) -> DataFrame:
    """``conv_id, ord, n_parts, seq``: strings of symbols, and how many a conversation has."""
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.instr(F.lit(ROLES), F.substring("role", 1, 1))  # 0: no such role; an empty initial is found first
    role = F.when((initial == 0) | (F.col("role") == ""), OTHER).otherwise(initial - 1)
    blank = trimmed == ""
    fault = F.when(blank, FAULTS.index("blank")).when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), FAULTS.index("truncated")).otherwise(0)
    narrow = rows.where("copies > 0").select("conv_id", "turn", "key", role.cast("int").alias("role"), fault.cast("int").alias("fault"), "copies")
    order = ["conv_id", "turn", "key"]
    placed = materialise(
        narrow.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
        .select("conv_id", F.monotonically_increasing_id().alias("place"), "key", "role", "fault", "copies"), "placed")
    repeated = (
        placed.where(F.col("fault") != FAULTS.index("blank")).groupBy("key").agg(F.min("place").alias("seen"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select("key", "seen"))
    again = (F.col("fault") != FAULTS.index("blank")) & (F.col("place") > F.col("seen"))
    duplicate = F.lit(FAULTS.index("duplicate"))
    first = F.when(again, duplicate).otherwise(F.col("fault"))
    second = F.when(F.col("fault") == FAULTS.index("blank"), F.col("fault")).otherwise(duplicate)
    symbols = F.concat(_symbol(F.col("role"), first), F.when(F.col("copies") == 2, _symbol(F.col("role"), second)).otherwise(""))
    part = F.shiftright("place", SEGMENT_BITS)
    # A group has consecutive numbers that agree above SEGMENT_BITS: a bounded number of them.
    strings = placed.join(repeated, "key", "left").groupBy("conv_id", part.alias("part")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", symbols.alias("s")))), lambda x: x["s"]), "").alias("seq"))
    own = Window.partitionBy("conv_id")
    return strings.select(
        "conv_id", (F.row_number().over(own.orderBy("part")) - 1).cast("long").alias("ord"), F.count(F.lit(1)).over(own).alias("n_parts"), "seq")


def repair_rules(strings: DataFrame) -> list[str]:
    """Rules of the grammar in order; a rule is two symbols, of rows or of earlier rules."""
    rules: list[str] = []

    def pairs(known: list[str]):
        def counted(parts) -> Iterator[tuple]:
            n: Counter = Counter()
            for part in parts:
                for seq in part.column("seq").to_pylist():
                    seq = packed(seq, known)
                    n.update(map(str.__add__, seq, seq[1:]))
            yield from n.items()

        schema = pa.schema([("pair", pa.string()), ("n", pa.int64())])
        return lambda parts: batches(counted(parts), schema)

    for _ in range(ROUNDS):
        top = (
            strings.mapInArrow(pairs(list(rules)), "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
            .where("n > 1").orderBy(F.desc("n"), "pair").limit(CANDIDATES).collect())
        taken: list[str] = []
        for row in top:  # two pairs that share no end with the other's start never overlap
            x, y = row["pair"]
            if all(b != x and a != y for a, b in taken) and len(taken) < RULES:
                taken.append(row["pair"])
        if not taken:
            break
        rules += taken
    return rules


def facts(seq: str) -> tuple:
    """Rows with each fault, neighbours of an illegal kind, first and last role."""
    numbers = [ord(c) - FIRST for c in seq]
    faults = Counter(k % 4 for k in numbers)
    roles = "".join((ROLES + ".")[k // 4] for k in numbers)
    illegal = sum(a + b not in LEGAL for a, b in zip(roles, roles[1:], strict=False))
    return faults[1], faults[2], faults[3], illegal, roles[0], roles[-1]


def _listed(matrix: list) -> tuple[list, list]:
    entries = [e for row in matrix for e in row]
    return [e and e[0] for e in entries], [e and flat(e[1]) for e in entries]


def _matrix(costs: list, audits: list) -> list:
    entries = [None if c is None else (c, a) for c, a in zip(costs, audits, strict=True)]
    return [entries[k : k + 4] for k in range(0, 16, 4)]


def evaluated(strings: DataFrame, rules: list[str]) -> DataFrame:
    """Counts, cheapest edits, and (for parts of conversations) the matrix of every distinct string."""
    matrices = grammar_matrices(rules)

    def rows(parts) -> Iterator[tuple]:
        for part in parts:
            for seq, in_parts in pairs_of(part, "seq", "in_parts"):
                product_of = [matrices[c] for c in packed(seq, rules)]
                if in_parts:
                    matrix = balanced(product_of)
                    line, listed = matrix[0], _listed(matrix)
                else:
                    line, listed = [(0, ""), None, None, None], (None, None)
                    for m in product_of:
                        line = product([line], m)[0]
                cost, audit = closed(line)
                yield seq, *facts(seq), cost, flat(audit), *listed

    return strings.mapInArrow(lambda parts: batches(rows(parts), _EVALUATED), _EVALUATED_DDL)


def _folded(parts_of: DataFrame, tasks: int) -> DataFrame:
    """Matrices of ``FOLD`` neighbouring parts multiplied: ``ord`` becomes a ``FOLD``-th."""

    def merged(group: list[tuple]) -> tuple:
        total = [sum(r[k] for r in group) for k in range(4)]
        total[3] += sum(a[5] + b[4] not in LEGAL for a, b in zip(group, group[1:], strict=False))
        return *total, group[0][4], group[-1][5], *_listed(balanced([_matrix(*r[6:]) for r in group]))

    def rows(parts) -> Iterator[tuple]:
        now, group = None, []
        for part in parts:
            for conv_id, to, *row in pairs_of(part, "conv_id", "to", *_PART):
                if (conv_id, to) != now:
                    if group:
                        yield *now, *merged(group)
                    now, group = (conv_id, to), []
                group.append(row)
        if group:
            yield *now, *merged(group)

    to = F.floor(F.col("ord") / FOLD).cast("long")
    return (
        parts_of.withColumn("to", to).repartition(tasks, "conv_id", "to").sortWithinPartitions("conv_id", "to", "ord")
        .mapInArrow(lambda parts: batches(rows(parts), _FOLDED, 256), "conv_id long, ord long, " + ", ".join(
            f"{c} {t}" for c, t in zip(_PART, ["long"] * 4 + ["string"] * 2 + ["array<long>", "array<string>"], strict=True))))


def audits(rows: DataFrame, tasks: int) -> DataFrame:
    """``conv_id, blank, duplicate, truncated, illegal, cost, audit`` of conversations with rows."""
    cut = materialise(segments(rows, tasks), "segments")
    strings = materialise(cut.groupBy("seq").agg(F.max(F.col("n_parts") > 1).alias("in_parts")), "strings")
    found = evaluated(strings, repair_rules(strings))
    columns = ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    most = cut.agg(F.max("n_parts")).first()[0] or 1
    if most == 1:
        return cut.join(found, "seq").select(*columns)
    # A string that is a part of one conversation may be the whole of another.
    found = materialise(found, "evaluated")
    parts_of = cut.where("n_parts > 1").join(found, "seq").select("conv_id", "ord", *_PART)
    while most > 1:
        parts_of = materialise(_folded(parts_of, tasks), "folded")
        most = -(-most // FOLD)

    def ends(parts) -> Iterator[tuple]:
        for part in parts:
            for row in pairs_of(part, *columns[:5], "costs", "audits"):
                cost, audit = closed(_matrix(*row[5:])[0])
                yield *row[:5], cost, flat(audit)

    schema = pa.schema([*[(c, pa.int64()) for c in columns[:-1]], ("audit", pa.string())])
    return cut.where("n_parts = 1").join(found, "seq").select(*columns).unionAll(
        parts_of.mapInArrow(lambda parts: batches(ends(parts), schema), ", ".join(f"{c} long" for c in columns[:-1]) + ", audit string"))


def repaired(conversations: DataFrame) -> DataFrame:
    """A row per conv_id: ``gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``."""
    tasks = tasks_for(conversations)
    rows = damaged(conversations)
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    edits = audits(rows, tasks).withColumn("kind", F.lit(0))
    both = rows.withColumn("kind", F.lit(1)).unionByName(edits, allowMissingColumns=True)
    names = ["conv_id", "kind", "turn", "role", "text", "copies", "audit", *counts]
    return (
        both.repartition(tasks, "conv_id").sortWithinPartitions("conv_id", "kind", "turn", "key").select(*names)
        .mapInArrow(lambda parts: batches(_digested(row for part in parts for row in pairs_of(part, *names)), _REPAIRED), ", ".join(
            f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in _REPAIRED)))


class _Repair:
    """One conversation while its rows pass by: SHA-256 of what the edits leave, and its turns."""

    def __init__(self, conv_id):
        self.conv_id, self.audit, self.counts = conv_id, "", [0] * 5
        self.at, self.sha, self.last = 0, hashlib.sha256(), ""
        self.started = False
        self.low = self.high = None
        self.n_turns = 0

    def put(self, role: str, text: bytes) -> None:
        self.sha.update((b"\n" if self.started else b"") + role.encode() + b":" + text)
        self.started, self.last = True, role[0]

    def wanted(self) -> str:
        return "assistant" if self.last == "u" else "user"

    def insert(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.put(self.wanted(), b"")
            self.at += 1

    def row(self, turn, role: str, text: bytes, copies: int) -> None:
        if copies and turn is not None:
            self.n_turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        for _ in range(copies):
            self.insert()
            letter = self.audit[self.at]
            self.at += 1
            if letter != "D":
                self.put(role if letter == "K" else self.wanted(), text)

    def result(self) -> tuple:
        self.insert()
        gaps = self.high - self.low + 1 - self.n_turns if self.n_turns else 0
        return self.conv_id, gaps, *self.counts, self.audit, self.sha.hexdigest()


def _digested(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Results of conversations from rows in the order of conv_id, kind (edits first) and turn."""
    now: _Repair | None = None
    for conv_id, kind, turn, role, text, copies, audit, *counts in rows:
        if now is None or conv_id != now.conv_id:
            if now is not None:
                yield now.result()
            now = _Repair(conv_id)
        if kind == 0:
            now.audit, now.counts = audit, counts
        else:
            now.row(turn, role, text, copies)
    if now is not None:
        yield now.result()
