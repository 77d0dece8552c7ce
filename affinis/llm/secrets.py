"""Secret scans (operator 10): patterns and character Markov models, DataFrame functions only.

Base kinds, leftmost and non-overlapping each: ``assign`` (a password, secret, token or
key that is given a value of eight or more characters), ``access`` (AKIA keys) and
``hex`` (32 or more). The method adds ``markov``: runs of 20 or more key characters
in what base spans leave of a text, which a model of random strings explains better than
one of ordinary identifiers. Random strings are uniform draws over the smallest alphabet
that holds the run (``ALPHABETS``: hex, base32, base36, base62, base64), whatever secrets
the corpus holds, or else follow the transitions of the values of base spans; the better
model counts. Ordinary are runs of at least 16 letters, in their own and in upper case,
with a share of ``SIGNS`` for digits and signs, evenly. Both sets of transitions are
smoothed by character frequencies; the training counts cover all documents. Short runs
are never judged, and a run needs letters and digits both, a log-likelihood ratio of
``MIN_RATIO`` nats and ``MIN_RATIO_EACH`` per character, so that ordinary long words are
left alone.

Spans are found without Python by splitting a text at the matches and extracting the
matches: the lengths of both, added up, are the positions (code points, end exclusive).

Defined cases: a null or empty text has no spans. Repeated rows each get their result,
null ids come out as null, an empty table gives an empty result, other columns stay
unread (:func:`masked` keeps them).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.llm.text import free_name, let, materialise

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"(?i:password|passwd|secret|token|api_?key)"
MIN_VALUE = 8
# Runs this long or longer are what is left of AKIA[A-Z0-9]+ and [0-9a-f]+ once short matches are dropped.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ORDINARY = r"[A-Za-z]{16,}"
KINDS = ["assign", "access", "hex", "markov"]
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-"
MIN_RATIO = 12.0
MIN_RATIO_EACH = 0.45
# Transitions that a character's overall frequency counts for in either model.
PRIOR = 20.0
# Share of digits and signs in ordinary identifiers; samples of letters can't tell it.
SIGNS = 0.25
# Alphabets of random strings, smallest first; anything else is drawn from all of ALPHABET.
ALPHABETS = [
    (16, "([0-9a-f]+|[0-9A-F]+)"), (32, "([a-z2-7]+|[A-Z2-7]+)=*"), (36, "([a-z0-9]+|[A-Z0-9]+)"), (62, "[A-Za-z0-9]+"),
    (64, "([A-Za-z0-9+/]+|[A-Za-z0-9_-]+)=*")]
MASK = "[SECRET]"

# Fields in the order that spans are listed by.
_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _spans(text: Column, pattern: str, kind: int, hint: str | None = None) -> Column:
    """Array of (start, kind, end, value) of all matches."""

    def placed(gaps: Column, found: Column) -> Column:
        pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
        nothing = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans"))

        def step(state, pair):
            start = state["at"] + F.length(pair["g"])
            end = start + F.length(pair["m"])
            one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), pair["m"].alias("value"))
            return F.struct(end.alias("at"), F.concat(state["spans"], F.array(one)).alias("spans"))

        return F.aggregate(pairs, nothing, step, lambda s: s["spans"])

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, let(F.split(text, pattern, -1), lambda g: placed(g, m))).otherwise(F.array().cast(_SPAN)))
    return F.when(text.rlike(hint or pattern), found).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    """Base spans by start, then kind; ``value`` is what was found (of ``assign`` the whole match)."""
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    spans = _spans(text, ASSIGN, 0, ASSIGN_HINT)
    assign = F.when(F.size(spans) > 0, let(values, lambda v: F.filter(
        F.zip_with(spans, v, lambda s, x: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), x.alias("value"))),
        lambda s: F.length(s["value"]) >= MIN_VALUE))).otherwise(spans)
    return F.sort_array(F.concat(assign.cast(_SPAN), _spans(text, ACCESS, 1), _spans(text, HEX, 2)))


def _blanked(text: Column, spans: Column) -> Column:
    """``text`` with spaces in place of the spans, which are in order of their starts."""
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s, span):
        gap = F.substring(text, s["at"] + 1, F.greatest(span["start"] - s["at"], F.lit(0)))
        blank = F.repeat(F.lit(" "), F.greatest(span["end"] - F.greatest(span["start"], s["at"]), F.lit(0)))
        return F.struct(F.greatest(s["at"], span["end"]).alias("at"), F.concat(s["out"], gap, blank).alias("out"))

    rest = F.aggregate(spans, state, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, rest).otherwise(text)


def scanned(docs: DataFrame, keep: list[str], name: str) -> DataFrame:
    """``keep`` columns and a struct of base spans, candidates and ordinary words; written once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = base_spans(text)
    candidates = lambda b: let(_blanked(text, b), lambda t: _spans(t, CANDIDATE, 3))
    likely = lambda c: c["value"].rlike("[0-9]") & c["value"].rlike("[A-Za-z]")
    scan = let(base, lambda b: F.struct(
        b.alias("base"), F.filter(candidates(b), likely).alias("candidates"),
        F.regexp_extract_all(text, F.lit(ORDINARY), F.lit(0)).alias("ordinary")))
    return docs.select(*[F.col(f"`{c}`") for c in keep], scan.alias(name))


def _characters(value: Column) -> Column:
    """A string's characters, cut up once: taking them by number walks to each from the start."""
    return F.filter(F.split(value, ""), lambda c: c != "")


def _neighbours(array: Column, of) -> Column:
    """``of(a, b)`` of every element and the next one."""

    def body(x: Column) -> Column:
        n = F.greatest(F.size(x) - 1, F.lit(0))
        return F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, F.lit(2), n), of)

    return let(array, body)


def _pair_counts(strings: DataFrame) -> DataFrame:
    """``pair, n``: transitions in the column ``s``, both ends within the alphabet."""
    pairs = _neighbours(_characters(F.col("s")), lambda a, b: F.concat(a, b))
    return (
        strings.where(F.length("s") >= 2).select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
        .where(F.translate("pair", ALPHABET, "") == ""))


def log_models(scans: DataFrame, name: str) -> dict[str, list[float]]:
    """log P(b | a) of every transition, row by row of the alphabet, ``random`` and ``ordinary``.

    Two tables of at most 68 x 68 counts are collected, whatever the size of the corpus.
    """
    field = F.col(name)
    ordinary = scans.select(F.explode(field["ordinary"]).alias("s"))
    samples = {
        "random": scans.select(F.explode(field["base"]["value"]).alias("s")),
        "ordinary": ordinary,
    }
    size = len(ALPHABET)
    at = {c: i for i, c in enumerate(ALPHABET)}
    letters = [c.isalpha() for c in ALPHABET]
    logs = {}
    for label, strings in samples.items():
        counts = [[0.0] * size for _ in range(size)]
        for row in _pair_counts(strings).collect():
            for a, b in [row["pair"], row["pair"].upper()] if label == "ordinary" else [row["pair"]]:
                counts[at[a]][at[b]] += row["n"]
        # A character after a rare one is judged by how frequent it is anywhere.
        single = [1.0 + sum(line[b] for line in counts) for b in range(size)]
        total = sum(single)
        p = [[(c + PRIOR * single[b] / total) / (sum(line) + PRIOR) for b, c in enumerate(line)] for line in counts]
        if label == "ordinary":
            for line in p:
                share = sum(x for x, letter in zip(line, letters, strict=True) if letter)
                line[:] = [x / share * (1 - SIGNS) if letter else SIGNS / (size - sum(letters)) for x, letter in zip(line, letters, strict=True)]
        logs[label] = [math.log(x) for line in p for x in line]
    return logs


def _sum(value: Column, table: Column) -> Column:
    """Summed log-likelihood of a string's transitions."""
    places = F.transform(_characters(value), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    steps = _neighbours(places, lambda a, b: F.coalesce(F.get(table, a * len(ALPHABET) + b), F.lit(0.0)))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)


def _ratio(value: Column, random: Column, ordinary: Column) -> Column:
    """Log-likelihood ratio of the better random model to the ordinary one."""
    each = F.lit(math.log(len(ALPHABET)))
    for size, pattern in reversed(ALPHABETS):
        each = F.when(value.rlike(f"^{pattern}$"), F.lit(math.log(size))).otherwise(each)
    return F.greatest(-each * (F.length(value) - 1), _sum(value, random)) - _sum(value, ordinary)


def found(docs: DataFrame, keep: list[str], name: str = "secret_scan") -> tuple[DataFrame, str]:
    """``keep`` columns and an array of all spans by start, then kind; with the array's name."""
    name = free_name(docs, name)
    scans = materialise(scanned(docs, keep, name), "scans")
    models = log_models(scans, name)
    random, ordinary = (F.split(F.lit(" ".join(map(repr, models[k]))), " ").cast("array<double>") for k in ("random", "ordinary"))
    field = F.col(name)
    judged = F.filter(
        field["candidates"],
        lambda c: let(_ratio(c["value"], random, ordinary), lambda r: (r >= MIN_RATIO) & (r >= MIN_RATIO_EACH * F.length(c["value"]))))
    spans = F.when(F.size(field["candidates"]) == 0, field["base"]).otherwise(F.sort_array(F.concat(field["base"], judged)))
    return scans.withColumn(name, spans), name


def listed(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret replaced by a fixed mark; overlapping spans share one.

    Only ``text`` changes, and ``n_chars`` of changed texts where there is such a column.
    """
    spans, name = found(docs, docs.columns)

    def cut(text: Column, array: Column) -> Column:
        state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

        def step(s, span):
            gap = F.substring(text, s["at"] + 1, F.greatest(span["start"] - s["at"], F.lit(0)))
            fresh = span["start"] >= s["at"]
            return F.struct(
                F.greatest(s["at"], span["end"]).alias("at"),
                F.when(fresh, F.concat(s["out"], gap, F.lit(MASK))).otherwise(s["out"]).alias("out"))

        return F.aggregate(array, state, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))

    dirty = F.size(name) > 0
    out = spans.withColumn("text", F.when(dirty, cut(F.col("text"), F.col(name))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(dirty, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
