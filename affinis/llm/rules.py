"""Quality rules (operator 6): distribution divergence, DataFrame functions only.

Two histograms of a document are compared with references of its language by
Jensen-Shannon distance (square root of the divergence in bits, 0 to 1):
character classes (lower case, upper case, spaces, digits, punctuation, symbols,
the rest) and common words (a fixed list per language, and the rest of the words).
The references are summed histograms, one per language: first of all documents that
pass the base rules, then of those among them that are near the first ones, so that
junk does not shape what it is measured by.

Base rules: at least 50 words, and at most half of them inside three-word windows
that the text has twice or more.

Defined cases: a null or empty text has zero counts and fails the base rules. A
language without a word list, or null, shares one reference, and its word distance
is 0. Documents below ``MIN_WORDS_JUDGED`` words are not judged by their words, and
below ``MIN_CHARS_JUDGED`` characters not by their characters. Repeated rows each
get the same result; an empty table gives an empty result; other columns of the
input are not read and stay as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.llm.text import free_name, let, materialise

SPACES = r"[\x20\x09-\x0D]+"
# Removed one after the other from what is left of the text; lengths give the counts.
CLASSES = {
    "lower": "[a-z]+",
    "upper": "[A-Z]+",
    "space": SPACES,
    "symbol": r"[#*$%&|<>]+",
    "punctuation": r"[.,;:!?'\"()\-]+",
    "digit": "[0-9]+",
}
# Frequent function words of each language.
COMMON = {
    "en": "the of and to in a is that it for on was with as be by this are at from".split(),
    "de": "der die und in den von zu das mit sich für des auf ist im nicht dem eine ein als".split(),
    "fr": "de la le et les des en un du une est que pour dans qui au par sur pas avec".split(),
    "es": "de la que el en y los se del las por un con para una no su es al lo".split(),
}
# Verdict of the method.
MAX_CHAR_DISTANCE = 0.17
MAX_WORD_DISTANCE = 0.31
MIN_CHARS_JUDGED = 200
MIN_WORDS_JUDGED = 100
# Documents farther than this from the first references don't count for the final ones.
TRIM_CHAR_DISTANCE = 0.20
TRIM_WORD_DISTANCE = 0.25
# Base rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _class_counts(text: Column) -> Column:
    """Struct of class name -> characters, and ``rest``."""

    def step(left: Column, names: list[str], counted: list[Column]) -> Column:
        if not names:
            return F.struct(*counted, F.length(left).cast("long").alias("rest"))
        name, *others = names
        shorter = F.regexp_replace(left, CLASSES[name], "")
        return let(shorter, lambda s: step(s, others, [*counted, (F.length(left) - F.length(s)).cast("long").alias(name)]))

    return step(text, list(CLASSES), [])


# Sorting plain longs is several times faster than sorting structs; a text of more
# windows than the low bits can number takes the structs, and so does one in which two
# different windows agree in the bits above.
INDEX_BITS = 24


def _covered(grams: Column) -> Column:
    """Words inside three-word windows whose hash occurs twice or more."""

    def width(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def starts(ordered: Column, key, at, if_mixed: Column | None = None) -> Column:
        """Ascending window numbers whose hash equals that of a neighbour in the order of
        ``key``. Where neighbours agree in the key alone, equal hashes may lie apart:
        ``if_mixed`` then."""
        same = lambda p: F.get(grams, p[0]) == F.get(grams, p[1])

        def found_in(beside: Column) -> Column:
            equal = F.sort_array(F.array_distinct(F.flatten(F.filter(beside, same))))
            return equal if if_mixed is None else F.when(F.exists(beside, lambda p: ~same(p)), if_mixed).otherwise(equal)

        def body(s: Column) -> Column:
            return let(F.transform(s, lambda e, k: F.when(key(F.get(s, k + 1)) == key(e), F.array(at(e), at(F.get(s, k + 1))))), found_in)

        return let(ordered, body)

    low = (1 << INDEX_BITS) - 1
    packed = F.sort_array(F.transform(grams, lambda h, i: F.shiftleft(F.shiftright(h, INDEX_BITS), INDEX_BITS).bitwiseOR(i.cast("long"))))
    plain = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    exact = starts(plain, lambda e: e["h"], lambda e: e["i"])
    found = F.when(
        F.size(grams) <= low,
        starts(packed, lambda e: F.shiftright(e, INDEX_BITS), lambda e: e.bitwiseAND(F.lit(low).cast("long")).cast("int"), exact)
    ).otherwise(exact)
    several = F.size(F.array_distinct(grams)) < F.size(grams)
    return F.when(several, let(found, width)).otherwise(F.lit(0).cast("long"))


def _repeat_words(words: Column) -> Column:
    windows = F.transform(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(let(windows, _covered))


def _word_features(words: Column, lang: Column) -> Column:
    every = sorted({w for ws in COMMON.values() for w in ws})
    lists = F.coalesce(
        *[F.when(lang == name, F.array(*map(F.lit, ws))) for name, ws in COMMON.items()], F.array().cast("array<string>"))
    common = F.filter(F.transform(words, lambda w: F.lower(w)), lambda w: w.isin(every))
    tally = let(common, lambda c: F.transform(lists, lambda w: F.size(F.filter(c, lambda x: x == w)).cast("long")))
    return F.struct(
        F.size(words).cast("long").alias("n_words"), _repeat_words(words).alias("n_repeat_words"), tally.alias("common"))


def measures(text: Column, lang: Column) -> Column:
    """Struct of everything the rules need of one text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.struct(
        _class_counts(text).alias("classes"),
        let(words, lambda w: _word_features(w, lang.cast("string"))).alias("words"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts; 0 where either is empty."""

    def share(x: Column) -> Column:
        total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"))
        return let(total, lambda t: F.transform(x, lambda v: F.when(t > 0, v / t).otherwise(0.0)))

    def bits(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)

    terms = F.zip_with(share(p), share(q), lambda a, b: (bits(a, (a + b) / 2) + bits(b, (a + b) / 2)) / 2)
    jsd = F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)))
    some = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double")) > 0
    return F.when(some(p) & some(q), jsd).otherwise(0.0)


def _char_histogram(m: Column) -> Column:
    return F.array(*[m["classes"][c] for c in [*CLASSES, "rest"]])


def _word_histogram(m: Column) -> Column:
    known = F.aggregate(m["words"]["common"], F.lit(0).cast("long"), lambda a, v: a + v)
    return F.concat(m["words"]["common"], F.array(m["words"]["n_words"] - known))


def base_failed(m: Column) -> Column:
    n = m["words"]["n_words"]
    return (n < MIN_WORDS) | (100 * m["words"]["n_repeat_words"] > MAX_REPEAT_PERCENT * n)


def _language(lang: Column) -> Column:
    return F.when(lang.isin(list(COMMON)), lang).otherwise("")


def references(measured: DataFrame, lang: str, m: str) -> DataFrame:
    """One row per language: summed histograms of the documents that pass the base rules."""
    total = lambda h, n: F.array(*[F.coalesce(F.sum(F.get(h, F.lit(i))), F.lit(0).cast("long")) for i in range(n)])
    widest = 1 + max(map(len, COMMON.values()))
    return (
        measured.where(~base_failed(F.col(m)))
        .select(_language(F.col(lang)).alias("ref_lang"), _char_histogram(F.col(m)).alias("c"), _word_histogram(F.col(m)).alias("w"))
        .groupBy("ref_lang").agg(total(F.col("c"), len(CLASSES) + 1).alias("ref_chars"), total(F.col("w"), widest).alias("ref_words")))


def _distances(m: Column, lang: Column, refs: DataFrame) -> tuple[Column, Column]:
    """Distances of the measured ``m`` to the references of its language.

    The references are one row per known language and one for the rest, of some
    twenty numbers each, whatever the size of the corpus.
    """
    rows = {r["ref_lang"]: r for r in refs.collect()}
    longs = lambda xs: F.array(*[F.lit(int(x)) for x in xs]).cast("array<bigint>")
    pick = lambda field, n: F.coalesce(
        *[F.when(_language(lang) == k, longs(r[field][: n(k)])) for k, r in sorted(rows.items())], F.array().cast("array<bigint>"))
    return (
        _distance(_char_histogram(m), pick("ref_chars", lambda k: len(CLASSES) + 1)),
        _distance(_word_histogram(m), pick("ref_words", lambda k: 1 + len(COMMON.get(k, ())))))


def judged(docs: DataFrame, keep: list[str], name: str = "quality_rules") -> tuple[DataFrame, str]:
    """``keep`` columns of ``docs`` and one struct column with counts, distances and verdict.

    The name of the struct is returned too: underscores are added if ``docs``
    has a column of that name. Texts are read once; the measured rows are
    written to the scratch folder, because references and verdicts both read them.
    """
    name = free_name(docs, name)
    lang = free_name(docs, "rules_lang")
    tongue = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    measured = materialise(
        docs.select(*[F.col(f"`{c}`") for c in keep], tongue.alias(lang), measures(F.col("text"), tongue).alias(name)), "rules")
    m = F.col(name)
    chars, words = _distances(m, F.col(lang), references(measured, lang, name))
    near = measured.where((chars <= TRIM_CHAR_DISTANCE) & (words <= TRIM_WORD_DISTANCE))
    chars, words = _distances(m, F.col(lang), references(near, lang, name))
    n_chars = reduce(lambda a, b: a + b, [m["classes"][c] for c in [*CLASSES, "rest"]])
    out = measured.withColumn(name, F.struct(
        m["words"]["n_words"].alias("n_words"),
        (n_chars - m["classes"]["space"]).alias("word_chars"),
        m["classes"]["symbol"].alias("n_symbols"),
        m["n_dup_lines"].alias("n_dup_lines"),
        m["words"]["n_repeat_words"].alias("n_repeat_words"),
        base_failed(m).alias("base_failed"),
        F.when(n_chars >= MIN_CHARS_JUDGED, chars).otherwise(0.0).alias("char_distance"),
        F.when(m["words"]["n_words"] >= MIN_WORDS_JUDGED, words).otherwise(0.0).alias("word_distance")))
    v = F.col(name)
    kept = ~v["base_failed"] & (v["char_distance"] <= MAX_CHAR_DISTANCE) & (v["word_distance"] <= MAX_WORD_DISTANCE)
    return out.withColumn(name, v.withField("kept", kept)).drop(lang), name


def passing(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns only."""
    out, name = judged(docs, docs.columns)
    return out.where(F.col(name)["kept"]).select(*[F.col(f"`{c}`") for c in docs.columns])
