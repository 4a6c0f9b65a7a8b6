"""Quality rules as one projection, with DataFrame functions alone.

``RULES`` is a table of thresholds: a measure, a measure it is held against, and the lowest and highest
share. ``verdict`` compiles the table into one Boolean column. Shares are compared in whole numbers
(``1000 * measure`` with ``per_mille * base``), so that nothing depends on rounding.

Measures count words (runs without white space), their characters, symbols, capitals, frequent function
words, lines with a word, lines that repeat an earlier one, lines that begin as list items or break off, and
words inside three-word windows that occur twice or more. Windows are sorted by hash and place, and those whose
hash repeats by their text, so equal ones stand together: the work grows with the length of a text, not with its
square, and a collision of hashes changes nothing.

Defined results: a null text has no words and fails; a row without an id is judged like any other; rows that
repeat are judged each; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from stratadoc.llm.common import narrow, ready

LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
#: Bits and digits of a place; no text has as many words.
PLACE_BITS = 31
PLACE_DIGITS = 10
STOP_WORDS = (
    "a", "an", "and", "as", "at", "by", "for", "from", "in", "is", "it", "of", "on", "that", "the", "this", "to", "was", "with",
    "das", "den", "der", "die", "ein", "eine", "ist", "sich", "und", "von", "zu",
    "de", "des", "du", "en", "est", "et", "la", "le", "les", "que", "un",
    "del", "el", "los", "las", "para", "por", "se", "y",
)


@dataclass(frozen=True)
class Rule:
    """``measure`` must be between ``low`` and ``high`` per mille of ``base``; None is no limit."""

    name: str
    measure: str
    base: str
    low: int | None = None
    high: int | None = None


RULES = (
    Rule("word_length", "word_chars", "n_words", 2_500, 12_000),
    Rule("symbols", "n_symbols", "n_words", None, 100),
    Rule("stop_words", "n_stop_words", "n_words", 10, None),
    Rule("capitals", "n_capitals", "word_chars", None, 400),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 400),
    Rule("list_lines", "n_list_lines", "n_lines", None, 900),
    Rule("broken_lines", "n_broken_lines", "n_lines", None, 300),
)


def passes(rule: Rule) -> Column:
    """Whether a row with all measures keeps one rule."""
    value, base = F.col(rule.measure) * 1000, F.col(rule.base)
    limits = [value >= base * rule.low] if rule.low is not None else []
    limits += [value <= base * rule.high] if rule.high is not None else []
    out = F.lit(True)
    for limit in limits:
        out = out & limit
    return out


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The whole table as one Boolean column."""
    out = F.lit(True)
    for rule in rules:
        out = out & passes(rule)
    return out


def _ordered(words: Column) -> Column:
    """Hash of each three-word window, as far as it fits beside the window's place, in order."""
    later = [F.slice(words, k, F.greatest(F.size(words), F.lit(1))) for k in (2, 3)]
    hashed = F.zip_with(F.zip_with(words, later[0], lambda a, b: F.xxhash64(a, b)), later[1], lambda h, c: F.xxhash64(h, c))
    hashed = F.slice(hashed, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))
    place = F.lit((1 << PLACE_BITS) - 1)
    return F.sort_array(F.transform(hashed, lambda h, k: h.bitwiseAND(F.bitwise_not(place)).bitwiseOR(k.cast("long"))))


def _candidates(ordered: Column) -> Column:
    """Places of windows whose hash occurs twice or more."""
    place = F.lit((1 << PLACE_BITS) - 1)
    following = F.slice(ordered, 2, F.greatest(F.size(ordered), F.lit(1)))
    # Neighbours that differ in their place alone; the last one has none after it.
    pairs = F.zip_with(ordered, following, lambda x, y: F.when(F.shiftrightunsigned(x.bitwiseXOR(y), PLACE_BITS) == 0, F.array(x, y)))
    return F.array_distinct(F.transform(F.flatten(F.array_compact(pairs)), lambda x: x.bitwiseAND(place).cast("int")))


def _windows(words: Column, places: Column) -> Column:
    """Windows at ``places`` in order of their text, each with its place behind it."""
    number = lambda k: F.lpad(k.cast("string"), PLACE_DIGITS, "0")
    return F.sort_array(F.transform(places, lambda k: F.concat_ws(" ", F.get(words, k), F.get(words, k + 1), F.get(words, k + 2), number(k))))


def _repeated_places(windows: Column) -> Column:
    """Places of windows that occur twice or more, in ascending order."""
    before = F.concat(F.array(F.lit("")), windows)
    after = F.concat(F.slice(windows, 2, F.greatest(F.size(windows), F.lit(1))), F.array(F.lit("")))
    text = lambda x: F.left(x, F.length(x) - PLACE_DIGITS)
    place = lambda x: F.right(x, F.lit(PLACE_DIGITS)).cast("int")
    # ``before`` is one longer; its last pair has no window and gives null.
    neighbours = F.arrays_zip(windows.alias("w"), before.alias("b"), after.alias("a"))
    found = F.filter(neighbours, lambda x: x["w"].isNotNull() & ((text(x["w"]) == text(x["b"])) | (text(x["w"]) == text(x["a"]))))
    return F.sort_array(F.transform(found, lambda x: place(x["w"])))


def _covered(places: Column) -> Column:
    """Words inside windows that begin at ``places``."""
    following = F.slice(places, 2, F.greatest(F.size(places), F.lit(1)))
    steps = F.zip_with(places, following, lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)


def _matching(lines: Column, pattern: str) -> Column:
    return F.size(F.filter(lines, lambda line: line.rlike(pattern))).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """All measures of ``(doc_id, text)``."""
    text = F.coalesce("text", F.lit(""))
    split = docs.select(
        "doc_id",
        text.alias("text"),
        F.filter(F.split(text, r"[\x20\x09-\x0D]++", -1), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    # Each step is a column of its own, since what it names twice would be worked out twice.
    ordered = split.select("*", _ordered(F.col("words")).alias("ordered"))
    found = ordered.select("*", _candidates(F.col("ordered")).alias("candidates"))
    windowed = found.select("*", _windows(F.col("words"), F.col("candidates")).alias("windows"))
    placed = windowed.select("*", _repeated_places(F.col("windows")).alias("places"))
    lowered = lambda w: F.translate(w, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    stops = F.filter("words", lambda w: (F.length(w) <= max(map(len, STOP_WORDS))) & lowered(w).isin(*STOP_WORDS))
    return placed.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("places")).alias("n_repeat_words"),
        F.size(stops).cast("long").alias("n_stop_words"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.size("lines").cast("long").alias("n_lines"),
        _matching(F.col("lines"), r"^[\x20\x09-\x0D]*[-*•]").alias("n_list_lines"),
        _matching(F.col("lines"), r"(\.\.\.|…)[\x20\x09-\x0D]*$").alias("n_broken_lines"),
    )


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All measures per row, ``base_failed``, ``kept``, and the names of the rules that a row breaks."""
    ready(docs.sparkSession)
    found = measured(narrow(docs, doc_id=doc_id, text=text))
    few = F.col("n_words") < LEAST_WORDS
    repeats = 100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")
    failed = found.withColumn("base_failed", few | repeats)
    broken = F.array_compact(F.array(*[F.when(~passes(rule), F.lit(rule.name)) for rule in rules]))
    return failed.select("*", (~F.col("base_failed") & verdict(rules)).alias("kept"), F.array_join(broken, ",").alias("broken_rules"))
