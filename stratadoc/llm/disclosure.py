"""Personal data and the terms that give it away, with DataFrame functions alone.

Base spans are found by patterns: e-mail addresses, IP addresses, card numbers, telephone numbers. Each
distinct value is a protected entity. Terms are words of four letters or more, anywhere in a text. Over the
whole corpus it is counted how many documents hold an entity, a term, and both. A term's pointwise mutual
information with an entity is compared with the entity's information content: at a share of 1 the term alone
tells the entity. Terms that reach ``DISCLOSURE`` and stand with the entity in at least ``LEAST_DOCUMENTS``
documents become spans, wherever they stand in a document that mentions the entity. ``sanitised`` replaces
spans by the name of their kind.

An entity in fewer documents than that has no terms, and a term cannot reach the threshold if it stands in more
than ``N ** (1 - d) * n_entity ** d`` of ``N`` documents; so common words are left out, by their counts, before
any entity meets its words. Equal texts are worked on once and weigh as many as they are.

The patterns are the given ones, written so that Java matches them without backtracking: a quantifier
is possessive where the next character could not be matched by it, and a match may only begin where a run
begins or the last match ended. Card patterns start at 16 digits, as shorter runs are no cards.

Defined results: a null text is empty and stays null in ``sanitised``; rows without an id, and rows that share
one, are documents like any other; an empty table gives no row; other columns are kept by
``sanitised`` and not read otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from stratadoc.llm.common import narrow, ready
from stratadoc.session import durable

LEAST_DOCUMENTS = 3
DISCLOSURE = 0.8
TERM = r"\p{L}{4,}+"
TERM_KIND = "term"
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){15,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A character without which a kind cannot occur.
SIGNS = {"email": "@", "ip": ".", "phone": "+"}
SPAN = "struct<kind:string,start:int,end:int,value:string>"
_ORDERED = "array<struct<start:int,end:int,kind:string>>"


def matches(text: Column, pattern: Column, kind: str) -> Column:
    """Places and values of all matches, leftmost first, in code points.

    The text between the matches and the matches themselves give the places as a running sum of lengths.
    """
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    none = F.array().cast(f"array<{SPAN}>")

    def add(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["between"])
        end = start + F.length(pair["found"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), pair["found"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    pairs = F.arrays_zip(between.alias("between"), found.alias("found"))
    zero = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    return F.when(F.size(found) > 0, F.aggregate(pairs, zero, add, lambda state: state["spans"])).otherwise(none)


def _luhn(digits: Column) -> Column:
    """Whether digits, given in reverse order, pass the check sum."""

    def weight(digit: Column, place: Column) -> Column:
        value = digit.cast("int") * (1 + place % 2)
        return F.when(value > 9, value - 9).otherwise(value)

    weighed = F.transform(F.split(digits, ""), weight)
    return F.aggregate(weighed, F.lit(0), lambda total, x: total + x) % 10 == 0


def _sound(kind: str, value: Column) -> Column:
    """Whether a match is kept."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: part.cast("double") <= 255)
    if kind == "card":
        return (F.length(digits) <= 19) & _luhn(F.reverse(digits))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _keeper(kind: str) -> Callable[[Column], Column]:
    return lambda span: _sound(kind, span["value"])


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def base_spans(text: Column) -> Column:
    """Base spans by kind, then by start."""
    parts = []
    for kind, pattern in PATTERNS.items():
        found = F.filter(matches(text, F.lit(pattern), kind), _keeper(kind))
        sign = SIGNS.get(kind)
        parts.append(F.when(F.contains(text, F.lit(sign)), found).otherwise(F.array().cast(f"array<{SPAN}>")) if sign else found)
    return F.concat(*parts)


def term_spans(text: Column, terms: Column) -> Column:
    """Whole words of ``text`` that are among ``terms``, in any case; no terms, no spans."""
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.array_sort(terms), "|"), F.lit(r")(?!\p{L})"))
    none = F.array().cast(f"array<{SPAN}>")
    return F.when(F.size(terms) > 0, matches(text, pattern, TERM_KIND)).otherwise(none)


def find_base(docs: DataFrame) -> DataFrame:
    """``doc_id, of, spans`` per row of ``(doc_id, text)``, ``of`` being the text's hash. Stored."""
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", text.alias("text"), base_spans(text).alias("spans"))
    return durable(found.select("doc_id", F.xxhash64("text").alias("of"), "spans"))


def entities_of(found: DataFrame, least_documents: int) -> DataFrame:
    """``of, weight, entity, n_entity`` of entities in enough documents; ``weight`` is the number of equal texts. Stored."""
    entity = F.array_distinct(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["value"])))
    named = found.where(F.size("spans") > 0).select("of", F.explode(entity).alias("entity"))
    mentions = named.groupBy("of", "entity").agg(F.count("*").alias("weight"))
    counts = mentions.groupBy("entity").agg(F.sum("weight").alias("n_entity")).where(F.col("n_entity") >= least_documents)
    return durable(mentions.join(counts, "entity").select("of", "weight", "entity", "n_entity"))


def together(docs: DataFrame, found: DataFrame, disclosure: float, least_documents: int) -> DataFrame:
    """``of, weight, entity, n_entity, term, n_term``: entities with the words of their texts that are rare enough. Stored."""
    named = entities_of(found, least_documents)
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term")
    largest = named.agg(F.max("n_entity")).first()[0]
    if largest is None:
        return named.select("*", F.lit("").alias("term"), F.lit(0).cast("long").alias("n_term"))
    rows = docs.count()

    def most(n_entity) -> Column:
        return F.lit(rows ** (1 - disclosure) * (1 + 1e-9)) * F.pow(n_entity, F.lit(disclosure))

    counts = docs.select(words).groupBy("term").agg(F.count("*").alias("n_term"))
    counts = durable(counts.where((F.col("n_term") >= least_documents) & (F.col("n_term") <= most(F.lit(largest)))))
    texts = docs.select(F.xxhash64("text").alias("of"), "text").join(named.select("of").distinct(), "of", "left_semi")
    held = texts.select("of", words).distinct().join(counts, "term")
    return durable(named.join(held, "of").where(F.col("n_term") <= most(F.col("n_entity"))))


def disclosing_terms(pairs: DataFrame, n_docs: int, disclosure: float, least_documents: int) -> DataFrame:
    """``entity, term`` of the terms that give an entity away. Stored."""
    counts = pairs.groupBy("entity", "n_entity", "term", "n_term").agg(F.sum("weight").alias("n_both"))
    information = F.log2(F.lit(n_docs) / F.col("n_entity"))
    mutual = F.log2(F.col("n_both") * F.lit(n_docs) / (F.col("n_term") * F.col("n_entity")))
    enough = (F.col("n_both") >= least_documents) & (information > 0)
    return durable(counts.where(enough & (mutual >= disclosure * information)).select("entity", "term"))


def terms_of_texts(docs: DataFrame, found: DataFrame, disclosure: float = DISCLOSURE, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """``of, terms``: what has to go from the texts that mention an entity. Stored."""
    pairs = together(docs, found, disclosure, least_documents)
    telling = disclosing_terms(pairs, docs.count(), disclosure, least_documents)
    own = pairs.select("of", "entity", "term").join(telling, ["entity", "term"], "left_semi").select("of", "term").distinct()
    return durable(own.groupBy("of").agg(F.collect_list("term").alias("terms")))


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and places of personal data per row."""
    ready(docs.sparkSession)
    docs = narrow(docs, doc_id=doc_id, text=text)
    found = find_base(docs)
    terms = terms_of_texts(docs, found)
    texts = docs.select(F.xxhash64("text").alias("of"), "text").join(terms, "of")
    added = texts.select("of", listed(term_spans(F.col("text"), F.col("terms"))).alias("added")).distinct()
    return found.join(added, "of", "left").select(
        "doc_id",
        *[F.size(F.filter("spans", _of_kind(kind))).cast("long").alias(f"n_{kind}") for kind in PATTERNS],
        F.sha2(listed(F.col("spans")), 256).alias("base_sha256"),
        F.concat_ws(",", F.when(F.size("spans") > 0, listed(F.col("spans"))), "added").alias("spans"),
    )


def sanitised(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns, with spans of ``text`` replaced by the name of their kind in brackets."""
    ready(docs.sparkSession)
    own = narrow(docs, doc_id=doc_id, text=text)
    found = find_base(own)
    terms = terms_of_texts(own, found)
    # The row travels as one value, so that none of its names can clash.
    packed = docs.select(F.xxhash64(F.col(f"`{text}`")).alias("of"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    source = F.col("row").getField(text)
    added = F.coalesce(term_spans(source, F.col("terms")), F.array().cast(f"array<{SPAN}>"))
    spans = F.concat(base_spans(source), added)
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"])))
    marked = packed.join(terms, "of", "left").select("row", F.coalesce(ordered, F.array().cast(_ORDERED)).alias("spans"))

    def replace(state: Column, span: Column) -> Column:
        fresh = span["start"] >= state["at"]
        kept = F.substring(source, state["at"] + 1, span["start"] - state["at"])
        out = F.when(fresh, F.concat(state["out"], kept, F.lit("["), F.upper(span["kind"]), F.lit("]"))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), out.alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = F.length(source) + 1
    replaced = F.aggregate("spans", zero, replace, lambda s: F.concat(s["out"], F.substring(source, s["at"] + 1, rest)))
    clean = F.when(F.size("spans") > 0, replaced).otherwise(source)
    return marked.select(*[(clean if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns])
