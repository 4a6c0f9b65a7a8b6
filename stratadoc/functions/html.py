"""HTML to text as native column chains, with one small helper for nested selectors."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from stratadoc import fixed_values as fv
from stratadoc.functions.text import col, let, strip

_JUNK = r"(?is)<(script|style|noscript)\b[^>]*>.*?(?:</\1\s*>|\z)"
_COMMENT = r"(?s)<!--.*?-->"
_TAG = r"(?s)<[^>]*>"
# Entities decoded natively; amp comes last so that nothing is decoded twice.
_ENTITIES = (
    ("&nbsp;", "\u00a0"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&apos;", "'"),
    ("&copy;", "©"),
    ("&middot;", "·"),
)
_NUMERIC = r"^(?:[xX]0*([0-9a-fA-F]*)|0*([0-9]*));"
_NUMBER = r"^(?:[xX][0-9a-fA-F]+|[0-9]+);"
# What references to 128 .. 159 stand for; the gaps stand for themselves.
_WINDOWS_1252 = (
    "\u20ac\u0081\u201a\u0192\u201e\u2026\u2020\u2021\u02c6\u2030\u0160\u2039\u0152\u008d\u017d\u008f"
    "\u0090\u2018\u2019\u201c\u201d\u2022\u2013\u2014\u02dc\u2122\u0161\u203a\u0153\u009d\u017e\u0178"
)
_NAMED = r"&(?!(?:nbsp|lt|gt|quot|apos|copy|middot|amp);)[A-Za-z][A-Za-z0-9]*;"


def _numeric(piece: Column) -> Column:
    """What follows ``&#``, with the number at its head decoded; as it was if there is none."""
    hexa = F.regexp_extract(piece, _NUMERIC, 1)
    deci = F.regexp_extract(piece, _NUMERIC, 2)
    number = F.when(F.lower(F.substring(piece, 1, 1)) == "x", F.conv(F.substring(hexa, 1, 7), 16, 10)).otherwise(
        F.substring(deci, 1, 8)
    )
    # Seven hex or eight decimal digits are beyond the last character anyway.
    code = F.coalesce(F.nullif(number, F.lit("")).try_cast("long"), F.lit(0))
    none = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    safe = F.when(none, F.lit(0xFFFD)).otherwise(code)
    char = F.when(
        safe.between(128, 159), F.substring(F.lit(_WINDOWS_1252), (safe - 127).cast("int"), F.lit(1))
    ).otherwise(F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32"))
    tail = F.regexp_replace(piece, _NUMBER, "")
    return F.when(F.regexp_like(piece, F.lit(_NUMBER)), F.concat(char, tail)).otherwise(F.concat(F.lit("&#"), piece))


def _decoded(text: Column, sign: str, decode: Callable[[Column], Column]) -> Column:
    """A text cut at ``sign``, with every part behind one decoded."""
    parts = F.split(text, sign)
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), decode)
    return F.concat(F.element_at(parts, 1), F.array_join(rest, ""))


def _all_references(text: Column) -> Column:
    """Numbers and all names of HTML 5, each decoded once."""
    # A constant of the plan: Python's own list, read as a map when the query is optimised.
    names = F.from_json(F.lit(json.dumps({n: c for n, c in html5.items() if n.endswith(";")})), "map<string,string>")

    def decode(piece: Column) -> Column:
        name = F.regexp_extract(piece, "^([A-Za-z][A-Za-z0-9]*;)", 1)
        char = F.try_element_at(names, name)
        named = F.coalesce(F.concat(char, F.substr(piece, F.length(name) + 1)), F.concat(F.lit("&"), piece))
        return F.when(F.startswith(piece, F.lit("#")), _numeric(F.substr(piece, F.lit(2)))).otherwise(named)

    return _decoded(text, "&", decode)


def unescape(c, all_names: bool = False) -> Column:
    """Decode entities; with ``all_names`` the full HTML 5 list.

    Texts with the usual names alone are decoded by plain replacements, others part by part.
    """

    def decode(whole: Column) -> Column:
        text = whole
        for name, char in _ENTITIES:
            text = F.replace(text, F.lit(name), F.lit(char))
        numbers = let(text, lambda t: F.when(F.contains(t, F.lit("&#")), _decoded(t, "&#", _numeric)).otherwise(t))
        usual = F.replace(numbers, F.lit("&amp;"), F.lit("&"))
        return F.when(F.regexp_like(whole, F.lit(_NAMED)), _all_references(whole)).otherwise(usual) if all_names else usual

    # Most texts hold no reference at all.
    return let(col(c), lambda whole: F.when(F.contains(whole, F.lit("&")), decode(whole)).otherwise(whole))


def _pieces(text: Column, pattern: str) -> Column:
    parts = F.transform(F.split(text, pattern), lambda p: strip(p))
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n")


def clean_text(c) -> Column:
    """Readable text of a page: no script, style or noscript bodies, one trimmed piece per line."""
    text = F.regexp_replace(col(c), _JUNK, "\n")
    text = F.regexp_replace(F.regexp_replace(text, _COMMENT, "\n"), _TAG, "\n")
    return _pieces(unescape(text, all_names=True), "\\n|  ")


def plain_text(c) -> Column:
    """All text nodes of a fragment, trimmed, one per line."""
    text = F.regexp_replace(F.regexp_replace(col(c), _COMMENT, "\u0001"), _TAG, "\u0001")
    parts = F.transform(F.split(unescape(text, all_names=True), "\u0001"), lambda p: strip(p))
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n")


def page_title(c, default: str = "Untitled") -> Column:
    raw = F.regexp_extract(col(c), r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)
    has_title = F.regexp_like(col(c), F.lit(r"(?i)<title\b"))
    return F.when(has_title, unescape(raw, all_names=True)).otherwise(F.lit(default))


def article_title(c, default: str = fv.DEFAULT_TITLE) -> Column:
    """Title cut at the first bar; what is left empty falls back to the whole title."""

    def cut(whole: Column) -> Column:
        return let(strip(F.substring_index(whole, "|", 1)), lambda head: F.when(head != "", head).otherwise(whole))

    return unescape(let(strip(page_title(c, default)), cut))


class _Finder(HTMLParser):
    """Offsets of the elements that the article rules name; used on pages with nested candidates."""

    # Elements without an end tag.
    VOID = frozenset(
        "area base br col embed hr img input link meta param source track wbr".split()
    )

    def __init__(self, page: str) -> None:
        super().__init__(convert_charrefs=False)
        self.page = page
        self.starts = [0]
        for line in page.split("\n"):
            self.starts.append(self.starts[-1] + len(line) + 1)
        self.open: list[tuple[str, dict, int, int]] = []
        self.spans: list[tuple[str, dict, int, int, int, tuple]] = []
        self.feed(page)
        self.close()
        while self.open:
            self._end(len(page), len(page))

    def _at(self) -> int:
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def handle_starttag(self, tag, attrs):
        if tag not in self.VOID:
            begin = self._at()
            self.open.append((tag, dict(attrs), begin, begin + len(self.get_starttag_text())))

    def _end(self, inner_end: int, outer_end: int) -> None:
        tag, attrs, begin, inner = self.open.pop()
        parents = tuple((t, a) for t, a, _, _ in self.open)
        self.spans.append((tag, attrs, begin, inner, inner_end, outer_end, parents))

    def handle_endtag(self, tag):
        if any(entry[0] == tag for entry in self.open):
            here = self._at()
            while self.open[-1][0] != tag:
                self._end(here, here)
            self._end(here, self.page.find(">", here) + 1 or len(self.page))

    def first(self, wanted) -> tuple | None:
        found = [s for s in self.spans if wanted(s)]
        return min(found, key=lambda s: s[2]) if found else None


def _classes(attrs: dict) -> list[str]:
    return (attrs.get("class") or "").split()


def _is_maindoc(tag: str, attrs: dict) -> bool:
    return tag == "main" and attrs.get("id") == "maindoc"


def _nested_article(page: str) -> str | None:
    finder = _Finder(page)
    rules = (
        lambda s: "td-content" in _classes(s[1]) and any(_is_maindoc(*p) for p in s[6]),
        lambda s: _is_maindoc(s[0], s[1]),
        lambda s: s[0] == "article",
        lambda s: s[0] == "body",
    )
    main = next((hit for hit in map(finder.first, rules) if hit), None)
    if main is None:
        return None
    begin, end = main[3], main[4]
    out, at = [], begin
    for tag, attrs, start, _, _, stop, _ in sorted(finder.spans, key=lambda s: s[2]):
        noise = {"feedback", "td-toc"} & set(_classes(attrs)) or attrs.get("id") == "print"
        if noise and start >= at and stop <= end:
            out.append(page[at:start])
            at = stop
    return "".join(out) + page[at:end]


@F.pandas_udf(T.StringType())
def _nested_articles(pages: pd.Series) -> pd.Series:
    return pages.map(_nested_article, na_action="ignore")


def needs_nesting(c) -> Column:
    """Pages whose article cannot be cut out by one pattern: named containers or nested articles."""
    return F.regexp_like(
        col(c), F.lit(r"(?is)maindoc|\bfeedback\b|td-toc|id=.?print|<article\b.*<article\b")
    )


def article_html(c) -> Column:
    """Inner HTML of the main content: article, else body, natively; null where there is neither."""
    page = col(c)
    article = F.regexp_extract(page, r"(?is)<article\b[^>]*>(.*?)</article\s*>", 1)
    body = F.regexp_extract(page, r"(?is)<body\b[^>]*>(.*?)(?:</body\s*>|\z)", 1)
    return (
        F.when(F.regexp_like(page, F.lit(r"(?i)<article\b")), article)
        .when(F.regexp_like(page, F.lit(r"(?i)<body\b")), body)
    )


def article_html_nested(c) -> Column:
    """The same with nested selectors and the removal of feedback, print and contents boxes."""
    return _nested_articles(col(c))
