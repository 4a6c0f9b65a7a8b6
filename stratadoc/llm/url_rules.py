"""URL filtering by pattern rules that are indexed by their rarest literal token.

Every rule has a regular expression and literal tokens that each matching URL must hold. How many pages
hold each token is counted over the whole table; a rule is filed under its rarest one. A URL's tokens
fetch the rules filed under them, and only those run their expressions. The longest matching host rule
decides; where none matches, a pattern rule does, and else the default verdict.

The rule list is a parameter and stands on the driver anyway, so its index is broadcast; the counts that
come back are one row per token of the rules.

Defined results: a null URL, or one without ``://``, has an empty host and path and only pattern rules
can match it; rows with equal or null ids are judged one by one; other columns are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stratadoc.llm.common import narrow, ready

_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
_TOKEN = re.compile(r"[a-z0-9]+")
_SPLIT = re.compile(r"://([^/?#]*)([^?#]*)")


def split_url(url: str | None) -> tuple[str, str]:
    """Host, in lower case, and path of a URL."""
    found = _SPLIT.search(url or "")
    return (found[1].translate(_ASCII_LOWER), found[2]) if found else ("", "")


def tokens(text: str) -> set[str]:
    """Runs of ASCII letters and digits, in lower case."""
    return set(_TOKEN.findall(text.translate(_ASCII_LOWER)))


@dataclass(frozen=True)
class Rule:
    """A rule on the host and path (``kind="host"``) or on the whole URL (``kind="pattern"``)."""

    text: str
    verdict: str
    expression: str
    literals: frozenset[str]
    kind: str
    path: str = ""


def host_rule(verdict: str, text: str) -> Rule:
    """A rule like ``example.net/en/``: its host and all subdomains, paths that start alike."""
    slash = text.index("/")
    host, path = text[:slash], text[slash:]
    # The path may go on after the rule's last token, which is therefore no whole token of the URL.
    whole = path[: len(path) - len(re.search(r"[A-Za-z0-9]*\Z", path)[0])]
    expression = rf"(?s)(?:.*\.)?{re.escape(host)}"
    return Rule(text, verdict, expression, frozenset(tokens(host) | tokens(whole)), "host", path)


def pattern_rule(verdict: str, expression: str, *literals: str) -> Rule:
    """A regular expression on the URL, and whole tokens without which it cannot match."""
    return Rule(expression, verdict, expression, frozenset(literals), "pattern")


RULES = (
    host_rule("block", "net/"),
    host_rule("allow", "example.net/en/"),
    host_rule("block", "example.com/de/"),
    host_rule("allow", "org/fr/"),
    pattern_rule("block", r"(?i)[./?=&_-]casino[./?=&_-]", "casino"),
    pattern_rule("block", r"(?i)[./?=&_-]porn[./?=&_-]", "porn"),
    pattern_rule("block", r"(?i)[./?=&_-]free-torrent[./?=&_-]", "free", "torrent"),
)


def rarest_tokens(pages: DataFrame, rules: Sequence[Rule]) -> dict[str, int]:
    """How many of ``pages`` hold each token of the rules, over all rows."""
    wanted = frozenset().union(*[r.literals for r in rules]) if rules else frozenset()
    if not wanted:
        return {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = defaultdict(int)
        for batch in batches:
            for url in batch.column("url").to_pylist():
                for token in tokens(url or "") & wanted:
                    total[token] += 1
        yield pa.RecordBatch.from_pydict({"token": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

    sums = pages.mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {row["token"]: row["n"] for row in sums.collect()}


def index_rules(rules: Sequence[Rule], counts: dict[str, int]) -> dict[str | None, list[int]]:
    """Rules by their rarest token; rules without a literal stand under None and are always run."""
    index: dict[str | None, list[int]] = defaultdict(list)
    for number, rule in enumerate(rules):
        index[min(rule.literals, key=lambda t: (counts.get(t, 0), t), default=None)].append(number)
    return dict(index)


def judge(
    pages: DataFrame, rules: Sequence[Rule] = RULES, default: str = "allow", page_id: str = "page_id", url: str = "url"
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every page; ``rule`` is that of a host rule."""
    spark = ready(pages.sparkSession)
    pages = narrow(pages, page_id=page_id, url=url)
    # Plain values, so that tasks can read them without this package.
    plain = [(r.text, r.verdict, r.expression, r.kind, r.path) for r in rules]
    index = spark.sparkContext.broadcast((plain, index_rules(rules, rarest_tokens(pages, rules))))
    id_type = dict(pages.dtypes)["page_id"]

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, filed = index.value
        compiled: dict[int, re.Pattern] = {}

        def matches(number: int, host: str, path: str, url: str) -> bool:
            _, _, expression, kind, start = own[number]
            if number not in compiled:
                compiled[number] = re.compile(expression)
            if kind == "host":
                return path.startswith(start) and bool(compiled[number].fullmatch(host))
            return bool(compiled[number].search(url))

        for batch in batches:
            out = []
            for address in batch.column("url").to_pylist():
                address = address or ""
                host, path = split_url(address)
                found = list(filed.get(None, ()))
                for token in tokens(address):
                    found += filed.get(token, ())
                hits = [own[n] for n in found if matches(n, host, path, address)]
                hits.sort(key=lambda r: (-len(r[0]), r))
                best = next((r for r in hits if r[3] == "host" and host), None)
                decided = best or next((r for r in hits if r[3] == "pattern"), None)
                out.append((host, path, best[0] if best else None, decided[1] if decided else default))
            columns = [pa.array(c, pa.string()) for c in zip(*out)] if out else [pa.array([], pa.string())] * 4
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *columns], names=["page_id", "host", "path", "rule", "verdict"])

    return pages.mapInArrow(decide, f"page_id {id_type}, host string, path string, rule string, verdict string")
