"""Column functions on strings: names, paths, slugs, tokens, citations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from stratadoc import fixed_values as fv


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is named, and written into the plan once."""
    return F.transform(F.array(value), use)[0]


def strip(c) -> Column:
    """Trim every Unicode white-space character, not only the ASCII space."""
    return F.btrim(col(c), F.lit(fv.WHITESPACE))


def tokens(c) -> Column:
    """Lower-cased runs of letters and digits of any script; all other characters separate."""
    return F.array_remove(F.split(F.lower(col(c)), r"[^\p{L}\p{N}]+"), "")


def filename(path, ordinal) -> Column:
    """Last path part; a missing path is named after its ordinal."""
    path = col(path)
    named = F.substring_index(path, "/", -1)
    return F.when(F.coalesce(path, F.lit("")) != "", named).otherwise(
        F.concat(F.lit("object_"), col(ordinal).cast("string"))
    )


def extension(name) -> Column:
    name = col(name)
    return F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", -1)).otherwise(F.lit("bin"))


def object_key(user, file_id, name) -> Column:
    return F.concat(F.lit("uploads/"), col(user), F.lit("/"), col(file_id), F.lit("."), extension(name))


def url_path(url) -> Column:
    """Path part of a URL, tolerant of malformed ones; parameters of the last segment are cut."""
    path = F.regexp_extract(col(url), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(path, ";[^/]*$", "")


def slug(url) -> Column:
    """File-name stem made from the URL path."""
    parts = F.filter(F.split(url_path(url), "/"), lambda p: (p != "") & (p != "docs"))
    joined = F.regexp_replace(F.array_join(parts, "_"), "[^a-zA-Z0-9._-]+", "_")
    cut = F.substring(F.btrim(joined, F.lit("_")), 1, fv.SLUG_CHARS)
    return (
        F.when(F.size(parts) == 0, F.lit("home"))
        .when(cut == "", F.lit("page"))
        .otherwise(cut)
    )


def section(path, sections=fv.SECTIONS, default: str = "other") -> Column:
    """Label of the first prefix the path starts with."""
    path = col(path)
    label = F.lit(default)
    for prefix, name in reversed(sections):
        label = F.when(path.startswith(prefix), F.lit(name)).otherwise(label)
    return label


def excerpt(c, chars: int = fv.EXCERPT_CHARS) -> Column:
    return F.concat(F.substring(col(c), 1, chars), F.lit("..."))


def cited(text, source) -> Column:
    return F.concat(col(text), F.lit(" [Source: "), col(source), F.lit("]"))


def cited_excerpt(text, source, page) -> Column:
    return F.concat(
        F.lit("- Content: "),
        excerpt(F.coalesce(col(text), F.lit(""))),
        F.lit(" [Source: "),
        F.coalesce(col(source), F.lit("Unknown")),
        F.lit(", Page: "),
        F.coalesce(col(page).cast("string"), F.lit("N/A")),
        F.lit("]\n"),
    )


def history_lines(messages) -> Column:
    """One ``role: content`` line per message."""
    return F.array_join(
        F.transform(col(messages), lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n"
    )


def title_rule(title, char: str = "=") -> Column:
    """The character repeated to the title's length."""
    return F.repeat(F.lit(char), F.length(col(title)))


def counter_key(client) -> Column:
    return F.concat(F.lit("rate_limit:"), col(client).cast("string"))


def content_id(c) -> Column:
    """md5 hex of text or bytes: the same content always has the same id."""
    return F.md5(col(c))


def random_id(hexadecimal: bool = False) -> Column:
    """Random uuid; never use it as a key that a replay has to find again."""
    return F.replace(F.uuid(), F.lit("-"), F.lit("")) if hexadecimal else F.uuid()


def now_iso() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def merge_maps(base, override) -> Column:
    """Map union in which the second map wins on a shared key."""
    base, override = col(base), col(override)
    kept = F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(override), k))
    return F.map_concat(kept, override)


def fill(template: str, **values) -> Column:
    """Template whose ``{name}`` places are replaced by columns; other braces stay as they are."""
    pieces, rest = [], template
    while True:
        at = {name: rest.find("{" + name + "}") for name in values}
        at = {name: pos for name, pos in at.items() if pos >= 0}
        if not at:
            break
        name = min(at, key=at.get)
        pieces += [F.lit(rest[: at[name]]), F.coalesce(col(values[name]), F.lit(""))]
        rest = rest[at[name] + len(name) + 2 :]
    return F.concat(*pieces, F.lit(rest))
