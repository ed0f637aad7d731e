"""Text functions as columns: everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and digits; whatever lies between parts tokens.
TOKEN = r"[\p{L}\p{N}]+"
# The category vocabulary.
CATEGORIES = ["decision", "preference", "pattern", "knowledge", "constraint"]


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapsed(c: Column | str) -> Column:
    """Runs of white space as one blank, none around."""
    return F.trim(F.regexp_replace(_c(c), r"\s+", " "))


def snippet(c: Column | str, size: int = 200) -> Column:
    """The first ``size`` characters on one line, with ``...`` where there is more. Null stays null."""
    c = _c(c)
    return F.concat(collapsed(F.substring(c, 1, size)), F.when(F.length(c) > size, F.lit("...")).otherwise(F.lit("")))


def clipped(c: Column | str, size: int = 160) -> Column:
    """One line of at most ``size`` characters, the last one ``…`` where text was cut."""
    one = collapsed(c)
    return F.when(F.length(one) > size, F.concat(F.substring(one, 1, size - 1), F.lit("…"))).otherwise(one)


def line_summary(c: Column | str, longer_than: int = 10, lines: int = 3, size: int = 300) -> Column:
    """The first ``lines`` lines whose trimmed length is above ``longer_than``, joined by line breaks and cut to ``size``."""
    kept = F.filter(F.split(_c(c), "\n"), lambda x: F.length(F.trim(x)) > longer_than)
    return F.substring(F.array_join(F.slice(kept, 1, lines), "\n"), 1, size)


def comparable(c: Column | str) -> Column:
    """Small letters, single blanks, no stop at the end: the form in which repeated facts are equal."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_c(c)), r"\s+", " "), r"[.!。]+$", ""))


def path_slug(c: Column | str) -> Column:
    """A path as a project slug: slashes, dots and underscores become dashes."""
    return F.regexp_replace(_c(c), r"[/._]", "-")


def encoded_path(c: Column | str) -> Column:
    """A path as a folder name: no slash at the end, all but letters and digits become dashes."""
    return F.regexp_replace(F.regexp_replace(_c(c), r"/+$", ""), r"[^A-Za-z0-9]", "-")


def tokens(c: Column | str) -> Column:
    """The words of a text in small letters. Null gives null."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(TOKEN), F.lit(0))


def capped_tokens(found: Column, longest: int = 6, most: int = 10) -> Column:
    """At most ``most`` tokens: the ``longest`` longest (ties by the token) and those that look like identifiers."""
    unique = F.array_distinct(found)
    ranked = F.transform(F.array_sort(F.transform(unique, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda s: s["t"])
    marked = F.filter(unique, lambda t: t.rlike(r"\d") | t.rlike(r"^[A-Z]{2,4}$"))
    return F.when(F.size(found) <= longest, unique).otherwise(F.slice(F.array_distinct(F.concat(F.slice(ranked, 1, longest), marked)), 1, most))


def exchange_id(archive: Column | str, first: Column | str, last: Column | str) -> Column:
    """The id of an exchange: md5 of its archive and its first and last line."""
    return F.md5(F.concat(_c(archive), F.lit(":"), _c(first).cast("string"), F.lit("-"), _c(last).cast("string")))


def category_of(c: Column | str) -> Column:
    """One of the category vocabulary: itself, the first valid part of an ``a|b`` echo, constraint for requirements, else knowledge."""
    v = F.lower(F.trim(_c(c)))
    parts = F.filter(F.transform(F.split(v, r"\|"), lambda x: F.trim(x)), lambda x: x.isin(CATEGORIES))
    return F.when(v.isin(CATEGORIES), v).when(v.isin("requirement", "requirements"), "constraint").when(v.contains("|") & (F.size(parts) > 0), parts[0]).otherwise("knowledge")


def unit_interval(c: Column | str) -> Column:
    """Clamped to 0..1; null and what is not finite give null."""
    c = _c(c)
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))


def short_tool(c: Column | str) -> Column:
    """A tool name without the prefix of its server."""
    return F.regexp_replace(_c(c), r"^mcp__[^_]+_[^_]+__", "")


def session_key(c: Column | str) -> Column:
    """A session id safe as a file name: letters, digits, ``_`` and ``-``, at most 80; null under 4 characters."""
    v = F.substring(F.regexp_replace(_c(c), r"[^A-Za-z0-9_-]", ""), 1, 80)
    return F.when(F.length(v) >= 4, v)


def is_main_conversation(path: Column | str) -> Column:
    """Whether the file's name is a UUID, as those of main conversations are."""
    return F.coalesce(F.element_at(F.split(_c(path), "/"), -1).rlike(r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\.jsonl$"), F.lit(False))


def summary_of(c: Column | str) -> Column:
    """What stands between ``<summary>`` marks; the whole text, trimmed, where there are none."""
    m = F.trim(F.regexp_extract(_c(c), r"(?s)<summary>(.*?)</summary>", 1))
    return F.when(m != "", m).otherwise(F.trim(_c(c)))


def json_of(c: Column | str) -> Column:
    """The JSON of a model's answer: a fenced block, else the widest ``[...]``, else the widest ``{...}``; null if none parses."""
    c = _c(c)
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    text = F.when(fenced != "", fenced).when(c.rlike(r"(?s)\[.*\]"), F.regexp_extract(c, r"(?s)(\[.*\])", 1)).otherwise(F.regexp_extract(c, r"(?s)(\{.*\})", 1))
    return F.when(F.try_parse_json(text).isNotNull(), F.btrim(text, F.lit(" \t\r\n")))


def edge_key(kind: Column | str, a: Column | str, b: Column | str, symmetric: list[str]) -> Column:
    """A key that is equal for equal edges; symmetric kinds have one for both directions."""
    kind, a, b = _c(kind), _c(a), _c(b)
    both = F.concat_ws("|", kind, F.least(a, b), F.greatest(a, b))
    return F.when(kind.isin(symmetric), both).otherwise(F.concat_ws("|", kind, a, b))


def escaped_like(c: Column | str, needle: str) -> Column:
    """Whether the text contains ``needle``, without letter case; ``%`` and ``_`` stand for themselves."""
    return F.contains(F.lower(_c(c)), F.lit(needle.lower()))


def markdown_cell(c: Column | str) -> Column:
    """Safe inside a Markdown table."""
    return F.regexp_replace(F.regexp_replace(_c(c), r"\|", r"\\|"), r"\s+", " ")


def version_number(c: Column | str) -> Column:
    """A number from 1000 on for a name: its characters as digits to the base 31, in 32 bits, modulo a million."""
    codes = F.transform(F.split(_c(c), ""), lambda x: F.ascii(x).cast("bigint"))
    return F.lit(1000) + F.aggregate(codes, F.lit(0).cast("bigint"), lambda acc, x: (acc * 31 + x) % (1 << 32)) % 1_000_000


def slug(c: Column | str) -> Column:
    """A name in small letters without blanks around."""
    return F.lower(F.trim(_c(c)))


def is_slug(c: Column | str) -> Column:
    """Whether a name may be one: letters, digits and dashes, no dash in front, at most 64."""
    return slug(c).rlike("^[a-z0-9][a-z0-9-]{0,63}$")
