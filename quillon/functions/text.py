"""Text and naming expressions; all are Catalyst built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slugify(text: Column, default: str = "object", most: int = 80) -> Column:
    """Characters outside `[A-Za-z0-9._-]` become `_`, runs of `_` one, ends lose `_` and `.`; empty gives `default`."""
    kept = F.regexp_replace(F.regexp_replace(F.trim(text), r"[^A-Za-z0-9._-]", "_"), "_+", "_")
    return F.substring(F.coalesce(F.nullif(F.regexp_replace(kept, r"^[_.]+|[_.]+\z", ""), F.lit("")), F.lit(default)), 1, most)


def last_digits(text: Column) -> Column:
    """The last run of digits as a number; null where there is none."""
    return F.try_to_number(F.nullif(F.regexp_extract(text, r"(\d+)(?!.*\d)", 1), F.lit("")), F.lit("9999999999999999999")).cast("long")


def split_key(key: Column, sep: str = "_") -> tuple[Column, Column]:
    """What stands before and after the last `sep`; without one the key and null."""
    last = F.substring_index(key, sep, -1)
    has = F.instr(key, sep) > 0
    return F.when(has, F.substring(key, F.lit(1), F.length(key) - F.length(last) - len(sep))).otherwise(key), F.when(has, last)


def clean_target(text: Column) -> Column:
    """One closing `_0` less, `_` to blanks."""
    return F.replace(F.regexp_replace(text, r"_0\z", ""), F.lit("_"), F.lit(" "))


def first_nonempty(*candidates: Column, default: str | None = None) -> Column:
    """The first candidate that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in candidates], F.lit(default))


def strip_fences(text: Column) -> Column:
    """A Markdown code fence around the text taken off."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```\z", ""))


def variants(text: Column, additions: dict[str, list[str]] | None = None) -> Column:
    """The trimmed text, its small form, and what `additions` lists for each word that the small form holds; without empty ones, distinct, in this order."""
    base = F.trim(text)
    more = [F.when(F.contains(F.lower(base), F.lit(word)), F.array(*map(F.lit, added))).otherwise(F.array().cast("array<string>")) for word, added in (additions or {}).items()]
    return F.array_distinct(F.filter(F.concat(F.array(base, F.lower(base)), *more), lambda v: v != ""))


def safe_text(text: Column, default: str = "-") -> Column:
    return F.coalesce(F.nullif(F.trim(text.cast("string")), F.lit("")), F.lit(default))


def wrap(text: Column, width: int, lines: int = 5) -> Column:
    """Words packed greedily into at most `lines` lines of `width` characters; a longer word has a line of its own."""
    packed = F.aggregate(
        F.filter(F.split(text, r"\s+"), lambda w: w != ""),
        F.array().cast("array<string>"),
        lambda done, w: F.when((F.size(done) > 0) & (F.length(F.element_at(done, -1)) + 1 + F.length(w) <= width), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat_ws(" ", F.try_element_at(done, F.lit(-1)), w)))).otherwise(F.concat(done, F.array(w))),
    )
    return F.slice(packed, 1, lines)


def fold_path(tokens: Column, head: int, sep: str = "_", join: str = "/") -> Column:
    """A path packed into one name: the first `head` tokens are folders, the rest the file's name."""
    parts = F.split(tokens, sep)
    return F.concat_ws(join, F.array_join(F.slice(parts, 1, head), join), F.array_join(F.slice(parts, F.lit(head + 1), F.greatest(F.size(parts) - head, F.lit(0))), sep))
