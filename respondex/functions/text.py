"""Column expressions over free text. No Python UDFs: everything stays in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

WORD = r"[\p{L}\p{N}']+"
LATIN_WORD = r"[A-Za-z']+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``.

    The optimizer may inline a projected column into every place that uses it;
    inside a lambda that would tokenise the text once per token.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def squash(c: Column) -> Column:
    """Collapse white space and trim."""
    # a single space is left alone: replacing it by itself would copy the text word by word
    return F.trim(F.regexp_replace(c, r"\s{2,}|[\t\n\x0B\f\r]", " "))


def canonical(c: Column) -> Column:
    """Squashed text, ``3.0`` as ``3``, blank as NULL."""
    s = squash(c.cast("string"))
    s = F.regexp_replace(s, r"^(-?[0-9]+)\.0+$", "$1")
    return F.nullif(s, F.lit(""))


def norm(c: Column) -> Column:
    return F.lower(squash(F.coalesce(c, F.lit(""))))


def words(c: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0))


def word_count(c: Column, pattern: str = WORD) -> Column:
    return F.size(words(c, pattern))


def lower_words(c: Column, pattern: str = WORD) -> Column:
    return words(F.lower(c), pattern)


def unique_ratio(tokens: Column) -> Column:
    return F.when(F.size(tokens) > 0, F.size(F.array_distinct(tokens)) / F.size(tokens)).otherwise(F.lit(0.0))


def contains_any(c: Column, markers: Sequence[str]) -> Column:
    hit = F.lit(False)
    for m in markers:
        hit = hit | c.contains(m)
    return hit


def as_pattern(what: str | Sequence[str]) -> str:
    """A pattern, or the pattern that finds any of several strings."""
    return what if isinstance(what, str) else "|".join(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", m) for m in what)


def found(c: Column, what: str | Sequence[str]) -> Column:
    """Whether a pattern, or any of several strings, occurs."""
    return c.rlike(what) if isinstance(what, str) else contains_any(c, what)


def starts_with_any(c: Column, markers: Sequence[str]) -> Column:
    hit = F.lit(False)
    for m in markers:
        hit = hit | c.startswith(m)
    return hit


def hits_in(tokens: Column, lexicon: Sequence[str]) -> Column:
    return F.size(F.filter(tokens, lambda t: t.isin(*lexicon)))


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined n-grams; ``tokens`` should be a lambda variable or a plain column."""
    size = F.size(tokens)
    return F.when(
        size >= n,
        F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.concat_ws(" ", *[F.element_at(tokens, i + k) for k in range(n)])),
    ).otherwise(F.array().cast("array<string>"))


def occurs_at_least(items: Column, k: int) -> Column:
    """True when some element occurs ``k`` times: after a sort, equal neighbours are k-1 apart."""
    return let(
        F.sort_array(items),
        lambda s: F.when(
            F.size(s) >= k,
            F.exists(
                F.sequence(F.lit(1), F.size(s) - (k - 1)),
                lambda i: F.element_at(s, i) == F.element_at(s, i + (k - 1)),
            ),
        ).otherwise(F.lit(False)),
    )


def repeated_phrase(c: Column) -> Column:
    """Some 2-, 3- or 4-gram occurs three times in a text of six tokens or more."""
    return let(
        lower_words(c, r"[a-z']+"),
        lambda t: (F.size(t) >= 6)
        # a repeated 3- or 4-gram repeats its first two words as well
        & occurs_at_least(ngrams(t, 2), 3),
    )


def signature(c: Column) -> Column:
    """Template signature of the whole text: lower case, numbers as #, letters only."""
    s = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[0-9]+", "#")
    s = F.regexp_replace(s, r"[^a-z# ]+", " ")
    return F.trim(F.regexp_replace(s, r" {2,}", " "))


def compact_words(c: Column, min_len: int = 3) -> Column:
    """Lower-case alphanumeric words of at least ``min_len`` characters, joined by one space."""
    cleaned = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+", " ")
    return F.array_join(F.filter(F.split(F.trim(cleaned), " "), lambda w: F.length(w) >= min_len), " ")
