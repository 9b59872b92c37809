"""Word-level expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = r"\p{L}\p{N}_"


def trim_word(token: Column) -> Column:
    """Without marks at either end."""
    return F.regexp_replace(token, f"^[^{_WORD}]+|[^{_WORD}]+\\z", "")


def word_syllables(token: Column) -> Column:
    """Vowel groups, plus literal hyphens; at least 1 for a token that isn't empty."""
    vowels = F.regexp_count(F.lower(token), F.lit("[aeiouyáéíóúàèìòùâêîôûäëïöüãõœæ]+"))
    return F.when(token == "", 0).otherwise(F.greatest(F.lit(1), vowels + F.regexp_count(token, F.lit(r"(?<=\w)-(?=\w)"))))


def syllables(text: Column, known: dict[str, int] | None = None) -> Column:
    """Syllables of all tokens between white space; 0 for null. `known` is a dictionary of lower-case words that goes before the rule."""
    tokens = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")
    entries = F.create_map(*[F.lit(x) for pair in known.items() for x in pair]) if known else None
    count = lambda t: word_syllables(t) if entries is None else F.coalesce(F.try_element_at(entries, F.lower(t)), word_syllables(t))
    return F.aggregate(tokens, F.lit(0), lambda a, t: a + count(t))


def log_variety(word: Column) -> Column:
    """Distinct characters over the logarithm of the length; null for one character or none."""
    return F.when(F.length(word) > 1, F.size(F.array_distinct(F.split(word, ""))) / F.log(F.length(word)))


def word_budget(token: Column, rate: float, least_len: int = 7, variety: float = 1.6, per: float = 4.0, slow: float = 0.6) -> Column:
    """Seconds a word may take: by syllables, or by length for long words of few distinct characters."""
    word = trim_word(token)
    drawn = F.greatest(F.lit(1.0), F.ceil(F.length(word) / per).cast("double")) * slow
    low = (F.length(word) >= least_len) & (log_variety(word) < variety)
    return F.when(F.coalesce(low, F.lit(False)), drawn).otherwise(word_syllables(token) * F.lit(rate))


def content_token(data: Column, *parts: Column) -> Column:
    """SHA-256 of the bytes, then the parts, joined by hyphens."""
    return F.concat_ws("-", F.sha2(data, 256), *parts)


def is_numeric(token: Column) -> Column:
    return F.regexp_like(token, F.lit(r"^\p{N}+\z"))


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "\\x1B\\[[0-?]*[ -/]*[@-~]", "")


def status_label(value: Column, ok: Column) -> Column:
    """PASS or FAIL; N/A without a value, INFO without a verdict."""
    return F.when(value.isNull(), "N/A").when(ok.isNull(), "INFO").when(ok, "PASS").otherwise("FAIL")
