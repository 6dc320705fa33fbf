"""Template masks, family and alert keys, clipping, cause hints, normalisation."""

from __future__ import annotations

import json

from pyspark.sql import Column, functions as F

from . import fixed as X
from .base import col, contains_any, extract_all, is_ascii, literal_map, pattern, strip
from .vectors import let


def fixed_point(x, digits: int) -> Column:
    """A number with a fixed count of decimals, ties to even."""
    return F.format_string(f"%.{digits}f", F.bround(col(x), digits))


def _masked(c: Column, masks, unicode: bool) -> Column:
    for text, repl, ignore_case in masks:
        c = F.regexp_replace(c, pattern(text, ignore_case, unicode), repl)
    return c


def _apply_masks(c: Column, masks) -> Column:
    """The mask chain; ASCII rows use ASCII classes, which match the same and run faster."""
    return F.when(is_ascii(c), _masked(c, masks, False)).otherwise(_masked(c, masks, True))


def _squeeze(c: Column) -> Column:
    return F.regexp_replace(c, pattern(r"\s+"), " ")


def template_key(message) -> Column:
    return F.lower(_squeeze(_apply_masks(strip(message), X.TEMPLATE_MASKS)))


def family_key(message) -> Column:
    return F.lower(strip(_apply_masks(col(message), X.FAMILY_MASKS)))


def scan_mask(message) -> Column:
    message = col(message)
    masked = strip(_squeeze(_apply_masks(F.lower(message), X.SCAN_MASKS)))
    return F.when(F.coalesce(masked, F.lit("")) == "", X.SCAN_EMPTY).otherwise(masked)


def alert_key(level, service, message) -> Column:
    masked = F.regexp_replace(F.lower(col(message)), pattern(X.ALERT_MASK), "<id>")
    return F.concat_ws("|", F.upper(col(level)), col(service), F.substring(masked, 1, X.ALERT_KEY_CHARS))


def clip(text, limit: int = 300) -> Column:
    text = strip(text)
    return F.when(F.char_length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("…"))).otherwise(text)


def cause_hint(level, service, message, reasons) -> Column:
    """One-line likely cause: first matching keyword group, else first reason, else the level."""
    low, service, reasons = F.lower(col(message)), col(service), col(reasons)
    named = ~F.coalesce(service, F.lit("")).isin("", "unknown")
    where = F.when(named, service).otherwise("the app")
    some_service = F.when(F.coalesce(service, F.lit("")) != "", service).otherwise("the app")
    out = None
    for words, verdict in X.CAUSE_HINTS:
        line = F.concat(F.lit(verdict + " (seen in "), where, F.lit(")"))
        test = contains_any(low, words)
        out = F.when(test, line) if out is None else out.when(test, line)
    return out.otherwise(F.coalesce(F.get(reasons, F.lit(0)),
                                    F.concat(col(level), F.lit(" condition in "), some_service)))


# --- message normalisation -------------------------------------------------

def synonym_map(synonyms: dict | None = None) -> Column:
    """A constant map column.  Learned dictionaries go in as one JSON literal."""
    if synonyms is None:
        return literal_map(X.BASE_SYNONYMS)
    return F.from_json(F.lit(json.dumps(synonyms)), "map<string,string>")


def _synonym(word: Column, synonyms: Column, words: list[str] | None) -> Column:
    """The entry of ``word``.  A map is searched key by key, so words outside a known key set skip it."""
    found = F.try_element_at(synonyms, word)
    return found if words is None else F.when(word.isin(words), found)


def _unknown_word(token: Column, synonyms: Column, upper_only: bool, words: list[str] | None) -> Column:
    up, low = F.upper(token), F.lower(token)
    conn = F.regexp_extract(up, r"^ECONN(\w+)$", 1)
    generic = up.rlike("^E[A-Z]{2,10}$")
    if upper_only:
        generic = generic & (token == up)

    def swap(parts: Column) -> Column:
        return F.array_join(F.transform(parts, lambda p: F.coalesce(_synonym(p, synonyms, words), p)), " ")

    split_camel = F.regexp_replace(F.regexp_replace(token, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    head = F.regexp_extract(low, r"^([a-z]+)(\d+)$", 1)
    tail = F.regexp_extract(low, r"^([a-z]+)(\d+)$", 2)
    out = F.when(conn != "", F.lower(conn))
    for code, word in X.ERROR_CODES:
        out = out.when(up.rlike(code), word)
    return (out.when(generic, F.lower(F.substring(up, 2, 20)))
            .when(token.rlike("[a-z][A-Z]|[A-Z][A-Z][a-z]"), swap(F.split(F.lower(split_camel), " +")))
            .when(head != "", swap(F.array(head, tail)))
            .otherwise(low))


def normalize_token(token: Column, synonyms: Column, upper_only: bool = False, words: list[str] | None = None) -> Column:
    """``words``: the keys of a constant ``synonyms`` map."""
    low = F.lower(token)
    known = _synonym(low, synonyms, words)
    # a plain lower-case word that does not start with "e" can only be a synonym: no further rule applies
    return (F.when(token.rlike("^[a-df-z][a-z]*$"), F.coalesce(known, token))
            .when(low.rlike(r"^\d+$"), token)
            .otherwise(F.coalesce(known, _unknown_word(token, synonyms, upper_only, words))))


def normalize_message(message, synonyms: dict | None = None, upper_only: bool = False) -> Column:
    """Tokens mapped through the synonyms, error codes and word splits, joined by blanks.

    The generic error-code rule is applied to the upper-cased token, so it also
    shortens ordinary words that start with "e"; ``upper_only`` limits it to
    tokens that are written in capitals.
    """
    table, words = synonym_map(synonyms), list(X.BASE_SYNONYMS if synonyms is None else synonyms)
    tokens = extract_all(message, X.TOKEN_PATTERN)
    return F.array_join(F.transform(tokens, lambda t: normalize_token(t, table, upper_only, words)), " ")


def learner_tokens(message) -> Column:
    """Lower-case words of three letters or more that are neither numbers nor stop words."""
    tokens = extract_all(F.lower(col(message)), X.TOKEN_PATTERN)
    return F.filter(tokens, lambda t: (F.char_length(t) >= 3) & ~t.rlike(r"^\d+$") & ~t.isin(*X.STOPWORDS))


def text_terms(normalized) -> Column:
    """Uni- and bigrams of the normalised text, stop words dropped first."""
    words = F.filter(extract_all(F.lower(col(normalized)), X.TERM_PATTERN), lambda t: ~t.isin(*X.STOPWORDS))

    def with_pairs(words: Column) -> Column:
        pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
                           lambda a, b: F.concat(a, F.lit(" "), b))
        return F.concat(words, F.filter(pairs, lambda p: p.isNotNull()))

    return let(words, with_pairs)
