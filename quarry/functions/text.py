"""Analysers as ``Column -> Column`` functions returning ``array<string>``.

All of them are built-in Spark expressions (regex, higher-order array
functions), so they stay inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the behaviour being reproduced.
# English stop words of the standard English analyser (33 words).
ENGLISH_STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in",
    "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the",
    "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)
# The 27 special characters split off words by the corpus tokenizer.
SPECIALS = "!\"#$;%^:?*()[]{}<>«»,.–—=+…"
# Characters kept by the character filter: a-z, A-Z, 0-9 and these 15.
CHAR_FILTER_EXTRA = "!&()?-'\",.:; \n\t"
# ---------------------------------------------------------------------------

WORD_RE = r"[\p{L}\p{N}]+"
ENGLISH_WORD_RE = r"[\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)*"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def regex_class_escape(chars: str) -> str:
    """Escape characters for use inside a ``[...]`` class (Java and RE2 agree)."""
    out = []
    for ch in chars:
        if ch in "\\^-[]":
            out.append("\\" + ch)
        elif ch == "\n":
            out.append("\\n")
        elif ch == "\t":
            out.append("\\t")
        else:
            out.append(ch)
    return "".join(out)


def whitespace_tokens(text) -> Column:
    """A1: split on runs of whitespace, no empty tokens, case kept."""
    return F.filter(F.split(F.coalesce(_col(text), F.lit("")), r"\s+"), lambda x: x != "")


def standard_tokens(text) -> Column:
    """A2: letter/digit runs of the lower-cased text (UAX#29 word approximation)."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(WORD_RE), 0)


def remove_stop_words(tokens, stop_words) -> Column:
    """A3 in array form: drop case-insensitive stop words (positions are not kept here)."""
    stop = F.array(*[F.lit(w.lower()) for w in stop_words])
    return F.filter(_col(tokens), lambda t: ~F.array_contains(stop, F.lower(t)))


def s_stem(term: Column) -> Column:
    """S-stemmer (Harman 1991): first applicable of ies->y, es->e, s->'' rules."""
    return (F.when(term.rlike("[^ae]ies$"), F.regexp_replace(term, "ies$", "y"))
            .when(term.rlike("[^aeo]es$"), F.regexp_replace(term, "es$", "e"))
            .when(term.rlike("[^us]s$"), F.regexp_replace(term, "s$", ""))
            .otherwise(term))


def english_tokens(text, stop_words=ENGLISH_STOP_WORDS) -> Column:
    """A4: standard words (inner apostrophes kept), lower case, possessive
    ``'s`` removed, English stop words removed, S-stemmed."""
    words = F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))),
                                 F.lit(ENGLISH_WORD_RE), 0)
    words = F.transform(words, lambda w: F.regexp_replace(w, "'s$", ""))
    words = remove_stop_words(words, stop_words)
    return F.transform(words, s_stem)


def special_tokens(text, keep_specials: bool = False) -> Column:
    """Split on blank/tab, then split words at the special characters;
    optionally keep each special character as its own token."""
    cls = regex_class_escape(SPECIALS)
    pattern = f"[^ \\t{cls}]+|[{cls}]"
    toks = F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(pattern), 0)
    if keep_specials:
        return toks
    return F.filter(toks, lambda t: ~t.rlike(f"^[{cls}]$"))


def feature_tokens(text) -> Column:
    """Split at whitespace or commas."""
    return F.filter(F.split(F.coalesce(_col(text), F.lit("")), r"[\s,]+"), lambda x: x != "")


def truncate_tokens(tokens, n: int) -> Column:
    """Keep the first ``n`` characters of each token (n >= 1)."""
    if n < 1:
        raise ValueError("truncation length must be >= 1")
    return F.transform(_col(tokens), lambda t: F.substring(t, 1, n))


def position_tokens(tokens) -> Column:
    """A10: prefix each token with its 1-based position: ``<pos>_<token>``."""
    return F.transform(_col(tokens), lambda t, i: F.concat((i + 1).cast("string"), F.lit("_"), t))


def shingles(tokens, min_size: int, max_size: int | None = None) -> Column:
    """Word n-grams of sizes min..max joined by a blank, no unigrams.

    ``tokens`` should be a column reference (materialise the tokens first):
    the expression is evaluated inside the per-gram lambda.
    """
    max_size = max_size or min_size
    toks = _col(tokens)
    parts = []
    def grams(n):
        return F.when(F.size(toks) >= n, F.transform(
            F.sequence(F.lit(1), F.size(toks) - n + 1),
            lambda i: F.array_join(F.slice(toks, i, n), " "))).otherwise(F.array().cast("array<string>"))

    for n in range(max(2, min_size), max_size + 1):
        parts.append(grams(n))
    if not parts:
        return F.array().cast("array<string>")
    return parts[0] if len(parts) == 1 else F.flatten(F.array(*parts))


def prefixes(s) -> Column:
    """All prefixes of a string, lengths 1..n; the empty string gives ['']."""
    c = _col(s)
    return F.when(F.length(c) == 0, F.array(F.lit(""))).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(c, 1, i)))


def char_filter(text) -> Column:
    """Keep only a-z, A-Z, 0-9 and the 15 extra characters."""
    cls = "a-zA-Z0-9" + regex_class_escape(CHAR_FILTER_EXTRA)
    return F.regexp_replace(F.coalesce(_col(text), F.lit("")), f"[^{cls}]", "")


ANALYZERS = {
    "whitespace": whitespace_tokens,
    "standard": standard_tokens,
    "english": english_tokens,
    "specials": special_tokens,
    "features": feature_tokens,
}


def analyzer(name: str):
    try:
        return ANALYZERS[name]
    except KeyError:
        raise ValueError(f"unknown analyser {name!r}; known: {sorted(ANALYZERS)}") from None
