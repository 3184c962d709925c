"""String functions as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that carry no evidence about a topic.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "into", "is", "it", "of", "on", "or", "that", "the", "this", "to", "with"]


#: Insides of character classes, spelled out with ASCII first, as they are faster than the flag for Unicode classes.
_LETTERS = r"a-zA-Z0-9_\p{L}\p{N}"
_SPACES = r"\x09-\x0d\x20\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _plain_latin() -> tuple[str, str]:
    """Accented letters of Latin-1 and Latin Extended-A whose decomposition is one letter and marks, and those letters."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))) for c in range(0xC0, 0x180)]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and all(unicodedata.combining(x) for x in d[1:])]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


@F.pandas_udf(StringType())
def nfkd(texts: pd.Series) -> pd.Series:
    """Compatibility decomposition of any script, in Arrow batches."""
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFKD", t))


@F.pandas_udf(StringType())
def nfkd_without_marks(texts: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks, in Arrow batches."""
    return texts.map(lambda t: t if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def _own_form() -> str:
    """Of U+0080 to U+2FFF, the characters that are their own decomposition, as the inside of a character class."""
    own = [c for c in range(0x80, 0x3000) if unicodedata.normalize("NFKD", chr(c)) == chr(c) and not unicodedata.combining(chr(c))]
    runs, start = [], None
    for c, after in zip(own, own[1:] + [None]):
        start = c if start is None else start
        if after != c + 1:
            runs.append(f"\\x{{{start:x}}}-\\x{{{c:x}}}")
            start = None
    return "".join(runs)


def decomposed(text: Column) -> Column:
    """Compatibility decomposition. Only texts with characters that have one leave the JVM."""
    other = text.rlike(r"[^\x00-\x7f]") & text.rlike(f"[^\\x00-\\x7f{_own_form()}]")
    return F.when(other, nfkd(F.when(other, text))).otherwise(text)


def strip_accents(text: Column) -> Column:
    """Compatibility decomposition without combining marks: Latin letters by a table in the JVM, only texts with other
    characters that have a decomposition leave it."""
    accented, plain = _plain_latin()
    # letters of Latin-1 are in the table or their own form, which one short class tells
    other = text.rlike(r"[^\x00-\x7f\xc0-\xff]") & text.rlike(f"[^\\x00-\\x7f{accented}{_own_form()}]")
    return F.when(other, nfkd_without_marks(F.when(other, text))).otherwise(F.translate(text, accented, plain))


def squeeze(text: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize(text: Column, accents: bool = True, lower: bool = True, punctuation: bool = True) -> Column:
    """Comparison form, always decomposed; a null is empty. accents and punctuation: take out accents, and make
    punctuation (and marks, where accents are kept) a space."""
    out = F.trim(F.coalesce(text, F.lit("")))
    out = strip_accents(out) if accents else decomposed(out)
    out = F.lower(out) if lower else out
    out = F.regexp_replace(out, r"(?U)[^\p{L}\p{N}_\s]", " ") if punctuation else out
    return squeeze(out)


def clean(text: Column, lower: bool = True, punctuation: bool = True) -> Column:
    """Like normalize, but punctuation vanishes and accents stay."""
    out = squeeze(F.coalesce(text, F.lit("")))
    out = F.lower(out) if lower else out
    return squeeze(F.regexp_replace(out, r"(?U)[^\p{L}\p{N}_\s]", "")) if punctuation else out


def tokens(text: Column) -> Column:
    """Lower-cased word tokens: runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"[{_LETTERS}]+"), F.lit(0))


def spaced_tokens(text: Column) -> Column:
    """Lower-cased tokens between white space."""
    return F.array_remove(F.split(F.lower(text), rf"[{_SPACES}]+"), "")


def long_tokens(text: Column) -> Column:
    """Lower-cased word tokens of two characters or more."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"[{_LETTERS}]{{2,}}"), F.lit(0))


def evidence_tokens(text: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """ASCII letters and digits, three characters or more, no stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(stop_words))


def without_stop_words(words: Column, stop_words: list[str]) -> Column:
    return F.filter(words, lambda w: ~w.isin(stop_words))


def aliases_of(text: Column) -> Column:
    """Distinct abbreviations: two capitals or more, with or without an explanation in parentheses."""
    found = F.regexp_extract_all(text, F.lit(r"\b[A-Z]{2,}"), F.lit(0))
    return F.array_distinct(found)


def split_aliases(text: Column) -> Column:
    """Parts between bars, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\|"), lambda a: F.trim(a)), lambda a: a != "")


def without_parentheses(text: Column) -> Column:
    return squeeze(F.regexp_replace(text, r"\([^)]*\)", " "))


def first_clause(text: Column) -> Column:
    return F.trim(F.get(F.split(text, "[,;]", 2), F.lit(0)))


def char_ngrams(text: Column, n: int) -> Column:
    """All n-grams of characters in order; none in shorter texts."""
    inside = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, inside).otherwise(F.array().cast("array<string>"))


def with_typo(text: Column) -> Column:
    """The middle character goes from the longest word, the first of several, if it has five characters or more."""
    words = F.split(text, " ")
    sizes = F.transform(words, F.length)
    at = F.array_position(sizes, F.array_max(sizes)).cast("int")
    word = F.element_at(words, at)
    middle = F.floor(F.length(word) / 2).cast("int")
    shorter = F.concat(F.substr(word, F.lit(1), middle), F.substr(word, middle + 2, F.length(word)))
    return F.when(F.length(word) >= 5, F.array_join(F.transform(words, lambda w, i: F.when(i == at - 1, shorter).otherwise(w)), " ")).otherwise(text)


def holdout_variants(name: Column) -> Column:
    """Labelled perturbations of a name in a fixed order, each cleaned."""
    forms = [
        ("typo", clean(with_typo(clean(name)))), ("remove_parenthetical", clean(without_parentheses(name))), ("ampersand_expanded", clean(F.replace(name, F.lit("&"), F.lit(" and ")))),
        ("first_clause", clean(first_clause(name))), ("normalized_verbatim", clean(name)),
    ]
    return F.array(*[F.struct(F.lit(n).alias("variant"), v.alias("text")) for n, v in forms])


def letter_case(text: Column) -> Column:
    """title_case, uppercase, lowercase or mixed."""
    return (
        F.when(text.rlike(r"^\P{L}*(\p{Lu}\p{Ll}*\P{L}+)*\p{Lu}\p{Ll}*\P{L}*$"), "title_case")
        .when((F.upper(text) == text) & (F.lower(text) != text), "uppercase").when((F.lower(text) == text) & (F.upper(text) != text), "lowercase").otherwise("mixed")
    )


def token_estimate(text: Column) -> Column:
    """Model tokens of a text: 1.2 for a word, one at least."""
    return F.greatest(F.lit(1), F.ceil(F.size(spaced_tokens(text)) * F.lit(1.2))).cast("long")


def prompt_safe(text: Column, limit: int = 5000) -> Column:
    bare = F.regexp_replace(text, "```", "")
    return F.when(F.length(bare) > limit, F.concat(F.left(bare, F.lit(limit)), F.lit("..."))).otherwise(bare)


def redact_keys(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)((?:api[_-]?key|token|secret)\s*[=:]\s*)\S+", "$1***")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def mix_index_hash(texts: Column, ids: Column) -> Column:
    """Staleness hash of grouped index rows."""
    return F.md5(F.array_join(F.array_sort(F.collect_list(F.concat(ids, F.lit(":"), texts))), "|"))
