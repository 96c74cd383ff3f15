"""Names and texts: normalising, cleaning, similarity, search terms. All but Jaro-Winkler are columns."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

_FOLDED = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in range(0xC0, 0x180)]
_FOLDED = [(a, b) for a, b in _FOLDED if a != b and b.isascii()]

# Letters that no decomposition folds.
SPECIAL_LETTERS = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d"}

# Words that searches ignore.
STOP_WORDS = "a an and are as at be by for from in is it of on or that the this to was were with".split()


def _each(text: Column, *rules: tuple[str, str]) -> Column:
    """Regular expressions replaced one after the other."""
    return reduce(lambda c, rule: F.regexp_replace(c, *rule), rules, text)


def fold(text: Column) -> Column:
    """Latin letters without their accents."""
    plain = F.translate(text, "".join(a for a, _ in _FOLDED), "".join(b for _, b in _FOLDED))
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), SPECIAL_LETTERS.items(), plain)


def norm_text(text: Column) -> Column:
    """Lower case without accents and a trailing country code; other marks become single spaces each."""
    return _each(fold(F.lower(text)), (r"\s*\([a-z]{2,3}\)\s*$", ""), ("[^a-z0-9]", " "))


def normalize_text(text: Column) -> Column:
    """``norm_text`` with runs of spaces collapsed and trimmed."""
    return F.trim(F.regexp_replace(norm_text(F.trim(text)), " +", " "))


def match_name(text: Column) -> Column:
    """The name before any bracket, lower, without a roman numeral to vi at its end and apostrophes."""
    head = F.trim(F.lower(F.split(text, r"\(")[0]))
    return F.trim(_each(fold(head), (r"\s+(i|ii|iii|iv|v|vi)$", ""), ("'", ""), (r"[-.,]", " "), (r"\s+", " ")))


def title_name(text: Column) -> Column:
    """The name before any bracket without i or ii at its end, in title case."""
    head = F.trim(F.split(text, r"\(")[0])
    return F.initcap(F.trim(_each(head, (r"(?i)\s+(i|ii)$", ""), (r"\.", " "), ("'", ""), (r"\s+", " "))))


def exchange_name(text: Column) -> Column:
    """An exchange's runner name: before any bracket, lower, all i and spaces at its end gone."""
    return _each(F.lower(F.split(text, r"\(")[0]), ("[ i]+$", ""), ("'", ""))


def norm_course(text: Column) -> Column:
    """A course name without an all-weather mark, spaces, hyphens and apostrophes."""
    return _each(F.trim(F.lower(text)), (r" (\(aw\)|aw)$", ""), ("[ '-]", ""))


def clean_string(text: Column) -> Column:
    """Without commas and quotes, white space collapsed."""
    return F.trim(_each(text, ("[,\"']", ""), (r"\s+", " ")))


def clean_race_name(text: Column) -> Column:
    """A race name without class, group, grade and listed marks."""
    return clean_string(_each(text, (r"(?i)\(?class [a-h0-9]\)?", ""), (r"(?i)\(?(group|grade) [0-9ivx]+\)?", ""), (r"Listed Race|\(Listed\)", "")))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words, each with two blanks before it and one after."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3))))))


def overlap(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """Jaccard similarity of two arrays as sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def trigram_similarity(a: Column, b: Column) -> Column:
    return overlap(trigrams(a), trigrams(b), 0.0)


def lexemes(text: Column) -> Column:
    """Search terms in order: lower-case words without stop words, common English endings cut."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(*STOP_WORDS))
    return F.transform(words, lambda w: F.regexp_replace(w, "(?<=[a-z]{3})(ings?|ed|es|s)$", ""))


def _jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    taken = [False] * len(b)
    left = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                left.append(x)
                break
    if not left:
        return 0.0
    right = [y for y, t in zip(b, taken, strict=True) if t]
    half = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    m = len(left)
    return (m / len(a) + m / len(b) + (m - half) / m) / 3


def similar_names(a: str | None, b: str | None) -> float | None:
    """Jaro-Winkler: Jaro, raised for up to four equal first letters where it is above 0.7."""
    if a is None or b is None:
        return None
    j = _jaro(a, b)
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(len(a), len(b), 4))
    return j + prefix * 0.1 * (1 - j) if j > 0.7 else j


def letter_counts(text: Column) -> Column:
    """How often each of a to z stands in a text in lower case, and last how many other characters."""
    letters = [F.length(text) - F.length(F.replace(text, F.lit(chr(c)), F.lit(""))) for c in range(97, 123)]
    return F.array(*letters, F.length(F.regexp_replace(text, "[a-z]", "")))


def jaro_winkler_bound(a: Column, b: Column, counts_a: Column, counts_b: Column) -> Column:
    """No pair of these texts is more similar than this: letters in common, lengths and first letters tell.

    Matching characters are at most those that both have, whatever their places; the first letters that
    agree raise Jaro's measure as they do in truth. Of two empty texts, and of equal ones, it is 1.
    """
    m = F.aggregate(F.zip_with(counts_a, counts_b, lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    jaro = F.when(a == b, 1.0).when(m == 0, 0.0).otherwise((m / F.length(a) + m / F.length(b) + 1) / 3)
    front = F.lit(0)
    for n in range(1, 5):
        front = F.when((F.length(a) >= n) & (F.length(b) >= n) & (F.substr(a, F.lit(1), F.lit(n)) == F.substr(b, F.lit(1), F.lit(n))), n).otherwise(front)
    return F.when(jaro > 0.7, jaro + front * 0.1 * (1 - jaro)).otherwise(jaro)


@pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similar_names(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
