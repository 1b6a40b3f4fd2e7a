"""Text expressions: normalised keys, words, n-grams, form measures, tokens."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from credence.functions.distributions import let


#: The white space of Unicode, for classes in regular expressions.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Texts of ASCII and the letters of Latin-1 only are their own NFKC forms.
_PLAIN = r"^[\x00-\x7f\u00c0-\u00ff]*$"


def normalise(text: Column) -> Column:
    """NFKC, lower case, runs of anything but a-z and 0-9 to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(nfkc(text)), "[^a-z0-9]+", " "))


def nfkc(text: Column) -> Column:
    """The NFKC form. No built-in function makes it; only texts that it may change go to Python, in
    Arrow batches, the others stay in the JVM."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return F.coalesce(run(F.when(~text.rlike(_PLAIN), text)), text)


def words(text: Column) -> Column:
    """Runs without white space."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """How many ``words`` a text has. Python cuts at the same white space, in a fifth of the time of a regular
    expression of that class."""
    @F.pandas_udf("int")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else len(x.split()) for x in s], dtype="Int32")

    return run(text)


def ngrams(key: Column, n: int = 8) -> Column:
    """Distinct word n-grams of a normalised text; none where it is shorter."""
    def grams(w: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))

    return let(F.split(key, " "), grams)


def longest_word(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(found, F.length)), F.lit(0))


#: The form properties of a text; those named ``..._over`` are compared with a threshold.
FORM_KINDS = {
    "word_count_over": word_count,
    "char_count_over": F.length,
    "longest_word_over": longest_word,
    "contains_number": lambda t: t.rlike("[0-9]").cast("int"),
    "contains_comma": lambda t: F.contains(t, F.lit(",")).cast("int"),
    "ends_with_question_mark": lambda t: t.rlike(rf"\?[{SPACE}]*\z").cast("int"),
}


def tokens(text: Column) -> Column:
    """Lower-case a-z0-9 words and adjacent pairs of them joined by an underscore."""
    def both(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat(a, F.lit("_"), b))
        return F.concat(w, pairs)

    return let(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), both)


def plain_description(text: Column) -> Column:
    """Straight apostrophes, and without one trailing period."""
    return F.regexp_replace(F.translate(text, "’", "'"), r"\.$", "")


def line_problem(line: Column, longest: int) -> Column:
    """Why a generated line is refused, or null."""
    t = F.trim(line)
    return F.when(t == "", "empty").when(t.rlike("[\r\n]"), "several lines").when(F.length(t) > longest, "too long")
