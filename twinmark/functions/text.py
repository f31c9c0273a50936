"""Text normalisation and tokens as column expressions.

Everything stays in the JVM but nfc(), for which Spark has no function: the evaluation runs it once, before
anything is scored, as an Arrow batch function over texts that need it.
"""

from __future__ import annotations

import string
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: letters that answers and overlap keys are made of, beside digits and a-z.
LETTERS = "əğıöşüç"


def nfc(df: DataFrame, *columns: str) -> DataFrame:
    """The columns in Unicode's composed form. Text without a character from U+0300 on is composed already:
    the JVM tells, and only other text reaches the function."""

    @F.pandas_udf("string")
    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))

    def composed(c: str):
        open_ = F.col(c).rlike(r"[^\x{0}-\x{2FF}]")
        return F.when(open_, compose(F.when(open_, F.col(c)))).otherwise(F.col(c))

    return df.withColumns({c: composed(c) for c in columns})


def squeeze(c: Column) -> Column:
    """Runs of Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip(c: Column) -> Column:
    """Without Unicode white space at the ends; trim() takes only spaces."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


#: Letters whose capitals are several letters (ß, ŉ, ﬁ, ᾳ), with the one capital they have in Unicode's simple mapping, or themselves.
CAPITALS = {x: "ẞ" if x == "ß" else x.title() if len(x.title()) == 1 else x for x in map(chr, range(0x10000)) if len(x.upper()) > 1}
#: Letters that have a capital from Unicode 16 on stay as they are, as in SQL.
CAPITALS |= {x: x for x in "\u019b\u0264\u1c8a\ua7cd\ua7db" + "".join(map(chr, range(0x10D70, 0x10D86)))}


def capitals(c: Column) -> Column:
    """Upper case letter for letter, of the same length: upper() makes SS of ß and FI of ﬁ. Only texts with such
    letters are taken apart."""
    many, one = "".join(CAPITALS), "".join(CAPITALS.values())
    letter = lambda x: F.when(F.instr(F.lit(many), x) > 0, F.translate(x, many, one)).otherwise(F.upper(x))
    return F.when(F.rlike(c, F.lit(f"[{many}]")), F.array_join(F.transform(F.split(c, ""), letter), "")).otherwise(F.upper(c))


def normalize_answer(c: Column) -> Column:
    """Lower case, no ASCII punctuation (deleted, not replaced), white space squeezed. Compose first with nfc()."""
    return squeeze(F.translate(F.lower(c), string.punctuation, ""))


def normalize_response(c: Column) -> Column:
    """Lower case and squeezed; punctuation stays."""
    return squeeze(F.lower(c))


def match_tokens(normalized: Column) -> Column:
    """Digit runs and letter runs of a normalised text."""
    return F.regexp_extract_all(normalized, F.lit(rf"(?iu)\p{{Nd}}+(?:/\p{{Nd}}+)?|[a-z{LETTERS}]+"), F.lit(0))


def overlap_tokens(c: Column) -> Column:
    """Runs of digits and letters, together."""
    return F.regexp_extract_all(F.lower(c), F.lit(rf"[0-9a-z{LETTERS}]+"), F.lit(0))


def overlap_key(c: Column) -> Column:
    return F.array_join(overlap_tokens(c), " ")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(squeeze(c), " "), lambda w: w != ""))


def label(c: Column) -> Column:
    """A reviewer's label: trimmed, lower case, empty for null."""
    return F.coalesce(F.lower(strip(c)), F.lit(""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct tokens; 1 if both are empty, 0 if one is."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def bound(c: Column, body) -> Column:
    """body(c) with c worked out once, where body uses it inside functions of array elements."""
    return F.get(F.transform(F.array(c), body), 0)


def blind_id(salt: str, *parts: Column) -> Column:
    """First 16 hexadecimal digits of the salted key's SHA-256."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(salt), *parts), 256), 1, 16)


#: The Azerbaijani alphabet in its own order: a fixed value.
ALPHABET = "abcçdeəfgğhxıijkqlmnoöprsştuüvyz"


def collation_key(c: Column) -> Column:
    """An array that sorts words in Azerbaijani order; I is the dotless letter's capital, letters unknown come last."""
    plain = F.lower(F.translate(c, "İI", "iı"))
    at = lambda x: F.instr(F.lit(ALPHABET), x)
    return F.transform(F.split(plain, ""), lambda x: F.when(at(x) > 0, at(x)).otherwise(len(ALPHABET) + 1))
