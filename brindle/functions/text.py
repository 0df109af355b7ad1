"""Text functions as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry little meaning; readers.word_list reads others from a file.
STOP_WORDS = ("the", "of", "and", "to", "in", "a", "is", "de", "la", "le", "der", "die", "und", "el", "que")


def plain(text: Column) -> Column:
    """Lower case without the punctuation ( [ , . ! ? : ; ] )."""
    return F.translate(F.lower(text), "([,.!?:;])", "")


def plain_words(text: Column) -> Column:
    """Pieces between single spaces; runs of spaces give empty pieces."""
    return F.split(F.trim(plain(text)), " ")


def stripped(word: Column) -> Column:
    return F.regexp_replace(word, r"^\s+|\s+$", "")


def cleaned(text: Column) -> Column:
    """Lower case; punctuation becomes a space; line breaks vanish, joining words; numbers go, with a
    dollar sign before them; contractions are spelt out or cut; "...n't" words go with the character
    after them."""
    t = F.translate(F.lower(text), "([,.!?:;])\\\n", "           ")
    t = F.regexp_replace(t, r"\$*[0-9]+", "")
    t = F.replace(F.replace(t, F.lit("can't"), F.lit("can not")), F.lit("won't"), F.lit("will not"))
    for ending in ("'m", "'re", "'ve", "'s", "'ll", "'d"):
        t = F.replace(t, F.lit(ending), F.lit(" "))
    return F.regexp_replace(t, r"[0-9A-Za-z_]+(n't).", "")


def cleaned_sql(text: str) -> str:
    """The same in DuckDB's SQL."""
    t = f"translate(lower({text}), '([,.!?:;])\\' || chr(10), repeat(' ', 11))"
    t = f"regexp_replace({t}, '\\$*[0-9]+', '', 'g')"
    t = f"replace(replace({t}, 'can''t', 'can not'), 'won''t', 'will not')"
    for ending in ("m", "re", "ve", "s", "ll", "d"):
        quoted = "\'\'\'" + ending + "\'"
        t = f"replace({t}, {quoted}, ' ')"
    return f"regexp_replace({t}, '[0-9A-Za-z_]+(n''t).', '', 'g')"


def cleaned_words(text: Column) -> Column:
    return F.split(F.trim(cleaned(text)), " ")


def categories(joined: Column) -> Column:
    """The entries of a comma-separated list, trimmed."""
    return F.transform(F.split(joined, ","), lambda c: F.trim(c))


def letters_only(text: Column) -> Column:
    """ASCII letters only; the empty string passes."""
    return text.rlike("^[A-Za-z]*$")
