"""Caption and prompt text as Column expressions."""

from __future__ import annotations

import html
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranges that caption cleaning removes, and the marks it sets spaces around (fixed values).
EMOJI = "[\U0001f600-\U0001f64f\U0001f300-\U0001f5ff\U0001f680-\U0001f6ff\U0001f700-\U0001f77f\U0001f780-\U0001f7ff\U0001f800-\U0001f8ff\U0001f900-\U0001f9ff\U0001fa00-\U0001fa6f\U0001fa70-\U0001faff\u2702-\u27b0\u24c2-\U0001f251]"
MARKS = r"()\[\]{}<>?.,!|\-/~`@#_=;:"
CAPTION_MARKS = r"""[.!"()*#:;~]"""
ASCII_PUNCTUATION = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""
#: White space of any script, as in Python: within a character class, and as characters.
SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
#: Opening of a captioning prompt (fixed value).
PROMPT = "Briefly caption the image using relevant details from the alt-text and detected classes."


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def trim_caption(c: Column) -> Column:
    """Cuts an unfinished last sentence: with more than one full stop and none at the end, keeps up to the last; always stripped."""
    stripped = strip(c)
    stops = F.length(stripped) - F.length(F.replace(stripped, F.lit("."), F.lit("")))
    return strip(F.when((stops > 1) & ~stripped.endswith("."), F.regexp_extract(stripped, r"(?s)^(.*\.)", 1)).otherwise(stripped))


def preprocess_caption(c: Column, join_repeats: bool = True) -> Column:
    """Emoji out, double spaces halved once, no white space before a mark, repeated marks joined, one space after a mark."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), EMOJI, "")
    out = F.replace(out, F.lit("  "), F.lit(" "))
    out = F.regexp_replace(out, rf"[{SPACE}]+([{MARKS}])", "$1")
    if join_repeats:
        out = F.regexp_replace(out, rf"([{MARKS}])\1+", "$1")
    out = F.regexp_replace(out, rf"([{MARKS}])([^{SPACE}{MARKS}])", "$1 $2")
    return strip(out)


def clean_and_capitalize(c: Column) -> Column:
    """Drops all up to a chat preamble's "assistant" line and a leading "The image shows a" (the space after the article is optional, so "apples" loses its a), then raises the first letter."""
    out = F.regexp_replace(c, r"(?s).*?\nassistant\n", "")
    out = F.regexp_replace(out, rf"(?i)\A(The image[{SPACE}]+[\p{{L}}\p{{N}}_]+[{SPACE}]+(an|the|a)[{SPACE}]?)", "")
    return F.concat(F.upper(F.substring(out, 1, 1)), F.substring(out, F.lit(2), F.length(out)))


def build_prompt(caption: Column, classes: Column, most: int = 77, opening: str = PROMPT) -> Column:
    """The opening, at most `most` characters of the caption, and the classes if there are any; null captions are empty."""
    named = F.when(F.size(classes) > 0, F.concat(F.lit(" Classes: "), F.array_join(classes, ", "), F.lit("."))).otherwise("")
    return F.concat(F.lit(f"{opening} Alt-text: "), F.substring(F.coalesce(caption, F.lit("")), 1, most), F.lit("."), named)


def pre_caption(c: Column, words: int = 50) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(c), CAPTION_MARKS, " "), rf"[{SPACE}]{{2,}}", " ")
    out = F.btrim(F.rtrim(out, F.lit("\n")))
    return F.array_join(F.slice(F.split(out, " "), 1, words), " ")


def pre_question(c: Column, words: int = 50) -> Column:
    out = F.rtrim(F.regexp_replace(F.lower(c), CAPTION_MARKS, ""))
    return F.array_join(F.slice(F.split(out, " "), 1, words), " ")


def canonicalize(c: Column, keep: str = "") -> Column:
    """Underscores to spaces, ASCII punctuation out (but within `keep`, if given), lower case, single spaces."""
    out = F.replace(c, F.lit("_"), F.lit(" "))
    if keep:
        parts = F.transform(F.split(out, re.escape(keep)), lambda x: F.regexp_replace(x, ASCII_PUNCTUATION, ""))
        out = F.array_join(parts, keep)
    else:
        out = F.regexp_replace(out, ASCII_PUNCTUATION, "")
    return strip(F.regexp_replace(F.lower(out), rf"[{SPACE}]+", " "))


def whitespace_clean(c: Column) -> Column:
    return strip(F.regexp_replace(c, rf"[{SPACE}]+", " "))


@F.pandas_udf(T.StringType())
def unescape_twice(c: pd.Series) -> pd.Series:
    """Character references decoded, also such as were escaped twice."""
    return c.map(lambda t: None if t is None else html.unescape(html.unescape(t)))


def basic_clean(c: Column, repair: Callable[[Column], Column] = lambda c: c) -> Column:
    """repair (of wrongly decoded text; none by default), character references, strip."""
    return strip(unescape_twice(repair(c)))


def clean(kind: str) -> Callable[[Column], Column]:
    """Cleaning ahead of a tokenizer by its name: canonicalize, lower or whitespace."""
    kinds = {
        "canonicalize": lambda c: canonicalize(basic_clean(c)),
        "lower": lambda c: F.lower(whitespace_clean(basic_clean(c))),
        "whitespace": lambda c: whitespace_clean(basic_clean(c)),
    }
    if kind not in kinds:
        raise ValueError(f"no cleaning {kind}")
    return kinds[kind]


def tag_separators(c: Column) -> Column:
    """Tags that were given with commas, as tags separated by bars."""
    return F.replace(c, F.lit(","), F.lit(" | "))


def article(name: Column) -> Column:
    return F.when(F.substring(name, 1, 1).isin("a", "e", "i", "o", "u"), "an").otherwise("a")


def class_name(name: Column) -> Column:
    """Underscores to spaces, slashes to "or", lower case, no closing stops."""
    return F.regexp_replace(F.lower(F.replace(F.replace(name, F.lit("_"), F.lit(" ")), F.lit("/"), F.lit(" or "))), r"\.+$", "")


def singular(c: Column) -> Column:
    """A rule-based singular of one noun: ies to y, (s|sh|ch|x|z)es without es, another s but for ss, us, is dropped. A dictionary's lemma can stand in its place."""
    cut = lambda end, by: F.regexp_replace(c, end + r"\z", by)
    return F.when(c.rlike(r"\p{L}\p{L}ies\z"), cut("ies", "y")).when(c.rlike(r"(s|sh|ch|x|z)es\z"), cut("es", "")).when(c.rlike(r"\p{L}[^sui\s]s\z"), cut("s", "")).otherwise(c)


def lower_singular(word: str) -> str:
    """singular() of one string."""
    if re.search(r"[^\W\d_]{2}ies\Z", word):
        return word[:-3] + "y"
    if word.endswith(("ses", "shes", "ches", "xes", "zes")):
        return word[:-2]
    return word[:-1] if re.search(r"[^\W\d_][^sui\s]s\Z", word) else word


def word_forms(word: Column, more: Column | None = None) -> Column:
    """The word, its singular and `more` (an array of synonyms), each with its -ing forms and its plural, sorted."""
    w = F.replace(F.lower(word), F.lit("-"), F.lit(" "))
    bases = F.array_distinct(F.array(w, singular(w)))
    if more is not None:
        bases = F.array_union(bases, F.coalesce(more, F.array().cast("array<string>")))

    def derived(b: Column) -> Column:
        plural = F.when(b.endswith("y"), F.regexp_replace(b, "y$", "ies")).when(b.rlike("(s|sh|ch|x|z)$"), F.concat(b, F.lit("es"))).otherwise(F.concat(b, F.lit("s")))
        gerund = F.concat(b, F.lit("ing"))
        return F.array(b, gerund, F.when(b.endswith("e"), F.regexp_replace(b, "e$", "ing")).otherwise(gerund), plural)

    return F.array_sort(F.array_distinct(F.flatten(F.transform(bases, derived))))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance in lower case / longer length; 1 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(F.lower(a), F.lower(b)) / longest)


def ends_with_stop(c: Column) -> Column:
    s = F.lower(F.btrim(c))
    return F.when(s.endswith("."), s).otherwise(F.concat(s, F.lit(".")))
