"""Text scalar operators (column expressions only; no Python UDF).

Each function maps Column(s) to a Column and stays inside whole-stage codegen where Spark
allows it (regexp_replace, split, translate, replace, array_join ...).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------
# Fixed values (must equal the original rules exactly).
#
# Python's str.split()/strip() whitespace: the 29 code points for which str.isspace() is true.
# Spark's trim strips only U+0020 and Java's \s is ASCII-only, so the class is spelled out.
WS_CLASS = (r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
# The same 29 characters as a plain string (for translate/btrim, which need no regex engine).
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
            "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
            "\u2028\u2029\u202f\u205f\u3000")
# Punctuation marks that become their own tokens in the symbol cleaner (ASCII '*' and '\' are
# not in the set). Written Java-safe: '[' escaped, '-' escaped.
SYMBOL_CLASS = "[!“\"#$%&'()+,\\-./:;<=>?@\\[\\]^_`{|}~，。！？、【】「」～；（）：”‘’·－…〈〉』『]"
# Number pattern shared by the number tagger and the number starrer; the alternation order
# matters (digits-stars-digits first).
NUMBER_PATTERN = r"[0-9]+\*+[0-9]+|[0-9]+|\*\*\*"
# Common CJK ideographs block used by the CJK spacer.
CJK_CLASS = r"[\x{4e00}-\x{9fa5}]"
# Ordered typo corrections of the word cleaner.
TYPO_MAP = (("花贝", "花呗"), ("借贝", "借呗"))
# Replacement tag of the number tagger.
NUM_TAG = " #num "
# ---------------------------------------------------------------------------------------------

def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ws_to_space(text) -> Column:
    """Every whitespace character becomes U+0020 (a character map, no regex)."""
    return F.translate(_c(text), WS_CHARS, " " * len(WS_CHARS))


def word_tokens(text) -> Column:
    """Split on runs of Unicode whitespace, dropping empties (Python ``str.split()``).

    Whitespace is mapped to U+0020 and split on that one literal character (the non-regex
    split path); the empty strings between consecutive spaces are removed.
    """
    return F.array_remove(F.split(ws_to_space(text), " "), "")


def strip(text) -> Column:
    """Unicode strip of both ends (Python ``str.strip()``), a character-set trim."""
    return F.btrim(_c(text), F.lit(WS_CHARS))


def drop_ws(text) -> Column:
    """Delete every whitespace character."""
    return F.translate(_c(text), WS_CHARS, "")


def chars(text) -> Column:
    """Code points of ``text`` (astral characters intact); ``''`` gives ``['']``."""
    return F.split(_c(text), "")


def char_tokens(text) -> Column:
    """One token per code point of the stripped line; U+0020 is not a token."""
    return F.array_remove(F.array_remove(chars(strip(text)), " "), "")


def join_tokens(tokens, sep: str = " ") -> Column:
    """T4: join by one space."""
    return F.array_join(_c(tokens), sep)


def mask_alnum(text) -> Column:
    """T5: every run of [a-z]+, [0-9]+ or [A-Z]+ becomes '*'."""
    return F.regexp_replace(_c(text), "[a-z]+|[0-9]+|[A-Z]+", "*")


def collapse_stars(text) -> Column:
    """Runs of '*' become one '*'."""
    return F.regexp_replace(_c(text), r"\*+", "*")


def fix_typos(text, mapping=TYPO_MAP) -> Column:
    """Ordered literal replacements."""
    return reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), mapping, _c(text))


def drop_stopwords(tokens, stop) -> Column:
    """Remove listed words, keeping order and duplicates of the others.

    ``array_except`` would de-duplicate, so the filter form is used. ``stop`` is a short
    Python list (for a long list explode and left-anti join instead, see operators.vocab).
    """
    stop_arr = F.array(*[F.lit(s) for s in stop]) if stop else F.array().cast("array<string>")
    return F.filter(_c(tokens), lambda t: ~F.array_contains(stop_arr, t))


def tag_numbers(text) -> Column:
    """Digits-stars-digits, digit runs and '***' become ' #num '."""
    return F.regexp_replace(_c(text), NUMBER_PATTERN, NUM_TAG)


def star_numbers(text) -> Column:
    """The same pattern becomes '*'."""
    return F.regexp_replace(_c(text), NUMBER_PATTERN, "*")


def space_latin(text) -> Column:
    """Latin runs longer than one letter get a space on each side; single letters go.

    Single-letter runs are bounded by non-letters, so deleting them first cannot join runs.
    """
    t = F.regexp_replace(_c(text), "(?<![a-zA-Z])[a-zA-Z](?![a-zA-Z])", "")
    return F.regexp_replace(t, "([a-zA-Z]+)", " $1 ")


def lower_latin(text) -> Column:
    """Latin runs lower-cased (A-Z only, accented letters untouched) and spaced."""
    t = F.regexp_replace(_c(text), "([a-zA-Z]+)", " $1 ")
    return F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _space_run_chars(text: Column, char_class: str) -> Column:
    """Each maximal run of ``char_class`` becomes ' c1 c2 ... cn ' (one space between): a space
    goes before every character of the class, and behind the last of a run."""
    t = F.regexp_replace(text, "(" + char_class + ")(?!" + char_class + ")", "$1 ")
    return F.regexp_replace(t, "(?=" + char_class + ")", " ")


def space_symbols(text) -> Column:
    """Each listed punctuation mark of a run becomes its own space-separated token."""
    return _space_run_chars(_c(text), SYMBOL_CLASS)


def space_cjk(text) -> Column:
    """Characters U+4E00..U+9FA5 become separate space-separated tokens."""
    return _space_run_chars(_c(text), CJK_CLASS)


def collapse_ws(text) -> Column:
    """Whitespace runs become one space."""
    return F.regexp_replace(_c(text), WS_CLASS + "+", " ")


def clean_symbols(text) -> Column:
    """Symbols spaced, numbers starred, CJK spaced, whitespace collapsed."""
    return collapse_ws(space_cjk(star_numbers(space_symbols(text))))


def clean_numbers(text) -> Column:
    """Numbers tagged, Latin runs spaced (single letters dropped), whitespace collapsed."""
    return collapse_ws(space_latin(tag_numbers(text)))


def clean_words(text, stop) -> Column:
    """Alnum masked, stars collapsed, typos fixed, split, stop words dropped, joined.

    The dictionary word segmenter of the original is not built; whitespace tokens stand in.
    """
    t = fix_typos(collapse_stars(mask_alnum(text)))
    return join_tokens(drop_stopwords(word_tokens(strip(t)), stop))


def flatten(arrays) -> Column:
    """Flatten one level."""
    return F.flatten(_c(arrays))


def remove_none(arr) -> Column:
    """Drop nulls."""
    return F.array_compact(_c(arr))


def project_with_optional_label(df, cols=("a", "b"), label="label"):
    """Keep the label column when the frame has one."""
    keep = list(cols) + ([label] if label in df.columns else [])
    return df.select(*keep)
