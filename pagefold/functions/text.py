"""Text as Columns: normal forms, amounts, tokens, likeness."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagefold.functions.lambdas import let

# Words that say nothing of a field.
STOPWORDS = """a an the is are was were be been have has had do does did will would could should may might must shall can cannot
of in on at to for with from by and or but not if as so that this these those it its""".split()


def collapse(c: Column) -> Column:
    """White space runs to one space, none at the ends (Unicode's white space)."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", "")


def compact(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


def metric_text(c: Column) -> Column:
    return F.lower(collapse(c))


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\D", "")


def shape(c: Column, most: int = 20) -> Column:
    """Letters to A, digits to 9, the first most characters."""
    return F.left(F.regexp_replace(F.regexp_replace(c, r"\p{L}", "A"), r"\p{Nd}", "9"), F.lit(most))


def vocab_token(c: Column) -> Column:
    """Lower case, a-z and 0-9 alone; null if shorter than two."""
    t = F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    return F.when(F.length(t) >= 2, t)


def keyword_tokens(c: Column) -> Column:
    """Letter and digit runs of two and more in lower case, without stop words; repeats stay."""
    words = F.transform(F.regexp_extract_all(c, F.lit("[a-zA-Z0-9]+"), F.lit(0)), F.lower)
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(STOPWORDS))


def parse_amount(c: Column) -> Column:
    """A printed amount as a double, or null.

    Currency signs, letters but e and E, and white space go. "1.234,56" and a comma after the last point: the point groups and the
    comma is the decimal sign. A comma alone groups if three digits follow the last, else it is the decimal sign. A point alone is
    the decimal sign. What still is no number is null.
    """
    def number(s: Column) -> Column:
        comma, point = F.instr(s, ",") > 0, F.instr(s, ".") > 0
        last = lambda ch: F.length(s) - F.length(F.substring_index(s, ch, -1))
        european = s.rlike(r"\.\d{3},\d{2}$") | (comma & point & (last(",") > last(".")))
        grouped = F.length(F.substring_index(s, ",", -1)) == 3
        swapped = F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
        return F.when(european, swapped).when(comma & ~point, F.when(grouped, F.replace(s, F.lit(","), F.lit(""))).otherwise(F.replace(s, F.lit(","), F.lit(".")))).otherwise(s)

    plain = let(F.regexp_replace(c, r"(?U)[€$£¥₹₣₹a-df-zA-DF-Z\s]", ""), number)
    return let(plain, lambda x: F.when(x.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), x.try_cast("double")))


@F.pandas_udf(T.StringType())
def nfkc_lower(s: pd.Series) -> pd.Series:
    """NFKC, lower case, white space collapsed. Spark has no Unicode normal forms, so this one is an Arrow batch in Python."""
    return s.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).lower().split()))


@lru_cache(maxsize=1 << 16)
def aligned(t: str | None) -> str | None:
    """NFKD without combining marks, lower case, punctuation to spaces, white space collapsed."""
    if t is None:
        return None
    if t.isascii() and t.isalnum():
        return t.lower()
    base = "".join(ch for ch in unicodedata.normalize("NFKD", t) if not unicodedata.combining(ch)).lower()
    return " ".join("".join(ch if ch.isalnum() or ch == "_" or ch.isspace() else " " for ch in base).split())


def pystrings(texts: pa.Array) -> list[str]:
    """to_pylist(), much faster."""
    return texts.to_numpy(zero_copy_only=False).tolist()


#: ASCII that no word of aligned() has.
APART = "".join(c for c in map(chr, range(128)) if not c.isalnum() and c != "_")


def aligned_all(texts: pa.Array) -> list[str]:
    """aligned() of each, "" for null; those of ASCII without Python's letter by letter."""
    texts = pc.fill_null(texts, "")
    out, ascii_ = pc.ascii_trim(pc.ascii_lower(texts), APART), pc.string_is_ascii(texts)
    some = pc.and_(pc.invert(pc.ascii_is_alnum(out)), ascii_)
    out = pc.replace_with_mask(out, some, pc.ascii_trim(pc.replace_substring_regex(out.filter(some), "[^a-z0-9_]+", " "), " "))
    others = pc.invert(ascii_)
    out = pc.replace_with_mask(out, others, pa.array([aligned(x) for x in pystrings(texts.filter(others))], pa.string()))
    return pystrings(out)


@F.pandas_udf(T.StringType())
def align_text(s: pd.Series) -> pd.Series:
    """aligned() of each."""
    return s.map(aligned)


def ocr_code(c: Column) -> Column:
    """NFKC in lower case without spaces; o is 0 and l is 1."""
    return F.translate(nfkc_lower(c), "ol ", "01")


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff and Obershelp's likeness, as difflib has it; the order of arguments matters. Null if either is."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def best_part(short: str, long: str) -> float:
    """Likeness, 0 to 100, of the shorter text to the best window of its length in the longer."""
    if len(short) > len(long):
        short, long = long, short
    if not short:
        return 0.0 if long else 100.0
    best = 0.0
    for i in range(len(long) - len(short) + 1):
        best = max(best, SequenceMatcher(None, short, long[i : i + len(short)], autojunk=False).ratio())
        if best == 1.0:
            break
    return 100.0 * best


@F.pandas_udf(T.DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else best_part(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
