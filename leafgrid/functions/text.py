"""Column expressions on text: trimming, captions, slugs, masking."""

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from leafgrid import constants as K

# Characters that NFC may change or join with a neighbour.  Text without any of them
# is already NFC, so it never has to leave the JVM.
NFC_SUSPECTS = (
    r"[\p{M}\x{374}\x{900}-\x{FFF}\x{1100}-\x{11FF}\x{2126}\x{212A}\x{212B}\x{1F71}-\x{1FFD}\x{2000}-\x{2001}"
    r"\x{2329}-\x{232A}\x{2ADC}\x{37E}\x{387}\x{F900}-\x{FAFF}\x{FB1D}-\x{FB4E}\x{11000}-\x{11FFF}"
    r"\x{1D15E}-\x{1D1C0}\x{2F800}-\x{2FA1F}]"
)


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")


def nfc(text: Column) -> Column:
    """Canonical composition.  Python sees a value only if it may change."""
    return F.coalesce(_nfc(F.when(text.rlike(NFC_SUSPECTS), text)), text)


def strip(text: Column) -> Column:
    """Trim all Unicode whitespace; works from both ends, without a pattern."""
    return F.trim(text, F.lit(K.WS_CHARS))


def squeeze(text: Column) -> Column:
    """Runs of whitespace become one space, ends are trimmed."""
    return F.trim(F.regexp_replace(text, f"{K.WS}+", " "))


def non_blank(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def first_text(*texts: Column) -> Column:
    return F.coalesce(*[non_blank(t) for t in texts], F.lit(""))


def clean_caption(raw: Column) -> Column:
    return F.coalesce(non_blank(F.regexp_replace(raw, K.CAPTION_PREFIX, "")), raw)


def slug(text: Column, normalised: bool = False) -> Column:
    """File-name safe form; keeps Hangul, at most 40 characters."""
    t = text if normalised else nfc(text)
    t = F.regexp_replace(strip(t), K.SLUG_BANNED, "")
    t = F.regexp_replace(t, " +", "-")
    t = F.substring(F.regexp_replace(t, "^-+|-+$", ""), 1, K.SLUG_LENGTH)
    return F.coalesce(F.nullif(t, F.lit("")), F.lit(K.UNTITLED))


def mask(text: Column, rules=K.SECRET_RULES) -> Column:
    return reduce(lambda t, r: F.regexp_replace(t, r[0], r[1].replace("$", r"\$")), rules, text)


def shorten(text: Column, length: int) -> Column:
    """Cut to ``length`` characters and mark the cut."""
    cut = F.substring(text, 1, length)
    return F.when(F.length(text) > length, F.concat(cut, F.lit(K.ELLIPSIS))).otherwise(cut)


def contains_any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def starts_with_any(text: Column, prefixes) -> Column:
    return reduce(lambda a, b: a | b, [text.startswith(p) for p in prefixes])


