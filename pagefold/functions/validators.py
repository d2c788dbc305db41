"""How well a text fits its field's format, as Columns: 1, 0.5 or 0."""

from __future__ import annotations

import re
from datetime import datetime
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagefold.functions.catalog import FAMILIES

# Patterns, signs and codes.
IBAN = r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"
BIC = r"^[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}([A-Z0-9]{3})?$"
TAX_STRICT, TAX_DIGITS, GARBAGE = r"(?iu)(?U)^[A-Z]{2}[\w\-./]{5,}$", r"(?U)^\d[\d\-./]{4,}$", r"(?U)[^\w\s\-./]"
REGISTRATION = r"(?iu)(?U)^[A-Z0-9][\w\-./\s]{3,14}$"
SIGNS = "$€£¥₹₽¢₩₪₦₴₺₱฿₸"
AMOUNT = rf"(?iu)(?U)^(?:[{SIGNS}]|[A-Z]{{3}}\s*)?[\d][\d,.\s]*(?:\s*(?:[A-Z]{{3}}|[{SIGNS}]))?$"
NOT_AMOUNT = rf"(?iu)(?U)[^\d,.\s{SIGNS}A-Z%-]"
RATE = r"(?U)^\d+(\.\d+)?\s*%?$"
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
DATES = (
    r"^\d{4}-\d{2}-\d{2}$",
    r"^\d{1,2}/\d{1,2}/\d{2,4}$",
    r"^\d{1,2}\.\d{1,2}\.\d{2,4}$",
    r"^\d{1,2}-\d{1,2}-\d{2,4}$",
    rf"(?i)^\d{{1,2}}\s+(?:{MONTHS})[a-z]*\.?\s*,?\s*\d{{2,4}}$",
    rf"(?i)^(?:{MONTHS})[a-z]*\.?\s+\d{{1,2}},?\s+\d{{2,4}}$",
)
CODES = """USD EUR GBP JPY CHF CAD AUD NZD CNY HKD SEK NOK DKK SGD MXN BRL INR KRW ZAR TRY RUB PLN CZK HUF RON BGN HRK ISK ILS SAR AED THB MYR
IDR PHP TWD PKR EGP UAH CLP ARS COP PEN VND NGN KES GHS MAD QAR KWD BHD OMR JOD LBP DZD TND LYD ETB TZS UGX""".split()
EMAIL = r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$"
QUANTITY, POSITION = r"(?U)^-?\d+([.,]\d+)?$", r"(?U)^\d+$"


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _one(test: Column) -> Column:
    return F.when(test, F.lit(1.0)).otherwise(F.lit(0.0))


def iban(c: Column) -> Column:
    """Length, pattern and the checksum by 97: letters are 10 to 35 and the rest runs along the characters."""
    s = F.upper(F.regexp_replace(c, " ", ""))
    turned = F.concat(F.substring(s, 5, 34), F.left(s, F.lit(4)))
    value = lambda ch: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ch) - 1
    rest = F.aggregate(F.split(turned, "", -1), F.lit(0), lambda a, ch: (a * F.when(value(ch) > 9, 100).otherwise(10) + value(ch)) % 97)
    return F.when(F.length(s).between(15, 34) & s.rlike(IBAN), _one(rest == 1)).otherwise(F.lit(0.0))


def bic(c: Column) -> Column:
    s = F.upper(_trimmed(c))
    return _one(F.length(s).isin(8, 11) & s.rlike(BIC))


def tax_id(c: Column) -> Column:
    s = _trimmed(c)
    return F.when((s == "") | s.rlike(GARBAGE), 0.0).when(s.rlike(r"(?U)\s"), 0.5).when(s.rlike(TAX_STRICT) | s.rlike(TAX_DIGITS), 1.0).otherwise(0.5)


def registration_id(c: Column) -> Column:
    s = _trimmed(c)
    return F.when(s == "", 0.0).when(s.rlike(GARBAGE), 0.5).when(s.rlike(REGISTRATION), 1.0).otherwise(0.5)


def amount(c: Column) -> Column:
    s = _trimmed(c)
    return _one((s != "") & ~s.rlike(NOT_AMOUNT) & s.rlike(AMOUNT))


def rate(c: Column) -> Column:
    s = _trimmed(c)
    value = F.regexp_replace(s, r"(?U)[%\s]", "").try_cast("double")
    return _one(s.rlike(RATE) & F.coalesce(value.between(0, 100), F.lit(False)))


def date(c: Column) -> Column:
    """Any of six patterns, or a real date of year, month and day with one digit or two."""
    s = _trimmed(c)
    loose = r"(?i)^\d{4}-\d{1,2}-\d{1,2}$"
    real = F.try_to_timestamp(s, F.lit("yyyy-M-d")).isNotNull()
    return _one(reduce(lambda a, b: a | b, [s.rlike(p) for p in DATES]) | (s.rlike(loose) & real))


def currency(c: Column) -> Column:
    s = F.upper(_trimmed(c))
    return F.when(s.isin(*SIGNS) | s.isin(*CODES), 1.0).when(s.rlike("^[A-Z]{3}$"), 0.5).otherwise(0.0)


def email(c: Column) -> Column:
    return _one(_trimmed(c).rlike(EMAIL))


def quantity(c: Column) -> Column:
    return _one(_trimmed(c).rlike(QUANTITY))


def position(c: Column) -> Column:
    return _one(_trimmed(c).rlike(POSITION))


VALIDATORS = {"iban": iban, "bic": bic, "tax_id": tax_id, "registration_id": registration_id, "amount": amount, "rate": rate, "date": date, "currency": currency, "email": email, "quantity": quantity, "position": position}


def format_confidence(fieldtype: Column, text: Column) -> Column:
    """The validator of the field type; 1 for other types, and for null text."""
    out = F.lit(1.0)
    for family, types in FAMILIES.items():
        out = F.when(fieldtype.isin(types), VALIDATORS[family](text)).otherwise(out)
    return F.when(text.isNull(), F.lit(1.0)).otherwise(out)


def validator_check(fieldtype: Column, text: Column) -> Column:
    """The confidence if it is at least a half, else null."""
    c = format_confidence(fieldtype, text)
    return F.when(c >= 0.5, c)


@lru_cache(maxsize=64)
def _python(pattern: str) -> re.Pattern:
    """A Java pattern of this module for Python, whose classes are Unicode's anyway."""
    bare = re.sub(r"\(\?(?:iu|U)\)", "", pattern)
    return re.compile(bare, re.IGNORECASE if "(?iu)" in pattern else 0)


def confidence(fieldtype: str | None, text: str) -> float:
    """format_confidence of one text in plain Python, for operators that search a page's runs row by row."""
    family = next((f for f, types in FAMILIES.items() if fieldtype in types), None)
    found = lambda pattern, s: _python(pattern).search(s) is not None
    s = text.strip()
    if family == "iban":
        s = text.replace(" ", "").upper()
        if not (15 <= len(s) <= 34 and found(IBAN, s)):
            return 0.0
        return float(int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1)
    if family == "bic":
        return float(len(s) in (8, 11) and found(BIC, s.upper()))
    if family == "tax_id":
        if not s or found(GARBAGE, s):
            return 0.0
        return 0.5 if any(c.isspace() for c in s) or not (found(TAX_STRICT, s) or found(TAX_DIGITS, s)) else 1.0
    if family == "registration_id":
        return 0.0 if not s else 1.0 if not found(GARBAGE, s) and found(REGISTRATION, s) else 0.5
    if family == "amount":
        return float(bool(s) and not found(NOT_AMOUNT, s) and found(AMOUNT, s))
    if family == "rate":
        return float(found(RATE, s) and 0 <= float(re.sub(r"[%\s]", "", s)) <= 100)
    if family == "date":
        return float(any(found(d, s) for d in DATES) or _loose_date(s))
    if family == "currency":
        s = s.upper()
        return 1.0 if s in [*SIGNS, *CODES] else 0.5 if re.fullmatch("[A-Z]{3}", s) else 0.0
    patterns = {"email": EMAIL, "quantity": QUANTITY, "position": POSITION}
    return float(found(patterns[family], s)) if family else 1.0


def _loose_date(s: str) -> bool:
    try:
        datetime.strptime(s, "%Y-%m-%d")
    except ValueError:
        return False
    return True
