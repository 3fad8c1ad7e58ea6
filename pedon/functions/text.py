"""Identifiers, numbers and codes as people type them."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from pedon.functions.rounding import col

X = Column | str

# Words of an identifier that carry nothing.
NOISE = ["PONTO", "PONTOS", "PT", "AMOSTRA", "AMOSTRAS", "AM", "SAMPLE", "ID", "N", "NO", "NUM"]


def _compatible(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


def _decomposed() -> tuple[str, str]:
    """Characters up to U+FFFF whose compatibility form, without combining marks, is one other character, and that character."""
    pairs = []
    for c in map(chr, (*range(0xA0, 0xD800), *range(0xF900, 0xFFF0))):
        p = _compatible(c)
        if len(p) == 1 and p.isascii():
            pairs.append((c, p))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


_MARKED, _PLAIN = _decomposed()
#: Characters whose compatibility form is several, with a letter or digit among them.
_LONG = {c: p for c in map(chr, (*range(0xA0, 0x2500), *range(0xFB00, 0xFB07))) if len(p := _compatible(c)) > 1 and any(x.isascii() and x.isalnum() for x in p)}
# What stands for a value that was not determined.
MISSING = ["", "ND", "NA", "N/A", "-", "--"]


def plain(x: X) -> Column:
    """Compatibility form without combining marks: accents go, wide letters and superscript digits become plain ones.

    A text of ASCII is its own, so only others are taken apart sign by sign.
    """
    out = F.regexp_replace(F.translate(col(x), _MARKED, _PLAIN), r"[\u0300-\u036F]", "")
    forms = F.create_map(*[F.lit(x) for pair in _LONG.items() for x in pair])
    long = F.array_join(F.transform(F.split(out, ""), lambda c: F.coalesce(forms[c], c)), "")
    return F.when(col(x).rlike(r"[^\x00-\x7F]"), F.when(out.rlike("[" + "".join(_LONG) + "]"), long).otherwise(out)).otherwise(col(x))


def unaccented(x: X) -> Column:
    """Upper case, without accents and in plain letters."""
    return F.upper(plain(F.trim(col(x))))


def _number(digits: Column) -> Column:
    return F.regexp_replace(digits, r"^0+(?=\d)", "")


def id_tokens(x: X) -> Column:
    """Runs of letters and of digits, digits without leading zeros."""
    return F.transform(F.regexp_extract_all(unaccented(x), F.lit(r"([A-Z]+|\d+)"), 1), _number)


def canonical_of(tokens: X) -> Column:
    return F.array_join(col(tokens), "-")


def reduced_of(tokens: X) -> Column:
    """The canonical form without words that carry nothing."""
    return F.array_join(F.filter(col(tokens), lambda t: ~t.isin(*NOISE)), "-")


def canonical_id(x: X) -> Column:
    return canonical_of(id_tokens(x))


def reduced_id(x: X) -> Column:
    return reduced_of(id_tokens(x))


def signature(x: X) -> Column:
    """The numbers in their order, as text: their length is not bounded."""
    return F.array_join(F.transform(F.regexp_extract_all(col(x), F.lit(r"(\d+)"), 1), _number), ",")


def depth_of(x: X) -> Column:
    """struct(top, bottom, base): a layer at the end of an identifier, in cm, and what is left; null layer where the last numbers aren't one."""
    all_ = id_tokens(x)
    t = F.when(F.try_element_at(all_, F.lit(-1)) == "CM", F.slice(all_, 1, F.greatest(F.size(all_) - 1, F.lit(0)))).otherwise(all_)
    n = F.size(t)
    rest = F.when(n >= 2, F.slice(t, 1, F.greatest(n - 2, F.lit(0)))).otherwise(t)
    a, b = (F.when((n >= 2) & F.try_element_at(t, F.lit(i)).rlike(r"^\d{1,9}$"), F.try_element_at(t, F.lit(i)).cast("int")) for i in (-2, -1))
    layer = (a % 5 == 0) & (b % 5 == 0) & (b - a).between(5, 60) & (b <= 100) & F.exists(rest, lambda w: w.rlike(r"^\d"))
    ok = F.coalesce(layer, F.lit(False))
    return F.struct(F.when(ok, a).alias("top"), F.when(ok, b).alias("bottom"), F.array_join(F.when(ok, rest).otherwise(t), "-").alias("base"))


def br_number(x: X) -> Column:
    """struct(value, censored): '1.234,56' is 1234.56, '<0,4' is 0.2 and censored; not determined and unreadable are null."""
    s = F.regexp_replace(col(x), r"\s", "")
    below = s.startswith("<")
    digits = F.regexp_replace(s, "^<", "")
    digits = F.when(digits.contains(","), F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(digits)
    # digits only: 'nan' and 'inf' are no measurements
    value = F.when(~F.upper(s).isin(*MISSING) & digits.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), digits.try_cast("double"))
    return F.struct(F.when(below, value / 2.0).otherwise(value).alias("value"), (F.coalesce(below, F.lit(False)) & value.isNotNull()).alias("censored"))


def br_format(x: X, digits: int = 2) -> Column:
    """A number with a decimal comma, null for null; exact halves (as binary numbers) go to the even digit."""
    v = col(x)
    half = v * F.lit(float(10**digits)) - F.floor(v * F.lit(float(10**digits))) == 0.5
    # an exact half is a multiple of an eighth, a sixteenth and so on; of other numbers only the product is
    exact = half & (v * F.lit(float(2 ** (digits + 1))) == F.floor(v * F.lit(float(2 ** (digits + 1)))))
    return F.when(v.isNotNull(), F.replace(F.format_string(f"%.{digits}f", F.when(exact, F.bround(v, digits)).otherwise(v)), F.lit("."), F.lit(",")))


def slug(x: X) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(unaccented(x)), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when(s == "", "elemento").otherwise(s)


def registry_code(x: X) -> Column:
    """UF-1234567-32 hexadecimal digits, without points and white space; null where it is no code."""
    s = F.upper(F.regexp_replace(col(x), r"[.\s]", ""))
    return F.when(s.rlike(r"^[A-Z]{2}-\d{7}-[0-9A-F]{32}$"), s)


def degrees(x: X) -> Column:
    """Decimal degrees of 8°22'26.947"S, to 6 digits; null where it is no angle. What follows the hemisphere doesn't count."""
    form = r"""^(\d+)°(\d+)'([\d.]+)"?([NSEW])"""
    part = lambda i: F.regexp_extract(F.trim(col(x)), form, i)
    v = part(1).try_cast("double") + part(2).try_cast("double") / 60.0 + part(3).try_cast("double") / 3600.0
    return F.round(F.when(part(4).isin("S", "W"), -v).otherwise(v), 6)
