"""Device, object and contour names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Device type codes, in the order the patterns try them.
DEVICE_CODES = ("V", "DI", "DO", "AI", "AO", "M", "LS", "LT", "TE", "QT", "FQT", "PT", "PC")
# Fixed value: placeholder that means "no device".
NO_DEVICE = "Нет"
# Characters removed from both ends of a contour name candidate.
NAME_EDGE = "=<>:;,-"
# Labels longer than this are prose, scores up to this are no match.
LABEL_MAX = 10
FUZZY_MIN = 0.6

_CODES = "(" + "|".join(DEVICE_CODES) + ")"


# White space characters of Unicode text.
WHITE_SPACE = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)


def strip(c: Column) -> Column:
    """Remove white space, Unicode included, at both ends."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def device_type(name: Column) -> Column:
    """Type code in front of the final digits of a name, or null."""
    return _filled(F.regexp_extract(F.upper(name), _CODES + r"([0-9]+)$", 1))


def device_object(name: Column) -> Column:
    """Object part of a device name: shortest prefix before type code and digits, or null."""
    return _filled(F.regexp_extract(name, "^(.+?)" + _CODES + r"[0-9]+$", 1))


def device_short_name(name: Column) -> Column:
    """Upper-case device part that follows ``device_object``."""
    return F.upper(F.substr(name, F.length(device_object(name)) + 1))


def is_label(text: Column) -> Column:
    """True for short trimmed texts with a Latin letter directly before a digit."""
    return (F.length(text) <= LABEL_MAX) & text.rlike("[A-Za-z][0-9]")


def label_name(text: Column) -> Column:
    """Label in a trimmed text: letters, optional separator, digits; separators removed."""
    found = F.regexp_extract(F.upper(text), r"([A-Z]+[-\s_]?[0-9]+)", 1)
    return F.coalesce(_filled(F.regexp_replace(found, r"[-\s_]", "")), text)


def contour_candidate(text: Column) -> Column:
    """Contour name candidate: between the first two plus signs, or null."""
    part = strip(F.split_part(text, F.lit("+"), F.lit(2)))
    edge = "[" + NAME_EDGE.replace("-", r"\-") + "]+"
    return F.when(
        F.contains(text, F.lit("+")) & part.rlike(r"[\p{L}\p{N}]"),
        F.regexp_replace(part, f"^{edge}|{edge}$", ""),
    )


def contour_object(name: Column) -> Column:
    """Object a contour stands for: part after the last plus sign, or null."""
    return _filled(strip(F.element_at(F.split(name, r"\+"), -1)))


def name_prefix(name: Column) -> Column:
    """Leading letters and the digits after them, or null."""
    return _filled(F.regexp_extract(name, "^([A-Za-z]+[0-9]*)", 1))


def is_device_name(name: Column) -> Column:
    """True for names that are neither blank nor the placeholder."""
    return (strip(name) != "") & (name != NO_DEVICE)


def common_prefix_length(a: Column, b: Column) -> Column:
    """Number of equal characters at the start of both strings."""
    shorter = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(1), shorter), lambda i: F.left(a, i) == F.left(b, i))
    return F.when(shorter > 0, F.size(same)).otherwise(0)


def similarity(a: Column, b: Column) -> Column:
    """Score in [0, 1]: equality, else containment ratio, else common prefix share."""
    a, b = F.upper(a), F.upper(b)
    la, lb = F.length(a), F.length(b)
    return (
        F.when((la == 0) | (lb == 0) | a.isNull() | b.isNull(), F.lit(0.0))
        .when(a == b, F.lit(1.0))
        .when(F.contains(b, a), la / lb)
        .when(F.contains(a, b), lb / la)
        .otherwise(common_prefix_length(a, b) / F.greatest(la, lb))
    )
