"""Rescaling of vector-graphics attributes kept as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheetloom.functions.names import strip
from sheetloom.functions.numbers import all_fixed3, fixed3, float_text, thousandths, thousandths_text, to_number

# Scale of the export and attributes that hold one coordinate.
SCALE = 1.25
COORDINATES = ("x", "y", "x1", "y1", "x2", "y2", "cx", "cy", "r", "rx", "ry", "width", "height")

_NUMBER = r"-?\d+\.?\d*"
# Path data by its grammar: a number may have an exponent, and a flag of an arc may touch what follows.
_REAL = r"[-+]?(?:\d++\.?+\d*+|\.\d++)(?:[eE][-+]?\d++)?+"
_GAP = r"[\s,]*+"
_COMMANDS = "MmZzLlHhVvCcSsQqTtAa"
_COMMAND = rf"[{_COMMANDS}][^{_COMMANDS}]*"
# Radii, then rotation and the two flags, then the end point.
_ARC = rf"({_REAL})({_GAP})({_REAL})({_GAP}{_REAL}{_GAP}[01]{_GAP}[01]{_GAP})({_REAL})({_GAP})({_REAL})"
_TRANSLATE = r"translate\(([^)]+)\)"


# Stands for matches where a text is cut at them.
_CUT = "\u0001"


def _between(text: Column, pattern: str) -> Column:
    """The parts of ``text`` around the matches of ``pattern``.

    ``split`` compiles its pattern anew for each row unless it is one plain character.
    """
    marked = F.split(F.regexp_replace(text, pattern, _CUT), _CUT, -1)
    return F.when(F.contains(text, F.lit(_CUT)), F.split(text, pattern, -1)).otherwise(marked)


def _rewrite(text: Column, pattern: str, *changes) -> Column:
    """Replace every match of ``pattern`` by what ``changes`` make of it, one after the other."""
    between = _between(text, pattern)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    for change in changes:
        found = F.transform(found, change)
    return F.array_join(
        F.zip_with(between, found, lambda b, m: F.concat(b, F.coalesce(m, F.lit("")))), ""
    )


def _pair(text: Column, scale: float, whole: Column) -> Column:
    """Scaled numbers of ``x,y``, null where there is none, and the text for other forms."""
    x, y = (F.when(F.size(F.split(text, ",")) == 2, to_number(F.get(F.split(text, ","), i))) for i in (0, 1))
    return F.struct((x * scale).alias("x"), (y * scale).alias("y"), whole.alias("whole"))


def _pair_text(p: Column, before: str = "", after: str = "") -> Column:
    done = F.concat(F.lit(before), fixed3(p["x"]), F.lit(","), fixed3(p["y"]), F.lit(after))
    return F.coalesce(done, p["whole"])


def rescale_path(d: Column, scale: float = SCALE) -> Column:
    """Scale every number of path data to three decimals (arc flags included)."""
    return _rewrite(d, _NUMBER, lambda m: m.cast("double") * scale, thousandths, thousandths_text)


def _apart(gap: Column, number: Column) -> Column:
    """A number after its gap; a blank parts it from a number that it would touch."""
    touching = (gap == "") & ~F.startswith(number, F.lit("-"))
    return F.concat(F.when(touching, " ").otherwise(gap), number)


def _rewrite_list(text: Column, pattern: str, *changes) -> Column:
    """``_rewrite`` for lists of numbers, which stay apart."""
    between, found = _between(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    for change in changes:
        found = F.transform(found, change)
    return F.array_join(F.zip_with(between, found, lambda b, m: F.coalesce(_apart(b, m), b)), "")


def _arc_parts(arc: Column, scale: float) -> Column:
    """Scaled radii and end point of an arc, and what stands between them."""
    # One search marks the seven groups; an arc holds nothing but numbers, blanks and commas.
    parts = F.split(F.regexp_replace(arc, _ARC, "$1;$2;$3;$4;$5;$6;$7"), ";", -1)

    def of(p: Column) -> Column:
        numbers = all_fixed3(F.array(*[F.get(p, i).cast("double") * scale for i in (0, 2, 4, 6)]))
        return F.struct(numbers.alias("n"), F.get(p, 1).alias("radii"), F.get(p, 3).alias("flags"), F.get(p, 5).alias("ends"))

    return F.get(F.transform(F.array(parts), of), 0)


def _arc_text(p: Column) -> Column:
    number = lambda i: F.get(p["n"], i)
    return F.concat(number(0), _apart(p["radii"], number(1)), p["flags"], number(2), _apart(p["ends"], number(3)))


def rescale_path_by_grammar(d: Column, scale: float = SCALE) -> Column:
    """Scale path data command by command, to three decimals.

    Unlike ``rescale_path`` it leaves rotations and flags of arcs alone, reads exponents as part of
    their numbers, and keeps numbers apart that touched (``1.5.5``). What stands before the first
    command, and what does not make up a whole arc, stays as it is; null gives null.
    """

    def command(c: Column) -> Column:
        arcs = _rewrite_list(c, _ARC, lambda m: _arc_parts(m, scale), _arc_text)
        plain = _rewrite_list(c, _REAL, lambda m: m.cast("double") * scale, thousandths, thousandths_text)
        return F.when(F.lower(F.left(c, F.lit(1))) == "a", arcs).otherwise(plain)

    return _rewrite(d, _COMMAND, command)


def rescale_translate(transform: Column, scale: float = SCALE) -> Column:
    """Scale ``translate(a,b)``; other forms stay."""
    return _rewrite(
        transform,
        _TRANSLATE,
        lambda m: _pair(strip(F.regexp_extract(m, _TRANSLATE, 1)), scale, m),
        lambda p: _pair_text(p, "translate(", ")"),
    )


def rescale_points(points: Column, scale: float = SCALE) -> Column:
    """Scale a blank-separated list of ``x,y`` pairs; bad pairs stay."""
    pairs = F.filter(F.split(strip(points), r"\s+"), lambda p: p != "")
    return F.array_join(F.transform(F.transform(pairs, lambda p: _pair(p, scale, p)), lambda p: _pair_text(p)), " ")


def rescale_attributes(tag: Column, attrs: Column, scale: float = SCALE, by_grammar: bool = False) -> Column:
    """Scale all geometry of one element given as ``map<string,string>``; path data by its grammar if asked for."""
    path = rescale_path_by_grammar if by_grammar else rescale_path
    outline = F.endswith(tag, F.lit("polygon")) | F.endswith(tag, F.lit("polyline"))
    return F.transform_values(
        attrs,
        lambda k, v: F.when(k.isin(*COORDINATES), F.coalesce(float_text(to_number(v) * scale), v))
        .when(k == "transform", rescale_translate(v, scale))
        .when((k == "d") & F.endswith(tag, F.lit("path")), path(v, scale))
        .when((k == "points") & outline, rescale_points(v, scale))
        .otherwise(v),
    )
