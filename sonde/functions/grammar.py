"""Column builders for the recording text grammar: tokens, integers, 32-bit floats.

Everything stays in Catalyst expressions.  A token is checked before it is cast, because a
bare cast is more lenient than the grammar (blanks, suffixes, exponents, nan).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: token patterns of the text format ---------------------------------------
UNSIGNED = r"^[0-9]+$"
SIGNED = r"^-?[0-9]+$"
FLOAT = r"^-?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
BLANKS = r"[ \t\r\n\f\x0B]+"
NONZERO_MANTISSA = r"^[^eE]*[1-9]"


def tokens(line: Column) -> Column:
    return F.split(F.regexp_replace(F.regexp_replace(line, f"^{BLANKS}", ""), f"{BLANKS}$", ""), BLANKS)


def token(array: Column, index: int | Column) -> Column:
    """The token, or null past the end (indexing would fail under ANSI mode)."""
    return F.get(array, index if isinstance(index, Column) else F.lit(index))


def integer(text: Column, kind: str = "bigint", signed: bool = False, top: str | None = None) -> Column:
    """The token as `kind`; null when it is no integer or is out of range."""
    value = F.when(text.rlike(SIGNED if signed else UNSIGNED), text.try_cast(kind))
    return value if top is None else F.when(value <= F.lit(top).cast("decimal(38,0)"), value)


def single(value: Column) -> Column:
    """A double as 32-bit float; -0 and 0 are one value."""
    return value.cast("float") + F.lit(0.0).cast("float")


def single_fits(text: Column, value: Column) -> Column:
    """Whether a token's double neither overflows a 32-bit float nor underflows to zero."""
    narrow = value.cast("float")
    lost = (narrow == 0) & text.rlike(NONZERO_MANTISSA)
    return (F.abs(narrow) < F.lit(float("inf")).cast("float")) & ~lost


def plain_numbers(line: Column) -> Column:
    """Whether all tokens after the first use only characters of the number grammar.

    On such a line a cast to double accepts exactly the float grammar, so long lists of numbers
    need one pattern per line instead of one per number.
    """
    return line.rlike(r"^\s*\S+[-+0-9.eE\s]*$") & ~line.rlike(r"\s\+")


def finite(value: Column) -> Column:
    """True for a number that is neither NaN nor infinite; null stays null."""
    return ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
