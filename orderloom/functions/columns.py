"""Column expressions shared by the operators."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Blank means nothing but characters up to U+0020. Spark's trim() strips spaces
# only, so tabs and newlines need the pattern; a no-break space is not blank.
BLANK_PATTERN = r"\A[\x00-\x20]*\z"

# An integer field has no padding; a cast would accept ' 7 '.
INTEGER_PATTERN = r"\A[+-]?[0-9]+\z"

GRAINS = ("day", "week", "month")


def is_blank(key: Column) -> Column:
    """True where ``key`` is null, empty or white space, whatever its type."""
    return key.isNull() | key.cast("string").rlike(BLANK_PATTERN)


def any_null(*names: str) -> Column:
    """True where at least one of the named columns is null."""
    missing = F.lit(False)
    for name in names:
        missing = missing | F.col(name).isNull()
    return missing


def field_or_null(cells: Column, position: int, field: T.StructField) -> Column:
    """One cell of a split line as ``field``'s type; null if it is missing or no such value."""
    return F.get(cells, F.lit(position)).try_cast(field.dataType)


def is_padded_integer(cells: Column, position: int, parsed: Column) -> Column:
    """True where ``parsed`` came from text with padding, which the cast alone accepts.

    Plainly written numbers read back as the text they came from; only the others are
    held against the pattern, which takes far longer than the comparison.
    """
    raw = F.get(cells, F.lit(position))
    return (raw != parsed.cast("string")) & ~raw.rlike(INTEGER_PATTERN)


def period_start(day: Column, grain: str) -> Column:
    """First day of the period that holds ``day``.

    Weeks start on Monday and carry their own start date, so the week around
    New Year stays in one piece.
    """
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {GRAINS}, got {grain!r}")
    return day if grain == "day" else F.trunc(day, grain)


# Digits of a single amount; a sum of decimals has ten more, room for 10^10 such amounts.
AMOUNT_DIGITS = 28


def exact_amount(amount: Column, scale: int) -> Column:
    """``amount`` rounded to a decimal; one too large for it fails the job in any mode.

    A number that is none (NaN) becomes null.
    """
    rounded = amount.try_cast(T.DecimalType(AMOUNT_DIGITS, scale))
    lost = amount.isNotNull() & rounded.isNull() & ~F.isnan(amount.cast("double"))
    too_large = F.raise_error(F.concat(F.lit("amount too large to add: "), amount.cast("string")))
    return F.when(lost, too_large.cast(T.DecimalType(AMOUNT_DIGITS, scale))).otherwise(rounded)


# Amounts below 10^18 units of the last place are added as integers, in limbs of 20 bits.
_SMALL_DIGITS, _LIMB_BITS = 18, 20
#: Amounts that one total can hold: a limb of 20 bits of each leaves room for 2^43 in a long.
MOST_AMOUNTS = 1 << 42


def _units(amount: Column, scale: int) -> tuple[Column, Column]:
    """``amount`` in units of the last place, as a long, or, if it is too large, as a decimal; the
    other of the two is null, and both are for null and NaN.

    The digits of an amount are rounded half up. Its product with a power of ten, as doubles, is off
    by less than 2^-50 of itself; only where that could matter, next to a half, or where
    the product is so large that it has no room for a fraction, are decimals used.
    """
    product = amount.cast("double") * F.lit(float(10**scale))
    size = F.abs(product)
    capped = F.least(size, F.lit(2.0**50))
    whole = F.floor(capped)
    fraction = capped - whole
    is_clear = (size < 2.0**49) & (F.abs(fraction - 0.5) > size * 2.0**-50)
    nearest = whole + F.when(fraction > 0.5, F.lit(1)).otherwise(F.lit(0))
    rounded = exact_amount(amount, scale)
    is_small = F.abs(rounded) < F.lit(Decimal(10 ** (_SMALL_DIGITS - scale)))
    units = (
        F.when(is_clear, F.when(product < 0, -nearest).otherwise(nearest))
        .when(is_small, (rounded * F.lit(Decimal(10**scale))).cast("bigint"))
    )
    return units, F.when(is_clear | is_small, F.lit(None)).otherwise(rounded)


def exact_parts(amount: Column, scale: int) -> dict[str, Column]:
    """Aggregates from which ``total_of`` makes the sum of amounts; sums of them are parts again.

    Units of the last place are added as longs, in three limbs of 20 bits so that none runs over.
    """
    units, large = _units(amount, scale)
    low = F.lit((1 << _LIMB_BITS) - 1)
    is_nan = F.isnan(amount.cast("double"))
    return {
        "high": F.sum(F.shiftright(units, 2 * _LIMB_BITS)),
        "middle": F.sum(F.shiftright(units, _LIMB_BITS).bitwiseAND(low)),
        "low": F.sum(units.bitwiseAND(low)),
        "large": F.sum(large),
        "numbers": F.count_if(amount.isNotNull() & ~is_nan),
        "others": F.count_if(is_nan),
    }


def total_of(parts: dict[str, Column], scale: int) -> Column:
    """The total as ``decimal(38, scale)``, null without numbers; one too large fails the job."""
    kind = T.DecimalType(38, scale)

    def shifted(name: str, bits: int) -> Column:
        return F.coalesce(parts[name], F.lit(0)).cast("decimal(19,0)") * F.lit(Decimal(1 << bits))

    units = shifted("high", 2 * _LIMB_BITS) + shifted("middle", _LIMB_BITS) + shifted("low", 0)
    unit = F.lit(Decimal(1).scaleb(-scale))
    total = (units * unit).cast(kind) + F.coalesce(parts["large"].cast(kind), F.lit(Decimal(0)).cast(kind))
    too_large = (total.cast(kind).isNull()) | (parts["numbers"] > MOST_AMOUNTS)
    overflow = F.raise_error(F.lit("sum of amounts is too large")).cast(kind)
    return F.when(parts["numbers"] == 0, F.lit(None)).when(too_large, overflow).otherwise(total.cast(kind))


def exact_total(amount: Column, scale: int) -> Column:
    """Sum of amounts as a decimal, each rounded to ``scale``; too large a sum fails the job.

    Numbers that are none (NaN) are left out. Decimals are faster here than ``exact_parts``, which are
    for sums that are stored and added again.
    """
    addend = exact_amount(amount, scale)
    total = F.sum(addend)
    overflow = F.raise_error(F.lit("sum of amounts is too large")).cast(T.DecimalType(38, scale))
    return F.when(F.count(addend) == 0, F.lit(None)).when(total.isNull(), overflow).otherwise(total)


def exact_sum(amount: Column, scale: int | None) -> Column:
    """Sum of money as double.

    ``scale=None`` adds doubles, so the last bits depend on the order of addition.
    With a scale every amount is rounded to it and added as a decimal: the same
    total on any cluster, partitioning or retry. A NaN makes the sum NaN either way.
    """
    if scale is None:
        return F.sum(amount)
    return F.when(F.bool_or(F.isnan(amount.cast("double"))), F.lit(float("nan"))).otherwise(
        exact_total(amount, scale).cast("double")
    )
