"""A screen of parent keys: most orphans are told apart before anything is shuffled.

The screen is a bit per hash value of a key, built by Spark's bitmap aggregates, combined in the
tasks that scan the parent. A child row whose bit is unset has no parent for certain. One whose bit
is set may have one, and the join decides. The bits are broadcast: their size follows the number of
parent keys, and more keys than ``SCREEN_BYTES`` have room for are not screened at all.

It pays where many child rows are orphans: these are then neither shuffled nor sorted. It costs a
scan of the parent keys, and saves nothing where the parent is small enough to be broadcast itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.operators.quality import drop_orphans, missing_references

#: Bytes of the bits that are broadcast, at most.
SCREEN_BYTES = 64 << 20
#: Bits per parent key: one orphan in nine passes the screen.
BITS_PER_KEY = 8
#: Fixed value: bits that one row of Spark's bitmap aggregate holds.
BITMAP_BITS = 1 << 15

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_PLAIN = (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)


@dataclass(frozen=True)
class KeyScreen:
    """``bits`` has one row per bitmap: ``_screen_bitmap``, its number, and ``_screen_bits``."""

    bits: DataFrame
    bitmaps: int
    key_type: T.DataType

    def split(self, child: DataFrame, fk: str) -> DataFrame:
        """``child`` with ``_known``: false where no parent has the key, for certain; a null key has none."""
        if not _same_kind(child.schema[fk].dataType, self.key_type):
            raise TypeError(
                f"{fk} is {child.schema[fk].dataType.simpleString()}, "
                f"the keys are {self.key_type.simpleString()}"
            )
        bitmap, position = _place(child, fk, self.bitmaps)
        at = F.col("_screen_position")
        # One byte of the bitmap, as a number; the lowest bit comes first.
        byte = F.conv(F.hex(F.substring("_screen_bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
        bit = F.getbit(byte, at.bitwiseAND(F.lit(7)))
        placed = child.withColumns({"_screen_bitmap": bitmap, "_screen_position": position})
        # At most SCREEN_BYTES and their keys.
        return placed.join(F.broadcast(self.bits), "_screen_bitmap", "left").select(
            *[F.col(f"`{c}`") for c in child.columns],
            (F.col(f"`{fk}`").isNotNull() & (F.coalesce(bit, F.lit(0)) == 1)).alias("_known"),
        )


def key_screen(parent: DataFrame, key: str, max_bytes: int = SCREEN_BYTES) -> KeyScreen | None:
    """The screen of ``parent``'s keys, or None if ``max_bytes`` are too few for them.

    Keys are integers, text, binary, dates or timestamps; other types, whose equal values may differ
    in their bytes, are refused. Rows are counted first, which a stored table answers
    from its footers; copies of a key count, so a parent with very many may go without a screen.
    """
    key_type = parent.schema[key].dataType
    if not isinstance(key_type, (*_INTEGRAL, *_PLAIN)):
        raise TypeError(f"keys of type {key_type.simpleString()} cannot be screened")
    bitmaps = max(1, -(-parent.count() * BITS_PER_KEY // BITMAP_BITS))
    if bitmaps * BITMAP_BITS // 8 > max_bytes:
        return None
    bitmap, position = _place(parent, key, bitmaps)
    bits = (
        parent.where(F.col(f"`{key}`").isNotNull())
        .select(bitmap.alias("_screen_bitmap"), position.alias("_screen_position"))
        .groupBy("_screen_bitmap")
        .agg(F.bitmap_construct_agg("_screen_position").alias("_screen_bits"))
    )
    return KeyScreen(bits, bitmaps, key_type)


def drop_orphans_screened(
    child: DataFrame, fk: str, parent: DataFrame, key: str, unique: bool = False,
    max_bytes: int = SCREEN_BYTES,
) -> DataFrame:
    """``quality.drop_orphans``, with the rows and columns of that, for children with many orphans."""
    screen = key_screen(parent, key, max_bytes)
    if screen is not None:
        child = screen.split(child, fk).where("_known").drop("_known")
    return drop_orphans(child, fk, parent, key, unique)


def missing_references_screened(
    child: DataFrame, fk: str, parent: DataFrame, key: str, max_bytes: int = SCREEN_BYTES
) -> DataFrame:
    """``quality.missing_references``: one row, ``missing``, for children with many orphans.

    Rows without a bit become one partial count a task and are in no join. Their keys are
    nulled for that: however many different keys orphans have, they are one key to count.
    """
    screen = key_screen(parent, key, max_bytes)
    if screen is not None:
        keys = screen.split(child.select(fk), fk)
        child = keys.select(F.when(F.col("_known"), F.col(f"`{fk}`")).alias(fk))
    return missing_references(child, fk, parent, key)


def _place(rows: DataFrame, key: str, bitmaps: int) -> tuple[Column, Column]:
    """The number of a key's bitmap and its position there, from one hash."""
    column = F.col(f"`{key}`")
    if isinstance(rows.schema[key].dataType, _INTEGRAL):
        column = column.cast("bigint")
    hashed = F.pmod(F.xxhash64(column), F.lit(bitmaps * BITMAP_BITS))
    return F.floor(hashed / BITMAP_BITS).cast("bigint"), F.pmod(hashed, F.lit(BITMAP_BITS)).cast("int")


def _same_kind(a: T.DataType, b: T.DataType) -> bool:
    return a == b or (isinstance(a, _INTEGRAL) and isinstance(b, _INTEGRAL))
