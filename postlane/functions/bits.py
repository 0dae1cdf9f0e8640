"""Bit-level column expressions on non-negative bigint values.

Fields are laid out least significant bit first in 32-bit words; all
arithmetic is 64-bit, so values up to 2^32 - 1 and widths up to 32 are exact.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the compressed list format.
WORD_BITS = 32
LENGTH_BITS = 32
WIDTH_BITS = 6
HEADER_BITS = LENGTH_BITS + WIDTH_BITS
WORD_MASK = 0xFFFFFFFF


def bit_width(value: Column) -> Column:
    """Number of bits that `value` needs; 0 for 0. Exact, unlike a rounded logarithm."""
    return F.when(value == 0, F.lit(0)).otherwise(F.length(F.bin(value.cast("bigint")))).cast("int")


def list_bits(n: Column, width: Column) -> Column:
    """Bits of one compressed list, its header included."""
    return (F.lit(HEADER_BITS) + width.cast("bigint") * n).cast("bigint")


def words_for(bits: Column) -> Column:
    return F.shiftright(bits + (WORD_BITS - 1), 5)


def word_index(bit: Column) -> Column:
    return F.shiftright(bit, 5)


def bit_offset(bit: Column) -> Column:
    return bit.bitwiseAND(F.lit(WORD_BITS - 1).cast("bigint")).cast("int")


def field_parts(bit: Column, value: Column) -> Column:
    """array<struct<k, part>>: what a field of at most 32 bits adds to the word it starts in and to the next."""
    k, shift = word_index(bit), bit_offset(bit)
    low = F.call_function("shiftleft", value, shift).bitwiseAND(F.lit(WORD_MASK))
    high = F.call_function("shiftrightunsigned", value, F.lit(WORD_BITS) - shift)
    return F.array(F.struct(k.alias("k"), low.alias("part")), F.struct((k + 1).alias("k"), high.alias("part")))


def read_field(words: Column, bit: Column, width: Column) -> Column:
    """The `width` (0 to 32) bits at `bit` of an array of words; words past the end read as 0."""
    k, shift = word_index(bit).cast("int"), bit_offset(bit)
    word = lambda i: F.coalesce(F.get(words, i), F.lit(0).cast("bigint"))
    # Two words make 64 bits; the unsigned shift keeps the top bit, as shift + width is 63 at most.
    pair = word(k).bitwiseOR(F.shiftleft(word(k + 1), 32))
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), width) - 1
    return F.call_function("shiftrightunsigned", pair, shift).bitwiseAND(mask)
