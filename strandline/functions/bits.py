"""Bit and integer expressions on LONG columns. Right shifts are arithmetic: they floor."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def field(word, offset: int, bits: int) -> Column:
    """bits of a 32-bit word from offset on, counted from its most significant bit. Serves reads and peeks."""
    return F.shiftright(_c(word), 32 - offset - bits).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def sign_extend(raw, bits: int) -> Column:
    return F.shiftright(F.shiftleft(_c(raw), 64 - bits), 64 - bits)


def padding(bit_position) -> Column:
    """Bits to the next byte border."""
    return F.pmod(8 - _c(bit_position) % 8, F.lit(8))


def reverse32(word) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(_c(word)), 32, "0")), 2, 10).cast("long")


def wrap32(x) -> Column:
    """Two's-complement 32-bit wrap of a LONG."""
    return (_c(x) + 2147483648).bitwiseAND(F.lit(4294967295)) - 2147483648


def zigzag(n) -> Column:
    return F.when(_c(n) >= 0, 2 * _c(n)).otherwise(-2 * _c(n) - 1)


def unzigzag(n) -> Column:
    return F.shiftright(_c(n), 1).bitwiseXOR(-(_c(n).bitwiseAND(F.lit(1).cast("long"))))


def golomb_bits(v, k: int) -> Column:
    """Length of the exponential-Golomb code of order k."""
    return 2 * F.length(F.bin(F.shiftright(_c(v), k) + 1)) - 1 + k


def golomb_code(v, k: int) -> Column:
    """The code itself as a string of 0 and 1."""
    high = F.bin(F.shiftright(_c(v), k) + 1)
    low = F.lpad(F.bin(_c(v).bitwiseAND(F.lit((1 << k) - 1).cast("long"))), k, "0") if k else F.lit("")
    return F.concat(F.repeat(F.lit("0"), F.length(high) - 1), high, low)


def golomb_value(code, k: int) -> Column:
    """The value of one such code."""
    zeros = F.instr(_c(code), "1") - 1
    high = F.conv(F.substring(_c(code), zeros + 1, zeros + 1), 2, 10).cast("long") - 1
    low = F.conv(F.substring(_c(code), 2 * zeros + 2, F.lit(k)), 2, 10).cast("long") if k else F.lit(0)
    return F.shiftleft(high, k) + low


def lead_octets(byte) -> Column:
    """Octets of a coded number by its lead byte; null for a continuation byte and 0xFF."""
    b = _c(byte)
    out = F.when(b < 0x80, 1)
    for n, top in enumerate((0xE0, 0xF0, 0xF8, 0xFC, 0xFE, 0xFF), 2):
        out = out.when((b >= 0xC0) & (b < top), n)
    return out


def number_octets(value) -> Column:
    """Fewest octets that a coded number takes (up to 36 bits)."""
    v = _c(value)
    out = F.when(v < 0x80, 1)
    for n, bits in enumerate((11, 16, 21, 26, 31, 36), 2):
        out = out.when(v < (1 << bits), n)
    return out


def encode_number(value) -> Column:
    """The extended UTF-8 form as upper-case hex."""
    v, n = _c(value), number_octets(value)
    lead = F.when(n == 1, v)
    for octets, mark in ((2, 0xC0), (3, 0xE0), (4, 0xF0), (5, 0xF8), (6, 0xFC), (7, 0xFE)):
        lead = lead.when(n == octets, F.shiftright(v, 6 * (octets - 1)) + mark)
    parts = [F.lpad(F.hex(lead), 2, "0")]
    for i in range(6):
        tail = F.lpad(F.hex(F.shiftright(v, 6 * (5 - i)).bitwiseAND(F.lit(63).cast("long")) + 128), 2, "0")
        parts.append(F.when(n > 6 - i, tail).otherwise(""))
    return F.concat(*parts)


def decode_number(code) -> Column:
    """The value of a hex form; null unless it is the shortest form of its value."""
    c = _c(code)
    size = F.length(c) / 2
    lead = F.conv(F.substring(c, 1, 2), 16, 10).cast("long")
    n = lead_octets(lead)
    start = F.when(n == 1, lead)
    for octets, mask in ((2, 31), (3, 15), (4, 7), (5, 3), (6, 1), (7, 0)):
        start = start.when(n == octets, lead.bitwiseAND(F.lit(mask).cast("long")))
    tail = F.transform(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda i: F.conv(F.substring(c, 2 * i - 1, F.lit(2)), 16, 10).cast("long"))
    good = F.forall(tail, lambda b: F.shiftright(b, 6) == 2)
    value = F.when(n == 1, start).otherwise(F.when(good, F.aggregate(tail, start, lambda a, b: F.shiftleft(a, 6) + b.bitwiseAND(F.lit(63).cast("long")))))
    return F.when((n == size) & (number_octets(value) == n), value)


def trailing_zeros(x) -> Column:
    """Trailing zero bits of a non-zero LONG, null for 0."""
    b = F.bin(_c(x))
    return F.when(_c(x) != 0, F.length(b) - F.length(F.regexp_replace(b, "0+$", "")))


def fifo_byte(sample) -> Column:
    return F.shiftright(_c(sample), 8).bitwiseAND(F.lit(255).cast("long"))


def fits16(sample) -> Column:
    return _c(sample).between(-32768, 32767)


def scale_byte(sample, gain) -> Column:
    """An 8-bit sample under a gain of 0 to 256, floored."""
    return F.shiftright(_c(sample) * _c(gain), 8)


def fold_float(x) -> Column:
    """A unit float as 16-bit, half rounded up, clamped; NaN is 0."""
    v = F.floor(F.nanvl(_c(x), F.lit(0.0)) * 32768 + 0.5)
    return F.greatest(F.lit(-32768), F.least(F.lit(32767), v)).cast("long")


def fold_down(left, right, how: str = "mix") -> Column:
    """The speaker's mono of a pair: half the sum, floored, or the left side alone."""
    return F.shiftright(_c(left) + _c(right), 1) if how == "mix" else _c(left)


def rgb15(colour) -> Column:
    """0xRRGGBB as 15-bit, red lowest."""
    c = _c(colour)
    r, g, b = (F.shiftright(c, s).bitwiseAND(F.lit(255).cast("long")) for s in (16, 8, 0))
    return F.shiftright(r, 3) + F.shiftleft(F.shiftright(g, 3), 5) + F.shiftleft(F.shiftright(b, 3), 10)


def minutes(seconds) -> Column:
    """Whole minutes by a reciprocal multiplication; exact below 2**20 seconds."""
    return F.shiftright(_c(seconds) * 71582789, 32)


def bar_reciprocal(samples) -> Column:
    return F.floor(F.lit(32 * 4294967296).cast("decimal(20,0)") / _c(samples)).cast("long")


def bar_cell(position, reciprocal) -> Column:
    return F.shiftright(_c(position) * _c(reciprocal), 32)


def between_cycles(start, end) -> Column:
    """Counter difference; a counter that ran backwards gives the sentinel 2**32 - 1."""
    return F.when(_c(end) >= _c(start), _c(end) - _c(start)).otherwise(F.lit(4294967295))


def halfwords(bits) -> Column:
    """16-bit words that hold bits, plus four, made even."""
    h = F.shiftright(_c(bits) + 15, 4) + 4
    return h + h % 2


def band_coefficients(band) -> Column:
    """Coded coefficients of a 16-wide band below the limit of 500."""
    return F.greatest(F.lit(0), F.least(F.lit(16), 500 - 16 * _c(band)))


def largest_magnitude(step) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(65535), F.floor(F.floor(F.lit(1 << 28) / _c(step)) / 16) - 1)).cast("long")


def fixed3(thousandths) -> Column:
    return F.format_string("%d.%03d", F.floor(_c(thousandths) / 1000), _c(thousandths) % 1000)
