"""Bit cursors over bytes, most significant bit first."""

from __future__ import annotations


class Short(ValueError):
    """The bytes end before the field does."""


class Bits:
    """Reads fields of any width from one big integer; a slice is a shift and a mask."""

    def __init__(self, data: bytes, at: int = 0, end: int | None = None):
        self.data, self.at = data, at * 8
        self.end = (len(data) if end is None else end) * 8

    def read(self, n: int) -> int:
        a, b = self.at, self.at + n
        if b > self.end:
            raise Short(f"{n} bits wanted at bit {a}, {self.end - a} left")
        self.at = b
        first, last = a >> 3, (b + 7) >> 3
        return (int.from_bytes(self.data[first:last], "big") >> (last * 8 - b)) & ((1 << n) - 1)

    def peek(self, n: int) -> int:
        """The next n bits without consuming them, zeros beyond the end."""
        a, b = self.at, self.at + n
        first, last = a >> 3, (b + 7) >> 3
        raw = self.data[first : min(last, self.end >> 3)]
        return (int.from_bytes(raw, "big") << 8 * (last - first - len(raw)) >> (last * 8 - b)) & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.read(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        """Zeros before the next one, which is consumed too."""
        n, width = 0, 32
        while True:
            width = min(width, self.end - self.at)
            if width <= 0:
                raise Short("a run of zeros without an end")
            v = self.read(width)
            if v:
                zeros = width - v.bit_length()
                self.at -= width - zeros - 1
                return n + zeros
            n += width

    def align(self) -> int:
        skipped = -self.at % 8
        self.at += skipped
        return skipped


class BitWriter:
    """The inverse of Bits."""

    def __init__(self):
        self.value, self.n = 0, 0
        self.done = bytearray()

    def put(self, v: int, n: int) -> None:
        self.value = (self.value << n) | (v & ((1 << n) - 1))
        self.n += n
        if self.n >= 4096:
            keep = self.n % 8
            self.done += (self.value >> keep).to_bytes((self.n - keep) // 8, "big")
            self.value &= (1 << keep) - 1
            self.n = keep

    def unary(self, n: int) -> None:
        while n > 64:
            self.put(0, 64)
            n -= 64
        self.put(1, n + 1)

    def align(self) -> None:
        self.put(0, -self.n % 8)

    def bytes(self) -> bytes:
        pad = -self.n % 8
        return bytes(self.done) + (self.value << pad).to_bytes((self.n + pad) // 8, "big")
