"""Rice partitions by interchangeable kernels, which must give the same values and leave the cursor at the same bit.

``cursor`` reads code by code. ``table`` finds, for every bit of a window at once, where a code that
begins there ends, follows the chain of ends, and takes quotients and remainders as arrays.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from strandline.sources.bitio import Bits, Short

#: Folded values from this on are refused.
MOST = 0xFFFFFFFF


class RiceError(ValueError):
    pass


def cursor(b: Bits, n: int, k: int) -> list[int]:
    out = []
    for _ in range(n):
        q = b.unary()
        v = q << k | (b.read(k) if k else 0)
        if v >= MOST:
            raise RiceError("a residual out of range")
        out.append(v >> 1 ^ -(v & 1))
    return out


def table(b: Bits, n: int, k: int) -> list[int]:
    if not n:
        return []
    starts = np.empty(n, np.int64)
    done, width = 0, max(1024, n * (k + 4))
    while True:
        first = b.at >> 3
        last = min(b.end >> 3, (b.at + width + 7 >> 3) + 1)
        bits = np.unpackbits(np.frombuffer(b.data, np.uint8, last - first, first)) if last > first else np.zeros(0, np.uint8)
        size = len(bits)
        at = np.where(bits == 1, np.arange(size), size)
        one = np.minimum.accumulate(at[::-1])[::-1] if size else at
        chain, p = (one + 1 + k).tolist(), b.at - 8 * first
        done = 0
        while done < n and p < size:
            starts[done] = p
            p = chain[p]
            done += 1
        if done == n and p <= size:
            break
        if last >= b.end >> 3:
            raise Short("a Rice partition without an end")
        width *= 2
    ones = one[starts]
    v = (ones - starts) << k
    for j in range(k):
        v |= bits[ones + 1 + j].astype(np.int64) << (k - 1 - j)
    if (v >= MOST).any():
        raise RiceError("a residual out of range")
    b.at = 8 * first + p
    return (v >> 1 ^ -(v & 1)).tolist()


KERNELS: dict[str, Callable[[Bits, int, int], list[int]]] = {"cursor": cursor, "table": table}
