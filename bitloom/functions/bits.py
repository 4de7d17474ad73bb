"""Bit hashes as columns: packing, weighted counts and the masks that the metrics need.

A hash is an array<boolean>; its packed form is an array<long> of 64-bit words, bit i of word
w being hash[64 w + i]. Counts on words stay inside whole-stage code generation, and a
weighted count is a short sum of plain counts, one for each distinct weight.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

WORD = 64
#: Distinct weights up to which a weighted count is a sum of masked counts.
DISTINCT = 16


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def words_of(n_bits: int) -> int:
    return -(-n_bits // WORD)


def pack(h: Column, n_bits: int) -> Column:
    """array<boolean> to array<long>. A fold, as an expression for each bit would outgrow a generated method."""
    return F.array(*(_pack_word(h, at, min(n_bits - at, WORD)) for at in range(0, n_bits, WORD)))


def _pack_word(h: Column, at: int, size: int) -> Column:
    powers, zero = F.expr("array(" + ", ".join(f"{signed(1 << i)}L" for i in range(size)) + ")"), F.lit(0).cast("long")
    return F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), zero, lambda acc, i: acc.bitwiseOR(F.when(F.get(h, i + at), F.get(powers, i)).otherwise(zero)))


def bit_string(h: Column) -> Column:
    """array<boolean> to "0101..."."""
    return F.array_join(F.transform(h, lambda x: F.when(x, F.lit("1")).otherwise(F.lit("0"))), "")


def from_bit_string(s: Column) -> Column:
    """"0101..." to array<boolean>; only "1" is true."""
    return F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: c == "1")


def words_mask(bits: Sequence[int], n_bits: int) -> list[int]:
    """Packed words with the given bits set."""
    out = [0] * words_of(n_bits)
    for i in bits:
        out[i // WORD] |= 1 << (i % WORD)
    return [signed(w) for w in out]


def count(words: Sequence[Column], mask: Sequence[int] | None = None) -> Column:
    """Set bits of the words, those of mask only if it is given."""
    parts = []
    for i, w in enumerate(words):
        if mask is None:
            parts.append(F.bit_count(w))
        elif mask[i]:
            parts.append(F.bit_count(w.bitwiseAND(F.lit(mask[i]).cast("long"))))
    return reduce(lambda a, b: a + b, parts) if parts else F.lit(0)


def weighted(words: Sequence[Column], weights: Sequence[float]) -> Column:
    """Sum of the weights of the set bits."""
    groups: dict[float, list[int]] = {}
    for i, w in enumerate(weights):
        groups.setdefault(float(w), []).append(i)
    if len(groups) > DISTINCT:
        return _by_bytes(words, weights)
    terms = [F.lit(w) * count(words, words_mask(bits, len(weights))) for w, bits in sorted(groups.items()) if w]
    return reduce(lambda a, b: a + b, terms) if terms else F.lit(0.0)


def _by_bytes(words: Sequence[Column], weights: Sequence[float]) -> Column:
    """As weighted, by one literal table of 256 sums for each byte: for weights that are nearly all distinct."""
    terms = []
    for start in range(0, len(weights), 8):
        own = [float(w) for w in weights[start : start + 8]]
        # One parsed literal: a call for each of its elements would cost more than the query.
        table = F.expr("array(" + ", ".join(f"{math.fsum(w for i, w in enumerate(own) if b >> i & 1)!r}D" for b in range(1 << len(own))) + ")")
        byte = F.shiftrightunsigned(words[start // WORD], start % WORD).bitwiseAND(F.lit((1 << len(own)) - 1).cast("long"))
        terms.append(F.get(table, byte.cast("int")))
    return reduce(lambda a, b: a + b, terms)


def side_of(n_bits: int) -> int:
    """Side of the square that a hash of n_bits fills; an error if it fills none."""
    s = math.isqrt(n_bits)
    if s * s != n_bits:
        raise ValueError(f"a hash of {n_bits} bits is not square; pad it to a square number first")
    return s


def window_coverage(n_bits: int, n: int) -> list[float]:
    """How many n x n windows inside the square hold each cell."""
    s = side_of(n_bits)
    if not 1 <= n <= s:
        raise ValueError(f"windows of side {n} do not fit a square of side {s}")
    line = [min(i + 1, n, s - i, s - n + 1) for i in range(s)]
    return [float(a * b) for a in line for b in line]


def filter_mass(n_bits: int, kernel: Sequence[Sequence[float]]) -> list[float]:
    """For each cell the sum of the kernel over the positions at which a zero-padded convolution meets it.

    An even kernel is anchored right of its middle (cell k // 2).
    """
    s, kh, kw = side_of(n_bits), len(kernel), len(kernel[0])
    out = []
    for y in range(s):
        for x in range(s):
            out.append(float(sum(kernel[a][b] for a in range(kh) for b in range(kw) if 0 <= y + a - kh // 2 < s and 0 <= x + b - kw // 2 < s)))
    return out


def line_masks(n_bits: int) -> dict[str, list[list[int]]]:
    """Bits of each even and odd row and column: keys "er", "or", "ec", "oc"."""
    s = side_of(n_bits)
    rows = [[y * s + x for x in range(s)] for y in range(s)]
    cols = [[y * s + x for y in range(s)] for x in range(s)]
    return {"er": rows[::2], "or": rows[1::2], "ec": cols[::2], "oc": cols[1::2]}


Apply = Callable[[Sequence[Column], Sequence[Column]], Column]
