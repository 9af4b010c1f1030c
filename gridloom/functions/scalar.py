"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_MASK32 = 0xFFFFFFFF


def times32(a: Column, k: int) -> Column:
    """Product modulo 2**32 of a column (below 2**32) and a constant, which is taken signed so that nothing overflows."""
    return (a * F.lit(k - (1 << 32) if k >> 31 else k).cast("long")).bitwiseAND(F.lit(_MASK32))


#: Multipliers of the lattice hash, for x, y, z and seed; its shifts, and the multipliers between them.
LATTICE = (73856093, 19349663, 83492791, 2654435761)
SHIFTS = (16, 15, 16)
MIXERS = (0x7FEB352D, 0x846CA68B)


def lattice_noise(z: Column, y: Column, x: Column, seed: int | Column = 0) -> Column:
    """A number from 0 to 1 for a lattice point: an avalanche hash of 32 bits."""
    whole = lambda c: c.cast("long").bitwiseAND(F.lit(_MASK32))
    own = F.lit(seed * LATTICE[3] & _MASK32).cast("long") if isinstance(seed, int) else times32(whole(seed), LATTICE[3])
    h = own
    for c, k in zip((x, y, z), LATTICE, strict=False):
        h = h.bitwiseXOR(times32(whole(c), k))
    for shift, k in zip(SHIFTS, (*MIXERS, 1), strict=True):
        h = h.bitwiseXOR(F.shiftright(h, shift))
        h = times32(h, k) if k != 1 else h
    return h / F.lit(float(1 << 32))


def tent(i: Column, start: Column, stop: Column, overlap: int) -> Column:
    """A block's weight on one axis: 1 inside its own chunk, falling over the overlap outside it."""
    out = F.greatest(start - i, i - (stop - 1), F.lit(0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - out / F.lit(overlap + 1.0)))


def ramp(i: Column, start: Column, stop: Column) -> Column:
    """A block's weight on one axis: from its faces to its middle."""
    n = stop - start
    return F.least(i - start + 0.5, stop - i - 0.5) / (n / 2)


def half_cosine(distance: Column, band: float) -> Column:
    """From 0 at a face to 1 at ``band`` inside."""
    d = F.greatest(F.lit(0.0), F.least(F.lit(float(band)), distance))
    return F.lit(0.5) - F.lit(0.5) * F.cos(d * F.lit(3.141592653589793 / band))


def morton(coords: list[Column], bits: int) -> Column:
    """Z-order: the coordinates' bits interleaved, the last coordinate's lowest."""
    out = F.lit(0).cast("long")
    n = len(coords)
    for b in range(bits):
        for k, c in enumerate(reversed(coords)):
            bit = F.shiftright(c.cast("long"), b).bitwiseAND(F.lit(1).cast("long"))
            out = out.bitwiseOR(F.shiftleft(bit, b * n + k))
    return out


def compressed_morton(coords: list[Column], shape: tuple[int, ...]) -> Column:
    """Z-order in which an axis gives no more bits than its extent needs."""
    out, place = F.lit(0).cast("long"), 0
    needed = [max(0, (n - 1).bit_length()) for n in shape]
    for b in range(max(needed, default=0)):
        for c, n in zip(reversed(coords), reversed(needed), strict=True):
            if b < n:
                bit = F.shiftright(c.cast("long"), b).bitwiseAND(F.lit(1).cast("long"))
                out, place = out.bitwiseOR(F.shiftleft(bit, place)), place + 1
    return out
