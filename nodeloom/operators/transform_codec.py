"""An error-bounded codec of elements: blocks of 4 x 4 x 4 values, an integer
transform by lifting, bit planes from the highest on.

A block's values become whole numbers beside its largest exponent. Along each axis
four numbers turn into a sum and three differences, by steps that can be undone
without loss, so that smooth blocks have few large numbers. Their planes of bits
are written from the highest on: a fixed number of planes is a fixed rate; for a
fixed accuracy there are as many as keep every value within the tolerance, which
is tried on the block itself. Whole batches of blocks are coded together."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SIDE, BITS = 4, 40  #: of a block; of its whole numbers, without what the transform adds
TOP = BITS + 7  #: planes of a transformed block: three axes add two bits each, signs one


def _pair(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Floor of the mean, and difference."""
    d = a - b
    return b + (d >> 1), d


def _unpair(s: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    b = s - (d >> 1)
    return b + d, b


def forward(q: np.ndarray) -> np.ndarray:
    """Blocks (count, 4, 4, 4) of whole numbers: sums and differences along each axis."""
    for axis in (1, 2, 3):
        x = np.moveaxis(q, axis, -1)
        (s0, d0), (s1, d1) = _pair(x[..., 0], x[..., 1]), _pair(x[..., 2], x[..., 3])
        s, d = _pair(s0, s1)
        q = np.moveaxis(np.stack([s, d, d0, d1], axis=-1), -1, axis)
    return q


def inverse(c: np.ndarray) -> np.ndarray:
    for axis in (3, 2, 1):
        x = np.moveaxis(c, axis, -1)
        s0, s1 = _unpair(x[..., 0], x[..., 1])
        (a, b), (e, f) = _unpair(s0, x[..., 2]), _unpair(s1, x[..., 3])
        c = np.moveaxis(np.stack([a, b, e, f], axis=-1), -1, axis)
    return c


def _blocks(u: np.ndarray, n: int) -> np.ndarray:
    """Elements (count, n^3) as blocks (count * parts^3, 4, 4, 4); the last value of a row goes on where a block is not full."""
    parts = -(-n // SIDE)
    x = np.pad(u.reshape(-1, n, n, n), [(0, 0)] + [(0, parts * SIDE - n)] * 3, mode="edge")
    x = x.reshape(len(u), parts, SIDE, parts, SIDE, parts, SIDE).transpose(0, 1, 3, 5, 2, 4, 6)
    return x.reshape(-1, SIDE, SIDE, SIDE)


def _elements(b: np.ndarray, n: int) -> np.ndarray:
    parts = -(-n // SIDE)
    x = b.reshape(-1, parts, parts, parts, SIDE, SIDE, SIDE).transpose(0, 1, 4, 2, 5, 3, 6)
    return x.reshape(-1, parts * SIDE, parts * SIDE, parts * SIDE)[:, :n, :n, :n].reshape(len(x), -1)


def _whole(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponents of blocks (of their largest value; the least for empty ones), and their whole numbers."""
    top = np.abs(b).max(axis=(1, 2, 3))
    exponent = np.where(top > 0, np.frexp(top)[1], -1000).astype(np.int32)
    return exponent, np.rint(np.ldexp(b, (BITS - 1 - exponent)[:, None, None, None])).astype(np.int64)


def _cut(c: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Numbers of which only the highest planes are left, towards zero and half a step up."""
    drop = np.maximum(TOP - planes, 0)[:, None, None, None]
    size = np.abs(c) >> drop << drop
    return np.sign(c) * np.where((size > 0) & (drop > 0), size + (np.int64(1) << np.maximum(drop - 1, 0)), size)


def decoded(exponent: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.ldexp(inverse(c).astype(float), (exponent - (BITS - 1))[:, None, None, None])


def planes_for(b: np.ndarray, tolerance: float) -> np.ndarray:
    """The fewest planes with which every value of a block is within tolerance. The
    error need not fall with each plane, so all numbers of planes are tried; a
    block that no number of planes keeps within it has -1."""
    exponent, q = _whole(b)
    c = forward(q)
    found = np.full(len(b), -1)
    for p in range(TOP + 1):
        open_ = np.flatnonzero(found < 0)
        if not len(open_):
            break
        some = decoded(exponent[open_], _cut(c[open_], np.full(len(open_), p)))
        found[open_[np.abs(some - b[open_]).max(axis=(1, 2, 3)) <= tolerance]] = p
    return found


def encode(u: np.ndarray, n: int, tolerance: float | None = None, planes: int | None = None) -> list[bytes]:
    """A payload per element. Block by block: number of planes, exponent, signs
    (where there are planes), planes from the highest on; blocks that no planes
    keep within the tolerance have their values instead."""
    if not len(u):
        return []
    b = _blocks(u, n)
    exponent, q = _whole(b)
    c = forward(q)
    many = planes_for(b, tolerance) if tolerance is not None else np.full(len(b), planes)
    size = np.abs(c).reshape(len(b), -1).astype(np.uint64)
    signs = np.packbits(c.reshape(len(b), -1) < 0, axis=1)
    bits = [np.packbits((size >> np.uint64(TOP - 1 - p)) & np.uint64(1) > 0, axis=1) for p in range(int(max(many.max(initial=0), 0)))]
    per, out = len(b) // max(1, len(u)), []
    for e in range(len(u)):
        parts = []
        for k in range(e * per, (e + 1) * per):
            m = int(many[k])
            if m < 0:
                parts.append(struct.pack("<Bh", 255, 0) + b[k].astype("<f8").tobytes())
            else:
                parts.append(struct.pack("<Bh", m, int(exponent[k])) + (signs[k].tobytes() if m else b"") + b"".join(bits[p][k].tobytes() for p in range(m)))
        out.append(b"".join(parts))
    return out


def decode(payloads: list[bytes], n: int) -> np.ndarray:
    """Elements of payloads."""
    values, width = SIDE**3, SIDE**3 // 8
    kept, exponents, numbers, raw = [], [], [], {}
    for data in payloads:
        at = 0
        while at < len(data):
            m, exponent = struct.unpack_from("<Bh", data, at)
            at += 3
            if m == 255:
                raw[len(kept)] = np.frombuffer(data, "<f8", values, at).reshape(SIDE, SIDE, SIDE)
                at, m, c = at + 8 * values, 0, np.zeros(values, np.int64)
            elif m:
                sign = np.unpackbits(np.frombuffer(data, np.uint8, width, at)).astype(np.int64)
                plane = np.unpackbits(np.frombuffer(data, np.uint8, width * m, at + width).reshape(m, width), axis=1).astype(np.int64)
                c = (plane << (TOP - 1 - np.arange(m))[:, None]).sum(axis=0) * (1 - 2 * sign)
                at += width * (m + 1)
            else:
                c = np.zeros(values, np.int64)
            kept.append(m)
            exponents.append(exponent)
            numbers.append(c.reshape(SIDE, SIDE, SIDE))
    if not kept:
        return np.zeros((0, n**3))
    b = decoded(np.array(exponents), _cut(np.stack(numbers), np.array(kept)))
    for k, v in raw.items():
        b[k] = v
    return _elements(b, n)


def packed(column: str, n: int, tolerance: float | None = None, planes: int | None = None) -> Column:
    """Payloads of arrays of n^3 values: of fixed accuracy (tolerance) or of a fixed number of planes."""

    @F.pandas_udf("binary")
    def run(u: pd.Series) -> pd.Series:
        return pd.Series(encode(np.stack([np.asarray(v, float) for v in u]), n, tolerance, planes) if len(u) else [], dtype=object)

    return run(column)


def unpacked(column: str, n: int) -> Column:
    @F.pandas_udf("array<double>")
    def run(p: pd.Series) -> pd.Series:
        return pd.Series(list(decode(list(p), n)), dtype=object)

    return run(column)
