"""Arithmetic of GF(256) as numpy tables, built from the primitive polynomial."""

from __future__ import annotations

import numpy as np

from ..constants import GF_PRIM


def _tables() -> tuple[np.ndarray, np.ndarray]:
    exp, log, x = np.zeros(510, np.int64), np.zeros(256, np.int64), 1
    for i in range(255):
        exp[i], log[x] = x, i
        x = (x << 1) ^ (GF_PRIM if x & 0x80 else 0)
    exp[255:] = exp[:255]
    return exp, log


EXP, LOG = _tables()


def _products() -> np.ndarray:
    a, b = np.indices((256, 256))
    return np.where((a == 0) | (b == 0), 0, EXP[LOG[a] + LOG[b]])


PRODUCT = _products()
#: The same in an eighth of the memory, which a core's cache holds.
NARROW = PRODUCT.astype(np.uint8)


def mul(a, b) -> np.ndarray:
    return PRODUCT[a, b]


def inverse(a) -> np.ndarray:
    return EXP[255 - LOG[np.asarray(a, np.int64)]]


def poly_mul(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Product of polynomials, lowest degree first."""
    out = np.zeros(len(p) + len(q) - 1, np.int64)
    for i, c in enumerate(p):
        if c:
            out[i : i + len(q)] ^= mul(c, q)
    return out


def poly_at(p: np.ndarray, x) -> np.ndarray:
    """Values at the points x (none of them zero), lowest degree first: all powers at once, then one XOR."""
    powers = EXP[LOG[np.asarray(x, np.int64)][:, None] * np.arange(len(p))[None, :] % 255]
    return np.bitwise_xor.reduce(PRODUCT[powers, p[None, :]], axis=1)


def generator(nsym: int) -> np.ndarray:
    """(x - a^0) ... (x - a^(nsym-1)), lowest degree first."""
    g = np.array([1], np.int64)
    for i in range(nsym):
        g = poly_mul(g, np.array([EXP[i], 1]))
    return g


def remainders(nsym: int, degrees: int) -> np.ndarray:
    """(degrees, nsym): row d holds the parity symbols, highest degree first, of a one at degree nsym + d."""
    g = generator(nsym)[:nsym][::-1]
    out = np.zeros((degrees, nsym), np.int64)
    row = g.copy()
    for d in range(degrees):
        out[d] = row
        row = np.append(row[1:], 0) ^ mul(row[0], g)
    return out
