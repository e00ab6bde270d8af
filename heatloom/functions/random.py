"""Counter-based random numbers: a hash of seed and keys, never of the partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

TWO_32 = 4294967296.0


def uniform(seed: int, *keys: Column | str, method: str = "xxhash64") -> Column:
    """Uniform draw in (0, 1) that depends only on the seed and the key values.

    ``xxhash64`` is the fast choice; ``md5`` can be reproduced by other SQL engines.
    """
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    if method == "xxhash64":
        bits = F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 32)).cast("double")
    elif method == "md5":
        text = F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols])
        bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double")
    else:
        raise ValueError(f"unknown method {method!r}")
    return (bits + 0.5) / F.lit(TWO_32)


def normal(seed: int, *keys: Column | str, method: str = "xxhash64", hashes: int = 1) -> Column:
    """Standard normal draw (Box-Muller) with a hash of its own.

    With one hash both uniform numbers come from it, with two each has one of its own.
    """
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    if hashes == 2:
        u1, u2 = (uniform(seed, *cols, F.lit(x), method=method) for x in "ab")
        return F.sqrt(-2.0 * F.log(u1)) * F.cos(u2 * F.lit(2.0 * math.pi))
    if method == "xxhash64":
        bits = F.xxhash64(F.lit(seed), *cols)
        parts = [F.shiftrightunsigned(bits, 32), bits.bitwiseAND(F.lit(0xFFFFFFFF))]
    elif method == "md5":
        text = F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]).cast("binary"))
        parts = [F.conv(F.substring(text, i, 8), 16, 10) for i in (1, 9)]
    else:
        raise ValueError(f"unknown method {method!r}")
    u1, u2 = ((x.cast("double") + 0.5) / F.lit(TWO_32) for x in parts)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(u2 * F.lit(2.0 * math.pi))


def normals(n: int, seed: int, *keys: Column | str, method: str = "xxhash64") -> list[Column]:
    """``n`` independent standard normal draws (Box-Muller); the first of them do not depend on ``n``.

    Two uniform numbers give two draws, by cosine and sine; one ``xxhash64`` gives two
    numbers, one ``md5`` gives four.  The number of the hash is its last key.
    """
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    out: list[Column] = []
    while len(out) < n:
        if method == "xxhash64":
            bits = F.xxhash64(F.lit(seed), *cols, F.lit(len(out) // 2))
            parts = [F.shiftrightunsigned(bits, 32), bits.bitwiseAND(F.lit(0xFFFFFFFF))]
        elif method == "md5":
            text = F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols], F.lit(str(len(out) // 4)))
            parts = [F.conv(F.substring(F.md5(text.cast("binary")), i, 8), 16, 10) for i in (1, 9, 17, 25)]
        else:
            raise ValueError(f"unknown method {method!r}")
        u = [(x.cast("double") + 0.5) / F.lit(TWO_32) for x in parts]
        for u1, u2 in zip(u[::2], u[1::2]):
            radius, angle = F.sqrt(-2.0 * F.log(u1)), u2 * F.lit(2.0 * math.pi)
            out += [radius * F.cos(angle), radius * F.sin(angle)]
    return out[:n]


def triangular(u: Column, lo: Column, mode: Column, hi: Column) -> Column:
    """Inverse distribution function of the triangular distribution; the mode where lo = hi."""
    span = hi - lo
    left = lo + F.sqrt(u * span * (mode - lo))
    right = hi - F.sqrt((1.0 - u) * span * (hi - mode))
    return F.when(span <= 0, mode).when(u * span < mode - lo, left).otherwise(right)
