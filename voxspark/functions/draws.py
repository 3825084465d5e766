"""Keyed draws: random numbers that depend on a seed and keys, never on partitioning."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, tag: str | Column, *keys: Column | str) -> Column:
    """A number in [0, 1) for each key: 48 bits of an MD5 digest."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(tag) if isinstance(tag, str) else tag, *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def normal(seed: int, tag: str, *keys: Column | str) -> Column:
    """A standard normal number for each key (Box-Muller)."""
    radius = F.sqrt(-2 * F.log(1 - uniform(seed, tag + ".r", *keys)))
    return radius * F.cos(2 * math.pi * uniform(seed, tag + ".a", *keys))


def uniform_sql(seed: int, tag: str, *keys: str) -> str:
    """:func:`uniform` in DuckDB SQL."""
    parts = ", ".join([f"'{seed}'", f"'{tag}'", *[f"({k})::VARCHAR" for k in keys]])
    return f"(('0x' || substr(md5(concat_ws(':', {parts})), 1, 12))::BIGINT / {float(1 << 48)})"


def normal_sql(seed: int, tag: str, *keys: str) -> str:
    """:func:`normal` in DuckDB SQL."""
    return f"(sqrt(-2 * ln(1 - {uniform_sql(seed, tag + '.r', *keys)})) * cos(2 * pi() * {uniform_sql(seed, tag + '.a', *keys)}))"


PROPOSALS = 10  # of a gamma draw; each is taken with a chance of 0.95 at least


def _shape(alpha: float) -> tuple[float, float]:
    if alpha <= 0:
        raise ValueError("a gamma draw needs a shape above 0")
    d = (alpha if alpha >= 1 else alpha + 1) - 1 / 3
    return d, 1 / math.sqrt(9 * d)


def gamma(alpha: float, seed: int, tag: str, *keys: Column | str) -> Column:
    """A gamma number of shape ``alpha`` (scale 1) for each key, by rejection.

    A cubed normal is proposed up to ``PROPOSALS`` times (after all of them, once in
    10**13 draws, the mode stands in); shapes below 1 are drawn one higher and
    multiplied by a power of a uniform.
    """
    d, c = _shape(alpha)
    out = F.lit(d)
    for k in reversed(range(PROPOSALS)):
        x, u = normal(seed, f"{tag}.{k}", *keys), uniform(seed, f"{tag}.{k}.u", *keys)
        out = F.transform(F.array(F.struct(x.alias("x"), F.pow(1 + c * x, F.lit(3)).alias("v"), F.log(1 - u).alias("u"))), _taken(d, out))[0]
    return out if alpha >= 1 else out * F.pow(1 - uniform(seed, f"{tag}.p", *keys), F.lit(1 / alpha))


def _taken(d: float, rest: Column) -> Callable[[Column], Column]:
    """The proposal where it is taken, else what the proposals after it give."""
    return lambda p: F.when((p["v"] > 0) & (p["u"] < p["x"] * p["x"] / 2 + d - d * p["v"] + d * F.log(F.when(p["v"] > 0, p["v"]).otherwise(1.0))), d * p["v"]).otherwise(rest)


def gamma_sql(alpha: float, seed: int, tag: str, *keys: str) -> str:
    """:func:`gamma` in DuckDB SQL."""
    d, c = _shape(alpha)
    parts = []
    for k in range(PROPOSALS):
        x, u = normal_sql(seed, f"{tag}.{k}", *keys), uniform_sql(seed, f"{tag}.{k}.u", *keys)
        v = f"pow(1 + {c!r}::DOUBLE * {x}, 3)"
        parts.append(f"WHEN {v} > 0 AND ln(1 - {u}) < {x} * {x} / 2 + {d!r}::DOUBLE - {d!r}::DOUBLE * {v} + {d!r}::DOUBLE * ln(greatest({v}, 1e-300)) THEN {d!r}::DOUBLE * {v}")
    out = f"(CASE {' '.join(parts)} ELSE {d!r}::DOUBLE END)"
    return out if alpha >= 1 else f"({out} * pow(1 - {uniform_sql(seed, tag + '.p', *keys)}, {1 / alpha!r}::DOUBLE))"
