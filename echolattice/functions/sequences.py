"""Column functions over a sequence of frames: array<array<double>>, rows in time order, 12 pitch classes on a circle.

All of them are expressions of the JVM's own array functions, so that they run inside a scan's or a join's stage.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PITCHES = 12
#: Norms up to this count as silence.
SILENT = 1e-9
#: Frames a second of the native rate.
NATIVE_RATE = 44100 / 512


def _zero() -> Column:
    return F.lit(0.0)


def let(value: Column, body) -> Column:
    """body(value), with value worked out once: inside another function's lambda it would be, anew, for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(v: Column) -> Column:
    return F.aggregate(v, _zero(), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column, kind: str) -> Column:
    """max is the greatest value, not the greatest magnitude."""
    kinds = {"max": F.array_max, "l2": lambda x: F.sqrt(dot(x, x)), "l1": lambda x: total(F.transform(x, F.abs))}
    if kind not in kinds:
        raise ValueError(f"unknown normalisation {kind!r}: none, {', '.join(kinds)}")
    return kinds[kind](v)


def normalize_frames(frames: Column, kind: str = "max") -> Column:
    """Each frame divided by its norm; silent frames are zeros."""
    if kind == "none":
        return frames
    norm(F.array(), kind)

    def one(v: Column) -> Column:
        return let(norm(v, kind), lambda n: F.transform(v, lambda x: F.when(n > SILENT, x / n).otherwise(0.0)))

    return F.transform(frames, one)


def l2_normalize(v: Column) -> Column:
    """A zero vector stays zero."""
    return let(v, lambda w: let(F.greatest(F.sqrt(dot(w, w)), F.lit(SILENT)), lambda n: F.transform(w, lambda x: x / n)))


def rate_factor(source: float, target: float) -> int:
    """Frames of a block that bring one rate near another; halves go to the even number."""
    return max(int(round(source / target)), 1)


def _pitchwise(block: Column, how: str) -> Column:
    def one(p: Column) -> Column:
        v = F.transform(block, lambda f: F.get(f, p))
        if how == "mean":
            return total(v) / F.size(block)
        if how == "max":
            return F.array_max(v)
        low, high = F.floor((F.size(block) - 1) / 2).cast("int"), F.floor(F.size(block) / 2).cast("int")
        return let(F.sort_array(v), lambda s: (F.get(s, low) + F.get(s, high)) / 2)

    return F.transform(F.sequence(F.lit(0), F.lit(PITCHES - 1)), one)


def downsample(frames: Column, factor: int, how: str = "mean") -> Column:
    """Blocks of so many frames, the partial one at the end left out; fewer frames than a block give one frame, their mean."""
    if how not in ("mean", "median", "max"):
        raise KeyError(how)
    if factor <= 1:
        return frames

    def run(x: Column) -> Column:
        blocks = F.floor(F.size(x) / factor).cast("int")
        full = F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: let(F.slice(x, b * factor + 1, F.lit(factor)), lambda block: _pitchwise(block, how)))
        return F.when(blocks >= 1, full).otherwise(F.array(_pitchwise(x, "mean")))

    return let(frames, run)


def roll(v: Column, steps: int | Column) -> Column:
    """A frame rolled up by so many pitches."""
    return let(v, lambda w: F.transform(F.sequence(F.lit(0), F.lit(PITCHES - 1)), lambda i: F.get(w, F.pmod(i - steps, F.lit(PITCHES)).cast("int"))))


def transpose(frames: Column, steps: int | Column) -> Column:
    return F.transform(frames, lambda f: roll(f, steps))


def profile(frames: Column) -> Column:
    """Mean frame, of length 1 unless it is silent."""
    unit = lambda mean: let(F.sqrt(dot(mean, mean)), lambda n: F.transform(mean, lambda x: F.when(n > SILENT, x / n).otherwise(x)))
    return let(let(frames, lambda x: _pitchwise(x, "mean")), unit)


def optimal_transposition(a: Column, b: Column) -> Column:
    """Steps that bring profile b nearest to profile a; of equals, the fewest. Scores are compared at 9 decimals."""
    circle = F.sequence(F.lit(0), F.lit(PITCHES - 1))

    def fit(x: Column, y: Column) -> Column:
        scores = F.transform(circle, lambda s: F.round(dot(x, F.transform(circle, lambda i: F.get(y, F.pmod(i - s, F.lit(PITCHES)).cast("int")))), 9))
        return let(scores, lambda v: F.array_position(v, F.array_max(v)).cast("int") - 1)

    return let(a, lambda x: let(b, lambda y: fit(x, y)))


def patch_starts(n: Column, length: int, hop: int) -> Column:
    """First frames of the patches; a sequence shorter than a patch has one, to be filled up with silence."""
    return F.when(n <= length, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - length, F.lit(hop)))


def patches(frames: Column, length: int, hop: int) -> Column:
    """Patches of frames every hop; a tail that no whole patch covers is left out."""
    silence = F.array_repeat(F.array_repeat(_zero(), PITCHES), length)

    def run(x: Column) -> Column:
        whole = F.transform(patch_starts(F.size(x), length, hop), lambda s: F.slice(x, s + 1, F.lit(length)))
        return F.when(F.size(x) < length, F.array(F.slice(F.concat(x, silence), 1, length))).otherwise(whole)

    return let(frames, run)


def delay_embed(frames: Column, m: int = 9, tau: int = 1) -> Column:
    """States of m frames tau apart, one after the other; fewer frames than a state needs is an error."""

    def run(x: Column) -> Column:
        n = F.size(x) - (m - 1) * tau
        states = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda k: F.get(x, i + k * tau))))
        short = F.raise_error(F.concat(F.lit("too short to embed: "), F.size(x).cast("string"), F.lit(" frames"))).cast("array<array<double>>")
        return F.when(n >= 1, states).otherwise(short)

    return let(frames, run)


def resample(frames: Column, start: int | Column, crop: int | Column, width: int) -> Column:
    """width frames from crop ones by nearest index over an even spacing, halves to the even index."""
    last = F.lit(crop) - 1 if isinstance(crop, int) else crop - 1
    pick = lambda i: (F.lit(start) if isinstance(start, int) else start) + F.bround(i * last / max(width - 1, 1), 0).cast("int")
    return let(frames, lambda x: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.get(x, pick(i).cast("int"))))


def md5_key(*parts: Column) -> Column:
    """A reproducible order key: 32 bits of the MD5 of the parts joined by colons, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("long")


def is_finite(d: Column) -> Column:
    return ~F.isnan(d) & (F.abs(d) != math.inf)


def rank_key(d: Column) -> Column:
    """The distance to rank by: whatever isn't finite goes to the end, in item order."""
    return F.when(is_finite(d), d).otherwise(math.inf)
