"""Array and map functions on vectors, spectrograms, weights and score maps.

Everything is built from higher-order functions, so rows stay on the JVM side.
A value used inside a lambda is bound once with :func:`let`; without it Spark
would evaluate the enclosing expression again for every element.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import as_col, let

# Crop width, slot count, padding caps, mask floor, guards.
CROP_WIDTH = 128
SLOTS = 8
TOKENS = 128
MAX_WIDTH = 256
MASK_FLOOR = -80.0
STD_GUARD = 1e-6
WEIGHT_GUARD = 1e-8


def doubles(arr: Column | str) -> Column:
    return as_col(arr).cast("array<double>")


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def mean(arr: Column) -> Column:
    return total(arr) / F.size(arr)


def std_pop(arr: Column | str) -> Column:
    """Population standard deviation of an array."""
    return let(doubles(arr), lambda a: let(
        F.struct(a.alias("v"), mean(a).alias("m")),
        lambda s: F.sqrt(F.aggregate(
            s["v"], F.lit(0.0), lambda acc, x: acc + (x - s["m"]) * (x - s["m"])
        ) / F.size(s["v"]))))


def _moments(flat: Column) -> Column:
    """struct(v, m, d): the flat array, its mean and its population deviation."""
    return let(F.struct(flat.alias("v"), mean(flat).alias("m")), lambda s: F.struct(
        s["m"].alias("m"),
        F.sqrt(F.aggregate(
            s["v"], F.lit(0.0), lambda acc, x: acc + (x - s["m"]) * (x - s["m"])
        ) / F.size(s["v"])).alias("d")))


def zscore(arr: Column | str) -> Column:
    """Standardise a flat array with its own mean and deviation."""
    return let(doubles(arr), lambda a: let(
        F.struct(a.alias("v"), _moments(a).alias("s")),
        lambda t: F.transform(
            t["v"], lambda x: (x - t["s"]["m"]) / (t["s"]["d"] + F.lit(STD_GUARD)))))


def zscore_bands(bands: Column | str) -> Column:
    """Standardise a band-major 2-D array over all of its cells."""
    return let(as_col(bands).cast("array<array<double>>"), lambda b: let(
        F.struct(b.alias("v"), _moments(F.flatten(b)).alias("s")),
        lambda t: F.transform(t["v"], lambda row: F.transform(
            row, lambda x: (x - t["s"]["m"]) / (t["s"]["d"] + F.lit(STD_GUARD))))))


def _window_or_pad(a: Column, width: int, start: Column, zero: Column) -> Column:
    return (F.when(F.size(a) >= width, F.slice(a, start + 1, width))
            .otherwise(F.concat(a, F.array_repeat(zero, F.lit(width) - F.size(a)))))


def center_crop(arr: Column | str, width: int = CROP_WIDTH) -> Column:
    """Middle ``width`` elements; shorter arrays are padded with zeros on the right."""
    return let(doubles(arr), lambda a: _window_or_pad(
        a, width, F.floor((F.size(a) - width) / 2).cast("int"), F.lit(0.0)))


def center_crop_bands(bands: Column | str, width: int = CROP_WIDTH) -> Column:
    return F.transform(as_col(bands), lambda row: center_crop(row, width))


def draw(key: Column | str, seed: int, slot: int, below: Column) -> Column:
    """Whole number in ``[0, below)`` that depends only on (key, seed, slot 0-3)."""
    digest = F.md5(F.concat_ws(":", as_col(key).cast("string"), F.lit(str(seed))))
    part = F.conv(F.substring(digest, 8 * slot + 1, 8), 16, 10).cast("bigint")
    return F.pmod(part, below.cast("bigint")).cast("int")


def seeded_crop(arr: Column | str, width: int, key: Column | str, seed: int) -> Column:
    """Window of ``width`` elements whose start is drawn uniformly from (key, seed)."""
    return let(F.struct(doubles(arr).alias("v"), as_col(key).cast("string").alias("k")),
               lambda s: _window_or_pad(
                   s["v"], width,
                   draw(s["k"], seed, 0, F.greatest(F.size(s["v"]) - width + 1, F.lit(1))),
                   F.lit(0.0)))


def seeded_crop_bands(bands: Column | str, width: int, key: Column | str, seed: int) -> Column:
    """One seeded window through all bands of a band-major array; short rows are padded."""
    def cut(s: Column) -> Column:
        steps = F.size(F.get(s["b"], F.lit(0)))
        start = draw(s["k"], seed, 0, F.greatest(steps - width + 1, F.lit(1)))
        return let(F.struct(s["b"].alias("b"), start.alias("s")), lambda t: F.transform(
            t["b"], lambda row: _window_or_pad(row, width, t["s"], F.lit(0.0))))

    return let(F.struct(as_col(bands).cast("array<array<double>>").alias("b"),
                        as_col(key).cast("string").alias("k")), cut)


def pad_bands(bands: Column | str, width: Column | int, value: float = 0.0) -> Column:
    """Every band cut or right-padded to ``width``; struct(values, length) as :func:`pad_to`."""
    w = F.lit(width) if isinstance(width, int) else width
    return let(F.struct(as_col(bands).cast("array<array<double>>").alias("b"), w.cast("int").alias("w")),
               lambda s: F.struct(
                   F.transform(s["b"], lambda row: F.slice(F.concat(row, F.array_repeat(
                       F.lit(value), F.greatest(s["w"] - F.size(row), F.lit(0)))), F.lit(1), s["w"])).alias("values"),
                   F.least(F.size(F.get(s["b"], F.lit(0))), s["w"]).alias("length")))


def span_mask(bands: Column | str, key: Column | str, seed: int,
              floor: float = MASK_FLOOR) -> Column:
    """Overwrite one span of bands and one span of time steps with ``floor``."""
    def spans(s: Column) -> Column:
        rows, cols = F.size(s["b"]), F.size(F.get(s["b"], F.lit(0)))
        one = F.lit(1)
        fw = draw(s["k"], seed, 0, F.greatest(one, F.floor(rows / 8)))
        tw = draw(s["k"], seed, 2, F.greatest(one, F.floor(cols / 8)))
        return let(F.struct(s["b"].alias("b"), s["k"].alias("k"), fw.alias("fw"),
                            tw.alias("tw"), rows.alias("r"), cols.alias("c")),
                   lambda u: F.struct(
                       u["b"].alias("b"), u["fw"].alias("fw"), u["tw"].alias("tw"),
                       draw(u["k"], seed, 1, F.greatest(one, u["r"] - u["fw"])).alias("f0"),
                       draw(u["k"], seed, 3, F.greatest(one, u["c"] - u["tw"])).alias("t0")))

    def paint(s: Column) -> Column:
        return F.transform(s["b"], lambda row, i: F.transform(
            row, lambda x, j: F.when(
                ((i >= s["f0"]) & (i < s["f0"] + s["fw"]))
                | ((j >= s["t0"]) & (j < s["t0"] + s["tw"])), F.lit(floor)).otherwise(x)))

    bound = F.struct(as_col(bands).cast("array<array<double>>").alias("b"),
                     as_col(key).cast("string").alias("k"))
    return let(let(bound, spans), paint)


def pad_to(arr: Column | str, width: Column | int, value: float = 0.0) -> Column:
    """Cut or right-pad to ``width``; struct(values, length), where
    ``length`` counts the real values among the ``width``."""
    w = F.lit(width) if isinstance(width, int) else width
    return let(F.struct(doubles(arr).alias("v"), w.cast("int").alias("w")), lambda s: F.struct(
        F.slice(F.concat(s["v"], F.array_repeat(
            F.lit(value), F.greatest(s["w"] - F.size(s["v"]), F.lit(0)))), F.lit(1), s["w"],
        ).alias("values"),
        F.least(F.size(s["v"]), s["w"]).alias("length")))


def pad_with_mask(arr: Column | str, slots: int = SLOTS, value: float = 0.0) -> Column:
    """struct(values, mask): exactly ``slots`` values and which of them are real."""
    return let(pad_to(arr, slots, value), lambda s: F.struct(
        s["values"].alias("values"),
        F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: i < s["length"]).alias("mask")))


def pad_tokens(ids: Column | str, width: int = TOKENS, pad: int = 0) -> Column:
    """struct(input_ids, attention_mask) of fixed length, cut or padded on the right."""
    def fixed(a: Column) -> Column:
        kept = F.least(F.size(a), F.lit(width))
        return F.struct(
            F.slice(F.concat(a, F.array_repeat(F.lit(pad).cast("bigint"), width)), 1, width)
            .alias("input_ids"),
            F.concat(F.array_repeat(F.lit(1).cast("bigint"), kept),
                     F.array_repeat(F.lit(0).cast("bigint"), F.lit(width) - kept))
            .alias("attention_mask"))
    return let(as_col(ids).cast("array<bigint>"), fixed)


def pad_mask(attention: Column | str) -> Column:
    """True where a token position is padding."""
    return F.transform(as_col(attention), lambda x: x == 0)


def renorm(weights: Column | str, mask: Column | str) -> Column:
    """Zero the masked-out weights and scale the rest to sum 1 (guarded)."""
    kept = F.zip_with(doubles(weights), as_col(mask), lambda w, m: F.when(m, w).otherwise(F.lit(0.0)))
    return let(let(kept, lambda k: F.struct(
        k.alias("k"), F.greatest(total(k), F.lit(WEIGHT_GUARD)).alias("t"))),
        lambda s: F.transform(s["k"], lambda w: w / s["t"]))


def weighted_pool(vecs: Column | str, weights: Column | str) -> Column:
    """Sum of the vectors, each multiplied by its weight."""
    scaled = F.zip_with(as_col(vecs).cast("array<array<double>>"), doubles(weights),
                        lambda v, w: F.transform(v, lambda x: x * w))
    return let(scaled, lambda s: F.aggregate(
        F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))), F.get(s, F.lit(0)),
        lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b)))


def masked_mean(vecs: Column | str, pad: Column | str) -> Column:
    """Mean of the vectors whose pad flag is false, dividing by at least one."""
    keep = F.transform(as_col(pad), lambda p: F.when(p, F.lit(0.0)).otherwise(F.lit(1.0)))
    return let(F.struct(as_col(vecs).cast("array<array<double>>").alias("v"), keep.alias("k")),
               lambda s: let(
                   F.struct(weighted_pool(s["v"], s["k"]).alias("p"),
                            F.greatest(total(s["k"]), F.lit(1.0)).alias("n")),
                   lambda t: F.transform(t["p"], lambda x: x / t["n"])))


def vsum(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y)


def fuse(a: Column | str, b: Column | str) -> Column:
    """Concatenate both vectors, their absolute difference and their product."""
    return let(F.struct(doubles(a).alias("a"), doubles(b).alias("b")), lambda s: F.concat(
        s["a"], s["b"],
        F.zip_with(s["a"], s["b"], lambda x, y: F.abs(x - y)),
        F.zip_with(s["a"], s["b"], lambda x, y: x * y)))


def l2(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; NULL when a vector has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.try_divide(dot(a, b), norm)


def softmax(arr: Column | str, temperature: float = 1.0) -> Column:
    """``exp(temperature * x)`` scaled to sum 1, shifted by the maximum."""
    scaled = F.transform(doubles(arr), lambda x: x * F.lit(temperature))
    shifted = let(scaled, lambda a: let(
        F.struct(a.alias("v"), F.array_max(a).alias("m")),
        lambda s: F.transform(s["v"], lambda x: F.exp(x - s["m"]))))
    return let(let(shifted, lambda e: F.struct(e.alias("e"), total(e).alias("t"))),
               lambda s: F.transform(s["e"], lambda x: x / s["t"]))


def log_sum_exp(arr: Column | str) -> Column:
    return let(doubles(arr), lambda a: let(
        F.struct(a.alias("v"), F.array_max(a).alias("m")),
        lambda s: s["m"] + F.log(F.aggregate(
            s["v"], F.lit(0.0), lambda acc, x: acc + F.exp(x - s["m"])))))


def argmax(arr: Column | str) -> Column:
    """Position of the largest element, the first one on ties."""
    return let(as_col(arr), lambda a: F.array_position(a, F.array_max(a)) - 1).cast("int")


def argmax_key(scores: Column | str, order: Sequence[str]) -> Column:
    """Key with the largest value; ties go to the key that comes first in ``order``."""
    names = F.array(*[F.lit(n) for n in order])
    return let(as_col(scores), lambda m: F.get(
        names, argmax(F.transform(names, lambda n: F.try_element_at(m, n)))))


def score_map(probs: Column | str, names: Sequence[str], digits: int | None = 4) -> Column:
    """Map name -> probability, optionally rounded."""
    def fill(p: Column) -> Column:
        return F.transform(p, lambda x: F.round(x, digits)) if digits is not None else p
    return F.map_from_arrays(F.array(*[F.lit(n) for n in names]), fill(doubles(probs)))


def class_delta(left: Column | str, right: Column | str, digits: int | None = 4) -> Column:
    """Absolute difference per key of two score maps."""
    def diff(_: Column, a: Column, b: Column) -> Column:
        d = F.abs(a - b)
        return F.round(d, digits) if digits is not None else d
    return F.map_zip_with(as_col(left), as_col(right), diff)


def entries_desc(scores: Column | str, order: Sequence[str]) -> Column:
    """Map entries by value, largest first; ties keep the given key order."""
    names = F.array(*[F.lit(n) for n in order])
    entries = let(as_col(scores), lambda m: F.transform(
        names, lambda n, i: F.struct((-F.try_element_at(m, n)).alias("neg"), i.alias("i"),
                                     n.alias("key"))))
    return F.transform(
        F.array_sort(F.filter(entries, lambda e: e["neg"].isNotNull())),
        lambda e: F.struct(e["key"].alias("key"), (-e["neg"]).alias("value")))


def uniform(n: Column | int) -> Column:
    """``n`` equal weights that sum to 1 (empty for ``n = 0``)."""
    size = F.lit(n) if isinstance(n, int) else n
    return F.array_repeat(F.lit(1.0) / F.greatest(size, F.lit(1)), size.cast("int"))


def has_nan(arr: Column | str) -> Column:
    return F.exists(doubles(arr), F.isnan)


def has_inf(arr: Column | str) -> Column:
    return F.exists(doubles(arr), lambda x: F.abs(x) == F.lit(float("inf")))


def bad_value(arr: Column | str) -> Column:
    """'NaN', else 'Inf', else NULL."""
    return let(doubles(arr), lambda a: F.when(has_nan(a), "NaN").when(has_inf(a), "Inf"))


def flat_float(arr: Column | str) -> Column:
    """2-D or 1-D numbers as one flat float array."""
    return F.flatten(as_col(arr)).cast("array<float>")


def flat_long(arr: Column | str) -> Column:
    return F.flatten(as_col(arr)).cast("array<bigint>")
