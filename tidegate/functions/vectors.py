"""Vector functions on arrays, in the JVM, and blocked products for bulk work."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """The vector over its length; one of no length, or none that is finite, is left as it is."""
    n = norm(v)
    good = (n >= EPS) & ~F.isnan(n) & (n < float("inf"))
    # the length stands in an array of one, so that it is worked out once and not for each component
    over = F.transform(F.array(n), lambda m: F.transform(v, lambda x: x.cast("double") / m))[0]
    return F.when(good, over).otherwise(v.cast("array<double>"))


def cosine(a: Column, b: Column) -> Column:
    """Inner product of the normalised vectors; of one without length, as it is."""
    unit = lambda n: F.when((n >= EPS) & ~F.isnan(n) & (n < float("inf")), n).otherwise(F.lit(1.0))
    return dot(a, b) / (unit(norm(a)) * unit(norm(b)))


def mean_vectors(vectors: Column) -> Column:
    """Mean of an array of vectors of one length."""
    zero = F.transform(vectors[0], lambda x: F.lit(0.0))
    total = F.aggregate(vectors, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / F.size(vectors))


def max_vectors(vectors: Column) -> Column:
    """The largest of each component of an array of vectors of one length."""
    first = F.transform(vectors[0], lambda x: x.cast("double"))
    return F.aggregate(vectors, first, lambda s, v: F.zip_with(s, v, lambda x, y: F.greatest(x, y.cast("double"))))


def _held(value: Column, then) -> Column:
    """``then`` of a column that is worked out once: it stands in an array of one."""
    return F.transform(F.array(value), then)[0]


def pool_images(images: Column) -> Column:
    """One vector of several images: each normalised, their mean normalised."""
    unit = F.transform(images, lambda v: l2_normalize(v))
    return _held(_held(unit, lambda x: mean_vectors(x)), lambda v: l2_normalize(v))


def fuse(text: Column, image: Column, mode: str = "pool", w_text: float = 0.4, w_image: float = 0.6) -> Column:
    """One vector of a text's and an image's, each normalised and weighted: side by side or added, then normalised. One alone is normalised.

    Modes: concat, weighted_avg, pool (the same where both are there). Neither there, or vectors of unlike length that are
    to be added, raise an error.
    """
    return fuse_images(text, F.when(image.isNotNull(), F.array(image)), mode, w_text, w_image)


def fuse_images(text: Column, images: Column, mode: str = "pool", w_text: float = 0.4, w_image: float = 0.6) -> Column:
    """``fuse`` of a text's vector and an array of images' vectors, null or empty if there is none."""
    if mode not in ("concat", "weighted_avg", "pool"):
        raise ValueError(f"unknown mode: {mode}")
    wrong = lambda why: F.raise_error(F.lit(why)).cast("array<double>")
    some = F.coalesce(F.size(images), F.lit(0)) > 0
    image = F.when(some, pool_images(images))
    scaled = lambda v, w: F.transform(v, lambda x: x * w)
    if mode == "concat":
        both = lambda p: F.concat(scaled(p["t"], w_text), scaled(p["i"], w_image))
    else:
        both = lambda p: F.when(F.size(p["t"]) == F.size(p["i"]), F.zip_with(p["t"], p["i"], lambda x, y: w_text * x + w_image * y)).otherwise(wrong("vectors of unlike length"))
    parts = F.struct(l2_normalize(text).alias("t"), image.alias("i"))
    fused = _held(_held(parts, both), lambda v: l2_normalize(v))
    return F.when(text.isNull() & ~some, wrong("neither text nor image")).when(text.isNull(), image).when(~some, l2_normalize(text)).otherwise(fused)


def build_query(text: Column, images: Column, mode: str = "pool", w_text: float = 0.4, w_image: float = 0.6) -> Column:
    """The query vector of a request: its text's and the plain mean of its frames', fused; one alone as it is, none null.

    ``images`` is an array of vectors; null or empty stands for no frame.
    """
    some = F.coalesce(F.size(images), F.lit(0)) > 0
    mean = F.when(some, mean_vectors(images))
    alone = lambda v: v.cast("array<double>")
    return F.when(text.isNull(), mean).when(~some, alone(text)).otherwise(fuse(text, mean, mode, w_text, w_image))


def frame_indices(total: Column, count: int = 5) -> Column:
    """``count`` frame numbers spread evenly from first to last, halves rounded to even; none of no frames."""
    n = F.greatest(F.lit(1), F.least(F.lit(count), total))
    spread = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.bround(k * (total - 1) / (n - 1)).cast("int"))
    return F.when(total <= 0, F.array().cast("array<int>")).when(n == 1, F.array(F.lit(0))).otherwise(F.array_distinct(spread))
