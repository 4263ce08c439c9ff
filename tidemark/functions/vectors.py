"""Dense-vector expressions on ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import as_col


def doubles(v: str | Column) -> Column:
    return as_col(v).cast("array<double>")


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row.

    A plain expression used inside a lambda is evaluated again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def relu(v: Column) -> Column:
    return F.transform(v, lambda x: F.greatest(x, F.lit(0.0)))


def relu_derivative(v: Column) -> Column:
    return F.transform(v, lambda x: F.when(x > 0, 1).otherwise(0))


def sigmoid(v: Column) -> Column:
    return F.transform(v, lambda x: 1.0 / (1.0 + F.exp(-x)))


def vector_sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def softmax(v: Column) -> Column:
    """Shifted by the maximum, so large inputs do not overflow."""

    def divide(x: Column) -> Column:
        return F.transform(x["e"], lambda e: e / x["total"])

    def exponents(x: Column) -> Column:
        return F.transform(x["v"], lambda item: F.exp(item - x["top"]))

    powers = bind(F.struct(v.alias("v"), F.array_max(v).alias("top")), exponents)
    return bind(powers, lambda e: bind(F.struct(e.alias("e"), vector_sum(e).alias("total")), divide))


def one_hot(label: str | Column, classes: int) -> Column:
    y = as_col(label)
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.when(i == y, 1).otherwise(0))


def argmax(v: Column) -> Column:
    """0-based place of the largest item, first of ties."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def scale(v: Column, divisor: float = 255.0) -> Column:
    return F.transform(v, lambda x: x / F.lit(divisor))


def normalise(v: Column, mean: float = 0.5, std: float = 0.5) -> Column:
    return F.transform(v, lambda x: (x - F.lit(mean)) / F.lit(std))


def nest(v: Column, rows: int, cols: int) -> Column:
    """Flat vector -> rows x cols x 1, wrapped in a batch of one."""
    def grid(x: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(rows - 1)),
            lambda r: F.transform(F.slice(x, r * cols + 1, cols), lambda item: F.array(item)),
        )

    return F.array(bind(v, grid))


def unnest(nested: Column) -> Column:
    """Inverse of :func:`nest`."""
    return F.flatten(F.flatten(F.flatten(nested)))


def planar_to_interleaved(v: Column, channels: int = 3) -> Column:
    """(channel, pixel) order -> (pixel, channel) order."""
    def move(x: Column) -> Column:
        plane = (F.size(x) / channels).cast("int")
        return F.transform(
            F.sequence(F.lit(0), F.size(x) - 1),
            lambda i: F.get(x, (i % channels) * plane + F.floor(i / channels).cast("int")),
        )

    return bind(v, move)


def squared_distance(a: Column, b: Column) -> Column:
    return vector_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def cross_entropy(probabilities: Column, label: str | Column, eps: float = 1e-8) -> Column:
    """Loss of one row: minus log of the probability given to its label."""
    return -F.log(F.get(probabilities, as_col(label)) + F.lit(eps))
