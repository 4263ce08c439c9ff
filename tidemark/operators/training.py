"""Dense three-layer classifier: scoring and gradient training over DataFrames.

Rows stay in Spark; only weights and gradients, whose size is that of the model,
travel between driver and tasks.  Weights are stored as a table
``layer, i, j, w`` with ``i = -1`` for the bias.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.vectors import cross_entropy, doubles

WEIGHT_SCHEMA = "layer int, i int, j int, w double"
EPS = 1e-8

# A model is a list of (matrix, bias) per layer.
Model = list[tuple[np.ndarray, np.ndarray]]


def random_model(sizes: Sequence[int], seed: int, scale: float = 0.01) -> Model:
    rng = np.random.default_rng(seed)
    return [(rng.standard_normal((a, b)) * scale, np.zeros(b)) for a, b in zip(sizes, sizes[1:])]


def model_rows(model: Model) -> list[tuple[int, int, int, float]]:
    rows = []
    for layer, (matrix, bias) in enumerate(model, 1):
        rows += [(layer, -1, j, float(b)) for j, b in enumerate(bias)]
        rows += [(layer, i, j, float(w)) for (i, j), w in np.ndenumerate(matrix)]
    return rows


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    spark.createDataFrame(model_rows(model), WEIGHT_SCHEMA).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> Model:
    return to_model(spark.read.schema(WEIGHT_SCHEMA).parquet(path))


def to_model(weights: DataFrame) -> Model:
    """Weights table -> arrays on the driver (as many numbers as the model has)."""
    rows = weights.toPandas()
    model = []
    for layer in sorted(rows["layer"].unique()):
        part = rows[rows["layer"] == layer]
        matrix = np.zeros((part["i"].max() + 1, part["j"].max() + 1))
        bias = np.zeros(matrix.shape[1])
        inner = part[part["i"] >= 0]
        matrix[inner["i"], inner["j"]] = inner["w"]
        outer = part[part["i"] < 0]
        bias[outer["j"]] = outer["w"]
        model.append((matrix, bias))
    return model


def activations(x: np.ndarray, model: Model) -> list[np.ndarray]:
    """Input, hidden layers (relu) and class probabilities (softmax)."""
    layers = [x]
    for n, (matrix, bias) in enumerate(model, 1):
        z = layers[-1] @ matrix + bias
        if n < len(model):
            layers.append(np.maximum(z, 0.0))
        else:
            power = np.exp(z - z.max(axis=1, keepdims=True))
            layers.append(power / power.sum(axis=1, keepdims=True))
    return layers


def gradients(x: np.ndarray, y: np.ndarray, model: Model) -> tuple[list[tuple[np.ndarray, np.ndarray]], float]:
    """Summed (not averaged) gradients per layer, and the summed loss, of one batch."""
    layers = activations(x, model)
    hits = layers[-1][np.arange(len(y)), y]
    delta = layers[-1].copy()
    delta[np.arange(len(y)), y] -= 1.0
    out = []
    for level in range(len(model) - 1, -1, -1):
        out.append((layers[level].T @ delta, delta.sum(axis=0)))
        if level:
            delta = (delta @ model[level][0].T) * (layers[level] > 0)
    return out[::-1], float(-np.log(hits + EPS).sum())


def _flat(parts) -> np.ndarray:
    return np.concatenate([np.concatenate([m.ravel(), b]) for m, b in parts])


def _shaped(flat: np.ndarray, like: Model) -> Model:
    out, at = [], 0
    for matrix, bias in like:
        m = flat[at : at + matrix.size].reshape(matrix.shape)
        at += matrix.size
        out.append((m, flat[at : at + bias.size]))
        at += bias.size
    return out


@dataclass
class Config:
    """One training run: learning rate and starting weights."""

    rate: float
    model: Model


def _partials(configs: Sequence[Config], batch_size: int | None):
    """Per task and config: one row of summed gradients, or of locally trained weights."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, loss = 0, np.zeros(len(configs))
        sums = [np.zeros(_flat(c.model).size) for c in configs]
        models = [[(m.copy(), b.copy()) for m, b in c.model] for c in configs]
        for batch in batches:
            if batch.empty:
                continue
            x, y = np.stack(batch["x"].to_numpy()), batch["y"].to_numpy()
            n += len(y)
            for k, config in enumerate(configs):
                step, cost = gradients(x, y, config.model)
                loss[k] += cost
                if batch_size is None:
                    sums[k] += _flat(step)
                    continue
                for at in range(0, len(y), batch_size):
                    part = slice(at, at + batch_size)
                    step, _ = gradients(x[part], y[part], models[k])
                    share = config.rate / len(y[part])
                    models[k] = [(m - share * gm, b - share * gb) for (m, b), (gm, gb) in zip(models[k], step)]
        if n:
            flats = sums if batch_size is None else [_flat(m) * n for m in models]
            yield pd.DataFrame(
                {"config": range(len(configs)), "n": n, "loss": loss, "g": [f.tolist() for f in flats]}
            )

    return run


def train_many(
    df: DataFrame, vector: str, label: str, configs: Sequence[Config], epochs: int, batch_size: int | None = None
) -> tuple[list[Model], list[tuple[int, int, float]]]:
    """Train all configs side by side; one pass over the data per epoch.

    Without ``batch_size`` this is full-batch gradient descent: tasks sum gradients,
    Spark adds the sums per weight, the driver applies them.  With it, tasks run
    mini-batches on their own rows and the resulting weights are averaged by row
    count, which is a different (parallel) algorithm than one sequential pass.
    Returns the models and (config, epoch, loss before the epoch's update), with the
    final loss as epoch ``epochs``.
    """
    rows = df.select(doubles(vector).alias("x"), F.col(label).cast("int").alias("y")).persist()
    configs = [Config(c.rate, c.model) for c in configs]
    history = []
    try:
        for epoch in range(epochs + 1):
            partial = rows.mapInPandas(_partials(configs, batch_size), "config int, n long, loss double, g array<double>")
            by_task = partial.select("config", "n", "loss", F.posexplode("g").alias("pos", "g"))
            # One position carries the counts, so everything comes from one aggregate.
            sums = (
                by_task.groupBy("config", "pos")
                .agg(F.sum("g").alias("g"), F.sum("n").alias("n"), F.sum("loss").alias("loss"))
                .toPandas()
            )
            for k, config in enumerate(configs):
                mine = sums[sums["config"] == k].sort_values("pos")
                n = int(mine["n"].iloc[0])
                history.append((k, epoch, float(mine["loss"].iloc[0]) / n))
                if epoch < epochs:
                    total = _shaped(mine["g"].to_numpy() / n, config.model)
                    if batch_size is None:
                        config.model = [
                            (m - config.rate * gm, b - config.rate * gb) for (m, b), (gm, gb) in zip(config.model, total)
                        ]
                    else:
                        config.model = total
    finally:
        rows.unpersist()
    return [c.model for c in configs], history


def train(df: DataFrame, vector: str, label: str, model: Model, rate: float, epochs: int, batch_size: int | None = None):
    """One config; start from a loaded model for a warm start."""
    models, history = train_many(df, vector, label, [Config(rate, model)], epochs, batch_size)
    return models[0], [(epoch, loss) for _, epoch, loss in history]


def score(df: DataFrame, vector: str, model: Model, out: str = "pred", probabilities: str | None = None) -> DataFrame:
    """Add the predicted class and, if named, the class probabilities."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def forward(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if batch.empty:
                yield pd.Series([], dtype=object)
            else:
                yield pd.Series(list(activations(np.stack(batch.to_numpy()), shared.value)[-1]))

    scored = df.withColumn("_p", forward(doubles(vector)))
    top = (F.array_position("_p", F.array_max("_p")) - 1).cast("int")
    scored = scored.withColumn(out, top)
    return scored.withColumnRenamed("_p", probabilities) if probabilities else scored.drop("_p")


def evaluate(df: DataFrame, vector: str, label: str, model: Model, names: Sequence[str]) -> tuple[float, float]:
    """Mean loss, and mean edit distance between the names of the true and the predicted class."""
    scored = score(df, vector, model, "_pred", "_probabilities")
    named = F.array(*[F.lit(n) for n in names])
    row = scored.agg(
        F.avg(cross_entropy(F.col("_probabilities"), label)).alias("loss"),
        F.avg(F.levenshtein(F.get(named, F.col(label)), F.get(named, F.col("_pred")))).alias("distance"),
    ).first()
    return row["loss"], row["distance"]


def train_logged(
    train_rows: DataFrame, val_rows: DataFrame, vector: str, label: str, model: Model, rate: float, epochs: int, names: Sequence[str], run_id: str
) -> tuple[Model, list[tuple[str, str, int, float]]]:
    """The trained model, and after each epoch its losses and edit distance as rows of run metrics."""
    rows = []
    for epoch in range(1, epochs + 1):
        model, history = train(train_rows, vector, label, model, rate, 1)
        val_loss, distance = evaluate(val_rows, vector, label, model, names)
        found = {"train_loss": history[-1][1], "val_loss": val_loss, "avg_edit_distance": distance}
        rows += [(run_id, key, epoch, value) for key, value in found.items()]
    return model, rows


def accuracies(df: DataFrame, vector: str, label: str, models: Sequence[Model]) -> list[float]:
    """Accuracy of every model, in one pass."""
    shared = df.sparkSession.sparkContext.broadcast(list(models))

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            x, y = np.stack(batch["x"].to_numpy()), batch["y"].to_numpy()
            found = [int((activations(x, m)[-1].argmax(axis=1) == y).sum()) for m in shared.value]
            yield pd.DataFrame({"config": range(len(found)), "hits": found, "n": len(y)})

    rows = df.select(doubles(vector).alias("x"), F.col(label).cast("int").alias("y"))
    counted = rows.mapInPandas(hits, "config int, hits long, n long").groupBy("config")
    sums = counted.agg((F.sum("hits") / F.sum("n")).alias("a")).collect()
    found = {r["config"]: r["a"] for r in sums}
    return [found.get(k, 0.0) for k in range(len(models))]


def grid_search(
    df: DataFrame,
    vector: str,
    label: str,
    split: str,
    rates: Sequence[float],
    widths: Sequence[int],
    inputs: int,
    classes: int,
    epochs: int,
    seed: int = 42,
    scale: float = 0.1,
    start: Callable[[Sequence[int]], Model] | None = None,
) -> DataFrame:
    """Every rate x width, trained side by side on ``train``, ranked on ``val``.

    ``start`` gives the first weights for layer sizes; else they are random, by ``seed`` and ``scale``.

    The best run is the first one whose accuracy no earlier run reaches; none is best
    if all are 0.
    """
    options = [(r, w) for r in rates for w in widths]
    start = start or (lambda sizes: random_model(sizes, seed, scale))
    configs = [Config(r, start([inputs, w, max(w // 2, 2), classes])) for r, w in options]
    models, history = train_many(df.filter(F.col(split) == "train"), vector, label, configs, epochs)
    found = accuracies(df.filter(F.col(split) == "val"), vector, label, models)
    best = found.index(max(found)) if max(found) > 0 else None
    final = {k: loss for k, epoch, loss in history if epoch == epochs}
    rows = [
        (k, float(r), int(w), float(final[k]), float(found[k]), k == best) for k, (r, w) in enumerate(options)
    ]
    return df.sparkSession.createDataFrame(
        rows, "run_no int, rate double, width int, train_loss double, val_accuracy double, best boolean"
    )
