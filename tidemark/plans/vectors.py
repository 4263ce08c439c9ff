"""Registered queries: vectors, dense classifier, run metrics."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tidemark.functions import vectors as vx
from tidemark.operators import runs as rn
from tidemark.operators import splits as sp
from tidemark.operators import training as tr
from tidemark.plans.registry import register, table
from tidemark.session import work_path

V = "embedding::DOUBLE[]"


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", vx.doubles("embedding").alias("v"))


@register(
    "activations",
    f"""WITH e AS (SELECT vec_id, {V} AS v FROM embeddings), s AS (SELECT *, list_transform(v, lambda x: exp(x - list_max(v))) AS p FROM e)
SELECT vec_id, round(list_sum(list_transform(v, lambda x: greatest(x, 0.0::DOUBLE))), 6) AS relu_sum,
  list_sum(list_transform(v, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END))::BIGINT AS positive,
  round(list_sum(list_transform(v, lambda x: 1 / (1 + exp(-x)))), 6) AS sigmoid_sum,
  round(list_max(p) / list_sum(p), 8) AS softmax_top, round((p[1]) / list_sum(p), 8) AS softmax_first FROM s""",
)
def activations(spark, sf_dir):
    v = F.col("v")
    positive = F.aggregate(vx.relu_derivative(v), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return vectors(spark, sf_dir).select(
        "vec_id",
        F.round(vx.vector_sum(vx.relu(v)), 6).alias("relu_sum"),
        positive.alias("positive"),
        F.round(vx.vector_sum(vx.sigmoid(v)), 6).alias("sigmoid_sum"),
        F.round(F.array_max(vx.softmax(v)), 8).alias("softmax_top"),
        F.round(F.get(vx.softmax(v), 0), 8).alias("softmax_first"),
    )


@register(
    "one_hot",
    "SELECT vec_id, array_to_string(list_transform(range(10), lambda i: CASE WHEN i = label THEN 1 ELSE 0 END), '') AS code FROM embeddings",
)
def one_hot(spark, sf_dir):
    code = F.array_join(vx.one_hot("label", 10).cast("array<string>"), "")
    return vectors(spark, sf_dir).select("vec_id", code.alias("code"))


@register("argmax", f"SELECT vec_id, (list_position({V}, list_max({V})) - 1)::INTEGER AS top FROM embeddings")
def argmax(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", vx.argmax(F.col("v")).alias("top"))


@register(
    "scale_vector",
    f"""SELECT vec_id, round(list_sum(list_transform({V}, lambda x: x / 255.0::DOUBLE)), 8) AS scaled,
  round(list_sum(list_transform({V}, lambda x: (x - 0.5::DOUBLE) / 0.5::DOUBLE)), 6) AS normalised,
  ({V})[1] * 1024 AS first_kb FROM embeddings""",
)
def scale_vector(spark, sf_dir):
    v = F.col("v")
    return vectors(spark, sf_dir).select(
        "vec_id",
        F.round(vx.vector_sum(vx.scale(v)), 8).alias("scaled"),
        F.round(vx.vector_sum(vx.normalise(v)), 6).alias("normalised"),
        (F.get(v, 0) * 1024).alias("first_kb"),
    )


@register(
    "planar_to_interleaved",
    f"SELECT vec_id, unnest(range(64))::INTEGER AS pos, unnest(list_transform(range(64), lambda i: ({V})[(i % 4) * 16 + i // 4 + 1])) AS x FROM embeddings",
)
def planar_to_interleaved(spark, sf_dir):
    moved = vx.planar_to_interleaved(F.col("v"), 4)
    return vectors(spark, sf_dir).select("vec_id", F.posexplode(moved).alias("pos", "x"))


# --- dense classifier with weights given by a formula ----------------------------------

SIZES = [64, 16, 12, 10]


def formula_weights(spark, sizes=SIZES):
    """Weights any engine can repeat: small fractions from a residue of (layer, i, j)."""
    layers = F.explode(
        F.array(
            *[
                F.struct(F.lit(n).alias("layer"), F.lit(a).alias("a"), F.lit(b).alias("b"))
                for n, (a, b) in enumerate(zip(sizes, sizes[1:]), 1)
            ]
        )
    )
    rows = spark.range(1).select(layers.alias("s")).select("s.*")
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(-1), F.col("a") - 1)))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
    inner = (F.pmod(F.col("i") * 31 + F.col("j") * 17 + F.col("layer") * 7, F.lit(23)) - 11) / 20.0
    bias = (F.pmod(F.col("j") * 13 + F.col("layer"), F.lit(7)) - 3) / 10.0
    return rows.select("layer", "i", "j", F.when(F.col("i") < 0, bias).otherwise(inner).alias("w"))


def _sql_layer(n, source, width_in, width_out, relu):
    z = f"sum(s.x * (((s.i * 31 + j.j * 17 + {n * 7}) % 23) - 11) / 20.0::DOUBLE) + (((any_value(j.j) * 13 + {n}) % 7) - 3) / 10.0::DOUBLE"
    value = f"greatest({z}, 0)" if relu else z
    return f"a{n} AS (SELECT s.vec_id, j.j AS i, {value} AS x FROM {source} s CROSS JOIN (SELECT unnest(range({width_out})) AS j) j GROUP BY s.vec_id, j.j)"


@register(
    "mlp_forward",
    f"""WITH a0 AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
{_sql_layer(1, 'a0', 64, 16, True)}, {_sql_layer(2, 'a1', 16, 12, True)}, {_sql_layer(3, 'a2', 12, 10, False)},
p AS (SELECT vec_id, i, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS p FROM a3)
SELECT vec_id, arg_max(i, (round(p, 9), -i))::INTEGER AS pred, round(max(p), 6) AS top FROM p GROUP BY vec_id""",
)
def mlp_forward(spark, sf_dir):
    model = tr.to_model(formula_weights(spark))
    scored = tr.score(vectors(spark, sf_dir), "v", model, probabilities="p")
    return scored.select("vec_id", "pred", F.round(F.array_max("p"), 6).alias("top"))


def _sql_training(rows, configs, epochs):
    """CTEs of ``epochs`` full-batch steps on ``rows`` (id, label, x) from formula weights.

    ``configs`` lists (number, rate, layer sizes).  Leaves ``w{n}`` (c, layer, j, col, b), the
    weights after n steps, and for each step the class probabilities ``p{n}`` (c, id, x) before it;
    vectors are lists, so a weight's gradient is one dot product.
    """
    layers = ", ".join(
        f"({c}, {rate}::DOUBLE, {n}, {a}, {b})" for c, rate, sizes in configs for n, (a, b) in enumerate(zip(sizes, sizes[1:]), 1)
    )
    parts = [
        f"t AS MATERIALIZED ({rows})",
        f"""w0 AS MATERIALIZED (SELECT c, rate, layer, j, list_transform(range(0, s.a), lambda i: ((i * 31 + j * 17 + layer * 7) % 23 - 11) / 20.0::DOUBLE) AS col,
  ((j * 13 + layer) % 7 - 3) / 10.0::DOUBLE AS b FROM (VALUES {layers}) s(c, rate, layer, a, b), LATERAL (SELECT unnest(range(0, s.b)) AS j))""",
    ]
    numbers = ", ".join(f"({c})" for c, _, _ in configs)
    parts.append(f"a0 AS MATERIALIZED (SELECT c, id, x FROM t CROSS JOIN (VALUES {numbers}) n(c))")
    for s in range(epochs + 1):
        w = f"w{s}"
        parts.append(_sql_lists_forward(w, "a0", f"f{s}_"))
        parts.append(f"p{s} AS MATERIALIZED ({_sql_softmax(f'f{s}_3')})")
        if s == epochs:
            break
        parts += [
            f"d{s}_3 AS MATERIALIZED (SELECT c, id, list_transform(p.x, lambda v, k: v - (k = label + 1)::INTEGER) AS x FROM p{s} p JOIN t USING (id))",
            f"r{s} AS MATERIALIZED (SELECT c, layer, k - 1 AS i, list(v ORDER BY j) AS row FROM (SELECT c, layer, j, unnest(col) AS v, generate_subscripts(col, 1) AS k FROM {w}) GROUP BY ALL)",
        ]
        for n in (2, 1):
            parts.append(
                f"""d{s}_{n} AS MATERIALIZED (SELECT a.c, a.id, list(CASE WHEN a.x[r.i + 1] > 0 THEN list_dot_product(r.row, d.x) ELSE 0 END ORDER BY r.i) AS x
  FROM f{s}_{n} a JOIN d{s}_{n + 1} d USING (c, id) JOIN r{s} r ON r.c = a.c AND r.layer = {n + 1} GROUP BY a.c, a.id)"""
            )
        for side, name, tables in (("i", "g", ("a0", f"f{s}_1", f"f{s}_2")), ("j", "h", (f"d{s}_1", f"d{s}_2", f"d{s}_3"))):
            listed = " UNION ALL ".join(
                f"SELECT c, {n} AS layer, id, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS {side} FROM {source}" for n, source in enumerate(tables, 1)
            )
            parts.append(f"{name}{s} AS MATERIALIZED (SELECT c, layer, {side}, list(v ORDER BY id) AS v FROM ({listed}) GROUP BY ALL)")
        parts.append(
            f"""w{s + 1} AS MATERIALIZED (SELECT w.c, w.rate, w.layer, w.j, list(w.col[g.i + 1] - w.rate * list_dot_product(g.v, h.v) / len(h.v) ORDER BY g.i) AS col,
  any_value(w.b - w.rate * list_sum(h.v) / len(h.v)) AS b FROM {w} w JOIN h{s} h USING (c, layer, j) JOIN g{s} g ON g.c = w.c AND g.layer = w.layer GROUP BY w.c, w.rate, w.layer, w.j)"""
        )
    return ",\n".join(parts)


def _sql_lists_forward(w, source, out):
    """``{out}1``, ``{out}2`` and the logits ``{out}3`` of the input lists of ``source`` (c, id, x)."""
    steps = []
    for n in (1, 2, 3):
        z = "list_dot_product(a.x, w.col) + w.b"
        z = f"greatest({z}, 0)" if n < 3 else z
        before = source if n == 1 else f"{out}{n - 1}"
        steps.append(f"{out}{n} AS MATERIALIZED (SELECT a.c, a.id, list({z} ORDER BY w.j) AS x FROM {before} a JOIN {w} w ON w.c = a.c AND w.layer = {n} GROUP BY a.c, a.id)")
    return ",\n".join(steps)


def _sql_softmax(source):
    top = f"SELECT c, id, list_transform(x, lambda v: exp(v - list_max(x))) AS e FROM {source}"
    return f"SELECT c, id, list_transform(e, lambda v: v / list_sum(e)) AS x FROM ({top})"


TRAIN_SIZES = [64, 32, 16, 10]
TRAIN_EPOCHS = 10


def _sql_losses(epochs):
    return " UNION ALL ".join(
        f"SELECT c, {s} AS step, avg(-ln(p.x[label + 1] + 1e-8)) AS loss FROM p{s} p JOIN t USING (id) GROUP BY c" for s in epochs
    )


VECTOR_ROWS = "SELECT vec_id AS id, label, embedding::DOUBLE[] AS x FROM embeddings"


@register(
    "mlp_train",
    f"""WITH {_sql_training(VECTOR_ROWS, [(0, 0.5, TRAIN_SIZES)], TRAIN_EPOCHS)}
SELECT 'dense' AS run_id, 'loss' AS key, step::INTEGER AS step, round(loss, 6) AS value FROM ({_sql_losses(range(TRAIN_EPOCHS + 1))})""",
)
def mlp_train(spark, sf_dir):
    """Loss per epoch of full-batch training on all vectors."""
    data = vectors(spark, sf_dir)
    start = tr.to_model(formula_weights(spark, TRAIN_SIZES))
    _, history = tr.train(data, "v", "label", start, 0.5, TRAIN_EPOCHS)
    return spark.createDataFrame([("dense", "loss", e, round(v, 6)) for e, v in history], rn.METRICS)


RATES = [0.1, 0.5]
NAMES = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]


def _sql_forward(w, a, e, keys):
    """Activations ``{a}1``, ``{a}2`` and class probabilities ``{a}p`` of the inputs ``{a}0``; input -1 is the bias."""
    hidden = [
        f"""{a}{n} AS (SELECT {keys}, j AS i, greatest(sum(x * w), 0) AS x FROM {a}{n - 1} JOIN {w} USING ({", ".join(["i", *keys.split(", ")[1:]])})
  WHERE layer = {n} GROUP BY {keys}, j UNION ALL SELECT {keys}, -1, 1 FROM {e})"""
        for n in (1, 2)
    ]
    last = f"""{a}3 AS (SELECT {keys}, j AS i, sum(x * w) AS x FROM {a}2 JOIN {w} USING ({", ".join(["i", *keys.split(", ")[1:]])})
  WHERE layer = 3 GROUP BY {keys}, j),
{a}p AS (SELECT {keys}, i, exp(x) / sum(exp(x)) OVER (PARTITION BY {keys}) AS p FROM {a}3)"""
    return ",\n".join([*hidden, last])


def _sql_run_log():
    def back(n):
        return f"""d{n} AS (SELECT a{n}.vec_id, a{n}.i, sum(d * w) AS d FROM a{n} JOIN w ON layer = {n + 1} AND w.i = a{n}.i
  JOIN d{n + 1} ON d{n + 1}.vec_id = a{n}.vec_id AND d{n + 1}.i = w.j WHERE a{n}.i >= 0 AND a{n}.x > 0 GROUP BY ALL)"""

    def inputs(keys, source):
        return f"SELECT {keys}, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM {source} UNION ALL SELECT {keys}, -1, 1 FROM {source}"

    gradients = " UNION ALL ".join(
        f"SELECT {n} AS layer, a{n - 1}.i, d{n}.i AS j, sum(x * d) / (SELECT count(*) FROM t) AS g FROM a{n - 1} JOIN d{n} USING (vec_id) GROUP BY ALL"
        for n in (1, 2, 3)
    )
    layers = ", ".join(f"({n}, {a}, {b})" for n, (a, b) in enumerate(zip(SIZES, SIZES[1:]), 1))
    rates = ", ".join(f"({r}::DOUBLE)" for r in RATES)
    return f"""WITH e AS (SELECT vec_id, label, embedding, md5('42:' || vec_id::VARCHAR) < '4' AS held FROM embeddings),
t AS (SELECT * FROM e WHERE NOT held), rates AS (SELECT * FROM (VALUES {rates}) r(rate)),
w AS (SELECT layer, i, j, CASE WHEN i < 0 THEN ((j * 13 + layer) % 7 - 3) / 10.0::DOUBLE
    ELSE ((i * 31 + j * 17 + layer * 7) % 23 - 11) / 20.0::DOUBLE END AS w
  FROM (VALUES {layers}) s(layer, a, b), LATERAL (SELECT unnest(range(-1, s.a)) AS i), LATERAL (SELECT unnest(range(0, s.b)) AS j)),
a0 AS ({inputs("vec_id", "t")}),
{_sql_forward("w", "a", "t", "vec_id")},
d3 AS (SELECT vec_id, i, p - (i = label)::INTEGER AS d FROM ap JOIN t USING (vec_id)),
{back(2)}, {back(1)},
g AS ({gradients}),
v AS (SELECT rate, layer, i, j, w - rate * coalesce(g, 0) AS w FROM w LEFT JOIN g USING (layer, i, j) CROSS JOIN rates),
er AS (SELECT * FROM e CROSS JOIN rates),
b0 AS ({inputs("vec_id, rate", "er")}),
{_sql_forward("v", "b", "er", "vec_id, rate")},
scored AS (SELECT rate, held, label, arg_max(i, p) AS pred, sum(p) FILTER (i = label) AS hit FROM bp JOIN e USING (vec_id) GROUP BY rate, vec_id, held, label)
SELECT 'rate ' || rate::VARCHAR AS run_id, rate, 1 AS epochs, round(avg(-ln(hit + 1e-8)) FILTER (NOT held), 6) AS train_loss,
  round(avg(-ln(hit + 1e-8)) FILTER (held), 6) AS val_loss,
  round(avg(levenshtein(({NAMES})[label + 1], ({NAMES})[pred + 1])) FILTER (held), 6) AS avg_edit_distance
FROM scored GROUP BY rate"""


@register("run_log", _sql_run_log())
def run_log(spark, sf_dir):
    """A run per learning rate, one epoch from formula weights: parameters beside training and validation metrics."""
    root = work_path(spark, "runs")
    params, metrics = os.path.join(root, "params"), os.path.join(root, "metrics")
    held = F.md5(F.concat(F.lit("42:"), F.col("vec_id").cast("string"))) < "4"
    data, start = vectors(spark, sf_dir), tr.to_model(formula_weights(spark))
    for rate in RATES:
        run_id = f"rate {rate}"
        _, rows = tr.train_logged(data.where(~held), data.where(held), "v", "label", start, rate, 1, NAMES, run_id)
        rn.log_params(spark, params, [(run_id, "rate", str(rate)), (run_id, "epochs", "1")])
        rn.log_metrics(spark, metrics, rows)
    logged = [spark.read.schema(s).parquet(p) for s, p in ((rn.PARAMS, params), (rn.METRICS, metrics))]
    keys = ["train_loss", "val_loss", "avg_edit_distance"]
    return rn.run_table(*logged, ["rate", "epochs"], keys).select(
        "run_id", F.col("rate").cast("double"), F.col("epochs").cast("int"), *[F.round(k, 6).alias(k) for k in keys]
    )


GRID_RATES, GRID_WIDTHS, GRID_EPOCHS = [0.1, 0.5, 1.0], [16, 32, 64], 8


def _sql_grid():
    configs = [(k, r, [64, w, w // 2, 10]) for k, (r, w) in enumerate((r, w) for r in GRID_RATES for w in GRID_WIDTHS)]
    named = ", ".join(f"({k}, {r}::DOUBLE, {sizes[1]})" for k, r, sizes in configs)
    numbers = ", ".join(f"({k})" for k, _, _ in configs)
    return f"""WITH ranked AS (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY md5('42:' || vec_id::VARCHAR)) AS r, floor((count(*) OVER ()) * 0.7::DOUBLE) AS f, count(*) OVER () AS n FROM embeddings),
parted AS MATERIALIZED (SELECT vec_id AS id, label, embedding::DOUBLE[] AS x, CASE WHEN r <= f THEN 'train' WHEN r <= f + floor((n - f) * 0.5::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM ranked),
{_sql_training("SELECT id, label, x FROM parted WHERE split = 'train'", configs, GRID_EPOCHS)},
v0 AS MATERIALIZED (SELECT c, id, x FROM parted CROSS JOIN (VALUES {numbers}) n(c) WHERE split = 'val'),
{_sql_lists_forward(f"w{GRID_EPOCHS}", "v0", "v")},
hits AS (SELECT c, avg((list_position(v3.x, list_max(v3.x)) - 1 = label)::INTEGER) AS acc FROM v3 JOIN parted USING (id) GROUP BY c),
losses AS ({_sql_losses([GRID_EPOCHS])}),
runs AS (SELECT k.c, k.rate, k.width, loss, coalesce(acc, 0) AS acc FROM (VALUES {named}) k(c, rate, width) JOIN losses USING (c) LEFT JOIN hits USING (c))
SELECT c::INTEGER AS run_no, rate, width::INTEGER AS width, round(loss, 6) AS train_loss, round(acc, 6) AS val_accuracy,
  acc > 0 AND c = (SELECT arg_max(c, (acc, -c)) FROM runs) AS best FROM runs"""


@register("grid_search", _sql_grid())
def grid_search(spark, sf_dir):
    """3 x 3 learning rates and widths, all runs trained side by side."""
    split = sp.train_val_test(vectors(spark, sf_dir), 0.7, 0.15, 0.15, 42, "vec_id")
    found = tr.grid_search(
        split, "v", "label", "split", GRID_RATES, GRID_WIDTHS, 64, 10, GRID_EPOCHS, start=lambda sizes: tr.to_model(formula_weights(spark, sizes))
    )
    return found.withColumns({c: F.round(c, 6) for c in ("train_loss", "val_accuracy")})


KEYS = ["click", "view", "signup", "error", "purchase"]


@register(
    "run_metrics_pivot",
    f"""SELECT user_id, {", ".join(f"arg_max(value, event_id) FILTER (event_type = '{k}') AS {k}" for k in KEYS)}
FROM events GROUP BY user_id""",
)
def run_metrics_pivot(spark, sf_dir):
    """Users as runs, event types as metric keys, event ids as steps."""
    return rn.last_metrics(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id", "value", KEYS)


@register(
    "best_run",
    """WITH r AS (SELECT event_type, user_id, round(avg(value), 6) AS score FROM events GROUP BY event_type, user_id)
SELECT event_type, arg_max(user_id, (score, -user_id)) AS user_id, max(score) AS score FROM r WHERE score > 0 GROUP BY event_type""",
)
def best_run(spark, sf_dir):
    runs = (
        table(spark, sf_dir, "events")
        .groupBy("event_type", "user_id")
        .agg(F.round(F.avg("value"), 6).alias("score"))
    )
    return rn.best_run(runs, ["event_type"], "user_id", "score")
