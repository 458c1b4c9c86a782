"""Gradients of any model program, operation by operation, as DataFrames.

Each operation's rule is made of the forward operators: an aggregate goes back
over the transposed graph, an endpoint sum to sums by receiver and by sender, a
weighted aggregate also to the dot product of both ends, a dense layer to a sum
of outer products.  Values are sparse: a node without a gradient has no row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import pointwise as P
from tessera.graph import Graph, transpose
from tessera.operators import edges as E
from tessera.operators import nodes as N
from tessera.operators import statistics as T
from tessera.operators import tiling

from . import lower
from . import spec as S
from .spec import ModelSpec
from .training import Adam, _bytes, _drop, _kept, outer_sum

EDGE_VALUES = {S.EDGE_SUM, S.EDGE_MUL, S.EDGE_DOT, S.LEAKY_RELU, S.SOFTMAX}
SCALARS = {S.DEGREES, S.POWER, S.CONSTANT, S.ATTEN}


def trainable(m: ModelSpec) -> set[str]:
    """Names of values that depend on a parameter."""
    out: set[str] = set()
    for op in m.ops:
        if op.weight or out & set(op.inputs):
            out.add(op.out)
    return out


def _total(grads: list[DataFrame]) -> DataFrame:
    """The sum of gradients of one value: vectors, scalars or edge values."""
    if len(grads) == 1:
        return grads[0]
    if "w" in grads[0].columns:
        grads = [g.select("dst", "src", "w") for g in grads]
    every = grads[0]
    for g in grads[1:]:
        every = every.unionByName(g)
    if "w" in every.columns:
        return every.groupBy("dst", "src").agg(F.sum("w").alias("w"))
    if "s" in every.columns:
        return every.groupBy("id").agg(F.sum("s").alias("s"))
    long = every.select("id", F.posexplode("vec").alias("j", "v")).groupBy("id", "j").agg(F.sum("v").alias("v"))
    from tessera.graph import to_vectors

    return to_vectors(long)


def backward(m: ModelSpec, graph: Graph, env: Mapping[str, DataFrame], weights: Mapping[str, list], dims: Mapping[str, int], grad: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda x: x, drawn: Mapping[str, DataFrame] | None = None, tile: int | None = None) -> dict[str, np.ndarray]:
    """The gradient of every parameter, given that of the program's result.
    ``drawn`` has the sampled edges that an aggregate read, repeats included.
    With ``tile`` aggregates go back by tiles of so many receivers, as partial
    sums of the transposed tiles."""
    live, grads, out = trainable(m), {m.result: [grad]}, {}
    made = {op.out: op for op in m.ops}

    def spread(edges: DataFrame, g: DataFrame, width: int) -> DataFrame:
        """The receivers' gradients summed by sender."""
        back = transpose(edges)
        if tile:
            return tiling.tiled_aggregate(back, g, tile, width, "sum", N.WIDE)
        return N.aggregate(Graph(back, unweighted="w" not in back.columns), g, "sum", width)

    def push(name: str, g: DataFrame) -> None:
        if name in live:
            grads.setdefault(name, []).append(g)

    def learn(name: str, g: np.ndarray) -> None:
        out[name] = out.get(name, 0) + g

    for op in reversed(m.ops):
        if op.out not in grads:
            continue
        g = keep(_total(grads.pop(op.out)))
        x = [env.get(i) for i in op.inputs]
        if op.kind == S.FFN:
            w = np.array(weights[op.weight])
            learn(op.weight, outer_sum(x[0], g, *w.shape))
            if op.bias:
                learn(m.biases()[op.weight], column_sums(g, w.shape[1])[None])
            push(op.inputs[0], N.ffn(g, w.T.tolist()))
        elif op.kind == S.AGGREGATE and len(x) == 2:
            width, own = dims[op.inputs[1]], (drawn or {}).get(op.out)
            values = x[0] if own is None else x[0].join(own, ["dst", "src"])
            if op.fn == "mean":
                g = N.row_scale(N.norm(N.degrees(values), -1), g)
            push(op.inputs[1], spread(values.select("dst", "src", "w"), g, width))
            if op.inputs[0] in live:
                if own is not None:
                    push(op.inputs[0], E.sddmm_dot(own, g, x[1]).groupBy("dst", "src").agg(F.sum("w").alias("w")))
                elif made[op.inputs[0]].kind == S.SOFTMAX:
                    # the softmax's gradient reads its output: it travels along, and no join by edge is needed
                    both = E.endpoints(x[0].select("dst", "src", F.col("w").alias("alpha")), g, x[1], "vec")
                    push(op.inputs[0], both.select("dst", "src", P.dot(F.col("l"), F.col("r")).alias("w"), "alpha"))
                else:
                    push(op.inputs[0], E.sddmm_dot(graph.edges, g, x[1]))
        elif op.kind == S.AGGREGATE:
            if op.fn == "max":
                raise ValueError("a maximum has no gradient here")
            own = (drawn or {}).get(op.out, graph.edges)
            if op.fn == "mean":
                g = N.row_scale(N.norm(N.degrees(own), -1), g)
            push(op.inputs[0], spread(own if graph.weighted and "w" in own.columns else own.select("dst", "src"), g, dims[op.inputs[0]]))
        elif op.kind == S.ROW_SCALE:
            push(op.inputs[1], N.row_scale(x[0], g))
        elif op.kind == S.ADD:
            for i in op.inputs:
                push(i, g)
        elif op.kind == S.EPS_SCALE:
            eps = op.value
            if op.weight in weights:
                eps = weights[op.weight][0][0]
                both = x[0].join(g.select("id", F.col("vec").alias("g")), "id")
                learn(op.weight, np.array([[both.agg(F.sum(P.dot(F.col("vec"), F.col("g"))).alias("s")).first().s or 0.0]]))
            push(op.inputs[0], N.pointwise(g, lambda v, eps=eps: P.scale_by_eps(v, eps)))
        elif op.kind == S.RELU:
            gate = g.join(x[0].select("id", F.col("vec").alias("pre")), "id")
            push(op.inputs[0], gate.select("id", F.zip_with("vec", "pre", lambda d, v: F.when(v > 0, d).otherwise(0.0)).alias("vec")))
        elif op.kind == S.ATTEN:
            a = [r[0] for r in weights[op.weight]]
            learn(op.weight, outer_sum(x[0], g.select("id", F.array("s").alias("vec")), len(a), 1))
            push(op.inputs[0], g.select("id", F.transform(F.array(*(F.lit(float(v)) for v in a)), lambda v: v * F.col("s")).alias("vec")))
        elif op.kind == S.EDGE_SUM:
            for i, s in zip(op.inputs, E.sddmm_sum_grad(g), strict=True):
                push(i, s)
        elif op.kind == S.EDGE_MUL:
            for i, s in zip(op.inputs, E.sddmm_mul_grad(g, *x), strict=True):
                push(i, s)
        elif op.kind == S.EDGE_DOT:
            # each end's gradient is an aggregate of the other end's vectors, weighted by the edge's
            push(op.inputs[0], N.aggregate(graph, x[1], "sum", dims[op.inputs[1]], g))
            push(op.inputs[1], N.aggregate(graph, x[0], "sum", dims[op.inputs[0]], transpose(g)))
        elif op.kind == S.LEAKY_RELU:
            before = made.get(op.inputs[0])
            if before and before.kind in (S.EDGE_SUM, S.EDGE_MUL):
                # the value before it again from both ends, instead of a join by edge
                l, r = F.col("l"), F.col("r")
                both = E.endpoints(g.select("dst", "src", "w"), *(env[i] for i in before.inputs)).withColumn("z", l + r if before.kind == S.EDGE_SUM else l * r)
            else:
                both = g.join(x[0].select("dst", "src", F.col("w").alias("z")), ["dst", "src"])
            push(op.inputs[0], both.select("dst", "src", (F.col("w") * F.when(F.col("z") >= 0, 1.0).otherwise(op.value)).alias("w")))
        elif op.kind == S.SOFTMAX:
            push(op.inputs[0], E.softmax_grad(env[op.out], g))
        else:
            raise ValueError(f"no gradient of {op.kind}")
    return out


def column_sums(vectors: DataFrame, width: int) -> np.ndarray:
    """The sum of all vectors."""
    out = np.zeros(width)
    for r in vectors.select(F.posexplode("vec").alias("j", "x")).groupBy("j").agg(F.sum("x").alias("x")).collect():
        out[r.j] = r.x
    return out


def widths(m: ModelSpec, width: int) -> dict[str, int]:
    dims = {"features": width}
    for op in m.ops:
        dims[op.out] = op.out_dim if op.kind == S.FFN else dims.get(op.inputs[-1], width)
    return dims


def loss_gradient(logits: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """Of the mean cross-entropy over the ``n`` labelled nodes."""
    p = N.log_softmax(logits).join(labels, "id")
    return p.select("id", F.transform("vec", lambda x, j: (F.exp(x) - F.when(j == F.col("label"), 1.0).otherwise(0.0)) / n).alias("vec"))


def initial(m: ModelSpec, seed: int = 0) -> dict[str, np.ndarray]:
    """Random weights, biases of zero and every epsilon at its own value."""
    rng = np.random.default_rng(seed)
    eps = {op.weight: op.value for op in m.ops if op.kind == S.EPS_SCALE and op.weight}
    w = {k: np.array([[eps[k]]]) if k in eps else rng.uniform(-1, 1, s) / np.sqrt(s[0]) for k, s in m.weights().items()}
    return w | {bias: np.zeros((1, w[k].shape[1])) for k, bias in m.biases().items()}


def biases_of(m: ModelSpec, weights: Mapping[str, list]) -> dict[str, list]:
    return {k: weights[bias][0] for k, bias in m.biases().items()}


def train(m: ModelSpec, graph: Graph, features: DataFrame, labels: DataFrame, masks: DataFrame, width: int, iterations: int | None = None, rate: float = 0.01, decay: float = 5e-4, seed: int = 0, weights: Mapping[str, list] | None = None, schedule: S.Schedule | None = None, stored: bool = False) -> tuple[dict[str, np.ndarray], list[dict]]:
    """(weights, history) of full-graph training of any program.

    Edges are written once, for every job of every step reads them, unless they are
    ``stored`` already.  Values of a step are written as Parquet, so that forward and backward read
    them and lineage stays short, and deleted when the weights are updated; the
    history has their bytes.  Operations that no parameter reaches are evaluated
    once.  Under a ``schedule`` aggregates are tiled or sampled (backward reads
    the edges that forward drew; ``dynamic`` draws anew in each step, so that
    nothing behind an aggregate is invariant), ``training_subgraph`` reads the
    receptive field of the training nodes for the loss, and accuracy, over the
    whole graph, is made only if ``print_accuracy`` or ``eval`` asks for it."""
    rng, spark = np.random.default_rng(seed), features.sparkSession
    w = initial(m, seed) | {k: np.array(v, dtype=float) for k, v in (weights or {}).items()}
    live, dims, adam, history, paths, held = trainable(m), widths(m, width), Adam(rate, decay), [], [], []
    sample, dynamic = (schedule.kernel_sample, schedule.dynamic) if schedule else (None, False)
    aggregates = [op.out for op in m.ops if op.kind == S.AGGREGATE]
    if not stored:
        graph = graph.with_edges(_kept(graph.edges, "train-edges", held))
    drawn: dict[str, DataFrame] = {}
    if sample and not dynamic:
        drawn = dict.fromkeys(aggregates, _kept(lower.sampled(graph.edges, schedule), "train-drawn", held))
    moving = set(live)
    if sample and dynamic:
        for op in m.ops:
            if op.kind == S.AGGREGATE or moving & set(op.inputs):
                moving.add(op.out)
    fixed: dict[str, DataFrame] = {}
    if schedule is None or schedule.code_motion:
        made = lower.execute(m.with_ops([op for op in m.ops if op.out not in moving]), graph, features, {}, width, schedule=schedule, drawn=drawn)
        fixed = {k: _kept(v, "train-fixed", held) for k, v in made.items() if k != "features"}
    train_ids, test_ids = masks.where("train").select("id"), masks.where("test").select("id")
    own, n = labels.join(train_ids, "id", "left_semi"), train_ids.count()
    rows = train_ids if schedule and schedule.training_subgraph and any(op.hop for op in m.ops) else None
    wanted = schedule is None or schedule.print_accuracy or m.evaluate
    for step in range(1, (iterations or m.iterations) + 1):
        now = {k: v.tolist() for k, v in w.items()}
        if sample and dynamic:
            drawn = {k: _kept(lower.sampled(graph.edges, schedule, rng), "train-drawn", paths) for k in aggregates}

        def forward(of, now=now, drawn=drawn):
            kinds = (S.AGGREGATE, S.FFN, S.SOFTMAX)
            return lower.execute(m, graph, features, now, width, rows=of, known=fixed, biases=biases_of(m, now), schedule=schedule, drawn=drawn, keep=lambda op, df: _kept(df, "train-value", paths) if op.kind in kinds else df)

        env = forward(rows)
        logits = env[m.result]
        row = {"step": step, "loss": float(T.cross_entropy(logits, labels, train_ids).first().loss), "accuracy": None}
        if wanted and step % max(1, m.validation_step) == 0:
            every = logits if rows is None else forward(None)[m.result]
            row["accuracy"] = T.accuracy(every, labels, test_ids).first().accuracy
        w |= adam.update(w, backward(m, graph, env, now, dims, loss_gradient(logits, own, n), lambda g: _kept(g, "train-grad", paths), drawn, schedule.col_tile if schedule else None))
        row["bytes"] = _bytes(spark, paths)
        _drop(spark, paths)
        history.append(row)
    _drop(spark, held)
    return w, history
