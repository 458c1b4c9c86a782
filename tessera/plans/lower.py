"""From a model program to one lazily built DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import pointwise as P
from tessera.graph import Graph, undirected
from tessera.operators import edges as E
from tessera.operators import nodes as N
from tessera.operators import grid, sampling, tiling
from tessera.operators.subgraphs import receptive_field

from . import spec as S
from .spec import ModelSpec, Op, Schedule

Matrix = Sequence[Sequence[float]]
#: Values that one step of coarsening adds to an aggregate's row.
SLICE = 32
#: Functions of both ends that ``grid.attend`` takes.
FUNCTIONS = {S.EDGE_SUM: "sum", S.EDGE_MUL: "mul", S.EDGE_DOT: "dot"}


def execute(m: ModelSpec, graph: Graph, features: DataFrame, weights: Mapping[str, Matrix], width: int, rows: DataFrame | None = None, known: Mapping[str, DataFrame] | None = None, biases: Mapping[str, Sequence[float]] | None = None, schedule: Schedule | None = None, rng: np.random.Generator | None = None, keep: Callable[[Op, DataFrame], DataFrame] | None = None, drawn: Mapping[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Every named value of the program.

    ``rows`` names the nodes whose results are wanted; aggregates that carry a
    hop then read that receptive field only (Spark does not push a semi-join
    through an aggregate).  ``known`` has values made before, such as those of
    invariant operations.  ``schedule`` asks for sampled or tiled aggregates;
    ``keep`` may materialise each value as it is made.  ``drawn`` has the sampled
    edges of aggregates that were drawn before, by the name of their output.
    """
    sample, tile = (schedule.kernel_sample, schedule.col_tile) if schedule else (None, None)
    chunk = SLICE * schedule.coarsen if schedule and schedule.coarsen else N.WIDE
    env: dict[str, DataFrame] = {"features": features, **(known or {})}
    dims = {"features": width}
    hops = max((op.hop for op in m.ops), default=0)
    fields = receptive_field(graph.edges, rows, hops) if rows is not None and hops else []
    for op in m.ops:
        dims[op.out] = op.out_dim if op.kind == S.FFN else dims.get(op.inputs[-1], width)
        if op.out in env:
            continue
        x = [env[i] for i in op.inputs if i != "graph"]
        own = graph.with_edges(fields[op.hop - 1]) if fields and op.hop else graph
        if op.kind == S.DEGREES:
            # sampled aggregates read the same number of edges of every node
            out = N.constant(features, sample) if sample else N.degrees(graph.edges)
        elif op.kind == S.POWER:
            out = N.norm(x[0], op.value)
        elif op.kind == S.CONSTANT:
            out = N.constant(features, op.value)
        elif op.kind == S.ROW_SCALE:
            out = N.row_scale(*x)
        elif op.kind == S.AGGREGATE:
            values = None
            if len(x) == 2:
                values = x[0] if own is graph else x[0].join(own.edges.select("dst", "src"), ["dst", "src"], "left_semi")
            width_in = dims[op.inputs[-1]]
            if sample:
                if drawn and op.out in drawn:
                    edges = drawn[op.out]
                    own = own.with_edges(edges if own is graph else edges.join(own.edges.select("dst").distinct(), "dst", "left_semi"))
                else:
                    own = own.with_edges(sampled(own.edges, schedule, rng))
                values = values.join(own.edges, ["dst", "src"]) if values is not None else None
            attended = None if sample or tile or keep or fields or op.fn != "sum" or width_in > N.WIDE else attention(m, op, known or {})
            if attended:
                kind, slope, ends = attended
                left, right = (env[i] if kind == S.EDGE_DOT else env[i].select("id", F.array("s").alias("vec")) for i in ends)
                blocks = grid.side(graph.edges, features, times=max(1.0, width_in / width))
                out = grid.attend(graph.edges, left, right, x[-1], FUNCTIONS[kind], slope, E.CLAMP, E.SEED, blocks)
            elif tile:
                edges = own.edges if own.weighted else own.edges.select("dst", "src")
                out = tiling.tiled_aggregate(edges if values is None else values.select("dst", "src", "w"), x[-1], tile, width_in, op.fn, chunk)
            else:
                edges = own.edges if values is None else values
                blocks = grid.side(edges, features, -(-width_in // chunk), max(1.0, width_in / width)) if width_in > chunk else None
                out = N.aggregate(own, x[-1], op.fn, width_in, values, chunk, blocks)
        elif op.kind == S.FFN:
            out = N.ffn(x[0], weights[op.weight], (biases or {}).get(op.weight))
        elif op.kind == S.ADD:
            out = N.add(*x)
        elif op.kind == S.EPS_SCALE:
            eps = weights[op.weight][0][0] if op.weight in weights else op.value
            out = N.pointwise(x[0], lambda v, eps=eps: P.scale_by_eps(v, eps))
        elif op.kind == S.RELU:
            out = N.pointwise(x[0], P.relu)
        elif op.kind == S.ATTEN:
            out = N.project_to_scalar(x[0], [r[0] for r in weights[op.weight]])
        elif op.kind == S.EDGE_SUM:
            out = E.sddmm_sum(graph.edges, *x)
        elif op.kind == S.EDGE_MUL:
            out = E.sddmm_mul(graph.edges, *x)
        elif op.kind == S.EDGE_DOT:
            out = E.sddmm_dot(graph.edges, *x)
        elif op.kind == S.LEAKY_RELU:
            out = E.leaky_relu(x[0], op.value)
        elif op.kind == S.SOFTMAX:
            out = E.softmax(x[0])
        else:
            raise ValueError(f"no such operation: {op.kind}")
        env[op.out] = keep(op, out) if keep else out
    return env


def attention(m: ModelSpec, op: Op, known: Mapping[str, DataFrame]) -> tuple[str, float | None, tuple[str, ...]] | None:
    """The edge function, the slope of its activation and the ends' values, where
    ``op`` aggregates by a softmax of these that is not made yet: weights of edges are
    then no table of their own."""
    made = {o.out: o for o in m.ops}
    weight = made.get(op.inputs[0]) if len(op.inputs) == 2 else None
    if weight is None or weight.kind != S.SOFTMAX or weight.out in known:
        return None
    score, slope = made.get(weight.inputs[0]), None
    if score is not None and score.kind == S.LEAKY_RELU and score.out not in known:
        score, slope = made.get(score.inputs[0]), score.value
    if score is None or score.kind not in FUNCTIONS or score.out in known:
        return None
    return score.kind, slope, score.inputs


def sampled(edges: DataFrame, schedule: Schedule, rng: np.random.Generator | None = None) -> DataFrame:
    """The edges an aggregate with in-kernel sampling reads; repeats stay."""
    if schedule.dynamic:
        return sampling.dynamic(edges, schedule.kernel_sample, rng or np.random.default_rng()).select("dst", "src")
    return sampling.affine(edges, schedule.kernel_sample).select("dst", "src")


def prepare(graph: Graph, schedule: Schedule) -> Graph:
    """The graph as a schedule wants it: mirrored, without weights, sampled once."""
    edges = graph.edges
    if schedule.undirected and not graph.undirected:
        edges = undirected(edges)
    if schedule.unweighted:
        edges = edges.select("dst", "src")
    if schedule.data_sample:
        edges = sampling.affine(edges, schedule.data_sample).select("dst", "src")
    return Graph(edges, schedule.undirected, schedule.unweighted, schedule.sparse)


def run_program(m: ModelSpec, graph: Graph, features: DataFrame, weights: Mapping[str, Matrix], width: int, rng: np.random.Generator | None = None, **how) -> DataFrame:
    """A parsed program under its own schedule."""
    return run(m, prepare(graph, m.schedule), features, weights, width, schedule=m.schedule, rng=rng, **how)


def run(m: ModelSpec, graph: Graph, features: DataFrame, weights: Mapping[str, Matrix], width: int, **how) -> DataFrame:
    """The program's result as vectors; of ``rows`` only, if these are given."""
    out = execute(m, graph, features, weights, width, **how)[m.result]
    rows = how.get("rows")
    return out if rows is None else out.join(rows.select("id").distinct(), "id", "left_semi")
