"""Neighbourhood aggregates given by the user.

An aggregator says how a value becomes a state, how states of one receiver
become one (in any order and grouping), and what a state results in, each for
whole batches.  Edges are folded by the cells of a grid (``grid.fold``), so that a
receiver sends one state a cell and not one an edge; behind it states come sorted by
receiver and are reduced in one pass that holds one batch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from tessera.graph import Graph
from tessera.operators import grid

#: States of new receivers that a cell collects before it reduces them once more.
HELD = grid.HELD

Matrix = np.ndarray


@dataclass(frozen=True)
class Aggregator:
    """``start``: values (edges x width) to states; ``merge``: states, and where
    each receiver's begin, to one state a receiver; ``finish``: states to results."""

    start: Callable[[Matrix], Matrix]
    merge: Callable[[Matrix, np.ndarray], Matrix]
    finish: Callable[[Matrix], Matrix] = lambda states: states


def _merge_logs(states: Matrix, first: np.ndarray) -> Matrix:
    top, total = np.split(states, 2, axis=1)
    high = np.maximum.reduceat(top, first)
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(states))))
    return np.hstack((high, np.add.reduceat(total * np.exp(top - high[group]), first)))


def _logs(states: Matrix) -> Matrix:
    top, total = np.split(states, 2, axis=1)
    return top + np.log(total)


def _merge_top(states: Matrix, first: np.ndarray, k: int) -> Matrix:
    n, width = len(states), states.shape[1] // k
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
    every = np.repeat(group, k)
    out = np.full((len(first), k, width), -np.inf)
    for j in range(width):
        values = states.reshape(n, k, width)[:, :, j].ravel()
        order = np.lexsort((-values, every))
        place = np.arange(n * k) - (first * k)[every[order]]  # within the group
        some = place < k
        out[every[order][some], place[some], j] = values[order][some]
    return out.reshape(len(first), k * width)


#: log(sum(exp(x))), without overflow.
LOG_SUM_EXP = Aggregator(lambda x: np.hstack((x, np.ones_like(x))), _merge_logs, _logs)
PRODUCT = Aggregator(lambda x: x, lambda states, first: np.multiply.reduceat(states, first))


def top(k: int, missing: float = -np.inf) -> Aggregator:
    """The ``k`` largest values of each column, column vectors one after another;
    ``missing`` where a receiver has fewer edges."""
    return Aggregator(
        lambda x: np.hstack((x, np.full((len(x), (k - 1) * x.shape[1]), -np.inf))),
        lambda states, first: _merge_top(states, first, k),
        lambda states: np.where(np.isneginf(states), missing, states),
    )


def aggregate_by(graph: Graph, vectors: DataFrame, how: Aggregator, weights: DataFrame | None = None, into: DataFrame | None = None) -> DataFrame:
    """(id, vec): ``how`` over the senders' vectors of each receiver (times the
    edge's weight), and over the receiver's own row of ``into``, if it has one."""
    edges = graph.edges if weights is None else weights
    weighted = weights is not None or graph.weighted
    edges = edges.select("dst", "src", *(["w"] if weighted else []))
    states = grid.fold(edges, {"x": vectors}, {}, lambda x, w: how.start(x if w is None else x * w[:, None]), how.merge, grid.side(edges, vectors), HELD)
    if into is not None:

        def started(batches):
            for batch in batches:
                if batch.num_rows:
                    yield grid.batch_of(batch.column(0).to_numpy(), how.start(grid.matrix(batch.column(1))))

        states = states.select("id", "vec").unionByName(into.select("id", "vec").mapInArrow(started, "id long, vec array<double>"))
    return grid.merged(states, how.merge, how.finish)
