"""Programs of the model language from text to results.

A program's dataset is loaded by name, its open sizes and (for ``opt_input``)
its schedule follow from the data, the rewrites that the schedule allows are
made, and it is trained and evaluated under that schedule.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.graph import Graph
from tessera.sources import npy

from . import autodiff, dsl, lower, rewrites
from . import schedule as schedules
from .spec import ModelSpec
from .training import _kept

Dataset = tuple[Graph, DataFrame, DataFrame, DataFrame]
Loader = Callable[[SparkSession], Dataset]


@dataclass(frozen=True)
class Outcome:
    """A program as it ran, its weights, one row of history for each step (loss,
    accuracy, bytes kept), and the evaluated vectors of all nodes, or None."""

    spec: ModelSpec
    weights: dict[str, np.ndarray]
    history: list[dict]
    result: DataFrame | None

    def steps(self, spark: SparkSession) -> DataFrame:
        """(step, loss, accuracy, bytes); accuracy is null where the program asks
        for none, bytes where ``print_memory`` is not set."""
        memory = self.spec.schedule.print_memory
        rows = [(r["step"], r["loss"], r["accuracy"], r["bytes"] if memory else None) for r in self.history]
        return spark.createDataFrame(rows, "step int, loss double, accuracy double, bytes long")


def load(spark: SparkSession, name: str, datasets: Mapping[str, Loader]) -> Dataset:
    """A registered dataset, or the NumPy files of the folder that ``name`` is."""
    if name in datasets:
        return datasets[name](spark)
    if "/" not in name:
        raise dsl.DslError(f"no such dataset: {name}")
    folder = name.rstrip("/")
    return npy.load(spark, folder)


def fitted(m: ModelSpec, features: DataFrame, labels: DataFrame) -> ModelSpec:
    """The program with the sizes of its data; sizes it states must agree."""
    first = features.select(F.size("vec").alias("n")).first()
    width, classes = (first.n if first else 0), (labels.agg(F.max("label").alias("m")).first().m or 0) + 1
    given = m.schedule
    if given.feature_size not in (None, width):
        raise ValueError(f"feature_size is {given.feature_size}, the data have {width}")
    if given.label_size is not None and given.label_size < classes:
        raise ValueError(f"label_size is {given.label_size}, the data have {classes} labels")
    s = replace(given, feature_size=width, label_size=given.label_size or classes)
    return replace(m.sized(s.feature_size, s.label_size), schedule=s)


def tuned(m: ModelSpec, edges: DataFrame, nodes: DataFrame) -> ModelSpec:
    """The program under the schedule that the statistics of ``edges`` call for:
    mirrored, without weights, and in column tiles where the graph is dense."""
    plan = schedules.choose(edges, nodes)
    return replace(m, schedule=replace(m.schedule, undirected=True, unweighted=True, coarsen=2, col_tile=plan.col_tile))


def run(spark: SparkSession, text: str, datasets: Mapping[str, Loader], weights: Callable[[ModelSpec], Mapping[str, list]] | None = None, rate: float = 0.01, decay: float = 5e-4, seed: int = 0) -> list[Outcome]:
    """An outcome for each model that the text builds.  ``weights`` gives the
    first weights of a program; they are random without it."""
    out = []
    for m in dsl.parse(text):
        graph, features, labels, masks = load(spark, m.dataset, datasets)
        m = fitted(m, features, labels)
        if m.schedule.opt_input:
            seen = graph, features
            if m.schedule.opt_input != m.dataset:
                seen = load(spark, m.schedule.opt_input, datasets)[:2]
            m = tuned(m, seen[0].edges, seen[1])
        ready = lower.prepare(graph, m.schedule)
        plan = rewrites.optimise(m, training=m.iterations > 0)
        w = autodiff.initial(plan, seed) | {k: np.array(v, dtype=float) for k, v in (weights(m) if weights else {}).items()}
        history: list[dict] = []
        if m.iterations:
            ready = ready.with_edges(_kept(ready.edges, "program-edges"))
            w, history = autodiff.train(plan, ready, features, labels, masks, m.schedule.feature_size, rate=rate, decay=decay, seed=seed, weights=w, schedule=m.schedule, stored=True)
        result = None
        if m.evaluate:
            now = {k: v.tolist() for k, v in w.items()}
            result = lower.run(plan, ready, features, now, m.schedule.feature_size, biases=autodiff.biases_of(plan, now), schedule=m.schedule, rng=np.random.default_rng(seed))
        out.append(Outcome(plan, w, history, result))
    return out
