"""Full-graph training of the two-layer convolution in closed form.

Every step is a few DataFrame jobs; weights and the optimiser's state are NumPy
arrays on the driver, of the model's size and not the graph's.  The invariant
prefix, the normalised aggregate of the features, is made once and written.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import pointwise as P
from tessera.graph import Graph, transpose
from tessera.operators import grid
from tessera.operators import nodes as N
from tessera.operators import statistics as T
from tessera.operators.edges import sddmm_mul
from tessera.storage import new_path, place


@dataclass
class Adam:
    """The optimiser, with weight decay added to gradients."""

    rate: float = 0.01
    decay: float = 5e-4
    betas: tuple[float, float] = (0.9, 0.999)
    eps: float = 1e-8
    step: int = 0
    state: dict[str, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def update(self, weights: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        self.step += 1
        out = {}
        for k, w in weights.items():
            g = grads[k] + self.decay * w
            m, v = self.state.get(k, (np.zeros_like(w), np.zeros_like(w)))
            m, v = self.betas[0] * m + (1 - self.betas[0]) * g, self.betas[1] * v + (1 - self.betas[1]) * g * g
            self.state[k] = m, v
            out[k] = w - self.rate * (m / (1 - self.betas[0] ** self.step)) / (np.sqrt(v / (1 - self.betas[1] ** self.step)) + self.eps)
        return out


def _kept(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """Written to the shared folder and read again; ``paths`` gets the path, for ``_drop``."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bytes(spark, paths: list[str]) -> int:
    """What the tables at ``paths`` take."""
    return sum(fs.getContentSummary(found).getLength() for fs, found in (place(spark, p) for p in paths))


def _drop(spark, paths: list[str]) -> None:
    """Deletes what a step wrote, once the next no longer reads it."""
    for fs, found in (place(spark, p) for p in paths):
        fs.delete(found, True)
    paths.clear()


def outer_sum(a: DataFrame, b: DataFrame, rows: int, cols: int) -> np.ndarray:
    """The sum over nodes of a[v] b[v]^T: each task adds up one matrix of its nodes
    by products of whole Arrow batches; rows x cols numbers reach the driver."""
    pairs = a.join(b.select("id", F.col("vec").alias("g")), "id").select("vec", "g")

    def run(batches):
        total = np.zeros((rows, cols))
        for batch in batches:
            x, g = (c.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(c), n) for c, n in zip(batch.columns, (rows, cols), strict=True))
            total += x.T @ g
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "v"])

    cells = pairs.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((rows, cols))
    for r in cells.collect():
        out[r.i, r.j] = r.v
    return out


def normalised(graph: Graph) -> DataFrame:
    """Edges weighted by both ends' degrees to the power -1/2."""
    scale = N.norm(N.degrees(graph.edges), -0.5)
    return sddmm_mul(graph.edges, scale, scale)


def train_gcn(graph: Graph, features: DataFrame, labels: DataFrame, masks: DataFrame, dims: tuple[int, int, int], iterations: int, rate: float = 0.01, decay: float = 5e-4, validation_step: int = 1, seed: int = 0, warm_up: int = 4) -> tuple[dict[str, np.ndarray], list[dict]]:
    """(weights, history): loss of every step, accuracy on test nodes at each
    validation step, and seconds; means leave the first ``warm_up`` steps out."""
    f, h, c = dims
    rng = np.random.default_rng(seed)
    w = {"w0": rng.uniform(-1, 1, (f, h)) / np.sqrt(f), "w1": rng.uniform(-1, 1, (h, c)) / np.sqrt(h)}
    edges = _kept(graph.edges.select("dst", "src"), "train-edges")
    back, blocks = transpose(edges), grid.side(edges, features)
    scale = _kept(N.norm(N.degrees(edges), -0.5), "train-scale")

    def summed(along: DataFrame, x: DataFrame) -> DataFrame:
        """Sums over normalised edges: the scales are those of nodes, so that edges need no weights."""
        return N.row_scale(scale, grid.total(along, N.row_scale(scale, x), blocks))

    fixed = _kept(summed(edges, features), "train-prefix")
    train, test = masks.where("train").select("id"), masks.where("test").select("id")
    n = train.count()
    target = labels.join(train, "id", "left_semi")
    adam, history, paths = Adam(rate, decay), [], []
    for step in range(1, iterations + 1):
        began = time.perf_counter()
        hidden = N.ffn(fixed, w["w0"].tolist())
        mixed = _kept(summed(edges, N.pointwise(hidden, P.relu)), "train-hidden", paths)
        logits = N.ffn(mixed, w["w1"].tolist())
        loss = T.cross_entropy(logits, labels, train).first().loss
        both = N.log_softmax(logits).join(target, "id").select("id", F.transform("vec", lambda x: F.exp(x)).alias("p"), "label")
        grad = both.select("id", F.transform("p", lambda p, j: (p - F.when(j == F.col("label"), 1.0).otherwise(0.0)) / n).alias("vec"))
        up = summed(back, N.ffn(grad, w["w1"].T.tolist()))
        gate = up.join(hidden.select("id", F.col("vec").alias("pre")), "id").select("id", F.zip_with("vec", "pre", lambda g, x: F.when(x > 0, g).otherwise(0.0)).alias("vec"))
        grads = {"w1": outer_sum(mixed, grad, h, c), "w0": outer_sum(fixed, gate, f, h)}
        row = {"step": step, "loss": float(loss), "seconds": 0.0, "accuracy": None}
        if step % validation_step == 0:
            row["accuracy"] = T.accuracy(logits, labels, test).first().accuracy
        w = adam.update(w, grads)
        _drop(graph.edges.sparkSession, paths)
        row["seconds"] = time.perf_counter() - began
        history.append(row)
    return w, history


def summary(history: list[dict], warm_up: int = 4) -> dict[str, float]:
    """Mean seconds after the warm-up, the last loss and the best accuracy."""
    timed = [r["seconds"] for r in history if r["step"] > warm_up] or [r["seconds"] for r in history]
    best = [r["accuracy"] for r in history if r["accuracy"] is not None]
    return {"mean_seconds": float(np.mean(timed)), "loss": history[-1]["loss"], "max_accuracy": max(best) if best else float("nan")}
