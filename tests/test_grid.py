"""Folds over a grid of blocks, and what is made of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.graph import Graph
from tessera.operators import grid
from tessera.operators import nodes as N
from tessera.plans import autodiff, lower, training
from tessera.plans import spec as S
from tests.test_graph import NODES, WIDTH, attended, dense, small  # noqa: F401


@pytest.mark.parametrize("kind", [S.EDGE_SUM, S.EDGE_MUL, S.EDGE_DOT])
def test_attention_makes_no_table_of_edges(small, kind):
    """Scores, softmax and aggregate are one fold: no join with edges is left, and results are those of the steps apart."""
    g, x = small
    m = S.model("gat", (WIDTH, 4, 3)) if kind == S.EDGE_SUM else attended(kind)
    w = {k: v.tolist() for k, v in autodiff.initial(m, 3).items()}
    got = lower.run(m, g, x, w, WIDTH)
    apart = lower.execute(m, g, x, w, WIDTH, keep=lambda op, df: df)[m.result]
    np.testing.assert_allclose(dense(got), dense(apart), atol=1e-9)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_wide_vectors_are_folded_by_chunks(spark):
    """A task holds a chunk of a block; nulls are left out, vectors that are null have no edges."""
    e = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (4, 1), (5, 3)], "dst long, src long")
    x = spark.createDataFrame([(1, [1.0, None, 3.0]), (2, [5.0, None, 7.0]), (3, None)], "id long, vec array<double>")
    want = {"sum": ([6.0, None, 10.0], [1.0, None, 3.0]), "mean": ([3.0, None, 5.0], [1.0, None, 3.0]), "max": ([5.0, None, 7.0], [1.0, None, 3.0])}
    for fn, (first, other) in want.items():
        got = N.aggregate(Graph(e), x, fn, 3, chunk=2)
        assert {r.id: r.vec for r in got.collect()} == {0: first, 4: other}
        assert "MapInArrow partial" in got._jdf.queryExecution().executedPlan().toString()


def test_convolution_trains_on_edges_without_weights(small, spark, monkeypatch):
    g, x = small
    kept, own = {}, training._kept
    monkeypatch.setattr(training, "_kept", lambda df, name, paths=None: kept.setdefault(name, df.columns) and own(df, name, paths))
    y = spark.createDataFrame([(i, i % 3) for i in range(NODES)], "id long, label int")
    masks = spark.createDataFrame([(i, i < 8, False, i >= 8) for i in range(NODES)], "id long, train boolean, valid boolean, test boolean")
    training.train_gcn(g, x, y, masks, (WIDTH, 4, 3), 1)
    assert kept["train-edges"] == ["dst", "src"]


def test_cells_send_one_state_a_receiver(spark):
    """Not one an edge, and large node numbers are kept."""
    far = 1 << 40
    e = spark.range(20000, numPartitions=8).select((F.col("id") % 50 + far).alias("dst"), (F.col("id") % 1999).alias("src"))
    x = spark.range(1999).select("id", F.array(F.col("id") * 1.0, F.lit(1.0)).alias("vec"))
    states = grid.fold(e, {"x": x}, {}, lambda x, w: x, grid._sums, 3)
    assert states.count() <= 3 * 50
    got = {r.id - far: r.vec for r in grid.total(e, x, 3).collect()}
    want = np.zeros((50, 2))
    np.add.at(want, np.arange(20000) % 50, np.stack((np.arange(20000) % 1999, np.ones(20000)), 1))
    assert set(got) == set(range(50))
    np.testing.assert_allclose([got[i] for i in range(50)], want)


def test_packed_edges_take_the_bytes_of_their_numbers(spark):
    """Three an edge here, not eight; numbers of any size and sign come back."""
    e = spark.range(20000, numPartitions=2).select((F.col("id") % 50).alias("dst"), (F.col("id") % 1999).alias("src"))
    n, size = grid.packed_edges(e, 3).agg(F.sum("n"), F.sum(F.octet_length("ids"))).first()
    assert n == 20000 and size < 4 * n
    ends = [-(1 << 63), -(1 << 40), -1, 0, 255, 256, 1 << 40, (1 << 63) - 1]
    far = spark.createDataFrame([(a, b) for a in ends for b in ends if a <= b], "dst long, src long")
    x = spark.createDataFrame([(a, [2.0**k]) for k, a in enumerate(ends)], "id long, vec array<double>")
    got = {r.id: r.vec for r in grid.total(far, x, 2).collect()}
    assert got == {a: [float(sum(2**j for j in range(k, len(ends))))] for k, a in enumerate(ends)}


@pytest.mark.parametrize("kind, hidden", [("gat", 8), ("gcn", 65)])
def test_later_layers_have_no_more_blocks(spark, sf, monkeypatch, kind, hidden):
    """Spark's estimate of a layer's output follows the edges; there are as many vectors as nodes."""
    from tessera.sources import tables

    seen, own = [], grid.fold
    monkeypatch.setattr(grid, "fold", lambda *x, **how: seen.append(x[5]) or own(*x, **how))
    x = tables.features(spark, sf)
    monkeypatch.setattr(grid, "BLOCK", 2 * grid._estimate(x))
    m = S.model(kind, (64, hidden, hidden, hidden))
    w = {k: v.tolist() for k, v in autodiff.initial(m, 3).items()}
    lower.run(m, tables.graph(spark, sf), x, w, 64)
    assert len(seen) >= 2 and len(set(seen)) == 1
