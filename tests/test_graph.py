"""Properties of operators, rewrites, the parser, sources and training, on small graphs."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import skew
from tessera.functions import pointwise as P
from tessera.graph import Graph, to_long, to_vectors, transpose
from tessera.operators import edges as E
from tessera.operators import adjacency, aggregators, generate, reorder, sampling, statistics, subgraphs, tiling
from tessera.operators import nodes as N
from tessera.plans import autodiff, dsl, lower, programs, rewrites, schedule, training
from tessera.plans import spec as S
from tessera.queries import BODIES, PROGRAM, bind
from tessera.sources import matrix_market, npy
from tessera.sources import tables as D
from tests.plans import small_partitions, split_joins

RNG = np.random.default_rng(5)
NODES, WIDTH = 12, 6
ADJ = (RNG.random((NODES, NODES)) < 0.3) | np.eye(NODES, dtype=bool)
X = RNG.normal(size=(NODES, WIDTH))


@pytest.fixture(scope="module")
def small(spark):
    e = spark.createDataFrame([(int(d), int(s)) for d, s in zip(*np.nonzero(ADJ), strict=True)], "dst long, src long")
    x = spark.createDataFrame([(i, X[i].tolist()) for i in range(NODES)], "id long, vec array<double>")
    return Graph(e), x


def dense(vectors):
    out = np.zeros((NODES, len(vectors.first().vec)))
    for r in vectors.collect():
        out[r.id] = r.vec
    return out


def weights(m, seed=0):
    rng = np.random.default_rng(seed)
    return {k: rng.normal(size=shape).tolist() for k, shape in m.weights().items()}


def numpy_model(m, w):
    """The program on matrices."""
    env = {"features": X}
    a = ADJ.astype(float)
    for op in m.ops:
        x = [env[i] for i in op.inputs if i != "graph"]
        if op.kind == S.DEGREES:
            out = a.sum(1)
        elif op.kind == S.POWER:
            out = x[0] ** op.value
        elif op.kind == S.ROW_SCALE:
            out = x[0][:, None] * x[1]
        elif op.kind == S.AGGREGATE:
            out = (x[0] if len(x) == 2 else a) @ x[-1] / (a.sum(1)[:, None] if op.fn == "mean" else 1)
        elif op.kind == S.FFN:
            out = x[0] @ np.array(w[op.weight])
        elif op.kind == S.ADD:
            out = x[0] + x[1]
        elif op.kind == S.EPS_SCALE:
            out = (1 + (np.array(w[op.weight])[0, 0] if op.weight in w else op.value)) * x[0]
        elif op.kind == S.RELU:
            out = np.maximum(x[0], 0)
        elif op.kind == S.ATTEN:
            out = x[0] @ np.array(w[op.weight])[:, 0]
        elif op.kind == S.EDGE_SUM:
            out = (x[0][:, None] + x[1][None]) * a
        elif op.kind == S.EDGE_MUL:
            out = np.outer(x[0], x[1]) * a
        elif op.kind == S.EDGE_DOT:
            out = (x[0] @ x[1].T) * a
        elif op.kind == S.LEAKY_RELU:
            out = np.where(x[0] >= 0, x[0], op.value * x[0])
        elif op.kind == S.SOFTMAX:
            e = np.exp(x[0]) * a
            out = e / (e.sum(1, keepdims=True) + 1e-12)
        env[op.out] = out
    return env[m.result]


@pytest.mark.parametrize("kind", sorted(S.LAYERS))
@pytest.mark.parametrize("dims", [(WIDTH, 3, 2), (WIDTH, 9, 2)])
def test_rewrites_keep_results(small, kind, dims):
    g, x = small
    m = S.model(kind, dims)
    w = weights(m)
    want = numpy_model(m, w)
    for f in (lambda p: p, rewrites.optimise, rewrites.reorder, lambda p: rewrites.fuse_scales(rewrites.reorder(p)), rewrites.recompute, rewrites.hoist):
        got = dense(lower.run(f(m), g, x, w, WIDTH))
        np.testing.assert_allclose(got, want, atol=1e-9)
    rows = x.where("id in (1, 4)")
    some = lower.run(rewrites.restrict(rewrites.optimise(m)), g, x, w, WIDTH, rows=rows).collect()
    assert sorted(r.id for r in some) == [1, 4]
    for r in some:
        np.testing.assert_allclose(r.vec, want[r.id], atol=1e-9)


def test_reorder_moves_by_width():
    kinds = lambda m: [op.kind for op in m.ops]
    narrow, wide = S.model("gcn", (6, 2)), S.model("gcn", (2, 6))
    assert kinds(rewrites.reorder(narrow)).index(S.FFN) < kinds(rewrites.reorder(narrow)).index(S.AGGREGATE)
    assert kinds(rewrites.reorder(wide)).index(S.FFN) > kinds(rewrites.reorder(wide)).index(S.AGGREGATE)
    biased = narrow.with_ops([op if op.kind != S.FFN else S.Op(**{**op.__dict__, "bias": True}) for op in narrow.ops])
    assert rewrites.reorder(biased) == biased


def test_hoist_marks_what_no_weight_reaches():
    m = rewrites.hoist(S.model("gcn", (6, 3, 2)))
    assert [op.kind for op in m.ops if op.invariant][:2] == [S.DEGREES, S.POWER]
    assert not any(op.invariant for op in m.ops if op.kind in (S.FFN, S.RELU))


def test_softmax_sums_to_one(small):
    g, x = small
    w = g.edges.withColumn("w", F.col("dst") - F.col("src") * 0.5)
    for stable in (False, True):
        sums = E.edge_to_node(E.softmax(w, stable)).collect()
        assert all(abs(r.s - 1) < 1e-9 for r in sums)


def test_transpose_twice_and_permutation(small):
    g, x = small
    same = lambda a, b: tuple(reorder.same_edges(a, b).first()) == (0, 0)
    assert same(transpose(transpose(g.edges)), g.edges)
    perm = reorder.reversed_order(x, NODES)
    there = reorder.permute(g.edges, perm)
    assert same(reorder.permute(there, perm.select(F.col("new").alias("old"), F.col("old").alias("new"))), g.edges)
    moved = dense(N.aggregate(Graph(there), reorder.permute_nodes(x, perm), "sum", WIDTH))
    np.testing.assert_allclose(moved[::-1], ADJ @ X, atol=1e-9)


def test_tiles_and_layouts_agree(small):
    g, x = small
    for size in (1, 5, 100):
        np.testing.assert_allclose(dense(tiling.tiled_aggregate(g.edges, x, size, WIDTH)), ADJ @ X, atol=1e-9)
    np.testing.assert_allclose(dense(N.aggregate(g, x)), ADJ @ X, atol=1e-9)
    np.testing.assert_allclose(dense(to_vectors(to_long(x, None))), X)


def test_sampling_handles_low_degrees(spark):
    e = spark.createDataFrame([(0, 3), (1, 1), (1, 2)], "dst long, src long")
    got = sampling.shuffled(e, 5).groupBy("dst", "src").count().collect()
    assert {(r.dst, r.src): r["count"] for r in got}[(0, 3)] == 5
    assert sampling.affine(e.limit(0), 4).count() == 0


def test_receptive_field(small):
    g, x = small
    one, two = subgraphs.receptive_field(g.edges, x.where("id = 0"), 2)
    assert {r.src for r in one.collect()} == set(np.flatnonzero(ADJ[0]).tolist())
    assert {r.dst for r in two.collect()} == set(np.flatnonzero(ADJ[0]).tolist())


def test_pointwise_edges_of_domains(spark):
    df = spark.sql("SELECT CAST(x AS DOUBLE) AS x FROM VALUES (0), (-1), (4) AS t(x)")
    got = df.select(P.inverse_root(F.col("x")).alias("a"), P.reciprocal(F.col("x")).alias("b"), P.relu(F.col("x")).alias("c")).collect()
    assert [tuple(r) for r in got] == [(None, None, 0.0), (None, -1.0, 0.0), (0.5, 0.25, 4.0)]


def test_generators(spark):
    e = generate.rmat(spark, 6, 500)
    assert e.count() == e.distinct().count() and e.agg(F.max("dst"), F.max("src")).first()[0] < 64
    pts = RNG.random((200, 2)) - 0.5
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "id long, x double, y double")
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero((d < 0.1) & ~np.eye(200, dtype=bool)), strict=True)}
    assert {(r.dst, r.src) for r in generate.radius_edges(df, 0.1).collect()} == want


@pytest.mark.parametrize("kind", sorted(BODIES))
def test_parsed_programs(small, kind):
    g, x = small
    text = PROGRAM.replace("feature_size(64)", f"feature_size({WIDTH})").format(fn="mul_mean" if kind == "sage" else "sum", body=BODIES[kind])
    m = dsl.parse(text)[0]
    assert (m.dataset, m.iterations, m.evaluate, m.schedule.coarsen) == ("derived", 1, True, 2)
    w = bind(m)
    np.testing.assert_allclose(dense(lower.run(m, g, x, w, WIDTH)), numpy_model(m, w), atol=1e-9)


def test_parser_options_and_errors():
    head = 'G = load_dataset("x");\n'
    layer = "L = layer(G, hs) { %s }\nM = model(G) { l1 = L(G, 4); l2 = L(l1, G.labels.size()); }\nm = M(G);\nm.train(iters=3, validation_step=2);\n"
    tail = "G=G.sample(5); A=dsl.get_aggregate(fn=dsl.fn.sum); A=A.sample(20).dynamic(); G=G.col_tile(10); feature_size(8); label_size(3); print_accuracy(true); operator_reordering(false); # note\n"
    m = dsl.parse(head + layer % "res = dsl.nn.ffn(G.node.feats, out=hs); G.node.feats = res;" + tail)[0]
    s = m.schedule
    assert (s.data_sample, s.kernel_sample, s.dynamic, s.col_tile, s.print_accuracy, s.reordering) == (5, 20, True, 10, True, False)
    assert (m.iterations, m.validation_step) == (3, 2)
    assert list(m.weights().values()) == [(8, 4), (4, 3)]
    for bad in ("res = a - b;", "res = a / b;"):
        with pytest.raises(dsl.DslError, match="no operation"):
            dsl.parse(head + layer % bad + tail)
    with pytest.raises(dsl.DslError, match="rez is never set"):
        dsl.parse(head + layer % "res = dsl.nn.ffn(G.node.feats, out=hs); G.node.feats = rez;" + tail)
    with pytest.raises(dsl.DslError, match="attention weights need a vector"):
        dsl.parse(head + layer % "d = G.graphs.degrees(); res = dsl.nn.init_weight() * d;" + tail)
    with pytest.raises(dsl.DslError, match="schedule"):
        dsl.parse(head)
    with pytest.raises(dsl.DslError, match="line 1"):
        dsl.parse("G = load_dataset(")


def test_matrix_market(spark, tmp_path):
    def file(name, text):
        (tmp_path / name).write_text(text)
        return f"file://{tmp_path / name}"

    rows = lambda p: sorted(map(tuple, matrix_market.read(spark, p).collect()))
    assert rows(file("a.mtx", "%%MatrixMarket matrix coordinate real general\n% c\n3 3 2\n1 2 0.5\n3 1 -2\n")) == [(0, 1, 0.5), (2, 0, -2.0)]
    assert rows(file("b.mtx", "%%MatrixMarket matrix coordinate pattern symmetric\n2 2 2\n1 1\n2 1\n")) == [(0, 0, 1.0), (0, 1, 1.0), (1, 0, 1.0)]
    assert rows(file("c.mtx", "%%MatrixMarket matrix coordinate integer skew-symmetric\n2 2 1\n2 1 3\n")) == [(0, 1, -3.0), (1, 0, 3.0)]
    assert rows(file("d.mtx", "%%MatrixMarket matrix array real general\n2 2\n1\n2\n3\n4\n")) == [(0, 0, 1.0), (0, 1, 3.0), (1, 0, 2.0), (1, 1, 4.0)]
    for n in (1, 2, 3, 7, 40):
        for kind, sign, k in (("symmetric", 1, 0), ("skew-symmetric", -1, 1)):
            cells = [(r, c) for c in range(n) for r in range(c + k, n)]
            values = {x: float(i + 1) for i, x in enumerate(cells)}
            text = f"%%MatrixMarket matrix array real {kind}\n% packed\n{n} {n}\n" + "".join(f"{values[x]}\n" for x in cells)
            want = values | {(c, r): sign * v for (r, c), v in values.items() if r != c}
            assert rows(file(f"{kind}{n}.mtx", text)) == sorted((*x, v) for x, v in want.items())
    big = 3_000_000  # places beyond what a double holds exactly
    row, col = matrix_market.unpacked(F.col("k"), big, False)
    for c in (0, 1, 77, big // 2, big - 2, big - 1):
        first = c * big - c * (c - 1) // 2
        for k, want in ((first, (c, c)), (first + big - c - 1, (big - 1, c))):
            assert tuple(spark.createDataFrame([(k,)], "k long").select(row, col).first()) == want
    with pytest.raises(matrix_market.MatrixMarketError):
        matrix_market.read(spark, file("g.mtx", "%%MatrixMarket matrix array real symmetric\n2 2\n1\n2\n"))
    with pytest.raises(matrix_market.MatrixMarketError):
        matrix_market.read(spark, file("e.mtx", "%%MatrixMarket matrix coordinate complex general\n1 1 0\n"))


def test_npy_dataset(spark, tmp_path):
    folder = f"file://{tmp_path}/set"
    (tmp_path / "set").mkdir()
    save = lambda array, name: np.save(tmp_path / "set" / name, array)
    dst, src = np.nonzero(ADJ)
    save(np.concatenate(([NODES, NODES], dst)).astype(np.uint32), "Adj_src.npy")
    save(src.astype(np.uint32), "Adj_dst.npy")
    save(X.astype(np.float32), "Feat.npy")
    for k, name in enumerate(("TnMsk", "VlMsk", "TsMsk")):
        save((np.arange(NODES) % 3 == k).astype(np.int32), f"{name}.npy")
    assert {(r.dst, r.src) for r in npy.edges(spark, folder).collect()} == set(zip(dst.tolist(), src.tolist(), strict=True))
    np.testing.assert_allclose(dense(npy.vectors(spark, f"{folder}/Feat.npy")), X, atol=1e-6)
    assert npy.masks(spark, folder).where("valid").count() == 4


def test_training_follows_the_gradient(spark, small):
    g, x = small
    y = spark.createDataFrame([(i, i % 3) for i in range(NODES)], "id long, label int")
    m = x.select("id", (F.col("id") < 9).alias("train"), F.lit(False).alias("valid"), (F.col("id") >= 9).alias("test"))
    w, history = training.train_gcn(g, x, y, m, (WIDTH, 4, 3), 3, rate=0.05, decay=0.0, seed=1)
    a = ADJ / np.sqrt(np.outer(ADJ.sum(1), ADJ.sum(1)))

    def forward(w0, w1):
        z = a @ np.maximum(a @ X @ w0, 0) @ w1
        p = z - np.log(np.exp(z).sum(1, keepdims=True))
        return -p[np.arange(9), np.arange(9) % 3].mean()

    rng = np.random.default_rng(1)
    w0, w1 = rng.uniform(-1, 1, (WIDTH, 4)) / np.sqrt(WIDTH), rng.uniform(-1, 1, (4, 3)) / 2
    adam, eps = training.Adam(0.05, 0.0), 1e-6
    ws = {"w0": w0, "w1": w1}
    for h in history:
        assert abs(h["loss"] - forward(ws["w0"], ws["w1"])) < 1e-9
        grads = {}
        for k in ws:
            grads[k] = np.zeros_like(ws[k])
            for i in np.ndindex(ws[k].shape):
                up, down = {**ws}, {**ws}
                up[k], down[k] = ws[k].copy(), ws[k].copy()
                up[k][i] += eps
                down[k][i] -= eps
                grads[k][i] = (forward(**up) - forward(**down)) / (2 * eps)
        ws = adam.update(ws, grads)
    np.testing.assert_allclose(w["w0"], ws["w0"], atol=1e-5)
    assert 0 <= training.summary(history)["max_accuracy"] <= 100


def test_schedule(small):
    g, x = small
    p = schedule.choose(g.edges, x)
    assert (p.nodes, p.edges) == (NODES, int(ADJ.sum())) and p.col_tile == 2 and not p.fuse


def test_streamed_degrees(spark, tmp_path):
    from tessera.streaming.edges import windowed_degrees

    schema = "ts timestamp, dst long, src long"
    spark.createDataFrame([(1, 2, 60), (1, 3, 61), (2, 3, 4000)], "dst long, src long, t long").select(F.timestamp_seconds("t").alias("ts"), "dst", "src").write.parquet(str(tmp_path / "in"))
    q = windowed_degrees(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("degrees_stream").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.id, r.s) for r in spark.table("degrees_stream").collect()) == [(1, 2), (2, 1)]


@pytest.mark.parametrize("kind", sorted(S.LAYERS))
def test_gradients_of_every_model(spark, small, kind):
    from tessera.plans import autodiff

    g, x = small
    m = S.model(kind, (WIDTH, 4, 3))
    w = {k: np.array(v) for k, v in weights(m, 2).items()}
    y = spark.createDataFrame([(i, i % 3) for i in range(9)], "id long, label int")

    def loss(w):
        z = numpy_model(m, w)[:9]
        p = z - np.log(np.exp(z).sum(1, keepdims=True))
        return -p[np.arange(9), np.arange(9) % 3].mean()

    now = {k: v.tolist() for k, v in w.items()}
    env = lower.execute(m, g, x, now, WIDTH, keep=lambda op, d: training._kept(d, "t-value"))
    got = autodiff.backward(m, g, env, now, autodiff.widths(m, WIDTH), autodiff.loss_gradient(env[m.result], y, 9), lambda d: training._kept(d, "t-grad"))
    assert set(got) == set(w)
    for k in w:
        for i in [(0, 0), (w[k].shape[0] - 1, w[k].shape[1] - 1)]:
            up, down = {**w, k: w[k].copy()}, {**w, k: w[k].copy()}
            up[k][i] += 1e-6
            down[k][i] -= 1e-6
            assert abs(got[k][i] - (loss(up) - loss(down)) / 2e-6) < 1e-6


def labelled(spark, x):
    y = spark.createDataFrame([(i, i % 3) for i in range(NODES)], "id long, label int")
    return y, x.select("id", (F.col("id") < 4).alias("train"), F.lit(False).alias("valid"), (F.col("id") >= 9).alias("test"))


def loss_of(z, rows):
    z = z[rows]
    p = z - np.log(np.exp(z).sum(1, keepdims=True))
    return -p[np.arange(len(rows)), np.array(rows) % 3].mean()


@pytest.mark.parametrize("kind", ["gat", "gcn", "gin"])
def test_training_by_schedule(spark, small, kind):
    """Receptive fields, tiles and code motion change no weight and no loss."""
    g, x = small
    y, masks = labelled(spark, x)
    m = S.model(kind, (WIDTH, 4, 3))
    plain, history = autodiff.train(m, g, x, y, masks, WIDTH, 2)
    s = S.Schedule(col_tile=5, training_subgraph=True, code_motion=kind != "gin", print_accuracy=True)
    tuned, again = autodiff.train(rewrites.restrict(m), g, x, y, masks, WIDTH, 2, schedule=s)
    for k in plain:
        np.testing.assert_allclose(tuned[k], plain[k], atol=1e-9)
    for k in ("loss", "accuracy"):
        assert [r[k] for r in again] == pytest.approx([r[k] for r in history])
    assert again[0]["bytes"] > 0
    if kind == "gin":
        assert abs(plain["eps0"][0, 0] - 1.0) > 1e-4  # it is learned


def test_training_on_sampled_edges(spark, small):
    """Backward reads the edges that forward drew, each as often."""
    g, x = small
    y, masks = labelled(spark, x)
    b = S.Builder()
    out = b.add(S.FFN, b.add(S.AGGREGATE, b.add(S.RELU, b.add(S.FFN, "features", weight="w0", in_dim=WIDTH, out_dim=4))), weight="w1", in_dim=4, out_dim=3)
    m = S.ModelSpec(tuple(b.ops), out).biased()
    w = autodiff.initial(m, 3) | {"w0_bias": np.full((1, 4), 0.1)}
    a = np.zeros((NODES, NODES))
    for r in sampling.affine(g.edges, 3).collect():
        a[r.dst, r.src] += 1
    forward = lambda w: a @ np.maximum(X @ w["w0"] + w["w0_bias"], 0) @ w["w1"] + w["w1_bias"]
    rows = list(range(4))
    grads = {}
    for k in w:
        grads[k] = np.zeros_like(w[k])
        for i in np.ndindex(w[k].shape):
            up, down = {**w, k: w[k].copy()}, {**w, k: w[k].copy()}
            up[k][i] += 1e-6
            down[k][i] -= 1e-6
            grads[k][i] = (loss_of(forward(up), rows) - loss_of(forward(down), rows)) / 2e-6
    want = training.Adam(0.01, 5e-4).update(w, grads)
    got, history = autodiff.train(m, g, x, y, masks, WIDTH, 1, weights=w, schedule=S.Schedule(kernel_sample=3))
    assert history[0]["loss"] == pytest.approx(loss_of(forward(w), rows)) and history[0]["accuracy"] is None
    for k in w:
        np.testing.assert_allclose(got[k], want[k], atol=1e-5)
    moved, _ = autodiff.train(m, g, x, y, masks, WIDTH, 2, weights=w, schedule=S.Schedule(kernel_sample=3, dynamic=True))
    assert all(np.isfinite(v).all() for v in moved.values())


@pytest.mark.parametrize("fn", ["sum", "mean", "max"])
@pytest.mark.parametrize("wide", [64, 2])
def test_tiles_of_every_aggregate(small, fn, wide):
    g, x = small
    weighted = g.edges.withColumn("w", (F.col("dst") * 3 + F.col("src") * 5) % 7 + 1.0)
    for edges in (g.edges, weighted):
        own = Graph(edges, unweighted="w" not in edges.columns)
        np.testing.assert_allclose(dense(tiling.tiled_aggregate(edges, x, 5, WIDTH, fn, wide)), dense(N.aggregate(own, x, fn, WIDTH)), atol=1e-9)


def test_programs_from_text(spark, small):
    g, x = small
    y, masks = labelled(spark, x)
    data = {"derived": lambda s: (g, x, y, masks)}
    text = PROGRAM.replace("feature_size(64);\nlabel_size(10);\n", "print_memory(true);\n").format(fn="mul_sum", body=BODIES["gcn"])
    text = text.replace("L(G, 8, non_ln, ", "L(G, G.labels.size(), null, ")
    done = programs.run(spark, text, data)[0]
    assert list(done.spec.weights().values()) == [(WIDTH, 3)] and len(done.history) == 1
    row = done.steps(spark).first()
    assert row.bytes > 0 and row.accuracy is not None  # eval() asks for it
    assert done.result.count() == NODES
    quiet = programs.run(spark, text.replace("r = m.eval();", "").replace("print_memory(true);", ""), data)[0]
    row = quiet.steps(spark).first()
    assert (row.bytes, row.accuracy, quiet.result) == (None, None, None)
    with pytest.raises(ValueError, match="feature_size"):
        programs.run(spark, text + "feature_size(99);", data)
    with pytest.raises(dsl.DslError, match="no such dataset"):
        programs.run(spark, text, {})


def test_rmat_against_its_hashes(spark):
    """Every edge descends by the draws that the docstring states."""
    import xxhash

    scale, n, seed = 6, 300, 27491095

    def draw(i, level):
        h = 42
        for value, size in ((i, 8), (level, 4), (seed, 4)):
            h = xxhash.xxh64(value.to_bytes(size, "little"), seed=h).intdigest()
        return (h % (1 << 30)) / (1 << 30)

    want = set()
    for i in range(n):
        dst = src = 0
        for level in range(scale):
            u = draw(i, level)
            quadrant = 0 if u < 0.57 else 1 if u < 0.57 + 0.19 else 2 if u < 0.57 + 0.19 + 0.19 else 3
            dst, src = dst * 2 + quadrant // 2, src * 2 + quadrant % 2
        want |= {(dst, src), (src, dst)}
    assert sorted((r.dst, r.src) for r in generate.rmat(spark, scale, n, mirrored=True).collect()) == sorted(want)


# adjacency rows


def hub_graph(spark, n=3000):
    """A receiver of n edges, one of a few, and n of one each."""
    hub = spark.range(n).select(F.lit(0).cast("long").alias("dst"), (F.col("id") * 7 % 10007).alias("src"))
    few = spark.range(5).select(F.lit(1).cast("long").alias("dst"), F.col("id").alias("src"))
    return hub.unionByName(few).unionByName(spark.range(2, n).select(F.col("id").alias("dst"), (F.col("id") * 3).alias("src")))


def no_window_by(df, column="dst"):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not any("Window" in line and re.search(rf"\[{column}#\d+L?\]", line) for line in plan.splitlines())


@pytest.mark.parametrize("chunk", [1, 40, 1000])
def test_adjacency_rows_split_hubs(spark, chunk):
    e = hub_graph(spark).withColumn("w", F.col("src") * 0.5)
    packed = adjacency.rows(e, block=adjacency.sender_block(16), chunk=chunk)
    assert no_window_by(packed)
    got = packed.collect()
    assert max(len(r.senders) for r in got) <= chunk + 16
    assert sum(r.dst == 0 for r in got) >= 3000 // (chunk + 16)
    for dst in (0, 1, 2):
        own = sorted((r for r in got if r.dst == dst), key=lambda r: r["first"])
        senders = [s for r in own for s in r.senders]
        assert senders == sorted(senders) and {r.deg for r in own} == {len(senders)}
        assert [r["first"] for r in own] == np.cumsum([0, *(len(r.senders) for r in own)])[:-1].tolist()
        assert [w for r in own for w in r.ws] == [s * 0.5 for s in senders]


def test_operators_on_adjacency_rows_do_not_depend_on_chunks(spark):
    e = hub_graph(spark)
    listed = spark.range(0, 10007, 5).select("id", (-F.col("id")).alias("rank"))
    for f in (
        lambda c: sampling.affine(e, 20, 37, 11, chunk=c),
        lambda c: sampling.shuffled(e, 20, 3, chunk=c),
        lambda c: reorder.listed_first(e, listed, chunk=c),
        lambda c: statistics.locality_ratios(e, chunk=c),
        lambda c: adjacency.ordered(e, chunk=c),
    ):
        a, b = f(7), f(1 << 20)
        assert no_window_by(a)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert no_window_by(statistics.locality(e))


def test_a_hub_of_a_million_edges_spans_tasks(spark):
    e = spark.range(1_000_000).select(F.lit(3).cast("long").alias("dst"), "id").withColumnRenamed("id", "src")
    packed = adjacency.rows(e, chunk=50_000)
    got = packed.select(F.size("senders").alias("n"), F.spark_partition_id().alias("p")).collect()
    assert sum(r.n for r in got) == 1_000_000 and max(r.n for r in got) < 70_000 and len({r.p for r in got}) > 1


def test_morton_orders_by_tiles(spark, tmp_path):
    pairs = [(0, 0), (0, 65536), (65536, 0), (1, 2), (2**32 - 1, 0), (2**31, 5), (12345678, 87654321)]
    want = {p: sum(((p[0] >> k) & 1) << (2 * k + 1) | ((p[1] >> k) & 1) << (2 * k) for k in range(32)) for p in pairs}
    df = spark.createDataFrame(pairs, "dst long, src long").select("dst", "src", reorder.morton(F.col("dst"), F.col("src")).alias("code"), reorder.morton_key(F.col("dst"), F.col("src")).alias("key"))
    got = {(r.dst, r.src): r for r in df.collect()}
    assert {p: r.code % 2**64 for p, r in got.items()} == want
    assert sorted(got, key=lambda p: got[p].key) == sorted(want, key=want.get)
    grid = spark.range(64).select(F.col("id").alias("dst")).join(spark.range(64).select(F.col("id").alias("src")), F.lit(True))
    reorder.morton_layout(grid, 16).write.parquet(str(tmp_path / "z"))
    files = spark.read.parquet(str(tmp_path / "z")).groupBy(F.input_file_name().alias("f")).agg((F.max("dst") - F.min("dst")).alias("d"), (F.max("src") - F.min("src")).alias("s")).collect()
    assert sum(r.d < 32 and r.s < 32 for r in files) >= len(files) / 2


# hot keys


def skewed_weights(spark, n=6000):
    """A receiver of n weighted edges, and n of one each, from files of many parts."""
    e = spark.range(n, numPartitions=8).select(F.lit(0).cast("long").alias("dst"), F.col("id").alias("src"))
    return e.unionByName(spark.range(1, 40, numPartitions=4).select(F.col("id").alias("dst"), F.col("id").alias("src"))).withColumn("w", F.rand(1))


def test_hot_keys_can_be_split(spark):
    w = skewed_weights(spark)
    swapped = w.select(F.col("src").alias("dst"), F.col("dst").alias("src"), "w")
    vec = spark.range(6000).select("id", F.array(F.col("id") * 1.0).alias("vec"))
    # vectors that are an aggregate themselves, and a sender of very many edges
    twice = N.aggregate(Graph(swapped, unweighted=False), N.aggregate(Graph(w.select("dst", "src")), vec, "sum", 1), "sum", 1)
    with small_partitions(spark):
        assert split_joins(E.softmax(w)) >= 1
        assert split_joins(E.softmax(w, stable=True)) >= 1
        assert split_joins(E.softmax_grad(w, w.withColumn("w", F.lit(1.0)))) >= 1
        assert split_joins(twice) >= 1
        assert split_joins(skew.dealt_join(w.withColumn("k", F.col("dst").cast("string")), w.groupBy(F.col("dst").cast("string").alias("k")).count(), "k")) >= 1


def test_dealt_joins_match_as_plain_ones_do(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y"), (2, None), (2, "x")], "k long, t string")
    b = spark.createDataFrame([(1, "x", 7), (None, None, 8), (2, "z", 9)], "k long, t string, v int")
    for key in ("k", "t"):
        for how in ("inner", "left"):
            other = b.select(key, "v")
            assert sorted(map(str, skew.dealt_join(a, other, key, how).select("k", "t", "v").collect())) == sorted(map(str, a.join(other, key, how).select("k", "t", "v").collect()))


# edge functions and aggregates by name


def attended(kind):
    """An attention layer on products of scalars, or on dot products, then a convolution."""
    b = S.Builder()
    h = b.add(S.FFN, "features", weight="w0", in_dim=WIDTH, out_dim=4)
    if kind == S.EDGE_MUL:
        ends = [b.add(S.ATTEN, h, weight=f"a{s}", in_dim=4, out_dim=1) for s in "lr"]
    else:
        ends = [b.add(S.FFN, h, weight=f"v{s}", in_dim=4, out_dim=4) for s in "lr"]
    h = b.add(S.AGGREGATE, b.add(S.SOFTMAX, b.add(kind, *ends)), h)
    result = b.add(S.FFN, b.add(S.RELU, h), weight="w1", in_dim=4, out_dim=3)
    return S.ModelSpec(tuple(b.ops), result)


@pytest.mark.parametrize("kind", [S.EDGE_MUL, S.EDGE_DOT])
def test_gradients_of_edge_functions(spark, small, kind):
    g, x = small
    m = attended(kind)
    w = {k: np.array(v) / 2 for k, v in weights(m, 3).items()}
    y = spark.createDataFrame([(i, i % 3) for i in range(9)], "id long, label int")

    def loss(w):
        z = numpy_model(m, w)[:9]
        p = z - np.log(np.exp(z).sum(1, keepdims=True))
        return -p[np.arange(9), np.arange(9) % 3].mean()

    now = {k: v.tolist() for k, v in w.items()}
    env = lower.execute(m, g, x, now, WIDTH, keep=lambda op, d: training._kept(d, "t-value"))
    got = autodiff.backward(m, g, env, now, autodiff.widths(m, WIDTH), autodiff.loss_gradient(env[m.result], y, 9), lambda d: training._kept(d, "t-grad"))
    assert set(got) == set(w)
    for k in w:
        for i in np.ndindex(w[k].shape):
            up, down = {**w, k: w[k].copy()}, {**w, k: w[k].copy()}
            up[k][i] += 1e-6
            down[k][i] -= 1e-6
            assert abs(got[k][i] - (loss(up) - loss(down)) / 2e-6) < 1e-6


def test_edge_functions_are_honoured_or_rejected():
    text = PROGRAM.format(fn="mul_sum", body=BODIES["gat"])
    kinds = lambda t: {op.kind for op in dsl.parse(t)[0].ops}
    assert {S.EDGE_SUM, S.LEAKY_RELU} <= kinds(text)
    mul = text.replace("get_edge_aggregate(fn = dsl.fn.sum)", "get_edge_aggregate(fn = dsl.fn.mul)")
    assert S.EDGE_MUL in kinds(mul) and not {S.EDGE_SUM, S.LEAKY_RELU} & kinds(mul)
    for bad in (mul.replace("fn.mul)", "fn.dot)"), mul.replace("edge_fn(G, attnL, attnR)", "edge_fn(G, res, res)"), mul.replace("fn.mul)", "fn.median)")):
        with pytest.raises(dsl.DslError):
            dsl.parse(bad)


def test_aggregators_do_not_depend_on_batches(spark, monkeypatch):
    rng = np.random.default_rng(4)
    n = 5000
    values = rng.normal(size=(n, 2)) * 50
    x = spark.createDataFrame([(i, values[i].tolist()) for i in range(n)], "id long, vec array<double>")
    e = spark.range(n, numPartitions=7).select(F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") % 11 + 1).cast("long").alias("dst"), F.col("id").alias("src"))
    dst = np.where(np.arange(n) % 2 == 0, 0, np.arange(n) % 11 + 1)
    for held in (64, aggregators.HELD):
        monkeypatch.setattr(aggregators, "HELD", held)
        logs = {r.id: r.vec for r in aggregators.aggregate_by(Graph(e), x, aggregators.LOG_SUM_EXP).collect()}
        best = {r.id: r.vec for r in aggregators.aggregate_by(Graph(e), x, aggregators.top(3)).collect()}
        assert set(logs) == set(best) == set(dst.tolist())
        for d in logs:
            own = values[dst == d]
            high = own.max(0)
            np.testing.assert_allclose(logs[d], high + np.log(np.exp(own - high).sum(0)))
            np.testing.assert_allclose(best[d], np.sort(own, 0)[::-1][:3].ravel())
    # weights multiply, and a receiver's own row counts once more
    w = e.where("src < 6").withColumn("w", F.lit(2.0))
    own = {r.id: r.vec for r in aggregators.aggregate_by(Graph(w, unweighted=False), x, aggregators.PRODUCT, into=x.where("id = 0")).collect()}
    np.testing.assert_allclose(own[0], values[0] * np.prod(2 * values[[0, 2, 4]], 0))
    assert aggregators.aggregate_by(Graph(e.limit(0)), x, aggregators.PRODUCT).count() == 0


def test_a_hub_is_reduced_before_the_shuffle(spark):
    e = spark.range(20000, numPartitions=4).select(F.lit(0).cast("long").alias("dst"), F.col("id").alias("src"))
    x = spark.range(20000, numPartitions=4).select("id", F.array(F.lit(0.0)).alias("vec"))
    got = aggregators.aggregate_by(Graph(e), x, aggregators.LOG_SUM_EXP)
    assert got.first().vec[0] == pytest.approx(np.log(20000))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow partial") == plan.count("MapInArrow final") == 1 and plan.index("MapInArrow final") < plan.index("REPARTITION_BY_COL") < plan.index("MapInArrow partial")


# wide vectors and array files


@pytest.mark.parametrize("fn", ["sum", "mean", "max"])
def test_wide_vectors_in_chunks(small, fn):
    g, x = small
    want = {"sum": ADJ.astype(float) @ X, "mean": ADJ.astype(float) @ X / ADJ.sum(1)[:, None], "max": np.array([X[r].max(0) for r in ADJ])}[fn]
    for width, chunk in ((WIDTH, 4), (None, 4), (None, 64), (WIDTH, 1)):
        np.testing.assert_allclose(dense(N.aggregate(g, x, fn, width, chunk=chunk)), want, atol=1e-12)
        np.testing.assert_allclose(dense(tiling.tiled_aggregate(g.edges, x, 5, width, fn, chunk)), want, atol=1e-12)
    plan = N.aggregate(g, x, "sum", 602)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and plan.count("Generate") == 1


def test_array_files_of_any_kind(spark, tmp_path):
    a = np.arange(60, dtype=np.int16).reshape(20, 3)
    for name, array in (("c", a), ("f", np.asfortranarray(a)), ("big", a.astype(">f4")), ("flat", a.ravel())):
        np.save(tmp_path / f"{name}.npy", array)
    for name in ("c", "f", "big"):
        got = npy.columns(spark, 40, vec=(f"file://{tmp_path}/{name}.npy", "vector"))
        assert got.rdd.getNumPartitions() > 2
        assert [r.vec for r in sorted(got.collect())] == a.astype(float).tolist()
        assert [r.x for r in sorted(npy.values(spark, f"{tmp_path}/{name}.npy").collect())] == a.ravel().astype(float).tolist()
    both = npy.columns(spark, x=(f"{tmp_path}/flat.npy", "long", 1), y=(f"{tmp_path}/c.npy", "long", 1)).collect()
    assert [(r.x, r.y) for r in sorted(both)] == [(k, k) for k in range(1, 60)]
    np.save(tmp_path / "none.npy", np.zeros((0, 3)))
    assert npy.vectors(spark, f"{tmp_path}/none.npy").count() == 0
    np.save(tmp_path / "text.npy", np.array(["x"]))
    (tmp_path / "bad.npy").write_bytes(b"nothing of the kind")
    for name in ("text", "bad"):
        with pytest.raises(Exception, match="npy"):
            npy.values(spark, f"{tmp_path}/{name}.npy").count()


def test_datasets_are_exported_and_read_again(spark, small, tmp_path):
    g, x = small
    y = spark.createDataFrame([(i, i % 3) for i in range(NODES)], "id long, label int")
    npy.export(g, x, y, None, str(tmp_path / "d"), seed=5)
    got, vec, label, masks = npy.load(spark, str(tmp_path / "d"))
    loops = ADJ | np.eye(NODES, dtype=bool)
    pairs = sorted((int(d), int(s)) for d, s in zip(*np.nonzero(loops), strict=True))
    assert np.load(tmp_path / "d" / "Adj_src.npy").tolist() == [NODES, NODES, *(d for d, _ in pairs)]
    assert np.load(tmp_path / "d" / "Adj_dst.npy").tolist() == [s for _, s in pairs]
    assert sorted((r.dst, r.src) for r in got.edges.collect()) == pairs
    np.testing.assert_allclose(dense(vec), X.astype(np.float32))
    assert sorted((r.id, r.label) for r in label.collect()) == [(i, i % 3) for i in range(NODES)]
    rows = masks.collect()
    assert sum(r.train for r in rows) == int(0.7 * NODES) and sum(r.valid for r in rows) == int(0.15 * NODES) and all(r.train + r.valid + r.test == 1 for r in rows)
    with pytest.raises(npy.NpyError, match="renumbered"):
        npy.export(g, x.where("id > 3"), y, None, str(tmp_path / "e"))


def test_renumbered_subgraphs(spark, small):
    g, x = small
    keep = [1, 4, 5, 11]
    own, perm, (y,) = subgraphs.renumbered(g, x.where(F.col("id").isin(keep)).select("id"), x)
    assert {r.old: r.new for r in perm.collect()} == {k: i for i, k in enumerate(keep)}
    assert sorted((r.dst, r.src) for r in own.edges.collect()) == sorted((i, j) for i, a in enumerate(keep) for j, b in enumerate(keep) if ADJ[a, b])
    assert {r.id: r.vec for r in y.collect()} == {i: X[k].tolist() for i, k in enumerate(keep)}


@pytest.mark.parametrize("kind", ["gcn", "gat", "sage"])
def test_gradients_by_tiles(spark, small, kind):
    g, x = small
    m = S.model(kind, (WIDTH, 4, 3))
    now = weights(m, 2)
    y = spark.createDataFrame([(i, i % 3) for i in range(9)], "id long, label int")
    env = lower.execute(m, g, x, now, WIDTH, keep=lambda op, d: training._kept(d, "t-value"))
    seen = []

    def grads(tile):
        def keep(d):
            seen.append((tile, d._jdf.queryExecution().optimizedPlan().toString()))
            return training._kept(d, "t-grad")

        return autodiff.backward(m, g, env, now, autodiff.widths(m, WIDTH), autodiff.loss_gradient(env[m.result], y, 9), keep, tile=tile)

    whole, tiled = grads(None), grads(5)
    for k in whole:
        np.testing.assert_allclose(tiled[k], whole[k], atol=1e-12)
    assert any("tile" in plan for tile, plan in seen if tile) and not any("tile" in plan for tile, plan in seen if not tile)


# memory of a task


def explained(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_are_made_distinct_behind_their_shuffle(spark, sf, monkeypatch):
    """No map-side distinct of a file split, and as many tasks as lines ask for."""
    monkeypatch.setattr(D, "LINES", 1000)
    plan = explained(D.edges(spark, sf))
    exchange = re.search(r"Exchange hashpartitioning\(dst#\d+L?, src#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan)
    assert exchange and int(exchange[1]) == 1 + D.table(spark, sf, "lineitem").count() // 1000
    assert "HashAggregate" not in plan[exchange.end() :]


def test_same_edges_is_one_group_by(spark):
    a = spark.createDataFrame([(1, 2), (1, 2), (3, 4), (None, 1)], "dst long, src long")
    b = spark.createDataFrame([(1, 2), (5, 6), (None, 1)], "dst long, src long")
    got = reorder.same_edges(a, b)
    assert tuple(got.first()) == (2, 1)
    assert "Join" not in explained(got)
    assert tuple(reorder.same_edges(a.limit(0), b.limit(0)).first()) == (0, 0)


def test_adjacency_rows_in_partitions_of_their_estimate(spark, sf, monkeypatch):
    monkeypatch.setattr(skew, "EACH", 4000)
    e = D.edges(spark, sf)
    packed = adjacency.rows(e, block=adjacency.sender_block(16), chunk=64)
    parts = 1 + int(str(e._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // 4000
    plan = explained(packed)
    assert parts > 1 and "LeftSemi" not in plan
    for keys in ("dst", "block"), ("dst", "chunk"):
        assert re.search(rf"hashpartitioning\({keys[0]}#\d+L?, {keys[1]}#\d+L?, {parts}\), REPARTITION_BY_NUM", plan)
    assert sorted(adjacency.edges_of(packed).select("dst", "src").collect()) == sorted(e.select("dst", "src").collect())


def test_training_reads_its_edges_once(spark, small):
    """Whatever made the edges runs once, and softmax gradients join no edges with edges."""
    g, x = small
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    own = g.with_edges(g.edges.mapInArrow(count, "dst long, src long"))
    y = spark.createDataFrame([(i, i % 3) for i in range(NODES)], "id long, label int")
    masks = spark.createDataFrame([(i, i < 8, i >= 8) for i in range(NODES)], "id long, train boolean, test boolean")
    autodiff.train(S.model("gat", (WIDTH, 4, 3)), own, x, y, masks, WIDTH, 1)
    assert seen.value == int(ADJ.sum())


def test_softmax_gradient_with_its_outputs_alongside(spark, small):
    w = small[0].edges.withColumn("w", (F.col("dst") - F.col("src")) / 7.0)
    alpha = E.softmax(w)
    grad = w.withColumn("w", F.sin(F.col("w")))
    both = alpha.withColumnRenamed("w", "alpha").join(grad, ["dst", "src"])
    rows = lambda df: sorted((r.dst, r.src, round(r.w, 9)) for r in df.collect())
    carried = spark.createDataFrame(both.collect(), both.schema)
    got = E.softmax_grad(alpha, carried)
    assert rows(got) == rows(E.softmax_grad(alpha, grad))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
