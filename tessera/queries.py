"""The registered graph queries and their DuckDB twins.

Each query runs over the whole derived graph.  Twins share the common table
expressions below; values are rounded to six places because sums may be taken
in another order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import pointwise as P
from tessera.graph import Graph, to_long, transpose, undirected, with_self_loops
from tessera.operators import edges as E
from tessera.operators import adjacency, aggregators, generate, reorder, sampling, statistics, subgraphs, tiling
from tessera.operators import nodes as N
from tessera.plans import autodiff, dsl, lower, programs, rewrites, training
from tessera.plans import spec as S
from tessera.sources import matrix_market, npy
from tessera.sources import tables as D
from tessera.storage import new_path

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
H = 8  # width of layers in queries

CTE = {
    "n": "n AS (SELECT count(*) AS c FROM embeddings)",
    "edges": """edges AS (SELECT l_partkey % n.c AS dst, (l_suppkey * 5 + l_linenumber) % n.c AS src FROM lineitem, n
      WHERE l_partkey % n.c <> (l_suppkey * 5 + l_linenumber) % n.c UNION SELECT vec_id, vec_id FROM embeddings)""",
    "feat": "feat AS (SELECT vec_id AS id, CAST(unnest(range(64)) AS INT) AS k, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)",
    "w": "w AS (SELECT CAST(a.k AS INT) AS k, CAST(b.j AS INT) AS j, CAST((a.k * 7 + b.j * 3) % 11 - 5 AS DOUBLE) / 10 AS w FROM range(64) a(k), range(8) b(j))",
    "w8": "w8 AS (SELECT CAST(a.k AS INT) AS k, CAST(b.j AS INT) AS j, CAST((a.k * 7 + b.j * 3) % 11 - 5 AS DOUBLE) / 10 AS w FROM range(8) a(k), range(8) b(j))",
    "h": "h AS (SELECT id, j, sum(x * w) AS v FROM feat JOIN w USING (k) GROUP BY id, j)",
    "deg": "deg AS (SELECT dst AS id, CAST(count(*) AS DOUBLE) AS s FROM edges GROUP BY dst)",
    "norm": "norm AS (SELECT id, power(s, -0.5) AS s FROM deg)",
    "al": "al AS (SELECT id, sum(v * CAST((j * 5) % 7 - 3 AS DOUBLE) / 10) AS s FROM h GROUP BY id)",
    "ar": "ar AS (SELECT id, sum(v * CAST((j * 5 + 2) % 7 - 3 AS DOUBLE) / 10) AS s FROM h GROUP BY id)",
    "z": "z AS (SELECT dst, src, al.s + ar.s AS w FROM edges JOIN al ON al.id = dst JOIN ar ON ar.id = src)",
    "lz": "lz AS (SELECT dst, src, CASE WHEN w >= 0 THEN w ELSE 0.2::DOUBLE * w END AS w FROM z)",
    "alpha": "alpha AS (SELECT dst, src, least(exp(w), 1e12) / (sum(least(exp(w), 1e12)) OVER (PARTITION BY dst) + 1e-12) AS w FROM lz)",
    "agg": "agg AS (SELECT dst AS id, j, sum(v) AS v FROM edges JOIN h ON h.id = src GROUP BY dst, j)",
    "gcn": """gcn AS (SELECT dst AS id, j, greatest(0.0, a.s * sum(b.s * v)) AS v FROM edges JOIN norm b ON b.id = src JOIN h ON h.id = src
      JOIN norm a ON a.id = dst GROUP BY dst, j, a.s)""",
    "logits": "logits AS (SELECT id, CAST(k AS INT) AS j, x AS v FROM feat WHERE k < 10)",
    "mask": "mask AS (SELECT vec_id AS id, vec_id % 10 <= 6 AS train, vec_id % 10 = 7 AS valid, vec_id % 10 >= 8 AS test FROM embeddings)",
}


def with_(names: str, body: str) -> str:
    return "WITH " + ",\n".join(CTE[n] for n in names.split()) + "\n" + body


def r(x: str) -> str:
    return f"round({x}, 6) + 0.0::DOUBLE"


LONG = f"SELECT id, j, {r('v')} AS v FROM "


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        key = name or f.__name__
        _queries[key] = f
        if sql is not None:
            _sql[key] = sql
        return f

    return add


def q6(x, name: str):
    return (F.round(x, 6) + F.lit(0.0)).alias(name)


def hidden(spark: SparkSession, sf: str) -> DataFrame:
    return N.ffn(D.features(spark, sf), D.weights(64, H))


def scores(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    h = hidden(spark, sf)
    return N.project_to_scalar(h, D.attention_vector(H)), N.project_to_scalar(h, D.attention_vector(H, 2))


def parameters(kind: str, dims: tuple[int, ...]) -> dict[str, list[list[float]]]:
    """The weights of a query's program."""
    out: dict[str, list[list[float]]] = {}
    for k in range(len(dims) - 1):
        out[f"w{k}"] = out[f"s{k}"] = D.weights(dims[k], dims[k + 1])
        out[f"al{k}"] = [[x] for x in D.attention_vector(dims[k + 1])]
        out[f"ar{k}"] = [[x] for x in D.attention_vector(dims[k + 1], 2)]
    return out


def program(spark: SparkSession, sf: str, m: S.ModelSpec, kind: str, dims: tuple[int, ...], **how) -> DataFrame:
    g = D.graph(spark, sf)
    return lower.run(m, g, D.features(spark, sf), parameters(kind, dims), 64, **how)


# graphs and sources


@query(with_("n edges", "SELECT dst, src FROM edges"))
def edges_build(spark, sf):
    return D.edges(spark, sf)


@query(with_("n edges", "SELECT dst, src FROM edges UNION SELECT src, dst FROM edges"))
def edges_undirected(spark, sf):
    return undirected(D.edges(spark, sf))


@query(with_("n edges", "SELECT src AS dst, dst AS src FROM edges"), "transpose")
def transposed(spark, sf):
    return transpose(D.edges(spark, sf))


@query(with_("n edges", "SELECT dst, src FROM edges"))
def self_loops(spark, sf):
    """Loops removed and added again."""
    nodes = D.features(spark, sf).select("id")
    return with_self_loops(D.edges(spark, sf), nodes)


@query(with_("n edges", 'SELECT dst, CAST(sum(c) OVER (ORDER BY dst) - c AS BIGINT) AS "begin", CAST(sum(c) OVER (ORDER BY dst) AS BIGINT) AS "end" FROM (SELECT dst, count(*) AS c FROM edges GROUP BY dst)'))
def csr_offsets(spark, sf):
    return tiling.offsets(D.edges(spark, sf))


@query(with_("n edges", """, b AS (SELECT dst, src // 16 AS b, count(*) AS n FROM edges GROUP BY ALL),
  s AS (SELECT dst, b, sum(n) OVER (PARTITION BY dst ORDER BY b) - n AS start, sum(n) OVER (PARTITION BY dst) AS deg FROM b)
  SELECT e.dst, CAST(CASE WHEN deg > 64 THEN start // 64 ELSE 0 END AS BIGINT) AS chunk, row_number() OVER (PARTITION BY e.dst ORDER BY src) - 1 AS place, src, CAST((e.dst * 3 + src) % 7 AS DOUBLE) AS w
  FROM edges e JOIN s ON s.dst = e.dst AND s.b = e.src // 16"""))
def csr_rows(spark, sf):
    """Adjacency rows of some 64 edges, taken apart again to show each edge's place."""
    e = D.edges(spark, sf).withColumn("w", ((F.col("dst") * 3 + F.col("src")) % 7).cast("double"))
    packed = adjacency.rows(e, block=adjacency.sender_block(16), chunk=64)
    each = packed.select("dst", "chunk", "first", F.posexplode(F.arrays_zip("senders", "ws")).alias("at", "x"))
    return each.select("dst", "chunk", (F.col("first") + F.col("at")).alias("place"), F.col("x.senders").alias("src"), F.col("x.ws").alias("w"))


@query(f"SELECT vec_id AS id, label, vec_id % 10 <= 6 AS train, vec_id % 10 = 7 AS valid, vec_id % 10 >= 8 AS test, {r('CAST(embedding[1] AS DOUBLE)')} AS first, CAST(len(embedding) AS INT) AS width FROM embeddings")
def load_dataset(spark, sf):
    _, x, y, m = D.load(spark, sf)
    return x.join(y, "id").join(m, "id").select("id", "label", "train", "valid", "test", q6(F.col("vec")[0], "first"), F.size("vec").alias("width"))


@query(with_("n edges", "SELECT dst AS row, src AS col, CAST(1 AS DOUBLE) AS val FROM edges"))
def matrix_market_round_trip(spark, sf):
    path, e = new_path(spark, "mtx"), D.edges(spark, sf)
    n = D.node_count(spark, sf)
    matrix_market.write(e.select(F.col("dst").alias("row"), F.col("src").alias("col"), F.lit(1.0).alias("val")), path, n, n)
    return matrix_market.read(spark, path)


@query(with_("n edges", "SELECT dst AS row, src AS col, CAST(1 AS DOUBLE) AS val FROM edges WHERE dst >= src UNION ALL SELECT src, dst, CAST(1 AS DOUBLE) FROM edges WHERE dst > src"))
def mtx_mirror(spark, sf):
    """The lower triangle as a symmetric pattern file, read with its mirror."""
    path, n = new_path(spark, "mtx"), D.node_count(spark, sf)
    low = D.edges(spark, sf).where("dst >= src").select(F.col("dst").alias("row"), F.col("src").alias("col"))
    matrix_market.write(low, path, n, n, "pattern", "symmetric")
    return matrix_market.read(spark, path)


@query(with_("n edges", """, g AS (SELECT greatest(dst % 200, src % 200) AS a, least(dst % 200, src % 200) AS b, count(*) AS n FROM edges GROUP BY 1, 2)
  SELECT r.k AS row, c.k AS col, CAST(coalesce(g.n, 0) AS DOUBLE) AS val FROM range(200) r(k), range(200) c(k) LEFT JOIN g ON g.a = greatest(r.k, c.k) AND g.b = least(r.k, c.k)"""))
def mtx_array_symmetric(spark, sf):
    """Edges between 200 groups of nodes, as a packed symmetric array."""
    path = new_path(spark, "mtx")
    group = lambda f: f(F.col("dst") % 200, F.col("src") % 200)
    counts = D.edges(spark, sf).groupBy(group(F.greatest).alias("row"), group(F.least).alias("col")).agg(F.count("*").alias("n"))
    cells = spark.range(200).select(F.col("id").alias("col"), F.explode(F.sequence("id", F.lit(199).cast("long"))).alias("row"))
    values = cells.join(counts, ["row", "col"], "left").select((F.col("col") * 200 + F.col("row") + 2).alias("at"), F.coalesce("n", F.lit(0)).cast("string").alias("value"))
    head = spark.createDataFrame([(0, "%%MatrixMarket matrix array real symmetric"), (1, "200 200")], "at long, value string")
    # a file of a fixed size, 20,102 lines, in order
    head.unionByName(values).repartition(1).sortWithinPartitions("at").select("value").write.text(path)
    return matrix_market.read(spark, path)


def exported(spark: SparkSession, sf: str, masks: DataFrame | None = None) -> str:
    """The derived dataset, written as array files."""
    folder = new_path(spark, "npy")
    npy.export(D.graph(spark, sf), D.features(spark, sf), D.labels(spark, sf), masks, folder)
    return folder


@query("SELECT vec_id AS id, label FROM embeddings")
def npy_labels(spark, sf):
    """Labels written as an array file and read again."""
    path = new_path(spark, "npy") + "/Lab.npy"
    y = D.labels(spark, sf)
    npy.write(y.select(F.col("id").alias("i"), F.col("label").alias("x")), path, "int64", y.count(), 1)
    return npy.labels(spark, path.rpartition("/")[0])


@query(with_("n edges mask", f"""SELECT vec_id AS id, label, train, valid, test, {r('list_sum([CAST(x AS DOUBLE) FOR x IN embedding])')} AS total, CAST(len(embedding) AS INT) AS width, deg, senders
  FROM embeddings JOIN mask ON id = vec_id JOIN (SELECT dst, count(*) AS deg, CAST(sum(src) AS BIGINT) AS senders FROM edges GROUP BY dst) d ON d.dst = vec_id"""))
def npy_dataset(spark, sf):
    """All files of a dataset written by ranges and read again, a row a node."""
    g, x, y, m = npy.load(spark, exported(spark, sf, D.masks(spark, sf)))
    e = g.edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("deg"), F.sum("src").alias("senders"))
    total = F.aggregate("vec", F.lit(0.0), lambda a, v: a + v)
    return x.select("id", q6(total, "total"), F.size("vec").alias("width")).join(y, "id").join(m, "id").join(e, "id")


@query(with_("n edges", "SELECT dst, src FROM edges"))
def npy_edges(spark, sf):
    """Edges written in order of both ends and read again."""
    folder = new_path(spark, "npy")
    npy.write_edges(D.edges(spark, sf), folder, D.node_count(spark, sf))
    return npy.edges(spark, folder)


@query("SELECT CAST(floor(count(*) * 0.7::DOUBLE) AS BIGINT) AS train, CAST(floor(count(*) * 0.15::DOUBLE) AS BIGINT) AS valid, count(*) AS nodes, count(*) AS masked FROM embeddings")
def exact_masks(spark, sf):
    """Sizes of drawn masks: every node has just one."""
    m = subgraphs.exact_masks(D.features(spark, sf), 7)
    one = F.col("train").cast("int") + F.col("valid").cast("int") + F.col("test").cast("int")
    return m.agg(F.count_if("train").alias("train"), F.count_if("valid").alias("valid"), F.count("*").alias("nodes"), F.count_if(one == 1).alias("masked"))


# nodes


@query(with_("n edges deg", "SELECT id, s FROM deg"))
def degrees(spark, sf):
    return N.degrees(D.edges(spark, sf))


@query(with_("n edges deg", f"SELECT id, {r('power(s, -0.5)')} AS s FROM deg"))
def norm_pow(spark, sf):
    return N.norm(N.degrees(D.edges(spark, sf)), -0.5).select("id", q6(F.col("s"), "s"))


@query(with_("n edges deg", f"SELECT id, {r('power(s, 2)')} AS s FROM deg"))
def norm_pow_integer(spark, sf):
    return N.norm(N.degrees(D.edges(spark, sf)), 2).select("id", q6(F.col("s"), "s"))


@query(with_("n edges feat", f"SELECT dst AS id, k AS j, {r('sum(x)')} AS v FROM edges JOIN feat ON id = src GROUP BY dst, k"))
def spmm_sum(spark, sf):
    return to_long(N.aggregate(D.graph(spark, sf), D.features(spark, sf), "sum", 64))


@query(with_("n edges feat w h", f"SELECT dst AS id, j, {r('sum(v * ((dst * 3 + src * 5) % 7 + 1))')} AS v FROM edges JOIN h ON id = src GROUP BY dst, j"))
def spmm_weighted(spark, sf):
    e = D.edges(spark, sf).withColumn("w", ((F.col("dst") * 3 + F.col("src") * 5) % 7 + 1).cast("double"))
    return to_long(N.aggregate(Graph(e, unweighted=False), hidden(spark, sf), "sum", H))


@query(with_("n edges feat w h", f"SELECT dst AS id, j, {r('avg(v)')} AS v FROM edges JOIN h ON id = src GROUP BY dst, j"))
def spmm_mean(spark, sf):
    return to_long(N.aggregate(D.graph(spark, sf), hidden(spark, sf), "mean", H))


@query(with_("n edges feat w h", f"SELECT dst AS id, j, {r('max(v)')} AS v FROM edges JOIN h ON id = src GROUP BY dst, j"))
def spmm_max(spark, sf):
    return to_long(N.aggregate(D.graph(spark, sf), hidden(spark, sf), "max", H))


@query(with_("n edges feat w h", f"SELECT dst AS id, j, {r('ln(sum(exp(v)))')} AS v FROM edges JOIN h ON id = src GROUP BY dst, j"))
def spmm_log_sum_exp(spark, sf):
    """An aggregate given by its state, its merge and its result."""
    return to_long(aggregators.aggregate_by(D.graph(spark, sf), hidden(spark, sf), aggregators.LOG_SUM_EXP))


@query(with_("n edges feat w h", f"""SELECT id, CAST(j + 8 * (i - 1) AS INT) AS j, {r('coalesce(vs[i], 0)')} AS v
  FROM (SELECT dst AS id, j, list(v ORDER BY v DESC) AS vs FROM edges JOIN h ON id = src GROUP BY dst, j), range(1, 3) t(i)"""))
def spmm_top_two(spark, sf):
    return to_long(aggregators.aggregate_by(D.graph(spark, sf), hidden(spark, sf), aggregators.top(2, 0.0)))


@query(with_("n edges feat w h agg", LONG + "agg"))
def spmm_long_form(spark, sf):
    """The layout for wide vectors."""
    return to_long(N.aggregate(D.graph(spark, sf), hidden(spark, sf), "sum"))


def widened(x: DataFrame, width: int) -> DataFrame:
    """Features of ``width`` values: the given ones again and again, scaled."""
    return x.select("id", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.element_at("vec", k % 64 + 1) * (F.floor(k / 64) + 1)).alias("vec"))


@query(with_("n edges feat", f"SELECT dst AS id, CAST(c * 64 + k AS INT) AS j, {r('sum(x * (c + 1))')} AS v FROM edges JOIN feat ON id = src, range(10) t(c) WHERE c * 64 + k < 602 GROUP BY dst, c, k"))
def spmm_wide_602(spark, sf):
    """Vectors of 602 values, in chunks of 64."""
    return to_long(N.aggregate(D.graph(spark, sf), widened(D.features(spark, sf), 602), "sum", 602))


@query(with_("n edges feat deg norm", f"SELECT id, k AS j, {r('s * x')} AS v FROM feat JOIN norm USING (id)"))
def row_broadcast(spark, sf):
    return to_long(N.row_scale(N.norm(N.degrees(D.edges(spark, sf)), -0.5), D.features(spark, sf)))


@query(with_("feat w h", LONG + "h"))
def ffn(spark, sf):
    return to_long(hidden(spark, sf))


@query(with_("feat w h", f"SELECT id, j, {r('v + (j - 3) / 4.0::DOUBLE')} AS v FROM h"))
def ffn_bias(spark, sf):
    return to_long(N.ffn(D.features(spark, sf), D.weights(64, H), [(j - 3) / 4 for j in range(H)]))


@query(with_("feat", f"SELECT id, b.j::INT AS j, {r('sum(x * (((k * 7 + b.j * 3) % 11 - 5)::DOUBLE / 10))')} AS v FROM feat, range(80) b(j) GROUP BY id, b.j"))
def ffn_large(spark, sf):
    """A matrix too large for a literal: a join with its rows."""
    return to_long(N.ffn(D.features(spark, sf), D.weights(64, 80)))


@query(with_("feat w h al", f"SELECT id, {r('s')} AS s FROM al"))
def ffn_edge(spark, sf):
    return scores(spark, sf)[0].select("id", q6(F.col("s"), "s"))


@query(with_("n edges feat w h agg", f"SELECT id, j, {r('h.v + agg.v')} AS v FROM h JOIN agg USING (id, j)"))
def add(spark, sf):
    h = hidden(spark, sf)
    return to_long(N.add(h, N.aggregate(D.graph(spark, sf), h, "sum", H)))


def _pointwise(name: str, f, sql: str) -> None:
    query(with_("feat w h", f"SELECT id, j, {r(sql)} AS v FROM h"), name)(lambda spark, sf: to_long(N.pointwise(hidden(spark, sf), f)))


_pointwise("relu", P.relu, "greatest(0.0, v)")
_pointwise("leaky_relu", P.leaky_relu, "CASE WHEN v >= 0 THEN v ELSE 0.2::DOUBLE * v END")
_pointwise("leaky_relu_node", lambda x: P.leaky_relu(x, P.NODE_SLOPE), "CASE WHEN v >= 0 THEN v ELSE 0.01::DOUBLE * v END")
_pointwise("explrelu", P.exp_leaky_relu, "exp(CASE WHEN v >= 0 THEN v ELSE 0.01::DOUBLE * v END)")
_pointwise("eps_scale", P.scale_by_eps, "2 * v")
_pointwise("inverse_root", lambda x: P.inverse_root(F.abs(x) + 1), "sqrt(1 / (abs(v) + 1))")
_pointwise("elementwise", lambda x: P.divide(P.wsum(x, F.lit(0.5), x) - 1.0, P.clamp(F.abs(x), 0.5, 2.0)), "(v + 0.5::DOUBLE * v - 1) / greatest(0.5, least(2.0, abs(v)))")
_pointwise("power_reciprocal", lambda x: P.reciprocal(P.power(F.abs(x) + 1, 1.5)), "1 / power(abs(v) + 1, 1.5)")


@query("SELECT vec_id AS id, CAST(1 AS DOUBLE) AS one, CAST(3 * 4 AS DOUBLE) AS fill FROM embeddings")
def ones_full(spark, sf):
    x = D.features(spark, sf)
    return N.constant(x).withColumnRenamed("s", "one").join(N.constant(x, 3 * 4).withColumnRenamed("s", "fill"), "id")


@query(with_("feat", f"SELECT {r('sum(x)')} AS total FROM feat"))
def sum_all(spark, sf):
    return N.total(D.features(spark, sf)).select(q6(F.col("total"), "total"))


@query(with_("feat w h", f"SELECT id, j, {r('v - ln(sum(exp(v)) OVER (PARTITION BY id))')} AS v FROM h"))
def log_softmax(spark, sf):
    return to_long(N.log_softmax(hidden(spark, sf)))


# edges

EDGE = f"SELECT dst, src, {r('w')} AS w FROM "


def long_edges(e: DataFrame) -> DataFrame:
    return e.select("dst", "src", q6(F.col("w"), "w"))


@query(with_("n edges feat w h al ar z", EDGE + "z"))
def sddmm_sum(spark, sf):
    return long_edges(E.sddmm_sum(D.edges(spark, sf), *scores(spark, sf)))


@query(with_("n edges deg norm", f"SELECT dst, src, {r('a.s * b.s')} AS w FROM edges JOIN norm a ON a.id = dst JOIN norm b ON b.id = src"))
def sddmm_mul(spark, sf):
    return long_edges(training.normalised(D.graph(spark, sf)))


@query(with_("n edges feat w h", f"SELECT dst, src, {r('sum(a.v * b.v)')} AS w FROM edges JOIN h a ON a.id = dst JOIN h b ON b.id = src AND a.j = b.j GROUP BY dst, src"))
def sddmm_dot(spark, sf):
    h = hidden(spark, sf)
    return long_edges(E.sddmm_dot(D.edges(spark, sf), h, h))


@query(with_("n edges feat w h al ar", f"SELECT dst, src, {r('greatest(al.s, ar.s) - 2 * al.s')} AS w FROM edges JOIN al ON al.id = dst JOIN ar ON ar.id = src"))
def apply_edges(spark, sf):
    return long_edges(E.apply(D.edges(spark, sf), *scores(spark, sf), lambda a, b: F.greatest(a, b) - 2 * a))


def _logits(spark, sf):
    return E.leaky_relu(E.sddmm_sum(D.edges(spark, sf), *scores(spark, sf)))


@query(with_("n edges feat w h al ar z lz", EDGE + "lz"))
def edge_leaky_relu(spark, sf):
    return long_edges(_logits(spark, sf))


@query(with_("n edges feat w h al ar z lz alpha", EDGE + "alpha"))
def edge_softmax(spark, sf):
    return long_edges(E.softmax(_logits(spark, sf)))


@query(with_("n edges feat w h al ar z lz", f"SELECT dst, src, {r('exp(w - max(w) OVER (PARTITION BY dst)) / sum(exp(w - m)) OVER (PARTITION BY dst)')} AS w FROM (SELECT *, max(w) OVER (PARTITION BY dst) AS m FROM lz)"))
def edge_softmax_stable(spark, sf):
    return long_edges(E.softmax(_logits(spark, sf), stable=True))


@query(with_("n edges feat w h al ar z lz alpha", f"SELECT dst, src, {r('a * g - a * sum(a * g) OVER (PARTITION BY dst)')} AS w FROM (SELECT alpha.dst, alpha.src, alpha.w AS a, z.w AS g FROM alpha JOIN z USING (dst, src))"))
def edge_softmax_grad(spark, sf):
    return long_edges(E.softmax_grad(E.softmax(_logits(spark, sf)), E.sddmm_sum(D.edges(spark, sf), *scores(spark, sf))))


@query(with_("n edges feat w h al ar z", f"SELECT dst AS id, {r('1e-12 + sum(w)')} AS s FROM z GROUP BY dst"))
def edge_to_node(spark, sf):
    return E.edge_to_node(E.sddmm_sum(D.edges(spark, sf), *scores(spark, sf)), E.SEED).select("id", q6(F.col("s"), "s"))


@query(with_("n edges feat w h al ar z", f"SELECT coalesce(a.id, b.id) AS id, {r('a.s')} AS by_dst, {r('b.s')} AS by_src FROM (SELECT dst AS id, sum(w) AS s FROM z GROUP BY dst) a FULL JOIN (SELECT src AS id, sum(w) AS s FROM z GROUP BY src) b ON a.id = b.id"))
def sddmm_sum_grad(spark, sf):
    a, b = E.sddmm_sum_grad(E.sddmm_sum(D.edges(spark, sf), *scores(spark, sf)))
    return a.withColumnRenamed("s", "a").join(b.withColumnRenamed("s", "b"), "id", "full_outer").select("id", q6(F.col("a"), "by_dst"), q6(F.col("b"), "by_src"))


@query(with_("n edges feat w h al ar z deg", f"SELECT dst, src, {r('w * s')} AS w FROM z JOIN deg ON id = dst"))
def node_to_edge(spark, sf):
    e = D.edges(spark, sf)
    return long_edges(E.node_to_edge(E.sddmm_sum(e, *scores(spark, sf)), N.degrees(e)))


@query(with_("n edges feat w h al ar z lz alpha", f"SELECT dst AS id, j, {r('sum(w * v)')} AS v FROM alpha JOIN h ON id = src GROUP BY dst, j"))
def attention_aggregate(spark, sf):
    return to_long(N.aggregate(D.graph(spark, sf), hidden(spark, sf), "sum", H, E.softmax(_logits(spark, sf))))


# models

GCN = with_("n edges feat w h deg norm gcn", LONG + "gcn")
GAT = with_("n edges feat w h al ar z lz alpha", f"SELECT dst AS id, j, {r('greatest(0.0, sum(w * v))')} AS v FROM alpha JOIN h ON id = src GROUP BY dst, j")
GIN = with_("n edges feat w h agg", f"SELECT id, j, {r('greatest(0.0, 2 * h.v + agg.v)')} AS v FROM h JOIN agg USING (id, j)")
SAGE = with_("n edges feat w h agg deg", f"SELECT id, j, {r('greatest(0.0, agg.v / s + h.v)')} AS v FROM h JOIN agg USING (id, j) JOIN deg USING (id)")
LAYER = {"gcn": GCN, "gat": GAT, "gin": GIN, "sage": SAGE}


def _two_layers(kind: str) -> str:
    """The layer's SQL twice: the second reads the first's rows."""
    first = {
        "gcn": "o AS (SELECT id, j AS k, v AS x FROM gcn)",
        "gat": "o AS (SELECT dst AS id, j AS k, greatest(0.0, sum(w * v)) AS x FROM alpha JOIN h ON id = src GROUP BY dst, j)",
        "gin": "o AS (SELECT id, j AS k, greatest(0.0, 2 * h.v + agg.v) AS x FROM h JOIN agg USING (id, j))",
        "sage": "o AS (SELECT id, j AS k, greatest(0.0, agg.v / s + h.v) AS x FROM h JOIN agg USING (id, j) JOIN deg USING (id))",
    }[kind]
    base = {"gcn": "n edges feat w w8 h deg norm gcn", "gat": "n edges feat w w8 h al ar z lz alpha", "gin": "n edges feat w w8 h agg", "sage": "n edges feat w w8 h agg deg"}[kind]
    h2 = "h2 AS (SELECT id, j, sum(x * w) AS v FROM o JOIN w8 USING (k) GROUP BY id, j)"
    agg2 = "agg2 AS (SELECT dst AS id, j, sum(v) AS v FROM edges JOIN h2 ON h2.id = src GROUP BY dst, j)"
    tail = {
        "gcn": f"SELECT dst AS id, j, {r('a.s * sum(b.s * v)')} AS v FROM edges JOIN norm b ON b.id = src JOIN h2 ON h2.id = src JOIN norm a ON a.id = dst GROUP BY dst, j, a.s",
        "gat": f"""SELECT dst AS id, j, {r('sum(w * v)')} AS v FROM (SELECT dst, src, least(exp(w), 1e12) / (sum(least(exp(w), 1e12)) OVER (PARTITION BY dst) + 1e-12) AS w FROM
          (SELECT dst, src, CASE WHEN l + t >= 0 THEN l + t ELSE 0.2::DOUBLE * (l + t) END AS w FROM edges
           JOIN (SELECT id, sum(v * CAST((j * 5) % 7 - 3 AS DOUBLE) / 10) AS l FROM h2 GROUP BY id) a ON a.id = dst
           JOIN (SELECT id, sum(v * CAST((j * 5 + 2) % 7 - 3 AS DOUBLE) / 10) AS t FROM h2 GROUP BY id) b ON b.id = src)) JOIN h2 ON h2.id = src GROUP BY dst, j""",
        "gin": f"SELECT id, j, {r('2 * h2.v + agg2.v')} AS v FROM h2 JOIN agg2 USING (id, j)",
        "sage": f"SELECT id, j, {r('agg2.v / s + h2.v')} AS v FROM h2 JOIN agg2 USING (id, j) JOIN deg USING (id)",
    }[kind]
    return "WITH " + ",\n".join([*(CTE[c] for c in base.split()), first, h2, agg2]) + "\n" + tail


for _kind in S.LAYERS:

    def _layer(spark, sf, kind=_kind):
        """One layer, rewritten."""
        return to_long(program(spark, sf, rewrites.optimise(S.model(kind, (64, H), last_relu=True)), kind, (64, H)))

    def _plain(spark, sf, kind=_kind):
        """The same program as written: every rewrite off."""
        return to_long(program(spark, sf, S.model(kind, (64, H), last_relu=True), kind, (64, H)))

    def _stack(spark, sf, kind=_kind):
        return to_long(program(spark, sf, rewrites.optimise(S.model(kind, (64, H, H))), kind, (64, H, H)))

    query(LAYER[_kind], f"{_kind}_layer")(_layer)
    query(LAYER[_kind], f"{_kind}_layer_as_written")(_plain)
    query(_two_layers(_kind), f"{_kind}_2layer")(_stack)


@query(GCN)
def gcn_fused_scales(spark, sf):
    m = rewrites.fuse_scales(rewrites.reorder(S.model("gcn", (64, H), last_relu=True)))
    return to_long(program(spark, sf, m, "gcn", (64, H)))


@query(GCN)
def gcn_hoisted(spark, sf):
    """The invariant prefix made first and handed in."""
    m = rewrites.hoist(S.model("gcn", (64, H), last_relu=True))
    g, x = D.graph(spark, sf), D.features(spark, sf)
    prefix = [op for op in m.ops if op.invariant]
    env = lower.execute(m.with_ops(prefix), g, x, {}, 64)
    return to_long(lower.run(m, g, x, parameters("gcn", (64, H)), 64, known=env))


@query(with_("n edges feat w h deg norm gcn mask", LONG + "gcn WHERE id IN (SELECT id FROM mask WHERE train)"))
def gcn_train_rows(spark, sf):
    """The receptive field of the training rows only."""
    m = rewrites.restrict(rewrites.optimise(S.model("gcn", (64, H), last_relu=True)))
    return to_long(program(spark, sf, m, "gcn", (64, H), rows=D.masks(spark, sf).where("train")))


@query(with_("n edges feat", f"SELECT dst AS id, b.j::INT AS j, {r('sum(x * (((k * 7 + b.j * 3) % 11 - 5)::DOUBLE / 10))')} AS v FROM edges JOIN (SELECT * FROM feat WHERE k < 4) f ON f.id = src, range(8) b(j) GROUP BY dst, b.j"))
def ffn_recompute(spark, sf):
    """A widening layer that an aggregate and a sum use: aggregated narrow."""
    b = S.Builder()
    wide = b.add(S.FFN, "features", weight="w0", in_dim=4, out_dim=H)
    agg = b.add(S.AGGREGATE, wide)
    out = b.add(S.ADD, agg, b.add(S.EPS_SCALE, wide, value=-1.0))
    m = rewrites.recompute(S.ModelSpec(tuple(b.ops), out))
    x = tiling.dense_slice(D.features(spark, sf), 0, 4)
    return to_long(lower.run(m, D.graph(spark, sf), x, {"w0": D.weights(4, H)}, 4))


# transforms


def _sampled(factor: int, shift: int, n: int) -> str:
    return with_("n edges", f"""SELECT d.dst, p.src, CAST(i AS INT) AS i FROM (SELECT dst, count(*) AS deg FROM edges GROUP BY dst) d, range({n}) t(i)
      JOIN (SELECT dst, src, row_number() OVER (PARTITION BY dst ORDER BY src) - 1 AS place FROM edges) p ON p.dst = d.dst AND p.place = (i * {factor} + {shift}) % d.deg""")


@query(_sampled(5, 7, 20))
def sample_affine(spark, sf):
    return sampling.affine(D.edges(spark, sf), 20)


_DRAWN = np.random.default_rng(7).integers(0, 101, 2)


@query(_sampled(int(_DRAWN[0]), int(_DRAWN[1]), 10))
def sample_dynamic(spark, sf):
    return sampling.dynamic(D.edges(spark, sf), 10, np.random.default_rng(7))


@query(with_("n edges", "SELECT dst, CAST(10 AS BIGINT) AS n, least(10, count(*)) AS senders FROM edges GROUP BY dst"))
def sample_random(spark, sf):
    """What any random sample with wrap-around has: n edges, each neighbour once before any repeats."""
    return sampling.shuffled(D.edges(spark, sf), 10).groupBy("dst").agg(F.count("*").alias("n"), F.countDistinct("src").alias("senders"))


@query(with_("n edges feat w h", f"""SELECT s.dst AS id, j, {r('sum(v)')} AS v FROM ({_sampled(5, 7, 20).split(CTE['edges'])[1]}) s JOIN h ON h.id = s.src GROUP BY s.dst, j"""))
def sampled_aggregate(spark, sf):
    e = sampling.affine(D.edges(spark, sf), 20)
    return to_long(N.aggregate(Graph(e), hidden(spark, sf), "sum", H))


@query(with_("n edges mask", "SELECT dst, src FROM edges WHERE dst IN (SELECT id FROM mask WHERE train UNION SELECT src FROM edges JOIN mask ON id = dst WHERE train)"))
def khop_subgraph(spark, sf):
    return subgraphs.receptive_field(D.edges(spark, sf), D.masks(spark, sf).where("train"), 2)[1]


@query(with_("n edges", "SELECT dst, src FROM edges WHERE dst % 3 = 0 AND src % 3 = 0"))
def induced_subgraph(spark, sf):
    return subgraphs.induced(D.edges(spark, sf), D.features(spark, sf).where("id % 3 = 0"))


@query(with_("n mask", """SELECT id FROM (SELECT id, kind, row_number() OVER (PARTITION BY kind ORDER BY id) AS p, count(*) OVER (PARTITION BY kind) AS c FROM
  (SELECT id, CASE WHEN train AND id % 4 > 0 THEN 0 WHEN valid THEN 1 WHEN test THEN 2 ELSE 3 END AS kind FROM mask))
  WHERE CASE WHEN kind < 3 THEN p <= floor(c * 20 / 100) ELSE p > c - floor(c * 20 / 100) END"""))
def node_percent_sample(spark, sf):
    m = D.masks(spark, sf).withColumn("train", F.col("train") & (F.col("id") % 4 > 0))
    return subgraphs.percent_of_nodes(m, 20)


KEPT = """, kept AS (SELECT id FROM (SELECT id, kind, row_number() OVER (PARTITION BY kind ORDER BY id) AS i, count(*) OVER (PARTITION BY kind) AS c FROM (SELECT id, CASE WHEN train THEN 0 WHEN valid THEN 1 WHEN test THEN 2 ELSE 3 END AS kind FROM mask)) WHERE CASE WHEN kind < 3 THEN i <= floor(c * 20 / 100) ELSE i > c - floor(c * 20 / 100) END),
  perm AS (SELECT id AS old, row_number() OVER (ORDER BY id) - 1 AS new FROM kept)"""


@query(with_("n mask", KEPT + f"""
  SELECT new AS id, label, train, valid, test, {r('CAST(embedding[1] AS DOUBLE)')} AS first FROM perm JOIN embeddings ON vec_id = old JOIN mask ON id = old"""))
def sampled_dataset(spark, sf):
    """A fifth of each kind of nodes, numbered anew: their labels, masks and features."""
    _, x, y, m = subgraphs.sampled_dataset(*D.load(spark, sf), 20)
    return x.select("id", q6(F.col("vec")[0], "first")).join(y, "id").join(m, "id")


@query(with_("n edges mask", KEPT + " SELECT a.new AS dst, b.new AS src FROM edges JOIN perm a ON a.old = dst JOIN perm b ON b.old = src"))
def sampled_dataset_edges(spark, sf):
    """The edges among these nodes, under the new numbers."""
    return subgraphs.sampled_dataset(*D.load(spark, sf), 20)[0].edges


@query(with_("n edges", "SELECT dst, src FROM edges WHERE dst >= 100 AND dst < 250"))
def row_range(spark, sf):
    return subgraphs.row_range(D.edges(spark, sf), 100, 250)


@query(with_("n edges feat w h agg", LONG + "agg"))
def col_tile_spmm(spark, sf):
    return to_long(tiling.tiled_aggregate(D.edges(spark, sf), hidden(spark, sf), 100, H))


@query(with_("n edges", """SELECT CAST(tile AS BIGINT) AS tile, dst, CAST(sum(c) OVER (PARTITION BY tile ORDER BY dst) - c AS BIGINT) AS "begin", CAST(sum(c) OVER (PARTITION BY tile ORDER BY dst) AS BIGINT) AS "end"
  FROM (SELECT src // 100 AS tile, dst, count(*) AS c FROM edges GROUP BY 1, 2)"""))
def col_tile_bounds(spark, sf):
    return tiling.tile_bounds(D.edges(spark, sf), 100)


@query(with_("n edges", """SELECT CAST(tile AS BIGINT) AS tile, dst, lag(tile) OVER w IS NULL AS first, lead(tile) OVER w IS NULL AS last, CAST(coalesce(lead(tile) OVER w, -1) AS BIGINT) AS next_tile
  FROM (SELECT DISTINCT src // 100 AS tile, dst FROM edges) WINDOW w AS (PARTITION BY dst ORDER BY tile)"""))
def tile_work_mask(spark, sf):
    return tiling.work_mask(D.edges(spark, sf), 100).withColumn("next_tile", F.coalesce("next_tile", F.lit(-1).cast("long")))


@query(with_("n edges", "SELECT CAST(dst // 64 AS BIGINT) AS tile, count(DISTINCT dst) AS rows, count(*) AS n FROM edges GROUP BY 1"))
def row_tiles(spark, sf):
    return tiling.row_tiles(D.edges(spark, sf), 64)


@query(with_("n edges", """SELECT CAST(b // 1000 AS BIGINT) AS tile, min(dst) AS low, max(dst) AS high, CAST(sum(c) AS BIGINT) AS n FROM
  (SELECT dst, c, sum(c) OVER (ORDER BY dst) - c AS b FROM (SELECT dst, count(*) AS c FROM edges GROUP BY dst)) GROUP BY 1"""))
def row_tiles_nnz(spark, sf):
    return tiling.equal_edge_tiles(D.edges(spark, sf), 1000)


@query(with_("n edges", "SELECT row_number() OVER (ORDER BY n DESC, tile) - 1 AS place, tile, n FROM (SELECT CAST(dst // 64 AS BIGINT) AS tile, count(*) AS n FROM edges GROUP BY 1)"))
def row_tiles_sorted(spark, sf):
    return tiling.tiles_by_size(D.edges(spark, sf), 64)


@query(with_("n edges", "SELECT tile, n, CAST((32 - n % 32) % 32 AS BIGINT) AS padding FROM (SELECT CAST(dst // 64 AS BIGINT) AS tile, count(*) AS n FROM edges GROUP BY 1)"))
def padded_tiles(spark, sf):
    return tiling.padded(D.edges(spark, sf), 64, 32)


@query(with_("n edges", """, t AS (SELECT dst // 64 AS tile, max((dst, src)) AS e, (32 - count(*) % 32) % 32 AS lack FROM edges GROUP BY 1)
  SELECT dst, src, CAST(1 AS DOUBLE) AS w, false AS padding FROM edges
  UNION ALL SELECT e[1], e[2], CAST(0 AS DOUBLE), true FROM (SELECT e, unnest(range(lack)) FROM t)"""))
def padded_tile_edges(spark, sf):
    return tiling.padded_edges(D.edges(spark, sf), 64, 32)


@query(with_("feat", f"SELECT id, CAST(k - 16 AS INT) AS j, {r('x')} AS v FROM feat WHERE k >= 16 AND k < 24"))
def dense_slice(spark, sf):
    return to_long(tiling.dense_slice(D.features(spark, sf), 16, 8))


# losses, statistics


@query(with_("feat logits", f"SELECT {r('avg(l - v)')} AS loss FROM (SELECT id, ln(sum(exp(v))) AS l FROM logits GROUP BY id) a JOIN embeddings ON vec_id = a.id JOIN logits b ON b.id = a.id AND b.j = label WHERE a.id % 10 <= 6"))
def cross_entropy(spark, sf):
    x = tiling.dense_slice(D.features(spark, sf), 0, 10)
    return statistics.cross_entropy(x, D.labels(spark, sf), D.masks(spark, sf).where("train")).select(q6(F.col("loss"), "loss"))


@query(with_("feat w h", "SELECT id, CAST(arg_max(j, (v, -j)) AS INT) AS pred FROM h GROUP BY id"))
def argmax(spark, sf):
    return statistics.argmax(hidden(spark, sf))


@query(with_("feat logits", f"SELECT {r('100.0 * avg(CAST(pred = label AS DOUBLE))')} AS accuracy FROM (SELECT id, arg_max(j, (v, -j)) AS pred FROM logits GROUP BY id) JOIN embeddings ON vec_id = id WHERE id % 10 >= 8"))
def accuracy(spark, sf):
    x = tiling.dense_slice(D.features(spark, sf), 0, 10)
    return statistics.accuracy(x, D.labels(spark, sf), D.masks(spark, sf).where("test")).select(q6(F.col("accuracy"), "accuracy"))


@query(with_("n edges deg", f"SELECT {r('avg(s)')} AS mean, {r('var_samp(s)')} AS variance, {r('stddev_samp(s)')} AS std FROM deg"))
def mean_std(spark, sf):
    out = statistics.spread(N.degrees(D.edges(spark, sf)), "s")
    return out.select(*(q6(F.col(c), c) for c in out.columns))


@query(with_("n edges deg", f"""SELECT min(s)::BIGINT AS min_degree, max(s)::BIGINT AS max_degree, {r('avg(s)')} AS mean_degree, {r('stddev_pop(s)')} AS std_degree,
  {r('sum(-s / e * ln(s / e))')} AS entropy, {r('sum(-s / e * ln(s / e)) / ln(count(*))')} AS norm_entropy FROM deg, (SELECT sum(s) AS e FROM deg)"""))
def degree_stats(spark, sf):
    out = statistics.degree_statistics(D.edges(spark, sf))
    return out.select("min_degree", "max_degree", *(q6(F.col(c), c) for c in out.columns[2:]))


@query(with_("n edges deg", f"SELECT {r('sum(-c / t * ln(c / t))')} AS entropy FROM (SELECT count(*)::DOUBLE AS c, (SELECT count(*) FROM deg, n WHERE id < floor(n.c * 20 / 100))::DOUBLE AS t FROM deg, n WHERE id < floor(n.c * 20 / 100) GROUP BY s)"))
def degree_entropy(spark, sf):
    return statistics.degree_histogram_entropy(D.edges(spark, sf), 20, D.node_count(spark, sf)).select(q6(F.col("entropy"), "entropy"))


@query(with_("n edges", f"SELECT {r('sqrt(avg(abs(dst - src)))')} AS distance, {r('sqrt(avg(g))')} AS gap FROM (SELECT dst, src, src - lag(src) OVER (PARTITION BY dst ORDER BY src) AS g FROM edges)"))
def locality_gap(spark, sf):
    return statistics.locality(D.edges(spark, sf)).select(q6(F.col("distance"), "distance"), q6(F.col("gap"), "gap"))


@query(with_("n edges", "SELECT " + ", ".join(f"{r(f'avg(CASE WHEN p IS NULL OR src // {s} <> p // {s} THEN 1.0::DOUBLE ELSE 0 END)')} AS ratio_{s}" for s in (1, 4, 8, 16, 32, 64)) + " FROM (SELECT src, lag(src) OVER (PARTITION BY dst ORDER BY src) AS p FROM edges)"))
def locality_ratios(spark, sf):
    out = statistics.locality_ratios(D.edges(spark, sf))
    return out.select(*(q6(F.col(c), c) for c in out.columns))


@query(with_("n edges deg", f"""SELECT CAST(min(s) FILTER (i >= ceil(c * 0.25)) AS BIGINT) AS q1, CAST(min(s) FILTER (i >= ceil(c * 0.5)) AS BIGINT) AS median, CAST(min(s) FILTER (i >= ceil(c * 0.75)) AS BIGINT) AS q3,
  CAST(max(s) - min(s) AS BIGINT) AS spread, {r('sum((2 * i - c - 1) * s) / (max(c) * sum(s))')} AS gini, {r('sum(s) FILTER (i > floor(c * 0.9)) / sum(s)')} AS top_share
  FROM (SELECT s, row_number() OVER (ORDER BY s) AS i, count(*) OVER () AS c FROM deg)"""))
def degree_distribution(spark, sf):
    return statistics.distribution(D.edges(spark, sf)).select("q1", "median", "q3", "spread", q6(F.col("gini"), "gini"), q6(F.col("top_share"), "top_share"))


def _described(suffix: str, where: str) -> str:
    """Statistics over elements, each a row, in SQL of its own."""
    return f"""(SELECT counted, min(v)::DOUBLE AS min{suffix}, max(v)::DOUBLE AS max{suffix}, {r('avg(v)')} AS mean{suffix}, median(v)::DOUBLE AS median{suffix}, {r('var_pop(v)')} AS variance{suffix}, {r('stddev_pop(v)')} AS stddev{suffix},
    {r('sum((2 * i - n - 1) * v) / (max(n) * sum(v))')} AS gini{suffix}, {r('min(j) FILTER (held * n >= (n - j) * t) / max(n)')} AS pratio{suffix}
    FROM (SELECT counted, v, row_number() OVER (PARTITION BY counted ORDER BY v) AS i, row_number() OVER d AS j, sum(v) OVER d AS held, count(*) OVER (PARTITION BY counted) AS n, sum(v) OVER (PARTITION BY counted) AS t
      FROM x {where} WINDOW d AS (PARTITION BY counted ORDER BY v DESC ROWS UNBOUNDED PRECEDING)) GROUP BY counted)"""


@query(with_("n edges", f""", x AS (
    SELECT 'row' AS counted, id, count(dst) AS v FROM (SELECT unnest(range(c)) AS id FROM n) LEFT JOIN edges ON dst = id GROUP BY ALL
    UNION ALL SELECT 'column', id, count(src) FROM (SELECT unnest(range(c)) AS id FROM n) LEFT JOIN edges ON src = id GROUP BY ALL
    UNION ALL SELECT 'row_block', id, count(dst) FROM (SELECT unnest(range((c + 31) // 32)) AS id FROM n) LEFT JOIN edges ON dst // 32 = id GROUP BY ALL
    UNION ALL SELECT 'column_block', id, count(src) FROM (SELECT unnest(range((c + 15) // 16)) AS id FROM n) LEFT JOIN edges ON src // 16 = id GROUP BY ALL
    UNION ALL SELECT 'tile', id, count(dst) FROM (SELECT unnest(range(((c + 31) // 32) * ((c + 15) // 16))) AS id, (c + 15) // 16 AS m FROM n) LEFT JOIN edges ON dst // 32 = id // m AND src // 16 = id % m GROUP BY ALL)
  SELECT t.*, a.* EXCLUDE (counted), b.* EXCLUDE (counted) FROM (SELECT counted, count(*) FILTER (v > 0) AS nonzero, sum(v)::DOUBLE AS sum, count(*) AS nelems, {r('count(*) FILTER (v > 0) / count(*)')} AS nonzero_ratio FROM x GROUP BY counted) t
  JOIN {_described('', '')} a ON a.counted = t.counted JOIN {_described('_nz', 'WHERE v > 0')} b ON b.counted = t.counted"""))
def matrix_distributions(spark, sf):
    """All statistics of rows, columns, blocks and tiles."""
    n = D.node_count(spark, sf)
    out = statistics.distributions(D.edges(spark, sf), n, n, 32, 16)
    exact = {"counted", "nonzero", "nelems", "sum", "min", "max", "median", "min_nz", "max_nz", "median_nz"}
    return out.select(*(F.col(c) if c in exact else q6(F.col(c), c) for c in out.columns))


@query(with_("n edges deg", f"SELECT n.c AS n, CAST(sum(s) AS BIGINT) AS e, CAST(max(s) AS BIGINT) AS max_degree, {r('sum(s) / (n.c * n.c)')} AS density FROM deg, n GROUP BY n.c"))
def graph_stats(spark, sf):
    return statistics.graph_statistics(D.edges(spark, sf), D.features(spark, sf)).select("n", "e", "max_degree", q6(F.col("density"), "density"))


# orders


@query(with_("n edges", "SELECT n.c - 1 - dst AS dst, n.c - 1 - src AS src FROM edges, n"))
def permute(spark, sf):
    nodes = D.features(spark, sf)
    return reorder.permute(D.edges(spark, sf), reorder.reversed_order(nodes, D.node_count(spark, sf)))


@query(with_("feat w h", LONG + "h"))
def permute_there_and_back(spark, sf):
    nodes = hidden(spark, sf)
    perm = reorder.reversed_order(nodes, D.node_count(spark, sf))
    return to_long(reorder.permute_nodes(reorder.permute_nodes(nodes, perm), perm, inverse=True))


@query(with_("n edges", "SELECT dst, src, row_number() OVER (PARTITION BY dst ORDER BY CASE WHEN src % 17 = 0 THEN -src END ASC NULLS LAST, src) - 1 AS place FROM edges"))
def col_reorder(spark, sf):
    listed = D.features(spark, sf).where("id % 17 = 0").select("id", (-F.col("id")).alias("rank"))
    return reorder.listed_first(D.edges(spark, sf), listed)


@query(with_("n edges", 'SELECT src AS old, row_number() OVER (ORDER BY count(*) DESC, src) - 1 AS "new" FROM edges GROUP BY src'))
def degree_relabel(spark, sf):
    return reorder.by_degree(D.edges(spark, sf))


@query(with_("n edges", "SELECT src AS id, count(*) AS n FROM edges GROUP BY src HAVING count(*) > 100"))
def dense_columns(spark, sf):
    return reorder.dense_columns(D.edges(spark, sf), 100)


@query(with_("n edges", "SELECT dst FROM edges GROUP BY dst HAVING bool_or(src % 101 = 0)"))
def boundary_rows(spark, sf):
    marked = D.edges(spark, sf).withColumn("src", F.when(F.col("src") % 101 == 0, -1).otherwise(F.col("src")))
    return reorder.boundary_rows(marked)


@query(with_("n edges", "SELECT CAST(0 AS BIGINT) AS only_a, count(*) FILTER (dst % 7 = 0) AS only_b FROM edges"))
def graph_equal(spark, sf):
    e = D.edges(spark, sf)
    return reorder.same_edges(e.where("dst % 7 <> 0"), e)


@query(with_("n edges", "SELECT dst, src, row_number() OVER (ORDER BY dst, src) - 1 AS place FROM edges"))
def coo_row_order(spark, sf):
    return reorder.row_order(D.edges(spark, sf))


@query(with_("n edges", "SELECT dst, src, row_number() OVER (ORDER BY src, dst) - 1 AS place FROM edges"))
def coo_column_order(spark, sf):
    return reorder.column_order(D.edges(spark, sf))


@query(with_("n edges", """, p AS (SELECT dst * 4000037 AS dst, src * 4000037 AS src FROM edges)
  SELECT dst, src, CAST(CAST(list_sum([CAST((dst >> k) & 1 AS HUGEINT) << (2 * k + 1) for k in range(32)]) + list_sum([CAST((src >> k) & 1 AS HUGEINT) << (2 * k) for k in range(32)]) AS HUGEINT) AS VARCHAR) AS code FROM p"""))
def morton(spark, sf):
    """Z-order codes of numbers of up to 32 bits, as unsigned text."""
    wide = D.edges(spark, sf).select((F.col("dst") * 4000037).alias("dst"), (F.col("src") * 4000037).alias("src"))
    code = reorder.morton(F.col("dst"), F.col("src")).cast("decimal(20,0)")
    return wide.select("dst", "src", F.when(code < 0, code + F.expr("18446744073709551616BD")).otherwise(code).cast("decimal(20,0)").cast("string").alias("code"))


@query("""WITH p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)
  SELECT a.id AS dst, b.id AS src FROM p a, p b WHERE a.id <> b.id AND power(a.x - b.x, 2) + power(a.y - b.y, 2) < 0.05::DOUBLE * 0.05::DOUBLE""")
def rgg_range_join(spark, sf):
    points = D.features(spark, sf).select("id", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y"))
    return generate.radius_edges(points, 0.05)


@query()
def rmat(spark, sf):
    return generate.rmat(spark, 12, 20_000, mirrored=True)


@query()
def train_gcn(spark, sf):
    """Three steps of training; rows only, for the weights begin at random."""
    g, x, y, m = D.load(spark, sf)
    _, history = training.train_gcn(g, x, y, m, (64, H, 10), 3)
    return spark.createDataFrame([(r["step"], r["loss"], r["accuracy"]) for r in history], "step int, loss double, accuracy double")


# the model language

PROGRAM = """
G = load_dataset("derived");
aggrFn = dsl.get_aggregate(fn = dsl.fn.{fn});
edgeFn = dsl.get_edge_aggregate(fn = dsl.fn.sum);
L = layer(G, hs, nonln_fn, aggregate_fn, edge_fn) {{
{body}
}}
M = model(G, non_ln) {{
  l1 = L(G, 8, non_ln, aggrFn, edgeFn);
}}
m = M(G, dsl.non_ln.ReLU);
m.train(iters=1, validation_step=1);
r = m.eval();
G=G.set_undirected(false);
G=G.set_unweighted(true);
feature_size(64);
label_size(10);
G=G.is_sparser(true);
aggrFn=aggrFn.coarsen(2);
"""
BODIES = {
    "gcn": "deg = G.graphs.degrees(); norm = dsl.fn.pow(deg, -0.5); res = norm * G.node.feats; res = aggregate_fn(G.graphs, res); res = dsl.nn.ffn(res, out=hs); res = norm * res; G.node.feats = nonln_fn(res);",
    "gat": "res = dsl.nn.ffn(G.node.feats, out=hs); attnL = dsl.nn.ffn(res, out=1); attnR = dsl.nn.ffn(res, out=1); attn = edge_fn(G, attnL, attnR); G.edges.vals = dsl.fn.softmax(G, attn); res = aggregate_fn(G.graphs, res); G.node.feats = nonln_fn(res);",
    "gin": "res_n = aggregate_fn(G.graphs, G.node.feats); res = dsl.nn.scalar(1) * G.node.feats; res = res + res_n; res = dsl.nn.ffn(res, out=hs); G.node.feats = nonln_fn(res);",
    "sage": "res_n = aggregate_fn(G.graphs, G.node.feats); res = dsl.nn.ffn(res_n, out=hs) + dsl.nn.ffn(res, out=hs); G.node.feats = nonln_fn(res);",
}


def bind(m: S.ModelSpec) -> dict[str, list[list[float]]]:
    """The queries' weights under a parsed program's own names."""
    out, attention = {}, 0
    for op in m.ops:
        if op.kind == S.ATTEN and op.weight not in out:
            out[op.weight] = [[x] for x in D.attention_vector(op.in_dim, 2 * attention)]
            attention += 1
        elif op.kind == S.FFN and op.weight not in out:
            out[op.weight] = D.weights(op.in_dim, op.out_dim)
    return out


for _kind in BODIES:

    def _program(spark, sf, kind=_kind):
        """Parsed, rewritten by its schedule, and run."""
        m = dsl.parse(PROGRAM.format(fn="mul_mean" if kind == "sage" else "mul_sum", body=BODIES[kind]))[0]
        weights = bind(m)
        return to_long(lower.run(rewrites.optimise(m), D.graph(spark, sf), D.features(spark, sf), weights, 64))

    query(LAYER[_kind], f"dsl_{_kind}")(_program)


def edge_function(spark, sf, fn: str, args: str) -> DataFrame:
    """The attention layer with another function of an edge's ends."""
    body = BODIES["gat"].replace("edge_fn(G, attnL, attnR)", f"edge_fn(G, {args})")
    text = PROGRAM.format(fn="mul_sum", body=body).replace("get_edge_aggregate(fn = dsl.fn.sum)", f"get_edge_aggregate(fn = dsl.fn.{fn})")
    m = rewrites.prune(dsl.parse(text)[0])
    return to_long(lower.run(m, D.graph(spark, sf), D.features(spark, sf), bind(m), 64))


def _attended(z: str, ctes: str) -> str:
    return with_(f"n edges feat w h {ctes}".strip(), f""", lz AS ({z}), {CTE['alpha']}
  SELECT dst AS id, j, {r('greatest(0.0, sum(w * v))')} AS v FROM alpha JOIN h ON id = src GROUP BY dst, j""")


@query(_attended("SELECT dst, src, al.s * ar.s AS w FROM edges JOIN al ON al.id = dst JOIN ar ON ar.id = src", "al ar"))
def dsl_edge_mul(spark, sf):
    return edge_function(spark, sf, "mul", "attnL, attnR")


@query(_attended("SELECT dst, src, sum(a.v * b.v) AS w FROM edges JOIN h a ON a.id = dst JOIN h b ON b.id = src AND a.j = b.j GROUP BY dst, src", ""))
def dsl_edge_dot(spark, sf):
    return edge_function(spark, sf, "dot", "res, res")


def scheduled(spark, sf, kind: str, *lines: str) -> DataFrame:
    text = PROGRAM.format(fn="mul_mean" if kind == "sage" else "mul_sum", body=BODIES[kind]) + "\n".join(lines)
    m = dsl.parse(text)[0]
    return to_long(lower.run_program(rewrites.optimise(m), D.graph(spark, sf), D.features(spark, sf), bind(m), 64))


@query(GCN.replace(CTE["edges"], CTE["edges"].replace("edges AS", "e0 AS", 1) + ",\nedges AS (SELECT dst, src FROM e0 UNION SELECT src, dst FROM e0)"))
def dsl_gcn_undirected(spark, sf):
    return scheduled(spark, sf, "gcn", "G=G.set_undirected(true);")


@query(GIN)
def dsl_gin_tiled(spark, sf):
    return scheduled(spark, sf, "gin", "G=G.col_tile(100);")


@query(with_("n edges feat w h", f"""SELECT s.dst AS id, j, {r('greatest(0.0, sum(v) / 20)')} AS v FROM ({_sampled(5, 7, 20).split(CTE['edges'])[1]}) s JOIN h ON h.id = s.src GROUP BY s.dst, j"""))
def dsl_gcn_data_sample(spark, sf):
    return scheduled(spark, sf, "gcn", "G=G.sample(20);", "G=G.is_sparser(false);")


@query(with_("n edges feat w h", f"""SELECT s.dst AS id, j, {r('greatest(0.0, sum(v) / 20)')} AS v FROM ({_sampled(5, 7, 20).split(CTE['edges'])[1]}) s JOIN h ON h.id = s.src GROUP BY s.dst, j"""))
def dsl_gcn_kernel_sample(spark, sf):
    return scheduled(spark, sf, "gcn", "aggrFn=aggrFn.sample(20);", "G=G.is_sparser(false);")


@query()
def train_gat(spark, sf):
    """Two steps of training by the general gradients; rows only."""
    g, x, y, m = D.load(spark, sf)
    _, history = autodiff.train(rewrites.hoist(S.model("gat", (64, H, 10))), g, x, y, m, 64, 2)
    return spark.createDataFrame([(r["step"], r["loss"], r["accuracy"]) for r in history], "step int, loss double, accuracy double")


# programs from text to results


def trained(kind: str, *lines: str, iters: int = 2) -> str:
    """A program of one layer whose outputs are the labels' logits."""
    text = PROGRAM.format(fn="mul_sum", body=BODIES[kind]).replace("L(G, 8, non_ln, ", "L(G, G.labels.size(), null, ").replace("iters=1", f"iters={iters}")
    return text + "\n".join(("print_accuracy(true);", *lines))


def outcome(spark: SparkSession, sf: str, text: str) -> programs.Outcome:
    return programs.run(spark, text, {"derived": lambda s: D.load(s, sf)}, bind)[0]


def steps(spark: SparkSession, sf: str, text: str) -> DataFrame:
    done = outcome(spark, sf, text).steps(spark)
    return done.select("step", q6(F.col("loss"), "loss"), q6(F.col("accuracy"), "accuracy"))


def _measured(step: int, z: str) -> str:
    """Loss over training nodes and accuracy over test nodes of logits ``z``."""
    return f"""SELECT CAST({step} AS INT) AS step, (SELECT {r('avg(l - v)')} FROM (SELECT id, ln(sum(exp(v))) AS l FROM {z} GROUP BY id) a JOIN embeddings ON vec_id = a.id JOIN {z} b ON b.id = a.id AND b.j = label WHERE a.id % 10 <= 6) AS loss,
      (SELECT {r('100.0 * avg(CAST(pred = label AS DOUBLE))')} FROM (SELECT id, arg_max(j, (v, -j)) AS pred FROM {z} GROUP BY id) JOIN embeddings ON vec_id = id WHERE id % 10 >= 8) AS accuracy"""


def _two_steps(prefix: str) -> str:
    """Two steps of softmax regression on ``p`` (id, k, x): the first moves every
    weight by the rate against its gradient's sign, as the optimiser's first does."""
    return f"""{prefix},
      w1 AS (SELECT CAST(a.k AS INT) AS k, CAST(b.j AS INT) AS j, CAST((a.k * 7 + b.j * 3) % 11 - 5 AS DOUBLE) / 10 AS w FROM range(64) a(k), range(10) b(j)),
      z1 AS (SELECT id, j, sum(x * w) AS v FROM p JOIN w1 USING (k) GROUP BY id, j),
      d1 AS (SELECT id, j, exp(v) / sum(exp(v)) OVER (PARTITION BY id) - CASE WHEN j = label THEN 1.0::DOUBLE ELSE 0 END AS d FROM z1 JOIN embeddings ON vec_id = id WHERE id % 10 <= 6),
      g1 AS (SELECT k, j, sum(x * d) / (SELECT count(*) FROM embeddings WHERE vec_id % 10 <= 6) + 5e-4 * any_value(w) AS g FROM p JOIN d1 USING (id) JOIN w1 USING (k, j) GROUP BY k, j),
      w2 AS (SELECT k, j, w - 0.01::DOUBLE * g / (abs(g) + 1e-8) AS w FROM w1 JOIN g1 USING (k, j)),
      z2 AS (SELECT id, j, sum(x * w) AS v FROM p JOIN w2 USING (k) GROUP BY id, j)
      {_measured(1, 'z1')} UNION ALL {_measured(2, 'z2')}"""


@query(_two_steps(with_("n edges feat deg norm", "").rstrip() + ",\np AS (SELECT dst AS id, k, a.s * sum(b.s * x) AS x FROM edges JOIN norm b ON b.id = src JOIN feat f ON f.id = src JOIN norm a ON a.id = dst GROUP BY dst, k, a.s)"))
def dsl_train_gcn(spark, sf):
    """A parsed program trained: the invariant prefix once, losses from the
    receptive field of the training nodes."""
    return steps(spark, sf, trained("gcn", "training_subgraph(true);", "train_code_motion(true);"))


@query(_two_steps(with_("n edges feat", "").rstrip() + f""",
      p AS (SELECT s.dst AS id, k, sum(x) / 20 AS x FROM ({_sampled(5, 7, 20).split(CTE['edges'])[1]}) s JOIN feat f ON f.id = s.src GROUP BY s.dst, k)"""))
def dsl_train_gcn_sampled(spark, sf):
    """Trained on sampled edges in tiles, without code motion."""
    return steps(spark, sf, trained("gcn", "aggrFn=aggrFn.sample(20);", "G=G.col_tile(100);", "G=G.is_sparser(false);", "train_code_motion(false);"))


@query(with_("n edges feat", f"""w10 AS (SELECT CAST(a.k AS INT) AS k, CAST(b.j AS INT) AS j, CAST((a.k * 7 + b.j * 3) % 11 - 5 AS DOUBLE) / 10 AS w FROM range(64) a(k), range(10) b(j)),
      h10 AS (SELECT id, j, sum(x * w) AS v FROM feat JOIN w10 USING (k) GROUP BY id, j),
      s10 AS (SELECT id, sum(v * CAST((j * 5) % 7 - 3 AS DOUBLE) / 10) AS l, sum(v * CAST((j * 5 + 2) % 7 - 3 AS DOUBLE) / 10) AS r FROM h10 GROUP BY id),
      e10 AS (SELECT dst, src, a.l + b.r AS z FROM edges JOIN s10 a ON a.id = dst JOIN s10 b ON b.id = src),
      x10 AS (SELECT dst, src, least(exp(CASE WHEN z >= 0 THEN z ELSE 0.2::DOUBLE * z END), 1e12) AS x FROM e10),
      a10 AS (SELECT dst, src, x / (sum(x) OVER (PARTITION BY dst) + 1e-12) AS w FROM x10),
      z1 AS (SELECT dst AS id, j, sum(w * v) AS v FROM a10 JOIN h10 ON id = src GROUP BY dst, j)
      {_measured(1, 'z1')}""").replace(CTE["feat"] + "\n", CTE["feat"] + ",\n"))
def dsl_train_gat(spark, sf):
    """The first step of an attention program, in tiles; its attention vectors by ``init_weight``."""
    text = trained("gat", "G=G.col_tile(100);", iters=1)
    for end, name in (("src", "attnL"), ("dst", "attnR")):
        text = text.replace(f"{name} = dsl.nn.ffn(res, out=1)", f"{name} = dsl.nn.init_weight() * res.{end}")
    return steps(spark, sf, text)


_MIRRORED = CTE["edges"].replace("edges AS", "e0 AS", 1) + ",\nedges AS (SELECT dst, src FROM e0 UNION SELECT src, dst FROM e0)"


@query(with_("n edges feat w h deg norm gcn", f"SELECT id, j, {r('v')} AS v, (SELECT CASE WHEN count(*) > 0.001 * c * c THEN c // 5 ELSE -1 END FROM e0, n GROUP BY c) AS col_tile FROM gcn").replace(CTE["edges"], _MIRRORED))
def dsl_opt_input(spark, sf):
    """A program without sizes; its schedule is chosen from its input."""
    lines = [line for line in PROGRAM.format(fn="mul_sum", body=BODIES["gcn"]).splitlines() if not line.startswith(("G=G.", "feature_size", "label_size", "aggrFn=", "m.train"))]
    done = outcome(spark, sf, "\n".join(lines) + '\nG=G.opt_input("derived");')
    return to_long(done.result).withColumn("col_tile", F.lit(done.spec.schedule.col_tile or -1).cast("long"))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
