"""MatrixMarket files as DataFrames: coordinate and array, general and symmetric.

Lines are split by Spark; the head (banner and size) is read from the beginning of
the first file.  Row and column numbers become 0-based.  Symmetric and skew files
list one triangle: the mirrored entries are added, negated for skew ones (unlike
readers that forget the sign).  Arrays list columns one after another, those of
one triangle packed: an entry's row and column follow from its place in closed
form.  Complex and Hermitian files are rejected.

A folder of files that are one matrix when joined in order of their names, as
``write`` makes it, is read as one.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.storage import place


class MatrixMarketError(ValueError):
    """The file is not of a kind that can be read."""


def _head(spark: SparkSession, path: str) -> tuple[str, list[str], list[int]]:
    """(first file, words of its banner, numbers of its size line)."""
    fs, root = place(spark, path)
    files = sorted(str(s.getPath()) for s in fs.listStatus(root) if s.isFile() and s.getPath().getName()[0] not in "_.")
    jvm, lines = spark.sparkContext._jvm, []
    for file in files[:1]:
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(jvm.org.apache.hadoop.fs.Path(file))))
        try:
            while (line := reader.readLine()) is not None:
                line = line.strip()
                if line and (not lines or not line.startswith("%")):
                    lines.append(line)
                if len(lines) == 2:
                    break
        finally:
            reader.close()
    if not lines or not lines[0].lower().startswith("%%matrixmarket matrix") or len(lines[0].split()) < 5:
        raise MatrixMarketError(f"{path}: no banner")
    if len(lines) < 2:
        raise MatrixMarketError(f"{path}: no size")
    return files[0], lines[0].lower().split(), [int(x) for x in lines[1].split()]


def unpacked(k: Column, n: int, skew: bool) -> tuple[Column, Column]:
    """(row, column) of the k-th entry of a packed lower triangle of n columns;
    skew ones lack the diagonal.  Column c begins at c m - c (c - 1) / 2 for m
    entries in the first: the root of that in floating point is at most one off."""
    m = n - 1 if skew else n
    start = lambda c: c * m - (c * (c - 1) / 2).cast("long")
    guess = F.floor((F.lit(2 * m + 1) - F.sqrt(F.greatest(F.lit(0.0), F.lit(float((2 * m + 1) ** 2)) - k * 8.0))) / 2).cast("long")
    c = F.when(start(guess) > k, guess - 1).when(start(guess + 1) <= k, guess + 1).otherwise(guess)
    return c + (k - start(c)) + int(skew), c


def read(spark: SparkSession, path: str) -> DataFrame:
    """(row LONG, col LONG, val DOUBLE); entries without a value have 1."""
    first, banner, size = _head(spark, path)
    _, _, layout, field, symmetry = banner[:5]
    if layout not in ("coordinate", "array") or field not in ("pattern", "integer", "real", "double") or symmetry not in ("general", "symmetric", "skew-symmetric"):
        raise MatrixMarketError(f"{path}: {layout} {field} {symmetry} is not supported")
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_name").alias("file"))
    body = lines.where("line <> '' and not startswith(line, '%')")
    size_at = body.where(F.col("file") == first.rpartition("/")[2]).agg(F.min("at").alias("at")).first().at
    data = body.where(F.col("at") != size_at)
    parts = F.split("line", r"\s+")
    if layout == "coordinate":
        value = F.lit(1.0) if field == "pattern" else parts[2].cast("double")
        entries = data.select((parts[0].cast("long") - 1).alias("row"), (parts[1].cast("long") - 1).alias("col"), value.alias("val"))
    else:
        rows, cols = size[:2]
        skew = symmetry == "skew-symmetric"
        if symmetry != "general" and rows != cols:
            raise MatrixMarketError(f"{path}: a {symmetry} matrix of {rows} x {cols}")
        want = rows * cols if symmetry == "general" else rows * (rows - 1 if skew else rows + 1) // 2
        # places are numbered within partitions, then shifted
        block = data.select("line", F.shiftright("at", 33).alias("part"), (F.col("at") % (1 << 33)).alias("place"))
        counts = {r.part: r.n for r in block.groupBy("part").agg(F.count("*").alias("n")).collect()}
        starts, total = [], 0
        for p in sorted(counts):
            starts.append((p, total))
            total += counts[p]
        if total != want:
            raise MatrixMarketError(f"{path}: {total} values for {want} of {rows} x {cols}")
        begin = F.create_map(*[F.lit(x) for pair in starts for x in pair]) if starts else F.create_map(F.lit(0).cast("long"), F.lit(0))
        index = (begin[F.col("part")] + F.row_number().over(Window.partitionBy("part").orderBy("place")) - 1).cast("long")
        listed = block.select(index.alias("i"), F.col("line").cast("double").alias("val"))
        row, col = (F.col("i") % rows, F.floor(F.col("i") / rows)) if symmetry == "general" else unpacked(F.col("i"), rows, skew)
        entries = listed.select(row.cast("long").alias("row"), col.cast("long").alias("col"), "val")
    if symmetry == "general":
        return entries
    sign = -1.0 if symmetry == "skew-symmetric" else 1.0
    return entries.unionByName(entries.where("row <> col").select(F.col("col").alias("row"), F.col("row").alias("col"), (F.col("val") * sign).alias("val")))


def edges(spark: SparkSession, path: str) -> DataFrame:
    """A matrix as weighted edges: its rows receive from its columns."""
    return read(spark, path).select(F.col("row").alias("dst"), F.col("col").alias("src"), F.col("val").alias("w"))


def write(df: DataFrame, path: str, n_rows: int, n_cols: int, field: str = "real", symmetry: str = "general") -> None:
    """Writes (row, col[, val]) as coordinates: a folder whose files, joined in
    order of their names, are one matrix; the first begins with the head.  Of a
    symmetric matrix ``df`` has the lower triangle."""
    head = [f"%%MatrixMarket matrix coordinate {field} {symmetry}", f"{n_rows} {n_cols} {df.count()}"]
    values = [] if field == "pattern" else ["val"]
    body = df.select(F.concat_ws(" ", F.col("row") + 1, F.col("col") + 1, *values).alias("value"))

    def headed(batches):
        from pyspark import TaskContext

        if TaskContext.get().partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array(head)], names=["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays(batch.columns, names=["value"])

    body.mapInArrow(headed, "value string").write.text(path)
