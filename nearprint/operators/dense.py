"""Exact cosine similarity above a threshold for dense vectors.

Dense vectors share every slot, so terms cannot separate them; angles can.  Each vector
lives in the cell of its nearest pivot.  By the triangle inequality a vector can only be
similar to a vector of another cell if its angle to that cell's pivot is at most the
cell's radius plus the threshold angle, so it visits just those cells.  Cells are joined to
groups, and a large one is cut into several; a vector travels once to each group it visits,
however many of its cells that are.  A task holds the residents of a group, and its visitors pass
by some at a time: each time is one matrix product of bounded size.  What is shuffled grows
with the vectors times the groups, and a group holds as much as a task can.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearprint.operators.similarity import check_threshold, expand_to_documents, streamed
from nearprint.operators.tfidf import members
from nearprint.storage import materialise

#: Vectors to a pivot, and vectors that are multiplied at a time.
ROWS_PER_SLICE = 1000
#: Values of the residents of a group, and cells of a product.
HELD_VALUES = 4_000_000
PRODUCT_CELLS = 4_000_000
# Pivots travel with the plan: their number and total length have a bound.
MAX_PIVOTS = 512
MAX_PIVOT_VALUES = 1 << 20
# Angles are compared with this much slack so that rounding cannot rule out a pair.
SLACK = 1e-6


def similar_vectors(vectors: DataFrame, threshold: float, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Directed pairs ``(id, similar_id, score)`` of ``(id, encoded)`` with equal lengths.

    Equal vectors are compared once; vectors without a nonzero slot match nothing.
    """
    check_threshold(threshold)
    unit = _unit(vectors)
    classes = materialise(
        unit.groupBy("bag_key").agg(
            F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies"), F.any_value("unit").alias("unit")
        ),
        "dense",
    )
    class_vectors = classes.select(F.col("class_id").alias("id"), "unit")
    pairs = _similar_classes(class_vectors, threshold, rows_per_slice)
    return expand_to_documents(pairs, members(unit, classes))


def _unit(vectors: DataFrame) -> DataFrame:
    """``(id, unit, bag_key)``: vectors of length 1 and a digest of their values."""
    values = F.col("encoded").cast("array<double>")
    squares = F.aggregate(values, F.lit(0.0), lambda total, v: total + v * v)
    scaled = vectors.select("id", values.alias("values"), F.sqrt(squares).alias("norm")).where(F.col("norm") > 0)
    unit = scaled.select("id", F.transform("values", lambda v: v / F.col("norm")).alias("unit"))
    return unit.withColumn("bag_key", F.md5(F.to_json(F.struct("unit"))))


def _similar_classes(vectors: DataFrame, threshold: float, rows_per_slice: int) -> DataFrame:
    kind = vectors.schema["id"].dataType
    schema = T.StructType([
        T.StructField("id", kind), T.StructField("similar_id", kind), T.StructField("score", T.DoubleType()),
    ])
    placed = _homes(vectors, threshold, rows_per_slice)
    if placed is None:
        return vectors.sparkSession.createDataFrame([], schema)
    homes, visited, residents, width = placed
    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A task for each partition at least, with as little sent as that allows.
    most = math.ceil(residents.sum() / math.ceil(math.sqrt(2 * partitions)))
    first, slices = _groups(residents, max(1, min(most, HELD_VALUES // width)))
    groups = int((first + slices).max())
    parts = math.ceil(partitions / groups)
    covered = np.zeros((len(first), groups), np.float32)
    for cell, (begin, n) in enumerate(zip(first, slices, strict=True)):
        covered[cell, begin : begin + n] = 1

    @F.arrow_udf(T.IntegerType())
    def own(home: pa.Array, mixed: pa.Array) -> pa.Array:
        cell = home.to_numpy()
        return pa.array((first[cell] + mixed.to_numpy() % slices[cell]).astype("int32"))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def passed(unit: pa.Array, home: pa.Array) -> pa.Array:
        meets = visited(unit, home).astype(np.float32) @ covered > 0
        return pa.array([np.flatnonzero(row).astype("int32") for row in meets], pa.list_(pa.int32()))

    sent = homes.select(
        "id", "unit", "home", own("home", F.xxhash64("id")).alias("own"), passed("unit", "home").alias("passed"),
        F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(parts)).cast("int").alias("part"),
    )
    begin = F.col("own") * parts
    held = F.transform(F.sequence(begin, begin + parts - 1), lambda c: F.struct(c.alias("cell"), F.lit(False).alias("passing")))
    passing = F.transform("passed", lambda g: F.struct((g * parts + F.col("part")).alias("cell"), F.lit(True).alias("passing")))
    cells = sent.withColumn("seat", F.explode(F.concat(held, passing))).select("seat.cell", "seat.passing", "home", "id", "unit")

    def against(held: tuple[pa.Table, np.ndarray], rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        residents, values = held
        home, tall = residents["home"].to_numpy(), max(1, min(rows_per_slice, PRODUCT_CELLS // len(values)))
        for top in range(0, rows.num_rows, tall):
            some = rows.slice(top, tall)
            products = matrix(some.column("unit")) @ values.T
            row, column = np.nonzero(products > threshold)
            # Visitors come from lower cells only; inside a cell each pair counts once.
            of = some.column("home").to_numpy()[row]
            row, column = (x[of <= home[column]] for x in (row, column))
            found = pa.table({
                "id": residents["id"].take(pa.array(column)),
                "similar_id": some.column("id").take(pa.array(row)),
                "score": pa.array(products[row, column]),
            })
            lower = pa.array(some.column("home").to_numpy()[row] < home[column])
            yield from found.filter(pc.or_(lower, pc.less(found["id"], found["similar_id"]))).combine_chunks().to_batches()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return streamed(batches, lambda residents: (residents, matrix(residents["unit"])), against)

    scored = cells.repartitionById(groups * parts, "cell").sortWithinPartitions("cell", "passing").mapInArrow(meet, schema)
    return scored.select(
        F.least("id", "similar_id").alias("id"), F.greatest("id", "similar_id").alias("similar_id"), "score"
    )


def _groups(residents: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first group of each cell, and in how many it is: of about ``most`` residents each."""
    first, slices, group, filled = np.zeros(len(residents), np.int64), np.ones(len(residents), np.int64), 0, 0
    for cell, n in enumerate(residents.tolist()):
        if filled and filled + n > most:
            group, filled = group + 1, 0
        first[cell], slices[cell] = group, max(1, math.ceil(n / most))
        group, filled = group + slices[cell] - 1, n if slices[cell] > 1 else filled + n
    return first, slices


def _homes(vectors: DataFrame, threshold: float, rows_per_slice: int):
    """``(id, unit, home)``, what cells some vectors visit, the residents of each cell, and the width; None without vectors."""
    wanted = min(max(math.ceil(vectors.count() / rows_per_slice), 1), MAX_PIVOTS)
    width = vectors.select(F.size("unit").alias("n")).first()
    if width is None:
        return None
    wanted = max(min(wanted, MAX_PIVOT_VALUES // width["n"]), 1)
    # At most MAX_PIVOT_VALUES numbers, picked by hash so that a rerun picks the same.
    chosen = vectors.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()
    pivots = np.array([row["unit"] for row in chosen])

    @F.arrow_udf(T.StructType([T.StructField("home", T.IntegerType()), T.StructField("angle", T.DoubleType())]))
    def nearest(unit: pa.Array) -> pa.Array:
        products = matrix(unit) @ pivots.T
        angle = np.arccos(np.clip(products.max(axis=1), -1, 1))
        return pa.StructArray.from_arrays([pa.array(products.argmax(axis=1).astype("int32")), pa.array(angle)], ["home", "angle"])

    placed = materialise(vectors.select("id", "unit", nearest("unit").alias("at")).select("id", "unit", "at.home", "at.angle"), "placed")
    # One row per pivot.
    radius, residents = np.full(len(pivots), -np.inf), np.zeros(len(pivots), np.int64)
    for row in placed.groupBy("home").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).collect():
        radius[row["home"]], residents[row["home"]] = row["radius"], row["n"]
    reach = radius + math.acos(threshold) + SLACK

    def visited(unit: pa.Array, home: pa.Array) -> np.ndarray:
        angles = np.arccos(np.clip(matrix(unit) @ pivots.T, -1, 1))
        at_home = np.arange(len(pivots)) == home.to_numpy()[:, None]
        higher = np.arange(len(pivots)) > home.to_numpy()[:, None]
        return at_home | (higher & (angles <= reach))

    return placed.select("id", "unit", "home"), visited, residents, width["n"]


def _visits(vectors: DataFrame, threshold: float, rows_per_slice: int) -> DataFrame:
    """``(id, unit, home, cell)``: each vector in its home cell and the cells it must visit."""
    homes, visited, _, _ = _homes(vectors, threshold, rows_per_slice)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def cells(unit: pa.Array, home: pa.Array) -> pa.Array:
        return pa.array([np.flatnonzero(row).astype("int32") for row in visited(unit, home)], pa.list_(pa.int32()))

    return homes.select("id", "unit", "home", F.explode(cells("unit", "home")).alias("cell"))


def matrix(unit: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors as rows of one array."""
    return pc.list_flatten(unit).to_numpy().reshape(len(unit), -1)
