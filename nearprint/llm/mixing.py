"""Mixing sources to target weights, in DataFrame functions only.

Every source asks for a share of all words by its weight.  No source is repeated more than
``epochs`` times: a source whose share is larger is clamped there, and what it leaves over
is shared out anew by weight, until no share is too large.  That fixpoint has a closed
form.  With sources in order of ``cap / weight``, a prefix is clamped and all others get
``level * weight``.

A source then gives whole repetitions of all its documents and one part repetition: its
documents in the order of a seeded hash, up to the words still wanted.  The cut is found on
a histogram of the hash, so that only the documents of one of 4,096 hash ranges of a source
are ever ordered in one place.  A document on the cut is taken if at least half of it fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearprint.llm.codes import WORD
from nearprint.llm.tables import materialise, own_names

WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = "mix-1"
#: A hash has 32 bits; its upper 12 are the range it lies in.
RANGE_SIZE = 1 << 20


def draw(id_column: Column, seed: str) -> Column:
    """A hash of 32 bits; a null id counts as an empty one."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def shares(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """``(source, source_size, target)`` for ``(source, size)`` rows.

    Weights go round the sources in code point order, null last.  The windows without a key
    run over one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    at = (F.row_number().over(ordered) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (at + 1).cast("int")).cast("long")
    weighed = totals.withColumn("weight", weight).withColumn("cap", F.lit(epochs) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    up_to = by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spent = F.sum("cap").over(up_to) - F.col("cap")
    open_weight = F.sum("weight").over(whole) - (F.sum("weight").over(up_to) - F.col("weight"))
    level = (F.sum("source_size").over(whole) - spent) / open_weight
    leveled = weighed.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.max(fits).over(whole))
    return leveled.select("source", "source_size", F.coalesce(target, F.col("cap").cast("double")).alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    epochs: int = EPOCHS,
    seed: str = SEED,
    id_column: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """``(doc_id, source, size, source_size, target, whole, extra, taken)`` per document.

    ``size`` counts words.  The mix holds ``whole + extra`` copies of a document, ``taken``
    words.  Null texts have size 0; a null source is a source; null ids are drawn as one
    empty id; rows that repeat an id are documents of their own.  A document without words
    adds nothing but goes with its source's repetitions.  An empty table gives no rows.
    """
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    sizes = materialise(
        docs.select(
            F.col(id_column).alias("doc_id"), F.col(source).alias("source"), words.alias("size"),
            draw(F.col(id_column), seed).alias("draw"),
        ),
        "mix-sizes",
    )
    ranged = sizes.withColumn("range", F.floor(F.col("draw") / RANGE_SIZE))
    plan = shares(sizes, weights, epochs)
    epoch = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("whole", F.floor(epoch).cast("long"))
    plan = plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))

    # The range of the hash in which the part repetition of a source ends.
    filled = ranged.groupBy("source", "range").agg(F.sum("size").alias("words"))
    along = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = filled.withColumn("end", F.sum("words").over(along))
    cut = (
        filled.alias("f").join(plan.alias("p"), F.col("f.source").eqNullSafe(F.col("p.source")))
        .where((F.col("rest") > 0) & (F.col("end") - F.col("words") <= F.col("rest")) & (F.col("end") > F.col("rest")))
        .select(F.col("f.source").alias("cut_source"), F.col("range").alias("cut"), (F.col("end") - F.col("words")).alias("before"))
    )
    plan = materialise(
        plan.join(cut, F.col("source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source")
        # Without a cut the part repetition is empty, or all of the source.
        .withColumn("cut", F.coalesce("cut", F.when(F.col("rest") > 0, F.lit(1 << 32)).otherwise(F.lit(-1)))),
        "mix-plan",
    )
    placed = ranged.alias("d").join(
        plan.withColumnRenamed("source", "plan_source"), F.col("d.source").eqNullSafe(F.col("plan_source"))
    )
    inside = Window.partitionBy("source").orderBy("draw", F.col("doc_id").asc_nulls_last(), "size")
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    on_cut = placed.where(F.col("range") == F.col("cut"))
    reach = F.col("before") + F.sum("size").over(inside) - F.col("size") / 2
    on_cut = on_cut.withColumn("extra", (reach <= F.col("rest")).cast("long"))
    off_cut = placed.where(F.col("range") != F.col("cut"))
    off_cut = off_cut.withColumn("extra", (F.col("range") < F.col("cut")).cast("long"))
    return on_cut.unionByName(off_cut).select(
        "doc_id", "source", "size", "source_size", "target", "whole", "extra",
        ((F.col("whole") + F.col("extra")) * F.col("size")).alias("taken"),
    )


def sample(docs: DataFrame, copies: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Each row as often as ``copies(doc_id, copies)`` says, with its own columns only.

    Rows that repeat an id all get the largest number given for it.
    """
    own, times, copy = own_names(docs, "copied_id", "copies", "copy")
    counted = copies.where("copies > 0").groupBy(F.col("doc_id").alias(own)).agg(F.max("copies").cast("int").alias(times))
    joined = docs.join(counted, F.col(id_column).eqNullSafe(F.col(own)))
    repeated = joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
    return repeated.select(*docs.columns)
