"""Nearest and as-of joins by one pass over the union of both sides, and the piecewise-linear time map."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bounds(rows: DataFrame, marks: DataFrame, by: list[str], at: str, key: str) -> DataFrame:
    """Each row with the last mark at or before it (``before``) and the first at or after it (``after``).

    One shuffle for both sides; no pair of rows and marks is ever made.
    """
    left = rows.withColumn("_mark", F.lit(None).cast(rows.schema[at].dataType))
    right = marks.select(*by, F.col("at").cast(rows.schema[at].dataType).alias(at)).withColumn("_mark", F.col(at))
    both = left.unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(at)
    out = both.withColumn("before", F.last("_mark", True).over(w.rangeBetween(Window.unboundedPreceding, 0))).withColumn("after", F.first("_mark", True).over(w.rangeBetween(0, Window.unboundedFollowing)))
    return out.filter(F.col(key).isNotNull()).drop("_mark")


def nearest(rows: DataFrame, marks: DataFrame, by: list[str], at: str, key: str) -> DataFrame:
    """``nearest`` mark and its ``distance``; the earlier one on ties, null without marks."""
    out = bounds(rows, marks, by, at, key)
    down, up = F.col(at) - F.col("before"), F.col("after") - F.col(at)
    early = F.col("after").isNull() | (down <= up)
    return out.withColumn("nearest", F.when(early & F.col("before").isNotNull(), F.col("before")).otherwise(F.col("after"))).withColumn("distance", F.abs(F.col(at) - F.col("nearest"))).drop("before", "after")


def projected(rows: DataFrame, regions: DataFrame, by: list[str], at: str, key: str, reverse: bool = False) -> DataFrame:
    """Move ``at`` by the offset interpolated between region centres, flat outside, never below 0.

    ``regions`` has start, stop and offset. With ``reverse`` the centres lie on the moved line.
    """
    centre = (F.col("start") + F.col("stop")) / 2.0 + (F.col("offset") if reverse else F.lit(0.0))
    marks = regions.select(*by, centre.alias("at"), F.struct(centre.alias("at"), F.col("offset").cast("double").alias("offset")).alias("_mark"))
    left = rows.withColumn("_at", F.col(at).cast("double"))
    both = left.unionByName(marks.withColumnRenamed("at", "_at"), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("_at")
    both = both.withColumn("_lo", F.last("_mark", True).over(w.rangeBetween(Window.unboundedPreceding, 0))).withColumn("_hi", F.first("_mark", True).over(w.rangeBetween(0, Window.unboundedFollowing)))
    t0, o0, t1, o1 = F.col("_lo.at"), F.col("_lo.offset"), F.col("_hi.at"), F.col("_hi.offset")
    inside = F.when(t1 == t0, o0).otherwise(o0 + (F.col("_at") - t0) / (t1 - t0) * (o1 - o0))
    offset = F.when(F.col("_lo").isNull(), F.coalesce(o1, F.lit(0.0))).when(F.col("_hi").isNull(), o0).otherwise(inside)
    moved = F.greatest(F.lit(0.0), F.col("_at") - offset if reverse else F.col("_at") + offset)
    return both.filter(F.col(key).isNotNull()).withColumn("projected", moved).drop("_at", "_mark", "_lo", "_hi")


#: Vectors of a block, about.
BLOCK = 512


def blocks(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """The rows in blocks: ``ids`` and ``vectors`` of each."""
    n = math.ceil(rows.count() / BLOCK) or 1
    held = F.collect_list(F.struct(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("x"))).alias("held")
    dealt = rows.groupBy(F.pmod(F.xxhash64(key), F.lit(n)).alias("block")).agg(held).repartition(min(n, 64), "block")
    return dealt.select(F.col("held.id").alias("ids"), F.col("held.x").alias("vectors"))


def _unit(vectors: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length, the positions and the unit vectors; one without length stays zero."""
    lengths = vectors.value_lengths().fill_null(-1).to_numpy()
    out = {}
    for size in np.unique(lengths[lengths >= 0]).tolist():
        at = np.flatnonzero(lengths == size)
        m = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), size)
        norm = np.sqrt((m * m).sum(1, keepdims=True))
        out[size] = at, m / np.where(norm == 0, 1.0, norm)
    return out


def top_cosines(asked: DataFrame, held: DataFrame, keep: int) -> DataFrame:
    """q, vec_id, cosine (6 digits): of each pair of blocks, the ``keep`` most similar others of each query, ties to the smaller id.

    Null where a vector is null, holds a null or is of another length; null comes last.
    """
    pairs = asked.select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")).crossJoin(held.select("ids", "vectors"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                q, ids = (b.column(c)[i].values.to_numpy() for c in ("q_ids", "ids"))
                left, right = _unit(b.column("q_vectors")[i].values), _unit(b.column("vectors")[i].values)
                cosine = np.full((len(q), len(ids)), np.nan)
                for size in left.keys() & right.keys():
                    cosine[np.ix_(left[size][0], right[size][0])] = left[size][1] @ right[size][1].T
                cosine = np.round(cosine, 6)
                for k in range(len(q)):
                    other = np.flatnonzero(ids != q[k])
                    top = other[np.lexsort((ids[other], -cosine[k, other]))[:keep]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), q[k])), pa.array(ids[top]), pa.array(cosine[k, top], from_pandas=True)], ["q", "vec_id", "cosine"])

    return pairs.mapInArrow(run, "q bigint, vec_id bigint, cosine double")
