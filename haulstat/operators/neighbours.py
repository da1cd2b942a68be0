"""Exact nearest neighbours without comparing everything with everything."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage, spread_out

STEP = 1e-9  # distances are compared on this grid, so equal distances tie on every engine


def nearest_in_plane(queries: DataFrame, corpus: DataFrame, block: list[str], k: int) -> DataFrame:
    """The ``k`` nearest corpus rows of every query in the same block (columns ``id``, ``x``, ``y``).

    Every block is cut into grid cells sized by its own number of distinct
    points. A query looks at its cell and the ring around it; when its k-th
    distance reaches beyond that ring it goes on to a wider ring. The result
    is exact, ties go to the smaller id, and no block is ever paired as a whole.

    Repeated points cost nothing: only the first k+1 ids at one point can be
    anybody's neighbour, and queries at one point share one search of k+1
    neighbours from which each then leaves itself out.
    """
    need = k + 1
    twin = W.partitionBy(*block, "x", "y").orderBy("id")
    points = (corpus.withColumn("_t", F.row_number().over(twin)).where(F.col("_t") <= need)
              .groupBy(*block, "x", "y").agg(F.array_sort(F.collect_list("id")).alias("_ids")))
    points = cut_lineage(points)
    cells = F.floor(F.sqrt(F.count("*") / F.lit(need + 2)))
    frame = points.groupBy(*block).agg(
        F.min("x").alias("_x0"), F.min("y").alias("_y0"), F.max("x").alias("_x1"), F.max("y").alias("_y1"),
        F.greatest(F.lit(1), cells).cast("bigint").alias("_g"))
    frame = (frame.withColumn("_w", (F.col("_x1") - F.col("_x0")) / F.col("_g"))
             .withColumn("_h", (F.col("_y1") - F.col("_y0")) / F.col("_g")))

    def placed(df):
        def cell(v, v0, step):
            raw = F.when(F.col(step) > 0, F.floor((F.col(v) - F.col(v0)) / F.col(step))).otherwise(F.lit(0))
            return F.greatest(F.lit(0), F.least(F.col("_g") - 1, raw)).cast("bigint")
        return df.join(frame, block).withColumns({"_cx": cell("x", "_x0", "_w"), "_cy": cell("y", "_y0", "_h")})

    side = placed(points).select(*block, "_ids", F.col("x").alias("_nx"), F.col("y").alias("_ny"),
                                 F.col("_cx").alias("_tx"), F.col("_cy").alias("_ty"))
    spots = cut_lineage(placed(queries.select(*block, "x", "y").distinct()))
    waiting = spots.select(*block, F.col("x").alias("_qx"), F.col("y").alias("_qy"),
                           "_cx", "_cy", "_x0", "_y0", "_w", "_h", "_g")
    spot = block + ["_qx", "_qy"]
    found, ring = None, 1
    while True:
        near = F.sequence(F.lit(-ring), F.lit(ring))
        asked = (spread_out(waiting)
                 .withColumn("_tx", F.explode(F.transform(near, lambda d: F.col("_cx") + d)))
                 .where((F.col("_tx") >= 0) & (F.col("_tx") < F.col("_g")))
                 .withColumn("_ty", F.explode(F.transform(near, lambda d: F.col("_cy") + d)))
                 .where((F.col("_ty") >= 0) & (F.col("_ty") < F.col("_g")))
                 .select(*spot, "_tx", "_ty"))
        dx, dy = F.col("_nx") - F.col("_qx"), F.col("_ny") - F.col("_qy")
        pairs = asked.join(side, block + ["_tx", "_ty"]).select(
            *spot, F.floor(F.sqrt(dx * dx + dy * dy) / STEP + 0.5).alias("_d"), "_ids")
        best = W.partitionBy(*spot).orderBy("_d")
        # Points at one distance share a rank, so no tie is cut off; each point holds at least one id.
        short = pairs.withColumn("_r", F.rank().over(best)).where(F.col("_r") <= need)
        ids = F.transform("_ids", lambda i: F.struct(F.col("_d").alias("d"), i.alias("n_id")))
        lists = short.groupBy(*spot).agg(F.slice(F.array_sort(F.flatten(F.collect_list(ids))), 1, need).alias("near"))

        # Distance from the query to the border of the searched square; a border
        # at the edge of the block has nothing behind it.
        def reach(q, c, v0, step):
            low = F.when(F.col(c) - ring <= 0, F.lit(float("inf"))).otherwise(
                F.col(q) - (F.col(v0) + (F.col(c) - ring) * F.col(step)))
            high = F.when(F.col(c) + ring >= F.col("_g") - 1, F.lit(float("inf"))).otherwise(
                F.col(v0) + (F.col(c) + ring + 1) * F.col(step) - F.col(q))
            return F.least(low, high)

        safe = F.least(reach("_qx", "_cx", "_x0", "_w"), reach("_qy", "_cy", "_y0", "_h"))
        judged = cut_lineage(waiting.join(lists, spot, "left").withColumn("_safe", safe))
        far = F.element_at("near", -1)["d"] * STEP
        done = F.coalesce((F.col("_safe") == float("inf"))
                          | ((F.size("near") >= need) & (far < F.col("_safe") - 2 * STEP)), F.lit(False))
        ready = judged.where(done).select(*spot, "near")
        found = ready if found is None else found.unionByName(ready)
        waiting = judged.where(~done).drop("near", "_safe")
        if waiting.isEmpty():
            break
        ring *= 2
    mine = queries.select(*block, F.col("id").alias("q_id"), F.col("x").alias("_qx"), F.col("y").alias("_qy")).join(found, spot)
    others = F.slice(F.filter("near", lambda n: n["n_id"] != F.col("q_id")), 1, k)
    return mine.select("q_id", F.posexplode(others).alias("rank", "n")).select(
        "q_id", (F.col("rank") + 1).alias("rank"), "n.n_id", (F.col("n.d") * STEP).alias("distance"))
