"""Search on grids: which maps have a way from the start to the goal."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.scratch import scratch


def has_goal_path(cells: DataFrame) -> DataFrame:
    """(map, reachable) of the maps in cells (map, row, col, kind): from S to G over all but H, four ways.

    Each round extends the cells found last by their neighbours (an equi-join by place) and writes them, which
    cuts the lineage; maps whose goal is found drop out.  A map without a start or goal isn't reachable.
    """
    spark, path = cells.sparkSession, scratch(cells.sparkSession, "grid")
    free = cells.where("kind <> 'H'").select("map", "row", "col", "kind")
    last, kept = free.where("kind = 'S'").withColumn("round", F.lit(0)), []
    for k in count(1):
        kept.append(f"{path}/{k}")
        last.write.parquet(kept[-1])
        last = spark.read.parquet(kept[-1])
        if last.isEmpty():
            break
        seen = spark.read.parquet(*kept)
        moves = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((0, 1), (1, 0), (0, -1), (-1, 0))]))
        open_maps = last.join(seen.where("kind = 'G'").select("map").distinct(), "map", "left_anti")
        beside = open_maps.select("map", "row", "col", moves.alias("m")).select("map", (F.col("row") + F.col("m.r")).alias("row"), (F.col("col") + F.col("m.c")).alias("col")).distinct()
        last = beside.join(free, ["map", "row", "col"]).join(seen.select("map", "row", "col"), ["map", "row", "col"], "left_anti").withColumn("round", F.lit(k))
    found = spark.read.parquet(*kept).where("kind = 'G'").select("map").distinct().withColumn("_found", F.lit(True))
    return cells.select("map").distinct().join(found, "map", "left").select("map", F.coalesce("_found", F.lit(False)).alias("reachable"))
