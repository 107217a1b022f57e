"""Places: touching grid cells, their evidence and home proposals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool import params as P
from tidepool.functions import geo
from tidepool.operators.vectors import ordered_leaders
from tidepool.plans.stored import discard, stored

#: Cells along an edge of a tile that one task labels.
TILE = 128


def tile_pieces(pdf: pd.DataFrame) -> pd.DataFrame:
    """Smallest (cy, cx) of the piece of each cell of one tile; a tile has TILE * TILE cells at most."""
    y0, x0 = pdf["cy"].min(), pdf["cx"].min()
    y, x = (pdf["cy"] - y0).to_numpy() + 1, (pdf["cx"] - x0).to_numpy() + 1
    none = np.iinfo(np.int32).max
    grid = np.full((y.max() + 2, x.max() + 2), none, np.int32)
    grid[y, x] = y * grid.shape[1] + x
    held = grid < none
    while True:
        low = grid
        for step in (1, -1):
            low = np.minimum(low, np.roll(low, step, 0))
        for step in (1, -1):
            low = np.minimum(low, np.roll(low, step, 1))
        low = np.where(held, low, none)
        # a label's own label is as small or smaller
        low = np.where(held, np.minimum(low, np.append(low.ravel(), none)[np.minimum(low, low.size)]), none)
        if (low == grid).all():
            break
        grid = low
    label = grid[y, x].astype(np.int64)
    return pdf[["cy", "cx"]].assign(py=label // grid.shape[1] - 1 + y0, px=label % grid.shape[1] - 1 + x0)


def smallest_linked(links: DataFrame) -> DataFrame:
    """(label, root) of linked labels (a, b): labels fall to the smallest neighbour's and then jump to
    their label's label, so rounds grow with the logarithm of a component's width."""
    both = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "label-links")
    now = stored(both.select(F.col("a").alias("label"), F.col("a").alias("root")).distinct(), "labels")
    while True:
        near = both.join(now.select(F.col("label").alias("b"), "root"), "b").groupBy(F.col("a").alias("label")).agg(F.min("root").alias("near"))
        low = F.least("root", "near")
        to = now.select(F.col("label").alias("low"), F.col("root").alias("further"))
        met = now.join(near, "label").select("label", "root", low.alias("low")).join(to, "low", "left")
        best = F.least("low", F.coalesce("further", "low"))
        new = stored(met.select("label", best.alias("root"), (F.col("root") != best).alias("moved")), "labels")
        moved = new.where("moved").limit(1).count()
        discard(now)
        now = new.select("label", "root")
        if not moved:
            return now


def touching_cells(cells: DataFrame) -> DataFrame:
    """(cy, cx, place): 8-connected components of distinct cells, named by their smallest cell.

    Tiles of TILE * TILE cells are labelled each in one task; only labels that touch across an
    edge of a tile are then joined in rounds, so rounds see few rows however many cells there are."""
    tile = lambda c: F.floor(F.col(c) / TILE).alias("t" + c)
    own = cells.select("cy", "cx").distinct().select("cy", "cx", tile("cy"), tile("cx"))
    named = stored(own.groupBy("tcy", "tcx").applyInPandas(lambda pdf: tile_pieces(pdf), "cy long, cx long, py long, px long"), "cells")
    label = F.struct("py", "px")
    edge = F.pmod(F.col("cy"), F.lit(TILE)).isin(0, TILE - 1) | F.pmod(F.col("cx"), F.lit(TILE)).isin(0, TILE - 1)
    around = F.expr("explode(flatten(transform(sequence(-1, 1), y -> transform(sequence(-1, 1), x -> struct(cy + y AS cy, cx + x AS cx)))))")
    border = named.where(edge)
    links = border.select(label.alias("a"), around.alias("at")).select("a", "at.*").join(border.select("cy", "cx", label.alias("b")), ["cy", "cx"]).where("a < b").select("a", "b").distinct()
    links = stored(links, "touching")
    pieces = named.select("cy", "cx", label.alias("label"))
    if not links.limit(1).count():
        return pieces.withColumnRenamed("label", "place")
    return pieces.join(smallest_linked(links), "label", "left").select("cy", "cx", F.coalesce("root", "label").alias("place"))


def places(rows: DataFrame) -> DataFrame:
    """Evidence of each place of rows (lat, lon, day, month, night) and whether it clears the home bars."""
    celled = rows.withColumn("cy", geo.cell_floor(F.col("lat"), P.CENSUS_CELL)).withColumn("cx", geo.cell_floor(F.col("lon"), P.CENSUS_CELL))
    # files are read once and summed by cell and day; nights and months count over these few rows
    sums = [F.count("*").alias("n"), F.sum("lat").alias("lat"), F.sum("lon").alias("lon")]
    daily = stored(celled.groupBy("cy", "cx", "day", "month", F.coalesce("night", F.lit(False)).alias("night")).agg(*sums), "cell-days")
    found = daily.join(touching_cells(daily), ["cy", "cx"]).groupBy("place").agg(
        F.count_distinct("day").alias("days"),
        F.count_distinct(F.when(F.col("night"), F.col("day"))).alias("night_days"),
        F.count_distinct("month").alias("months"),
        F.sum("n").alias("files"),
        F.round(F.sum("lat") / F.sum("n"), 9).alias("lat"),
        F.round(F.sum("lon") / F.sum("n"), 9).alias("lon"),
    )
    missed = F.concat_ws(",", F.when(F.col("days") < P.HOME_MIN_DAYS, "days"), F.when(F.col("night_days") < P.HOME_MIN_NIGHT_DAYS, "night_days"))
    return found.withColumn("missed", missed).withColumn("proposed", missed == "")


def near_cells(cells: DataFrame, km: float, width: float) -> DataFrame:
    """(a, b) of different cells (id, lat, lon) within km. Buckets of `width` degrees bound what
    meets: a bucket and those around it. width must be at least km in degrees of longitude."""
    y, x = F.floor(F.col("lat") / width), F.floor(F.col("lon") / width)
    left = cells.select(F.col("id").alias("a"), F.col("lat").alias("alat"), F.col("lon").alias("alon"), y.alias("y"), x.alias("x"))
    right = cells.select(F.col("id").alias("b"), F.col("lat").alias("blat"), F.col("lon").alias("blon"), F.explode(F.sequence(y - 1, y + 1)).alias("y"), F.sequence(x - 1, x + 1).alias("xs"))
    right = right.select("b", "blat", "blon", "y", F.explode("xs").alias("x"))
    close = geo.haversine_km(F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon")) <= km
    return left.join(right, ["y", "x"]).where((F.col("a") != F.col("b")) & close).select("a", "b")


def areas(rows: DataFrame, days: int = 8, months: int = 3, night: float = 0.25, merge_km: float = 2.0, fold_km: float = 5.0) -> DataFrame:
    """(seed, residence, files, days, months, night_share): cells of about 1 km go to the densest
    seed within merge_km; areas within fold_km of a residence are folded into the first one by seed.

    rows: lat, lon, day, month, night. Only cells, not rows, enter the ordered steps.
    """
    celled = rows.withColumn("cy", geo.cell_even(F.col("lat"), P.CENSUS_CELL)).withColumn("cx", geo.cell_even(F.col("lon"), P.CENSUS_CELL))
    name = F.concat_ws(":", "cy", "cx")
    cells = stored(celled.groupBy("cy", "cx").agg(F.count("*").alias("n")).select(name.alias("id"), (F.col("cy") * P.CENSUS_CELL).alias("lat"), (F.col("cx") * P.CENSUS_CELL).alias("lon"), F.struct((-F.col("n")).alias("n"), "cy", "cx").alias("rank")), "cells")
    lead = stored(ordered_leaders(cells.select("id", "rank"), near_cells(cells, merge_km, 0.05)), "areas")
    stats = [F.count("*").alias("files"), F.count_distinct("day").alias("days"), F.count_distinct("month").alias("months"), F.avg(F.col("night").cast("int")).alias("night_share")]
    placed = stored(celled.withColumn("id", name).join(lead, "id").select("leader", "day", "month", "night"), "area-rows")
    found = stored(placed.groupBy("leader").agg(*stats).withColumn("residence", (F.col("days") >= days) & (F.col("months") >= months) & (F.col("night_share") >= night)), "area-stats")
    seeds = cells.join(found.select(F.col("leader").alias("id"), "residence"), "id")
    home = seeds.where("residence").select(F.col("id").alias("b"), "rank")
    fold = near_cells(seeds, fold_km, 0.12).join(home, "b").join(seeds.where("not residence").select(F.col("id").alias("a")), "a", "left_semi").groupBy("a").agg(F.min_by("b", "rank").alias("home"))
    final = placed.join(fold.withColumnRenamed("a", "leader"), "leader", "left").withColumn("seed", F.coalesce("home", "leader"))
    flags = found.select(F.col("leader").alias("seed"), "residence")
    return final.groupBy("seed").agg(*stats).join(flags, "seed").select("seed", "residence", "files", "days", "months", F.round("night_share", 6).alias("night_share"))
