"""Queries of map features along tracks, owner words, own places, plan rows and their checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepool import params as P
from tidepool.functions import geo, parse, places
from tidepool.operators import vectors
from tidepool.plans import adapters as A
from tidepool.plans import archive as R
from tidepool.plans.stored import small, stored

from . import naming, planning
from .basics import HAV, VALID, homes_of, placed
from .looks import GRAY, UNIT, classes, unit
from .relations import DOCS, doc_files

c = F.col
QUERIES, SQL = {}, {}


def add(name, sql=None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


#: Map features around the points of the given tables; a trail has two points.
FEATURE = """SELECT p_partkey AS feature_no, CASE p_partkey % 4 WHEN 0 THEN 'peak' WHEN 1 THEN 'saddle' WHEN 2 THEN 'viewpoint' ELSE 'trail' END AS kind,
  25 + CAST(p_partkey * 7 % 50 AS DOUBLE) / 100 + CAST(p_partkey % 7 AS DOUBLE) * 9 / 10000{shift} AS flat, 121 + CAST(p_partkey * 3 % 25 AS DOUBLE) / 50 + CAST(p_partkey % 5 AS DOUBLE) * 9 / 10000 AS flon FROM part"""
FEATURES = FEATURE.format(shift="") + " UNION ALL " + FEATURE.format(shift=" - CAST(1 AS DOUBLE) / 500") + " WHERE p_partkey % 4 = 3"


def features(s, d):
    return s.sql(FEATURES.replace("FROM part", "FROM {t}"), t=A.table(s, d, "part"))


TRACKS = A.CTE + f""", feat AS ({FEATURES}), pts AS (SELECT folder, day, lat, lon, count(*) AS n, min(taken) AS first FROM typed WHERE lat IS NOT NULL AND taken IS NOT NULL GROUP BY ALL),
    met AS (SELECT folder, day, lat, lon, feature_no, any_value(kind) AS kind, any_value(n) AS n, any_value(first) AS first, min({HAV.format(a="lat", b="lon", c="flat", d="flon")}) AS km FROM pts, feat WHERE abs(lat - flat) < 0.01 GROUP BY folder, day, lat, lon, feature_no),
    tracks AS (SELECT folder, day, feature_no, any_value(kind) AS kind, CAST(sum(n) AS BIGINT) AS near, CAST(round_even(min(km) * 1000, 0) AS BIGINT) AS min_d, min(first) AS first_touch FROM met WHERE km <= 0.4 GROUP BY folder, day, feature_no)"""


def shapes(found):
    """(feature_no, kind, shape) of features; those of one kind and the same points are of one shape."""
    points = F.sort_array(F.collect_set(F.struct("flat", "flon")))
    own = found.groupBy("feature_no", "kind").agg(points.alias("points"))
    return own.withColumn("shape", F.min("feature_no").over(Window.partitionBy("kind", "points")))


def near_shapes(points, shaped, keys, km):
    """keys, shape, near (sum of n), the least distance in metres (min_d) and least first of the points (keys, place, lat, lon, n,
    first) within km of each shape. A position meets a position once, whatever days and features they have."""
    forms = shaped.groupBy("shape").agg(F.first("points").alias("points")).select("shape", F.explode("points").alias("p"))
    forms = stored(forms.select("shape", c("p.flat").alias("flat"), c("p.flon").alias("flon")), "shapes")
    spots = points.select("lat", "lon").distinct()
    met = geo.near_pairs(spots, forms.select("flat", "flon").distinct(), km)
    near = met.join(forms, ["flat", "flon"]).groupBy("lat", "lon", "shape").agg(F.min("km").alias("km"))
    found = points.join(small(stored(near, "near-shapes")), ["lat", "lon"])
    return found.groupBy(*keys, "shape").agg(F.sum("n").alias("near"), F.bround(F.min("km") * 1000, 0).cast("long").alias("min_d"), F.min("first").alias("first_touch"))


def tracks(s, d, shaped):
    """Shapes within RANK_KM of a day's points: how many points are near, the least distance in metres
    and the first time there. Points of one position meet shapes once, positions are read after
    they are counted, and of a shape's own points the nearest counts."""
    counted = A.typed(s, d).where("taken is not null").groupBy("folder", "day", "gps_position").agg(F.count("*").alias("n"), F.min("taken").alias("first"))
    point = parse.let(c("gps_position"), parse.gps)  # the view's text of it is long, and gps names it often
    pts = counted.withColumn("lat", point["lat"]).withColumn("lon", point["lon"]).where("lat is not null")
    return near_shapes(pts, shaped, ["folder", "day"], P.RANK_KM)


def best_names(s, d, shaped, seen, keys):
    """keys, place and name of up to four names of the shapes near a key (keys, shape, near, min_d, first_touch), in the order
    they were reached: near peaks and saddles, and trails and viewpoints only if there are fewer than two of those; of
    equal names the best ranked counts. Features of one shape and name rank by their number, so the first stands for all."""
    base = places.trail_place(c("name"))
    named = naming.named(s, d).select(c("p_partkey").alias("feature_no"), base.alias("name")).where("name is not null").withColumn("same", places.same_place_key(c("name")))
    cls = F.when(c("kind").isin("peak", "saddle"), 0).otherwise(1)
    first = shaped.join(named, "feature_no").groupBy("shape", "same").agg(F.first("kind").alias("kind"), F.min_by("name", "feature_no").alias("name"), F.min("feature_no").alias("feature_no"))
    first = first.withColumn("cls", cls).drop("kind")
    rows = seen.join(first, "shape").where((c("cls") == 1) | (c("min_d") < P.PEAK_KEEP_M))
    rank = F.struct("cls", -c("near"), "min_d", "feature_no")
    picks = rows.groupBy(*keys, "same").agg(F.min_by("name", rank).alias("name"), F.min_by("first_touch", rank).alias("first_touch"), F.min("cls").alias("cls"))
    whole = Window.partitionBy(*keys)
    used = picks.withColumn("peaks", F.count_if(c("cls") == 0).over(whole)).where("cls = 0 or peaks < 2")
    return used.withColumn("place", F.row_number().over(whole.orderBy("first_touch", "name"))).where("place <= 4").select(*keys, "place", "name")


@add("track_features", TRACKS + " SELECT folder, CAST(day AS VARCHAR) AS day, feature_no, kind, near, min_d, CAST(first_touch AS VARCHAR) AS first_touch FROM tracks")
def track_features(s, d):
    shaped = stored(shapes(features(s, d)), "features")
    own = shaped.select("shape", "feature_no", "kind").hint("merge")  # as many as the map has: never sent whole
    found = tracks(s, d, shaped).join(own, "shape")
    return found.select("folder", c("day").cast("string").alias("day"), "feature_no", "kind", "near", "min_d", c("first_touch").cast("string").alias("first_touch"))


SAME = "CASE " + " ".join(f"WHEN k LIKE '%{t}' AND length(k) > 2 THEN substr(k, 1, length(k) - 1)" for t in P.KEY_TAILS) + " ELSE k END"


@add("track_names", TRACKS + f""", base AS (SELECT p_partkey AS feature_no, place AS base, replace(place, '陵', '稜') AS k FROM ({naming.SQL["trail_places"]})),
    o AS (SELECT folder, day, base, {SAME} AS same, first_touch, CASE WHEN kind IN ('peak', 'saddle') THEN 0 ELSE 1 END AS cls, (CASE WHEN kind IN ('peak', 'saddle') THEN 0 ELSE 1 END, -near, min_d, feature_no) AS o FROM tracks JOIN base USING (feature_no) WHERE kind NOT IN ('peak', 'saddle') OR min_d < 350),
    picks AS (SELECT folder, day, same, arg_min(base, o) AS name, arg_min(first_touch, o) AS first_touch, min(cls) AS cls FROM o GROUP BY ALL), n AS (SELECT *, count(*) FILTER (cls = 0) OVER (PARTITION BY folder, day) AS peaks FROM picks)
    SELECT folder, CAST(day AS VARCHAR) AS day, CAST(row_number() OVER (PARTITION BY folder, day ORDER BY first_touch, name) AS INTEGER) AS place, name FROM n WHERE cls = 0 OR peaks < 2 QUALIFY place <= 4""")
def track_names(s, d):
    """Up to four names of a day in the order they were reached."""
    shaped = stored(shapes(features(s, d)), "features")
    found = best_names(s, d, shaped, tracks(s, d, shaped), ["folder", "day"])
    return found.select("folder", c("day").cast("string").alias("day"), "place", "name")


def at_home(lat, lon):
    """Whether a home that is valid on `day` is nearer than PRIVACY_KM."""
    return F.coalesce(geo.nearest_of(lat, lon, homes_of(c("day")))["km"] < P.PRIVACY_KM, F.lit(False))


def near_home(lat, lon):
    return f"EXISTS (SELECT 1 FROM {A.HOMES_SQL} WHERE {HAV.format(a=lat, b=lon, c='hlat', d='hlon')} < 3.0 AND {VALID})"


@add("owner_words", A.CTE + f""", feat AS ({FEATURES}), spots AS (SELECT folder, day, round(avg(lat), 9) AS lat, round(avg(lon), 9) AS lon FROM typed WHERE lat IS NOT NULL AND day IS NOT NULL GROUP BY folder, day),
    met AS (SELECT folder, day, feature_no, {HAV.format(a="lat", b="lon", c="flat", d="flon")} AS km FROM spots, feat WHERE kind = 'viewpoint' AND abs(lat - flat) < 0.01
      AND NOT {near_home("lat", "lon")} AND NOT {near_home("flat", "flon")})
    SELECT folder, CAST(day AS VARCHAR) AS day, arg_min(feature_no, (km, -(feature_no % 9), feature_no)) AS word FROM met WHERE km <= 0.3 GROUP BY folder, day""")
def owner_words(s, d):
    """The word an owner gave to the spot nearest to a day's centre within WORD_KM, of equally near ones the
    latest; neither may lie at a home."""
    spots = placed(s, d).groupBy("folder", "day").agg(F.round(F.avg("lat"), 9).alias("lat"), F.round(F.avg("lon"), 9).alias("lon"))
    met = geo.near_pairs(spots.where(~at_home(c("lat"), c("lon"))), features(s, d).where("kind = 'viewpoint'"), P.WORD_KM)
    rank = F.struct("km", -(c("feature_no") % 9), "feature_no")
    return met.where(~at_home(c("flat"), c("flon"))).groupBy("folder", "day").agg(F.min_by("feature_no", rank).alias("word")).withColumn("day", c("day").cast("string"))


@add("own_place_members", A.CTE + f""", near AS (SELECT file_no, arg_min(id, km) AS home FROM (SELECT file_no, id, {HAV.format(a="lat", b="lon", c="hlat", d="hlon")} AS km FROM typed, {A.HOMES_SQL} WHERE lat IS NOT NULL AND {VALID}) WHERE km < 3.0 GROUP BY file_no)
    SELECT folder, count(*) AS members, count(*) FILTER (home IS NULL OR home = CASE WHEN CAST(substr(folder, 2) AS INTEGER) % 2 = 0 THEN 'h1' ELSE 'n1' END) AS counted FROM typed LEFT JOIN near USING (file_no) GROUP BY folder""")
def own_place_members(s, d):
    """Members of each folder, and those that may name it: not at a home, or at the folder's own place."""
    near = geo.nearest_of(c("lat"), c("lon"), homes_of(c("day")))
    home = F.when(near["km"] < P.PRIVACY_KM, near["id"])
    own = F.when(F.substring("folder", 2, 9).cast("int") % 2 == 0, "h1").otherwise("n1")
    return A.typed(s, d).select("folder", F.coalesce(home == own, F.lit(True)).alias("counts")).groupBy("folder").agg(F.count("*").alias("members"), F.count_if("counts").alias("counted"))


@add("twin_holds", f"""WITH plan AS ({planning.SQL["twin_plan"]}), f AS ({DOCS}), now AS (SELECT path, size, CASE WHEN doc_id % 10 = 3 THEN 'changed' ELSE sha END AS sha FROM f WHERE doc_id % 10 <> 7)
    SELECT plan.path, coalesce(now.size = f.size AND now.sha = f.sha, false) AS holds FROM plan JOIN f USING (path) LEFT JOIN now ON now.path = plan.dest WHERE action = 'skip_dupe'""")
def twin_holds(s, d):
    """Whether the file that a skipped copy counts on still has its size and bytes."""
    files = doc_files(s, d)
    now = files.where("doc_id % 10 <> 7").select(c("path").alias("dest"), c("size").alias("now_size"), F.when(c("doc_id") % 10 == 3, "changed").otherwise(c("sha")).alias("now_sha"))
    skips = planning.twin_plan(s, d).where("action = 'skip_dupe'").select("path", "dest").join(files.select("path", "size", "sha"), "path")
    return skips.join(now, "dest", "left").select("path", F.coalesce((c("size") == c("now_size")) & (c("sha") == c("now_sha")), F.lit(False)).alias("holds"))


@add("op_validity", """WITH e AS (SELECT DISTINCT strftime(o_orderdate, '%Y%m%d') || '_' || o_orderstatus AS name FROM orders WHERE o_orderkey % 2 = 1),
    ops AS (SELECT o_orderkey AS op, CASE WHEN o_orderkey % 7 = 0 THEN strftime(o_orderdate + INTERVAL 1 DAY, '%Y%m') ELSE strftime(o_orderdate + INTERVAL 1 DAY, '%Y%m%d') END || '_' || o_orderstatus AS new FROM orders WHERE o_orderkey % 2 = 0), n AS (SELECT new, count(*) AS n FROM ops GROUP BY new)
    SELECT op, problem FROM (SELECT op, CASE WHEN NOT regexp_full_match(new, '[0-9]{8}_.+') THEN 'grammar' WHEN e.name IS NOT NULL THEN 'taken' WHEN n > 1 THEN 'collides' END AS problem FROM ops JOIN n USING (new) LEFT JOIN e ON e.name = new) WHERE problem IS NOT NULL""")
def op_validity(s, d):
    """Renames that can't be done: ungrammatical, to a folder that is there, or to the same name as another.
    Names are counted before they meet the renames."""
    rows, next_day = A.table(s, d, "orders"), F.date_add(F.to_date("o_orderdate"), 1)
    there = rows.where("o_orderkey % 2 = 1").select(F.concat_ws("_", F.date_format("o_orderdate", "yyyyMMdd"), "o_orderstatus").alias("new")).distinct().withColumn("taken", F.lit(True))
    stamp = F.when(c("o_orderkey") % 7 == 0, F.date_format(next_day, "yyyyMM")).otherwise(F.date_format(next_day, "yyyyMMdd"))
    ops = rows.where("o_orderkey % 2 = 0").select(c("o_orderkey").alias("op"), F.concat_ws("_", stamp, "o_orderstatus").alias("new"))
    met = ops.join(ops.groupBy("new").agg(F.count("*").alias("n")), "new").join(there, "new", "left")
    problem = F.when(~c("new").rlike("^[0-9]{8}_.+$"), "grammar").when(c("taken"), "taken").when(c("n") > 1, "collides")
    return met.select("op", problem.alias("problem")).where("problem is not null")


@add("period_rows", """WITH t AS (SELECT o_custkey AS trip, CAST(min(o_orderdate) FILTER (o_orderkey % 2 = 0) AS DATE) AS a, CAST(max(o_orderdate) FILTER (o_orderkey % 2 = 0) AS DATE) AS z, CAST(min(o_orderdate) AS DATE) AS first, CAST(max(o_orderdate) AS DATE) AS last FROM orders GROUP BY o_custkey)
    SELECT trip, strftime(a, '%Y%m%d') || '-' || strftime(z, '%Y%m%d') AS old, strftime(first, '%Y%m%d') || '-' || strftime(last, '%Y%m%d') AS new FROM t WHERE first < a OR last > z""")
def period_rows(s, d):
    """Trips whose legs reach beyond the days in their name, with the wider name."""
    own, day = c("o_orderkey") % 2 == 0, F.to_date("o_orderdate")
    span = lambda a, z: F.concat_ws("-", F.date_format(a, "yyyyMMdd"), F.date_format(z, "yyyyMMdd"))
    t = A.table(s, d, "orders").groupBy(c("o_custkey").alias("trip")).agg(F.min(F.when(own, day)).alias("a"), F.max(F.when(own, day)).alias("z"), F.min(day).alias("first"), F.max(day).alias("last"))
    return t.where((c("first") < c("a")) | (c("last") > c("z"))).select("trip", span("a", "z").alias("old"), span("first", "last").alias("new"))


@add("visual_columns", A.CTE + ", " + R.CTE.removeprefix("WITH ") + """ SELECT m.file_no, coalesce(CASE WHEN provenance LIKE 'viewed-%' THEN 'viewed' WHEN provenance IS NOT NULL THEN 'matched' END, '') AS scene, coalesce(CASE WHEN status = 'confirmed' THEN coalesce(name, kind) END, '') AS subject
    FROM manifest m LEFT JOIN (SELECT * FROM looks WHERE value >= 30) l USING (file_no) LEFT JOIN subjects ON no = subject_no""")
def visual_columns(s, d):
    """Plan rows with what was seen on the file and whom it shows, if the subject is confirmed."""
    seen = R.looks(s, d).where("value >= 30").select("file_no", "provenance", c("subject_no").alias("no"))
    known = R.subjects(s, d).where("status = 'confirmed'").select("no", F.coalesce("name", "kind").alias("subject"))
    met = A.manifest(s, d).select("file_no").join(seen, "file_no", "left").join(known, "no", "left")
    scene = F.when(c("provenance").startswith("viewed-"), "viewed").when(c("provenance").isNotNull(), "matched")
    return met.select("file_no", F.coalesce(scene, F.lit("")).alias("scene"), F.coalesce("subject", F.lit("")).alias("subject"))


@add("rejected_suppression", UNIT + f""", p AS (SELECT id, m.label AS rejected, list_dot_product(v, c) AS s FROM u JOIN m ON u.label % 2 = m.label % 2 WHERE m.label % 5 = 2)
    SELECT id, arg_max(CAST(rejected AS VARCHAR), s) AS rejected, round(max(s), 6) AS score FROM p GROUP BY id HAVING max(s) >= {GRAY}""")
def rejected_suppression(s, d):
    """Vectors as near as GRAY to the centre of a rejected draft of their own kind."""
    rows, name = unit(s, d), c("name").try_cast("int")
    found = None
    for kind in (0, 1):
        met = vectors.nearest_two(rows.where(c("label") % 2 == kind), classes(s, d).where((name % 5 == 2) & (name % 2 == kind)))
        found = met if found is None else found.unionByName(met)
    return found.where(c("best_score") >= GRAY).select("id", c("best").alias("rejected"), F.round("best_score", 6).alias("score"))


@add("batch_rows", R.CTE + """ SELECT batch, count(*) AS looks, count(*) FILTER (provenance IN ('viewed-image', 'viewed-image:')) AS viewed, count(DISTINCT sample) AS samples, count(*) FILTER (status = 'confirmed') AS confirmed, count(*) FILTER (status IS NULL) AS unknown
    FROM looks LEFT JOIN subjects ON no = subject_no GROUP BY batch""")
def batch_rows(s, d):
    """The review row of each batch."""
    rows = R.looks(s, d).join(R.subjects(s, d).select(c("no").alias("subject_no"), "status"), "subject_no", "left")
    return rows.groupBy("batch").agg(F.count("*").alias("looks"), F.count_if(parse.is_view_confirmed(c("provenance"))).alias("viewed"), F.count_distinct("sample").alias("samples"), F.count_if(c("status") == "confirmed").alias("confirmed"), F.count_if(c("status").isNull()).alias("unknown"))
