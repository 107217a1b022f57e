"""Queries of landmarks that photos vote for, named stops and places of batches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepool import params as P
from tidepool.functions import geo, parse, places
from tidepool.operators import landmarks, timeline
from tidepool.plans import adapters as A
from tidepool.plans.stored import small, stored

from . import naming
from .basics import EDGES, HAV, VALID, homes_of
from .more import edges
from .planning import HOLDS
from .tracks import FEATURES, SAME, best_names, features, near_shapes, shapes

c = F.col
QUERIES, SQL = {}, {}


def add(name, sql=None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


#: Positions of the events: each folder and day has a place, on most days another one in the afternoon, and now and then a short halt.
VISITS = """SELECT event_id AS id, 'v' || CAST(user_id % 8 AS STRING) AS folder, CAST(ts AS DATE) AS day, ts AS shot,
  25 + CAST(spot % 5 AS DOUBLE) / 10 + CAST(event_id % 3 AS DOUBLE) * 4 / 10000 + CASE WHEN day_no % 7 = 6 AND hour_no >= 14 THEN CAST(45 AS DOUBLE) / 1000 ELSE 0 END AS lat,
  121 + CAST(spot - spot % 5 AS DOUBLE) / 50 + CAST(event_id % 2 AS DOUBLE) * 3 / 10000 AS lon
FROM (SELECT *, (user_id % 8 * 7 + day_no * 3 + CASE WHEN hour_no < 14 OR day_no % 3 = 0 THEN 0 ELSE day_no % 4 * 6 END + CASE WHEN event_id % 37 = 0 THEN 5 ELSE 0 END) % 25 AS spot
  FROM (SELECT event_id, user_id, ts, dayofmonth(ts) AS day_no, hour(ts) AS hour_no FROM events) e) v"""
#: Features of a map: nodes and boxes, some near the positions. Each third tells what tags it has.
SIGHTS = f"""SELECT p_partkey AS feature_no, p_name || ' ' || CAST(p_partkey % 40 AS STRING) || CASE WHEN p_partkey % 31 = 0 THEN '巷' ELSE '' END AS name,
  CASE p_partkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 0 WHEN 4 THEN CASE WHEN p_partkey % 4 = 0 THEN 0 END END AS rank,
  p_partkey % 6 = 4 AS street, p_partkey % 4 = 0 AS notable,
  25 + CAST(spot % 5 AS DOUBLE) / 10 + CAST(p_partkey % 9 AS DOUBLE) * 4 / 10000 AS south, 121 + CAST(spot - spot % 5 AS DOUBLE) / 50 + CAST(p_partkey % 7 AS DOUBLE) * 3 / 10000 AS west,
  25 + CAST(spot % 5 AS DOUBLE) / 10 + CAST(p_partkey % 9 AS DOUBLE) * 4 / 10000 + half AS north, 121 + CAST(spot - spot % 5 AS DOUBLE) / 50 + CAST(p_partkey % 7 AS DOUBLE) * 3 / 10000 + half AS east
FROM (SELECT *, CASE WHEN p_partkey % 23 < 9 AND p_partkey % 23 <> 2 THEN p_partkey % 23 ELSE 11 END AS spot, CASE WHEN p_partkey % 3 = 0 THEN CAST(0 AS DOUBLE) WHEN p_partkey % 50 = 7 THEN CAST(1 AS DOUBLE) / 20 ELSE CAST(p_size % 6 AS DOUBLE) * 3 / 10000 END AS half FROM part) p"""
#: The town of each cell of a tenth of a degree; some have none, and some are finer than a town.
TOWNS = """SELECT n_nationkey % 5 AS ty, CAST((n_nationkey - n_nationkey % 5) / 5 AS INT) AS tx, n_name || CASE WHEN n_nationkey % 6 = 5 THEN '里' ELSE '' END AS town FROM nation WHERE n_nationkey % 11 <> 10"""

#: The country that the owner declared.
DECLARED = "a"


def visits(s, d):
    return s.sql(VISITS.replace("FROM events", "FROM {t}"), t=A.table(s, d, "events"))


def sights(s, d):
    """Features that can be a landmark: with a rank and a name that is no address."""
    return s.sql(SIGHTS.replace("FROM part", "FROM {t}"), t=A.table(s, d, "part")).where(c("rank").isNotNull() & ~places.is_address(c("name")))


def towns(s, d):
    return s.sql(TOWNS.replace("FROM nation", "FROM {t}"), t=A.table(s, d, "nation"))


def cell(x, origin):
    """Number of the cell of a tenth of a degree around its middle."""
    return F.floor(F.round((x - origin) * 10 + 0.5, 6)).cast("int")


def with_town(s, d, rows):
    return rows.withColumn("ty", cell(c("lat"), 25)).withColumn("tx", cell(c("lon"), 121)).join(small(towns(s, d)), ["ty", "tx"], "left").drop("ty", "tx")


def away(points):
    """Points outside every home's radius, whatever its days: homes are literals of the plan."""
    every = [(lat, lon, F.lit(True), {"id": name}) for name, lat, lon, *_ in A.HOMES]
    return points.where(~(geo.nearest_of(c("lat"), c("lon"), every)["km"] <= P.AWAY_KM))


def counted(points, keys):
    return points.groupBy(*keys, "lat", "lon").agg(F.count("*").alias("photos"))


ANY_HOME = f"EXISTS (SELECT 1 FROM {A.HOMES_SQL} h WHERE {HAV.format(a='lat', b='lon', c='hlat', d='hlon')} <= 3.0)"
NEAR = HAV.format(a="lat", b="lon", c="greatest(south, least(lat, north))", d="greatest(west, least(lon, east))")
BASE = f"visits AS MATERIALIZED ({VISITS}), sights AS (SELECT * FROM ({SIGHTS}) WHERE rank IS NOT NULL AND NOT (name LIKE '%巷')), towns AS ({TOWNS})"


def votes_sql(source, keys):
    """met, vote and marks over a relation of points (keys, lat, lon) away from homes."""
    return f"""met AS (SELECT {keys}, lat, lon, photos, feature_no, name, rank, street, notable, south = north AND west = east AS node, round({HAV.format(a="south", b="west", c="north", d="east")}, 9) AS extent, km,
      CASE WHEN rank = 0 AND km <= 0.05 THEN 1 WHEN rank = 0 AND km <= 0.15 THEN 2 WHEN km <= 0.05 THEN 3 ELSE 4 END AS tier
      FROM (SELECT *, round({NEAR}, 9) AS km FROM (SELECT {keys}, lat, lon, count(*) AS photos FROM {source} WHERE NOT {ANY_HOME} GROUP BY ALL) p, sights WHERE lat BETWEEN south - 0.01 AND north + 0.01 AND lon BETWEEN west - 0.01 AND east + 0.01) WHERE km <= 0.3),
    vote AS (SELECT {keys}, lat, lon, photos, arg_min({{'name': name, 'rank': rank, 'km': km, 'tier': tier}}, CASE WHEN tier < 4
      THEN (tier, street::DOUBLE, (NOT notable)::DOUBLE, (NOT CASE WHEN node THEN km <= 0.025 ELSE km = 0 END)::DOUBLE, extent, km, feature_no) ELSE (tier, 0.0, 0.0, 0.0, km, rank::DOUBLE, feature_no) END) AS v FROM met GROUP BY ALL),
    marks AS (SELECT {keys}, v.name AS name, min(v.rank) AS rank, CAST(sum(photos) AS BIGINT) AS photos, min(v.km) AS km, {", ".join(f"CAST(coalesce(sum(photos) FILTER (v.tier = {t}), 0) AS BIGINT) AS t{t}" for t in (1, 2, 3, 4))} FROM vote GROUP BY {keys}, v.name),
    totals AS (SELECT {keys}, count(*) AS total FROM {source} WHERE NOT {ANY_HOME} GROUP BY {keys}),
    ranked AS (SELECT *, row_number() OVER w AS r, first_value(rank) OVER w AS first FROM marks JOIN totals USING ({keys}) WINDOW w AS (PARTITION BY {keys} ORDER BY rank, photos DESC, km, name)),
    picked AS (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY r) AS place, name FROM ranked WHERE r = 1 OR (rank = first AND photos >= total / 3 - 1e-9) QUALIFY place <= 2)"""


@add("landmark_votes", f"WITH {BASE}, {votes_sql('visits', 'folder, day')} SELECT folder, CAST(day AS VARCHAR) AS day, name, rank, photos, round(km * 1000, 3) AS m, t1, t2, t3, t4 FROM marks")
def landmark_votes(s, d):
    """Landmarks of each folder and day: every photo away from the homes votes once, by tiers."""
    found = landmarks.votes(counted(away(visits(s, d)), ["folder", "day"]), sights(s, d), ["folder", "day"])
    return found.select("folder", c("day").cast("string").alias("day"), "name", "rank", "photos", F.round(c("km") * 1000, 3).alias("m"), "t1", "t2", "t3", "t4")


@add("landmark_pick", f"WITH {BASE}, {votes_sql('visits', 'folder, day')} SELECT folder, CAST(day AS VARCHAR) AS day, CAST(place AS INTEGER) AS place, name FROM picked")
def landmark_pick(s, d):
    """The one or two landmarks that name a day."""
    points = away(visits(s, d))
    found = landmarks.votes(counted(points, ["folder", "day"]), sights(s, d), ["folder", "day"])
    return landmarks.picks(found, points.groupBy("folder", "day").agg(F.count("*").alias("total")), ["folder", "day"]).withColumn("day", c("day").cast("string"))


STOPS = f"""ordered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY folder, day ORDER BY shot, id) AS k FROM visits),
    walk(folder, day, k, id, lat, lon, stop, lats, lons) AS (
      SELECT folder, day, k, id, lat, lon, 1, [lat], [lon] FROM ordered WHERE k = 1
      UNION ALL SELECT folder, day, k, id, lat, lon, CASE WHEN far THEN stop + 1 ELSE stop END, CASE WHEN far THEN [lat] ELSE list_append(lats, lat) END, CASE WHEN far THEN [lon] ELSE list_append(lons, lon) END
      FROM (SELECT o.*, stop, lats, lons, {HAV.format(a="list_aggregate(lats, 'median')", b="list_aggregate(lons, 'median')", c="o.lat", d="o.lon")} > 3 AS far FROM walk JOIN ordered o ON o.folder = walk.folder AND o.day = walk.day AND o.k = walk.k + 1)),
    seg AS MATERIALIZED (SELECT folder, day, stop AS unit, id, lat, lon FROM walk)"""


def segmented(s, d):
    """visits with the number of their stop (unit), stored: the stops are read several times."""
    points = visits(s, d)
    return stored(points.drop("shot").join(timeline.stops(points.withColumnRenamed("shot", "at"), ["folder", "day"]).withColumnRenamed("stop", "unit"), ["folder", "day", "id"]), "stops")


UNIT = ["folder", "day", "unit"]


def middle(points):
    return points.groupBy(*UNIT).agg(F.count("*").alias("points"), F.median("lat").alias("lat"), F.median("lon").alias("lon"))


def landmark_names(s, d, points):
    """UNIT and names: the landmarks of the units' points away from homes."""
    far = away(points)
    found = landmarks.votes(counted(far, UNIT), sights(s, d), UNIT)
    return landmarks.listed(landmarks.picks(found, far.groupBy(*UNIT).agg(F.count("*").alias("total")), UNIT), UNIT)


def label_of(lat, lon):
    """The owner's word for the nearest named place within PLACE_KM."""
    near = geo.nearest_of(lat, lon, [(y, x, F.lit(True), {"label": name}) for _, y, x, name in A.NAMED])
    return F.when(near["km"] <= P.PLACE_KM, near["label"])


def peak_names(s, d, points):
    """UNIT and peaks: up to four features of ways and summits on the units' points away from homes, in the order in
    which they were reached."""
    far = away(points).groupBy(*UNIT, "lat", "lon").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    shaped = stored(shapes(features(s, d).where("flon between 121.03 and 121.35")), "features")  # the map has no ways elsewhere
    used = best_names(s, d, shaped, near_shapes(far, shaped, UNIT, P.RANK_KM), UNIT)
    return landmarks.listed(used, UNIT).withColumnRenamed("names", "peaks")


@add("named_stops", f"""WITH RECURSIVE {BASE}, {STOPS}, {votes_sql("seg", "folder, day, unit")},
    mid AS (SELECT folder, day, unit, count(*) AS points, median(lat) AS lat, median(lon) AS lon FROM seg GROUP BY ALL),
    athome AS (SELECT DISTINCT folder, day, unit FROM (SELECT folder, day, unit, lat, lon FROM seg UNION ALL SELECT folder, day, unit, lat, lon FROM mid), {A.HOMES_SQL} WHERE {HAV.format(a="lat", b="lon", c="hlat", d="hlon")} < 3.0 AND {VALID}),
    word AS (SELECT folder, day, unit, arg_min(label, km) AS label FROM (SELECT folder, day, unit, label, {HAV.format(a="lat", b="lon", c="nlat", d="nlon")} AS km FROM mid, {A.NAMED_SQL}) WHERE km <= 1 GROUP BY ALL),
    mark AS (SELECT folder, day, unit, string_agg(name, '; ' ORDER BY place) AS names FROM picked GROUP BY ALL),
    feat AS (SELECT * FROM ({FEATURES}) WHERE flon BETWEEN 121.03 AND 121.35), ways AS (SELECT folder, day, unit, lat, lon, count(*) AS n, min(id) AS first FROM seg WHERE NOT {ANY_HOME} GROUP BY ALL),
    wmet AS (SELECT folder, day, unit, lat, lon, feature_no, any_value(kind) AS kind, any_value(n) AS n, any_value(first) AS first, min({HAV.format(a="lat", b="lon", c="flat", d="flon")}) AS km FROM ways, feat WHERE abs(lat - flat) < 0.01 GROUP BY folder, day, unit, lat, lon, feature_no),
    wseen AS (SELECT folder, day, unit, feature_no, any_value(kind) AS kind, sum(n) AS near, CAST(round_even(min(km) * 1000, 0) AS BIGINT) AS min_d, min(first) AS touch FROM wmet WHERE km <= 0.4 GROUP BY folder, day, unit, feature_no),
    base AS (SELECT p_partkey AS feature_no, place AS base, replace(place, '陵', '稜') AS k FROM ({naming.SQL["trail_places"]})),
    wrank AS (SELECT folder, day, unit, base, {SAME} AS same, touch, CASE WHEN kind IN ('peak', 'saddle') THEN 0 ELSE 1 END AS cls, (CASE WHEN kind IN ('peak', 'saddle') THEN 0 ELSE 1 END, -near, min_d, feature_no) AS o FROM wseen JOIN base USING (feature_no) WHERE kind NOT IN ('peak', 'saddle') OR min_d < 350),
    wbest AS (SELECT folder, day, unit, same, arg_min(base, o) AS name, arg_min(touch, o) AS touch, min(cls) AS cls FROM wrank GROUP BY ALL),
    wused AS (SELECT *, row_number() OVER (PARTITION BY folder, day, unit ORDER BY touch, name) AS place FROM (SELECT *, count(*) FILTER (cls = 0) OVER (PARTITION BY folder, day, unit) AS peaks FROM wbest) WHERE cls = 0 OR peaks < 2),
    peak AS (SELECT folder, day, unit, string_agg(name, '; ' ORDER BY place) AS names FROM wused WHERE place <= 4 GROUP BY ALL),
    here AS (SELECT folder, day, unit, min(shape) AS here FROM (SELECT folder, day, unit, shape FROM (SELECT folder, day, unit, lat AS plat, lon AS plon, shape, y1, x1, y2, x2 FROM mid, {A.values(EDGES, "shape, y1, x1, y2, x2")} WHERE y1 <> y2) GROUP BY folder, day, unit, shape HAVING {HOLDS}) GROUP BY ALL),
    told AS (SELECT mid.folder, mid.day, mid.unit, points, athome.unit IS NOT NULL AS home, label, mark.names AS mark, peak.names AS peak, here.here = '{DECLARED}' AS inside, count(*) OVER (PARTITION BY mid.folder, mid.day) > 1 AS moved, town
      FROM mid LEFT JOIN athome USING (folder, day, unit) LEFT JOIN word USING (folder, day, unit) LEFT JOIN mark USING (folder, day, unit) LEFT JOIN peak USING (folder, day, unit) LEFT JOIN here USING (folder, day, unit)
      LEFT JOIN towns ON ty = floor(round((lat - 25) * 10 + 0.5, 6)) AND tx = floor(round((lon - 121) * 10 + 0.5, 6))),
    modes AS (SELECT *, CASE WHEN home THEN 'home' WHEN points < 3 THEN 'unnamed' WHEN label IS NOT NULL THEN 'named' WHEN mark IS NOT NULL THEN 'landmark' WHEN peak IS NOT NULL OR (inside AND NOT moved) THEN 'overpass' WHEN inside IS NULL OR inside THEN 'area_z13' ELSE 'overseas_z13' END AS mode FROM told),
    names AS (SELECT folder, day, unit, points, mode, coalesce(CASE mode WHEN 'named' THEN label WHEN 'landmark' THEN mark WHEN 'overpass' THEN peak WHEN 'overseas_z13' THEN town WHEN 'area_z13' THEN CASE WHEN inside AND regexp_matches(town, '[里鄰村]$') THEN NULL ELSE town END END, '') AS names FROM modes)
    SELECT folder, CAST(day AS VARCHAR) AS day, CAST(unit AS BIGINT) AS stop, points, mode, names, coalesce(last_value(CASE WHEN names <> '' THEN names END IGNORE NULLS) OVER (PARTITION BY folder, day ORDER BY unit ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), '') AS day_names FROM names""")
def named_stops(s, d):
    """Each stop with the mode that named it, its names, and the names of its day: those of the last stop that has any.

    In order: a home keeps it unnamed, so do few points; then the owner's word, landmarks, ways and summits; a stop that
    stayed in the owner's country needs no more if the day didn't move; else the town, in the owner's country
    unless it is finer than a district."""
    points = segmented(s, d)
    mid = middle(points)
    near = geo.nearest_of(c("lat"), c("lon"), homes_of(c("day")))["km"] < P.PRIVACY_KM
    both = points.select(*UNIT, "lat", "lon").unionByName(mid.select(*UNIT, "lat", "lon"))
    home = both.groupBy(*UNIT).agg(F.bool_or(F.coalesce(near, F.lit(False))).alias("home"))
    outlines = edges(s)
    here = geo.crossings(mid.select(*UNIT, "lat", "lon"), outlines, UNIT).where("inside").groupBy(*UNIT).agg(F.min("shape").alias("here"))
    told = mid.join(home, UNIT).join(landmark_names(s, d, points), UNIT, "left").join(peak_names(s, d, points), UNIT, "left").join(here, UNIT, "left")
    told = with_town(s, d, told).withColumn("label", label_of(c("lat"), c("lon"))).withColumn("inside", c("here") == DECLARED)
    told = told.withColumn("moved", F.count("*").over(Window.partitionBy("folder", "day")) > 1)
    mode = F.when(c("home"), "home").when(c("points") < P.MIN_POINTS_TO_NAME, "unnamed").when(c("label").isNotNull(), "named").when(c("names").isNotNull(), "landmark")
    mode = mode.when(c("peaks").isNotNull() | (c("inside") & ~c("moved")), "overpass").when(F.coalesce("inside", F.lit(True)), "area_z13").otherwise("overseas_z13")
    town = F.when(~(F.coalesce("inside", F.lit(False)) & places.ends_in(c("town"), P.TOO_FINE)), c("town"))
    moded = told.withColumn("mode", mode)
    m = c("mode")
    names = F.when(m == "named", c("label")).when(m == "landmark", F.array_join("names", "; ")).when(m == "overpass", F.array_join("peaks", "; ")).when(m == "overseas_z13", c("town")).when(m == "area_z13", town)
    out = moded.select("folder", "day", c("unit").alias("stop"), "points", "mode", F.coalesce(names, F.lit("")).alias("names"))
    w = Window.partitionBy("folder", "day").orderBy("stop").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.last(F.when(c("names") != "", c("names")), True).over(w)
    return out.withColumn("day_names", F.coalesce(last, F.lit(""))).withColumn("day", c("day").cast("string"))


def chain(s, d, points, mid):
    """UNIT, words and mark of each unit: at a home its owner's word, else the town; elsewhere the owner's word, else
    landmarks (mark), else the town. A town that is an address gives no word."""
    near = geo.nearest_of(c("lat"), c("lon"), homes_of(c("day")))
    at_home = F.coalesce(near["km"] <= P.AWAY_KM, F.lit(False))
    rows = with_town(s, d, mid.join(landmark_names(s, d, points), UNIT, "left"))
    rows = rows.select(*UNIT, at_home.alias("home"), near["label"].alias("home_label"), label_of(c("lat"), c("lon")).alias("label"), "names", F.when(~places.is_address(c("town")), c("town")).alias("town"))
    mark = ~c("home") & c("label").isNull() & c("names").isNotNull()
    one = F.when(c("home"), F.coalesce("home_label", "town")).otherwise(F.coalesce("label", "town"))
    return rows.select(*UNIT, "home", mark.alias("mark"), F.when(mark, c("names")).when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<string>")).alias("words"))


@add("batch_places", f"""WITH RECURSIVE {BASE}, {STOPS}, whole AS (SELECT folder, day, 0 AS unit, id, lat, lon FROM visits), units AS MATERIALIZED (SELECT * FROM seg UNION ALL SELECT * FROM whole), {votes_sql("units", "folder, day, unit")},
    mid AS MATERIALIZED (SELECT folder, day, unit, count(*) AS points, median(lat) AS lat, median(lon) AS lon FROM units GROUP BY ALL),
    hk AS (SELECT folder, day, unit, arg_min(coalesce(label, ''), km) AS label FROM (SELECT folder, day, unit, label, {HAV.format(a="lat", b="lon", c="hlat", d="hlon")} AS km FROM mid, {A.HOMES_SQL} WHERE {VALID}) WHERE km <= 3.0 GROUP BY ALL),
    word AS (SELECT folder, day, unit, arg_min(label, km) AS label FROM (SELECT folder, day, unit, label, {HAV.format(a="lat", b="lon", c="nlat", d="nlon")} AS km FROM mid, {A.NAMED_SQL}) WHERE km <= 1 GROUP BY ALL),
    mark AS (SELECT folder, day, unit, list(name ORDER BY place) AS names FROM picked GROUP BY ALL),
    chain AS MATERIALIZED (SELECT folder, day, unit, hk.unit IS NOT NULL AS home, hk.unit IS NULL AND word.label IS NULL AND names IS NOT NULL AS mark,
        CASE WHEN hk.unit IS NOT NULL THEN list_filter([coalesce(nullif(hk.label, ''), town)], lambda x: x IS NOT NULL) WHEN word.label IS NOT NULL THEN [word.label] WHEN names IS NOT NULL THEN names ELSE list_filter([town], lambda x: x IS NOT NULL) END AS words
      FROM mid LEFT JOIN hk USING (folder, day, unit) LEFT JOIN word USING (folder, day, unit) LEFT JOIN mark USING (folder, day, unit) LEFT JOIN towns ON ty = floor(round((lat - 25) * 10 + 0.5, 6)) AND tx = floor(round((lon - 121) * 10 + 0.5, 6))),
    split AS (SELECT folder, day FROM whole JOIN (SELECT folder, day, lat AS clat, lon AS clon FROM mid WHERE unit = 0) USING (folder, day) GROUP BY folder, day HAVING min({HAV.format(a="lat", b="lon", c="clat", d="clon")}) > 3),
    legs AS (SELECT chain.folder, chain.day, arg_max(words[1], unit) FILTER (len(words) > 0 AND (NOT home OR allhome)) AS w, arg_max(mark, unit) FILTER (len(words) > 0 AND (NOT home OR allhome)) AS mark FROM chain JOIN split USING (folder, day) JOIN (SELECT folder, day, bool_and(home) AS allhome FROM chain WHERE unit > 0 GROUP BY ALL) USING (folder, day) WHERE unit > 0 GROUP BY chain.folder, chain.day),
    days AS MATERIALIZED (SELECT c.folder, CAST(floor((dayofmonth(c.day) - 1) / 7) AS BIGINT) AS batch, row_number() OVER (PARTITION BY c.folder, floor((dayofmonth(c.day) - 1) / 7) ORDER BY c.day) AS k, CASE WHEN legs.w IS NOT NULL THEN [legs.w] ELSE c.words END AS words, CASE WHEN legs.w IS NOT NULL THEN legs.mark ELSE c.mark END AS mark
      FROM chain c LEFT JOIN legs ON c.folder = legs.folder AND c.day = legs.day WHERE c.unit = 0),
    trip(folder, batch, k, names, marks) AS (SELECT DISTINCT folder, batch, 0::BIGINT, []::VARCHAR[], 0 FROM days
      UNION ALL SELECT folder, batch, k, CASE WHEN f2 THEN list_append(n1, w2) ELSE n1 END, m1 + CASE WHEN f2 AND mark THEN 1 ELSE 0 END FROM (
        SELECT *, w2 IS NOT NULL AND NOT full_ AND NOT list_contains(n1, w2) AND (NOT mark OR m1 < 2) AS f2 FROM (
          SELECT *, CASE WHEN f1 THEN list_append(names, w1) ELSE names END AS n1, marks + CASE WHEN f1 AND mark THEN 1 ELSE 0 END AS m1 FROM (
            SELECT *, w1 IS NOT NULL AND NOT full_ AND NOT list_contains(names, w1) AND (NOT mark OR marks < 2) AS f1 FROM (
              SELECT d.folder, d.batch, d.k, names, marks, d.mark, d.words[1] AS w1, d.words[2] AS w2, len(names) >= 4 AS full_ FROM trip JOIN days d ON d.folder = trip.folder AND d.batch = trip.batch AND d.k = trip.k + 1))))),
    ends AS (SELECT folder, batch, max(k) AS k FROM days GROUP BY ALL)
    SELECT folder, batch, array_to_string(names, ' + ') AS places FROM trip JOIN ends USING (folder, batch, k)""")
def batch_places(s, d):
    """The distinct places of each folder's weeks in travel order. A day whose middle is far from all its photos takes
    the word of its last stop away from the homes (the last of all, if it was at homes only)."""
    seg = segmented(s, d)
    points = stored(seg.unionByName(seg.withColumn("unit", F.lit(0).cast("long"))), "units")
    mid = stored(middle(points), "middles")
    words = stored(chain(s, d, points, mid), "words")
    centre = mid.where("unit = 0").select("folder", "day", c("lat").alias("clat"), c("lon").alias("clon"))
    km = geo.haversine_km(c("lat"), c("lon"), c("clat"), c("clon"))
    split = seg.join(centre, ["folder", "day"]).groupBy("folder", "day").agg(F.min(km).alias("km")).where(c("km") > P.STOP_SPLIT_KM).select("folder", "day")
    stops = words.where("unit > 0").join(split, ["folder", "day"]).withColumn("all_home", F.bool_and("home").over(Window.partitionBy("folder", "day")))
    usable = stops.where((F.size("words") > 0) & (~c("home") | c("all_home")))
    last = usable.groupBy("folder", "day").agg(F.max_by(F.struct(F.slice("words", 1, 1).alias("words"), "mark"), "unit").alias("leg"))
    days = words.where("unit = 0").join(last, ["folder", "day"], "left")
    days = days.select("folder", F.floor((F.dayofmonth("day") - 1) / 7).alias("batch"), "day", F.coalesce("leg.words", "words").alias("words"), F.coalesce("leg.mark", "mark").alias("mark"))
    return landmarks.itinerary(days, ["folder", "batch"], P.BATCH_PLACES).select("folder", "batch", F.array_join("names", " + ").alias("places"))
