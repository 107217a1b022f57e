"""Queries of names, map tags, recurrence, the ladder and folder rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepool import params as P
from tidepool.functions import geo, names, parse
from tidepool.operators import census, ladder, recurrence, vectors
from tidepool.plans import adapters as A

from .basics import EDGES, HAV, VALID, with_homes
from .looks import GRAY, TAU, classes, unit

c = F.col
QUERIES, SQL = {}, {}


def add(name, sql=None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


@add("name_render", """SELECT o_orderkey, concat_ws('_', strftime(o_orderdate, '%Y%m%d'), CASE WHEN o_orderkey % 3 = 0 THEN 'JP' END, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'lake' ELSE 'lake+hill' END, CASE WHEN o_orderkey % 5 = 0 THEN 'Ann' END, lower(o_orderstatus)) AS name FROM orders""")
def name_render(s, d):
    k = c("o_orderkey")
    empty = F.array().cast("array<string>")
    where = F.when(k % 4 == 0, empty).when(k % 4 == 1, F.array(F.lit("lake"))).otherwise(F.array(F.lit("lake"), F.lit("hill")))
    who = F.when(k % 5 == 0, F.array(F.lit("Ann"))).otherwise(empty)
    name = names.render(F.date_format("o_orderdate", "yyyyMMdd"), F.when(k % 3 == 0, "JP"), where, who, F.lower("o_orderstatus"))
    return A.table(s, d, "orders").select("o_orderkey", name.alias("name"))


@add("name_slots", "SELECT o_orderkey, split_part(n, '_', 2) AS place, substr(n, 5) AS leg FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') || '_' || lower(o_orderstatus) || '_x' AS n FROM orders)")
def name_slots(s, d):
    n = F.concat_ws("_", F.date_format("o_orderdate", "yyyyMMdd"), F.lower("o_orderstatus"), F.lit("x"))
    return A.table(s, d, "orders").select("o_orderkey", names.slot(n, 1).alias("place"), names.leg_name(n).alias("leg"))


@add("name_units")
def name_units(s, d):
    return A.table(s, d, "part").select("p_partkey", names.name_units(c("p_name")).alias("units"), names.name_problems(F.concat(F.lit("20240101_"), c("p_name")), 2).alias("problems"))


TAGS = "map(CASE WHEN p_partkey % 2 = 0 THEN 'amenity' ELSE 'tourism' END, CASE p_partkey % 6 WHEN 0 THEN 'cafe' WHEN 1 THEN 'hotel' WHEN 2 THEN 'bank' WHEN 3 THEN 'museum' WHEN 4 THEN 'bar' ELSE 'info' END, CASE WHEN p_partkey % 3 = 0 THEN 'name:en' ELSE 'name' END, p_name)"


@add("map_tags", "SELECT p_partkey, p_name AS name, CASE p_partkey % 6 WHEN 0 THEN 'eatery' WHEN 4 THEN 'eatery' WHEN 1 THEN 'stay' WHEN 3 THEN 'sight' END AS kind FROM part")
def map_tags(s, d):
    tagged = A.table(s, d, "part").withColumn("tags", F.expr(TAGS))
    return tagged.select("p_partkey", names.preferred_tag(c("tags"), ("name:ja", "name:en", "name")).alias("name"), names.place_kind(c("tags")).alias("kind"))


@add("who_render", "SELECT conv_id, CASE WHEN count(DISTINCT role) <= 1 THEN string_agg(DISTINCT role, '+' ORDER BY role) ELSE 'everyone' END AS who FROM conversations GROUP BY conv_id")
def who_render(s, d):
    return A.table(s, d, "conversations").groupBy("conv_id").agg(names.who_text(F.array_sort(F.collect_set("role")), 1, "everyone").alias("who"))


@add("date_probe", A.CTE + """, r AS (SELECT folder, taken, row_number() OVER (PARTITION BY folder ORDER BY file_name, file_no) - 1 AS p, count(*) OVER (PARTITION BY folder) AS n FROM typed)
    SELECT folder, count(*) AS probed, CAST(min(taken) AS VARCHAR) AS first, CAST(max(taken) AS VARCHAR) AS last FROM r WHERE p = 0 OR p = n // 2 OR p = n - 1 OR p % 25 = 0 GROUP BY folder""")
def date_probe(s, d):
    w = Window.partitionBy("folder")
    r = A.typed(s, d).withColumn("p", F.row_number().over(w.orderBy("file_name", "file_no")) - 1).withColumn("n", F.count("*").over(w))
    picked = r.where("p = 0 or p = floor(n / 2) or p = n - 1 or p % 25 = 0")
    return picked.groupBy("folder").agg(F.count("*").alias("probed"), F.min("taken").cast("string").alias("first"), F.max("taken").cast("string").alias("last"))


@add("name_index", A.CTE + "SELECT lower(file_name) AS name, folder || '/' || file_no AS path, CAST(split_part(file_size, ' ', 1) AS BIGINT) AS size, count(*) OVER (PARTITION BY lower(file_name)) AS paths FROM manifest")
def name_index(s, d):
    # one row a path, so a name of any number of paths is only counted
    rows = A.manifest(s, d).select(F.lower("file_name").alias("name"), F.concat_ws("/", "folder", c("file_no").cast("string")).alias("path"), F.get(F.split("file_size", " "), F.lit(0)).cast("bigint").alias("size"))
    return rows.join(rows.groupBy("name").agg(F.count("*").alias("paths")), "name")


@add("verify_report", "SELECT CASE WHEN l.doc_id IS NULL THEN 'gone' WHEN quality = 0 THEN 'moved' ELSE 'present' END AS verdict, count(*) AS files FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def verify_report(s, d):
    joined = A.table(s, d, "documents").select("doc_id").join(A.table(s, d, "labels").withColumn("there", F.lit(True)), "doc_id", "left")
    return joined.groupBy(F.when(c("there").isNull(), "gone").when(c("quality") == 0, "moved").otherwise("present").alias("verdict")).agg(F.count("*").alias("files"))


@add("content_reclaim", "WITH p AS (SELECT n_chars, sha256(text) AS sha, min(doc_id) AS donor FROM documents WHERE doc_id % 2 = 0 GROUP BY ALL) SELECT doc_id, donor FROM documents d JOIN p ON p.n_chars = d.n_chars AND p.sha = sha256(text) WHERE doc_id % 2 = 1")
def content_reclaim(s, d):
    docs = A.table(s, d, "documents").select("doc_id", "n_chars", F.sha2("text", 256).alias("sha"))
    pool = docs.where("doc_id % 2 = 0").groupBy("n_chars", "sha").agg(F.min("doc_id").alias("donor"))
    return docs.where("doc_id % 2 = 1").join(pool, ["n_chars", "sha"]).select("doc_id", "donor")


@add("primary_detection", "SELECT l_orderkey AS file, arg_min(l_linenumber, (l_linenumber, l_partkey)) AS det_index, count(*) AS det_count FROM lineitem WHERE l_discount > 0.02 GROUP BY l_orderkey")
def primary_detection(s, d):
    kept = A.table(s, d, "lineitem").where("l_discount > 0.02")
    return kept.groupBy(c("l_orderkey").alias("file")).agg(F.min("l_linenumber").alias("det_index"), F.count("*").alias("det_count"))


@add("detection_marks", "SELECT l_orderkey AS file, l_linenumber AS det_index, count(*) OVER (PARTITION BY l_orderkey) AS det_count FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o_orderkey = l_orderkey AND o_orderkey % 7 = l_linenumber)")
def detection_marks(s, d):
    marks = A.table(s, d, "orders").select(c("o_orderkey").alias("l_orderkey"), (c("o_orderkey") % 7).cast("int").alias("l_linenumber")).distinct()
    left = A.table(s, d, "lineitem").join(marks, ["l_orderkey", "l_linenumber"], "left_anti")
    return left.select(c("l_orderkey").alias("file"), c("l_linenumber").alias("det_index"), F.count("*").over(Window.partitionBy("l_orderkey")).alias("det_count"))


def members(s, d):
    return A.typed(s, d).select(
        (c("file_no") % 60).alias("cluster"), c("file_no").alias("id"), "taken", F.when(c("lat").isNotNull(), F.concat(F.when(c("lat") < 25.25, "residence-").otherwise("place-"), F.floor(c("lat") * 4).cast("string"))).alias("area"),
        (~parse.no_camera(c("make"), c("model"))).alias("has_camera"))


AXES = A.CTE + """, m AS (SELECT file_no % 60 AS cluster, file_no AS id, taken, CASE WHEN lat IS NOT NULL THEN CASE WHEN lat < 25.25 THEN 'residence-' ELSE 'place-' END || CAST(floor(lat * 4) AS BIGINT) END AS area, NOT (make IN ('-', '') AND model IN ('-', '')) AS has_camera FROM typed),
    a AS (SELECT cluster, area, count(*) AS n, min(id) AS first FROM m WHERE area IS NOT NULL GROUP BY ALL),
    t AS (SELECT cluster, arg_max(area, (n, -first)) AS bound_area, max(n) / sum(n) AS b FROM a GROUP BY cluster),
    x AS (SELECT cluster, count(*) AS mass, count(DISTINCT CAST(taken AS DATE)) AS days, count(DISTINCT substr(CAST(taken AS VARCHAR), 1, 7)) AS months,
      round(count(*) FILTER (hour(taken) IN (19, 20, 21, 22, 23, 0, 1, 2, 3, 4, 5, 6)) / nullif(count(taken), 0), 3) AS night_share, round(count(*) FILTER (NOT has_camera) / count(*), 3) AS no_camera_share FROM m GROUP BY cluster),
    axes AS (SELECT x.*, bound_area, coalesce(round(b, 3), 0) AS boundness FROM x LEFT JOIN t USING (cluster))"""


@add("cluster_axes", AXES + " SELECT * FROM axes")
def cluster_axes(s, d):
    return recurrence.axes(members(s, d), "cluster")


@add("candidate_gate", AXES + """ SELECT cluster, CASE WHEN no_camera_share >= 0.8 THEN 'bulk_no_camera_class' WHEN boundness >= 0.6 AND starts_with(bound_area, 'residence-') THEN 'residence_bound_pattern'
    WHEN boundness >= 0.6 AND bound_area IS NOT NULL THEN 'place_bound_pattern' ELSE 'recurring_subject_or_scene' END AS kind FROM axes WHERE mass >= 8 AND days >= 4 AND months >= 2""")
def candidate_gate(s, d):
    return recurrence.kind(recurrence.gate(recurrence.axes(members(s, d), "cluster"))).select("cluster", "kind")


@add("blast_radius")
def blast_radius(s, d):
    rows = unit(s, d).select("id", "v")
    clusters = vectors.alike_leaders(rows, 0.2).select("id", c("leader").alias("key"))
    big = clusters.groupBy("key").agg(F.count("*").alias("n")).where("n >= 12").select("key")
    return recurrence.blast_radius(rows, clusters, big, TAU, 0.05, 8)


@add("ladder_picks")
def ladder_picks(s, d):
    scored = vectors.nearest_two(unit(s, d), classes(s, d))
    near = vectors.nearest_members(unit(s, d), "label", 3).select("id", c("r").alias("medoid_rank"))
    rows = scored.join(near, "id", "left").select(
        "label", "id", F.lit(10).alias("budget"), "medoid_rank", F.when((c("best_score") >= GRAY) & (c("best_score") < TAU), c("best_score")).alias("gray"), F.when(c("best_score") < 0.15, c("best_score")).alias("outlier"))
    return ladder.run_ladder(rows, "label", P.RUNG1_SHARE)


@add("draft_store")
def draft_store(s, d):
    return ladder.fold_drafts(unit(s, d).select("label", c("id").alias("seq"), "v"), "label", TAU)


@add("trip_runs", """WITH d AS (SELECT DISTINCT o_custkey AS unit, CAST(o_orderdate AS DATE) AS day, o_custkey % 3 AS country FROM orders), n AS (SELECT *, CASE WHEN date_diff('day', lag(day) OVER w, day) <= 30 THEN 0 ELSE 1 END AS cut FROM d WINDOW w AS (PARTITION BY unit ORDER BY day)),
    r AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY unit ORDER BY day) AS BIGINT) AS trip FROM n) SELECT unit, trip, CAST(min(day) AS VARCHAR) AS first, CAST(max(day) AS VARCHAR) AS last, count(*) AS days FROM r GROUP BY unit, trip HAVING count(*) >= 2""")
def trip_runs(s, d):
    w = Window.partitionBy("unit").orderBy("day")
    days = A.table(s, d, "orders").select(c("o_custkey").alias("unit"), F.to_date("o_orderdate").alias("day")).distinct()
    cut = F.when(F.datediff("day", F.lag("day").over(w)) <= 30, 0).otherwise(1)
    runs = days.withColumn("cut", cut).withColumn("trip", F.sum("cut").over(w))
    return runs.groupBy("unit", "trip").agg(F.min("day").cast("string").alias("first"), F.max("day").cast("string").alias("last"), F.count("*").alias("days")).where("days >= 2")


@add("rule_place_differs", "SELECT s_suppkey, s_nationkey, n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 5 <> n_regionkey")
def rule_place_differs(s, d):
    n = F.broadcast(A.table(s, d, "nation").select(c("n_nationkey").alias("s_nationkey"), "n_regionkey"))
    return A.table(s, d, "supplier").join(n, "s_nationkey").where("s_suppkey % 5 <> n_regionkey").select("s_suppkey", "s_nationkey", "n_regionkey")


@add("rule_missing_names", "SELECT source, string_agg(lang, '+' ORDER BY lang) AS missing FROM (SELECT DISTINCT source, lang FROM documents WHERE lang <> 'en') GROUP BY source")
def rule_missing_names(s, d):
    backed = A.table(s, d, "documents").groupBy("source").agg(F.collect_set("lang").alias("langs"))
    gone = F.array_sort(F.array_except("langs", F.array(F.lit("en"))))
    return backed.where(F.size(gone) > 0).select("source", F.array_join(gone, "+").alias("missing"))


@add("batch_days", "SELECT source, count(DISTINCT doc_id % 30) AS days, min(doc_id % 30) AS first, max(doc_id % 30) AS last FROM documents GROUP BY source")
def batch_days(s, d):
    day = c("doc_id") % 30
    return A.table(s, d, "documents").groupBy("source").agg(F.count_distinct(day).alias("days"), F.min(day).alias("first"), F.max(day).alias("last"))


@add("allowed_destinations", "SELECT page_id FROM pages WHERE EXISTS (SELECT 1 FROM (VALUES ('/en'), ('/a/b')) p(prefix) WHERE '/' || split_part(url, '/', 4) = prefix OR starts_with('/' || split_part(url, '/', 4), prefix || '/'))")
def allowed_destinations(s, d):
    prefixes = s.createDataFrame([("/en",), ("/a/b",)], "prefix string")
    path = F.concat(F.lit("/"), F.get(F.split("url", "/"), F.lit(3)))
    hit = (path == c("prefix")) | path.startswith(F.concat("prefix", F.lit("/")))
    return A.table(s, d, "pages").join(F.broadcast(prefixes), hit, "left_semi").select("page_id")


@add("recorded_rate", "SELECT event_type, arg_max(value, (ts, event_id)) AS rate FROM events GROUP BY event_type")
def recorded_rate(s, d):
    return A.table(s, d, "events").groupBy("event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("rate"))


@add("settings_pairs", "SELECT a.n_nationkey AS low, b.n_nationkey AS high FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1 WHERE a.n_regionkey > b.n_regionkey")
def settings_pairs(s, d):
    n = A.table(s, d, "nation").select(c("n_nationkey").cast("long").alias("k"), c("n_regionkey").alias("value"))
    other = n.select((c("k") - 1).alias("k"), c("k").alias("high"), c("value").alias("bound"))
    return n.join(other, "k").where("value > bound").select(c("k").alias("low"), "high")


FLAT = """min(sqrt(pow(lon * kx - x1 * kx - t * dx, 2) + pow(lat * 110.57 - y1 * 110.57 - t * dy, 2)))"""
EDGE = A.CTE + f""", pe AS (SELECT file_no, lat, lon, shape, y1, x1, cos(radians(lat)) * 111.32e0 AS kx, (x2 - x1) * cos(radians(lat)) * 111.32e0 AS dx, (y2 - y1) * 110.57e0 AS dy FROM typed, {A.values(EDGES, "shape, y1, x1, y2, x2")} WHERE lat IS NOT NULL),
    pt AS (SELECT *, greatest(0, least(1, ((lon - x1) * kx * dx + (lat - y1) * 110.57e0 * dy) / (dx * dx + dy * dy))) AS t FROM pe),
    km AS (SELECT file_no, shape, {FLAT} AS km FROM pt GROUP BY file_no, shape)"""


def edges(s):
    return s.createDataFrame(EDGES, "shape string, y1 double, x1 double, y2 double, x2 double")


@add("edge_distance", EDGE + " SELECT file_no, shape, round(km, 6) AS km FROM km")
def edge_distance(s, d):
    points = A.typed(s, d).where("lat is not null").select("file_no", "lat", "lon")
    return geo.edge_km(points, edges(s), ["file_no"]).withColumn("km", F.round("km", 6))


@add("country_of_point", EDGE + f""", held AS (SELECT file_no, min(shape) AS held FROM (SELECT file_no, shape FROM typed, {A.values(EDGES, "shape, y1, x1, y2, x2")} WHERE lat IS NOT NULL AND y1 <> y2
      GROUP BY file_no, shape HAVING count(*) FILTER ((y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1) % 2 = 1) GROUP BY file_no)
    SELECT shape, count(*) AS files FROM (SELECT file_no, coalesce(any_value(held), arg_min(shape, (km, shape)) FILTER (km <= 15)) AS shape FROM km LEFT JOIN held USING (file_no) GROUP BY file_no) GROUP BY shape""")
def country_of_point(s, d):
    points = A.typed(s, d).where("lat is not null").select("file_no", "lat", "lon")
    return geo.country_of(points, edges(s), ["file_no"], P.OUTLINE_KM).groupBy("shape").agg(F.count("*").alias("files"))


@add("areas")
def areas(s, d):
    return census.areas(A.typed(s, d).where("lat is not null and day is not null"), days=8, months=1)


@add("prior_match")
def prior_match(s, d):
    return vectors.match_alike(unit(s, d), 0.2)


@add("home_stops", A.CTE + f""", p AS (SELECT folder, day, lat, lon FROM typed WHERE lat IS NOT NULL AND day IS NOT NULL), m AS (SELECT folder, day, median(lat) AS clat, median(lon) AS clon FROM p GROUP BY ALL),
    k AS (SELECT folder, day, min({HAV.format(a="clat", b="clon", c="hlat", d="hlon")}) AS centre, min({HAV.format(a="lat", b="lon", c="hlat", d="hlon")}) AS point FROM p JOIN m USING (folder, day), {A.HOMES_SQL} WHERE {VALID} GROUP BY ALL)
    SELECT folder, CAST(day AS VARCHAR) AS day, CASE WHEN centre < 3 THEN 'centre' ELSE 'point' END AS via FROM k WHERE centre < 3 OR point < 3""")
def home_stops(s, d):
    points = A.typed(s, d).where("lat is not null and day is not null").select("folder", "day", "lat", "lon")
    mid = points.groupBy("folder", "day").agg(F.median("lat").alias("clat"), F.median("lon").alias("clon"))
    pairs = with_homes(s, points.join(mid, ["folder", "day"]))
    near = pairs.groupBy("folder", "day").agg(F.min(geo.haversine_km(c("clat"), c("clon"), c("hlat"), c("hlon"))).alias("centre"), F.min("km").alias("point"))
    return near.where((c("centre") < 3) | (c("point") < 3)).select("folder", c("day").cast("string").alias("day"), F.when(c("centre") < 3, "centre").otherwise("point").alias("via"))
