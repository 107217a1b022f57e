"""Queries of plans, folders, day types, stops and their checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepool import params as P
from tidepool.functions import geo, parse
from tidepool.operators import census, joins, rules, timeline
from tidepool.plans import adapters as A
from tidepool.plans.stored import small

from .basics import EDGES, HAV, IMG, PRE, VALID, VID, homes_of, placed
from .looks import MISSED, PLACES, found_places
from .more import edges
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


HOME_KM = HAV.format(a="lat", b="lon", c="hlat", d="hlon")
HOLDS = "count(*) FILTER ((y1 > plat) <> (y2 > plat) AND plon < (x2 - x1) * (plat - y1) / (y2 - y1) + x1) % 2 = 1"
EDGE_ROWS = A.values(EDGES, "shape, y1, x1, y2, x2")
DAY_TYPES = A.CTE + f""", d AS (SELECT folder, day, median(lat) AS lat, median(lon) AS lon, count(*) AS files FROM typed WHERE day IS NOT NULL GROUP BY ALL),
    hs AS (SELECT id, min(shape) AS shape FROM (SELECT id, hlat AS plat, hlon AS plon, shape, y1, x1, y2, x2 FROM {A.HOMES_SQL}, {EDGE_ROWS} WHERE y1 <> y2) GROUP BY id, shape HAVING {HOLDS}), hshape AS (SELECT id, min(shape) AS shape FROM hs GROUP BY id),
    ps AS (SELECT folder, day, min(shape) AS here FROM (SELECT folder, day, shape FROM (SELECT folder, day, lat AS plat, lon AS plon, shape, y1, x1, y2, x2 FROM d, {EDGE_ROWS} WHERE lat IS NOT NULL AND y1 <> y2) GROUP BY folder, day, shape HAVING {HOLDS}) GROUP BY folder, day),
    own AS (SELECT shape AS country FROM hshape ORDER BY id LIMIT 1),
    hv AS (SELECT folder, day, bool_or({HOME_KM} <= 3.0) AS near, list(hshape.shape) AS shapes FROM d, {A.HOMES_SQL} h LEFT JOIN hshape USING (id) WHERE {VALID} GROUP BY folder, day),
    day_types AS (SELECT folder, day, files, lat, lon, here, CASE WHEN lat IS NULL THEN '' WHEN here IS NOT NULL AND here IS DISTINCT FROM (SELECT country FROM own) AND NOT coalesce(list_contains(shapes, here), false) THEN 'ABROAD' WHEN coalesce(near, false) THEN 'HOME' ELSE 'AWAY' END AS type
      FROM d LEFT JOIN ps USING (folder, day) LEFT JOIN hv USING (folder, day))"""


def day_types(s, d):
    """Days with their type from the owner's country, the outlines and the homes valid that day.

    The owner's country is the outline that holds the first home that one holds. A day is ABROAD if
    another outline holds its middle and no home valid that day lies in it too."""
    days = A.typed(s, d).where("day is not null").groupBy("folder", "day").agg(F.median("lat").alias("lat"), F.median("lon").alias("lon"), F.count("*").alias("files"))
    outlines = edges(s)
    homes = A.homes(s).select("id", c("hlat").alias("lat"), c("hlon").alias("lon"))
    held = {r["id"]: r["shape"] for r in geo.crossings(homes, outlines, ["id"]).where("inside").groupBy("id").agg(F.min("shape").alias("shape")).collect()}  # homes are literals
    country = held[min(held)] if held else None
    here = geo.crossings(days.where("lat is not null").select("folder", "day", "lat", "lon"), outlines, ["folder", "day"]).where("inside").groupBy("folder", "day").agg(F.min("shape").alias("here"))
    near = geo.nearest_of(c("lat"), c("lon"), homes_of(c("day")))
    at_home = F.lit(False)
    for (_, _, valid, own) in homes_of(c("day")):
        if held.get(own["id"]):
            at_home = at_home | (valid & (c("here") == held[own["id"]]))
    abroad = c("here").isNotNull() & ~c("here").eqNullSafe(F.lit(country)) & ~at_home
    kind = F.when(c("lat").isNull(), "").when(F.coalesce(abroad, F.lit(False)), "ABROAD").when(F.coalesce(near["km"] <= P.AWAY_KM, F.lit(False)), "HOME").otherwise("AWAY")
    return days.join(here, ["folder", "day"], "left").withColumn("type", kind)


@add("day_types", DAY_TYPES + " SELECT folder, CAST(day AS VARCHAR) AS day, coalesce(here, '') AS here, type, files FROM day_types")
def day_type_rows(s, d):
    return day_types(s, d).select("folder", c("day").cast("string").alias("day"), F.coalesce("here", F.lit("")).alias("here"), "type", "files")


#: Day types with those of days without positions filled in from the days around them.
TYPES = DAY_TYPES + """, t AS (SELECT folder, day, files, nullif(type, '') AS raw, lat, lon FROM day_types),
    f AS (SELECT *, last_value(raw IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, first_value(raw IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM t WINDOW w AS (PARTITION BY folder ORDER BY day)),
    typed_days AS (SELECT folder, day, files, lat, lon, coalesce(raw, CASE WHEN p = n THEN p WHEN (p IS NULL AND n = 'ABROAD') OR (n IS NULL AND p = 'ABROAD') THEN 'ABROAD' ELSE 'HOME' END) AS type FROM f)"""


def typed_days(s, d):
    days = day_types(s, d).select("folder", "day", "files", "lat", "lon", F.when(c("type") != "", c("type")).alias("type"))
    return timeline.fill_types(days, ["folder"])


@add("day_type_fill", TYPES + " SELECT folder, CAST(day AS VARCHAR) AS day, type FROM typed_days")
def day_type_fill(s, d):
    return typed_days(s, d).select("folder", c("day").cast("string").alias("day"), "type")


RUNS = TYPES + f""", cuts AS (SELECT *, CASE WHEN lag(day) OVER w IS NULL OR lag(type) OVER w <> type OR date_diff('day', lag(day) OVER w, day) > 2
      OR (type IN ('AWAY', 'ABROAD') AND coalesce({HAV.format(a="lag(lat) OVER w", b="lag(lon) OVER w", c="lat", d="lon")} > 10, false)) THEN 1 ELSE 0 END AS cut FROM typed_days WINDOW w AS (PARTITION BY folder ORDER BY day)),
    runs AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY folder ORDER BY day) AS BIGINT) AS run FROM cuts)"""


@add("run_islands", RUNS + " SELECT folder, run, any_value(type) AS type, CAST(min(day) AS VARCHAR) AS first, CAST(max(day) AS VARCHAR) AS last, count(*) AS days, CAST(sum(files) AS BIGINT) AS files FROM runs GROUP BY folder, run")
def run_islands(s, d):
    runs = timeline.number_runs(typed_days(s, d), ["folder"], 2, 10.0)
    return runs.groupBy("folder", "run").agg(F.first("type").alias("type"), F.min("day").cast("string").alias("first"), F.max("day").cast("string").alias("last"), F.count("*").alias("days"), F.sum("files").alias("files"))


@add("split_runs")
def split_runs(s, d):
    runs = timeline.number_runs(typed_days(s, d), ["folder"], 2, 1000.0)
    return timeline.split_runs(runs.select("folder", "run", "day", "files", "lat", "lon"), ["folder", "run"], 8)


@add("trip_candidates", DAY_TYPES + """, n AS (SELECT folder, day, here, files, date_diff('day', lag(day) OVER w, day) AS gap, lag(here) OVER w AS before FROM day_types WHERE type = 'ABROAD' WINDOW w AS (PARTITION BY folder ORDER BY day)),
    r AS (SELECT *, sum(CASE WHEN gap <= 2 AND before = here THEN 0 ELSE 1 END) OVER (PARTITION BY folder ORDER BY day) AS trip FROM n) SELECT folder, CAST(trip AS BIGINT) AS trip, any_value(here) AS country, CAST(min(day) AS VARCHAR) AS first, CAST(max(day) AS VARCHAR) AS last, CAST(sum(files) AS BIGINT) AS files FROM r GROUP BY folder, trip HAVING min(day) < max(day)""")
def trip_candidates(s, d):
    w = Window.partitionBy("folder").orderBy("day")
    days = day_types(s, d).where("type = 'ABROAD'")
    same = (F.datediff("day", F.lag("day").over(w)) <= 2) & (F.lag("here").over(w) == c("here"))
    runs = days.withColumn("cut", F.when(same, 0).otherwise(1)).withColumn("trip", F.sum("cut").over(w))
    found = runs.groupBy("folder", "trip").agg(F.first("here").alias("country"), F.min("day").alias("first"), F.max("day").alias("last"), F.sum("files").alias("files"))
    return found.where(c("first") < c("last")).select("folder", "trip", "country", c("first").cast("string").alias("first"), c("last").cast("string").alias("last"), "files")


@add("anchor_cell", A.CTE + """, d AS (SELECT day, median(lat) AS lat, median(lon) AS lon FROM typed WHERE lat IS NOT NULL AND day IS NOT NULL GROUP BY day), k AS (SELECT *, CAST(round_even(lat / 0.2, 0) AS BIGINT) AS cy, CAST(round_even(lon / 0.2, 0) AS BIGINT) AS cx FROM d),
    top AS (SELECT cy, cx FROM k GROUP BY cy, cx ORDER BY count(*) DESC, min(day) LIMIT 1) SELECT round(median(lat), 6) AS lat, round(median(lon), 6) AS lon, count(*) AS days FROM k JOIN top USING (cy, cx)""")
def anchor_cell(s, d):
    days = placed(s, d).groupBy("day").agg(F.median("lat").alias("lat"), F.median("lon").alias("lon"))
    celled = days.withColumn("cy", geo.cell_even(c("lat"), 0.2)).withColumn("cx", geo.cell_even(c("lon"), 0.2))
    top = celled.groupBy("cy", "cx").agg(F.count("*").alias("n"), F.min("day").alias("first")).orderBy(F.desc("n"), "first").limit(1)
    return celled.join(F.broadcast(top.select("cy", "cx")), ["cy", "cx"]).agg(F.round(F.median("lat"), 6).alias("lat"), F.round(F.median("lon"), 6).alias("lon"), F.count("*").alias("days"))


SIZES = A.CTE + """, z AS (SELECT file_no, file_name, make, model, file_type, least(try_cast(width AS INTEGER), try_cast(height AS INTEGER)) AS short, greatest(try_cast(width AS INTEGER), try_cast(height AS INTEGER)) AS long FROM manifest WHERE try_cast(width AS INTEGER) IS NOT NULL),
    bare AS (SELECT * FROM z WHERE make IN ('-', '') AND model IN ('-', '')), cand AS (SELECT short, long FROM bare GROUP BY short, long HAVING count(*) FILTER (regexp_matches(file_name, '(?i)^screenshot')) >= 2),
    pending AS (SELECT * FROM cand EXCEPT (SELECT 1080, 2400 UNION SELECT 3024, 4032))"""
ANSWERED = [(1080, 2400), (3024, 4032)]


def pending(s, d):
    """(sizes without a camera that screenshots prove and that nobody answered, rows with their size)."""
    w, h = c("width").try_cast("int"), c("height").try_cast("int")
    rows = A.manifest(s, d).where(w.isNotNull()).select("file_no", "file_name", "file_type", parse.no_camera(c("make"), c("model")).alias("bare"), F.least(w, h).alias("short"), F.greatest(w, h).alias("long"))
    found = rows.where("bare").groupBy("short", "long").agg(F.count_if(c("file_name").rlike("(?i)^screenshot")).alias("named")).where(c("named") >= P.SCREEN_HITS)
    return found.join(F.broadcast(s.createDataFrame(ANSWERED, "short int, long int")), ["short", "long"], "left_anti").select("short", "long"), rows


@add("pending_sizes", SIZES + " SELECT short, long, count(z.file_no) AS files FROM pending JOIN z USING (short, long) GROUP BY ALL")
def pending_sizes(s, d):
    sizes, rows = pending(s, d)
    return rows.join(small(sizes), ["short", "long"]).groupBy("short", "long").agg(F.count("*").alias("files"))


@add("held_from_vision", SIZES + f" SELECT file_no FROM bare JOIN pending USING (short, long) WHERE file_type IN ({IMG})")
def held_from_vision(s, d):
    sizes, rows = pending(s, d)
    return rows.where(c("bare") & c("file_type").isin(*P.IMAGE_TYPES)).join(small(sizes), ["short", "long"], "left_semi").select("file_no")


@add("twin_plan", f"""WITH f AS (SELECT *, doc_id % 9 = 0 AS copied FROM ({DOCS}) WHERE doc_id % 5 <> 0), tree AS (SELECT size, sha, min(path) AS tree_path FROM ({DOCS}) WHERE doc_id % 5 = 0 GROUP BY size, sha),
    t AS (SELECT f.path, coalesce(tree_path, CASE WHEN f.path <> k.keep THEN k.keep END) AS twin FROM f LEFT JOIN tree USING (size, sha) JOIN (SELECT size, sha, arg_min(path, (NOT copied, length(name), path)) AS keep FROM f GROUP BY size, sha) k USING (size, sha) WHERE NOT copied)
    SELECT f.path, CASE WHEN doc_id % 17 = 0 THEN 'skip_junk' WHEN twin IS NOT NULL THEN 'skip_dupe' ELSE 'copy' END AS action, CASE WHEN doc_id % 17 = 0 THEN '' WHEN twin IS NOT NULL THEN twin ELSE 'out/' || source END AS dest,
      CASE WHEN doc_id % 17 <> 0 AND twin IS NOT NULL THEN 'out/' || source ELSE '' END AS fallback FROM (SELECT f.*, split_part(f.path, '/', 1) AS source FROM f) f LEFT JOIN t USING (path)""")
def twin_plan(s, d):
    files = doc_files(s, d)
    dump = files.where("doc_id % 5 <> 0").withColumn("copied", c("doc_id") % 9 == 0)
    twins = joins.twins(dump, files.where("doc_id % 5 = 0").select("path", "size", "sha"))
    plan = dump.select("path", F.when(c("doc_id") % 17 == 0, "skip_junk").otherwise("copy").alias("action"), F.when(c("doc_id") % 17 == 0, "").otherwise(F.concat(F.lit("out/"), "source")).alias("dest"))
    return rules.apply_twins(plan, twins)


@add("no_date_plan", A.CTE + f""" SELECT file_no, CASE WHEN split_part(file_size, ' ', 1) = '0' THEN 'skip_junk' ELSE 'copy' END AS action, {PRE} AS class,
    CASE WHEN split_part(file_size, ' ', 1) = '0' THEN '' WHEN file_type IN ({VID}) AND regexp_matches(modified, '^(19|20)') THEN 'out/' || substr(modified, 1, 4) || '/' || substr(modified, 1, 4) || '00_check' ELSE 'out/_check/import' END AS dest FROM typed WHERE taken IS NULL""")
def no_date_plan(s, d):
    rows = A.typed(s, d).where("taken is null")
    empty = rules.is_empty()
    year = parse.file_year(c("modified"))
    video = c("file_type").isin(*P.VIDEO_TYPES) & year.isNotNull()
    bucket = F.when(video, parse.bucket_path(F.lit("out"), F.concat(year, F.lit("00_check")))).otherwise("out/_check/import")
    return rows.select("file_no", F.when(empty, "skip_junk").otherwise("copy").alias("action"), rules.preclass().alias("class"), F.when(empty, "").otherwise(bucket).alias("dest"))


@add("dedupe_results", """WITH r AS (SELECT l_orderkey AS batch, l_partkey AS source, min(l_suppkey) AS existing FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) SELECT o_orderkey AS batch, count(source) AS dupes, count(source) = 0 AS missing FROM orders LEFT JOIN r ON r.batch = o_orderkey GROUP BY o_orderkey""")
def dedupe_results(s, d):
    found = A.table(s, d, "lineitem").where("l_returnflag = 'R'").select(c("l_orderkey").alias("batch"), c("l_partkey").alias("source")).distinct().groupBy("batch").agg(F.count("*").alias("n"))
    want = A.table(s, d, "orders").select(c("o_orderkey").alias("batch"))
    return want.join(found, "batch", "left").select("batch", F.coalesce("n", F.lit(0)).alias("dupes"), c("n").isNull().alias("missing"))


@add("manifest_union", A.CTE + " SELECT DISTINCT folder, file_name FROM (SELECT * FROM typed WHERE taken IS NOT NULL UNION ALL SELECT * FROM typed WHERE lat IS NULL)")
def manifest_union(s, d):
    rows = A.typed(s, d).select("folder", "file_name", "taken", "lat")
    return rows.where("taken is not null").unionByName(rows.where("lat is null")).select("folder", "file_name").dropDuplicates()


@add("month_positions", A.CTE + " SELECT folder, month, CAST(dense_rank() OVER (ORDER BY month) - 1 AS BIGINT) AS place FROM (SELECT DISTINCT folder, month FROM typed WHERE month IS NOT NULL)")
def month_positions(s, d):
    seen = A.typed(s, d).where("month is not null").select("folder", "month").distinct()
    # months are a few hundred at most
    place = seen.select("month").distinct().select("month", (F.row_number().over(Window.orderBy("month")) - 1).cast("long").alias("place"))
    return seen.join(F.broadcast(place), "month").select("folder", "month", "place")


@add("copy_stats", A.CTE + """, h AS (SELECT file_no, CASE WHEN file_no % 23 = 0 THEN 'wrong' WHEN file_no % 19 = 0 THEN NULL ELSE 'sha' || file_no END AS sha FROM manifest), v AS (SELECT file_no, folder, 'sha' || file_no AS want FROM manifest WHERE file_no % 4 <> 0)
    SELECT folder, count(*) FILTER (sha = want) AS copied, count(*) FILTER (sha <> want) AS wrong, count(*) FILTER (sha IS NULL) AS absent FROM v LEFT JOIN h USING (file_no) GROUP BY folder""")
def copy_stats(s, d):
    rows = A.manifest(s, d).select("file_no", "folder", F.concat(F.lit("sha"), c("file_no").cast("string")).alias("want"))
    there = rows.select("file_no", F.when(c("file_no") % 23 == 0, "wrong").when(c("file_no") % 19 == 0, None).otherwise(c("want")).alias("sha"))
    return rules.copy_verdicts(rows.where("file_no % 4 <> 0"), there).groupBy("folder").agg(*[F.count_if(c("verdict") == v).alias(v) for v in ("copied", "wrong", "absent")])


@add("folder_identity", A.CTE + """, k AS (SELECT folder, month, sha256(string_agg(n, '|' ORDER BY n)) AS own FROM (SELECT DISTINCT folder, month, file_type AS n FROM typed WHERE month IS NOT NULL) GROUP BY folder, month) SELECT folder, own, count(*) AS cuts, min(month) AS first FROM k GROUP BY folder, own""")
def folder_identity(s, d):
    members = A.typed(s, d).where("month is not null").groupBy("folder", "month").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("file_type")), "|"), 256).alias("own"))
    return members.groupBy("folder", "own").agg(F.count("*").alias("cuts"), F.min("month").alias("first"))


@add("tree_multiset", f"SELECT split_part(path, '/', 1) AS folder, size, sha, count(*) AS n FROM ({DOCS}) GROUP BY ALL")
def tree_multiset(s, d):
    return doc_files(s, d).groupBy(c("source").alias("folder"), "size", "sha").agg(F.count("*").alias("n"))


@add("day_claims", A.CTE + " SELECT folder, count(*) AS days, CAST(min(day) AS VARCHAR) AS first, CAST(max(day) AS VARCHAR) AS last, date_diff('day', min(day), max(day)) + 1 = count(*) AS whole FROM (SELECT DISTINCT folder, day FROM typed WHERE day IS NOT NULL) GROUP BY folder")
def day_claims(s, d):
    days = A.typed(s, d).where("day is not null").select("folder", "day").distinct()
    return days.groupBy("folder").agg(F.count("*").alias("days"), F.min("day").cast("string").alias("first"), F.max("day").cast("string").alias("last"), (F.datediff(F.max("day"), F.min("day")) + 1 == F.count("*")).alias("whole"))


@add("frequent_unknown_places", PLACES + f""" SELECT days, months, files, lat, lon FROM places WHERE days >= 3 AND months >= 3 AND NOT EXISTS (SELECT 1 FROM {A.HOMES_SQL} WHERE {HOME_KM} <= 1.0) AND NOT EXISTS (SELECT 1 FROM {A.NAMED_SQL} WHERE {HAV.format(a='lat', b='lon', c='nlat', d='nlon')} <= 1.0)""")
def frequent_unknown_places(s, d):
    known = [(y, x) for _, y, x, *_ in A.HOMES] + [(y, x) for _, y, x, _ in A.NAMED]
    near = geo.nearest_of(c("lat"), c("lon"), [(y, x, F.lit(True), {}) for y, x in known])
    return found_places(s, d).where((c("days") >= 3) & (c("months") >= 3) & (near["km"] > P.MATCH_KM)).select("days", "months", "files", "lat", "lon")


@add("listed_homes", PLACES + f" SELECT days, files, lat, lon, coalesce((SELECT min(id) FROM {A.HOMES_SQL} WHERE {HOME_KM} < 1.0), '') AS listed FROM places WHERE {MISSED} = ''")
def listed_homes(s, d):
    listed = F.coalesce(*[F.when(geo.haversine_km(c("lat"), c("lon"), F.lit(y), F.lit(x)) < P.MATCH_KM, F.lit(name)) for name, y, x, *_ in A.HOMES], F.lit(""))
    return found_places(s, d).where("proposed").select("days", "files", "lat", "lon", listed.alias("listed"))


@add("numbered_places", PLACES + f" SELECT CAST(row_number() OVER (ORDER BY {MISSED} <> '', days DESC, night_days DESC, files DESC, lat, lon) AS INTEGER) AS page_no, lat, lon FROM places WHERE {MISSED} = '' OR days >= 2 OR night_days >= 1 ORDER BY 1 LIMIT 60")
def numbered_places(s, d):
    found = found_places(s, d).where("proposed or days >= 2 or night_days >= 1")
    top = found.orderBy(F.desc("proposed"), F.desc("days"), F.desc("night_days"), F.desc("files"), "lat", "lon").limit(60)  # rows of a page
    w = Window.orderBy(F.desc("proposed"), F.desc("days"), F.desc("night_days"), F.desc("files"), "lat", "lon")
    return top.select(F.row_number().over(w).alias("page_no"), "lat", "lon")


@add("place_labels", f"SELECT label, count(*) AS places, min(id) AS first FROM (SELECT id, label FROM {A.NAMED_SQL} UNION ALL SELECT id, label FROM {A.HOMES_SQL} UNION ALL SELECT 'm-' || s_suppkey, s_name FROM supplier) WHERE label IS NOT NULL GROUP BY label")
def place_labels(s, d):
    known = A.named(s).select("id", "label").unionByName(A.homes(s).select("id", "label")).unionByName(A.table(s, d, "supplier").select(F.concat(F.lit("m-"), c("s_suppkey").cast("string")).alias("id"), c("s_name").alias("label")))
    return known.where("label is not null").groupBy("label").agg(F.count("*").alias("places"), F.min("id").alias("first"))


WORDS = "CASE o_orderkey % 4 WHEN 0 THEN 'lake+hill' WHEN 1 THEN ' market + ' || o_orderstatus WHEN 2 THEN '25.1,121.2' ELSE 'north++lake' END"


@add("place_refs", f"""WITH k AS (SELECT label, count(*) AS n, min(id) AS id FROM (SELECT id, label FROM {A.NAMED_SQL} UNION ALL SELECT id, label FROM {A.HOMES_SQL}) WHERE label IS NOT NULL GROUP BY label),
    w AS (SELECT DISTINCT o_orderkey, trim(unnest(string_split({WORDS}, '+'))) AS word FROM orders WHERE o_orderkey % 4 <> 2) SELECT o_orderkey, CASE WHEN n = 1 THEN id ELSE 'map:' || word END AS ref FROM w LEFT JOIN k ON label = word WHERE word <> ''""")
def place_refs(s, d):
    known = A.named(s).select("id", "label").unionByName(A.homes(s).select("id", "label")).where("label is not null").groupBy("label").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    place = F.when(c("o_orderkey") % 4 == 0, "lake+hill").when(c("o_orderkey") % 4 == 1, F.concat(F.lit(" market + "), "o_orderstatus")).when(c("o_orderkey") % 4 == 2, "25.1,121.2").otherwise("north++lake")
    rows = A.table(s, d, "orders").select("o_orderkey", place.alias("place")).where(~c("place").rlike(r"^-?\d+(\.\d+)?,\s*-?\d+(\.\d+)?$"))
    words = rows.select("o_orderkey", F.explode(F.array_distinct(F.transform(F.split("place", "[+]"), lambda x: F.trim(x)))).alias("word")).where("word <> ''")
    met = words.join(F.broadcast(known), words["word"] == known["label"], "left")
    return met.select("o_orderkey", F.when(c("n") == 1, c("id")).otherwise(F.concat(F.lit("map:"), "word")).alias("ref"))


@add("first_batch_of_place", A.CTE + " SELECT CAST(floor(lat * 20) AS BIGINT) AS py, CAST(floor(lon * 20) AS BIGINT) AS px, min(folder) AS first_batch, count(DISTINCT folder) AS batches FROM typed WHERE lat IS NOT NULL GROUP BY ALL")
def first_batch_of_place(s, d):
    cell = lambda x: F.floor(c(x) * 20).cast("long")
    return A.typed(s, d).where("lat is not null").groupBy(cell("lat").alias("py"), cell("lon").alias("px")).agg(F.min("folder").alias("first_batch"), F.count_distinct("folder").alias("batches"))


@add("blocked_renames", """WITH r AS (SELECT page_id, '/' || split_part(url, '/', 4) AS target FROM pages WHERE page_id % 2 = 0), p AS (SELECT '/' || split_part(url, '/', 4) || CASE WHEN page_id % 4 = 1 THEN '/x' ELSE 'x' END AS dest FROM pages WHERE page_id % 2 = 1)
    SELECT page_id FROM r WHERE EXISTS (SELECT 1 FROM p WHERE dest = target OR starts_with(dest, target || '/'))""")
def blocked_renames(s, d):
    top = F.concat(F.lit("/"), F.coalesce(F.get(F.split("url", "/"), F.lit(3)), F.lit("")))
    pages = A.table(s, d, "pages").select("page_id", top.alias("target"))
    pending = pages.where("page_id % 2 = 1").select(F.concat("target", F.when(c("page_id") % 4 == 1, "/x").otherwise("x")).alias("dest"))
    return joins.blocked(pages.where("page_id % 2 = 0"), "target", pending, "dest").select("page_id")


@add("engine_names", "SELECT DISTINCT name FROM (SELECT split_part(url, '/', 4) AS name FROM pages UNION ALL SELECT o_orderpriority FROM orders UNION ALL SELECT p_name FROM part)")
def engine_names(s, d):
    one = lambda t, e: A.table(s, d, t).select(e.alias("name"))
    return one("pages", F.coalesce(F.get(F.split("url", "/"), F.lit(3)), F.lit(""))).union(one("orders", c("o_orderpriority"))).union(one("part", c("p_name"))).distinct()


@add("earlier_copies", """WITH w AS (SELECT doc_id, source || '/' || lang AS want FROM documents), h AS (SELECT doc_id, source || '/' || CASE WHEN doc_id % 6 = 0 THEN 'old' ELSE lang END AS old FROM documents WHERE doc_id % 2 = 0) SELECT old, want, count(*) AS files FROM h JOIN w USING (doc_id) WHERE old <> want GROUP BY old, want""")
def earlier_copies(s, d):
    rows = A.table(s, d, "documents").select("doc_id", "source", "lang")
    want = rows.select("doc_id", F.concat_ws("/", "source", "lang").alias("want"))
    old = rows.where("doc_id % 2 = 0").select("doc_id", F.concat_ws("/", "source", F.when(c("doc_id") % 6 == 0, "old").otherwise(c("lang"))).alias("old"))
    return old.join(want, "doc_id").where(c("old") != c("want")).groupBy("old", "want").agg(F.count("*").alias("files"))


@add("new_place_ids", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'p-' || s_suppkey ELSE 'p-' || ((SELECT max(s_suppkey) FROM supplier WHERE s_suppkey % 3 = 0) + row_number() OVER (PARTITION BY s_suppkey % 3 = 0 ORDER BY s_suppkey)) END AS place_id FROM supplier")
def new_place_ids(s, d):
    rows = A.table(s, d, "supplier").select("s_suppkey")
    has = c("s_suppkey") % 3 == 0
    mark = rows.where(has).agg(F.max("s_suppkey").alias("mark"))
    # places a pack lists are a bounded dimension; its new rows are numbered in one task
    new = rows.where(~has).withColumn("n", F.row_number().over(Window.orderBy("s_suppkey"))).join(F.broadcast(mark)).select("s_suppkey", F.concat(F.lit("p-"), (c("mark") + c("n")).cast("string")).alias("place_id"))
    return rows.where(has).select("s_suppkey", F.concat(F.lit("p-"), c("s_suppkey").cast("string")).alias("place_id")).unionByName(new)


@add("moved_files", A.CTE + " SELECT file_no, folder, CASE WHEN folder = 'f05' AND day BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' THEN 'f06' ELSE folder END AS new_folder FROM typed WHERE folder IN ('f05', 'f06')")
def moved_files(s, d):
    days = s.createDataFrame([("f05", "2024-01-10", "2024-01-20", "f06")], "folder string, first string, last string, target string")
    rows = A.typed(s, d).where(c("folder").isin("f05", "f06"))
    inside = c("day").between(F.to_date("first"), F.to_date("last"))
    return rows.join(F.broadcast(days), "folder", "left").select("file_no", "folder", F.when(inside, c("target")).otherwise(c("folder")).alias("new_folder"))


@add("retired_folders", A.CTE + " SELECT DISTINCT folder FROM manifest EXCEPT SELECT folder FROM typed WHERE month = '2024-02'")
def retired_folders(s, d):
    rows = A.typed(s, d).select("folder", "month")
    return rows.select("folder").distinct().join(rows.where("month = '2024-02'"), "folder", "left_anti")


@add("export_units", A.CTE + " SELECT folder, count(DISTINCT month) AS legs, count(DISTINCT day) FILTER (month = '2024-01') AS first_leg_days, CAST(min(day) AS VARCHAR) AS first, CAST(max(day) AS VARCHAR) AS last FROM typed WHERE day IS NOT NULL GROUP BY folder")
def export_units(s, d):
    legs = A.typed(s, d).where("day is not null").groupBy("folder", "month").agg(F.count_distinct("day").alias("days"), F.min("day").alias("a"), F.max("day").alias("z"))
    return legs.groupBy("folder").agg(F.count("*").alias("legs"), F.coalesce(F.max(F.when(c("month") == "2024-01", c("days"))), F.lit(0)).alias("first_leg_days"), F.min("a").cast("string").alias("first"), F.max("z").cast("string").alias("last"))


@add("freeze_hash", A.CTE + ", k AS (SELECT folder, sha256(string_agg(n || ':' || m, '|' ORDER BY m)) AS h FROM (SELECT folder, coalesce(month, '') AS m, count(*) AS n FROM typed GROUP BY ALL) GROUP BY folder) SELECT folder, h, h IN (SELECT h FROM k GROUP BY h HAVING count(*) > 1) AS shared FROM k")
def freeze_hash(s, d):
    n = A.typed(s, d).groupBy("folder", F.coalesce("month", F.lit("")).alias("m")).agg(F.count("*").alias("n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("m", "n"))), lambda x: F.concat_ws(":", x["n"].cast("string"), x["m"]))
    hashed = n.groupBy("folder").agg(F.sha2(F.array_join(parts, "|"), 256).alias("h"))
    again = hashed.groupBy("h").agg(F.count("*").alias("folders"))
    return hashed.join(again, "h").select("folder", "h", (c("folders") > 1).alias("shared"))


@add("stops_of_days")
def stops_of_days(s, d):
    """Stops of each day with their centre, points and whether a home or too few points keep them unnamed."""
    from .relations import stop_segments

    points = A.typed(s, d).where("lat is not null and taken is not null").select("folder", "day", c("file_no").alias("id"), "lat", "lon")
    stops = stop_segments(s, d).join(points, ["folder", "day", "id"]).groupBy("folder", "day", "stop").agg(F.count("*").alias("points"), F.median("lat").alias("lat"), F.median("lon").alias("lon"))
    near = geo.nearest_of(c("lat"), c("lon"), homes_of(c("day")))
    label = geo.nearest_of(c("lat"), c("lon"), [(y, x, F.lit(True), {"label": name}) for _, y, x, name in A.NAMED])
    why = F.when(F.coalesce(near["km"] < P.PRIVACY_KM, F.lit(False)), "home").when(c("points") < P.MIN_POINTS_TO_NAME, "brief").when(label["km"] <= P.PLACE_KM, "named")
    named = stops.withColumn("mode", F.coalesce(why, F.lit("open"))).withColumn("name", F.when(why == "named", label["label"]))
    w = Window.partitionBy("folder", "day").orderBy("stop").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return named.withColumn("day_name", F.last("name", True).over(w)).select("folder", c("day").cast("string").alias("day"), "stop", "points", "mode", "name", "day_name")
