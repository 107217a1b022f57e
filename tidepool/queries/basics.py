"""Queries of scans, parsed values, geography and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool import params as P
from tidepool.functions import geo, parse
from tidepool.operators import rules
from tidepool.plans import adapters as A

c = F.col
QUERIES, SQL = {}, {}


def add(name, sql=None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def both(names):
    return ", ".join(f"'{x}'" for x in names)


@add("day_rollup", A.CTE + """SELECT CAST(day AS VARCHAR) AS day, count(*) AS files, count(lat) AS gps_files, round(median(lat), 6) AS lat, round(median(lon), 6) AS lon
    FROM typed WHERE day IS NOT NULL GROUP BY day""")
def day_rollup(s, d):
    return A.typed(s, d).where("day is not null").groupBy(c("day").cast("string").alias("day")).agg(
        F.count("*").alias("files"), F.count("lat").alias("gps_files"), F.round(F.median("lat"), 6).alias("lat"), F.round(F.median("lon"), 6).alias("lon"))


@add("scan_inventory", A.CTE + f"""SELECT lower(regexp_extract(file_name, '\\.([^.]+)$', 1)) AS ext,
    CASE WHEN file_name LIKE '.\\_%' ESCAPE '\\' THEN 'junk' WHEN ext = 'aae' THEN 'sidecar' WHEN ext IN ({both(P.PHOTO_EXT)}) THEN 'photo'
         WHEN ext IN ({both(P.VIDEO_EXT)}) THEN 'video' ELSE 'other' END AS kind,
    count(*) AS files, CAST(sum(CAST(split_part(file_size, ' ', 1) AS BIGINT)) AS BIGINT) AS bytes FROM manifest GROUP BY ALL""")
def scan_inventory(s, d):
    ext = parse.extension(c("file_name"))
    kind = F.when(c("file_name").startswith("._"), "junk").when(ext == "aae", "sidecar").when(ext.isin(*P.PHOTO_EXT), "photo").when(ext.isin(*P.VIDEO_EXT), "video").otherwise("other")
    size = F.get(F.split("file_size", " "), F.lit(0)).cast("long")
    return A.manifest(s, d).groupBy(ext.alias("ext"), kind.alias("kind")).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"))


@add("junk_reason", A.CTE + f"""SELECT m.folder, m.file_name, CASE WHEN NOT starts_with(m.file_name, '._') THEN 'system' WHEN t.file_name IS NULL THEN 'twin_missing'
    WHEN lower(regexp_extract(t.file_name, '\\.([^.]+)$', 1)) = 'aae' THEN 'twin_is_sidecar' ELSE 'twin_here' END AS why
    FROM manifest m LEFT JOIN (SELECT DISTINCT folder, file_name FROM manifest) t ON t.folder = m.folder AND t.file_name = substr(m.file_name, 3)
    WHERE starts_with(m.file_name, '._') OR lower(m.file_name) IN ({both(P.JUNK_NAMES)})""")
def junk_reason(s, d):
    return rules.junk_reason(A.manifest(s, d))


@add("media_names", A.CTE + f"""SELECT file_no, lower(regexp_extract(file_name, '\\.([^.]+)$', 1)) IN ({both(P.PHOTO_EXT + P.VIDEO_EXT)}) AND NOT starts_with(file_name, '._') AS is_media,
    CASE WHEN file_type IN ({both(P.IMAGE_TYPES)}) THEN 'image' WHEN file_type IN ({both(P.VIDEO_TYPES)}) THEN 'video' END AS kind FROM manifest""")
def media_names(s, d):
    return A.manifest(s, d).select("file_no", parse.is_media_name(c("file_name")).alias("is_media"), parse.kind_of(c("file_type")).alias("kind"))


@add("scan_summary", A.CTE + f"""SELECT count(*) AS files, count(*) FILTER (taken IS NULL) AS undated, count(lat) AS gps_files, round(count(lat) / count(*), 4) AS gps_share,
    CAST(min(taken) AS VARCHAR) AS first_taken, CAST(max(taken) AS VARCHAR) AS last_taken,
    count(*) FILTER (starts_with(file_name, '._')) AS sidecars FROM typed""")
def scan_summary(s, d):
    return A.typed(s, d).agg(
        F.count("*").alias("files"), F.count_if(c("taken").isNull()).alias("undated"), F.count("lat").alias("gps_files"), F.round(F.count("lat") / F.count("*"), 4).alias("gps_share"),
        F.min("taken").cast("string").alias("first_taken"), F.max("taken").cast("string").alias("last_taken"), F.count_if(c("file_name").startswith("._")).alias("sidecars"))


@add("capture_date", A.CTE + """SELECT file_no, taken, CASE WHEN try_strptime(CASE WHEN date_time_original NOT IN ('-', '', '0000:00:00 00:00:00') THEN substr(date_time_original, 1, 19) END, '%Y:%m:%d %H:%M:%S') IS NOT NULL THEN 'DateTimeOriginal'
    WHEN taken IS NOT NULL THEN 'CreateDate' END AS source FROM typed""")
def capture_date(s, d):
    return A.typed(s, d).select("file_no", "taken", parse.date_source(DateTimeOriginal=c("date_time_original"), CreateDate=c("create_date")).alias("source"))


@add("offset_minutes", A.CTE + """SELECT file_no, CASE offset_original WHEN '+08:00' THEN 480 WHEN '+0900' THEN 540 WHEN '-03:30' THEN -210 END AS minutes FROM manifest WHERE offset_original <> '-'""")
def offset_minutes(s, d):
    return A.manifest(s, d).select("file_no", parse.offset_minutes(c("offset_original")).alias("minutes")).where("minutes is not null")


@add("gps_parse", A.CTE + "SELECT file_no, lat, lon FROM typed WHERE lat IS NOT NULL")
def gps_parse(s, d):
    return A.typed(s, d).where("lat is not null").select("file_no", "lat", "lon")


@add("taken_triple", A.CTE + "SELECT CAST(day AS VARCHAR) AS day, month, night, count(*) AS files FROM typed WHERE taken IS NOT NULL GROUP BY ALL")
def taken_triple(s, d):
    return A.typed(s, d).where("taken is not null").groupBy(c("day").cast("string").alias("day"), "month", "night").agg(F.count("*").alias("files"))


@add("size_shapes", A.CTE + """SELECT least(w, h) || 'x' || greatest(w, h) AS portrait, greatest(w, h) AS long_edge,
    CASE WHEN abs(greatest(w, h) / least(w, h) - 4 / 3) < 0.02 THEN '4:3' WHEN abs(greatest(w, h) / least(w, h) - 3 / 2) < 0.02 THEN '3:2' WHEN greatest(w, h) / least(w, h) >= 1.7 THEN 'tall' ELSE 'other' END AS shape,
    count(*) AS files FROM (SELECT try_cast(width AS INTEGER) AS w, try_cast(height AS INTEGER) AS h FROM manifest) WHERE w IS NOT NULL GROUP BY ALL""")
def size_shapes(s, d):
    w, h = c("width").try_cast("int"), c("height").try_cast("int")
    return A.manifest(s, d).where(w.isNotNull()).groupBy(
        parse.portrait(c("width"), c("height")).alias("portrait"), parse.long_edge(c("width"), c("height")).alias("long_edge"), parse.screen_shape(w, h).alias("shape")
    ).agg(F.count("*").alias("files"))


@add("year_hint", "SELECT page_id, nullif(regexp_extract(url, '(19[89][0-9]|20[0-4][0-9])', 1), '') AS hint FROM (SELECT page_id, 'x-' || (1970 + page_id % 90) || '-y' AS url FROM pages)")
def year_hint(s, d):
    return A.table(s, d, "pages").select("page_id", parse.year_hint(F.concat(F.lit("x-"), (1970 + c("page_id") % 90).cast("string"), F.lit("-y"))).alias("hint"))


@add("file_year", A.CTE + "SELECT substr(modified, 1, 4) AS year, count(*) AS files FROM manifest GROUP BY 1")
def file_year(s, d):
    return A.manifest(s, d).groupBy(parse.file_year(c("modified")).alias("year")).agg(F.count("*").alias("files"))


@add("bounds_to_instants", """SELECT o_orderkey, b AS bound, CAST(CAST(CASE length(b) WHEN 4 THEN b || '-01-01' WHEN 7 THEN b || '-01' ELSE b END AS TIMESTAMP) AS VARCHAR) AS first_moment,
    CAST(CAST(CASE length(b) WHEN 4 THEN b || '-01-01' WHEN 7 THEN b || '-01' ELSE b END AS TIMESTAMP) + CASE length(b) WHEN 4 THEN INTERVAL 1 YEAR WHEN 7 THEN INTERVAL 1 MONTH ELSE INTERVAL 1 DAY END - INTERVAL 1 SECOND AS VARCHAR) AS last_moment
    FROM (SELECT o_orderkey, substr(CAST(o_orderdate AS VARCHAR), 1, CASE o_orderkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 7 ELSE 10 END) AS b FROM orders)""")
def bounds_to_instants(s, d):
    b = F.expr("substring(cast(o_orderdate as string), 1, CASE o_orderkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 7 ELSE 10 END)")
    rows = A.table(s, d, "orders").select("o_orderkey", b.alias("bound"))
    return rows.select("o_orderkey", "bound", parse.bound_start(c("bound")).cast("string").alias("first_moment"), parse.bound_end(c("bound")).cast("string").alias("last_moment"))


@add("name_period", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(a, '%Y%m%d') ELSE strftime(a, '%Y%m%d') || '-' || strftime(b, '%m%d') END AS period
    FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 + 1 AS INTEGER) AS b FROM orders)""")
def name_period(s, d):
    a = F.to_date("o_orderdate")
    end = F.when(c("o_orderkey") % 3 != 0, F.date_add(a, (c("o_orderkey") % 9 + 1).cast("int")))
    return A.table(s, d, "orders").select("o_orderkey", parse.period(a, end).alias("period"))


HEADS = "CASE p_partkey % 6 WHEN 0 THEN '202600' WHEN 1 THEN '202606' WHEN 2 THEN '20260600' WHEN 3 THEN '20260612' WHEN 4 THEN '_check' ELSE '202600_check' END"


@add("name_kinds", f"""SELECT p_partkey, head, CASE WHEN regexp_full_match(head, '[0-9]{{4}}00') THEN 'YEARLY' WHEN regexp_full_match(head, '[0-9]{{6}}00|[0-9]{{6}}') THEN 'MONTHLY' ELSE 'FOLDER' END AS kind,
    CASE WHEN head = '_check' THEN 'UNDATED' WHEN regexp_full_match(head, '[0-9]{{4}}00_check') THEN 'YEARLY' END AS bucket FROM (SELECT p_partkey, {HEADS} AS head FROM part)""")
def name_kinds(s, d):
    return A.table(s, d, "part").select("p_partkey", F.expr(HEADS).alias("head")).select("p_partkey", "head", parse.head_kind(c("head")).alias("kind"), parse.bucket_form(c("head"), "check").alias("bucket"))


@add("path_slots", """SELECT page_id, replace(replace(url, 'https://', 'c:\\'), '\\', '/') AS path, length(url) - length(replace(url, '/', '')) AS depth FROM pages""")
def path_slots(s, d):
    return A.table(s, d, "pages").select("page_id", parse.path_key(F.replace("url", F.lit("https://"), F.lit("c:\\"))).alias("path"), (F.length("url") - F.length(F.translate("url", "/", ""))).cast("long").alias("depth"))


@add("time_window", "SELECT event_id, m AS minute, (m >= 1320 OR m <= 360) AS at_night, m BETWEEN 540 AND 1080 AS at_work FROM (SELECT event_id, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS m FROM events)")
def time_window(s, d):
    m = (F.hour("ts") * 60 + F.minute("ts")).alias("minute")
    return A.table(s, d, "events").select("event_id", m).select("event_id", "minute", parse.in_window(c("minute"), 1320, 360).alias("at_night"), parse.in_window(c("minute"), 540, 1080).alias("at_work"))


@add("batch_spec", "SELECT part.p_partkey, CAST(b AS INTEGER) AS batch FROM part, unnest(list_concat(generate_series(p_size, p_size + 3), [p_size + 9])) u(b)")
def batch_spec(s, d):
    spec = F.concat(c("p_size").cast("string"), F.lit("-"), (c("p_size") + 3).cast("string"), F.lit(","), (c("p_size") + 9).cast("string"))
    return A.table(s, d, "part").select("p_partkey", F.explode(parse.expand_spec(spec)).alias("batch"))


@add("span_days", """SELECT p_partkey, CAST(make_date(2024, m1, 5) AS VARCHAR) AS first, CAST(make_date(CASE WHEN m2 * 100 + 2 < m1 * 100 + 5 THEN 2025 ELSE 2024 END, m2, 2) AS VARCHAR) AS last
    FROM (SELECT p_partkey, CAST(p_partkey % 12 + 1 AS INTEGER) AS m1, CAST(p_size % 12 + 1 AS INTEGER) AS m2 FROM part)""")
def span_days(s, d):
    got = parse.span_days(F.lit(2024), (c("p_partkey") % 12 + 1).cast("int"), F.lit(5), (c("p_size") % 12 + 1).cast("int"), F.lit(2))
    return A.table(s, d, "part").select("p_partkey", got["first"].cast("string").alias("first"), got["last"].cast("string").alias("last"))


@add("provenance_split", """SELECT doc_id, p AS raw, regexp_replace(regexp_replace(p, ':$', ''), '^draft:', '') AS clean, p IN ('viewed-image', 'viewed-image:') AS confirmed
    FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'viewed-image' WHEN 1 THEN 'viewed-image:' WHEN 2 THEN 'draft:viewed-image' WHEN 3 THEN 'draft:draft:guess:' ELSE ' viewed-image' END AS p FROM documents)""")
def provenance_split(s, d):
    p = F.expr("CASE doc_id % 5 WHEN 0 THEN 'viewed-image' WHEN 1 THEN 'viewed-image:' WHEN 2 THEN 'draft:viewed-image' WHEN 3 THEN 'draft:draft:guess:' ELSE ' viewed-image' END")
    return A.table(s, d, "documents").select("doc_id", p.alias("raw")).select("doc_id", "raw", parse.provenance(c("raw")).alias("clean"), parse.is_view_confirmed(c("raw")).alias("confirmed"))


@add("candidate_ids", """SELECT source, 'rc-' || substr(sha256(string_agg(sha, '|' ORDER BY sha)), 1, 12) AS candidate_id FROM (SELECT source, sha256(CAST(doc_id AS VARCHAR)) AS sha FROM documents) GROUP BY source""")
def candidate_ids(s, d):
    return parse.candidate_ids(A.table(s, d, "documents").select("source", F.sha2(c("doc_id").cast("string"), 256).alias("sha")), "source")


@add("props_lookup", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.missing') IS NOT NULL AS has_missing FROM events")
def props_lookup(s, d):
    return A.table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.get_json_object("props", "$.missing").isNotNull().alias("has_missing"))


@add("human_sizes", "SELECT doc_id, CASE WHEN n >= 1048576 THEN CAST(round(n / 1048576, 1) AS VARCHAR) || ' MB' WHEN n >= 1024 THEN CAST(round(n / 1024, 1) AS VARCHAR) || ' KB' ELSE n || ' B' END AS size FROM (SELECT doc_id, n_chars * 37 AS n FROM documents)")
def human_sizes(s, d):
    return A.table(s, d, "documents").select("doc_id", parse.human_size(c("n_chars") * 37).alias("size"))


HAV = "2 * 6371e0 * asin(sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))"
KM = HAV.format(a="lat", b="lon", c="hlat", d="hlon")
VALID = """(CASE WHEN regexp_full_match(since, '[0-9]{4}(-[0-9]{2}(-[0-9]{2})?)?') THEN substr(coalesce(CAST(day AS VARCHAR), ''), 1, length(since)) >= since ELSE true END
    AND CASE WHEN regexp_full_match(until, '[0-9]{4}(-[0-9]{2}(-[0-9]{2})?)?') THEN substr(coalesce(CAST(day AS VARCHAR), ''), 1, length(until)) <= until ELSE true END)"""


def with_homes(s, rows):
    """Rows beside each home (a bounded dimension) that is valid on the row's day, with km."""
    homes = F.broadcast(A.homes(s))
    pairs = rows.join(homes, parse.within_bounds(c("day").cast("string"), c("since"), c("until")))
    return pairs.withColumn("km", geo.haversine_km(c("lat"), c("lon"), c("hlat"), c("hlon")))


def homes_of(day):
    """The homes as literals, each with its condition on the day; a row without a day is before every bound."""
    return [(lat, lon, parse.within_bounds(F.coalesce(day.cast("string"), F.lit("")), F.lit(since), F.lit(until)), {"id": name, "label": label}) for name, lat, lon, since, until, label in A.HOMES]


def placed(s, d):
    return A.typed(s, d).where("lat is not null and day is not null")


@add("nearest_home", A.CTE + f"""SELECT file_no, arg_min(id, km) AS home, arg_min(coalesce(label, 'none'), km) AS label, round(min(km), 6) AS km FROM (
    SELECT file_no, id, label, {KM} AS km FROM typed, {A.HOMES_SQL} WHERE lat IS NOT NULL AND day IS NOT NULL AND {VALID}) GROUP BY file_no""")
def nearest_home(s, d):
    near = geo.nearest_of(c("lat"), c("lon"), homes_of(c("day")))
    # inlined, so that the nearest is found once a row and not once a field
    rows = placed(s, d).select("file_no", F.inline(F.array(near))).where("km is not null")
    return rows.select("file_no", c("id").alias("home"), F.coalesce("label", F.lit("none")).alias("label"), F.round("km", 6).alias("km"))


@add("within_home_range", A.CTE + f"""SELECT DISTINCT file_no FROM typed, {A.HOMES_SQL} WHERE lat IS NOT NULL AND day IS NOT NULL AND {VALID} AND {KM} <= 3.0""")
def within_home_range(s, d):
    homes = F.broadcast(A.homes(s))
    near = parse.within_bounds(c("day").cast("string"), c("since"), c("until")) & (geo.haversine_km(c("lat"), c("lon"), c("hlat"), c("hlon")) <= P.AWAY_KM)
    return placed(s, d).join(homes, near, "left_semi").select("file_no")


@add("away_points", A.CTE + f"""SELECT file_no FROM typed WHERE lat IS NOT NULL AND day IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {A.HOMES_SQL} h WHERE {KM} <= 3.0)""")
def away_points(s, d):
    near = geo.haversine_km(c("lat"), c("lon"), c("hlat"), c("hlon")) <= P.AWAY_KM
    return placed(s, d).join(F.broadcast(A.homes(s)), near, "left_anti").select("file_no")


@add("private_points", A.CTE + f"""SELECT folder, count(*) AS files FROM (SELECT DISTINCT folder, file_no FROM typed, {A.HOMES_SQL} WHERE lat IS NOT NULL AND day IS NOT NULL AND {VALID} AND {KM} < 3.0) GROUP BY folder""")
def private_points(s, d):
    near = parse.within_bounds(c("day").cast("string"), c("since"), c("until")) & (geo.haversine_km(c("lat"), c("lon"), c("hlat"), c("hlon")) < P.PRIVACY_KM)
    return placed(s, d).join(F.broadcast(A.homes(s)), near, "left_semi").groupBy("folder").agg(F.count("*").alias("files"))


NKM = HAV.format(a="lat", b="lon", c="nlat", d="nlon")


@add("named_place", A.CTE + f"""SELECT file_no, arg_min(label, km) AS label FROM (SELECT file_no, label, {NKM} AS km FROM typed, {A.NAMED_SQL} WHERE lat IS NOT NULL) WHERE km <= {P.PLACE_KM} GROUP BY file_no""")
def named_place(s, d):
    near = geo.nearest_of(c("lat"), c("lon"), [(lat, lon, F.lit(True), {"label": label}) for _, lat, lon, label in A.NAMED])
    return A.typed(s, d).where("lat is not null").select("file_no", near.alias("near")).where(c("near.km") <= P.PLACE_KM).select("file_no", "near.label")


@add("grid_cells", A.CTE + "SELECT CAST(floor(round(lat / 0.01, 6)) AS BIGINT) AS cy, CAST(floor(round(lon / 0.01, 6)) AS BIGINT) AS cx, CAST(round_even(lat / 0.2, 0) AS BIGINT) AS ay, count(*) AS files FROM typed WHERE lat IS NOT NULL GROUP BY ALL")
def grid_cells(s, d):
    return A.typed(s, d).where("lat is not null").groupBy(geo.cell_floor(c("lat"), 0.01).alias("cy"), geo.cell_floor(c("lon"), 0.01).alias("cx"), geo.cell_even(c("lat"), 0.2).alias("ay")).agg(F.count("*").alias("files"))


@add("points_bbox", A.CTE + "SELECT folder, min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east, round(avg(lat), 6) AS clat, round(avg(lon), 6) AS clon FROM typed WHERE lat IS NOT NULL GROUP BY folder")
def points_bbox(s, d):
    return A.typed(s, d).where("lat is not null").groupBy("folder").agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"), F.round(F.avg("lat"), 6).alias("clat"), F.round(F.avg("lon"), 6).alias("clon"))


#: shape, y1, x1, y2, x2 of closed rings; the second has a hole.
EDGES = [("a", 25.0, 121.0, 25.3, 121.0), ("a", 25.3, 121.0, 25.3, 121.3), ("a", 25.3, 121.3, 25.0, 121.0),
         ("b", 25.1, 121.2, 25.5, 121.2), ("b", 25.5, 121.2, 25.5, 121.5), ("b", 25.5, 121.5, 25.1, 121.5), ("b", 25.1, 121.5, 25.1, 121.2),
         ("b", 25.2, 121.3, 25.4, 121.3), ("b", 25.4, 121.3, 25.4, 121.4), ("b", 25.4, 121.4, 25.2, 121.4), ("b", 25.2, 121.4, 25.2, 121.3)]


@add("point_in_polygon", A.CTE + f"""SELECT file_no, shape FROM typed, {A.values(EDGES, "shape, y1, x1, y2, x2")}
    WHERE lat IS NOT NULL AND y1 <> y2 GROUP BY file_no, shape HAVING count(*) FILTER ((y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1) % 2 = 1""")
def point_in_polygon(s, d):
    edges = s.createDataFrame(EDGES, "shape string, y1 double, x1 double, y2 double, x2 double")
    found = geo.crossings(A.typed(s, d).where("lat is not null").select("file_no", "lat", "lon"), edges, ["file_no"])
    return found.where("inside").select("file_no", "shape")


@add("feature_distance", A.CTE + f"""SELECT file_no, round({HAV.format(a="lat", b="lon", c="greatest(25.1, least(lat, 25.2))", d="greatest(121.1, least(lon, 121.3))")}, 6) AS km FROM typed WHERE lat IS NOT NULL""")
def feature_distance(s, d):
    km = geo.clamp_km(c("lat"), c("lon"), *map(F.lit, (25.1, 121.1, 25.2, 121.3)))
    return A.typed(s, d).where("lat is not null").select("file_no", F.round(km, 6).alias("km"))


IMG, VID = both(P.IMAGE_TYPES), both(P.VIDEO_TYPES)
TIER = f"""CASE WHEN starts_with(file_name, '._') OR split_part(file_size, ' ', 1) = '0' THEN 'T0/junk'
    WHEN NOT (make IN ('-', '') AND model IN ('-', '')) THEN NULL
    WHEN regexp_matches(file_name, '(?i)^screen[ _]?shot') OR width || 'x' || height IN ('1170x2532', '2532x1170', '1080x2400', '2400x1080') THEN 'T1/' || CASE WHEN file_type IN ({VID}) THEN 'screen_record' ELSE 'screenshot' END
    WHEN regexp_matches(file_name, '(?i)^IMG-[0-9]{{8}}-WA') THEN 'T2/shared'
    WHEN file_type NOT IN ({VID}) AND greatest(try_cast(width AS INTEGER), try_cast(height AS INTEGER)) IN (1280, 1600, 2048) THEN 'T3/shared'
    WHEN file_type IN ({VID}) AND taken IS NULL THEN 'T4/no_exif'
    WHEN taken IS NULL AND lat IS NULL THEN 'T5/no_exif' END"""
PRE = f"coalesce(split_part({TIER}, '/', 2), CASE WHEN make NOT IN ('-', '') AND lower(make) NOT IN ('apple', 'samsung') THEN 'shared' ELSE 'own' END)"


@add("tier_cascade", A.CTE + f"SELECT file_no, split_part(t, '/', 1) AS tier, split_part(t, '/', 2) AS class FROM (SELECT file_no, {TIER} AS t FROM typed) WHERE t IS NOT NULL")
def tier_cascade(s, d):
    return A.manifest(s, d).select("file_no", rules.tier().alias("t")).where("t is not null").select("file_no", "t.tier", "t.class")


@add("preclassify_counts", A.CTE + f"SELECT folder, {PRE} AS class, count(*) AS files FROM typed GROUP BY ALL")
def preclassify_counts(s, d):
    return A.manifest(s, d).groupBy("folder", rules.preclass().alias("class")).agg(F.count("*").alias("files"))


@add("first_route", A.CTE + f"""SELECT CASE WHEN split_part(file_size, ' ', 1) = '0' THEN 'skip_junk' WHEN taken IS NULL THEN 'to_be_checked' WHEN {TIER} = 'T0/junk' THEN 'skip_junk'
    WHEN file_type NOT IN ({IMG}, {VID}) THEN 'others' WHEN {TIER} LIKE 'T1%' AND regexp_matches(file_name, '(?i)^screen[ _]?shot') THEN 'screenshot' ELSE 'undecided' END AS route, count(*) AS files FROM typed GROUP BY ALL""")
def first_route(s, d):
    return A.manifest(s, d).groupBy(rules.first_route().alias("route")).agg(F.count("*").alias("files"))


@add("no_date_bucket", A.CTE + f"SELECT file_no, CASE WHEN file_type IN ({VID}) THEN substr(modified, 1, 4) || '00_check' ELSE '_check/import' END AS bucket FROM typed WHERE taken IS NULL")
def no_date_bucket(s, d):
    return A.typed(s, d).where("taken is null").select("file_no", rules.undated_bucket(True, "202401").alias("bucket"))


LEGS = [(1, "2024-01-03", "2024-01-08", "a"), (2, "2024-01-07", "2024-01-12", "b"), (3, "2024-01-20", "2024-01-21", "c")]
DAYS = [("2024-01-07", "elsewhere"), ("2024-01-15", "party")]


@add("route_rows", A.CTE + f"""SELECT file_no, CASE WHEN dupe THEN 'skip_dupe' WHEN class = 'junk' THEN 'skip_junk' ELSE 'copy' END AS action,
    CASE WHEN dupe THEN 'tree/' || file_no WHEN class = 'junk' THEN '' WHEN doc THEN 'out/' || strftime(day, '%Y%m') || '00_check'
         WHEN class IN ('screenshot', 'screen_record') THEN 'out/' || strftime(day, '%Y%m') || '00_screenshots'
         WHEN path IS NOT NULL THEN path ELSE 'out/trip' || coalesce('/' || leg, '') END AS destination,
    CASE WHEN dupe THEN '' WHEN class = 'junk' THEN 'junk' WHEN doc THEN 'paperwork' WHEN class IN ('screenshot', 'screen_record') THEN 'screenshot'
         WHEN path IS NOT NULL THEN '' WHEN class = 'shared' THEN 'shared' ELSE '' END AS tag
    FROM (SELECT t.*, {PRE} AS class, file_no % 31 = 0 AS dupe, file_no % 37 = 0 AS doc, o.path,
            (SELECT arg_min(name, ord) FROM {A.values(LEGS, "ord, a, b, name")} l WHERE t.day BETWEEN CAST(a AS DATE) AND CAST(b AS DATE)) AS leg
          FROM typed t LEFT JOIN {A.values(DAYS, "oday, path")} o ON CAST(oday AS DATE) = day WHERE day IS NOT NULL)""")
def route_rows(s, d):
    rows = A.typed(s, d).where("day is not null")
    dupes = F.when(c("file_no") % 31 == 0, F.concat(F.lit("tree/"), c("file_no").cast("string")))
    documents = c("file_no") % 37 == 0
    overrides = s.createDataFrame(DAYS, "day string, path string").withColumn("day", F.to_date("day"))
    legs = s.createDataFrame(LEGS, "ord int, first string, last string, name string").withColumns({"first": F.to_date("first"), "last": F.to_date("last")})
    return rules.route(rows, dupes, documents, overrides, legs, "out")


@add("document_only_batches", "SELECT source, lang FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source, lang HAVING bool_and(coalesce(quality, 1) = 1)")
def document_only_batches(s, d):
    joined = A.table(s, d, "documents").join(A.table(s, d, "labels"), "doc_id", "left")
    return joined.groupBy("source", "lang").agg(F.bool_and(F.coalesce(c("quality"), F.lit(1)) == 1).alias("all_good")).where("all_good").select("source", "lang")


@add("make_gap", A.CTE + "SELECT make, count(*) AS files FROM manifest WHERE make NOT IN ('-', '') AND lower(make) NOT IN ('apple', 'samsung') GROUP BY make")
def make_gap(s, d):
    own = s.createDataFrame([(m,) for m in rules.OWN_MAKES], "own string")
    seen = A.manifest(s, d).where(parse.present(c("make")).isNotNull())
    return seen.join(F.broadcast(own), F.lower("make") == c("own"), "left_anti").groupBy("make").agg(F.count("*").alias("files"))


@add("recognition_window", """SELECT event_type, count(*) AS files FROM events JOIN (SELECT * FROM (VALUES ('click', '2024-01-05', '2024-01-06'), ('view', '2024-01-20', '2024-01-25')) v(kind, a, b))
    ON event_type = kind AND CAST(ts AS DATE) BETWEEN CAST(a AS DATE) - 3 AND CAST(b AS DATE) + 3 GROUP BY event_type""")
def recognition_window(s, d):
    active = s.createDataFrame([("click", "2024-01-05", "2024-01-06"), ("view", "2024-01-20", "2024-01-25")], "event_type string, a string, b string")
    inside = F.to_date("ts").between(F.date_sub(F.to_date("a"), 3), F.date_add(F.to_date("b"), 3))
    return A.table(s, d, "events").join(F.broadcast(active), "event_type").where(inside).groupBy("event_type").agg(F.count("*").alias("files"))
