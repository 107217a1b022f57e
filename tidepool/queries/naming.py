"""Queries of place names, file names, boxes and small values."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepool import params as P
from tidepool.functions import geo, parse, places
from tidepool.plans import adapters as A

from .basics import HAV
from .edges import HEADS, LITERAL_HEADS, SNIFF
from .looks import BOX

c = F.col
QUERIES, SQL = {}, {}


def add(name, sql=None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def quoted(words):
    return ", ".join(f"'{w}'" for w in words)


EXT = "upper(regexp_extract(file_name, '.\\.([^.]*)$', 1))"
ALLOWED = " ".join(f"WHEN '{k}' THEN {EXT} IN ({quoted(v[1])})" for k, v in P.EXTENSIONS.items())
CANON = " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in P.EXTENSIONS.items())


@add("copy_names", A.CTE + f""", r AS (SELECT m.*, CASE WHEN file_type IN ('HEIC', 'HEIF') AND {SNIFF} IN ('MOV', 'MP4') THEN {SNIFF} ELSE file_type END AS real FROM (SELECT *, [{LITERAL_HEADS}][file_no % {len(HEADS)} + 1] AS h FROM manifest) m)
    SELECT file_no, real AS real_type, CASE WHEN CASE real {ALLOWED} ELSE true END THEN file_name ELSE regexp_replace(file_name, '\\.[^.]*$', '') || '.' || CASE real {CANON} END END AS name FROM r""")
def copy_names(s, d):
    head = F.unhex(F.element_at(F.array(*map(F.lit, HEADS)), (c("file_no") % len(HEADS) + 1).cast("int")))
    rows = A.manifest(s, d).select("file_no", "file_name", parse.real_type(c("file_type"), parse.sniff(head)).alias("real_type"))
    return rows.select("file_no", "real_type", parse.copy_name(c("file_name"), c("real_type")).alias("name"))


@add("magic_correction", A.CTE + f""", r AS (SELECT file_no, file_type, {SNIFF} AS sniffed FROM (SELECT *, [{LITERAL_HEADS}][file_no % {len(HEADS)} + 1] AS h FROM manifest)),
    k AS (SELECT *, CASE WHEN file_type IN ({quoted(P.IMAGE_TYPES)}) THEN 'image' WHEN file_type IN ({quoted(P.VIDEO_TYPES)}) THEN 'video' END AS a, CASE WHEN sniffed IN ({quoted(P.IMAGE_TYPES)}) THEN 'image' WHEN sniffed IN ({quoted(P.VIDEO_TYPES)}) THEN 'video' END AS b FROM r)
    SELECT file_no, file_type, sniffed FROM k WHERE b IS NOT NULL AND a IS DISTINCT FROM b""")
def magic_correction(s, d):
    head = F.unhex(F.element_at(F.array(*map(F.lit, HEADS)), (c("file_no") % len(HEADS) + 1).cast("int")))
    rows = A.manifest(s, d).select("file_no", "file_type", parse.sniff(head).alias("sniffed"))
    a, b = parse.kind_of(c("file_type")), parse.kind_of(c("sniffed"))
    return rows.where(b.isNotNull() & ~a.eqNullSafe(b))


@add("dump_months", """SELECT o_orderkey, CASE WHEN length(g) >= 6 AND CAST(substr(g, 5, 2) AS INTEGER) BETWEEN 1 AND 12 THEN substr(g, 1, 6) WHEN y1 = y2 THEN y1 ELSE y1 || '-' || y2 END AS month
    FROM (SELECT o_orderkey, regexp_replace(o_orderpriority || CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, ' %Y.%m') WHEN 1 THEN strftime(o_orderdate, ' %Y') ELSE '' END, '[^0-9]', '', 'g') AS g,
      strftime(o_orderdate, '%Y') AS y1, strftime(o_orderdate + INTERVAL 100 DAY, '%Y') AS y2 FROM orders)""")
def dump_months(s, d):
    tail = F.when(c("o_orderkey") % 3 == 0, F.date_format("o_orderdate", " yyyy.MM")).when(c("o_orderkey") % 3 == 1, F.date_format("o_orderdate", " yyyy")).otherwise("")
    first = F.to_date("o_orderdate")
    return A.table(s, d, "orders").select("o_orderkey", parse.dump_month(F.concat("o_orderpriority", tail), first, F.date_add(first, 100)).alias("month"))


#: Endings that give names of the given tables every form that the rules tell apart.
ENDINGS = ("山", "橋", "步道", "登山步道", "12 號", "３段", "巷", "陡上段", "路", "陵線", "步道往南湖", "(北段)", ";x", "-北", "")
STARTS = ("", "遠眺", "往", "")
PLACE = f"[{quoted(STARTS)}][p_partkey % {len(STARTS)} + 1] || p_name || [{quoted(ENDINGS)}][p_partkey % {len(ENDINGS)} + 1]"


def named(s, d):
    of = lambda words: F.element_at(F.array(*map(F.lit, words)), (c("p_partkey") % len(words) + 1).cast("int"))
    return A.table(s, d, "part").select("p_partkey", F.concat(of(STARTS), "p_name", of(ENDINGS)).alias("name"))


def no_place(x):
    tails = " OR ".join(f"{x} LIKE '%{t}'" for t in P.STRUCTURE_SUFFIXES + P.ADDRESS_SUFFIXES)
    words = " OR ".join(f"contains({x}, '{w}')" for w in P.ROUTE_DESCRIPTIONS)
    return f"({words} OR {tails} OR regexp_matches({x}, '[0-9０-９]+\\s*[巷弄號段]'))"


@add("place_name_tests", f"""SELECT p_partkey, regexp_matches(name, '[0-9０-９]+\\s*[巷弄號段]') OR {" OR ".join(f"name LIKE '%{t}'" for t in P.ADDRESS_SUFFIXES)} AS is_address, {no_place("name")} AS no_place,
    CASE {" ".join(f"WHEN k LIKE '%{t}' AND length(k) > 2 THEN substr(k, 1, length(k) - 1)" for t in P.KEY_TAILS)} ELSE k END AS same_key FROM (SELECT p_partkey, {PLACE} AS name, replace({PLACE}, '陵', '稜') AS k FROM part)""")
def place_name_tests(s, d):
    n = c("name")
    return named(s, d).select("p_partkey", places.is_address(n).alias("is_address"), places.names_no_place(n).alias("no_place"), places.same_place_key(n).alias("same_key"))


def sql_cut(x, options, start):
    cases = " ".join(f"WHEN {'starts_with' if start else 'ends_with'}({x}, '{o}') AND length({x}) > {len(o)} THEN " + (f"trim(substr({x}, {len(o) + 1}))" if start else f"substr({x}, 1, length({x}) - {len(o)})") for o in options)
    return f"CASE {cases} ELSE {x} END"


@add("trail_places", f"""WITH a AS (SELECT p_partkey, trim(split_part(trim(regexp_split_to_array(trim(regexp_replace({PLACE}, '[（(].*?[）)]', '', 'g')), '[;；]')[1]), '-', 1)) AS n FROM part),
    b AS (SELECT p_partkey, {sql_cut("n", P.VIEW_PREFIXES + P.LEG_JOINERS, True)} AS n FROM a),
    j AS (SELECT p_partkey, CASE {" ".join(f"WHEN contains(substr(n, 2), '{w}') THEN trim(split_part(n, '{w}', 1))" for w in P.LEG_JOINERS)} ELSE n END AS n FROM b),
    t AS (SELECT p_partkey, {sql_cut("n", P.TRAIL_SUFFIXES, False)} AS n FROM j) SELECT p_partkey, n AS place FROM t WHERE length(n) >= 2 AND NOT {no_place("n")}""")
def trail_places(s, d):
    return named(s, d).select("p_partkey", places.trail_place(c("name")).alias("place")).where("place is not null")


#: A few signs of simplified script, enough for the tests of variants here; a caller passes its own class.
SIMPLIFIED = "[旧国东门马华湾区岛汉]"


@add("name_variants", f"""SELECT p_partkey, CASE WHEN contains(n, ';') THEN trim(split_part(n, ';', 1)) ELSE n END AS first_variant,
    CASE WHEN contains(n, ';') THEN coalesce(list_filter(v, lambda x: NOT regexp_matches(x, '{SIMPLIFIED}'))[1], v[1]) ELSE n END AS traditional
    FROM (SELECT p_partkey, n, list_filter(list_transform(string_split(n, ';'), lambda x: trim(x)), lambda x: x <> '') AS v FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN '旧' || p_name || '; ' || p_name WHEN 2 THEN '国;;湾' ELSE p_name || ';x' END AS n FROM part))""")
def name_variants(s, d):
    n = F.expr("CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN '旧' || p_name || '; ' || p_name WHEN 2 THEN '国;;湾' ELSE p_name || ';x' END")
    return A.table(s, d, "part").select("p_partkey", places.first_variant(n).alias("first_variant"), places.first_variant(n, SIMPLIFIED).alias("traditional"))


TAG_KEYS, TAG_VALUES = ("tourism", "leisure", "natural", "historic", "amenity", "waterway", "highway"), ("museum", "park", "peak", "castle", "cafe", "hotel", "waterfall", "pedestrian", "bank")
TAG = f"[{quoted(TAG_KEYS)}][p_partkey % {len(TAG_KEYS)} + 1]", f"[{quoted(TAG_VALUES)}][p_size % {len(TAG_VALUES)} + 1]"


def in_tags(table):
    return " OR ".join(f"(k = '{k}'" + (")" if v is None else f" AND v IN ({quoted(v)}))") for k, v in table.items())


@add("landmark_ranks", f"SELECT p_partkey, CASE WHEN {in_tags(P.SIGHT_TAGS)} THEN 0 WHEN {in_tags(P.STAY_TAGS)} THEN 1 WHEN k = 'highway' AND v = 'pedestrian' AND p_partkey % 2 = 0 THEN 0 ELSE -1 END AS rank FROM (SELECT p_partkey, {TAG[0]} AS k, {TAG[1]} AS v FROM part)")
def landmark_ranks(s, d):
    of = lambda words, x: F.element_at(F.array(*map(F.lit, words)), (c(x) % len(words) + 1).cast("int"))
    more = F.when(c("p_partkey") % 2 == 0, F.create_map(F.lit("wikidata"), F.lit("Q1"))).otherwise(F.create_map(F.lit("name"), c("p_name")))
    tags = F.map_concat(F.create_map(of(TAG_KEYS, "p_partkey"), of(TAG_VALUES, "p_size")), more)
    return A.table(s, d, "part").select("p_partkey", F.coalesce(places.landmark_rank(tags), F.lit(-1)).alias("rank"))


@add("country_answers", "SELECT p_partkey, p_type = 'ECONOMY' OR (p_size > 0 AND p_size <= 4) AS is_country FROM part")
def country_answers(s, d):
    return A.table(s, d, "part").select("p_partkey", ((c("p_type") == "ECONOMY") | ((c("p_size") > 0) & (c("p_size") <= P.COUNTRY_RANK))).alias("is_country"))


@add("feature_extents", A.CTE + f", b AS (SELECT folder, min(lat) AS s, min(lon) AS w, max(lat) AS n, max(lon) AS e FROM typed WHERE lat IS NOT NULL GROUP BY folder) SELECT folder, round({HAV.format(a='s', b='w', c='n', d='e')}, 6) AS km FROM b")
def feature_extents(s, d):
    box = A.typed(s, d).where("lat is not null").groupBy("folder").agg(F.min("lat").alias("s"), F.min("lon").alias("w"), F.max("lat").alias("n"), F.max("lon").alias("e"))
    return box.select("folder", F.round(places.extent_km(c("s"), c("w"), c("n"), c("e")), 6).alias("km"))


@add("padded_boxes", f"""WITH b AS ({BOX}) SELECT file, id, round(greatest(0, x0 - (x1 - x0) * 0.12), 6) AS px0, round(greatest(0, y0 - (y1 - y0) * 0.12), 6) AS py0, round(least(60, x1 + (x1 - x0) * 0.12), 6) AS px1, round(least(16, y1 + (y1 - y0) * 0.12), 6) AS py1,
    round_even(greatest(0, x1 - x0) * greatest(0, y1 - y0) / (60.0 * 16.0), 4) AS share FROM b""")
def padded_boxes(s, d):
    boxes = s.sql(BOX.replace("FROM lineitem", "FROM {t}"), t=A.table(s, d, "lineitem"))
    box, frame = [c(x) for x in ("x0", "y0", "x1", "y1")], (F.lit(60.0), F.lit(16.0))
    padded = [F.round(p, 6).alias(n) for p, n in zip(places.pad_box(*box, *frame), ("px0", "py0", "px1", "py1"))]
    return boxes.select("file", "id", *padded, places.box_share(*box, *frame).alias("share"))


#: Detections of files: boxes of many sizes in frames of many sizes, with scores, classes and states.
DETECTED = """SELECT l_orderkey AS file, l_linenumber AS id, CAST(l_partkey * 37 % 100 AS DOUBLE) / 100 AS score, CASE l_partkey % 5 WHEN 0 THEN 'cat' WHEN 1 THEN 'dog' WHEN 2 THEN 'cat' WHEN 3 THEN 'person' ELSE 'car' END AS class,
  CAST(2 + l_quantity AS DOUBLE) AS w, CAST(3 + l_partkey % 40 AS DOUBLE) AS h, CAST(120 + l_orderkey % 5 * 60 AS DOUBLE) AS width, CAST(160 + l_orderkey % 3 * 80 AS DOUBLE) AS height, CASE WHEN l_orderkey % 23 = 4 THEN 'error' ELSE 'ok' END AS status FROM lineitem"""
KEPT_CLASSES = ("cat", "dog")
KEPT = f"SELECT * FROM ({DETECTED}) d WHERE score >= {P.MIN_BOX_SCORE} AND class IN ('cat', 'dog')"


def detected(s, d):
    """Detections of kept classes that reach the least score."""
    rows = s.sql(DETECTED.replace("FROM lineitem", "FROM {t}"), t=A.table(s, d, "lineitem"))
    return rows.where((c("score") >= P.MIN_BOX_SCORE) & c("class").isin(*KEPT_CLASSES))


@add("exemplar_quality", f"""WITH k AS (SELECT *, count(*) OVER (PARTITION BY file) AS found, CASE WHEN file % 7 = 0 THEN 2 END AS stated, round_even(w * h / (width * height), 4) AS share FROM ({KEPT}))
    SELECT file, id, CASE WHEN status <> 'ok' THEN 'no_vector' WHEN greatest(coalesce(stated, 0), found) > 1 THEN 'several' WHEN share < 0.02 THEN 'too_small' ELSE 'ok' END AS verdict FROM k""")
def exemplar_quality(s, d):
    """Whether a detection may become an exemplar: it has a vector, is alone in its frame, and fills enough of it."""
    found = F.count("*").over(Window.partitionBy("file"))
    stated = F.when(c("file") % 7 == 0, 2)
    share = places.box_share(F.lit(0.0), F.lit(0.0), c("w"), c("h"), c("width"), c("height"))
    verdict = F.when(c("status") != "ok", "no_vector").when(F.greatest(F.coalesce(stated, F.lit(0)), found) > 1, "several").when(share < P.MIN_BOX_SHARE, "too_small").otherwise("ok")
    return detected(s, d).select("file", "id", verdict.alias("verdict"))


@add("detector_filter", f"SELECT file, id, class, CAST(row_number() OVER (PARTITION BY file ORDER BY score DESC, id) AS INTEGER) AS place FROM ({KEPT})")
def detector_filter(s, d):
    return detected(s, d).select("file", "id", "class", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("score"), "id")).alias("place"))


@add("durations", """SELECT o_orderkey, CASE WHEN m < 1 THEN 'under 1 min' WHEN m >= 60 THEN m // 60 || ' h ' || m % 60 || ' min' ELSE m || ' min' END AS text FROM (SELECT o_orderkey, CAST(round_even(o_totalprice / 60, 0) AS BIGINT) AS m FROM orders)""")
def durations(s, d):
    return A.table(s, d, "orders").select("o_orderkey", parse.duration_text(c("o_totalprice")).alias("text"))


@add("run_estimates", """WITH r AS (SELECT event_type, arg_max(value, (ts, event_id)) AS rate, count(*) AS photos FROM events GROUP BY event_type)
    SELECT event_type, photos, CASE WHEN m < 1 THEN 'under 1 min' WHEN m >= 60 THEN m // 60 || ' h ' || m % 60 || ' min' ELSE m || ' min' END AS about FROM (SELECT *, CAST(round_even(photos * rate / 60, 0) AS BIGINT) AS m FROM r)""")
def run_estimates(s, d):
    rates = A.table(s, d, "events").groupBy("event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("rate"), F.count("*").alias("photos"))
    return rates.select("event_type", "photos", parse.duration_text(c("photos") * c("rate")).alias("about"))


@add("bucket_dirs", """SELECT o_orderkey, CASE WHEN regexp_full_match(h, '[0-9]{6}00|[0-9]{4}00') THEN 'out/' || substr(h, 1, 4) || '/' || n ELSE 'out/' || n END AS path
    FROM (SELECT o_orderkey, n, split_part(n, '_', 1) AS h FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y%m00_check') WHEN 1 THEN strftime(o_orderdate, '%Y00_check') WHEN 2 THEN strftime(o_orderdate, '%Y%m%d_x') ELSE '_check' END AS n FROM orders))""")
def bucket_dirs(s, d):
    k, day = c("o_orderkey") % 4, c("o_orderdate")
    n = F.when(k == 0, F.concat(F.date_format(day, "yyyyMM"), F.lit("00_check"))).when(k == 1, F.concat(F.date_format(day, "yyyy"), F.lit("00_check"))).when(k == 2, F.concat(F.date_format(day, "yyyyMMdd"), F.lit("_x"))).otherwise("_check")
    return A.table(s, d, "orders").select("o_orderkey", parse.bucket_path(F.lit("out"), n).alias("path"))


@add("import_names", """SELECT page_id, NOT regexp_matches(n, '[\\\\/:*?"<>|\\x00-\\x1f]') AND n NOT IN ('', '.', '..') AS usable, '_check/' || n AS bucket FROM (SELECT page_id, split_part(url, '/', CAST(3 + page_id % 3 AS INTEGER)) || CASE WHEN page_id % 7 = 0 THEN '?' ELSE '' END AS n FROM pages)""")
def import_names(s, d):
    n = F.concat(F.coalesce(F.get(F.split("url", "/"), (2 + c("page_id") % 3).cast("int")), F.lit("")), F.when(c("page_id") % 7 == 0, "?").otherwise(""))
    usable = ~n.rlike(r'[\\/:*?"<>|\x00-\x1f]') & ~n.isin("", ".", "..")
    return A.table(s, d, "pages").select("page_id", usable.alias("usable"), F.concat(F.lit("_check/"), n).alias("bucket"))


@add("subject_order", """SELECT s_suppkey, CAST(row_number() OVER (ORDER BY CASE WHEN regexp_full_match(k, 'subj-[0-9]+') THEN 0 ELSE 1 END, CASE WHEN regexp_full_match(k, 'subj-[0-9]+') THEN CAST(substr(k, 6) AS BIGINT) ELSE 0 END, k) AS BIGINT) AS place
    FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN s_name ELSE 'subj-' || s_suppkey * 37 % 1000003 END AS k FROM supplier)""")
def subject_order(s, d):
    k = F.when(c("s_suppkey") % 5 == 0, c("s_name")).otherwise(F.concat(F.lit("subj-"), (c("s_suppkey") * 37 % 1_000_003).cast("string")))
    numbered = k.rlike("^subj-[0-9]+$")
    rows = A.table(s, d, "supplier").select("s_suppkey", F.when(numbered, 0).otherwise(1).alias("g"), F.when(numbered, F.substring(k, F.lit(6), F.length(k)).cast("long")).otherwise(F.lit(0)).alias("n"), k.alias("k"))
    # places by a global sort: ranges are counted, then rows are numbered within them
    ranged = rows.repartitionByRange("g", "n", "k").sortWithinPartitions("g", "n", "k").withColumn("at", F.monotonically_increasing_id())
    part, local = F.shiftright("at", 33), c("at").bitwiseAND(F.lit((1 << 33) - 1))
    from tidepool.plans.stored import stored

    placed = stored(ranged.select("s_suppkey", part.alias("part"), local.alias("local")), "ordered")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.alias("x").join(F.broadcast(sizes.alias("y")), c("y.part") < c("x.part"), "left").groupBy("x.part").agg(F.coalesce(F.sum("y.n"), F.lit(0)).alias("before"))
    return placed.join(F.broadcast(before), "part").select("s_suppkey", (c("before") + c("local") + 1).alias("place"))


@add("trip_countries", "SELECT o_orderkey, split_part(n, '_', 2) AS country FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') || CASE WHEN o_orderkey % 2 = 0 THEN '_' || o_orderstatus ELSE '' END || '_trip' AS n FROM orders) WHERE length(n) - length(replace(n, '_', '')) >= 2")
def trip_countries(s, d):
    n = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.when(c("o_orderkey") % 2 == 0, F.concat(F.lit("_"), "o_orderstatus")).otherwise(""), F.lit("_trip"))
    slots = F.split(n, "_")
    return A.table(s, d, "orders").where(F.size(slots) > 2).select("o_orderkey", F.get(slots, F.lit(1)).alias("country"))


@add("folder_pieces", """WITH f AS (SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') || '_lake_' || o_orderstatus || '+' || o_orderpriority AS folder FROM orders), known AS (SELECT unnest(['f', '5-LOW', 'Lake', 'o']) AS k)
    SELECT DISTINCT o_orderkey, piece FROM (SELECT o_orderkey, trim(unnest(string_split(replace(folder, '_', '+'), '+'))) AS piece FROM f) JOIN known ON lower(k) = lower(piece)""")
def folder_pieces(s, d):
    folder = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_lake_"), "o_orderstatus", F.lit("+"), "o_orderpriority")
    known = s.createDataFrame([("f",), ("5-low",), ("lake",), ("o",)], "k string")
    pieces = A.table(s, d, "orders").select("o_orderkey", F.explode(F.array_distinct(F.transform(F.split(folder, "[_+]"), lambda x: F.trim(x)))).alias("piece"))
    return pieces.join(F.broadcast(known), F.lower("piece") == c("k")).select("o_orderkey", "piece")



@add("subject_lists", """SELECT conv_id, turn, coalesce(len(list_filter(l, lambda x: x <> '')), 0) AS n FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN [role, ''] WHEN turn % 3 = 1 THEN [role] ELSE [] END AS l FROM conversations)""")
def subject_lists(s, d):
    several = F.when(c("turn") % 3 == 0, F.array("role", F.lit("")))
    one = F.when(c("turn") % 3 == 1, c("role"))
    held = F.filter(F.coalesce(several, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>")), lambda x: x != "")
    return A.table(s, d, "conversations").select("conv_id", "turn", F.size(held).cast("long").alias("n"))
