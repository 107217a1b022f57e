"""Queries of joins, aggregates, windows and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepool import params as P
from tidepool.functions import geo, names, parse
from tidepool.operators import joins, timeline
from tidepool.plans import adapters as A

from .basics import HAV, KM, VALID, placed, with_homes

c = F.col
QUERIES, SQL = {}, {}


def add(name, sql=None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


@add("range_join_batch", A.CTE + """SELECT b.n AS batch, count(*) AS files, count(lat) AS gps_files FROM typed JOIN (SELECT CAST(i AS INTEGER) AS n, DATE '2024-01-01' + CAST(i * 4 AS INTEGER) AS a, DATE '2024-01-01' + CAST(i * 4 + 5 AS INTEGER) AS z FROM generate_series(0, 6) t(i)) b
    ON day BETWEEN a AND z GROUP BY b.n""")
def range_join_batch(s, d):
    start = F.to_date(F.lit("2024-01-01"))
    batches = s.range(7).select(c("id").cast("int").alias("batch"), F.date_add(start, (c("id") * 4).cast("int")).alias("a"), F.date_add(start, (c("id") * 4 + 5).cast("int")).alias("z"))
    rows = A.typed(s, d)
    return rows.join(F.broadcast(batches), c("day").between(c("a"), c("z"))).groupBy("batch").agg(F.count("*").alias("files"), F.count("lat").alias("gps_files"))


@add("asof_nearest_offset", """WITH e AS (SELECT event_id AS id, user_id, ts, CASE WHEN event_id % 3 <> 0 THEN CAST(event_id % 7 * 60 AS BIGINT) END AS off FROM events)
    SELECT q.user_id, q.id, arg_min(x.off, (abs(epoch_us(q.ts) - epoch_us(x.ts)), x.ts, x.off)) AS d_offset FROM e q JOIN e x ON q.user_id = x.user_id AND abs(epoch_us(q.ts) - epoch_us(x.ts)) <= 86400000000
    WHERE q.off IS NULL AND x.off IS NOT NULL GROUP BY q.user_id, q.id""")
def asof_nearest_offset(s, d):
    rows = A.table(s, d, "events").select("user_id", c("event_id").alias("id"), c("ts").alias("at"), F.when(c("event_id") % 3 != 0, c("event_id") % 7 * 60).alias("offset"))
    return joins.nearest_offset(rows, ["user_id"], P.AS_OF_HOURS * 3600).select("user_id", "id", "d_offset")


NEIGHBOURS = """n AS (SELECT folder, file_name, file_no, day, last_value(day IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
    first_value(day IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM {src} WINDOW w AS (PARTITION BY folder ORDER BY file_name, file_no))"""


@add("neighbour_agree", A.CTE + ", " + NEIGHBOURS.format(src="typed") + """ SELECT file_no, CASE WHEN before IS NULL AND after IS NULL THEN 'no_anchor' WHEN before IS NULL OR after IS NULL THEN 'no_anchor_one_side'
    WHEN before = after THEN 'agree' ELSE 'disagree' END AS verdict FROM n WHERE day IS NULL""")
def neighbour_agree(s, d):
    rows = A.typed(s, d).select("folder", c("file_name").alias("name"), c("file_no").alias("id"), "day")
    return joins.neighbour_days(rows).where("day is null").select(c("id").alias("file_no"), "verdict")


@add("adjacency_control", A.CTE + ", " + NEIGHBOURS.format(src="(SELECT * FROM typed WHERE day IS NOT NULL)") + " SELECT count(*) AS dated, count(*) FILTER (before = after) AS offered, count(*) FILTER (before = after AND before = day) AS right FROM n")
def adjacency_control(s, d):
    return joins.control(A.typed(s, d).select("folder", c("file_name").alias("name"), c("file_no").alias("id"), "day"))


DOCS = "SELECT doc_id, source || '/' || doc_id AS path, 'n' || doc_id % 50 AS name, n_chars AS size, sha256(text) AS sha FROM documents"


def doc_files(s, d):
    return A.table(s, d, "documents").select(
        "doc_id", F.concat_ws("/", "source", c("doc_id").cast("string")).alias("path"), F.concat(F.lit("n"), (c("doc_id") % 50).cast("string")).alias("name"), c("n_chars").alias("size"), F.sha2("text", 256).alias("sha"), "source"
    )


@add("name_size_dedupe", f"""WITH f AS ({DOCS}), r AS (SELECT doc_id AS ord, name, size, sha FROM f WHERE doc_id % 3 = 0), q AS (SELECT doc_id AS id, name, size, sha FROM f WHERE doc_id % 3 <> 0)
    SELECT id, CASE WHEN min(ord) FILTER (q.sha = r.sha) IS NOT NULL THEN 'duplicate' WHEN count(ord) > 0 THEN 'collision' ELSE 'unique' END AS verdict FROM q LEFT JOIN r ON q.size = r.size AND q.name = r.name GROUP BY id""")
def name_size_dedupe(s, d):
    files = doc_files(s, d).select("doc_id", "name", "size", "sha")
    found = joins.name_size_duplicates(files.where("doc_id % 3 <> 0").withColumnRenamed("doc_id", "id"), files.where("doc_id % 3 = 0").withColumnRenamed("doc_id", "ord"))
    return found.select("id", "verdict")


@add("content_twins", f"""WITH f AS (SELECT *, doc_id % 9 = 0 AS copied FROM ({DOCS}) WHERE doc_id % 5 <> 0), tree AS (SELECT size, sha, min(path) AS tree_path FROM ({DOCS}) WHERE doc_id % 5 = 0 GROUP BY size, sha)
    SELECT f.path, coalesce(tree_path, CASE WHEN f.path <> k.keep THEN k.keep END) AS twin FROM f LEFT JOIN tree USING (size, sha)
    JOIN (SELECT size, sha, arg_min(path, (NOT copied, length(name), path)) AS keep FROM f GROUP BY size, sha) k USING (size, sha) WHERE NOT copied AND coalesce(tree_path, CASE WHEN f.path <> k.keep THEN k.keep END) IS NOT NULL""")
def content_twins(s, d):
    files = doc_files(s, d)
    return joins.twins(files.where("doc_id % 5 <> 0").withColumn("copied", c("doc_id") % 9 == 0), files.where("doc_id % 5 = 0").select("path", "size", "sha"))


@add("stale_verdict", """WITH f AS (SELECT doc_id, source || '/' || doc_id AS path, 'n' || doc_id % 400 AS name, n_chars AS size FROM documents),
    q AS (SELECT * FROM f WHERE doc_id % 2 = 0), p AS (SELECT path, name, size FROM f WHERE doc_id % 3 = 0),
    j AS (SELECT q.path, count(p.path) AS n, count(*) FILTER (p.size = q.size AND q.size > 0) AS ns FROM q LEFT JOIN p USING (name) GROUP BY q.path)
    SELECT path, CASE WHEN path IN (SELECT path FROM p) THEN 'present' WHEN n = 0 THEN 'gone' WHEN CASE WHEN ns > 0 THEN ns ELSE n END = 1 THEN 'moved' ELSE 'ambiguous' END AS verdict FROM j""")
def stale_verdict(s, d):
    files = doc_files(s, d).withColumn("name", F.concat(F.lit("n"), (c("doc_id") % 400).cast("string")))
    return joins.staleness(files.where("doc_id % 2 = 0").select("path", "name", "size"), files.where("doc_id % 3 = 0").select("path", "name", "size")).select("path", "verdict")


#: Names without their digits, so that many collide; some end as a renamed one would.
COLLIDING = """SELECT folder AS dest, file_no AS id, CASE WHEN file_no % 2 = 0 THEN upper(bare) ELSE bare END AS name FROM (SELECT folder, file_no,
    regexp_replace(replace(file_name, '.', CASE WHEN file_no % 40 = 1 THEN '_dup3.' WHEN file_no % 40 = 22 THEN '_dup2.' ELSE '.' END), '(^|[^p0-9])[0-9]+', '$1'{flag}) AS bare FROM {rows}) x"""


@add("collision_suffix", A.CTE.replace("WITH", "WITH RECURSIVE", 1) + f""", n AS ({COLLIDING.format(flag=", 'g'", rows="manifest").replace("$1", chr(92) + "1")}),
    o AS MATERIALIZED (SELECT *, regexp_extract(lower(name), '^(.+?)([.][^.]+)?$', 1) AS stem, regexp_extract(lower(name), '^(.+?)([.][^.]+)?$', 2) AS ext, row_number() OVER (PARTITION BY dest ORDER BY name, id) AS k FROM n),
    w(dest, k, id, final, taken) AS (SELECT DISTINCT dest, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, []::VARCHAR[] FROM o
      UNION ALL SELECT dest, k, id, CASE WHEN n = 1 THEN name ELSE regexp_extract(name, '^(.+?)([.][^.]+)?$', 1) || '_dup' || n || regexp_extract(name, '^(.+?)([.][^.]+)?$', 2) END, list_append(taken, CASE WHEN n = 1 THEN lower(name) ELSE stem || '_dup' || n || ext END)
      FROM (SELECT o.*, taken, CASE WHEN NOT list_contains(taken, lower(o.name)) THEN 1 ELSE list_filter(range(2, len(taken) + 3), lambda x: NOT list_contains(taken, o.stem || '_dup' || x || o.ext))[1] END AS n FROM w JOIN o ON o.dest = w.dest AND o.k = w.k + 1))
    SELECT dest, id, final FROM w WHERE k > 0""")
def collision_suffix(s, d):
    """Names made unique in each folder, around those that already end as a renamed one."""
    return joins.collision_suffix(s.sql(COLLIDING.format(flag="", rows="{rows}"), rows=A.manifest(s, d)))


@add("alias_resolve", """WITH RECURSIVE l AS (SELECT p_partkey AS id, p_partkey // 2 AS target FROM part WHERE p_partkey % 3 <> 0 AND p_partkey > 1),
    w AS (SELECT id, target, 1 AS n FROM l UNION ALL SELECT w.id, l.target, n + 1 FROM w JOIN l ON w.target = l.id)
    SELECT id, arg_max(target, n) AS root FROM w GROUP BY id""")
def alias_resolve(s, d):
    links = A.table(s, d, "part").where("p_partkey % 3 <> 0 and p_partkey > 1").select(c("p_partkey").alias("id"), F.floor(c("p_partkey") / 2).alias("target"))
    return joins.resolve_aliases(links)


ROOTS = "SELECT DISTINCT CASE WHEN page_id % 4 = 0 THEN '/a' || page_id % 7 ELSE '/a' || page_id % 11 || '/b' || page_id % 5 || CASE WHEN page_id % 2 = 0 THEN '/c' ELSE '' END END AS root FROM pages"


@add("outermost_roots", f"WITH r AS ({ROOTS}) SELECT root FROM r WHERE NOT EXISTS (SELECT 1 FROM r o WHERE starts_with(r.root, o.root || '/'))")
def outermost_roots(s, d):
    root = F.expr("CASE WHEN page_id % 4 = 0 THEN concat('/a', page_id % 7) ELSE concat('/a', page_id % 11, '/b', page_id % 5, CASE WHEN page_id % 2 = 0 THEN '/c' ELSE '' END) END")
    return joins.outermost(A.table(s, d, "pages").select(root.alias("root")))


@add("unread_except_all", A.CTE + "SELECT folder, lower(file_name) AS name FROM manifest EXCEPT ALL SELECT folder, lower(file_name) FROM manifest WHERE file_no % 3 <> 0")
def unread_except_all(s, d):
    names = A.manifest(s, d).select("file_no", "folder", F.lower("file_name").alias("name"))
    return names.select("folder", "name").exceptAll(names.where("file_no % 3 <> 0").select("folder", "name"))


@add("plan_reconcile", A.CTE + """, e AS (SELECT file_no, folder AS dest FROM typed WHERE file_no % 10 <> 0), x AS (SELECT file_no, CASE WHEN file_no % 7 = 0 THEN 'other' ELSE folder END AS dest FROM typed WHERE file_no % 11 <> 0)
    SELECT coalesce(e.file_no, x.file_no) AS file_no, CASE WHEN x.file_no IS NULL THEN 'missing' WHEN e.file_no IS NULL THEN 'extra' ELSE 'differs' END AS problem FROM e FULL JOIN x ON e.file_no = x.file_no WHERE e.dest IS DISTINCT FROM x.dest""")
def plan_reconcile(s, d):
    rows = A.manifest(s, d)
    want = rows.where("file_no % 10 <> 0").select("file_no", c("folder").alias("want"))
    have = rows.where("file_no % 11 <> 0").select("file_no", F.when(c("file_no") % 7 == 0, "other").otherwise(c("folder")).alias("have"))
    problem = F.when(c("have").isNull(), "missing").when(c("want").isNull(), "extra").otherwise("differs")
    return want.join(have, "file_no", "full").where(~c("want").eqNullSafe(c("have"))).select("file_no", problem.alias("problem"))


@add("sighting_days", A.CTE + f"""SELECT id AS home, count(DISTINCT day) AS days, count(*) AS files FROM (SELECT file_no, day, id, {KM} AS km FROM typed, {A.HOMES_SQL} WHERE lat IS NOT NULL AND day IS NOT NULL AND {VALID}) WHERE km <= 10 GROUP BY id""")
def sighting_days(s, d):
    return with_homes(s, placed(s, d)).where("km <= 10").groupBy(c("id").alias("home")).agg(F.count_distinct("day").alias("days"), F.count("*").alias("files"))


@add("verified_union", """SELECT o_custkey AS source, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY o_custkey""")
def verified_union(s, d):
    o = A.table(s, d, "orders").select("o_custkey", "o_orderstatus", F.struct("o_orderdate", "o_orderkey").alias("at"))
    return o.groupBy(c("o_custkey").alias("source")).agg(F.max_by("o_orderstatus", "at").alias("status"))


#: Copies that earlier dumps made, by the folder they went to, and where the owner's tree has them now: some folders were
#: renamed, some not, some parted, and some texts are there twice.
COPIES = """SELECT doc_id, length(text) AS size, sha, part || '_' || lang AS engine, part || '_' || CASE doc_id % 9 % 3 WHEN 0 THEN 'lake' WHEN 1 THEN lang ELSE CASE WHEN doc_id % 2 = 0 THEN 'hill' ELSE 'shore' END END AS folder
FROM (SELECT doc_id, text, lang, {sha} AS sha, source || CAST(doc_id % 9 AS STRING) AS part FROM {docs}) d"""


@add("majority_owner_word", f"""WITH c AS ({COPIES.format(sha="sha256(text)", docs="documents")}), tree AS (SELECT size, sha, count(DISTINCT folder) AS n, min(folder) AS folder FROM c WHERE doc_id % 7 <> 5 GROUP BY size, sha),
    g AS (SELECT engine, count(*) AS copies, bool_or(coalesce(n > 1, false)) AS split FROM c LEFT JOIN tree USING (size, sha) GROUP BY engine), h AS (SELECT engine, tree.folder, count(*) AS held FROM c JOIN tree USING (size, sha) GROUP BY ALL)
    SELECT engine, folder, split_part(folder, '_', 2) AS word FROM g JOIN h USING (engine) WHERE NOT split AND 2 * held > copies AND split_part(folder, '_', 2) <> split_part(engine, '_', 2) AND folder NOT IN (SELECT engine FROM c)""")
def majority_owner_word(s, d):
    """The word that an owner gave to a folder of an earlier dump: its copies are found in the tree by size and hash, one
    folder holds more than half of them, and its name differs. A copy that is in two folders gives no word."""
    docs = A.table(s, d, "documents")
    copies = s.sql(COPIES.format(sha="sha2(text, 256)", docs="{docs}"), docs=docs)
    tree = copies.where("doc_id % 7 <> 5").groupBy("size", "sha").agg(F.count_distinct("folder").alias("n"), F.min("folder").alias("home"))
    met = copies.join(tree, ["size", "sha"], "left")
    homes = met.groupBy("engine", "home").agg(F.count("*").alias("held"), F.bool_or(F.coalesce(c("n") > 1, F.lit(False))).alias("split"))
    own = Window.partitionBy("engine")
    told = homes.withColumn("copies", F.sum("held").over(own)).withColumn("any_split", F.bool_or("split").over(own))
    word = lambda x: F.get(F.split(x, "_"), F.lit(1))
    best = told.where(c("home").isNotNull() & ~c("any_split") & (2 * c("held") > c("copies")) & (word(c("home")) != word(c("engine"))))
    named = copies.select(c("engine").alias("home")).distinct()
    return best.join(named, "home", "left_anti").select("engine", c("home").alias("folder"), word(c("home")).alias("word"))


@add("device_census", A.CTE + """SELECT coalesce(CASE WHEN make NOT IN ('-', '') THEN make END, '(none)') AS make, CASE WHEN grouping(model) = 0 THEN coalesce(CASE WHEN model NOT IN ('-', '') THEN model END, '(none)') END AS model, count(*) AS files
    FROM manifest GROUP BY GROUPING SETS ((make, model), (make)) HAVING grouping(model) = 0 OR make NOT IN ('-', '')""")
def device_census(s, d):
    counted = A.manifest(s, d).groupingSets([["make", "model"], ["make"]], "make", "model").agg(F.grouping("model").alias("g"), F.count("*").alias("files"))
    named = lambda x: F.coalesce(F.when(~c(x).isin("-", ""), c(x)), F.lit("(none)"))
    return counted.where((c("g") == 0) | ~c("make").isin("-", "")).select(named("make").alias("make"), F.when(c("g") == 0, named("model")).alias("model"), "files")


@add("screen_candidates", A.CTE + """SELECT width || 'x' || height AS size, count(*) AS files, count(*) FILTER (regexp_matches(file_name, '(?i)^screenshot')) AS named FROM manifest WHERE make IN ('-', '') AND width <> '-' GROUP BY 1 HAVING named >= 2""")
def screen_candidates(s, d):
    rows = A.manifest(s, d).where(parse.present(c("make")).isNull() & (c("width") != "-"))
    return rows.groupBy(F.concat_ws("x", "width", "height").alias("size")).agg(F.count("*").alias("files"), F.count_if(c("file_name").rlike("(?i)^screenshot")).alias("named")).where(c("named") >= P.SCREEN_HITS)


@add("modal_year", "SELECT source, year FROM (SELECT source, year, row_number() OVER (PARTITION BY source ORDER BY n DESC, year) AS r FROM (SELECT source, 2000 + doc_id % 6 AS year, count(*) AS n FROM documents GROUP BY ALL)) WHERE r = 1")
def modal_year(s, d):
    n = A.table(s, d, "documents").groupBy("source", (2000 + c("doc_id") % 6).alias("year")).agg(F.count("*").alias("n"))
    return n.groupBy("source").agg(F.min_by("year", F.struct(-c("n"), c("year"))).alias("year"))


@add("area_stats", A.CTE + """SELECT folder, count(*) AS files, count(DISTINCT day) AS days, string_agg(DISTINCT month, ',' ORDER BY month) AS months, round(avg(CAST(night AS INTEGER)), 6) AS night_share, CAST(min(taken) AS VARCHAR) AS first, CAST(max(taken) AS VARCHAR) AS last
    FROM typed WHERE taken IS NOT NULL GROUP BY folder""")
def area_stats(s, d):
    return A.typed(s, d).where("taken is not null").groupBy("folder").agg(
        F.count("*").alias("files"), F.count_distinct("day").alias("days"), F.array_join(F.array_sort(F.collect_set("month")), ",").alias("months"),
        F.round(F.avg(c("night").cast("int")), 6).alias("night_share"), F.min("taken").cast("string").alias("first"), F.max("taken").cast("string").alias("last"))


@add("time_of_day", A.CTE + """SELECT folder, CASE WHEN h BETWEEN 7 AND 10 THEN 'mostly morning' WHEN h BETWEEN 11 AND 14 THEN 'mostly midday' WHEN h BETWEEN 15 AND 18 THEN 'mostly late afternoon' ELSE 'mostly after dark' END AS band
    FROM (SELECT folder, list_sort(list(hour(taken)))[count(*) // 2 + 1] AS h FROM typed WHERE taken IS NOT NULL GROUP BY folder)""")
def time_of_day(s, d):
    return A.typed(s, d).where("taken is not null").transform(timeline.upper_median_bands, "folder", F.hour("taken"))


@add("who_evidence", "SELECT event_type, user_id % 5 AS who, count(DISTINCT event_id % 100) AS files FROM events GROUP BY ALL")
def who_evidence(s, d):
    return A.table(s, d, "events").groupBy("event_type", (c("user_id") % 5).alias("who")).agg(F.count_distinct(c("event_id") % 100).alias("files"))


@add("phrase_rank", """SELECT folder, kind, files, CAST(r AS INTEGER) AS r FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY files DESC, kind) AS r FROM (SELECT folder, file_type AS kind, count(*) AS files FROM manifest GROUP BY ALL)) WHERE r <= 2""".replace("SELECT folder, kind", A.CTE + "SELECT folder, kind", 1))
def phrase_rank(s, d):
    n = A.manifest(s, d).groupBy("folder", c("file_type").alias("kind")).agg(F.count("*").alias("files"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("folder").orderBy(F.desc("files"), "kind"))).where("r <= 2")


@add("fsl_months", A.CTE + "SELECT folder, month, count(DISTINCT day) AS days FROM typed WHERE month IS NOT NULL GROUP BY ALL HAVING count(DISTINCT day) >= 25")
def fsl_months(s, d):
    return A.typed(s, d).where("month is not null").groupBy("folder", "month").agg(F.count_distinct("day").alias("days")).where("days >= 25")


@add("drop_off", A.CTE + """, m AS (SELECT DISTINCT folder, month FROM typed WHERE month IS NOT NULL), k AS (SELECT month, row_number() OVER (ORDER BY month) AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT month FROM m))
    SELECT folder, count(*) AS months, max(month) AS last_month, max(n) - max(pos) AS trailing FROM m JOIN k USING (month) GROUP BY folder HAVING count(*) >= 3 AND max(n) - max(pos) >= 2""")
def drop_off(s, d):
    return timeline.drop_offs(A.typed(s, d).where("month is not null"), "folder", P.DROP_OFF)


@add("status_stages", "SELECT CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'planned' END AS stage, count(*) AS batches, CAST(round(sum(o_totalprice), 2) AS DOUBLE) AS total FROM orders GROUP BY 1")
def status_stages(s, d):
    stage = F.when(c("o_orderstatus") == "F", "done").when(c("o_orderstatus") == "O", "pending").otherwise("planned")
    return A.table(s, d, "orders").groupBy(stage.alias("stage")).agg(F.count("*").alias("batches"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@add("pack_snapshot", "SELECT sha256(string_agg(h, '|' ORDER BY h)) AS snapshot FROM (SELECT sha256(n_name) AS h FROM nation)")
def pack_snapshot(s, d):
    return A.table(s, d, "nation").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.sha2("n_name", 256))), "|"), 256).alias("snapshot"))


#: The stops of each day point by point, with the values of the current one for its medians.
STOP_WALK = f"""ordered AS MATERIALIZED (SELECT folder, day, file_no AS id, lat, lon, row_number() OVER (PARTITION BY folder, day ORDER BY taken, file_no) AS k FROM typed WHERE lat IS NOT NULL AND taken IS NOT NULL),
    walk(folder, day, k, id, stop, lats, lons) AS (
      SELECT folder, day, k, id, 1::BIGINT, [lat], [lon] FROM ordered WHERE k = 1
      UNION ALL SELECT folder, day, k, id, CASE WHEN far THEN stop + 1 ELSE stop END, CASE WHEN far THEN [lat] ELSE list_append(lats, lat) END, CASE WHEN far THEN [lon] ELSE list_append(lons, lon) END
      FROM (SELECT o.*, stop, lats, lons, {HAV.format(a="list_aggregate(lats, 'median')", b="list_aggregate(lons, 'median')", c="o.lat", d="o.lon")} > 3 AS far FROM walk JOIN ordered o ON o.folder = walk.folder AND o.day = walk.day AND o.k = walk.k + 1))"""


@add("stop_segments", A.CTE.replace("WITH", "WITH RECURSIVE", 1) + ", " + STOP_WALK + " SELECT folder, day, id, stop FROM walk")
def stop_segments(s, d):
    points = A.typed(s, d).where("lat is not null and taken is not null").select("folder", "day", c("file_no").alias("id"), c("taken").alias("at"), "lat", "lon")
    return timeline.stops(points, ["folder", "day"])


@add("gap_sessions", """WITH n AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 43200000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS session FROM n) SELECT user_id, session, CAST(min(ts) AS VARCHAR) AS start, count(*) AS rows FROM r GROUP BY ALL""")
def gap_sessions(s, d):
    found = timeline.sessions(A.table(s, d, "events"), ["user_id"], c("ts"), 43_200)
    return found.select("user_id", "session", c("start").cast("string").alias("start"), "rows")


@add("midpoint_days", A.CTE + f""", m AS (SELECT folder, day, median(lat) AS clat, median(lon) AS clon FROM typed WHERE lat IS NOT NULL AND day IS NOT NULL GROUP BY ALL)
    SELECT folder, CAST(day AS VARCHAR) AS day FROM typed JOIN m USING (folder, day) WHERE lat IS NOT NULL GROUP BY folder, day HAVING min({HAV.format(a="lat", b="lon", c="clat", d="clon")}) > 3""")
def midpoint_days(s, d):
    pts = placed(s, d)
    mid = pts.groupBy("folder", "day").agg(F.median("lat").alias("clat"), F.median("lon").alias("clon"))
    near = pts.join(mid, ["folder", "day"]).groupBy("folder", "day").agg(F.min(geo.haversine_km(c("lat"), c("lon"), c("clat"), c("clon"))).alias("km"))
    return near.where(c("km") > P.STOP_SPLIT_KM).select("folder", c("day").cast("string").alias("day"))


@add("day_overlap_check", """WITH l AS (SELECT o_custkey AS parent, o_orderkey AS leg, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + 20 AS z FROM orders)
    SELECT x.parent, x.leg AS first, y.leg AS second FROM l x JOIN l y ON x.parent = y.parent AND x.leg < y.leg AND x.a <= y.z AND y.a <= x.z""")
def day_overlap_check(s, d):
    legs = A.table(s, d, "orders").select(c("o_custkey").alias("parent"), c("o_orderkey").alias("leg"), F.to_date("o_orderdate").alias("a"), F.date_add(F.to_date("o_orderdate"), 20).alias("z"))
    x, y = legs.alias("x"), legs.alias("y")
    hit = (c("x.parent") == c("y.parent")) & (c("x.leg") < c("y.leg")) & (c("x.a") <= c("y.z")) & (c("y.a") <= c("x.z"))
    return x.join(y, hit).select("x.parent", c("x.leg").alias("first"), c("y.leg").alias("second"))


@add("batch_states", """SELECT conv_id, arg_max(CASE role WHEN 'user' THEN 'pending' ELSE 'classified' END, turn) AS status, count(*) AS events FROM conversations GROUP BY conv_id""")
def batch_states(s, d):
    state = F.when(c("role") == "user", "pending").otherwise("classified")
    return A.table(s, d, "conversations").groupBy("conv_id").agg(F.max_by(state, "turn").alias("status"), F.count("*").alias("events"))


@add("first_seen_union", """SELECT sha, arg_min(source, (src, doc_id)) AS source FROM (SELECT sha256(text) AS sha, source, doc_id, CAST(substr(source, 4) AS INTEGER) % 3 AS src FROM documents) GROUP BY sha""")
def first_seen_union(s, d):
    rows = A.table(s, d, "documents").select(F.sha2("text", 256).alias("sha"), "source", F.struct((F.expr("cast(substring(source, 4) as int)") % 3).alias("src"), c("doc_id")).alias("at"))
    return rows.groupBy("sha").agg(F.min_by("source", "at").alias("source"))


@add("open_proposals", "SELECT DISTINCT p_name || '/' || p_brand AS size FROM part EXCEPT (SELECT p_name || '/' || p_brand FROM part WHERE p_size > 44 UNION SELECT p_name || '/' || p_brand FROM part WHERE p_size < 6)")
def open_proposals(s, d):
    p = A.table(s, d, "part").select(F.concat_ws("/", "p_name", "p_brand").alias("size"), "p_size")
    settled = p.where("p_size > 44").select("size").union(p.where("p_size < 6").select("size"))
    return p.select("size").distinct().join(settled, "size", "left_anti")


NAMES = "SELECT p_name AS w FROM part UNION SELECT CASE WHEN s_suppkey % 7 = 0 THEN upper(s_name) ELSE s_name END FROM supplier"


@add("near_names", f"""WITH n AS (SELECT w, lower(w) AS f FROM ({NAMES})) SELECT a.w AS first, b.w AS second, CAST(levenshtein(a.f, b.f) AS INTEGER) AS distance FROM n a JOIN n b ON a.w < b.w
    WHERE levenshtein(a.f, b.f) = 0 OR (levenshtein(a.f, b.f) = 1 AND least(length(a.f), length(b.f)) >= 4)""")
def near_names(s, d):
    rows = s.sql(NAMES.replace("FROM part", "FROM {p}").replace("FROM supplier", "FROM {q}"), p=A.table(s, d, "part"), q=A.table(s, d, "supplier"))
    return names.near_names(rows, "w")
