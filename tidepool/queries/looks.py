"""Queries of vectors, places, selection, registry and integrity checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepool import params as P
from tidepool.functions import geo
from tidepool.operators import census, selection, vectors
from tidepool.plans import adapters as A

c = F.col
QUERIES, SQL = {}, {}
#: Bars for the given vectors, which have no tight clusters.
TAU, ACCEPT, GRAY, MARGIN, OUTLIER = 0.30, 0.30, 0.20, 0.03, 0.25


def add(name, sql=None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


UNIT = """WITH u AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / n) AS v
    FROM (SELECT *, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings) WHERE n >= 0.5),
    m AS (SELECT label, n, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS c FROM (SELECT label, max(n) AS n, list(x ORDER BY i) AS c FROM (
        SELECT label, i, avg(v[i]) AS x, count(*) AS n FROM u, generate_series(1, 64) t(i) GROUP BY label, i) GROUP BY label))"""


def unit(s, d):
    return vectors.unit(A.table(s, d, "embeddings").select(c("vec_id").alias("id"), "label", "embedding"))


def classes(s, d):
    """Class vectors (name, c) of the labels."""
    return vectors.mean_vectors(unit(s, d), "label").select(F.coalesce(c("label").cast("string"), F.lit("None")).alias("name"), "c")


@add("vector_load", UNIT + " SELECT label, count(*) AS n, round(sum(v[1]), 6) AS total FROM u GROUP BY label")
def vector_load(s, d):
    return unit(s, d).groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum(F.get("v", F.lit(0))), 6).alias("total"))


@add("prompt_ensemble", UNIT + " SELECT label, CAST(i - 1 AS INTEGER) AS i, round(c[i], 6) AS x FROM m, generate_series(1, 64) t(i)")
def prompt_ensemble(s, d):
    return vectors.mean_vectors(unit(s, d), "label").select("label", F.posexplode("c").alias("i", "x")).withColumn("x", F.round("x", 6))


TOP = UNIT + """, r AS (SELECT id, u.label, CAST(m.label AS VARCHAR) AS name, list_dot_product(v, c) AS s, row_number() OVER (PARTITION BY id ORDER BY list_dot_product(v, c) DESC, CAST(m.label AS VARCHAR)) AS r FROM u, m),
    t AS (SELECT a.id, a.label, a.name AS best, a.s AS s1, b.s AS s2 FROM r a JOIN r b USING (id) WHERE a.r = 1 AND b.r = 2)"""


@add("zero_shot_top2", TOP + " SELECT id, best, round(s1, 6) AS score, round(s1 - s2, 6) AS margin, s1 - s2 >= 0.05 AS confident, s1 - s2 >= 0.01 AS signal FROM t")
def zero_shot_top2(s, d):
    t = vectors.nearest_two(unit(s, d), classes(s, d))
    gap = c("best_score") - c("second_score")
    return t.select("id", "best", F.round("best_score", 6).alias("score"), F.round(gap, 6).alias("margin"), (gap >= P.CONFIDENT).alias("confident"), (gap >= P.SIGNAL).alias("signal"))


@add("clip_verdict", TOP + f" SELECT CASE WHEN s2 >= {ACCEPT} AND s1 - s2 < {MARGIN} THEN 'question' WHEN s1 >= {ACCEPT} THEN 'accept' WHEN s1 >= {GRAY} THEN 'gray' ELSE 'none' END AS verdict, count(*) AS files FROM t GROUP BY 1")
def clip_verdict(s, d):
    t = vectors.nearest_two(unit(s, d), classes(s, d))
    return t.groupBy(vectors.verdict(c("best_score"), c("second_score"), ACCEPT, GRAY, MARGIN).alias("verdict")).agg(F.count("*").alias("files"))


@add("identity_verdict", TOP + " SELECT id, CASE WHEN s1 >= 0.25 AND s2 <= s1 - 0.02 THEN 'accept' WHEN s1 >= 0.25 * 0.70 / 0.82 THEN 'gray' ELSE 'none' END AS verdict FROM t")
def identity_verdict(s, d):
    t = vectors.nearest_two(unit(s, d), classes(s, d))
    return t.select("id", vectors.identity_verdict(c("best_score"), c("second_score"), 0.25, P.IDENTITY_MARGIN).alias("verdict"))


@add("paperwork_score", UNIT + " SELECT id, round(max(list_dot_product(v, c)) FILTER (m.label < 3) - max(list_dot_product(v, c)) FILTER (m.label >= 3), 6) AS score FROM u, m GROUP BY id")
def paperwork_score(s, d):
    known, side = classes(s, d), c("name").try_cast("int") < 3
    paper = vectors.nearest_two(unit(s, d).select("id", "v"), known.where(side)).select("id", "v", c("best_score").alias("paper"))
    return vectors.nearest_two(paper, known.where(~side)).select("id", F.round(c("paper") - c("best_score"), 6).alias("score"))


@add("close_pairs", UNIT + f" SELECT a.id AS a, b.id AS b, round(list_dot_product(a.v, b.v), 6) AS cos FROM u a JOIN u b ON a.id < b.id WHERE list_dot_product(a.v, b.v) >= {TAU}")
def close_pairs(s, d):
    return vectors.close_pairs(unit(s, d), TAU).withColumn("cos", F.round("cos", 6))


@add("leader_clusters")
def leader_clusters(s, d):
    return vectors.alike_leaders(unit(s, d), TAU)


@add("cluster_medoid", UNIT + " SELECT label, id, n FROM (SELECT a.label, a.id, count(*) AS n, row_number() OVER (PARTITION BY a.label ORDER BY round(sum(list_dot_product(a.v, b.v)), 9) DESC, sha256(CAST(a.id AS VARCHAR))) AS r FROM u a JOIN u b ON a.label = b.label GROUP BY a.label, a.id) WHERE r = 1")
def cluster_medoid(s, d):
    return vectors.medoids(unit(s, d), "label")


@add("outlier_rank", UNIT + f" SELECT id, round(max(list_dot_product(v, c)), 6) AS best FROM u, m GROUP BY id HAVING max(list_dot_product(v, c)) < {OUTLIER}")
def outlier_rank(s, d):
    return vectors.nearest_two(unit(s, d), classes(s, d)).where(c("best_score") < OUTLIER).select("id", F.round("best_score", 6).alias("best"))


@add("exemplar_topk", UNIT + " SELECT label, id, CAST(r AS INTEGER) AS r FROM (SELECT u.label, id, row_number() OVER (PARTITION BY u.label ORDER BY round(list_dot_product(v, c), 9) DESC, sha256(CAST(id AS VARCHAR))) AS r FROM u JOIN m USING (label)) WHERE r <= 5")
def exemplar_topk(s, d):
    return vectors.nearest_members(unit(s, d), "label", P.EXEMPLARS)


@add("group_coherence", UNIT + " SELECT a.label, round(min(list_dot_product(a.v, b.v)), 6) AS least FROM u a JOIN u b ON a.label = b.label AND a.id < b.id GROUP BY a.label")
def group_coherence(s, d):
    return vectors.coherence(unit(s, d), "label").withColumn("least", F.round("least", 6))


@add("farthest_points")
def farthest_points(s, d):
    return vectors.farthest_points(unit(s, d), "label", 5)


@add("cap_eviction")
def cap_eviction(s, d):
    return vectors.evict(unit(s, d), "label", P.EXEMPLAR_CAP)


@add("confirmed_suppression", UNIT + f""", p AS (SELECT a.id, max(list_dot_product(a.v, b.v)) AS s FROM u a JOIN u b ON b.id % 50 = 0 AND a.label = b.label WHERE a.id % 50 <> 0 GROUP BY a.id)
    SELECT id, round(s, 6) AS cos FROM p WHERE s >= {GRAY}""")
def confirmed_suppression(s, d):
    rows = unit(s, d)
    met = vectors.most_alike(rows.where("id % 50 <> 0"), rows.where("id % 50 = 0"), "label")
    return met.where(c("cos") >= GRAY).select("id", F.round("cos", 6).alias("cos"))


BOX = "SELECT l_orderkey AS file, l_linenumber AS id, l_discount AS score, l_quantity AS x0, l_tax * 100 AS y0, l_quantity + 20 AS x1, l_tax * 100 + 10 AS y1 FROM lineitem"


@add("box_nms")
def box_nms(s, d):
    boxes = s.sql(BOX.replace("FROM lineitem", "FROM {t}"), t=A.table(s, d, "lineitem"))
    return vectors.suppress_boxes(boxes.withColumn("id", c("id").cast("long")), "file", P.BOX_CONTAINMENT)


@add("box_containment", f"""WITH b AS ({BOX} WHERE l_orderkey % 50 = 0) SELECT a.file, a.id AS first, b.id AS second,
    round(greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) / least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)), 6) AS share FROM b a JOIN b ON a.file = b.file AND a.id < b.id""".replace(" WHERE l_orderkey % 50 = 0", ""))
def box_containment(s, d):
    boxes = s.sql(BOX.replace("FROM lineitem", "FROM {t}"), t=A.table(s, d, "lineitem"))
    a, b = boxes.alias("a"), boxes.alias("b")
    side = lambda t: [c(f"{t}.{x}") for x in ("x0", "y0", "x1", "y1")]
    pairs = a.join(b, (c("a.file") == c("b.file")) & (c("a.id") < c("b.id")))
    return pairs.select("a.file", c("a.id").alias("first"), c("b.id").alias("second"), F.round(geo.containment(side("a"), side("b")), 6).alias("share"))


CELL = "CAST(floor(round({0} / 0.01, 6)) AS BIGINT)"
PLACES = A.CTE + f""", src AS (SELECT *, {CELL.format("lat")} AS cy, {CELL.format("lon")} AS cx FROM typed WHERE lat IS NOT NULL AND day IS NOT NULL),
    cells AS (SELECT DISTINCT cy, cx FROM src),
    edges AS (SELECT a.cy, a.cx, b.cy AS by, b.cx AS bx FROM cells a, generate_series(-1, 1) s(i), generate_series(-1, 1) t(j), cells b WHERE b.cy = a.cy + i AND b.cx = a.cx + j AND (i <> 0 OR j <> 0)),
    comp(cy, cx, place) USING KEY (cy, cx) AS (
      SELECT cy, cx, (cy, cx) FROM cells
      UNION (SELECT e.by, e.bx, min(w.place) FROM comp w JOIN edges e ON e.cy = w.cy AND e.cx = w.cx JOIN recurring.comp o ON o.cy = e.by AND o.cx = e.bx WHERE w.place < o.place GROUP BY e.by, e.bx)),
    places AS (SELECT count(DISTINCT day) AS days, count(DISTINCT CASE WHEN night THEN day END) AS night_days, count(DISTINCT month) AS months, count(*) AS files, round(avg(lat), 9) AS lat, round(avg(lon), 9) AS lon
        FROM src JOIN comp USING (cy, cx) GROUP BY place)"""
PLACES = PLACES.replace("WITH manifest", "WITH RECURSIVE manifest")
MISSED = "concat_ws(',', CASE WHEN days < 5 THEN 'days' END, CASE WHEN night_days < 3 THEN 'night_days' END)"


def found_places(s, d):
    return census.places(A.typed(s, d).where("lat is not null and day is not null"))


@add("place_components", PLACES + f" SELECT days, night_days, months, files, lat, lon, {MISSED} AS missed, {MISSED} = '' AS proposed FROM places")
def place_components(s, d):
    return found_places(s, d).drop("place")


@add("home_near_misses", PLACES + f" SELECT days, night_days, files, lat, lon, {MISSED} AS missed FROM places WHERE {MISSED} <> '' AND (days >= 2 OR night_days >= 1) ORDER BY days DESC, night_days DESC, files DESC, lat, lon LIMIT 5")
def home_near_misses(s, d):
    near = found_places(s, d).where(~c("proposed") & ((c("days") >= 2) | (c("night_days") >= 1)))
    order = [F.desc("days"), F.desc("night_days"), F.desc("files"), "lat", "lon"]
    return near.orderBy(*order).limit(P.NEAR_MISS_SHOWN).select("days", "night_days", "files", "lat", "lon", "missed")


@add("see_budget", "SELECT source, least(count(*), greatest(5, least(40, CAST(round_even(count(*) * 0.1, 0) AS BIGINT)))) AS budget FROM documents GROUP BY source")
def see_budget(s, d):
    n = A.table(s, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return n.select("source", selection.budget(c("n"), P.SEE_RATE, P.SEE_FLOOR, P.SEE_CAP).alias("budget"))


@add("rung_quota", "SELECT lang, greatest(1, least(count(*), CAST(round_even(count(*) * 0.85, 0) AS BIGINT))) AS quota FROM documents GROUP BY lang")
def rung_quota(s, d):
    n = A.table(s, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return n.select("lang", selection.quota(c("n"), P.RUNG1_SHARE).alias("quota"))


@add("even_spread", "WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS p, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT source, doc_id FROM r WHERE n <= 7 OR p IN (SELECT CAST(floor(i * n / 7) AS BIGINT) FROM generate_series(0, 6) t(i))")
def even_spread(s, d):
    return selection.even_spread(A.table(s, d, "documents").select("source", "doc_id"), ["source"], ["doc_id"], 7)


@add("stratified_sample", """WITH r AS (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 AS p, count(*) OVER (PARTITION BY source, lang) AS n, count(*) OVER (PARTITION BY source) AS pool FROM documents),
    k AS (SELECT *, greatest(1, CAST(round_even(20 * n / pool, 0) AS BIGINT)) AS k FROM r) SELECT source, lang, doc_id FROM k WHERE k >= n OR p IN (SELECT CAST(floor(i * n / k) AS BIGINT) FROM generate_series(0, 30) t(i) WHERE i < k)""")
def stratified_sample(s, d):
    return selection.stratified(A.table(s, d, "documents").select("source", "lang", "doc_id"), ["source"], "lang", ["doc_id"], 20)


@add("gray_picks", TOP + " SELECT id, round(s1, 6) AS score FROM t WHERE s1 >= 0.2 AND s1 < 0.3")
def gray_picks(s, d):
    return vectors.nearest_two(unit(s, d), classes(s, d)).where("best_score >= 0.2 and best_score < 0.3").select("id", F.round("best_score", 6).alias("score"))


@add("rename_ledger", "SELECT DISTINCT conv_id AS subject, lower(role) || '-' || turn AS name FROM conversations")
def rename_ledger(s, d):
    old = A.table(s, d, "conversations").groupBy(c("conv_id").alias("subject")).agg(F.collect_set(F.concat_ws("-", F.lower("role"), c("turn").cast("string"))).alias("names"))
    return old.select("subject", F.explode("names").alias("name"))


@add("settled_subjects", "SELECT user_id FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY user_id) WHERE last IN ('click', 'error')")
def settled_subjects(s, d):
    last = A.table(s, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    return last.where(c("last").isin("click", "error")).select("user_id")


@add("mint_ids", "SELECT lpad(CAST(max(s_suppkey) + 1 AS VARCHAR), 4, '0') AS next_id FROM supplier")
def mint_ids(s, d):
    return A.table(s, d, "supplier").agg(F.lpad((F.max("s_suppkey") + 1).cast("string"), 4, "0").alias("next_id"))


@add("place_id_problems", "SELECT id, CASE WHEN NOT regexp_full_match(id, 'h[0-9]+') THEN 'malformed' ELSE 'duplicate' END AS problem, n FROM (SELECT CASE WHEN s_suppkey % 9 = 0 THEN 'x' ELSE 'h' END || s_suppkey % 40 AS id, count(*) AS n FROM supplier GROUP BY 1) WHERE n > 1 OR NOT regexp_full_match(id, 'h[0-9]+')")
def place_id_problems(s, d):
    ids = A.table(s, d, "supplier").select(F.concat(F.when(c("s_suppkey") % 9 == 0, "x").otherwise("h"), (c("s_suppkey") % 40).cast("string")).alias("id"))
    bad = ~c("id").rlike("^h[0-9]+$")
    return ids.groupBy("id").agg(F.count("*").alias("n")).where((c("n") > 1) | bad).select("id", F.when(bad, "malformed").otherwise("duplicate").alias("problem"), "n")


@add("duplicate_sample_check", "SELECT sample, count(*) AS claims, min(doc_id) AS first FROM (SELECT doc_id, sha256(text) AS sample FROM documents) GROUP BY sample HAVING count(*) > 1")
def duplicate_sample_check(s, d):
    return A.table(s, d, "documents").groupBy(F.sha2("text", 256).alias("sample")).agg(F.count("*").alias("claims"), F.min("doc_id").alias("first")).where("claims > 1")


@add("viewed_claim_audit", """SELECT doc_id, concat_ws(',', CASE WHEN l.doc_id IS NULL THEN 'not_selected' END, CASE WHEN d.doc_id % 4 = 3 THEN 'bad_provenance' END, CASE WHEN l.quality = 0 THEN 'sample_differs' END) AS problems
    FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR d.doc_id % 4 = 3 OR l.quality = 0""")
def viewed_claim_audit(s, d):
    rows = A.table(s, d, "documents").select("doc_id").join(A.table(s, d, "labels").withColumn("picked", F.lit(True)), "doc_id", "left")
    problems = F.concat_ws(",", F.when(c("picked").isNull(), "not_selected"), F.when(c("doc_id") % 4 == 3, "bad_provenance"), F.when(c("quality") == 0, "sample_differs"))
    return rows.select("doc_id", problems.alias("problems")).where("problems <> ''")


@add("decision_merge", """SELECT key, arg_max(label, (strength, seq)) AS label FROM (SELECT user_id AS key, event_type AS label, CASE event_type WHEN 'error' THEN 3 WHEN 'click' THEN 2 ELSE 1 END AS strength, event_id AS seq FROM events) GROUP BY key""")
def decision_merge(s, d):
    rows = A.table(s, d, "events").withColumn("strength", F.when(c("event_type") == "error", 3).when(c("event_type") == "click", 2).otherwise(1))
    return rows.groupBy(c("user_id").alias("key")).agg(F.max_by("event_type", F.struct("strength", "event_id")).alias("label"))


@add("cluster_propagation", """SELECT source, arg_min(lang, doc_id) AS label, count(DISTINCT lang) > 1 AS conflict FROM documents JOIN labels USING (doc_id) GROUP BY source""")
def cluster_propagation(s, d):
    viewed = A.table(s, d, "documents").join(A.table(s, d, "labels").select("doc_id"), "doc_id")
    return viewed.groupBy("source").agg(F.min_by("lang", "doc_id").alias("label"), (F.count_distinct("lang") > 1).alias("conflict"))


@add("settings_resolve", """SELECT n_nationkey AS setting, coalesce(CASE WHEN n_nationkey % 5 = 0 THEN 'flag' END, CASE WHEN n_nationkey % 3 = 0 THEN 'collection' END, CASE WHEN n_regionkey = 1 THEN 'pack' END, 'default') AS layer FROM nation""")
def settings_resolve(s, d):
    k = c("n_nationkey")
    layer = F.coalesce(F.when(k % 5 == 0, "flag"), F.when(k % 3 == 0, "collection"), F.when(c("n_regionkey") == 1, "pack"), F.lit("default"))
    return A.table(s, d, "nation").select(k.alias("setting"), layer.alias("layer"))


@add("rename_mismatches", A.CTE + """SELECT file_no, file_type FROM manifest WHERE CASE lower(regexp_extract(file_name, '\\.([^.]+)$', 1)) WHEN 'jpg' THEN 'JPEG' WHEN 'heic' THEN 'HEIC' WHEN 'png' THEN 'PNG' WHEN 'mov' THEN 'MOV' WHEN 'mp4' THEN 'MP4' ELSE '?' END <> file_type""")
def rename_mismatches(s, d):
    ext = F.lower(F.regexp_extract("file_name", r"\.([^.]+)$", 1))
    known = F.create_map(*[F.lit(x) for p in (("jpg", "JPEG"), ("heic", "HEIC"), ("png", "PNG"), ("mov", "MOV"), ("mp4", "MP4")) for x in p])
    return A.manifest(s, d).where(F.coalesce(F.try_element_at(known, ext), F.lit("?")) != c("file_type")).select("file_no", "file_type")


@add("copy_finished", "SELECT o_custkey AS unit, bool_and(o_orderstatus = 'F') AS finished, count(*) FILTER (o_orderstatus <> 'F') AS left_rows FROM orders GROUP BY o_custkey")
def copy_finished(s, d):
    done = c("o_orderstatus") == "F"
    return A.table(s, d, "orders").groupBy(c("o_custkey").alias("unit")).agg(F.bool_and(done).alias("finished"), F.count_if(~done).alias("left_rows"))


@add("skipped_before", "SELECT doc_id FROM documents WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND toxic = 1)")
def skipped_before(s, d):
    return A.table(s, d, "documents").join(A.table(s, d, "labels").where("toxic = 1"), "doc_id", "left_semi").select("doc_id")


@add("question_pairs", TOP.replace("a.name AS best,", "a.name AS best, b.name AS second,") + f" SELECT least(best, second) AS first, greatest(best, second) AS second, count(*) AS files FROM t WHERE s1 - s2 < {MARGIN} GROUP BY ALL")
def question_pairs(s, d):
    t = vectors.nearest_two(unit(s, d), classes(s, d)).where(c("best_score") - c("second_score") < MARGIN)
    return t.groupBy(F.least("best", "second").alias("first"), F.greatest("best", "second").alias("second")).agg(F.count("*").alias("files"))


@add("frame_numbers", "SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS frame FROM conversations")
def frame_numbers(s, d):
    return A.table(s, d, "conversations").select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("frame"))
