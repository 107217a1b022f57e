"""Queries of subjects, looks at files, and what they settle."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepool import params as P
from tidepool.functions import parse
from tidepool.operators import vectors
from tidepool.plans import adapters as A
from tidepool.plans import archive as R
from tidepool.plans.stored import small

from .basics import HAV, VALID, homes_of, placed
from .looks import ACCEPT, GRAY, MARGIN, TOP, UNIT, classes, unit

c = F.col
QUERIES, SQL = {}, {}


def add(name, sql=None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def settled(s, d):
    """Looks with the columns of their subject, where it is known."""
    return R.looks(s, d).join(R.subjects(s, d).withColumnRenamed("no", "subject_no"), "subject_no", "left")


CONFIRMED = "provenance IN ('viewed-image', 'viewed-image:')"


def seen():
    return parse.is_view_confirmed(c("provenance"))


@add("recognisers", R.CTE + """, e AS (SELECT label, count(*) AS n, count(*) FILTER (vec_id % 3 = 0 AND label % 4 <> 1) AS own FROM embeddings GROUP BY label)
    SELECT subject_id, coalesce(own, 0) > 0 AS has_identity FROM subjects JOIN e USING (label) WHERE status = 'confirmed' AND n > 0""")
def recognisers(s, d):
    e = A.table(s, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.count_if((c("vec_id") % 3 == 0) & (c("label") % 4 != 1)).alias("own"))
    return R.subjects(s, d).where("status = 'confirmed'").join(e, "label").select("subject_id", (c("own") > 0).alias("has_identity"))


@add("forms_folder", R.CTE + " SELECT subject_id, coalesce(forms, name IS NOT NULL AND has_start) AS forms FROM subjects")
def forms_folder(s, d):
    return R.subjects(s, d).select("subject_id", F.coalesce("forms", c("name").isNotNull() & c("has_start")).alias("forms"))


@add("subject_labels", R.CTE + """ SELECT file_no, subject_no, coalesce(kind, 'unknown') AS kind, CASE WHEN name IS NOT NULL AND status NOT IN ('draft') THEN name ELSE coalesce(kind, 'unknown') END AS shown, NOT (name IS NOT NULL AND status NOT IN ('draft')) OR status IS NULL AS is_draft
    FROM looks LEFT JOIN subjects ON no = subject_no""")
def subject_labels(s, d):
    known = F.coalesce(c("name").isNotNull() & (c("status") != "draft"), F.lit(False))
    kind = F.coalesce("kind", F.lit("unknown"))
    return settled(s, d).select("file_no", "subject_no", kind.alias("kind"), F.when(known, c("name")).otherwise(kind).alias("shown"), (~known).alias("is_draft"))


@add("backed_subjects", R.CTE + f""" SELECT folder, lower(name) AS pet, count(DISTINCT file_no) AS files, min(subject_no) AS first_id FROM looks JOIN subjects ON no = subject_no WHERE {CONFIRMED} AND status = 'confirmed' AND name IS NOT NULL GROUP BY ALL""")
def backed_subjects(s, d):
    rows = settled(s, d).where(seen() & (c("status") == "confirmed") & c("name").isNotNull())
    return rows.groupBy("folder", F.lower("name").alias("pet")).agg(F.count_distinct("file_no").alias("files"), F.min("subject_no").alias("first_id"))


@add("unbacked_names", R.CTE + f""", named AS (SELECT DISTINCT folder, lower(name) AS pet FROM looks JOIN subjects ON no = subject_no WHERE name IS NOT NULL),
    backed AS (SELECT DISTINCT folder, lower(name) AS pet FROM looks JOIN subjects ON no = subject_no WHERE {CONFIRMED} AND status = 'confirmed' AND name IS NOT NULL) SELECT folder, pet FROM named EXCEPT SELECT folder, pet FROM backed""")
def unbacked_names(s, d):
    rows = settled(s, d).where("name is not null").select("folder", F.lower("name").alias("pet"), (seen() & (c("status") == "confirmed")).alias("backs"))
    return rows.groupBy("folder", "pet").agg(F.bool_or("backs").alias("b")).where(~c("b")).select("folder", "pet")


@add("subject_looks", R.CTE + " SELECT subject_no, sample, arg_min(file_no, (ts, file_no)) AS first_file FROM looks GROUP BY ALL")
def subject_looks(s, d):
    return R.looks(s, d).groupBy("subject_no", "sample").agg(F.min_by("file_no", F.struct("ts", "file_no")).alias("first_file"))


@add("subjects_by_frame", R.CTE + " SELECT sample, count(DISTINCT subject_no) AS subjects, min(file_no) AS first_file FROM looks GROUP BY sample")
def subjects_by_frame(s, d):
    return R.looks(s, d).groupBy("sample").agg(F.count_distinct("subject_no").alias("subjects"), F.min("file_no").alias("first_file"))


@add("draft_observations", R.CTE + " SELECT batch, subject_id, count(*) AS looks, count(DISTINCT sample) AS samples FROM looks JOIN subjects ON no = subject_no WHERE status = 'draft' GROUP BY ALL")
def draft_observations(s, d):
    return settled(s, d).where("status = 'draft'").groupBy("batch", "subject_id").agg(F.count("*").alias("looks"), F.count_distinct("sample").alias("samples"))


@add("asked_before", R.CTE + " SELECT subject_no, arg_max(batch, (ts, file_no)) AS checkpoint, count(*) AS observations FROM looks WHERE value < 400 GROUP BY subject_no")
def asked_before(s, d):
    return R.looks(s, d).where("value < 400").groupBy("subject_no").agg(F.max_by("batch", F.struct("ts", "file_no")).alias("checkpoint"), F.count("*").alias("observations"))


@add("rounds_fired", R.CTE + " SELECT count(DISTINCT batch) AS rounds FROM looks WHERE provenance LIKE 'clip-%'")
def rounds_fired(s, d):
    return R.looks(s, d).where(c("provenance").startswith("clip-")).agg(F.count_distinct("batch").alias("rounds"))


@add("batches_without_vision", R.CTE + " SELECT DISTINCT folder, month(ts) AS m FROM looks EXCEPT SELECT folder, month(ts) FROM looks WHERE provenance = 'clip-propagated:'")
def batches_without_vision(s, d):
    rows = R.looks(s, d).select("folder", F.month("ts").cast("long").alias("m"), "provenance")
    return rows.select("folder", "m").distinct().join(rows.where("provenance = 'clip-propagated:'"), ["folder", "m"], "left_anti")


@add("provenance_problems", R.CTE + " SELECT file_no, claimed FROM looks WHERE claimed <> '' AND claimed NOT IN ('viewed-image:', 'clip-matched:', 'clip-propagated:', 'draft:viewed-image:', 'draft:clip-matched:', 'draft:clip-propagated:')")
def provenance_problems(s, d):
    return R.looks(s, d).where((c("claimed") != "") & ~c("claimed").isin(*P.PROVENANCES, *[f"draft:{p}" for p in P.PROVENANCES])).select("file_no", "claimed")


@add("seen_problems", R.CTE + """, k AS (SELECT sample, min(file_no) AS owner FROM looks GROUP BY sample) SELECT file_no, concat_ws(',', CASE WHEN NOT (provenance IN ('viewed-image', 'viewed-image:')) THEN 'not_viewed' END, CASE WHEN owner <> file_no THEN 'sample_of_another' END) AS problems
    FROM looks JOIN k USING (sample) WHERE NOT (provenance IN ('viewed-image', 'viewed-image:')) OR owner <> file_no""")
def seen_problems(s, d):
    rows = R.looks(s, d)
    owner = rows.groupBy("sample").agg(F.min("file_no").alias("owner"))
    problems = F.concat_ws(",", F.when(~seen(), "not_viewed"), F.when(c("owner") != c("file_no"), "sample_of_another"))
    return rows.join(owner, "sample").select("file_no", problems.alias("problems")).where("problems <> ''")


@add("agent_view_problems", R.CTE + f""", v AS (SELECT DISTINCT sample, subject_no FROM looks WHERE value >= 60) SELECT file_no, CASE WHEN v.sample IS NULL THEN 'no_view_agrees' ELSE 'not_a_view' END AS problem FROM looks l LEFT JOIN v ON v.sample = l.sample AND v.subject_no = l.subject_no
    WHERE v.sample IS NULL OR NOT {CONFIRMED}""")
def agent_view_problems(s, d):
    rows = R.looks(s, d)
    views = rows.where("value >= 60").select("sample", "subject_no").distinct().withColumn("agrees", F.lit(True))
    met = rows.join(views, ["sample", "subject_no"], "left")
    return met.where(c("agrees").isNull() | ~seen()).select("file_no", F.when(c("agrees").isNull(), "no_view_agrees").otherwise("not_a_view").alias("problem"))


@add("artefact_inventory", R.CTE + f" SELECT provenance AS kind, count(DISTINCT batch) AS batches, count(*) AS n, bool_or({CONFIRMED}) AS blocking FROM looks GROUP BY provenance")
def artefact_inventory(s, d):
    return R.looks(s, d).groupBy(c("provenance").alias("kind")).agg(F.count_distinct("batch").alias("batches"), F.count("*").alias("n"), F.bool_or(seen()).alias("blocking"))


STRENGTH = "CASE provenance WHEN 'viewed-image:' THEN 3 WHEN 'clip-propagated:' THEN 2 ELSE 1 END"


@add("claims_kept", R.CTE + f""", r AS (SELECT file_no % 500 AS path, subject_no, provenance, {STRENGTH} AS strength, file_no AS seq FROM looks) SELECT path, arg_max(subject_no, (strength, seq)) AS subject_no, max(strength) AS strength FROM r GROUP BY path""")
def claims_kept(s, d):
    strength = F.when(c("provenance") == "viewed-image:", 3).when(c("provenance") == "clip-propagated:", 2).otherwise(1)
    rows = R.looks(s, d).select((c("file_no") % 500).alias("path"), "subject_no", strength.alias("strength"), c("file_no").alias("seq"))
    return rows.groupBy("path").agg(F.max_by("subject_no", F.struct("strength", "seq")).alias("subject_no"), F.max("strength").alias("strength"))


@add("home_sightings", A.CTE + ", " + R.CTE.removeprefix("WITH ") + f""", near AS (SELECT file_no, arg_min(id, km) AS home FROM (SELECT file_no, id, {HAV.format(a="lat", b="lon", c="hlat", d="hlon")} AS km FROM typed, {A.HOMES_SQL} WHERE lat IS NOT NULL AND day IS NOT NULL AND {VALID}) WHERE km <= 10 GROUP BY file_no)
    SELECT DISTINCT home, subject_id FROM near JOIN looks USING (file_no) JOIN subjects ON no = subject_no WHERE {CONFIRMED} AND status = 'confirmed'""")
def home_sightings(s, d):
    from tidepool.functions import geo

    near = geo.nearest_of(c("lat"), c("lon"), homes_of(c("day")))
    homes = placed(s, d).select("file_no", near.alias("near")).where(c("near.km") <= 10).select("file_no", c("near.id").alias("home"))
    rows = settled(s, d).where(seen() & (c("status") == "confirmed"))
    return homes.join(rows.select("file_no", "subject_id"), "file_no").select("home", "subject_id").distinct()


@add("away_gate", A.CTE + f" SELECT folder, NOT coalesce(bool_or(near), false) AS asks FROM (SELECT folder, lat IS NOT NULL AND EXISTS (SELECT 1 FROM {A.HOMES_SQL} WHERE {HAV.format(a='lat', b='lon', c='hlat', d='hlon')} <= 3.0 AND {VALID}) AS near FROM typed) GROUP BY folder")
def away_gate(s, d):
    from tidepool.functions import geo

    near = geo.nearest_of(c("lat"), c("lon"), homes_of(c("day")))
    rows = A.typed(s, d).select("folder", F.coalesce(near["km"] <= P.AWAY_KM, F.lit(False)).alias("near"))
    return rows.groupBy("folder").agg((~F.bool_or("near")).alias("asks"))


@add("verdict_tally", TOP + f""", v AS (SELECT CASE WHEN s2 >= {ACCEPT} AND s1 - s2 < {MARGIN} THEN 'question' WHEN s1 >= {ACCEPT} THEN 'accept' WHEN s1 >= {GRAY} THEN 'gray' ELSE 'none' END AS verdict, best FROM t) SELECT best AS class, count(*) FILTER (verdict = 'accept') AS accept, count(*) FILTER (verdict = 'gray') AS gray, count(*) FILTER (verdict = 'question') AS question, count(*) FILTER (verdict = 'none') AS none FROM v GROUP BY best""")
def verdict_tally(s, d):
    t = vectors.nearest_two(unit(s, d), classes(s, d))
    v = t.select(c("best").alias("class"), vectors.verdict(c("best_score"), c("second_score"), ACCEPT, GRAY, MARGIN).alias("verdict"))
    return v.groupBy("class").agg(*[F.count_if(c("verdict") == x).alias(x) for x in ("accept", "gray", "question", "none")])


@add("accepted_matches", TOP + f" SELECT id, best AS subject, round(s1, 6) AS score FROM t WHERE s1 >= {ACCEPT} AND NOT (s2 >= {ACCEPT} AND s1 - s2 < {MARGIN})")
def accepted_matches(s, d):
    t = vectors.nearest_two(unit(s, d), classes(s, d))
    good = vectors.verdict(c("best_score"), c("second_score"), ACCEPT, GRAY, MARGIN) == "accept"
    return t.where(good).select("id", c("best").alias("subject"), F.round("best_score", 6).alias("score"))


@add("unknown_picks", TOP + f" SELECT id FROM t WHERE s1 < {GRAY} AND s1 - s2 < 0.01")
def unknown_picks(s, d):
    t = vectors.nearest_two(unit(s, d), classes(s, d))
    return t.where((c("best_score") < GRAY) & (c("best_score") - c("second_score") < P.SIGNAL)).select("id")


@add("folder_bound", TOP + ", " + R.CTE.removeprefix("WITH ") + f""", f AS (SELECT DISTINCT CAST(label AS VARCHAR) AS name FROM subjects WHERE coalesce(forms, name IS NOT NULL AND has_start)) SELECT t.label AS cluster, count(*) AS members, min(id) AS first FROM t JOIN f ON f.name = t.best WHERE s1 >= {ACCEPT} AND NOT (s2 >= {ACCEPT} AND s1 - s2 < {MARGIN}) GROUP BY t.label""")
def folder_bound(s, d):
    t = vectors.nearest_two(unit(s, d), classes(s, d))
    forming = R.subjects(s, d).where(F.coalesce("forms", c("name").isNotNull() & c("has_start"))).select(c("label").cast("string").alias("best")).distinct()
    good = vectors.verdict(c("best_score"), c("second_score"), ACCEPT, GRAY, MARGIN) == "accept"
    return t.where(good).join(forming, "best", "left_semi").groupBy(c("label").alias("cluster")).agg(F.count("*").alias("members"), F.min("id").alias("first"))


@add("guaranteed_picks", UNIT + ", " + R.CTE.removeprefix("WITH ") + """, g AS (SELECT * FROM u WHERE label IN (SELECT label FROM subjects WHERE coalesce(forms, name IS NOT NULL AND has_start)))
    SELECT label, id FROM (SELECT a.label, a.id, row_number() OVER (PARTITION BY a.label ORDER BY round(sum(list_dot_product(a.v, b.v)), 9) DESC, sha256(CAST(a.id AS VARCHAR))) AS r FROM g a JOIN g b ON a.label = b.label GROUP BY a.label, a.id) WHERE r = 1""")
def guaranteed_picks(s, d):
    """The representative of each cluster whose subject forms a folder of its own."""
    forming = R.subjects(s, d).where(F.coalesce("forms", c("name").isNotNull() & c("has_start"))).select("label").distinct()
    return vectors.medoids(unit(s, d).join(forming, "label", "left_semi"), "label").select("label", "id")


@add("provisional_labels", TOP + """, med AS (SELECT label, id AS rep FROM (SELECT a.label, a.id, row_number() OVER (PARTITION BY a.label ORDER BY round(sum(list_dot_product(a.v, b.v)), 9) DESC, sha256(CAST(a.id AS VARCHAR))) AS r FROM u a JOIN u b ON a.label = b.label GROUP BY a.label, a.id) WHERE r = 1)
    SELECT t.id, CASE WHEN t.id % 10 = 0 THEN 'pending-view' WHEN t.s1 - t.s2 >= 0.05 THEN 'clip-matched:' WHEN med.rep <> t.id AND p.s1 - p.s2 >= 0.05 THEN 'clip-propagated:' ELSE 'unlabeled' END AS state,
      CASE WHEN t.id % 10 = 0 THEN '' WHEN t.s1 - t.s2 >= 0.05 THEN t.best WHEN med.rep <> t.id AND p.s1 - p.s2 >= 0.05 THEN p.best ELSE '' END AS label FROM t JOIN med USING (label) JOIN t p ON p.id = med.rep""")
def provisional_labels(s, d):
    scenes = vectors.nearest_two(unit(s, d), classes(s, d)).select("id", c("label").alias("cluster"), "best", ((c("best_score") - c("second_score")) >= P.CONFIDENT).alias("sure"))
    rep = vectors.medoids(unit(s, d), "label").select(c("label").alias("cluster"), c("id").alias("rep"))
    own = rep.join(scenes.select(c("id").alias("rep"), c("best").alias("rep_best"), c("sure").alias("rep_sure")), "rep")
    rows = scenes.join(small(own), "cluster")
    spread = (c("rep") != c("id")) & c("rep_sure")
    state = F.when(c("id") % 10 == 0, "pending-view").when(c("sure"), "clip-matched:").when(spread, "clip-propagated:").otherwise("unlabeled")
    label = F.when(c("id") % 10 == 0, "").when(c("sure"), c("best")).when(spread, c("rep_best")).otherwise("")
    return rows.select("id", state.alias("state"), label.alias("label"))


@add("identity_suppression", TOP + " SELECT id, best AS subject FROM t WHERE s1 >= 0.25 AND s1 - s2 >= 0.02")
def identity_suppression(s, d):
    t = vectors.nearest_two(unit(s, d), classes(s, d))
    return t.where((c("best_score") >= 0.25) & (c("best_score") - c("second_score") >= P.IDENTITY_MARGIN)).select("id", c("best").alias("subject"))


#: The given vectors drawn towards their label's centre, by three degrees, so that the real bars part them.
PULL = "CASE id % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.5 ELSE 0.3 END"
TIGHT = UNIT + f""", pulled AS (SELECT u.id, u.label, list_transform(list_zip(u.v, m.c), lambda z: z[1] + CAST({PULL} AS DOUBLE) * z[2]) AS v FROM u JOIN m USING (label)),
    tight AS (SELECT id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM pulled)"""


def tight(s, d):
    rows = unit(s, d)
    centres = vectors.mean_vectors(rows, "label").select("label", c("c").alias("centre"))
    pull = F.expr(PULL).cast("double")
    pulled = rows.join(small(centres), "label").withColumn("pull", pull)
    sums = pulled.select("id", "label", F.zip_with("v", "centre", lambda x, y: x + c("pull") * y).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x))
    return sums.withColumn("norm", norm).select("id", "label", F.transform("v", lambda x: x / c("norm")).alias("v"))


@add("sweep_absorb", TIGHT + """, w AS (SELECT a.id, b.label AS into_label, max(list_dot_product(a.v, b.v)) AS s FROM tight a JOIN tight b ON a.id % 2 = 1 AND b.id % 2 = 0 AND a.label % 2 = b.label % 2 GROUP BY a.id, b.label)
    SELECT id, arg_max(into_label, (round(s, 9), -into_label)) AS into_label, round(max(s), 4) AS score FROM w GROUP BY id HAVING max(s) >= 0.85""")
def sweep_absorb(s, d):
    """Drafts that are as alike as SWEEP_TAU to an exemplar of a confirmed subject of their kind, and that subject."""
    rows = tight(s, d).withColumn("kind", c("label") % 2)
    met = vectors.most_alike_label(rows.where("id % 2 = 1"), rows.where("id % 2 = 0"), "kind", "label")
    return met.where(c("cos") >= P.SWEEP_TAU).select("id", c("label").alias("into_label"), F.round("cos", 4).alias("score"))


@add("worst_frames", UNIT + """, q AS (SELECT a.label, a.id, max(list_dot_product(a.v, b.v)) AS s FROM u a JOIN u b ON a.label = b.label AND b.id % 4 = 0 WHERE a.id % 4 <> 0 GROUP BY a.label, a.id)
    SELECT label, id, CAST(r AS INTEGER) AS r FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(s, 9), id) AS r FROM q) WHERE r <= 3""")
def worst_frames(s, d):
    rows = unit(s, d)
    met = vectors.most_alike(rows.where("id % 4 <> 0"), rows.where("id % 4 = 0"), "label")
    placed_rows = rows.select("id", "label").join(met, "id").withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(F.round("cos", 9), "id")))
    return placed_rows.where("r <= 3").select("label", "id", "r")


@add("frames_centroid", UNIT + """, f AS (SELECT u.id, u.label, u.v FROM u JOIN m USING (label) QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(list_dot_product(v, c), 9) DESC, id) <= 5),
    k AS (SELECT label, i, avg(v[i]) AS x FROM f, generate_series(1, 64) t(i) GROUP BY label, i) SELECT label, CAST(i - 1 AS INTEGER) AS i, round(x, 6) AS x FROM k""")
def frames_centroid(s, d):
    """The centre of the frames picked for each cluster: its five members nearest to its centre."""
    rows = unit(s, d)
    frames = vectors.nearest_members(rows, "label", P.EXEMPLARS).select("id")
    return vectors.mean_vectors(rows.join(frames, "id", "left_semi"), "label", renormalise=False).select("label", F.posexplode("c").alias("i", "x")).withColumn("x", F.round("x", 6))


@add("tile_ceiling", R.CTE + """, n AS (SELECT subject_no, count(*) AS reach FROM looks JOIN subjects ON no = subject_no WHERE status = 'draft' GROUP BY subject_no), k AS (SELECT *, row_number() OVER (ORDER BY reach DESC, subject_no) AS r FROM n)
    SELECT kind, count(*) AS tiles, CAST(sum(reach) AS BIGINT) AS files FROM k JOIN subjects ON no = subject_no WHERE r <= 12 GROUP BY kind""")
def tile_ceiling(s, d):
    rows = settled(s, d).where("status = 'draft'").groupBy("subject_no", "kind").agg(F.count("*").alias("reach"))
    return rows.orderBy(F.desc("reach"), "subject_no").limit(P.TILES).groupBy("kind").agg(F.count("*").alias("tiles"), F.sum("reach").alias("files"))


@add("contact_sheets", R.CTE + " SELECT subject_no, sample, CAST(r AS INTEGER) AS r FROM (SELECT *, row_number() OVER (PARTITION BY subject_no ORDER BY t0, sample) AS r FROM (SELECT subject_no, sample, min(ts) AS t0 FROM looks GROUP BY ALL)) WHERE r <= 5")
def contact_sheets(s, d):
    first = R.looks(s, d).groupBy("subject_no", "sample").agg(F.min("ts").alias("at"))
    return first.withColumn("r", F.row_number().over(Window.partitionBy("subject_no").orderBy("at", "sample"))).where("r <= 5").select("subject_no", "sample", "r")


@add("audit_states", R.CTE + """, e AS (SELECT subject_no, CASE WHEN value < 20 THEN 'unconfirmed' WHEN value < 60 THEN 'confirmed' WHEN value < 90 THEN 'absorbed' ELSE 'released' END AS decision, ts, file_no FROM looks)
    SELECT subject_no, arg_max(decision, (ts, file_no)) AS state, count(*) AS decisions, count(*) FILTER (decision = 'unconfirmed') AS undone FROM e GROUP BY subject_no""")
def audit_states(s, d):
    decision = F.when(c("value") < 20, "unconfirmed").when(c("value") < 60, "confirmed").when(c("value") < 90, "absorbed").otherwise("released")
    rows = R.looks(s, d).withColumn("decision", decision)
    return rows.groupBy("subject_no").agg(F.max_by("decision", F.struct("ts", "file_no")).alias("state"), F.count("*").alias("decisions"), F.count_if(c("decision") == "unconfirmed").alias("undone"))


@add("folded_subjects", R.CTE + """, m AS (SELECT no, coalesce(CASE WHEN status = 'merged-into' THEN merged_into END, no) AS into_no FROM subjects) SELECT into_no AS subject_no, count(DISTINCT sample) AS samples, count(*) AS looks FROM looks JOIN m ON no = subject_no GROUP BY into_no""")
def folded_subjects(s, d):
    to = R.subjects(s, d).select(c("no").alias("subject_no"), F.coalesce(F.when(c("status") == "merged-into", c("merged_into")), c("no")).alias("into_no"))
    return R.looks(s, d).join(to, "subject_no").groupBy(c("into_no").alias("subject_no")).agg(F.count_distinct("sample").alias("samples"), F.count("*").alias("looks"))


@add("partitioned_subjects", R.CTE + " SELECT subject_no, sample, CASE WHEN count(DISTINCT batch) > 1 THEN 'contested' ELSE 'group-' || min(batch) END AS part FROM looks GROUP BY subject_no, sample")
def partitioned_subjects(s, d):
    part = F.when(F.count_distinct("batch") > 1, "contested").otherwise(F.concat(F.lit("group-"), F.min("batch").cast("string")))
    return R.looks(s, d).groupBy("subject_no", "sample").agg(part.alias("part"))


@add("released_subjects", R.CTE + """ SELECT subject_id, CASE WHEN status = 'merged-into' THEN 'draft' ELSE status END AS status FROM subjects WHERE merged_into IN (SELECT no FROM subjects WHERE status = 'confirmed') OR status = 'draft'""")
def released_subjects(s, d):
    rows = R.subjects(s, d)
    keepers = rows.where("status = 'confirmed'").select(c("no").alias("merged_into"), F.lit(True).alias("kept"))
    met = rows.join(keepers, "merged_into", "left").where("kept or status = 'draft'")
    return met.select("subject_id", F.when(c("status") == "merged-into", "draft").otherwise(c("status")).alias("status"))
