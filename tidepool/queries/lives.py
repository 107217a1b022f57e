"""Queries of the registry as an event log, and of what its subjects show."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidepool.operators import joins, lifecycle
from tidepool.operators.memory import Memory
from tidepool.plans import adapters as A
from tidepool.plans import archive as R
from tidepool.plans.stored import shared_dir
from tidepool.streaming import rounds

c = F.col
QUERIES, SQL = {}, {}


def add(name, sql=None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


#: Decisions about some forty subjects of each of ten packs, from the events.
LOG = """SELECT event_id AS seq, CAST(user_id % 10 AS INT) AS pack,
  element_at(array('draft', 'draft', 'draft', 'confirm', 'confirm', 'add', 'add', 'add', 'sweep', 'sweep', 'fold', 'release', 'unconfirm', 'reject', 'revive', 'split'), CAST(event_id % 16 AS INT) + 1) AS verb,
  CAST(round(value * 100) AS BIGINT) % 41 AS subject, CASE WHEN event_id % 16 BETWEEN 8 AND 10 THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 41 END AS other,
  CASE WHEN event_id % 16 IN (3, 4) OR event_id % 32 = 10 THEN concat('name ', event_id % 23) END AS name, element_at(array('cat', 'dog'), CAST(round(value * 100) AS INT) % 2 + 1) AS kind, event_id % 9 AS files,
  event_id AS ref, array(CAST(event_id % 7 AS DOUBLE), CAST(event_id % 11 AS DOUBLE), CAST(event_id % 13 AS DOUBLE), CAST(1 AS DOUBLE)) AS v,
  CASE WHEN event_id % 16 = 15 THEN transform(sequence(1, CAST(event_id % 4 AS INT) + 1), i -> 1000 + 10 * event_id + i) END AS children
FROM {t}"""


def log(s, d):
    return s.sql(LOG, t=A.table(s, d, "events"))


#: Exemplars that a subject of these small logs keeps.
CAP = 4


@add("registry_states")
def registry_states(s, d):
    """Every subject after its log: status, names, tombstone, what it absorbed, exemplars."""
    rows = lifecycle.replay(log(s, d), "pack", CAP).where("what = 'state'")
    joined = lambda x: F.array_join(F.transform(x, lambda i: i.cast("string")), ",")
    lists = [joined(c(n)).alias(n) for n in ("exemplars", "absorbed", "split_into")]
    return rows.select("pack", "subject", "status", "kind", "name", F.array_join("previous_names", ",").alias("previous_names"), "merged_into", "absorbed_by", "reopened", "files", *lists)


@add("registry_audit")
def registry_audit(s, d):
    """Every decision with what it moved, refused ones with their reason."""
    return lifecycle.replay(log(s, d), "pack", CAP).where("what = 'audit'").select("pack", "seq", "subject", "decision", "reason", F.array_join(F.transform("moved", lambda i: i.cast("string")), ",").alias("moved"))


@add("registry_files")
def registry_files(s, d):
    return lifecycle.shown_files(lifecycle.replay(log(s, d), "pack", CAP).where("what = 'state'"), "pack")


MERGED = """(SELECT *, CASE WHEN status = 'merged-into' THEN merged_into WHEN status = 'draft' AND no % 4 = 1 AND no > 3 THEN CAST(floor(no / 3) AS BIGINT) END AS goes_to FROM subjects)"""


@add("display_files", R.CTE.replace("WITH", "WITH RECURSIVE", 1) + f""", walk(no, root) AS (SELECT no, no FROM subjects UNION ALL SELECT walk.no, m.goes_to FROM walk JOIN {MERGED} m ON m.no = walk.root WHERE m.goes_to IS NOT NULL),
    ends AS (SELECT walk.no, walk.root FROM walk LEFT JOIN {MERGED} m ON m.no = walk.root WHERE m.goes_to IS NULL)
    SELECT 'subj-' || lpad(CAST(root AS VARCHAR), 4, '0') AS subject_id, CAST(sum(files) AS BIGINT) AS shown, CAST(sum(ungated) AS BIGINT) AS ungated, count(*) AS records FROM ends JOIN subjects USING (no) WHERE root IN (SELECT no FROM subjects) GROUP BY root""")
def display_files(s, d):
    """What a subject shows: its files and those of everything merged into it or absorbed by it, along chains of any
    length; a chain that runs in a loop is an error."""
    rows = R.subjects(s, d)
    to = F.when(c("status") == "merged-into", c("merged_into")).when((c("status") == "draft") & (c("no") % 4 == 1) & (c("no") > 3), F.floor(c("no") / 3))
    links = rows.select(c("no").cast("long").alias("id"), to.cast("long").alias("target")).where("target is not null")
    ends = joins.resolve_aliases(links).withColumnRenamed("id", "no")
    summed = rows.join(ends, "no", "left").withColumn("root", F.coalesce("root", "no")).groupBy("root").agg(F.sum("files").alias("shown"), F.sum("ungated").alias("ungated"), F.count("*").alias("records"))
    return rows.select(c("no").alias("root"), "subject_id").join(summed, "root").select("subject_id", "shown", "ungated", "records")


#: A checkpoint a dump and day: the subjects of its events, those that were reopened, and the end of the dump.
CHECKPOINTS = """SELECT user_id AS dump, CAST(dayofmonth(ts) AS BIGINT) AS checkpoint, {set}(CAST(round(value * 100) AS BIGINT) % 37) AS tiles,
  {set}(CASE WHEN value < 15 THEN CAST(round(value * 100) AS BIGINT) % 37 END) AS reopened, max(dayofmonth(ts)) >= 29 OR (max(dayofmonth(ts)) = 17 AND user_id % 5 = 0) AS final FROM {events} GROUP BY user_id, dayofmonth(ts)"""


def checkpoints(s, d):
    return s.sql(CHECKPOINTS.replace("{set}", "collect_set"), events=A.table(s, d, "events"))


ROUNDS = f"""WITH RECURSIVE k AS ({CHECKPOINTS.replace("{events}", "events").replace("{set}(CASE", "list(DISTINCT CASE").replace("{set}(", "list(DISTINCT ")}),
    o AS MATERIALIZED (SELECT dump, checkpoint, tiles, list_filter(reopened, lambda x: x IS NOT NULL) AS reopened, final, row_number() OVER (PARTITION BY dump ORDER BY checkpoint) AS n FROM k),
    w(dump, n, fired, seen, ended, checkpoint, fire, why, round, new, waiting) AS (
      SELECT DISTINCT dump, 0::BIGINT, 0, []::BIGINT[], false, NULL::BIGINT, NULL::BOOLEAN, NULL::VARCHAR, 0, 0::BIGINT, 0::BIGINT FROM o
      UNION ALL SELECT dump, n, fired + CASE WHEN fire AND NOT last THEN 1 ELSE 0 END, CASE WHEN fire THEN list_distinct(list_concat(seen, tiles)) ELSE seen END, ended OR last, checkpoint, fire,
        CASE WHEN last THEN 'final' WHEN new >= 3 AND fired >= 2 THEN 'cap' ELSE 'floor' END, fired + 1, new, len(tiles)
      FROM (SELECT *, last OR (new >= 3 AND fired < 2) AS fire FROM (SELECT o.dump, o.n, w.fired, w.seen, w.ended, o.checkpoint, o.tiles, o.final AND NOT w.ended AS last,
        len(list_filter(o.tiles, lambda x: NOT list_contains(w.seen, x) OR list_contains(o.reopened, x))) AS new FROM w JOIN o ON o.dump = w.dump AND o.n = w.n + 1)))
    SELECT dump, checkpoint, fire, why, round, new, waiting FROM w WHERE n > 0"""


@add("question_rounds", ROUNDS)
def question_rounds(s, d):
    """Which checkpoints of each dump ask, and why the others don't."""
    return rounds.gate(checkpoints(s, d))


@add("stream_question_rounds", ROUNDS)
def stream_question_rounds(s, d):
    """The same as a stream, taken up again twice from its stored state."""
    return rounds.streamed(checkpoints(s, d))


#: Looks at the vectors: their subject is their label's, some were not viewed, can't be shown, or have no length.
SEEN = """SELECT vec_id AS seq, CAST(label AS BIGINT) AS subject, vec_id AS ref, transform(embedding, x -> CAST(CASE WHEN vec_id % 29 = 3 THEN 0 ELSE x END AS DOUBLE)) AS v,
  CASE WHEN vec_id % 6 = 5 THEN 'clip-matched:' ELSE 'viewed-image:' END AS provenance, concat('s', vec_id % 50) AS sample FROM {t}"""
STATUS = "SELECT CAST(no AS BIGINT) AS subject, CASE WHEN no % 10 = 7 THEN 'merged-into' WHEN no % 10 = 8 THEN 'draft' ELSE 'confirmed' END AS status FROM (SELECT s_suppkey AS no FROM supplier) s WHERE no < 10 AND no <> 6"


def memorised(s, d):
    """The memory after two runs, of the even and the odd looks, the first of which is repeated."""
    seen = s.sql(SEEN, t=A.table(s, d, "embeddings"))
    subjects = s.sql(STATUS.replace("FROM supplier", "FROM {t}"), t=A.table(s, d, "supplier"))
    proofs = seen.where("seq % 11 <> 4").select("sample", "ref")
    taken_out = seen.where("seq % 13 = 6").select("subject", "ref")
    memory = Memory(s, f"{shared_dir(s)}/memory-{uuid.uuid4().hex}", cap=6)
    for run, half in (("even", 0), ("odd", 1), ("even", 0)):
        memory.remember(run, seen.where(f"seq % 2 = {half}"), subjects, proofs, taken_out)
    return memory


@add("memorise_audit", f"""WITH n AS (SELECT vec_id AS seq, CAST(label AS BIGINT) AS subject, status FROM embeddings LEFT JOIN ({STATUS}) t ON t.subject = label)
    SELECT CASE WHEN seq % 2 = 0 THEN 'even' ELSE 'odd' END AS run, seq, subject, CASE WHEN gate IS NULL THEN 'memorized' ELSE 'refused' END AS decision, gate FROM (SELECT *, CASE WHEN seq % 6 = 5 THEN 'provenance' WHEN seq % 11 = 4 THEN 'evidence' WHEN status IS NULL THEN 'subject'
      WHEN status = 'merged-into' THEN 'merged-into' WHEN status <> 'confirmed' THEN 'unconfirmed' WHEN seq % 13 = 6 THEN 'not-this' WHEN seq % 29 = 3 THEN 'vector' END AS gate FROM n)""")
def memorise_audit(s, d):
    """Every attempt to add an exemplar, with the gate that refused it."""
    return memorised(s, d).audit().select("run", "seq", "subject", "decision", "gate")


@add("memorised_exemplars")
def memorised_exemplars(s, d):
    """The exemplars that each subject keeps."""
    return memorised(s, d).exemplars().select("subject", "ref")
