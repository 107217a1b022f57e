"""Queries of names inside texts, leaks, and digests of frozen tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.functions import places
from tidepool.operators import constraints, dictionary, digests
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


#: Folder names with the names of parts and suppliers in them, and the dictionary of both.
FOLDERS = """SELECT o_orderkey AS id, replace(CAST(CAST(o_orderdate AS DATE) AS STRING), '-', '') || CASE o_orderkey % 4 WHEN 0 THEN '_walk' WHEN 1 THEN '_' || lower(p_name) || ' trip' WHEN 2 THEN '_Supplier#' || lpad(CAST(o_custkey % 120 AS STRING), 9, '0') || '+' || p_name ELSE '_old ' || upper(p_name) || 's' END AS text
FROM orders JOIN part ON p_partkey = o_custkey % 100"""
NAMES = "SELECT DISTINCT lower(p_name) AS name FROM part UNION SELECT lower(s_name) FROM supplier"


def tables(s, d, text, **names):
    for table in names:
        text = text.replace(f"FROM {table}", f"FROM {{{table}}}").replace(f"JOIN {table}", f"JOIN {{{table}}}")
    return s.sql(text, **{t: A.table(s, d, t) for t in names})


@add("names_in_folders", f"""WITH f AS ({FOLDERS}), n AS ({NAMES}) SELECT id, arg_min(name, (-length(name), position(name IN lower(text)), name)) AS name FROM f JOIN n ON contains(lower(text), name) GROUP BY id""")
def names_in_folders(s, d):
    """The longest name of a part or supplier inside each folder's name, in any case."""
    folders = tables(s, d, FOLDERS, orders=1, part=1).withColumn("text", F.lower("text"))
    return dictionary.longest_in(folders, tables(s, d, NAMES, part=1, supplier=1))


#: Lines that are to be shown, some with the name of a folder or the coordinate of a place, and what they must not hold.
LINES = """SELECT o_orderkey AS id, 'reach: ' || CAST(o_orderkey % 97 AS STRING) || ' files; exemplars: IMG_' || lpad(CAST(o_orderkey % 9999 AS STRING), 4, '0') || '.HEIC' || CASE WHEN o_orderkey % 19 = 0 THEN ' in ' || c_name || '/x' ELSE '' END
  || CASE WHEN o_orderkey % 23 = 0 THEN ' at 25.' || lpad(CAST(o_custkey % 1000 AS STRING), 3, '0') ELSE '' END AS text FROM orders JOIN customer ON c_custkey = o_custkey"""
SECRETS = """SELECT 'folder' AS kind, c_name AS name FROM customer WHERE length(c_name) >= 3 UNION SELECT 'place', '25.' || lpad(CAST(c_custkey % 100 AS STRING), 2, '0') FROM customer WHERE c_custkey % 7 = 0 UNION SELECT 'place', '25.' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') FROM customer WHERE c_custkey % 7 = 0"""


@add("leaks_in_lines", f"WITH l AS ({LINES}), n AS ({SECRETS}) SELECT DISTINCT id, kind, name FROM l JOIN n ON contains(text, name)")
def leaks_in_lines(s, d):
    """Names of folders and coordinates that a line would give away; a caller refuses if there is any."""
    secrets = tables(s, d, SECRETS, customer=1)
    found = dictionary.found_in(tables(s, d, LINES, orders=1, customer=1), secrets.select("name"))
    return found.select("id", "name").distinct().join(secrets, "name").select("id", "kind", "name")


ROWS = "SELECT o_orderpriority || substr(CAST(o_orderdate AS STRING), 1, 4) AS part, o_orderkey, o_custkey, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders"
LATER = """SELECT CASE WHEN o_orderkey % 3001 = 7 THEN 'moved' ELSE part END AS part, o_orderkey, o_custkey, CASE WHEN o_orderkey % 2003 = 5 THEN NULL ELSE o_orderstatus END AS o_orderstatus, cents FROM {rows} WHERE part NOT LIKE '2-HIGH1994'"""


def sealed(rows, part="part"):
    texts = [f"coalesce(length(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')" for x in ("cents", "o_custkey", "o_orderkey", "o_orderstatus")]
    lanes = [f"sum(CAST('0x' || substr(h, {1 + 16 * k}, 15) AS BIGINT))" for k in range(4)]
    return f"SELECT part, count(*) AS rows, sha256(concat_ws(':', count(*), {', '.join(lanes)})) AS digest FROM (SELECT part, sha256(concat_ws('|', {', '.join(texts)})) AS h FROM ({rows})) GROUP BY part"


def orders(s, d):
    return tables(s, d, ROWS, orders=1)


@add("table_digests", f"SELECT part, rows, digest FROM ({sealed(ROWS)})")
def table_digests(s, d):
    """Content digest of each part of the orders, whatever the order of rows and their partitions."""
    return digests.part_digests(orders(s, d), "part")


@add("freeze_validity", f"""WITH a AS ({sealed(ROWS)}), b AS ({sealed(LATER.replace("{rows}", f"({ROWS})"))})
    SELECT coalesce(a.part, b.part) AS part, CASE WHEN b.part IS NULL THEN 'gone' WHEN a.part IS NULL THEN 'new' ELSE 'changed' END AS problem FROM a FULL JOIN b ON a.part = b.part WHERE a.digest IS DISTINCT FROM b.digest""")
def freeze_validity(s, d):
    """What changed since the orders were frozen: rows moved to another part, a value gone, a part gone."""
    rows = orders(s, d)
    later = s.sql(LATER, rows=rows)
    return digests.freeze_problems(digests.part_digests(rows, "part"), digests.part_digests(later, "part"), "part")


#: The files and folders of an index: routes that are settled or not, folders that are live or not, names of every kind.
INDEX_FILES = """SELECT event_id AS file_no, user_id % 90 AS folder, CASE event_id % 5 WHEN 0 THEN 'skip_dupe' WHEN 1 THEN 'merge' ELSE 'copy' END AS route,
  CASE WHEN event_id % 41 = 0 THEN 'open' WHEN event_id % 37 = 1 THEN 'settled:no-plan' WHEN event_id % 53 = 2 THEN NULL ELSE 'settled:plan' END AS route_source, CASE WHEN event_id % 13 = 7 THEN 'gone' ELSE 'present' END AS status, CASE WHEN event_id % 3 > 0 THEN user_id % 12 END AS batch FROM events"""
INDEX_FOLDERS = """SELECT c_custkey AS folder, CASE c_custkey % 12 WHEN 0 THEN NULL WHEN 1 THEN '20240105_a/b' WHEN 2 THEN '20240106_walk .' WHEN 3 THEN '20240107_25.1234,121.5' WHEN 4 THEN '20240108_lake 12巷+x' WHEN 5 THEN '2024-01_lake' WHEN 6 THEN '20240110-12_lake' WHEN 7 THEN '20240111' WHEN 8 THEN '202401_check'
    ELSE '202401' || lpad(CAST(10 + c_custkey % 19 AS STRING), 2, '0') || '_' || c_mktsegment END AS name, CASE WHEN c_custkey % 17 = 5 THEN 'empty' WHEN c_custkey % 19 = 3 THEN 'merged' ELSE 'live' END AS status, c_custkey % 5 <> 3 AS place_known, c_custkey % 24 = 4 AS own_label FROM customer"""


def address(name):
    return f"list_bool_or([regexp_matches(p, '[0-9０-９]+\\s*[巷弄號段]') OR p LIKE '%巷' OR p LIKE '%弄' OR p LIKE '%號' FOR p IN string_split_regex(substr({name}, position('_' IN {name}) + 1), '[_+]')])"


FOLDER_RULES = {
    "no-name": ("problem", "name IS NULL"),
    "unusable": ("problem", "contains(name, '/') OR trim(name, ' .') <> name"),
    "coordinate": ("problem", "regexp_matches(name, '[0-9]{1,3}[.][0-9]{3,}')"),
    "address": ("problem", f"{address('name')} AND NOT own_label"),
    "own-address": ("warning", f"{address('name')} AND own_label"),
    "grammar": ("problem", "NOT regexp_matches(name, '^[0-9]{6}([0-9]{2}(-[0-9]{2}([0-9]{2})?)?)?(_|$)')"),
    "old-date-form": ("warning", "regexp_matches(name, '^[0-9]{8}-[0-9]{2}(_|$)') OR regexp_matches(name, '^[0-9]{6}_')"),
    "no-where": ("problem", "place_known AND regexp_matches(name, '^[0-9]{8}(-[0-9]{4})?$')"),
}
FILE_RULES = {
    "unsettled": ("problem", "NOT starts_with(coalesce(route_source, ''), 'settled:')"),
    "homeless": ("problem", "route IN ('copy', 'merge') AND NOT live"),
    "not-reached": ("problem", "route_source = 'settled:no-plan' AND batch IS NOT NULL"),
    "planless": ("warning", "route_source = 'settled:no-plan' AND batch IS NULL"),
}
RULES_SQL = " UNION ALL ".join(
    [f"SELECT 'folder' AS what, CAST(folder AS VARCHAR) AS key, '{n}' AS rule, '{s}' AS severity FROM d WHERE {w}" for n, (s, w) in FOLDER_RULES.items()]
    + [f"SELECT 'file', CAST(file_no AS VARCHAR), '{n}', '{s}' FROM f WHERE {w}" for n, (s, w) in FILE_RULES.items()]
)
INDEX_SQL = f"WITH d0 AS ({INDEX_FOLDERS}), d AS (SELECT * FROM d0 WHERE status = 'live'), f AS (SELECT f.*, d.folder IS NOT NULL AS live FROM ({INDEX_FILES}) f LEFT JOIN d ON d.folder = f.folder WHERE f.status = 'present')"


def index_problems(s, d):
    """what, key, rule and severity of everything that keeps an index from being copied: one pass over the files and one over
    the folders, whose numbers alone meet the files."""
    folders = tables(s, d, INDEX_FOLDERS, customer=1).where("status = 'live'")
    alive = folders.select("folder", F.lit(True).alias("live"))
    files = tables(s, d, INDEX_FILES, events=1).where("status = 'present'").join(alive, "folder", "left").withColumn("live", F.coalesce("live", F.lit(False)))
    n, rule = c("name"), constraints.Rule
    pieces = F.split(F.substring(n, F.locate("_", n) + 1, F.length(n)), "[_+]")
    addressed = F.exists(pieces, places.is_address)
    of_folders = [
        rule("no-name", constraints.PROBLEM, n.isNull()),
        rule("unusable", constraints.PROBLEM, n.contains("/") | (F.trim(n, F.lit(" .")) != n)),
        rule("coordinate", constraints.PROBLEM, n.rlike("[0-9]{1,3}[.][0-9]{3,}")),
        rule("address", constraints.PROBLEM, addressed & ~c("own_label")),
        rule("own-address", constraints.WARNING, addressed & c("own_label")),
        rule("grammar", constraints.PROBLEM, ~n.rlike("^[0-9]{6}([0-9]{2}(-[0-9]{2}([0-9]{2})?)?)?(_|$)")),
        rule("old-date-form", constraints.WARNING, n.rlike("^[0-9]{8}-[0-9]{2}(_|$)|^[0-9]{6}_")),
        rule("no-where", constraints.PROBLEM, c("place_known") & n.rlike("^[0-9]{8}(-[0-9]{4})?$")),
    ]
    planless = c("route_source") == "settled:no-plan"
    of_files = [
        rule("unsettled", constraints.PROBLEM, ~F.coalesce("route_source", F.lit("")).startswith("settled:")),
        rule("homeless", constraints.PROBLEM, c("route").isin("copy", "merge") & ~c("live")),
        rule("not-reached", constraints.PROBLEM, planless & c("batch").isNotNull()),
        rule("planless", constraints.WARNING, planless & c("batch").isNull()),
    ]
    found = constraints.broken(folders, c("folder"), of_folders).withColumn("what", F.lit("folder"))
    return found.unionByName(constraints.broken(files, c("file_no"), of_files).withColumn("what", F.lit("file"))).select("what", "key", "rule", "severity")


@add("index_check", f"{INDEX_SQL} {RULES_SQL}")
def index_check(s, d):
    return index_problems(s, d)


@add("plan_name_summary", f"{INDEX_SQL}, r AS ({RULES_SQL}) SELECT CAST(d.folder AS VARCHAR) AS key, count(r.key) FILTER (severity = 'problem') AS problems, count(r.key) FILTER (severity = 'warning') AS warnings, count(r.key) FILTER (severity = 'problem') = 0 AS passes FROM d LEFT JOIN r ON r.what = 'folder' AND r.key = CAST(d.folder AS VARCHAR) GROUP BY d.folder")
def plan_name_summary(s, d):
    """How many problems and warnings each live folder's name has, and whether it passes."""
    folders = tables(s, d, INDEX_FOLDERS, customer=1).where("status = 'live'").select(c("folder").alias("key"))
    return constraints.verdict(index_problems(s, d).where("what = 'folder'"), folders)
