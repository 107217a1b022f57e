"""Queries of sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.functions import parse
from tidepool.plans import adapters as A
from tidepool.sources import media
from tidepool.streaming import live

c = F.col
QUERIES, SQL = {}, {}


def add(name, sql=None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


@add("manifest_round_trip", A.CTE + "SELECT CAST(file_no AS VARCHAR) AS file_no, file_name, make, CAST(NULL AS VARCHAR) AS software FROM manifest WHERE make <> ''")
def manifest_round_trip(s, d):
    rows = A.manifest(s, d).where("make <> ''").select(c("file_no").cast("string").alias("file_no"), "file_name", "make")
    return media.round_trip(rows, "file_no string, file_name string, make string, software string")


#: First bytes of every kind, in hex; the last ones tell nothing.
HEADS = ("FFD8FFE0", "89504E470D0A1A0A", "474946383761", "474946383961", "524946460000000057454250", "524946460000000041564920", "524946460000000057415645",
         "000000186674797068656963", "00000018667479706D736631", "0000001466747970717420200000", "00000018667479704D345648", "000000186674797069736F6D", "0000001866747970336770350000",
         "0000001C66747970616263640000000069736F6D6D696631", "0000001066747970616263640000000068656963", "000000086D6F6F76", "0000000877696465", "00000018667479", "00")


def coded(names):
    return ", ".join(f"'{n.encode().hex().upper()}'" for n in names)


SNIFF = f"""CASE WHEN starts_with(h, 'FFD8FF') THEN 'JPEG' WHEN starts_with(h, '89504E470D0A1A0A') THEN 'PNG' WHEN substr(h, 1, 12) IN ('474946383761', '474946383961') THEN 'GIF'
    WHEN substr(h, 1, 8) = '52494646' AND substr(h, 17, 8) = '57454250' THEN 'WEBP' WHEN substr(h, 1, 8) = '52494646' AND substr(h, 17, 8) = '41564920' THEN 'AVI'
    WHEN length(h) >= 24 AND substr(h, 9, 8) = '66747970' THEN CASE WHEN substr(h, 17, 8) IN ({coded(parse.HEIF_BRANDS)}) THEN 'HEIC'
      {" ".join(f"WHEN substr(h, 17, 8) IN ({coded(b)}) THEN '{k}'" for k, b in parse.BRANDS.items())}
      WHEN len(list_filter(generate_series(4, least(CAST('0x' || substr(h, 1, 8) AS BIGINT), length(h) // 2) // 4 - 1), lambda i: substr(h, 8 * i + 1, 8) IN ({coded(parse.HEIF_BRANDS)}))) > 0 THEN 'HEIC' END
    WHEN substr(h, 9, 8) IN ({coded(parse.QUICKTIME_ATOMS)}) THEN 'MOV' END"""
LITERAL_HEADS = ", ".join(f"'{h}'" for h in HEADS)


@add("sniff_types", f"SELECT doc_id, {SNIFF} AS sniffed FROM (SELECT doc_id, substr([{LITERAL_HEADS}][doc_id % {len(HEADS)} + 1] || hex(encode(coalesce(text, ''))), 1, {2 * parse.HEAD_BYTES}) AS h FROM documents)")
def sniff_types(s, d):
    head = F.unhex(F.element_at(F.array(*map(F.lit, HEADS)), (c("doc_id") % len(HEADS) + 1).cast("int")))
    content = F.concat(head, F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return A.table(s, d, "documents").select("doc_id", parse.sniff(content).alias("sniffed"))


@add("hash_cache", "SELECT doc_id, sha256(text) AS sha, doc_id % 3 = 0 AS cached FROM documents")
def hash_cache(s, d):
    docs = A.table(s, d, "documents")
    cache = docs.where("doc_id % 3 = 0").select("doc_id", "n_chars", F.sha2("text", 256).alias("old"))
    joined = docs.join(cache, ["doc_id", "n_chars"], "left")
    return joined.select("doc_id", F.coalesce("old", F.sha2("text", 256)).alias("sha"), c("old").isNotNull().alias("cached"))


@add("upsert_state", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def upsert_state(s, d):
    o = A.table(s, d, "orders")
    old, new = o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1")
    both = old.unionByName(new).withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    return both.groupBy("o_custkey").agg(F.max_by("o_orderkey", "at").alias("o_orderkey"))


@add("stream_day_counts", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_day_counts(s, d):
    return live.day_counts(s, d)


@add("stream_sessions", """WITH n AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 43200000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM n) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM r GROUP BY user_id, session
    HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def stream_sessions(s, d):
    return live.live_sessions(s, d)
