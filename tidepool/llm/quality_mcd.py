"""Quality rules: minimum-covariance-determinant outliers per language and source.

Base statistics come from the whole text; their smoothed logarithms form a vector.
Each group (a language and source with enough rows, else the language's small
sources together, else all that is left) gets a robust location and scatter: from
two starts (all rows; rows below the group's means in every repetition and symbol
statistic) concentration steps re-estimate mean and covariance over the
three quarters of the rows with the smallest Mahalanobis distances, and the start
that ends with the smaller determinant wins. A document whose distance exceeds
the cut-off is rejected.

All of it is DataFrame expressions. Distances are ranked through a histogram of
their logarithms, so a group of any size is only counted and summed, never
gathered, and equal distances stay together. Scatter has a floor that widens as
rows get fewer, so constant statistics and small groups are no obstacle.

Defined results: null text has no words and fails the base rules; a null language
or source counts as an empty one; documents that fail the base rules don't take
part in the estimates; groups of one row have the floor as their scatter;
repeated rows count each time; an empty table gives an empty result; extra
columns are kept by keep_good and ignored by verdicts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, quoted

BLANKS = r"[ \t\n\x0B\f\r]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Words that smooth the ratios of short texts, and their mean length.
PRIOR_WORDS = 50
PRIOR_LENGTH = 5
#: Least standard deviation of each statistic.
FLOORS = (0.05, 0.4, 0.4, 0.4)
#: Rows a language and source (or a language's rest) needs for its own estimate: its subset then holds twice as many
#: rows as there are statistics. The floor counts as RIDGE_ROWS rows, so estimates from few rows are wide.
MIN_GROUP = 11
RIDGE_ROWS = 15
SUBSET = 0.75
#: Makes the scatter of the central 75 % of a normal sample in 4 dimensions consistent.
CONSISTENCY = 1.4866
STEPS = 3
#: Chi-square of 4 degrees of freedom, tail of about 5e-6.
CUTOFF = 30.0
BINS = 16
#: Estimates up to this many rows are broadcast; beyond it the join shuffles.
BROADCAST_GROUPS = 20_000

STATS = ("y1", "y2", "y3", "y4")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
PAIRS = [(i, j) for i in range(4) for j in range(i + 1)]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: Column) -> Column:
    """Words in windows that are found twice or more."""

    def covered(windows: Column) -> Column:
        ranked = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
        twice = lambda s: F.filter(
            s, lambda x, j: ((j > 0) & (F.get(s, j - 1)["w"] == x["w"])) | F.coalesce(F.get(s, j + 1)["w"] == x["w"], F.lit(False))
        )
        places = let(ranked, lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"])))
        widths = let(places, lambda p: F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)))))
        return F.aggregate(widths, F.lit(0), lambda a, x: a + x)

    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
    windows = F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(WINDOW)]))
    counted = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(counted)


def base_counts(text: Column) -> Column:
    """Struct of the base statistics of a text."""
    text = F.coalesce(text, F.lit(""))
    bare = F.translate(text, " \t\n\x0b\f\r", "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\f\r", "")) > 0)
    words = F.array_remove(F.split(text, BLANKS), "")
    found = let(words, lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("r")))
    return F.struct(
        found["n"].cast("long").alias("n_words"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        found["r"].cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def vector() -> list[Column]:
    smooth = F.col("n_words") + F.lit(PRIOR_WORDS)
    return [
        F.log((F.col("word_chars") + F.lit(PRIOR_WORDS * PRIOR_LENGTH)) / smooth).alias("y1"),
        F.log(1 + PRIOR_WORDS * F.col("n_symbols") / smooth).alias("y2"),
        F.log(1 + F.col("n_dup_lines").cast("double")).alias("y3"),
        F.log(1 + PRIOR_WORDS * F.col("n_repeat_words") / smooth).alias("y4"),
    ]


def estimates(rows: DataFrame, keys: list[str], widen: float) -> DataFrame:
    """Mean, Cholesky factor of the scatter and its log-determinant of each group."""
    moments = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *[F.avg(y).alias(f"m{i}") for i, y in enumerate(STATS)],
        *[F.covar_pop(STATS[i], STATS[j]).alias(f"c{i}{j}") for i, j in PAIRS],
    )
    for i, j in PAIRS:
        c = F.col(f"c{i}{j}") * widen
        if i == j:
            c = c + FLOORS[i] ** 2 * (1 + RIDGE_ROWS / F.col("n"))
        for k in range(j):
            c = c - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        moments = moments.withColumn(f"l{i}{j}", F.sqrt(c) if i == j else c / F.col(f"l{j}{j}"))
    logdet = sum((F.log(f"l{i}{i}") for i in range(4)), F.lit(0.0))
    return moments.select(*keys, *[f"m{i}" for i in range(4)], *[f"l{i}{j}" for i, j in PAIRS], logdet.alias("logdet"))


def with_distance(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """rows with d2, the squared Mahalanobis distance to their group's estimate."""
    small = found.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    joined = rows.join(F.broadcast(found) if small else found, keys)
    total = F.lit(0.0)
    for i in range(4):
        z = F.col(STATS[i]) - F.col(f"m{i}")
        for k in range(i):
            z = z - F.col(f"l{i}{k}") * F.col(f"z{k}")
        joined = joined.withColumn(f"z{i}", z / F.col(f"l{i}{i}"))
        total = total + F.col(f"z{i}") * F.col(f"z{i}")
    return joined.select(*rows.columns, total.alias("d2"))


def group_keys(counts: DataFrame) -> DataFrame:
    """(lang, source) -> group (g_lang, g_source) for each pair in counts (lang, source, n)."""
    by_lang = counts.where(F.col("n") < MIN_GROUP).groupBy("lang").agg(F.sum("n").alias("rest"))
    return counts.join(by_lang, "lang", "left").select(
        "lang",
        "source",
        F.when((F.col("n") >= MIN_GROUP) | (F.col("rest") >= MIN_GROUP), F.col("lang")).otherwise("*").alias("g_lang"),
        F.when(F.col("n") >= MIN_GROUP, F.col("source")).otherwise("*").alias("g_source"),
    )


def concentrate(rows: DataFrame, found: DataFrame) -> DataFrame:
    """One concentration step: estimates over the nearest rows of each group."""
    keys = ["g_lang", "g_source", "start"]
    near = with_distance(rows, found, keys).withColumn("bin", F.floor(BINS * F.log2(1 + F.col("d2"))).cast("int"))
    table = near.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    upto = table.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w))
    cut = upto.where(F.col("upto") >= SUBSET * F.col("total")).groupBy(*keys).agg(F.min("bin").alias("cut"))
    small = cut.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    subset = near.join(F.broadcast(cut) if small else cut, keys).where(F.col("bin") <= F.col("cut"))
    return estimates(subset, keys, CONSISTENCY)


def fit(stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(group of each language and source, estimate of each group) from a stored
    table with lang, source (not null) and the base statistics."""
    good = stats.where(~base_failed())
    counts = good.groupBy("lang", "source").agg(F.count("*").alias("n"))
    groups = materialize(group_keys(counts), "mcd-groups")
    small = groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    rows = good.select("lang", "source", *vector()).join(F.broadcast(groups) if small else groups, ["lang", "source"]).select("g_lang", "g_source", *STATS)
    rows = materialize(rows, "mcd-rows")
    keys = ["g_lang", "g_source"]
    all_rows = estimates(rows, keys, 1.0)
    means = all_rows.select(*keys, *[F.col(f"m{i}").alias(f"mean{i}") for i in range(1, 4)])
    low = rows.join(F.broadcast(means) if means.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else means, keys).where("y2 <= mean1 and y3 <= mean2 and y4 <= mean3")
    low_rows = estimates(low, keys, CONSISTENCY)
    now = materialize(all_rows.withColumn("start", F.lit(0)).unionByName(low_rows.withColumn("start", F.lit(1))), "mcd-start")
    both = rows.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    for _ in range(STEPS):
        now = materialize(concentrate(both, now), "mcd-step")
    best = Window.partitionBy(*keys).orderBy(F.round("logdet", 9), "start")
    return groups, now.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r", "start")


def judged(stats: DataFrame, keep: list[str]) -> DataFrame:
    """keep columns, base_failed, distance and kept of each row of a stored table."""
    groups, found = fit(stats)
    model = materialize(groups.join(found, ["g_lang", "g_source"]).drop("g_lang", "g_source"), "mcd-model")
    failed = stats.where(base_failed()).select(*keep, F.lit(True).alias("base_failed"), F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    rows = stats.where(~base_failed()).select(*keep, *[c for c in ("lang", "source") if c not in keep], *vector())
    scored = with_distance(rows, model, ["lang", "source"])
    verdict = F.coalesce(F.col("d2") <= CUTOFF, F.lit(False))
    return failed.unionByName(scored.select(*keep, F.lit(False).alias("base_failed"), F.col("d2").alias("distance"), verdict.alias("kept")))


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed, distance and kept of each document."""
    stats = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), base_counts(F.col("text")).alias("s")
    ).select("doc_id", "lang", "source", "s.*")
    return judged(materialize(stats, "quality"), ["doc_id", *COUNTS])


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, with all their columns."""
    stats = docs.select(
        F.struct(*quoted(docs.columns)).alias("doc"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), base_counts(F.col("text")).alias("s")
    ).select("doc", "lang", "source", "s.*")
    return judged(materialize(stats, "quality"), ["doc"]).where("kept").select("doc.*")


def oracle_sql() -> str:
    """The same estimates in SQL."""

    def chol(rows: str, keys: str, widen: float) -> str:
        parts = []
        for i, j in PAIRS:
            c = f"c{i}{j} * {widen!r}::DOUBLE" + (f" + {FLOORS[i] ** 2!r}::DOUBLE * (1 + {RIDGE_ROWS}::DOUBLE / n)" if i == j else "")
            c += "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            parts.append((f"sqrt({c})" if i == j else f"({c}) / l{j}{j}") + f" AS l{i}{j}")
        moments = ", ".join(["count(*) AS n"] + [f"avg({y}) AS m{i}" for i, y in enumerate(STATS)] + [f"covar_pop({STATS[i]}, {STATS[j]}) AS c{i}{j}" for i, j in PAIRS])
        return f"SELECT *, {', '.join(parts)}, ln(l00) + ln(l11) + ln(l22) + ln(l33) AS logdet FROM (SELECT {keys}, {moments} FROM {rows} GROUP BY {keys})"

    def dist(rows: str, est: str, on: str) -> str:
        zs = []
        for i in range(4):
            zs.append(f"({STATS[i]} - m{i}" + "".join(f" - l{i}{k} * z{k}" for k in range(i)) + f") / l{i}{i} AS z{i}")
        return f"SELECT *, z0 * z0 + z1 * z1 + z2 * z2 + z3 * z3 AS d2 FROM (SELECT r.*, {', '.join(zs)} FROM {rows} r JOIN {est} e USING ({on}))"

    keys = "g_lang, g_source, start"
    steps = ""
    for s in range(STEPS):
        steps += f"""
        near{s} AS MATERIALIZED (SELECT *, CAST(floor({BINS} * log2(1 + d2)) AS INTEGER) AS bin FROM ({dist("both_starts", f"est{s}", keys)})),
        cut{s} AS (
            SELECT {keys}, min(bin) AS cut FROM (
                SELECT {keys}, bin, sum(count(*)) OVER (PARTITION BY {keys} ORDER BY bin) AS upto, sum(count(*)) OVER (PARTITION BY {keys}) AS total
                FROM near{s} GROUP BY {keys}, bin)
            WHERE upto >= {SUBSET} * total GROUP BY {keys}),
        sub{s} AS (SELECT n.* FROM near{s} n JOIN cut{s} USING ({keys}) WHERE bin <= cut),
        est{s + 1} AS MATERIALIZED ({chol(f"sub{s}", keys, CONSISTENCY)}),"""
    blanks = r"[ \t\n\x0B\f\r]+"
    return f"""
    WITH w AS MATERIALIZED (
        SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text,
               list_filter(string_split_regex(coalesce(text, ''), '{blanks}'), lambda x: x <> '') AS words,
               list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS lines
        FROM documents),
        win AS (
            SELECT doc_id, i, array_to_string(list_slice(words, i, i + {WINDOW - 1}), ' ') AS g
            FROM w, unnest(generate_series(1, len(words) - {WINDOW - 1})) AS t(i)),
        twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
        rep AS (
            SELECT doc_id, sum(width) AS n FROM (
                SELECT doc_id, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, {WINDOW})) AS width FROM twice)
            GROUP BY doc_id),
        stats AS MATERIALIZED (
            SELECT w.doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
                   CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
                   CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
                   CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                   CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
            FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
        good AS MATERIALIZED (
            SELECT *, ln((word_chars + {PRIOR_WORDS * PRIOR_LENGTH}) / (n_words + {PRIOR_WORDS})) AS y1,
                   ln(1 + {PRIOR_WORDS} * n_symbols / (n_words + {PRIOR_WORDS})) AS y2,
                   ln(1 + CAST(n_dup_lines AS DOUBLE)) AS y3,
                   ln(1 + {PRIOR_WORDS} * n_repeat_words / (n_words + {PRIOR_WORDS})) AS y4
            FROM stats WHERE n_words >= {MIN_WORDS} AND 100 * n_repeat_words <= {MAX_REPEAT_PERCENT} * n_words),
        counts AS (SELECT lang, source, count(*) AS n FROM good GROUP BY lang, source),
        rest AS (SELECT lang, sum(n) AS rest FROM counts WHERE n < {MIN_GROUP} GROUP BY lang),
        groups AS MATERIALIZED (
            SELECT lang, source, CASE WHEN n >= {MIN_GROUP} OR rest >= {MIN_GROUP} THEN lang ELSE '*' END AS g_lang,
                   CASE WHEN n >= {MIN_GROUP} THEN source ELSE '*' END AS g_source
            FROM counts LEFT JOIN rest USING (lang)),
        in_group AS MATERIALIZED (SELECT * FROM good JOIN groups USING (lang, source)),
        all_est AS MATERIALIZED ({chol("in_group", "g_lang, g_source", 1.0)}),
        low AS (
            SELECT r.* FROM in_group r JOIN all_est e USING (g_lang, g_source) WHERE y2 <= m1 AND y3 <= m2 AND y4 <= m3),
        est0 AS MATERIALIZED (
            SELECT *, 0 AS start FROM all_est UNION ALL BY NAME SELECT *, 1 AS start FROM ({chol("low", "g_lang, g_source", CONSISTENCY)})),
        both_starts AS MATERIALIZED (SELECT * FROM in_group, (VALUES (0), (1)) t(start)),{steps}
        model AS (
            SELECT * FROM est{STEPS} QUALIFY row_number() OVER (PARTITION BY g_lang, g_source ORDER BY round(logdet, 9), start) = 1),
        scored AS ({dist("in_group", "model", "g_lang, g_source")})
    SELECT s.doc_id, s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words,
           scored.doc_id IS NULL AS base_failed, coalesce(d2 <= {CUTOFF}, false) AS kept
    FROM stats s LEFT JOIN scored ON s.doc_id = scored.doc_id
    """
