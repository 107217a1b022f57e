"""Ordered classification cascades over manifest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool import params as P
from tidepool.functions import parse
from tidepool.plans.stored import small

OWN_MAKES = ("apple", "samsung")
SCREENS = ((1170, 2532), (1080, 2400))
LONG_EDGES = (1280, 1600, 2048)
MESSENGER = r"(?i)^(IMG-\d{8}-WA|mmexport|signal-)"
SCREENSHOT = r"(?i)^screen[ _]?shot"
RANDOM_NAME = r"^[0-9A-Fa-f-]{32,36}\."


def col(name: str) -> Column:
    return F.col(name)


def is_empty() -> Column:
    return F.get(F.split("file_size", " "), F.lit(0)) == "0"


def at_screen_size(screens: tuple = SCREENS) -> Column:
    """Exact size of a known screen, either way up."""
    both = [f"{a}x{b}" for a, b in screens] + [f"{b}x{a}" for a, b in screens]
    return F.concat_ws("x", "width", "height").isin(both)


def tier() -> Column:
    """struct(tier, class): the first rule that fires; NULL if none does."""
    video = F.col("file_type").isin(*P.VIDEO_TYPES)
    bare = parse.no_camera(F.col("make"), F.col("model"))
    dated = parse.first_date(F.col("date_time_original"), F.col("create_date")).isNotNull()
    made = lambda t, c: F.struct(F.lit(t).alias("tier"), c.alias("class"))
    return (
        F.when(F.col("file_name").startswith("._") | (F.col("file_type") == "MacOS") | is_empty(), made("T0", F.lit("junk")))
        .when(~bare, F.lit(None))
        .when(F.col("file_name").rlike(SCREENSHOT) | at_screen_size(), made("T1", F.when(video, "screen_record").otherwise("screenshot")))
        .when(F.col("file_name").rlike(MESSENGER), made("T2", F.lit("shared")))
        .when(~video & parse.long_edge(F.col("width"), F.col("height")).isin(*LONG_EDGES), made("T3", F.lit("shared")))
        .when(video & ~dated, made("T4", F.lit("no_exif")))
        .when(~dated & parse.gps(F.col("gps_position")).isNull(), made("T5", F.lit("no_exif")))
    )


def preclass() -> Column:
    """Class of a row: its tier's, else by make, else by a random file name, else own."""
    make = parse.present(F.col("make"))
    bare = parse.no_camera(F.col("make"), F.col("model"))
    by_make = F.when(make.isNotNull() & ~F.lower(make).isin(*OWN_MAKES), "shared").when(bare & F.col("file_name").rlike(RANDOM_NAME), "shared").otherwise("own")
    return F.coalesce(tier()["class"], by_make)


def first_route() -> Column:
    """Routes that need no owner data: empty, undated, junk, unknown format, screenshot by name."""
    dated = parse.first_date(F.col("date_time_original"), F.col("create_date")).isNotNull()
    t = tier()["tier"]
    return (
        F.when(is_empty(), "skip_junk")
        .when(~dated, "to_be_checked")
        .when(t == "T0", "skip_junk")
        .when(~F.col("file_type").isin(*P.IMAGE_TYPES, *P.VIDEO_TYPES), "others")
        .when((t == "T1") & F.col("file_name").rlike(SCREENSHOT), "screenshot")
        .otherwise("undecided")
    )


def undated_bucket(by_file_date: bool, dump_month: str) -> Column:
    """Bucket of an undated row: videos by the year of their file date, else one bucket."""
    if not by_file_date:
        return F.lit(f"{dump_month}00_check")
    year = parse.file_year(F.col("modified"))
    return F.when(F.col("file_type").isin(*P.VIDEO_TYPES) & year.isNotNull(), F.concat(year, F.lit("00_check"))).otherwise("_check/import")


def route(rows: DataFrame, dupes: DataFrame | Column, documents: DataFrame | Column, overrides: DataFrame, legs: DataFrame, dest: str) -> DataFrame:
    """action, destination and tag of each dated row; the first rule that fires wins.

    rows: manifest columns with day. dupes(file_no, existing) and documents(file_no) are joined, or are
    columns (the existing path or NULL; whether it is a document) where the caller knows them from the rows.
    overrides(day, path), legs(ord, first, last, name): of several legs that hold a day the first by ord
    counts; legs are few, so they are spread over their days, one row a day.
    """
    days = legs.withColumn("day", F.explode(F.sequence("first", "last"))).groupBy("day").agg(F.min_by("name", "ord").alias("leg"))
    joined = rows.withColumn("cls", preclass())
    joined = joined.withColumn("existing", dupes) if isinstance(dupes, Column) else joined.join(dupes, "file_no", "left")
    joined = joined.withColumn("is_document", documents) if isinstance(documents, Column) else joined.join(documents.withColumn("is_document", F.lit(True)), "file_no", "left")
    joined = joined.join(small(overrides.withColumnRenamed("path", "override")), "day", "left").join(small(days, 100_000), "day", "left")
    month = F.date_format("day", "yyyyMM")
    known = F.col("file_type").isin(*P.IMAGE_TYPES, *P.VIDEO_TYPES)
    out = lambda action, path, tag: F.struct(F.lit(action).alias("action"), path.alias("destination"), F.lit(tag).alias("tag"))
    bucket = lambda word: F.concat(F.lit(f"{dest}/"), month, F.lit(f"00_{word}"))
    trip = F.concat_ws("/", F.lit(f"{dest}/trip"), "leg")
    rule = (
        F.when(F.col("existing").isNotNull(), out("skip_dupe", F.col("existing"), ""))
        .when(F.col("cls") == "junk", out("skip_junk", F.lit(""), "junk"))
        .when(~known, out("copy", bucket("others"), "unknown_format"))
        .when(F.col("is_document"), out("copy", bucket("check"), "paperwork"))
        .when(F.col("cls").isin("screenshot", "screen_record"), out("copy", bucket("screenshots"), "screenshot"))
        .when(F.col("override").isNotNull(), out("copy", F.col("override"), ""))
        .when(F.col("cls") == "shared", out("copy", trip, "shared"))
        .otherwise(out("copy", trip, ""))
    )
    return joined.select("file_no", rule.alias("r")).select("file_no", "r.*")


def junk_reason(names: DataFrame) -> DataFrame:
    """Why each skipped name (folder, file_name) is junk; a ._ name depends on its twin."""
    twins = names.select("folder", F.col("file_name").alias("twin_name")).distinct().withColumn("there", F.lit(True))
    junk = names.where(F.col("file_name").startswith("._") | F.lower("file_name").isin(*P.JUNK_NAMES))
    joined = junk.withColumn("twin_name", F.expr("substring(file_name, 3)")).join(twins, ["folder", "twin_name"], "left")
    why = (
        F.when(~F.col("file_name").startswith("._"), "system")
        .when(F.col("there").isNull(), "twin_missing")
        .when(parse.extension(F.col("twin_name")) == "aae", "twin_is_sidecar")
        .otherwise("twin_here")
    )
    return joined.select("folder", "file_name", why.alias("why"))


def apply_twins(plan: DataFrame, twins: DataFrame) -> DataFrame:
    """Copies (path, action, dest) that have a twin (path, twin) become skips; where they would have gone is kept
    as their fallback."""
    met = plan.join(twins, "path", "left")
    skip = (F.col("action") == "copy") & F.col("twin").isNotNull()
    return met.select("path", F.when(skip, "skip_dupe").otherwise(F.col("action")).alias("action"), F.when(skip, F.col("twin")).otherwise(F.col("dest")).alias("dest"), F.when(skip, F.col("dest")).otherwise("").alias("fallback"))


def copy_verdicts(wanted: DataFrame, there: DataFrame) -> DataFrame:
    """wanted (file_no, want) with verdict: copied, wrong (other bytes are there) or absent."""
    met = wanted.join(there, "file_no", "left")
    return met.withColumn("verdict", F.when(F.col("sha").isNull(), "absent").when(F.col("sha") == F.col("want"), "copied").otherwise("wrong"))


def refuse(problems: DataFrame, what: str) -> None:
    """An error that counts the problems and shows one, if there are any."""
    first = problems.limit(1).collect()
    if first:
        raise ValueError(f"{what}: {problems.count()} problems, among others {first[0].asDict()}")
