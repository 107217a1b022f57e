"""Typed values from the text columns of a manifest, as Column expressions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool import params as P


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def present(value: Column) -> Column:
    """value, or NULL for the markers of an absent tag."""
    return F.when(~value.isin(*P.ABSENT), value)


def stamp(value: Column) -> Column:
    """First 19 characters as a local timestamp; NULL if absent or no such moment."""
    return F.try_to_timestamp(F.substring(present(value), 1, 19), F.lit("yyyy:MM:dd HH:mm:ss")).cast("timestamp_ntz")


def offset_minutes(value: Column) -> Column:
    """+08:00 or +0800 as signed minutes."""
    pattern = r"^([+-])(\d{2}):?(\d{2})$"
    part = lambda i: F.regexp_extract(value, pattern, i)
    minutes = part(2).try_cast("int") * 60 + part(3).try_cast("int")
    return F.when(value.rlike(pattern), F.when(part(1) == "-", -minutes).otherwise(minutes))


def first_date(*values: Column) -> Column:
    """The first value that parses."""
    return F.coalesce(*[stamp(v) for v in values])


def date_source(**values: Column) -> Column:
    """Name of the tag that first_date takes."""
    return F.coalesce(*[F.when(stamp(v).isNotNull(), F.lit(k)) for k, v in values.items()])


def gps(value: Column) -> Column:
    """struct(lat, lon) of 'lat lon' or 'lat, lon'; NULL if unreadable or at (0, 0)."""
    parts = F.split(F.trim(F.regexp_replace(present(value), ",", " ")), r"\s+")
    lat, lon = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    good = (F.size(parts) == 2) & lat.isNotNull() & lon.isNotNull() & ~((lat == 0) & (lon == 0))
    return F.when(good, F.struct(lat.alias("lat"), lon.alias("lon")))


def is_night(when: Column) -> Column:
    return F.hour(when).isin(*P.NIGHT_HOURS)


def long_edge(w: Column, h: Column) -> Column:
    return F.greatest(w.try_cast("int"), h.try_cast("int"))


def portrait(w: Column, h: Column) -> Column:
    """'short x long' of two sizes, NULL if one is absent."""
    w, h = w.try_cast("int"), h.try_cast("int")
    return F.when(w.isNotNull() & h.isNotNull(), F.concat_ws("x", F.least(w, h), F.greatest(w, h)))


def no_camera(make: Column, model: Column) -> Column:
    return present(make).isNull() & present(model).isNull()


def screen_shape(w: Column, h: Column) -> Column:
    short, tall = F.least(w, h), F.greatest(w, h)
    ratio = tall / F.nullif(short, F.lit(0))
    return (
        F.when(short <= 0, "none")
        .when(F.abs(ratio - 4 / 3) < 0.02, "4:3")
        .when(F.abs(ratio - 3 / 2) < 0.02, "3:2")
        .when(ratio >= 1.7, "tall")
        .otherwise("other")
    )


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))


def is_media_name(name: Column) -> Column:
    return extension(name).isin(*P.PHOTO_EXT, *P.VIDEO_EXT) & ~name.startswith("._")


def kind_of(file_type: Column) -> Column:
    return F.when(file_type.isin(*P.IMAGE_TYPES), "image").when(file_type.isin(*P.VIDEO_TYPES), "video")


def file_year(modified: Column) -> Column:
    return F.nullif(F.regexp_extract(modified, r"^((?:19|20)\d\d)", 1), F.lit(""))


def year_hint(text: Column) -> Column:
    """The last free-standing year from 1980 to 2049 in a text."""
    found = F.regexp_extract_all(text, F.lit(r"(?<!\d)(19[89]\d|20[0-4]\d)(?!\d)"), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def bound_ok(value: Column) -> Column:
    """A bound YYYY, YYYY-MM or YYYY-MM-DD, NULL (open) if malformed."""
    return F.when(value.rlike(r"^\d{4}(-\d{2}(-\d{2})?)?$"), value)


def within_bounds(day: Column, since: Column, until: Column) -> Column:
    """Each bound is compared with as much of the day as it states."""
    since, until = bound_ok(since), bound_ok(until)
    after = F.substring(day, F.lit(1), F.length(since)) >= since
    before = F.substring(day, F.lit(1), F.length(until)) <= until
    return F.coalesce(after, F.lit(True)) & F.coalesce(before, F.lit(True))


def bound_start(value: Column) -> Column:
    day = F.when(F.length(value) == 4, F.concat(value, F.lit("-01-01"))).when(F.length(value) == 7, F.concat(value, F.lit("-01"))).otherwise(value)
    return F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).cast("timestamp_ntz")


def bound_end(value: Column) -> Column:
    """Last second of the bound's unit."""
    start = bound_start(value)
    after = F.when(F.length(value) == 4, F.add_months(start, 12)).when(F.length(value) == 7, F.add_months(start, 1)).otherwise(F.date_add(start, 1))
    return (after.cast("timestamp_ntz") - F.expr("INTERVAL 1 SECOND")).cast("timestamp_ntz")


def period(start: Column, end: Column) -> Column:
    """YYYYMMDD, or YYYYMMDD-MMDD for a span."""
    s, e = F.date_format(start, "yyyyMMdd"), F.date_format(end, "MMdd")
    return F.when(end.isNull() | (start == end), s).otherwise(F.concat_ws("-", s, e))


def head_kind(head: Column) -> Column:
    return F.when(head.rlike(r"^\d{4}00$"), "YEARLY").when(head.rlike(r"^\d{6}00$|^\d{6}$"), "MONTHLY").otherwise("FOLDER")


def bucket_form(top: Column, word: str) -> Column:
    return (
        F.when(top == f"_{word}", "UNDATED")
        .when(top.rlike(rf"^\d{{6}}00_{word}$"), "MONTHLY")
        .when(top.rlike(rf"^\d{{4}}00_{word}$"), "YEARLY")
    )


def human_size(n: Column) -> Column:
    """Bytes in the largest unit of at least one, one decimal."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        out = F.when(n >= 1024**power, F.concat(F.round(n / 1024**power, 1).cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


def in_window(minute: Column, start: int, end: int) -> Column:
    """A daily window that may wrap past midnight."""
    return (minute >= start) | (minute <= end) if end <= start else minute.between(start, end)


def minutes_of(text: Column) -> Column:
    """HH:MM as minutes."""
    return F.when(text.rlike(r"^([01]\d|2[0-3]):[0-5]\d$"), F.substring(text, 1, 2).try_cast("int") * 60 + F.substring(text, 4, 2).try_cast("int"))


def path_key(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def span_days(year: Column, m1: Column, d1: Column, m2: Column, d2: Column) -> Column:
    """First and last day of MMDD-MMDD from a year; an earlier end is in the next year."""
    wraps = (m2 * 100 + d2 < m1 * 100 + d1).cast("int")
    return F.struct(F.make_date(year, m1, d1).alias("first"), F.make_date(year + wraps, m2, d2).alias("last"))


def expand_spec(spec: Column) -> Column:
    """'4-12,15' as an array of ints."""
    def one(part: Column) -> Column:
        ends = F.split(F.trim(part), "-")
        return F.sequence(F.get(ends, F.lit(0)).cast("int"), F.element_at(ends, -1).cast("int"))

    return F.flatten(F.transform(F.split(spec, ","), one))


def candidate_ids(rows: DataFrame, key: str, sha: str = "sha") -> DataFrame:
    """(key, candidate_id): hash of a key's sorted shas, joined by |. Sorted partitions are hashed
    row by row, so a key of any size is only streamed."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lambda k, h: pa.RecordBatch.from_arrays([pa.array([k], kept), pa.array(["rc-" + h.hexdigest()[:12]])], names=[key, "candidate_id"])
        now, joint = None, b""
        for batch in batches:
            kept = batch.column(0).type
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if now is None or now[0] != k:
                    if now:
                        yield of(*now)
                    now, joint = (k, hashlib.sha256()), b""
                if x is not None:
                    now[1].update(joint + x.encode())
                    joint = b"|"
        if now:
            yield of(*now)

    return rows.select(key, sha).repartition(key).sortWithinPartitions(key, sha).mapInArrow(run, f"{key} {kind}, candidate_id string")


def provenance(value: Column) -> Column:
    """One leading 'draft:' and a closing colon removed."""
    return F.regexp_replace(F.regexp_replace(value, ":$", ""), "^draft:", "")


def is_view_confirmed(value: Column) -> Column:
    return value.isin("viewed-image", "viewed-image:")


#: Brands of ISO media files.
HEIF_BRANDS = ("heic", "heix", "hevc", "hevx", "heim", "heis", "mif1", "msf1")
BRANDS = {
    "MOV": ("qt  ",),
    "M4V": ("M4V ", "M4VH", "M4VP"),
    "MP4": ("isom", "iso2", "iso4", "iso5", "iso6", "mp41", "mp42", "avc1", "dash", "MSNV"),
    "3GP": ("3gp4", "3gp5", "3gp6", "3gp7", "3ge6", "3ge7", "3gg6", "3g2a"),
}
QUICKTIME_ATOMS = ("moov", "mdat", "wide", "free", "skip", "pnot")
HEAD_BYTES = 64


def sniff(content: Column) -> Column:
    """File type from the first bytes, NULL if they tell none. A media box is named by its major
    brand; one that is not known still counts as HEIC if its compatible brands hold one of HEIF."""
    return let(F.hex(F.substring(content, 1, HEAD_BYTES)), _sniffed)


def _sniffed(head: Column) -> Column:
    code = lambda s: s.encode().hex().upper()
    codes = lambda names: [code(n) for n in names]
    word = lambda i: F.substring(head, 8 * i + 1, 8)
    size = F.conv(word(0), 16, 10).cast("long")
    ends = F.least(F.floor(F.least(size, F.floor(F.length(head) / 2)) / 4), F.lit(HEAD_BYTES // 4)).cast("int")
    others = F.when(ends > 4, F.transform(F.sequence(F.lit(4), ends - 1), lambda i: F.substring(head, 8 * i + 1, F.lit(8))))
    box = F.when(word(2).isin(codes(HEIF_BRANDS)), "HEIC")
    for kind, brands in BRANDS.items():
        box = box.when(word(2).isin(codes(brands)), kind)
    box = box.when(F.coalesce(F.arrays_overlap(others, F.array(*map(F.lit, codes(HEIF_BRANDS)))), F.lit(False)), "HEIC")
    return (
        F.when(head.startswith("FFD8FF"), "JPEG")
        .when(head.startswith("89504E470D0A1A0A"), "PNG")
        .when(head.startswith(code("GIF87a")) | head.startswith(code("GIF89a")), "GIF")
        .when((word(0) == code("RIFF")) & (word(2) == code("WEBP")), "WEBP")
        .when((word(0) == code("RIFF")) & (word(2) == code("AVI ")), "AVI")
        .when((word(1) == code("ftyp")) & (F.length(head) >= 24), box)
        .when(word(1).isin(codes(QUICKTIME_ATOMS)), "MOV")
    )


def real_type(file_type: Column, sniffed: Column) -> Column:
    """A still by its tag that is a movie by its bytes is a movie."""
    return let(sniffed, lambda x: F.when(file_type.isin("HEIC", "HEIF") & x.isin("MOV", "MP4"), x).otherwise(file_type))


def copy_name(name: Column, file_type: Column) -> Column:
    """The name of a copy: another extension if the type doesn't allow the one it has."""
    return let(file_type, lambda kind: _copy_name(name, kind))


def _copy_name(name: Column, file_type: Column) -> Column:
    out = F.when(F.lit(False), name)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    for kind, (canonical, allowed) in P.EXTENSIONS.items():
        wrong = ~F.upper(F.regexp_extract(name, r"(?<=.)\.([^.]*)$", 1)).isin(*allowed)
        out = out.when((file_type == kind) & wrong, F.concat(stem, F.lit("." + canonical)))
    return out.otherwise(name)


def dump_month(name: Column, first: Column, last: Column) -> Column:
    """YYYYMM from the digits of a folder name, else the year or years of its first and last day."""
    digits = F.regexp_replace(name, r"\D", "")
    fits = (F.length(digits) >= 6) & F.substring(digits, 5, 2).try_cast("int").between(1, 12)
    a, b = F.date_format(first, "yyyy"), F.date_format(last, "yyyy")
    return F.when(fits, F.substring(digits, 1, 6)).when(a == b, a).otherwise(F.concat_ws("-", a, b))


def duration_text(seconds: Column) -> Column:
    """Hours and minutes, to the nearest minute (halves to even)."""
    m = F.bround(seconds / 60, 0).cast("long")
    hours, rest = F.floor(m / 60), m % 60
    minutes = F.concat(rest.cast("string"), F.lit(" min"))
    return F.when(m < 1, "under 1 min").when(hours > 0, F.concat_ws(" ", hours.cast("string"), F.lit("h"), minutes)).otherwise(minutes)


def bucket_path(root: Column, name: Column) -> Column:
    """Path of a bucket: monthly and yearly ones lie in the folder of their year."""
    head = F.get(F.split(name, "_"), F.lit(0))
    return F.when(head.rlike(r"^(\d{6}00|\d{4}00)$"), F.concat_ws("/", root, F.substring(head, 1, 4), name)).otherwise(F.concat_ws("/", root, name))
