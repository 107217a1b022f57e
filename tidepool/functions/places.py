"""Place names and map features, as Column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepool import params as P
from tidepool.functions import geo
from tidepool.functions.parse import let


def ends_in(name: Column, tails: tuple[str, ...]) -> Column:
    return reduce(or_, [name.endswith(t) for t in tails])


def is_address(name: Column) -> Column:
    """A house number, lane or alley, or a name that ends in one of their words."""
    return name.rlike("[0-9０-９]+\\s*[巷弄號段]") | ends_in(name, P.ADDRESS_SUFFIXES)


def names_no_place(name: Column) -> Column:
    """How a way is to be walked, a structure beside it, or an address."""
    return reduce(or_, [name.contains(w) for w in P.ROUTE_DESCRIPTIONS]) | ends_in(name, P.STRUCTURE_SUFFIXES) | is_address(name)


def without_first(text: Column, options: tuple[str, ...], at_start: bool) -> Column:
    """text without the first of the options that it starts (or ends) with and isn't all of."""
    out = F.when(F.lit(False), text)
    for o in options:
        fits = (text.startswith(o) if at_start else text.endswith(o)) & (F.length(text) > len(o))
        cut = F.substring(text, F.lit(len(o) + 1), F.length(text)) if at_start else F.substring(text, F.lit(1), F.length(text) - len(o))
        out = out.when(fits, F.trim(cut) if at_start else cut)
    return out.otherwise(text)


def trail_place(name: Column) -> Column:
    """The place that the name of a way stands for, NULL if none."""
    bare = F.trim(F.regexp_replace(name, "[（(].*?[）)]", ""))
    first = F.trim(F.get(F.split(F.trim(F.get(F.split(bare, "[;；]"), F.lit(0))), "-"), F.lit(0)))
    seen = let(first, lambda x: without_first(x, P.VIEW_PREFIXES + P.LEG_JOINERS, True))

    def start(x: Column) -> Column:
        out = F.when(F.lit(False), x)
        for j in P.LEG_JOINERS:
            out = out.when(F.substring(x, F.lit(2), F.length(x)).contains(j), F.trim(F.get(F.split(x, j), F.lit(0))))
        return out.otherwise(x)

    place = let(let(seen, start), lambda x: without_first(x, P.TRAIL_SUFFIXES, False))
    return let(place, lambda x: F.when((F.length(x) >= 2) & ~names_no_place(x), x))


def same_place_key(name: Column) -> Column:
    """One key for the spellings of a place: a variant sign and one closing word of ways are dropped."""
    return let(F.replace(name, F.lit("陵"), F.lit("稜")), _without_tail)


def _without_tail(key: Column) -> Column:
    out = F.when(F.lit(False), key)
    for tail in P.KEY_TAILS:
        out = out.when(key.endswith(tail) & (F.length(key) > len(tail) + 1), F.substring(key, F.lit(1), F.length(key) - len(tail)))
    return out.otherwise(key)


def first_variant(name: Column, simplified: Column | None = None) -> Column:
    """The first of variants joined by semicolons, or the first without a simplified sign."""
    parts = F.filter(F.transform(F.split(name, ";"), lambda v: F.trim(v)), lambda v: v != "")
    if simplified is None:
        return F.when(name.contains(";"), F.trim(F.get(F.split(name, ";"), F.lit(0)))).otherwise(name)
    good = F.filter(parts, lambda v: ~v.rlike(simplified))
    return F.when(name.contains(";"), F.coalesce(F.get(good, F.lit(0)), F.get(parts, F.lit(0)))).otherwise(name)


def landmark_rank(tags: Column) -> Column:
    """0 for a sight, 1 for a stay, NULL for neither; a street for walkers is a sight if it is notable."""

    def hit(table: dict) -> Column:
        tag = lambda k: F.try_element_at(tags, F.lit(k))
        return reduce(or_, [F.coalesce(tag(k) != "" if v is None else tag(k).isin(*v), F.lit(False)) for k, v in table.items()])

    notable = F.map_contains_key(tags, "wikidata") | F.map_contains_key(tags, "wikipedia")
    street = F.coalesce(F.try_element_at(tags, F.lit("highway")) == "pedestrian", F.lit(False)) & notable
    return F.when(hit(P.SIGHT_TAGS), 0).when(hit(P.STAY_TAGS), 1).when(street, 0)


def extent_km(south: Column, west: Column, north: Column, east: Column) -> Column:
    """Kilometres across a feature's box, 0 without one."""
    return F.coalesce(geo.haversine_km(south, west, north, east), F.lit(0.0))


def pad_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> list[Column]:
    """A box grown by its share on each side and held inside the frame."""
    w, h = (x1 - x0) * P.BOX_PAD, (y1 - y0) * P.BOX_PAD
    return [F.greatest(F.lit(0.0), x0 - w), F.greatest(F.lit(0.0), y0 - h), F.least(width, x1 + w), F.least(height, y1 + h)]


def box_share(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    area = F.greatest(F.lit(0.0), x1 - x0) * F.greatest(F.lit(0.0), y1 - y0)
    return F.coalesce(F.bround(area / F.nullif(width * height, F.lit(0.0)), 4), F.lit(0.0))
