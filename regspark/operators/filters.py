"""Reusable filters of the register: any combination of optional conditions.

Each condition that is given becomes a part of one Column, which Spark pushes to the scan as far as
it goes (equality, ranges, prefixes and null tests; not searches inside a text or across accents).
Conditions on other tables become a semi or anti join, and only where they are given.

A tri-state condition takes True, False or UNKNOWN (null); None leaves it out, as for all others.
Names are searched without regard to case and accents, by the collation UNICODE_CI_AI, in any script.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNKNOWN = "unknown"
NAMES = "UNICODE_CI_AI"


def same_name(c: Column) -> Column:
    """A name that compares, joins and groups without regard to case and accents."""
    return F.collate(c, NAMES)


def contains(name: str, value: str | None) -> Column | None:
    return None if value is None else F.contains(same_name(F.col(name)), same_name(F.lit(value)))


def starts(name: str, value: str | None) -> Column | None:
    return None if value is None else F.col(name).startswith(value)


def equal(name: str, value: object | None) -> Column | None:
    return None if value is None else F.col(name) == value


def one_of(name: str, values: Iterable | None) -> Column | None:
    return None if values is None else F.col(name).isin(list(values))


def at_least(name: str, value: object | None) -> Column | None:
    return None if value is None else F.col(name) >= value


def tri(name: str, value: bool | str | None) -> Column | None:
    return None if value is None else F.col(name).isNull() if value == UNKNOWN else F.col(name) == F.lit(value)


def code_prefix(name: str, value: str | None) -> Column | None:
    """A prefix of a code, neither with its dots."""
    return None if value is None else F.replace(F.col(name), F.lit("."), F.lit("")).startswith(value.replace(".", ""))


def both(*conditions: Column | None) -> Column | None:
    given = [c for c in conditions if c is not None]
    return reduce(Column.__and__, given) if given else None


def either(*conditions: Column | None) -> Column | None:
    given = [c for c in conditions if c is not None]
    return reduce(Column.__or__, given) if given else None


def _where(rows: DataFrame, *conditions: Column | None) -> DataFrame:
    all_ = both(*conditions)
    return rows if all_ is None else rows.where(all_)


def directory(rows: DataFrame, name: str | None = None, tax_id: str | None = None, place: str | None = None, status: str | None = None, kinds: Iterable[str] | None = None, section: str | None = None, activity: str | None = None, population: str | None = None, missing: bool = False) -> DataFrame:
    """Rows by part of the name, prefix of the tax id, place, status, kinds, section, prefix of the
    activity's code and population; rows missing since a run only with `missing`."""
    live = None if missing else F.col("missing_since").isNull()
    return _where(rows, live, starts("tax_id", tax_id), equal("place", place), equal("status", status), one_of("kind", kinds), equal("section", section), equal("population", population), code_prefix("activity", activity), contains("name", name))


def registry(rows: DataFrame, establishments: DataFrame | None = None, key: str = "id", state: str | None = None, inactive: bool | None = None, province: str | None = None, active: str = "ACTIVE", **tri_state: bool | str) -> DataFrame:
    """Rows by state, by whether they are anything but certainly `active` (unknown counts as inactive),
    by tri-state columns, and by a province in which the holder has an establishment (key, province)."""
    not_active = ~F.col("state").eqNullSafe(F.lit(active))
    which = None if inactive is None else not_active if inactive else ~not_active
    left = _where(rows, equal("state", state), which, *(tri(c, v) for c, v in tri_state.items()))
    if province is None:
        return left
    there = establishments.where(F.upper(F.trim("province")) == province.strip().upper()).select(key)
    return left.join(there, key, "left_semi")


def list_membership(rows: DataFrame, lists: DataFrame, key: str = "tax_id", touristic: bool | None = None, ratified: bool | None = None, any_list: bool | None = None, on: str | None = None, year: int | None = None, none: bool | None = None) -> DataFrame:
    """Rows that fit any of the conditions given: in the tourism register, ratified there, on any list,
    on one list (both in a year, if one is given), or `none`: in no register and on no list at all.

    `rows` has touristic and ratified, `lists` is (key, list, year). Without a condition all rows stay.
    """
    own = either(F.coalesce("touristic", F.lit(False)) if touristic else None, F.coalesce("ratified", F.lit(False)) if ratified else None)
    listed = bool(any_list) or on is not None
    if own is None and not listed and not none:
        return rows
    keep = F.lit(False) if own is None else own
    marked = rows
    if listed:
        which = _where(lists, equal("list", None if any_list else on), equal("year", year)).select(F.col(key).alias("_listed")).distinct()
        marked = marked.join(which, F.col(key) == F.col("_listed"), "left")
        keep = keep | F.col("_listed").isNotNull()
    if none:
        every = lists.select(F.col(key).alias("_any")).distinct()
        marked = marked.join(every, F.col(key) == F.col("_any"), "left")
        keep = keep | (F.col("_any").isNull() & ~F.coalesce("touristic", F.lit(False)))
    return marked.where(keep).select(rows.columns)


def codes(rows: DataFrame, search: str | None = None, level: int | None = None, leaves: bool = False, missing: bool = False) -> DataFrame:
    """Codes whose code begins with `search` or whose name contains it, of a level, leaves only; missing ones only with `missing`."""
    live = None if missing else F.col("missing_since").isNull()
    return _where(rows, live, equal("level", level), F.col("leaf") if leaves else None, either(code_prefix("code", search), contains("name", search)))


def statements(rows: DataFrame, companies: DataFrame | None = None, year: int | None = None, name: str | None = None, tax_id: str | None = None, section: str | None = None, missing: bool = False) -> DataFrame:
    """Statement headers of a year, by their company's name, tax id and section; the companies are joined only for those."""
    live = None if missing else F.col("missing_since").isNull()
    own = _where(rows, live, equal("year", year))
    if name is None and tax_id is None and section is None:
        return own
    return own.join(_where(companies, starts("tax_id", tax_id), equal("section", section), contains("name", name)).select("company"), "company", "left_semi")


def risk(rows: DataFrame, population: str | None = None, year: int | None = None, last_year: bool = False, persistence: int | None = None, gap: object | None = None, activity: str | None = None, search: str | None = None) -> DataFrame:
    """Yearly risk rows by population, a year or each company's last, years of persistence, least gap,
    prefix of the activity's code, and a search in the name or at the start of the tax id."""
    base = rows
    if last_year:  # a company has a few years
        base = rows.withColumn("_last", F.max("year").over(Window.partitionBy("company"))).where("year = _last").drop("_last")
    return _where(base, equal("population", population), equal("year", year), at_least("persistence", persistence), at_least("gap", gap), code_prefix("activity", activity), either(starts("tax_id", search), contains("name", search)))
