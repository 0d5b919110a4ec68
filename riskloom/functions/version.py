"""Versions, ages and grades, as columns. What can't be read is null, never a guess."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: days a release must have been out, by environment grade, and the default grade
COOLDOWN_DAYS = {"E0": 3, "E1": 7, "E2": 14}
DEFAULT_GRADE = "E1"


def version_key(version: Column) -> Column:
    """Numbers before the first '-', '+' or blank, zeros at the end dropped, as an array that compares; null if unreadable."""
    core = F.regexp_extract(F.trim(version), r"^([^-+ ]*)", 1)
    parts = F.filter(F.split(core, r"\."), lambda x: x != "")
    numbers = F.transform(parts, lambda x: x.cast("int"))
    last = F.aggregate(F.zip_with(numbers, F.sequence(F.lit(1), F.size(numbers)), lambda n, i: F.when(n != 0, i).otherwise(F.lit(0))), F.lit(1), lambda a, x: F.greatest(a, x))
    readable = core.rlike(r"^[0-9.]*[0-9][0-9.]*$") & F.forall(parts, lambda x: F.length(x) <= 9)
    return F.when(readable, F.slice(numbers, F.lit(1), last))


def prerelease(version: Column) -> Column:
    """The tag behind the first '-', without build data, lower-cased; empty if none."""
    return F.lower(F.regexp_extract(F.regexp_replace(F.trim(version), r"\+.*$", ""), r"^[^-]*-(.*)$", 1))


def is_prerelease(version: Column) -> Column:
    return version.rlike(r"(?i)-(?:rc|alpha|beta|next|canary|dev|pre|preview|snapshot)")


def npm_bounds(spec: Column) -> Column:
    """Half-open bounds of ^ and ~ ranges as struct(lo, hi) of version keys; null for other forms."""
    form = r"^([\^~])([0-9]+)(?:\.([0-9]+))?(?:\.([0-9]+))?$"
    own = F.trim(spec)
    sign = F.regexp_extract(own, form, 1)
    part = lambda i: F.regexp_extract(own, form, i)
    number = lambda i: F.coalesce(F.when(part(i) != "", part(i).cast("int")), F.lit(0))
    major, minor, patch = number(2), number(3), number(4)
    text = lambda *xs: F.concat_ws(".", *[x.cast("string") for x in xs])
    zero = F.lit(0)
    upper = (
        F.when((sign == "~") & (part(3) == ""), text(major + 1, zero, zero))
        .when(sign == "~", text(major, minor + 1, zero))
        .when(major > 0, text(major + 1, zero, zero))
        .when((minor > 0) | (part(4) == ""), text(zero, minor + 1, zero))
        .otherwise(text(zero, zero, patch + 1))
    )
    return F.when(own.rlike(form), F.struct(version_key(text(major, minor, patch)).alias("lo"), version_key(upper).alias("hi")))


def grade_days(grade: Column) -> Column:
    out = F.lit(COOLDOWN_DAYS[DEFAULT_GRADE])
    for name, days in COOLDOWN_DAYS.items():
        out = F.when(F.upper(F.trim(grade)) == name, F.lit(days)).otherwise(out)
    return out


def grade_supported(grade: Column) -> Column:
    return grade.isNull() | F.upper(F.trim(grade)).isin(list(COOLDOWN_DAYS))


def cooled_down(age_days: Column, grade: Column) -> Column:
    """Null while the age is unknown."""
    return age_days >= grade_days(grade)


def age_days(timestamp: Column, today: Column) -> Column:
    return F.datediff(today, F.to_date(F.substring(timestamp, 1, 10)))


def is_patch_step(before: Column, after: Column) -> Column:
    """Same major and minor number, another patch."""
    at = lambda x, i: F.coalesce(F.get(x, F.lit(i)), F.lit(0))
    return (at(before, 0) == at(after, 0)) & (at(before, 1) == at(after, 1)) & (at(before, 2) != at(after, 2))


def size_change(before: Column, after: Column) -> Column:
    return F.try_divide((after - before).cast("double"), before.cast("double"))


def interval_contains(start: Column, end: Column, inclusive: Column, key: Column) -> Column:
    """Whether a version key lies in [start, end) or [start, end]; null where the version is unreadable."""
    return (key >= F.coalesce(start, F.array(F.lit(0)))) & (end.isNull() | (key < end) | (inclusive & (key == end)))
