"""Text, date and number parsing as column expressions; garbage becomes null, nothing raises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_text(x: Column) -> Column:
    """Runs of white space become one space; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))


def none_if_blank(x: Column) -> Column:
    return F.when(~F.trim(x).isin("", "--"), F.trim(x))


def first_group(x: Column, pattern: str, group: int = 1) -> Column:
    """A pattern's group where the pattern matches, else null."""
    return F.when(x.rlike(pattern), F.regexp_extract(x, pattern, group))


def int_of(x: Column) -> Column:
    """The first signed whole number, thousands separators ignored."""
    return first_group(F.replace(x, F.lit(","), F.lit("")), r"(-?\d+)").try_cast("int")


def seconds_of(x: Column) -> Column:
    """``m:ss`` as seconds; anything else is null."""
    return first_group(x, r"^\s*(\d+):(\d{1,2})\s*$").try_cast("int") * 60 + first_group(x, r"^\s*(\d+):(\d{1,2})\s*$", 2).try_cast("int")


def height_of(x: Column) -> Column:
    """Feet and inches as inches."""
    return first_group(x, r"(\d+)'\s*(\d+)").try_cast("int") * 12 + first_group(x, r"(\d+)'\s*(\d+)", 2).try_cast("int")


def landed_of(x: Column, group: int) -> Column:
    """Of ``x of y``: group 1 is landed, group 2 attempted."""
    return first_group(x, r"(\d+)\s+of\s+(\d+)", group).try_cast("int")


def date_of(x: Column) -> Column:
    """Dates with long or short English month names, with or without a comma."""
    plain = F.regexp_replace(F.trim(x), ",", "")
    return F.coalesce(F.try_to_date(plain, "MMMM d yyyy"), F.try_to_date(plain, "MMM d yyyy"))


def between(x: Column, left: str, right: str) -> Column:
    """Text between two labels, whatever their case."""
    return first_group(x, rf"(?i){left}\s+(.+?)\s+{right}\b")


def entity_id(url: Column, entity: str) -> Column:
    return first_group(url, rf"{entity}-details/([A-Za-z0-9]+)")


def absolute_url(page: Column, link: Column) -> Column:
    """A link as a page's reader would follow it: whole links stay, others start at the page's host or folder."""
    host, folder = F.regexp_extract(page, r"^[A-Za-z]+://[^/]+", 0), F.regexp_extract(page, r"^.*/", 0)
    return F.when(link.rlike("^[A-Za-z]+:"), link).when(link.startswith("/"), F.concat(host, link)).otherwise(F.concat(folder, link))


def slug_id(url: Column) -> Column:
    """The number that ends a slug."""
    return first_group(url, r"-(\d+)/?$")


def outcome_of(x: Column) -> Column:
    """Outcome tokens as W, L, D or NC."""
    names = {"w": "W", "win": "W", "l": "L", "loss": "L", "d": "D", "draw": "D", "nc": "NC", "no contest": "NC"}
    return F.try_element_at(F.create_map(*[F.lit(v) for pair in names.items() for v in pair]), F.lower(F.trim(x)))


def strip_record_suffix(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"(?i)\s*Record:.*$", ""))


def strip_nickname(x: Column) -> Column:
    return F.regexp_replace(x, r'"[^"]*"', " ")


def name_key(x: Column) -> Column:
    """Lower case, other characters as spaces, and runs of single letters joined."""
    plain = F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))
    return F.regexp_replace(plain, r"(?<=\b[a-z]) (?=[a-z]\b)", "")


def cleaned_name_key(x: Column) -> Column:
    return name_key(strip_nickname(strip_record_suffix(x)))


def name_variants(x: Column) -> Column:
    """Spellings of a leading pair of initials: as given, with dots, apart."""
    pair = x.rlike(r"^[A-Z]{2} ")
    dotted = F.regexp_replace(x, "^([A-Z])([A-Z]) ", "$1.$2. ")
    apart = F.regexp_replace(x, "^([A-Z])([A-Z]) ", "$1 $2 ")
    return F.when(pair, F.array_distinct(F.array(x, dotted, apart))).otherwise(F.array(x))


def dob_status(a: Column, b: Column) -> Column:
    """missing, exact, near (7 days), month_day_swap, same_year_close (31 days) or conflict; years must agree beyond exact."""
    days = F.abs(F.datediff(a, b))
    swap = (F.month(a) == F.dayofmonth(b)) & (F.dayofmonth(a) == F.month(b))
    return (
        F.when(a.isNull() | b.isNull(), "missing").when(a == b, "exact").when(F.year(a) != F.year(b), "conflict")
        .when(days <= 7, "near").when(swap, "month_day_swap").when(days <= 31, "same_year_close").otherwise("conflict")
    )


def canonical_id(source: Column, own: Column) -> Column:
    """``source:id``; null where either is."""
    return F.concat(source, F.lit(":"), own)
