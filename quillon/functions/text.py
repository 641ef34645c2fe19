"""Text expressions with the semantics of the source data: Unicode white space, comma lists, dates, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
_SPACES = r"(?U)[\s\x1c-\x1f]+"


def strip(col: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(col, _EDGES, "")


def filled(col: Column) -> Column:
    """Null to empty."""
    return F.coalesce(col, F.lit(""))


def collapse(col: Column) -> Column:
    """White space runs to one blank, none at the ends."""
    return F.trim(F.regexp_replace(strip(col), _SPACES, " "))


def split_raw(col: Column) -> Column:
    """Comma pieces, stripped, blanks kept; an empty text has none."""
    return F.when(filled(col) == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(col, ","), strip))


def split_items(col: Column) -> Column:
    """Comma pieces, stripped, blanks dropped."""
    return F.filter(split_raw(col), lambda x: x != "")


def join_unique(arr: Column) -> Column:
    """Distinct items in order, joined by comma and blank."""
    return F.array_join(F.array_distinct(arr), ", ")


def sanitise_name(col: Column) -> Column:
    """Characters that folders cannot hold become underscores."""
    return F.translate(filled(col), '\\/*?:"<>|', "_" * 9)


def normalise_date(col: Column) -> Column:
    """First YYYY-MM-DD found, else the stripped text."""
    found = F.regexp_extract(filled(col), r"(\d{4}-\d{2}-\d{2})", 1)
    return F.when(found != "", found).otherwise(strip(filled(col)))


def stamp_date(col: Column) -> Column:
    """Date part of an ISO stamp (B6, other source)."""
    return F.substring(filled(col), 1, 10)


def is_web_link(col: Column) -> Column:
    """Whether the stripped, lowered text begins with http:// or https://."""
    low = F.lower(strip(filled(col)))
    return low.startswith("http://") | low.startswith("https://")


def search_text(*cols: Column) -> Column:
    """Stripped, lowered columns in one line."""
    return collapse(F.concat_ws(" ", *[F.lower(strip(filled(c))) for c in cols]))


#: URL pattern and id prefix of each known site.
ID_RULES = ((r"/g/(\d+)", "NH"), (r"/album/(\d+)", "JM"))


def id_from_link(link: Column, rules=ID_RULES) -> Column:
    """Prefix and number of the first rule that the link meets, else null."""
    found = [(F.regexp_extract(filled(link), pattern, 1), prefix) for pattern, prefix in rules]
    return F.coalesce(*[F.when(n != "", F.concat(F.lit(p), n)) for n, p in found])


def resolve_id(item: Column, link: Column, rules=ID_RULES) -> Column:
    """The stripped id if there is one, else that of the link, else null (B1)."""
    own = strip(filled(item))
    return F.when(own != "", own).otherwise(id_from_link(link, rules))


def l2_normalise(vec: Column) -> Column:
    """A vector over its length, which counts as 1e-12 at least."""
    wide = F.transform(vec, lambda x: x.cast("double"))
    norm = F.greatest(F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-12))
    return F.transform(wide, lambda x: x / norm)
