"""Therapeutic areas of a disease."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from litevidence.constants import AREA_FIRST, AREA_SECOND


def flat_areas(areas: Column | str) -> Column:
    """The area ids as `a|b`; empty text where there are none, as in the delimited files."""
    return F.concat_ws("|", areas)


def preferred_area(areas: Column | str) -> Column:
    """One area id: the first of the preferred kind, else of the second kind, else of any."""
    ids = F.col(areas) if isinstance(areas, str) else areas
    first = F.filter(ids, lambda x: x.startswith(AREA_FIRST))
    second = F.filter(ids, lambda x: x.startswith(AREA_SECOND[0]) | x.startswith(AREA_SECOND[1]))
    named = F.filter(ids, lambda x: x != "")
    return F.coalesce(*[F.get(kind, F.lit(0)) for kind in (first, second, named)])


def preferred_area_of_text(flat: Column | str) -> Column:
    """The same for areas given as `a|b` text."""
    return preferred_area(F.split(flat, r"\|"))
