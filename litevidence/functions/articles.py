"""What kind of article a list of publication types describes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from litevidence.constants import (
    DETAIL_NO_TITLE, DETAIL_NOT_AVAILABLE, DETAIL_PRIMARY, DETAIL_REVIEW, DETAIL_UNKNOWN,
    LABEL_PRIMARY, LABEL_REVIEW, REVIEW,
)


def is_review(pubtypes: Column | str, listed: Column) -> Column:
    """Whether `Review` is one of the types. Not listed: false. Listed without types: unknown, null."""
    return F.when(listed, F.array_contains(pubtypes, REVIEW)).otherwise(False)


def article_label(review: Column | str) -> Column:
    review = F.col(review) if isinstance(review, str) else review
    return F.when(review, LABEL_REVIEW).when(~review, LABEL_PRIMARY)


def detailed_label(pubtypes: Column | str, listed: Column) -> Column:
    """Any type that mentions a review counts, systematic reviews included."""
    types = F.coalesce(F.col(pubtypes) if isinstance(pubtypes, str) else pubtypes, F.array())
    return (
        F.when(~listed, DETAIL_UNKNOWN)
        .when(F.exists(types, lambda x: x.contains(REVIEW)), DETAIL_REVIEW)
        .otherwise(DETAIL_PRIMARY)
    )


def detailed_types(pubtypes: Column | str, listed: Column) -> Column:
    return F.when(listed, F.concat_ws(", ", pubtypes)).otherwise(DETAIL_NOT_AVAILABLE)


def detailed_title(title: Column | str, listed: Column) -> Column:
    title = F.col(title) if isinstance(title, str) else title
    return F.when(listed, F.coalesce(title, F.lit(DETAIL_NO_TITLE))).otherwise(DETAIL_NOT_AVAILABLE)
