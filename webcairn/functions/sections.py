"""Section rules, ranks and page scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from webcairn import limits as L
from webcairn.functions.text import strip


def section_of(path: Column) -> Column:
    rules = F.when(path.rlike(L.SECTION_RULES[0][0]), L.SECTION_RULES[0][1])
    for pattern, section in L.SECTION_RULES[1:]:
        rules = rules.when(path.rlike(pattern), section)
    return rules.otherwise(L.DEFAULT_SECTION)


def section_rank(section: Column) -> Column:
    """Rank of a section inside a document; Optional is always last."""
    order = F.array(*[F.lit(s) for s in L.SECTION_ORDER])
    known = F.array_position(order, section)
    return (
        F.when(section == L.OPTIONAL_SECTION, 99)
        .when(known > 0, known)
        .otherwise(len(L.SECTION_ORDER) + 1)
        .cast("bigint")
    )


def _filled(text: Column) -> Column:
    return F.coalesce(strip(text) != "", F.lit(False))


def richness(title: Column, description: Column, snippet: Column) -> Column:
    return (
        F.when(_filled(title), 2).otherwise(0)
        + F.when(_filled(description), 2).when(_filled(snippet), 1).otherwise(0)
    ).cast("bigint")
