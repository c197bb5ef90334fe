"""Work-mode and employment classes of folded text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Wordings of work modes, in order of precedence.
MODES = {
    "hybrid": r"\bhybrid\b",
    "remote": r"\b(?:remote|work from home|wfh|telecommut\w*|work from anywhere|distributed team|anywhere in the world)\b",
    "onsite": r"\b(?:on[\s-]?site|in[\s-]office|office[\s-]based|in[\s-]person)\b",
}
#: Wordings of employment types, in order of precedence.
EMPLOYMENT = {
    "internship": r"intern",
    "part_time": r"part[\s_-]?time",
    "freelance": r"freelanc",
    "contract": r"contract|consult",
    "temporary": r"\btemp",
    "full_time": r"full[\s_-]?time|permanent|employee|regular",
}


def first_match(text: Column, patterns: dict[str, str], otherwise: str) -> Column:
    return F.coalesce(*[F.when(text.rlike(p), F.lit(k)) for k, p in patterns.items()], F.lit(otherwise))


def work_mode(*folded: Column) -> Column:
    return first_match(F.concat_ws(" ", *folded), MODES, "unknown")


def work_mode_or(first: list[Column], second: Column) -> Column:
    """From the first texts, else from the second: the start of a description, cut before it is folded, as folding
    changes lengths."""
    found = work_mode(*first)
    return F.when(found != "unknown", found).otherwise(work_mode(second))


def employment(folded: Column) -> Column:
    return first_match(folded, EMPLOYMENT, "unspecified")
