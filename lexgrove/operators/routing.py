"""Rule-based routing of question texts, as columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.functions import fixed_values as fv
from lexgrove.functions.text import first_rule, rx, strip


def keyword_score(text: Column, patterns: Sequence[str]) -> Column:
    """Number of patterns that occur at least once."""
    score = F.lit(0)
    for pattern in patterns:
        score = score + text.rlike(rx(pattern, ignore_case=True)).cast("int")
    return score


def any_pattern(text: Column, patterns: Sequence[str]) -> Column:
    joined = "|".join(f"(?:{p})" for p in patterns)
    return text.rlike(rx(f"(?:{joined})", ignore_case=True))


@dataclass(frozen=True)
class RoutingRules:
    """Pattern lists of the four signals."""

    verdict: Sequence[str] = field(default_factory=lambda: tuple(fv.VERDICT_KEYWORDS))
    legal: Sequence[str] = field(default_factory=lambda: tuple(fv.LEGAL_KEYWORDS))
    trademark: Sequence[str] = field(default_factory=lambda: tuple(fv.TRADEMARK_KEYWORDS))
    advisory: Sequence[str] = field(default_factory=lambda: tuple(fv.ADVISORY_PATTERNS))


def with_route(df: DataFrame, text_col: str, rules: RoutingRules | None = None) -> DataFrame:
    """Add the four scores and ``route``: legal, verdict, trademark or combined.

    Scores are columns of their own, so each pattern runs once per text.
    """
    rules = rules or RoutingRules()
    text = strip(F.coalesce(F.col(text_col), F.lit("")))
    scored = df.withColumns(
        {
            "verdict_score": keyword_score(text, rules.verdict),
            "legal_score": keyword_score(text, rules.legal),
            "trademark_score": keyword_score(text, rules.trademark),
            "advisory": any_pattern(text, rules.advisory),
        }
    )
    v, law, mark = (F.col(f"{n}_score") for n in ("verdict", "legal", "trademark"))
    route = first_rule(
        [
            (text == "", F.lit("legal")),
            (mark >= 2, F.lit("trademark")),
            ((mark >= 1) & (v <= 2) & (law <= 1), F.lit("trademark")),
            (F.col("advisory") & (v >= 1), F.lit("combined")),
            ((v >= 2) & (law >= 2), F.lit("combined")),
            ((v > law) & (v >= 2), F.lit("verdict")),
            ((law > v) & (law >= 1), F.lit("legal")),
            (v >= 1, F.lit("combined")),
        ],
        F.lit("legal"),
    )
    return scored.withColumn("route", route)


Retriever = Callable[[DataFrame], DataFrame]


def fan_out(routed: DataFrame, retrievers: dict[str, Retriever]) -> DataFrame:
    """Send each query to the search of its route; results carry ``route``."""
    parts = [
        search(routed.where(F.col("route") == route)).withColumn("route", F.lit(route))
        for route, search in retrievers.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
