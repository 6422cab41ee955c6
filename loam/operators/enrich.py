"""Screening, quality actions and tags from probability columns.

The scores come from anywhere: rule expressions, a joined table, a remote model. Decisions are
ordered conditions over visible thresholds; a missing score never drops or quarantines.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Thresholds:
    drop_low_information: float = 0.85
    drop_boilerplate: float = 0.85
    quarantine_instructs: float = 0.70
    tag_confidence: float = 0.50
    mode: str = "on"
    screen_paragraphs: str = "on"


@dataclass(frozen=True)
class TagField:
    """A tag with its options; one of them is ``other``."""

    name: str
    options: tuple[str, ...]
    route: bool = False

    def __post_init__(self) -> None:
        if len(self.options) < 2 or "other" not in self.options:
            raise ValueError(f"tag {self.name} needs two options, one of them 'other'")


@dataclass(frozen=True)
class Taxonomy:
    version: str = "1"
    fields: tuple[TagField, ...] = ()
    custom: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        names = [f.name for f in self.fields] + list(self.custom)
        if len(names) != len(set(names)):
            raise ValueError("two fields of the taxonomy have one name")


def screen_action(instructs: Column, boilerplate: Column, t: Thresholds = Thresholds()) -> Column:
    """quarantine, drop or keep a paragraph; raw values are compared."""
    action = F.when(instructs >= t.quarantine_instructs, "quarantine").when(boilerplate >= t.drop_boilerplate, "drop").otherwise("keep")
    return action if t.mode == "on" else F.lit("keep")


def enrich_action(instructs: Column, boilerplate: Column, low_information: Column, t: Thresholds = Thresholds()) -> Column:
    """What happens to a chunk; values are rounded to four places first."""
    r = lambda c: F.round(c, 4)
    action = (
        F.when(r(instructs) >= t.quarantine_instructs, "quarantine")
        .when(r(boilerplate) >= t.drop_boilerplate, "drop_boilerplate")
        .when(r(low_information) >= t.drop_low_information, "drop_low_information")
        .otherwise("keep")
    )
    return action if t.mode in ("on", "shadow") else F.lit("keep")


def tag_value(choice: Column, confidence: Column, t: Thresholds = Thresholds()) -> Column:
    """The chosen option where it is confident enough, else ``unknown``."""
    return F.when((confidence >= t.tag_confidence) & choice.isNotNull(), choice).otherwise("unknown")


def enrich(chunks: DataFrame, t: Thresholds = Thresholds(), failed: str | None = None, taxonomy: Taxonomy = Taxonomy()) -> DataFrame:
    """Add action, quarantined, dropped_reason, shadow_action, needs_reenrich and the tags.

    Expects ``instructs_ai``, ``boilerplate`` and ``low_information``, and per tag ``<name>_choice`` and
    ``<name>_confidence``; a tag without them is ``unknown``. Rows whose ``failed`` column is true are kept and
    marked for another run. In shadow mode every chunk is kept and ``shadow_action`` tells what would have been done.
    """
    broken = F.coalesce(F.col(failed), F.lit(False)) if failed else F.lit(False)
    decided = F.when(broken, "keep").otherwise(enrich_action(F.col("instructs_ai"), F.col("boilerplate"), F.col("low_information"), t))
    shadow = t.mode == "shadow"
    out = chunks.withColumns({
        "action": F.lit("keep") if shadow else decided,
        "shadow_action": F.when(decided != "keep", decided) if shadow else F.lit(None).cast("string"),
    })
    for tag in taxonomy.fields:
        choice, sure = f"{tag.name}_choice", f"{tag.name}_confidence"
        known = choice in chunks.columns and sure in chunks.columns and t.mode != "off"
        value = F.when(broken, "unknown").otherwise(tag_value(F.col(choice), F.col(sure), t)) if known else F.lit("unknown")
        out = out.withColumns({f"tag_{tag.name}": value, f"tag_{tag.name}_p": F.round(sure, 4) if known else F.lit(None).cast("double")})
    return out.withColumns(
        {
            "quarantined": F.col("action") == "quarantine",
            "dropped_reason": F.when(F.col("action").startswith("drop_"), F.substring("action", 6, 100)),
            "needs_reenrich": broken,
        }
    )


# ---------------------------------------------------------------- rule scores

def rule_scores(text: Column) -> dict[str, Column]:
    """Deterministic stand-ins for the model's probabilities."""
    low = F.lower(text)
    words = F.regexp_count(text, F.lit("[A-Za-z0-9]+"))
    return {
        "low_information": F.when(words < 4, 0.9).otherwise(0.05),
        "boilerplate": F.when(low.rlike("cookie|privacy|copyright|license|subscribe"), 0.95).otherwise(0.03),
        "instructs_ai": F.when(low.contains("ignore all previous instructions"), 0.97).otherwise(0.02),
        "self_contained": F.when(low.rlike("^(this|it|they) "), 0.3).otherwise(0.85),
    }


def overlap_score(query: Column, passage: Column) -> Column:
    """Share of the query's distinct words that the passage has, to four places."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), " "), lambda w: w != ""))
    asked = words(query)
    return F.when(F.size(asked) > 0, F.round(F.size(F.array_intersect(asked, words(passage))) / F.size(asked), 4)).otherwise(F.lit(0.0))
