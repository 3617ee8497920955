"""Column functions for match documents."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference: provider short status -> internal status.
STATUS_CODES = {
    "NS": "SCHEDULED", "TBD": "SCHEDULED",
    "1H": "LIVE", "2H": "LIVE", "HT": "LIVE", "ET": "LIVE", "P": "LIVE",
    "FT": "FINISHED", "AET": "FINISHED", "PEN": "FINISHED",
    "PST": "POSTPONED", "CANC": "POSTPONED", "ABD": "POSTPONED",
}

# Team-name aliases (lower-cased, trimmed key -> canonical name).
TEAM_ALIASES = {
    "usa": "United States",
    "united states of america": "United States",
    "us": "United States",
    "usmnt": "United States",
    "england": "England",
    "korea republic": "South Korea",
    "ir iran": "Iran",
    "czechia": "Czech Republic",
    "türkiye": "Turkey",
    "côte d'ivoire": "Ivory Coast",
}

# Knockout stage lists of the two stage-weight variants.
KNOCKOUT_STAGES = ["ROUND_OF_16", "QUARTER_FINALS", "SEMI_FINALS", "FINAL", "THIRD_PLACE"]
KNOCKOUT_STAGES_SHORT = ["ROUND_OF_16", "QUARTER", "SEMI", "FINAL"]
EXTRA_TIME_MARKERS = ["EXTRA_TIME", "AET", "ET"]
PENALTY_MARKERS = ["PENALTY", "PEN", "SHOOTOUT"]


def _map_literal(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def status_map(short: Column) -> Column:
    """Provider status code -> internal status; unknown codes pass through."""
    return F.coalesce(F.element_at(_map_literal(STATUS_CODES), short), short)


def winner(home_ft: Column, away_ft: Column) -> Column:
    """NULL scores compare as 0; DRAW only when the home score is known."""
    h, a = F.coalesce(home_ft, F.lit(0)), F.coalesce(away_ft, F.lit(0))
    return (F.when(h > a, "HOME_TEAM").when(a > h, "AWAY_TEAM")
            .when(home_ft.isNotNull(), "DRAW"))


def _contains_any(s: Column, needles: list[str]) -> Column:
    return reduce(lambda x, y: x | y, [s.contains(n) for n in needles])


def upper_stage(stage: Column, normalize_separators: bool = False) -> Column:
    s = F.upper(F.coalesce(stage, F.lit("")))
    if normalize_separators:  # "Round of 16" -> "ROUND_OF_16" (SURVEY Q13 option)
        s = F.regexp_replace(s, "[ -]+", "_")
    return s


def went_to_extra_time(stage: Column, strict: bool = False) -> Column:
    """Any of the markers as a substring (loose, as the reference); strict = whole token."""
    s = upper_stage(stage)
    if strict:
        return s.rlike(r"(^|[^A-Z])(EXTRA_TIME|AET|ET)([^A-Z]|$)")
    return _contains_any(s, EXTRA_TIME_MARKERS)


def went_to_penalties(stage: Column) -> Column:
    return _contains_any(upper_stage(stage), PENALTY_MARKERS)


def stage_weight(stage: Column, variant: str = "normalize", normalize_separators: bool = False) -> Column:
    """1.5 for knockout stages, else 1.0. variant 'normalize' or 'engineer' picks the list."""
    stages = KNOCKOUT_STAGES if variant == "normalize" else KNOCKOUT_STAGES_SHORT
    s = upper_stage(stage, normalize_separators)
    return F.when(_contains_any(s, stages), F.lit(1.5)).otherwise(F.lit(1.0))


def normalize_team_name(name: Column) -> Column:
    """Alias lookup on lower(trim(name)); otherwise the trimmed name. Empty/NULL pass."""
    key = F.lower(F.trim(name))
    return (F.when(name.isNull() | (name == ""), name)
            .otherwise(F.coalesce(F.element_at(_map_literal(TEAM_ALIASES), key), F.trim(name))))
