"""The settings of a whole run: one part per operator, each declared beside its operator."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from .operators.bursts import Bursts
from .operators.flags import Volumes
from .operators.groups import PATTERN_LEAST, PATTERN_TOP
from .operators.score import Rarity
from .operators.templates import YEAR
from .operators.textvec import TextModel

# fixed values: scores from which entries are flagged
THRESHOLDS = {"low": 0.80, "normal": 0.70, "high": 0.60}

# fixed names: keyword options of ``analyze``, with the part and setting that each one sets
OPTIONS = {
    "eps": (None, "radius"), "min_samples": (None, "core"),
    "flag_threshold": (None, "threshold"), "auto_threshold": (None, "from_scores"),
    "rare_pct": ("rarity", "share"), "rare_min": ("rarity", "least"), "safe_rarity_damp": ("rarity", "safe_damp"),
    "enable_burst": ("bursts", "on"), "burst_window": ("bursts", "width"), "burst_factor": ("bursts", "factor"), "burst_min": ("bursts", "least"),
    "flood_share": ("volumes", "flood"), "incident_share": ("volumes", "incident"),
    "recurring_share": ("volumes", "recurring"), "recurring_min": ("volumes", "recurring_least"),
    "pattern_min": (None, "pattern_least"), "max_patterns": (None, "pattern_top"),
    "text_features": ("text", "size"), "feature_weight": ("text", "weight"), "min_df": ("text", "min_df"),
    "learn_synonyms": (None, "synonyms"), "default_year": (None, "year"),
}


@dataclass(frozen=True)
class Settings:
    """What ``detect`` hands to its operators; the settings at this level belong to the run itself."""

    bursts: Bursts = field(default_factory=Bursts)
    volumes: Volumes = field(default_factory=Volumes)
    rarity: Rarity = field(default_factory=Rarity)
    text: TextModel = field(default_factory=TextModel)
    synonyms: bool = True              # learn them from the lines
    radius: float | None = None        # of clusters; None: from the distances of the templates
    core: int = 4                      # fixed value: weight of a core point
    threshold: float = THRESHOLDS["normal"]
    from_scores: bool = False          # the threshold comes from the scores themselves
    pattern_least: int = PATTERN_LEAST
    pattern_top: int = PATTERN_TOP
    year: int = YEAR


def settings(sensitivity: str = "normal", **options) -> Settings:
    """Settings by sensitivity and single options; options that are None or unknown change nothing."""
    parts: dict[str | None, dict] = {}
    for name, value in options.items():
        if value is not None and name in OPTIONS:
            part, key = OPTIONS[name]
            parts.setdefault(part, {})[key] = value
    plain = {"threshold": THRESHOLDS.get(sensitivity, THRESHOLDS["normal"]), **parts.pop(None, {})}
    base = Settings(**plain)
    return replace(base, **{part: replace(getattr(base, part), **given) for part, given in parts.items()})
