"""Tunable constants, in one place; every operator takes them as arguments with these as defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    # Windows, half-lives, thresholds and budgets that results depend on.
    history_days: int = 90
    place_half_life: float = 14.0
    page_half_life: float = 7.0
    bounce_s: float = 10.0
    active: float = 0.5
    probation: float = 0.2
    probation_days: int = 14
    recent_days: int = 30
    page_budget: int = 50
    refresh_s: int = 24 * 3600
    candidates: int = 200
    results: int = 5
    least_probability: float = 0.1
    weights: dict = field(default_factory=lambda: {"bias": -3.0, "days": 1.5, "breadth": 0.5, "bounce": -1.0, "regular": 0.5})
    # hubs
    hub_visits: int = 3
    hub_origins: int = 3
    hub_distinct: float = 0.8
    hub_distinct_brief: float = 0.5
    hub_brief: float = 0.8
    # places
    concentration: float = 0.8
    max_depth: int = 4
    # search
    max_link_texts: int = 10
    alias_boost: float = 3.0
    coverage: float = 2.0
    field_weights: dict = field(default_factory=lambda: {"title": 2.5, "anchors": 3.0, "contexts": 1.5, "headings": 1.0, "snippet": 0.7, "words": 0.5})


DEFAULT = Settings()
