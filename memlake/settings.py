"""Tunable parameters, with the defaults every job falls back to."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # time axis
    timezone: str = "Europe/London"
    boundary_hour: int = 3
    boundary_minute: int = 0
    # token budgets of the write path
    context_total: int = 200_000
    context_free: int = 75_000
    map_prompt: int = 10_000
    reduce_prompt: int = 10_000
    system_prompt: int = 10_000
    reduce_output: int = 10_000
    chunk_max_turns: int = 200
    chars_per_token: int = 2
    retries: int = 1
    # decay, in ISO weeks
    trim_weeks: int = 2
    shallow_weeks: int = 3
    deep_weeks: int = 4
    session_decay_weeks: int = 2
    # recall
    l0_limit: int = 12
    l1_limit: int = 24
    l2_limit: int = 24
    final_limit: int = 8
    max_chars: int = 12_000
    exact_max_chars: int = 10_000
    recent_days: int = 3
    recency_alpha: float = 0.15
    recency_horizon_days: float = 30.0
    window_horizon_days: float = 14.0
    l1_weight: float = 0.7
    l2_weight: float = 0.3
    # landmarks
    landmark_threshold: float = 5.5

    @property
    def map_budget(self) -> int:
        """Tokens one map call may read before its share of reduce input is set aside."""
        return self.context_total - self.context_free - self.map_prompt - self.system_prompt

    @property
    def reduce_budget(self) -> int:
        """Tokens the reduce call may read over all map outputs."""
        return (self.context_total - self.context_free - self.reduce_prompt
                - self.system_prompt - self.reduce_output)


DEFAULTS = Settings()
