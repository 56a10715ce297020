"""The parameters that analyses share, with their checks."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class QueryOptions:
    """Parameters of all analyses; the defaults are those of the analyses' definitions."""

    #: The moment to look back from; without one, that of the last commit, but never later than now.
    as_of: str | None = None
    #: Count changes under the name their file finally got.
    lineage: bool = False
    min_revs: int = 5
    min_shared_revs: int = 5
    min_coupling_pct: float = 30.0
    max_coupling_pct: float = 100.0
    max_changeset_size: int = 30
    significance: float = 0.05
    fdr_correction: bool = False
    min_soc: int = 1
    expression: str | None = None
    min_clone_node_count: int = 30
    min_clone_shared_revs: int = 3
    clone_similarity_floor: float = 0.70
    clone_skip_same_dir: bool = True
    departed_threshold_days: int = 90
    window_days: int = 90
    rework_window_days: int = 21
    release_tag_glob: str = "v*"
    substantial_share: float = 0.10
    knowledge_model: str = "commits"
    time_bucket: str | None = None
    target: str | None = None
    compat: bool = False
    familiarity_min: float = 70.0
    rows_limit: int | None = None

    def __post_init__(self) -> None:
        if not 0 <= self.min_coupling_pct <= self.max_coupling_pct <= 100:
            raise ValueError("coupling percentages must satisfy 0 <= min <= max <= 100")
        if not 1 <= self.window_days <= 3650:
            raise ValueError("window_days must be between 1 and 3650")
        if not 1 <= self.rework_window_days <= 365:
            raise ValueError("rework_window_days must be between 1 and 365")
        if self.knowledge_model not in ("commits", "doe"):
            raise ValueError("knowledge_model must be commits or doe")
        if self.time_bucket not in (None, "day", "week", "month"):
            raise ValueError("time_bucket must be day, week or month")
        if not 0 < self.significance < 1:
            raise ValueError("significance must be between 0 and 1")
        if self.rows_limit is not None and self.rows_limit < 1:
            raise ValueError("rows_limit must be at least 1")

    def but(self, **changes) -> QueryOptions:
        """The same options with some replaced."""
        return replace(self, **changes)
