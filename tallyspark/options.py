"""Tunable limits of the reconciliation."""

from __future__ import annotations

from dataclasses import dataclass

# ---- fixed values -----------------------------------------------------------
SALES, PURCHASE = "Sales Receipt", "Purchase Payment"
MATCHED, COMBINED = "Matched", "Matched (combined)"
PARTIAL, UNMATCHED = "Partially Matched", "Unmatched"
FULLY, PARTLY, NOT_SETTLED = "Fully Settled", "Partially Settled", "Not Settled"
OVERPAID, NEEDS_REVIEW = "Overpaid/Mismatch", "Needs Review"
TWO_WAY, THREE_WAY = "2-way", "3-way"
# -----------------------------------------------------------------------------


@dataclass(frozen=True)
class MatchOptions:
    tolerance_days: int = 5
    min_score: float = 60.0
    matched_score: float = 85.0
    amount_weight: float = 50.0
    date_weight: float = 40.0
    direction_weight: float = 10.0
    max_combination: int = 3
    max_pool: int = 15
    name_threshold: float = 0.75
    fuzzy_threshold: float = 0.6

    def date_score(self, days: int) -> float:
        if days >= self.tolerance_days:
            return 0.0
        return self.date_weight * (1 - days / self.tolerance_days)

    def pair_score(self, exact: bool, days: int, same_direction: bool) -> float:
        return ((self.amount_weight if exact else 0.0) + self.date_score(days)
                + (self.direction_weight if same_direction else 0.0))

    def distances(self, exact: bool, same_direction: bool) -> list[int]:
        """Day distances at which a pair still reaches the minimum score."""
        return [d for d in range(self.tolerance_days + 1)
                if self.pair_score(exact, d, same_direction) >= self.min_score]
