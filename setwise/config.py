"""Settings of a private build, frozen so that one value describes a whole run."""

from __future__ import annotations

import math
from dataclasses import dataclass

#: Fixed value: epsilon spent on each sampled hash function at most.
EPSILON_PER_HASH = 2.1773189849


@dataclass(frozen=True)
class Config:
    """Defaults follow the published experiment, but for sizes that suit small item domains.

    ``budget``: "parity" lets each of a user's two reports spend the whole epsilon; "split" halves it.
    ``smooth``: post-processing of frequency estimates, see ``operators.oue.smooth``.
    ``draws``: "reports" draws every bit of every report, users x domain of them, which SQL can repeat; "aggregate"
    counts true values and draws each element's sum of bits from its binomial law, whatever the number of users.
    The law is the same; domains of thousands of items, or millions of pairs, want "aggregate".
    """

    epsilon: float = 2.0
    alpha: float = 0.2
    hashes: int = 512
    max_depth: int = 3
    fanout: int = 2
    min_child: int = 5
    samples: int = 20
    dual_split: float = 0.5
    alpha_eta: float = 1.0
    hybrid_weight: float = 0.5
    max_queries: int = 999
    seed: int = 2025
    budget: str = "parity"
    smooth: str = "clip"
    draws: str = "reports"

    @property
    def report_epsilon(self) -> float:
        """What one report of a user spends."""
        return self.epsilon / 2 if self.budget == "split" else self.epsilon

    @property
    def hash_choices(self) -> int:
        """Hash functions each user reports on."""
        return max(1, math.ceil(self.report_epsilon / EPSILON_PER_HASH))

    @property
    def hash_epsilon(self) -> float:
        return self.report_epsilon / self.hash_choices

    @property
    def blocks(self) -> int:
        return 2**self.max_depth


def flip_rate(epsilon: float) -> float:
    """Probability that a bit that isn't the true one is reported as set."""
    return 1.0 / (math.exp(epsilon) + 1.0)


#: Probability that the true bit is reported as set.
KEEP_RATE = 0.5
#: The published grid.
EPSILON_GRID = (0.1, 0.5, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0)
