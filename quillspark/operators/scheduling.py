"""Spaced review: a card's memory state after each rating, by the published FSRS model, version 6."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from datetime import datetime, timedelta

# The published default weights of FSRS-6, the steps and bounds of its scheduler.
WEIGHTS = (0.212, 1.2931, 2.3065, 8.2956, 6.4133, 0.8334, 3.0194, 0.001, 1.8722, 0.1666, 0.796, 1.4835, 0.0614, 0.2629, 1.6483, 0.6014, 1.8729, 0.5425, 0.0912, 0.0658, 0.1542)
RATINGS = {"again": 1, "hard": 2, "good": 3, "easy": 4}
LEARNING, REVIEW, RELEARNING = 1, 2, 3
STEPS = {LEARNING: (timedelta(minutes=1), timedelta(minutes=10)), RELEARNING: (timedelta(minutes=10),)}
LEAST_STABILITY, LONGEST_DAYS = 0.001, 36_500


@dataclass(frozen=True)
class Card:
    """A new card has no stability; step is None in review."""

    state: int = LEARNING
    step: int | None = 0
    stability: float | None = None
    difficulty: float | None = None
    last: datetime | None = None
    due: datetime | None = None


@dataclass(frozen=True)
class Scheduler:
    """Intervals for a wanted retention; without the random spread of intervals, so that a log has one outcome."""

    retention: float = 0.9
    w: tuple[float, ...] = WEIGHTS

    @property
    def decay(self) -> float:
        return -self.w[20]

    @property
    def factor(self) -> float:
        return 0.9 ** (1 / self.decay) - 1

    def retrievability(self, card: Card, at: datetime) -> float:
        if card.last is None or card.stability is None:
            return 0.0
        return (1 + self.factor * max(0, (at - card.last).days) / card.stability) ** self.decay

    def interval(self, stability: float) -> timedelta:
        days = round(stability / self.factor * (self.retention ** (1 / self.decay) - 1))
        return timedelta(days=min(max(days, 1), LONGEST_DAYS))

    def first_difficulty(self, g: int) -> float:
        return self.w[4] - math.exp(self.w[5] * (g - 1)) + 1

    def next_difficulty(self, d: float, g: int) -> float:
        damped = d + (10 - d) * -self.w[6] * (g - 3) / 9
        return min(max(self.w[7] * self.first_difficulty(4) + (1 - self.w[7]) * damped, 1.0), 10.0)

    def next_stability(self, card: Card, g: int, at: datetime) -> float:
        w, s, d = self.w, card.stability, card.difficulty
        if (at - card.last).days < 1:  # the same day
            growth = math.exp(w[17] * (g - 3 + w[18])) * s ** -w[19]
            return s * (max(growth, 1.0) if g >= 3 else growth)
        r = self.retrievability(card, at)
        if g == 1:
            long = w[11] * d ** -w[12] * ((s + 1) ** w[13] - 1) * math.exp((1 - r) * w[14])
            return min(long, s / math.exp(w[17] * w[18]))
        spread = {2: w[15], 3: 1.0, 4: w[16]}[g]
        return s * (1 + math.exp(w[8]) * (11 - d) * s ** -w[9] * (math.exp((1 - r) * w[10]) - 1) * spread)

    def review(self, card: Card, rating: str, at: datetime) -> Card:
        """The card after a rating at a time."""
        g = RATINGS[rating]
        if card.stability is None:
            s, d = self.w[g - 1], min(max(self.first_difficulty(g), 1.0), 10.0)
        else:
            s, d = self.next_stability(card, g, at), self.next_difficulty(card.difficulty, g)
        card = replace(card, stability=max(s, LEAST_STABILITY), difficulty=d, last=at)
        state, step, wait = self._next(card, g)
        return replace(card, state=state, step=step, due=at + (self.interval(card.stability) if wait is None else wait))

    @staticmethod
    def _next(card: Card, g: int) -> tuple[int, int | None, timedelta | None]:
        """State, step and waiting time (None: the interval of the stability) after a rating."""
        if card.state == REVIEW:
            return (RELEARNING, 0, STEPS[RELEARNING][0]) if g == 1 else (REVIEW, None, None)
        steps = STEPS[card.state]
        if g == 1:
            return card.state, 0, steps[0]
        if g == 2:
            if card.step == 0:
                return card.state, 0, steps[0] * 1.5 if len(steps) == 1 else (steps[0] + steps[1]) / 2
            return card.state, card.step, steps[card.step]
        if g == 4 or card.step + 1 >= len(steps):
            return REVIEW, None, None
        return card.state, card.step + 1, steps[card.step + 1]
