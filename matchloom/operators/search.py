"""Parameter search by Parzen estimators: the next trial is drawn where good trials are dense and bad ones are not."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target


@dataclass(frozen=True)
class Span:
    """The values of a parameter between two ends; by logarithm, or in whole steps where a step is given."""

    low: float
    high: float
    log: bool = False
    step: int | None = None

    def unit(self, value: float) -> float:
        """Where a value lies between the ends, from 0 to 1; what is outside them counts as the nearer end."""
        value = min(max(value, self.low), self.high)
        if self.log:
            return math.log(value / self.low) / math.log(self.high / self.low)
        return (value - self.low) / (self.high - self.low)

    def value(self, unit: float) -> float:
        raw = self.low * (self.high / self.low) ** unit if self.log else self.low + unit * (self.high - self.low)
        if self.step:
            return int(min(self.high, self.low + self.step * round((raw - self.low) / self.step)))
        return round(raw, 8)


#: The ranges of the eight parameters. The last two hold back splits as the penalties on leaf weights do.
BOOST_SPACE = {
    "trees": Span(200, 800, step=100),
    "depth": Span(3, 9, step=1),
    "step": Span(0.01, 0.20, log=True),
    "minInstancesPerNode": Span(1, 10, step=1),
    "subsample": Span(0.6, 1.0),
    "features": Span(0.6, 1.0),
    "minInfoGain": Span(1e-5, 1e-1, log=True),
    "minWeightFractionPerNode": Span(1e-4, 5e-2, log=True),
}


@dataclass(frozen=True)
class Trial:
    number: int
    params: dict[str, float]
    score: float
    result: object = field(default=None, compare=False, repr=False)


class Parzen:
    """A mixture on [0, 1]: a flat part, and a cut normal around each point as wide as the gap to its neighbours."""

    def __init__(self, points: list[float]):
        self.points = sorted(points)
        edges = [0.0, *self.points, 1.0]
        narrowest = 1.0 / min(100.0, 1.0 + len(points))
        self.widths = [min(1.0, max(edges[i + 1] - edges[i], edges[i + 2] - edges[i + 1], narrowest)) for i in range(len(self.points))]

    def draw(self, dice: random.Random) -> float:
        which = dice.randrange(len(self.points) + 1)
        if which == len(self.points):
            return dice.random()
        while True:
            x = dice.gauss(self.points[which], self.widths[which])
            if 0.0 <= x <= 1.0:
                return x

    def density(self, x: float) -> float:
        total = 1.0
        for at, width in zip(self.points, self.widths, strict=True):
            inside = 0.5 * (math.erf((1.0 - at) / (width * math.sqrt(2))) + math.erf(at / (width * math.sqrt(2))))
            total += math.exp(-0.5 * ((x - at) / width) ** 2) / (width * math.sqrt(2 * math.pi) * inside)
        return total / (len(self.points) + 1)


def suggest(space: dict[str, Span], done: list[Trial], number: int, seed: int, start: int = 10, draws: int = 24) -> dict[str, float]:
    """The parameters of a trial, from its number, the seed and the trials that are done: always the same for the same.

    Until `start` trials are done, it is drawn evenly. Then the best tenth of them, one at least, makes the good density
    of each parameter and the others the bad one; of `draws` values of the good density the one with the greatest ratio
    of good to bad is taken.
    """
    dice = random.Random(f"{seed}/{number}")
    if len(done) < start:
        return {name: span.value(dice.random()) for name, span in space.items()}
    ranked = sorted(done, key=lambda t: (-t.score, t.number))
    n_good = min(25, math.ceil(len(ranked) / 10))
    found = {}
    for name, span in space.items():
        good, bad = (Parzen([span.unit(t.params[name]) for t in part]) for part in (ranked[:n_good], ranked[n_good:]))
        tried = [good.draw(dice) for _ in range(draws)]
        found[name] = span.value(max(tried, key=lambda x: good.density(x) / bad.density(x)))
    return found


def search(
    objective: Callable[[dict[str, float]], tuple[float, object]], space: dict[str, Span], trials: int, seed: int = 42,
    at_once: int = 4, first: dict[str, float] | None = None, start: int = 10,
) -> list[Trial]:
    """All trials by number. `objective` gives a score, of which more is better, and what belongs to it.

    Trials run in waves of `at_once` Spark jobs side by side; a wave is drawn from the waves before it, so that a rerun
    has the same trials whatever ends first. `first` is trial 0 where it is given, so the best is no worse than it.
    """
    done: list[Trial] = []
    with ThreadPoolExecutor(at_once) as pool:
        while len(done) < trials:
            numbers = range(len(done), min(trials, len(done) + at_once))
            wave = [dict(first) if first and n == 0 else suggest(space, done, n, seed, start) for n in numbers]
            ended = list(pool.map(inheritable_thread_target(objective), wave))
            done += [Trial(n, params, score, result) for n, params, (score, result) in zip(numbers, wave, ended, strict=True)]
    return done


def best_trial(done: list[Trial]) -> Trial:
    """The trial with the greatest score, the first of equals."""
    return min(done, key=lambda t: (-t.score, t.number))
