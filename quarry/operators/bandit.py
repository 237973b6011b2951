"""Bandits: epsilon-greedy and UCB1 agents, their batch tables over logs, and the recommender's loop."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .frame import positive
from .stats import running


@dataclass
class Arms:
    n: int
    counts: np.ndarray = field(init=False)
    values: np.ndarray = field(init=False)

    def __post_init__(self):
        positive(n=self.n)
        self.counts, self.values = np.zeros(self.n, int), np.zeros(self.n)

    def update(self, arm: int, reward: float) -> None:
        if not 0 <= arm < self.n:
            raise IndexError(f"no arm {arm}")
        self.counts[arm] += 1
        self.values[arm] += (reward - self.values[arm]) / self.counts[arm]


@dataclass
class EpsilonGreedy(Arms):
    epsilon: float = 0.1
    seed: int = 0

    def __post_init__(self):
        super().__post_init__()
        self.set_epsilon(self.epsilon)
        self.random = np.random.Generator(np.random.PCG64(self.seed))

    def set_epsilon(self, epsilon: float) -> None:
        if not 0 <= epsilon <= 1:
            raise ValueError("epsilon must be from 0 to 1")
        self.epsilon = epsilon

    def select(self) -> int:
        if self.random.random() < self.epsilon:
            return int(self.random.integers(self.n))
        return int(np.argmax(self.values))


@dataclass
class UCB(Arms):
    """Arms not yet pulled come first, in order. The total grows when an arm is selected, not when it is updated."""

    total: int = 0

    def select(self) -> int:
        self.total += 1
        fresh = np.flatnonzero(self.counts == 0)
        if len(fresh):
            return int(fresh[0])
        return int(np.argmax(self.values + np.sqrt(2 * math.log(self.total) / self.counts)))


def arm_values(log: DataFrame, arm: str = "arm", reward: str = "reward") -> DataFrame:
    return log.groupBy(arm).agg(F.count(F.lit(1)).alias("pulls"), F.avg(reward).alias("value"))


def ucb_scores(log: DataFrame, arm: str = "arm", reward: str = "reward") -> DataFrame:
    """value + sqrt(2 ln T / n) for each arm, T being all pulls. The total is one row."""
    values = arm_values(log, arm, reward)
    total = F.broadcast(values.agg(F.sum("pulls").alias("total")))
    return values.crossJoin(total).withColumn("score", F.col("value") + F.sqrt(F.lit(2.0) * F.ln("total") / F.col("pulls"))).drop("total")


def greedy_arm(values: DataFrame, arm: str = "arm", value: str = "value") -> DataFrame:
    """The best arm, the first of equals: one aggregate."""
    return values.agg(F.min(F.struct((-F.col(value)).alias("v"), F.col(arm).alias("arm")))["arm"].alias(arm))


def incremental_means(log: DataFrame, arm: str = "arm", reward: str = "reward", order: str = "t") -> DataFrame:
    """`log` with each arm's mean and number of rewards up to each pull; two-level sums, so that a busy arm isn't one task."""
    sums = running(log, arm, order, reward)
    return sums.withColumn("value", F.col("running_sum") / F.col("running_count")).withColumn("pulls", F.col("running_count")).drop("running_sum", "running_count", "running_max")


def recent(log: DataFrame, keep: int = 200, arm: str = "arm", order: str = "t") -> DataFrame:
    """Each arm's last `keep` rows."""
    return log.withColumn("_rank", F.row_number().over(W.partitionBy(arm).orderBy(F.desc(order)))).filter(F.col("_rank") <= keep).drop("_rank")


@dataclass(frozen=True)
class Session:
    rewards: list[float]
    running: list[float]
    sliding: list[tuple[int, float]]
    arms: list[int]


class Shelf:
    """An arm's items: some in random order (all, or as many as a session can draw) of `size` in all.

    A draw is uniform among the items that aren't among the last `memory` drawn. Items never drawn are alike, so a new one is the
    next in the order, and only how many others there are has to be known.
    """

    def __init__(self, items: np.ndarray, size: int, memory: int):
        self.items, self.size, self.memory, self.drawn, self.fresh = items, size, memory, [], 0

    def draw(self, rng: np.random.Generator) -> np.ndarray | None:
        recent = set(self.drawn[-self.memory :]) if self.memory else set()
        old = sorted(set(self.drawn) - recent)
        free = self.size - self.fresh + len(old)
        if not free:
            return None
        at = int(rng.integers(free))
        if at < len(old):
            self.drawn.append(old[at])
        else:
            self.drawn.append(self.fresh)
            self.fresh += 1
        return self.items[self.drawn[-1]]


def recommend(members: dict[int, np.ndarray], target: np.ndarray, turns: int = 1000, agent: Arms | None = None, schedule: tuple[float, float, float] = (1.0, 0.05, 0.01), window: int = 10, every: int = 5, memory: int = 200, seed: int = 0, sizes: dict[int, int] | None = None) -> Session:
    """The recommender's loop over clusters (arms): pick an arm, then an item of it that isn't among its last `memory` picks.

    The reward is 1 + 9 * sigmoid(20 * (cosine - 0.55)). Every `every` turns the mean of the last `window` rewards before the pull
    is noted. An arm without unused items is passed over; when none has any, the session ends. `sizes`: how many items each arm has, if
    `members` holds only some of them, in random order: min(size, turns) at least.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    arms = sorted(members)
    agent = agent or EpsilonGreedy(len(arms), epsilon=schedule[0], seed=seed)
    shelves = [Shelf(members[a] if sizes else rng.permutation(members[a]), sizes[a] if sizes else len(members[a]), memory) for a in arms]
    rewards, running, sliding, chosen = [], [], [], []
    for turn in range(1, turns + 1):
        if isinstance(agent, EpsilonGreedy):
            agent.set_epsilon(max(schedule[1], schedule[0] * math.exp(-schedule[2] * turn)))
        if turn % every == 0 and rewards:
            sliding.append((turn, float(np.mean(rewards[-window:]))))
        x = None
        for pick in (agent.select(), *range(len(arms))):
            if (x := shelves[pick].draw(rng)) is not None:
                break
        if x is None:
            break
        size = np.linalg.norm(x) * np.linalg.norm(target)
        reward = 1 + 9 / (1 + math.exp(-20 * (float(x @ target) / size - 0.55))) if size else 1.0
        agent.update(pick, reward)
        rewards.append(reward)
        running.append(float(np.mean(rewards)))
        chosen.append(arms[pick])
    return Session(rewards, running, sliding, chosen)
