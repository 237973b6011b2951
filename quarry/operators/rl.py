"""Reinforcement learning on n x n tic-tac-toe: environment, replay memory, DQN, REINFORCE, parallel evaluation and sweeps.

An agent trains where it is; games for evaluation and configurations of a sweep are rows, played in the tasks.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import add, and_, or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from .nn import Sequential
from .optim import Optimizer
from .ranges import discounted_scan

#: Rewards of a win, a loss, a draw, a move that blocks the second player's line, an invalid move.
WIN, LOSS, DRAW, BLOCK, INVALID = 1.0, -1.0, 0.1, 0.6, -10.0
MASKED = -1e9


class TicTacToe:
    def __init__(self, n: int = 3):
        if n < 1:
            raise ValueError("the board needs a cell")
        self.n = n
        rows = np.arange(n * n).reshape(n, n)
        self.lines = np.vstack([rows, rows.T, np.diag(rows), np.diag(rows[:, ::-1])])
        self.reset()

    def reset(self) -> np.ndarray:
        self.board, self.player, self.over, self.winner = np.zeros(self.n * self.n, int), 1, False, 0
        return self.state()

    def state(self) -> np.ndarray:
        """One-hot cells of the first player, then of the second."""
        return np.concatenate([self.board == 1, self.board == 2]).astype(np.float32)

    def valid(self) -> np.ndarray:
        return np.flatnonzero(self.board == 0)

    def has_line(self, player: int) -> bool:
        return bool((self.board[self.lines] == player).all(1).any())

    def step(self, action: int) -> tuple[np.ndarray, float]:
        """The state and reward after a move. A win or draw replaces the bonus for a block."""
        if self.over or not 0 <= action < len(self.board) or self.board[action]:
            return self.state(), INVALID
        reward = 0.0
        if self.player == 1:
            self.board[action] = 2
            reward = BLOCK if self.has_line(2) else 0.0
        self.board[action] = self.player
        if self.has_line(self.player):
            self.over, self.winner = True, self.player
            reward = WIN if self.player == 1 else LOSS
        elif not (self.board == 0).any():
            self.over, reward = True, DRAW
        self.player = 3 - self.player
        return self.state(), reward

    def line_potential(self, cell: int, player: int) -> float:
        """0.05 times the player's share of each open line through a cell (lines without the opponent)."""
        lines = self.lines[(self.lines == cell).any(1)]
        cells = self.board[lines]
        return float(0.05 / self.n * ((cells == player).sum(1) * (cells != 3 - player).all(1)).sum())

    def move_quality(self, cell: int, player: int) -> float:
        """3 for a block, 0.2 for the centre of an odd board, 0.15 for a corner, and the potential of the lines."""
        before = self.board[cell]
        self.board[cell] = 3 - player
        quality = 3.0 if self.has_line(3 - player) else 0.0
        self.board[cell] = player
        row, column = divmod(cell, self.n)
        quality += 0.2 if self.n % 2 and row == column == self.n // 2 else 0.0
        quality += 0.15 if row in (0, self.n - 1) and column in (0, self.n - 1) else 0.0
        quality += self.line_potential(cell, player)
        self.board[cell] = before
        return quality


@dataclass(frozen=True)
class Sample:
    state: np.ndarray
    action: int
    reward: float
    next_state: np.ndarray
    done: bool


class ReplayMemory:
    """A bounded memory. Sampling shuffles it in place, so that what is dropped afterwards isn't the oldest sample."""

    def __init__(self, capacity: int, seed: int = 0):
        if capacity < 1:
            raise ValueError("capacity must be positive")
        self.held: deque[Sample] = deque(maxlen=capacity)
        self.random = np.random.Generator(np.random.PCG64(seed))

    def __len__(self) -> int:
        return len(self.held)

    def add(self, sample: Sample) -> None:
        self.held.append(sample)

    def sample(self, n: int) -> list[Sample]:
        order = self.random.permutation(len(self.held))
        self.held = deque([self.held[i] for i in order], maxlen=self.held.maxlen)
        return [self.held[i] for i in range(min(n, len(self.held)))]


@dataclass
class DQN:
    policy: Sequential
    optimizer: Optimizer
    epsilon: float = 1.0
    epsilon_end: float = 0.05
    epsilon_decay: float = 0.99
    gamma: float = 0.9
    batch_size: int = 32
    update_frequency: int = 100
    capacity: int = 10_000
    seed: int = 0
    updates: int = 0

    def __post_init__(self):
        self.target = self.policy.copy()
        self.memory = ReplayMemory(self.capacity, self.seed)
        self.random = np.random.Generator(np.random.PCG64(self.seed))

    def act(self, state: np.ndarray, valid: np.ndarray, explore: bool = True) -> int:
        if explore and self.random.random() < self.epsilon:
            return int(self.random.choice(valid))
        values = self.policy(state[None].astype(float))[0]
        return int(valid[np.argmax(values[valid])])

    def update(self) -> None:
        """One step on a batch: target r + gamma * max over all actions of the target network."""
        if len(self.memory) < self.batch_size:
            return
        batch = self.memory.sample(self.batch_size)
        states, following = np.array([s.state for s in batch], float), np.array([s.next_state for s in batch], float)
        actions, done = np.array([s.action for s in batch]), np.array([s.done for s in batch])
        goal = np.array([s.reward for s in batch]) + np.where(done, 0.0, self.gamma * self.target(following).max(1))
        seen = self.policy.forward(states)
        upstream = np.zeros_like(seen[-1])
        at = np.arange(len(batch)), actions
        upstream[at] = seen[-1][at] - goal
        self.policy = self.policy.with_parameters(self.optimizer.step(self.policy.parameters(), self.policy.backward(seen, upstream) / len(batch)))
        self.updates += 1
        if self.updates % self.update_frequency == 0:
            self.target = self.policy.copy()

    def decay(self) -> None:
        if self.epsilon > self.epsilon_end:
            self.epsilon *= self.epsilon_decay


def discounted(rewards: np.ndarray, gamma: float) -> np.ndarray:
    out, after = np.zeros(len(rewards)), 0.0
    for t in reversed(range(len(rewards))):
        out[t] = after = rewards[t] + gamma * after
    return out


def normalized(returns: np.ndarray) -> np.ndarray:
    """Zero mean, unit population deviation; unchanged if the deviation is 1e-8 or less."""
    spread = returns.std() if len(returns) else 0.0
    return (returns - returns.mean()) / spread if spread > 1e-8 else returns


@dataclass
class Reinforce:
    """Policy gradients over valid actions only; with a critic, a value network that learns beside the policy.

    The target of a step is its discounted return (`reward_to_go`) or its episode's first one, by default normalised in each episode.
    `subtract_baseline` takes the critic's value off the target; the critic descends on (value - target) squared.
    """

    policy: Sequential
    optimizer: Optimizer
    gamma: float = 0.9
    seed: int = 0
    critic: Sequential | None = None
    critic_optimizer: Optimizer | None = None
    normalize: bool = True
    subtract_baseline: bool = False
    reward_to_go: bool = True
    episodes: list[list[tuple[np.ndarray, int, float, np.ndarray]]] = field(default_factory=list)

    def __post_init__(self):
        if self.subtract_baseline and self.critic is None:
            raise ValueError("a baseline needs a critic")
        if self.critic is not None and self.critic_optimizer is None:
            raise ValueError("a critic needs an optimizer of its own")
        self.random = np.random.Generator(np.random.PCG64(self.seed))

    def probabilities(self, states: np.ndarray, masks: np.ndarray) -> np.ndarray:
        logits = np.where(masks, self.policy(states), MASKED)
        e = np.where(masks, np.exp(logits - logits.max(1, keepdims=True)), 0.0)
        return e / (e.sum(1, keepdims=True) + 1e-10)

    def act(self, state: np.ndarray, valid: np.ndarray, explore: bool = True) -> int:
        mask = np.zeros((1, len(state) // 2), bool)
        mask[0, valid] = True
        p = self.probabilities(state[None].astype(float), mask)[0]
        return int(self.random.choice(len(p), p=p / p.sum())) if explore else int(np.argmax(p))

    def targets(self, episode: list) -> np.ndarray:
        returns = discounted(np.array([reward for _, _, reward, _ in episode]), self.gamma)
        returns = normalized(returns) if self.normalize and len(returns) > 1 else returns
        return returns if self.reward_to_go else np.full(len(returns), returns[0])

    def update(self) -> dict[str, float]:
        """One step of both networks on the episodes held, which are then let go; the step count and means over steps of the policy's
        loss, the critic's (0 without one) and the entropy."""
        held, self.episodes = [e for e in self.episodes if e], []
        if not held:
            return {"policy_loss": 0.0, "critic_loss": 0.0, "entropy": 0.0, "steps": 0}
        steps = [step for e in held for step in e]
        states, masks = np.array([x[0] for x in steps], float), np.array([x[3] for x in steps])
        at, target = (np.arange(len(steps)), [x[1] for x in steps]), np.concatenate([self.targets(e) for e in held])
        advantage, critic_loss = target, 0.0
        if self.critic is not None:
            values = self.critic.forward(states)
            error = values[-1][:, 0] - target
            advantage, critic_loss = (-error if self.subtract_baseline else target), float((error * error).mean())
            slope = self.critic.backward(values, 2 * error[:, None]) / len(held)
            self.critic = self.critic.with_parameters(self.critic_optimizer.step(self.critic.parameters(), slope))
        p = self.probabilities(states, masks)
        upstream = p.copy()
        upstream[at] -= 1
        upstream *= advantage[:, None]
        slope = self.policy.backward(self.policy.forward(states), upstream * masks) / len(held)
        self.policy = self.policy.with_parameters(self.optimizer.step(self.policy.parameters(), slope))
        entropy = -(p * np.log(np.maximum(p, 1e-8))).sum(1)
        return {"policy_loss": float((-advantage * np.log(np.maximum(p[at], 1e-8))).mean()), "critic_loss": critic_loss, "entropy": float(entropy.mean()), "steps": len(steps)}


def policy_losses(steps: DataFrame | GroupedData, probabilities: str = "p", action: str = "action", value: str = "value", target: str = "target", baseline: bool = True) -> DataFrame:
    """(policy_loss, critic_loss, entropy, steps): means over a log of steps (or its groups), one row for each. `action` counts from 0; probabilities
    below 1e-8 count as that in logarithms and not at all in the entropy; with `baseline` the advantage is target - value."""
    advantage = F.col(target) - F.col(value) if baseline else F.col(target)
    chosen = F.ln(F.greatest(F.get(probabilities, F.col(action)), F.lit(1e-8)))
    entropy = F.aggregate(probabilities, F.lit(0.0), lambda total, p: total + F.when(p > 1e-8, -p * F.ln(p)).otherwise(0.0))
    return steps.agg(F.avg(-advantage * chosen).alias("policy_loss"), F.avg((F.col(value) - F.col(target)) ** 2).alias("critic_loss"), F.avg(entropy).alias("entropy"), F.count(F.lit(1)).alias("steps"))


def move_quality(board: Column, cell: Column, player: int, n: int) -> Column:
    """As TicTacToe.move_quality, of a board of n * n cells (0: empty) in an array column and a cell counted from 0."""
    env = TicTacToe(n)
    set_to = lambda who: [F.when(cell == i, F.lit(who)).otherwise(board[i]) for i in range(n * n)]
    theirs, ours = set_to(3 - player), set_to(player)
    lines = env.lines.tolist()
    blocks = reduce(or_, [reduce(and_, [theirs[i] == 3 - player for i in line]) for line in lines])
    corner, centre = [0, n - 1, n * n - n, n * n - 1], [n * n // 2] if n % 2 else []
    quality = F.when(blocks, 3.0).otherwise(0.0) + F.when(cell.isin(centre), 0.2).otherwise(0.0) + F.when(cell.isin(corner), 0.15).otherwise(0.0)
    for line in lines:
        held = reduce(add, [(ours[i] == player).cast("int") for i in line])
        is_open = reduce(and_, [ours[i] != 3 - player for i in line])
        quality = quality + F.when(cell.isin(line) & is_open, 0.05 / n * held).otherwise(0.0)
    return quality


def play(act, env: TicTacToe, random: np.random.Generator, seen=None) -> int:
    """One game against a random second player; the winner, 0 for a draw. `seen` gets (state, action, reward, next state, over, mask)."""
    state = env.reset()
    while not env.over:
        mask = env.board == 0
        action = act(state, env.valid())
        after, reward = env.step(action)
        if not env.over:
            _, lost = env.step(int(random.choice(env.valid())))
            reward = LOSS if env.over and env.winner == 2 else DRAW if env.over else reward
        if seen is not None:
            seen(state, action, reward, after, env.over, mask)
        state = env.state()
    return env.winner


@dataclass(frozen=True)
class Config:
    name: str = "default"
    algorithm: str = "dqn"
    board: int = 3
    hidden: tuple[int, ...] = (32, 32)
    optimizer: str = "adam"
    learning_rate: float = 0.001
    gamma: float = 0.4
    epsilon_start: float = 1.0
    epsilon_end: float = 0.05
    epsilon_decay: float = 0.99
    batch_size: int = 32
    update_frequency: int = 100
    episodes: int = 500
    seed: int = 0
    #: (inputs, outputs, seed) -> network, in place of the layers of `hidden`.
    network: Callable[[int, int, int], Sequential] | None = None
    critic: bool = False
    critic_rate: float = 0.005
    normalize: bool = True
    subtract_baseline: bool = False
    reward_to_go: bool = True

    def build(self, outputs: int, seed: int) -> Sequential:
        inputs = 2 * self.board * self.board
        return self.network(inputs, outputs, seed) if self.network else Sequential.build([inputs, *self.hidden, outputs], "relu", seed)


def train_agent(c: Config) -> DQN | Reinforce:
    net = c.build(c.board * c.board, c.seed)
    rng, env = np.random.Generator(np.random.PCG64(c.seed + 1)), TicTacToe(c.board)
    if c.algorithm == "dqn":
        agent = DQN(net, Optimizer(c.optimizer, c.learning_rate), c.epsilon_start, c.epsilon_end, c.epsilon_decay, c.gamma, c.batch_size, c.update_frequency, seed=c.seed)

        def note(state, action, reward, after, over, mask):
            agent.memory.add(Sample(state, action, reward, after, over))
            agent.update()

        for _ in range(c.episodes):
            play(agent.act, env, rng, note)
            agent.decay()
        return agent
    if c.algorithm == "reinforce":
        critic = {"critic": c.build(1, c.seed + 2), "critic_optimizer": Optimizer(c.optimizer, c.critic_rate)} if c.critic else {}
        agent = Reinforce(net, Optimizer(c.optimizer, c.learning_rate), c.gamma, c.seed, normalize=c.normalize, subtract_baseline=c.subtract_baseline, reward_to_go=c.reward_to_go, **critic)
        for episode in range(c.episodes):
            steps: list = []
            play(agent.act, env, rng, lambda s, a, r, n, o, m, steps=steps: steps.append((s, a, r, m)))
            agent.episodes.append(steps)
            if (episode + 1) % c.batch_size == 0:
                agent.update()
        return agent
    raise ValueError(f"unknown algorithm {c.algorithm!r}")


def evaluate_agent(spark: SparkSession, policy: Sequential | None, games: int = 10_000, board: int = 3, seed: int = 0) -> DataFrame:
    """(game, outcome): games of a greedy policy (None: random moves) against random moves; each row is a game with its own seed."""
    shared = spark.sparkContext.broadcast(policy)

    def run(frames):
        net, env = shared.value, TicTacToe(board)
        for frame in frames:
            out = []
            for game in frame["id"]:
                rng = np.random.Generator(np.random.PCG64([seed, int(game)]))

                def act(state, valid, rng=rng):
                    return int(rng.choice(valid)) if net is None else int(valid[np.argmax(net(state[None].astype(float))[0][valid])])

                out.append(("draw", "win", "loss")[play(act, env, rng)])
            yield pd.DataFrame({"game": frame["id"], "outcome": out})

    return spark.range(games).mapInPandas(run, "game long, outcome string")


def sweep(spark: SparkSession, configs: list[Config], games: int = 1000) -> DataFrame:
    """(name, episodes, wins, losses, draws) of each configuration, trained and evaluated in a task of its own."""
    rows = spark.createDataFrame([(i, c.name) for i, c in enumerate(configs)], "number int, name string").repartition(len(configs), "number")
    shared = spark.sparkContext.broadcast(configs)

    def run(frames):
        for frame in frames:
            for number in frame["number"]:
                c = shared.value[number]
                agent, env = train_agent(c), TicTacToe(c.board)
                rng = np.random.Generator(np.random.PCG64([c.seed, 77]))
                won = [play(lambda s, v, a=agent: a.act(s, v, False), env, rng) for _ in range(games)]
                yield pd.DataFrame([{"name": c.name, "episodes": c.episodes, "wins": won.count(1), "losses": won.count(2), "draws": won.count(0)}])

    return rows.mapInPandas(run, "name string, episodes int, wins long, losses long, draws long")


def episode_returns(steps: DataFrame, gamma: float, episode: str = "episode_id", t: str = "t", reward: str = "reward") -> DataFrame:
    """Adds `ret` = r + gamma * next ret, and `normalized` (by episode, population deviation; unchanged at 1e-8 or less): see `ranges.discounted_scan`."""
    return discounted_scan(steps.select(episode, t, reward), gamma, episode, t, reward)
