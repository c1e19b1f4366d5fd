"""Following a position in a corpus of texts: a filter over every word, as a grouped-map and a stateful streaming operator.

The belief is a distribution over all words of all texts plus a state for "none of them". Per window: predict (a
truncated Poisson step, a few words back, any line of the same text, a floor over the corpus), then weigh by
exp(-kappa * edits above the best). One group is one listener; groups are independent, so Spark spreads them by key.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.kernels import semiglobal_batch, semiglobal_costs


@dataclass(frozen=True)
class Settings:
    """Names and defaults are fixed values: settings are given by these names (`Settings.parse`), and the defaults decide what is shown."""

    kappa: float = 0.15
    kappa_search: float = 1.2
    lock_confidence: float = 0.95
    max_speed: float = 4.0
    speeds: tuple[float, ...] = (0.59, 0.99, 1.15, 1.3, 1.44, 1.55, 1.67, 1.84, 2.05, 2.39)
    tempo_memory: float = 0.98
    p_back: float = 0.1
    back_words: int = 8
    p_teleport: float = 0.01
    p_teleport_locked: float = 0.01
    p_line_jump: float = 0.02
    start_weight: float = 0.3
    start_words: int = 12
    popularity: float = 0.5
    null_rate: float = 0.45
    null_enter: float = 0.002
    null_leave: float = 0.05
    min_dua_confidence: float = 0.7

    @classmethod
    def parse(cls, assignments: Iterable[str]) -> Settings:
        """From FIELD=VALUE; tuples take their numbers separated by commas."""
        given = {}
        for assignment in assignments:
            name, _, value = assignment.partition("=")
            kind = {f.name: type(f.default) for f in fields(cls)}[name]
            given[name] = tuple(map(float, value.split(","))) if kind is tuple else kind(value)
        return cls(**given)


@dataclass
class Index:
    """Words of all texts in one flat array of letters, in text order."""

    texts: list[str]
    lines: list[list[tuple[int, str]]]  # per text: (line number, normalised words joined by spaces)
    weight: list[float] = field(default_factory=list)

    def __post_init__(self) -> None:
        letters, self.text_of, self.line_of, ends = [], [], [], []
        for t, lines in enumerate(self.lines):
            for number, line in lines:
                for word in line.split():
                    letters += map(ord, word)
                    ends.append(len(letters))
                    self.text_of.append(t)
                    self.line_of.append(number)
        self.letters, self.ends = np.array(letters, np.int64), np.array(ends, np.int64)
        self.text_of, self.line_of = np.array(self.text_of, np.int64), np.array(self.line_of, np.int64)
        self.first = np.searchsorted(self.text_of, np.arange(len(self.texts) + 1))
        same = (self.text_of[1:] == self.text_of[:-1]) & (self.line_of[1:] == self.line_of[:-1]) if len(ends) else np.zeros(0, bool)
        self.line_first = np.flatnonzero(np.concatenate(([True], ~same))) if len(ends) else np.zeros(0, np.int64)

    @property
    def n(self) -> int:
        return len(self.ends)

    def costs(self, fragment: str) -> np.ndarray:
        """Edits of the fragment ending at each word's last letter (so that no word ties with the one after it)."""
        return semiglobal_costs(np.array([ord(c) for c in fragment if c != " "], np.int64), self.letters)[self.ends]

    def costs_of(self, fragments: list[str]) -> np.ndarray:
        """The same for many fragments, in one walk over the texts."""
        return semiglobal_batch([np.array([ord(c) for c in f if c != " "], np.int64) for f in fragments], self.letters, self.ends)


class Tracker:
    def __init__(self, index: Index, settings: Settings = Settings()):
        self.ix, self.s = index, settings
        weight = np.array(index.weight or [0.0] * len(index.texts))
        share = (weight + 1) ** settings.popularity
        share /= share.sum()
        size = np.maximum(np.diff(index.first), 1)
        at = np.arange(index.n) - index.first[index.text_of]
        head = np.minimum(size, settings.start_words)
        by_word = settings.start_weight * (at < settings.start_words) / head[index.text_of] + (1 - settings.start_weight) / size[index.text_of]
        self.floor = by_word * share[index.text_of]
        self.belief = self.floor * 0.98
        self.none = 0.02
        self.tempo = np.full(len(settings.speeds), 1 / len(settings.speeds))
        self.last: float | None = None

    def _shift(self, p: np.ndarray, step: int) -> np.ndarray:
        """Mass `step` words on (or back); it stays inside its text."""
        to = np.clip(np.arange(self.ix.n) + step, self.ix.first[self.ix.text_of], self.ix.first[self.ix.text_of + 1] - 1)
        return np.bincount(to, weights=p, minlength=self.ix.n)

    def _predictions(self, dt: float) -> np.ndarray:
        s = self.s
        most = math.ceil(s.max_speed * dt)
        moved = np.stack([self._shift(self.belief, k) for k in range(most + 1)])
        back = sum(self._shift(self.belief, -k) for k in range(1, s.back_words + 1)) / s.back_words
        per_text = np.add.reduceat(np.append(self.belief, 0.0), self.ix.first[:-1]) if self.ix.n else np.zeros(0)
        lines = np.zeros(self.ix.n)
        starts = self.ix.line_first
        count = np.bincount(self.ix.text_of[starts], minlength=len(per_text))
        lines[starts] = per_text[self.ix.text_of[starts]] / count[self.ix.text_of[starts]]
        jump = min(1.0, s.p_line_jump * dt)
        out = []
        for speed in s.speeds:
            lam = speed * dt
            p = np.array([math.exp(-lam + k * math.log(lam) - math.lgamma(k + 1)) if lam > 0 else float(k == 0) for k in range(most + 1)])
            p /= p.sum()
            ahead = p @ moved
            step = (1 - s.p_back) * ahead + s.p_back * back
            out.append((1 - jump) * step + jump * lines)
        return np.stack(out)

    def update(self, t: float, fragment: str, cost: np.ndarray | None = None) -> dict:
        """The position after a window; `cost`: its costs at each word, if they are known already."""
        dt = 0.0 if self.last is None or not fragment else max(0.0, t - self.last)
        self.last = t
        s = self.s
        each = self._predictions(dt) if dt > 0 else np.repeat(self.belief[None], len(s.speeds), 0)
        known = self.belief.sum()
        floor = s.p_teleport_locked if self.position()["confidence"] >= s.lock_confidence else s.p_teleport
        each = (1 - floor) * each + floor * known * self.floor
        if not fragment:
            self.belief = self.tempo @ each
            return self.position()
        letters = len(fragment.replace(" ", ""))
        cost = (self.ix.costs(fragment) if cost is None else cost).astype(float)
        peak = self.position()["confidence"]
        kappa = s.kappa if peak >= s.lock_confidence else s.kappa_search
        best = min(cost.min(initial=math.inf), s.null_rate * letters)
        like = np.exp(-kappa * (cost - best))
        none_like = math.exp(-kappa * (s.null_rate * letters - best))
        leave = s.null_leave * self.none
        each = each * (1 - s.null_enter) + leave * self.floor
        none = self.none * (1 - s.null_leave) + s.null_enter * known
        evidence = each @ like
        self.tempo = self.tempo**s.tempo_memory * np.maximum(evidence, 1e-300)
        self.tempo /= self.tempo.sum()
        self.belief = (self.tempo @ each) * like
        self.none = none * none_like
        total = self.belief.sum() + self.none
        self.belief, self.none = self.belief / total, self.none / total
        return self.position()

    def position(self) -> dict:
        mass = np.bincount(self.ix.text_of, weights=self.belief, minlength=len(self.ix.texts))
        top = int(mass.argmax())
        out = {"text": None, "confidence": float(mass[top]), "line": None, "word": None}
        if mass[top] >= self.s.min_dua_confidence:
            a, b = self.ix.first[top], self.ix.first[top + 1]
            lines, inverse = np.unique(self.ix.line_of[a:b], return_inverse=True)
            by_line = np.bincount(inverse, weights=self.belief[a:b])
            line = int(by_line.argmax())
            inside = np.flatnonzero(inverse == line)
            run = np.cumsum(self.belief[a:b][inside])
            word = int(inside[np.searchsorted(run, run[-1] / 2)])
            out |= {"text": self.ix.texts[top], "line": int(lines[line]), "word": word}
        return out


def check_size(letters: int) -> None:
    """Refuses an index of more than 256 MB, at eight bytes a letter."""
    if 8 * letters > 256 << 20:
        raise ValueError("the reference corpus is too large to hold in each worker")


POSITION = "rec string, t double, text string, line int, word int, confidence double"


DEAL, CHUNK = 256, 512  # windows in a deal, about; windows whose costs are found in one walk over the texts


def follow(windows: DataFrame, index: Index, settings: Settings = Settings()) -> DataFrame:
    """windows (rec, t, fragment: normalised words) -> a position per window. The index must be small: its size is checked before it travels.

    Recordings are dealt by the number of windows there are, so that tasks do not depend on how small the rows are; a task
    finds the costs of many windows in one walk over the texts, and follows each of its recordings.
    """
    check_size(len(index.letters))
    shared = windows.sparkSession.sparkContext.broadcast(index)
    deals = max(1, -(-windows.count() // DEAL))

    def some(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rec", "t"], kind="stable")
        rows, tracker, current = [], None, None
        for at in range(0, len(pdf), CHUNK):
            part = pdf.iloc[at : at + CHUNK]
            fragments = part["fragment"].fillna("").tolist()
            for rec, t, x, cost in zip(part["rec"], part["t"], fragments, shared.value.costs_of(fragments), strict=True):
                if tracker is None or rec != current:
                    tracker, current = Tracker(shared.value, settings), rec
                rows.append({"rec": rec, "t": t, **tracker.update(t, x, cost)})
        out = pd.DataFrame(rows, columns=["rec", "t", "text", "line", "word", "confidence"])
        return out.astype({"line": "Int32", "word": "Int32"})

    dealt = windows.withColumn("_deal", F.pmod(F.xxhash64("rec"), F.lit(deals))).repartition(deals, "_deal")
    return dealt.groupBy("_deal").applyInPandas(some, POSITION)


def follow_stream(windows: DataFrame, index: Index, settings: Settings = Settings()) -> DataFrame:
    """The same on a stream: one state per rec, kept between micro-batches, rows of a batch in time order."""
    import pickle

    shared = windows.sparkSession.sparkContext.broadcast(index)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tracker = Tracker(shared.value, settings)
        if state.exists:
            tracker.belief, tracker.none, tracker.tempo, tracker.last = pickle.loads(state.get[0])
        pdf = pd.concat(list(batches)).sort_values("t", kind="stable")
        rows = [{"rec": key[0], "t": t, **tracker.update(t, x or "")} for t, x in zip(pdf["t"], pdf["fragment"], strict=True)]
        state.update((pickle.dumps((tracker.belief, tracker.none, tracker.tempo, tracker.last)),))
        yield pd.DataFrame(rows, columns=["rec", "t", "text", "line", "word", "confidence"]).astype({"line": "Int32", "word": "Int32"})

    return windows.groupBy("rec").applyInPandasWithState(step, POSITION, "blob binary", "append", "NoTimeout")


def smooth(index: Index, costs: np.ndarray, dt: float, settings: Settings = Settings()) -> np.ndarray:
    """Forward-backward over word costs [steps, words]: the smoothed likeliest word at each step. The backward pass uses a flat kernel."""
    tracker = Tracker(index, settings)
    like = np.exp(-settings.kappa * (costs - costs.min(1, keepdims=True)))
    forward = np.empty_like(like)
    for t in range(len(costs)):
        if t:
            tracker.belief = tracker.tempo @ tracker._predictions(dt)
        tracker.belief = tracker.belief * like[t]
        tracker.belief /= tracker.belief.sum()
        forward[t] = tracker.belief
    most = math.ceil(settings.max_speed * dt)
    back = np.ones(index.n)
    out = np.empty(len(costs), np.int64)
    last = index.first[index.text_of + 1] - 1
    for t in range(len(costs) - 1, -1, -1):
        out[t] = int((forward[t] * back).argmax())
        seen = like[t] * back
        back = sum(seen[np.minimum(np.arange(index.n) + k, last)] for k in range(most + 1)) / (most + 1)
        back = (1 - settings.p_teleport) * back + settings.p_teleport * (seen * tracker.floor).sum()
        back /= back.max()
    return out
