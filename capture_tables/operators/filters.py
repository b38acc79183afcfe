"""Filters with a true recurrence over a track's frames, as grouped maps: one-euro smoothing of
values and rotations, and the choice of a track among hypotheses."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from capture_tables.operators.grouped import over_groups, schema_of


def alpha(cutoff, dt):
    """Weight of the new value in an exponential filter of that cutoff frequency."""
    tau = 1.0 / (2.0 * np.pi * cutoff)
    return 1.0 / (1.0 + tau / dt)


class OneEuro:
    """The adaptive low-pass filter: the faster the signal, the higher the cutoff. Its state is the
    last filtered value, its speed and the last time, so that a stream can carry it on."""

    def __init__(self, least_cutoff: float = 1.0, beta: float = 0.1, speed_cutoff: float = 1.0, state=None):
        self.least, self.beta, self.speed_cutoff = least_cutoff, beta, speed_cutoff
        self.value, self.speed, self.time = state or (None, None, None)

    def step(self, x: np.ndarray, t: float) -> np.ndarray:
        if self.value is None:
            self.value, self.speed, self.time = x, np.zeros_like(x), t
            return x
        dt = max(t - self.time, 1e-9)
        a = alpha(self.speed_cutoff, dt)
        self.speed = a * (x - self.value) / dt + (1 - a) * self.speed
        b = alpha(self.least + self.beta * np.abs(self.speed), dt)
        self.value, self.time = b * x + (1 - b) * self.value, t
        return self.value


def _schema(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*columns).schema)


def one_euro(df: DataFrame, columns: list[str], by: list[str], order: str = "frame", freq: float = 120.0, least_cutoff: float = 1.0, beta: float = 0.1, speed_cutoff: float = 1.0) -> DataFrame:
    """by..., order and the smoothed columns, track by track."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        f = OneEuro(least_cutoff, beta, speed_cutoff)
        values = rows[columns].to_numpy(float)
        out = np.array([f.step(x, t / freq) for x, t in zip(values, rows[order].to_numpy(float), strict=True)]).reshape(-1, len(columns))
        return rows[[*by, order]].assign(**dict(zip(columns, out.T, strict=True)))

    schema = _schema(df, [*by, order]) + ", " + ", ".join(f"{c} double" for c in columns)
    return df.select(*by, order, *columns).groupBy(*by).applyInPandas(run, schema)


_R = [f"r{i}{j}" for i in range(3) for j in range(3)]


def _logs(m: np.ndarray) -> np.ndarray:
    """The rotation vectors of many matrices."""
    angle = np.arccos(np.clip((np.trace(m, axis1=1, axis2=2) - 1) / 2, -1, 1))
    v = np.stack([m[:, 2, 1] - m[:, 1, 2], m[:, 0, 2] - m[:, 2, 0], m[:, 1, 0] - m[:, 0, 1]], axis=1)
    small, half = angle < 1e-8, np.pi - angle < 1e-6
    scale = np.where(small, 0.5, angle / np.where(small | half, 1.0, 2 * np.sin(angle)))
    out = v * scale[:, None]
    if half.any():
        own = m[half]
        size = np.sqrt(np.maximum((np.diagonal(own, axis1=1, axis2=2) + 1) / 2, 0))
        k = size.argmax(axis=1)
        rows = np.arange(len(own))
        out[half] = (own[rows, k] + np.eye(3)[k]) / (2 * size[rows, k])[:, None] * angle[half][:, None]
    return out


def _exps(v: np.ndarray) -> np.ndarray:
    angle = np.linalg.norm(v, axis=1)
    still = angle < 1e-12
    x, y, z = (v / np.where(still, 1.0, angle)[:, None]).T
    o = np.zeros_like(x)
    k = np.stack([o, -z, y, z, o, -x, -y, x, o], axis=1).reshape(-1, 3, 3)
    out = np.eye(3) + np.sin(angle)[:, None, None] * k + (1 - np.cos(angle))[:, None, None] * (k @ k)
    out[still] = np.eye(3)
    return out


def one_euro_rotation(df: DataFrame, by: list[str], mode: str = "tangent", order: str = "frame", freq: float = 30.0, least_cutoff: float = 0.5, beta: float = 2.0, speed_cutoff: float = 1.0) -> DataFrame:
    """Smoothed r00 .. r22. Each step starts from the last result: the turn from there to the new
    rotation, as a vector. mode tangent: the vectors go through the filter, the first as it is;
    geodesic: a share of the vector, that follows from its own speed alone."""

    def work(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        turns = rows[_R].to_numpy(float).reshape(-1, 3, 3)
        times = rows[order].to_numpy(float) / freq
        out, length = np.empty_like(turns), np.diff(starts)
        value, speed, time, last = (np.zeros((len(length), 3)), np.zeros((len(length), 3)), np.zeros(len(length)), turns[starts[:-1]])
        out[starts[:-1]] = last
        # all tracks take their k-th step together
        for k in range(1, int(length.max())):
            on = np.flatnonzero(length > k)
            at = starts[on] + k
            step = _logs(last[on].transpose(0, 2, 1) @ turns[at])
            if mode == "tangent":
                if k > 1:
                    dt = np.maximum(times[at] - time[on], 1e-9)[:, None]
                    a = alpha(speed_cutoff, dt)
                    speed[on] = a * (step - value[on]) / dt + (1 - a) * speed[on]
                    b = alpha(least_cutoff + beta * np.abs(speed[on]), dt)
                    step = b * step + (1 - b) * value[on]
                value[on], time[on] = step, times[at]
            else:
                dt = np.maximum(times[at] - times[at - 1], 1e-9)
                step = step * alpha(least_cutoff + beta * np.linalg.norm(step, axis=1) / dt, dt)[:, None]
            last[on] = last[on] @ _exps(step)
            out[at] = last[on]
        return rows[[*by, order]].assign(**dict(zip(_R, out.reshape(-1, 9).T, strict=True)))

    schema = schema_of(df, [*by, order]) + ", " + ", ".join(f"{c} double" for c in _R)
    return over_groups(df.select(*by, order, *_R), by, [order], work, schema)


class _Track:
    """The hypotheses of a track's frames, the first ranked first, and how they are chosen in both
    directions of time."""

    def __init__(self, turns: list[np.ndarray], visibility: list[np.ndarray], ious: list[np.ndarray] | None, number: list[int], clock: list[float], visible: float, base: float, omega: float, ahead: int, occluded: int, iou_kept: int, reliable_iou: float, reliable_visibility: float):
        self.turns, self.visibility, self.ious = turns, visibility, ious
        self.number, self.clock = number, clock
        self.visible, self.base, self.omega, self.ahead, self.occluded = visible, base, omega, ahead, occluded
        self.iou_kept, self.reliable_iou, self.reliable_visibility = iou_kept, reliable_iou, reliable_visibility
        #: For each frame the place of its choice among its hypotheses, and whether a gate let it through.
        self.chosen: dict[int, tuple[int, bool]] = {}

    def _good(self, k: int) -> np.ndarray:
        """Those no worse than the frame's best but iou_kept."""
        if self.ious is None:
            return np.ones(len(self.turns[k]), bool)
        own = self.ious[k]
        return own >= np.sort(own)[::-1][min(self.iou_kept, len(own) - 1)]

    def _near(self, k: int, other: np.ndarray, seen: float) -> np.ndarray:
        """Good ones within the gate around a rotation; it widens with the time since `seen`."""
        trace = np.einsum("nij,ij->n", self.turns[k], other)
        angle = np.degrees(np.arccos(np.clip((trace - 1) / 2, -1, 1)))
        return self._good(k) & (angle < self.base + abs(self.clock[k] - seen) * self.omega)

    def forward(self) -> None:
        k = at = 0  # at: the last visible frame
        last, visibility = None, 0.0
        while k < len(self.turns):
            awake = last is not None and (visibility > self.visible or self.number[k] - self.number[at] < self.occluded)
            near = self._near(k, last, self.clock[at]) if awake else self._good(k)
            if k + self.ahead < len(self.turns) and not (near.any() if awake else k == 0):
                until, pick, visibility = self._landing(k)
                last = self.turns[until][pick]
                self._backward(k, until, last)
                k = at = until
                continue
            pick = int(near.argmax())
            self.chosen[k] = (pick, bool(awake and near.any()))
            last, visibility = self.turns[k][pick], self.visibility[k][pick]
            if visibility > self.visible:
                at = k
            k += 1

    def _landing(self, k: int) -> tuple[int, int, float]:
        """The first last frame of a stride with a reliable hypothesis, or the track's last frame."""
        while True:
            end = min(k + self.ahead, len(self.turns)) - 1
            final = k + self.ahead >= len(self.turns)
            sure = np.ones(len(self.turns[end]), bool) if self.ious is None else self.ious[end] >= self.reliable_iou
            if final or (sure.any() and self.visibility[end][0] >= self.reliable_visibility):
                first = int(sure.argmax())
                return end, 0 if final else first, self.visibility[end][first]
            k += self.ahead

    def _backward(self, start: int, until: int, last: np.ndarray) -> None:
        """Frames start .. until - 1 from behind; a gate that lets none through stays open from there."""
        seen, awake = self.clock[until], True
        for k in range(until - 1, start - 1, -1):
            near = self._near(k, last, seen) if awake else self._good(k)
            if awake and not near.any():
                awake, near = False, self._good(k)
            pick = int(near.argmax())
            self.chosen[k] = (pick, awake)
            last = self.turns[k][pick]
            if self.visibility[k][pick] > self.visible:
                seen = self.clock[k]


def select_track(hypotheses: DataFrame, by: list[str], visible: float = 0.3, base: float = 13.0, omega: float = 0.5, ahead: int = 30, occluded: int = 30, time: str | None = None, iou: str | None = None, iou_kept: int = 30, reliable_iou: float = 0.5, reliable_visibility: float = 0.7) -> DataFrame:
    """by..., frame, rank, gated: one hypothesis for each frame (columns rank, visibility,
    r00 .. r22, and those named by `time`, in seconds, and `iou`).

    With `iou`, a frame's candidates are those no worse than its best but `iou_kept`. While the last
    choice is visible, or a visible one is fewer than `occluded` frames behind, a frame takes its
    first candidate less than base + gap * omega degrees from the last choice's rotation; the gap to
    the last visible choice is counted in frames, or with `time` in thirtieths of a second.
    Where that lets none through, or the gate sleeps, the track jumps in strides of `ahead` frames
    until a stride's last frame has a hypothesis of `reliable_iou` and its first ranked is visible by
    `reliable_visibility`, or until the track ends. The frames passed over are chosen backwards from
    there with a gate of their own, which stays open once it lets none through, and the track goes on
    from the frame it landed on. The first frame, and those in reach of the end, take their first
    candidate where the gate does not decide.
    """
    if ahead < 2:
        raise ValueError("strides have two frames at least")

    def work(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        turns = rows[_R].to_numpy(float).reshape(-1, 3, 3)
        number, visibility = rows["frame"].to_numpy(), rows["visibility"].to_numpy(float)
        clock = rows[time].to_numpy(float) * 30 if time else number.astype(float)
        ious = rows[iou].to_numpy(float) if iou else None
        picked, gates = [], []
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            at = [lo, *(lo + 1 + np.flatnonzero(number[lo + 1 : hi] != number[lo : hi - 1])).tolist(), hi]
            part = lambda x: [x[p:q] for p, q in zip(at[:-1], at[1:], strict=True)]  # noqa: B023, E731
            first = at[:-1]
            track = _Track(part(turns), part(visibility), None if ious is None else part(ious), number[first].tolist(), clock[first].tolist(), visible, base, omega, ahead, occluded, iou_kept, reliable_iou, reliable_visibility)
            track.forward()
            for k, (pick, gated) in sorted(track.chosen.items()):
                picked.append(at[k] + pick)
                gates.append(gated)
        return rows[[*by, "frame", "rank"]].iloc[picked].assign(gated=gates)

    schema = schema_of(hypotheses, [*by, "frame", "rank"]) + ", gated boolean"
    return over_groups(hypotheses.select(*by, "frame", "rank", "visibility", *[c for c in (time, iou) if c], *_R), by, ["frame", "rank"], work, schema)


def smoothed_with(df: DataFrame, *steps) -> DataFrame:
    """`df` through the steps in turn, each a function of a DataFrame: the place to hook one's own
    depth or track preprocessing in."""
    for step in steps:
        df = df.transform(step)
    return df
