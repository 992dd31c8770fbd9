"""The two lateness policies as row-at-a-time engines of one partition.

Each engine holds plain state that turns into JSON and back, so a streaming
operator can keep it in Spark's state store, and tests can run it on a list.
Every clock is the arrival time of the row at hand, which makes runs repeat.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_left
from dataclasses import asdict, dataclass, field

NONE = -(1 << 62)


@dataclass
class Result:
    window_start: int
    count: int
    status_500: int
    version: int = 1


@dataclass
class StrictState:
    last_t: int = NONE
    watermark: int = NONE
    max_et: int = NONE
    open: dict = field(default_factory=dict)
    seen: dict = field(default_factory=dict)
    purged_at: int = NONE
    received: int = 0
    on_time: int = 0
    late: int = 0
    duplicates: int = 0
    non_monotonic: int = 0


class Strict:
    """Watermark from punctuation: a token T moves it to T - delta. Late rows are counted and dropped.

    A row is late if its window ended at or before the watermark; that test
    comes before the duplicate test, so ids of late rows are not remembered.
    """

    def __init__(self, delta_ms: int = 10_000, size_ms: int = 5_000, ttl_ms: int = 60_000, state: StrictState | None = None):
        self.delta_ms, self.size_ms, self.ttl_ms, self.s = delta_ms, size_ms, ttl_ms, state or StrictState()

    def punctuation(self, t_commit: int) -> list[Result]:
        s = self.s
        if t_commit <= s.last_t:
            s.non_monotonic += 1
            return []
        s.last_t = t_commit
        s.watermark = max(s.watermark, t_commit - self.delta_ms)
        return self._closed()

    def _closed(self) -> list[Result]:
        done = sorted(w for w in self.s.open if w + self.size_ms <= self.s.watermark)
        return [Result(w, *self.s.open.pop(w)) for w in done]

    def event(self, event_id: str, et: int, status: int) -> str:
        s = self.s
        s.received += 1
        s.max_et = max(s.max_et, et)
        start = et // self.size_ms * self.size_ms
        if start + self.size_ms <= s.watermark:
            s.late += 1
            return "late"
        if event_id in s.seen:
            s.duplicates += 1
            return "duplicate"
        s.seen[event_id] = et
        self._purge()
        cell = s.open.setdefault(start, [0, 0])
        cell[0] += 1
        cell[1] += status == 500
        s.on_time += 1
        return "on_time"

    def _purge(self) -> None:
        """Ids older than the time to live, looked for once per quarter of it."""
        s = self.s
        now = s.watermark if s.watermark > NONE else s.max_et
        if now - s.purged_at >= self.ttl_ms // 4:
            s.purged_at = now
            s.seen = {k: v for k, v in s.seen.items() if v >= now - self.ttl_ms}

    def flush(self) -> list[Result]:
        out = [Result(w, *c) for w, c in sorted(self.s.open.items())]
        self.s.open.clear()
        return out

    def dump(self) -> str:
        return json.dumps(asdict(self.s))

    @classmethod
    def load(cls, text: str | None, **kw) -> Strict:
        if not text:
            return cls(**kw)
        raw = json.loads(text)
        raw["open"] = {int(k): v for k, v in raw["open"].items()}
        return cls(state=StrictState(**raw), **kw)


@dataclass
class HeuristicState:
    max_et: int = NONE
    watermark: int = NONE
    moved_at: int = NONE
    first_arrival: int = NONE
    leff_ms: float = -1.0
    last_count: int = -1
    p: float = 0.99
    burst_until: int = NONE
    history: list = field(default_factory=list)
    slices: dict = field(default_factory=dict)
    signs: dict = field(default_factory=dict)
    negatives: list = field(default_factory=list)
    degraded_since: int = NONE
    open: dict = field(default_factory=dict)
    closed_upto: int = NONE
    closed: list = field(default_factory=list)
    seen: dict = field(default_factory=dict)
    purged_at: int = NONE
    received: int = 0
    on_time: int = 0
    late: int = 0
    duplicates: int = 0


@dataclass
class HeuristicOptions:
    size_ms: int = 5_000
    p_normal: float = 0.99
    p_safe: float = 0.999
    alpha: float = 0.01
    l_max_ms: int = 60_000
    max_lag_ms: int = 10_000_000_000
    max_future_skew_ms: int = 300_000
    warmup_ms: int = 5_000
    warmup_samples: int = 2_000
    window_ms: int = 60_000
    change: float = 0.10
    decay: float = 0.05
    advance: float = 1.5
    local_close: bool = True
    ttl_ms: int = 60_000
    burst_ratio: float = 2.0
    burst_ms: int = 300_000
    every: int = 1
    strict_late: bool = True


class Heuristic:
    """Watermark ``max_et - L_eff``; L_eff is a sketch quantile of recent lateness. Late rows are kept aside.

    Steps of a row: duplicate test, future-skew guard, event-time maximum,
    sign and tier of the lag, sketch, L_eff, watermark, closing, routing.
    ``strict_late`` calls a row late if its window ended at or before the
    watermark; otherwise only if its window was closed before.
    """

    def __init__(self, options: HeuristicOptions | None = None, state: HeuristicState | None = None):
        self.o, self.s = options or HeuristicOptions(), state or HeuristicState(p=(options or HeuristicOptions()).p_normal)
        self._log = math.log((1 + self.o.alpha) / (1 - self.o.alpha))

    # Sketch of lateness: counts of (second, bucket), the last window's seconds only.

    def _add(self, lag_ms: float, now: int) -> None:
        if lag_ms < 0:
            return
        second, oldest = now // 1000, (now - self.o.window_ms) // 1000
        newest = max(self.s.slices, default=second)
        if second < newest - self.o.window_ms // 1000:
            return
        bucket = math.ceil(math.log(max(lag_ms / 1000, 1e-3) / 1e-3) / self._log)
        cell = self.s.slices.setdefault(second, {})
        cell[bucket] = cell.get(bucket, 0) + 1
        for old in [k for k in self.s.slices if k < oldest]:
            del self.s.slices[old]

    def _quantile(self, p: float) -> tuple[float, int]:
        total: dict[int, int] = {}
        for cell in self.s.slices.values():
            for b, n in cell.items():
                total[b] = total.get(b, 0) + n
        count = sum(total.values())
        rank, seen = max(1, math.ceil(p * count)), 0
        for b in sorted(total):
            seen += total[b]
            if seen >= rank:
                return 1e-3 * math.exp(self._log * b) * 1000, count
        return 0.0, 0

    def _tier(self, lag: int, now: int) -> str:
        second = now // 1000
        n, bad = self.s.signs.get(second, (0, 0))
        self.s.signs[second] = [n + 1, bad + (lag < 0)]
        for old in [k for k in self.s.signs if k <= second - 60]:
            del self.s.signs[old]
        n, bad = (sum(x) for x in zip(*self.s.signs.values(), strict=True))
        rate = bad / n
        tier = "NORMAL" if rate < 0.001 else "WARNING" if rate < 0.01 else "ALERT" if rate < 0.05 else "CRITICAL"
        if lag < 0:
            self.s.negatives = [*self.s.negatives, lag][-1000:]
        if tier == "CRITICAL" and self.s.degraded_since == NONE:
            self.s.degraded_since = now
        elif self.s.degraded_since > NONE and rate < 0.01 and now - self.s.degraded_since > 300_000:
            self.s.degraded_since = NONE
            self.s.leff_ms = min(self._quantile(self.s.p)[0], self.o.l_max_ms)
        return tier

    def _phase(self, now: int) -> int:
        """0: no watermark yet; 1: no less than the prior; 2: as measured."""
        if self.s.first_arrival == NONE:
            self.s.first_arrival = now
        age = now - self.s.first_arrival
        if age < 5_000 and self.s.received < 100:
            return 0
        return 2 if age >= self.o.warmup_ms and self.s.received >= self.o.warmup_samples else 1

    def _update_leff(self, now: int, phase: int) -> None:
        s, o = self.s, self.o
        if s.leff_ms < 0:
            s.leff_ms = float(o.l_max_ms)
        if s.received % o.every:
            return
        q, count = self._quantile(s.p)
        if phase < 2:
            s.leff_ms = min(max(q, float(o.l_max_ms)), float(o.l_max_ms))
            return
        if count < 10 or count == s.last_count:
            return
        s.last_count = count
        s.history = [*s.history, q][-60:]
        if len(s.history) >= 30 and s.burst_until == NONE:
            before = sorted(s.history[:-1])
            middle = before[len(before) // 2]
            if middle > 0 and q / middle > o.burst_ratio:
                s.p, s.burst_until = o.p_safe, now + o.burst_ms
        elif s.burst_until > NONE and now >= s.burst_until:
            s.p, s.burst_until = o.p_normal, NONE
        change = (q - s.leff_ms) / max(s.leff_ms, 1.0)
        if change >= o.change:
            s.leff_ms = q
        elif change < 0:
            s.leff_ms = max(q, s.leff_ms * (1 - o.decay))
        s.leff_ms = min(s.leff_ms, float(o.l_max_ms))

    def _advance(self, now: int, phase: int) -> list[Result]:
        s, o = self.s, self.o
        if phase == 0:
            return []
        leff = o.l_max_ms if s.degraded_since > NONE else s.leff_ms
        candidate = math.floor(s.max_et - leff)
        if not o.local_close and s.watermark > NONE:
            # Closing on the least watermark of all partitions: no watermark may run ahead of the clock.
            elapsed = max(0, now - s.moved_at)
            candidate = min(candidate, math.floor(s.watermark + elapsed * o.advance + (o.size_ms if elapsed > 100 else 0)))
        s.watermark = max(s.watermark, candidate)
        s.moved_at = now
        done = sorted(w for w in s.open if w + o.size_ms <= s.watermark)
        s.closed = [w for w in [*s.closed, *done] if w >= s.watermark - 3_600_000]
        return [Result(w, *s.open.pop(w)) for w in done]

    def event(self, event_id: str, et: int, arrival: int, status: int) -> tuple[str, int, list[Result]]:
        """(route, ms past the watermark, windows this row closed). Routes: on_time, late, duplicate, future_skew, extreme_lag."""
        s, o = self.s, self.o
        s.received += 1
        if event_id in s.seen:
            s.duplicates += 1
            return "duplicate", 0, []
        s.seen[event_id] = arrival
        if arrival - s.purged_at >= o.ttl_ms // 4:
            s.purged_at = arrival
            s.seen = {k: v for k, v in s.seen.items() if v >= arrival - o.ttl_ms}
        if et - arrival > o.max_future_skew_ms:
            s.late += 1
            return "future_skew", 0, []
        s.max_et = max(s.max_et, et)
        lag = arrival - et
        tier = self._tier(lag, arrival)
        adjusted = lag
        if lag < 0 and tier in ("ALERT", "CRITICAL"):
            known = sorted(s.negatives)
            adjusted = lag + abs(known[len(known) // 2])
        if s.degraded_since == NONE and lag <= o.max_lag_ms:
            self._add(adjusted, arrival)
        phase = self._phase(arrival)
        self._update_leff(arrival, phase)
        results = self._advance(arrival, phase)
        past = max(s.watermark - et, 0) if s.watermark > NONE else 0
        if lag > o.max_lag_ms:
            s.late += 1
            return "extreme_lag", past, results
        start = et // o.size_ms * o.size_ms
        if (start + o.size_ms <= s.watermark) if o.strict_late else _holds(s.closed, start):
            s.late += 1
            return "late", past, results
        cell = s.open.setdefault(start, [0, 0])
        cell[0] += 1
        cell[1] += status == 500
        s.on_time += 1
        return "on_time", 0, results

    def flush(self) -> list[Result]:
        out = [Result(w, *c) for w, c in sorted(self.s.open.items())]
        self.s.open.clear()
        return out

    def dump(self) -> str:
        return json.dumps(asdict(self.s))

    @classmethod
    def load(cls, text: str | None, options: HeuristicOptions | None = None) -> Heuristic:
        if not text:
            return cls(options)
        raw = json.loads(text)
        ints = lambda d: {int(k): v for k, v in d.items()}
        raw["open"], raw["signs"] = ints(raw["open"]), ints(raw["signs"])
        raw["slices"] = {int(k): ints(v) for k, v in raw["slices"].items()}
        return cls(options, HeuristicState(**raw))


def _holds(ordered: list[int], value: int) -> bool:
    ordered = sorted(ordered)
    i = bisect_left(ordered, value)
    return i < len(ordered) and ordered[i] == value
