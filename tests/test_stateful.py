import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.streaming import runs
from tessera.streaming import stateful as S

FRAMES = "session string, seq long, samples array<double>, channels int, rate int, last boolean"


def sessions():
    rng, out = np.random.default_rng(2), []
    for name, rate, channels, lengths in (("a", 16_000, 1, [700, 0, 1900, 33]), ("b", 44_100, 2, [3000, 5, 4410, 1]), ("c", 8_000, 1, [100]), ("d", 48_000, 3, [10, 4000, 4000, 900, 2000]), ("e", 22_050, 1, [0])):
        for seq, n in enumerate(lengths):
            out.append((name, seq, rng.normal(size=n * channels).round(6).tolist() or (None if seq else []), channels, rate, seq == len(lengths) - 1))
    return out


def plain(frames, target, size, zeros=6):
    """Chunks of a session at once, sample by sample."""
    out = {}
    for name in sorted({f[0] for f in frames}):
        own = sorted((f for f in frames if f[0] == name), key=lambda f: f[1])
        rate, channels = own[0][4], own[0][3]
        x = np.array([v for f in own for v in f[2] or []]).reshape(-1, channels).mean(1) if any(f[2] for f in own) else np.zeros(0)
        n = -(-len(x) * target // rate)
        y = x if rate == target else np.zeros(n)
        cut = min(1.0, target / rate)
        for m in range(n if rate != target else 0):
            t = m * rate / target
            for k in range(max(0, int(t - zeros / cut) - 1), min(len(x), int(t + zeros / cut) + 2)):
                d = (k - t) * cut
                if abs(d) < zeros:
                    y[m] += x[k] * cut * np.sinc(d) * np.cos(np.pi * d / (2 * zeros)) ** 2
        out |= {(name, c): (y[c * size : (c + 1) * size], (c + 1) * size >= n) for c in range(-(-n // size))}
    return out


def run(spark, tmp_path, frames, cuts, **more):
    """The chunks of a stream that comes in so many files, shuffled within windows of four frames."""
    rng = random.Random(cuts)
    order = sorted(frames, key=lambda f: (f[1] // 2, rng.random()))
    path = tmp_path / f"in{cuts}"
    step = -(-len(order) // cuts)
    for k in range(cuts):
        spark.createDataFrame(order[k * step : (k + 1) * step], FRAMES).coalesce(1).write.mode("append").parquet(str(path))
    with S.rocks(spark):
        stream = S.audio_chunks(runs.source(spark, str(path), FRAMES), **more)
        return {(r.session, r.chunk): (np.array(r.samples), r.last) for r in runs.drained(stream, str(tmp_path / f"out{cuts}"), str(tmp_path / f"progress{cuts}")).collect()}


def test_chunks_do_not_depend_on_the_cuts_of_the_stream(spark, tmp_path):
    frames = sessions()
    want = plain(frames, 16_000, 500)
    for cuts in (1, 4, 15):
        got = run(spark, tmp_path, frames, cuts, size=500)
        assert got.keys() == want.keys()
        assert all(np.allclose(got[k][0], want[k][0], atol=1e-9) and got[k][1] == want[k][1] for k in want), cuts
    assert {len(v[0]) for k, v in want.items() if not v[1]} == {500}


def test_resampling_keeps_a_tone():
    rate, target, n = 44_100, 16_000, 20_000
    x = np.sin(2 * np.pi * 440 * np.arange(n) / rate)
    m = n * target // rate
    y = S.resampled(x, 0, 0, m, rate, target, 16)
    assert np.abs(y[200:-200] - np.sin(2 * np.pi * 440 * np.arange(m) / target)[200:-200]).max() < 0.01
    assert np.abs(S.resampled(np.sin(2 * np.pi * 15_000 * np.arange(n) / rate), 0, 0, m, rate, target, 16)[200:-200]).max() < 0.05  # above the new limit


def test_outputs_that_are_ready_need_no_later_input():
    x = np.random.default_rng(5).normal(size=3000)
    for rate, target in ((44_100, 16_000), (8_000, 16_000), (22_050, 24_000)):
        for n in (0, 1, 13, 500, 2999):
            end = S.ready(n, rate, target, 6)
            assert np.array_equal(S.resampled(x[:n], 0, 0, end, rate, target, 6), S.resampled(x, 0, 0, end, rate, target, 6))


def run_rows(n=400):
    rng = random.Random(7)
    return [(rng.randrange(23), i, None if rng.random() < 0.1 else rng.random()) for i in range(n)]


def write(spark, rows, path, cuts):
    step = -(-len(rows) // cuts)
    for k in range(cuts):
        spark.createDataFrame(rows[k * step : (k + 1) * step], "grp long, run long, reward double").coalesce(1).write.mode("append").parquet(path)


def plain_groups(rows, expected=5):
    out, held = [], {}
    for g, run, reward in rows:
        held.setdefault(g, []).append((run, reward))
        if len(held[g]) == expected:
            got = [(r, x) for r, x in held.pop(g) if x is not None]
            out.append((g, len(got), expected - len(got), round(float(np.mean([x for _, x in got])), 9) if got else None, min((r for r, _ in got), default=None)))
    return sorted(out, key=str), held


def test_state_is_saved_and_loaded_into_another_stream(spark, tmp_path):
    rows = run_rows()
    want, waiting = plain_groups(rows)
    told = lambda df: [(r.grp, r.n_runs, r.n_dropped, None if r.mean_reward is None else round(r.mean_reward, 9), r.first_run) for r in df.collect()]
    at = lambda name: str(tmp_path / name)
    schema = "grp long, run long, reward double"
    with S.rocks(spark):
        write(spark, rows, at("all"), 3)
        unbroken = told(runs.drained(S.grouped_runs(runs.source(spark, at("all"), schema), 5), at("whole"), at("p0")))
        assert sorted(unbroken, key=str) == want
        write(spark, rows[:230], at("one"), 2)
        first = told(runs.drained(S.grouped_runs(runs.source(spark, at("one"), schema), 5), at("out1"), at("p1")))
        S.save_state(S.open_state(spark, at("p1")), at("snapshot"), version=3)
        initial = S.loaded(spark, at("snapshot"), "grp long, " + S.GROUP, 3)
        write(spark, rows[230:], at("two"), 2)
        second = told(runs.drained(S.grouped_runs(runs.source(spark, at("two"), schema), 5, initial), at("out2"), at("p2")))
        assert sorted(first + second, key=str) == want
        left = {r.grp: len(r.runs) + r.dropped for r in S.open_state(spark, at("p2")).collect()}
        assert left == {g: len(x) for g, x in waiting.items()}
    for schema, version in (("grp long, " + S.GROUP, 4), ("grp long, runs array<int>, rewards array<double>, dropped long", 3), ("grp long, runs array<long>", 3)):
        with pytest.raises(ValueError, match="the snapshot has"):
            S.loaded(spark, at("snapshot"), schema, version)
    assert initial.select(F.sum(F.size("runs"))).first()[0] > 0


class Held:
    """A value or a map of a state, counting what is asked of it."""

    def __init__(self):
        self.value, self.rows, self.calls = None, {}, 0

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def containsKey(self, key):
        self.calls += 1
        return key in self.rows

    def getValue(self, key):
        self.calls += 1
        return self.rows[key]

    def updateValue(self, key, value):
        self.calls += 1
        self.rows[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self.rows[key]

    def clear(self):
        self.value, self.rows = None, {}


@pytest.mark.parametrize("most", [0, 3, 4096])
def test_frames_that_follow_do_not_meet_the_state_one_by_one(monkeypatch, most):
    import pandas as pd

    monkeypatch.setattr(S, "EARLY", most)
    own = [("s", k, [k + 0.25, k - 0.5, 3.0 * k, 1.0], 2, 8_000, k == 99) for k in range(100)]
    want, columns = plain(own, 16_000, 25), ["session", "seq", "samples", "channels", "rate", "last"]
    for seed in (None, 1):
        processor, got, order = S.AudioChunks(16_000, 25, 6), {}, list(own)
        processor.state, processor.early = Held(), Held()
        if seed:
            random.Random(seed).shuffle(order)
        frames = lambda rows: iter([pd.DataFrame(rows[i : i + 7], columns=columns) for i in range(0, len(rows), 7)])
        for rows in (order[:60], order[60:]):
            for df in processor.handleInputRows(("s",), frames(rows), None):
                got |= {(r.session, r.chunk): (np.array(r.samples), r.last) for r in df.itertuples()}
        assert got.keys() == want.keys() and all(np.allclose(got[k][0], want[k][0], atol=1e-9) and got[k][1] == want[k][1] for k in want)
        assert processor.state.value is None and not processor.early.rows
        assert seed or processor.early.calls == 0


def test_weights_are_made_once_for_each_phase(monkeypatch):
    made, real = [], S.kernel
    monkeypatch.setattr(S, "kernel", lambda x, cut, zeros: made.append(np.size(x)) or real(x, cut, zeros))
    S.resampled(np.ones(10_000), 0, 0, 20_000, 8_000, 16_000, 6)
    assert sum(made) <= 2 * 14
