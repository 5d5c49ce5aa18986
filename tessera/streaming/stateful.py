"""Stateful stream operators: audio chunks that carry over micro-batches, groups whose state can be moved to another stream.

They run on ``transformWithState``, whose state lies in RocksDB and in the query's checkpoint folder.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def mono(samples: np.ndarray, channels: int) -> np.ndarray:
    """The mean of interleaved channels."""
    return samples.reshape(-1, channels).mean(1)


def mixed(frames: list[tuple]) -> np.ndarray:
    """The samples of (samples, channels) frames in a row, each mixed to one channel; frames of one kind at once."""
    if len({c for _, c in frames}) == 1 and not any(len(x) % c for x, c in frames):
        return mono(np.concatenate([np.asarray(x, "f8") for x, _ in frames]), frames[0][1])
    return np.concatenate([np.zeros(0), *(mono(np.array(x, "f8"), c) for x, c in frames)])


def kernel(x: np.ndarray, cut: float, zeros: int) -> np.ndarray:
    """A low-pass sinc at distances x (in input samples), to the ``zeros``-th crossing under a Hann window."""
    near = np.abs(x * cut) < zeros
    return np.where(near, cut * np.sinc(x * cut) * np.cos(np.pi * x * cut / (2 * zeros)) ** 2, 0.0)


def resampled(held: np.ndarray, first: int, begin: int, end: int, rate: int, target: int, zeros: int) -> np.ndarray:
    """Outputs begin to end - 1 at the target rate, from inputs of which ``held`` begin at ``first``; zero outside them."""
    if rate == target:
        at = np.arange(begin, end) - first
        return np.where((at >= 0) & (at < len(held)), held[np.clip(at, 0, max(0, len(held) - 1))], 0.0) if len(held) else np.zeros(end - begin)
    if end <= begin:
        return np.zeros(0)
    cut = min(1.0, target / rate)
    reach = int(np.ceil(zeros / cut))
    whole, rest = np.divmod(np.arange(begin, end, dtype="i8") * rate, target)  # exact, however long the stream
    phases, which = np.unique(rest, return_inverse=True)  # few: outputs repeat their places between inputs
    taps = kernel(np.arange(-reach, reach + 2) - (phases / target)[:, None], cut, zeros)
    low, high = int(whole[0]) - reach, int(whole[-1]) + reach + 2
    near = np.zeros(high - low)
    a, b = max(first, low), min(first + len(held), high)
    if b > a:
        near[a - low : b - low] = held[a - first : b - first]
    return (np.lib.stride_tricks.sliding_window_view(near, 2 * reach + 2)[whole - whole[0]] * taps[which]).sum(1)


def ready(n_in: int, rate: int, target: int, zeros: int) -> int:
    """How many outputs need no input beyond the first n_in."""
    if rate == target:
        return n_in
    reach = int(np.ceil(zeros / min(1.0, target / rate))) + 1
    last = n_in - 1 - reach  # the last input that an output may lie at or just after
    return max(0, -(-(last + 1) * target // rate)) if last >= 0 else 0


STATE = "rate long, n_in long, first long, n_out long, next_seq long, chunk long, held array<double>, waiting array<double>, n_early long"
#: Frames of a session that wait in a task's memory for one before them; more go to the state.
EARLY = 4096


class AudioChunks(StatefulProcessor):
    """Frames of a session, in the order of ``seq`` whatever order they come in, as chunks of equal length."""

    def __init__(self, target: int, size: int, zeros: int):
        self.target, self.size, self.zeros = target, size, zeros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", STATE)
        self.early = handle.getMapState("early", "seq long", "samples array<double>, rate long, last boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        """Frames that follow on one another are taken from the rows; only those that came too early meet the state one by one."""
        known = self.state.get()
        rate, n_in, first, n_out, next_seq, chunk, held, waiting, n_early = known or (None, 0, 0, 0, 0, 0, [], [], 0)
        held, waiting, done = np.array(held, "f8"), np.array(waiting, "f8"), False
        early: dict[int, tuple] = {}  # mixed samples, rate, last
        for frame in rows:
            if done:
                continue
            for seq, samples, channels, of, last in zip(frame["seq"].tolist(), frame["samples"], frame["channels"].tolist(), frame["rate"].tolist(), frame["last"].tolist(), strict=True):
                if seq >= next_seq:  # a frame that repeats, or comes again after a failure, is the same
                    early[seq] = (samples if samples is not None else [], int(channels), int(of), bool(last))
            taken = []
            while not done:
                if next_seq in early:
                    samples, channels, of, done = early.pop(next_seq)
                elif n_early and self.early.containsKey((next_seq,)):
                    samples, of, done = self.early.getValue((next_seq,))
                    self.early.removeKey((next_seq,))
                    channels, n_early = 1, n_early - 1
                else:
                    break
                if rate is not None and of != rate:
                    raise ValueError(f"the rate of session {key[0]} changes from {rate} to {of}")
                rate, next_seq = of, next_seq + 1
                taken.append((samples, channels))
            new = mixed(taken)
            held, n_in = np.concatenate([held, new]), n_in + len(new)
            if rate is not None:
                end = -(-n_in * self.target // rate) if done else ready(n_in, rate, self.target, self.zeros)
                if end > n_out:
                    waiting = np.concatenate([waiting, resampled(held, first, n_out, end, rate, self.target, self.zeros)])
                    n_out = end
                need = max(first, n_out * rate // self.target - int(np.ceil(self.zeros / min(1.0, self.target / rate))))
                if rate == self.target:
                    need = n_out
                held, first = held[min(need - first, len(held)) :], min(need, first + len(held))
            if len(early) > EARLY and not done:
                n_early += self.put(early)
            out = []
            while len(waiting) >= self.size or (done and len(waiting)):
                out.append((key[0], chunk, waiting[: self.size], done and len(waiting) <= self.size))
                waiting, chunk = waiting[self.size :], chunk + 1
            if out:
                yield pd.DataFrame(out, columns=["session", "chunk", "samples", "last"])
        if done:
            if known:
                self.state.clear()
            if n_early:
                self.early.clear()
        else:
            n_early += self.put(early)
            self.state.update((rate, n_in, first, n_out, next_seq, chunk, held.tolist(), waiting.tolist(), n_early))

    def put(self, early: dict[int, tuple]) -> int:
        """Frames moved to the state; how many of them weren't there."""
        n = 0
        for seq, (samples, channels, of, last) in early.items():
            n += not self.early.containsKey((seq,))
            self.early.updateValue((seq,), (mono(np.array(samples, "f8"), channels).tolist(), of, last))
        early.clear()
        return n

    def close(self) -> None:
        pass


def audio_chunks(frames: DataFrame, target: int = 16_000, size: int = 800, zeros: int = 6) -> DataFrame:
    """(session, chunk, samples, last) of a stream of (session, seq, samples, channels, rate, last).

    Interleaved channels are mixed to one, samples resampled by a windowed sinc and cut into chunks of ``size``; the rest of
    a chunk, the samples that later outputs need, and frames that came too early wait in the state, so chunks don't
    depend on how the stream is cut into micro-batches.  The frame with ``last`` ends a session: the last chunk may be
    short, and the state goes.  Sequence numbers begin at 0; null samples are empty; a rate that changes is an error.
    """
    kind = T.StructType([frames.schema["session"], *T._parse_datatype_string("chunk long, samples array<double>, last boolean").fields])
    return frames.groupBy("session").transformWithStateInPandas(AudioChunks(target, size, zeros), kind, "append", "none")


GROUP = "runs array<long>, rewards array<double>, dropped long"


class Groups(StatefulProcessor):
    """Runs of a group until ``expected`` have come; the state may begin with that of another stream."""

    def __init__(self, expected: int):
        self.expected = expected

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.group = handle.getValueState("group", GROUP)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:
        r = initialState.iloc[0]
        self.group.update(([int(x) for x in r["runs"]], [float(x) for x in r["rewards"]], int(r["dropped"])))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        known = self.group.get()
        runs, rewards, dropped = known or ([], [], 0)
        runs, rewards, out = list(runs), list(rewards), []
        frame = pd.concat(rows)  # a micro-batch's rows of one group come in any order
        for run, reward in sorted(zip(frame["run"], frame["reward"], strict=True), key=lambda x: x[0]):
            if pd.isna(reward):
                dropped += 1
            else:
                runs.append(int(run))
                rewards.append(float(reward))
            if len(runs) + dropped == self.expected:
                out.append((key[0], len(runs), dropped, float(np.mean(rewards)) if rewards else None, min(runs, default=None)))
                runs, rewards, dropped = [], [], 0
        if runs or dropped:
            self.group.update((runs, rewards, dropped))
        elif known:
            self.group.clear()
        if out:
            yield pd.DataFrame(out, columns=["grp", "n_runs", "n_dropped", "mean_reward", "first_run"]).astype({"first_run": "Int64"})

    def close(self) -> None:
        pass


def grouped_runs(runs: DataFrame, expected: int, initial: DataFrame | None = None) -> DataFrame:
    """(grp, n_runs, n_dropped, mean_reward, first_run) of each ``expected`` runs of a group; a null reward is a dropped run.

    ``initial``: (grp, runs, rewards, dropped), the open groups that the stream begins with, as ``loaded`` gives them.
    """
    kind = T.StructType([T.StructField("grp", T.LongType()), *T._parse_datatype_string("n_runs long, n_dropped long, mean_reward double, first_run long").fields])
    return runs.groupBy("grp").transformWithStateInPandas(Groups(expected), kind, "append", "none", None if initial is None else initial.groupBy("grp"))


def open_state(spark: SparkSession, checkpoint: str, name: str = "group") -> DataFrame:
    """The key and the fields of a stopped stream's value state."""
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint).select("key.*", "value.*")


def save_state(state: DataFrame, path: str, version: int) -> None:
    """A snapshot that outlives the stream's checkpoint: the state as Parquet, its schema and a version beside it."""
    state.write.parquet(f"{path}/state")
    state.sparkSession.createDataFrame([(version, state.schema.json())], "version int, schema string").coalesce(1).write.json(f"{path}/about")


def loaded(spark: SparkSession, path: str, schema: str, version: int) -> DataFrame:
    """A snapshot's state, if it was saved with this version and with these columns and types; else an error."""
    about = spark.read.schema("version int, schema string").json(f"{path}/about").first()
    held, wanted = T.StructType.fromJson(json.loads(about.schema)), T._parse_datatype_string(schema)
    if about.version != version:
        raise ValueError(f"the snapshot has version {about.version}, not {version}")
    told = lambda s: [(f.name, f.dataType.simpleString()) for f in s.fields]
    if told(held) != told(wanted):
        raise ValueError(f"the snapshot has {told(held)}, not {told(wanted)}")
    return spark.read.schema(held).parquet(f"{path}/state")
