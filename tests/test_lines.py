import random

import pytest
from pyspark.sql import functions as F

from tessera.sources import lines as L


def plain(data):
    """[(offset, n_bytes, line)] of non-blank lines."""
    at, found = 0, []
    for line in data.split(b"\n"):
        whole = line + b"\n" if at + len(line) < len(data) else line
        if line.strip():
            found.append((at, line.rstrip(b"\r").decode()))
        at += len(whole)
    ends = [a for a, _ in found[1:]] + [len(data)][: len(found)]
    return [(a, e - a, t) for (a, t), e in zip(found, ends, strict=True)]


FILES = {
    "a.jsonl": b'{"x": 1}\n{"x": 2}\n', "b.jsonl": b'{"x": 3}\r\n\r\n  \t\n{"x": "\xc3\xa9"}\r\n', "c.jsonl": b'\n\n{"x": 4}\n\n{"x": 5}', "d.jsonl": b"", "e.jsonl": b"\n \n",
    "f.jsonl": b"\n".join(b'{"n": %d, "t": "%s"}' % (i, b"w" * (i * 37 % 90)) + (b"\r" if i % 5 == 0 else b"") + (b"\n\n" if i % 7 == 0 else b"") for i in range(300)), "_SUCCESS": b"no\n", "g.jsonl": b"   lead\nlast\r",
}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    for name, data in FILES.items():
        (tmp_path / "in" / ("sub" if name == "c.jsonl" else "") / name).write_bytes(data)
    return tmp_path


def paths(folder):
    return {str(p): FILES[p.name] for p in sorted((folder / "in").rglob("*")) if p.is_file() and not p.name.startswith("_")}


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_lines_and_offsets_whatever_the_ranges(spark, folder, size):
    if size == 1:
        for name in ("f.jsonl",):
            (folder / "in" / name).write_bytes(FILES[name][:400])
    got = {}
    for r in L.lines(spark, str(folder / "in"), size).collect():
        got.setdefault(r.file, []).append((r.offset, r.n_bytes, r.line))
    data = {f: open(f, "rb").read() for f in paths(folder)}
    assert {f: sorted(x) for f, x in got.items()} == {f: plain(d) for f, d in data.items() if plain(d)}
    for f, x in got.items():
        assert max(a + n for a, n, _ in x) == len(data[f])


def test_index_is_dense_by_file_and_offset_and_reads_by_offset(spark, folder):
    L.write_offsets(spark, str(folder / "in"), str(folder / "index"), 50)
    index = L.offsets(spark, str(folder / "index"))
    want = [(f, a, n, t) for f, d in sorted(paths(folder).items()) for a, n, t in plain(d)]
    assert [(r.file, r.offset, r.n_bytes) for r in index.orderBy("row_index").collect()] == [w[:3] for w in want]
    assert [r.row_index for r in index.orderBy("row_index").collect()] == list(range(len(want)))
    rng = random.Random(1)
    asked = sorted(rng.sample(range(len(want)), 100))
    located = index.where(F.col("row_index").isin(asked)).withColumn("clash", F.lit(1))
    # everything but the lines asked for is overwritten, so nothing else can have been read
    for f, d in paths(folder).items():
        kept = bytearray(b"\xff" * len(d))
        for k in asked:
            if want[k][0] == f:
                kept[want[k][1] : want[k][1] + want[k][2]] = d[want[k][1] : want[k][1] + want[k][2]]
        open(f, "wb").write(bytes(kept))
    got = {r.row_index: r.line for r in L.read_at(located, str(folder / "in")).collect()}
    assert got == {k: want[k][3] for k in asked}


def test_a_large_file_is_many_partitions(spark, tmp_path):
    (tmp_path / "big.jsonl").write_bytes(b"".join(b'{"i": %d}\n' % i for i in range(50_000)))
    df = L.lines(spark, str(tmp_path / "big.jsonl"), 1 << 16)
    assert df.select(F.spark_partition_id()).distinct().count() == -(-(tmp_path / "big.jsonl").stat().st_size // (1 << 16))
    assert df.agg(F.count(F.lit(1)), F.sum("n_bytes")).first() == (50_000, (tmp_path / "big.jsonl").stat().st_size)


def test_missing_and_empty_folders(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert L.lines(spark, str(tmp_path / "none")).count() == 0
    L.write_offsets(spark, str(tmp_path / "none"), str(tmp_path / "index"))
    assert L.read_at(L.offsets(spark, str(tmp_path / "index")), str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="absent"):
        L.lines(spark, str(tmp_path / "absent")).count()
