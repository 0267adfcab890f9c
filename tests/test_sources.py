import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from somaframe.functions import folders
from somaframe.sources import files as X
from somaframe.sources import records as R


def by_hand_212(samples):
    """Twelve bits at a time, as a string of bits: low byte of the first, high halves (second, first), low byte of the second."""
    out = bytearray()
    samples = list(samples) + [0] * (len(samples) % 2)
    for a, b in zip(samples[::2], samples[1::2], strict=True):
        x, y = format(a & 4095, "012b"), format(b & 4095, "012b")
        out += bytes([int(x[4:], 2), int(y[:4] + x[:4], 2), int(y[4:], 2)])
    return bytes(out)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 100, 101])
def test_twelve_bits(n):
    samples = np.random.default_rng(n).integers(-2048, 2048, n)
    assert R.encode(samples, 212) == by_hand_212(samples.tolist())[: 3 * n // 2 + n % 2]
    assert R.decode(R.encode(samples, 212), 212).tolist() == samples.tolist()


def test_sixteen_bits():
    samples = np.array([-32768, -1, 0, 1, 258, 32767])
    assert R.encode(samples, 16) == b"\x00\x80\xff\xff\x00\x00\x01\x00\x02\x01\xff\x7f"
    assert R.decode(R.encode(samples, 16), 16).tolist() == samples.tolist()
    with pytest.raises(ValueError, match="fit"):
        R.encode(np.array([2048]), 212)


def test_headers():
    h = R.parse_header("# a comment\nrec01 2 250 1800000\nrec01.dat 16 200(5)/mV 16 0 7 0 0 ECG lead II\nrec01.dat 16 0 16 3 0 0 0 RESP\n")
    assert (h.name, h.rate, h.frames) == ("rec01", 250.0, 1800000)
    assert [(c.gain, c.baseline, c.label) for c in h.channels] == [(200.0, 5.0, "ECG lead II"), (200.0, 3.0, "RESP")]
    assert R.parse_header("x 1\nx.dat 212\n").rate == 250.0
    with pytest.raises(ValueError, match="not known"):
        R.parse_header("x 1 100 5\nx.dat 80 200 8 0 0 0 0 ECG\n")
    with pytest.raises(ValueError, match="one file"):
        R.parse_header("x 2 100 5\nx.dat 16 200 8 0 0 0 0 ECG\ny.dat 16 200 8 0 0 0 0 RESP\n")


@pytest.mark.parametrize("kind", [16, 212])
def test_records_in_parts(spark, tmp_path, kind):
    """Three channels of odd length, in parts that begin in the middle of a record; the first channel that matches counts."""
    n = 101
    rows = spark.range(n).select(F.lit("rec").alias("name"), F.col("id").alias("i"), (F.col("id") / 4 - 10).alias("Resp belt"), (F.col("id") % 7).cast("double").alias("ECG I"), F.when(F.col("id") % 10 == 3, None).otherwise(-1.5).alias("ecg II"))
    path = str(tmp_path / "rec")
    assert R.write_records(rows, path, 50.0, kind, 4.0, ["Resp belt", "ECG I", "ecg II"], baseline=3).collect()[0].frames == n
    for parts in (2, 7, 64, 1000):
        got = X.load("binary_records", spark, folder=path, part_frames=parts)
        assert got.rdd.getNumPartitions() == -(-n // max(2, parts // 2 * 2))
        by = {(r.signal, r.i): r for r in got.collect()}
        assert len(by) == 2 * n
        assert all(by["ecg", i].value == i % 7 and by["resp", i].value == i / 4 - 10 and by["ecg", i].time_s == i / 50 for i in range(n))
    other = X.load("binary_records", spark, folder=path, signals=["ii"]).toPandas()
    assert other.value.isna().sum() == 10 and (other.value.dropna() == -1.5).all()
    assert X.load("binary_records", spark, folder=path, records=["none"]).count() == 0


def test_many_short_records(spark, tmp_path):
    """Partitions hold runs of parts, so that they do not grow with the number of records."""
    rows = spark.range(6_000).select(F.concat(F.lit("r"), F.floor(F.col("id") / 10)).alias("name"), (F.col("id") % 10).alias("i"), (F.col("id") / 2).alias("ecg"))
    path = str(tmp_path / "short")
    assert R.write_records(rows, path, 50.0, 16, 2.0, ["ecg"]).count() == 600
    got = X.load("binary_records", spark, folder=path, part_frames=4)
    assert got.rdd.getNumPartitions() == R.MOST_SINGLE
    assert {(r.name, r.i): r.value for r in got.collect()} == {(f"r{k // 10}", k % 10): k / 2 for k in range(6_000)}


def test_levels_are_pruned(spark, tmp_path):
    base = str(tmp_path / "windows")
    assert X.levels(spark, base) == []
    assert X.write_level(spark.range(5).withColumn("level", F.lit(9)), base) == 1
    assert X.write_level(spark.range(3).withColumn("more", F.lit("x")), base) == 2
    assert X.write_level(spark.range(1), base, 7) == 7
    assert X.levels(spark, base) == [1, 2, 7] and X.write_level(spark.range(2), base) == 8
    with pytest.raises(ValueError, match="there"):
        X.write_level(spark.range(2), base, 2)
    assert {r["level"]: r["count"] for r in X.read_levels(spark, base).groupBy("level").count().collect()} == {1: 5, 2: 3, 7: 1, 8: 2}
    some = X.read_levels(spark, base, [2])
    assert some.count() == 3 and set(some.columns) == {"id", "more", "level"}
    plan = some._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: ")[1].split("]")[0]
    assert "level" in filters and "2" in filters
    assert all("level=2" in f for f in some.inputFiles()) or "level" in filters


def test_shared_folder(tmp_path):
    def fake(master, named=None):
        conf = types.SimpleNamespace(get=lambda key, default: named or default)
        return types.SimpleNamespace(sparkContext=types.SimpleNamespace(master=master, getConf=lambda: conf))

    assert folders.shared(fake("spark://host:7077", "hdfs://x/y")) == "hdfs://x/y"
    for master in ("local", "local[4]", "local[*]"):
        assert folders.shared(fake(master)).startswith("/")
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            folders.shared(fake(master))
