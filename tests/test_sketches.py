"""Percentiles of whole vectors from sketches: exact below the buffer's size, within the stated rank error above it."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrove.operators import pooling as P
from vectrove.operators import sketches

LEVELS = [0.0, 0.1, 0.5, 0.9, 1.0]


def rank_error(values, found, share):
    """How many ranks the value is off its place, ties counted in its favour."""
    place = (len(values) - 1) * share
    low, high = np.searchsorted(np.sort(values), found, "left"), np.searchsorted(np.sort(values), found, "right")
    return max(0, low - math.ceil(place), math.floor(place) - high)


def test_sketch_keeps_every_weight_and_its_bound():
    rng = np.random.default_rng(1)
    for n, parts in ((1, 1), (1024, 3), (1025, 2), (20_000, 7), (300_000, 40)):
        values = np.c_[rng.normal(size=n), rng.integers(0, 5, n), np.arange(n)[::-1]].astype(float)
        whole = sketches.Sketch()
        for part in np.array_split(values, parts):  # merge as the tasks do
            one = sketches.Sketch()
            for batch in np.array_split(part, 3):
                if len(batch):
                    one.add(batch)
            whole.error += one.error
            for h, m in one.rows():
                whole.add(m, h)
        got, q = whole.percentiles(LEVELS)
        assert got == n
        assert whole.error <= n / sketches.SIZE * (math.log2(max(2, n / sketches.SIZE)) + 1)
        assert (whole.error == 0) == (n <= sketches.SIZE)
        for i, share in enumerate(LEVELS):
            for d in range(3):
                assert rank_error(values[:, d], q[i, d], share) <= whole.error + 1
        if n <= sketches.SIZE:
            np.testing.assert_allclose(q, np.quantile(values, LEVELS, axis=0), rtol=1e-12)


def test_hot_group_over_partitions_keeps_the_bound(spark, monkeypatch):
    monkeypatch.setattr(sketches, "BYTES", 40_000)  # many sendings of a task
    n = 60_000
    df = spark.range(n, numPartitions=12).select(F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 200).cast("string"))).alias("g"), F.array(F.hash("id").cast("double"), (F.col("id") % 7).cast("float").cast("double")).alias("v"), F.lit(1).alias("key"))
    rows = df.collect()
    for r in sketches.vector_percentiles(df, LEVELS, "g", "v").collect():
        mine = np.array([x.v for x in rows if x.g == r.g])
        assert r.n == len(mine)
        assert r.error == 0 if r.g != "hot" else 0 < r.error < 0.15 * len(mine)
        for i, share in enumerate(LEVELS):
            for d in range(2):
                assert rank_error(mine[:, d], r["values"][i][d], share) <= r.error + 1


def test_exact_for_every_group(spark, monkeypatch):
    """Groups too large for their sketch, of several lengths, with null elements, null and empty vectors, NaN, a null key and clashing names."""
    monkeypatch.setattr(sketches, "SIZE", 16)
    rng = np.random.default_rng(2)
    rows = [("small", rng.normal(size=3).tolist()) for _ in range(9)] + [("large", rng.normal(size=3).tolist()) for _ in range(100)]
    rows += [("ragged", [1.0, 2.0]), ("ragged", [3.0]), ("holes", [None, 4.0]), ("holes", [2.0, 8.0]), ("one", [5.0]), (None, [1.0, 1.0]), (None, [3.0, 2.0])]
    rows += [("null", None), ("empty", []), ("nan", [float("nan")]), ("nan", [1.0]), ("nan", [0.0])]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "patient_id string, embedding array<double>, key int, width int, `values` string").repartition(5)
    got = {r.patient_id: r.features for r in P.pool(df, "iqr").collect()}
    assert set(got) == {"small", "large", "ragged", "holes", "one", None, "nan"}
    for name in got:
        mine = [v for g, v in rows if g == name and v]
        for d in range(max(map(len, mine))):
            have = [v[d] for v in mine if d < len(v) and v[d] is not None]
            want = np.subtract(*np.quantile(have, [0.75, 0.25]))
            if name == "nan":
                assert math.isnan(got[name][d])
            else:
                assert got[name][d] == pytest.approx(want, rel=1e-12, abs=1e-12)
    got = {r.patient_id: r.features for r in P.pool(df, "mad").collect()}
    for name in ("small", "large", "ragged", "holes", None):
        mine = [v for g, v in rows if g == name and v]
        for d in range(max(map(len, mine))):
            have = np.array([v[d] for v in mine if d < len(v) and v[d] is not None])
            assert got[name][d] == pytest.approx(np.median(np.abs(have - np.median(have))), rel=1e-12, abs=1e-12)
    loose = {r.patient_id: r.features for r in P.pool(df, "iqr", exact=False).collect()}
    assert set(loose) == set(got) and loose["small"] == pytest.approx({r.patient_id: r.features for r in P.pool(df, "iqr").collect()}["small"])


def test_no_rows_and_wrong_shares(spark):
    none = spark.createDataFrame([], "patient_id long, embedding array<float>")
    for name in ("iqr", "mad", "p90_p10"):
        assert P.pool(none, name).collect() == []
    with pytest.raises(ValueError):
        sketches.vector_percentiles(none, [1.5])
