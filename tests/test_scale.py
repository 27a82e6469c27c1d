"""What keeps work from growing faster than its input: where groups are made, what is asked of names, how files are dealt to tasks."""

import numpy as np
import pandas as pd
import pytest

from neurosheaf import queries
from neurosheaf.functions import filters
from neurosheaf.operators import blockwise, channels, filtering
from neurosheaf.sources import files

SMALLEST = "/root/testdata/sf0.001"


def plan(df) -> list[str]:
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def test_names_are_told_after_channels_are_distinct(spark):
    """A filter on types and names isn't pushed down to the samples."""
    lines = plan(channels.pick(queries._typed(spark, SMALLEST), ["good", "eog", "pz"], exclude_bad=True).select("recording", "channel"))
    at = next(i for i, line in enumerate(lines) if "posexplode" in line or "explode(names" in line)
    assert not any("RLIKE" in line or "regexp" in line for line in lines[at + 1 :])


def test_samples_of_the_view_are_dealt_out_once(spark):
    """Groups by recording and sample, or channel, are made where the window over a recording left its rows."""
    made = queries.sig(spark, SMALLEST)
    for keys in (["recording", "sample"], ["recording", "channel"]):
        assert sum("Exchange" in line for line in plan(made.groupBy(*keys).agg({"value": "max", "sample": "max"}))) == 1


def test_short_channels_need_no_states(spark, monkeypatch):
    """Channels of one block are filtered where they are: by no prefix, and without being written."""
    x = np.random.default_rng(1).normal(size=1000)
    monkeypatch.setattr(blockwise, "iir", lambda *_: pytest.fail("went over states of blocks"))
    got = filtering.notch_filter(spark.createDataFrame(pd.DataFrame({"recording": "r", "channel": "c", "sample": np.arange(1000), "value": x})), 30.0, 200.0).toPandas().sort_values("sample")
    for f in (30.0, 60.0, 90.0):
        x = filters.zero_phase(filters.notch(f, 200.0), x)
    assert got["sample"].tolist() == list(range(1000)) and np.abs(got.value.to_numpy() - x).max() < 1e-9


def test_long_and_short_channels_together(spark, monkeypatch):
    """Those of more than a block go over states, the others don't."""
    monkeypatch.setattr(blockwise, "SIZE", 1 << 11)
    parts = [pd.DataFrame({"recording": "r", "channel": f"c{n}", "sample": np.arange(n), "value": np.random.default_rng(n).normal(size=n)}) for n in (5000, 300, 1)]
    got = filtering.notch_filter(spark.createDataFrame(pd.concat(parts)), 60.0, 200.0).toPandas()
    for p in parts:
        own = got[got.channel == p.channel.iloc[0]].sort_values("sample")
        assert np.abs(own.value.to_numpy() - filters.zero_phase(filters.notch(60.0, 200.0), p.value.to_numpy())).max() < 1e-8


def test_many_small_files_are_read_several_a_task(spark, tmp_path, monkeypatch):
    """Ranges of a file stay what is read at a time, but not a task each; filters hold as before."""
    rows = spark.range(40).selectExpr("id as recording").crossJoin(spark.range(600).selectExpr("id as sample")).selectExpr("recording", "'c' as channel", "sample", "cast(recording + sample as double) as value")
    assert files.write(rows, str(tmp_path), 100.0).count() == 40 and not list(tmp_path.glob(".parts-*/*/*"))
    read = lambda: files.read(spark, str(tmp_path), range_mb=0.0005).where("sample >= 200 and sample < 350")
    want, apart = sorted(map(tuple, read().collect())), read().rdd.getNumPartitions()
    made = files.RecordingsReader({"path": str(tmp_path), "range_mb": "0.0005"})
    monkeypatch.setattr(files, "FILES", 10)
    packs = made.partitions()
    assert apart >= 40 and len(packs) == 1 and len(want) == 40 * 150
    made.first, made.last = 200, 350
    got = sorted(r for p in packs for b in made.read(p) for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    assert got == want
