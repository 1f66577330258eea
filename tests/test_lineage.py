"""Lineage cuts: what is read later is the written table, and the session's settings stay as they were."""

import pytest
from pyspark.sql import functions as F

from hairpin.plans import lineage


@pytest.mark.parametrize("write", [lineage.cut, lineage.store])
def test_a_written_table_needs_none_of_its_shuffles(spark, write):
    before = spark.conf.get(lineage.CLEANUP, "false")
    source = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("total"))
    want = {k: sum(range(k, 1000, 7)) for k in range(7)}
    written = write(source)
    assert spark.conf.get(lineage.CLEANUP) == before
    # read twice, joined with itself, and beside its source, which is computed again
    for _ in range(2):
        assert {r.k: r.total for r in written.collect()} == want
    assert written.alias("x").join(written.alias("y"), "k").count() == 7
    assert source.join(written, ["k", "total"]).count() == 7
    assert write(source.where("false")).count() == 0


def test_the_setting_is_restored_when_a_write_fails(spark):
    before = spark.conf.get(lineage.CLEANUP, "false")
    with pytest.raises(Exception):  # noqa: B017
        lineage.store(spark.range(5).select(F.raise_error(F.lit("no")).alias("x")))
    assert spark.conf.get(lineage.CLEANUP) == before


def test_what_is_stored_in_a_scratch_goes_but_what_is_kept(spark):
    from pathlib import Path

    there = lambda df: Path(df.inputFiles()[0].removeprefix("file:").rpartition("/")[0].replace("///", "/")).exists()
    outside = lineage.store(spark.range(3))
    with lineage.scratch(spark) as keep:
        own = lineage.store(spark.range(5))
        with lineage.scratch(spark) as keep_inner:
            inner, passed = lineage.store(spark.range(6)), keep_inner(spark.range(7))
        assert not there(inner) and there(passed) and there(own)
        kept = keep(own.where("id > 1"))
    assert not there(own) and not there(passed) and there(kept) and there(outside) and kept.count() == 3
    with pytest.raises(ZeroDivisionError), lineage.scratch(spark):
        own = lineage.store(spark.range(5))
        1 / 0  # noqa: B018
    assert not there(own)
