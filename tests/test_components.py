"""Connected components: as many tasks as the links need, links worked out once."""

from hairpin.operators.components import connected_components
from hairpin.plans.lineage import in_tasks

HELD = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


def test_small_graphs_take_few_tasks_and_links_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 50), (60, None), (None, 61)], "a long, b long").mapInArrow(seen, "a long, b long")
    before = {k: spark.conf.get(k) for k in HELD}
    for k, v in HELD.items():
        spark.conf.set(k, v)
    try:
        found = connected_components(links, "a", "b")
        assert {(r.id, r.component) for r in found.collect()} == {(i, 0) for i in range(31)} | {(50, 50)}
        assert found.rdd.getNumPartitions() == 1 and read.value == 33
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_tasks_follow_rows_and_are_never_more(spark):
    rows = spark.range(1000).repartition(12)
    assert [in_tasks(rows, n, 10).rdd.getNumPartitions() for n in (0, 1, 35, 1000)] == [1, 1, 4, 12]
