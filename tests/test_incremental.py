import pytest

from sedimenta.operators.incremental import IncrementalTable, fingerprints, partition_of, refresh_pending

CHANGES = "project string, rel_path string, kind string, content_hash string, ts timestamp, change_id long, extra int"
HASHES = "project string, rel_path string, content_hash string, run_id long, batch_no int"
RUNS = "run_id long, batches_processed int"


def frames(spark, changes, hashes, runs):
    from datetime import datetime, timedelta

    rows = [(p, f, k, h, datetime(2025, 1, 1) + timedelta(hours=t), i, 0) for p, f, k, h, t, i in changes]
    return spark.createDataFrame(rows, CHANGES), spark.createDataFrame(hashes, HASHES), spark.createDataFrame(runs, RUNS)


def test_pending_files(spark, tmp_path):
    changes = [("p", "new", "create", "h1", 1, 1), ("p", "same", "create", "h2", 1, 2), ("p", "late", "update", "h4", 5, 3), ("p", "late", "update", "h3", 2, 9), ("p", "gone", "delete", None, 3, 4), ("p", "new", "create", "h1", 1, 1), (None, "n", "create", "x", 1, 8)]
    hashes = [("p", "same", "h2", 1, 1), ("p", "late", "h3", 1, 1), ("p", "gone", "h9", 1, 1), ("p", "new", "h1", 2, 3), ("p", "old", "h", 3, 1), ("p", "old", None, 4, 1)]
    runs = [(1, 1), (1, None), (2, 2), (2, None), (3, 1), (4, 1)]
    table = IncrementalTable(spark, f"file://{tmp_path}/t", buckets=4)
    got = {tuple(r)[:3] for r in refresh_pending(table, *frames(spark, changes, hashes, runs)).select("project", "rel_path", "action").collect()}
    assert got == {("p", "new", "added"), ("p", "late", "updated"), ("p", "gone", "removed"), ("", "n", "added")}


def test_recomputes_only_what_changed_and_survives_failure(spark, tmp_path):
    rows = [("p", f"f{i}", i) for i in range(40)]
    schema, seen = "project string, rel_path string, v int", []

    def work(data):
        seen.append(sorted(r.rel_path for r in data.select("rel_path").collect()))
        return data.withColumn("double", data.v * 2)

    def fails(data):
        raise RuntimeError("lost")

    table = IncrementalTable(spark, f"file://{tmp_path}/t", buckets=8)
    first = table.refresh({"data": spark.createDataFrame(rows, schema)}, ("project", "rel_path"), work)
    assert first.count() == 40
    assert table.refresh({"data": spark.createDataFrame(rows, schema)}, ("project", "rel_path"), fails).count() == 40  # nothing changed
    changed = [*rows[1:], ("p", "f1", 100)]
    with pytest.raises(RuntimeError):
        table.refresh({"data": spark.createDataFrame(changed, schema)}, ("project", "rel_path"), fails)
    table = IncrementalTable(spark, f"file://{tmp_path}/t", buckets=8)
    again = table.refresh({"data": spark.createDataFrame(changed, schema)}, ("project", "rel_path"), work)
    assert sorted((r.rel_path, r.double) for r in again.collect()) == sorted((f, v * 2) for _, f, v in changed)
    assert len(seen) == 2 and {"f1"} <= set(seen[1]) and len(seen[1]) < 40
    emptied = table.refresh({"data": spark.createDataFrame([], schema)}, ("project", "rel_path"), work)
    assert emptied.count() == 0
    with pytest.raises(ValueError):
        IncrementalTable(spark, f"file://{tmp_path}/t", buckets=9)


def test_fingerprints_ignore_order_not_copies(spark):
    one = spark.createDataFrame([("a", 1), ("b", 2), (None, None)], "k string, v int")
    other = spark.createDataFrame([(2, "b"), (None, None), (1, "a")], "v int, k string")
    prints = lambda d: sorted(map(tuple, fingerprints(d, "s", partition_of(2, "k")).collect()))
    assert prints(one) == prints(other)
    assert prints(one) != prints(one.union(one.limit(1)))


def test_a_run_that_dies_after_the_overwrite_leaves_no_stale_rows(spark, tmp_path, monkeypatch):
    schema = "project string, rel_path string, v int"
    data = lambda v: {"data": spark.createDataFrame([("p", "a", v), ("q", "b", 7)], schema)}
    work = lambda data: data.withColumn("double", data.v * 2)
    for kind in ({}, {"buckets": 4}):
        root = f"file://{tmp_path}/t{len(kind)}"
        assert {r.v for r in IncrementalTable(spark, root, **kind).refresh(data(1), ("project", "rel_path"), work).collect()} == {1, 7}
        table = IncrementalTable(spark, root, **kind)
        put = table._put

        def dies(name, content):
            if name.startswith("done-"):
                raise RuntimeError("lost")
            put(name, content)

        monkeypatch.setattr(table, "_put", dies)
        with pytest.raises(RuntimeError):
            table.refresh(data(2), ("project", "rel_path"), work)
        assert {r.v for r in IncrementalTable(spark, root, **kind).refresh(data(1), ("project", "rel_path"), work).collect()} == {1, 7}
        assert {(r.v, r.double) for r in IncrementalTable(spark, root, **kind).refresh(data(2), ("project", "rel_path"), work).collect()} == {(2, 4), (7, 14)}
        assert sum(n.startswith(("done-", "intent-", "prints-")) for n in (x.name for x in (tmp_path / f"t{len(kind)}").iterdir())) == 2


def test_first_refresh_on_empty_inputs(spark, tmp_path):
    schema = "project string, rel_path string, v int"
    table = IncrementalTable(spark, f"file://{tmp_path}/t")
    first = table.refresh({"data": spark.createDataFrame([], schema)}, ("project", "rel_path"), lambda data: data.withColumn("double", data.v * 2))
    assert first.columns == ["project", "rel_path", "v", "double"] and first.count() == 0
    rows = [("p", "a", 1)]
    assert table.refresh({"data": spark.createDataFrame(rows, schema)}, ("project", "rel_path"), lambda data: data.withColumn("double", data.v * 2)).count() == 1


def test_partitions_follow_scopes_and_size(spark, tmp_path):
    schema, seen = "project string, rel_path string, v int", []

    def work(data):
        seen.append({r.project for r in data.select("project").distinct().collect()})
        return data

    rows = [("big", f"f{i}", i) for i in range(120)] + [(f"p{k}", f"f{i}", i) for k in range(60) for i in range(2)] + [(None, None, 0)]
    table = IncrementalTable(spark, f"file://{tmp_path}/t", part_rows=20)
    refresh = lambda rows: table.refresh({"data": spark.createDataFrame(rows, schema)}, ("project", "rel_path"), work)
    assert refresh(rows).count() == len(rows)
    small = [(p, f, v + (p == "p7")) for p, f, v in rows]
    assert refresh(small).count() == len(rows) and "p7" in seen[-1] and len(seen[-1]) < 30 and "big" not in seen[-1]
    big = [(p, f, v + (f == "f100")) for p, f, v in small]
    assert sorted(map(str, refresh(big).collect())) == sorted(map(str, spark.createDataFrame(big, schema).collect())) and seen[-1] == {"big"}
    grown = big + [(f"n{i}", "x", i) for i in range(1000)]
    assert refresh(grown).count() == len(grown) and len(seen[-1]) > 1000
    assert refresh(grown).count() == len(grown) and len(seen) == 4
