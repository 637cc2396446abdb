import datetime as dt
from dataclasses import replace
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lamella import Table, compact_partitions, mart, preview, table_for, write_incremental
from lamella.operators import incremental
from lamella.operators.incremental import (
    _rewrite,
    default_unique_key,
    delete_insert,
    full_refresh,
    merge,
    merge_frame,
    overwrite_partitions,
)
from lamella.session import Workspace, shared_folder

SCHEMA = "k int, v string, partition_daily date"


def frame(spark, *rows):
    return spark.createDataFrame([(k, v, dt.date(2024, 1, d)) for k, v, d in rows], SCHEMA)


def values(spark, table):
    return sorted(
        ((r.k, r.v, r.partition_daily.day) for r in table.read(spark, frame(spark).schema).collect()), key=repr
    )


@pytest.fixture
def table(spark, tmp_path):
    stored = Table(str(tmp_path / "t"), ("partition_daily",))
    write_incremental(frame(spark, (1, "a", 1), (2, "b", 1), (3, "c", 2)), stored)
    return stored


def test_default_keys():
    assert default_unique_key(["partition_monthly", "partition_daily"]) == ["partition_daily"]
    assert default_unique_key(["partition_monthly"]) == ["partition_monthly"]
    assert default_unique_key(["x", "y"]) == ["x", "y"]


def test_table_takes_the_partitions_the_model_has(spark):
    assert table_for(frame(spark), "/p").partitions == ("partition_daily",)


def test_merge_is_idempotent_and_moves_rows(spark, table):
    new = frame(spark, (3, "moved", 5), (4, "new", 2))
    for _ in range(2):
        write_incremental(new, table, "merge", unique_key="k")
        assert values(spark, table) == [(1, "a", 1), (2, "b", 1), (3, "moved", 5), (4, "new", 2)]


def test_merge_empties_a_partition(spark, table):
    write_incremental(frame(spark, (3, "moved", 1)), table, "merge", unique_key=["k"])
    assert values(spark, table) == [(1, "a", 1), (2, "b", 1), (3, "moved", 1)]


def test_merge_rejects_repeated_keys_but_not_null_ones(spark, table):
    with pytest.raises(ValueError, match="repeat"):
        write_incremental(frame(spark, (1, "x", 1), (1, "y", 1)), table, "merge", unique_key="k")
    write_incremental(frame(spark, (None, "x", 1), (None, "y", 1)), table, "merge", unique_key="k")
    assert len(values(spark, table)) == 5


def test_merge_column_choice(spark, rows):
    old = spark.createDataFrame([(1, "a", "b")], "k int, x string, y string")
    new = spark.createDataFrame([(1, None, "B"), (2, "c", "d")], "k int, x string, y string")
    assert rows(merge_frame(old, new, ["k"])) == [(1, None, "B"), (2, "c", "d")]
    assert rows(merge_frame(old, new, ["k"], ["y"])) == [(1, "a", "B"), (2, "c", "d")]
    assert rows(merge_frame(old, new, ["k"], None, ["y"])) == [(1, None, "b"), (2, "c", "d")]
    with pytest.raises(ValueError):
        merge_frame(old, new, ["k"], ["x"], ["y"])


def test_delete_insert_by_day_and_by_key(spark, table):
    write_incremental(frame(spark, (9, "z", 1), (9, "z", 1)), table)
    assert values(spark, table) == [(3, "c", 2), (9, "z", 1), (9, "z", 1)]
    write_incremental(frame(spark, (9, "once", 3)), table, unique_key="k")
    assert values(spark, table) == [(3, "c", 2), (9, "once", 3)]


def test_delete_insert_clears_finer_partitions(spark, tmp_path):
    stored = Table(str(tmp_path / "t"), ("partition_daily", "k"))
    write_incremental(frame(spark, (1, "a", 1), (2, "b", 1), (2, "c", 2)), stored)
    write_incremental(frame(spark, (1, "A", 1)), stored)
    assert values(spark, stored) == [(1, "A", 1), (2, "c", 2)]


def test_unpartitioned_tables(spark, tmp_path):
    stored = Table(str(tmp_path / "t"))
    write_incremental(frame(spark, (1, "a", 1)), stored, "full_refresh")
    write_incremental(frame(spark, (1, "b", 1), (2, "c", 1)), stored, "merge", unique_key="k")
    write_incremental(frame(spark, (2, "d", 1)), stored, unique_key="k")
    assert values(spark, stored) == [(1, "b", 1), (2, "d", 1)]
    with pytest.raises(ValueError):
        write_incremental(frame(spark, (2, "d", 1)), stored)
    with pytest.raises(ValueError):
        write_incremental(frame(spark, (2, "d", 1)), stored, "overwrite_existing_partitions")


def test_overwrite_append_refresh(spark, table):
    write_incremental(frame(spark, (7, "x", 2)), table, "overwrite_existing_partitions")
    write_incremental(frame(spark, (7, "x", 2)), table, "append")
    assert values(spark, table) == [(1, "a", 1), (2, "b", 1), (7, "x", 2), (7, "x", 2)]
    write_incremental(frame(spark, (8, "y", 4)), table, "append", refresh=True)
    assert values(spark, table) == [(8, "y", 4)]
    with pytest.raises(ValueError):
        write_incremental(frame(spark), table, "replace")
    with pytest.raises(ValueError):
        write_incremental(frame(spark), table, "merge")


def test_strings_with_special_characters_as_partitions(spark, tmp_path):
    stored = Table(str(tmp_path / "t"), ("v",))
    df = frame(spark, (1, "a b/c:d=%e", 1), (2, None, 1), (3, "plain", 1))
    write_incremental(df, stored)
    moved = frame(spark, (1, "plain", 1), (2, "plain", 1))
    write_incremental(moved, stored, "merge", unique_key="k")
    assert values(spark, stored) == [(1, "plain", 1), (2, "plain", 1), (3, "plain", 1)]


def test_compaction_keeps_rows_and_reduces_files(spark, table):
    for i in range(4):
        write_incremental(frame(spark, (10 + i, "x", 1), (20 + i, "x", 2)), table, "append")
    files = lambda: sorted(table.read(spark).inputFiles())
    before, rows_before = files(), values(spark, table)
    compact_partitions(spark, table, "2024-01-01")
    after = files()
    assert values(spark, table) == rows_before
    day = lambda names, d: [n for n in names if f"2024-01-0{d}" in n]
    assert len(day(after, 1)) == 1 < len(day(before, 1)) and day(after, 2) == day(before, 2)


def test_hooks_run_around_the_write(spark, table):
    write_incremental(
        frame(spark, (1, "a", 1)),
        table,
        pre_hooks="SET lamella.before = yes",
        post_hooks=["SET lamella.after = yes"],
    )
    assert spark.conf.get("lamella.before") == spark.conf.get("lamella.after") == "yes"


def test_mart_is_a_view(spark):
    mart(frame(spark, (1, "a", 1)), "a_mart")
    assert spark.sql("SELECT count(*) FROM a_mart").first()[0] == 1
    assert preview(spark.range(500)).count() == 100 and preview(spark.range(500).limit(3)).count() == 3


def test_working_copies_lie_in_the_shared_folder_and_go_with_success(spark):
    folder = shared_folder(spark)
    assert folder == spark.conf.get("spark.checkpoint.dir", folder)
    with Workspace(spark) as work:
        df = work.materialize(spark.range(3), "test")
        assert all(folder.removeprefix("file:") in f for f in df.inputFiles())
        assert df.agg(F.sum("id")).first()[0] == 3
    assert not Path(work.paths[0].removeprefix("file:")).exists()
    with pytest.raises(RuntimeError), Workspace(spark) as work:
        work.materialize(spark.range(3), "test")
        raise RuntimeError
    assert Path(work.paths[0].removeprefix("file:")).exists()


def test_compaction_by_month_and_of_whole_tables(spark, tmp_path):
    monthly = "k int, v string, partition_monthly date"
    rows = lambda k, m: spark.createDataFrame([(k, "x", dt.date(2024, m, 1))], monthly)
    by_month, whole = Table(str(tmp_path / "m"), ("partition_monthly",)), Table(str(tmp_path / "w"))
    for table in (by_month, whole):
        for k in range(3):
            write_incremental(rows(k, 1).unionAll(rows(k, 2)).coalesce(1), table, "append")
        # A date stands for its month; a table without dates is rewritten whole.
        compact_partitions(spark, table, "2024-01-17")
        assert table.read(spark).count() == 6
    files = by_month.read(spark).inputFiles()
    assert sum("2024-01-01" in f for f in files) == 1 and sum("2024-02-01" in f for f in files) == 3
    assert len(whole.read(spark).inputFiles()) == 1


def test_a_key_holding_the_partition_limits_the_search(spark, tmp_path):
    stored = Table(str(tmp_path / "t"), ("partition_daily", "v"))
    write_incremental(frame(spark, (1, "a", 1), (1, "a", 2), (2, "b", 1)), stored)
    write_incremental(frame(spark, (1, "z", 1)), stored, "merge", unique_key=["k", "partition_daily"])
    assert values(spark, stored) == [(1, "a", 2), (1, "z", 1), (2, "b", 1)]
    write_incremental(frame(spark, (1, "z", 3)), stored, "merge", unique_key=["k", "v", "partition_daily"])
    assert values(spark, stored) == [(1, "a", 2), (1, "z", 1), (1, "z", 3), (2, "b", 1)]


def _session(master, configured=None, current=None):
    """Just enough of a session to ask for its shared folder."""
    chosen = []
    context = SimpleNamespace(
        master=master, getCheckpointDir=lambda: (chosen or [current])[-1], setCheckpointDir=chosen.append
    )
    conf = SimpleNamespace(get=lambda key, default=None: configured if key == "spark.checkpoint.dir" else default)
    return SimpleNamespace(sparkContext=context, conf=conf), chosen


def test_the_shared_folder_is_the_configured_one():
    session, chosen = _session("spark://host:7077", configured="/shared/ckpt")
    assert shared_folder(session) == "/shared/ckpt" and chosen == ["/shared/ckpt"]
    session, chosen = _session("yarn", current="/set/in/code")
    assert shared_folder(session) == "/set/in/code" and not chosen
    session, _ = _session("yarn")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session)
    session, chosen = _session("local[2]")
    assert [shared_folder(session)] == chosen


def test_columns_a_table_does_not_have_are_refused(spark, tmp_path):
    table = Table(str(tmp_path / "t"), ("p",))
    full_refresh(spark.createDataFrame([(1, 10, "a"), (2, 20, "a")], "k int, v int, p string"), table)
    fresh = spark.createDataFrame([(1, 11, 5, "a")], "k int, v int, w int, p string")
    for act in (lambda: merge(fresh, table, "k"), lambda: delete_insert(fresh, table, ["k"]), lambda: delete_insert(fresh, table)):
        with pytest.raises(ValueError, match="w"):
            act()
    for option in ("update_columns", "exclude_columns"):
        with pytest.raises(ValueError, match="nope"):
            merge(fresh.drop("w"), table, "k", **{option: ["nope"]})
    assert sorted(r["v"] for r in table.read(spark).collect()) == [10, 20]


def test_rows_keep_what_new_rows_do_not_say(spark, tmp_path):
    table = Table(str(tmp_path / "t"), ("p",))
    full_refresh(spark.createDataFrame([(1, 10, 7, "a"), (2, 20, 8, "a")], "k int, v int, w int, p string"), table)
    merge(spark.createDataFrame([(1, 11, "a"), (3, 30, "b")], "k int, v int, p string"), table, "k")
    found = sorted(tuple(r) for r in table.read(spark).select("k", "v", "w", "p").collect())
    assert found == [(1, 11, 7, "a"), (2, 20, 8, "a"), (3, 30, None, "b")]


def test_null_keys_match_nothing_and_are_kept(spark, tmp_path):
    table = Table(str(tmp_path / "t"), ("p",))
    full_refresh(spark.createDataFrame([(1, None), (None, "a"), (3, "a")], "k int, p string"), table)
    merge(spark.createDataFrame([(None, "a"), (3, "a")], "k int, p string"), table, "k")
    delete_insert(spark.createDataFrame([(9, None)], "k int, p string"), table, ["p"])
    found = sorted(((r["k"], r["p"]) for r in table.read(spark).collect()), key=repr)
    assert found == sorted([(1, None), (9, None), (None, "a"), (None, "a"), (3, "a")], key=repr)


def test_a_table_can_be_refreshed_from_itself(spark, tmp_path):
    table = Table(str(tmp_path / "t"), ("p",))
    full_refresh(spark.createDataFrame([(1, "a"), (2, "b")], "k int, p string"), table)
    full_refresh(table.read(spark).where("k > 1"), table)
    assert [tuple(r) for r in table.read(spark).collect()] == [(2, "b")]
    overwrite_partitions(table.read(spark).selectExpr("k + 1 as k", "p"), table)
    assert [tuple(r) for r in table.read(spark).collect()] == [(3, "b")]


def test_folders_of_table_formats_are_left_alone(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "k int, p string")
    table = Table(str(tmp_path / "t"), ("p",))
    full_refresh(rows, table)
    with pytest.raises(ValueError, match="plain files"):
        _rewrite(replace(table, format="delta"), table.read(spark), rows, ["k"], lambda old: old, None)


def test_a_merge_splits_hot_keys(spark):
    old = spark.range(10).selectExpr("id % 3 AS k", "id AS v")
    plan = merge_frame(old, spark.range(5).selectExpr("id AS k", "id AS v"), ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" not in plan and "LeftOuter" in plan and "LeftAnti" in plan


def test_what_a_query_reads_is_known_without_listing_files(spark, tmp_path):
    path = str(tmp_path / "stored")
    spark.range(10).selectExpr("id", "id % 2 AS p").write.partitionBy("p").parquet(path)
    table, other = Table(path, ("p",)), Table(str(tmp_path / "stor"), ("p",))
    own = spark.read.parquet(path)
    within = spark.range(3).where(F.col("id").isin(own.select("id")))
    for df in (own, own.groupBy("p").count(), spark.read.parquet(path + "/p=1"), within, spark.range(1).union(own.select("id"))):
        assert incremental._reads(df, table) and not incremental._reads(df, other)
    assert not incremental._reads(spark.range(3), table)
    assert "inputFiles" not in Path(incremental.__file__).read_text()


def test_merge_deals_rows_of_hot_keys_to_parts(spark, monkeypatch):
    """Stored rows of a hot key get the new row wherever they lie; signs of zero and types of keys do not matter."""
    monkeypatch.setattr(incremental, "HOT_ROWS", 50)
    stored = spark.sql(
        "SELECT id, CASE WHEN id % 2 = 0 THEN if(id % 4 = 0, 0D, -0D) WHEN id % 10 = 3 THEN NULL ELSE cast(id AS double) END AS key, 'old' AS v"
        " FROM range(400)"
    )
    new = spark.sql("SELECT * FROM VALUES (0, 'zero'), (1, 'one'), (NULL, 'none'), (1000, 'more') AS t(key, v)")
    got = merge_frame(stored, new, ["key"])
    at = {r["key"]: r["v"] for r in new.collect() if r["key"] is not None}
    want = [(r["id"], r["key"], at.get(r["key"], "old")) for r in stored.collect()]
    want += [(None, None, "none"), (None, 1000.0, "more")]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    parts = got._jdf.queryExecution().analyzed().toString()
    assert "Generate explode" in parts
