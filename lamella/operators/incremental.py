"""Incremental writes on partitioned files: replace dates, delete and insert, upsert, append.

Only the partitions a write touches are read and rewritten. A write that depends on the table's
own rows is computed into the shared folder first, so that it never overwrites what it reads.
Plain files have no transactions: readers may see a write half done, and a job that dies in its
last step, the replacement of partitions, leaves its computed copy in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.names import NAMES, Names
from lamella.operators.checks import Counted, Watched
from lamella.operators.dates import in_dates, month_starts, parse_dates
from lamella.operators.roles import ident
from lamella.session import Workspace, remove

# Formats whose folders hold nothing but data files, so that a folder may be removed.
PLAIN_FORMATS = ("parquet", "orc", "avro", "csv", "json", "text")

# The strategies of an incremental model.
STRATEGIES = ("delete+insert", "merge", "overwrite_existing_partitions", "append", "full_refresh")


@dataclass(frozen=True)
class Table:
    """A stored model: where it lies and how it is partitioned.

    ``rebalance`` brings the rows of a partition together before they are written, which keeps
    files large; switch it off for data that already comes that way.
    """

    path: str
    partitions: tuple[str, ...] = ()
    format: str = "parquet"
    options: dict = field(default_factory=dict)
    rebalance: bool = True

    def read(self, spark: SparkSession, schema: T.StructType | None = None) -> DataFrame:
        reader = spark.read.format(self.format).options(**self.options)
        return (reader.schema(schema) if schema is not None else reader).load(self.path)

    def stored(self, spark: SparkSession, new: T.StructType) -> DataFrame | None:
        """The table's rows under its own schema, or None when nothing was written yet.

        Partition columns have no stored type; they take that of the new rows.
        """
        try:
            own = self.read(spark).schema
        except AnalysisException as error:
            if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise
        typed = [new[f.name] if f.name in self.partitions and f.name in new.names else f for f in own]
        return self.read(spark, T.StructType(typed))


def table_for(df: DataFrame, path: str, partitions: Sequence[str] = NAMES.partitions, **kwargs) -> Table:
    """A table partitioned by those of ``partitions`` the model has."""
    return Table(path, tuple(p for p in partitions if p in df.columns), **kwargs)


def _write(df: DataFrame, table: Table, mode: str, overwrite: str = "static") -> None:
    # Adaptive execution splits partitions that are too big for one task, such as a very busy day.
    if table.partitions and table.rebalance:
        df = df.hint("rebalance", *table.partitions)
    writer = df.write.format(table.format).options(**table.options).mode(mode)
    writer = writer.option("partitionOverwriteMode", overwrite)
    (writer.partitionBy(*table.partitions) if table.partitions else writer).save(table.path)


def _roots(df: DataFrame) -> list[str]:
    """The folders that a query reads files from, subqueries included; their files are not listed."""
    plan, found = df._jdf.queryExecution().analyzed(), []
    subqueries = plan.subqueriesAll()
    for part in [plan, *(subqueries.apply(k) for k in range(subqueries.size()))]:
        leaves = part.collectLeaves()
        for leaf in (leaves.apply(k) for k in range(leaves.size())):
            if leaf.getClass().getSimpleName() == "LogicalRelation":
                relation = leaf.relation()
                if relation.getClass().getSimpleName() == "HadoopFsRelation":
                    paths = relation.location().rootPaths()
                    found += [paths.apply(k).toString() for k in range(paths.size())]
    return found


def _reads(df: DataFrame, table: Table) -> bool:
    """Whether ``df`` is computed from the table's own files: from its folder, one below or one above it."""

    def plain(path: str) -> str:
        path = path.split("://", 1)[-1] if "://" in path else path.split(":", 1)[-1]
        return path.replace("//", "/").rstrip("/") + "/"

    own = plain(table.path)
    roots = [plain(p) for p in _roots(df)]
    return any(p.endswith(own) or own in p or own.startswith(p) for p in roots)


def _detached(df: DataFrame, table: Table, work: Workspace) -> DataFrame:
    """``df``, or a copy of it when it reads the files that are about to be replaced."""
    return work.materialize(df, "detached") if _reads(df, table) else df


def full_refresh(df: DataFrame, table: Table) -> None:
    """Rebuild the table from scratch, also from its own rows."""
    with Workspace(df.sparkSession) as work:
        _write(_detached(df, table, work), table, "overwrite")


def append(df: DataFrame, table: Table) -> None:
    """Add rows."""
    _write(df, table, "append")


def overwrite_partitions(df: DataFrame, table: Table) -> None:
    """Replace exactly the partitions present in ``df``."""
    if not table.partitions:
        raise ValueError("only a partitioned table can have partitions replaced")
    with Workspace(df.sparkSession) as work:
        _write(_detached(df, table, work), table, "overwrite", "dynamic")


def default_unique_key(partitions: Sequence[str], names: Names = NAMES) -> list[str]:
    """The daily partition, else the monthly one, else all partition columns."""
    for name in (names.daily, names.monthly):
        if name in partitions:
            return [name]
    return list(partitions)


def _same(keys: Sequence[str], left: str, right: str, null_safe: bool = False) -> Column:
    pairs = [(F.col(ident(left, k)), F.col(ident(right, k))) for k in keys]
    return reduce(lambda a, b: a & b, [a.eqNullSafe(b) if null_safe else a == b for a, b in pairs])


def _null_key(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(ident(k)).isNull() for k in keys])


def check_columns(new: DataFrame, target: DataFrame, named: Sequence[str] = ()) -> None:
    """Columns the table does not have are an error, whether the new rows or the caller name them."""
    unknown = [c for c in [*new.columns, *named] if c not in target.columns]
    if unknown:
        raise ValueError(f"the table has no columns {sorted(set(unknown))}; add them by a full refresh")


def delete_insert_frame(target: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """State after deleting rows whose key is in ``new`` and adding ``new`` (duplicates kept).

    Columns that ``new`` lacks are null in the rows it adds. A null key deletes nothing.
    """
    doomed = new.select(*keys).distinct()
    kept = target.alias("t").join(doomed.alias("s"), _same(keys, "t", "s"), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


#: Keys looked at as possibly hot, the stored rows from which one is, and the parts its rows are dealt to.
CANDIDATES, HOT_ROWS, PARTS = 256, 100_000, 128


def _hot_keys(target: DataFrame, keys: Sequence[str]) -> tuple[Column, DataFrame] | None:
    """What tells stored rows of hot keys, and those keys (a bounded list, from a heavy-hitter sketch); None without any."""
    held = target.select(*keys).where(~_null_key(keys))
    number = F.xxhash64(*[F.col(ident(k)) for k in keys])
    top = held.select(number.alias("merge_hash")).agg(F.expr(f"approx_top_k(merge_hash, {CANDIDATES})").alias("top"))
    hot = [F.lit(x["item"]) for x in top.first()["top"] or () if x["count"] >= HOT_ROWS]
    return (number.isin(hot), held.where(number.isin(hot)).distinct()) if hot else None


def merge_frame(
    target: DataFrame,
    new: DataFrame,
    keys: Sequence[str],
    update_columns: Sequence[str] | None = None,
    exclude_columns: Sequence[str] | None = None,
) -> DataFrame:
    """State after an upsert on ``keys``.

    Matched rows take all columns of ``new``, only ``update_columns``, or all but
    ``exclude_columns``; unmatched new rows are inserted whole. Columns that ``new`` lacks keep
    their stored value, and are null in inserted rows. A null key matches nothing; such rows are
    spread by a number of their own, so that they do not meet in one task.

    New keys are unique, so a left join gives the stored rows and an anti join the inserted ones; Spark splits hot
    keys of both, which it does not for a full join. Stored rows of hot keys are dealt to parts besides, in
    each of which the new row is repeated: Spark splits late, when the rows to sort take a lot of memory.
    """
    if update_columns and exclude_columns:
        raise ValueError("give update_columns or exclude_columns, not both")
    check_columns(new, target, [*(update_columns or ()), *(exclude_columns or ())])
    columns = target.columns
    updated = set(update_columns or [c for c in columns if c not in (exclude_columns or ())]) & set(new.columns)
    alone = F.when(_null_key(keys), F.monotonically_increasing_id() + 1).otherwise(0).alias("merge spread")
    same = _same([*keys, "merge spread"], "t", "s")
    known, spread = new.where(~_null_key(keys)).select("*", F.lit(0).cast("long").alias("merge spread")), alone
    hot = _hot_keys(target, keys)
    if hot is not None:
        is_hot, listed = hot
        part = F.monotonically_increasing_id() % PARTS
        spread = F.when(_null_key(keys), F.monotonically_increasing_id() + 1).when(is_hot, part).otherwise(0).alias("merge spread")
        marked = known.alias("t").join(F.broadcast(listed).alias("s"), _same(keys, "t", "s"), "left")
        parts = F.when(F.col(ident("s", keys[0])).isNotNull(), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
        known = marked.select(*[F.col(ident("t", c)) for c in new.columns], F.explode(parts.cast("array<bigint>")).alias("merge spread"))
    found = target.select("*", spread.cast("long").alias("merge spread")).alias("t").join(known.alias("s"), same, "left")
    there = F.col(ident("s", "merge spread")).isNotNull()

    def pick(name: str) -> Column:
        old = F.col(ident("t", name))
        return F.when(there, F.col(ident("s", name))).otherwise(old).alias(name) if name in updated else old

    # Each stored key once, however many rows it has.
    present = target.select(*keys).where(~_null_key(keys)).distinct()
    present = present.withColumn("merge spread", F.lit(0).cast("long"))
    added = new.select("*", alone.cast("long").alias("merge spread")).alias("t")
    added = added.join(present.alias("s"), same, "left_anti").drop("merge spread")
    rows = found.select(*[pick(c) for c in columns])
    return rows.unionByName(added, allowMissingColumns=True).select(*columns)


def _in_partitions(df: DataFrame, touched: DataFrame, partitions: Sequence[str]) -> DataFrame:
    """Rows of the touched partitions.

    The values of each column are listed in the plan, so that other folders are not read; there
    are no more of them than folders of the table. With several columns a join picks the
    combinations that occur.
    """
    rows = touched.select(*partitions).distinct().collect()
    for p in partitions:
        values = {r[p] for r in rows}
        column = F.col(ident(p))
        found = column.isin([F.lit(v) for v in values if v is not None])
        df = df.where(found | column.isNull() if None in values else found)
    if len(partitions) == 1:
        return df
    return df.alias("t").join(touched.alias("s"), _same(partitions, "t", "s", True), "left_semi")


def _rewrite(
    table: Table,
    target: DataFrame,
    new: DataFrame,
    keys: Sequence[str],
    change: Callable[[DataFrame], DataFrame],
    work: Workspace,
) -> None:
    """Apply ``change`` to the partitions of ``target`` that ``new`` touches.

    The table's keys are read once, to find those partitions and their folders; after that only
    the touched partitions are read. Partitions that lose their last row lose their folder.
    """
    parts = table.partitions
    if not parts:
        _write(work.materialize(change(target), "changed"), table, "overwrite")
        return
    if table.format not in PLAIN_FORMATS:
        raise ValueError(f"rewriting partitions needs plain files, not {table.format!r}")
    folder = F.regexp_extract(F.col("_metadata.file_path"), "^(.*)/[^/]+$", 1).alias("folder")
    shared = [p for p in parts if p in keys]
    searched = target.select(*dict.fromkeys([*keys, *parts]), folder)
    if shared:
        searched = _in_partitions(searched, new.select(*shared).distinct(), shared)
    found = searched.alias("t")
    if set(shared) != set(keys):
        found = found.join(new.select(*keys).distinct().alias("s"), _same(keys, "t", "s"), "left_semi")
    hit = work.materialize(found.select(*parts, "folder").distinct(), "touched")
    # Both were stored, so this small list is cheap to compute again.
    touched = hit.select(*parts).unionByName(new.select(*parts)).distinct()
    # Where the new rows go, stored rows may lie in folders that the search by key did not meet.
    changed = work.materialize(change(_in_partitions(target, touched, parts)), "changed")
    left = changed.select(*parts).distinct()
    gone = hit.alias("t").join(left.alias("s"), _same(parts, "t", "s", True), "left_anti")
    emptied = [unquote(r["folder"]) for r in gone.select("folder").distinct().collect()]
    overwrite_partitions(changed, table)
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda path: remove(new.sparkSession, path), emptied))


def delete_insert(
    df: DataFrame, table: Table, unique_key: Sequence[str] | None = None, names: Names = NAMES
) -> None:
    """Delete stored rows whose key appears in ``df``, then insert ``df``.

    The default key is the daily partition, else the monthly one, else all partition columns.
    Where the key decides the partition, whole partitions are replaced and nothing is read; rows
    with a null key delete nothing and are added.
    """
    spark = df.sparkSession
    keys = list(unique_key) if unique_key else default_unique_key(table.partitions, names)
    if not keys:
        raise ValueError("a table without partitions needs a unique_key")
    target = table.stored(spark, df.schema)
    if target is None:
        full_refresh(df, table)
        return
    check_columns(df, target)
    # A day lies in one month, so a daily key decides a (monthly, daily) partition.
    decided = {*keys, names.monthly} if names.daily in keys else set(keys)
    with Workspace(spark) as work:
        if set(keys) <= set(table.partitions) <= decided:
            new = _detached(df, table, work)
            overwrite_partitions(new.where(~_null_key(keys)), table)
            append(new.where(_null_key(keys)), table)
            return
        new = work.materialize(df, "new")
        _rewrite(table, target, new, keys, lambda old: delete_insert_frame(old, new, keys), work)


def merge(
    df: DataFrame,
    table: Table,
    unique_key: str | Sequence[str],
    update_columns: Sequence[str] | None = None,
    exclude_columns: Sequence[str] | None = None,
) -> None:
    """Upsert ``df`` into the table; a key given twice in ``df`` is an error."""
    spark = df.sparkSession
    keys = [unique_key] if isinstance(unique_key, str) else list(unique_key)
    with Workspace(spark) as work:
        new = work.materialize(df, "new")
        present = reduce(lambda a, b: a & b, [F.col(ident(k)).isNotNull() for k in keys])
        twice = new.where(present).groupBy(*keys).count().where("count > 1")
        if not twice.isEmpty():
            raise ValueError(f"rows to merge repeat their key {keys}")
        target = table.stored(spark, df.schema)
        if target is None:
            full_refresh(new, table)
            return
        check_columns(new, target, [*(update_columns or ()), *(exclude_columns or ())])

        def change(old: DataFrame) -> DataFrame:
            return merge_frame(old, new, keys, update_columns, exclude_columns)

        _rewrite(table, target, new, keys, change, work)


def run_hooks(spark: SparkSession, statements: Sequence[str] | str | None) -> None:
    """Run user SQL, one statement each."""
    for statement in [statements] if isinstance(statements, str) else statements or ():
        spark.sql(statement)


def write_incremental(
    df: DataFrame,
    table: Table,
    strategy: str = "delete+insert",
    *,
    unique_key: str | Sequence[str] | None = None,
    update_columns: Sequence[str] | None = None,
    exclude_columns: Sequence[str] | None = None,
    refresh: bool = False,
    pre_hooks: Sequence[str] | str | None = None,
    post_hooks: Sequence[str] | str | None = None,
    checks: Mapping[str, Counted] | None = None,
    names: Names = NAMES,
) -> DataFrame | None:
    """Store a model by its strategy; ``refresh`` rebuilds it whatever the strategy is.

    ``checks`` that count rows are made as the rows are written; their results are returned.
    """
    if checks:
        watched = Watched(df, checks)
        write_incremental(
            watched.model,
            table,
            strategy,
            unique_key=unique_key,
            update_columns=update_columns,
            exclude_columns=exclude_columns,
            refresh=refresh,
            pre_hooks=pre_hooks,
            post_hooks=post_hooks,
            names=names,
        )
        return watched.results()
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}, expected one of {STRATEGIES}")
    spark = df.sparkSession
    run_hooks(spark, pre_hooks)
    if refresh or strategy == "full_refresh":
        full_refresh(df, table)
    elif strategy == "append":
        append(df, table)
    elif strategy == "overwrite_existing_partitions":
        overwrite_partitions(df, table)
    elif strategy == "merge":
        if not unique_key:
            raise ValueError("merge needs a unique_key")
        merge(df, table, unique_key, update_columns, exclude_columns)
    else:
        keys = [unique_key] if isinstance(unique_key, str) else unique_key
        delete_insert(df, table, keys, names)
    run_hooks(spark, post_hooks)
    return None


def compact_partitions(
    spark: SparkSession,
    table: Table,
    dates=None,
    *,
    file_bytes: int = 100 * 1024 * 1024,
    codec: str = "zstd",
    names: Names = NAMES,
) -> None:
    """Rewrite the files of the given dates (or their months) into fewer, larger ones.

    A table that is not partitioned by date is rewritten whole.
    """
    stored = table.read(spark)
    by = next((p for p in (names.daily, names.monthly) if p in table.partitions), None)
    if by is not None and dates is not None:
        days = parse_dates(dates)
        wanted = month_starts(days) if by == names.monthly else days
        stored = stored.where(in_dates(F.col(ident(by)), wanted, stored.schema[by].dataType))
    # The size of files is set in a session of its own, so other jobs keep theirs.
    own = spark.newSession()
    own.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(file_bytes))
    packed = replace(table, options={**table.options, "compression": codec}, rebalance=True)
    with Workspace(spark) as work:
        rows = work.materialize(stored, "compact")
        rows = own.read.schema(rows.schema).parquet(work.paths[-1])
        rebalanced = rows if table.partitions else rows.hint("rebalance")
        _write(rebalanced, packed, "overwrite", "dynamic" if table.partitions else "static")
