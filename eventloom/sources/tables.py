"""Key-bucketed tables, catalog checks and JDBC output."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from .. import schemas
from ..operators.merge import first_per_key
from ..session import durable

_BUCKET, _SOURCE, _APPLIED, _VERSION, _KNOWN = "bucket", "_source", "_applied", "_version", "_known"
_GONE = "(gone)"  # marks the version of a row that deletes it


def _nothing(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """No rows, as the planner knows: joins with them vanish instead of moving the other side."""
    return spark.range(1).filter(F.lit(False)).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


class KeyedTable:
    """A Parquet table with one row per key, one writer at a time.

    ``base`` holds rows in hash buckets of their key, ``log`` newer versions of some of them. An
    append looks for stored keys and adds files to the base; an upsert adds the new versions of the
    batch's keys to the log, so what it writes follows the batch, not the table. ``read`` takes the
    log's last version of a key before the base's row. ``compact`` moves the log into the base: run
    it between micro-batches, when the log has grown beyond what readers should join.

    Each row says which epoch of which writer it has seen last, so a replayed micro-batch leaves the
    keys alone that it has reached before, also if another query has written them since. A writer
    is a query: a new checkpoint is a new writer.

    Without ``keys`` the rows are keyed by the place of their message.
    """

    PLACE = ["partition", "offset"]

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], buckets: int = 16):
        self.spark, self.path, self.schema, self.buckets = spark, path.rstrip("/"), schema, buckets
        self.keys = list(keys) or [f"_{c}" for c in self.PLACE]
        kept = schema if keys else T.StructType([*schema.fields, *T.StructType.fromDDL("_partition int, _offset bigint").fields])
        self._rows = kept
        marks = T.StructType.fromDDL(f"{_APPLIED} map<string,bigint>, {_VERSION} bigint, {_KNOWN} boolean, {_SOURCE} string, {_BUCKET} int")
        self._stored_schema = T.StructType([*kept.fields, *marks.fields])

    def _files(self, layer: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(self._stored_schema).parquet(f"{self.path}/{layer}")
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            folder = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
            if folder.exists(path) and not folder.getFileStatus(path).isDirectory():
                raise
            return None

    def _empty(self) -> bool:
        return self._files("base") is None and self._files("log") is None

    def _latest(self, wanted: DataFrame | None = None, columns: list[str] | None = None) -> DataFrame:
        """The stored rows, those of ``wanted`` keys if given, with their marks; ``columns`` beside the keys, or all."""
        base, log = (self._narrow(self._files(layer), wanted) for layer in ("base", "log"))
        if base is None and log is None:
            return _nothing(self.spark, self._stored_schema)
        names = self._stored_schema.fieldNames() if columns is None else list(dict.fromkeys([*self.keys, *columns, _SOURCE, _VERSION]))
        if log is None:
            return base.select(*names)
        last = log.groupBy(*self.keys).agg(F.max_by(F.struct(*names), _VERSION).alias("_r")).select("_r.*")
        live = last.filter(~F.col(_SOURCE).eqNullSafe(F.lit(_GONE)))
        if base is None:
            return live
        older = log.groupBy(*self.keys).agg(F.max(_VERSION).alias("_last"))  # a key may be appended again after its deletion
        newer = self._same(base, older) & (base[_VERSION] <= older["_last"])
        return base.join(older, newer, "left_anti").select(*names).unionByName(live)

    def _same(self, a: DataFrame, b: DataFrame):
        condition = F.lit(True)
        for k in self.keys:
            condition = condition & a[k].eqNullSafe(b[k])
        return condition

    def _narrow(self, df: DataFrame | None, wanted: DataFrame | None) -> DataFrame | None:
        if df is None or wanted is None:
            return df
        return df.join(wanted, self._same(df, wanted) & (df[_BUCKET] == wanted[_BUCKET]), "left_semi")

    def read(self) -> DataFrame:
        return self._latest(columns=self.schema.fieldNames()).select(*self.schema.fieldNames())

    def _place(self, batch: DataFrame) -> DataFrame:
        if "_offset" in self.keys and "_offset" not in batch.columns:
            batch = batch.withColumns({f"_{c}": F.col(c) for c in self.PLACE})
        keys = [F.col(k).cast(self._rows[k].dataType) for k in self.keys]
        return batch.withColumn(_BUCKET, F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int"))

    def _wanted(self, placed: DataFrame) -> DataFrame:
        return placed.select(*[F.col(k).cast(self._rows[k].dataType).alias(k) for k in self.keys], _BUCKET)

    def held(self, batch: DataFrame) -> DataFrame:
        """Key and ``_source`` of the stored rows of the batch's keys."""
        return self._latest(self._wanted(self._place(batch)), []).select(*self.keys, _SOURCE)

    def _version(self) -> int:
        """Later than any version before: one writer at a time, by its clock."""
        return time.time_ns()

    def append_new(self, batch: DataFrame, order: list[str], source: str | None = None) -> None:
        """Append the first row of each key that is not stored yet; ``source`` names a column to keep beside it."""
        placed = self._place(batch)
        stored = self._latest(self._wanted(placed), []).select(*self.keys)
        none = {_APPLIED: F.lit(None).cast("map<string,bigint>"), _VERSION: F.lit(self._version()), _KNOWN: F.lit(False)}
        rows = placed.withColumns(none | {_SOURCE: F.col(source) if source else F.lit(None).cast("string")})
        fresh = first_per_key(rows.join(stored, self._same(rows, stored), "left_anti"), self.keys, order)
        typed = fresh.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self._stored_schema.fields])
        typed.hint("rebalance", _BUCKET).write.mode("append").partitionBy(_BUCKET).parquet(f"{self.path}/base")

    def upsert(
        self, batch: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame], epoch: int | None = None, writer: str = "", removes: bool = True
    ) -> None:
        """Replace the stored rows of the batch's keys by ``apply(these rows, batch)``.

        Keys that ``epoch`` of ``writer`` has reached before are left alone. Stored rows that
        ``apply`` leaves out are deleted; ``removes=False`` says that it leaves out none. Several joins
        read ``batch``: store it before if it is costly to compute.
        """
        placed, names = self._place(batch), self._rows.fieldNames()
        held = self._latest(self._wanted(placed))
        if not self._empty():
            held = durable(held)  # the batch's keys at most
        seen = F.coalesce(F.col(f"{_APPLIED}")[writer], F.lit(-1))
        if epoch is not None:
            done = held.filter(seen >= epoch).select(*self.keys)
            placed = placed.join(done, self._same(placed, done), "left_anti")
            held = held.filter(seen < epoch)
        merged = apply(held.select(*names), placed.drop(_BUCKET)).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self._rows.fields])
        marks = held.select(*[F.col(k).alias(f"_k_{k}") for k in self.keys], F.col(_APPLIED).alias("_before"), F.lit(True).alias("_was"))
        same = F.lit(True)
        for k in self.keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        both = merged.withColumn("_is", F.lit(True)).join(marks, same, "full" if removes else "left")
        before = F.coalesce("_before", F.create_map().cast("map<string,bigint>"))
        mine = F.create_map(F.lit(writer), F.lit(-1 if epoch is None else epoch).cast("bigint"))
        applied = F.map_concat(F.map_filter(before, lambda k, _: k != writer), mine) if epoch is not None else before
        stamped = both.withColumns(
            {k: F.coalesce(k, f"_k_{k}") for k in self.keys}
            | {_APPLIED: applied, _VERSION: F.lit(self._version()), _KNOWN: F.coalesce("_was", F.lit(False))}
            | {_SOURCE: F.when(F.col("_is").isNull(), F.lit(_GONE))}
        )
        rows = self._place(stamped).select(*self._stored_schema.fieldNames())
        rows.hint("rebalance").write.mode("append").parquet(f"{self.path}/log")

    def put(self, rows: DataFrame) -> None:
        """Store ``rows``, one of each key, in the place of the stored ones of their keys."""
        placed = self._place(rows)
        marks = self._latest(self._wanted(placed), [_APPLIED]).select(
            *[F.col(k).alias(f"_k_{k}") for k in self.keys], F.col(_APPLIED).alias("_before"), F.lit(True).alias("_was")
        )
        same = F.lit(True)
        for k in self.keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        self._log(placed.join(marks, same, "left").withColumns({_KNOWN: F.coalesce("_was", F.lit(False)), _SOURCE: F.lit(None).cast("string")}))

    def remove(self, keys: DataFrame) -> None:
        """Delete the stored rows of these keys."""
        held = self._latest(self._wanted(self._place(keys)), [_APPLIED]).withColumnRenamed(_APPLIED, "_before")
        others = [f for f in self._rows.fields if f.name not in self.keys]
        empty = {f.name: F.lit(None).cast(f.dataType) for f in others}
        self._log(self._place(held.withColumns(empty | {_KNOWN: F.lit(True), _SOURCE: F.lit(_GONE)})))

    def _log(self, rows: DataFrame) -> None:
        """Add versions of rows that keep the epochs ``_before`` to the log."""
        before = F.coalesce("_before", F.create_map().cast("map<string,bigint>"))
        marked = rows.withColumns({_APPLIED: before, _VERSION: F.lit(self._version())})
        typed = marked.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self._stored_schema.fields])
        typed.hint("rebalance").write.mode("append").parquet(f"{self.path}/log")

    def changes(self, epoch: int, writer: str = "") -> DataFrame:
        """The rows that ``epoch`` of ``writer`` wrote last, and ``_known``: whether their keys were stored before."""
        log = self._files("log")
        if log is None:
            return _nothing(self.spark, T.StructType([*self.schema.fields, T.StructField(_KNOWN, T.BooleanType())]))
        mine = log.filter((F.col(_APPLIED)[writer] == epoch) & ~F.col(_SOURCE).eqNullSafe(F.lit(_GONE)))
        last = mine.groupBy(*self.keys).agg(F.max_by(F.struct(*self._stored_schema.fieldNames()), _VERSION).alias("_r"))
        return last.select(*[f"_r.{n}" for n in self.schema.fieldNames()], f"_r.{_KNOWN}")

    def compact(self) -> None:
        """Move the log's rows into the base buckets they belong to.

        The base is written before the log is emptied; a compaction that broke off is run again.
        """
        log = self._files("log")
        if log is None:
            return
        read = log.inputFiles()
        touched = sorted(r[0] for r in log.select(_BUCKET).distinct().collect())  # at most the number of buckets
        if not touched:
            return
        rows = durable(self._latest().filter(F.col(_BUCKET).isin(touched)))
        present = {r[0] for r in rows.select(_BUCKET).distinct().collect()}
        rows.hint("rebalance", _BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_BUCKET).parquet(f"{self.path}/base")
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        paths = [hadoop.Path(p) for p in (*read, *(f"{self.path}/base/{_BUCKET}={b}" for b in touched if b not in present))]
        for path in paths:
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def write_fact(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Append fact rows, optionally partitioned by a date column so that later scans prune."""
    writer = df.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def write_jdbc(df: DataFrame, url: str, table: str, connections: int = 10, batch_rows: int = 500, **options) -> None:
    """Append rows to a database table over a bounded number of connections."""
    (
        df.coalesce(connections)
        .write.format("jdbc")
        .options(url=url, dbtable=table, batchsize=str(batch_rows), **options)
        .mode("append")
        .save()
    )


def existing_tables(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t.name,) for t in spark.catalog.listTables()], "table_name string")


def table_preflight(required: DataFrame, existing: DataFrame) -> DataFrame:
    """Required table names that do not exist, compared without case."""
    found = existing.select(F.lower("table_name").alias("_found")).distinct()
    return required.join(found, F.lower(required["table_name"]) == found["_found"], "left_anti")


def check_tables(spark: SparkSession, required=schemas.REQUIRED_TABLES, warn_only: bool = False) -> list[str]:
    """Names of missing tables; raises unless ``warn_only``."""
    wanted = spark.createDataFrame([(t,) for t in required], "table_name string")
    missing = sorted(r["table_name"] for r in table_preflight(wanted, existing_tables(spark)).collect())
    if missing and not warn_only:
        raise RuntimeError(f"required tables are missing: [{', '.join(missing)}]")
    return missing


def reconcile_except(required: DataFrame, existing: DataFrame) -> DataFrame:
    """Distinct required rows that do not exist."""
    return required.subtract(existing)


def schema_introspect(tables: dict[str, DataFrame | T.StructType]) -> list[tuple]:
    """(table, position, column, type, is_pk, is_nullable, is_auto_inc) of each table's columns."""
    rows = []
    for name, source in tables.items():
        schema = source if isinstance(source, T.StructType) else source.schema
        for i, f in enumerate(schema.fields):
            meta = f.metadata or {}
            rows.append(
                (name.lower(), i, f.name, f.dataType.simpleString(), bool(meta.get("pk")), f.nullable, bool(meta.get("auto_inc")))
            )
    return rows


INTROSPECTED = "table_name string, position int, column_name string, data_type string, is_pk boolean, is_nullable boolean, is_auto_inc boolean"


def catalog_schema(spark: SparkSession, names: list[str]) -> DataFrame:
    """Column metadata of catalog tables; names that are not found are left out."""
    found = {n: spark.table(n) for n in names if spark.catalog.tableExists(n)}
    return spark.createDataFrame(schema_introspect(found), INTROSPECTED)
