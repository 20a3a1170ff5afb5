"""Sources and sinks: cells as Parquet, whole models, change logs, Arrow, CSV.

Paths go through Spark, so they may be in any store that Spark opens.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping
from contextlib import contextmanager
from datetime import UTC, datetime
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ast import from_json, to_json
from ..plans.catalog import Dim, Metric, Prop
from ..plans.model import Model


def write_cells(model: Model, name: str, path: str, partition: str | None = None) -> None:
    """A metric's cells as zstd Parquet: a column of keys for each dimension, `v`; optionally partitioned by a dimension."""
    out = model.cube(name).write.mode("overwrite").option("compression", "zstd")
    (out.partitionBy(partition) if partition else out).parquet(path)


def read_cells(model: Model, name: str, dims: Iterable[str], path: str, kind: str = "number") -> Metric:
    """An input from Parquet; columns are picked by name, others are ignored.  ValueError if a key is no member."""
    dims = list(dims)
    df = model.spark.read.parquet(path)
    for d in dims:
        dim = model.dim_named(d)
        lost = df.select(F.col(d).cast(dim.key_type).alias("key")).join(dim.frame(model.spark).select("key"), "key", "left_anti")
        if not lost.isEmpty():
            raise ValueError(f"{name}: a key of {d} is no member")
    return model.add_input(name, dims, df.select(*dims, "v"), kind)


def read_csv(model: Model, name: str, dims: Iterable[str], path: str, value: str = "v", kind: str = "number") -> Metric:
    """An input from CSV with a header; dimensions hold member names."""
    dims = list(dims)
    df = model.spark.read.csv(path, header=True)
    for d in dims:
        names = model.dim_named(d).frame(model.spark).select(F.col("key").alias("_key"), F.col("name").alias(d))
        df = df.join(names, d).drop(d).withColumnRenamed("_key", d)
    return model.add_input(name, dims, df.select(*dims, F.col(value).cast(model.v_type(model._kind(kind))).alias("v")), kind)


def to_arrow(model: Model, name: str) -> pa.Table:
    """A metric with member names as dictionaries."""
    m = model.metric_named(name)
    df = model.with_names(model.cube(name).toDF(*m.dims, "v"), m.dims)
    table = df.select(*(F.col(f"{u}_name").alias(model.dims[u].name) for u in m.dims), F.col("v").alias("value")).toArrow()
    for i, u in enumerate(m.dims):
        table = table.set_column(i, model.dims[u].name, table.column(i).dictionary_encode())
    return table


def arrow_stream(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


# ---------------------------------------------------------------- models


def save(model: Model, path: str) -> None:
    """The structure as one JSON row, inputs, properties and table dimensions as Parquet; formula values aren't saved."""
    spark, path = model.spark, path.rstrip("/")
    data = {
        "exact": model.exact, "max_cells": model.max_cells, "version": model.version, "next": model._next, "outcomes": model.outcomes,
        "dims": [{"uid": d.uid, "name": d.name, "ordered": d.ordered, "members": d.members, "props": list(d.props)} for d in model.dims.values()],
        "props": [{"uid": p.uid, "name": p.name, "target": p.target} for p in model.props.values()],
        "metrics": [{"uid": m.uid, "name": m.name, "dims": m.dims, "kind": m.kind, "formula": None if m.formula is None else to_json(m.formula), "overrides": m.overrides} for m in model.metrics.values()],
    }
    for m in model.metrics.values():
        if m.formula is None:
            model.input(m.uid).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/cells/{m.uid}")
    for p in model.props.values():
        p.table.write.mode("overwrite").parquet(f"{path}/props/{p.uid}")
    for d in model.dims.values():
        if d.table is not None:
            d.table.write.mode("overwrite").parquet(f"{path}/dims/{d.uid}")
    spark.createDataFrame([(json.dumps(data),)], "data string").coalesce(1).write.mode("overwrite").json(f"{path}/model")


def load(spark: SparkSession, path: str) -> Model:
    path = path.rstrip("/")
    data = json.loads(spark.read.schema("data string").json(f"{path}/model").head()["data"])
    out = Model(spark, data["exact"], data["max_cells"])
    out.version, out._next, out.outcomes = data["version"], data["next"], data["outcomes"]
    for p in data["props"]:
        out.props[p["uid"]] = Prop(p["uid"], p["name"], p["target"], spark.read.parquet(f"{path}/props/{p['uid']}"))
    for d in data["dims"]:
        members = None if d["members"] is None else [tuple(x) for x in d["members"]]
        table = spark.read.parquet(f"{path}/dims/{d['uid']}") if members is None else None
        out.dims[d["uid"]] = Dim(d["uid"], d["name"], d["ordered"], members, table, {u: out.props[u] for u in d["props"]})
    for m in data["metrics"]:
        base = spark.read.parquet(f"{path}/cells/{m['uid']}") if m["formula"] is None else None
        out.metrics[m["uid"]] = Metric(m["uid"], m["name"], tuple(m["dims"]), m["kind"], base, {}, None if m["formula"] is None else from_json(m["formula"]), m["overrides"])
    return out


# ---------------------------------------------------------------- change log

RECORD = "version long, at timestamp, user string, reason string, client_op_id string, ops string"


class ChangeLog:
    """An append-only folder of JSON records, one for each committed transaction.

    Tables that a record holds (of dimensions, properties, inputs, large writes) are Parquet folders in `_data`, whole models
    in `_snapshots`; both belong to the log, so a replay needs nothing else.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._group: list[tuple] | None = None

    def append(self, version: int, ops: list[Mapping[str, Any]], user: str | None = None, reason: str | None = None, client_op_id: str | None = None) -> None:
        row = (version, datetime.now(UTC), user, reason, client_op_id, json.dumps([{k: self._stored(v) for k, v in op.items()} for op in ops]))
        if self._group is not None:
            self._group.append(row)
        else:
            self._write([row])

    def _stored(self, value: Any) -> Any:
        if not isinstance(value, DataFrame):
            return value
        path = f"{self.path}/_data/{uuid.uuid4().hex}"
        value.write.option("compression", "zstd").parquet(path)
        return {"parquet": path}

    def _write(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, RECORD).coalesce(1).write.mode("append").json(self.path)

    @contextmanager
    def grouped(self):
        """Records of the transactions inside are written together at the end, as far as they were committed."""
        self._group = []
        try:
            yield self
        finally:
            rows, self._group = self._group, None
            if rows:
                self._write(rows)

    def records(self) -> DataFrame:
        return self.spark.read.schema(RECORD).json(self.path)

    def replay(self, model: Model, upto: int | None = None) -> Model:
        """Applies the records after the model's version, in order, up to the first that is missing."""
        todo = self.records().where(F.col("version") > model.version)
        if upto is not None:
            todo = todo.where(F.col("version") <= upto)
        for r in todo.orderBy("version").toLocalIterator():
            if r["version"] > model.version + 1:
                break
            follow(model, r["version"], r["ops"], r["client_op_id"])
        return model

    def snapshot(self, model: Model) -> None:
        """The whole model as of its version, from which restore() goes on."""
        save(model, f"{self.path}/_snapshots/{model.version:012d}")

    def restore(self, start: Model | None = None, upto: int | None = None) -> Model:
        """The model of a version (the last): its latest snapshot before, or start, and the records since."""
        top = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_snapshots")
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = sorted(int(x.getPath().getName()) for x in fs.listStatus(top)) if fs.exists(top) else []
        found = [v for v in found if upto is None or v <= upto]
        model = load(self.spark, f"{self.path}/_snapshots/{found[-1]:012d}") if found else (start or Model(self.spark)).fork()
        return self.replay(model, upto)

    def history(self, metric: str, key: Iterable[str], model: Model | None = None) -> DataFrame:
        """Who changed a cell, when, and how: version, at, user, old, new (as text).  With a model also large writes and
        spreads, whose tables hold keys; each such record is one more small read."""
        key = list(key)
        op = F.explode(F.from_json("ops", "array<struct<op:string,name:string,key:array<string>,value:string,old:string,table:struct<parquet:string>>>"))
        rows = self.records().select("version", "at", "user", op.alias("o")).where(F.col("o.name") == metric)
        out = rows.where((F.col("o.op") == "set_cell") & (F.col("o.key") == F.array(*map(F.lit, key)))).select("version", "at", "user", F.col("o.old").alias("old"), F.col("o.value").alias("new"))
        if model is None:
            return out
        m = model._target(metric)
        here = dict(zip((model.dims[u].name for u in m.dims), model._keys(m.dims, tuple(key)), strict=True))
        for r in rows.where(F.col("o.op").isin("write_table", "spread")).select("version", "at", "user", "o.table.parquet").collect():
            cells = self.spark.read.parquet(r["parquet"])
            for d, k in here.items():
                cells = cells.where(F.col(f"`{d}`") == k)
            out = out.union(cells.select(F.lit(r["version"]).cast("long"), F.lit(r["at"]), F.lit(r["user"]), F.col("_old").cast("string"), F.col("v").cast("string")))
        return out


def follow(model: Model, version: int, ops: str, client_op_id: str | None = None) -> None:
    """Applies one record to a follower; records that it has are skipped."""
    if version <= model.version:
        return
    model.apply(json.loads(ops))
    model.version = version
    if client_op_id:
        model.outcomes[client_op_id] = version
