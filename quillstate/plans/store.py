"""Versioned keyed state on a shared file system.

    root/<storage>/v=<version>-<tag>/variable_id=<id>/shard=<s>/*.parquet   rows one commit wrote
    root/<storage>/_manifests/<version>   of every variable and shard, the folders that hold its rows

A commit writes the rows it changed, and nothing else: of each shard the manifest lists a base
folder and the folders of later changes. A read takes the newest row of a key among the
changes, which are few, and the base rows of all other keys. A shard whose changes have grown
to a share of its base, or to many folders, is written anew by the commit that finds it so.

A commit becomes visible when its manifest is renamed to the next version, which fails if
that version is there: of two writers that started from one version the second is refused,
and nothing it wrote is seen. Folders have names of their own, so a failed, lost or refused
writer leaves no trace. A frame made by ``read`` stays with the version it was made at;
manifests and folders outside the last ``retain`` versions are deleted once they are older
than ``grace_seconds``, which must be longer than a reader takes.

Batches are counted per stream and apart from versions: a batch is committed at most once,
whatever else was written before or between.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from math import gcd

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstate.operators.lookup import check_keys, pull
from quillstate.operators.optimizers import fresh_slots, optimizer, slot_schema
from quillstate.operators.sharding import by_shard, local_of, row_numbers, shard_of
from quillstate.operators.training import apply_gradients
from quillstate.session import cut
from quillstate.types import StateError, Variable

#: Pulls may run ahead of the committed batches by less than this many.
MAX_AHEAD = 1024
#: Folders of changes a shard may have before it is compacted.
MAX_CHANGES = 16


class Files:
    """The few file-system calls the store needs, on any Hadoop path. ``null://`` takes writes and holds nothing."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self.root = spark._jvm, root.rstrip("/")
        self.null = root.startswith("null:")
        self.fs = None if self.null else self._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, *parts: object):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *map(str, parts)]))

    def exists(self, *parts: object) -> bool:
        return not self.null and self.fs.exists(self.path(*parts))

    def names(self, *parts: object) -> list[str]:
        p = self.path(*parts)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.exists(*parts) else []

    def age(self, *parts: object) -> float:
        """Seconds since a file or folder was last changed."""
        return time.time() - self.fs.getFileStatus(self.path(*parts)).getModificationTime() / 1000

    def ages(self, *parts: object) -> dict[str, float]:
        """Name and age of everything in a folder, by one listing."""
        if not self.exists(*parts):
            return {}
        return {s.getPath().getName(): time.time() - s.getModificationTime() / 1000 for s in self.fs.listStatus(self.path(*parts))}

    def delete(self, *parts: object) -> None:
        if not self.null:
            self.fs.delete(self.path(*parts), True)

    def read(self, *parts: object) -> str:
        stream = self.fs.open(self.path(*parts))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, text: str, *parts: object, replace: bool = True) -> bool:
        """A small file, written aside and renamed; without ``replace`` False if it was there already."""
        if self.null:
            return True
        target, aside = self.path(*parts), self.path(*parts[:-1], f"_{parts[-1]}.{uuid.uuid4().hex}")
        out = self.fs.create(aside, True)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()
        options = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.fs.getConf())
        how = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        rename = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        self._jvm.java.lang.reflect.Array.set(rename, 0, how.OVERWRITE if replace else how.NONE)
        try:
            options.rename(aside, target, rename)
        except Exception:
            self.fs.delete(aside, False)
            if not replace and self.fs.exists(target):
                return False
            raise
        return True

    def replicate(self, n: int, *parts: object) -> None:
        """Asks the file system to keep ``n`` copies of all files below a folder; some keep one whatever is asked."""
        files = self.fs.listFiles(self.path(*parts), True)
        while files.hasNext():
            self.fs.setReplication(files.next().getPath(), n)

    def create_exclusive(self, *parts: object) -> bool:
        """Creates an empty file; False if it was there already (a lock)."""
        try:
            self.fs.create(self.path(*parts), False).close()
            return True
        except Exception as e:  # the file system says that it exists
            if self.fs.exists(self.path(*parts)):
                return False
            raise e


class Store:
    """One storage: variables sharing a shard layout and their versions."""

    def __init__(self, spark: SparkSession, root: str, storage: str, shard_num: int = 8, retain: int = 2, grace_seconds: float = 86_400, compact_share: float = 0.5):
        self.spark, self.storage, self.shard_num, self.retain = spark, storage, shard_num, retain
        self.grace_seconds, self.compact_share = grace_seconds, compact_share
        self.files = Files(spark, root)
        self.variables: dict[int, Variable] = {}

    # -- definition --------------------------------------------------------------------
    def create_variable(self, variable: Variable) -> None:
        if variable.variable_id in self.variables:
            self.variables[variable.variable_id].meta.check_same(variable.meta)
            return
        self.variables[variable.variable_id] = variable

    def configure(self, variable_id: int, *, initializer: dict | None = None, optimizer_config: dict | None = None) -> None:
        """New initializer or optimizer; another optimizer category resets the slots, weights stay.

        The reset writes no rows: slots of the folders there are are not read any more.
        """
        v = self.variables[variable_id]
        if initializer:
            v.initializer = initializer
        if optimizer_config:
            changed = optimizer_config.get("category") != v.optimizer.get("category")
            v.optimizer = optimizer_config
            m = self._manifest()
            if changed and str(variable_id) in m["variables"]:
                state = m["variables"][str(variable_id)]
                state["optimizer"] = optimizer_config
                state["plain"] = sorted({f for held in state["shards"].values() for f, _ in held})
                self._commit(m, [])

    # -- versions ------------------------------------------------------------------------
    @property
    def version(self) -> int | None:
        made = [int(n) for n in self.files.names(self.storage, "_manifests") if n.isdigit()]
        return max(made, default=None)

    def _manifest(self, version: int | None = None) -> dict:
        version = self.version if version is None else version
        if version is None:
            return {"version": 0, "batches": {}, "variables": {}}
        if not self.files.exists(self.storage, "_manifests", version):
            raise StateError(f"storage {self.storage} has no version {version} any more")
        return json.loads(self.files.read(self.storage, "_manifests", version))

    def last_batch(self, stream: str = "steps") -> int:
        """The last committed batch of a stream; -1 before the first."""
        return self._manifest()["batches"].get(stream, -1)

    def wait_for(self, batch_id: int, stream: str = "steps", seconds: float = 0.0, every: float = 0.2) -> None:
        """Returns when all batches before ``batch_id`` are committed; raises if that takes longer than ``seconds``."""
        until = time.time() + seconds
        while self.last_batch(stream) < batch_id - 1:
            if time.time() >= until:
                raise StateError(f"batch {batch_id} waits for batch {self.last_batch(stream) + 1}")
            time.sleep(every)

    def _schema(self, variable_id: int, config: dict) -> str:
        kind = "float" if self.variables[variable_id].meta.datatype.lower() in ("float32", "float") else "double"
        return f"key bigint, weights array<{kind}>, slots {slot_schema(optimizer(config))}"

    def _dir(self, folder: str, variable_id: int) -> str:
        return f"{self.files.root}/{self.storage}/{folder}/variable_id={variable_id}"

    def read(self, variable_id: int, version: int | None = None, shards: list[int] | None = None) -> DataFrame:
        """A variable's rows at a version (the committed one); a late batch also reads the committed version."""
        return self._rows(variable_id, self._manifest(version)["variables"].get(str(variable_id)), shards)

    def _rows(self, variable_id: int, state: dict | None, shards: list[int] | None = None) -> DataFrame:
        v = self.variables[variable_id]
        config = state["optimizer"] if state and "optimizer" in state else v.optimizer
        schema, names = self._schema(variable_id, config), ("key", "weights", "slots")
        base: dict[bool, list[str]] = {}
        changes: dict[str, list[str]] = {}
        plain = set(state["plain"]) if state else set()
        for s, held in (state["shards"] if state else {}).items():
            if shards is None or int(s) in shards:
                for i, (folder, _) in enumerate(held):
                    path = f"{self._dir(folder, variable_id)}/shard={s}"
                    (base.setdefault(folder in plain, []) if i == 0 else changes.setdefault(folder, [])).append(path)

        def scan(paths: list[str], bare: bool) -> DataFrame:
            if not bare:
                return self.spark.read.schema(schema).parquet(*paths)
            rows = self.spark.read.schema(schema).parquet(*paths).select("key", "weights")
            return rows.withColumn("slots", fresh_slots(optimizer(config), v.meta.embedding_dim))

        out = None
        for bare, paths in base.items():
            out = scan(paths, bare) if out is None else out.unionByName(scan(paths, bare))
        if out is None:
            return self.spark.createDataFrame([], schema)
        if not changes:
            return out
        parts = [scan(paths, folder in plain).withColumn("__v", F.lit(version_of(folder))) for folder, paths in changes.items()]
        late = parts[0]
        for p in parts[1:]:
            late = late.unionByName(p)
        newest = late.groupBy("key").agg(F.max_by(F.struct("weights", "slots"), "__v").alias("__n")).select("key", "__n.weights", "__n.slots")
        return out.join(newest.select("key"), "key", "left_anti").unionByName(newest).select(*names)

    def _write(self, folder: str, variable_id: int, rows: DataFrame) -> dict[str, int]:
        """Writes rows by shard; the rows of each shard that has any, counted from the files' footers."""
        sharded = by_shard(rows.withColumn("shard", shard_of(F.col("key"), self.shard_num)), self.shard_num)
        sharded.write.mode("overwrite").partitionBy("shard").parquet(self._dir(folder, variable_id))
        names = self.files.names(self.storage, folder, f"variable_id={variable_id}")
        if not any(n.startswith("shard=") for n in names):
            return {}
        return {str(r["shard"]): r["count"] for r in self.spark.read.schema("key bigint, shard int").parquet(self._dir(folder, variable_id)).groupBy("shard").count().collect()}

    def _commit(self, manifest: dict, folders: list[str]) -> None:
        """Makes ``manifest``, built from version ``manifest["version"]``, the next version."""
        version = manifest["version"] + 1
        made = manifest | {"version": version}
        if not self.files.write(json.dumps(made), self.storage, "_manifests", version, replace=False):
            for f in folders:
                self.files.delete(self.storage, f)
            raise StateError(f"another writer committed version {version} of {self.storage}")
        self._expire(version)

    def _expire(self, version: int) -> None:
        """Deletes what no kept version names; without a manifest to go, one listing is all it takes."""
        ages = self.files.ages(self.storage, "_manifests")
        old = [n for n, age in ages.items() if n.isdigit() and int(n) < version - self.retain and age >= self.grace_seconds]
        if not old:
            return
        for name in old:
            self.files.delete(self.storage, "_manifests", name)
        kept: set[str] = set()
        for name in ages.keys() - set(old):
            if name.isdigit():
                m = json.loads(self.files.read(self.storage, "_manifests", name))
                kept |= {f for state in m["variables"].values() for held in state["shards"].values() for f, _ in held}
        for name, age in self.files.ages(self.storage).items():
            # a folder of a writer that has not committed yet is younger than the grace
            if name.startswith("v=") and name not in kept and version_of(name) <= version and age >= self.grace_seconds:
                self.files.delete(self.storage, name)

    def _due(self, held: list, more: int) -> bool:
        """Whether a shard is to be written anew when ``more`` rows of it change."""
        changed = sum(n for _, n in held[1:]) + more
        return bool(held) and (len(held) >= MAX_CHANGES or should_persist(changed, held[0][1], 0, self.compact_share))

    def _put(self, manifest: dict, variable_id: int, rows: DataFrame, anew: set[str] = frozenset()) -> list[str]:
        """Writes changed rows, each key once, into ``manifest``; the folders written.

        Of shards in ``anew`` the rows are all there are.
        """
        version = manifest["version"] + 1
        folder = f"v={version}-{uuid.uuid4().hex[:8]}"
        v = self.variables[variable_id]
        state = manifest["variables"].setdefault(str(variable_id), {"shards": {}, "plain": []})
        state["optimizer"] = v.optimizer
        for s, n in self._write(folder, variable_id, rows).items():
            state["shards"][s] = [*([] if s in anew else state["shards"].get(s, [])), [folder, n]]
        used = {f for held in state["shards"].values() for f, _ in held}
        state["plain"] = [f for f in state["plain"] if f in used]
        due = {s: held for s, held in state["shards"].items() if len(held) > 1 and (len(held) > MAX_CHANGES or should_persist(sum(n for _, n in held[1:]), held[0][1], 0, self.compact_share))}
        if not due:
            return [folder]
        whole = f"v={version}-{uuid.uuid4().hex[:8]}"
        counts = self._write(whole, variable_id, self._rows(variable_id, state, [int(s) for s in due]))
        for s in due:
            state["shards"][s] = [[whole, counts[s]]]
        return [folder, whole]

    def clear(self, variable_id: int) -> None:
        """No rows, same configuration."""
        m = self._manifest()
        m["variables"].pop(str(variable_id), None)
        self._commit(m, [])

    def upsert(self, variable_id: int, rows: DataFrame) -> None:
        """Bulk rows ``key, weights[, slots]``; without slots they start fresh.

        Of rows with one key the one with the greatest weights (then slots) stays. Keys out of range are refused.
        """
        v = self.variables[variable_id]
        if "slots" not in rows.columns:
            rows = rows.withColumn("slots", fresh_slots(optimizer(v.optimizer), v.meta.embedding_dim))
        m = self._manifest()
        schema = self.spark.createDataFrame([], self._schema(variable_id, v.optimizer)).schema
        rows = check_keys(rows.select(*[F.col(f.name).cast(f.dataType) for f in schema]), "key", v.meta)
        one = rows.groupBy("key").agg(F.max(F.struct("weights", "slots")).alias("__n")).select("key", "__n.weights", "__n.slots")
        self._commit(m, self._put(m, variable_id, one))

    def check_ahead(self, batch_id: int, stream: str = "steps") -> None:
        following = self.last_batch(stream) + 1
        if batch_id - following - 1 >= MAX_AHEAD:
            raise StateError(f"request too large version: {batch_id}, current {following}")

    def store(self, batch_id: int, reduced: dict[int, DataFrame], pulled: dict[int, DataFrame] | None = None, stream: str = "steps") -> bool:
        """One update step of all variables; False if this batch of the stream was committed before.

        Gradients and pulled keys out of a variable's range fail the step; nothing of it is seen.
        """
        m = self._manifest()
        if batch_id <= m["batches"].get(stream, -1):
            return False
        self.check_ahead(batch_id, stream)
        m["batches"][stream] = batch_id
        before = json.loads(json.dumps(m["variables"]))
        folders: list[str] = []
        for i, v in self.variables.items():
            grads, keys = reduced.get(i), (pulled or {}).get(i)
            if grads is None and keys is None:
                continue
            if grads is None:
                grads = self.spark.createDataFrame([], "key bigint, grad array<double>, cnt bigint")
            # both are needed twice: for the shards they touch, and for the update
            grads = cut(check_keys(grads, "key", v.meta))
            keys = cut(check_keys(keys.select("key").where("key is not null"), "key", v.meta).distinct()) if keys is not None else None
            touched = grads.select("key") if keys is None else grads.select("key").unionByName(keys)
            counts = touched.groupBy(shard_of(F.col("key"), self.shard_num).alias("s")).count().collect()  # one row per shard
            held = before.get(str(i), {"shards": {}})["shards"]
            # shards of which many rows change are written anew at once, not as changes first
            anew = {str(r["s"]) for r in counts if self._due(held.get(str(r["s"]), []), r["count"])}
            state = self._rows(i, before.get(str(i)), [r["s"] for r in counts])
            whole = shard_of(F.col("key"), self.shard_num).isin([int(s) for s in anew]) if anew else None
            folders += self._put(m, i, apply_gradients(state, grads, v.optimizer, v.initializer, v.meta.embedding_dim, keys, touched_only=True, also=whole), anew)
        self._commit(m, folders)
        return True

    def drop(self) -> None:
        self.files.delete(self.storage)


def version_of(folder: str) -> int:
    return int(folder.removeprefix("v=").split("-")[0])


def upsert(state: DataFrame, rows: DataFrame) -> DataFrame:
    """``state`` with ``rows`` put in; of rows with one key the one with the greatest other columns stays."""
    rest = [c for c in state.columns if c != "key"]
    new = rows.select(*[F.col(c).cast(state.schema[c].dataType) for c in state.columns]).groupBy("key").agg(F.max(F.struct(*rest)).alias("__n")).select("key", "__n.*")
    return state.join(new.select("key"), "key", "left_anti").unionByName(new)


# ---- dump, load, reshard ---------------------------------------------------------------------


def dump(state: DataFrame, path: str, variable_id: int | None, shard_num: int, include_optimizer: bool = True) -> None:
    """Rows by shard with their local index, as ``variable_id=<id>/shard=<s>``; a ``null://`` path computes and keeps nothing.

    With None the rows carry their ``variable_id``: all variables of one shape in one write.
    """
    rows = state if include_optimizer else state.drop("slots")
    key = F.col("key")
    out = rows.withColumn("shard", shard_of(key, shard_num)).withColumn("local", local_of(key, shard_num)).withColumn("shard_num", F.lit(shard_num)).drop("key")
    out = out.repartition("variable_id", "shard") if variable_id is None else by_shard(out.withColumn("variable_id", F.lit(variable_id)), shard_num)
    if path.startswith("null:"):
        out.write.format("noop").mode("overwrite").save()
        return
    out.write.mode("overwrite").partitionBy("variable_id", "shard").parquet(path)


def load(spark: SparkSession, path: str, variable_id: int | None, shards: list[int] | None = None) -> DataFrame:
    """A dumped variable with global keys, whatever the number of shards it was dumped with; with None all, with their ``variable_id``."""
    rows = spark.read.parquet(path)
    if variable_id is not None:
        rows = rows.where(F.col("variable_id") == variable_id).drop("variable_id")
    if shards is not None:
        rows = rows.where(F.col("shard").isin(shards))  # prunes folders
    n = F.col("shard_num").cast("bigint")
    keyed = rows.withColumn("key", F.col("local") * n + F.col("shard").cast("bigint"))
    return keyed.drop("local", "shard_num", "shard")


def reshard(state: DataFrame, shard_num: int) -> DataFrame:
    """``state`` with one partition per shard of a new shard count."""
    return by_shard(state.withColumn("shard", shard_of(F.col("key"), shard_num)), shard_num)


def restore_local(spark: SparkSession, path: str, variable_id: int | None, shard_num: int, local: list[int]) -> DataFrame:
    """What a replaced server reads back: keys of its shards, without optimizer slots.

    A dump of the same shard count is read in those folders only; of another, shard ``s`` of ``n``
    holds keys of shard ``l`` of ``shard_num`` only where both leave the same rest by their
    greatest common divisor, and only such folders are read.
    """
    dumped = spark.read.parquet(path)
    if variable_id is not None:
        dumped = dumped.where(F.col("variable_id") == variable_id)
    one = dumped.select("shard_num").first()  # one dump has one shard count
    if one is None:
        return load(spark, path, variable_id).drop("slots")
    n, g = one[0], gcd(one[0], shard_num)
    rows = load(spark, path, variable_id, [s for s in range(n) if any(s % g == x % g for x in local)])
    return rows.where(shard_of(F.col("key"), shard_num).isin(local)).drop("slots")


def export_dense(state: DataFrame, vocabulary_size: int, init: dict, dim: int) -> DataFrame:
    """A row for every key of a bounded vocabulary, defaults where none is stored; an unbounded one is refused."""
    if not 0 <= vocabulary_size < 1 << 63:
        raise StateError("only a bounded vocabulary has a dense form")
    every = state.sparkSession.range(vocabulary_size).withColumnRenamed("id", "key")
    return pull(every, state, init=init, dim=dim).select("key", "weights")


def numbered_blocks(state: DataFrame, block_rows: int) -> DataFrame:
    """``state`` with the number of its ``block``: rows in order of key, ``block_rows`` to a block."""
    return row_numbers(state, ["key"], "__rn").withColumn("block", F.floor(F.col("__rn") / block_rows).cast("bigint")).drop("__rn")


def read_blocks(state: DataFrame, block_rows: int, after: int | None = None) -> Iterator[pa.Table]:
    """Blocks of at most ``block_rows`` rows in order of key, one in memory at a time.

    ``after`` is a cursor: the last key of a block read before; reading goes on behind it.
    """
    rows = state if after is None else state.where(F.col("key") > after)
    names = rows.columns
    held: list[tuple] = []
    for r in rows.repartitionByRange("key").sortWithinPartitions("key").toLocalIterator():
        held.append(tuple(r))
        if len(held) == block_rows:
            yield pa.table({c: [x[i] for x in held] for i, c in enumerate(names)})
            held = []
    if held:
        yield pa.table({c: [x[i] for x in held] for i, c in enumerate(names)})


# ---- incremental checkpoints -------------------------------------------------------------------


def snapshot(deltas: DataFrame, keys: list[str], checkpoint: int | None, work_id: str = "work_id") -> DataFrame:
    """The newest row per key with ``work_id < checkpoint`` from append-only deltas; -1 was never saved.

    The aggregate keeps one row per key map-side; of rows with equal ``work_id`` the one with the
    greatest other columns, in their order, is kept.
    """
    rest = [c for c in deltas.columns if c not in keys]
    visible = deltas.where(F.col(work_id) != -1)
    if checkpoint is not None:
        visible = visible.where(F.col(work_id) < checkpoint)
    best = visible.groupBy(*keys).agg(F.max(F.struct(F.col(work_id).alias("__w"), F.struct(*rest).alias("s"))).alias("__s"))
    return best.select(*keys, "__s.s.*")


def compact(deltas: DataFrame, keys: list[str], oldest: int) -> DataFrame:
    """Deltas reduced to what checkpoints from ``oldest`` on need: one row per key before it, all after."""
    old = snapshot(deltas, keys, oldest)
    return old.unionByName(deltas.where(F.col("work_id") >= oldest))


def should_persist(delta_rows: int, state_rows: int, pending: int, share: float = 0.5) -> bool:
    """Whether a new checkpoint pays: enough changed rows and none being written."""
    return pending == 0 and delta_rows > 0 and delta_rows >= share * max(1, state_rows)
