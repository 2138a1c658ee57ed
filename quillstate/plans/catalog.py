"""Model catalog: signs, statuses, serving snapshots, and the requests a controller answers."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from quillstate.operators.lookup import pull
from quillstate.plans.store import Files, Store, dump, load
from quillstate.types import StateError, Variable, VariableMeta, model_meta_json, parse_model_meta

CREATING, NORMAL, DELETING = "CREATING", "NORMAL", "DELETING"


def save_model(stores: list[Store], uri: str, version: int = 0, include_optimizer: bool = True, model_uuid: str | None = None) -> str:
    """Meta file and dumped variables under ``uri``; returns the model sign ``uuid-version``."""
    files = Files(stores[0].spark, uri)
    sign = f"{model_uuid or uuid.uuid4().hex}-{version}"
    variables = []
    for store in stores:
        for v in store.variables.values():
            dump(store.read(v.variable_id), f"{uri}/{store.storage}", v.variable_id, store.shard_num, include_optimizer)
            v.storage_name = store.storage
            variables.append(v)
    files.write(model_meta_json(sign, variables), "model_meta")
    return sign


def load_model(stores: list[Store], uri: str) -> str:
    """Saved rows into the stores; variable lists must match exactly, old rows are cleared."""
    sign, saved = parse_model_meta(Files(stores[0].spark, uri).read("model_meta"))
    have = [(s, v) for s in stores for v in s.variables.values()]
    if len(have) != len(saved):
        raise StateError(f"the model has {len(saved)} variables, the context {len(have)}")
    for (_, v), w in zip(have, saved):
        v.meta.check_same(w.meta)
    for (store, v), w in zip(have, saved):
        rows = load(store.spark, f"{uri}/{w.storage_name}", v.variable_id)
        store.clear(v.variable_id)
        store.upsert(v.variable_id, rows)
    return sign


def save_beside(stores: list[Store], path: str, file_style: bool = False, **kw) -> str:
    """Saves the sparse part beside a dense model: in its folder, or or in ``<path>.sparse`` for single files."""
    root = f"{path}.sparse" if file_style else f"{path}/sparse"
    Files(stores[0].spark, root).delete()
    return save_model(stores, root, **kw)


def load_beside(stores: list[Store], path: str) -> str:
    for root in (f"{path}/sparse", f"{path}.sparse", path):
        if Files(stores[0].spark, root).exists("model_meta"):
            return load_model(stores, root)
    raise StateError(f"no saved model at {path}")


class Catalog:
    """Serving models below a root folder, one JSON entry each."""

    def __init__(self, spark: SparkSession, root: str, stale_seconds: float = 3600):
        self.spark, self.files, self.stale_seconds = spark, Files(spark, root), stale_seconds

    # -- entries ----------------------------------------------------------------------
    def _entry(self, sign: str) -> dict | None:
        return json.loads(self.files.read("models", sign, "entry")) if self.files.exists("models", sign, "entry") else None

    def _put(self, entry: dict) -> None:
        self.files.write(json.dumps(entry), "models", entry["model_sign"], "entry")

    def create_model(self, model_uri: str, replica_num: int = 3, shard_num: int = -1) -> str:
        """Registers a saved model for reading. An interrupted creation is taken up again.

        A positive ``shard_num`` makes a copy with so many shards, kept ``replica_num`` times by file systems that
        replicate; otherwise the saved rows are read where they are. The lock of a creation is given back
        on every way out; one whose holder is gone is taken over after ``stale_seconds``.
        """
        sign, variables = parse_model_meta(Files(self.spark, model_uri).read("model_meta"))
        entry = self._entry(sign)
        if entry and entry["status"] == NORMAL:
            raise StateError(f"model {sign} exists")
        if entry and entry["status"] == DELETING:
            raise StateError(f"model {sign} is being deleted")
        if not self._lock(sign):
            raise StateError(f"model {sign} is being created")
        try:
            storages = {name: i for i, name in enumerate(dict.fromkeys(v.storage_name for v in variables))}
            entry = {
                "model_sign": sign, "model_uri": model_uri, "status": CREATING, "error": "", "replica_num": replica_num, "shard_num": shard_num, "storages": storages,
                "variables": [{"variable_id": v.variable_id, "name": v.name, "datatype": v.meta.datatype, "embedding_dim": v.meta.embedding_dim, "vocabulary_size": v.meta.vocabulary_size, "storage_name": v.storage_name, "initializer": v.initializer} for v in variables],
            }
            self._put(entry)
            try:
                for v in variables:  # a version that cannot be read must not become NORMAL
                    rows = load(self.spark, f"{model_uri}/{v.storage_name}", v.variable_id)
                    if shard_num > 0:
                        dump(rows, self._copy(entry, v.storage_name, v.variable_id), v.variable_id, shard_num)
                        self.files.replicate(max(1, replica_num), "models", sign, "rows")
                    else:
                        rows.limit(1).count()
            except Exception as e:
                self._put(entry | {"error": str(e)[:1000]})
                raise
            self._put(entry | {"status": NORMAL})
        finally:
            self.files.delete("models", sign, "lock")
        return sign

    def _lock(self, sign: str) -> bool:
        if self.files.create_exclusive("models", sign, "lock"):
            return True
        if self.files.age("models", sign, "lock") < self.stale_seconds:
            return False
        self.files.delete("models", sign, "lock")
        return self.files.create_exclusive("models", sign, "lock")

    def _copy(self, entry: dict, storage: str, variable_id: int) -> str:
        return f"{self.files.root}/models/{entry['model_sign']}/rows/{storage}/{variable_id}"

    def delete_model(self, sign: str) -> None:
        """Deletes a model, or what an interrupted creation left of it."""
        entry = self._entry(sign)
        if entry is None and not self.files.exists("models", sign):
            raise KeyError(sign)
        if self.files.exists("models", sign, "lock") and self.files.age("models", sign, "lock") < self.stale_seconds:
            raise StateError(f"model {sign} is being created")
        if entry is not None:
            self._put(entry | {"status": DELETING})
        self.files.delete("models", sign)

    def show_model(self, sign: str) -> dict:
        entry = self._entry(sign)
        if entry is None:
            raise KeyError(sign)
        return entry

    def models(self) -> DataFrame:
        rows = [self._entry(s) for s in self.files.names("models")]
        made = [(e["model_sign"], e["model_uri"], e["status"], e["error"], len(e["variables"])) for e in rows if e]
        return self.spark.createDataFrame(made, "model_sign string, model_uri string, status string, error string, n_variables int")

    # -- reading -------------------------------------------------------------------------
    def find_variable(self, sign: str, variable_id: int) -> tuple[Variable, DataFrame]:
        entry = self.show_model(sign)
        if entry["status"] != NORMAL:
            raise StateError(f"model {sign} is {entry['status']}")
        v = entry["variables"][variable_id]
        meta = VariableMeta(v["datatype"], v["embedding_dim"], v["vocabulary_size"])
        at = self._copy(entry, v["storage_name"], variable_id) if entry["shard_num"] > 0 else f"{entry['model_uri']}/{v['storage_name']}"
        return Variable(variable_id, v["name"], meta, v["storage_name"], v["initializer"]), load(self.spark, at, variable_id)

    def read_only_pull(self, sign: str, variable_id: int, keys: DataFrame, key: str = "key") -> DataFrame:
        v, state = self.find_variable(sign, variable_id)
        return pull(keys, state.select("key", "weights"), key, init=v.initializer, meta=v.meta)

    # -- requests ----------------------------------------------------------------------------
    def request(self, method: str, path: str, body: dict | None = None) -> tuple[int, object]:
        """Status code and answer of a controller request on ``/models[/sign]``."""
        parts = [p for p in path.split("/") if p]
        try:
            if parts[:1] != ["models"] or len(parts) > 2:
                return 404, {"error": "not found"}
            if method == "POST" and len(parts) == 1:
                for need in ("model_uri", "replica_num", "shard_num"):
                    if need not in (body or {}):
                        return 400, {"error": f"{need} is missing"}
                return 201, {"model_sign": self.create_model(body["model_uri"], body["replica_num"], body["shard_num"])}
            if method == "GET":
                return 200, self.show_model(parts[1]) if len(parts) == 2 else {r.model_sign: r.status for r in self.models().collect()}
            if method == "DELETE" and len(parts) == 2:
                self.delete_model(parts[1])
                return 202, {}
            return 404, {"error": "not found"}
        except KeyError:
            return 404, {"error": "no such model"}
        except StateError as e:
            return 403, {"error": str(e)}
