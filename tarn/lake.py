"""The lake: versioned tables in Parquet with a transactional metadata store, read and written through Spark."""

from __future__ import annotations

import contextlib
import json
import random
import re
import sqlite3
import threading
import time
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.errors import ConflictError, LakeError
from tarn.functions import fields
from tarn.operators.ddl import OPTIONS, Ddl
from tarn.operators.dml import Dml
from tarn.operators.maintenance import Maintenance
from tarn.operators.register import Register
from tarn.operators.scan import Plan, Scan
from tarn.operators.write import Write
from tarn.sources.files import FileSystem
from tarn.sources.store import Store, columns_at, now

RETRIES, WAIT_S, BACKOFF = 10, 0.1, 1.5
_INSERT = {"inserted_into_table", "inlined_insert"}
_DELETE = {"deleted_from_table", "inlined_delete"}
_COMPACT = {"merge_adjacent", "rewrite_delete"}
#: What a change of mine on a table conflicts with, if another commit did it to the table meanwhile.
_CONFLICTS = {
    "inserted_into_table": {"dropped_table", "altered_table"} | _DELETE,
    "inlined_insert": {"dropped_table", "altered_table"} | _DELETE,
    "deleted_from_table": {"dropped_table", "altered_table"} | _COMPACT | _INSERT,
    "inlined_delete": {"dropped_table", "altered_table", "inlined_delete", "flushed_inlined"} | _INSERT,
    "flushed_inlined": {"dropped_table", "inlined_delete", "flushed_inlined"},
    "merge_adjacent": {"dropped_table"} | _DELETE | _COMPACT,
    "rewrite_delete": {"dropped_table"} | _DELETE | _COMPACT,
    "altered_table": {"dropped_table", "altered_table"},
    "altered_view": {"dropped_view", "altered_view"},
    "dropped_table": {"dropped_table"},
    "dropped_view": {"dropped_view"},
    "dropped_macro": {"dropped_macro"},
    "dropped_schema": {"dropped_schema"},
}


class Lake(Scan, Write, Dml, Ddl, Maintenance, Register):
    """A lake in data_path (any store Spark reaches) with its metadata in a SQLite file on the driver.

    snapshot_version or snapshot_time pin it to a snapshot, read-only. Tables are named "table" or "schema.table".
    automatic_migration brings a store of an older format up to this one. busy_timeout_s: how long to wait for another writer.
    """

    def __init__(self, spark: SparkSession, metadata_path: str, data_path: str | None = None, read_only: bool = False, create_if_not_exists: bool = True, override_data_path: bool = False, snapshot_version: int | None = None, snapshot_time=None, data_inlining_row_limit: int | None = None, write_deletion_vectors: bool | None = None, automatic_migration: bool = False, busy_timeout_s: float = 30):
        self.spark, self.fs = spark, FileSystem(spark)
        self.read_only = read_only or snapshot_version is not None or snapshot_time is not None
        try:
            self.store = self._real = Store(metadata_path, data_path, create=create_if_not_exists and not read_only, migrate=automatic_migration, timeout_s=busy_timeout_s)
        except sqlite3.OperationalError as e:
            raise LakeError(f"no lake at {metadata_path}") from e
        stored = self.store.option("data_path")
        if stored is None and data_path is None:
            raise LakeError("a new lake needs a data_path")
        if data_path is not None and stored is not None and data_path.rstrip("/") != stored.rstrip("/") and not override_data_path:
            raise LakeError(f"the lake's data path is {stored}; use override_data_path to read it from {data_path}")
        self.data_path = (data_path or stored).rstrip("/")
        for name, value in (("data_inlining_row_limit", data_inlining_row_limit), ("write_deletion_vectors", write_deletion_vectors)):
            if value is not None and not self.read_only:
                self.store.option_set(name, str(value).lower() if isinstance(value, bool) else value)
        self._written: list[str] = []
        self._new_options: dict = {}
        self._message: tuple = (None, None, None)
        self._pending = None
        self._thread = threading.get_ident()
        self.last_plan = Plan()
        self.last_committed: int | None = None
        self._pin = None
        if snapshot_version is not None or snapshot_time is not None:
            self._pin = self._snapshot(snapshot_version, snapshot_time)

    def close(self) -> None:
        self._real.db.close()

    # --- snapshots and names ---

    def _now(self) -> int:
        return self._pin if getattr(self, "_pin", None) is not None else self.store.current()["snapshot_id"]

    @staticmethod
    def _time(value) -> datetime:
        t = value if isinstance(value, datetime) else datetime.fromisoformat(str(value))
        return t if t.tzinfo else t.replace(tzinfo=UTC)

    def _snapshot(self, version: int | None, timestamp) -> int:
        if version is not None and timestamp is not None:
            raise LakeError("give a version or a timestamp, not both")
        if version is not None:
            if self.store.one("SELECT 1 FROM snapshot WHERE snapshot_id = ?", version) is None:
                raise LakeError(f"No snapshot found at version {version}")
            return version
        if timestamp is not None:
            at = self._time(timestamp)
            if at > datetime.now(UTC):
                raise LakeError("the timestamp lies in the future")
            found = [r["snapshot_id"] for r in self.store.rows("SELECT * FROM snapshot ORDER BY snapshot_id") if self._time(r["snapshot_time"]) <= at]
            if not found:
                raise LakeError(f"No snapshot found at timestamp {timestamp}")
            return found[-1]
        return self._now()

    def _lower_snapshot(self, timestamp) -> int:
        """The oldest snapshot not before a time."""
        found = [r["snapshot_id"] for r in self.store.rows("SELECT * FROM snapshot ORDER BY snapshot_id") if self._time(r["snapshot_time"]) >= self._time(timestamp)]
        if not found:
            raise LakeError(f"No snapshot found after timestamp {timestamp}")
        return found[0]

    def _schema(self, name: str, snapshot: int):
        found = [r for r in self.store.alive("namespace", snapshot) if r["name"].lower() == name.lower()]
        if not found:
            raise LakeError(f'schema "{name}" does not exist')
        return found[0]

    def _names(self, name: str, snapshot: int):
        space, _, own = name.rpartition(".")
        return self._schema(space or "main", snapshot), own

    def _find(self, kind: str, space, own: str, snapshot: int):
        return next((r for r in self.store.alive(kind, snapshot, "schema_id = ?", space["schema_id"]) if r["name"].lower() == own.lower()), None)

    def _table(self, name: str, snapshot: int):
        space, own = self._names(name, snapshot)
        row = self._find("lake_table", space, own, snapshot)
        if row is None:
            raise LakeError(f'table "{name}" does not exist')
        return row

    def option(self, name: str, default=None, table=None):
        if name in self._new_options:  # of a table that is being made
            return self._new_options[name]
        return self.store.option(name, default, table["table_id"] if table is not None else None, table["schema_id"] if table is not None else None)

    # --- commits ---

    def set_commit_message(self, author: str | None = None, message: str | None = None, extra_info: str | None = None) -> None:
        """For the next commit."""
        self._message = (author, message, extra_info)

    @contextlib.contextmanager
    def _exclusive(self):
        if self.read_only:
            raise LakeError("the lake is read-only")
        with self._real.lock:
            self._real.db.execute("BEGIN IMMEDIATE")
            try:
                yield self._real
                self._real.db.execute("COMMIT")
            except BaseException:
                self._real.db.execute("ROLLBACK")
                raise

    @contextlib.contextmanager
    def transaction(self):
        """Several changes in one commit. Reads inside see them; an error rolls all back and deletes the files written."""
        if self._pending is not None:
            yield self  # part of the one that is open
            return
        base = self._now()
        self._pending, self.store = ([], [], base), self._real.copy()
        self.store.new_id = self._real.new_id
        # The changes so far make a snapshot of the copy that only this transaction sees.
        try:
            yield self
            ops, told, _ = self._pending
            self.store, self._pending = self._real, None
            if ops:
                self._apply(ops, told, base)
            self._written = []
        except BaseException:
            self.store, self._pending = self._real, None
            self._roll_back()
            raise

    def _roll_back(self) -> None:
        for path in self._written:
            with contextlib.suppress(Exception):
                self.fs.delete(path, True)
        self._written = []

    def _commit(self, ops: list, told: list[tuple]) -> None:
        """Commit operations (store, snapshot) as one snapshot, or add them to the open transaction."""
        if self.read_only:
            raise LakeError("the lake is read-only")
        if self._pending is not None:
            mine, changes, base = self._pending
            provisional = base + 1
            if not mine:
                self.store.run("INSERT INTO snapshot VALUES (?, ?, 0)", provisional, now())
            for op in ops:
                op(self.store, provisional)
            mine += ops
            changes += told
            return
        base = self._now()
        try:
            self._apply(ops, told, base)
            self._written = []
        except BaseException:
            self._roll_back()
            raise

    def _apply(self, ops: list, told: list[tuple], base: int) -> None:
        author, message, extra = self._message
        if message is None and str(self._real.option("require_commit_message", "false")).lower() == "true":
            raise LakeError("a commit message is required")
        for attempt in range(RETRIES + 1):
            try:
                with self._exclusive() as s:
                    head = s.current()
                    if head["snapshot_id"] != base:
                        self._check(told, base)
                    at = s.one("SELECT max(snapshot_id) FROM snapshot")[0] + 1
                    schema_version = head["schema_version"] + any(t[0].startswith(("created", "altered", "dropped")) for t in told)
                    s.run("INSERT INTO snapshot VALUES (?, ?, ?)", at, now(), schema_version)
                    for op in ops:
                        op(s, at)
                    text = [f"{t[0]}:{t[1]}" + (f"[{'|'.join(map(str, sorted(t[2])))}]" if len(t) > 2 and t[2] else "") for t in told]
                    s.run("INSERT INTO snapshot_changes VALUES (?, ?, ?, ?, ?)", at, ",".join(dict.fromkeys(text)), author, message, extra)
                self.last_committed, self._message = at, (None, None, None)
                return
            except sqlite3.OperationalError as e:
                if "locked" not in str(e) and "busy" not in str(e) or attempt == RETRIES:
                    raise
                time.sleep(WAIT_S * BACKOFF**attempt * random.uniform(0.5, 1))

    def _check(self, told: list[tuple], base: int) -> None:
        """Raise if what was committed since base stands against my changes."""
        theirs = [self._parsed(c) for r in self._real.rows("SELECT changes FROM snapshot_changes WHERE snapshot_id > ?", base) for c in r["changes"].split(",") if c]
        created = {v for k, v, _ in theirs if k.startswith("created")}
        for t in told:
            kind, what, touched = t[0], str(t[1]), {str(x) for x in t[2]} if len(t) > 2 else set()
            if kind.startswith("created"):
                if what in created:
                    raise ConflictError(f'"{what}" was created by another commit')
                if "." in what and ("dropped_schema", self._schema_of(what)) in {(k, v) for k, v, _ in theirs}:
                    raise ConflictError(f'the schema of "{what}" was dropped by another commit')
            for k, v, files in theirs:
                if kind == "dropped_schema" and k.startswith("created") and v.startswith(f"{self._name_of_schema(what)}."):
                    raise ConflictError("something was created in the schema by another commit")
                if v != what:
                    continue
                if k in _CONFLICTS.get(kind, ()) or kind == k == "deleted_from_table" and touched & files:
                    raise ConflictError(f"{kind} of {what} conflicts with {k} of another commit")

    @staticmethod
    def _parsed(text: str) -> tuple[str, str, set[str]]:
        kind, _, rest = text.partition(":")
        what, _, files = rest.partition("[")
        return kind, what, set(files.rstrip("]").split("|")) if files else set()

    def _schema_of(self, name: str) -> str:
        row = self._real.one("SELECT schema_id FROM namespace WHERE name = ?", name.rpartition(".")[0])
        return str(row[0]) if row else ""

    def _name_of_schema(self, schema_id: str) -> str:
        row = self._real.one("SELECT name FROM namespace WHERE schema_id = ?", int(schema_id))
        return row[0] if row else ""

    # --- what there is ---

    def snapshots(self) -> DataFrame:
        rows = []
        for r in self.store.rows("SELECT * FROM snapshot JOIN snapshot_changes USING (snapshot_id) ORDER BY snapshot_id"):
            changes: dict[str, list[str]] = {}
            for kind, what, _ in map(self._parsed, filter(None, (r["changes"] or "").split(","))):
                changes.setdefault(kind, []).append(what)
            rows.append((r["snapshot_id"], self._time(r["snapshot_time"]), r["schema_version"], changes, r["author"], r["commit_message"], r["commit_extra_info"]))
        return self.spark.createDataFrame(rows, "snapshot_id long, snapshot_time timestamp, schema_version long, changes map<string,array<string>>, author string, commit_message string, commit_extra_info string")

    def current_snapshot(self) -> DataFrame:
        return self.spark.createDataFrame([(self._now(),)], "id long")

    def last_committed_snapshot(self) -> DataFrame:
        """The last snapshot that this object committed, null before."""
        return self.spark.createDataFrame([(self.last_committed,)], "id long")

    def table_info(self) -> DataFrame:
        snapshot, rows = self._now(), []
        for t in self.store.alive("lake_table", snapshot):
            files = self._files(t["table_id"], snapshot)
            sets = self.store.alive("delete_set", snapshot, "table_id = ?", t["table_id"])
            deleted = sum(self.fs.size(p) for s in sets for p in ([s["path"]] if s["format"] == "puffin" else [w[0] for w in self.fs.walk(s["path"]) if w[0].endswith(".parquet")]))
            rows.append((t["name"], t["schema_id"], t["table_id"], t["uuid"], len(files), sum(f["size"] for f in files), len(sets), deleted))
        return self.spark.createDataFrame(rows, "table_name string, schema_id long, table_id long, table_uuid string, file_count long, file_size_bytes long, delete_file_count long, delete_file_size_bytes long")

    def list_files(self, name: str, schema: str | None = None, version: int | None = None, timestamp=None) -> DataFrame:
        snapshot = self._snapshot(version, timestamp)
        table = self._table(name if schema is None else f"{schema}.{name}", snapshot)
        files = self._files(table["table_id"], snapshot)
        sets = {r["delete_id"]: r for r in self.store.alive("delete_set", snapshot, "table_id = ?", table["table_id"])}
        gone = {}
        for c in self.store.alive("delete_count", snapshot, "1"):
            if c["delete_id"] in sets:
                n, path = gone.get(c["file_id"], (0, None))
                gone[c["file_id"]] = (n + c["n"], sets[c["delete_id"]]["path"])
        rows = [(f["path"], f["size"], f["record_count"], f["row_id_start"], f["partition_values"], f["begin_snapshot"], gone.get(f["file_id"], (0, None))[1], gone.get(f["file_id"], (0, None))[0]) for f in files]
        return self.spark.createDataFrame(rows, "data_file string, data_file_size_bytes long, record_count long, row_id_start long, partition_values string, begin_snapshot long, delete_file string, delete_count long")

    def settings(self) -> DataFrame:
        return self.spark.createDataFrame([("sqlite", self.store.option("version"), self.data_path)], "catalog_type string, version string, data_path string")

    def options(self) -> DataFrame:
        rows = [(r["name"], r["value"], r["scope"], r["scope_id"] if r["scope"] != "global" else None) for r in self.store.rows("SELECT * FROM option") if r["name"] in OPTIONS]
        return self.spark.createDataFrame(rows, "option_name string, value string, scope string, scope_entry long")

    def query_log(self) -> DataFrame:
        """The last statements that this object put to its store, with when and how long."""
        return self.spark.createDataFrame([(k, at, seconds, " ".join(sql.split())) for k, (at, seconds, sql) in enumerate(self._real.queries)], "nth long, started timestamp, seconds double, statement string")

    def size(self) -> DataFrame:
        """Bytes and rows of the lake's files, from the store."""
        row = self.store.one("SELECT coalesce(sum(size), 0), coalesce(sum(record_count), 0), count(*) FROM data_file WHERE end_snapshot IS NULL")
        return self.spark.createDataFrame([tuple(row)], "bytes long, record_count long, file_count long")

    def partitions(self, name: str) -> DataFrame:
        """Files by partition value (as text), with their rows."""
        snapshot = self._now()
        rows = [(json.loads(f["partition_values"]) if f["partition_values"] else [], f["record_count"]) for f in self._files(self._table(name, snapshot)["table_id"], snapshot)]
        return self.spark.createDataFrame(rows, "partition_values array<string>, record_count long").groupBy("partition_values").agg(F.sum("record_count").alias("record_count"), F.count("*").alias("files"))

    # --- SQL ---

    def register(self, prefix: str = "", version: int | None = None) -> None:
        """Temporary views and functions of the session for all tables, views and macros (of schema main by their own names)."""
        snapshot = self._snapshot(version, None)
        spaces = {r["schema_id"]: r["name"] for r in self.store.alive("namespace", snapshot)}
        label = lambda r: prefix + (r["name"] if spaces[r["schema_id"]] == "main" else f"{spaces[r['schema_id']].replace('.', '_')}_{r['name']}")
        for t in self.store.alive("lake_table", snapshot):
            self._scan(t["table_id"], snapshot).createOrReplaceTempView(label(t))
        macros: dict[str, list] = {}
        for m in self.store.alive("macro", snapshot):
            macros.setdefault(label(m), []).append(m)
        for name, own in macros.items():
            for m in own:
                n = len([p for p in m["parameters"].split(",") if p.strip()])
                as_ = name if len(own) == 1 else f"{name}_{n}"  # Spark has one function of a name
                returns = "TABLE (" + m["kind"][6:] + ")" if m["kind"].startswith("table") else ""
                self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {as_}({m['parameters']}) " + (f"RETURNS {returns} RETURN {m['body']}" if returns else f"RETURN {m['body']}"))
        left = self.store.alive("view", snapshot)
        while left:  # views may stand on views
            failed = []
            for v in left:
                try:
                    df = self.spark.sql(v["sql"])
                except Exception as e:  # noqa: BLE001
                    failed.append((v, e))
                    continue
                aliases = json.loads(v["aliases"])
                (df.toDF(*aliases) if aliases else df).createOrReplaceTempView(label(v))
            if len(failed) == len(left):
                raise LakeError(f'view "{failed[0][0]["name"]}" can\'t be read') from failed[0][1]
            left = [v for v, _ in failed]

    def sql(self, query: str, version: int | None = None) -> DataFrame:
        """A query over the lake's tables, views and macros."""
        self.register(version=version)
        return self.spark.sql(query)


def schema_text(lake: Lake, name: str) -> str:
    """The columns of a table as Spark DDL."""
    snapshot = lake._now()
    return re.sub(r"\s+", " ", fields.schema_of(columns_at(lake.store, lake._table(name, snapshot)["table_id"], snapshot)).simpleString())
