"""The metadata store: one SQLite file. Rows live from begin_snapshot to end_snapshot; a commit is one transaction."""

from __future__ import annotations

import contextlib
import json
import sqlite3
import threading
import time
from collections import deque
from datetime import UTC, datetime
from urllib.parse import quote

from tarn.errors import LakeError

LOG_LENGTH = 10_000
_STATISTICS = ("file_stats", "variant_stats")

VERSION = "2"
#: What a store of a version lacks that the next one has.
MIGRATIONS = {
    "1": """
CREATE TABLE variant_stats (file_id INTEGER, table_id INTEGER, field_id INTEGER, key TEXT, kind TEXT, min TEXT, max TEXT);
CREATE INDEX variant_stats_of ON variant_stats (table_id, field_id, key);
""",
}
_VERSIONED = "begin_snapshot INTEGER NOT NULL, end_snapshot INTEGER"

DDL = f"""
CREATE TABLE option (scope TEXT, scope_id INTEGER, name TEXT, value TEXT, PRIMARY KEY (scope, scope_id, name));
CREATE TABLE snapshot (snapshot_id INTEGER PRIMARY KEY, snapshot_time TEXT, schema_version INTEGER);
CREATE TABLE snapshot_changes (snapshot_id INTEGER PRIMARY KEY, changes TEXT, author TEXT, commit_message TEXT, commit_extra_info TEXT);
CREATE TABLE counter (name TEXT PRIMARY KEY, value INTEGER);
CREATE TABLE namespace (schema_id INTEGER, uuid TEXT, name TEXT, {_VERSIONED});
CREATE TABLE lake_table (table_id INTEGER, uuid TEXT, schema_id INTEGER, name TEXT, path TEXT, {_VERSIONED});
CREATE TABLE table_columns (table_id INTEGER, columns TEXT, schema_version INTEGER, {_VERSIONED});
CREATE TABLE next_field (table_id INTEGER PRIMARY KEY, value INTEGER);
CREATE TABLE partition_spec (table_id INTEGER, partition_id INTEGER, spec TEXT, {_VERSIONED});
CREATE TABLE sort_spec (table_id INTEGER, spec TEXT, {_VERSIONED});
CREATE TABLE data_file (file_id INTEGER PRIMARY KEY, table_id INTEGER, path TEXT, reported TEXT, record_count INTEGER, size INTEGER,
  row_id_start INTEGER, partition_id INTEGER, partition_values TEXT, layout TEXT, mapping TEXT, row_ids INTEGER, snapshots INTEGER,
  partial_max INTEGER, ended_by TEXT, {_VERSIONED});
CREATE INDEX data_file_of ON data_file (table_id, begin_snapshot);
CREATE TABLE file_stats (file_id INTEGER, table_id INTEGER, field_id INTEGER, value_count INTEGER, null_count INTEGER, min TEXT, max TEXT, has_nan INTEGER);
CREATE INDEX file_stats_of ON file_stats (table_id, field_id);
{MIGRATIONS["1"]}CREATE TABLE delete_set (delete_id INTEGER PRIMARY KEY, table_id INTEGER, path TEXT, format TEXT, {_VERSIONED});
CREATE TABLE delete_count (delete_id INTEGER, file_id INTEGER, n INTEGER, {_VERSIONED});
CREATE TABLE inlined_delete (table_id INTEGER, file_id INTEGER, pos INTEGER, {_VERSIONED});
CREATE TABLE inlined_row (table_id INTEGER, row_id INTEGER, layout TEXT, body TEXT, {_VERSIONED});
CREATE TABLE table_stats (table_id INTEGER PRIMARY KEY, next_row_id INTEGER);
CREATE TABLE view (view_id INTEGER, uuid TEXT, schema_id INTEGER, name TEXT, sql TEXT, aliases TEXT, {_VERSIONED});
CREATE TABLE macro (macro_id INTEGER, schema_id INTEGER, name TEXT, kind TEXT, parameters TEXT, body TEXT, {_VERSIONED});
CREATE TABLE tag (object TEXT, object_id INTEGER, field TEXT, key TEXT, value TEXT, {_VERSIONED});
CREATE TABLE scheduled (path TEXT, scheduled_time TEXT);
"""


def now() -> str:
    return datetime.now(UTC).isoformat(timespec="microseconds")


class Store:
    """A connection with the few things that all callers ask of it. log holds the last statements, queries those with when they
    began and how long they took, for tests and diagnosis."""

    def __init__(self, path: str, data_path: str | None = None, read_only: bool = False, create: bool = True, migrate: bool = False, timeout_s: float = 30):
        self.path, self.lock, self.log = path, threading.RLock(), []
        self.queries: deque[tuple[datetime, float, str]] = deque(maxlen=LOG_LENGTH)
        if read_only or not create:
            self.db = sqlite3.connect(f"file:{path}?mode={'ro' if read_only else 'rw'}", uri=True, check_same_thread=False, isolation_level=None, timeout=timeout_s)
        else:
            self.db = sqlite3.connect(path, check_same_thread=False, isolation_level=None, timeout=timeout_s)
        self.db.row_factory = sqlite3.Row
        self.db.set_trace_callback(self._logged)
        if not self.rows("SELECT 1 FROM sqlite_master WHERE name = 'snapshot'"):
            if path != ":memory:":
                self.db.execute("PRAGMA journal_mode = WAL")
            self.db.executescript("BEGIN IMMEDIATE;" + DDL + "COMMIT;")
            self.db.execute("INSERT INTO snapshot VALUES (0, ?, 0)", (now(),))
            self.db.execute("INSERT INTO snapshot_changes VALUES (0, 'created_schema:main', NULL, NULL, NULL)")
            self.db.execute("INSERT INTO counter VALUES ('id', 1)")
            self.db.execute("INSERT INTO namespace VALUES (0, 'main', 'main', 0, NULL)")
            self.option_set("data_path", data_path)
            self.option_set("version", VERSION)
        self._migrated(migrate and not read_only)

    def _logged(self, sql: str) -> None:
        self.log.append(sql)
        if len(self.log) > 2 * LOG_LENGTH:
            del self.log[:LOG_LENGTH]

    def _migrated(self, allowed: bool) -> None:
        """Bring a store of an older version up to this one, a step at a time, if that is allowed; never back."""
        while (version := self.option("version")) != VERSION:
            if version not in MIGRATIONS:
                raise LakeError(f"the lake's format {version} is not known here")
            if not allowed:
                raise LakeError(f"the lake has format {version} and {VERSION} is needed: attach it with automatic_migration")
            self.db.executescript(f"BEGIN IMMEDIATE;{MIGRATIONS[version]}UPDATE option SET value = '{int(version) + 1}' WHERE name = 'version';COMMIT;")

    def rows(self, sql: str, *args) -> list[sqlite3.Row]:
        with self.lock, self._timed(sql):
            return self.db.execute(sql, args).fetchall()

    def one(self, sql: str, *args):
        found = self.rows(sql, *args)
        return found[0] if found else None

    def run(self, sql: str, *args) -> int:
        with self.lock, self._timed(sql):
            return self.db.execute(sql, args).rowcount

    def many(self, sql: str, rows) -> None:
        with self.lock, self._timed(sql):
            self.db.executemany(sql, list(rows))

    @contextlib.contextmanager
    def _timed(self, sql: str):
        at, begin = datetime.now(UTC), time.perf_counter()
        yield
        self.queries.append((at, time.perf_counter() - begin, sql))

    def alive(self, table: str, snapshot: int, where: str = "1", *args) -> list[sqlite3.Row]:
        """Rows visible at a snapshot."""
        return self.rows(f"SELECT * FROM {table} WHERE {where} AND begin_snapshot <= ? AND (end_snapshot IS NULL OR end_snapshot > ?)", *args, snapshot, snapshot)

    def new_id(self) -> int:
        """An id that no other object has; taken outside commits too, so it is never given twice."""
        with self.lock:
            return self.db.execute("UPDATE counter SET value = value + 1 WHERE name = 'id' RETURNING value").fetchone()[0]

    def current(self) -> sqlite3.Row:
        return self.one("SELECT * FROM snapshot ORDER BY snapshot_id DESC LIMIT 1")

    def option_set(self, name: str, value, scope: str = "global", scope_id: int = -1) -> None:
        if value is None:
            self.run("DELETE FROM option WHERE scope = ? AND scope_id = ? AND name = ?", scope, scope_id, name)
        else:
            self.run("INSERT OR REPLACE INTO option VALUES (?, ?, ?, ?)", scope, scope_id, name, str(value))

    def option(self, name: str, default=None, table_id: int | None = None, schema_id: int | None = None):
        """A table's value, else its schema's, else the lake's."""
        for scope, scope_id in (("table", table_id), ("schema", schema_id), ("global", -1)):
            if scope_id is not None and (row := self.one("SELECT value FROM option WHERE scope = ? AND scope_id = ? AND name = ?", scope, scope_id, name)):
                return row[0]
        return default

    def copy(self) -> Store:
        """A private copy in memory, for a transaction that reads its own writes.

        Statistics, by far the most of a store, stay in the file: they are read there through a view that adds the copy's own
        and leaves out those of files that it has forgotten. Nothing but a file's end changes its statistics.
        """
        other = object.__new__(Store)
        other.path, other.lock, other.log, other.queries = ":memory:", threading.RLock(), [], self.queries
        other.db = sqlite3.connect(":memory:", check_same_thread=False, isolation_level=None, uri=True)
        other.db.row_factory = sqlite3.Row
        other.db.executescript(DDL + "CREATE TEMP TABLE forgotten (file_id INTEGER PRIMARY KEY);")
        other.db.execute("ATTACH DATABASE ? AS base", (f"file:{quote(self.path)}?mode=ro",))
        with self.lock:
            other.db.execute("BEGIN")
            for (name,) in other.db.execute("SELECT name FROM main.sqlite_master WHERE type = 'table'").fetchall():
                if name not in _STATISTICS:
                    other.db.execute(f"INSERT INTO main.{name} SELECT * FROM base.{name}")
            other.db.execute("COMMIT")
        for name in _STATISTICS:
            values = ", ".join(f"NEW.{r['name']}" for r in other.db.execute(f"SELECT name FROM pragma_table_info('{name}', 'main')").fetchall())
            other.db.executescript(
                f"ALTER TABLE main.{name} RENAME TO own_{name};"
                f"CREATE TEMP VIEW {name} AS SELECT * FROM own_{name} UNION ALL SELECT * FROM base.{name} WHERE file_id NOT IN (SELECT file_id FROM forgotten);"
                f"CREATE TEMP TRIGGER add_{name} INSTEAD OF INSERT ON {name} BEGIN INSERT INTO own_{name} VALUES ({values}); END;"
                f"CREATE TEMP TRIGGER drop_{name} INSTEAD OF DELETE ON {name} BEGIN DELETE FROM own_{name} WHERE file_id = OLD.file_id; INSERT OR IGNORE INTO forgotten VALUES (OLD.file_id); END;"
            )
        return other


def columns_at(store: Store, table_id: int, snapshot: int) -> list[dict]:
    return json.loads(store.alive("table_columns", snapshot, "table_id = ?", table_id)[0]["columns"])
