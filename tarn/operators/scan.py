"""Reads: which files, deletions and inlined rows a snapshot shows, as one DataFrame."""

from __future__ import annotations

import json
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.errors import LakeError
from tarn.functions import fields
from tarn.plans import pruning
from tarn.sources.store import columns_at

BROADCAST_ROWS = 2_000_000  # deleted positions that are sent to all executors; more are shuffled
LINEAGE = ("_row_id", "_snapshot_id", "_file_id", "_pos")
JSON_FORMAT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


@dataclass
class Plan:
    """What a read looked at: for tests and for users who ask why it was slow."""

    files_total: int = 0
    files_read: int = 0
    inlined_rows: int = 0
    names: tuple = ()


class Scan:
    """Mixed into Lake."""

    def _files(self, table_id: int, snapshot: int) -> list:
        return self.store.alive("data_file", snapshot, "table_id = ?", table_id)

    def _pruner(self, table_id: int, files: list, nodes: list[dict], wanted: set[int] | None = None) -> pruning.Files:
        """Statistics of files, of the wanted fields only (all without)."""
        kinds = {n["id"]: n["kind"] for n, _, _ in fields.leaves(nodes) if wanted is None or n["id"] in wanted}
        stats, ids = {}, {f["file_id"] for f in files}
        few = f"AND file_id IN ({','.join(map(str, sorted(ids)))})" if len(ids) <= 1_000 else ""
        for field_id in kinds:
            for s in self.store.rows(f"SELECT * FROM file_stats WHERE table_id = ? AND field_id = ? {few}", table_id, field_id):
                if s["file_id"] in ids:
                    stats[s["file_id"], field_id] = dict(s)
        by_layout: dict[str, dict[int, str]] = {}
        for f in files:  # a bound is of the type its file was written with
            if f["layout"] not in by_layout:
                by_layout[f["layout"]] = {n["id"]: n["kind"] for n, _, _ in fields.leaves(json.loads(f["layout"]))}
            written = by_layout[f["layout"]]
            for field_id, kind in kinds.items():
                if (s := stats.get((f["file_id"], field_id))) is not None:
                    s["kind"] = written.get(field_id, kind)
        specs = {r["partition_id"]: json.loads(r["spec"]) for r in self.store.rows("SELECT * FROM partition_spec WHERE table_id = ?", table_id)}
        return pruning.Files(files, stats, nodes, specs)

    def _kept_files(self, table_id: int, snapshot: int, nodes: list[dict], where: str) -> tuple[list, int]:
        """(files that may hold rows of a predicate, number of all): what bounds can tell in SQL never leaves the store, the
        statistics of the fields that the predicate names decide on the rest."""
        tree = pruning.parse(self.spark, where)
        total = self.store.one("SELECT count(*) FROM data_file WHERE table_id = ? AND begin_snapshot <= ? AND (end_snapshot IS NULL OR end_snapshot > ?)", table_id, snapshot, snapshot)[0]
        leaves = {tuple(x.lower() for x in names): n for n, names, _ in fields.leaves(nodes)}
        ruled_out, args = pruning.as_sql(tree, leaves, table_id)
        files = self.store.alive("data_file", snapshot, f"table_id = ?{ruled_out}", table_id, *args)
        wanted = {leaves[x]["id"] for x in pruning.paths(tree) if x in leaves}
        judge = self._pruner(table_id, files, nodes, wanted)
        ids = {f["file_id"] for f in files}
        for path in pruning.paths(tree):
            if pruning.VARIANT in path and (leaf := leaves.get(path[:-3])) is not None:
                for s in self.store.rows("SELECT * FROM variant_stats WHERE table_id = ? AND field_id = ? AND lower(key) = ?", table_id, leaf["id"], path[-2]):
                    if s["file_id"] in ids:
                        judge.variants[s["file_id"], leaf["id"], s["key"]] = dict(s)
        return judge.keep(tree), total

    def table(self, name: str, version: int | None = None, timestamp=None, where: str | None = None, lineage: bool = False, virtual: bool = False) -> DataFrame:
        """The rows of a table at the current snapshot, a version or the newest one not after a timestamp.

        where: a predicate in SQL; files that cannot match are not read. lineage: with _row_id, _snapshot_id, _file_id, _pos.
        virtual: with rowid, snapshot_id, filename, file_row_number and file_index (the file's place among those that are read);
        the last three are null of inlined rows.
        """
        snapshot = self._snapshot(version, timestamp)
        table = self._table(name, snapshot)
        out = self._scan(table["table_id"], snapshot, where, lineage or virtual)
        out = out.where(where) if where else out
        if not virtual:
            return out
        # One row a file, of a number the store knows; sent to all executors.
        places = self.spark.createDataFrame([(f["file_id"], f["path"], k) for k, f in enumerate(self._read)], "_file_id long, filename string, file_index long")
        out = out.join(F.broadcast(places), "_file_id", "left").withColumn("rowid", F.col("_row_id")).withColumn("snapshot_id", F.col("_snapshot_id")).withColumn("file_row_number", F.col("_pos"))
        return out if lineage else out.drop(*LINEAGE)

    def _scan(self, table_id: int, snapshot: int, where: str | None = None, lineage: bool = False, files: list | None = None) -> DataFrame:
        nodes = columns_at(self.store, table_id, snapshot)
        if where and files is None:
            kept, total = self._kept_files(table_id, snapshot, nodes, where)
        else:
            kept = self._files(table_id, snapshot) if files is None else files
            total = len(kept)
        self._read = kept
        inlined = self.store.alive("inlined_row", snapshot, "table_id = ?", table_id) if files is None else []
        self.last_plan = Plan(total, len(kept), len(inlined), tuple(f["path"] for f in kept[:5]))
        parts = self._read_files(table_id, kept, nodes, snapshot, lineage)
        if inlined:
            parts.append(self._read_inlined(inlined, nodes, lineage))
        return self._union(parts, nodes, lineage)

    def _union(self, parts: list[DataFrame], nodes: list[dict], lineage: bool) -> DataFrame:
        if not parts:
            schema = fields.schema_of(nodes)
            if lineage:
                for c in LINEAGE:
                    schema = schema.add(c, T.LongType())
            return self.spark.createDataFrame([], schema)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionAll(p)
        return out

    def _deletions(self, table_id: int, file_ids: set[int], snapshot: int, low: int | None = None):
        """(positions, deleted per file) of deletions alive at a snapshot (begun at low or later), or None."""
        since = "" if low is None else f" AND begin_snapshot >= {int(low)}"
        counts: dict[int, int] = defaultdict(int)
        sets = {r["delete_id"]: r for r in self.store.alive("delete_set", snapshot, f"table_id = ?{since}", table_id)}
        used = set()
        if sets:
            for r in self.store.alive("delete_count", snapshot, "1"):
                if r["delete_id"] in sets and r["file_id"] in file_ids:
                    counts[r["file_id"]] += r["n"]
                    used.add(r["delete_id"])
        small = [(r["file_id"], r["pos"], r["begin_snapshot"]) for r in self.store.alive("inlined_delete", snapshot, f"table_id = ?{since}", table_id) if r["file_id"] in file_ids]
        for file_id, _, _ in small:
            counts[file_id] += 1
        if not counts:
            return None, counts
        parts = [self._delete_set(sets[d]) for d in sorted(used)]
        if small:
            parts.append(self.spark.createDataFrame(small, "_file_id long, _pos long, _deleted_at long"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionAll(p)
        return out, counts

    def _deletions_by_file(self, table_id: int, file_ids: set[int], snapshot: int):
        """The deleted rows of each file that has any, from the store alone."""
        counts: dict[int, int] = defaultdict(int)
        sets = {r["delete_id"] for r in self.store.alive("delete_set", snapshot, "table_id = ?", table_id)}
        for r in self.store.alive("delete_count", snapshot, "1"):
            if r["delete_id"] in sets and r["file_id"] in file_ids:
                counts[r["file_id"]] += r["n"]
        for r in self.store.alive("inlined_delete", snapshot, "table_id = ?", table_id):
            if r["file_id"] in file_ids:
                counts[r["file_id"]] += 1
        return counts

    def _delete_set(self, row) -> DataFrame:
        """(_file_id, _pos, _deleted_at) of one written set of deletions."""
        if row["format"] == "puffin":
            from tarn.sources import puffin

            df = puffin.positions(self.spark, row["path"])
        else:
            df = self.spark.read.schema("file_id long, pos long").parquet(row["path"])
            # A position without a file or a place is no deletion that this lake wrote: better an error than rows come back.
            broken = F.raise_error(F.lit(f"broken deletions in {row['path']}"))
            df = df.select(F.coalesce("file_id", broken.cast("long")).alias("file_id"), F.coalesce("pos", broken.cast("long")).alias("pos")).select(F.col("file_id").alias("_file_id"), F.col("pos").alias("_pos"))
        return df.withColumn("_deleted_at", F.lit(row["begin_snapshot"]).cast("long"))

    def _read_files(self, table_id: int, files: list, nodes: list[dict], snapshot: int | None, lineage: bool, apply_deletes: bool = True) -> list[DataFrame]:
        """DataFrames of files, one for each layout. snapshot None: rows of all snapshots, nothing deleted."""
        deleted, counts = self._deletions(table_id, {f["file_id"] for f in files}, snapshot) if apply_deletes and snapshot is not None else (None, {})
        groups: dict[tuple, list] = defaultdict(list)
        for f in files:
            late = bool(f["snapshots"]) and snapshot is not None and (f["partial_max"] or 0) > snapshot
            groups[f["layout"], f["mapping"], f["row_ids"], f["snapshots"], f["file_id"] in counts, late].append(f)
        return [self._read_group(group, nodes, snapshot, lineage, deleted if key[4] else None, sum(counts.get(f["file_id"], 0) for f in group), key[5]) for key, group in groups.items()]

    def _read_group(self, group: list, nodes: list[dict], snapshot, lineage: bool, deleted, n_deleted: int, late: bool) -> DataFrame:
        first = group[0]
        written = json.loads(first["layout"])
        mapping = json.loads(first["mapping"]) if first["mapping"] else None
        names = {n["id"]: mapping["fields"].get(str(n["id"])) if mapping else f"c{n['id']}" for n in written}
        schema = T.StructType([T.StructField(names[n["id"]], fields.spark_type(n, physical=mapping is None)) for n in written if names[n["id"]]])
        if first["row_ids"]:
            schema = schema.add("_row_id", T.LongType())
        if first["snapshots"]:
            schema = schema.add("_snapshot_id", T.LongType())
        df = self.spark.read.schema(schema).parquet(*(f["path"] for f in group))
        wide = lineage or deleted is not None
        hive = mapping["hive"] if mapping else {}
        if wide or hive:
            facts = [(f["reported"], f["file_id"], f["row_id_start"], f["begin_snapshot"], json.loads(f["mapping"])["hive"] if hive else None) for f in group]
            # One row a file, of a size the store knows; sent to all executors.
            constant = self.spark.createDataFrame(facts, "_key string, _file_id long, _start long, _begin long, _hive map<string,string>")
            df = df.select("*", F.col("_metadata.file_path").alias("_key"), F.col("_metadata.row_index").alias("_pos")).join(F.broadcast(constant), "_key")
        if late:
            df = df.where(F.col("_snapshot_id") <= snapshot)
        if deleted is not None:
            gone = deleted.select("_file_id", "_pos")
            df = df.join(F.broadcast(gone) if n_deleted <= BROADCAST_ROWS else gone, ["_file_id", "_pos"], "left_anti")
        by_id = {n["id"]: n for n in written}
        columns = []
        for n in nodes:
            own = by_id.get(n["id"])
            if own is not None and str(n["id"]) in hive:
                column = F.col("_hive")[str(n["id"])].cast(fields.spark_type(n))
            elif own is not None and mapping is not None:
                column = F.col(f"`{names[n['id']]}`").cast(fields.spark_type(n)) if names[n["id"]] else fields.to_logical(F.lit(None), None, n)
            else:
                column = fields.to_logical(F.col(f"c{n['id']}"), own, n)
            columns.append(column.alias(n["name"]))
        if lineage:
            columns += [
                (F.col("_row_id") if first["row_ids"] else F.col("_start") + F.col("_pos")).alias("_row_id"),
                (F.col("_snapshot_id") if first["snapshots"] else F.col("_begin")).alias("_snapshot_id"),
                F.col("_file_id"),
                F.col("_pos"),
            ]
        return df.select(*columns)

    def _read_inlined(self, rows: list, nodes: list[dict], lineage: bool) -> DataFrame:
        by_layout: dict[str, list] = defaultdict(list)
        for r in rows:
            by_layout[r["layout"]].append((r["row_id"], r["begin_snapshot"], r["body"]))
        parts = []
        for layout, own in by_layout.items():
            written = json.loads(layout)
            df = self.spark.createDataFrame(own, "_row_id long, _snapshot_id long, _body string").coalesce(1)
            df = df.withColumn("_v", F.from_json("_body", fields.schema_of(written, physical=True), JSON_FORMAT))
            by_id = {n["id"]: n for n in written}
            columns = [fields.to_logical(F.col(f"_v.c{n['id']}") if n["id"] in by_id else F.lit(None), by_id.get(n["id"]), n).alias(n["name"]) for n in nodes]
            if lineage:
                columns += ["_row_id", "_snapshot_id", F.lit(None).cast("long").alias("_file_id"), F.lit(None).cast("long").alias("_pos")]
            parts.append(df.select(*columns))
        return self._union(parts, nodes, lineage)

    # --- answers from the store alone ---

    def count(self, name: str, version: int | None = None, timestamp=None) -> DataFrame:
        """COUNT(*) without reading data: files' counts less their deletions, and inlined rows."""
        snapshot = self._snapshot(version, timestamp)
        table_id = self._table(name, snapshot)["table_id"]
        files = self._files(table_id, snapshot)
        if any(f["snapshots"] and (f["partial_max"] or 0) > snapshot for f in files):  # a merged file also holds later rows
            return self._scan(table_id, snapshot).agg(F.count("*").alias("count"))
        _, counts = self._deletions_counts(table_id, files, snapshot)
        n = sum(f["record_count"] for f in files) - counts + len(self.store.alive("inlined_row", snapshot, "table_id = ?", table_id))
        return self.spark.createDataFrame([(n,)], "count long")

    def _deletions_counts(self, table_id: int, files: list, snapshot: int):
        ids = {f["file_id"] for f in files}
        sets = {r["delete_id"] for r in self.store.alive("delete_set", snapshot, "table_id = ?", table_id)}
        n = sum(r["n"] for r in self.store.alive("delete_count", snapshot, "1") if r["delete_id"] in sets and r["file_id"] in ids)
        return ids, n + sum(r["file_id"] in ids for r in self.store.alive("inlined_delete", snapshot, "table_id = ?", table_id))

    def min_max(self, name: str, column: str, version: int | None = None) -> DataFrame:
        """MIN and MAX of a column: from the store if nothing was deleted and all bounds are known, else by a scan."""
        snapshot = self._snapshot(version, None)
        table_id = self._table(name, snapshot)["table_id"]
        nodes = columns_at(self.store, table_id, snapshot)
        node = fields.find(nodes, column)
        files = self._files(table_id, snapshot)
        clean = not self._deletions_counts(table_id, files, snapshot)[1] and not self.store.alive("inlined_row", snapshot, "table_id = ?", table_id)
        clean = clean and not any(f["snapshots"] and (f["partial_max"] or 0) > snapshot for f in files)
        stats = self._pruner(table_id, files, nodes, {node["id"]}).stats
        own = [stats.get((f["file_id"], node["id"])) for f in files]
        exact = all(s is not None and not s["has_nan"] and (s["min"] is not None or s["null_count"] == s["value_count"]) for s in own)
        if clean and exact and own and node["kind"] not in ("binary", "timestamp"):
            lows = [pruning.decode(s["min"], s["kind"]) for s in own if s["min"] is not None]
            highs = [pruning.decode(s["max"], s["kind"]) for s in own if s["max"] is not None]
            self.last_plan = Plan(len(files), 0)
            return self.spark.createDataFrame([(min(lows, default=None), max(highs, default=None))], T.StructType([T.StructField("min", fields.spark_type(node)), T.StructField("max", fields.spark_type(node))]))
        return self._scan(table_id, snapshot).agg(F.min(column).alias("min"), F.max(column).alias("max"))

    def top(self, name: str, column: str, n: int, descending: bool = True, ties: tuple[str, ...] = (), version: int | None = None) -> DataFrame:
        """ORDER BY column LIMIT n, reading only files whose bounds may reach the first n; ties: more columns to order by."""
        snapshot = self._snapshot(version, None)
        table_id = self._table(name, snapshot)["table_id"]
        nodes = columns_at(self.store, table_id, snapshot)
        node = fields.find(nodes, column)
        files = self._files(table_id, snapshot)
        partial = any(f["snapshots"] and (f["partial_max"] or 0) > snapshot for f in files)
        clean = not partial and not self._deletions_counts(table_id, files, snapshot)[1] and all(c["id"] != node["id"] or c["initial"] is None for c in nodes)
        kept = self._pruner(table_id, files, nodes, {node["id"]}).top(node["id"], n, descending) if clean else files
        inlined = self.store.alive("inlined_row", snapshot, "table_id = ?", table_id)
        self.last_plan = Plan(len(files), len(kept), len(inlined))
        parts = self._read_files(table_id, kept, nodes, snapshot, False)
        if inlined:
            parts.append(self._read_inlined(inlined, nodes, False))
        order = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
        return self._union(parts, nodes, False).orderBy(order, *ties).limit(n)

    # --- change feed ---

    def _range(self, start, end) -> tuple[int, int]:
        lo = start if isinstance(start, int) else self._lower_snapshot(start)
        return lo, end if isinstance(end, int) else self._snapshot(None, end)

    def insertions(self, name: str, start, end) -> DataFrame:
        """snapshot_id, rowid and the columns of rows born in the snapshots start to end (both included), deleted since or not."""
        lo, hi = self._range(start, end)
        table_id, nodes = self._feed_table(name, hi)
        files = [f for f in self.store.rows("SELECT * FROM data_file WHERE table_id = ? AND begin_snapshot <= ?", table_id, hi) if max(f["begin_snapshot"], f["partial_max"] or 0) >= lo and f["ended_by"] != "merge"]
        parts = []
        for f in self._read_files(table_id, files, nodes, None, True):
            parts.append(f)
        # A file made by a rewrite holds rows born before it: their birth is told by the file that it replaces.
        begun = self.spark.createDataFrame([(f["file_id"], f["begin_snapshot"]) for f in files], "_file_id long, _begin long") if files else None
        out = self._union(parts, nodes, True)
        if begun is not None:
            out = out.join(F.broadcast(begun), "_file_id").where("_snapshot_id >= _begin").drop("_begin")
        inlined = self.store.rows("SELECT * FROM inlined_row WHERE table_id = ? AND begin_snapshot BETWEEN ? AND ?", table_id, lo, hi)
        columns = [n["name"] for n in nodes]
        out = out.select("_snapshot_id", "_row_id", *columns)
        if inlined:
            out = out.unionAll(self._read_inlined(inlined, nodes, True).select("_snapshot_id", "_row_id", *columns))
        return out.where(F.col("_snapshot_id").between(lo, hi)).withColumnsRenamed({"_snapshot_id": "snapshot_id", "_row_id": "rowid"})

    def deletions(self, name: str, start, end) -> DataFrame:
        """snapshot_id (of the deletion), rowid and the columns of rows that were deleted in the snapshots start to end."""
        lo, hi = self._range(start, end)
        table_id, nodes = self._feed_table(name, hi)
        columns = [n["name"] for n in nodes]
        parts = []
        files = self.store.rows("SELECT * FROM data_file WHERE table_id = ? AND begin_snapshot <= ? AND coalesce(ended_by, '') <> 'merge'", table_id, hi)
        at, counts = self._deletions(table_id, {f["file_id"] for f in files}, hi, lo)
        touched = [f for f in files if f["file_id"] in counts]
        if touched:
            rows = self._union(self._read_files(table_id, touched, nodes, None, True), nodes, True)
            parts.append(rows.join(at, ["_file_id", "_pos"]).select(F.col("_deleted_at").alias("snapshot_id"), F.col("_row_id").alias("rowid"), *columns))
        ended: dict[int, list] = defaultdict(list)
        for f in files:
            if f["end_snapshot"] is not None and lo <= f["end_snapshot"] <= hi and f["ended_by"] == "delete":
                ended[f["end_snapshot"]].append(f)
        for at_end, own in sorted(ended.items()):  # a branch for each snapshot and layout, however many files ended
            rows = self._union(self._read_files(table_id, own, nodes, at_end - 1, True), nodes, True)
            parts.append(rows.select(F.lit(at_end).cast("long").alias("snapshot_id"), F.col("_row_id").alias("rowid"), *columns))
        dead = self.store.rows("SELECT * FROM inlined_row WHERE table_id = ? AND end_snapshot BETWEEN ? AND ?", table_id, lo, hi)
        if dead:
            ends = self.spark.createDataFrame([(r["row_id"], r["begin_snapshot"], r["end_snapshot"]) for r in dead], "_row_id long, _snapshot_id long, _end long")
            rows = self._read_inlined(dead, nodes, True).join(F.broadcast(ends), ["_row_id", "_snapshot_id"])
            parts.append(rows.select(F.col("_end").alias("snapshot_id"), F.col("_row_id").alias("rowid"), *columns))
        if not parts:
            return self.spark.createDataFrame([], T.StructType([T.StructField("snapshot_id", T.LongType()), T.StructField("rowid", T.LongType())] + fields.schema_of(nodes).fields))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionAll(p)
        return out

    def changes(self, name: str, start, end) -> DataFrame:
        """Insertions and deletions with change_type; a row deleted and inserted in one snapshot is an update."""
        born, died = self.insertions(name, start, end), self.deletions(name, start, end)
        key = ["snapshot_id", "rowid"]
        both = born.select(*key).join(died.select(*key), key).withColumn("_both", F.lit(True))
        columns = born.columns[2:]

        def told(df, change, update):
            return df.join(both, key, "left").select(*key, F.when(F.col("_both"), update).otherwise(change).alias("change_type"), *columns)

        return told(born, "insert", "update_postimage").unionAll(told(died, "delete", "update_preimage"))

    def _feed_table(self, name: str, snapshot: int):
        table_id = self._table(name, snapshot)["table_id"]
        return table_id, columns_at(self.store, table_id, snapshot)


def need(condition, message: str) -> None:
    if not condition:
        raise LakeError(message)
