"""Maintenance: merging small files, rewriting deleted rows away, flushing inlined rows, retention and cleaning up."""

from __future__ import annotations

import json
from collections import defaultdict
from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from tarn.errors import LakeError
from tarn.operators.write import TARGET_FILE_SIZE
from tarn.sources.store import columns_at, now

DELETE_THRESHOLD = 0.95
KEEP_SCHEDULED = timedelta(days=2)


def _seconds(text: str) -> timedelta:
    """'7 days', '12 hours', '30 minutes', '45 seconds' as a span of time."""
    n, unit = str(text).split()
    return timedelta(**{unit if unit.endswith("s") else unit + "s": float(n)})


def _bins(files: list, target: int, size_of) -> list[list]:
    """Neighbours in files' order of birth; one more is added to a bin while that brings it nearer to the target size."""
    bins: list[list] = [[]]
    size = 0
    for f in sorted(files, key=lambda f: (f["begin_snapshot"], f["row_id_start"] or 0, f["file_id"])):
        own = size_of(f)
        if bins[-1] and abs(target - size) < abs(target - size - own):
            bins.append([])
            size = 0
        bins[-1].append(f)
        size += own
    return [b for b in bins if b]


class Maintenance:
    """Mixed into Lake."""

    def _tables(self, table: str | None, schema: str | None, snapshot: int) -> list:
        if table is not None:
            return [self._table(table if schema is None else f"{schema}.{table}", snapshot)]
        spaces = {r["schema_id"]: r["name"] for r in self.store.alive("namespace", snapshot)}
        return [r for r in self.store.alive("lake_table", snapshot) if schema is None or spaces.get(r["schema_id"]) == schema]

    def merge_adjacent_files(self, table: str | None = None, schema: str | None = None, min_file_size: int = 0, max_file_size: int | None = None, max_compacted_files: int | None = None, newer_than: int | None = None) -> int:
        """Merge small files without deletions that have one layout and partition; the number of files merged.

        A merged file carries row and snapshot ids, so all snapshots read as before; the files it replaces are scheduled
        for deletion. Neighbours are added while that brings a group nearer to the target size. A table's groups are written by
        one job a layout, each by a task of its own, and committed at once.
        """
        snapshot, merged = self._now(), 0
        for t in self._tables(table, schema, snapshot):
            target = int(self.option("target_file_size", TARGET_FILE_SIZE, t))
            top = max_file_size if max_file_size is not None else target
            files = [f for f in self._files(t["table_id"], snapshot) if min_file_size <= f["size"] < top and (newer_than is None or f["begin_snapshot"] > newer_than)]
            counts = self._deletions_by_file(t["table_id"], {f["file_id"] for f in files}, snapshot)
            groups: dict[tuple, list] = defaultdict(list)
            for f in files:
                if f["file_id"] not in counts and not f["mapping"]:
                    # What a rewrite made holds rows older than itself; it merges only with files of the same rewrite.
                    since = f["begin_snapshot"] if f["snapshots"] and f["partial_max"] is None else -1
                    groups[f["layout"], f["partition_id"], f["partition_values"], since].append(f)
            bins = []
            for group in groups.values():
                for own in _bins(group, target, lambda f: f["size"]):
                    own = own[: max_compacted_files - merged] if max_compacted_files is not None else own
                    if len(own) > 1:
                        bins.append(own)
                        merged += len(own)
            if bins:
                self._merge(t, bins, snapshot)
        return merged

    def _merge(self, table, bins: list[list], snapshot: int) -> None:
        table_id, made = table["table_id"], self._rewritten(table, bins, snapshot, None)

        def merged(s, at):
            for files, new in zip(bins, made, strict=True):
                begin = min(f["begin_snapshot"] for f in files)
                rewritten = files[0]["snapshots"] and files[0]["partial_max"] is None
                last = None if rewritten else max(max(f["begin_snapshot"], f["partial_max"] or 0) for f in files)
                self._add_files(s, table_id, new, at, row_ids=True, snapshots=True, begin=begin, partial_max=last)
                for f in files:
                    self._forget(s, f)

        self._commit([merged], [("merge_adjacent", table_id, frozenset(f["file_id"] for files in bins for f in files))])

    def _rewritten(self, table, bins: list[list], snapshot: int, read_at: int | None) -> list[list[dict]]:
        """New files for bins of files, the files of a bin sharing layout and partition. Rows are read as of read_at (None: all
        that the files hold) and keep their ids; each bin is written by one task, sorted if the table is."""
        _, order = self._specs(table["table_id"], snapshot)
        now_nodes = columns_at(self.store, table["table_id"], snapshot)
        out: list[list[dict]] = [[] for _ in bins]
        layouts: dict[str, list[int]] = defaultdict(list)
        for k, files in enumerate(bins):
            layouts[files[0]["layout"]].append(k)
        for layout, which in layouts.items():
            nodes = json.loads(layout)
            files = [f for k in which for f in bins[k]]
            rows = self._union(self._read_files(table["table_id"], files, nodes, read_at, True), nodes, True)
            # One row a file, of a number the store knows; sent to all executors.
            dealt = self.spark.createDataFrame([(f["file_id"], place) for place, k in enumerate(which) for f in bins[k]], "_file_id long, _bin int")
            rows = rows.join(F.broadcast(dealt), "_file_id").select(*self._physical_columns(nodes), "_row_id", "_snapshot_id", "_bin")
            rows = rows.repartitionById(len(which), F.col("_bin"))
            if order and {x["id"] for x in now_nodes} <= {x["id"] for x in nodes}:
                current = {x["id"]: x["name"] for x in now_nodes}
                rows = self._sorted(rows, [{**x, "name": current.get(x["id"], x["name"])} for x in nodes], order, ["_bin"], within=True)
            for f in self._write_files(table, nodes, rows, ((None, []), []), sort=False, by="_bin", single=False):
                k = which[int(f.pop("keys")[0])]
                f["partition_id"], f["partition_values"] = bins[k][0]["partition_id"], bins[k][0]["partition_values"]
                out[k].append(f)
        return out

    @staticmethod
    def _forget(store, f) -> None:
        store.run("DELETE FROM data_file WHERE file_id = ?", f["file_id"])
        store.run("DELETE FROM file_stats WHERE file_id = ?", f["file_id"])
        store.run("DELETE FROM variant_stats WHERE file_id = ?", f["file_id"])
        if not f["mapping"]:
            store.run("INSERT INTO scheduled VALUES (?, ?)", f["path"], now())

    def rewrite_data_files(self, table: str | None = None, schema: str | None = None, delete_threshold: float | None = None) -> int:
        """Rewrite files of which at least a share of rows is deleted, several into one of about the target size; rows keep their
        ids. The number of files rewritten."""
        snapshot, done = self._now(), 0
        for t in self._tables(table, schema, snapshot):
            least = float(delete_threshold if delete_threshold is not None else self.option("rewrite_delete_threshold", DELETE_THRESHOLD, t))
            target = int(self.option("target_file_size", TARGET_FILE_SIZE, t))
            files = {f["file_id"]: f for f in self._files(t["table_id"], snapshot)}
            counts = self._deletions_by_file(t["table_id"], set(files), snapshot)
            groups: dict[tuple, list] = defaultdict(list)
            for i, n in counts.items():
                f = files[i]
                if n / max(1, f["record_count"]) >= least and not f["mapping"]:
                    groups[f["layout"], f["partition_id"], f["partition_values"]].append(f)
            # What survives of a file counts: files of a bin make one of about the target size.
            bins = [own for group in groups.values() for own in _bins(group, target, lambda f: f["size"] * (1 - counts[f["file_id"]] / max(1, f["record_count"])))]
            if not bins:
                continue
            made = self._rewritten(t, bins, snapshot, snapshot)
            told = {f["file_id"] for own in bins for f in own}

            def rewritten(s, at, made=made, told=told, t=t):
                for new in made:
                    self._add_files(s, t["table_id"], [f for f in new if f["rows"]], at, row_ids=True, snapshots=True)
                s.many("UPDATE data_file SET end_snapshot = ?, ended_by = 'rewrite' WHERE file_id = ?", [(at, i) for i in told])

            self._commit([rewritten], [("rewrite_delete", t["table_id"], frozenset(told))])
            done += len(told)
        return done

    def flush_inlined_data(self, table: str | None = None, schema: str | None = None) -> dict[str, int]:
        """Write inlined rows, those that are deleted since included, to files; rows written by table, where there are any."""
        snapshot, done = self._now(), {}
        for t in self._tables(table, schema, snapshot):
            rows = self.store.rows("SELECT * FROM inlined_row WHERE table_id = ? AND begin_snapshot <= ?", t["table_id"], snapshot)
            if not rows:
                continue
            ops = []
            by_layout: dict[str, list] = defaultdict(list)
            for r in rows:
                by_layout[r["layout"]].append(r)
            for layout, own in by_layout.items():
                nodes = json.loads(layout)
                df = self._read_inlined(own, nodes, True).select(*self._physical_columns(nodes), "_row_id", "_snapshot_id")
                df = df.orderBy("_row_id", "_snapshot_id").coalesce(1)
                files = self._write_files(t, nodes, df, self._specs(t["table_id"], snapshot), sort=False)
                begin, last = min(r["begin_snapshot"] for r in own), max(r["begin_snapshot"] for r in own)
                ends = [(r["row_id"], r["begin_snapshot"], r["end_snapshot"]) for r in own if r["end_snapshot"] is not None]
                dead = []
                if ends and files:  # where the dead ones have come to lie; only those come back
                    places = {f["reported"]: k for k, f in enumerate(files)}
                    ended = self.spark.createDataFrame(ends, "_row_id long, _snapshot_id long, _end long")
                    at = self.spark.read.schema("_row_id long, _snapshot_id long").parquet(*(f["path"] for f in files)).select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("pos"))
                    dead = [(places[r["path"]], r["pos"], r["_end"]) for r in at.join(F.broadcast(ended), ["_row_id", "_snapshot_id"]).collect()]

                def flushed(s, at, files=files, begin=begin, last=last, dead=dead, t=t, own=own):
                    ids = self._add_files(s, t["table_id"], files, at, row_ids=True, snapshots=True, begin=begin, partial_max=last)
                    s.many("INSERT INTO inlined_delete VALUES (?, ?, ?, ?, NULL)", [(t["table_id"], ids[k], pos, end) for k, pos, end in dead])
                    s.many("DELETE FROM inlined_row WHERE table_id = ? AND row_id = ? AND begin_snapshot = ?", [(t["table_id"], r["row_id"], r["begin_snapshot"]) for r in own])

                ops.append(flushed)
            self._commit(ops, [("flushed_inlined", t["table_id"])])
            done[t["name"]] = len(rows)
        return done

    # --- retention ---

    def expire_snapshots(self, older_than=None, versions: list[int] | None = None, dry_run: bool = False) -> list[int]:
        """Forget snapshots before a time, or of given ids; never the newest. What no snapshot shows any more is scheduled."""
        if older_than is not None and versions is not None:
            raise LakeError("give older_than or versions, not both")
        if older_than is None and versions is None and (keep := self.store.option("expire_older_than")):
            older_than = datetime.now(UTC) - _seconds(keep)
        newest = self._now()
        every = self.store.rows("SELECT * FROM snapshot")
        if versions is not None:
            gone = [r["snapshot_id"] for r in every if r["snapshot_id"] in set(versions)]
        elif older_than is not None:
            gone = [r["snapshot_id"] for r in every if self._time(r["snapshot_time"]) < self._time(older_than)]
        else:
            return []
        gone = sorted(i for i in gone if i != newest)
        if dry_run or not gone:
            return gone
        with self._exclusive() as s:
            s.many("DELETE FROM snapshot WHERE snapshot_id = ?", [(i,) for i in gone])
            s.many("DELETE FROM snapshot_changes WHERE snapshot_id = ?", [(i,) for i in gone])
            # A row is needed while some snapshot lies in [begin, end).
            unseen = "end_snapshot IS NOT NULL AND NOT EXISTS (SELECT 1 FROM snapshot p WHERE p.snapshot_id >= x.begin_snapshot AND p.snapshot_id < x.end_snapshot)"
            files = s.rows(f"SELECT * FROM data_file x WHERE {unseen}")
            for f in files:
                self._forget(s, f)
                s.run("DELETE FROM delete_count WHERE file_id = ?", f["file_id"])
                s.run("DELETE FROM inlined_delete WHERE file_id = ?", f["file_id"])
            for d in s.rows("SELECT * FROM delete_set d WHERE NOT EXISTS (SELECT 1 FROM delete_count c WHERE c.delete_id = d.delete_id)"):
                s.run("INSERT INTO scheduled VALUES (?, ?)", d["path"], now())
                s.run("DELETE FROM delete_set WHERE delete_id = ?", d["delete_id"])
            for kind in ("inlined_row", "lake_table", "table_columns", "partition_spec", "sort_spec", "view", "macro", "tag", "namespace"):
                s.run(f"DELETE FROM {kind} AS x WHERE {unseen}")
        return gone

    def cleanup_old_files(self, older_than=None, cleanup_all: bool = False, dry_run: bool = False) -> list[str]:
        """Delete scheduled files: all, or those scheduled before a time (two days ago unless set otherwise)."""
        if older_than is not None and cleanup_all:
            raise LakeError("give older_than or cleanup_all, not both")
        if older_than is None:
            keep = self.store.option("delete_older_than")
            older_than = datetime.now(UTC) - (_seconds(keep) if keep else KEEP_SCHEDULED)
        rows = [r["path"] for r in self.store.rows("SELECT * FROM scheduled") if cleanup_all or self._time(r["scheduled_time"]) < self._time(older_than)]
        if not dry_run:
            for path in rows:
                self.fs.delete(path, True)
                self.store.run("DELETE FROM scheduled WHERE path = ?", path)
        return rows

    def delete_orphaned_files(self, older_than=None, cleanup_all: bool = False, dry_run: bool = False) -> list[str]:
        """Delete .parquet and .puffin files below the data path that the store does not know."""
        known = {self.fs.canonical(r[0]) for r in self.store.rows("SELECT path FROM data_file UNION SELECT path FROM delete_set UNION SELECT path FROM scheduled")}
        limit = self._time(older_than).timestamp() * 1000 if older_than is not None else None if cleanup_all else (datetime.now(UTC) - KEEP_SCHEDULED).timestamp() * 1000
        out = []
        for path, _, changed in self.fs.walk(self.data_path):
            parts = path.split("/")
            owned = path in known or "/".join(parts[:-1]) in known
            if path.endswith((".parquet", ".puffin")) and not owned and (limit is None or changed < limit):
                out.append(path)
                if not dry_run:
                    self.fs.delete(path)
        return out

    def checkpoint(self) -> None:
        """All maintenance in order: flush, expire, merge, rewrite, clean up, orphans. Tables with auto_compact off are neither
        flushed nor merged nor rewritten."""
        snapshot = self._now()
        names = {r["schema_id"]: r["name"] for r in self.store.alive("namespace", snapshot)}
        compacted = [(names[t["schema_id"]], t["name"]) for t in self._tables(None, None, snapshot) if str(self.option("auto_compact", "true", t)).lower() != "false"]
        for schema, name in compacted:
            self.flush_inlined_data(name, schema)
        self.expire_snapshots()
        for schema, name in compacted:
            self.merge_adjacent_files(name, schema)
            self.rewrite_data_files(name, schema)
        self.cleanup_old_files()
        self.delete_orphaned_files()
