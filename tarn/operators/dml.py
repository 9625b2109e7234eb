"""Row-level changes: DELETE, TRUNCATE, UPDATE and MERGE. Rows keep their ids through updates."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.errors import LakeError
from tarn.functions import fields
from tarn.operators.scan import LINEAGE
from tarn.sources.store import columns_at

DELETE_INLINE_LIMIT = 10
PUFFIN_BYTES = 16 << 20


class Dml:
    """Mixed into Lake."""

    def delete(self, name: str, where: str | None = None) -> int:
        """Delete the rows that a predicate keeps (all without one); the number of rows."""
        snapshot = self._now()
        table = self._table(name, snapshot)
        rows = self._scan(table["table_id"], snapshot, where, lineage=True)
        return self._delete_rows(table, rows.where(where) if where else rows, snapshot)

    def truncate(self, name: str) -> int:
        """End all files and inlined rows of a table in the store; no data is read. The number of rows."""
        snapshot = self._now()
        table = self._table(name, snapshot)
        table_id = table["table_id"]
        files = self._files(table_id, snapshot)
        if any(f["snapshots"] and (f["partial_max"] or 0) > snapshot for f in files):  # a merged file that also holds later rows
            return self.delete(name)
        inlined = self.store.alive("inlined_row", snapshot, "table_id = ?", table_id)
        n = sum(f["record_count"] for f in files) - self._deletions_counts(table_id, files, snapshot)[1] + len(inlined)
        ids = [f["file_id"] for f in files]

        def truncated(store, at):
            store.many("UPDATE data_file SET end_snapshot = ?, ended_by = 'delete' WHERE file_id = ? AND end_snapshot IS NULL", [(at, i) for i in ids])
            store.many("UPDATE inlined_row SET end_snapshot = ? WHERE table_id = ? AND row_id = ? AND end_snapshot IS NULL", [(at, table_id, r["row_id"]) for r in inlined])

        if n:
            self._commit([truncated], [("deleted_from_table" if ids else "inlined_delete", table_id, frozenset(ids))])
        return n

    def delete_using(self, name: str, source: DataFrame, on: str | Column) -> int:
        """Delete the rows of the table (alias t) that join with a row of source (alias s)."""
        snapshot = self._now()
        table = self._table(name, snapshot)
        rows = self._scan(table["table_id"], snapshot, lineage=True).alias("t")
        return self._delete_rows(table, rows.join(source.alias("s"), F.expr(on) if isinstance(on, str) else on, "left_semi"), snapshot)

    def _delete_rows(self, table, rows: DataFrame, snapshot: int) -> int:
        op, touched, n = self._deletion(table, rows.select(*LINEAGE), snapshot)
        if n:
            self._commit([op], [("deleted_from_table" if touched else "inlined_delete", table["table_id"], frozenset(touched))])
        return n

    def _deletion(self, table, lineage: DataFrame, snapshot: int):
        """An operation that deletes the rows of a lineage, the files it touches and the number of rows.

        Positions are written by the executors, a set of files for the whole change; only a count per data file comes back.
        A file of which no row is left ends; a few positions go into the store instead.
        """
        table_id = table["table_id"]
        folder = f"{table['path']}/deletes-{uuid.uuid4().hex}"
        positions = lineage.where("_file_id is not null").select(F.col("_file_id").alias("file_id"), F.col("_pos").alias("pos")).distinct()
        positions.write.parquet(folder)
        self._written.append(folder)
        written = self.spark.read.schema("file_id long, pos long").parquet(folder)
        counts = {r["file_id"]: r["count"] for r in written.groupBy("file_id").count().collect()}
        inlined = []
        if self.store.alive("inlined_row", snapshot, "table_id = ?", table_id):
            inlined = [r[0] for r in lineage.where("_file_id is null").select("_row_id").distinct().collect()]
        files = {f["file_id"]: f for f in self._files(table_id, snapshot)}
        _, before = self._deletions(table_id, set(counts), snapshot)
        whole = {i for i, n in counts.items() if n + before.get(i, 0) == files[i]["record_count"] and not (files[i]["snapshots"] and (files[i]["partial_max"] or 0) > snapshot)}
        rest = {i: n for i, n in counts.items() if i not in whole}
        limit = int(self.option("data_inlining_row_limit", DELETE_INLINE_LIMIT, table))
        small = [(r["file_id"], r["pos"]) for r in written.where(F.col("file_id").isin(list(rest))).collect()] if rest and sum(rest.values()) <= limit else None
        vectors = str(self.option("write_deletion_vectors", "false", table)).lower() == "true"
        sets = []  # (id, path, format, positions by file)
        if rest and small is None:
            sets = self._write_puffin(table, written, rest, files) if vectors else [(self.store.new_id(), folder, "parquet", rest)]

        def deleted(store, at):
            for i in whole:
                store.run("UPDATE data_file SET end_snapshot = ?, ended_by = 'delete' WHERE file_id = ? AND end_snapshot IS NULL", at, i)
            if small is not None:
                store.many("INSERT INTO inlined_delete VALUES (?, ?, ?, ?, NULL)", [(table_id, i, pos, at) for i, pos in small])
            for delete_id, path, kind, counted in sets:
                store.run("INSERT INTO delete_set VALUES (?, ?, ?, ?, ?, NULL)", delete_id, table_id, path, kind, at)
                store.many("INSERT INTO delete_count VALUES (?, ?, ?, ?, NULL)", [(delete_id, i, n, at) for i, n in counted.items()])
            store.many("UPDATE inlined_row SET end_snapshot = ? WHERE table_id = ? AND row_id = ? AND end_snapshot IS NULL", [(at, table_id, r) for r in inlined])

        return deleted, set(counts), sum(counts.values()) + len(inlined)

    def _write_puffin(self, table, written: DataFrame, rest: dict[int, int], files: dict) -> list[tuple]:
        """Puffin files with a deletion vector for each data file, as (id, path, format, positions by file).

        The executors encode the vectors; the driver takes them a partition at a time and begins a new file when one has
        PUFFIN_BYTES, so it holds little of a large change.
        """
        from tarn.sources import puffin

        kept = self.spark.createDataFrame([(i,) for i in rest], "file_id long")
        sets, held, size = [], [], 0

        def flush():
            nonlocal held, size
            path = f"{table['path']}/deletes-{uuid.uuid4().hex}.puffin"
            self.fs.write(path, puffin.packed(held))
            self._written.append(path)
            sets.append((self.store.new_id(), path, "puffin", {file_id: n for file_id, _, _, n in held}))
            held, size = [], 0

        for r in puffin.vectors(written.join(F.broadcast(kept), "file_id", "left_semi")).toLocalIterator():
            held.append((r["file_id"], files[r["file_id"]]["path"], bytes(r["blob"]), r["n"]))
            size += len(r["blob"])
            if size >= PUFFIN_BYTES:
                flush()
        if held:
            flush()
        return sets

    def update(self, name: str, changes: dict[str, str], where: str | None = None) -> int:
        """Set columns to SQL expressions over the old row; the number of rows. Rows keep their ids."""
        snapshot = self._now()
        table = self._table(name, snapshot)
        rows = self._scan(table["table_id"], snapshot, where, lineage=True)
        rows = rows.where(where) if where else rows
        return self._update_rows(table, rows, {k: F.expr(v) for k, v in changes.items()}, snapshot)

    def update_from(self, name: str, source: DataFrame, on: str, changes: dict[str, str]) -> int:
        """Set columns of the rows (alias t) that join with source (alias s), to expressions over both; of several joined rows of
        source one is taken."""
        snapshot = self._now()
        table = self._table(name, snapshot)
        rows = self._scan(table["table_id"], snapshot, lineage=True).alias("t").join(source.alias("s"), F.expr(on))
        nodes = columns_at(self.store, table["table_id"], snapshot)
        new = {k.lower(): F.expr(v) for k, v in changes.items()}
        for k in changes:
            fields.find(nodes, k)
        rows = rows.select(*(new.get(n["name"].lower(), F.col(f"t.`{n['name']}`")).alias(n["name"]) for n in nodes), *LINEAGE)
        first = W.partitionBy("_row_id").orderBy(*(F.col(f"`{n['name']}`") for n in nodes if n["kind"] != "map"))
        rows = rows.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")
        return self._update_rows(table, rows, {}, snapshot)

    def _update_rows(self, table, rows: DataFrame, changes: dict[str, Column], snapshot: int) -> int:
        nodes = columns_at(self.store, table["table_id"], snapshot)
        new = {k.lower(): v for k, v in changes.items()}
        for k in changes:
            fields.find(nodes, k)
        rows = rows.select(*(new.get(n["name"].lower(), F.col(f"`{n['name']}`")).alias(n["name"]) for n in nodes), *LINEAGE)
        out = rows.select(*self._physical_columns(nodes), "_row_id")
        deleted, touched, n = self._deletion(table, rows, snapshot)
        if not n:
            return 0
        inserted = self._insertion(table, nodes, out, snapshot, row_ids=True, known=n)
        self._commit([deleted, inserted], [("deleted_from_table" if touched else "inlined_delete", table["table_id"], frozenset(touched)), *self._inserted(table["table_id"], inserted)])
        return n

    @staticmethod
    def _physical_columns(nodes: list[dict]) -> list[Column]:
        return [F.col(f"`{n['name']}`").cast(fields.spark_type(n)).cast(fields.spark_type(n, physical=True)).alias(f"c{n['id']}") for n in nodes]

    def merge(self, name: str, source: DataFrame, on: str, matched: list[tuple] = (), not_matched: list[tuple] = (), not_matched_by_source: list[tuple] = ()) -> dict[str, int]:
        """MERGE source (alias s) into a table (alias t) on a condition, in one commit.

        Each clause list holds (condition or None, action): the first whose condition holds applies. Actions: "delete", "error",
        "nothing", {"column": "expression"} to update matched or unmatched-by-source rows, and for not_matched rows "insert *" or
        {"column": "expression"}. At most one clause may update or delete a row; two source rows on one are an error.
        """
        snapshot = self._now()
        table = self._table(name, snapshot)
        nodes = columns_at(self.store, table["table_id"], snapshot)
        changing = [a for c in (matched, not_matched_by_source) for _, a in c if a == "delete" or isinstance(a, dict)]
        if len(changing) > 1:
            raise LakeError("MERGE may have one UPDATE or DELETE action")
        target = self._scan(table["table_id"], snapshot, lineage=True).withColumn("_in_t", F.lit(True)).alias("t")
        both = target.join(source.withColumn("_in_s", F.lit(True)).alias("s"), F.expr(on), "full" if not_matched_by_source else "right")
        action, actions = F.lit(None).cast("int"), []
        for side, clauses in ((F.col("_in_t") & F.col("_in_s"), matched), (F.col("_in_t").isNull(), not_matched), (F.col("_in_s").isNull(), not_matched_by_source)):
            for condition, what in clauses:
                hit = side & (F.coalesce(F.expr(condition), F.lit(False)) if condition else F.lit(True))
                action = F.coalesce(action, F.when(hit, F.lit(len(actions))))
                actions.append(what)
        rows = self._cached(both.withColumn("_action", action).where("_action is not null"))
        try:
            taken = {r["_action"]: r["count"] for r in rows.groupBy("_action").count().collect()}
            for k, what in enumerate(actions):
                if what == "error" and taken.get(k):
                    raise LakeError("MERGE met a row whose action is an error")
            ops, told, done = [], [], {"inserted": 0, "updated": 0, "deleted": 0}
            change = [k for k, a in enumerate(actions) if a == "delete" or isinstance(a, dict) and (k < len(matched) or k >= len(matched) + len(not_matched))]
            if change and taken.get(change[0]):
                own = rows.where(F.col("_action") == change[0])
                if own.groupBy("_row_id").count().where("count > 1").limit(1).count():
                    raise LakeError("MERGE: several source rows match one row of the table")
                what = actions[change[0]]
                deleted, touched, n = self._deletion(table, own.select(*LINEAGE), snapshot)
                ops.append(deleted)
                told.append(("deleted_from_table" if touched else "inlined_delete", table["table_id"], frozenset(touched)))
                done["deleted" if what == "delete" else "updated"] = n
                if what != "delete":
                    new = {k.lower(): F.expr(v) for k, v in what.items()}
                    out = own.select(*(new.get(m["name"].lower(), F.col(f"t.`{m['name']}`")).cast(fields.spark_type(m)).cast(fields.spark_type(m, physical=True)).alias(f"c{m['id']}") for m in nodes), "_row_id")
                    ops.append(self._insertion(table, nodes, out, snapshot, row_ids=True, known=n))
                    told += self._inserted(table["table_id"], ops[-1])
            new_rows = None
            for k in range(len(matched), len(matched) + len(not_matched)):
                if not taken.get(k) or actions[k] in ("nothing", "error"):
                    continue
                own = rows.where(F.col("_action") == k)
                values = {c.lower(): F.col(f"s.`{c}`") for c in source.columns} if actions[k] == "insert *" else {c.lower(): F.expr(v) for c, v in actions[k].items()}
                part = self._aligned(own.select(*(v.alias(next(m["name"] for m in nodes if m["name"].lower() == c)) for c, v in values.items() if any(m["name"].lower() == c for m in nodes))), nodes)
                new_rows = part if new_rows is None else new_rows.unionAll(part)
                done["inserted"] += taken[k]
            if new_rows is not None:
                ops.append(self._insertion(table, nodes, new_rows, snapshot, known=done["inserted"]))
                told += self._inserted(table["table_id"], ops[-1])
            if ops:
                self._commit(ops, told)
            return done
        finally:
            rows.unpersist()

    def _cached(self, rows: DataFrame) -> DataFrame:
        """A join that several writes read; kept on disk so that it is not run again (a lost part is computed anew)."""
        from pyspark import StorageLevel

        return rows.persist(StorageLevel.DISK_ONLY)
