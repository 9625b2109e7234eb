"""Following a change feed: a table in another lake is kept equal, one commit for each window of snapshots.

The source's snapshot reached is written in the target's commit message, so a window that was applied is not applied again.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.lake import Lake


def reached(target: Lake, name: str) -> int:
    """The last snapshot of the source that the target holds, -1 at first."""
    rows = target.store.rows("SELECT commit_extra_info FROM snapshot_changes WHERE commit_message = ? ORDER BY snapshot_id DESC LIMIT 1", f"replica of {name}")
    return int(rows[0][0]) if rows else -1


def follow(source: Lake, name: str, target: Lake, to: str, since: int | None = None) -> int:
    """Apply all changes of the source's table after a snapshot (by default the last applied) to the target; the new one.

    Rows are matched by a column of row ids that the target table gets once.
    """
    last = reached(target, name) if since is None else since
    now = source._now()
    if now <= last:
        return last
    first = source.store.one("SELECT min(snapshot_id) FROM snapshot WHERE snapshot_id > ?", last)[0]
    changes = source.changes(name, first, now)
    # Of several changes of one row in the window only the last state counts.
    state = changes.where("change_type <> 'update_preimage'").withColumn("rank", F.struct("snapshot_id", (F.col("change_type") == "delete").cast("int")))
    columns = [c for c in changes.columns if c not in ("snapshot_id", "rowid", "change_type")]
    top = state.groupBy("rowid").agg(F.max_by(F.struct("change_type", *columns), "rank").alias("s")).select("rowid", "s.*")
    top = source._cached(top)
    try:
        with target.transaction():
            if not any(c.lower() == "source_row_id" for c in target.table(to).columns):
                target.add_column(to, "source_row_id", "bigint")
            target.delete_using(to, top.select("rowid"), "t.source_row_id = s.rowid")
            target.insert(to, top.where("change_type <> 'delete'").select(*columns, F.col("rowid").alias("source_row_id")))
            target.set_commit_message(None, f"replica of {name}", str(now))
    finally:
        top.unpersist()
    return now


def poll(source: Lake, name: str, target: Lake, to: str, rounds: int, wait_s: float = 1.0) -> int:
    """follow() again and again; the last snapshot reached."""
    import time

    last = reached(target, name)
    for k in range(rounds):
        last = follow(source, name, target, to)
        if k + 1 < rounds:
            time.sleep(wait_s)
    return last
