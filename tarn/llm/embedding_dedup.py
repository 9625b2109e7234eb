"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors within cosine c lie within epsilon = sqrt(2 - 2 c) of each other, and no further apart after rotation to the
principal axes of the data. Vectors are sorted by their grid cells (epsilon wide) on the leading axes and cut into sequence
intervals. Each interval, and each run of intervals up to the whole sequence, has a bounding box on the leading axes; pairs
of runs are split recursively from the top, and a pair whose boxes are further apart than epsilon is dropped with all in it.
What is left are pairs of intervals. They are dealt to tasks by pairs of neighbourhoods of a few intervals, so that an interval
travels once for each neighbourhood it meets, and joined exactly in double precision, in sub-blocks with boxes of their own.

Equal vectors are one class with a count, so copies cost nothing more than one vector.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import common as C

LEAD = 8
SORTED = 3  # axes whose cells are sorted by
INTERVAL = 2_048
NEIGHBOURS = 4  # intervals that are dealt together
SUB = 512
SLACK = 1e-9


def _vectors(blobs, kind, dims) -> np.ndarray:
    """Unit vectors in double precision."""
    x = np.frombuffer(b"".join(blobs), kind).reshape(-1, dims).astype(np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _prepared(kind):
    """(id, cid, dims, blob): cid and blob are null for vectors that link with nothing."""

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            blobs, dims = [], []
            values = lists.flatten()
            ends = lists.offsets.to_numpy()
            ends = ends - ends[0] if len(ends) else ends
            flat = np.asarray(values.to_numpy(zero_copy_only=False), kind)
            fine = np.isfinite(flat)  # a null component reads as NaN
            bad = np.concatenate(([0], np.cumsum(~fine)))
            square = np.concatenate(([0], np.cumsum(np.where(fine, np.abs(flat) > 0, False))))
            at = 0
            for i in range(len(lists)):
                if not lists[i].is_valid:
                    blobs.append(None)
                    dims.append(0)
                    continue
                n = len(lists[i])
                a, b = at, at + n
                at = b
                ok = n > 0 and bad[b] == bad[a] and square[b] > square[a]
                x = flat[a:b] + kind(0)  # -0.0 and 0.0 are one value
                blobs.append(x.tobytes() if ok and np.isfinite(1 / np.sqrt((x.astype(np.float64) ** 2).sum())) else None)
                dims.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary()), pa.array(dims, pa.int64())], names=["id", "blob", "dims"])

    return run


def _moments(kind, dims):
    """Per task the sum of outer products of the unit vectors."""

    def run(batches):
        from pyspark import TaskContext

        total = np.zeros((dims, dims))
        for batch in batches:
            x = _vectors(batch.column(0).to_pylist(), kind, dims)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 32]), pa.array([total.tobytes()], pa.binary())], names=["g", "m"])

    return run


def principal_axes(classes: DataFrame, kind, dims: int, lead: int) -> np.ndarray:
    """The leading axes (dims x lead) of all unit vectors: sums per task, summed in 32 groups, then on the driver."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float64) for x in table["m"].to_pylist())
        return pa.table([pa.array([total.tobytes()], pa.binary())], names=["m"])

    sums = classes.select("blob").mapInArrow(_moments(kind, dims), "g long, m binary").groupBy("g").applyInArrow(add, "m binary").collect()
    total = sum((np.frombuffer(r[0], np.float64) for r in sums), np.zeros(dims * dims)).reshape(dims, dims)
    return np.linalg.eigh(total)[1][:, ::-1][:, :lead].copy()


def _cells(kind, dims, axes, epsilon):
    def run(batches):
        for batch in batches:
            x = _vectors(batch.column(0).to_pylist(), kind, dims) @ axes
            cells = np.floor(x[:, :SORTED] / epsilon).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *(pa.array(cells[:, k]) for k in range(cells.shape[1])), pa.array(x[:, 0])], names=["blob", "cid", "n", *(f"c{k}" for k in range(cells.shape[1])), "y"])

    return run


def _intervals(kind, dims, axes, size):
    """Sorted rows to intervals: block, part, box, classes, counts, vectors."""

    def run(batches):
        from pyspark import TaskContext

        part, nth, kept = TaskContext.get().partitionId(), 0, []

        def interval(rows):
            nonlocal nth
            y = _vectors([r[0] for r in rows], kind, dims) @ axes
            nth += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 24 | nth]), pa.array([part]), pa.array([y.min(0).tolist()], pa.list_(pa.float64())), pa.array([y.max(0).tolist()], pa.list_(pa.float64())), pa.array([np.array([r[1] for r in rows], np.int64).tobytes()], pa.binary()), pa.array([np.array([r[2] for r in rows], np.int64).tobytes()], pa.binary()), pa.array([b"".join(r[0] for r in rows)], pa.binary())],
                names=["block", "part", "lo", "hi", "cids", "counts", "vectors"],
            )

        for batch in batches:
            kept += zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True)
            while len(kept) >= size:
                yield interval(kept[:size])
                kept = kept[size:]
        if kept:
            yield interval(kept)

    return run


def near_pairs(boxes: DataFrame, epsilon: float, parts: int) -> DataFrame:
    """(a, b) of all intervals whose boxes (block, part, lo, hi) are within epsilon, by splitting pairs of runs from the top.

    Above the intervals stand the parts, then runs of 8 parts, of 64 and so on to one; each level joins the children of
    the pairs that the level above has left.
    """
    levels = [boxes.select(F.col("block").alias("node"), F.col("part").alias("parent"), "lo", "hi")]
    span, width = parts, 0
    dims = len(boxes.first()["lo"])

    def merged(df, parent):
        lows, highs = [F.min(F.col("lo")[i]).alias(f"l{i}") for i in range(dims)], [F.max(F.col("hi")[i]).alias(f"h{i}") for i in range(dims)]
        out = df.groupBy(F.col("parent").alias("node")).agg(*lows, *highs)
        return out.select("node", parent.alias("parent"), F.array(*(f"l{i}" for i in range(dims))).alias("lo"), F.array(*(f"h{i}" for i in range(dims))).alias("hi"))

    while span > 1 or width == 0:
        levels.append(merged(levels[-1], F.shiftright("node", 3)))
        span, width = -(-span // 8), width + 1
    levels[-1] = levels[-1].withColumn("parent", F.lit(0).cast("long"))
    pairs = boxes.sparkSession.range(1).select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    gap = F.aggregate(F.arrays_zip(F.col("x.lo").alias("alo"), F.col("x.hi").alias("ahi"), F.col("z.lo").alias("blo"), F.col("z.hi").alias("bhi")), F.lit(0.0), lambda s, d: s + F.pow(F.greatest(F.lit(0.0), d["alo"] - d["bhi"], d["blo"] - d["ahi"]), F.lit(2.0)))
    for level in reversed(levels):
        x, z = level.alias("x"), level.alias("z")
        below = pairs.join(x, F.col("a") == F.col("x.parent")).join(z, (F.col("b") == F.col("z.parent")) & (F.col("x.node") <= F.col("z.node")))
        pairs = below.where(gap <= (epsilon + SLACK) ** 2).select(F.col("x.node").alias("a"), F.col("z.node").alias("b"))
        pairs = C.materialise(pairs, "pairs")
    return pairs


def join_blocks(x: np.ndarray, y: np.ndarray, same: bool, least: float, axes: np.ndarray, nx: np.ndarray, ny: np.ndarray):
    """Links of two blocks of unit vectors: links of each row of x and of y (weighted by counts) and labels that join linked
    rows (x first, then y). Sub-blocks with boxes further apart than epsilon are skipped."""
    epsilon = np.sqrt(2 - 2 * least) + SLACK
    cx, cy = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    label = np.arange(len(x)) if same else np.arange(len(x) + len(y))
    shift = 0 if same else len(x)
    px, py = x @ axes, y @ axes
    boxes = [(j, py[j : j + SUB].min(0), py[j : j + SUB].max(0)) for j in range(0, len(y), SUB)]
    for i in range(0, len(x), SUB):
        lo, hi = px[i : i + SUB].min(0), px[i : i + SUB].max(0)
        for j, blo, bhi in boxes:
            if same and j < i:
                continue
            gap = np.maximum(0, np.maximum(lo - bhi, blo - hi))
            if (gap * gap).sum() > epsilon * epsilon:
                continue
            near = x[i : i + SUB] @ y[j : j + SUB].T >= least
            if same and i == j:
                np.fill_diagonal(near, False)
            if not near.any():
                continue
            cx[i : i + SUB] += near @ ny[j : j + SUB]
            if not (same and i == j):
                cy[j : j + SUB] += nx[i : i + SUB] @ near
            for r in np.flatnonzero(near.any(1)):
                at = np.append(np.flatnonzero(near[r]) + j + shift, i + r)
                old = np.unique(label[at])
                if len(old) > 1:
                    label[np.isin(label, old)] = old[0]
    if same:
        cx += cy
    return cx, cy, label


def _joined(kind, dims, axes, least):
    """Two neighbourhoods of intervals (or one with itself): the links of all their pairs of intervals."""

    def run(table: pa.Table) -> pa.Table:
        a, b = table["a"][0].as_py(), table["b"][0].as_py()
        blocks = []
        for r in table.select(["block", "part", "cids", "counts", "vectors"]).to_pylist():
            blocks.append((r["part"], r["block"], np.frombuffer(r["cids"], np.int64), np.frombuffer(r["counts"], np.int64), _vectors([r["vectors"]], kind, dims)))
        blocks.sort(key=lambda x: x[:2])
        cids, tos, links = [], [], []
        for part, block, x_ids, x_counts, x in blocks:
            if part != a:
                continue
            for other, other_block, y_ids, y_counts, y in blocks:
                if other != b or (a == b and other_block < block):
                    continue
                same = other_block == block
                cx, cy, label = join_blocks(x, y, same, least, axes, x_counts, y_counts)
                every = x_ids if same else np.concatenate([x_ids, y_ids])
                n = cx if same else np.concatenate([cx, cy])
                moved, have = np.flatnonzero(label != np.arange(len(label))), np.flatnonzero(n)
                cids += [every[have], every[moved]]
                tos += [*[None] * len(have), *every[label[moved]].tolist()]
                links += [n[have], np.zeros(len(moved), np.int64)]
        none = [np.zeros(0, np.int64)]
        return pa.table([pa.array(np.concatenate(cids or none)), pa.array(tos, pa.int64()), pa.array(np.concatenate(links or none))], names=["cid", "to", "n"])

    return run


def join_embeddings(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, lead: int = LEAD, interval: int = INTERVAL) -> DataFrame:
    """One row for each row of vectors: id, n_links, component_id, kept.

    Rows link when their cosine, in double precision, is at least `least`. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, vectors of different lengths not with each other. n_links counts other rows;
    component_id is the smallest id reachable by links, itself included; kept: the id is its component's. A null id is the
    smallest only where there is no other. Repeated rows link like others. Other columns are not read; no rows give none.
    """
    spark = vectors.sparkSession
    C.bound_batches(spark)
    kind = np.float32 if vectors.schema[vector_col].dataType.elementType.simpleString() == "float" else np.float64
    element = "array<float>" if kind is np.float32 else "array<double>"
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(element).alias("v"))
    rows = source.mapInArrow(_prepared(kind), "id long, blob binary, dims long").withColumn("cid", F.when(F.col("blob").isNotNull(), F.xxhash64("blob")))
    classes = C.materialise(rows.where("blob is not null").groupBy("cid", "blob", "dims").agg(F.count("*").alias("n")), "classes")
    found = None
    for (dims,) in classes.select("dims").distinct().orderBy("dims").collect():
        part = _join_dims(classes.where(F.col("dims") == dims).select("blob", "cid", "n"), kind, dims, least, min(lead, dims), interval)
        found = part if found is None else found.unionAll(part)
    members = C.materialise(rows.select("id", "cid"), "members")
    alone = members.where("cid is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if found is None:
        out = alone
    else:
        links = found.groupBy("cid").agg(F.sum("n").alias("links"))
        comps = C.connected_components(found.where("to is not null").select(F.col("cid").alias("a"), F.col("to").alias("b")), "components").select(F.col("node").alias("cid"), "comp")
        sizes = members.where("cid is not null").groupBy("cid").agg(F.min("id").alias("least"), F.count("*").alias("own"))
        labels = sizes.join(comps, "cid", "left").join(links, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
        labels = C.materialise(labels, "labels")
        labels = labels.join(labels.groupBy("comp").agg(F.min("least").alias("component_id")), "comp")
        out = members.join(labels.select("cid", (F.coalesce("links", F.lit(0)) + F.col("own") - 1).alias("n_links"), "component_id"), "cid").select("id", "n_links", "component_id").unionAll(alone)
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))).withColumnRenamed("id", id_col)


def _join_dims(classes: DataFrame, kind, dims: int, least: float, lead: int, interval: int) -> DataFrame:
    """(cid, to, n): per class partial numbers of links (to null), and links enough to join each component."""
    epsilon = float(np.sqrt(2 - 2 * least))
    axes = principal_axes(classes, kind, dims, lead)
    cells = [f"c{k}" for k in range(min(SORTED, lead))]
    keyed = classes.mapInArrow(_cells(kind, dims, axes, epsilon), "blob binary, cid long, n long, " + "".join(f"{c} long, " for c in cells) + "y double")
    parts = C.parts_for(classes.count(), NEIGHBOURS * interval, least=1)
    ordered = keyed.repartitionByRange(parts, *cells, "y", "cid").sortWithinPartitions(*cells, "y", "cid")
    blocks = C.materialise(ordered.mapInArrow(_intervals(kind, dims, axes, interval), "block long, part long, lo array<double>, hi array<double>, cids binary, counts binary, vectors binary"), "intervals", few=False)
    pairs = near_pairs(blocks.select("block", "part", "lo", "hi"), epsilon, parts)
    # Neighbourhoods (parts) that hold a pair within epsilon meet; join_blocks() skips the other pairs of theirs by their boxes.
    tiles = C.materialise(pairs.select(F.shiftright("a", 24).alias("a"), F.shiftright("b", 24).alias("b")).distinct(), "tiles")
    sides = tiles.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("part"))
    met = sides.join(blocks.select("part", "block", "cids", "counts", "vectors"), "part")
    # They are dealt one by one: hashing few of them would leave tasks with several and others with none.
    met = met.repartition(C.parts_for(tiles.count(), 1, least=1, most=4_000), "a", "b")
    return C.materialise(met.groupBy("a", "b").applyInArrow(_joined(kind, dims, axes, least), "cid long, to long, n long"), "links", few=False)
