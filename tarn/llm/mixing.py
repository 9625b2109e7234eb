"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

A source's target over its size is how often each of its documents is to be copied: a whole number of copies and a fractional
probability, the same for all. Fractions are settled in pairs: of two documents, mass (probability times size) moves at
random from one to the other until one of them is 0 or 1, with chances that keep every document's expectation; the other
carries the rest on to the next. The mass of a source thus stays as it is until one fractional document is left, so the words
taken differ from the target by at most half a document. Documents are settled in small groups first; what each group leaves
over meets others on the next level of a tree, so no group grows with its source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.llm import common as C

GROUP = 32
RUN = 4096
TOP = 3  # no source and no document is taken more often
EPSILON = 1e-9


def words(text: Column) -> Column:
    """The number of runs of characters other than blank and control white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """sources (source, source_size) with weight and target.

    Sources by code point, null last, weigh 1, 2, 3, repeating. Shares of all sizes by weight are held at TOP times the
    source's size; what exceeds goes to the others by weight, again and again: the level L at which sum(min(TOP * size, L *
    weight)) is all sizes. One row a source: windows without a partition run over the sources, never over documents.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    s = sources.withColumn("weight", (F.pmod(F.row_number().over(order) - 1, F.lit(3)) + 1).cast("double"))
    s = s.withColumn("most", F.col("source_size") * F.lit(float(TOP))).withColumn("at", F.col("most") / F.col("weight"))
    level = W.orderBy("at", F.col("source").asc_nulls_last())
    every = W.partitionBy()
    s = (
        s.withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("held", F.coalesce(F.sum("most").over(level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("free", F.sum("weight").over(level.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("held")) / F.col("free"))
        # The sources below the level are held: the first that is not gives the level.
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("at"), F.struct("at", "held", "level"))).over(every)["level"])
    )
    return s.select("source", "source_size", "weight", F.least("most", F.coalesce(F.col("level"), F.col("at")) * F.col("weight")).alias("target"))


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on nothing but the parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def _settle(items: Column, seed: int, level: int) -> Column:
    """Fold an array of (id, p, size) pairwise: a struct of those settled (id, up) and the one left (id, p, size), or null."""
    item = "struct<id:bigint,p:double,size:bigint>"
    start = F.struct(F.lit(None).cast(item).alias("left"), F.expr("cast(array() as array<struct<id:bigint,up:boolean>>)").alias("done"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["left"]
        wa, wb = a["size"].cast("double"), x["size"].cast("double")
        # Mass up to which a can rise while x falls, and the other way about.
        rise = F.least((1 - a["p"]) * wa, x["p"] * wb)
        fall = F.least(a["p"] * wa, (1 - x["p"]) * wb)
        up = _uniform(F.lit(seed), F.lit(level), a["id"], x["id"]) * (rise + fall) < fall
        moved = F.when(up, rise).otherwise(-fall)
        pa, pb = a["p"] + moved / wa, x["p"] - moved / wb
        # The one whose room gave out is settled exactly; rounding must not leave both.
        first = F.when(up, (1 - a["p"]) * wa <= x["p"] * wb).otherwise(a["p"] * wa <= (1 - x["p"]) * wb)
        up_of = F.when(first, up).otherwise(~up)
        done = F.struct(F.when(first, a["id"]).otherwise(x["id"]).alias("id"), up_of.alias("up"))
        rest = F.struct(
            F.when(first, x["id"]).otherwise(a["id"]).alias("id"),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(first, pb).otherwise(pa))).alias("p"),
            F.when(first, x["size"]).otherwise(a["size"]).alias("size"),
        )
        return F.when(a.isNull(), F.struct(x.cast(item).alias("left"), acc["done"].alias("done"))).otherwise(
            F.struct(rest.cast(item).alias("left"), F.concat(acc["done"], F.array(done)).alias("done"))
        )

    return F.aggregate(items, start, step)


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 17, group: int = GROUP) -> DataFrame:
    """One row for each row of docs: id, source, size, source_size, target (its source's), copies, taken (copies * size).

    Sizes are numbers of words. Documents without words (null text too) are taken 0 times. Reruns agree: chances depend on
    the seed, ids and sizes only. Repeated rows are told apart by a running number, so each is settled by itself; null ids and
    null sources are values like others. Other columns are not read. An empty table gives no rows.
    """
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"))
    # Rows that agree in all of this are one row with a count until they are told apart.
    counted = sized.groupBy("id", "source", "size").agg(F.count("*").alias("rows"))
    counted = C.materialise(counted, "sizes")
    sources = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum("rows").alias("n"))
    sources = C.materialise(targets(sources).join(sources.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "targets")
    # Counted up in runs of RUN, so that no array grows with the number of equal rows but one of its RUN-th part.
    rows = counted.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(rows - 1) div {RUN}"))))
    rows = rows.withColumn("nth", F.explode(F.sequence(F.col("run") * RUN + 1, F.least("rows", (F.col("run") + 1) * RUN)))).drop("rows", "run")
    rows = rows.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("key", F.xxhash64("id", "source", "size", "nth")).withColumn("rate", rate)
    rows = rows.withColumn("whole", F.floor(F.col("rate") + EPSILON)).withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")))
    rows = C.materialise(rows.withColumn("p", F.when((F.col("size") > 0) & (F.col("p") > EPSILON), F.col("p"))), "rows")
    open_ = rows.where("p is not null").select(F.col("source").alias("s"), F.col("key").alias("id"), "p", "size", "n")
    most = open_.groupBy("s").count().agg(F.max("count")).first()[0] or 0
    settled = None
    level = 0
    while most:
        # Groups by hash hold `group` items on average; the next level has a group-th of the items.
        last = most <= group
        buckets = F.lit(0).cast("long") if last else F.pmod(F.xxhash64(F.lit(level), "id"), F.ceil(F.col("n") / group))
        grouped = open_.groupBy("s", buckets.alias("g")).agg(F.sort_array(F.collect_list(F.struct("id", "p", "size"))).alias("items"), F.max("n").alias("n"))
        folded = C.materialise(grouped.select("s", "n", _settle(F.col("items"), seed, level).alias("x")), "settled")
        done = folded.select(F.explode("x.done").alias("d")).select(F.col("d.id").alias("key"), F.col("d.up").alias("up"))
        left = folded.where("x.left is not null").select("s", "x.left.*", F.ceil(F.col("n") / group).alias("n"))
        settled = done if settled is None else settled.unionAll(done)
        if last:
            # The one document that a source has left over goes to the nearer side: at most half its size from the target.
            end = left.select(F.col("id").alias("key"), (F.col("p") >= 0.5).alias("up"))
            settled = settled.unionAll(end)
            break
        open_, level = left, level + 1
        most = open_.groupBy("s").count().agg(F.max("count")).first()[0] or 0
    out = rows.withColumn("up", F.lit(False)) if settled is None else rows.join(settled, "key", "left")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.when(F.col("up"), 1).otherwise(0)).otherwise(0).cast("long")
    return out.withColumn("copies", copies).select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def repeat(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 17) -> DataFrame:
    """docs with each row as many times as mix() takes it, 0 times too.

    Repeated rows that share id, source and size are dealt their copies one after the other. Columns and values stay.
    """
    of, to, copies, rows, n, k = (C.unused(docs, x) for x in ("_of", "_to", "_copies", "_rows", "_n", "_k"))
    mixed = mix(docs, id_col, source_col, text_col, seed)
    key = F.struct(F.col(id_col), F.col(source_col), F.col("size"))
    took = C.materialise(mixed.groupBy(key.alias(to)).agg(F.sum("copies").alias(copies), F.count("*").alias(rows)), "taken")
    source, size = F.col(f"`{source_col}`").cast("string").alias(source_col), words(F.col(f"`{text_col}`")).alias("size")
    keyed = docs.withColumn(of, F.struct(F.col(f"`{id_col}`").alias(id_col), source, size))
    joined = keyed.join(took, F.col(of).eqNullSafe(F.col(to)))
    every = joined.where(F.col(rows) == 1).withColumn(n, F.col(copies))
    if not took.where(F.col(rows) > 1).isEmpty():
        every = every.unionByName(_dealt(joined.where(F.col(rows) > 1), of, copies, rows, n))
    every = every.where(F.col(n) > 0).withColumn(k, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n).cast("long"))))
    return every.select(*(f"`{c}`" for c in docs.columns))


def _dealt(several: DataFrame, of: str, copies: str, rows: str, n: str) -> DataFrame:
    """Rows of which several share the key `of`, with the copies n of each: its `copies` by its `rows`, one more for the first.

    Rows are numbered in runs of a written table, so that a key of very many rows is not numbered by one task.
    """
    run, at, first, i, of_it, run_of_it = (C.unused(several, x) for x in ("_run", "_at", "_first", "_i", "_of_it", "_run_of_it"))
    placed = C.materialise(several, "repeated")
    placed = placed.withColumn(at, F.col("_metadata.row_index")).withColumn(run, F.xxhash64(F.col("_metadata.file_path"), F.expr(f"_metadata.row_index div {RUN}")))
    counted = placed.groupBy(of, run).agg(F.count("*").alias(i))
    before = F.coalesce(F.sum(i).over(W.partitionBy(of).orderBy(run).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counted = counted.withColumn(first, before).select(F.col(of).alias(of_it), F.col(run).alias(run_of_it), first)
    met = placed.join(counted, F.col(of).eqNullSafe(F.col(of_it)) & (F.col(run) == F.col(run_of_it))).drop(of_it, run_of_it)
    met = met.withColumn(i, F.col(first) + F.row_number().over(W.partitionBy(of, run).orderBy(at)))
    return met.withColumn(n, F.floor(F.col(copies) / F.col(rows)) + F.when(F.col(i) <= F.pmod(copies, rows), 1).otherwise(0)).drop(run, at, first, i)
