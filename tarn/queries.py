"""The lake's queries over the sf tables, and the SQL that gives the same rows. Each builds its own lake."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.errors import ConflictError, LakeError
from tarn.lake import Lake

QUERIES: dict = {}
SQL: dict[str, str] = {}


@functools.cache
def _folder() -> str:
    path = tempfile.mkdtemp(prefix="tarn-lakes-")
    atexit.register(shutil.rmtree, path, True)
    return path


def new_lake(spark: SparkSession, **options) -> Lake:
    """An empty lake: data where the cluster shares files, metadata with the driver."""
    name = uuid.uuid4().hex
    shared = spark.conf.get("spark.checkpoint.dir", None) or f"file://{_folder()}"
    return Lake(spark, f"{_folder()}/{name}.db", f"{shared.rstrip('/')}/lakes/{name}", **{"data_inlining_row_limit": 0, **options})


def source(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def attached(spark: SparkSession, sf_dir: str, *tables: str) -> Lake:
    """A lake over the tables' own files: registered, not copied."""
    lake = new_lake(spark)
    for t in tables:
        lake.create_table(t, source(spark, sf_dir, t).schema)
        lake.add_data_files(t, [f for f, _, _ in lake.fs.walk(f"{sf_dir}/{t}.parquet") if f.endswith(".parquet")], hive_partitioning=False)
    return lake


def query(sql: str | None):
    """Register a function as a query under its name, with the SQL for its rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def relational(name: str, tables: str, sql: str, oracle: str | None = None) -> None:
    """Register SQL over registered tables, the same in both engines unless an oracle is given."""

    def run(spark, sf_dir):
        return attached(spark, sf_dir, *tables.split()).sql(sql)

    run.__name__ = name
    query(oracle or sql)(run)


def _orders(spark, sf_dir, **options) -> Lake:
    lake = new_lake(spark, **options)
    lake.create_table_as("orders", source(spark, sf_dir, "orders"))
    return lake


# --- scans, versions --------------------------------------------------------------------------------------------------

_Q1 = """SELECT l_returnflag, l_linestatus, CAST(round(sum(l_quantity), 2) AS DOUBLE) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
    CAST(round(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))), 2) AS DOUBLE) AS sum_disc_price, round(CAST(sum(CAST(l_discount AS DECIMAL(4, 2))) AS DOUBLE) / count(*), 6) AS avg_disc, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus"""


@query(_Q1)
def scan_filter_agg(spark, sf_dir):
    lake = new_lake(spark)
    lake.create_table_as("lineitem", source(spark, sf_dir, "lineitem"), partitioned_by=["epoch_year(l_shipdate)"])
    kept = lake.table("lineitem", where="l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")
    return kept.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
        F.round(F.sum(F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))), 2).cast("double").alias("sum_disc_price"),
        F.round(F.sum(F.col("l_discount").cast("decimal(4,2)")).cast("double") / F.count("*"), 6).alias("avg_disc"),
        F.count("*").alias("count_order"),
    )


@query("SELECT * FROM orders")
def time_travel_version(spark, sf_dir):
    lake = _orders(spark, sf_dir)
    before = lake._now()
    lake.delete("orders", "o_orderkey % 3 = 0")
    return lake.table("orders", version=before)


@query("SELECT * FROM orders")
def time_travel_timestamp(spark, sf_dir):
    lake = _orders(spark, sf_dir)
    at = lake.store.current()["snapshot_time"]
    lake.update("orders", {"o_totalprice": "0"}, "o_orderstatus = 'O'")
    return lake.table("orders", timestamp=at)


@query("SELECT * FROM orders")
def pinned_catalog(spark, sf_dir):
    lake = _orders(spark, sf_dir)
    before = lake._now()
    lake.truncate("orders")
    return Lake(spark, lake.store.path, snapshot_version=before).table("orders")


@query("SELECT o_orderkey, r AS rowid, CAST(1 + r // 500 AS BIGINT) AS snapshot_id, r % 500 AS file_row_number, true AS named, r // 500 AS file_index FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) WHERE r < 1500")
def virtual_columns(spark, sf_dir):
    """Three inserts of 500 rows, each a file: the engine's own ids, snapshots, places and files."""
    lake = new_lake(spark)
    rows = source(spark, sf_dir, "orders")
    lake.create_table("orders", rows.schema)
    first = rows.orderBy("o_orderkey").limit(1500).collect()
    for k in range(0, 1500, 500):
        lake.insert("orders", spark.createDataFrame(first[k : k + 500], rows.schema).coalesce(1))
    names = {r["data_file"] for r in lake.list_files("orders").collect()}
    out = lake.table("orders", virtual=True).withColumn("named", F.col("filename").isin(list(names)))
    return out.select("o_orderkey", "rowid", (F.col("snapshot_id") - 1).alias("snapshot_id"), "file_row_number", "named", "file_index")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rowid FROM orders WHERE o_orderkey % 4 <> 0")
def virtual_columns_after_update(spark, sf_dir):
    """Row ids stand through updates, deletions and a merge of files."""
    lake, rows = new_lake(spark), source(spark, sf_dir, "orders")
    lake.create_table("orders", rows.schema, sorted_by=["o_orderkey"])
    kept = rows.where("o_orderkey % 4 <> 0").coalesce(1)
    lake.insert("orders", kept)
    lake.insert("orders", rows.where("o_orderkey % 4 = 0"))
    lake.update("orders", {"o_totalprice": "0"}, "o_orderkey % 3 = 0")
    lake.delete("orders", "o_orderkey % 4 = 0")
    lake.merge_adjacent_files("orders")
    return lake.table("orders", virtual=True).select("o_orderkey", "rowid")


# --- row-level changes ------------------------------------------------------------------------------------------------


@query("SELECT * FROM orders WHERE NOT (o_orderkey % 3 = 0)")
def delete_rows(spark, sf_dir):
    lake = _orders(spark, sf_dir)
    lake.delete("orders", "o_orderkey % 3 = 0")
    return lake.table("orders")


@query("SELECT * FROM orders WHERE NOT (o_orderkey % 3 = 0) AND o_totalprice <= 200000")
def deletion_vectors(spark, sf_dir):
    lake = _orders(spark, sf_dir, write_deletion_vectors=True)
    lake.delete("orders", "o_orderkey % 3 = 0")
    lake.delete("orders", "o_totalprice > 200000")
    return lake.table("orders")


@query("SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def delete_using(spark, sf_dir):
    lake = _orders(spark, sf_dir)
    lake.delete_using("orders", source(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'"), "t.o_custkey = s.c_custkey")
    return lake.table("orders")


@query("SELECT * FROM orders WHERE false")
def truncate(spark, sf_dir):
    lake = _orders(spark, sf_dir)
    lake.truncate("orders")
    return lake.table("orders")


@query("SELECT * REPLACE (CASE WHEN o_orderstatus = 'F' THEN round(o_totalprice * 2, 2) ELSE o_totalprice END AS o_totalprice) FROM orders")
def update_rows(spark, sf_dir):
    lake = _orders(spark, sf_dir)
    lake.update("orders", {"o_totalprice": "round(o_totalprice * 2, 2)"}, "o_orderstatus = 'F'")
    return lake.table("orders")


@query("SELECT o.* REPLACE (coalesce(c.c_mktsegment, o_orderpriority) AS o_orderpriority) FROM orders o LEFT JOIN customer c ON o_custkey = c_custkey AND c_nationkey < 5")
def update_from(spark, sf_dir):
    lake = _orders(spark, sf_dir)
    lake.update_from("orders", source(spark, sf_dir, "customer"), "t.o_custkey = s.c_custkey AND s.c_nationkey < 5", {"o_orderpriority": "s.c_mktsegment"})
    return lake.table("orders")


@query("SELECT count(*) AS n, CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS ids, count(*) AS same FROM orders")
def update_row_lineage(spark, sf_dir):
    lake = _orders(spark, sf_dir)
    before = lake._now()
    lake.update("orders", {"o_totalprice": "o_totalprice + 1"}, "o_orderkey % 2 = 0")
    old = lake.table("orders", version=before, lineage=True).select(F.col("o_orderkey").alias("k"), F.col("_row_id").alias("r"))
    now = lake.table("orders", lineage=True)
    return now.join(old, (F.col("o_orderkey") == F.col("k")) & (F.col("_row_id") == F.col("r")), "left").agg(F.count("*").alias("n"), F.sum("_row_id").alias("ids"), F.count("r").alias("same"))


def _shifted(spark, sf_dir):
    """Orders again under keys of which half are new."""
    o = source(spark, sf_dir, "orders")
    most = o.agg(F.max("o_orderkey")).first()[0]
    return o.withColumn("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")).otherwise(F.col("o_orderkey") + most + 1)).withColumn("o_totalprice", F.col("o_totalprice") + 1)


_SHIFTED = "SELECT * REPLACE (CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE o_orderkey + (SELECT max(o_orderkey) FROM orders) + 1 END AS o_orderkey, o_totalprice + 1 AS o_totalprice) FROM orders"


@query(f"WITH s AS ({_SHIFTED}) SELECT * FROM s UNION ALL SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM s)")
def merge_upsert(spark, sf_dir):
    lake = _orders(spark, sf_dir)
    columns = [c for c in source(spark, sf_dir, "orders").columns]
    lake.merge("orders", _shifted(spark, sf_dir), "t.o_orderkey = s.o_orderkey", matched=[(None, {c: f"s.{c}" for c in columns})], not_matched=[(None, "insert *")])
    return lake.table("orders")


@query(f"WITH s AS ({_SHIFTED}) SELECT * FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM s) OR o_totalprice <= 100000 UNION ALL SELECT * FROM s WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders) AND o_orderstatus = 'O'")
def merge_by_source_delete(spark, sf_dir):
    lake = _orders(spark, sf_dir)
    lake.merge("orders", _shifted(spark, sf_dir), "t.o_orderkey = s.o_orderkey", not_matched=[("s.o_orderstatus = 'O'", "insert *")], not_matched_by_source=[("t.o_totalprice > 100000", "delete")])
    return lake.table("orders")


# --- change feed ------------------------------------------------------------------------------------------------------


def _history(spark, sf_dir):
    lake = _orders(spark, sf_dir)
    lake.update("orders", {"o_orderstatus": "'X'"}, "o_orderkey % 5 = 0")
    lake.delete("orders", "o_orderkey % 7 = 0")
    lake.insert("orders", source(spark, sf_dir, "orders").where("o_totalprice > 300000").withColumn("o_orderkey", -F.col("o_orderkey") - 1))
    return lake


_BORN = "SELECT CAST(1 AS BIGINT) AS snapshot_id, o_orderkey, o_orderstatus FROM orders UNION ALL SELECT 2, o_orderkey, 'X' FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT 4, -o_orderkey - 1, o_orderstatus FROM orders WHERE o_totalprice > 300000"
_DIED = "SELECT CAST(2 AS BIGINT) AS snapshot_id, o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT 3, o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END FROM orders WHERE o_orderkey % 7 = 0"


@query(_BORN)
def table_insertions(spark, sf_dir):
    return _history(spark, sf_dir).insertions("orders", 0, 4).select("snapshot_id", "o_orderkey", "o_orderstatus")


@query(_DIED)
def table_deletions(spark, sf_dir):
    return _history(spark, sf_dir).deletions("orders", 0, 4).select("snapshot_id", "o_orderkey", "o_orderstatus")


@query(f"SELECT *, CASE WHEN snapshot_id = 2 THEN 'update_postimage' ELSE 'insert' END AS change_type FROM ({_BORN}) UNION ALL SELECT *, CASE WHEN snapshot_id = 2 THEN 'update_preimage' ELSE 'delete' END FROM ({_DIED})")
def table_changes(spark, sf_dir):
    return _history(spark, sf_dir).changes("orders", 0, 4).select("snapshot_id", "o_orderkey", "o_orderstatus", "change_type")


@query(f"SELECT * FROM ({_DIED}) WHERE snapshot_id = 3")
def changes_after_merge(spark, sf_dir):
    lake = _history(spark, sf_dir)
    lake.merge_adjacent_files("orders")
    lake.rewrite_data_files("orders", delete_threshold=0.01)
    return lake.changes("orders", 3, lake._now()).where("change_type = 'delete'").select("snapshot_id", "o_orderkey", "o_orderstatus")


@query("SELECT * FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT * REPLACE ('Z' AS o_orderstatus) FROM orders WHERE o_orderstatus = 'F'")
def change_feed_replica(spark, sf_dir):
    """A second lake that follows the feed of the first, a window of snapshots at a time."""
    from tarn.streaming.replica import follow

    lake = _orders(spark, sf_dir)
    copy = new_lake(spark)
    copy.create_table("orders", source(spark, sf_dir, "orders").schema)
    state = follow(lake, "orders", copy, "orders")
    lake.update("orders", {"o_orderstatus": "'Z'"}, "o_orderstatus = 'F'")
    follow(lake, "orders", copy, "orders", state)
    return copy.table("orders").drop("source_row_id")


@query(f"SELECT *, CASE WHEN snapshot_id = 2 THEN 'update_postimage' ELSE 'insert' END AS change_type FROM ({_BORN}) UNION ALL SELECT *, CASE WHEN snapshot_id = 2 THEN 'update_preimage' ELSE 'delete' END FROM ({_DIED})")
def change_feed_stream(spark, sf_dir):
    """The feed as a stream that ends, and later goes on from its checkpoint with what was committed since."""
    from tarn.streaming.source import each_window

    lake = _orders(spark, sf_dir)
    folder = f"{lake.data_path}-stream"

    def handle(changes, number):
        changes.select("snapshot_id", "o_orderkey", "o_orderstatus", "change_type").write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    each_window(lake, "orders", handle, f"{folder}/checkpoint").awaitTermination()
    lake.update("orders", {"o_orderstatus": "'X'"}, "o_orderkey % 5 = 0")
    lake.delete("orders", "o_orderkey % 7 = 0")
    lake.insert("orders", source(spark, sf_dir, "orders").where("o_totalprice > 300000").withColumn("o_orderkey", -F.col("o_orderkey") - 1))
    each_window(lake, "orders", handle, f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/rows").drop("batch")


# --- answers from statistics, pruning -----------------------------------------------------------------------------------


@query("SELECT count(*) AS count FROM orders WHERE o_orderkey % 3 <> 0")
def metadata_count(spark, sf_dir):
    lake = _orders(spark, sf_dir)
    lake.delete("orders", "o_orderkey % 3 = 0")
    return lake.count("orders")


@query("SELECT min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders")
def metadata_min_max(spark, sf_dir):
    return _orders(spark, sf_dir).min_max("orders", "o_totalprice")


def _sorted_lines(spark, sf_dir) -> Lake:
    """Lineitem in files of disjoint ship dates."""
    lake = new_lake(spark)
    rows = source(spark, sf_dir, "lineitem")
    lake.create_table("lineitem", rows.schema)
    lake.insert("lineitem", rows.repartitionByRange(16, "l_shipdate"))
    return lake


def _told(lake: Lake, rows: DataFrame) -> DataFrame:
    """rows and whether files were left out, so that a query fails if its files are no longer pruned."""
    plan = lake.last_plan
    return rows.withColumn("pruned", F.lit(0 < plan.files_read < plan.files_total))


def _pruned(name: str, spark_where: str, sql_where: str) -> None:
    def run(spark, sf_dir):
        lake = _sorted_lines(spark, sf_dir)
        return _told(lake, lake.table("lineitem", where=spark_where))

    run.__name__ = name
    query(f"SELECT *, true AS pruned FROM lineitem WHERE {sql_where}")(run)


_pruned("prune_range", "l_shipdate >= timestamp_ntz'1996-01-01' AND l_shipdate < timestamp_ntz'1996-04-01'", "l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-04-01'")
_pruned("prune_or_tree", "(l_shipdate < timestamp_ntz'1995-06-01' AND l_quantity > 40) OR (l_shipdate > timestamp_ntz'1998-01-01' AND l_discount < 0.02)", "(l_shipdate < TIMESTAMP '1995-06-01' AND l_quantity > 40) OR (l_shipdate > TIMESTAMP '1998-01-01' AND l_discount < 0.02)")


@query("SELECT *, true AS pruned FROM orders WHERE o_orderkey IN (3, 77, 500, 600) OR o_orderkey IS NULL")
def prune_in(spark, sf_dir):
    lake = new_lake(spark)
    rows = source(spark, sf_dir, "orders")
    lake.create_table("orders", rows.schema)
    lake.insert("orders", rows.repartitionByRange(16, "o_orderkey"))
    return _told(lake, lake.table("orders", where="o_orderkey IN (3, 77, 500, 600) OR o_orderkey IS NULL"))


@query("SELECT 1 AS q, count(*) AS n, 2 AS files FROM (VALUES (1.0), ('NaN'::DOUBLE), (NULL), (5.0)) t(x) WHERE x > 2 UNION ALL SELECT 2, 1, 2 UNION ALL SELECT 3, 1, 1 UNION ALL SELECT 4, 2, 2")
def prune_nan(spark, sf_dir):
    lake = new_lake(spark)
    lake.create_table("dbl", "x double")
    for v in ("1.0D", "double('NaN')", "cast(null as double)", "5.0D"):
        lake.insert("dbl", spark.sql(f"SELECT {v} AS x"))
    parts = [lake.table("dbl", where=w).agg(F.lit(k).alias("q"), F.count("*").alias("n")).withColumn("files", F.lit(lake.last_plan.files_read)) for k, w in enumerate(("x > 2", "x < 2", "x IS NULL", "x >= 5"), 1)]
    return functools.reduce(DataFrame.unionAll, parts)


@query("SELECT o_orderkey AS id, o_totalprice AS price, true AS pruned FROM orders WHERE o_totalprice BETWEEN 50000 AND 60000")
def prune_nested(spark, sf_dir):
    lake = new_lake(spark)
    rows = source(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.struct(F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status")).alias("st"))
    lake.create_table("t", rows.schema)
    lake.insert("t", rows.repartitionByRange(8, "st.price"))
    return _told(lake, lake.table("t", where="st.price >= 50000 AND st.price <= 60000")).select("id", "st.price", "pruned")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, true AS pruned FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) < 10")
def prune_variant(spark, sf_dir):
    """Files are ruled out by the bounds of a variant's key."""
    lake = new_lake(spark)
    k = F.get_json_object("props", "$.k").cast("bigint")
    rows = source(spark, sf_dir, "events").select("event_id", F.parse_json("props").alias("v"), k.alias("k"))
    lake.create_table("events", rows.drop("k").schema)
    lake.insert("events", rows.repartitionByRange(8, "k").drop("k"))
    own = lake.table("events", where="variant_get(v, '$.k', 'bigint') < 10")
    return _told(lake, own).select("event_id", F.variant_get("v", "$.k", "bigint").alias("k"), "pruned")


@query("SELECT o_orderkey, o_totalprice, true AS pruned FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topn_pruned(spark, sf_dir):
    lake = new_lake(spark)
    rows = source(spark, sf_dir, "orders")
    lake.create_table("orders", rows.schema)
    lake.insert("orders", rows.repartitionByRange(16, "o_totalprice"))
    return _told(lake, lake.top("orders", "o_totalprice", 10, ties=("o_orderkey",))).select("o_orderkey", "o_totalprice", "pruned")


# --- partitions and order -------------------------------------------------------------------------------------------------


@query("SELECT CAST(year(o_orderdate) AS VARCHAR) AS y, CAST(month(o_orderdate) AS VARCHAR) AS m, count(*) AS record_count FROM orders GROUP BY ALL")
def partition_year_month(spark, sf_dir):
    lake = new_lake(spark)
    lake.create_table_as("orders", source(spark, sf_dir, "orders"), partitioned_by=["year(o_orderdate)", "month(o_orderdate)"])
    return lake.partitions("orders").select(F.col("partition_values")[0].alias("y"), F.col("partition_values")[1].alias("m"), "record_count")


@query("SELECT CAST(date_diff('day', TIMESTAMP '1970-01-01', ts) AS VARCHAR) AS d, count(*) AS record_count FROM events GROUP BY ALL")
def partition_epoch_day(spark, sf_dir):
    lake = new_lake(spark)
    lake.create_table_as("events", source(spark, sf_dir, "events"), partitioned_by=["epoch_day(ts)"])
    return lake.partitions("events").select(F.col("partition_values")[0].alias("d"), "record_count")


@query("SELECT event_id, date_diff('year', TIMESTAMP '1970-01-01', t) AS epoch_year, date_diff('month', TIMESTAMP '1970-01-01', t) AS epoch_month, date_diff('day', TIMESTAMP '1970-01-01', t) AS epoch_day, date_diff('hour', TIMESTAMP '1970-01-01', t) AS epoch_hour, year(t) AS year, month(t) AS month, day(t) AS day, hour(t) AS hour FROM (SELECT event_id, ts - INTERVAL 60 YEAR AS t FROM events)")
def partition_transforms(spark, sf_dir):
    from tarn.functions import transforms

    t = source(spark, sf_dir, "events").select("event_id", (F.col("ts") - F.expr("INTERVAL 60 YEAR")).alias("t"))
    return t.select("event_id", *(transforms.apply(k, F.col("t"), "timestamp_ntz").alias(k) for k in (*transforms.EPOCH, *transforms.CALENDAR)))


@query("SELECT count(*) AS n, count(*) AS right_bucket, 1 AS files_for_one FROM customer")
def partition_bucket(spark, sf_dir):
    """Rows lie in the bucket of their key, and a lookup reads the files of one bucket."""
    from tarn.functions import transforms

    lake = new_lake(spark)
    lake.create_table_as("customer", source(spark, sf_dir, "customer"), partitioned_by=["bucket(8, c_custkey)"])
    rows = spark.read.parquet(*[r["data_file"] for r in lake.list_files("customer").collect()])
    own = F.regexp_extract(F.col("_metadata.file_path"), r"bucket=(\d+)", 1).cast("long")
    rows = rows.select((own == transforms.apply("bucket", F.col("c1"), "bigint", 8)).alias("hit"))
    right = F.count(F.when(F.col("hit"), 1))
    lake.table("customer", where="c_custkey = 7")
    return rows.agg(F.count("*").alias("n"), right.alias("right_bucket")).withColumn("files_for_one", F.lit(lake.last_plan.files_read))


@query(None)
def murmur3_32(spark, sf_dir):
    """Rows only: the hash has no DuckDB function; tests hold it against known values."""
    from tarn.functions import transforms

    c = source(spark, sf_dir, "customer")
    return c.select("c_custkey", transforms.murmur3_32(F.col("c_custkey"), "bigint").alias("of_key"), transforms.murmur3_32(F.col("c_name"), "string").alias("of_name"), transforms.murmur3_32(F.col("c_acctbal"), "double").alias("of_balance"))


@query("SELECT CAST(0 AS BIGINT) AS out_of_order, count(*) AS n FROM orders")
def sorted_insert(spark, sf_dir):
    lake = new_lake(spark)
    rows = source(spark, sf_dir, "orders")
    lake.create_table("orders", rows.schema, sorted_by=["o_totalprice DESC", "o_orderkey"])
    lake.insert("orders", rows.repartition(4))
    from pyspark.sql import Window as W

    before = F.lag("o_totalprice").over(W.partitionBy("_file_id").orderBy("_pos"))
    out = lake.table("orders", lineage=True).withColumn("before", before)
    return out.agg(F.count(F.when(F.col("before") < F.col("o_totalprice"), 1)).alias("out_of_order"), F.count("*").alias("n"))


# --- schema evolution ---------------------------------------------------------------------------------------------------


def _two_halves(spark, sf_dir, change, second=None) -> DataFrame:
    """The even orders, a change of schema, then the odd ones."""
    lake, rows = new_lake(spark), source(spark, sf_dir, "orders")
    lake.create_table_as("orders", rows.where("o_orderkey % 2 = 0"))
    change(lake)
    odd = rows.where("o_orderkey % 2 <> 0")
    lake.insert("orders", second(odd) if second else odd)
    return lake.table("orders")


@query("SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 5 ELSE o_custkey END AS extra, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'n' END AS note FROM orders")
def add_column_default(spark, sf_dir):
    def change(lake):
        lake.add_column("orders", "extra", "bigint", 5)
        lake.add_column("orders", "note", "string")
        lake.set_default("orders", "note", "'n'")

    return _two_halves(spark, sf_dir, change, lambda o: o.withColumn("extra", F.col("o_custkey")))


@query("SELECT * EXCLUDE (o_orderpriority) FROM orders")
def drop_column(spark, sf_dir):
    return _two_halves(spark, sf_dir, lambda lake: lake.drop_column("orders", "o_orderpriority"), lambda o: o.drop("o_orderpriority"))


@query("SELECT * RENAME (o_orderstatus AS status) FROM orders")
def rename_column(spark, sf_dir):
    return _two_halves(spark, sf_dir, lambda lake: lake.rename_column("orders", "o_orderstatus", "status"), lambda o: o.withColumnRenamed("o_orderstatus", "status"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE o_orderpriority END AS o_orderpriority FROM orders")
def swap_column_names(spark, sf_dir):
    def change(lake):
        lake.rename_column("orders", "o_orderstatus", "x")
        lake.rename_column("orders", "o_orderpriority", "o_orderstatus")
        lake.rename_column("orders", "x", "o_orderpriority")

    return _two_halves(spark, sf_dir, change).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::DOUBLE AS n_regionkey FROM nation UNION ALL SELECT n_nationkey + 10000000000, n_name, 0.5 FROM nation")
def promote_type(spark, sf_dir):
    lake, rows = new_lake(spark), source(spark, sf_dir, "nation")
    lake.create_table_as("nation", rows)
    lake.alter_type("nation", "n_nationkey", "bigint")
    lake.alter_type("nation", "n_regionkey", "double")
    lake.insert("nation", rows.select((F.col("n_nationkey") + F.lit(10000000000)).alias("n_nationkey"), "n_name", F.lit(0.5).alias("n_regionkey")))
    return lake.table("nation")


@query("SELECT c_custkey AS id, c_name AS title, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_acctbal END AS balance FROM customer")
def struct_evolution(spark, sf_dir):
    lake, c = new_lake(spark), source(spark, sf_dir, "customer")
    lake.create_table_as("t", c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")).alias("st")))
    lake.add_field("t", "st.balance", "double")
    lake.rename_field("t", "st.name", "title")
    lake.drop_field("t", "st.nation")
    lake.insert("t", c.where("c_custkey % 2 <> 0").select(F.col("c_custkey").alias("id"), F.struct(F.col("c_name").alias("title"), F.col("c_acctbal").alias("balance")).alias("st")))
    return lake.table("t").select("id", "st.title", "st.balance")


@query("SELECT 'NOT NULL constraint failed: r_name' AS message")
def not_null_violation(spark, sf_dir):
    lake = new_lake(spark)
    lake.create_table("region", source(spark, sf_dir, "region").schema)
    lake.insert("region", source(spark, sf_dir, "region"))
    lake.set_not_null("region", "r_name")
    try:
        lake.insert("region", spark.sql("SELECT 9 AS r_regionkey, CAST(NULL AS STRING) AS r_name"))
        message = "none"
    except LakeError as e:
        message = str(e)
    return spark.createDataFrame([(message,)], "message string")


# --- maintenance --------------------------------------------------------------------------------------------------------


def _in_pieces(spark, sf_dir, n: int = 5, **options) -> Lake:
    lake, rows = new_lake(spark, **options), source(spark, sf_dir, "orders")
    lake.create_table("orders", rows.schema)
    for k in range(n):
        lake.insert("orders", rows.where(f"o_orderkey % {n} = {k}"))
    return lake


@query("SELECT *, 1 AS files FROM orders")
def merge_adjacent(spark, sf_dir):
    lake = _in_pieces(spark, sf_dir)
    lake.merge_adjacent_files("orders")
    return lake.table("orders").withColumn("files", F.lit(lake.list_files("orders").count()))


@query("SELECT * FROM orders WHERE o_orderkey % 5 < 3")
def compaction_time_travel(spark, sf_dir):
    lake = _in_pieces(spark, sf_dir)
    lake.merge_adjacent_files("orders")
    return lake.table("orders", version=4)


@query("SELECT * FROM orders WHERE o_orderkey % 3 <> 0")
def rewrite_deletes(spark, sf_dir):
    lake = _orders(spark, sf_dir)
    lake.delete("orders", "o_orderkey % 3 = 0")
    lake.rewrite_data_files("orders", delete_threshold=0.2)
    assert lake.list_files("orders").agg(F.sum("delete_count")).first()[0] == 0
    return lake.table("orders")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey <> 3")
def flush_inlined(spark, sf_dir):
    lake, rows = new_lake(spark, data_inlining_row_limit=10), source(spark, sf_dir, "nation")
    lake.create_table("nation", rows.schema)
    for k in range(5):
        lake.insert("nation", rows.where(f"n_nationkey % 5 = {k}"))
    lake.delete("nation", "n_nationkey = 3")
    lake.flush_inlined_data()
    return lake.table("nation")


@query("SELECT * FROM orders WHERE o_orderkey % 2 = 0")
def checkpoint(spark, sf_dir):
    lake = _in_pieces(spark, sf_dir, 3)
    lake.delete("orders", "o_orderkey % 2 <> 0")
    lake.checkpoint()
    return lake.table("orders")


@query("SELECT CAST(x AS BIGINT) AS snapshot_id, n FROM (VALUES (4), (5), (6)) v(x), (SELECT count(*) AS n FROM orders)")
def expire_and_cleanup(spark, sf_dir):
    lake = _in_pieces(spark, sf_dir)
    lake.merge_adjacent_files("orders")
    lake.expire_snapshots(versions=[0, 1, 2, 3, 7])
    lake.cleanup_old_files(cleanup_all=True)
    n = lake.table("orders").count()
    return lake.snapshots().where("snapshot_id < 7").select("snapshot_id", F.lit(n).cast("long").alias("n"))


@query("SELECT * FROM orders")
def orphaned_files(spark, sf_dir):
    lake = _orders(spark, sf_dir)
    source(spark, sf_dir, "region").coalesce(1).write.parquet(f"{lake.data_path}/stray")
    assert len(lake.delete_orphaned_files(cleanup_all=True)) == 1
    return lake.table("orders")


# --- registration ---------------------------------------------------------------------------------------------------------


@query("SELECT * FROM orders")
def add_files(spark, sf_dir):
    return attached(spark, sf_dir, "orders").table("orders")


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'")
def add_files_hive(spark, sf_dir):
    lake = new_lake(spark)
    folder = f"{lake.data_path}-outside"
    source(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus").write.partitionBy("o_orderstatus").parquet(folder)
    lake.create_table("orders", "o_orderkey bigint, o_totalprice double, o_orderstatus string")
    lake.add_data_files("orders", f"{folder}/*/*.parquet")
    return lake.table("orders", where="o_orderstatus <> 'F'")


@query("SELECT o_orderkey, CAST(NULL AS VARCHAR) AS missing, o_totalprice FROM orders")
def add_files_missing_extra(spark, sf_dir):
    lake = new_lake(spark)
    lake.create_table("orders", "o_orderkey bigint, missing string, o_totalprice double")
    lake.add_data_files("orders", [f for f, _, _ in lake.fs.walk(f"{sf_dir}/orders.parquet") if f.endswith(".parquet")], allow_missing=True, ignore_extra_columns=True)
    return lake.table("orders")


@query("SELECT o_orderkey, o_totalprice FROM orders")
def add_files_by_position(spark, sf_dir):
    """Columns of foreign files under other names, taken by their places."""
    lake = new_lake(spark)
    folder = f"{lake.data_path}-outside"
    source(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a"), F.col("o_totalprice").alias("b")).write.parquet(folder)
    lake.create_table("orders", "o_orderkey bigint, o_totalprice double")
    lake.add_data_files("orders", f"{folder}/*.parquet", by_position=True)
    return lake.table("orders")


@query("SELECT * FROM orders WHERE o_orderkey % 4 <> 1")
def foreign_delete_files(spark, sf_dir):
    """Positional deletes written elsewhere, checked and applied."""
    lake = _orders(spark, sf_dir)
    gone = lake.table("orders", virtual=True).where("o_orderkey % 4 = 1").select(F.col("filename").alias("file_path"), F.col("file_row_number").alias("pos"))
    folder = f"{lake.data_path}-deletes"
    gone.repartition(2, "file_path").sortWithinPartitions("file_path", "pos").write.parquet(folder)
    lake.add_delete_files("orders", [f for f, _, _ in lake.fs.walk(folder) if f.endswith(".parquet")])
    return lake.table("orders")


@query("SELECT true AS told, true AS timed")
def metadata_query_log(spark, sf_dir):
    lake = _orders(spark, sf_dir)
    log = lake.query_log()
    return log.agg((F.count(F.when(F.col("statement").contains("INSERT INTO data_file"), 1)) > 0).alias("told"), (F.min("seconds") >= 0).alias("timed"))


# --- views, macros, catalog -----------------------------------------------------------------------------------------------


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY ALL")
def view(spark, sf_dir):
    lake = attached(spark, sf_dir, "orders")
    lake.create_view("large", "SELECT * FROM orders WHERE o_totalprice > 100000")
    lake.create_view("by_status", "SELECT o_orderstatus, count(*) FROM large GROUP BY 1", aliases=["status", "n"])
    return lake.sql("SELECT status, n FROM by_status")


@query("SELECT o_orderkey, o_totalprice * 1.19::DOUBLE AS gross, o_custkey + 1 AS one, o_custkey + 5 AS five FROM orders")
def macro_scalar(spark, sf_dir):
    lake = attached(spark, sf_dir, "orders")
    lake.create_macro("gross", "price DOUBLE", "price * 1.19D")
    lake.create_macro("add_to", "a BIGINT, b BIGINT DEFAULT 1", "a + b")
    return lake.sql("SELECT o_orderkey, gross(o_totalprice) AS gross, add_to(o_custkey) AS one, add_to(o_custkey, 5) AS five FROM orders")


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'P'")
def macro_table(spark, sf_dir):
    lake = attached(spark, sf_dir, "orders")
    lake.create_macro("ranked", "st STRING", "SELECT o_orderkey, o_totalprice, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) FROM orders WHERE o_orderstatus = st", table="o_orderkey BIGINT, o_totalprice DOUBLE, place BIGINT")
    return lake.sql("SELECT * FROM ranked('P')")


@query("SELECT CAST(x AS BIGINT) AS snapshot_id, y AS change, z AS author FROM (VALUES (0, 'created_schema', NULL), (1, 'created_table', NULL), (2, 'inserted_into_table', 'ann'), (3, 'deleted_from_table', NULL)) v(x, y, z)")
def snapshot_listing(spark, sf_dir):
    lake = new_lake(spark)
    lake.create_table("orders", source(spark, sf_dir, "orders").schema)
    lake.set_commit_message("ann", "first rows")
    lake.insert("orders", source(spark, sf_dir, "orders"))
    lake.delete("orders", "o_orderkey % 2 = 0")
    return lake.snapshots().select("snapshot_id", F.explode(F.map_keys("changes")).alias("change"), "author")


@query("SELECT CAST(2 AS BIGINT) AS current, CAST(2 AS BIGINT) AS last, CAST(NULL AS BIGINT) AS of_other")
def current_and_last_snapshot(spark, sf_dir):
    lake = _orders(spark, sf_dir)
    lake.delete("orders", "o_orderkey % 2 = 0")
    other = Lake(spark, lake.store.path)
    ids = [x.first()[0] for x in (lake.current_snapshot(), lake.last_committed_snapshot(), other.last_committed_snapshot())]
    return spark.createDataFrame([tuple(ids)], "current long, last long, of_other long")


@query("SELECT count(*) AS record_count, true AS has_bytes FROM orders")
def lake_size(spark, sf_dir):
    return _orders(spark, sf_dir).size().select("record_count", (F.col("bytes") > 0).alias("has_bytes"))


@query("SELECT *, 'is elsewhere' AS refused FROM orders")
def data_path_override(spark, sf_dir):
    """A lake detached and attached again under another data path: refused, unless it is to be overridden."""
    lake = _orders(spark, sf_dir)
    path = lake.store.path
    lake.close()
    try:
        Lake(spark, path, f"{lake.data_path}/other")
        refused = "attached"
    except LakeError as e:
        refused = "is elsewhere" if "override_data_path" in str(e) else str(e)
    return Lake(spark, path, f"{lake.data_path}/other", override_data_path=True).table("orders").withColumn("refused", F.lit(refused))


@query("SELECT y, count(*) AS record_count FROM (SELECT CASE WHEN o_orderkey % 3 = 1 THEN CAST(year(o_orderdate) AS VARCHAR) END AS y FROM orders) GROUP BY y")
def set_and_reset_partitions(spark, sf_dir):
    """Rows written before, under and after a partitioning by year."""
    lake, rows = new_lake(spark), source(spark, sf_dir, "orders")
    lake.create_table("orders", rows.schema)
    for k, keys in enumerate(([], ["year(o_orderdate)"], [])):
        lake.set_partitioned_by("orders", *keys)
        lake.insert("orders", rows.where(f"o_orderkey % 3 = {k}"))
    return lake.partitions("orders").groupBy(F.get("partition_values", 0).alias("y")).agg(F.sum("record_count").alias("record_count"))


@query("SELECT count(*) AS n, true AS pruned_by_key, false AS pruned_by_price FROM orders WHERE o_totalprice < 0 OR o_orderkey < 10")
def skipped_statistics(spark, sf_dir):
    """A column without statistics rules out no file; the others do."""
    lake, rows = new_lake(spark), source(spark, sf_dir, "orders")
    lake.create_table("orders", rows.schema, options={"skip_stats_columns": "o_totalprice"})
    lake.insert("orders", rows.repartitionByRange(8, "o_orderkey"))
    n = lake.table("orders", where="o_totalprice < 0 OR o_orderkey < 10").count()
    told = []
    for where in ("o_orderkey < 10", "o_totalprice < 0"):
        lake.table("orders", where=where)
        told.append(lake.last_plan.files_read < lake.last_plan.files_total)
    return spark.createDataFrame([(n, *told)], "n long, pruned_by_key boolean, pruned_by_price boolean")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'new' END AS note, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS o_custkey FROM orders")
def drop_default_and_not_null(spark, sf_dir):
    lake, rows = new_lake(spark), source(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lake.create_table("orders", rows.schema)
    lake.add_column("orders", "note", "string")
    lake.set_default("orders", "note", "'new'")
    lake.set_not_null("orders", "o_custkey")
    lake.insert("orders", rows.where("o_orderkey % 2 = 0"))
    lake.drop_default("orders", "note")
    lake.drop_not_null("orders", "o_custkey")
    lake.insert("orders", rows.where("o_orderkey % 2 <> 0").select("o_orderkey"))
    return lake.table("orders")


@query("SELECT CAST(0 AS BIGINT) AS out_of_order, count(*) * 2 AS n, false AS sorted_after_reset FROM orders")
def set_and_reset_order(spark, sf_dir):
    from pyspark.sql import Window as W

    lake, rows = new_lake(spark), source(spark, sf_dir, "orders")
    lake.create_table("orders", rows.schema)
    lake.set_sorted_by("orders", "o_totalprice DESC NULLS LAST")
    lake.insert("orders", rows.repartition(3))
    lake.set_sorted_by("orders")
    lake.insert("orders", rows.repartition(1, "o_custkey"))
    late = F.lag("o_totalprice").over(W.partitionBy("_file_id").orderBy("_pos")) < F.col("o_totalprice")
    by_snapshot = lake.table("orders", lineage=True).withColumn("late", late).groupBy("_snapshot_id").agg(F.count(F.when(F.col("late"), 1)).alias("late"), F.count("*").alias("n"))
    return by_snapshot.agg(F.min("late").alias("out_of_order"), F.sum("n").alias("n"), (F.max("late") == 0).alias("sorted_after_reset"))


@query("SELECT n_name, 2 AS views_left FROM nation WHERE n_regionkey = 1")
def drop_and_rename_views(spark, sf_dir):
    lake = attached(spark, sf_dir, "nation")
    lake.create_view("a", "SELECT * FROM nation WHERE n_regionkey = 1")
    lake.create_view("b", "SELECT * FROM nation WHERE n_regionkey = 2")
    lake.create_view("c", "SELECT 1 AS one")
    lake.create_macro("twice", "x INT", "2 * x")
    lake.drop_macro("twice")
    lake.drop_view("b")
    lake.rename_view("a", "b")
    left = len(lake.store.alive("view", lake._now())) + len(lake.store.alive("macro", lake._now()))
    return lake.sql("SELECT n_name FROM b").withColumn("views_left", F.lit(left))


@query("SELECT * FROM (VALUES ('34', 2017239379, NULL), ('alice', NULL, 1), ('bob', NULL, 2), ('charlie', NULL, 3)) v(text, hash, bucket)")
def bucket_known_values(spark, sf_dir):
    """Published values of the hash, and buckets of four."""
    from tarn.functions import transforms

    number = spark.sql("SELECT 34L AS v").select(F.lit("34").alias("text"), transforms.murmur3_32(F.col("v"), "bigint").alias("hash"), F.lit(None).cast("long").alias("bucket"))
    names = spark.sql("SELECT * FROM VALUES ('alice'), ('bob'), ('charlie') AS t(v)").select(F.col("v").alias("text"), F.lit(None).cast("int").alias("hash"), transforms.apply("bucket", F.col("v"), "string", 4).alias("bucket"))
    return number.unionAll(names)


@query("SELECT 'orders' AS table_name, true AS has_files, CAST(1 AS BIGINT) AS delete_file_count")
def table_info(spark, sf_dir):
    lake = _orders(spark, sf_dir)
    lake.delete("orders", "o_orderkey % 2 = 0")
    return lake.table_info().select("table_name", ((F.col("file_count") > 0) & (F.col("file_size_bytes") > 0)).alias("has_files"), "delete_file_count")


@query("SELECT count(*) AS record_count, CAST(count(*) FILTER (WHERE o_orderkey % 3 = 0) AS BIGINT) AS delete_count FROM orders")
def list_files(spark, sf_dir):
    lake = _orders(spark, sf_dir)
    lake.delete("orders", "o_orderkey % 3 = 0")
    return lake.list_files("orders").agg(F.sum("record_count").alias("record_count"), F.sum("delete_count").alias("delete_count"))


@query("SELECT * FROM (VALUES ('data_inlining_row_limit', '0', 'global'), ('parquet_compression', 'gzip', 'table'), ('target_file_size', '1048576', 'schema')) v(option_name, value, scope)")
def options_listing(spark, sf_dir):
    lake = new_lake(spark)
    lake.create_table("region", source(spark, sf_dir, "region").schema)
    lake.set_option("parquet_compression", "gzip", table="region")
    lake.set_option("target_file_size", 1048576, schema="main")
    return lake.options().select("option_name", "value", "scope")


@query("SELECT * FROM (VALUES ('', 'all regions'), ('r_name', 'what it is called')) v(name, comment)")
def comments(spark, sf_dir):
    lake = new_lake(spark)
    lake.create_table("region", source(spark, sf_dir, "region").schema)
    lake.comment("table", "region", "all regions")
    lake.comment("column", "region", "what it is called", "r_name")
    return spark.createDataFrame(list(lake.comments("region").items()), "name string, comment string")


@query("SELECT * FROM region")
def nested_schemas(spark, sf_dir):
    lake = new_lake(spark)
    lake.create_schema("a")
    lake.create_schema("a.b")
    lake.create_table_as("a.b.region", source(spark, sf_dir, "region"))
    lake.rename_table("a.b.region", "regions")
    return lake.table("a.b.regions")


# --- inlined rows, transactions ---------------------------------------------------------------------------------------------


@query("SELECT CASE WHEN r_regionkey = 1 THEN 10 ELSE r_regionkey END AS r_regionkey, r_name, false AS has_files FROM region WHERE r_regionkey <> 2")
def inlined_small_insert(spark, sf_dir):
    lake = new_lake(spark, data_inlining_row_limit=10)
    lake.create_table("region", source(spark, sf_dir, "region").schema)
    lake.insert("region", source(spark, sf_dir, "region"))
    lake.update("region", {"r_regionkey": "10"}, "r_regionkey = 1")
    lake.delete("region", "r_regionkey = 2")
    return lake.table("region").withColumn("has_files", F.lit(lake.list_files("region").count() > 0))


@query("SELECT * FROM orders")
def txn_rollback(spark, sf_dir):
    lake = _orders(spark, sf_dir)
    try:
        with lake.transaction():
            lake.delete("orders", "o_orderkey % 2 = 0")
            lake.create_table_as("copy", lake.table("orders"))
            raise KeyError("stop")
    except KeyError:
        pass
    return lake.table("orders")


@query("SELECT 'orders' AS name, count(*) AS n FROM orders WHERE o_orderkey % 2 <> 0 UNION ALL SELECT 'gone', count(*) FROM orders WHERE o_orderkey % 2 = 0")
def txn_multi_table(spark, sf_dir):
    lake = _orders(spark, sf_dir)
    with lake.transaction():
        lake.create_table_as("gone", lake.table("orders").where("o_orderkey % 2 = 0"))
        lake.delete("orders", "o_orderkey % 2 = 0")
        assert lake.table("orders").where("o_orderkey % 2 = 0").limit(1).count() == 0
    return functools.reduce(DataFrame.unionAll, [lake.table(t).agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in ("orders", "gone")])


@query("SELECT true AS conflict, count(*) AS n FROM orders WHERE o_orderkey % 2 <> 0")
def conflict_insert_delete(spark, sf_dir):
    """An insert against a delete that was committed meanwhile."""
    lake = _orders(spark, sf_dir)
    other = Lake(spark, lake.store.path)
    conflict = False
    try:
        with other.transaction():
            other.insert("orders", source(spark, sf_dir, "orders"))
            lake.delete("orders", "o_orderkey % 2 = 0")
    except ConflictError:
        conflict = True
    return lake.table("orders").agg(F.lit(conflict).alias("conflict"), F.count("*").alias("n"))


@query("SELECT count(*) * 2 AS n FROM orders")
def concurrent_inserts(spark, sf_dir):
    lake = _orders(spark, sf_dir)
    other = Lake(spark, lake.store.path)
    with other.transaction():
        other.insert("orders", source(spark, sf_dir, "orders").where("o_orderkey % 2 = 0"))
        lake.insert("orders", source(spark, sf_dir, "orders").where("o_orderkey % 2 <> 0"))
    assert lake.table("orders", lineage=True).groupBy("_row_id").count().where("count > 1").limit(1).count() == 0
    return lake.table("orders").agg(F.count("*").alias("n"))
