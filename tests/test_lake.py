"""Behaviour of lakes that the queries do not show: errors, conflicts, histories step by step."""

import random

import pytest
from pyspark.sql import functions as F

from tarn.errors import ConflictError, LakeError
from tarn.lake import Lake
from tarn.queries import new_lake


@pytest.fixture
def lake(spark):
    return new_lake(spark)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("limit", [0, 10])
def test_change_feed_history(spark, limit):
    """Insert, two updates and a delete of three rows, with and without inlining."""
    lake = new_lake(spark, data_inlining_row_limit=limit)
    lake.create_table("test", "i int")
    lake.insert("test", spark.range(3).select(F.col("id").cast("int").alias("i")))
    lake.update("test", {"i": "i + 100"})
    lake.update("test", {"i": "i + 100"})
    lake.delete("test")
    feed = lambda a, b: sorted(((r.snapshot_id, r.rowid, r.change_type, r.i) for r in lake.changes("test", a, b).collect()))
    ids = sorted(r.rowid for r in lake.insertions("test", 0, 2).collect())
    assert ids == [0, 1, 2]
    assert [x[0::2] for x in feed(0, 2)] == [(2, "insert")] * 3
    assert sorted((c, i) for _, _, c, i in feed(3, 3)) == sorted([("update_preimage", k) for k in range(3)] + [("update_postimage", 100 + k) for k in range(3)])
    assert sorted(i for _, _, c, i in feed(5, 5)) == [200, 201, 202] and {c for _, _, c, _ in feed(5, 5)} == {"delete"}
    assert len(feed(0, 5)) == 3 + 6 + 6 + 3
    assert [rows(lake.table("test", version=v)) for v in (2, 3, 5)] == [[(0,), (1,), (2,)], [(100,), (101,), (102,)], []]
    if limit:
        assert lake.list_files("test").count() == 0
        lake.flush_inlined_data()
        assert rows(lake.table("test", version=3)) == [(100,), (101,), (102,)]
        assert lake.table("test").count() == 0


def test_time_travel_errors(spark):
    lake = new_lake(spark)
    lake.create_table("t", "a int")
    for bad in ({"version": 99}, {"timestamp": "2999-01-01"}, {"timestamp": "1999-01-01"}, {"version": 1, "timestamp": "2020-01-01"}):
        with pytest.raises(LakeError):
            lake.table("t", **bad)
    with pytest.raises(LakeError):
        lake.table("t", version=0)  # not there yet
    pinned = Lake(spark, lake.store.path, snapshot_version=1)
    with pytest.raises(LakeError):
        pinned.create_table("u", "a int")


def test_update_keeps_row_ids_and_merge_rules(spark):
    lake = new_lake(spark)
    lake.create_table_as("stock", spark.createDataFrame([(10, 2200), (20, 1900)], "item_id int, balance int"))
    buy = spark.createDataFrame([(10, 1000), (30, 300)], "item_id int, volume int")
    before = {r.item_id: r._row_id for r in lake.table("stock", lineage=True).collect()}
    done = lake.merge("stock", buy, "t.item_id = s.item_id", matched=[(None, {"balance": "t.balance + s.volume"})], not_matched=[(None, {"item_id": "s.item_id", "balance": "s.volume"})])
    assert done == {"inserted": 1, "updated": 1, "deleted": 0}
    assert rows(lake.table("stock")) == [(10, 3200), (20, 1900), (30, 300)]
    after = {r.item_id: r._row_id for r in lake.table("stock", lineage=True).collect()}
    assert all(after[k] == v for k, v in before.items())
    twice = spark.createDataFrame([(10, 1), (10, 2)], "item_id int, volume int")
    with pytest.raises(LakeError):
        lake.merge("stock", twice, "t.item_id = s.item_id", matched=[(None, "delete")])
    with pytest.raises(LakeError):
        lake.merge("stock", buy, "t.item_id = s.item_id", matched=[("s.volume > 5", {"balance": "0"}), (None, "delete")])
    with pytest.raises(LakeError):
        lake.merge("stock", buy, "t.item_id = s.item_id", matched=[(None, "error")])
    assert rows(lake.table("stock")) == [(10, 3200), (20, 1900), (30, 300)]


def test_delete_merge_rewrite_keep_every_version(spark):
    lake = new_lake(spark)
    lake.create_table("t", "a int, b int", partitioned_by=["b"])
    for k in range(4):
        lake.insert("t", spark.range(k * 10, k * 10 + 10).selectExpr("CAST(id AS INT) AS a", "CAST(id % 2 AS INT) AS b"))
    lake.delete("t", "a % 5 = 0")
    lake.update("t", {"a": "a + 1000"}, "a > 35")
    for k in (50, 60):
        lake.insert("t", spark.range(k, k + 3).selectExpr("CAST(id AS INT) AS a", "CAST(id % 2 AS INT) AS b"))
    versions = {v: rows(lake.table("t", version=v)) for v in range(1, lake._now() + 1)}
    feed = rows(lake.changes("t", 1, lake._now()))
    ids = rows(lake.table("t", lineage=True).select("a", "_row_id"))
    assert lake.rewrite_data_files("t", delete_threshold=0.1) > 0
    assert lake.merge_adjacent_files("t") > 0
    for v, want in versions.items():
        assert rows(lake.table("t", version=v)) == want, v
    assert rows(lake.changes("t", 1, max(versions))) == feed
    assert lake.changes("t", max(versions) + 1, lake._now()).count() == 0
    assert rows(lake.table("t", lineage=True).select("a", "_row_id")) == ids
    assert lake.count("t").first()[0] == len(versions[max(versions)])
    lake.expire_snapshots(versions=[0, 1, 2, 3])
    lake.cleanup_old_files(cleanup_all=True)
    lake.delete_orphaned_files(cleanup_all=True)
    assert rows(lake.table("t")) == versions[max(versions)]


def test_pruned_reads_equal_whole_ones(spark):
    """Random predicates over files of random ranges, NULLs and NaN included."""
    rng = random.Random(5)
    lake = new_lake(spark)
    data = [(k, rng.choice([None, rng.randint(0, 50)]), rng.choice([None, float("nan"), rng.uniform(-5, 5)]), rng.choice([None, "a", "b", "zz", "é"])) for k in range(400)]
    lake.create_table("t", "i int, g int, x double, s string")
    for k in range(0, 400, 50):
        lake.insert("t", spark.createDataFrame(sorted(data[k : k + 50], key=lambda r: (r[1] is None, r[1])), "i int, g int, x double, s string").coalesce(1))
    whole = lake.table("t").cache()
    atoms = lambda: rng.choice([f"i {rng.choice(['<', '>', '=', '<=', '>=', '<>'])} {rng.randint(-10, 420)}", f"g IN ({rng.randint(0, 60)}, {rng.randint(0, 60)})", "g IS NULL", "x IS NOT NULL", f"x {rng.choice(['<', '>', '>=', '='])} {rng.uniform(-6, 6):.2f}", "x = double('NaN')", f"s {rng.choice(['=', '<', '>'])} '{rng.choice(['a', 'b', 'm', 'é'])}'"])
    read = set()
    for _ in range(25):
        where = f"({atoms()} {rng.choice(['AND', 'OR'])} {atoms()}) {rng.choice(['AND', 'OR'])} {atoms()}"
        assert rows(lake.table("t", where=where).select("i")) == rows(whole.where(where).select("i")), where
        read.add(lake.last_plan.files_read)
    assert lake.table("t", where="i < 50").count() == 50 and lake.last_plan.files_read == 1
    assert len(read) > 1


def test_conflicts(spark):
    lake = new_lake(spark)
    lake.create_table("t", "a int")
    for k in range(2):
        lake.insert("t", spark.createDataFrame([(2 * k,), (2 * k + 1,)], "a int").coalesce(1))
    other = Lake(spark, lake.store.path)

    def race(mine, theirs):
        with other.transaction():
            mine(other)
            theirs(lake)

    race(lambda o: o.delete("t", "a = 0"), lambda i: i.delete("t", "a = 2"))  # other files: no conflict
    assert rows(lake.table("t")) == [(1,), (3,)]
    other.set_option("data_inlining_row_limit", 0)
    for mine, theirs in (
        (lambda o: o.insert("t", spark.range(1).selectExpr("CAST(id AS INT) AS a")), lambda i: i.add_column("t", "b", "int")),
        (lambda o: o.drop_table("t"), lambda i: i.drop_table("t")),
        (lambda o: o.create_table("u", "a int"), lambda i: i.create_table("u", "a int")),
    ):
        with pytest.raises(ConflictError):
            race(mine, theirs)
    assert rows(lake.table("u")) == []


def test_registration_rules(spark, tmp_path):
    lake = new_lake(spark)
    out = f"file://{tmp_path}/out"
    spark.createDataFrame([("x", 1), ("y", 2)], "col2 string, col1 int").coalesce(1).write.parquet(out)
    lake.create_table("test", "col1 int, col2 string")
    assert lake.add_data_files("test", f"{out}/*.parquet") == 1
    assert rows(lake.table("test")) == [(1, "x"), (2, "y")]
    assert lake.table("test", where="col1 > 5").count() == 0 and lake.last_plan.files_read == 0
    lake.delete("test", "col1 = 1")
    lake.rename_column("test", "col1", "one")
    assert rows(lake.table("test")) == [(2, "y")]
    lake.create_table("narrow", "col1 tinyint, col2 string")
    lake.create_table("missing", "col1 int, col2 string, z int")
    lake.create_table("extra", "col1 int")
    for t in ("narrow", "missing", "extra"):
        with pytest.raises(LakeError):
            lake.add_data_files(t, f"{out}/*.parquet")
    lake.add_data_files("missing", f"{out}/*.parquet", allow_missing=True)
    assert rows(lake.table("missing").where("z IS NULL")) == [(1, "x", None), (2, "y", None)]


def test_catalog_rules(spark):
    lake = new_lake(spark)
    lake.create_table("t", "a int, b struct<c:int>")
    for bad in (
        lambda: lake.create_table("t", "a int"),
        lambda: lake.create_table("u", "a int, A int"),
        lambda: lake.drop_column("t", "zz"),
        lambda: lake.alter_type("t", "a", "tinyint"),
        lambda: lake.drop_field("t", "b.c"),
        lambda: lake.add_column("t", "d", "int", "rand()"),
        lambda: lake.create_schema("x.y"),
        lambda: lake.set_option("no_such", 1),
        lambda: lake.set_option("skip_stats_columns", "a"),
        lambda: lake.insert("t", spark.range(1)),
        lambda: lake.create_table("p", "a int", partitioned_by=["year(a)"]),
        lambda: lake.drop_table("nope"),
    ):
        with pytest.raises(LakeError):
            bad()
    lake.create_table("t", "z string", or_replace=True)
    assert lake.table("t").columns == ["z"]
    lake.create_schema("s")
    lake.create_table("s.t", "a int")
    with pytest.raises(LakeError):
        lake.drop_schema("s")
    lake.drop_schema("s", cascade=True)
    with pytest.raises(LakeError):
        lake.table("s.t")
    lake.set_option("require_commit_message", "true")
    with pytest.raises(LakeError):
        lake.create_table("v", "a int")
    lake.set_commit_message("me", "needed")
    lake.create_table("v", "a int")
    last = lake.snapshots().orderBy(F.desc("snapshot_id")).first()
    assert (last.author, last.commit_message) == ("me", "needed")


def test_types_round_trip_inlined_and_written(spark):
    import datetime
    import decimal

    ddl = "a tinyint, b bigint, c float, d double, e decimal(20,4), f string, g binary, h date, i timestamp_ntz, j timestamp, k boolean, l array<int>, m struct<x:int,y:string>"
    t = datetime.datetime(2020, 1, 2, 3, 4, 5, 678901)
    data = [(1, 1 << 60, 0.5, float("inf"), decimal.Decimal("12345.6789"), "é\n\"'", bytearray(b"\x00\xff"), t.date(), t, t, True, [1, None], (1, None)), (None,) * 13]
    df = spark.createDataFrame(data, ddl)
    for limit in (0, 10):
        lake = new_lake(spark, data_inlining_row_limit=limit)
        lake.create_table("t", df.schema)
        lake.insert("t", df)
        assert lake.table("t").exceptAll(df).count() == 0 and df.exceptAll(lake.table("t")).count() == 0
        assert (lake.list_files("t").count() == 0) == bool(limit)
        lake.checkpoint()
        assert lake.table("t").exceptAll(df).count() == 0 and lake.table("t").count() == 2


@pytest.mark.parametrize("n", [3, 60])
def test_registration_judges_each_file(spark, lake, tmp_path, n):
    """A file that lacks a column, among few files and many: an error, or its default where that is allowed."""
    for k in range(n):
        rows = spark.range(2).select((F.col("id") + 10 * k).alias("a"), *([F.lit(k).alias("b")] if k != 1 else []))
        rows.coalesce(1).write.parquet(str(tmp_path / f"f{k:02}"))
    lake.create_table("t", "a bigint, b int")
    paths = [f"{tmp_path}/f{k:02}/*.parquet" for k in range(n)]
    with pytest.raises(LakeError, match='"b" is missing'):
        lake.add_data_files("t", paths)
    assert lake.add_data_files("t", paths, allow_missing=True) == n
    assert lake.table("t").where("b is null").count() == 2 and lake.table("t").count() == 2 * n


def test_truncate_ends_files_without_reading(spark, lake):
    lake.create_table_as("t", spark.range(1000).repartition(4))
    lake.delete("t", "id % 3 = 0")
    before = lake._now()
    sets = len(lake.store.rows("SELECT * FROM delete_set"))
    assert lake.truncate("t") == 666
    assert lake.table("t").count() == 0 and lake.table("t", version=before).count() == 666
    assert len(lake.store.rows("SELECT * FROM delete_set")) == sets and lake.last_committed == before + 1
    assert sorted(r.id for r in lake.deletions("t", before + 1, before + 1).collect()) == [k for k in range(1000) if k % 3]
    assert lake.truncate("t") == 0


def test_rewrite_and_merge_write_bins_side_by_side(spark, lake):
    """Bins of about the target size, a file each, in one commit; rows, ids and history stay."""
    lake.create_table("t", "id bigint, s string")
    for k in range(8):
        lake.insert("t", spark.range(500).select((F.col("id") + 500 * k).alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("s")).coalesce(1))
    old = {r.id: r._row_id for r in lake.table("t", lineage=True).collect()}
    size = lake.list_files("t").first()["data_file_size_bytes"]
    lake.set_option("target_file_size", int(size * 2.2), table="t")
    commits = lake._now()
    assert lake.merge_adjacent_files("t") == 8
    assert lake._now() == commits + 1 and lake.list_files("t").count() == 4
    lake.delete("t", "id % 2 = 0")
    lake.set_option("target_file_size", lake.list_files("t").first()["data_file_size_bytes"], table="t")
    commits = lake._now()
    assert lake.rewrite_data_files("t", delete_threshold=0.3) == 4
    assert lake._now() == commits + 1 and lake.list_files("t").count() == 2
    assert {r.id: r._row_id for r in lake.table("t", lineage=True).collect()} == {k: v for k, v in old.items() if k % 2}
    assert lake.table("t", version=4).count() == 1500


def test_options_reach_the_files(spark, lake):
    import pyarrow.parquet as pq

    for name, value in (("parquet_version", "v2"), ("parquet_compression", "zstd"), ("parquet_compression_level", 19), ("parquet_row_group_size", 100), ("hive_file_pattern", "false")):
        lake.set_option(name, value)
    lake.create_table_as("t", spark.range(1000).select("id", (F.col("id") % 2).alias("k")), partitioned_by=["k"])
    paths = [r["data_file"] for r in lake.list_files("t").collect()]
    assert not any("k=" in p for p in paths)
    meta = [pq.read_metadata(p.removeprefix("file:")) for p in paths]
    assert all(m.num_row_groups >= 2 and m.row_group(0).column(0).compression == "ZSTD" for m in meta)
    assert lake.table("t", where="k = 1").count() == 500 and lake.last_plan.files_read < lake.last_plan.files_total
    lake.set_option("auto_compact", "false", table="t")
    lake.insert("t", spark.range(1000, 1200).select("id", (F.col("id") % 2).alias("k")))
    files = lake.list_files("t").count()
    lake.checkpoint()
    assert lake.list_files("t").count() == files


def test_deletion_vectors_of_many_files(spark, lake, monkeypatch):
    from tarn.operators import dml

    monkeypatch.setattr(dml, "PUFFIN_BYTES", 100)
    lake.create_table("t", "id bigint", options={"write_deletion_vectors": "true"})
    lake.insert("t", spark.range(4000).repartitionByRange(6, "id"))
    lake.delete("t", "id % 3 = 0")
    assert len(lake.store.rows("SELECT * FROM delete_set WHERE format = 'puffin'")) > 1
    assert sorted(r.id for r in lake.table("t").collect()) == [k for k in range(4000) if k % 3]
    assert sorted(r.id for r in lake.deletions("t", 3, 3).collect()) == [k for k in range(4000) if k % 3 == 0]


def test_statistics_that_a_read_loads(spark, lake):
    """Files are ruled out in the store, and statistics are loaded of the predicate's fields and the rest alone."""
    lake.create_table("t", "a bigint, b timestamp_ntz, c double, d string")
    rows = spark.range(1000).selectExpr("id AS a", "timestamp_ntz'2020-01-01' + make_interval(0, 0, 0, CAST(id AS INT)) AS b", "id / 2 AS c", "string(id) AS d")
    lake.insert("t", rows.repartitionByRange(10, "a"))
    for where, n in (("a >= 950", 50), ("a = 5", 1), ("b < timestamp_ntz'2020-01-11'", 10), ("a > 100 AND a <= 140 AND c > 60", 20), ("a = 5 OR a = 900", 2), ("c < 3", 6)):
        del lake.store.log[:]
        assert lake.table("t", where=where).count() == n
        assert 0 < lake.last_plan.files_read <= 3 and lake.last_plan.files_total == 10
        assert not [x for x in lake.store.log if "file_stats WHERE table_id" in x and "field_id" not in x]
    lake.create_table("u", "d date")
    lake.insert("u", spark.sql("SELECT date'2020-01-05' AS d"))
    assert lake.table("u", where="d = timestamp_ntz'2020-01-05 00:00:00'").count() == 1


def test_migration_of_an_older_format(spark, lake):
    lake.create_table_as("t", spark.range(5))
    path = lake.store.path
    lake.close()
    import sqlite3

    db = sqlite3.connect(path)
    db.executescript("DROP TABLE variant_stats; UPDATE option SET value = '1' WHERE name = 'version'")
    db.close()
    with pytest.raises(LakeError, match="automatic_migration"):
        Lake(spark, path)
    again = Lake(spark, path, automatic_migration=True)
    assert again.table("t").count() == 5 and again.settings().first()["version"] == "2"
    again.insert("t", spark.range(3))
    again.store.option_set("version", "9")
    with pytest.raises(LakeError, match="not known"):
        Lake(spark, path, automatic_migration=True)


def test_foreign_delete_files_are_checked(spark, lake, tmp_path):
    lake.create_table_as("t", spark.range(100).coalesce(1))
    path = lake.list_files("t").first()["data_file"]
    for k, (rows, message) in enumerate([([(path, None)], "a null"), ([(path, 5), (path, 5)], "do not rise"), ([(path + "x", 5)], "table lacks"), ([(path, 100)], "beyond")]):
        spark.createDataFrame(rows, "file_path string, pos long").coalesce(1).write.parquet(str(tmp_path / f"d{k}"))
        with pytest.raises(LakeError, match=message):
            lake.add_delete_files("t", [f for f, _, _ in lake.fs.walk(f"{tmp_path}/d{k}") if f.endswith(".parquet")])
    spark.range(3).write.parquet(str(tmp_path / "other"))
    with pytest.raises(LakeError, match="no positional delete file"):
        lake.add_delete_files("t", [f for f, _, _ in lake.fs.walk(f"{tmp_path}/other") if f.endswith(".parquet")][:1])
    assert lake.table("t").count() == 100


def test_variant_bounds_only_of_one_type(spark, lake):
    lake.create_table("t", "id bigint, v variant")
    for text in ('{"k": 1}', '{"k": 50}', '{"k": "a"}', "[1, 2]", "7"):
        lake.insert("t", spark.sql(f"SELECT 1L AS id, parse_json('{text}') AS v"))
    lake.insert("t", spark.sql("SELECT 2L AS id, parse_json(x) AS v FROM VALUES ('{\"k\": 3}'), ('{\"k\": \"z\"}') AS t(x)"))
    assert lake.table("t", where="try_variant_get(v, '$.k', 'bigint') > 20").count() == 1
    assert lake.last_plan.files_read == 5  # one file is ruled out: its only key is 1
    assert lake.table("t", where="try_variant_get(v, '$.k', 'string') = 'a'").count() == 1


def test_transactions_leave_statistics_in_the_store(spark, lake):
    """Files are pruned inside a transaction by statistics of before it and of its own, and merged away ones are forgotten."""
    lake.create_table("t", "a bigint")
    for k in range(4):
        lake.insert("t", spark.range(10 * k, 10 * k + 10).select(F.col("id").alias("a")).coalesce(1))
    with lake.transaction():
        assert lake.store.one("SELECT count(*) FROM own_file_stats")[0] == 0 and lake.store.one("SELECT count(*) FROM file_stats")[0] == 4
        lake.insert("t", spark.range(100, 110).select(F.col("id").alias("a")).coalesce(1))
        for where, n in (("a = 105", 1), ("a < 10", 10), ("a > 500", 0)):
            assert lake.table("t", where=where).count() == n and lake.last_plan.files_read == (n > 0)
        assert lake.merge_adjacent_files("t") == 5
        assert lake.store.one("SELECT count(*) FROM file_stats")[0] == 1
        assert lake.table("t", where="a = 105").count() == 1
    assert lake.table("t").count() == 50 and lake.store.one("SELECT count(*) FROM file_stats")[0] == 1


def test_a_transaction_changes_what_it_inserted(spark, lake):
    lake.create_table("t", "a bigint")
    with lake.transaction():
        lake.insert("t", spark.range(100).select(F.col("id").alias("a")))
        lake.delete("t", "a % 2 = 0")
        lake.update("t", {"a": "a + 1000"}, "a < 10")
        inside = rows(lake.table("t"))
    assert rows(lake.table("t")) == inside == sorted([(k,) for k in range(11, 100, 2)] + [(k + 1000,) for k in range(1, 10, 2)])


def test_writes_leave_no_unknown_files(spark, lake):
    """An empty first partition makes Spark write a file without rows: no orphan may come of it."""
    rows = spark.range(0, 40, 1, 4).where("id >= 20").selectExpr("id", "id % 2 AS g", "'x y%20/=' || id % 2 AS s")
    lake.create_table_as("t", rows)
    lake.create_table_as("p", rows, partitioned_by=["g", "s"])
    lake.create_table_as("none", rows.where("id < 0"))
    assert lake.delete_orphaned_files(cleanup_all=True) == []
    assert [lake.table(t).count() for t in ("t", "p", "none")] == [20, 20, 0]
