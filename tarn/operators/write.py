"""Writes: INSERT, CREATE TABLE AS, and the files, statistics and inlined rows behind every other change."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.errors import LakeError
from tarn.functions import fields, transforms
from tarn.operators.scan import JSON_FORMAT
from tarn.plans import pruning
from tarn.sources.store import columns_at

INLINE_LIMIT = 10
INLINE_BYTES = 64 << 20  # an input estimated larger than this is never tried as an inlined one
TARGET_FILE_SIZE = 512 << 20
_NOT_INLINED = ("void", "variant", "interval", "geometry", "geography", "time(")
_BOUNDED = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "string", "date", "timestamp_ntz", "timestamp")
_TYPE_BYTES = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "date": 4, "float": 4, "string": 24, "binary": 100, "variant": 100}  # a value, as far as a type tells
_STRING_BOUND = 256  # longer strings are no bounds: a missing bound never prunes


class Write:
    """Mixed into Lake."""

    def insert(self, name: str, rows: DataFrame) -> None:
        """Append rows; columns go by name, missing ones get their default."""
        snapshot = self._now()
        table = self._table(name, snapshot)
        nodes = columns_at(self.store, table["table_id"], snapshot)
        op = self._insertion(table, nodes, self._aligned(rows, nodes), snapshot)
        self._commit([op], self._inserted(table["table_id"], op))

    def create_table_as(self, name: str, rows: DataFrame, partitioned_by=(), sorted_by=(), options: dict | None = None, or_replace: bool = False) -> None:
        """Create a table with the columns of rows and insert them, in one commit."""
        made = self._creation(name, rows.schema, partitioned_by, sorted_by, options, False, or_replace)
        self._new_options = {k.lower(): v for k, v in (options or {}).items()}
        try:
            inserted = self._insertion(made["table"], made["nodes"], self._aligned(rows, made["nodes"]), self._now(), layout=(made["partition"], made["order"]))
        finally:
            self._new_options = {}
        self._commit([made["op"], inserted], [*made["told"], *self._inserted(made["table"]["table_id"], inserted)])

    @staticmethod
    def _inserted(table_id: int, op) -> list[tuple[str, object]]:
        return [("inlined_insert" if op.inlined else "inserted_into_table", table_id)]

    def _aligned(self, rows: DataFrame, nodes: list[dict]) -> DataFrame:
        """rows with the table's columns in order, cast to their types and named c<id>."""
        given = {c.lower(): c for c in rows.columns}
        extra = set(given) - {n["name"].lower() for n in nodes}
        if extra:
            raise LakeError(f"the table has no column {', '.join(sorted(extra))}")
        columns = []
        for n in nodes:
            kind = fields.spark_type(n, physical=True)
            if n["name"].lower() in given:
                columns.append(F.col(f"`{given[n['name'].lower()]}`").cast(fields.spark_type(n)).cast(kind).alias(f"c{n['id']}"))
            else:
                default = F.expr(n["default"]) if n["default"] is not None else F.lit(None)
                columns.append(default.cast(kind).alias(f"c{n['id']}"))
        return rows.select(*columns)

    def _specs(self, table_id: int, snapshot: int):
        spec = self.store.alive("partition_spec", snapshot, "table_id = ?", table_id)
        sort = self.store.alive("sort_spec", snapshot, "table_id = ?", table_id)
        return (spec[0]["partition_id"], json.loads(spec[0]["spec"])) if spec else (None, []), json.loads(sort[0]["spec"]) if sort else []

    def _insertion(self, table, nodes: list[dict], rows: DataFrame, snapshot: int, row_ids: bool = False, known: int | None = None, layout: tuple | None = None):
        """An operation that adds physical rows (c<id>, and _row_id if row_ids) to a table. known: their number, if it is.
        layout: a new table's ((partition id, keys), sort order), which the store does not know yet."""
        table_id = table["table_id"]
        limit = int(self.option("data_inlining_row_limit", INLINE_LIMIT, table))
        specs = layout or self._specs(table_id, snapshot)
        written = json.dumps(nodes)
        plain = not any(k in n["kind"] for n, _, _ in fields.leaves(nodes) for k in _NOT_INLINED) and '"map"' not in written
        if limit > 0 and plain and (known <= limit if known is not None else self._estimate(rows) <= INLINE_BYTES):
            body = F.to_json(F.struct(*(F.col(f"c{n['id']}") for n in nodes)), {**JSON_FORMAT, "ignoreNullFields": "false"})
            few = rows.select(body.alias("b"), (F.col("_row_id") if row_ids else F.lit(None).cast("long")).alias("r"), *(F.col(f"c{n['id']}").isNull().alias(f"n{n['id']}") for n in nodes if not n["nullable"])).limit(limit + 1).collect()
            if len(few) <= limit:
                for n in nodes:
                    if not n["nullable"] and any(r[f"n{n['id']}"] for r in few):
                        raise LakeError(f'NOT NULL constraint failed: {n["name"]}')
                bodies = [(r["b"], r["r"]) for r in few]

                def inlined(store, at):
                    for body, row_id in bodies:
                        store.run("INSERT INTO inlined_row VALUES (?, ?, ?, ?, ?, NULL)", table_id, self._take_rows(store, table_id, 1) if row_id is None else row_id, written, body, at)

                inlined.inlined = True
                return inlined
        files = self._write_files(table, nodes, rows, specs)

        def added(store, at):
            self._add_files(store, table_id, files, at, row_ids=row_ids)

        added.inlined = False
        added.files = files
        return added

    def _estimate(self, rows: DataFrame) -> int:
        """Catalyst's estimate in bytes; 0 where it has none (rows that come from Python)."""
        n = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        return 0 if n >= 1 << 60 else n

    @staticmethod
    def _take_rows(store, table_id: int, n: int) -> int:
        row = store.one("SELECT next_row_id FROM table_stats WHERE table_id = ?", table_id)
        start = row[0] if row else 0
        store.run("INSERT OR REPLACE INTO table_stats VALUES (?, ?)", table_id, start + n)
        return start

    def _write_files(self, table, nodes: list[dict], rows: DataFrame, specs: tuple, sort: bool = True, by: str | None = None, single: bool = True) -> list[dict]:
        """Write physical rows as Parquet into a folder of their own; the files with their statistics.

        specs: ((partition id, keys), sort order). by: a column whose values get files of their own and are no partition keys.
        """
        (partition_id, keys), order = specs
        logical = {tuple(x.lower() for x in names): (n, ids) for (n, names, ids) in fields.leaves(nodes)}
        extra = [c for c in rows.columns if c.startswith("_") and c != by]
        out = rows
        # Keys are copies with names of their own, so the columns stay in the files.
        names = [by] if by else []
        for key, label in zip(keys, transforms.key_names(keys), strict=True):
            node, ids = logical[self._path_of(nodes, key["field_id"])]
            out = out.withColumn(f"{label}" if label not in out.columns else f"_p_{label}", transforms.apply(key["transform"], self._physical(ids), node["kind"], key["arg"]))
            names.append(out.columns[-1])
        if sort and order and str(self.option("sort_on_insert", "true", table)).lower() != "false":
            out = self._sorted(out, nodes, order, names)
        elif keys and str(self.option("per_thread_output", "false", table)).lower() != "true":
            out = out.hint("rebalance", *names)  # few files a key, and a key with many rows still split
        folder = f"{table['path']}/{uuid.uuid4().hex}"
        writer = out.write.options(**self._writer_options(table))
        if single:
            target = int(self.option("target_file_size", TARGET_FILE_SIZE, table))
            writer = writer.option("maxRecordsPerFile", max(1, int(target // self._row_bytes(table, nodes))))
        (writer.partitionBy(*names) if names else writer).parquet(folder)
        files = self._harvest(folder, nodes, names, extra, table)
        # Spark writes a file without rows for an empty first partition; the store would not know it.
        told = {self.fs.canonical(f["path"]) for f in files}
        for path, _, _ in self.fs.walk(folder):
            if path.endswith(".parquet") and path not in told:
                self.fs.delete(path)
        for f in files:
            f["partition_id"] = partition_id
        if keys and str(self.option("hive_file_pattern", "true", table)).lower() == "false":
            self._flattened(folder, files)
        self._written.append(folder)
        return files

    def _writer_options(self, table) -> dict[str, str]:
        """The Parquet writer's options, from the lake's."""
        codec = str(self.option("parquet_compression", "zstd", table)).lower()
        out = {"compression": codec}
        if size := self.option("parquet_row_group_size_bytes", None, table):
            out["parquet.block.size"] = str(size)
        if rows := self.option("parquet_row_group_size", None, table):
            out["parquet.block.row.count.limit"] = str(rows)
        if version := self.option("parquet_version", None, table):
            out["parquet.writer.version"] = {"1": "PARQUET_1_0", "2": "PARQUET_2_0"}[str(version).lower().removeprefix("v")]
        if level := self.option("parquet_compression_level", None, table):
            if codec == "zstd":
                out["parquet.compression.codec.zstd.level"] = str(level)
            elif codec == "gzip":
                out["zlib.compress.level"] = {"0": "NO_COMPRESSION", "1": "BEST_SPEED", "9": "BEST_COMPRESSION", "2": "TWO", "3": "THREE", "4": "FOUR", "5": "FIVE", "6": "SIX", "7": "SEVEN", "8": "EIGHT"}[str(level)]
        return out

    def _row_bytes(self, table, nodes: list[dict]) -> float:
        """Bytes of a row in a file: as in the table's files so far, or by the columns' types."""
        row = self.store.one("SELECT sum(size), sum(record_count) FROM (SELECT size, record_count FROM data_file WHERE table_id = ? ORDER BY file_id DESC LIMIT 100)", table["table_id"])
        if row[1]:
            return max(1.0, row[0] / row[1])
        return max(8.0, sum(_TYPE_BYTES.get(n["kind"], 8) for n, _, _ in fields.leaves(nodes)))

    def _flattened(self, folder: str, files: list[dict]) -> None:
        """Move files out of their key folders, whose names then do not tell the keys."""
        for f in files:
            path = f"{folder}/{uuid.uuid4().hex}.parquet"
            self.fs.rename(f["path"], path)
            f["path"], f["reported"] = path, self.fs.reported(path)

    def _path_of(self, nodes, field_id: int) -> tuple[str, ...]:
        return next(tuple(x.lower() for x in names) for n, names, _ in fields.leaves(nodes) if n["id"] == field_id)

    @staticmethod
    def _physical(ids: tuple[int, ...]):
        column = F.col(f"c{ids[0]}")
        for i in ids[1:]:
            column = column[f"c{i}"]
        return column

    def _sorted(self, rows: DataFrame, nodes: list[dict], order: list[dict], first: list[str] = (), within: bool = False) -> DataFrame:
        """rows in the order of a sort spec, as a whole or within partitions; its expressions are over the table's column names."""
        wide = rows.select("*", F.struct(*(fields.to_logical(F.col(f"c{n['id']}"), n, n).alias(n["name"]) for n in nodes)).alias("_row"))
        names = [f"_s{k}" for k in range(len(order))]
        wide = wide.select("*", "_row.*")
        for name, key in zip(names, order, strict=True):
            wide = wide.withColumn(name, F.expr(key["expression"]))
        keys = [getattr(F.col(n), ("desc" if k["descending"] else "asc") + ("_nulls_first" if k["nulls_first"] else "_nulls_last"))() for n, k in zip(names, order, strict=True)]
        return (wide.sortWithinPartitions if within else wide.orderBy)(*first, *keys).select(*rows.columns)

    def _harvest(self, folder: str, nodes: list[dict], keys: list[str], extra: list[str], table) -> list[dict]:
        """One aggregation over the written files: rows, and counts, bounds and NaNs of every scalar column."""
        skip = {x.strip().lower() for x in str(self.option("skip_stats_columns", "", table) or "").split(",")}
        schema = fields.schema_of(nodes, physical=True)
        read = self.spark.read.schema(schema).parquet(folder)
        aggregates = [F.count("*").alias("rows")]
        tracked = [(n, names, ids) for n, names, ids in fields.leaves(nodes)]
        for n, names, ids in tracked:
            c = self._physical(ids)
            aggregates.append(F.count(c).alias(f"n{n['id']}"))
            if (n["kind"] in _BOUNDED or n["kind"].startswith("decimal")) and ".".join(names).lower() not in skip:
                value = c
                if n["kind"] in ("float", "double"):
                    aggregates.append(F.max(F.isnan(c)).alias(f"f{n['id']}"))
                    value = F.when(~F.isnan(c), c)
                elif n["kind"] == "timestamp":
                    value = F.to_utc_timestamp(c, F.current_timezone()).cast("timestamp_ntz")
                aggregates += [F.min(value).alias(f"l{n['id']}"), F.max(value).alias(f"h{n['id']}")]
        found = read.groupBy(F.col("_metadata.file_path").alias("reported"), F.col("_metadata.file_size").alias("size")).agg(*aggregates).collect()
        layout, out = json.dumps(nodes), []
        keys_of = self._variant_stats(read, nodes, skip)
        # A required column is required where it stands: at the top, or inside a struct that is there.
        for r in found:
            for n in nodes:
                if not n["nullable"] and n["kind"] != "struct" and f"n{n['id']}" in r.__fields__ and r[f"n{n['id']}"] < r["rows"]:
                    self.fs.delete(folder, True)
                    raise LakeError(f'NOT NULL constraint failed: {n["name"]}')
            stats = []
            for n, _, _ in tracked:
                get = lambda k, n=n, r=r: r[f"{k}{n['id']}"] if f"{k}{n['id']}" in r.__fields__ else None
                bounds = [pruning.encode(x) if not (isinstance(x, str) and len(x) > _STRING_BOUND) else None for x in (get("l"), get("h"))]
                stats.append((n["id"], r["rows"], r["rows"] - get("n"), *bounds, int(bool(get("f")))))
            path = self._readable(r["reported"])
            values = [None if v == "__HIVE_DEFAULT_PARTITION__" else v for v in self._key_values(r["reported"], keys)] if keys else None
            out.append({"keys": values, "variants": keys_of.get(r["reported"], []), "path": path, "reported": r["reported"], "rows": r["rows"], "size": r["size"], "layout": layout, "stats": stats, "partition_values": json.dumps(values) if values is not None else None, "partition_id": None})
        return out

    def _variant_stats(self, read: DataFrame, nodes: list[dict], skip: set[str]) -> dict[str, list[tuple]]:
        """By file (field id, key, kind, min, max) of the keys of variant objects whose values in the file all have one type, of
        keys that a hundredth of the rows have at least."""
        out: dict[str, list[tuple]] = {}
        for n in nodes:
            if n["kind"] != "variant" or n["name"].lower() in skip:
                continue
            column = f"c{n['id']}"
            one = read.select(F.col("_metadata.file_path").alias("path"), column)
            rows = {r["path"]: r["count"] for r in one.groupBy("path").count().collect()}
            parts = one.lateralJoin(self.spark.tvf.variant_explode(F.col(column).outer())).where("key is not null")
            kind = F.lower(F.schema_of_variant("value"))
            whole, text = F.try_variant_get("value", "$", "bigint"), F.try_variant_get("value", "$", "string")
            told = parts.select("path", "key", kind.alias("kind"), F.try_variant_get("value", "$", "double").alias("d"), whole.alias("w"), text.alias("t"))
            told = told.groupBy("path", "key").agg(F.count("*").alias("n"), F.min("kind").alias("lo"), F.max("kind").alias("hi"), *(f(c).alias(f"{f.__name__}_{c}") for c in "wdt" for f in (F.min, F.max)))
            for r in told.where("lo = hi and lo in ('bigint', 'double', 'string')").collect():
                if r["n"] * 100 < rows[r["path"]]:
                    continue
                low, high = (r[f"{f}_{ {'bigint': 'w', 'double': 'd', 'string': 't'}[r['lo']]}"] for f in ("min", "max"))
                if not any(isinstance(x, float) and x != x or isinstance(x, str) and len(x) > _STRING_BOUND or x is None for x in (low, high)):
                    out.setdefault(r["path"], []).append((n["id"], r["key"], r["lo"], pruning.encode(low), pruning.encode(high)))
        return out

    @staticmethod
    def _readable(reported: str) -> str:
        from urllib.parse import unquote

        return unquote(reported)

    def _key_values(self, reported: str, keys: list[str]) -> list[str]:
        from urllib.parse import unquote

        parts = dict(unquote(p).split("=", 1) for p in reported.split("/")[:-1] if "=" in unquote(p))
        return [unquote(parts[k]) for k in keys]

    def _add_files(self, store, table_id: int, files: list[dict], at: int, row_ids: bool = False, snapshots: bool = False, begin: int | None = None, partial_max: int | None = None, mapping: str | None = None) -> list[int]:
        ids = []
        for f in files:
            # Given once: a transaction's later operations name the file, and all are run again when it commits.
            file_id = f["file_id"] = f.get("file_id") or self.store.new_id()
            start = None if row_ids else self._take_rows(store, table_id, f["rows"])
            store.run(
                "INSERT INTO data_file VALUES (?,?,?,?,?,?,?,?,?,?,?,?,?,?,?,?,?)",
                file_id, table_id, f["path"], f["reported"], f["rows"], f["size"], start, f["partition_id"], f["partition_values"], f["layout"],
                f.get("mapping") or mapping, int(row_ids), int(snapshots), partial_max, None, at if begin is None else begin, None,
            )
            store.many("INSERT INTO file_stats VALUES (?,?,?,?,?,?,?,?)", [(file_id, table_id, *s) for s in f["stats"]])
            store.many("INSERT INTO variant_stats VALUES (?,?,?,?,?,?,?)", [(file_id, table_id, *v) for v in f.get("variants", ())])
            ids.append(file_id)
        return ids
