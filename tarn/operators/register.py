"""Registration of Parquet files that were written elsewhere: no data moves."""

from __future__ import annotations

import json
from urllib.parse import unquote

from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.errors import LakeError
from tarn.functions import fields
from tarn.plans import pruning
from tarn.sources import footers
from tarn.sources.store import columns_at


class Register:
    """Mixed into Lake."""

    def add_data_files(self, name: str, paths: str | list[str], schema: str | None = None, allow_missing: bool = False, ignore_extra_columns: bool = False, hive_partitioning: bool | None = None, by_position: bool = False) -> int:
        """Add Parquet files (globs or a list) to a table; columns go by name, those of hive folders too. The number of files.

        A column that the table has and a file lacks is an error unless allow_missing, then it reads as its initial default; one
        that only the file has is an error unless ignore_extra_columns. A file's type must widen to the table's. by_position: the
        n-th column of a file is the table's n-th, whatever its name.
        """
        snapshot = self._now()
        table = self._table(name if schema is None else f"{schema}.{name}", snapshot)
        nodes = columns_at(self.store, table["table_id"], snapshot)
        files = [f for p in ([paths] if isinstance(paths, str) else paths) for f in (self.fs.glob(p) if any(x in p for x in "*?[{") else [self.fs.canonical(p)])]
        if not files:
            raise LakeError("no files found")
        for path in files:
            if not self.fs.exists(path):
                raise LakeError(f"no such file: {path}")
        read = footers.opened(self.spark, files)
        groups: dict[str, list] = {}  # files of one schema and with one set of key folders are judged together
        for path, (footer, kind, size) in zip(files, read, strict=True):
            folders = dict(unquote(x).split("=", 1) for x in path.split("/")[:-1] if "=" in unquote(x)) if hive_partitioning is not False else {}
            plain = T.StructType([T.StructField(f.name, f.dataType) for f in kind.fields])
            groups.setdefault(json.dumps([sorted(folders), plain.json()]), []).append((path, folders, plain, footer, size))
        ops = [self._registered(table, nodes, group, group[0][2], allow_missing, ignore_extra_columns, by_position) for group in groups.values()]
        self._commit(ops, [("inserted_into_table", table["table_id"])])
        return len(files)

    def add_delete_files(self, name: str, paths: str | list[str], schema: str | None = None) -> int:
        """Apply positional delete files that were written elsewhere: Parquet with the columns file_path and pos, and perhaps row.
        The number of rows deleted.

        Each file is checked as a whole: its columns, no nulls, strictly rising places within a data file, data files that the
        table has and places that these have.
        """
        snapshot = self._now()
        table = self._table(name if schema is None else f"{schema}.{name}", snapshot)
        paths = [paths] if isinstance(paths, str) else list(paths)
        alive = {self.fs.canonical(f["path"]): f for f in self._files(table["table_id"], snapshot)}
        for path, (_, kind, _) in zip(paths, footers.opened(self.spark, paths), strict=True):
            names = [(f.name, f.dataType.simpleString()) for f in kind.fields][:2]
            if names != [("file_path", "string"), ("pos", "bigint")] or len(kind.fields) > 3:
                raise LakeError(f"{path} is no positional delete file")
        known = self.spark.createDataFrame([(p, f["file_id"], f["record_count"]) for p, f in alive.items()] or [(None, None, None)], "file_path string, _file_id long, n long")
        rows = self.spark.read.schema("file_path string, pos long").parquet(*paths).select("file_path", "pos", F.col("_metadata.file_path").alias("of"), F.col("_metadata.row_index").alias("at"))
        last = F.lag("pos").over(W.partitionBy("of", "file_path").orderBy("at"))
        rows = rows.withColumn("last", last).join(F.broadcast(known), "file_path", "left")
        faults = {"a null": F.col("file_path").isNull() | F.col("pos").isNull(), "places that do not rise": F.col("pos") <= F.col("last"), "a data file that the table lacks": F.col("_file_id").isNull(), "a place beyond its data file": (F.col("pos") < 0) | (F.col("pos") >= F.col("n"))}
        found = rows.agg(*(F.count(F.when(c, 1)).alias(f"k{i}") for i, c in enumerate(faults.values()))).first()
        for n, what in zip(found, faults, strict=True):
            if n:
                raise LakeError(f"a delete file holds {what}")
        now = self._scan(table["table_id"], snapshot, lineage=True)
        return self._delete_rows(table, now.join(rows.select("_file_id", F.col("pos").alias("_pos")), ["_file_id", "_pos"], "left_semi"), snapshot)

    def _registered(self, table, nodes, group, kind: T.StructType, allow_missing, ignore_extra, by_position):
        if by_position:
            titles = [n["name"].lower() for n in nodes if n["name"].lower() not in {k.lower() for k in group[0][1]}]
            own = {titles[i] if i < len(titles) else f"\0{i}": f for i, f in enumerate(kind.fields)}
        else:
            own = {f.name.lower(): f for f in kind.fields}
        folders = {k.lower(): k for k in group[0][1]}
        layout, names, hive_of = [], {}, {}
        for n in nodes:
            f = own.get(n["name"].lower())
            if f is not None:
                if fields_type := self._foreign(n, f):
                    layout.append(fields_type)
                    names[str(n["id"])] = f.name
            elif n["name"].lower() in folders:
                layout.append(n)
                names[str(n["id"])] = None
                hive_of[str(n["id"])] = folders[n["name"].lower()]
            elif not allow_missing:
                raise LakeError(f'column "{n["name"]}" is missing in {group[0][0]}')
        extra = set(own) - {n["name"].lower() for n in nodes}
        if extra and not ignore_extra:
            raise LakeError(f"{group[0][0]} has columns that the table lacks: {', '.join(sorted(own[x].name for x in extra))}")
        by_name = {names[str(n["id"])]: n for n in layout if names[str(n["id"])] and not n["children"]}
        out = []
        for path, own_folders, _, footer, size in group:
            rows, found = footers.statistics(footer, {k: n["kind"] for k, n in by_name.items()})
            stats = []
            for column, (nulls, low, high, nan) in found.items():
                n = by_name[column]
                if nulls and not n["nullable"]:
                    raise LakeError(f'NOT NULL constraint failed: {n["name"]}')
                stats.append((n["id"], rows, nulls, pruning.encode(low), pruning.encode(high), int(nan)))
            mapping = {"fields": names, "hive": {i: self._hive_value(own_folders[k]) for i, k in hive_of.items()}}
            if rows:
                out.append({"path": path, "reported": self.fs.reported(path), "rows": rows, "size": size, "layout": json.dumps(layout), "stats": stats, "partition_values": None, "partition_id": None, "mapping": json.dumps(mapping)})
        table_id = table["table_id"]
        return lambda s, at: self._add_files(s, table_id, out, at)

    @staticmethod
    def _hive_value(text: str) -> str | None:
        return None if text == "__HIVE_DEFAULT_PARTITION__" else unquote(text)

    @staticmethod
    def _foreign(node: dict, f: T.StructField) -> dict:
        """The node as the file has it; an error if its type can't become the table's."""
        if node["children"]:
            wanted = fields.spark_type(node)
            if not isinstance(f.dataType, type(wanted)):
                raise LakeError(f'"{f.name}" is {f.dataType.simpleString()} in the file and {wanted.simpleString()} in the table')
            return node
        kind = f.dataType.simpleString()
        if not fields.widens(kind, node["kind"]) and not (kind, node["kind"]) in (("timestamp", "timestamp_ntz"), ("timestamp_ntz", "timestamp"), ("int", "float"), ("bigint", "double")):
            raise LakeError(f'"{f.name}" is {kind} in the file and {node["kind"]} in the table')
        return {**node, "kind": kind}
