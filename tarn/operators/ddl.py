"""Schemas, tables, columns, views and macros: everything that changes the catalog and no rows."""

from __future__ import annotations

import copy
import json
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.errors import LakeError
from tarn.functions import fields, transforms
from tarn.sources.store import columns_at

OPTIONS = (
    "parquet_compression", "parquet_version", "parquet_compression_level", "parquet_row_group_size", "parquet_row_group_size_bytes",
    "data_inlining_row_limit", "target_file_size", "require_commit_message", "hive_file_pattern", "rewrite_delete_threshold",
    "delete_older_than", "expire_older_than", "auto_compact", "per_thread_output", "write_deletion_vectors", "sort_on_insert", "skip_stats_columns",
)
_TABLE_ONLY, _GLOBAL_ONLY = ("skip_stats_columns",), ("expire_older_than",)


def parse_order(text: str) -> dict:
    """{expression, descending, nulls_first} of 'expr [ASC|DESC] [NULLS FIRST|LAST]'."""
    words = text.strip().split()
    nulls = None
    if len(words) > 2 and words[-2].upper() == "NULLS":
        nulls, words = words[-1].upper() == "FIRST", words[:-2]
    down = len(words) > 1 and words[-1].upper() == "DESC"
    if len(words) > 1 and words[-1].upper() in ("ASC", "DESC"):
        words = words[:-1]
    return {"expression": " ".join(words), "descending": down, "nulls_first": bool(nulls)}


class Ddl:
    """Mixed into Lake."""

    # --- schemas ---

    def create_schema(self, name: str, if_not_exists: bool = False) -> None:
        """A schema; a dotted name lies inside another."""
        snapshot = self._now()
        if any(r["name"] == name for r in self.store.alive("namespace", snapshot)):
            if if_not_exists:
                return
            raise LakeError(f'schema "{name}" already exists')
        if "." in name and not any(r["name"] == name.rpartition(".")[0] for r in self.store.alive("namespace", snapshot)):
            raise LakeError(f'schema "{name.rpartition(".")[0]}" does not exist')
        new, uid = self.store.new_id(), uuid.uuid4().hex
        self._commit([lambda s, at: s.run("INSERT INTO namespace VALUES (?, ?, ?, ?, NULL)", new, uid, name, at)], [("created_schema", name)])

    def drop_schema(self, name: str, if_exists: bool = False, cascade: bool = False) -> None:
        snapshot = self._now()
        found = [r for r in self.store.alive("namespace", snapshot) if r["name"] == name]
        if not found:
            if if_exists:
                return
            raise LakeError(f'schema "{name}" does not exist')
        inside = [r for r in self.store.alive("namespace", snapshot) if r["name"] == name or r["name"].startswith(name + ".")]
        ids = {r["schema_id"] for r in inside}
        things = [(kind, r) for kind in ("lake_table", "view", "macro") for r in self.store.alive(kind, snapshot) if r["schema_id"] in ids]
        if (things or len(inside) > 1) and not cascade:
            raise LakeError(f'schema "{name}" is not empty')

        def dropped(s, at):
            for kind, r in things:
                self._end(s, kind, {"lake_table": "table_id", "view": "view_id", "macro": "macro_id"}[kind], r[0], at)
            for i in ids:
                s.run("UPDATE namespace SET end_snapshot = ? WHERE schema_id = ? AND end_snapshot IS NULL", at, i)

        told = [("dropped_schema", r["schema_id"]) for r in inside] + [({"lake_table": "dropped_table", "view": "dropped_view", "macro": "dropped_macro"}[k], r[0]) for k, r in things]
        self._commit([dropped], told)

    @staticmethod
    def _end(store, kind: str, key: str, which: int, at: int) -> None:
        store.run(f"UPDATE {kind} SET end_snapshot = ? WHERE {key} = ? AND end_snapshot IS NULL", at, which)
        if kind == "lake_table":
            for t in ("table_columns", "partition_spec", "sort_spec", "data_file", "inlined_row"):
                extra = ", ended_by = 'drop'" if t == "data_file" else ""
                store.run(f"UPDATE {t} SET end_snapshot = ?{extra} WHERE table_id = ? AND end_snapshot IS NULL", at, which)

    # --- tables ---

    def create_table(self, name: str, schema: T.StructType | str, partitioned_by=(), sorted_by=(), options: dict | None = None, if_not_exists: bool = False, or_replace: bool = False) -> None:
        """A table with columns in Spark's types; keys like 'year(ts)' or 'bucket(8, id)', orders like 'a DESC'."""
        made = self._creation(name, schema, partitioned_by, sorted_by, options, if_not_exists, or_replace)
        if made is not None:
            self._commit([made["op"]], made["told"])

    def _creation(self, name: str, schema: T.StructType | str, partitioned_by, sorted_by, options, if_not_exists: bool, or_replace: bool) -> dict | None:
        """The operation that makes a table, and what an insertion in the same commit must know of it."""
        snapshot = self._now()
        space, own = self._names(name, snapshot)
        old = self._find("lake_table", space, own, snapshot)
        if old is not None or self._find("view", space, own, snapshot) is not None:
            if old is not None and if_not_exists:
                return None
            if old is None or not or_replace:
                raise LakeError(f'"{name}" already exists')
        kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        lower = [f.name.lower() for f in kind.fields]
        if not lower or len(set(lower)) < len(lower):
            raise LakeError("a table needs columns, each with a name of its own")
        ids = iter(range(1, 1 << 30))
        nodes = [fields.node_of(f.name, f.dataType, f.nullable, ids) for f in kind.fields]
        spec = self._partition_keys(nodes, partitioned_by)
        order = [parse_order(o) for o in sorted_by]
        table_id, uid, partition_id, last = self.store.new_id(), uuid.uuid4().hex, self.store.new_id(), next(ids)
        safe = own if own.replace("_", "").isalnum() and own.isascii() else uid
        path = f"{self.data_path}/{space['name'].replace('.', '/') if space['name'].replace('_', '').replace('.', '').isalnum() else space['uuid']}/{safe}-{uid[:8]}"

        def created(s, at):
            if old is not None:
                self._end(s, "lake_table", "table_id", old["table_id"], at)
            s.run("INSERT INTO lake_table VALUES (?, ?, ?, ?, ?, ?, NULL)", table_id, uid, space["schema_id"], own, path, at)
            s.run("INSERT INTO table_columns VALUES (?, ?, ?, ?, NULL)", table_id, json.dumps(nodes), at, at)
            s.run("INSERT INTO next_field VALUES (?, ?)", table_id, last)
            if spec:
                s.run("INSERT INTO partition_spec VALUES (?, ?, ?, ?, NULL)", table_id, partition_id, json.dumps(spec), at)
            if order:
                s.run("INSERT INTO sort_spec VALUES (?, ?, ?, NULL)", table_id, json.dumps(order), at)
            for k, v in (options or {}).items():
                s.option_set(self._option_name(k, "table"), v, "table", table_id)

        told = [*([("dropped_table", old["table_id"])] if old is not None else []), ("created_table", f"{space['name']}.{own}")]
        table = {"table_id": table_id, "schema_id": space["schema_id"], "name": own, "path": path}
        return {"op": created, "told": told, "table": table, "nodes": nodes, "partition": (partition_id if spec else None, spec), "order": order, "options": options}

    def drop_table(self, name: str, if_exists: bool = False) -> None:
        self._drop("lake_table", "table_id", "dropped_table", name, if_exists)

    def _drop(self, kind: str, key: str, told: str, name: str, if_exists: bool, all_of: bool = False) -> None:
        snapshot = self._now()
        space, own = self._names(name, snapshot)
        found = [r for r in self.store.alive(kind, snapshot, "schema_id = ?", space["schema_id"]) if r["name"].lower() == own.lower()]
        if not found:
            if if_exists:
                return
            raise LakeError(f'"{name}" does not exist')
        self._commit([lambda s, at: [self._end(s, kind, key, r[0], at) for r in found]], [(told, r[0]) for r in found])

    def rename_table(self, name: str, to: str) -> None:
        self._rename("lake_table", "table_id", "altered_table", name, to)

    def _rename(self, kind: str, key: str, told: str, name: str, to: str) -> None:
        snapshot = self._now()
        space, own = self._names(name, snapshot)
        row = self._find(kind, space, own, snapshot)
        if row is None:
            raise LakeError(f'"{name}" does not exist')
        if any(self._find(k, space, to, snapshot) is not None for k in ("lake_table", "view")):
            raise LakeError(f'"{to}" already exists')
        columns = row.keys()

        def renamed(s, at):
            s.run(f"UPDATE {kind} SET end_snapshot = ? WHERE {key} = ? AND end_snapshot IS NULL", at, row[key])
            values = [to if c == "name" else at if c == "begin_snapshot" else row[c] for c in columns]
            s.run(f"INSERT INTO {kind} VALUES ({','.join('?' * len(values))})", *values)

        self._commit([renamed], [(told, row[key])])

    # --- columns ---

    def _alter(self, name: str, change) -> None:
        """Commit a new version of a table's columns; change(nodes, ids) edits a copy of the nodes."""
        snapshot = self._now()
        table_id = self._table(name, snapshot)["table_id"]
        nodes = copy.deepcopy(columns_at(self.store, table_id, snapshot))
        old = copy.deepcopy(nodes)
        next_id = self.store.one("SELECT value FROM next_field WHERE table_id = ?", table_id)[0]
        ids = iter(range(next_id, 1 << 30))
        nodes = change(nodes, ids) or nodes
        if nodes == old:
            return
        last = next(ids)

        def altered(s, at):
            s.run("UPDATE table_columns SET end_snapshot = ? WHERE table_id = ? AND end_snapshot IS NULL", at, table_id)
            s.run("INSERT INTO table_columns VALUES (?, ?, ?, ?, NULL)", table_id, json.dumps(nodes), at, at)
            s.run("UPDATE next_field SET value = ? WHERE table_id = ?", last, table_id)

        self._commit([altered], [("altered_table", table_id)])

    @staticmethod
    def _literal(default) -> str | None:
        return None if default is None else default if isinstance(default, str) else ("true" if default else "false") if isinstance(default, bool) else str(default)

    def _is_constant(self, sql: str) -> bool:
        """Whether SQL names no column and calls nothing that changes from row to row or run to run."""
        e = self.spark._jsparkSession.sessionState().sqlParser().parseExpression(sql)
        kinds = {e.getClass().getSimpleName()}
        nodes = [e]
        while nodes:
            x = nodes.pop()
            kinds.add(x.getClass().getSimpleName())
            children = x.children()
            nodes += [children.apply(i) for i in range(children.length())]
        return not kinds & {"UnresolvedAttribute", "UnresolvedFunction"}

    def add_column(self, name: str, column: str, kind: str, default=None, if_not_exists: bool = False) -> None:
        """default: SQL of a literal; rows that are there get it too."""

        def change(nodes, ids):
            if any(n["name"].lower() == column.lower() for n in nodes):
                if if_not_exists:
                    return
                raise LakeError(f'column "{column}" already exists')
            node = fields.node_of(column, T.DataType.fromDDL(kind) if isinstance(kind, str) else kind, True, ids)
            node["default"] = node["initial"] = self._literal(default)
            if default is not None and not self._is_constant(node["default"]):
                raise LakeError("only a literal can be the default of an added column")
            nodes.append(node)

        self._alter(name, change)

    def drop_column(self, name: str, column: str, if_exists: bool = False) -> None:
        snapshot = self._now()
        table_id = self._table(name, snapshot)["table_id"]
        (_, spec), order = self._specs(table_id, snapshot)

        def change(nodes, ids):
            if if_exists and not any(n["name"].lower() == column.lower() for n in nodes):
                return None
            node = fields.find(nodes, column)
            if len(nodes) == 1:
                raise LakeError("the last column can't be dropped")
            inside = {node["id"], *(n["id"] for n, _, _ in fields.leaves([node]))}
            if any(k["field_id"] in inside for k in spec):
                raise LakeError(f'"{column}" is a partition key')
            if any(column.lower() in k["expression"].lower().replace("(", " ").replace(")", " ").replace(",", " ").split() for k in order):
                raise LakeError(f'"{column}" is a sort key')
            nodes.remove(node)

        self._alter(name, change)

    def rename_column(self, name: str, column: str, to: str) -> None:
        def change(nodes, ids):
            parent = fields.find(nodes, column.rpartition(".")[0])["children"] if "." in column else nodes
            node = fields.find(nodes, column)
            if any(n["name"].lower() == to.lower() and n is not node for n in parent):
                raise LakeError(f'column "{to}" already exists')
            node["name"] = to

        self._alter(name, change)

    rename_field = rename_column

    def alter_type(self, name: str, column: str, kind: str) -> None:
        """Widen a scalar; structs, lists and maps change field by field."""

        def change(nodes, ids):
            node = fields.find(nodes, column)
            node.update(fields.retype(node, T.DataType.fromDDL(kind), ids))

        self._alter(name, change)

    def add_field(self, name: str, path: str, kind: str, default=None) -> None:
        """A field in the struct at the path before the last dot."""

        def change(nodes, ids):
            parent, _, field = path.rpartition(".")
            node = fields.find(nodes, parent)
            if node["kind"] != "struct" or any(c["name"].lower() == field.lower() for c in node["children"]):
                raise LakeError(f'can\'t add "{path}"')
            new = fields.node_of(field, T.DataType.fromDDL(kind), True, ids)
            new["default"] = new["initial"] = self._literal(default)
            node["children"].append(new)

        self._alter(name, change)

    def drop_field(self, name: str, path: str) -> None:
        def change(nodes, ids):
            node = fields.find(nodes, path.rpartition(".")[0])
            child = fields.find(nodes, path)
            if len(node["children"]) == 1:
                raise LakeError("the last field of a struct can't be dropped")
            node["children"].remove(child)

        self._alter(name, change)

    def set_default(self, name: str, column: str, default) -> None:
        """SQL for rows to come; None drops it."""
        self._alter(name, lambda nodes, ids: fields.find(nodes, column).update(default=self._literal(default)))

    def drop_default(self, name: str, column: str) -> None:
        self.set_default(name, column, None)

    def set_not_null(self, name: str, column: str) -> None:
        if self.table(name).where(F.col(column).isNull()).limit(1).count():
            raise LakeError(f'NOT NULL constraint failed: {column} holds NULLs')
        self._alter(name, lambda nodes, ids: fields.find(nodes, column).update(nullable=False))

    def drop_not_null(self, name: str, column: str) -> None:
        self._alter(name, lambda nodes, ids: fields.find(nodes, column).update(nullable=True))

    # --- layout ---

    def _partition_keys(self, nodes: list[dict], texts) -> list[dict]:
        spec = []
        for text in texts or ():
            key = transforms.parse(text)
            node = fields.find(nodes, key["column"])
            if node["children"]:
                raise LakeError(f'"{key["column"]}" can\'t be a partition key')
            if key["transform"] in (*transforms.CALENDAR, *transforms.EPOCH) and node["kind"] not in ("date", "timestamp", "timestamp_ntz"):
                raise LakeError(f"{key['transform']} needs a date or a timestamp")
            spec.append({**key, "field_id": node["id"]})
        return spec

    def set_partitioned_by(self, name: str, *keys: str) -> None:
        """New files are partitioned by the keys (by none without any); files that are there stay as they are."""
        snapshot = self._now()
        table_id = self._table(name, snapshot)["table_id"]
        spec = self._partition_keys(columns_at(self.store, table_id, snapshot), keys)
        if [(k["transform"], k["field_id"], k["arg"]) for k in self._specs(table_id, snapshot)[0][1]] == [(k["transform"], k["field_id"], k["arg"]) for k in spec]:
            return
        partition_id = self.store.new_id()

        def set_(s, at):
            s.run("UPDATE partition_spec SET end_snapshot = ? WHERE table_id = ? AND end_snapshot IS NULL", at, table_id)
            if spec:
                s.run("INSERT INTO partition_spec VALUES (?, ?, ?, ?, NULL)", table_id, partition_id, json.dumps(spec), at)

        self._commit([set_], [("altered_table", table_id)])

    def set_sorted_by(self, name: str, *order: str) -> None:
        snapshot = self._now()
        table_id = self._table(name, snapshot)["table_id"]
        spec = [parse_order(o) for o in order]
        self.table(name).select(*(F.expr(k["expression"]) for k in spec))  # names and types are right

        def set_(s, at):
            s.run("UPDATE sort_spec SET end_snapshot = ? WHERE table_id = ? AND end_snapshot IS NULL", at, table_id)
            if spec:
                s.run("INSERT INTO sort_spec VALUES (?, ?, ?, NULL)", table_id, json.dumps(spec), at)

        self._commit([set_], [("altered_table", table_id)])

    # --- options and comments ---

    @staticmethod
    def _option_name(name: str, scope: str) -> str:
        name = name.lower()
        if name not in OPTIONS or scope != "table" and name in _TABLE_ONLY or scope != "global" and name in _GLOBAL_ONLY:
            raise LakeError(f'unknown option "{name}" for a {scope}')
        return name

    def set_option(self, name: str, value, schema: str | None = None, table: str | None = None) -> None:
        """Set (None: reset) an option of the lake, a schema or a table; the narrowest counts."""
        snapshot = self._now()
        scope, scope_id = "global", -1
        if table is not None:
            scope, scope_id = "table", self._table(table if schema is None else f"{schema}.{table}", snapshot)["table_id"]
        elif schema is not None:
            scope, scope_id = "schema", self._schema(schema, snapshot)["schema_id"]
        self.store.option_set(self._option_name(name, scope), value, scope, scope_id)

    def comment(self, what: str, name: str, text: str | None, column: str = "") -> None:
        """COMMENT ON table, view or column."""
        snapshot = self._now()
        kind = {"table": "lake_table", "column": "lake_table", "view": "view", "view column": "view"}[what]
        space, own = self._names(name, snapshot)
        row = self._find(kind, space, own, snapshot)
        if row is None:
            raise LakeError(f'"{name}" does not exist')
        field = str(fields.find(columns_at(self.store, row[0], snapshot), column)["id"]) if what == "column" else column

        def told(s, at):
            s.run("UPDATE tag SET end_snapshot = ? WHERE object = ? AND object_id = ? AND field = ? AND key = 'comment' AND end_snapshot IS NULL", at, kind, row[0], field)
            if text is not None:
                s.run("INSERT INTO tag VALUES (?, ?, ?, 'comment', ?, ?, NULL)", kind, row[0], field, text, at)

        self._commit([told], [("altered_table" if kind == "lake_table" else "altered_view", row[0])])

    def comments(self, name: str, version: int | None = None) -> dict[str, str]:
        """Comments of a table or view: by column name, its own under ''."""
        snapshot = self._snapshot(version, None)
        space, own = self._names(name, snapshot)
        for kind in ("lake_table", "view"):
            if (row := self._find(kind, space, own, snapshot)) is not None:
                names = {str(n["id"]): n["name"] for n in columns_at(self.store, row[0], snapshot)} if kind == "lake_table" else {}
                return {names.get(t["field"], t["field"]): t["value"] for t in self.store.alive("tag", snapshot, "object = ? AND object_id = ?", kind, row[0])}
        raise LakeError(f'"{name}" does not exist')

    # --- views and macros ---

    def create_view(self, name: str, sql: str, aliases: list[str] | None = None, or_replace: bool = False) -> None:
        snapshot = self._now()
        space, own = self._names(name, snapshot)
        old = self._find("view", space, own, snapshot)
        if self._find("lake_table", space, own, snapshot) is not None or old is not None and not or_replace:
            raise LakeError(f'"{name}" already exists')
        view_id, uid = self.store.new_id(), uuid.uuid4().hex

        def created(s, at):
            if old is not None:
                self._end(s, "view", "view_id", old["view_id"], at)
            s.run("INSERT INTO view VALUES (?, ?, ?, ?, ?, ?, ?, NULL)", view_id, uid, space["schema_id"], own, sql, json.dumps(aliases), at)

        self._commit([created], [("created_view", f"{space['name']}.{own}")])

    def drop_view(self, name: str, if_exists: bool = False) -> None:
        self._drop("view", "view_id", "dropped_view", name, if_exists)

    def rename_view(self, name: str, to: str) -> None:
        self._rename("view", "view_id", "altered_view", name, to)

    def create_macro(self, name: str, parameters: str, body: str, table: str | None = None) -> None:
        """A SQL macro: parameters like 'a INT, b INT DEFAULT 1'; a scalar expression, or a query with the columns that table
        names. Macros of one name may differ in their number of parameters."""
        snapshot = self._now()
        space, own = self._names(name, snapshot)
        count = len([p for p in parameters.split(",") if p.strip()])
        for r in self.store.alive("macro", snapshot, "schema_id = ?", space["schema_id"]):
            if r["name"].lower() == own.lower() and len([p for p in r["parameters"].split(",") if p.strip()]) == count:
                raise LakeError(f'macro "{name}" with {count} parameters already exists')
        macro_id, kind = self.store.new_id(), "scalar" if table is None else f"table {table}"
        self._commit([lambda s, at: s.run("INSERT INTO macro VALUES (?, ?, ?, ?, ?, ?, ?, NULL)", macro_id, space["schema_id"], own, kind, parameters, body, at)], [("created_macro", f"{space['name']}.{own}")])

    def drop_macro(self, name: str, if_exists: bool = False) -> None:
        self._drop("macro", "macro_id", "dropped_macro", name, if_exists)
