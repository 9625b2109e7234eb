"""Columns by field id: a table's columns are trees of nodes, and files hold each node under the name c<id>.

A node is a dict: id, name, kind ("struct", "array", "map" or a Spark type), children, nullable, default, initial. Names may
change, ids don't, so a file stays readable whatever its table's columns are called later.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.errors import LakeError

_ELEMENTS = {"array": ("element",), "map": ("key", "value")}
#: Widenings that keep every value, by kind: what each may become.
_WIDER = {
    "tinyint": ("smallint", "int", "bigint", "float", "double"),
    "smallint": ("int", "bigint", "float", "double"),
    "int": ("bigint", "double"),
    "bigint": (),
    "float": ("double",),
    "date": ("timestamp_ntz",),
    "void": ("tinyint", "smallint", "int", "bigint", "float", "double", "string", "date", "timestamp", "timestamp_ntz", "boolean", "binary"),
}
_DIGITS = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}


def node_of(name: str, kind: T.DataType, nullable: bool, ids) -> dict:
    """A node, with ids drawn from the iterator, for a Spark type."""
    node = {"id": next(ids), "name": name, "nullable": nullable, "default": None, "initial": None, "children": []}
    if isinstance(kind, T.StructType):
        if not kind.fields:
            raise LakeError("a struct needs at least one field")
        node["kind"] = "struct"
        node["children"] = [node_of(f.name, f.dataType, f.nullable, ids) for f in kind.fields]
    elif isinstance(kind, T.ArrayType):
        node["kind"] = "array"
        node["children"] = [node_of("element", kind.elementType, kind.containsNull, ids)]
    elif isinstance(kind, T.MapType):
        node["kind"] = "map"
        node["children"] = [node_of("key", kind.keyType, False, ids), node_of("value", kind.valueType, kind.valueContainsNull, ids)]
    else:
        node["kind"] = kind.simpleString()
    return node


def spark_type(node: dict, physical: bool = False) -> T.DataType:
    kind, children = node["kind"], node["children"]
    if kind == "struct":
        return T.StructType([T.StructField(f"c{c['id']}" if physical else c["name"], spark_type(c, physical)) for c in children])
    if kind == "array":
        return T.ArrayType(spark_type(children[0], physical))
    if kind == "map":
        return T.MapType(*(spark_type(c, physical) for c in children))
    return T.DataType.fromDDL(kind)


def schema_of(nodes: list[dict], physical: bool = False) -> T.StructType:
    return T.StructType([T.StructField(f"c{n['id']}" if physical else n["name"], spark_type(n, physical)) for n in nodes])


def leaves(nodes: list[dict], path: tuple[str, ...] = (), ids: tuple[int, ...] = ()):
    """(node, names, ids) of all fields that have statistics: scalars, at the top or inside structs."""
    for n in nodes:
        if n["kind"] == "struct":
            yield from leaves(n["children"], (*path, n["name"]), (*ids, n["id"]))
        elif n["kind"] not in _ELEMENTS:
            yield n, (*path, n["name"]), (*ids, n["id"])


def find(nodes: list[dict], path: str | tuple[str, ...]) -> dict:
    """The node at a dotted path; names are compared without case."""
    names = path.split(".") if isinstance(path, str) else list(path)
    node = next((n for n in nodes if n["name"].lower() == names[0].lower()), None)
    if node is None:
        raise LakeError(f'column "{names[0]}" does not exist')
    return node if len(names) == 1 else find(node["children"], tuple(names[1:]))


def to_logical(column: Column, written: dict | None, wanted: dict) -> Column:
    """A file's column (as the node it was written with) as the wanted node; what the file lacks is its initial default."""
    target = spark_type(wanted)
    if written is None:
        return F.expr(wanted["initial"]).cast(target) if wanted["initial"] is not None else F.lit(None).cast(target)
    if _same(written, wanted):
        return column if not wanted["children"] else column.cast(target)
    if wanted["kind"] == "struct":
        by_id = {c["id"]: c for c in written["children"]}
        fields = [to_logical(column[f"c{c['id']}"] if c["id"] in by_id else column, by_id.get(c["id"]), c).alias(c["name"]) for c in wanted["children"]]
        return F.when(column.isNotNull(), F.struct(*fields)).cast(target)
    if wanted["kind"] == "array":
        return F.transform(column, lambda x: to_logical(x, written["children"][0], wanted["children"][0])).cast(target)
    if wanted["kind"] == "map":
        changed = F.transform_values(column, lambda _, v: to_logical(v, written["children"][1], wanted["children"][1]))
        return F.transform_keys(changed, lambda k, _: to_logical(k, written["children"][0], wanted["children"][0])).cast(target)
    return column.cast(target)


def _same(a: dict, b: dict) -> bool:
    return (a["id"], a["kind"]) == (b["id"], b["kind"]) and len(a["children"]) == len(b["children"]) and all(_same(x, y) for x, y in zip(a["children"], b["children"], strict=True))


def _decimal(kind: str) -> tuple[int, int] | None:
    if kind.startswith("decimal("):
        p, s = kind[8:-1].split(",")
        return int(p), int(s)
    return None


def widens(source: str, target: str) -> bool:
    """Whether every value of the source type is one of the target type."""
    if source == target or target in _WIDER.get(source, ()):
        return True
    to = _decimal(target)
    if to and source in _DIGITS:
        return to[0] - to[1] >= _DIGITS[source]
    own = _decimal(source)
    return bool(to and own and to[1] >= own[1] and to[0] - to[1] >= own[0] - own[1])


def retype(node: dict, kind: T.DataType, ids) -> dict:
    """The node with another type: scalars only widen; structs, lists and maps change field by field (by name)."""
    out = dict(node)
    if isinstance(kind, T.StructType):
        if node["kind"] != "struct":
            raise LakeError(f'cannot change "{node["name"]}" from {node["kind"]} to a struct')
        own = {c["name"].lower(): c for c in node["children"]}
        out["children"] = [retype(own[f.name.lower()], f.dataType, ids) if f.name.lower() in own else node_of(f.name, f.dataType, f.nullable, ids) for f in kind.fields]
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        name = "array" if isinstance(kind, T.ArrayType) else "map"
        if node["kind"] != name:
            raise LakeError(f'cannot change "{node["name"]}" from {node["kind"]} to {name}')
        parts = (kind.elementType,) if name == "array" else (kind.keyType, kind.valueType)
        out["children"] = [retype(c, k, ids) for c, k in zip(node["children"], parts, strict=True)]
    else:
        if node["children"] or not widens(node["kind"], kind.simpleString()):
            raise LakeError(f'cannot change "{node["name"]}" from {node["kind"]} to {kind.simpleString()}: only widening is allowed')
        out["kind"] = kind.simpleString()
    return out
