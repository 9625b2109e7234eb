"""Which files may hold rows that a predicate keeps, from the statistics in the store.

The predicate's text is parsed by Spark; comparisons of a column with a literal, IN, IS [NOT] NULL, AND and OR are understood,
all else keeps every file. Spark applies the whole predicate again, so keeping too much is harmless. A missing bound never
prunes, NaN counts as greater than all numbers.
"""

from __future__ import annotations

import datetime
import decimal
import json
import re
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from tarn.functions import fields, transforms

MAX_NODES = 64
VARIANT = "$"  # in a path: the next is a key of the variant before it, the last the type that it is taken as
_KEY = re.compile(r"\$\.([A-Za-z_]\w*)")
#: Types that a key may be taken as, by the type that all its values in a file have.
_VARIANT_KINDS = {"bigint": ("tinyint", "smallint", "int", "bigint", "double"), "double": ("double",), "string": ("string",)}
_STORED = ("tinyint", "smallint", "int", "bigint", "timestamp_ntz")
_FLIP = {"=": "=", "<": ">", ">": "<", "<=": ">=", ">=": "<=", "<>": "<>"}
_COMPARE = {"EqualTo": "=", "EqualNullSafe": "<=>", "LessThan": "<", "GreaterThan": ">", "LessThanOrEqual": "<=", "GreaterThanOrEqual": ">="}


@dataclass
class Node:
    """op: and, or, a comparison, in, null, not null, or any (understands nothing)."""

    op: str
    path: tuple[str, ...] = ()
    values: list = field(default_factory=list)
    children: list[Node] = field(default_factory=list)


ANY = Node("any")


def _literal(e):
    """(known, value) of a parsed literal, as the Python value of its type."""
    name = e.getClass().getSimpleName()
    if name == "UnaryMinus":
        known, v = _literal(e.child())
        return known and isinstance(v, (int, float, decimal.Decimal)), -v if known and isinstance(v, (int, float, decimal.Decimal)) else None
    if name == "Cast" and e.dataType().simpleString() in ("date", "timestamp_ntz"):
        known, v = _literal(e.child())
        if known and isinstance(v, str):
            try:
                return True, datetime.date.fromisoformat(v) if e.dataType().simpleString() == "date" else datetime.datetime.fromisoformat(v)
            except ValueError:
                return False, None
    if name != "Literal":
        return False, None
    kind, v = e.dataType().simpleString(), e.value()
    if v is None:
        return True, None
    if kind.startswith("decimal"):
        return True, decimal.Decimal(str(v.toString() if hasattr(v, "toString") else v))
    if kind in ("string", "tinyint", "smallint", "int", "bigint", "float", "double", "boolean"):
        return True, str(v) if kind == "string" else v
    if kind == "date":
        return True, datetime.date(1970, 1, 1) + datetime.timedelta(days=v)
    if kind == "timestamp_ntz":
        return True, datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=v)
    return False, None


def _list(seq) -> list:
    return [seq.apply(i) for i in range(seq.length())]


def parse(spark: SparkSession, text: str) -> Node:
    """The part of a predicate that files can be judged by; trees of more than MAX_NODES nodes are not judged."""
    budget = [MAX_NODES]

    def column(e):
        name = e.getClass().getSimpleName()
        if name == "UnresolvedFunction" and _list(e.nameParts())[-1].lower() in ("variant_get", "try_variant_get"):
            args = _list(e.arguments())
            told = [_literal(x)[1] for x in args[1:]]
            if len(args) == 3 and isinstance(told[0], str) and (m := _KEY.fullmatch(told[0])) and (own := column(args[0])):
                return (*own, VARIANT, m[1], str(told[1]).lower())
        return tuple(_list(e.nameParts())) if name == "UnresolvedAttribute" else None

    def walk(e) -> Node:
        budget[0] -= 1
        name = e.getClass().getSimpleName()
        if name in ("And", "Or"):
            return Node(name.lower(), children=[walk(e.left()), walk(e.right())])
        if name == "Not":
            inner = walk(e.child())
            return {"=": Node("<>", inner.path, inner.values), "null": Node("not null", inner.path), "not null": Node("null", inner.path)}.get(inner.op, ANY)
        if name in ("IsNull", "IsNotNull"):
            path = column(e.child())
            return Node("null" if name == "IsNull" else "not null", path) if path else ANY
        if name == "In":
            path, found = column(e.value()), [_literal(x) for x in _list(e.list())]
            return Node("in", path, [v for _, v in found if v is not None]) if path and all(k for k, _ in found) else ANY
        if name == "UnresolvedFunction" and _list(e.nameParts()) == ["between"]:
            path, (a, low), (b, high) = (column(_list(e.arguments())[0]), *(_literal(x) for x in _list(e.arguments())[1:]))
            if path and a and b and low is not None and high is not None:
                return Node("and", children=[Node(">=", path, [low]), Node("<=", path, [high])])
            return ANY
        if name in _COMPARE:
            op = _COMPARE[name]
            for a, b, o in ((e.left(), e.right(), op), (e.right(), e.left(), _FLIP.get(op, op))):
                path = column(a)
                if path:
                    known, v = _literal(b)
                    if known and (v is not None or o == "<=>"):
                        return Node("null", path) if v is None else Node("=" if o == "<=>" else o, path, [v])
        return ANY

    out = walk(spark._jsparkSession.sessionState().sqlParser().parseExpression(text))
    return out if budget[0] >= 0 else ANY


def paths(node: Node) -> set[tuple[str, ...]]:
    """The columns that a predicate judges files by, in lower case."""
    own = {tuple(p.lower() for p in node.path)} if node.path else set()
    return own.union(*(paths(c) for c in node.children))


def as_sql(node: Node, leaves: dict[tuple[str, ...], dict], table_id: int) -> tuple[str, list]:
    """A condition on the store's data_file, and its arguments, that rules files out by a predicate's comparisons that must all
    hold; it judges whole numbers and times, whose bounds SQL can compare as they are stored, and keeps all it can't tell."""
    if node.op == "and":
        parts = [as_sql(c, leaves, table_id) for c in node.children]
        return "".join(p for p, _ in parts), [a for _, own in parts for a in own]
    leaf = leaves.get(tuple(p.lower() for p in node.path))
    if leaf is None or node.op not in ("=", "<", "<=", ">", ">=") or len(node.values) != 1 or leaf["kind"] not in _STORED:
        return "", []
    v = node.values[0]
    if leaf["kind"] == "timestamp_ntz" and isinstance(v, datetime.datetime):
        bound, v = (lambda side: side), encode(v)
    elif leaf["kind"] != "timestamp_ntz" and isinstance(v, int) and not isinstance(v, bool) and abs(v) < 1 << 62:
        bound = lambda side: f"CAST({side} AS INTEGER)"
    else:
        return "", []
    low, high = bound("s.min"), bound("s.max")
    out = {"=": f"({high} < ? OR {low} > ?)", "<": f"{low} >= ?", "<=": f"{low} > ?", ">": f"{high} <= ?", ">=": f"{high} < ?"}[node.op]
    # A column that held dates before has bounds without a time, which are no match for a time's text.
    known = "s.min IS NOT NULL AND s.max IS NOT NULL" + (" AND length(s.min) > 20 AND length(s.max) > 20" if leaf["kind"] == "timestamp_ntz" else "")
    sql = f" AND NOT EXISTS (SELECT 1 FROM file_stats s WHERE s.file_id = data_file.file_id AND s.table_id = ? AND s.field_id = ? AND {known} AND {out})"
    return sql, [table_id, leaf["id"], *[v] * out.count("?")]


def encode(value) -> str | None:
    """A bound as text in the store."""
    if value is None:
        return None
    if isinstance(value, (datetime.datetime, datetime.date)):
        return json.dumps(value.isoformat())
    if isinstance(value, decimal.Decimal):
        return json.dumps(str(value))
    return json.dumps(value) if isinstance(value, (bool, int, float, str)) else None


def decode(text: str | None, kind: str):
    """A bound from the store as the Python value of its column's type."""
    if text is None:
        return None
    v = json.loads(text)
    if kind == "date":
        return datetime.date.fromisoformat(v)
    if kind in ("timestamp", "timestamp_ntz"):
        return datetime.datetime.fromisoformat(v)
    return decimal.Decimal(v) if kind.startswith("decimal") else v


def _comparable(kind: str, v):
    """The literal as a value that compares with the column's bounds, or None."""
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        if isinstance(v, bool):
            return None
        if isinstance(v, str):
            try:
                v = decimal.Decimal(v)
            except decimal.InvalidOperation:
                return None
        return v if isinstance(v, (int, float, decimal.Decimal)) else None
    if kind == "string":
        return v if isinstance(v, str) else None
    if kind == "boolean":
        return v if isinstance(v, bool) else None
    if kind in ("date", "timestamp_ntz"):
        if isinstance(v, str):
            try:
                v = datetime.datetime.fromisoformat(v.strip())
            except ValueError:
                return None
        if isinstance(v, datetime.datetime):
            return v  # a date column is compared as a timestamp
        return datetime.datetime.combine(v, datetime.time()) if isinstance(v, datetime.date) else None
    return None


def _as_time(bound):
    return datetime.datetime.combine(bound, datetime.time()) if isinstance(bound, datetime.date) and not isinstance(bound, datetime.datetime) else bound


class Files:
    """Statistics and partition values of the files of one table; keep() answers for a predicate."""

    def __init__(self, files: list, stats: dict[tuple[int, int], dict], nodes: list[dict], specs: dict[int, list[dict]], variants: dict[tuple[int, int, str], dict] | None = None):
        self.files, self.stats, self.specs, self.variants = files, stats, specs, variants or {}
        self.fields = {tuple(n.lower() for n in names): node for node, names, _ in fields.leaves(nodes)}

    def keep(self, node: Node) -> list:
        return [f for f in self.files if self._may(f, node)]

    def _may(self, f, node: Node) -> bool:
        if node.op == "and":
            return all(self._may(f, c) for c in node.children)
        if node.op == "or":
            return any(self._may(f, c) for c in node.children)
        if VARIANT in node.path:
            return self._may_variant(f, node)
        if node.op == "any" or (leaf := self.fields.get(tuple(p.lower() for p in node.path))) is None:
            return True
        kind = leaf["kind"]
        if node.op in ("=", "in") and not self._bucket(f, leaf, node.values):
            return False
        s = self.stats.get((f["file_id"], leaf["id"]))
        if s is None:
            return True
        if node.op == "null":
            return s["null_count"] is None or s["null_count"] > 0 or len(node.path) > 1
        if s["null_count"] is not None and s["value_count"] is not None and s["null_count"] == s["value_count"]:
            return False  # only NULLs: no comparison keeps one
        if node.op == "not null":
            return True
        lo, hi = (_as_time(decode(s[k], s["kind"])) for k in ("min", "max"))
        if lo is None or hi is None:
            return True
        return any(self._compares(kind, node.op, v, lo, hi, s["has_nan"]) for v in node.values) if node.values else node.op != "in"

    def _may_variant(self, f, node: Node) -> bool:
        """A comparison of a variant's key: judged where all values of that key in a file have one type."""
        *own, _, key, taken = node.path
        leaf = self.fields.get(tuple(p.lower() for p in own))
        s = self.variants.get((f["file_id"], leaf["id"], key)) if leaf is not None else None
        if s is None or node.op in ("null", "not null") or taken not in _VARIANT_KINDS.get(s["kind"], ()):
            return True
        lo, hi = decode(s["min"], s["kind"]), decode(s["max"], s["kind"])
        return any(self._compares(s["kind"], node.op, v, lo, hi, False) for v in node.values) if node.values else node.op != "in"

    @staticmethod
    def _compares(kind, op, v, lo, hi, nan) -> bool:
        if isinstance(v, float) and v != v:
            return bool(nan) or op not in ("=", "in")
        v = _comparable(kind, v)
        if v is None:
            return True
        if kind == "float" and isinstance(v, (float, decimal.Decimal)):  # bounds of floats are coarser than the literal
            return op not in ("=", "in") or float(lo) - abs(float(v)) * 1e-6 <= float(v) <= float(hi) + abs(float(v)) * 1e-6
        if isinstance(v, decimal.Decimal) or isinstance(lo, decimal.Decimal):
            v, lo, hi = (decimal.Decimal(str(x)) for x in (v, lo, hi))
        if op in ("=", "in"):
            return lo <= v <= hi
        if op == "<>":
            return bool(nan) or not lo == hi == v
        if op in (">", ">="):
            return bool(nan) or (hi > v if op == ">" else hi >= v)
        return lo < v if op == "<" else lo <= v

    def _bucket(self, f, leaf, values) -> bool:
        """Whether one of the values falls into the bucket of a file that is dealt by the column."""
        if not f["partition_values"]:
            return True
        for key, own in zip(self.specs.get(f["partition_id"], []), json.loads(f["partition_values"]), strict=False):
            if key["transform"] == "bucket" and key["field_id"] == leaf["id"] and own is not None:
                exact = [v for v in values if isinstance(v, (int if leaf["kind"] in ("tinyint", "smallint", "int", "bigint") else str)) and not isinstance(v, bool)]
                if len(exact) != len(values) or leaf["kind"] not in ("tinyint", "smallint", "int", "bigint", "string"):
                    return True
                return any((transforms.murmur3_value(v, leaf["kind"]) & 0x7FFFFFFF) % key["arg"] == int(own) for v in exact)
        return True

    def top(self, field_id: int, n: int, descending: bool) -> list:
        """Files that may hold one of the n first rows by a column; all if a bound or a count is unknown or NULLs exist."""
        known = []
        for f in self.files:
            s = self.stats.get((f["file_id"], field_id))
            if s is None or s["min"] is None or s["max"] is None or s["null_count"] or s["has_nan"]:
                return self.files
            known.append((decode(s["min"], s["kind"]), decode(s["max"], s["kind"]), f))
        # The n-th value can't be worse than the worse bound of enough of the best files.
        known.sort(key=lambda k: k[0] if descending else k[1], reverse=descending)
        seen = 0
        for lo, hi, f in known:
            seen += f["record_count"]
            if seen >= n:
                bound = lo if descending else hi
                return [g for a, b, g in known if (b >= bound if descending else a <= bound)]
        return self.files
