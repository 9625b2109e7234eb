"""Parts that need no lake: hashes, transforms, types, vectors, predicates."""

import datetime
import decimal

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.errors import LakeError
from tarn.functions import fields, transforms
from tarn.plans import pruning
from tarn.sources import puffin


def test_murmur3_known_values():
    assert transforms.murmur3_value(34, "int") == 2017239379
    assert [(transforms.murmur3_value(x, "string") & 0x7FFFFFFF) % 4 for x in ("alice", "bob", "charlie")] == [1, 2, 3]
    assert transforms.murmur3_value(None, "int") is None
    assert transforms.murmur3_value(-0.0, "double") == transforms.murmur3_value(0.0, "double")


def test_murmur3_columns_agree_with_python(spark):
    rows = [(34, "alice", 1.5, True), (-7, "", -0.0, False), (None, None, None, None), (1 << 40, "日本", float("inf"), True), (5, "a longer text with a tail", float("nan"), False)]
    df = spark.createDataFrame(rows, "i bigint, s string, d double, b boolean")
    kinds = {"i": "bigint", "s": "string", "d": "double", "b": "boolean"}
    got = df.select(*(transforms.murmur3_32(F.col(c), k).alias(c) for c, k in kinds.items())).collect()
    for r, g in zip(rows, got, strict=True):
        for x, (c, k) in zip(r, kinds.items(), strict=True):
            want = transforms.murmur3_value(x, k)
            assert g[c] == (None if want is None else want - (1 << 32) if want >> 31 else want)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=40), max_size=20))
def test_murmur3_of_buffers(values):
    data = np.frombuffer(b"".join(values), np.uint8)
    offsets = np.cumsum([0, *map(len, values)])
    want = [transforms.murmur3_bytes(v) for v in values]
    assert transforms.murmur3_spans(data, offsets).tolist() == [h - (1 << 32) if h >> 31 else h for h in want]


def test_transform_texts():
    assert transforms.parse("bucket(8, a)") == {"transform": "bucket", "column": "a", "arg": 8}
    assert transforms.parse("epoch_day(ts)")["transform"] == "epoch_day"
    assert transforms.parse("a")["transform"] == "identity"
    for bad in ("bucket(0, a)", "weeks(a)", "a + b"):
        with pytest.raises(LakeError):
            transforms.parse(bad)
    spec = [{"transform": "year", "column": "a"}, {"transform": "year", "column": "b"}, {"transform": "identity", "column": "c"}]
    assert transforms.key_names(spec) == ["year", "year_b", "c"]


def test_widening():
    for a, b in (("tinyint", "int"), ("int", "bigint"), ("int", "double"), ("float", "double"), ("decimal(5,2)", "decimal(12,4)"), ("bigint", "decimal(20,0)"), ("void", "string")):
        assert fields.widens(a, b), (a, b)
    for a, b in (("int", "tinyint"), ("bigint", "double"), ("int", "string"), ("decimal(5,2)", "decimal(5,3)"), ("bigint", "decimal(18,0)")):
        assert not fields.widens(a, b), (a, b)


def test_nodes_round_trip():
    kind = T.StructType.fromDDL("a int, s struct<x:string,y:array<struct<z:double>>>, m map<string,struct<q:int>>")
    nodes = [fields.node_of(f.name, f.dataType, f.nullable, ids) for ids in [iter(range(1, 99))] for f in kind.fields]
    assert fields.schema_of(nodes).simpleString() == kind.simpleString()
    assert fields.find(nodes, "s.X")["kind"] == "string"
    with pytest.raises(LakeError):
        fields.find(nodes, "nope")


@settings(max_examples=60, deadline=None)
@given(st.sets(st.one_of(st.integers(0, 200), st.integers(0, 1 << 20), st.integers(1 << 31, 1 << 40)), max_size=300))
def test_deletion_vector_round_trip(values):
    assert puffin.decode_vector(puffin.encode_vector(sorted(values))).tolist() == sorted(values)


def test_deletion_vector_dense_and_broken():
    dense = np.arange(5, 70_000)
    data = puffin.encode_vector(dense)
    assert (puffin.decode_vector(data) == dense).all()
    with pytest.raises(LakeError):
        puffin.decode_vector(data[:-1] + b"\x01")
    assert puffin.read(puffin.pack([(3, "a", [1, 5]), (9, "b", [])])) == [(3, [1, 5]), (9, [])]


def test_predicates_parse(spark):
    n = pruning.parse(spark, "a > 5 AND (b IN ('x', 'y') OR c IS NULL) AND d.e <= date'2020-01-02'")
    assert n.op == "and"
    assert pruning.parse(spark, "5 < a").op == ">"
    assert [(c.op, c.values) for c in pruning.parse(spark, "a BETWEEN 1 AND 3").children] == [(">=", [1]), ("<=", [3])]
    assert pruning.parse(spark, "a NOT BETWEEN 1 AND 3").op == "any"
    assert pruning.parse(spark, "length(a) = 3").op == "any"
    assert pruning.parse(spark, "a = -1.5").values == [decimal.Decimal("-1.5")]
    assert pruning.parse(spark, "t >= timestamp_ntz'2020-01-02 03:04:05'").values == [datetime.datetime(2020, 1, 2, 3, 4, 5)]
    assert pruning.parse(spark, " OR ".join(f"a = {k}" for k in range(80))).op == "any"
