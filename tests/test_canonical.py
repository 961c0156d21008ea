"""Canonical JSON: the vectors of RFC 8785, and what has no form."""

from __future__ import annotations

import hashlib
import json
import struct

import pytest
from pyspark.sql import functions as F

from corpuslens.functions import canonical


@pytest.mark.parametrize(
    ("bits", "text"),
    [
        ("0000000000000000", "0"), ("8000000000000000", "0"), ("0000000000000001", "5e-324"), ("8000000000000001", "-5e-324"), ("7fefffffffffffff", "1.7976931348623157e+308"),
        ("ffefffffffffffff", "-1.7976931348623157e+308"), ("4340000000000000", "9007199254740992"), ("c340000000000000", "-9007199254740992"), ("4430000000000000", "295147905179352830000"),
        ("44b52d02c7e14af5", "9.999999999999997e+22"), ("44b52d02c7e14af6", "1e+23"), ("44b52d02c7e14af7", "1.0000000000000001e+23"), ("444b1ae4d6e2ef4e", "999999999999999700000"),
        ("444b1ae4d6e2ef4f", "999999999999999900000"), ("444b1ae4d6e2ef50", "1e+21"), ("3eb0c6f7a0b5ed8c", "9.999999999999997e-7"), ("3eb0c6f7a0b5ed8d", "0.000001"),
        ("41b3de4355555553", "333333333.3333332"), ("41b3de4355555557", "333333333.33333343"), ("becbf647612f3696", "-0.0000033333333333333333"), ("43143ff3c1cb0959", "1424953923781206.2"),
    ],
)
def test_numbers(bits, text):
    assert canonical.number_text(struct.unpack(">d", bytes.fromhex(bits))[0]) == text


def forms(spark, *given):
    rows = spark.createDataFrame(list(enumerate(given)), "i int, t string")
    return [r["c"] for r in rows.select("i", canonical.canonical_json("t").alias("c")).orderBy("i").collect()]


def test_objects_of_any_shape(spark):
    """The object of the RFC's section 3.2.2, and the order of its section 3.2.3."""
    one = r'''{"numbers": [333333333.33333329, 1E30, 4.50, 2e-3, 0.000000000000000000000000001], "string": "\u20ac$\u000F\u000aA'\u0042\u0022\u005c\\\"\/", "literals": [null, true, false]}'''
    two = '{"\\u20ac": "Euro Sign", "\\r": "Carriage Return", "\\ufb33": "Hebrew", "1": "One", "\\ud83d\\ude00": "Emoji", "\\u0080": "Control", "\\u00f6": "o"}'
    found = forms(spark, one, two, '{"b":1,"a":2,"c":3}', ' [ ] ', '{"a":{},"a":[1]}')
    assert found[0] == '{"literals":[null,true,false],"numbers":[333333333.3333333,1e+30,4.5,0.002,1e-27],"string":"€$\\u000f\\nA\'B\\"\\\\\\\\\\"/"}'
    assert list(json.loads(found[1])) == ["\r", "1", "\x80", "\u00f6", "\u20ac", "\U0001f600", "\ufb33"]
    assert found[2:] == ['{"a":2,"b":1,"c":3}', "[]", '{"a":[1]}']


def test_what_has_no_form(spark):
    assert forms(spark, None, "", "{", "NaN", "[Infinity]", "1e999", '"\\ud800"', "[" * 100_000) == [None] * 8
    assert forms(spark, "1" * 400, "9007199254740993", "-0", '"é\\u0001"') == [None, "9007199254740992", "0", '"é\\u0001"']


def test_schema_hash(spark):
    files = spark.createDataFrame([("b.json", "22"), ("a.json", "11"), ("vocab.json", "33")], "name string, sha256 string")
    want = hashlib.sha256(b'{"a.json":"11","b.json":"22","vocab.json":"33"}').hexdigest()
    assert canonical.schema_hash(files).first()[0] == f"sha256:{want}"
    assert spark.range(1).select(canonical.canonical_digest(F.lit("{")).alias("x")).first()["x"] is None
