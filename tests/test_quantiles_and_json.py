"""Exact quantiles by selection, canonical JSON and schema rules against plain versions."""

import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from dossier.functions.canonical import canonical_json, row_digest, row_json
from dossier.functions.masking import masked
from dossier.functions.text import mask_tree
from dossier.operators import quantiles


@pytest.mark.parametrize("small, grid", [(100_000, 256), (60, 32)])
def test_quantiles_by_selection(spark, monkeypatch, small, grid):
    monkeypatch.setattr(quantiles, "SMALL", small)
    monkeypatch.setattr(quantiles, "GRID", grid)
    monkeypatch.setattr(quantiles, "ACCURACY", 4 * grid)
    r = random.Random(3)
    groups = {
        "few": [3.0], "two": [1.0, 2.0], "ties": [5.0] * 300 + [1.0, 9.0], "wide": [r.choice([-1, 1]) * 10.0 ** r.uniform(-200, 200) for _ in range(401)],
        None: [r.random() for _ in range(250)], "ints": [float(r.randint(0, 20)) for _ in range(500)], "nulls": [None, None],
    }
    rows = [(g, x) for g, xs in groups.items() for x in xs]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = {x.g: (x.mid, x.p95, x.least) for x in quantiles.exact_quantiles(df, ["g"], F.col("v"), {"mid": "median", "p95": 0.95, "least": 0.0}).collect()}
    want = {}
    for g, xs in groups.items():
        s = sorted(x for x in xs if x is not None)
        if s:
            n = len(s)
            want[g] = ((s[(n + 1) // 2 - 1] + s[n // 2]) / 2, s[-(-95 * n // 100) - 1], s[0])
    assert got == want
    assert quantiles.exact_quantiles(df.limit(0), ["g"], F.col("v"), {"mid": "median"}).count() == 0


def test_quantiles_without_groups_and_joined_to_figures(spark):
    df = spark.createDataFrame([(i % 3, float(i)) for i in range(31)], "g int, v double")
    assert quantiles.exact_quantiles(df, [], F.col("v"), {"m": "median"}).first().m == 15.0
    out = quantiles.with_quantiles(df.groupBy("g").agg(F.count(F.lit(1)).alias("n")), df, ["g"], F.col("v"), {"p": 0.95})
    assert {r.g: r.p for r in out.collect()} == {g: sorted(float(i) for i in range(31) if i % 3 == g)[math.ceil(0.95 * len(range(g, 31, 3))) - 1] for g in range(3)}


DEEP = "id long, name string, tags array<string>, at struct<z: int, a: array<struct<y: string, b: boolean>>>, m map<string, array<int>>, none struct<q: string>"


def test_canonical_json_equals_the_plain_form(spark):
    odd = "".join(map(chr, range(0, 40))) + '"\\ é 😀   \\u001F'
    rows = [
        (1, odd, ["b", None, "a"], {"z": 1, "a": [{"y": "x", "b": True}, {"y": None, "b": None}]}, {"b": [1, None], "a": [], "é": None}, {"q": "v"}),
        (2, None, None, None, None, None), (3, "", [], {"z": None, "a": []}, {}, {"q": None}),
    ]
    df = spark.createDataFrame(rows, DEEP)
    out = df.select("id", row_json(df).alias("j"), row_digest(df).alias("h"), row_json(df, "tags", "id").alias("part")).collect()
    names = ["id", "name", "tags", "at", "m", "none"]
    for r, own in zip(sorted(out, key=lambda r: r.id), rows):
        plain = json.dumps(dict(zip(names, own)), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        assert r.j == plain and r.h == hashlib.sha256(plain.encode()).hexdigest()
        assert r.part == json.dumps({"id": own[0], "tags": own[2]}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    with pytest.raises(TypeError):
        canonical_json(F.lit(1.5), spark.createDataFrame([(1.5,)], "x double").schema["x"].dataType)


def test_typed_masks_equal_the_mask_of_a_tree(spark):
    kind = "n int, note string, prompt struct<version: string>, deep struct<email: string, xs: array<struct<t: string, k: boolean>>, m: map<string, string>>, tags array<string>"
    rows = [
        (1, "call 555-123-4567 or a.b@c.org, key sk-abcdefghijkl, ssn 123-45-6789", {"version": "v"}, {"email": "x@y.zz", "xs": [{"t": "top secret", "k": True}, {"t": None, "k": None}], "m": {"password": "p", "at a@b.cc": "z", "plain": None}}, ["ok", "q@r.st", None]),
        (2, None, None, None, None), (3, "", {"version": None}, {"email": None, "xs": [], "m": {}}, []),
    ]
    df = spark.createDataFrame(rows, kind).select(F.struct("*").alias("v"))
    out = df.select(F.to_json(masked(F.col("v"), df.schema["v"].dataType, ("top secret",)), {"ignoreNullFields": "false"}).alias("j")).collect()
    got = {r["n"]: r for r in (json.loads(x.j) for x in out)}
    for n, note, prompt, deep, tags in rows:
        plain = mask_tree({"n": n, "note": note, "prompt": prompt, "deep": deep, "tags": tags}, ("top secret",))
        assert got[n] == plain
