"""Snapshots behind a manifest, caches that keep themselves up, schema rules."""

import json
import re

import pytest
from pyspark.sql import functions as F

from dossier.operators.json_rules import json_violations
from dossier.sources import snapshots
from dossier.sources.caches import CacheTable


def _ids(df):
    return sorted(r.id for r in df.collect())


def test_snapshots_switch_by_manifest(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    frame = lambda ids, v: spark.createDataFrame([(i, f"k{i % 2}", v) for i in ids], "id long, kind string, v string")
    assert snapshots.manifest(spark, root) is None and snapshots.read(spark, root) is None and snapshots.versions(spark, root) == []
    assert snapshots.publish(frame(range(6), "a"), root, ("kind",)) == 1
    old = snapshots.read(spark, root)
    assert snapshots.upsert(frame([1, 9], "b"), root, ["id"], ("kind",)) == 2
    assert _ids(old) == [0, 1, 2, 3, 4, 5]  # a reader keeps its version
    assert sorted((r.id, r.v) for r in snapshots.read(spark, root).collect()) == [(0, "a"), (1, "b"), (2, "a"), (3, "a"), (4, "a"), (5, "a"), (9, "b")]
    assert snapshots.delete(spark, root, frame([0, 2, 77], ""), ["id"]) == 3 and _ids(snapshots.read(spark, root)) == [1, 3, 4, 5, 9]
    with pytest.raises(snapshots.Conflict):
        snapshots.publish(frame([5], "x"), root, parent=2)
    version, gone = snapshots.replace(frame([3, 4], "c"), root, "id")
    assert version == 4 and _ids(gone) == [1, 5, 9] and _ids(snapshots.read(spark, root)) == [3, 4] and _ids(snapshots.read(spark, root, 2)) == [0, 1, 2, 3, 4, 5, 9]
    assert [(r.version, r.parent) for r in snapshots.history(spark, root).collect()] == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert snapshots.vacuum(spark, root, 2) == 2 and snapshots.versions(spark, root) == [3, 4] and snapshots.vacuum(spark, root, 2) == 0
    assert _ids(snapshots.read(spark, root)) == [3, 4] and dict(snapshots.read(spark, root, 3).dtypes)["kind"] == "string"


def test_a_failed_switch_leaves_the_old_version(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    snapshots.publish(spark.createDataFrame([(1,)], "id long"), root)
    (tmp_path / "t/manifests/000000000002.json").write_text((tmp_path / "t/manifests/000000000001.json").read_text())  # another writer's
    folders = lambda: len(list((tmp_path / "t/data").iterdir()))
    before = folders()
    real = snapshots.versions
    try:
        snapshots.versions = lambda *a: [1]
        with pytest.raises(snapshots.Conflict):
            snapshots.publish(spark.createDataFrame([(2,)], "id long"), root)
    finally:
        snapshots.versions = real
    assert folders() == before and _ids(snapshots.read(spark, root)) == [1]


def test_caches_compute_what_they_lack(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS cache_test")
    cache = CacheTable(spark, "cache_test", f"file://{tmp_path}/c", "array<float>", 4)
    computed = []

    def compute(missing):
        computed.append(sorted(r.key for r in missing.collect()))
        return missing.select("key", F.array(F.length("text").cast("float")).alias("value"))

    asked = spark.createDataFrame([("a", "x"), ("b", "xy"), ("b", "xy"), ("c", "")], "key string, text string")
    out, many = cache.fill(asked, compute)
    assert many == 3 and sorted((r.key, r.value[0]) for r in out.collect()) == [("a", 1.0), ("b", 2.0), ("b", 2.0), ("c", 0.0)]
    assert cache.fill(asked, compute)[1] == 0 and computed == [["a", "b", "c"]]
    # a damaged row is made anew and the sound one counts
    spark.table("cache_test").where("key = 'b'").select("key", F.array(F.lit(9.0).cast("float")).alias("value"), "checksum", (F.col("made") + 99).alias("made")).write.insertInto("cache_test")
    assert sorted((r.key, r.value[0]) for r in cache.rows().collect()) == [("a", 1.0), ("b", 2.0), ("c", 0.0)]
    cache.forget(asked.where("key = 'b'"))
    spark.createDataFrame([("b", [7.0], 1, 1.0)], "key string, value array<float>, checksum long, made double").write.insertInto("cache_test")
    assert [r.key for r in cache.damaged().collect()] == ["b"]
    out, many = cache.fill(asked, compute)
    assert many == 1 and {r.key: r.value[0] for r in out.collect()}["b"] == 2.0 and computed[-1] == ["b"]
    spark.sql("DROP TABLE cache_test")  # the files stay
    again = CacheTable(spark, "cache_test", f"file://{tmp_path}/c", "array<float>", 4)
    assert again.fill(asked, compute)[1] == 0
    plan = again.rows()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    spark.sql("DROP TABLE cache_test")


SCHEMA = {
    "type": "object", "additionalProperties": False, "required": ["a", "b"],
    "properties": {
        "a": {"type": ["integer", "null"], "minimum": 0}, "b": {"enum": [None, "é", 3]}, "c": {"type": "array", "uniqueItems": True, "items": {"type": "string", "pattern": "^[u-x]$"}},
        "t": {"type": "string", "format": "date-time"}, "o": {"type": "object", "required": ["x"], "properties": {"x": {"const": "1"}, "y": {"type": "number", "minimum": 1.5}}}, "s": {"type": "string", "minLength": 2},
    },
}
_TYPES = {"string": str, "object": dict, "array": list}


def plain_rules(schema, v, path="$"):
    out = []
    kinds = [schema["type"]] if isinstance(schema.get("type"), str) else schema.get("type", [])

    def fits(k):
        if k == "null":
            return v is None
        if k == "integer":
            return type(v) is int or type(v) is float and v.is_integer()
        return type(v) in (int, float) if k == "number" else type(v) is bool if k == "boolean" else isinstance(v, _TYPES[k])

    if kinds and not any(map(fits, kinds)):
        out.append((path, "type"))
    if "const" in schema and v != schema["const"]:
        out.append((path, "const"))
    if "enum" in schema and not any(v == e and type(v) is type(e) for e in schema["enum"]):
        out.append((path, "enum"))
    if isinstance(v, str):
        out += [(path, "minLength")] * (len(v) < schema.get("minLength", 0))
        out += [(path, "pattern")] * ("pattern" in schema and not re.search(schema["pattern"], v))
        out += [(path, "format")] * ("format" in schema and not re.match(r"\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)$", v))
    if type(v) in (int, float) and "minimum" in schema and v < schema["minimum"]:
        out.append((path, "minimum"))
    if isinstance(v, dict):
        out += [(path, f"required:{k}") for k in schema.get("required", ()) if k not in v]
        if schema.get("additionalProperties") is False and set(v) - set(schema["properties"]):
            out.append((path, "additionalProperties"))
        for k, sub in schema.get("properties", {}).items():
            if k in v:
                out += plain_rules(sub, v[k], f"{path}.{k}")
    if isinstance(v, list):
        if schema.get("uniqueItems") and len({json.dumps(x) for x in v}) < len(v):
            out.append((path, "uniqueItems"))
        out += sorted({r for x in v for r in plain_rules(schema.get("items", {}), x, f"{path}[]")})
    return out


def test_schema_rules_equal_the_plain_ones(spark):
    texts = [
        '{"a":1,"b":null}', '{"a":-1,"c":["x","x"],"q":1}', '{"a":2,"b":"é","c":["u"],"t":"2024-01-01T00:00:00Z"}', '{"a":1.5,"b":3,"c":[1,"zz"],"t":"2024-01-01"}', "[]", "3", "null",
        '{"a":null,"b":"3","o":{"x":"2","y":1}}', '{"a":0,"b":3,"o":{"y":2,"x":"1"},"s":"é"}', '{"a":"1","b":null,"o":[],"s":7,"c":{}}', '{"a":1.0,"b":null,"o":{"x":null,"y":"1"},"c":[null],"t":null}', '{"a":1,"b":null,"c":[]}',
    ]
    df = spark.createDataFrame([*enumerate(texts), (90, "{nope"), (91, None)], "id int, j string")
    got = sorted(map(tuple, json_violations(df, "id", "j", SCHEMA).collect()))
    want = sorted((i, *r) for i, t in enumerate(texts) for r in plain_rules(SCHEMA, json.loads(t))) + [(90, "$", "json"), (91, "$", "json")]
    assert got == want
