"""JSON schemas compiled to columns: every broken rule of a JSON text with its path.

The text is parsed once to a VARIANT, which keeps the difference between a missing
field, a null and a value of another type.  Supported: type, required, properties,
additionalProperties (false), items, uniqueItems, enum, const, minimum, minLength,
pattern, and the format date-time.  An array's elements share a path with [].
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KINDS = {"string": "STRING", "boolean": "BOOLEAN", "null": "VOID", "object": "OBJECT<", "array": "ARRAY<"}
#: Date, time and a zone.
DATE_TIME = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-]\d{2}:\d{2})\z"


def _is(kind: Column, name: str) -> Column:
    if name == "integer":
        return (kind == "BIGINT") | kind.rlike(r"^DECIMAL\(\d+,0\)$")
    if name == "number":
        return kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return kind.startswith(_KINDS[name])


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$['{name}']", "variant")


def _among(v: Column, kind: Column, values: list) -> Column:
    """Whether ``v`` is one of ``values``; its text is written once, whatever their number."""
    some = F.to_json(v).isin([json.dumps(e, ensure_ascii=False) for e in values if e is not None])
    return (kind == "VOID") | some if None in values else some


def _own_rules(schema: dict, v: Column, kind: Column, there: Callable[[str], Column], fits: Column | None = None, each: Column | None = None) -> list[tuple[str, Column]]:
    """(rule, whether a present ``v`` of type ``kind`` breaks it), without its fields' and elements' rules.

    ``there``: whether a field is there; ``fits``: whether ``v`` is the object or array of its shape; ``each``: its elements, where they are cast already.
    """
    out: list[tuple[str, Column]] = []
    present = v.isNotNull() if fits is None else fits | v.isNotNull()

    def rule(name: str, ok: Column, when: Column = present) -> None:
        out.append((name, F.when(when, ~F.coalesce(ok, F.lit(False))).otherwise(False)))

    def an(name: str) -> Column:
        return present & _is(kind, name) if fits is None or name not in ("object", "array") else fits

    if "type" in schema:
        rule("type", _any([_is(kind, n) for n in ([schema["type"]] if isinstance(schema["type"], str) else schema["type"])]))
    for name in ("const", "enum"):
        if name in schema:
            rule(name, _among(v, kind, [schema[name]] if name == "const" else schema[name]))
    text = F.try_variant_get(v, "$", "string")
    if "minLength" in schema:
        rule("minLength", F.length(text) >= schema["minLength"], an("string"))
    if "pattern" in schema:
        rule("pattern", text.rlike(schema["pattern"]), an("string"))
    if schema.get("format") == "date-time":
        rule("format", text.rlike(DATE_TIME) & F.try_to_timestamp(text).isNotNull(), an("string"))
    if "minimum" in schema:
        rule("minimum", F.try_variant_get(v, "$", "double") >= schema["minimum"], an("number"))
    for name in schema.get("required", ()):
        rule(f"required:{name}", there(name), an("object"))
    if schema.get("additionalProperties") is False:
        keys = F.map_keys(F.try_variant_get(v, "$", "map<string,array<array<boolean>>>"))  # other values become null without a cast
        rule("additionalProperties", F.size(F.array_except(keys, F.array(*map(F.lit, schema["properties"])))) == 0, an("object"))
    if schema.get("uniqueItems"):
        texts = F.transform(F.try_variant_get(v, "$", "array<variant>") if each is None else each, lambda x: F.to_json(x))
        rule("uniqueItems", F.size(F.array_distinct(texts)) == F.size(texts), an("array"))
    return out


def _deep_rules(schema: dict, v: Column, path: str) -> list[tuple[str, str, Column]]:
    """(path, rule, broken) of an array's element and of what it holds."""
    kind = F.schema_of_variant(v)
    out = [(path, r, b) for r, b in _own_rules(schema, v, kind, lambda name: _field(v, name).isNotNull())]
    for name, sub in schema.get("properties", {}).items():
        out += [(p, r, F.when(_is(kind, "object"), b).otherwise(False)) for p, r, b in _deep_rules(sub, _field(v, name), f"{path}.{name}")]
    if "items" in schema:
        out += _item_rules(schema["items"], v, kind, f"{path}[]")
    return out


def _item_rules(schema: dict, v: Column, kind: Column, path: str) -> list[tuple[str, str, Column]]:
    each = F.try_variant_get(v, "$", "array<variant>")
    some = lambda k: F.exists(each, lambda x: _deep_rules(schema, x, path)[k][2])
    return [(p, r, F.when(v.isNotNull() & _is(kind, "array"), some(k)).otherwise(False)) for k, (p, r, _) in enumerate(_deep_rules(schema, v, path))]


def _fields(schema: dict) -> dict[str, dict]:
    """The fields that rules name, each with its schema."""
    return dict.fromkeys(schema.get("required", ()), {}) | schema.get("properties", {})


def _shape(schema: dict, element: bool = False) -> str:
    """The type that a node is cast to: a struct of its fields, an array, or a variant where neither tells all.

    What is of another type becomes null.  An element of an array has no path to look that up, so it is a struct
    only where its rules need no more than that.
    """
    fields, lists = _fields(schema), "items" in schema or "uniqueItems" in schema
    if fields and not lists:
        inner = {n: _shape(s) for n, s in fields.items()}
        if element and (schema.get("type") != "object" or schema.keys() - {"type", "required", "properties"} or set(inner.values()) != {"variant"}):
            return "variant"
        return "struct<" + ",".join(f"`{n.replace('`', '``')}`:{t}" for n, t in inner.items()) + ">"
    return f"array<{_shape(schema.get('items', {}), True)}>" if lists and not fields and not element else "variant"


def _element_rules(schema: dict, each: Column, path: str) -> list[tuple[str, str, Column]]:
    """(path, rule, broken) over the elements ``each``, cast to the shape of ``schema``."""

    def rules(x: Column) -> list[tuple[str, str, Column]]:
        if _shape(schema, True) == "variant":
            return _deep_rules(schema, x, path)
        out = [(path, "type", x.isNull())] + [(path, f"required:{n}", x.isNotNull() & x[n].isNull()) for n in schema.get("required", ())]
        for name, sub in schema.get("properties", {}).items():
            out += [(p, r, F.coalesce(b, F.lit(False))) for p, r, b in _deep_rules(sub, x[name], f"{path}.{name}")]
        return out

    some = lambda k: F.exists(each, lambda x: rules(x)[k][2])
    return [(p, r, some(k)) for k, (p, r, _) in enumerate(rules(each[0]))]


def json_violations(df: DataFrame, key: str, text: str, schema: dict, more: Callable[[Column], list[tuple[str, str, Column]]] = lambda v: []) -> DataFrame:
    """key, path, rule for every broken rule of the JSON ``text``; text that is no JSON breaks the rule "json".

    ``more``: further rules (path, rule, broken) of the parsed text, for what relates fields to each other.
    One cast gives all fields that rules name, as variants in structs and arrays; what is not of its shape is null
    there and is looked up in the parsed text by its path.  Rows carry the numbers of their broken rules.
    """
    whole = _shape(schema)
    parsed = df.select(key, F.try_parse_json(F.col(text)).alias("v")).withColumn("d", F.try_variant_get("v", "$", whole))
    broken, kinds = [("$", "json", F.col("v").isNull()), *more(F.col("v"))], {}

    def visit(own: dict, d: Column, at: str, path: str) -> None:
        shape = _shape(own)
        if shape == "variant":
            if _fields(own) or "items" in own or "uniqueItems" in own:
                broken.extend(_deep_rules(own, d, path))
            elif own:
                kinds[f"k{len(kinds)}"] = F.schema_of_variant(d)
                broken.extend((path, r, b) for r, b in _own_rules(own, d, F.col(f"k{len(kinds) - 1}"), lambda name: F.lit(False)))
            return
        raw, fits = F.col("v") if at == "$" else F.try_variant_get("v", at, "variant"), d.isNotNull()
        kind = F.when(fits, _KINDS["object" if shape.startswith("struct") else "array"]).otherwise(F.schema_of_variant(raw))

        def held(name: str) -> Column:
            there = d[name].isNotNull()
            return there if _shape(_fields(own)[name]) == "variant" else there | F.try_variant_get("v", f"{at}['{name}']", "variant").isNotNull()

        each = d if shape == "array<variant>" else None
        broken.extend((path, r, b) for r, b in _own_rules(own, raw, kind, held, fits, each))
        if shape.startswith("array"):
            broken.extend(_element_rules(own.get("items", {}), d, f"{path}[]"))
        else:
            for name, sub in own.get("properties", {}).items():
                visit(sub, d[name], f"{at}['{name}']", f"{path}.{name}")

    visit(schema, F.col("d"), "$", "$")
    numbers = F.array(*[F.when(b, k).otherwise(0) for k, (_, _, b) in enumerate(broken, 1)])
    marked = parsed.withColumns(kinds).select(key, numbers.alias("n")) if kinds else parsed.select(key, numbers.alias("n"))
    names = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(r).alias("rule")) for p, r, _ in broken])
    found = marked.select(key, F.explode(F.array_remove("n", 0)).alias("n")).select(key, F.element_at(names, F.col("n")).alias("f"))
    return found.select(key, "f.path", "f.rule")
