"""JSON schemas compiled to expressions over variants.

``problems`` gives what of a value breaks a schema as an array of lines, one each with the value's path, by built-in functions
only: types, required and further properties, enum, const, sizes, ranges, patterns, alternatives and local references. A value of
a wrong type has that problem alone. A schema that refers to itself has no such expression and is an error here.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPES = ("array", "object", "string", "boolean", "integer", "number", "null")


class Recursive(ValueError):
    """A schema whose references lead back to themselves."""


def target(schema: object, root: dict) -> dict | None:
    """The schema that a local reference names, else the schema itself; None where it names nothing."""
    if not isinstance(schema, dict) or not isinstance(schema.get("$ref"), str):
        return schema if isinstance(schema, dict) else None
    if not schema["$ref"].startswith("#/"):
        return None
    at: object = root
    for part in schema["$ref"][2:].split("/"):
        at = at.get(part) if isinstance(at, dict) else None
    return at if isinstance(at, dict) else None


def _array(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once a row, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def kind_of(value: Column, array: Column | None = None, fields: Column | None = None) -> Column:
    """The JSON type of a variant; whole numbers are integers, an absent value is null."""

    def scalar(text: Column) -> Column:
        return F.when(text.startswith('"'), "string").when(text.isin("true", "false"), "boolean").when(text.rlike("^-?[0-9]+$"), "integer").otherwise("number")

    array, fields = _array(value) if array is None else array, _object(value) if fields is None else fields
    absent = value.isNull() | F.is_variant_null(value)
    return F.when(absent, "null").when(array.isNotNull(), "array").when(fields.isNotNull(), "object").otherwise(_once(F.to_json(value), scalar))


def _listed(*problems: Column) -> Column:
    kept = [p for p in problems if p is not None]
    return F.concat(*kept) if len(kept) > 1 else kept[0] if kept else F.array().cast("array<string>")


def _line(path: Column | str, said: str) -> Column:
    here = F.lit(path or "(root)") if isinstance(path, str) else path
    return F.concat(F.lit("- "), here, F.lit(f": {said}"))


def _under(path: Column | str, key: str) -> Column | str:
    if isinstance(path, str):
        return f"{path}/{key}" if path else key
    return F.concat(path, F.lit(f"/{key}"))


def _same(value: Column, kind: Column, wanted: object) -> Column:
    if isinstance(wanted, (int, float)) and not isinstance(wanted, bool):
        return kind.isin("integer", "number") & (F.try_variant_get(value, "$", "double") == float(wanted))
    # both sides go through the same parser
    return F.to_json(value) == F.to_json(F.parse_json(F.lit(json.dumps(wanted))))


def _problems(given: Column, schema: object, root: dict, path: Column | str, within: tuple[str, ...]) -> Column:
    """A value is a long expression of its parents, so it and what is read from it are each worked out once."""
    parts = lambda v: F.struct(v.alias("v"), _array(v).alias("a"), _object(v).alias("o"))
    known = lambda b: F.struct(b["v"].alias("v"), b["a"].alias("a"), b["o"].alias("o"), kind_of(b["v"], b["a"], b["o"]).alias("k"))
    return _once(given, lambda v: _once(parts(v), lambda b: _once(known(b), lambda x: _found(x["v"], x["k"], x["a"], x["o"], schema, root, path, within))))


def _found(value: Column, kind: Column, array: Column, fields: Column, schema: object, root: dict, path: Column | str, within: tuple[str, ...]) -> Column:
    if isinstance(schema, dict) and isinstance(schema.get("$ref"), str):
        if schema["$ref"] in within:
            raise Recursive(schema["$ref"])
        within = (*within, schema["$ref"])
    shape = target(schema, root) or {}
    none = F.array().cast("array<string>")
    when = lambda broken, said: F.when(F.coalesce(broken, F.lit(False)), F.array(_line(path, said))).otherwise(none)
    rest: list[Column] = []
    same = lambda x: F.coalesce(_same(value, kind, x), F.lit(False))
    if "enum" in shape:
        fits = F.lit(False)
        for x in shape["enum"]:
            fits = fits | same(x)
        rest.append(when(~fits, "not one of the allowed values"))
    if "const" in shape:
        rest.append(when(~same(shape["const"]), "not the fixed value"))
    number = F.when(kind.isin("integer", "number"), F.try_variant_get(value, "$", "double"))
    text = F.when(kind == "string", F.try_variant_get(value, "$", "string"))
    items = F.when(array.isNotNull(), F.size(array))
    measures = {"Items": items, "Length": F.length(text), "imum": number}
    for side, word, beyond in (("min", "under", lambda a, b: a < b), ("max", "over", lambda a, b: a > b)):
        for name, measure in measures.items():
            if (limit := shape.get(side + name)) is not None:
                rest.append(when(beyond(measure, F.lit(limit)), f"{word} {side}{name} {limit}"))
    if "pattern" in shape:
        rest.append(when(~text.rlike(shape["pattern"]), "not of the pattern"))
    for key in ("anyOf", "oneOf"):
        if key in shape:
            broken = F.lit(True)
            for s in shape[key]:
                broken = broken & (F.size(_problems(value, s, root, path, within)) > 0)
            rest.append(when(broken, "fits no alternative"))
    props = shape.get("properties") or {}
    for k in shape.get("required") or []:
        rest.append(when(~F.map_contains_key(fields, k), f"lacks {k}"))
    if shape.get("additionalProperties") is False:
        more = F.filter(F.map_keys(fields), lambda k: ~k.isin(*props) if props else F.lit(True))
        rest.append(F.coalesce(F.transform(more, lambda k: F.concat(_line(path, "has "), k)), none))
    for k, prop in props.items():
        if isinstance(prop, dict):
            inner = _problems(F.try_element_at(fields, F.lit(k)), prop, root, _under(path, k), within)
            rest.append(F.when(F.coalesce(F.map_contains_key(fields, k), F.lit(False)), inner).otherwise(none))
    if isinstance(shape.get("items"), dict):
        at = lambda i: F.concat(F.lit(f"{path}/") if isinstance(path, str) and path else F.lit("") if isinstance(path, str) else F.concat(path, F.lit("/")), i.cast("string"))
        each = F.transform(array, lambda x, i: _problems(x, shape["items"], root, at(i), within))
        rest.append(F.coalesce(F.flatten(each), none))
    kinds = shape.get("type")
    kinds = kinds if isinstance(kinds, list) else [kinds] if kinds else []
    if not kinds:
        return _listed(*rest)
    allowed = {k for k in kinds if k in TYPES} | ({"integer"} if "number" in kinds else set())
    wrong = ~kind.isin(*allowed) if allowed else F.lit(True)
    return F.when(wrong, F.array(_line(path, f"not of type {' or '.join(kinds)}"))).otherwise(_listed(*rest))


def problems(value: Column, schema: dict) -> Column:
    """What of a variant breaks the schema: array<string>, empty if it fits."""
    return _problems(value, schema, schema, "", ())
