"""JSON Schema as expressions: every breach of a schema with its path and a message.

A schema is compiled to one expression over VARIANT, so documents are parsed
once and checked where they are read, without Python and without a shuffle.
Types, missing and null members are told apart as JSON tells them apart.  Of
the 2020-12 vocabulary these words are known: type, const, enum, required,
properties, additionalProperties, items, minItems, maxItems, uniqueItems,
minimum, maximum, exclusiveMinimum, exclusiveMaximum, multipleOf, minLength,
maxLength, pattern, allOf, anyOf, oneOf, not, and references within the schema
that do not lead back to themselves.  Any other word that would check something
is refused, so that nothing goes unchecked.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

PROBLEMS = "array<struct<path: string, message: string>>"
#: Words that only describe.
SILENT = {"$schema", "$id", "$defs", "$comment", "title", "description", "default", "examples", "format", "deprecated"}
#: The first breaches that an error tells.
TOLD = 8

Node = Callable[[Column, Column], Column]


def _kind(v: Column) -> Column:
    """The JSON type of a variant; whole numbers are integers however they are written."""
    number = F.when(F.try_variant_get(v, "$", "double") == F.floor(F.try_variant_get(v, "$", "double")), "integer").otherwise("number")
    scalar = _bound(
        F.schema_of_variant(v),
        lambda of: F.when(of == "BIGINT", "integer").when(of == "STRING", "string").when(of == "BOOLEAN", "boolean").when(of == "VOID", "null").otherwise(number),
    )
    # the schema of an object or a list would be made of all its parts
    return F.when(F.try_variant_get(v, "$", "map<string, variant>").isNotNull(), "object").when(_parts(v).isNotNull(), "array").otherwise(scalar)


def _shown(v: Column, kind: Column) -> Column:
    text = F.try_variant_get(v, "$", "string")
    return F.when(kind == "string", F.concat(F.lit("'"), text, F.lit("'"))).when(kind == "null", "None").when(kind == "boolean", F.initcap(text)).otherwise(F.to_json(v))


def _plain(value) -> str:
    """A value of the schema as a message shows it."""
    return repr(value) if value is None or isinstance(value, (bool, str)) else json.dumps(value) if not isinstance(value, list) else f"[{', '.join(map(_plain, value))}]"


def _none() -> Column:
    return F.array().cast(PROBLEMS)


def _problem(path: Column, *message: Column | str) -> Column:
    parts = [F.lit(m) if isinstance(m, str) else m for m in message]
    return F.array(F.struct(path.alias("path"), F.concat(*parts).alias("message"))).cast(PROBLEMS)


def _if(bad: Column, problem: Column) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), problem).otherwise(_none())


def _under(path: Column, name: Column | str) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    return F.when(path == "", name).otherwise(F.concat(path, F.lit("/"), name))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a variable that holds ``value``, so that it is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)  # an index in brackets works out the type of the whole body again for each row


def _joined(found: list[Column]) -> Column:
    """The problems of all of ``found``, with no array made that is not needed."""
    return found[0] if len(found) == 1 else F.concat(*found) if found else _none()


def _member(v: Column, name: str) -> Column:
    if "'" in name:
        raise ValueError(f"no quotes in names of members: {name}")
    return F.try_variant_get(v, f"$['{name}']", "variant")


def _equal(v: Column, kind: Column, value) -> Column:
    if value is None:
        return kind == "null"
    if isinstance(value, bool):
        return (kind == "boolean") & (F.try_variant_get(v, "$", "boolean") == F.lit(value))
    if isinstance(value, (int, float)):
        return kind.isin("integer", "number") & (F.try_variant_get(v, "$", "double") == F.lit(float(value)))
    if isinstance(value, str):
        return (kind == "string") & (F.try_variant_get(v, "$", "string") == F.lit(value))
    return F.to_json(v) == F.to_json(F.parse_json(F.lit(json.dumps(value))))


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


class _Compiler:
    def __init__(self, schema: dict):
        self.root = schema

    def node(self, schema: dict | bool, on_the_way: tuple[str, ...] = ()) -> Node:
        """A function of a variant that is there and its path."""
        if isinstance(schema, bool):
            return lambda v, path: _none() if schema else _problem(path, "False schema does not allow ", _shown(v, _kind(v)))
        checks: list[Callable[[Column, Column, Column], Column]] = []
        for word, value in schema.items():
            if word in SILENT:
                continue
            if word == "$ref":
                if value in on_the_way or not value.startswith("#/"):
                    raise ValueError(f"a reference that leads back to itself or elsewhere: {value}")
                of = self.root
                for part in value[2:].split("/"):
                    of = of[part.replace("~1", "/").replace("~0", "~")]
                checks.append(self._whole(self.node(of, (*on_the_way, value))))
            elif make := getattr(self, "_of_" + word, None):
                checks.append(make(value, schema, on_the_way))
            else:
                raise ValueError(f"unknown word of a schema: {word}")

        def check(v: Column, path: Column) -> Column:
            return _bound(_kind(v), lambda kind: _joined([c(v, kind, path) for c in checks]))

        return check

    @staticmethod
    def _whole(inner: Node):
        return lambda v, kind, path: inner(v, path)

    def _of_type(self, value, schema, way):
        names = [value] if isinstance(value, str) else value
        told = ", ".join(map(repr, names))
        allowed = [*names, "integer"] if "number" in names else names
        return lambda v, kind, path: _if(~kind.isin(*allowed), _problem(path, _shown(v, kind), f" is not of type {told}"))

    def _of_const(self, value, schema, way):
        return lambda v, kind, path: _if(~_equal(v, kind, value), _problem(path, f"{_plain(value)} was expected"))

    def _of_enum(self, value, schema, way):
        return lambda v, kind, path: _if(~_any([_equal(v, kind, x) for x in value]), _problem(path, _shown(v, kind), f" is not one of {_plain(value)}"))

    def _of_required(self, value, schema, way):
        def check(v, kind, path):
            return _joined([_if((kind == "object") & _member(v, name).isNull(), _problem(path, f"{name!r} is a required property")) for name in value])

        return check

    def _of_properties(self, value, schema, way):
        nodes = {name: self.node(inner, way) for name, inner in value.items()}

        def check(v, kind, path):
            def of(name, inner):
                return _bound(_member(v, name), lambda x: F.when(x.isNotNull(), inner(x, _under(path, name))).otherwise(_none()))

            return F.when(kind == "object", _joined([of(*n) for n in nodes.items()])).otherwise(_none())

        return check

    def _of_additionalProperties(self, value, schema, way):  # noqa: N802
        known, inner = list(schema.get("properties", {})), self.node(value, way)

        def check(v, kind, path):
            others = F.filter(F.map_entries(F.try_variant_get(v, "$", "map<string, variant>")), lambda e: ~e["key"].isin(*known) if known else F.lit(True))
            if value is False:
                names = F.array_join(F.transform(others, lambda e: F.concat(F.lit("'"), e["key"], F.lit("'"))), ", ")
                were = F.when(F.size(others) > 1, " were unexpected)").otherwise(" was unexpected)")
                return _if((kind == "object") & (F.size(others) > 0), _problem(path, "Additional properties are not allowed (", names, were))
            return F.when(kind == "object", F.flatten(F.transform(others, lambda e: inner(e["value"], _under(path, e["key"]))))).otherwise(_none())

        return check

    def _of_items(self, value, schema, way):
        inner = self.node(value, way)

        def check(v, kind, path):
            parts = F.transform(_parts(v), lambda x, i: inner(x, _under(path, i.cast("string"))))
            return F.when(kind == "array", F.flatten(parts)).otherwise(_none())

        return check

    def _of_uniqueItems(self, value, schema, way):  # noqa: N802
        def check(v, kind, path):
            texts = F.transform(_parts(v), lambda x: F.to_json(x))
            return _if((kind == "array") & F.lit(value) & (F.size(F.array_distinct(texts)) < F.size(texts)), _problem(path, _shown(v, kind), " has non-unique elements"))

        return check

    def _of_multipleOf(self, value, schema, way):  # noqa: N802
        def check(v, kind, path):
            share = F.try_variant_get(v, "$", "double") / F.lit(float(value))
            return _if(kind.isin("integer", "number") & (share != F.floor(share)), _problem(path, _shown(v, kind), f" is not a multiple of {_plain(value)}"))

        return check

    def _of_pattern(self, value, schema, way):
        return lambda v, kind, path: _if((kind == "string") & ~F.try_variant_get(v, "$", "string").rlike(value), _problem(path, _shown(v, kind), f" does not match {value!r}"))

    def _of_allOf(self, value, schema, way):  # noqa: N802
        nodes = [self.node(s, way) for s in value]
        return lambda v, kind, path: _joined([n(v, path) for n in nodes])

    def _of_anyOf(self, value, schema, way):  # noqa: N802
        nodes = [self.node(s, way) for s in value]
        return lambda v, kind, path: _if(~_any([F.size(n(v, path)) == 0 for n in nodes]), _problem(path, _shown(v, kind), " is not valid under any of the given schemas"))

    def _of_oneOf(self, value, schema, way):  # noqa: N802
        nodes = [self.node(s, way) for s in value]

        def check(v, kind, path):
            holds = F.size(F.filter(F.array(*[F.size(n(v, path)) == 0 for n in nodes]), lambda x: x))
            message = F.when(holds == 0, " is not valid under any of the given schemas").otherwise(" is valid under more than one of the given schemas")
            return _if(holds != 1, _problem(path, _shown(v, kind), message))

        return check

    def _of_not(self, value, schema, way):
        inner = self.node(value, way)
        return lambda v, kind, path: _if(F.size(inner(v, path)) == 0, _problem(path, _shown(v, kind), f" should not be valid under {json.dumps(value)}"))


def _parts(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _limit(kinds: tuple[str, ...], measure: Callable[[Column], Column], broken: Callable[[Column, float], Column], message: Callable[[object], str]):
    def make(self, value, schema, way):
        return lambda v, kind, path: _if(kind.isin(*kinds) & broken(measure(v), value), _problem(path, _shown(v, kind), message(value)))

    return make


def _number(v: Column) -> Column:
    return F.try_variant_get(v, "$", "double")


def _length(v: Column) -> Column:
    return F.length(F.try_variant_get(v, "$", "string"))


def _count(v: Column) -> Column:
    return F.size(_parts(v))


_NUMBERS = ("integer", "number")
for _name, _args in {
    "minimum": (_NUMBERS, _number, lambda x, m: x < m, lambda m: f" is less than the minimum of {_plain(m)}"),
    "maximum": (_NUMBERS, _number, lambda x, m: x > m, lambda m: f" is greater than the maximum of {_plain(m)}"),
    "exclusiveMinimum": (_NUMBERS, _number, lambda x, m: x <= m, lambda m: f" is less than or equal to the minimum of {_plain(m)}"),
    "exclusiveMaximum": (_NUMBERS, _number, lambda x, m: x >= m, lambda m: f" is greater than or equal to the maximum of {_plain(m)}"),
    "minLength": (("string",), _length, lambda x, m: x < m, lambda m: " is too short"),
    "maxLength": (("string",), _length, lambda x, m: x > m, lambda m: " is too long"),
    "minItems": (("array",), _count, lambda x, m: x < m, lambda m: " is too short"),
    "maxItems": (("array",), _count, lambda x, m: x > m, lambda m: " is too long"),
}.items():
    setattr(_Compiler, "_of_" + _name, _limit(*_args))


def problems(text: Column, schema: dict) -> Column:
    """The breaches of ``schema`` by a JSON document, in the order of the schema's words: ``array<struct<path, message>>``.

    Null text has no breaches (null); text that is not JSON has one at the root.
    """
    check = _Compiler(schema).node(schema)
    found = _bound(F.try_parse_json(text), lambda v: F.when(v.isNull(), _problem(F.lit(""), "not a JSON document")).otherwise(check(v, F.lit(""))))
    named = F.transform(found, lambda p: F.struct(F.when(p["path"] == "", "<root>").otherwise(p["path"]).alias("path"), p["message"].alias("message")))
    return F.when(text.isNotNull(), named)


def breaches(docs: DataFrame, schema: dict, text: str = "value") -> DataFrame:
    """A row ``(.., path, message)`` for each breach, with the other columns of ``docs``."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (text, "path", "message")]
    return docs.select(*others, F.explode(problems(F.col(f"`{text}`"), schema)).alias("breach")).select(*others, F.col("breach.path").alias("path"), F.col("breach.message").alias("message"))


def require_valid(docs: DataFrame, schema: dict, text: str = "value") -> DataFrame:
    """``docs``, if none breaks the schema; else an error with the first breaches."""
    first = breaches(docs.select(text), schema, text).limit(TOLD).collect()
    if first:
        raise ValueError("documents break the schema:\n  " + "\n  ".join(f"{r.path}: {r.message}" for r in first))
    return docs


# The label format, version 1.1.0.
LABEL_SCHEMA = {
    "type": "object",
    "required": ["schema_version", "clip_id", "take_id", "baseline_id", "who", "where", "what", "duration_s", "labels_from"],
    "additionalProperties": True,
    "properties": {
        "schema_version": {"const": "1.1.0"},
        "clip_id": {"type": "string", "pattern": "^B[0-9]{2}-[A-Z0-9]+_[A-Z0-9]+(__[A-Z0-9_]+_L[0-9]_s[0-9]{4})?$"},
        "take_id": {"type": "string"},
        "baseline_id": {"type": "string", "pattern": "^B[0-9]{2}$"},
        "genre": {"type": ["string", "null"]},
        "who": {
            "type": "object",
            "required": ["speaker_id"],
            "properties": {
                "speaker_id": {"type": "string"}, "age_band": {"type": ["string", "null"]}, "accent": {"type": ["string", "null"]}, "gender": {"enum": ["F", "M", "X", None]},
                "fluency_profile": {"type": ["string", "null"]}, "synthetic_voice": {"type": "boolean"},
            },
        },
        "where": {
            "type": "object",
            "required": ["base_condition", "added_condition"],
            "properties": {"base_condition": {"enum": ["C0", "C1", "C2"]}, "added_condition": {"enum": [None, "N20", "N10", "RVB", "PHN", "MP3", "GAIN"]}, "params": {"type": "object"}},
        },
        "what": {"type": "array", "items": {"$ref": "#/$defs/region"}},
        "duration_s": {"type": "number", "exclusiveMinimum": 0},
        "seed": {"type": "integer"},
        "generator_version": {"type": "string"},
        "labels_from": {"enum": ["generator", "splice", "human", "human-double", "engine"]},
        "multi_set": {"type": ["array", "null"], "items": {"type": "string"}},
        "scenario": {"type": ["string", "null"]},
        "scores": {"$ref": "#/$defs/scores"},
    },
    "$defs": {
        "flaw": {
            "enum": [
                "PACE_FAST", "PACE_SLOW", "PAUSE_BAD", "PAUSE_LOST", "MONOTONE", "UPTALK", "EMPH_FLAT", "EMPH_WRONG", "FADE", "SHOUT", "FILLER", "REPEAT", "RARE_HESIT",
                "SLUR", "WORD_SKIP", "WORD_SWAP",
            ]
        },
        "category": {"enum": ["Pacing", "Pausing", "Intonation", "Volume", "Fluency", "Clarity", "Text fidelity"]},
        "region": {
            "type": "object",
            "required": ["flaw", "category", "start_s", "end_s", "word_start", "word_end"],
            "properties": {
                "flaw": {"$ref": "#/$defs/flaw"}, "category": {"$ref": "#/$defs/category"}, "level": {"type": "integer", "minimum": 1, "maximum": 5},
                "kind": {"enum": ["modify", "insert", "delete"]}, "params": {"type": "object"}, "start_s": {"type": "number", "minimum": 0}, "end_s": {"type": "number", "minimum": 0},
                "baseline_start_s": {"type": "number", "minimum": 0}, "baseline_end_s": {"type": "number", "minimum": 0}, "word_start": {"type": "integer", "minimum": 0},
                "word_end": {"type": "integer", "minimum": 0}, "boundary": {"type": "string"}, "context": {"type": "string"}, "why": {"type": "string"},
                "severity": {"type": "number", "minimum": 0, "maximum": 5}, "confidence": {"type": "number", "minimum": 0, "maximum": 1},
                "points_lost": {"type": "number", "minimum": 0}, "explanation": {"type": "string"},
            },
        },
        "scores": {
            "type": "object",
            "properties": {
                "overall": {"type": "number", "minimum": 0, "maximum": 100}, "band": {"enum": ["polished", "strong", "noticeable", "needs work"]},
                "categories": {"type": "object", "additionalProperties": {"type": "number", "minimum": 0, "maximum": 100}},
                "reference_mode": {"enum": ["same-speaker", "cross-speaker", "reference-free"]},
            },
        },
    },
}
