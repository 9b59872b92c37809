"""Requests as JSON, checked and typed by what the option classes say.

The classes are the one source: their fields give names, types and defaults, their checks
the ranges and choices. They are compiled to expressions over the request's text, so all
errors of all requests are found in one projection, each with its path, and a request
without errors becomes a nested struct with defaults filled in.
"""

from __future__ import annotations

import types
import typing
from dataclasses import MISSING, dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import options as O

#: Where the classes stand in a request, by their field of RequestOptions.
PLACES = {"text": ("text_processing",), "validation": ("validation",), "alignment": ("validation", "alignment"), "post": ("post_processing",)}
#: Spark type, and pattern of a value's text, of each kind. Whole numbers may have zeros after the point.
KINDS = {
    "int": ("long", r"^-?[0-9]+(\.0*)?$"),
    "float": ("double", r"^-?[0-9]+(\.[0-9]*)?([eE][-+]?[0-9]+)?$"),
    "bool": ("boolean", r"^(true|false|1|0)$"),
    "str": ("string", ""),
    "limits": ("map<int,double>", r"^\{.*\}$"),
    "seeds": ("array<bigint>", r"^(-?[0-9]+|\[\s*(-?[0-9]+(\s*,\s*-?[0-9]+)*)?\s*\])$"),
}


@dataclass(frozen=True)
class Option:
    """A field of a request: where it is, and what it may be."""

    path: tuple[str, ...]
    kind: str
    default: object
    null: bool
    limit: dict


def _kind(hint: object) -> tuple[str, bool]:
    parts = typing.get_args(hint) if isinstance(hint, types.UnionType) else (hint,)
    names = [p.__name__ for p in parts if p is not type(None)]
    return "seeds" if "tuple" in names else "limits" if "dict" in names else names[0], type(None) in parts


def compiled() -> list[Option]:
    """Every option of a request, by path."""
    out = []
    for cls, at in [(O.RequestOptions, ()), *((f.default_factory, PLACES[f.name]) for f in fields(O.RequestOptions) if f.name in PLACES)]:
        hints, noted = typing.get_type_hints(cls), O.limits(cls)
        for f in fields(cls):
            if f.name not in PLACES or cls is not O.RequestOptions:
                kind, null = _kind(hints[f.name])
                out.append(Option((*at, f.name), kind, f.default if f.default is not MISSING else f.default_factory(), null, noted.get(f.name, {})))
    return out


def template() -> dict:
    """A request of defaults, nested as requests are."""
    out: dict = {"text": "Your text goes here."}
    for o in compiled():
        held = out
        for name in o.path[:-1]:
            held = held.setdefault(name, {})
        held[o.path[-1]] = o.default
    return out


def _value(o: Option, raw: Column) -> Column:
    if o.kind == "limits":
        found = F.from_json(raw, "map<string,double>")
        return F.map_from_entries(F.transform(F.map_entries(found), lambda e: F.struct(e["key"].cast("int"), e["value"])))
    if o.kind == "seeds":
        return F.coalesce(F.from_json(F.when(raw.startswith("["), raw), "array<bigint>"), F.array(raw.cast("long")))
    if o.kind == "bool":
        return raw.isin("true", "1")
    return raw.cast("double").cast("long") if o.kind == "int" else raw.cast(KINDS[o.kind][0])


def _default(o: Option) -> Column:
    if o.kind == "limits":
        return F.create_map(*[F.lit(x) for pair in o.default.items() for x in pair]).cast("map<int,double>")
    if o.kind == "seeds":
        return F.array(*[F.lit(s) for s in (o.default if isinstance(o.default, tuple) else (o.default,))]).cast("array<bigint>")
    return F.lit(o.default).cast(KINDS[o.kind][0])


def _problem(o: Option, held: Column, raw: Column) -> Column:
    """What is wrong with a value, or null."""
    kind, pattern = KINDS[o.kind]
    wrong = F.when(raw.isNull(), None if o.null else "null is not allowed")
    wrong = wrong.when(~raw.rlike(pattern) if pattern else F.lit(False), f"not of type {o.kind}")
    low, high, choices = (o.limit.get(k) for k in ("low", "high", "choices"))
    if low is not None:
        x = raw.cast("double")
        wrong = wrong.when((x < low) | (F.lit(False) if high is None else x > high), f"outside {low} to {'any' if high is None else high}")
    if choices:
        wrong = wrong.when(~raw.isin(*choices), f"none of {', '.join(choices)}")
    return F.when(held, wrong)


def _other(known: list[str]):
    return lambda k: ~k.isin(*known)


def _under(prefix: str):
    return lambda k: F.concat(F.lit(prefix), k)


def checked(requests: DataFrame, engines: list[str], json_col: str = "json", engine_col: str = "engine") -> DataFrame:
    """`requests` with status (200, 404 for another engine, 422), errors (array of path, problem; by path), unknown (paths of fields that no class has; no error) and request (typed, defaults filled in; null with errors).

    Text that is no JSON object has the one error "malformed JSON" with an empty path; null
    is no JSON either. A nested part that is no object has an error of its own and none of
    its fields. Null for a field that may be null stays null.
    """
    opts = compiled()
    places = sorted({o.path[:-1] for o in opts} | {()}, key=len)
    col = {at: "__at" + "_".join(("", *at)) for at in places}
    held = requests.withColumn(col[()], F.from_json(json_col, "map<string,string>"))
    errors: list[Column] = []
    error = lambda path, problem: F.when(problem.isNotNull(), F.struct(F.lit(".".join(path)).alias("path"), problem.alias("problem")))
    for at in places[1:]:
        above = F.col(col[at[:-1]])
        held = held.withColumn(col[at], F.from_json(above[at[-1]], "map<string,string>"))
        errors.append(error(at, F.when(F.map_contains_key(above, at[-1]) & F.col(col[at]).isNull(), "not an object")))
    top = F.col(col[()])
    errors.append(error(("text",), F.when(F.coalesce(F.length(top["text"]), F.lit(0)) == 0, "text is empty")))
    for o in opts:
        m = F.col(col[o.path[:-1]])
        errors.append(error(o.path, _problem(o, F.coalesce(F.map_contains_key(m, o.path[-1]), F.lit(False)), m[o.path[-1]])))
    known = {at: [o.path[-1] for o in opts if o.path[:-1] == at] + [p[-1] for p in places if p and p[:-1] == at] + ["text"] * (at == ()) for at in places}
    prefix = {at: "".join(f"{x}." for x in at) for at in places}
    unknown = F.concat(*[F.transform(F.filter(F.coalesce(F.map_keys(col[at]), F.array().cast("array<string>")), _other(known[at])), _under(prefix[at])) for at in places])
    malformed = F.array(F.struct(F.lit("").alias("path"), F.lit("malformed JSON").alias("problem")))
    found = F.when(top.isNull(), malformed).otherwise(F.array_sort(F.array_compact(F.array(*errors))))
    held = held.withColumn("errors", found).withColumn("unknown", F.array_sort(unknown))
    other = ~F.coalesce(F.col(engine_col).isin(*engines), F.lit(False))
    held = held.withColumn("status", F.when(other, 404).when(F.size("errors") > 0, 422).otherwise(200))

    def typed(at: tuple[str, ...]) -> list[Column]:
        m = F.col(col[at])
        own = [F.when(F.coalesce(F.map_contains_key(m, o.path[-1]), F.lit(False)), _value(o, m[o.path[-1]])).otherwise(_default(o)).alias(o.path[-1]) for o in opts if o.path[:-1] == at]
        return own + [F.struct(*typed(p)).alias(p[-1]) for p in places if p and p[:-1] == at]

    request = F.when(F.col("status") == 200, F.struct(top["text"].alias("text"), *typed(())))
    return held.withColumn("request", request).drop(*col.values())
