"""Responses held against the selections of their query: missing fields, wrong shapes, entities, further pages; planning of queries."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jsonx import canonical
from ..functions.shipping import ship

#: Fixed kinds of selections: those that only group others, and those that ask for nothing of their own.
GROUPS = ("Condition", "InlineFragment", "ClientExtension", "Defer", "Stream")
SILENT = ("LinkedHandle", "ScalarHandle", "TypeDiscriminator", "ClientExtension")


def path_text(path: tuple) -> str:
    return "$" + "".join(f"[{p}]" if isinstance(p, int) else f".{p}" for p in path)


def type_of(obj: dict, hint: str | None) -> str | None:
    """An object's type: what it says, what its field promises, or what its id begins with."""
    import base64
    import binascii

    said = obj.get("__typename") or hint
    if said or not isinstance(obj.get("id"), str) or not obj["id"]:
        return said
    raw = obj["id"]
    try:
        raw = base64.b64decode(raw + "=" * (-len(raw) % 4), validate=True).decode()
    except (binascii.Error, UnicodeDecodeError):
        pass
    return raw.split("-")[0]


@dataclass(frozen=True)
class Place:
    """A selection as it applies to one object of the data."""

    selection: dict
    owner: dict
    path: tuple
    key: str | None

    @property
    def value(self) -> object:
        return self.owner.get(self.key)


def places(selections: list, data: object, variables: dict, strict: bool) -> Iterator[Place]:
    """Every field selection on every object that it applies to.

    ``strict``: only selections whose condition and type hold; else all that may apply. Lists are
    entered for plural and singular fields alike.
    """
    todo = [(selections, data, (), None)]
    while todo:
        chosen, obj, path, hint = todo.pop()
        if not isinstance(obj, dict):
            continue
        kind = type_of(obj, hint)
        for s in chosen:
            if s["kind"] in GROUPS:
                holds = {"Condition": lambda s=s: bool(variables.get(s.get("condition"))) == s.get("passingValue"), "InlineFragment": lambda s=s, kind=kind: bool(s.get("abstractKey")) or s.get("type") == kind}.get(s["kind"], lambda: not strict)
                if not strict or holds():
                    todo.append((s.get("selections", []), obj, path, kind))
                continue
            field = s["kind"] in ("ScalarField", "LinkedField")
            key = (s.get("alias") or s["name"]) if field else None
            yield Place(s, obj, path, key)
            if s["kind"] == "LinkedField":
                value = obj.get(key)
                members = [((*path, key, i), v) for i, v in enumerate(value)] if isinstance(value, list) else [((*path, key), value)]
                todo += [(s.get("selections", []), v, p, s.get("concreteType")) for p, v in members]


def missing_fields(selections: list, data: object, variables: dict) -> set[str]:
    """Paths of selected fields that the data lacks, and of selections of a kind that is not known."""
    out = set()
    for p in places(selections, data, variables, True):
        if p.key is not None and p.key not in p.owner:
            out.add(path_text((*p.path, p.key)))
        elif p.key is None and p.selection["kind"] not in SILENT:
            out.add(path_text((*p.path, f"__unhandled_selection__{p.selection['kind']}")))
    return out


def invalid_shapes(selections: list, data: object, variables: dict) -> set[str]:
    """Paths of linked fields that hold a list for one object, one for a list, or no objects at all; null is always fine."""
    out = set()
    for p in places(selections, data, variables, True):
        if p.selection["kind"] != "LinkedField" or p.value is None:
            continue
        at = (*p.path, p.key)
        if p.selection.get("plural") is True:
            if isinstance(p.value, list):
                out.update(path_text((*at, i)) for i, v in enumerate(p.value) if v is not None and not isinstance(v, dict))
            else:
                out.add(path_text(at))
        elif not isinstance(p.value, dict):
            out.add(path_text(at))
    return out


def continuations(selections: list, data: object, variables: dict) -> Iterator[tuple[str, str, dict | None]]:
    """(next, path, variables) of pages that follow by cursor, (page, ...) by number, (stalled, path, None) where a cursor does not move."""
    for p in places(selections, data, variables, False):
        if p.selection["kind"] != "LinkedField":
            continue
        ask = {a["name"]: a["variableName"] for a in p.selection.get("args") or [] if a["kind"] == "Variable"}
        for i, child in enumerate(p.value) if isinstance(p.value, list) else [(None, p.value)]:
            if not isinstance(child, dict):
                continue
            at = path_text((*p.path, p.key) if i is None else (*p.path, p.key, i))
            info = child.get("pageInfo") or {}
            if info.get("hasNextPage") is True and "after" in ask:
                cursor = info.get("endCursor")
                fresh = bool(cursor) and cursor != variables.get(ask["after"])
                yield ("next", at, variables | {ask["after"]: cursor}) if fresh else ("stalled", at, None)
            elif "page" in ask and "after" not in ask and (info.get("hasNextPage") is True or ("hasNextPage" not in info and child.get("nodes", child.get("edges")))):
                yield "page", at, variables | {ask["page"]: variables.get(ask["page"], 1) + 1}


def entities(selections: list, data: object, variables: dict) -> Iterator[tuple[str, str, str, str]]:
    """(typename, id, path, canonical JSON) of every typed object with an id."""
    seen = set()
    for p in places(selections, data, variables, False):
        if id(p.owner) not in seen:
            seen.add(id(p.owner))
            hint = None
            if (kind := type_of(p.owner, hint)) and isinstance(p.owner.get("id"), str):
                yield kind, p.owner["id"], path_text(p.path), canonical(p.owner)


def findings(responses: DataFrame, catalog: dict[str, dict], bodies: bool = False) -> DataFrame:
    """(id, finding, path, detail) of responses (id, operation, variables_json, json_text), walked in Arrow batches.

    With ``bodies`` also body: the canonical JSON of an entity. ``catalog``: the operation's definition by name, a document of bounded size that is sent with the code.
    """
    ship(responses.sparkSession)
    names = ["id", "finding", "path", "detail", *(["body"] if bodies else [])]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for rid, op, var, text in f.itertuples(index=False):
                try:
                    data, variables = json.loads(text).get("data"), json.loads(var or "{}")
                except (TypeError, ValueError, AttributeError):
                    continue
                if op not in catalog:
                    out.append((rid, "unknown_operation", "$", op))
                    continue
                chosen = catalog[op]["operation"]["selections"]
                out += [(rid, "missing", p, None) for p in sorted(missing_fields(chosen, data, variables))]
                out += [(rid, "shape", p, None) for p in sorted(invalid_shapes(chosen, data, variables))]
                out += [(rid, k, p, canonical(v) if v else None) for k, p, v in continuations(chosen, data, variables)]
                out += [(rid, "entity", p, canonical([t, i]), body)[: len(names)] for t, i, p, body in entities(chosen, data, variables)]
            yield pd.DataFrame([(*r, None)[: len(names)] if len(r) < len(names) else r for r in out], columns=names)

    return responses.where(F.col("json_text").isNotNull()).select("id", "operation", "variables_json", "json_text").mapInPandas(run, f"id {responses.schema['id'].dataType.simpleString()}, {', '.join(n + ' string' for n in names[1:])}")


def new_pages(pages: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Pages (account, operation, binding, field_path, sha256) that were not seen before: a repeated fingerprint ends a numbered list."""
    key = ["account", "operation", "binding", "field_path", "sha256"]
    return pages.dropDuplicates(key).join(fingerprints.select(*key), key, "left_anti")


def plan(catalog: dict[str, dict], excluded: dict[str, str], free: set[str]) -> dict[str, tuple[str, str | None]]:
    """For each operation its class (root, related, unsupported, excluded) and why.

    A query whose variables are all ``free`` stands alone; one that also needs ids of known types is
    related to objects; any other variable makes it unsupported; what is no query changes data.
    """
    out = {}
    for name, q in catalog.items():
        if q["params"]["operationKind"] != "query":
            out[name] = ("excluded", "no query")
        elif name in excluded:
            out[name] = ("excluded", excluded[name])
        else:
            bound = bindings(q["operation"]["selections"])
            open_ = {a["name"] for a in q["operation"]["argumentDefinitions"]} - free - set(bound)
            out[name] = ("unsupported", ",".join(sorted(open_))) if open_ else ("related" if bound else "root", None)
    return out


def bindings(selections: list) -> dict[str, list[str]]:
    """Variables that are passed as an id, and the types that the fields asked with them give."""
    out: dict[str, list[str]] = {}
    todo = list(selections)
    while todo:
        s = todo.pop(0)
        if s["kind"] in GROUPS:
            todo += s.get("selections", [])
        elif s["kind"] in ("LinkedField", "ScalarField"):
            kinds = [x["type"] for x in s.get("selections", []) if x["kind"] == "InlineFragment"] + ([s["concreteType"]] if s.get("concreteType") else [])
            out |= {a["variableName"]: kinds for a in s.get("args") or [] if a["kind"] == "Variable" and a["name"] == "id" and kinds}
    return out


def related(objects: DataFrame, routes: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """(operation, variable, value) to ask for each object (typename, entity_id); ``routes``: variable and types by operation."""
    rows = [(op, var, t) for op, (var, types) in sorted(routes.items()) for t in types]
    table = objects.sparkSession.createDataFrame(rows, "operation string, variable string, typename string")
    return objects.select("typename", "entity_id").distinct().join(F.broadcast(table), "typename").select("operation", "variable", F.col("entity_id").alias("value"))
