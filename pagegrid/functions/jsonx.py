"""Canonical JSON, hashes and key paths over VARIANT columns."""
from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

c = F.col


def canonical(json_text: Column) -> Column:
    """JSON text with keys sorted at every depth; null when it does not parse."""
    return F.to_json(F.try_parse_json(json_text))


def content_hash(json_text: Column) -> Column:
    return F.sha2(canonical(json_text), 256)


def _without_key(ignored: str):
    @F.pandas_udf("string")
    def remove(texts: pd.Series) -> pd.Series:
        def prune(v):
            if isinstance(v, dict):
                return {k: prune(x) for k, x in v.items() if k != ignored}
            return [prune(x) for x in v] if isinstance(v, list) else v

        return texts.map(lambda s: None if s is None else json.dumps(prune(json.loads(s)), ensure_ascii=False))

    return remove


def request_hash(json_text: Column, ignored: str = "idempotencyKey") -> Column:
    """SHA-256 of the canonical text with one key removed at every depth.

    Only texts that hold the key reach the Arrow helper; all others stay in the JVM.
    """
    text = canonical(json_text)
    holds = text.contains(f'"{ignored}":')
    pruned = F.to_json(F.try_parse_json(_without_key(ignored)(F.when(holds, text))))
    return F.sha2(F.coalesce(pruned, text), 256)


class _Number(str):
    """A number as it is written, so that it comes out unchanged."""


def _load(text: str):
    return json.loads(text, parse_int=_Number, parse_float=_Number)


def _dump(v) -> str:
    if isinstance(v, _Number):
        return v
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_dump(x)}" for k, x in v.items()) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(_dump, v)) + "]"
    return json.dumps(v, ensure_ascii=False)


def _per_text(walk, kind: str):
    """A function of one JSON text as an Arrow-batched column function; null texts stay null."""
    return F.pandas_udf(lambda texts: texts.map(lambda t: None if t is None else walk(_load(t))), kind)


def _field_leaves(value) -> list[dict]:
    """Members that are not objects, at any depth; arrays stay whole."""
    found, todo = [], [("", None, value)]
    while todo:
        path, key, v = todo.pop()
        if isinstance(v, dict):
            todo += [(f"{path}.{k}" if path else k, k, x) for k, x in reversed(v.items())]
        elif key is not None:
            found.append({"path": path, "key": key, "value": _dump(v)})
    return found


def _all_paths(value) -> list[dict]:
    """Every member and array item, at any depth, without values."""
    found, todo = [], [("", value)]
    while todo:
        path, v = todo.pop()
        if isinstance(v, dict):
            inner = [(f"{path}.{k}" if path else k, k, x) for k, x in v.items()]
        elif isinstance(v, list):
            inner = [(f"{path}[{i}]", None, x) for i, x in enumerate(v)]
        else:
            continue
        found += [{"path": p, "key": k, "value": None} for p, k, _ in inner]
        todo += [(p, x) for p, _, x in reversed(inner)]
    return found


def flatten_paths(df: DataFrame, value: str, keys: list[str], open_arrays: bool = False) -> DataFrame:
    """(keys.., path, key, value) of a VARIANT column, at any depth, in one pass inside the row.

    Arrays stay whole (change diffs) and only leaves are given; with ``open_arrays`` (policy audits) arrays open as ``[i]``
    and the inner members are given too, without values. Null members are kept.
    """
    walk = _per_text(_all_paths if open_arrays else _field_leaves, "array<struct<path:string,key:string,value:string>>")
    opened = df.select(*keys, F.explode(walk(F.to_json(c(value)))).alias("x"))
    return opened.select(*keys, "x.path", "x.key", F.parse_json("x.value").alias("value"))


def _graph_objects(value) -> list[dict]:
    found, todo = [], [([], value)]
    while todo:
        path, v = todo.pop()
        if isinstance(v, dict):
            found.append({"path": path, "node": _dump(v)})
            v = v.get("@graph")
        if isinstance(v, list):
            todo += [([*path, i], x) for i, x in reversed(list(enumerate(v)))]
    return found


def graph_objects(value: Column) -> Column:
    """Objects of a VARIANT that stand in arrays and ``@graph`` lists, at any depth, with their places."""
    return _per_text(_graph_objects, "array<struct<path:array<int>,node:string>>")(F.to_json(value))
