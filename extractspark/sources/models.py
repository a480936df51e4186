"""Learned models as files: JSON, SQLite, or a Parquet folder. A model is small (rules, not pages) and lives on the driver.

The JSON and SQLite layouts name each rule's levels as [tag, {class, style}, place of the next level]; the first level is
the document. Files are written beside their target and put in place at once.
"""

from __future__ import annotations

import json
import os
import sqlite3
import tempfile
from contextlib import closing
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from ..operators.rules import Level, Rule
from .html import DOCUMENT

SQLITE = (".db", ".sqlite", ".sqlite3")
# The tables of a model in SQLite.
DDL = """
CREATE TABLE metadata (key TEXT PRIMARY KEY, value TEXT);
CREATE TABLE stack_list (id INTEGER PRIMARY KEY, stack_id TEXT, alias TEXT, group_index INTEGER, attr_index INTEGER, data TEXT);
CREATE TABLE group_rules (id INTEGER PRIMARY KEY, group_id TEXT, data TEXT);
CREATE TABLE adaptive_data (id INTEGER PRIMARY KEY, domain TEXT, identifier TEXT, properties TEXT);
CREATE TABLE content_fingerprints (id INTEGER PRIMARY KEY, fp_key TEXT, data TEXT);
"""


@dataclass
class Model:
    rules: list[Rule] = field(default_factory=list)
    group_rules: list[dict] = field(default_factory=list)
    signatures: dict[str, dict[str, dict]] = field(default_factory=dict)
    fingerprints: list[dict] = field(default_factory=list)


def rule_to_dict(r: Rule) -> dict[str, Any]:
    attrs = [{"class": list(x.cls) or "", "style": x.style} for x in r.levels]
    places = [x.place for x in r.levels]
    content: list[list] = [[DOCUMENT, {"class": "", "style": ""}, places[0]]]
    content += [[x.tag, a, *places[i + 1 : i + 2]] for i, (x, a) in enumerate(zip(r.levels, attrs, strict=True))]
    more = {k: getattr(r, k) for k in ("wanted_attr", "is_full_url", "is_non_rec_text", "url", "hash", "stack_id", "alias")}
    return {"content": content, **more, **({"group_index": r.group_index, "attr_index": r.attr_index} if r.group_index is not None else {})}


def rule_from_dict(d: dict[str, Any]) -> Rule:
    levels, place = [], 0
    for step in d["content"]:
        if step[0] != DOCUMENT:
            cls = step[1].get("class") or []
            levels.append(Level(step[0], tuple([cls] if isinstance(cls, str) else cls), step[1].get("style") or "", place))
        place = step[2] if len(step) > 2 else 0
    more = {k: d[k] for k in ("wanted_attr", "url", "hash", "stack_id", "alias", "group_index", "attr_index") if d.get(k) is not None}
    return Rule(levels, is_full_url=bool(d.get("is_full_url")), is_non_rec_text=bool(d.get("is_non_rec_text")), **more)


def to_dict(model: Model, include_adaptive: bool = True) -> dict[str, Any]:
    out: dict[str, Any] = {"stack_list": [rule_to_dict(r) for r in model.rules]}
    if model.group_rules:
        out["group_rules"] = model.group_rules
    if include_adaptive and model.signatures:
        out["adaptive_data"] = model.signatures
    if model.fingerprints:
        out["content_fingerprints"] = {f["fp_key"]: {k: v for k, v in f.items() if k != "fp_key"} for f in model.fingerprints}
    return out


def from_dict(data: dict[str, Any] | list, include_adaptive: bool = True) -> Model:
    data = {"stack_list": data} if isinstance(data, list) else data
    rules = [rule_from_dict(d) for d in data.get("stack_list", [])]
    for i, r in enumerate(rules):
        r.seq = i
    fingerprints = [{"fp_key": k, **v} for k, v in (data.get("content_fingerprints") or {}).items()]
    return Model(rules, data.get("group_rules") or [], (data.get("adaptive_data") or {}) if include_adaptive else {}, fingerprints)


def _format(path: str, kind: str) -> str:
    if kind not in ("auto", "json", "db", "sqlite", "parquet"):
        raise ValueError("format is 'auto', 'json', 'db', 'sqlite' or 'parquet'")
    if kind == "auto":
        return "sqlite" if path.endswith(SQLITE) else "parquet" if path.endswith(".parquet") else "json"
    return "sqlite" if kind == "db" else kind


def _beside(path: str) -> str:
    handle, name = tempfile.mkstemp(dir=Path(path).resolve().parent)
    os.close(handle)
    return name


def save(model: Model, path: str, format: str = "auto", include_adaptive: bool = True, spark: SparkSession | None = None) -> None:
    kind, data = _format(path, format), to_dict(model, include_adaptive)
    if kind == "parquet":
        rows = [(k, json.dumps(v, ensure_ascii=False)) for k, v in data.items()]
        (spark or SparkSession.active()).createDataFrame(rows, "part string, data string").coalesce(1).write.mode("overwrite").parquet(path)
        return
    temporary = _beside(path)
    try:
        if kind == "json":
            Path(temporary).write_text(json.dumps(data, indent=2, ensure_ascii=False), encoding="utf-8")
        else:
            _to_sqlite(temporary, data, bool(data.get("adaptive_data")))
        os.replace(temporary, path)
    finally:
        Path(temporary).unlink(missing_ok=True)


def _to_sqlite(path: str, data: dict[str, Any], adaptive: bool) -> None:
    text = lambda v: json.dumps(v, ensure_ascii=False)
    with closing(sqlite3.connect(path)) as db, db:
        db.executescript(DDL)
        db.executemany("INSERT INTO metadata VALUES (?, ?)", [("version", "1.0"), ("adaptive_enabled", str(adaptive))])
        db.executemany("INSERT INTO stack_list (stack_id, alias, group_index, attr_index, data) VALUES (?, ?, ?, ?, ?)", [(d["stack_id"], d["alias"], d.get("group_index"), d.get("attr_index"), text(d)) for d in data["stack_list"]])
        db.executemany("INSERT INTO group_rules (group_id, data) VALUES (?, ?)", [(g["group_id"], text(g)) for g in data.get("group_rules", [])])
        db.executemany("INSERT INTO adaptive_data (domain, identifier, properties) VALUES (?, ?, ?)", [(d, i, text(p)) for d, x in data.get("adaptive_data", {}).items() for i, p in x.items()])
        db.executemany("INSERT INTO content_fingerprints (fp_key, data) VALUES (?, ?)", [(k, text(v)) for k, v in data.get("content_fingerprints", {}).items()])


def load(path: str, format: str = "auto", include_adaptive: bool = True, spark: SparkSession | None = None) -> Model:
    kind = _format(path, format)
    if kind == "parquet":
        rows = (spark or SparkSession.active()).read.parquet(path).collect()
        return from_dict({r["part"]: json.loads(r["data"]) for r in rows}, include_adaptive)
    if not Path(path).exists():
        raise FileNotFoundError(path)
    if kind == "json":
        return from_dict(json.loads(Path(path).read_text(encoding="utf-8")), include_adaptive)
    data: dict[str, Any] = {"stack_list": [], "group_rules": [], "adaptive_data": {}, "content_fingerprints": {}}
    with closing(sqlite3.connect(path)) as db:
        there = {r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
        rows = lambda table, columns: db.execute(f"SELECT {columns} FROM {table} ORDER BY id") if table in there else ()  # noqa: E731, S608
        data["stack_list"] = [json.loads(r[0]) for r in rows("stack_list", "data")]
        data["group_rules"] = [json.loads(r[0]) for r in rows("group_rules", "data")]
        for domain, identifier, properties in rows("adaptive_data", "domain, identifier, properties"):
            data["adaptive_data"].setdefault(domain, {})[identifier] = json.loads(properties)
        data["content_fingerprints"] = {k: json.loads(v) for k, v in rows("content_fingerprints", "fp_key, data")}
    return from_dict(data, include_adaptive)
