"""Deeply nested semi-structured records as related flat tables.

Each record is walked once into triples of path, ordinals and value. The path names the levels without list
positions, the ordinals are the 1-based positions of the elements along it. A table is a repeated ancestor:
its triples are grouped by the ordinals down to that ancestor, which are its key and its link to the parents, and pivoted into
columns. Records are walked on the executors, one at a time; nothing is grouped in Python. A record's text is read by
the JSON library as a whole, as it is one value of a column and so in memory anyway; its triples are then streamed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermaline.session import written

TRIPLES = "row_id long, path string, ords array<int>, seq int, value string"


def _refuse(name: str):
    raise ValueError(f"{name} is no JSON")


def read_json(body: str | None):
    """The value of a JSON text, which may begin with a byte order mark or be a JSON string of a JSON text; None if it is none."""
    for _ in range(4):
        if not isinstance(body, str):
            return body
        try:
            body = json.loads(body.lstrip("\ufeff"), parse_constant=_refuse)
        except (ValueError, RecursionError):
            return None
    return None


def scalar_text(value) -> str | None:
    """Text of a JSON scalar as JSON writes it, strings without quotes."""
    return value if value is None or isinstance(value, str) else json.dumps(value)


def opened(text: str):
    """What a level stands for that is written as text: the object or list that it holds, else the text itself."""
    if text.lstrip("\ufeff \t\r\n")[:1] not in ("{", "["):
        return text
    value = read_json(text)
    return value if isinstance(value, (dict, list)) else text


def walk(record, container: str = "Set", joiner: str = ":", levels: frozenset[str] = frozenset()) -> Iterator[tuple[str, list[int], str | None]]:
    """(path, ordinals, value) of every element and scalar, parents first.

    A list stands for its items, one object for a list of one; null, [] and {} hold no element. Levels whose name
    ends in ``container`` are no elements: what they hold is numbered over all of them under the element above. A name with
    ``joiner`` stands for several levels. ``#text`` is the value of the element that holds it. An element's own triple has the value
    null if it is an object. Ordinals of containers are 0. At the paths in ``levels``, a text that holds a JSON object or
    list stands for what it holds; any other text remains one.
    """
    stack = [("", [], record, {})]
    while stack:
        path, ords, node, numbers = stack.pop()
        if isinstance(node, dict):
            later = []
            for name, value in node.items():
                if name == "#text":
                    continue
                steps = name.split(joiner) if joiner in name and not name.startswith("@") else [name]
                p = "/".join([path, *steps]) if path else "/".join(steps)
                items, todo = [], [value]
                while todo:
                    x = todo.pop()
                    if isinstance(x, str) and p in levels:
                        x = opened(x)
                    if isinstance(x, list):
                        todo.extend(reversed(x))
                    elif x is not None and x != {}:
                        items.append(x)
                own = steps[-1].endswith(container) and len(container) > 0
                for x in items:
                    if own:
                        later.append((p, [*ords, *[1] * (len(steps) - 1), 0], x, numbers))
                    else:
                        numbers[p] = numbers.get(p, 0) + 1
                        later.append((p, [*ords, *[1] * (len(steps) - 1), numbers[p]], x, {}))
            if path and not (ords and ords[-1] == 0):
                yield path, ords, scalar_text(node["#text"]) if "#text" in node and not isinstance(node["#text"], (dict, list)) else None
            # containers share their numbers, so they are walked here in order, not by the stack's reverse
            stack.extend(reversed(later))
        elif not isinstance(node, list):
            yield path, ords, scalar_text(node)


def triples(records: DataFrame, row_id: str, body: str, keep: list[str] | None = None, container: str = "Set", joiner: str = ":", root: str | None = None) -> DataFrame:
    """Rows ``(row_id, path, ords, seq, value)`` of every record that is valid JSON (see ``read_json`` and ``walk``).

    ``keep`` limits the paths; on the way to them, levels may be written as JSON text. ``root`` is a top-level name that
    records must have. Null, empty and unreadable bodies give nothing.
    """
    wanted = set(keep) if keep is not None else None
    above = frozenset("/".join(steps[:k]) for steps in (p.split("/") for p in keep or []) for k in range(1, len(steps)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, text in zip(batch["row_id"], batch["body"]):
                record = read_json(text)
                if isinstance(record, dict) and (root is None or root in record):
                    seq = 0
                    for path, ords, value in walk(record, container, joiner, above):
                        seq += 1
                        if wanted is None or path in wanted:
                            rows.append((i, path, ords, seq, value))
                if len(rows) >= 20_000:
                    yield pd.DataFrame(rows, columns=["row_id", "path", "ords", "seq", "value"])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["row_id", "path", "ords", "seq", "value"])

    source = records.select(F.col(row_id).cast("long").alias("row_id"), F.col(body).alias("body")).filter("row_id IS NOT NULL AND body IS NOT NULL AND body <> ''")
    return source.mapInPandas(run, TRIPLES)


@dataclass(frozen=True)
class Table:
    """A repeated ancestor: its path, the names of the numbers along it (by 0-based level), and its columns by relative path."""

    path: str
    numbers: dict[str, int]
    columns: dict[str, str] = field(default_factory=dict)

    def paths(self) -> list[str]:
        return [self.path, *(f"{self.path}/{p}" for p in self.columns.values() if p)]


def pivot(facts: DataFrame, table: Table) -> DataFrame:
    """One row for each element at the table's path, with its parents' numbers and its columns.

    A column is the first value that is not null at its relative path ('' is the element's own text), in the order of the
    record; null if there is none. Repeated records give each element once.
    """
    depth = table.path.count("/") + 1
    keys = {n: F.element_at("ords", level + 1).cast("long").alias(n) for n, level in table.numbers.items()}
    inside = facts.filter((F.col("path") == table.path) | F.col("path").isin(table.paths())).filter(F.size("ords") >= depth)
    first: list[Column] = [
        F.min(F.when((F.col("path") == (f"{table.path}/{p}" if p else table.path)) & F.col("value").isNotNull(), F.struct("seq", "value")))["value"].alias(c) for c, p in table.columns.items()
    ]
    there = F.max((F.col("path") == table.path).cast("int")).alias("_there")
    return inside.groupBy("row_id", *keys.values()).agg(there, *first).filter("_there = 1").drop("_there")


_LOG = "WITSMLComposite/wellSet/well/wellboreSet/wellbore/wellLogSet/wellLog"
WELLS = Table("WITSMLComposite/wellSet/well", {"well_no": 2}, {"uid": "@uid", "name": "name"})
WELLBORES = Table("WITSMLComposite/wellSet/well/wellboreSet/wellbore", {"well_no": 2, "wellbore_no": 4}, {"uid": "@uid", "name": "name"})
LOGS = Table(_LOG, {"well_no": 2, "wellbore_no": 4, "log_no": 6}, {"uid": "@uid", "creation_date": "creationDate", "software_version": "customData/SystemSettings/softwareVersion"})
CURVES = Table(f"{_LOG}/logCurveInfo", {"well_no": 2, "wellbore_no": 4, "log_no": 6, "curve_no": 7}, {"mnemonic": "mnemonic", "text": "", "uid": "@uid", "unit": "unit"})


def composite_tables(records: DataFrame, row_id: str, body: str) -> dict[str, DataFrame]:
    """Wells, wellbores, logs and curves of well-log composites, each keyed by the numbers of its parents."""
    spec = {"wells": WELLS, "wellbores": WELLBORES, "logs": LOGS, "curves": CURVES}
    facts = triples(records, row_id, body, [p for t in spec.values() for p in t.paths()], root="WITSMLComposite")
    return {name: pivot(facts, t) for name, t in spec.items()}


def curves_with_software(records: DataFrame, row_id: str, body: str) -> DataFrame:
    """Each curve with its mnemonic and its log's software version, '' where there is none."""
    log = Table(LOGS.path, LOGS.numbers, {"software_version": LOGS.columns["software_version"]})
    curve = Table(CURVES.path, CURVES.numbers, {"mnemonic": "mnemonic", "text": ""})
    facts = written(triples(records, row_id, body, log.paths() + curve.paths(), root="WITSMLComposite"), "triples")  # so that each body is parsed once
    curves, logs, key = pivot(facts, curve), pivot(facts, log), ["row_id", *LOGS.numbers]
    return curves.join(logs, key, "left").select(*key, "curve_no", F.coalesce("text", "mnemonic", F.lit("")).alias("mnemonic"), F.coalesce("software_version", F.lit("")).alias("software_version"))
