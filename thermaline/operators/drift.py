"""Schemas that drift between files: one consistent table, and a log of the changes.

Headers are flattened in parallel into (file, field, type, value). The schemas of a stream's files are folded into its union
schema: the fold keeps of each field the join of its types in a lattice (null < boolean < number < string < array) and
where it comes first and last, and is a partial aggregate, so it may be taken in any order and over any number of
files. The log reads the ordered differences from it: a field is added where the fold of the files up to one has it
first, removed where the fold of the files from one on lacks it first. Changes of type come from neighbouring values of a
field, which are found slice by slice so that a long stream is no hot task. Files are cast to the union schema.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thermaline.operators.nested import read_json
from thermaline.operators.ordered import with_neighbour

FIELDS = "stream long, seq long, field string, type string, value string"


def json_type(value) -> str:
    return {bool: "boolean", int: "number", float: "number", str: "string", list: "array", dict: "object"}.get(type(value), "null")


def canonical(value) -> str:
    """Equal for equal values: numbers by size, not by their way of writing."""
    if isinstance(value, float) and abs(value) < 1e15 and value == int(value):
        value = int(value)
    return json.dumps(value, sort_keys=True, ensure_ascii=False)


def flatten(header: dict, joiner: str = ":") -> dict[str, object]:
    """Fields by their full path joined by colons, in order; a name that is already joined means the same path."""
    out, stack = {}, [("", header)]
    while stack:
        path, node = stack.pop()
        if isinstance(node, dict):
            stack.extend((f"{path}{joiner}{k}" if path else k, v) for k, v in reversed(node.items()))
        elif path:
            out[path] = node
    return out


def header_fields(files: DataFrame, stream: str, seq: str, header: str) -> DataFrame:
    """Rows ``(stream, seq, field, type, value)``; a file without fields gives one with a null field.

    Unreadable, null and non-object headers, and files without stream or number, are no files. A file that was delivered
    more than once is read once (by the caller's grouping: equal rows have equal facts).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for s, q, text in zip(b["stream"], b["seq"], b["header"]):
                record = read_json(text)
                if isinstance(record, dict):
                    rows.append((s, q, None, None, None))
                    rows.extend((s, q, k, json_type(v), canonical(v)) for k, v in flatten(record).items())
            yield pd.DataFrame(rows, columns=["stream", "seq", "field", "type", "value"])

    source = files.select(F.col(stream).cast("long").alias("stream"), F.col(seq).cast("long").alias("seq"), F.col(header).alias("header")).filter("stream IS NOT NULL AND seq IS NOT NULL AND header IS NOT NULL")
    return source.mapInPandas(run, FIELDS)


LATTICE = ("null", "boolean", "number", "string", "array")


def promoted(type_: Column) -> Column:
    """Join of a column of types in the lattice, as an aggregate: the highest of them. Types outside it count as strings."""
    place = F.array_position(F.array(*[F.lit(t) for t in LATTICE]), type_)
    return F.element_at(F.array(*[F.lit(t) for t in LATTICE]), F.max(F.when(place > 0, place).otherwise(LATTICE.index("string") + 1)).cast("int"))


def fold(facts: DataFrame) -> DataFrame:
    """``(stream, field, kind, first, last)``: the union schema of each stream; ``first`` and ``last`` have ``seq, type, value``."""
    at = F.struct("seq", "type", "value")
    return facts.filter("field IS NOT NULL").groupBy("stream", "field").agg(promoted(F.col("type")).alias("kind"), F.min(at).alias("first"), F.max(at).alias("last"))


def drift_log(facts: DataFrame, width: int = 4096) -> DataFrame:
    """Rows ``(stream, seq, kind, old_name, new_name)`` of every change of a field between the files of a stream.

    ``added``: the first file with the field, unless it is the stream's first. ``removed``: the first file after the last one with
    the field. ``renamed`` instead of both, if in one file a field stops and another starts with the same value of the
    same type (matched in the order of their names if several agree; null is no value). ``type``: a value that is not
    null and of another type than the field's previous such value.
    """
    spans = fold(facts)
    files = facts.select("stream", "seq").distinct()
    following = with_neighbour(files, ["stream"], "seq", ["seq"], width, ahead=True, suffix="_next")
    starts = files.groupBy(F.col("stream").alias("_st")).agg(F.min("seq").alias("_first"))

    gone = spans.join(following.select(F.col("stream").alias("_sf"), F.col("seq").alias("_q"), "seq_next"), (F.col("stream") == F.col("_sf")) & (F.col("last.seq") == F.col("_q")))
    gone = gone.filter("seq_next IS NOT NULL").select("stream", F.col("seq_next").alias("seq"), F.col("field").alias("old_name"), F.lit("").alias("new_name"), F.col("last.type").alias("type"), F.col("last.value").alias("value"), F.lit("removed").alias("kind"))
    new = spans.join(starts, F.col("stream") == F.col("_st")).filter("first.seq > _first")
    new = new.select("stream", F.col("first.seq").alias("seq"), F.lit("").alias("old_name"), F.col("field").alias("new_name"), F.col("first.type").alias("type"), F.col("first.value").alias("value"), F.lit("added").alias("kind"))

    # the k-th field that stops and the k-th that starts with one value in one file are one field
    w = Window.partitionBy("stream", "seq", "type", "value", "kind").orderBy("old_name", "new_name")
    ends = gone.unionByName(new).withColumn("_k", F.when(F.col("type") != "null", F.row_number().over(w)))
    ends = ends.withColumn("_alone", F.when(F.col("_k").isNull(), F.concat_ws("\0", "old_name", "new_name")))
    both = ends.groupBy("stream", "seq", "type", "value", "_k", "_alone").agg(F.max("old_name").alias("old_name"), F.max("new_name").alias("new_name"))
    moved = both.select("stream", "seq", F.when(F.col("new_name") == "", "removed").when(F.col("old_name") == "", "added").otherwise("renamed").alias("kind"), "old_name", "new_name")

    values = facts.filter("field IS NOT NULL AND type <> 'null'").groupBy("stream", "field", "seq").agg(F.min("type").alias("type"))
    turned = with_neighbour(values, ["stream", "field"], "seq", ["type"], width).filter("type <> type_prev")
    return moved.unionByName(turned.select("stream", "seq", F.lit("type").alias("kind"), F.col("field").alias("old_name"), F.col("field").alias("new_name")))


def cast_value(kind: Column) -> Column:
    """JSON of a row's ``type, value`` cast to a type that is above it in the lattice: true becomes 1 as a number, numbers and
    booleans their JSON text as a string, and anything a list of one as an array. Null stays null."""
    number = F.when(F.col("type") == "boolean", F.when(F.col("value") == "true", "1").otherwise("0")).otherwise(F.col("value"))
    text = F.when(F.col("type").isin("boolean", "number"), F.concat(F.lit('"'), F.col("value"), F.lit('"'))).otherwise(F.col("value"))
    as_kind = F.when(kind == "number", number).when(kind == "string", text).when((kind == "array") & (F.col("type") != "array"), F.concat(F.lit("["), F.col("value"), F.lit("]"))).otherwise(F.col("value"))
    return F.when(F.col("type") == "null", F.lit(None).cast("string")).otherwise(as_kind)


def union_table(facts: DataFrame) -> DataFrame:
    """``(stream, seq, fields)``: one row for each file, with every field that any file of its stream has.

    ``fields`` maps their names, in order, to JSON of the union schema's type (see ``cast_value``), null where the file lacks the field
    or has a null. A file without fields has nulls only; a file read several times counts once, with the smaller of
    values that differ.
    """
    schema = fold(facts).select("stream", "field", "kind")
    files = facts.select("stream", "seq").distinct()
    given = facts.filter("field IS NOT NULL").groupBy("stream", "seq", "field").agg(F.min(F.struct("type", "value")).alias("_f")).select("stream", "seq", "field", "_f.*")
    rows = files.join(schema, "stream", "left").join(given, ["stream", "seq", "field"], "left")
    entry = F.when(F.col("field").isNotNull(), F.struct("field", cast_value(F.col("kind")).alias("value")))
    return rows.groupBy("stream", "seq").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("fields"))  # as long as the stream's schema


def typed_columns(table: DataFrame, fields: dict[str, str]) -> DataFrame:
    """``(stream, seq, <column>...)``: fields of the union table as columns of Spark's types, from ``{field: type}``; null where missing."""
    cols = [F.from_json(F.concat(F.lit('{"v":'), F.get(F.array(F.col("fields")[name]), F.lit(0)), F.lit("}")), f"v {t}")["v"].alias(name) for name, t in fields.items()]
    return table.select("stream", "seq", *cols)
