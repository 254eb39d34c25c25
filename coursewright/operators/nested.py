"""Nested records as related flat tables, by Dewey labels.

Every node of a record gets the list of ordinals that leads to it (places in
arrays, and places among the sorted field names of objects, each from 1).  The
parent's label is the label without its last number, so parent-child links need
no join and no generated keys.  Nodes are grouped into tables by their schema
path (``$.slots[].parts[]``): the path without the places.

Documents are handled as VARIANT values inside the JVM; one pass of nested
generators makes all nodes, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursewright.session import cut


def parse_documents(df: DataFrame, id_col: str, body_col: str, order_col: str | None = None) -> DataFrame:
    """``root_id, doc``: one parsed document per id.

    Rows of one id are one record; the latest by ``order_col`` counts (ties: the
    greater body).  A body that is null or not valid JSON gives a null ``doc``; a
    null id is left out, since nothing could point to it.
    """
    latest = F.struct(F.col(order_col) if order_col else F.lit(0), F.col(body_col).alias("body"))
    one = df.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("root_id")).agg(F.max(latest).alias("m"))
    return one.select("root_id", F.try_parse_json("m.body").alias("doc"))


def wrap_column(df: DataFrame, id_col: str, nested_col: str, order_col: str | None = None) -> DataFrame:
    """``root_id, doc`` of a typed nested column; one record per id as in :func:`parse_documents`. A null value gives a null ``doc``."""
    rank = F.struct(F.col(order_col) if order_col else F.lit(0), F.coalesce(F.to_json(F.struct(F.col(nested_col).alias("x"))), F.lit("")))
    one = df.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("root_id")).agg(F.max_by(F.col(nested_col), rank).alias("m"))
    return one.select("root_id", F.when(F.col("m").isNotNull(), F.to_variant_object("m")).alias("doc"))


def _wanted_prefixes(paths: Iterable[str]) -> list[str]:
    """All schema paths that lead to one of ``paths``, themselves included."""
    out: set[str] = set()
    for p in paths:
        at = "$"
        out.add(at)
        for step in p[1:].replace("[]", "\0[]\0").split("\0"):
            for field in step.split(".") if step != "[]" else ["[]"]:
                if field:
                    at += field if field == "[]" else "." + field
                    out.add(at)
    return sorted(out)


def _grow(nodes: DataFrame, depth: int, as_arrays: list[str], within: list[str] | None) -> DataFrame:
    """``nodes`` with the children of those of ``depth`` ordinals."""
    loose = F.col("path").isin(as_arrays) if as_arrays else F.lit(False)
    text = F.expr("try_variant_get(value, '$', 'string')")
    value = F.when(loose & F.expr("schema_of_variant(value) = 'STRING'"), F.coalesce(F.try_parse_json(text), F.col("value"))).otherwise(F.col("value")) if as_arrays else F.col("value")
    step = nodes.withColumn("value", F.when(F.size("dewey") == depth, value).otherwise(F.col("value")))
    items = F.expr("try_variant_get(value, '$', 'array<variant>')")
    fields = F.expr("try_variant_get(value, '$', 'map<string,variant>')")
    open_here = (F.size("dewey") == depth) & F.col("value").isNotNull() & F.expr("not is_variant_null(value)")
    step = step.withColumn("items", F.when(open_here, items)).withColumn("fields", F.when(open_here & F.col("items").isNull(), fields))

    def child(place: Column, path: Column, v: Column) -> Column:
        return F.struct(F.concat("dewey", F.array(place.cast("int"))).alias("dewey"), path.alias("path"), v.alias("value"))

    none = F.expr("cast(array() as array<struct<dewey:array<int>,path:string,value:variant>>)")
    from_items = F.transform("items", lambda x, i: child(i + 1, F.concat(F.col("path"), F.lit("[]")), x))
    from_fields = F.transform(F.map_entries("fields"), lambda e, i: child(i + 1, F.concat(F.col("path"), F.lit("."), e["key"]), e["value"]))
    alone = F.array(child(F.lit(1), F.concat(F.col("path"), F.lit("[]")), F.col("value")))
    children = F.when(F.col("items").isNotNull(), from_items).when(F.col("fields").isNotNull() & loose, alone).when(F.col("fields").isNotNull(), from_fields).otherwise(none)
    if within is not None:
        children = F.filter(children, lambda c: c["path"].isin(within))
    me = F.array(F.struct("dewey", "path", "value"))
    return step.select("root_id", F.explode(F.concat(me, children)).alias("n")).select("root_id", "n.dewey", "n.path", "n.value")


def dewey_nodes(docs: DataFrame, levels: int | None = None, as_arrays: Iterable[str] = (), tables: Iterable[str] | None = None) -> DataFrame:
    """``root_id, dewey, path, value``: a row per node of ``docs`` (``root_id, doc``), the root (label ``[]``, path ``$``) included.

    ``as_arrays``: schema paths that should hold an array but don't always: text
    holding JSON is parsed, a lone object counts as an array of one.
    ``tables``: only the nodes on the way to these schema paths are made.
    ``levels``: how deep to go; what lies below stays whole in ``value``.  Without
    it the depth is found from the data, by growing until no container is left.
    Null array elements hold their place and are nodes with a null value.
    Records without a document give no nodes.
    """
    within = None if tables is None else _wanted_prefixes(tables)
    if levels is None and within is not None:
        levels = max(p.count("[]") + p.count(".") for p in within)
    nodes = docs.filter(F.col("doc").isNotNull()).select("root_id", F.expr("cast(array() as array<int>)").alias("dewey"), F.lit("$").alias("path"), F.col("doc").alias("value"))
    loose = list(as_arrays)
    if levels is not None:
        for depth in range(levels):
            nodes = _grow(nodes, depth, loose, within)
        return nodes
    depth = 0
    while True:
        for _ in range(4):
            nodes = _grow(nodes, depth, loose, within)
            depth += 1
        nodes = cut(nodes)
        open_ = F.expr("try_variant_get(value, '$', 'array<variant>') is not null or try_variant_get(value, '$', 'map<string,variant>') is not null")
        if nodes.filter((F.size("dewey") == depth) & open_).isEmpty():
            return nodes


def parent_label(dewey: Column | str = "dewey", up: int = 1) -> Column:
    """The label ``up`` levels above, by truncation; empty for the root's children."""
    d = F.col(dewey) if isinstance(dewey, str) else dewey
    return F.slice(d, 1, F.greatest(F.size(d) - up, F.lit(0)))


def label_text(dewey: Column | str = "dewey") -> Column:
    """A label as text, ``3.1.2``."""
    d = F.col(dewey) if isinstance(dewey, str) else dewey
    return F.array_join(d, ".")


def flat_table(nodes: DataFrame, path: str, fields: Mapping[str, str]) -> DataFrame:
    """The nodes of one schema path as a table.

    Columns: ``root_id``, ``dewey``, ``parent`` (the label of the nearest node above
    that is a row of some table: an array element or the root), ``position`` (its
    place in its array, 0 where it is no array element) and one column per entry
    of ``fields`` (field name to SQL type).  A field that is missing, null, or not
    castable is null.  Null elements are left out; elements that are no objects
    are rows whose fields are null.
    """
    rows = nodes.filter((F.col("path") == path) & F.expr("value is not null and not is_variant_null(value)"))
    in_array = path.endswith("[]")
    steps, at = 0, path
    while at != "$":
        at, steps = (at[:-2], steps + 1) if at.endswith("[]") else (at.rpartition(".")[0], steps + 1)
        if at.endswith("[]") or at == "$":
            break
    return rows.select(
        "root_id",
        "dewey",
        parent_label("dewey", steps).alias("parent"),
        (F.element_at("dewey", -1) if in_array else F.lit(0)).alias("position"),
        *(F.expr(f"try_variant_get(value, '$.{name}', '{kind}')").alias(name) for name, kind in fields.items()),
    )
