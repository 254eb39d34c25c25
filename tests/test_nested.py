import json
import random

from pyspark.sql import functions as F

from coursewright.operators import nested
from tests.conftest import rows

BODY = {"slots": [{"parts": [{"label": "a", "parts": [{"label": "i"}, {"label": None}]}, None, "loose", {"text": "x"}]}, {"parts": {"label": "only"}}, {"parts": '[{"label": "text"}]'}, {"parts": None}, {"parts": "no json"}, 7, None]}
LOOSE = ("$.slots", "$.slots[].parts", "$.slots[].parts[].parts")


def docs(spark, *bodies):
    return nested.parse_documents(spark.createDataFrame([(i, b, 0) for i, b in bodies], "id string, body string, at int"), "id", "body", "at")


def parts(nodes):
    t = nested.flat_table(nodes, "$.slots[].parts[]", {"label": "string"})
    return rows(t.select("root_id", nested.label_text("parent"), nested.label_text(), "position", "label"))


def test_parts_of_every_shape(spark):
    nodes = nested.dewey_nodes(docs(spark, ("p", json.dumps(BODY))), as_arrays=LOOSE, tables=["$.slots[].parts[].parts[]"])
    assert parts(nodes) == [("p", "1.1", "1.1.1.1", 1, "a"), ("p", "1.1", "1.1.1.3", 3, None), ("p", "1.1", "1.1.1.4", 4, None), ("p", "1.2", "1.2.1.1", 1, "only"), ("p", "1.3", "1.3.1.1", 1, "text")]
    sub = nested.flat_table(nodes, "$.slots[].parts[].parts[]", {"label": "string"})
    assert rows(sub.select(nested.label_text("parent"), "position", "label")) == [("1.1.1.1", 1, "i"), ("1.1.1.1", 2, None)]


def test_bad_null_and_repeated_documents(spark):
    good = json.dumps({"slots": []})
    d = nested.parse_documents(spark.createDataFrame([("a", "{bad", 1), ("b", None, 1), ("c", good, 1), ("c", "{", 0), (None, good, 1), ("d", "", 1)], "id string, body string, at int"), "id", "body", "at")
    assert rows(d.select("root_id", F.col("doc").isNotNull())) == [("a", False), ("b", False), ("c", True), ("d", False)]
    assert parts(nested.dewey_nodes(d, as_arrays=LOOSE, tables=["$.slots[].parts[]"])) == []


def walk(v, label, path, out):
    out.append((tuple(label), path))
    if isinstance(v, list):
        for i, x in enumerate(v):
            walk(x, [*label, i + 1], path + "[]", out)
    elif isinstance(v, dict):
        for i, k in enumerate(sorted(v)):
            walk(v[k], [*label, i + 1], f"{path}.{k}", out)


def test_nodes_of_random_documents_of_any_depth(spark):
    rng = random.Random(4)

    def make(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.3:
            return rng.choice([1, "s", None, True, [], {}])
        return [make(depth - 1) for _ in range(rng.randint(0, 3))] if kind < 0.6 else {k: make(depth - 1) for k in rng.sample("abcd", rng.randint(1, 3))}

    made = {str(i): [make(7)] for i in range(12)}
    want = []
    for k, v in made.items():
        out = []
        walk(v, [], "$", out)
        want += [(k, list(a), b) for a, b in out]
    nodes = nested.dewey_nodes(docs(spark, *[(k, json.dumps(v)) for k, v in made.items()]))
    assert rows(nodes, "root_id", "dewey", "path") == sorted(want, key=repr)
    up = nodes.filter(F.size("dewey") > 0).select("root_id", nested.parent_label().alias("dewey"))
    assert up.join(nodes.select("root_id", "dewey"), ["root_id", "dewey"], "left_anti").count() == 0


def test_typed_column_keeps_places_of_null_elements(spark):
    df = spark.createDataFrame([("c", [None, ("x",), (None,)], 0), ("d", None, 0), ("e", [], 0)], "k string, v array<struct<id:string>>, at int")
    t = nested.flat_table(nested.dewey_nodes(nested.wrap_column(df, "k", "v", "at"), tables=["$[]"]), "$[]", {"id": "string"})
    assert rows(t, "root_id", "position", "id") == [("c", 2, "x"), ("c", 3, None)]
