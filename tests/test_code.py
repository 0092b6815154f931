"""The source front-end on small trees of its own."""

import pytest
from pyspark.sql import functions as F

from tessera import api
from tessera.operators import checks
from tessera.sources import python_code

FILES = {
    "app/base.py": '''
class Shape:
    """A shape."""

    def area(self):
        return self.scale() * 2

    def scale(self):
        return 1
''',
    "app/tools.py": '''
import time


def double(x):
    """Doubles.

    Args:
        x: what to double
    """
    return x * 2


async def pause():
    time.sleep(1)


def outer():
    def inner():
        return double(1)
    return inner()
''',
    "app/square.py": '''
from app.base import Shape
from app import tools


class Square(Shape):
    side: int
    name: str = "sq"

    def area(self):
        return tools.double(self.side) + self.scale()

    if True:
        def odd(self):
            pass


@router.get("/squares", response_model=Square, status_code=201)
def squares(q, limit: int = 3, body: dict = None):
    for x in q:
        db.execute(x)
    try:
        return double(q)
    except ValueError:
        log.warning("no")
''',
    "tests/test_tools.py": '''
from app.tools import double


def test_double():
    assert double(1) == 2
''',
    "app/broken.py": "def (:\n",
}


@pytest.fixture(scope="module")
def index(spark):
    files = spark.createDataFrame([(p, t.encode()) for p, t in FILES.items()], "path string, content binary")
    return api.build(spark, files)


def names(df, col="qualified_name"):
    return sorted(r[col] for r in df.collect())


def test_symbols(index):
    rows = {r.qualified_name: r for r in index.code.symbols.collect()}
    assert rows["Shape.area"].kind == "method" and rows["pause"].kind == "async_function"
    assert "inner" not in rows and rows["odd"].kind == "function" and rows["odd"].parent_id is None
    assert rows["Shape"].docstring == "A shape." and rows["Shape.area"].docstring is None
    assert rows["Shape.area"].parent_id == rows["Shape"].id
    assert rows["squares"].decorators == ['router.get("/squares", response_model=Square, status_code=201)']
    assert rows["squares"].signature == "def squares(q, limit: int = 3, body: dict = None)"
    src = FILES["app/square.py"].encode()
    assert src[rows["squares"].byte_start : rows["squares"].byte_end].startswith(b"@router.get")
    assert rows["squares"].untyped_params == ["q", "body"] and rows["squares"].except_pattern == "except ValueError: log.warning"
    assert rows["squares"].id == python_code.symbol_id("app/square.py", "squares", "function")


def test_parse_errors(index):
    assert [r.path for r in index.code.parse_errors.collect()] == ["app/broken.py"]


def test_edges(index):
    s = index.code.symbols
    a, b = s.select(F.col("id").alias("src"), F.col("qualified_name").alias("a")), s.select(F.col("id").alias("dst"), F.col("qualified_name").alias("b"))
    got = {(r.a, r.b, r.edge_type) for r in index.edges.join(a, "src").join(b, "dst").collect()}
    assert ("Square", "Shape", "INHERITS") in got
    assert ("Square.area", "Shape.scale", "CALLS") in got and ("Square.area", "double", "CALLS") in got
    assert ("Shape.area", "Shape.scale", "CALLS") in got and ("squares", "double", "CALLS") in got
    assert ("test_double", "double", "TESTS") in got and ("test_double", "double", "CALLS") not in got
    reasons = {(r.raw_expression, r.reason) for r in index.unresolved.collect()}
    assert ("time.sleep", "external") in reasons and ("db.execute", "no_type_inference") in reasons


def test_checks(index):
    found = {(r.category, r.qualified_name) for r in checks.code_smells(index.code, index.edges, index.unresolved, index.scores).collect()}
    assert ("blocking_call_in_async", "pause") in found and ("n_plus_one", "squares") in found and ("untyped_params", "squares") in found
    assert not any(c == "missing_response_model" for c, _ in found)
    dead = names(index.dead_code())
    assert "double" not in dead and "outer" in dead and "squares" not in dead
    contract = checks.route_contracts(index.code).collect()[0]
    assert (contract.method, contract.response_model, contract.status_code, contract.required) == ("get", "Square", 201, ["side"])
    assert checks.import_style(index.code).first().dominant == "absolute"
    assert checks.docstrings(index.code).first().dominant_style in ("google", "plain")


def test_search_and_graph(index, spark):
    top = index.search("double x", top_k=3).collect()
    assert top[0].qualified_name in ("double", "test_double") and [r.pick for r in top] == [1, 2, 3]
    target = next(r.id for r in index.code.symbols.where("qualified_name = 'double'").collect())
    row = index.impact(target).first()
    assert row.direct == 3 and row.transitive == 0
    assert index.clusters.where("level = 'fine'").count() == index.code.symbols.count()
    assert index.list_symbols("app/*", ["class"]).count() == 2
    assert index.status().first().symbols == index.code.symbols.count()


def test_drift(index, spark):
    env = spark.createDataFrame([("# x\nA=1\nB = 2\n\nnope",)], "text string")
    assert {(r.env_name, r.kind) for r in checks.config_drift(index.code, env).collect()} == {("A", "unknown_in_settings"), ("B", "unknown_in_settings")}


def test_served_source(index, spark):
    from tessera.operators.governor import Session

    files = spark.createDataFrame([(p, t.encode()) for p, t in FILES.items()], "path string, content binary")
    ids = {r.qualified_name: r.id for r in index.code.symbols.collect()}
    s = Session()
    first, second = index.source(ids["Shape.area"], files, s), index.source(ids["Shape.scale"], files, s)
    assert first["source"].startswith("class Shape") and second["source"].startswith("def scale") and s.used > 0
    assert index.source(ids["double"], files, Session(1))["denied"]
    with pytest.raises(KeyError):
        index.source("nope", files, s)


def test_reports(index, spark):
    text, digest = index.context_document()
    assert "absolute imports" in text and index.context_document(digest) == (None, digest)
    assert {r.id for r in index.debug_seeds("fix the bug in Square.area").collect()} and index.debug_seeds("hello").count() == 0
    nodes, edges = index.graph_export()
    assert nodes.count() == index.code.symbols.count() and "smells" in index.report().columns
    assert [r.file_path for r in index.by_file(index.list_symbols()).collect()] == sorted(p for p in FILES if "broken" not in p)
