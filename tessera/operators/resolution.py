"""From parsed tables to a typed graph: name indexes, call resolution, inheritance, test links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import is_test_file
from tessera.operators.graphs import merged_edges, with_overwrites
from tessera.operators.lineage import checkpointed
from tessera.sources.python_code import Code

#: Steps up a chain of base classes that are followed.
MAX_BASES = 12


def _last(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*[F.col(o).desc() for o in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


class Names:
    """qualified name -> id (the last file wins), bare name -> id where unique, and each file's imports (the last binding wins)."""

    def __init__(self, code: Code):
        s = code.symbols
        self.qualified = _last(s.select("qualified_name", "id", "file_path", "byte_start"), ["qualified_name"], ["file_path", "byte_start"]).select(F.col("qualified_name").alias("q_name"), F.col("id").alias("q_id"))
        self.bare = s.groupBy(F.col("name").alias("b_name")).agg(F.count(F.lit(1)).alias("b_count"), F.min("id").alias("b_id"))
        self.imports = _last(code.imports.where("local is not null"), ["path", "local"], ["ord"]).select(F.col("path").alias("i_path"), F.col("local").alias("i_local"), F.col("target").alias("i_target"))
        stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.py$", "")
        self.stems = code.paths.select(stem.alias("stem")).distinct().withColumn("first_party", F.lit(True))


def resolve_names(rows: DataFrame, names: Names, name: str) -> DataFrame:
    """Adds target and reason of a bare name in ``file_path``: an import that names a symbol, else the unique bare name."""
    out = rows.join(names.imports, (F.col("file_path") == F.col("i_path")) & (F.col(name) == F.col("i_local")), "left")
    out = out.join(names.qualified, F.col("i_target") == F.col("q_name"), "left").join(names.bare, F.col(name) == F.col("b_name"), "left")
    target = F.coalesce("q_id", F.when(F.col("b_count") == 1, F.col("b_id")))
    reason = F.when(target.isNotNull(), None).when(F.col("b_count") > 1, "ambiguous").otherwise("external")
    return out.withColumns({"target": target, "reason": reason}).drop("i_path", "i_local", "i_target", "q_name", "q_id", "b_name", "b_count", "b_id")


def inherits(code: Code, names: Names) -> DataFrame:
    """(src, dst, ord) of base classes that resolve."""
    found = resolve_names(code.bases, names, "text")
    return found.where("target is not null").select(F.col("class_id").alias("src"), F.col("target").alias("dst"), "ord")


def base_chain(links: DataFrame) -> DataFrame:
    """(class_id, base_id, order): bases breadth-first, the class itself first; cycles end, since a base counts once."""
    one = links.select(F.col("src").alias("from_id"), F.col("dst").alias("to_id"), "ord")
    level = one.select(F.col("from_id").alias("class_id"), F.col("to_id").alias("base_id"), F.array(F.lit(1), F.col("ord")).alias("order"))
    seen = level
    for depth in range(2, MAX_BASES + 1):
        level = checkpointed(level.join(one, F.col("base_id") == F.col("from_id")).select("class_id", F.col("to_id").alias("base_id"), F.concat(F.array(F.lit(depth)), F.slice("order", 2, depth), F.array("ord")).alias("order")).join(seen.select("class_id", "base_id"), ["class_id", "base_id"], "left_anti"))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen.groupBy("class_id", "base_id").agg(F.min("order").alias("order"))


def resolve_calls(code: Code, names: Names, links: DataFrame) -> DataFrame:
    """caller, ord, raw, target, reason of every call."""
    calls = code.calls
    # self.x and cls.x: the enclosing class, else the first base that has the name.
    own = calls.where("shape = 'attribute' and base in ('self', 'cls')")
    classes = code.symbols.where("kind = 'class'").select(F.col("id").alias("c_id"), F.col("qualified_name").alias("c_name"))
    chain = classes.select(F.col("c_id").alias("class_id"), F.col("c_id").alias("base_id"), F.array(F.lit(0)).alias("order")).unionByName(base_chain(links))
    named = chain.join(classes, F.col("base_id") == F.col("c_id")).select("class_id", "order", "c_name")
    tried = own.join(named, F.col("parent_id") == F.col("class_id")).join(names.qualified, F.concat_ws(".", "c_name", "attr") == F.col("q_name"))
    found = tried.groupBy("caller", "ord").agg(F.min(F.struct("order", "q_id")).alias("f")).select(F.col("caller").alias("f_caller"), F.col("ord").alias("f_ord"), F.col("f.q_id").alias("target"))
    own = own.join(found, (F.col("caller") == F.col("f_caller")) & (F.col("ord") == F.col("f_ord")), "left").withColumn("reason", F.when(F.col("target").isNull(), "no_type_inference"))
    # base.x of an imported base: first-party modules go by bare name.
    other = calls.where("shape = 'attribute' and not coalesce(base in ('self', 'cls'), false)")
    other = other.join(names.imports, (F.col("file_path") == F.col("i_path")) & (F.col("base") == F.col("i_local")), "left").join(names.stems, F.col("i_target") == F.col("stem"), "left").join(names.bare, F.col("attr") == F.col("b_name"), "left")
    via = F.coalesce("first_party", F.lit(False))
    other = other.withColumn("target", F.when(via & (F.col("b_count") == 1), F.col("b_id")))
    other = other.withColumn("reason", F.when(F.col("target").isNotNull(), None).when(F.col("i_local").isNull(), "no_type_inference").when(via & (F.col("b_count") > 1), "ambiguous").otherwise("external"))
    plain = resolve_names(calls.where("shape = 'identifier'"), names, "attr")
    rest = calls.where("shape = 'other'").withColumns({"target": F.lit(None).cast("string"), "reason": F.lit("no_type_inference")})
    cols = ["caller", "file_path", "byte_start", "ord", "raw", "target", "reason"]
    return own.select(cols).unionByName(other.select(cols)).unionByName(plain.select(cols)).unionByName(rest.select(cols))


def code_graph(code: Code) -> tuple[DataFrame, DataFrame]:
    """(edges, unresolved). Inheritance comes first, then calls in source order; another type takes an edge over."""
    names = Names(code)
    links = checkpointed(inherits(code, names))
    calls = checkpointed(resolve_calls(code, names, links))
    # A position that grows with pass, path, place and order.
    steps = links.select("src", "dst", F.lit("INHERITS").alias("edge_type"), F.struct(F.lit(0).alias("p"), F.lit("").alias("f"), F.lit(0).alias("b"), "ord").alias("pos"))
    made = calls.where("target is not null").select(F.col("caller").alias("src"), F.col("target").alias("dst"), F.lit("CALLS").alias("edge_type"), F.struct(F.lit(1).alias("p"), F.col("file_path").alias("f"), F.col("byte_start").alias("b"), "ord").alias("pos"))
    unresolved = calls.where("target is null").select(F.col("caller").alias("from_symbol_id"), F.col("raw").alias("raw_expression"), "reason")
    return merged_edges(steps.unionByName(made)), unresolved


def link_tests(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(test_id, target_id, confidence): named after the target and calling it is confirmed, else naming_only or call_only."""
    s = symbols.select("id", "kind", "name", is_test_file(F.col("file_path")).alias("in_test"))
    bare = F.when((F.col("kind") == "class") & F.col("name").startswith("Test"), F.substring("name", 5, 1000)).when((F.col("kind") != "class") & F.col("name").startswith("test_"), F.substring("name", 6, 1000))
    tests = s.where("in_test").select(F.col("id").alias("test_id"), F.lower(bare).alias("wanted"))
    subjects = s.where("not in_test").select(F.col("id").alias("target_id"), F.lower("name").alias("wanted"))
    naming = tests.where("wanted <> ''").join(subjects, "wanted").select("test_id", "target_id", F.lit(True).alias("named"))
    calling = edges.where("edge_type = 'CALLS'").join(tests.select(F.col("test_id").alias("src")), "src", "left_semi").join(subjects.select(F.col("target_id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("test_id"), F.col("dst").alias("target_id"), F.lit(True).alias("called"))
    kind = F.when(F.col("named") & F.col("called"), "confirmed").when(F.col("called"), "call_only").otherwise("naming_only")
    return naming.distinct().join(calling, ["test_id", "target_id"], "full_outer").select("test_id", "target_id", kind.alias("confidence"))


def with_tests(edges: DataFrame, links: DataFrame) -> DataFrame:
    """TESTS edges take over edges between the same two symbols, at weight 1."""
    more = links.select(F.col("test_id").alias("src"), F.col("target_id").alias("dst"), F.lit("TESTS").alias("edge_type"), F.lit(1).cast("long").alias("weight"), "confidence")
    return with_overwrites(edges.withColumn("confidence", F.lit(None).cast("string")), more)
