"""Static checks and mined conventions over the tables of a code base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import graphs, mining
from tessera.sources.python_code import Code

# Calls that block an event loop, and names of calls that query a database.
BLOCKING = ("time.sleep", "requests.get", "requests.post", "requests.put", "requests.delete", "requests.patch", "urllib.request.urlopen", "psycopg2.connect", "sqlite3.connect", "socket.socket")
QUERIES = ("query", "execute", "filter", "filter_by", "find", "select", "fetchone", "fetchall")
COMPLEX, DIVERSE = 5, 4
SEVERITIES = ("high", "warning", "info")


def _finding(rows: DataFrame, category: str, severity: str, message: Column) -> DataFrame:
    return rows.select(F.lit(category).alias("category"), F.col("id").alias("symbol_id"), "qualified_name", "file_path", message.alias("message"), F.lit(severity).alias("severity"))


def _routes(symbols: DataFrame) -> DataFrame:
    return symbols.where(tx.is_route(F.col("decorators")) & (F.col("kind") != "class"))


def missing_response_model(code: Code) -> DataFrame:
    bare = ~F.exists("decorators", lambda x: x.contains("response_model")) & ~F.col("signature").contains("->")
    return _finding(_routes(code.symbols).where(bare), "missing_response_model", "warning", F.lit("no response model and no return annotation"))


def untyped_params(code: Code) -> DataFrame:
    return _finding(_routes(code.symbols).where(F.size("untyped_params") > 0), "untyped_params", "warning", F.concat(F.lit("untyped: "), F.array_join("untyped_params", ", ")))


def blocking_calls(code: Code, unresolved: DataFrame) -> DataFrame:
    hits = unresolved.where(F.col("raw_expression").isin(*BLOCKING)).join(code.symbols.where("kind = 'async_function'"), F.col("from_symbol_id") == F.col("id"))
    return _finding(hits, "blocking_call_in_async", "high", F.concat(F.lit("blocking call of "), "raw_expression"))


def logic_in_handler(code: Code, edges: DataFrame) -> DataFrame:
    diverse = edges.where("edge_type = 'CALLS'").groupBy("src").agg(F.count(F.lit(1)).alias("targets")).where(F.col("targets") >= DIVERSE)
    hits = _routes(code.symbols).where(F.col("complexity") > COMPLEX).join(diverse, F.col("id") == F.col("src"))
    return _finding(hits, "business_logic_in_handler", "warning", F.concat(F.lit("complexity "), F.col("complexity").cast("string"), F.lit(", calls "), F.col("targets").cast("string")))


def queries_in_loops(code: Code) -> DataFrame:
    hits = code.symbols.where(F.arrays_overlap("loop_calls", F.array(*map(F.lit, QUERIES))))
    return _finding(hits, "n_plus_one", "warning", F.lit("a query inside a loop"))


def circular_dependencies(code: Code, edges: DataFrame) -> DataFrame:
    hits = code.symbols.join(graphs.cycle_members(edges), "id")
    return _finding(hits, "circular_dependency", "warning", F.concat(F.lit("on a cycle with "), "component"))


def god_objects(code: Code, scores: DataFrame) -> DataFrame:
    return _finding(code.symbols.join(graphs.hubs(scores), "id"), "god_object", "info", F.lit("central beyond the mean by a deviation"))


def error_handling(code: Code) -> DataFrame:
    return mining.majority(_handlers(code), pattern="except_pattern", pos="pos")


def _handlers(code: Code) -> DataFrame:
    return code.symbols.where("except_pattern is not null").select("id", "qualified_name", "file_path", "except_pattern", F.struct("file_path", "byte_start").alias("pos"))


def error_handling_violations(code: Code) -> DataFrame:
    top = F.broadcast(error_handling(code).select(F.col("pattern").alias("top")))
    return _handlers(code).join(top).where("except_pattern <> top")


def docstrings(code: Code) -> DataFrame:
    """One row: coverage_pct, documented, missing ids and the dominant style of public symbols."""
    style = tx.docstring_style(F.col("docstring"))
    public = code.symbols.where(~F.col("name").startswith("_")).withColumn("style", style).withColumn("documented", F.coalesce(F.col("docstring") != "", F.lit(False)))
    top = mining.majority(public.where("documented").withColumn("pos", F.struct("file_path", "byte_start")), pattern="style", pos="pos").select(F.col("pattern").alias("dominant_style"), F.col("n").alias("dominant_count"))
    stats = public.agg(F.coalesce(100 * F.count_if("documented") / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)).alias("coverage_pct"), F.count_if("documented").alias("documented"), F.sort_array(F.collect_list(F.when(~F.col("documented"), F.col("id")))).alias("missing"))
    out = stats.join(F.broadcast(top), F.lit(True), "left")  # both of one row
    return out.fillna({"dominant_style": "none", "dominant_count": 0})


def import_style(code: Code) -> DataFrame:
    """One row: relative, absolute, dominant (absolute on ties)."""
    counts = code.imports.agg(F.count_if(F.col("style") == "relative").alias("relative"), F.count_if(F.col("style") == "absolute").alias("absolute"))
    return counts.withColumn("dominant", F.when(F.col("relative") > F.col("absolute"), "relative").otherwise("absolute"))


def convention_breaks(code: Code) -> DataFrame:
    return _finding(error_handling_violations(code), "convention_violation", "info", F.concat(F.lit("handles errors as "), "except_pattern"))


def code_smells(code: Code, edges: DataFrame, unresolved: DataFrame, scores: DataFrame, category: str | None = None) -> DataFrame:
    every = [missing_response_model(code), untyped_params(code), blocking_calls(code, unresolved), logic_in_handler(code, edges), queries_in_loops(code), circular_dependencies(code, edges), god_objects(code, scores), convention_breaks(code)]
    out = every[0]
    for one in every[1:]:
        out = out.unionByName(one)
    return out if category is None else out.where(F.col("category") == category)


def worst_first(findings: DataFrame, limit: int = 30) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return graphs.capped(findings.withColumn("_rank", rank), F.col("_rank"), F.col("qualified_name"), F.col("category"), limit=limit).drop("_rank")


def dead_code(code: Code, edges: DataFrame) -> DataFrame:
    """Symbols that no edge enters; routes, test files and __init__ are never dead."""
    live = tx.is_route(F.col("decorators")) | tx.is_test_file(F.col("file_path")) | (F.col("name") == "__init__")
    return code.symbols.where(~live).join(edges.select(F.col("dst").alias("id")), "id", "left_anti").select("id", "qualified_name", "file_path")


def settings_fields(code: Code, suffix: str = "Settings") -> DataFrame:
    """(env_name) of the annotated fields of settings classes."""
    return code.class_fields.where(F.element_at(F.split("qualified_name", r"\."), -1).endswith(suffix)).select(F.upper("name").alias("env_name")).distinct()


def config_drift(code: Code, env_text: DataFrame) -> DataFrame:
    """(env_name, kind): settings without a variable and variables without a setting. env_text: one row (text)."""
    named = env_text.select(F.explode(tx.env_names(F.col("text"))).alias("env_name")).distinct()
    return mining.drift(settings_fields(code), named, "env_name", "missing_in_env", "unknown_in_settings")


def migration_drift(code: Code, migrations: DataFrame) -> DataFrame:
    """(qualified_name, name): fields of mapped models that no migration (text) mentions; columns count for every table."""
    models = code.symbols.where("has_tablename").select(F.col("id").alias("symbol_id"))
    migrated = migrations.select(F.explode(tx.migrated_columns(F.col("text"))).alias("name")).distinct()
    return code.class_fields.join(models, "symbol_id", "left_semi").join(migrated, "name", "left_anti").select("qualified_name", "name")


def route_contracts(code: Code) -> DataFrame:
    """qualified_name, method, response_model, status_code, required (fields of the response model without default)."""
    d = F.col("decorators")
    routes = _routes(code.symbols).select("qualified_name", "file_path", tx.route_method(d).alias("method"), tx.response_model(d, F.col("signature")).alias("response_model"), tx.route_status(d).alias("status_code"))
    classes = code.symbols.where("kind = 'class'").groupBy(F.col("name").alias("response_model")).agg(F.max(F.struct("file_path", "byte_start", "id"))["id"].alias("symbol_id"))
    required = code.class_fields.where("not has_default").groupBy("symbol_id").agg(F.collect_set("name").alias("required"))
    return routes.join(classes, "response_model", "left").join(required, "symbol_id", "left").select("qualified_name", "file_path", "method", "response_model", "status_code", F.coalesce("required", F.array().cast("array<string>")).alias("required"))
