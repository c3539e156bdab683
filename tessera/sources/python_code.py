"""Symbols and edges of Python source files, by the standard library's parser in a distributed scan.

A file becomes rows of one frame: record 'symbol' (id, kind, qualified_name, short_name, line, end_line), 'candidate' (an edge from the innermost enclosing
callable to a name, to be resolved) or 'error'. Resolution is a join afterwards.
"""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EXCLUDED = ("node_modules", "__pycache__", "dist", "build", "target", "vendor", "venv")
ROW = "record string, repo string, file string, id string, kind string, qualified_name string, short_name string, line long, end_line long, src_id string, parent_id string"
BUILTIN_CALLS = frozenset(dir(__builtins__) if not isinstance(__builtins__, dict) else __builtins__)


def symbol_id(language: str, repo: str, qualified_name: str, sha: str | None = None) -> str:
    text = "|".join([language, repo, qualified_name] + ([sha] if sha else []))
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """file (relative), content of the Python files below root, without hidden and generated directories."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.py").load(root)
    name = F.regexp_replace("path", "^[a-z]+:/+", "/")
    tail = F.expr(f"ltrim('/', replace(regexp_replace(path, '^[a-z]+:/+', '/'), '{root.rstrip('/')}', ''))")
    hidden = "(^|/)(\\.[^/]+|" + "|".join(EXCLUDED) + ")/"
    return raw.select(name.alias("path"), tail.alias("file"), F.decode("content", "UTF-8").alias("content")).where(~F.col("file").rlike(hidden))


def _rows(repo: str, file: str, source: str) -> list[tuple]:
    top = symbol_id("python", repo, file)
    out = [("symbol", repo, file, top, "file", file, file.rsplit("/", 1)[-1], 1, source.count("\n") + 1, None, None)]
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError) as e:
        return [*out, ("error", repo, file, None, type(e).__name__, None, None, getattr(e, "lineno", None), None, None, None)]

    def candidate(kind: str, node: ast.AST, name: str | None, src: str | None) -> None:
        if name and src:
            out.append(("candidate", repo, file, None, kind, None, name, node.lineno, None, src, None))

    def name_of(e: ast.AST | None) -> str | None:
        return e.id if isinstance(e, ast.Name) else e.attr if isinstance(e, ast.Attribute) else name_of(e.func) if isinstance(e, ast.Call) else name_of(e.value) if isinstance(e, ast.Subscript) else None

    def visit(node: ast.AST, scope: str, owner: str, in_class: bool, callable_id: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                is_class = isinstance(child, ast.ClassDef)
                qualified = f"{scope}::{child.name}"
                own = symbol_id("python", repo, qualified)
                out.append(("symbol", repo, file, own, "class" if is_class else "method" if in_class else "function", qualified, child.name, child.lineno, child.end_lineno, None, owner))
                for deco in child.decorator_list:
                    candidate("ANNOTATES", child, name_of(deco), own)
                if is_class:
                    for base in child.bases:
                        candidate("EXTENDS", child, name_of(base), own)
                else:
                    candidate("RETURNS_TYPE", child, name_of(child.returns), own)
                visit(child, qualified, own, is_class, callable_id if is_class else own)
                continue
            if in_class and isinstance(child, ast.AnnAssign | ast.Assign):
                for target in [child.target] if isinstance(child, ast.AnnAssign) else child.targets:
                    if isinstance(target, ast.Name):
                        qualified = f"{scope}::{target.id}"
                        own = symbol_id("python", repo, qualified)
                        out.append(("symbol", repo, file, own, "field", qualified, target.id, child.lineno, child.end_lineno, None, owner))
                        if isinstance(child, ast.AnnAssign):
                            candidate("TYPE_OF", child, name_of(child.annotation), own)
            if isinstance(child, ast.Call):
                name = name_of(child.func)
                if name and name not in BUILTIN_CALLS:
                    candidate("CONSTRUCTS" if name[:1].isupper() else "CALLS", child, name, callable_id)
            elif isinstance(child, ast.Raise):
                candidate("RAISES", child, name_of(child.exc), callable_id)
            elif isinstance(child, ast.Attribute):
                written = isinstance(child.ctx, ast.Store | ast.Del)
                candidate("WRITES_FIELD" if written else "READS_FIELD", child, child.attr, callable_id)
            visit(child, scope, owner, False, callable_id)

    visit(tree, file, top, False, None)
    return out


def extract(files: DataFrame, repo: str) -> DataFrame:
    """files: (file, content). Rows of ROW; a file that doesn't parse gives its file symbol and an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in ROW.split(", ")]
        for pdf in batches:
            rows = [r for f, s in zip(pdf["file"], pdf["content"], strict=True) for r in _rows(repo, f, s or "")]
            yield pd.DataFrame(rows, columns=columns)

    return files.select("file", "content").mapInPandas(run, ROW)


#: For each kind of edge the kinds of symbols that a name may stand for, the likelier first.
TARGETS = {"CALLS": ("function", "method"), "CONSTRUCTS": ("class",), "EXTENDS": ("class",), "ANNOTATES": ("function", "class"), "RETURNS_TYPE": ("class",), "TYPE_OF": ("class",), "RAISES": ("class",), "READS_FIELD": ("field",), "WRITES_FIELD": ("field",)}


def symbols(extracted: DataFrame) -> DataFrame:
    return extracted.where("record = 'symbol'").select("id", "kind", F.lit("python").alias("language"), "repo", "qualified_name", "short_name", "file", "line", "end_line").dropDuplicates(["id"])


def resolve_edges(extracted: DataFrame) -> DataFrame:
    """src_id, dst_id, kind: CONTAINS, and each candidate joined to the symbols of its repo with that short name; the likelier kind first,
    then the same file, then the smaller qualified name. No self-edges, each (src, dst, kind) once; names that nothing bears are left out."""
    known = extracted.where("record = 'symbol'")
    contains = known.where("parent_id is not null").select(F.col("parent_id").alias("src_id"), F.col("id").alias("dst_id"), F.lit("CONTAINS").alias("kind"))
    spark = extracted.sparkSession
    wants = spark.createDataFrame([(e, k, i) for e, ks in TARGETS.items() for i, k in enumerate(ks)], "edge string, target_kind string, place int")
    cand = extracted.where("record = 'candidate'").select(F.col("kind").alias("edge"), "repo", F.col("file").alias("from_file"), "short_name", "src_id").distinct()
    met = cand.join(F.broadcast(wants), "edge").join(known.select("repo", "short_name", F.col("kind").alias("target_kind"), "id", "file", "qualified_name"), ["repo", "short_name", "target_kind"])
    order = Window.partitionBy("edge", "src_id", "short_name", "from_file").orderBy("place", F.col("file") != F.col("from_file"), "qualified_name")
    best = met.withColumn("rn", F.row_number().over(order)).where((F.col("rn") == 1) & (F.col("id") != F.col("src_id")))
    return contains.unionByName(best.select("src_id", F.col("id").alias("dst_id"), F.col("edge").alias("kind"))).distinct()


def enclosing(occurrences: DataFrame, definitions: DataFrame) -> DataFrame:
    """occurrences: (file, occ, line); definitions: (file, id, line, end_line). file, occ, id: the innermost definition around each line,
    else the last that starts at or before it."""
    d = definitions.select("file", "id", F.col("line").alias("start"), "end_line")
    met = occurrences.join(d, "file").where(F.col("start") <= F.col("line"))
    inside = F.col("line") <= F.col("end_line")
    key = F.struct(F.when(inside, 0).otherwise(1), F.when(inside, F.col("end_line") - F.col("start")).otherwise(-F.col("start")), "id")
    return met.groupBy("file", "occ").agg(F.min_by("id", key).alias("id"))
