"""Import graph: edges, fan-out, cycles, layers, god modules, mud."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.paths import base_name, layer_rank, slashes, stem

# fixed values: thresholds
TIGHT_COUPLING = 10
MUD_FAN_OUT, MUD_FILES, MUD_LAYERED = 7.0, 5, 0.2
GOD_SCORE = 72
#: Edges of one repository that a task may gather.
MAX_EDGES = 5_000_000
ENTRY_POINTS = ["main.py", "core.py", "__init__.py"]


def import_edges(modules: DataFrame, imports: DataFrame) -> DataFrame:
    """(repo_id, src, dst): imports(repo_id, file_path, module) resolved by file stem; the last file of a stem wins.

    modules(repo_id, file_path, ordinal).
    """
    by_stem = modules.withColumn("stem", stem(F.col("file_path"))).groupBy("repo_id", "stem").agg(F.max_by("file_path", "ordinal").alias("dst"))
    # a stem names one file, so imports are made distinct once, after the join, with the map-side combine
    wanted = imports.select("repo_id", F.col("file_path").alias("src"), F.col("module").alias("stem"))
    return wanted.join(by_stem, ["repo_id", "stem"]).filter("src <> dst").select("repo_id", "src", "dst").distinct()


def fan_out(edges: DataFrame, least: int = TIGHT_COUPLING) -> DataFrame:
    """Files with `least` edges or more; edges are distinct."""
    return edges.groupBy("repo_id", "src").agg(F.count("*").alias("fan_out")).filter(F.col("fan_out") >= least)


def layer_violations(edges: DataFrame) -> DataFrame:
    """Edges whose target's keyword rank exceeds the source's by more than one."""
    ranked = edges.withColumn("src_rank", layer_rank(F.col("src"))).withColumn("dst_rank", layer_rank(F.col("dst")))
    return ranked.filter("dst_rank > src_rank + 1")


def god_score(lines: Column, fan: Column, imports: Column, classes: Column, functions: Column, mean_imports: Column) -> Column:
    """Composite 0..100 of size, fan-out, imports, public names and responsibilities."""

    def part(value: Column, full: Column | int, points: int) -> Column:
        return F.least(value.cast("double") / full, F.lit(1.0)) * points

    duties = classes + F.greatest(F.floor(imports / 8), F.lit(1))
    return part(F.greatest(lines, F.lit(1)), 2000, 22) + part(fan, 18, 18) + part(imports, F.greatest(mean_imports * 2.5, F.lit(1.0)), 18) + part(functions + classes, 45, 22) + part(duties, 12, 20)


def is_entry_point(path: Column, lines: Column, functions: Column) -> Column:
    base, shallow = F.lower(base_name(path)), F.size(F.split(slashes(path), "/")) <= 4
    return base.isin(ENTRY_POINTS) & shallow & (((lines >= 400) & (functions >= 15)) | ((base == "core.py") & (lines >= 250) & (functions >= 8)))


def mud(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per repository: files, mean fan-out, share of layered files, and whether it is a ball of mud."""
    degree = edges.groupBy("repo_id").agg(F.count("*").alias("edges"))
    files = modules.groupBy("repo_id").agg(F.count("*").alias("files"), F.count(layer_rank(F.col("file_path"))).alias("layered"))
    out = files.join(degree, "repo_id", "left").withColumn("mean_fan_out", F.coalesce("edges", F.lit(0)) / F.col("files")).withColumn("layered_share", F.col("layered") / F.col("files"))
    return out.withColumn("is_mud", (F.col("files") >= MUD_FILES) & (F.col("mean_fan_out") >= MUD_FAN_OUT) & (F.col("layered_share") < MUD_LAYERED)).select("repo_id", "files", "mean_fan_out", "layered_share", "is_mud")


def strong_components(nodes: dict[str, list[str]]) -> list[list[str]]:
    """Strongly connected components of two nodes or more, members sorted; iterative."""
    order: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    inside: set[str] = set()
    found = []
    for root in sorted(nodes):
        if root in order:
            continue
        work = [(root, iter(sorted(nodes.get(root, []))))]
        order[root] = low[root] = len(order)
        stack.append(root)
        inside.add(root)
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in order:
                    order[nxt] = low[nxt] = len(order)
                    stack.append(nxt)
                    inside.add(nxt)
                    work.append((nxt, iter(sorted(nodes.get(nxt, [])))))
                    break
                if nxt in inside:
                    low[node] = min(low[node], order[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == order[node]:
                    part = []
                    while True:
                        member = stack.pop()
                        inside.discard(member)
                        part.append(member)
                        if member == node:
                            break
                    if len(part) > 1:
                        found.append(sorted(part))
    return sorted(found)


def cycles(edges: DataFrame) -> DataFrame:
    """(repo_id, members): import cycles per repository.

    A task gathers one repository's edges; a source caps a repository's files, and more than MAX_EDGES are refused.
    """

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        nodes: dict[str, list[str]] = {}
        if len(frame) > MAX_EDGES:
            raise ValueError(f"repository {key[0]} has {len(frame)} edges")
        for a, b in zip(frame.src, frame.dst, strict=True):
            nodes.setdefault(a, []).append(b)
        return pd.DataFrame({"repo_id": key[0], "members": strong_components(nodes)}, columns=["repo_id", "members"])

    return edges.select("repo_id", "src", "dst").groupBy("repo_id").applyInPandas(run, f"repo_id {edges.schema['repo_id'].dataType.simpleString()}, members array<string>")


def repository_summary(modules: DataFrame, edges: DataFrame, top: int = 10, shown: int = 5) -> DataFrame:
    """(repo_id, place, line): files analysed, and the files with most imports with what they depend on; ties by path."""
    w = Window.partitionBy("repo_id").orderBy(F.desc("n_imports"), "file_path")
    best = modules.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    first = Window.partitionBy("repo_id", "src").orderBy("dst")
    deps = edges.withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= shown).groupBy("repo_id", F.col("src").alias("file_path")).agg(F.array_join(F.array_sort(F.collect_list("dst")), ", ").alias("deps"))
    listed = best.join(deps, ["repo_id", "file_path"], "left")
    line = F.concat(F.format_string("%s: %d imports, %d classes, %d functions", "file_path", "n_imports", "classes", "functions"), F.coalesce(F.concat(F.lit("; depends on "), F.col("deps")), F.lit("")))
    head = modules.groupBy("repo_id").agg(F.format_string("Files analysed: %d", F.count("*")).alias("line")).select("repo_id", F.lit(0).alias("place"), "line")
    return head.union(listed.select("repo_id", F.col("rank").alias("place"), line.alias("line")))
