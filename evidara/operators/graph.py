"""File-reference graph and dependency-aware task picking."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.functions.plan import union
from evidara.operators.mentions import mentions

#: Kinds by the first matching path prefix.
KIND_BY_PREFIX = (
    ("docs/", "doc"), ("specs/", "spec"), ("progress/runs/", "run"), ("progress/reviews/", "review"), ("progress/", "state"), (".claude/agents/", "agent"), (".opencode/agent/", "agent"), (".codex/skills/", "skill"), ("tasks/", "task"), ("packages/", "code"), ("apps/", "code"),
)


def kind_of(path: Column, prefixes=KIND_BY_PREFIX) -> Column:
    out = F.lit("root")
    for prefix, kind in reversed(prefixes):
        out = F.when(path.startswith(prefix), kind).otherwise(out)
    return out


def title_of(path: Column, text: Column) -> Column:
    """The first level-one Markdown heading of a .md file, else its path."""
    head = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?m)^[ \t]*# (.*)$", 1)
    return F.when(path.endswith(".md") & (F.trim(head) != ""), F.trim(head)).otherwise(path)


def first_hits(files: DataFrame) -> DataFrame:
    """Files found by several ordered patterns, once: (pattern, path, ...) by least pattern."""
    return files.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy("pattern"))).where("_n = 1").drop("_n")


def edges(files: DataFrame, tokens_of_paths: str | None = None) -> DataFrame:
    """(src, dst): src's text names dst's path, or wikilinks it by path or file name.

    Naming a path is a substring test; texts meet paths by the paths' rarest pieces (``mentions``).
    ``tokens_of_paths``, a pattern whose matches are whole path mentions, makes it a plain equi-join.
    """
    names = files.select(F.col("path").alias("dst")).where("dst <> ''").distinct()
    if tokens_of_paths is not None:
        said = files.select(F.col("path").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(tokens_of_paths), F.lit(0)))).alias("dst"))
        by_path = said.join(names, "dst").where("src <> dst").select("src", "dst")
    else:
        by_path = mentions(files.select(F.col("path").alias("src"), "text"), names).where("src <> dst")
    links = files.select(F.col("path").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1)))).alias("target")).withColumn("target", F.trim("target"))
    base = F.regexp_extract("dst", r"([^/]*?)(?:\.[^./]*)?$", 1)
    stems = names.select("dst", base.alias("stem")).groupBy("stem").agg(F.max("dst").alias("by_stem"))
    known = links.join(names.select("dst", F.col("dst").alias("target")), "target", "left").join(stems.withColumnRenamed("stem", "target"), "target", "left")
    wiki = known.select("src", F.coalesce("dst", "by_stem").alias("dst")).where("dst is not null")
    return union(by_path, wiki).distinct()


def orphans(files: DataFrame, links: DataFrame) -> DataFrame:
    """(path): files at no end of any edge."""
    ends = union(links.select(F.col("src").alias("path")), links.select(F.col("dst").alias("path")))
    return files.select("path").join(ends, "path", "left_anti")


def mermaid(links: DataFrame) -> str:
    """A Mermaid graph of all edges, drawn on the driver one partition at a time."""
    node = lambda p: "n_" + "".join(ch if ch.isalnum() else "_" for ch in p)
    rows = links.orderBy("src", "dst").toLocalIterator()
    return "\n".join(["graph LR", *(f'  {node(r["src"])}["{r["src"]}"] --> {node(r["dst"])}["{r["dst"]}"]' for r in rows)])


def graph_json(files: DataFrame, links: DataFrame) -> str:
    """The graph as JSON: nodes (id, kind, title), edges (source, target) and the counts of both and of orphans."""
    titles = files.groupBy("path").agg(F.min("text").alias("text")).select("path", kind_of(F.col("path")).alias("kind"), title_of(F.col("path"), F.col("text")).alias("title"))
    nodes = [{"id": r["path"], "kind": r["kind"], "title": r["title"]} for r in titles.orderBy("path").toLocalIterator()]
    edges_ = [{"source": r["src"], "target": r["dst"]} for r in links.select("src", "dst").orderBy("src", "dst").toLocalIterator()]
    ends = {e[k] for e in edges_ for k in ("source", "target")}
    counts = {"nodes": len(nodes), "edges": len(edges_), "orphans": sum(n["id"] not in ends for n in nodes)}
    return json.dumps({"nodes": nodes, "edges": edges_, "counts": counts}, ensure_ascii=False, indent=2)


def ready_tasks(tasks: DataFrame, owner: str | None = None) -> DataFrame:
    """Tasks to do whose dependencies are all done, in file order (column pos); unknown ones aren't done."""
    todo = tasks.where("status = 'todo'")
    if owner is not None:
        todo = todo.where(F.col("owner_cli") == owner)
    done = tasks.where("status = 'done'").select(F.col("id").alias("dep"))
    waiting = todo.select("id", F.explode("depends_on").alias("dep")).join(done, "dep", "left_anti").select("id").distinct()
    return todo.join(waiting, "id", "left_anti")

