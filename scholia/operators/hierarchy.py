"""Taxonomies: trees from XML, levels by path or prefix, counts by level (SRC-12, JN-17 to JN-19, AGG-60, AGG-61)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TREE = "symbol string, kind string, level string, title string, parent_symbol string, path string, entry_type string"


def tree_rows(xml: str, entry: str = "ipcEntry", skipped: Sequence[str] = ("t",)) -> Iterator[tuple]:
    """SRC-12: rows of a nested XML tree with parent and path.

    Entries without a symbol or of a skipped kind give no row, but their children do,
    under the parent above. A title joins all texts of its parts.
    """
    local = lambda e: e.tag.rpartition("}")[2]

    def walk(node: ElementTree.Element, parent: str | None, path: str, depth: int) -> Iterator[tuple]:
        for child in node:
            if local(child) != entry:
                if local(child) != "textBody":
                    yield from walk(child, parent, path, depth)
                continue
            symbol, kind = (child.get("symbol") or "").strip(), child.get("kind") or ""
            if not symbol or kind in skipped:
                yield from walk(child, parent, path, depth)
                continue
            title = "; ".join(t for part in child if local(part) == "textBody" for t in (" ".join(x.split()) for x in part.itertext()) if t)
            own = f"{path}/{symbol}" if path else symbol
            yield (symbol, kind, str(depth), title, parent, own, child.get("entryType"))
            yield from walk(child, symbol, own, depth + 1)

    yield from walk(ElementTree.fromstring(xml), None, "", 0)


def read_tree(files: DataFrame, content: str = "value", entry: str = "ipcEntry", skipped: Sequence[str] = ("t",)) -> DataFrame:
    """Trees of whole XML texts, one text a row (``spark.read.text(path, wholetext=True)``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in TREE.split(", ")]
        for b in batches:
            for xml in b[content]:
                yield pd.DataFrame(list(tree_rows(xml, entry, skipped)), columns=names)

    return files.select(content).mapInPandas(run, TREE)


def prefix_pairs(df: DataFrame, key: Sequence[str], parents: str, children: str, keep_parents: bool = False) -> DataFrame:
    """JN-17, JN-18: each parent code with the child codes that begin with it; with ``keep_parents`` also without one.

    Both lists stand in one row, so nothing is joined.
    """
    rows = df.select(*key, F.explode(parents).alias("parent"), F.col(children).alias("_c"))
    own = F.filter("_c", lambda c: c.startswith(F.col("parent")))
    return rows.select(*key, "parent", (F.explode_outer if keep_parents else F.explode)(own).alias("child"))


def code_levels(df: DataFrame, code: str, tree: DataFrame) -> DataFrame:
    """JN-19: section, class, subclass and main group of a code: by the tree's path, else by the code's prefixes.

    The tree is joined by key; a title that is missing is named after its code.
    """
    path = tree.select(F.col("symbol").alias(code), F.split("path", "/").alias("_path"))
    found = df.join(path.dropDuplicates([code]), code, "left")
    size = F.length(code)
    names = [("section", 1, "s"), ("class", 3, "c"), ("subclass", 4, "u"), ("main_group", 10, "m")]
    for k, (name, width, _) in enumerate(names):
        made = F.when(size >= width, F.substring(code, 1, 8 if name == "main_group" else width))
        found = found.withColumn(name, F.when(F.col("_path").isNotNull(), F.get("_path", k)).otherwise(made))
    for name, _, kind in names:
        titles = tree.where(F.col("kind") == kind).select(F.col("symbol").alias(name), F.col("title").alias(f"{name}_title")).dropDuplicates([name])
        shown = name.replace("_", " ").title()
        found = found.join(titles, name, "left").withColumn(
            f"{name}_title", F.when(F.col(name).isNotNull(), F.coalesce(f"{name}_title", F.concat(F.lit(f"{shown} "), F.col(name))))
        )
    return found.drop("_path")


def level_counts(df: DataFrame, levels: Sequence[str], tops: Sequence[int]) -> DataFrame:
    """AGG-60: rows of each path, and per level the largest values under each kept parent.

    One aggregate by whole path feeds all levels.
    """
    paths = df.groupBy(*levels).agg(F.count("*").alias("n"))
    out = None
    for k, (level, top) in enumerate(zip(levels, tops, strict=True)):
        above = list(levels[:k])
        summed = paths.where(F.col(level).isNotNull()).groupBy(*above, level).agg(F.sum("n").alias("n"))
        w = Window.partitionBy(*above).orderBy(F.desc("n"), level)
        best = summed.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
        path = F.concat_ws("/", *above, level)
        rows = best.select(F.lit(level).alias("level"), path.alias("path"), F.col(level).cast("string").alias("value"), "n", "rank")
        out = rows if out is None else out.unionByName(rows)
        paths = paths.join(best.select(*above, level), [*above, level], "left_semi")
    return out


def macro_heatmap(df: DataFrame, macro: str, category: str, n: int) -> DataFrame:
    """AGG-61, AGG-37: counts of the ``n`` leading categories of each macro class, with their share of the category."""
    counted = df.groupBy(macro, category).agg(F.count("*").alias("n"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy(macro).orderBy(F.desc("n"), category)))
    shown = counted.join(ranked.where(F.col("rank") <= n).select(category).distinct(), category, "left_semi")
    total = F.sum("n").over(Window.partitionBy(category))
    main: Column = F.max_by(macro, F.struct("n", macro)).over(Window.partitionBy(category))
    return shown.withColumn("share", F.col("n") / total).withColumn("main", main)
