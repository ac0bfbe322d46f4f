"""Hypergraphs, graphs, pairs, selections and properties as text and as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.functions import treelets
from hyperloom.plans.storage import numbered


def hyperedges_from_lines(lines: DataFrame, value: str = "value", line: str | None = None) -> DataFrame:
    """(e, v) of lines that are hyperedges: each run of digits is a vertex, other characters separate.

    Lines without digits are left out, a vertex counts once in a line, equal lines are different hyperedges. A run
    of digits that no 64-bit number can hold is no vertex.
    `line` is a column that numbers the lines; without one they get numbers by their text's order.
    """
    found = F.array_sort(F.array_distinct(F.array_compact(F.transform(F.regexp_extract_all(value, F.lit("([0-9]+)"), 1), lambda x: x.try_cast("long")))))
    kept = lines.select(*([F.col(line).cast("long").alias("e")] if line else []), found.alias("vs")).where(F.size("vs") > 0)
    if not line:
        kept = numbered(kept.withColumn("_tie", F.monotonically_increasing_id()), [F.col("vs"), F.col("_tie")], "e")
    return kept.select("e", F.explode("vs").alias("v"))


def read_hypergraph(spark: SparkSession, path: str) -> DataFrame:
    """The incidence of a text file with a hyperedge a line."""
    return hyperedges_from_lines(spark.read.text(path))


def hypergraph_lines(inc: DataFrame) -> DataFrame:
    """`e` and its line: the vertices in order, joined by commas."""
    return inc.groupBy("e").agg(F.array_join(F.transform(F.sort_array(F.collect_list("v")), lambda x: x.cast("string")), ",").alias("value"))


def write_hypergraph(inc: DataFrame, path: str) -> None:
    hypergraph_lines(inc).select("value").write.text(path)


class GraphFormatError(ValueError):
    """A graph's lines contradict each other or the header."""


def graph_from_lines(lines: DataFrame, form: str, n: int, m: int) -> DataFrame:
    """The adjacency (u, v) of the lines after a header `n m`; `lines` has `line` (from 0) and `value`.

    `edges`: `u v` a line; `node`: `u v1 v2 ...`; `degree`: `deg v1 v2 ...`, u is the line. Each edge is listed
    both ways. Vertices out of range, self loops, edges listed twice (but for `degree`), wrong degrees and a sum
    of degrees other than 2m are errors.
    """
    words = F.transform(F.regexp_extract_all("value", F.lit("([0-9]+)"), 1), lambda x: x.cast("long"))
    rows = lines.select("line", words.alias("w")).where(F.size("w") > 0)
    if form == "edges":
        made = rows.select(F.col("w")[0].alias("u"), F.col("w")[1].alias("v"))
    elif form == "node":
        made = rows.select(F.col("w")[0].alias("u"), F.explode(F.expr("slice(w, 2, size(w))")).alias("v"))
    elif form == "degree":
        if not rows.where(F.col("w")[0] != F.size("w") - 1).isEmpty():
            raise GraphFormatError("a degree differs from the number of neighbours")
        made = rows.select(F.col("line").cast("long").alias("u"), F.explode(F.expr("slice(w, 2, size(w))")).alias("v"))
    else:
        raise ValueError(f"no such form: {form}")
    facts = made.agg(
        F.count("*").alias("all"),
        F.count_distinct("u", "v").alias("distinct"),
        F.coalesce(F.sum((F.coalesce(F.col("u") >= n, F.lit(True)) | F.coalesce(F.col("v") >= n, F.lit(True))).cast("long")), F.lit(0)).alias("outside"),
        F.coalesce(F.sum((F.col("u") == F.col("v")).cast("long")), F.lit(0)).alias("loops"),
    ).first()
    for wrong, text in ((facts["outside"], "a vertex is out of range"), (facts["loops"], "an edge is a self loop"), (form != "degree" and facts["all"] != facts["distinct"], "an edge is listed twice"), (facts["all"] != 2 * m, "the header's number of edges is not that of the lines")):
        if wrong:
            raise GraphFormatError(text)
    return made


def graph_lines(adj: DataFrame, form: str = "degree") -> DataFrame:
    """`u` and its line in a form of `graph_from_lines` (but for `edges`), neighbours in order."""
    near = F.array_join(F.transform(F.sort_array(F.collect_list("v")), lambda x: x.cast("string")), " ")
    first = F.count("*").cast("string") if form == "degree" else F.col("u").cast("string")
    return adj.groupBy("u").agg(F.concat_ws(" ", first, near).alias("value"))


def graph_header(adj: DataFrame, n: int) -> DataFrame:
    return adj.agg(F.concat_ws(" ", F.lit(n).cast("string"), F.expr("count(1) div 2").cast("string")).alias("value"))


def selection_from_text(text: str) -> tuple[set[int], bool]:
    """The structures of a selection and whether they are included: a word INCLUDE or EXCLUDE, then numbers."""
    words = text.split()
    if not words or words[0] not in ("INCLUDE", "EXCLUDE"):
        raise ValueError("a selection starts with INCLUDE or EXCLUDE")
    chosen = {int(w) for w in words[1:]}
    if wrong := [s for s in chosen if not treelets.valid(s)]:
        raise ValueError(f"no tree: {wrong[0]}")
    return chosen, words[0] == "INCLUDE"


def read_selection(spark: SparkSession, path: str) -> tuple[set[int], bool]:
    """A selection from a text file."""
    return selection_from_text("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def tree_from_text(text: str, root: int = 0) -> int:
    """A tree from lines `u v`."""
    return treelets.from_edges([(int(a), int(b)) for a, b in (x.split() for x in text.splitlines() if x.strip())], root)


def properties(spark: SparkSession, **values) -> DataFrame:
    """Named values as a one-row table."""
    return spark.createDataFrame([tuple(values.values())], list(values))


def write_tables(tables: dict[int, DataFrame], path: str, compression: str = "zstd") -> None:
    """Treelet tables as one Parquet table, dealt by size."""
    whole = None
    for k, df in tables.items():
        part = df.withColumn("k", F.lit(k))
        whole = part if whole is None else whole.unionByName(part)
    whole.write.option("compression", compression).partitionBy("k").parquet(path)


def read_tables(spark: SparkSession, path: str, k: int) -> dict[int, DataFrame]:
    """The tables of sizes 1 to k; each reads its own files alone."""
    return {size: spark.read.parquet(path).where(F.col("k") == size).drop("k") for size in range(1, k + 1)}
