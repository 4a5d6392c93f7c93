"""Texts of files as rows, and walks, beliefs and decisions as the text of other tools."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
FENCE = r"(?m)^[ \t]{0,3}```[^\n]*\n[\s\S]*?^[ \t]{0,3}```[ \t]*\r?$"
SHORTEST_PARAGRAPH, PREVIEW = 24, 80
DOCUMENT_FILES = ("*.md", "*.rst", "*.txt", "*.adoc")
BULLET = r"^\s*-\s+\[([^\]]+)\]\(([^)]+)\)(\s+[—–-]+\s+(.+))?$"
REVIEW = r"^\s*-\s+\[([xX ])\]\s+keep\s+\[([xX ])\]\s+remove\s+\[([xX ])\]\s+lock\s+\|\s+(\S+)"
NODE_COLORS = {"locked": "cyan3", "high": "darkgreen", "low": "firebrick"}
EDGE_COLORS = {"SUPPORTS": "darkgreen", "CONTRADICTS": "firebrick", "CITES": "royalblue", "RELATES_TO": "gray50", "DERIVED_FROM": "purple", "IMPLEMENTS": "teal", "TEMPORAL_NEXT": "darkorange", "TESTS": "goldenrod", "SUPERSEDES": "black", "RESOLVES": "darkviolet", "POTENTIALLY_STALE": "gray70"}
TURN = "role string, text string, session_id string, ts string, type string, message struct<content:string>, sessionId string, timestamp string"


def paragraphs(text: Column) -> Column:
    """Paragraphs that aren't too short, without fenced code."""
    parts = F.transform(F.split(F.regexp_replace(text, FENCE, " "), "\n\n"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: F.length(p) >= SHORTEST_PARAGRAPH)


def document_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """(``path``, ``n``, ``paragraph``) of the documents below a folder."""
    rows = None
    for pattern in DOCUMENT_FILES:
        here = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern).select(F.input_file_name().alias("path"), "value")
        rows = here if rows is None else rows.unionByName(here)
    return rows.select("path", F.posexplode(paragraphs(F.col("value"))).alias("n", "paragraph"))


def docstrings(source: Column) -> Column:
    """(``name``, ``text``) of the docstrings of a Python source: of the module, its classes and functions; none where it can't be parsed."""

    @F.pandas_udf("array<struct<name:string,text:string>>")
    def found(values: pd.Series) -> pd.Series:
        def one(code: str | None) -> list[dict]:
            try:
                tree = ast.parse(code or "")
            except (SyntaxError, ValueError):
                return []
            nodes = [n for n in ast.walk(tree) if isinstance(n, ast.Module | ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef)]
            return [{"name": getattr(n, "name", "<module>"), "text": d} for n in nodes if (d := ast.get_docstring(n))]

        return values.map(one)

    return found(source)


def normalised_turns(lines: DataFrame, column: str = "line") -> DataFrame:
    """``lines`` of JSON of either of two shapes with ``role``, ``text``, ``session_id`` and ``ts``; what is neither is left out."""
    j = F.from_json(column, TURN)
    rows = lines.withColumn("_j", j)
    plain = F.col("_j.role").isNotNull() & (F.length("_j.text") > 0)
    content = F.col("_j.message.content")
    parts = F.from_json(content, "array<struct<type:string,text:string>>")
    texts = F.transform(F.filter(parts, lambda p: (p["type"] == "text") & (F.length(p["text"]) > 0)), lambda p: p["text"])
    said = F.when(content.startswith("["), F.array_join(texts, "\n")).otherwise(content)
    hosted = F.col("_j.type").isin("user", "assistant") & (F.length(said) > 0)
    none_if_empty = lambda c: F.when(c != "", c)
    rows = rows.withColumns(
        {
            "role": F.when(plain, F.col("_j.role")).when(hosted, F.col("_j.type")),
            "text": F.when(plain, F.col("_j.text")).when(hosted, said),
            "session_id": F.when(plain, none_if_empty(F.col("_j.session_id"))).when(hosted, none_if_empty(F.col("_j.sessionId"))),
            "ts": F.when(plain, F.col("_j.ts")).when(hosted, F.col("_j.timestamp")),
        }
    )
    return rows.where("role IS NOT NULL").drop("_j")


def transcripts(spark: SparkSession, folder: str, since: str | None = None) -> DataFrame:
    """The turns of all JSON-lines files below a folder, of those changed after ``since``."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl")
    return normalised_turns((reader.option("modifiedAfter", since) if since else reader).text(folder).withColumnRenamed("value", "line"))


def bullets(text: Column) -> Column:
    """(``label``, ``target``, ``note``) of the link bullets of a text."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(BULLET))
    return F.transform(lines, lambda line: F.struct(F.trim(F.regexp_extract(line, BULLET, 1)).alias("label"), F.trim(F.regexp_extract(line, BULLET, 2)).alias("target"), F.trim(F.regexp_extract(line, BULLET, 4)).alias("note")))


def memory_file(text: Column) -> Column:
    """(``name``, ``description``, ``type``, ``body``) of a text with a front matter; null without one or without a body."""
    p = r"(?s)\A---[ \t]*\n(.*?\n)---[ \t]*\n(.*)\Z"
    head, body = F.regexp_extract(text, p, 1), F.trim(F.regexp_extract(text, p, 2))
    field = lambda k: F.regexp_replace(F.regexp_extract(head, rf"(?m)^{k}:[ \t]*(.*?)[ \t]*$", 1), r"""^["']|["']$""", "")
    kind = F.regexp_extract(head, r"(?m)^[ \t]+type:[ \t]*([A-Za-z_]+)[ \t]*$", 1)
    made = F.struct(field("name").alias("name"), field("description").alias("description"), F.when(kind.isin("user", "feedback", "project", "reference"), kind).otherwise("").alias("type"), body.alias("body"))
    return F.when(text.rlike(p) & (body != ""), made)


def decisions(text: Column) -> Column:
    """(``id``, ``verdict``) of the lines of a review: keep, remove, lock, skip if nothing is checked, ambiguous if more than one is."""

    def one(line: Column) -> Column:
        checked = [F.lower(F.regexp_extract(line, REVIEW, k)) == "x" for k in (1, 2, 3)]
        n = sum((c.cast("int") for c in checked), F.lit(0))
        verdict = F.when(n > 1, "ambiguous").when(checked[0], "keep").when(checked[1], "remove").when(checked[2], "lock").otherwise("skip")
        return F.struct(F.regexp_extract(line, REVIEW, 4).alias("id"), verdict.alias("verdict"))

    return F.transform(F.filter(F.split(text, "\n"), lambda line: line.rlike(REVIEW)), one)


# ---- exports ------------------------------------------------------------------------------------------------------------


def _escaped(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"')


def _label(content: Column) -> Column:
    line = F.trim(F.regexp_replace(content, r"\s+", " "))
    return F.when(F.length(line) <= PREVIEW, line).otherwise(F.concat(F.substring(line, 1, PREVIEW - 1), F.lit("…")))


def _node_class(mean: Column, lock_level: Column) -> Column:
    return F.when(lock_level == "user", "locked").when(mean >= 0.75, "high").when(mean < 0.25, "low")


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The lines of a Graphviz graph of nodes (``id``, ``content``, ``mean``, ``lock_level``) and the edges among them, with their order."""
    colour = F.lit(None).cast("string")
    for name, value in NODE_COLORS.items():
        colour = F.when(_node_class(F.col("mean"), F.col("lock_level")) == name, value).otherwise(colour)
    thick = F.when(F.col("lock_level") == "user", "penwidth=2")
    attributes = F.concat_ws(", ", F.concat(F.lit('label="'), _escaped(_label(F.col("content"))), F.lit('"')), F.concat(F.lit('color="'), colour, F.lit('"')), thick)
    made = nodes.select(F.lit(1).alias("part"), F.col("id").alias("key"), F.concat(F.lit('  "'), _escaped(F.col("id")), F.lit('" ['), attributes, F.lit("];")).alias("line"))
    ids = nodes.select("id")
    inside = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "type").distinct()
    tint = F.lit(None).cast("string")
    for name, value in EDGE_COLORS.items():
        tint = F.when(F.col("type") == name, value).otherwise(tint)
    arrow = F.concat(F.lit('  "'), _escaped(F.col("src")), F.lit('" -> "'), _escaped(F.col("dst")), F.lit('"'), F.coalesce(F.concat(F.lit(' [color="'), tint, F.lit('"]')), F.lit("")), F.lit(";"))
    drawn = inside.select(F.lit(2).alias("part"), F.concat_ws("\0", "src", "dst", "type").alias("key"), arrow.alias("line"))
    frame = nodes.sparkSession.createDataFrame([(0, "0", "digraph store {"), (0, "1", "  graph [rankdir=LR];"), (0, "2", "  node [shape=box, style=rounded];"), (3, "", "}")], made.schema)
    return frame.unionByName(made).unionByName(drawn)


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edges as JSON objects, one a row."""
    made = nodes.select(F.lit("node").alias("part"), "id", F.to_json(F.struct("id", _label(F.col("content")).alias("label"), (F.col("lock_level") == "user").alias("locked"), F.round("mean", 6).alias("posterior_mean"))).alias("json"))
    ids = nodes.select("id")
    inside = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "type").distinct()
    return made.unionByName(inside.select(F.lit("edge").alias("part"), F.concat_ws(">", "src", "type", "dst").alias("id"), F.to_json(F.struct("src", "dst", "type")).alias("json")))


def vault_notes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(``file``, ``note``) of a markdown vault: front matter, the text, and links to what its edges reach."""
    links = edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set(F.concat(F.lit("- "), "type", F.lit(" [["), "dst", F.lit("]]")))).alias("links"))
    rows = nodes.join(links, "id", "left")
    head = F.concat(F.lit("---\nid: "), "id", F.lit("\nlock: "), "lock_level", F.lit("\n---\n"))
    return rows.select(F.concat("id", F.lit(".md")).alias("file"), F.concat(head, "content", F.coalesce(F.concat(F.lit("\n\n"), F.array_join("links", "\n")), F.lit(""))).alias("note"))


def append_feed(events: DataFrame, folder: str) -> None:
    """Add events (``ts``, ``event`` and any other fields) to a feed log, a JSON object a line; null fields are left out. Each call adds files of its own, so that
    nothing that is there is written again."""
    events.select(F.to_json(F.struct("ts", "event", *(c for c in events.columns if c not in ("ts", "event"))))).write.mode("append").text(folder)


def read_feed(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """The rows of a feed log by a schema; lines that are no JSON object are left out, and fields that a row doesn't have are null."""
    rows = spark.read.text(folder).where(F.trim("value").startswith("{"))
    found = rows.select(F.from_json("value", f"{kind}, _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("r"))
    return found.where("r._broken IS NULL").select("r.*").drop("_broken")
