"""Readers and writers with fixed schemas."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palmleaf.functions import text as T
from palmleaf.shared import materialize, numbered

#: Rows of a file whose sums one task runs over.
CELL = 10_000
ESSAY = "id string, text string, topic string"
TRIPLE = "subject string, relation string, object string, period string, source string"


def read_corpus(spark: SparkSession, path: str, paragraph_over: int = 50, sentence_over: int = 20, separator: str | None = None) -> DataFrame:
    """``(doc, para, pos, sentence)`` of whole text files: paragraphs between empty lines, sentences between . ! ? and danda.

    With ``separator`` a file holds many texts, one after the other with it between them: for corpora of more texts than a folder holds
    files; doc is then the file and the row's own number.
    """
    if separator is None:
        files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc"), "value")
    else:
        files = spark.read.option("lineSep", separator).text(path).select(F.concat_ws("#", F.input_file_name(), F.monotonically_increasing_id().cast("string")).alias("doc"), "value")
    paras = files.select("doc", T.paragraphs(F.col("value"), r"\n\n", paragraph_over).alias("parts"))
    paras = paras.select("doc", F.posexplode_outer("parts").alias("para", "text")).where("text is not null")  # outer, or parts are made twice
    return paras.select("doc", "para", F.posexplode(F.filter(F.transform(F.split("text", r"[.!?।]"), T.strip_ws), lambda s: F.length(s) > sentence_over)).alias("pos", "sentence"))


def _running(rows: DataFrame, value: str, out: str) -> DataFrame:
    """``rows`` (file, g, ...) with ``out``: the sum of ``value`` over the rows of the file before. Summed by cells of CELL rows first, so that no window takes a file."""
    cell = F.floor(F.col("g") / CELL)
    sums = rows.groupBy("file", cell.alias("_cell")).agg(F.sum(value).alias("_sum"))
    before = sums.withColumn("_before", F.sum("_sum").over(Window.partitionBy("file").orderBy("_cell")) - F.col("_sum")).drop("_sum")
    within = F.sum(value).over(Window.partitionBy("file", "_cell").orderBy("g")) - F.col(value)
    rows = rows.withColumn("_cell", cell).withColumn("_within", within)
    return rows.join(before.hint("merge"), ["file", "_cell"]).withColumn(out, F.col("_before") + F.col("_within")).drop("_cell", "_before", "_within")


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """``(file, pos, record)``: the objects of JSON files, each of which is an array of them (or has one after the other), as texts in order.

    Files are read by lines, which many tasks share: a JSON text ends no string at a line's end, so each line tells by itself how
    many brackets it opens; sums over the lines before say how deep it begins, and objects are cut where they close. A file
    that is one line is cut by one task. What stands between objects is left out.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    lines = numbered(lines.where(F.length(T.strip_ws(F.col("value"))) > 0), ["file", "block", "at"])
    bare = F.regexp_replace("value", r'"(?:[^"\\]|\\.)*"', "")
    count = lambda signs: F.length(bare) - F.length(F.translate(bare, signs, ""))
    lines = _running(lines.withColumn("delta", (count("{[") - count("}]")).cast("long")), "delta", "depth")
    first = lines.groupBy(F.col("file").alias("f")).agg(F.min_by(F.left(F.ltrim("value"), F.lit(1)), "g").alias("opens"))
    lines = lines.join(first.hint("merge"), F.col("file") == F.col("f")).select("file", "g", "value", "depth", F.when(F.col("opens") == "[", 1).otherwise(0).alias("base"))
    mark = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]]')

    def cut(it):
        for pdf in it:
            out = []
            for file, g, value, depth, base in zip(pdf["file"], pdf["g"], pdf["value"], pdf["depth"], pdf["base"]):
                since = 0 if depth > base else None
                for m in mark.finditer(value):
                    if m[0] in "{[":
                        since = m.start() if m[0] == "{" and depth == base else since
                        depth += 1
                    elif m[0] in "}]":
                        depth -= 1
                        if depth == base and since is not None and m[0] == "}":
                            out.append((file, g, m.start(), value[since : m.end()], 1))
                            since = None
                if since is not None and depth > base:
                    out.append((file, g, len(value), value[since:], 0))
            yield pd.DataFrame(out, columns=["file", "line", "place", "part", "closes"])

    parts = materialize(lines.mapInPandas(cut, "file string, line long, place int, part string, closes long"), "parts")
    parts = _running(numbered(parts, ["file", "line", "place"]), "closes", "pos")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "part"))), lambda x: x["part"]), "\n")  # lines of one object
    return parts.groupBy("file", "pos").agg(joined.alias("record"))


def read_essays_json(spark: SparkSession, path: str) -> DataFrame:
    """``(essay_id, topic, text)`` of JSON arrays; a missing id is essay_NNN by its place in the file."""
    rows = json_records(spark, path).select("pos", F.from_json("record", ESSAY).alias("e"))
    return rows.select(F.coalesce("e.id", F.format_string("essay_%03d", F.col("pos") + 1)).alias("essay_id"), F.col("e.topic").alias("topic"), F.col("e.text").alias("text"))


def read_lexicon(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Distinct ``token`` of JSON files that hold a list, or an object whose keys count; absent files hold nothing."""
    out = spark.createDataFrame([], "token string")
    for p in paths:
        try:
            raw = spark.read.text(p, wholetext=True)
        except Exception as e:  # only a missing path is excused
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        items = F.when(F.startswith(T.strip_ws(F.col("value")), F.lit("[")), F.from_json("value", "array<string>")).otherwise(F.json_object_keys("value"))
        out = out.unionByName(raw.select(F.explode(items).alias("token")))
    return out.distinct()


def read_name_list(spark: SparkSession, path: str) -> DataFrame:
    """``(seq, name)`` of lines such as ``12. name (note)``."""
    rows = spark.read.text(path).select(F.regexp_extract("value", r"^\s*(\d+)\.\s*(.+?)\s*$", 1).alias("n"), F.regexp_extract("value", r"^\s*(\d+)\.\s*(.+?)\s*$", 2).alias("name")).where("n != ''")
    return rows.select(F.col("n").cast("int").alias("seq"), T.nfc(F.regexp_replace("name", r"\s*\([^)]*\)\s*$", "")).alias("name"))


def read_triples_json(spark: SparkSession, path: str) -> DataFrame:
    """Flat triples of JSON arrays; objects without both ends are left out."""
    rows = json_records(spark, path).select(F.from_json("record", TRIPLE).alias("t")).select("t.*")
    return rows.where("subject is not null or object is not null")


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """Flat triples, one JSON object a line, as write_json leaves them; rows without both ends are left out."""
    return spark.read.schema(TRIPLE).option("mode", "PERMISSIVE").json(path).where("subject is not null or object is not null")


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(T.strip_ws(F.col("value")).alias("sentence")).where("sentence != ''")


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", "true").option("multiLine", "true").csv(path)


def write_articles(articles: DataFrame, path: str) -> None:
    articles.write.option("header", "true").csv(path)


def write_json(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    (rows.write.partitionBy(*by) if by else rows.write).json(path)


def parse_submissions(raw: DataFrame, schema: str, required: list[str], column: str = "body") -> DataFrame:
    """``raw`` with ``parsed`` and ``error``: JSON with bare control characters is read; else, or without a required field, error says so."""
    parsed = F.from_json(column, schema, {"allowUnquotedControlChars": "true", "mode": "PERMISSIVE"})
    rows = raw.withColumn("parsed", parsed)
    gaps = F.array_compact(F.array(*(F.when(F.col(f"parsed.{c}").isNull(), F.lit(c)) for c in required)))
    bad = F.col("parsed").isNull() | (F.size(gaps) == len(required))
    return rows.withColumn("error", F.when(bad, "invalid body").when(F.size(gaps) > 0, F.concat(F.lit("missing: "), F.concat_ws(", ", gaps))))


def read_conll(spark: SparkSession, path: str) -> DataFrame:
    """``(block, pos, token, tag)`` of files with a token and its tag a line and an empty line between sentences.

    Files are cut at empty lines, so a large one is read by many tasks; the tag is what stands behind the last white space of a line.
    """
    blocks = spark.read.option("lineSep", "\n\n").text(path).where(F.length(F.trim("value")) > 0).select(F.monotonically_increasing_id().alias("block"), "value")
    lines = blocks.select("block", F.posexplode(F.filter(F.transform(F.split("value", r"\r?\n"), T.strip_ws), lambda x: F.length(x) > 0)).alias("pos", "line"))
    return lines.select("block", "pos", F.regexp_extract("line", r"^(\S+)", 1).alias("token"), F.regexp_extract("line", r"(\S+)$", 1).alias("tag"))
