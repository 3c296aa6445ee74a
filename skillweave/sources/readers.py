"""Readers of the formats that postings, vocabularies, examples and graphs come in."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skillweave import schema
from skillweave.functions import text as fx

# Column names of vocabulary files, in order of preference, and member names by entity type.
LABEL_COLUMNS = ("Element Name", "Commodity Title", "Title", "O*NET-SOC Title")
DESCRIPTION_COLUMNS = ("Description", "Commodity Description")
CODE_COLUMNS = ("O*NET-SOC Code", "Commodity Code", "Element ID")
MEMBER_TYPES = (("knowledge", "KNW"), ("skills", "SKL"), ("abilities", "ABL"), ("technology skills", "TOL"), ("tools", "TOL"), ("occupation", "OCC"))
CONCEPT_TYPES = {"skill": "SKL", "occupation": "OCC", "knowledge": "KNW", "qualification": "QLF", "tool": "TOL"}


def read_jsonl(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """JSON lines of a fixed schema; a malformed line fails, blank lines are skipped."""
    return spark.read.schema(ddl).option("mode", "FAILFAST").json(path)


def with_order(df: DataFrame) -> DataFrame:
    """Adds ``ord``, rising with the input: file and place in it."""
    return df.withColumn("ord", F.monotonically_increasing_id())


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return with_order(read_jsonl(spark, path, schema.POSTING))


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    return with_order(read_jsonl(spark, path, schema.NER_EXAMPLE))


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    return with_order(read_jsonl(spark, path, schema.GAZETTEER))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """id, text; a line without id gets its place as one."""
    found = with_order(read_jsonl(spark, path, schema.TEXT_SCAN))
    return found.withColumn("id", F.coalesce("id", F.col("ord").cast("string")))


def _csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    return spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", True).option("mode", "PERMISSIVE").csv(path)


def _text(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.trim(F.col(f"`{name}`")), F.lit("")) if name in df.columns else F.lit("")


def _first(df: DataFrame, names: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(_text(df, n), F.lit("")) for n in names])


def read_esco(spark: SparkSession, path: str) -> DataFrame:
    """uri, preferredLabel, altLabels, entityType, description -> entries of source ESCO."""
    df = with_order(_csv(spark, path))
    return df.select("ord", F.col("uri").alias("canonical_id"), F.col("entityType").alias("entity_type"), F.trim("preferredLabel").alias("term"), F.lit("ESCO").alias("source"), _text(df, "description").alias("description"), fx.aliases(F.col("altLabels")).alias("aliases"))


def read_onet(spark: SparkSession, path: str) -> DataFrame:
    """category, code, label, aliases, description (tab-separated) -> entries of source O*NET."""
    df = with_order(_csv(spark, path, "\t"))
    return df.select("ord", F.concat_ws(":", F.lit("onet"), "category", "code").alias("canonical_id"), F.col("category").alias("entity_type"), F.trim("label").alias("term"), F.lit("O*NET").alias("source"), _text(df, "description").alias("description"), fx.aliases(F.col("aliases")).alias("aliases"))


def read_esco_official(spark: SparkSession, path: str) -> DataFrame:
    """The published ESCO table: conceptType or entityType, conceptUri or uri; other labels keep repeats."""
    df = with_order(_csv(spark, path))
    kind = F.lower(_first(df, ("conceptType", "entityType")))
    entity = F.lit("SKL")
    for name, code in CONCEPT_TYPES.items():
        entity = F.when(kind == name, F.lit(code)).otherwise(entity)
    label = _text(df, "preferredLabel")
    return df.filter(label != "").select("ord", F.coalesce(_first(df, ("conceptUri", "uri")), label).alias("canonical_id"), entity.alias("entity_type"), label.alias("term"), F.lit("ESCO").alias("source"), _text(df, "description").alias("description"), fx.alias_parts(_text(df, "altLabels")).alias("aliases"))


def onet_table(df: DataFrame, entity_type: Column) -> DataFrame:
    """Entries of a generic O*NET table; rows without a label are dropped."""
    label = _first(df, LABEL_COLUMNS)
    return df.filter(label.isNotNull()).select("ord", F.coalesce(_first(df, CODE_COLUMNS), label).alias("canonical_id"), entity_type.alias("entity_type"), label.alias("term"), F.lit("O*NET").alias("source"), F.coalesce(_first(df, DESCRIPTION_COLUMNS), F.lit("")).alias("description"), F.array().cast("array<string>").alias("aliases"))


#: Bytes of a member's lines that one task parses, about; a piece never has more than 2**PIECE_BITS rows.
PIECE_BYTES, PIECE_BITS = 1 << 20, 20


def member_type(member: str) -> str | None:
    """The entity type of an archive's member: the first one whose name it contains, for text tables only."""
    low = member.lower()
    return next((code for word, code in MEMBER_TYPES if word in low), None) if low.endswith(".txt") else None


def _pieces_of(stream: io.BufferedIOBase, size: int) -> Iterator[bytes]:
    """Runs of whole lines of about ``size`` bytes; no run ends inside a quoted field."""
    held, length, quoted = [], 0, False
    for line in stream:
        held.append(line)
        length += len(line)
        quoted ^= line.count(b'"') % 2 == 1
        if length >= size and not quoted:
            yield b"".join(held)
            held, length = [], 0
    if held:
        yield b"".join(held)


def _archive_pieces(size: int):
    """Archives -> (entity_type, place, header, lines): one row for each run of lines of each table inside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as archive:
                    for k, member in enumerate(archive.namelist()):
                        kind = member_type(member)
                        if kind is None:
                            continue
                        with archive.open(member) as stream:
                            header = stream.readline()
                            for n, lines in enumerate(_pieces_of(stream, size)):
                                row = [pa.array([kind]), pa.array([(k << 20 | n) << PIECE_BITS], pa.int64()), pa.array([header], pa.binary()), pa.array([lines], pa.binary())]
                                yield pa.RecordBatch.from_arrays(row, names=["entity_type", "place", "header", "lines"])

    return run


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of lines -> the rows of the tables, with the columns that vocabularies are read from."""
    names = LABEL_COLUMNS + DESCRIPTION_COLUMNS + CODE_COLUMNS
    for batch in batches:
        for kind, place, header, lines in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            part = pd.read_csv(io.BytesIO(header + lines), sep="\t", dtype=str, keep_default_na=False).reindex(columns=list(names))
            columns = [pa.array(part[n].astype(object).where(part[n].notna(), None).tolist(), pa.string()) for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(place + np.arange(len(part), dtype=np.int64)), pa.array([kind] * len(part), pa.string()), *columns], names=["ord", "entity_type", *names])


def read_onet_zip(spark: SparkSession, path: str, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Entries of the tables in zip archives; a member's type is the first one whose name it contains.

    A task takes an archive apart into runs of lines, which are dealt to all tasks and parsed there; ``ord`` follows the
    members and their lines.  The archives are read by Spark, from any store it knows.
    """
    columns = ", ".join(f"`{n}` string" for n in LABEL_COLUMNS + DESCRIPTION_COLUMNS + CODE_COLUMNS)
    files = spark.read.format("binaryFile").load(path).select("content")
    pieces = files.mapInArrow(_archive_pieces(piece_bytes), "entity_type string, place bigint, header binary, lines binary")
    dealt = pieces.repartition(spark.sparkContext.defaultParallelism, F.xxhash64("lines"))
    return onet_table(dealt.mapInArrow(_parsed, f"ord bigint, entity_type string, {columns}"), F.col("entity_type"))


def read_posting_table(spark: SparkSession, path: str) -> DataFrame:
    """The external posting table: Position and Long Description become title and description."""
    df = spark.read.parquet(path)
    renamed = df.withColumnsRenamed({"Position": "title", "Long Description": "description"})
    return with_order(renamed.fillna("", [c for c in ("title", "description") if c in renamed.columns]))


def filter_postings(df: DataFrame, keywords: list[str], min_chars: int = 200, max_rows: int = 10_000) -> DataFrame:
    """English postings, long enough, with a keyword in title, description or primary keyword; the first ``max_rows`` by ord."""
    out = df
    if "Long Description_lang" in df.columns:
        out = out.filter(F.lower(F.coalesce(F.col("`Long Description_lang`"), F.lit("en"))) == "en")
    primary = F.coalesce(F.col("`Primary Keyword`").cast("string"), F.lit("")) if "Primary Keyword" in df.columns else F.lit("")
    hay = F.lower(F.concat_ws(" ", "title", "description", primary))
    any_word = F.lit(False)
    for word in keywords:
        any_word = any_word | F.contains(hay, F.lit(word.lower()))
    return out.filter((F.length("description") >= min_chars) & any_word).orderBy("ord").limit(max_rows)


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Node table from CSV; of a repeated id the last row counts, at the first row's place."""
    df = with_order(spark.read.schema(schema.NODE).option("header", True).option("escape", '"').csv(path))
    row = F.struct("label", "name", "entity_type", "source", "alt_names")
    return df.groupBy("id").agg(F.max_by(row, "ord").alias("x"), F.min("ord").alias("node_ord")).select("id", "x.*", "node_ord")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edge table from CSV; unreadable numbers become null."""
    text = ", ".join(f"{c.split()[0]} string" for c in schema.EDGE.split(", "))
    df = with_order(spark.read.schema(text).option("header", True).option("escape", '"').csv(path))
    return df.select("source", "target", "relation", (F.lower("essential") == "true").alias("essential"), F.col("evidence_count").try_cast("double").cast("bigint").alias("evidence_count"), F.nullif("proficiency_level", F.lit("")).alias("proficiency_level"), F.col("experience_years").try_cast("double").alias("experience_years"), F.col("ord").alias("edge_ord"))


def read_skillspan(spark: SparkSession, path: str) -> DataFrame:
    from skillweave.operators.bio import merge_tags

    ddl = "idx bigint, tokens array<string>, tags_skill array<string>, tags_knowledge array<string>, source string"
    df = with_order(read_jsonl(spark, path, ddl))
    labels = merge_tags(F.col("tags_skill"), F.col("tags_knowledge"))
    return df.select("ord", F.col("idx").cast("string").alias("id"), F.lit("en").alias("lang"), F.array_join("tokens", " ").alias("text"), "tokens", labels.alias("labels"), F.create_map(F.lit("source"), F.coalesce("source", F.lit(""))).alias("metadata"))


def read_config(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}
