"""File corpora: discovery, text, JSON lines and binary documents, as one table."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.text import python_text, strip
from assayer.operators.chunking import check_overlap, recursive_chunks
from assayer.operators.positions import number_in_place, with_position
from assayer.session import materialize

# File extensions by the way a file is read.
TEXT_EXTENSIONS = (".txt", ".md")
JSONL_EXTENSIONS = (".jsonl",)
PDF_EXTENSIONS = (".pdf",)
DOCX_EXTENSIONS = (".docx",)
SUPPORTED_EXTENSIONS = TEXT_EXTENSIONS + JSONL_EXTENSIONS + PDF_EXTENSIONS + DOCX_EXTENSIONS

# Lines (or pages) whose chunk counts go to every task at most, and lines whose counts are summed up together.
_SENT_UNITS, _STRETCH_UNITS = 200_000, 10_000

# A paged extractor turns the bytes of one document into the texts of its pages.
Extractor = Callable[[bytes], list[str]]

_PAGES = T.ArrayType(
    T.StructType([T.StructField("page", T.LongType()), T.StructField("text", T.StringType())])
)


def allowed_extensions(extensions: Sequence[str] | None) -> list[str]:
    """Lower case with a leading dot; nothing given means all supported ones."""
    given = [e for e in extensions or () if e]
    return ["." + e.lower().removeprefix(".") for e in given] if extensions else list(SUPPORTED_EXTENSIONS)


def extension(path: Column) -> Column:
    """The lower-case extension of a path, dot included; '' if the name has none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def corpus_locations(config: Mapping[str, Any]) -> list[str]:
    """The configured paths and patterns; an error if there are none."""
    locations = [str(p) for p in config.get("paths", [])]
    locations += [str(config[key]) for key in ("path", "glob") if config.get(key)]
    if not locations:
        raise ValueError("A file corpus needs 'path', 'paths' or 'glob'")
    return locations


def discover(
    spark: SparkSession,
    locations: Sequence[str],
    extensions: Sequence[str] | None = None,
    recursive: bool = True,
) -> DataFrame:
    """The files under the locations: ``path, extension, length``, each once, by path.

    Only the listing is used; the content column is pruned, so no file is opened. A
    location that does not exist is an error, as is a pattern that matches nothing.
    """
    allowed = allowed_extensions(extensions)
    files = _files(spark, locations, "binaryFile", allowed, recursive)
    wanted = files.select("path", extension(F.col("path")).alias("extension"), "length")
    kept = wanted.where(F.col("extension").isin(allowed))
    return kept.distinct().orderBy("path")


def _files(
    spark: SparkSession,
    locations: Sequence[str],
    fmt: str,
    extensions: Sequence[str],
    recursive: bool,
    **options,
) -> DataFrame:
    """Files with one of the extensions; the others are dropped from the listing."""
    either_case = (
        "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions
    )
    reader = spark.read.format(fmt).option("pathGlobFilter", "*{" + ",".join(either_case) + "}")
    reader = reader.option("recursiveFileLookup", str(recursive).lower())
    return reader.options(**options).load(list(locations))


def plain_path(uri: Column) -> Column:
    """The path that a file's metadata gives percent-encoded, as listings of files spell it."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def _with_extension(df: DataFrame, extensions: Sequence[str]) -> DataFrame:
    return df.where(extension(F.col("source")).isin(list(extensions)))


def read_texts(
    spark: SparkSession,
    locations: Sequence[str],
    extensions: Sequence[str] = TEXT_EXTENSIONS,
    recursive: bool = True,
) -> DataFrame:
    """Whole UTF-8 files: ``text, source``."""
    files = _files(spark, locations, "text", extensions, recursive, wholetext="true")
    texts = files.select(F.col("value").alias("text"), plain_path(F.col("_metadata.file_path")).alias("source"))
    return _with_extension(texts, extensions)


def read_jsonl(
    spark: SparkSession,
    locations: Sequence[str],
    content: str = "text",
    extensions: Sequence[str] = JSONL_EXTENSIONS,
    recursive: bool = True,
    strict: bool = True,
) -> DataFrame:
    """JSON lines: ``text, source, line_number``, with blank lines neither read nor counted.

    ``content`` is a key or a path such as ``a.b[0]``. A line that is no object is its own
    text. Content that is missing or null is ''; with ``strict``, content that is not a
    text is an error, otherwise its JSON text is taken. A large file is read as several
    splits; lines are numbered per split and shifted by the lines of the splits before it.
    """
    lines = (
        _files(spark, locations, "text", extensions, recursive)
        .select(
            F.col("value"),
            plain_path(F.col("_metadata.file_path")).alias("source"),
            F.col("_metadata.file_block_start").alias("_split"),
        )
        .where(strip(F.col("value")) != "")
    )
    numbered = number_in_place(
        _with_extension(lines, extensions), "_split", ["source"], "line_number", start=1
    )
    return numbered.select(
        json_content(F.col("value"), content, strict).alias("text"), "source", "line_number"
    )


def json_content(line: Column, content: str = "text", strict: bool = True) -> Column:
    """The text that ``content`` names in a JSON line."""
    value = F.parse_json(line)
    whole_kind = F.schema_of_variant(value)
    path = "$" + (content if content.startswith(("[", ".")) else f".{content}")
    inner = F.try_variant_get(value, path, "variant")
    kind = F.schema_of_variant(inner)
    text = F.try_variant_get(value, path, "string")
    if strict:
        failure = F.raise_error(F.concat(F.lit(f"Content '{content}' is no text in: "), line))
        text = F.when(kind == "STRING", text).otherwise(failure.cast("string"))
    number = python_text(F.try_variant_get(value, "$", "double"), T.DoubleType())
    flag = python_text(F.try_variant_get(value, "$", "boolean"), T.BooleanType())
    return (
        F.when(whole_kind == "VOID", F.lit("None"))
        .when(whole_kind == "BOOLEAN", flag)
        .when(whole_kind.rlike("^(DOUBLE|FLOAT|DECIMAL)"), number)
        .when(~whole_kind.startswith("OBJECT"), F.try_variant_get(value, "$", "string"))
        .when(inner.isNull() | (kind == "VOID"), F.lit(""))
        .otherwise(text)
    )


def docx_text(content: bytes) -> list[str]:
    """The text of a word-processor file, as a single page."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = archive.namelist()
        parts = [n for n in names if n.startswith("word/header") and n.endswith(".xml")]
        parts += ["word/document.xml"]
        parts += [n for n in names if n.startswith("word/footer") and n.endswith(".xml")]
        text = "".join(_xml_text(archive.read(part)) for part in parts)
    return [text.strip()]


# Elements of a word-processor file and the text each one stands for.
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_BREAKS = {f"{_WORD}tab": "\t", f"{_WORD}br": "\n", f"{_WORD}cr": "\n", f"{_WORD}p": "\n\n"}


def _xml_text(xml: bytes) -> str:
    return "".join(
        (node.text or "") if node.tag == f"{_WORD}t" else _BREAKS.get(node.tag, "")
        for node in ElementTree.fromstring(xml).iter()
    )


def _pages_of(extractor: Extractor, content: str) -> Column:
    """The pages of each document in order, as an array of (page, text)."""

    @F.pandas_udf(_PAGES)
    def pages(contents: pd.Series) -> pd.Series:
        return contents.map(
            lambda c: [{"page": i, "text": t} for i, t in enumerate(extractor(bytes(c)))]
        )

    return pages(F.col(content))


def extract_pages(documents: DataFrame, extractor: Extractor, content: str = "content") -> DataFrame:
    """One row per page of every binary document: adds ``text, page`` (from 0)."""
    kept = [c for c in documents.columns if c != content]
    found = documents.select(*kept, F.explode(_pages_of(extractor, content)).alias("_page"))
    return found.select(*kept, "_page.text", "_page.page")


def extract_texts(documents: DataFrame, extractor: Extractor, content: str = "content") -> DataFrame:
    """One row per binary document: adds ``text``, its pages joined by line breaks and trimmed.

    The pages of a document are joined where they were read.
    """
    kept = [c for c in documents.columns if c != content]
    texts = F.transform(_pages_of(extractor, content), lambda page: F.coalesce(page["text"], F.lit("")))
    return documents.select(*kept, strip(F.array_join(texts, "\n")).alias("text"))


def read_binary(
    spark: SparkSession,
    locations: Sequence[str],
    extractor: Extractor,
    extensions: Sequence[str],
    recursive: bool = True,
) -> DataFrame:
    """Extracted pages of binary files: ``source, text, page``."""
    files = _files(spark, locations, "binaryFile", extensions, recursive)
    named = _with_extension(files.select(F.col("path").alias("source"), "content"), extensions)
    return extract_pages(named, extractor)


def normalize_metadata(
    docs: DataFrame, include_metadata: bool = True, number_chunks: bool = False
) -> DataFrame:
    """The common corpus columns of documents or chunks.

    ``source`` doubles as ``source_path``; a chunk start gets its end. ``chunk_index``
    counts the chunks of a file over all its lines and pages; a file of any size is
    numbered by many tasks.
    """
    if not include_metadata:
        return docs.select("text")
    columns = docs.columns
    derived = {}
    if "source" in columns and "source_path" not in columns:
        derived["source_path"] = F.col("source")
    if "start_index" in columns and "chunk_start" not in columns:
        derived["chunk_start"] = F.col("start_index")
        derived["chunk_end"] = F.col("start_index") + F.length("text")
    docs = docs.withColumns(derived) if derived else docs
    if number_chunks and "chunk_index" not in columns:
        docs = _numbered_chunks(docs)
    return docs


def _numbered_chunks(docs: DataFrame) -> DataFrame:
    """Adds ``chunk_index`` by file, over lines and pages.

    A chunk's place in its text (``_piece``) is its number where a file is one text. With lines or pages the
    chunks are written as they lie, and what the lines before hold is summed up in a small table, by
    stretches of lines first, so that texts do not move. Only where that table is too large to be sent, or
    the place is unknown, are chunks laid out anew.
    """
    units = [c for c in ("line_number", "page") if c in docs.columns]
    if "_piece" in docs.columns and not units:
        return docs.withColumn("chunk_index", F.col("_piece").cast("long")).drop("_piece")
    if "_piece" in docs.columns:
        docs = materialize(docs, "chunks")
        counts = docs.groupBy("source_path", *units).agg(F.count("*").alias("n"), (F.max("_piece") + 1).alias("pieces"))
        counts = materialize(counts.withColumn("stretch", F.floor(F.col(units[0]) / _STRETCH_UNITS)), "chunk-counts")
        if counts.count() <= _SENT_UNITS and counts.where("n <> pieces").isEmpty():
            sums = counts.groupBy("source_path", "stretch").agg(F.sum("n").alias("n"))
            earlier = Window.partitionBy("source_path").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
            sums = sums.select("source_path", "stretch", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
            inside = Window.partitionBy("source_path", "stretch").orderBy(*units).rowsBetween(Window.unboundedPreceding, -1)
            offsets = counts.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0)))
            same = [offsets[c].eqNullSafe(sums[c]) for c in ("source_path", "stretch")]
            offsets = offsets.join(F.broadcast(sums), same).select(*(offsets[c].alias(f"_{c}") for c in ("source_path", *units)), (F.col("before") + F.col("within")).alias("_offset"))
            same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("source_path", *units)]
            joined = docs.join(F.broadcast(materialize(offsets, "chunk-offsets")), same)
            return joined.select(*(c for c in docs.columns if c != "_piece"), (F.col("_offset") + F.col("_piece")).alias("chunk_index"))
    order = [c for c in (*units, "start_index", "_piece") if c in docs.columns]
    return with_position(docs, order, within=["source_path"], name="chunk_index").drop("_piece")


def read_corpus(
    spark: SparkSession,
    config: Mapping[str, Any],
    pdf_extractor: Extractor | None = None,
) -> DataFrame:
    """A file corpus as ``text`` and its metadata columns.

    ``config`` takes ``path, paths, glob, extensions, recursive, chunk_size,
    chunk_overlap, include_metadata, json_content_key, json_path`` and ``json_jq_schema``, of
    whose programs only paths are taken (``.a.b[0]``). PDF files need an extractor.
    """
    size = int(config.get("chunk_size") or 0)
    overlap = int(config.get("chunk_overlap", 0))
    check_overlap(size, overlap)
    locations = corpus_locations(config)
    wanted = allowed_extensions(config.get("extensions"))
    recursive = bool(config.get("recursive", True))
    present = {
        row["extension"]
        for row in discover(spark, locations, wanted, recursive).select("extension").distinct().collect()
    }

    def of(kind: Sequence[str]) -> list[str]:
        return [e for e in kind if e in present]

    frames = []
    if of(TEXT_EXTENSIONS):
        frames.append(read_texts(spark, locations, of(TEXT_EXTENSIONS), recursive))
    if of(JSONL_EXTENSIONS):
        content = config.get("json_path") or _plain_program(config.get("json_jq_schema")) or config.get("json_content_key", "text")
        frames.append(read_jsonl(spark, locations, content, of(JSONL_EXTENSIONS), recursive))
    if of(DOCX_EXTENSIONS):
        documents = read_binary(spark, locations, docx_text, of(DOCX_EXTENSIONS), recursive)
        frames.append(documents.drop("page"))
    if of(PDF_EXTENSIONS):
        if pdf_extractor is None:
            raise ValueError("PDF files need a pdf_extractor")
        frames.append(read_binary(spark, locations, pdf_extractor, of(PDF_EXTENSIONS), recursive))
    if not frames:
        raise ValueError("The file corpus holds no documents")
    docs = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    if size > 0:
        docs = chunk_documents(docs, size, overlap)
    return normalize_metadata(docs, bool(config.get("include_metadata", True)), size > 0)


def _plain_program(program: str | None) -> str | None:
    """The path that a program consists of; anything else is an error."""
    if program is None:
        return None
    if not re.fullmatch(r"(\.\w+(\[\d+\])*)+", program.strip()):
        raise ValueError(f"json_jq_schema: only a path such as .a.b[0] is taken, not {program}")
    return program.strip().removeprefix(".")


def chunk_documents(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """Documents cut into chunks that replace ``text``, with ``start_index``.

    ``_piece`` keeps the order of chunks that start at the same place.
    """
    cut = recursive_chunks(docs, "text", size, overlap)
    return cut.select(
        *(c for c in docs.columns if c != "text"),
        F.col("chunk").alias("text"),
        F.col("chunk_start").alias("start_index"),
        F.col("chunk_index").alias("_piece"),
    )
