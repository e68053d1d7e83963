"""Files to documents: kind by leading bytes, text by kind, one row per file.

What a kind needs beyond the standard library (pages of a PDF, words in a picture) is a function
that the caller passes in ``extractors``; a kind without one gives an error row, not a guess."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Leading bytes (hex) of each kind of picture.
PICTURES = ["89504E47", "FFD8FF", "47494638", "424D", "49492A00", "4D4D002A"]
EOL = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85  ]"


def category(content: Column) -> Column:
    """PDF, DOCX, TXT, IMAGE or UNKNOWN by what a file begins with, whatever its name. Text is
    anything else without control bytes in its first 4096; an empty file is UNKNOWN."""
    head = F.hex(F.substring(content, 1, 8))
    plain = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    word = F.contains(F.decode(content, "ISO-8859-1"), F.lit("word/"))
    webp = head.startswith("52494646") & (F.hex(F.substring(content, 9, 4)) == "57454250")
    picture = webp
    for magic in PICTURES:
        picture = picture | head.startswith(magic)
    return (
        F.when(content.isNull() | (F.octet_length(content) == 0), "UNKNOWN").when(head.startswith("25504446"), "PDF")
        .when(head.startswith("504B0304") & word, "DOCX").when(head.startswith("D0CF11E0"), "DOCX").when(picture, "IMAGE")
        .when(plain.rlike(r"[\x00-\x06\x0e-\x1a]"), "UNKNOWN").otherwise("TXT")
    )


def plain_text(content: Column) -> Column:
    """UTF-8, or Latin-1 where the bytes aren't that."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def line_count(text: Column) -> Column:
    """Lines as ends of lines part them; an end at the end of the text begins no line."""
    bare = F.regexp_replace(text, rf"(?:{EOL})\z", "")
    return F.when(text == "", 0).otherwise(F.size(F.split(bare, EOL, -1)))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_paragraphs(content: bytes | None) -> list[str] | None:
    """Paragraphs of a word document outside tables; None for what can't be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    mark = {f"{_W}tab": "\t", f"{_W}br": "\n"}
    return ["".join(e.text or "" if e.tag == f"{_W}t" else mark.get(e.tag, "") for e in p.iter()) for p in (body if body is not None else ()) if p.tag == f"{_W}p"]


def docx(content: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(contents: pd.Series) -> pd.Series:
        return contents.map(docx_paragraphs)

    return run(content)


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, content of every file below ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")


SHORT = 50


def ingest(files: DataFrame, extractors: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """doc_id, source_type, source_path, title, raw_text, line_count, error of (path, content), in one pass
    over the files. The id is a hash of path and content, so a second run gives the same; UNKNOWN files go.
    A PDF whose text is under 50 characters is read again as SCANNED_PDF."""
    extract = {"TXT": plain_text, "DOCX": lambda c: F.array_join(docx(c), "\n")} | (extractors or {})
    content, kind = F.col("content"), F.col("source_type")
    # each extractor gets the content of its own kind only
    given = {k: F.when(kind == k, content) for k in ("TXT", "DOCX", "PDF", "IMAGE")}
    texts = [F.when(kind == k, extract[k](c)) for k, c in given.items() if k in extract]
    rows = files.select("path", "content", category(content).alias("source_type")).where("source_type <> 'UNKNOWN'")
    rows = rows.withColumn("raw_text", F.coalesce(*texts))
    if "SCANNED_PDF" in extract:
        short = (kind == "PDF") & (F.length(F.trim(F.coalesce("raw_text", F.lit("")))) < SHORT)
        rows = rows.withColumn("source_type", F.when(short, "SCANNED_PDF").otherwise(kind))
        rows = rows.withColumn("raw_text", F.when(kind == "SCANNED_PDF", extract["SCANNED_PDF"](F.when(kind == "SCANNED_PDF", content))).otherwise(F.col("raw_text")))
    return rows.select(
        F.sha2(F.concat(F.encode("path", "UTF-8"), "content"), 256).alias("doc_id"), "source_type", F.col("path").alias("source_path"), F.element_at(F.split("path", "/"), -1).alias("title"), "raw_text",
        line_count(F.col("raw_text")).alias("line_count"), F.when(F.col("raw_text").isNull(), F.concat(F.lit("no extractor or unreadable: "), "source_type")).alias("error"),
    )


def pdf_text(pages: Column) -> Column:
    """The text of a PDF of array<struct<text, images: array<string>>>, one for each page: its words if it has
    any, then what was found in each of its pictures, headed by number and page. A picture that couldn't
    be read is null and leaves no trace."""

    def page(p: Column, i: Column) -> Column:
        told = F.transform(F.coalesce(p["images"], F.array().cast("array<string>")), lambda text, k: F.when(F.trim(text) != "", F.concat(F.format_string("--- Embedded Image %d on Page %d ---\n", k + 1, i + 1), text)))
        return F.concat(F.array_compact(F.array(F.when(F.trim(p["text"]) != "", p["text"]))), F.array_compact(told))

    return F.array_join(F.flatten(F.transform(pages, page)), "\n")


def image_documents(files: DataFrame, ocr: Callable[[Column], Column] | None = None, caption: Callable[[Column], Column] | None = None, embedder: Callable[[Column], Column] | None = None) -> DataFrame:
    """doc_id, source_type, source_path, title, raw_text, detections, caption, image_embedding of pictures.
    ``ocr`` gives the words found in a picture as an array, joined by spaces; ``caption`` a text; ``embedder`` a
    vector. One that is missing or fails (null) leaves its column empty, and the picture stays."""
    rows = files.select("path", "content", category(F.col("content")).alias("source_type")).where("source_type = 'IMAGE'")
    made = lambda use, kind: F.lit(None).cast(kind) if use is None else use(F.col("content")).cast(kind)
    rows = rows.withColumn("words", made(ocr, "array<string>")).withColumn("caption", F.coalesce(made(caption, "string"), F.lit(""))).withColumn("image_embedding", made(embedder, "array<float>"))
    return rows.select(
        F.sha2(F.concat(F.encode("path", "UTF-8"), "content"), 256).alias("doc_id"), "source_type", F.col("path").alias("source_path"), F.element_at(F.split("path", "/"), -1).alias("title"),
        F.coalesce(F.array_join("words", " "), F.lit("")).alias("raw_text"), F.coalesce(F.size("words"), F.lit(0)).alias("detections"), "caption", "image_embedding",
    )
