"""Readers: JSON lines, judgement files, directories of documents, and office formats."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.functions.text import id_hash

#: Extensions that are read as documents and as images.
DOCUMENTS = ("txt", "md", "docx", "pptx", "xlsx", "pdf", "doc", "ppt", "xls", "hwp")
IMAGES = ("png", "jpg", "jpeg", "bmp", "gif", "tif", "tiff", "webp")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; blank and malformed lines are dropped, missing fields are null."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per JSON file; a file that can't be read gives a row of nulls."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def benchmark_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, title, text) of a corpus file with ``_id`` or ``id``."""
    raw = json_lines(spark, path, "_id string, id string, title string, text string")
    return raw.select(F.coalesce("_id", "id").alias("doc_id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id IS NOT NULL")


def benchmark_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(qid, doc_id, rel) of a tab-separated file with a header; short lines are dropped."""
    raw = spark.read.schema("qid string, doc_id string, rel string").option("sep", "\t").option("header", True).csv(path)
    return raw.select("qid", "doc_id", F.expr("try_cast(rel AS int)").alias("rel")).where("qid IS NOT NULL AND doc_id IS NOT NULL AND rel IS NOT NULL")


def benchmark_queries(spark: SparkSession, path: str, qrels: DataFrame) -> DataFrame:
    """(qid, text) of a query file, only those with a judgement."""
    raw = json_lines(spark, path, "_id string, id string, text string, query string")
    return raw.select(F.coalesce("_id", "id").alias("qid"), F.coalesce("text", "query").alias("text")).where("qid IS NOT NULL").join(qrels.select("qid").distinct(), "qid", "left_semi")


def question_benchmark(raw: DataFrame, order: str = "question_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Corpus, queries and judgements of a table with a row per question; the first row of a document counts, unanswerable questions judge nothing."""
    first = F.row_number().over(W.partitionBy("document_id").orderBy(order))
    corpus = raw.withColumn("_r", first).where("_r = 1").select(F.col("document_id").alias("doc_id"), F.lit("").alias("title"), F.col("document_extracted").alias("text"))
    queries = raw.select(F.col("question_id").alias("qid"), F.col("question").alias("text"))
    qrels = raw.where(F.col("answer") != "UNANSWERABLE").select(F.col("question_id").alias("qid"), F.col("document_id").alias("doc_id"), F.lit(1).alias("rel"))
    return corpus, queries, qrels


def scan_directory(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, path, ext, kind, size, modified_at) of all files below a directory, by extension; kind is document or image, other files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).drop("content")
    ext = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    kind = F.when(ext.isin(*DOCUMENTS), "document").when(ext.isin(*IMAGES), "image")
    named = files.select("path", ext.alias("ext"), kind.alias("kind"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at")).where("kind IS NOT NULL")
    return named.withColumn("file_id", id_hash("", 16, F.col("path"), F.col("size"), F.unix_timestamp("modified_at")))


def _text(data: bytes) -> list[str]:
    for code in ("utf-8-sig", "cp949"):
        try:
            return [x.strip() for x in data.decode(code).splitlines() if x.strip()]
        except UnicodeDecodeError:
            continue
    return [x.strip() for x in data.decode("utf-8", "replace").splitlines() if x.strip()]


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _paragraphs(root: ElementTree.Element, para: str = "p", run: str = "t") -> list[str]:
    out = []
    for p in root.iter():
        if _local(p.tag) == para:
            t = "".join(x.text or "" for x in p.iter() if _local(x.tag) == run).strip()
            if t:
                out.append(t)
    return out


def _tables(root: ElementTree.Element, table: str = "tbl", row: str = "tr", cell: str = "tc") -> list[str]:
    rows = []
    for t in root.iter():
        if _local(t.tag) == table:
            for r in t.iter():
                if _local(r.tag) == row:
                    rows.append(" | ".join(" ".join(_paragraphs(c)) for c in r if _local(c.tag) == cell))
    return rows


def _number(name: str) -> int:
    return int((re.findall(r"(\d+)\.xml$", name) or ["0"])[0])


def _docx(z: zipfile.ZipFile) -> list[str]:
    root = ElementTree.fromstring(z.read("word/document.xml"))
    cells = {id(p) for t in root.iter() if _local(t.tag) == "tbl" for p in t.iter() if _local(p.tag) == "p"}
    plain = ["".join(x.text or "" for x in p.iter() if _local(x.tag) == "t").strip() for p in root.iter() if _local(p.tag) == "p" and id(p) not in cells]
    return [p for p in plain if p] + _tables(root)


def _pptx(z: zipfile.ZipFile) -> list[str]:
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=_number)
    return [line for n in slides for line in _paragraphs(ElementTree.fromstring(z.read(n)))]


def _xlsx(z: zipfile.ZipFile) -> list[str]:
    shared: list[str] = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _local(si.tag) == "si"]
    rows = []
    for n in sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=_number):
        for r in ElementTree.fromstring(z.read(n)).iter():
            if _local(r.tag) != "row":
                continue
            cells = []
            for c in r:
                value = "".join(v.text or "" for v in c.iter() if _local(v.tag) in ("v", "t"))
                cells.append(shared[int(value)] if c.get("t") == "s" and value.isdigit() and int(value) < len(shared) else value)
            if any(cells):
                rows.append(" | ".join(cells))
    return rows


def _title(z: zipfile.ZipFile) -> tuple[str | None, str | None]:
    """Title and creation time that the document states of itself."""
    if "docProps/core.xml" not in z.namelist():
        return None, None
    core = {_local(e.tag): (e.text or "").strip() for e in ElementTree.fromstring(z.read("docProps/core.xml"))}
    return core.get("title") or None, core.get("created") or None


def extract_one(ext: str, data: bytes, hooks: dict[str, Callable[[bytes], list[str]]]) -> dict:
    """Lines, title, creation time, number of embedded images, and error of one file; a broken file gives an error, not a failure."""
    out = {"lines": [], "document_title": None, "document_created_at": None, "n_images": 0, "error": None}
    try:
        if ext in hooks:
            out["lines"] = hooks[ext](data)
        elif ext in ("txt", "md"):
            out["lines"] = _text(data)
        elif ext in ("docx", "pptx", "xlsx"):
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                out["lines"] = {"docx": _docx, "pptx": _pptx, "xlsx": _xlsx}[ext](z)
                out["document_title"], out["document_created_at"] = _title(z)
                out["n_images"] = sum(re.match(r"(?:word|ppt|xl)/media/", n) is not None for n in z.namelist())
        else:
            out["error"] = f"no reader for {ext}"
    except Exception as e:  # noqa: BLE001
        out["error"] = f"{type(e).__name__}: {e}"[:200]
    return out


def read_documents(spark: SparkSession, path: str, hooks: dict[str, Callable[[bytes], list[str]]] | None = None) -> DataFrame:
    """(file_id, path, ext, size, modified_at, title, text, document_title, document_created_at, n_images, error) of the documents below a directory.

    Text files, DOCX, PPTX and XLSX are read here; ``hooks`` add readers by
    extension (PDF, HWP, OCR), functions of bytes that return lines.  The
    title is the document's own, else the file's stem.
    """
    hooks = hooks or {}
    ext = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).withColumn("ext", ext).where(F.col("ext").isin(*DOCUMENTS))
    src = files.select("path", "ext", F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = pd.DataFrame([extract_one(e, bytes(c), hooks) for e, c in zip(f["ext"], f["content"])], columns=["lines", "document_title", "document_created_at", "n_images", "error"])
            out = f.drop(columns="content").reset_index(drop=True)
            out["text"] = [("\n".join(x)) for x in got["lines"]]
            for c in ("document_title", "document_created_at", "n_images", "error"):
                out[c] = got[c]
            yield out[["path", "ext", "size", "modified_at", "text", "document_title", "document_created_at", "n_images", "error"]]

    read = src.mapInPandas(run, "path string, ext string, size bigint, modified_at timestamp, text string, document_title string, document_created_at string, n_images int, error string")
    stem = F.regexp_extract("path", r"([^/\\]+)\.[^./\\]+$", 1)
    return read.withColumn("title", F.coalesce("document_title", stem)).withColumn("file_id", id_hash("", 16, F.col("path"), F.col("size"), F.unix_timestamp("modified_at")))


def _images(data: bytes) -> list[tuple[str, int | None, bytes]]:
    """(name, slide or None, content) of the images inside an office file, in the order of their names; the slide is the first that shows the image."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shown: dict[str, int] = {}
        for n in sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/_rels/slide\d+\.xml\.rels", n)), key=lambda n: int(re.findall(r"slide(\d+)", n)[-1])):
            for r in ElementTree.fromstring(z.read(n)):
                if "media/" in r.get("Target", ""):
                    shown.setdefault(r.get("Target").rsplit("/", 1)[-1], int(re.findall(r"slide(\d+)", n)[-1]))
        names = sorted(n for n in z.namelist() if re.match(r"(?:word|ppt|xl)/media/[^/]+$", n))
        return [(n.rsplit("/", 1)[-1], shown.get(n.rsplit("/", 1)[-1]), z.read(n)) for n in names]


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, path, image_name, slide_index, size, content): the images inside the DOCX, PPTX and XLSX files below a directory, a row for each.

    A broken file has no rows here; :func:`read_documents` gives its error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1)).isin("docx", "pptx", "xlsx")).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for p, data in zip(f["path"], f["content"]):
                try:
                    rows += [(p, name, slide, len(image), image) for name, slide, image in _images(bytes(data))]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError):
                    continue
            out = pd.DataFrame(rows, columns=["path", "image_name", "slide_index", "size", "content"])
            out["slide_index"] = out["slide_index"].astype("Int32")
            yield out

    found = files.mapInPandas(run, "path string, image_name string, slide_index int, size bigint, content binary")
    return found.withColumn("image_id", id_hash("", 16, F.col("path"), F.col("image_name")))


def has_text_layer(chars, pages):
    """Whether a scanned format holds enough text: 200 characters, or 50 a page."""
    return (F.coalesce(chars, F.lit(0)) >= 200) | (F.coalesce(chars, F.lit(0)) / F.greatest(F.coalesce(pages, F.lit(1)), F.lit(1)) >= 50)
