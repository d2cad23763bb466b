"""Files as sources and sinks: text, HTML, JSON, folders, logs, sheets, index folders."""

from __future__ import annotations

import hashlib
import html
import io
import json
import re
import unicodedata
import uuid
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemill.functions import text as T

SKIPPED = ("readme", "license", "changelog", "agents")
SUFFIXES = ("txt", "md", "markdown", "json", "html", "htm", "pdf")
#: Metadata fields of a document; all text but page.
FIELDS = ("source_id", "title", "organization", "source_url", "publication_date", "jurisdiction", "language", "section", "document_hash", "source_version", "review_status", "reviewed_by", "reviewed_at")


class _Blocks(HTMLParser):
    """Headings, paragraphs and list items in order; nothing from scripts, styles and drawings."""

    DROPPED = {"script", "style", "noscript", "svg"}
    KEPT = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.title, self.tag, self.text, self.dropped, self.in_title = "", None, [], 0, False

    def close_block(self) -> None:
        if self.tag:
            said = " ".join("".join(self.text).split())
            if said:
                self.blocks.append(f"{'#' * int(self.tag[1])} {said}" if self.tag[0] == "h" else said)
        self.tag, self.text = None, []

    def handle_starttag(self, tag, attrs):
        if tag in self.DROPPED:
            self.dropped += 1
        elif tag == "title":
            self.in_title = True
        elif tag in self.KEPT:
            self.close_block()
            self.tag = tag

    def handle_endtag(self, tag):
        if tag in self.DROPPED:
            self.dropped = max(0, self.dropped - 1)
        elif tag == "title":
            self.in_title = False
        elif tag == self.tag:
            self.close_block()

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif self.tag and not self.dropped:
            self.text.append(data)


def _html(page: str | None) -> tuple[str, str]:
    parser = _Blocks()
    parser.feed(page or "")
    parser.close()
    parser.close_block()
    return " ".join(parser.title.split()), "\n\n".join(parser.blocks)


def html_text(html: Column) -> Column:
    """A struct of title and text of a page; one pass of a parser in Arrow batches (the JVM has none)."""

    def parse(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_html(p) for p in pages], columns=["title", "text"])

    return F.pandas_udf(parse, "title string, text string")(html)


HEADING = re.compile(r"^(#{1,6})\s+(.+)$")


Unit = tuple[str, bool]


def _fill(units: Iterable[Unit], size: int, glue: str, carry: Callable[[str], str] = lambda s: "") -> Iterator[str]:
    """Units (text, stands alone) joined as long as they fit; what follows a full one begins with its carry, if that fits."""
    held = ""
    for text, alone in units:
        joined = held + glue + text if held else text
        if held and (alone or len(joined) > size):
            yield held
            start = carry(held)
            joined = start + glue + text if start and len(start + glue + text) <= size else text
        if alone:
            yield text
        held = "" if alone else joined
    if held:
        yield held


def _sentences(block: str, size: int) -> Iterator[Unit]:
    """Sentences; of a longer one its parts, cut at the last space of the second half or, without one, anywhere."""
    for sentence in re.split(r"(?<=[.!?。！？])\s+", block):
        while len(sentence) > size:
            space = sentence.rfind(" ", size // 2, size + 1)
            head, sentence = sentence[: space if space > 0 else size], sentence[space if space > 0 else size :].strip()
            yield head.strip(), True
        if sentence:
            yield sentence, False


def _sections(text: str) -> Iterator[tuple[str | None, list[str]]]:
    """A section's name and its blocks: its heading, if it has one, and the paragraphs up to the next."""
    name, blocks = None, []
    for paragraph in re.split(r"\n\s*\n", text):
        lines: list[str] = []
        for line in map(str.strip, paragraph.splitlines()):
            head = HEADING.match(line)
            if head:
                yield name, [*blocks, "\n".join(lines)] if lines else blocks
                name, blocks, lines = head[2].strip(), [line], []
            elif line:
                lines.append(line)
        blocks += ["\n".join(lines)] if lines else []
    yield name, blocks


def _chunks(text: str | None, size: int, overlap: int) -> list[tuple[int, str | None, str]]:
    def tail(s: str) -> str:
        end = s[-overlap:] if overlap else ""
        return end.partition(" ")[2].strip() if " " in end else end.strip()

    out: list[tuple[int, str | None, str]] = []
    for name, blocks in _sections(text or ""):
        pieces = (p for b in blocks for p in ([b] if len(b) <= size else _fill(_sentences(b, size), size, " ")))
        for chunk in _fill(((p, False) for p in pieces), size, "\n\n", tail):
            flat = re.sub(r"[\t \f\v]+", " ", chunk).strip()
            if flat:
                out.append((len(out), name, flat))
    return out


def unescaped(c: Column) -> Column:
    """Text with its HTML entities as characters (no built-in knows them all)."""
    return F.when(F.contains(c, F.lit("&")), F.pandas_udf(lambda x: x.map(html.unescape, na_action="ignore"), "string")(c)).otherwise(c)


def chunks(rows: DataFrame, id_col: str, text_col: str, size: int = 700, overlap: int = 100) -> DataFrame:
    """id, ordinal, section, chunk, chunk_id: texts in chunks of at most `size` characters that overlap and don't cross headings."""
    if size < 100 or not 0 <= overlap < size:
        raise ValueError("size must be 100 or more, and overlap less than it")
    kind = "array<struct<ordinal:int,section:string,text:string>>"

    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"ordinal": i, "section": s, "text": x} for i, s, x in _chunks(t, size, overlap)])

    split = rows.select(F.col(id_col).alias("id"), F.sha2(text_col, 256).alias("h"), F.explode(F.pandas_udf(cut, kind)(F.col(text_col))).alias("c"))
    name = F.sha2(F.concat_ws("|", "h", F.lit(""), F.coalesce("c.section", F.lit("")), F.col("c.ordinal").cast("string"), "c.text"), 256)
    return split.select("id", "c.ordinal", "c.section", F.col("c.text").alias("chunk"), name.alias("chunk_id"))


def _normalized(text: str) -> str:
    """T.normalize(T.nfkc()) in Python."""
    text = re.sub("\r\n?", "\n", unicodedata.normalize("NFKC", text))
    text = re.sub(" ?\n ?", "\n", re.sub("[\t \f\x0b]+", " ", text))
    return re.sub("\n{3,}", "\n\n", text).strip(" \n")


def normalized_chunks(rows: DataFrame, id_col: str, text_col: str, size: int = 700, overlap: int = 100, at_once: int = 256) -> DataFrame:
    """chunks() of normalised texts (null: none), with a hash of each normalised chunk, by one Python worker a task that holds a few texts at a time."""
    if size < 100 or not 0 <= overlap < size:
        raise ValueError("size must be 100 or more, and overlap less than it")
    sha = lambda x: hashlib.sha256(x.encode())
    names = ("ordinal", "section", "chunk", "chunk_id", "hash")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, at_once):
                part = batch.slice(lo, at_once)
                out: list[tuple] = []
                for row, text in enumerate(part.column(1).to_pylist()):
                    flat = _normalized(text or "")
                    h = sha(flat).hexdigest()
                    out += [(row, i, section, x, sha(f"{h}||{section or ''}|{i}|{x}").hexdigest(), sha(_normalized(x)).digest()) for i, section, x in _chunks(flat, size, overlap)]
                if out:
                    row, *columns = zip(*out, strict=True)
                    kinds = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.binary())
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["id", *names])

    picked = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(cut, StructType([picked.schema["id"], *StructType.fromDDL("ordinal int, section string, chunk string, chunk_id string, hash binary").fields]))


def folder(spark: SparkSession, path: str) -> DataFrame:
    """path, suffix, content of the documents of a folder and those below it; notes about the folder and sidecars are no documents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    stem, suffix = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"\.([^.]*)$", 1)
    return files.select("path", "content", stem.alias("stem"), suffix.alias("suffix")).where(F.col("suffix").isin(*SUFFIXES) & ~F.col("stem").isin(*SKIPPED) & ~F.col("path").endswith(".metadata.json")).drop("stem")


def sidecars(spark: SparkSession, path: str) -> DataFrame:
    """of (path of the document) and its metadata fields, from <file>.metadata.json files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.metadata.json").load(path)
    body = F.from_json(F.decode("content", "UTF-8"), ", ".join(f"{f} string" for f in FIELDS) + ", page int")
    return files.select(F.regexp_replace("path", r"\.metadata\.json$", "").alias("of"), body.alias("m")).select("of", "m.*")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """path, text and metadata of the documents of a folder: text by format, fields from sidecars, blanks as null, review_status unreviewed by default."""
    files = folder(spark, path)
    if not _reads_pdf() and files.where("suffix = 'pdf'").limit(1).count():
        raise NotImplementedError("PDF files need pypdf, which is not installed")
    raw = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    plain = files.where(F.col("suffix").isin("txt", "md", "markdown")).select("path", "content", raw.alias("text"), F.lit(None).cast("string").alias("own_title"))
    page = files.where(F.col("suffix").isin("html", "htm")).select("path", "content", html_text(raw).alias("p")).select("path", "content", F.col("p.text").alias("text"), F.nullif("p.title", F.lit("")).alias("own_title"))
    body = files.where("suffix = 'json'").select("path", F.explode(json_records(raw)).alias("r"))
    items = body.select("path", F.col("r.record").cast("binary").alias("content"), "r.text", F.lit(None).cast("string").alias("own_title"), "r.own")
    sheets = files.where("suffix = 'pdf'").select("path", "content", F.explode(pdf_pages(F.col("content"))).alias("p")).select("path", "content", F.col("p.text").alias("text"), F.col("p.title").alias("own_title"), F.col("p.page").alias("own_page"))
    found = plain.unionByName(page).unionByName(items, allowMissingColumns=True).unionByName(sheets, allowMissingColumns=True).withColumn("text", T.normalize(F.col("text"))).where("text <> ''")
    side = sidecars(spark, path)
    # a record's own fields stand before the sidecar's
    given = lambda f: F.coalesce(F.nullif(F.trim(F.try_element_at("own", F.lit(f))), F.lit("")), F.nullif(F.trim(F.col(f)), F.lit("")))
    fields = [given(f).alias(f) for f in FIELDS if f not in ("title", "document_hash", "review_status")]
    title = F.coalesce(given("title"), F.nullif("own_title", F.lit(""))).alias("title")
    number = F.coalesce("own_page", F.try_element_at("own", F.lit("page")).try_cast("int"), "page").alias("page")
    return found.join(side, F.col("path") == F.col("of"), "left").select("path", "text", title, F.sha2("content", 256).alias("document_hash"), *fields, number, F.coalesce(given("review_status"), F.lit("unreviewed")).alias("review_status"))


def json_records(text: Column) -> Column:
    """An array of (text, record, own) of a JSON file: a list, the list under `documents`, or one record; a record can be a string.

    text is the record's text, or its content. record is its canonical JSON (keys sorted), which names it. own has its fields, with those of a
    nested `metadata` behind them. A file that isn't JSON is an error.
    """
    kind = "array<struct<text:string,record:string,own:map<string,string>>>"

    def one(raw: str | None) -> list[dict]:
        body = json.loads(raw) if raw and raw.strip() else []
        records = body if isinstance(body, list) else body["documents"] if isinstance(body.get("documents"), list) else [body]
        out = []
        for r in records:
            r = {"text": r} if isinstance(r, str) else r
            nested = r.get("metadata") if isinstance(r.get("metadata"), dict) else {}
            own = {k: str(v) for k, v in (nested | r).items() if k in (*FIELDS, "page") and v is not None}
            said = r.get("text") if r.get("text") is not None else r.get("content")
            out.append({"text": None if said is None else str(said), "record": json.dumps(r, sort_keys=True, ensure_ascii=False, separators=(",", ":")), "own": own})
        return out

    return F.pandas_udf(lambda rows: rows.map(one), kind)(text)


def _reads_pdf() -> bool:
    try:
        import pypdf  # noqa: F401
    except ImportError:
        return False
    return True


def pages_of_pdf(data: bytes) -> list[dict]:
    """page (from 1), text and title of a PDF file's pages that aren't empty. Needs pypdf, which is optional."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ImportError("PDF files need pypdf, which is not installed") from e
    reader = PdfReader(io.BytesIO(data))
    title = getattr(reader.metadata, "title", None)
    pages = ((i, p.extract_text() or "") for i, p in enumerate(reader.pages, 1))
    return [{"page": i, "text": t, "title": title} for i, t in pages if t.strip()]


def pdf_pages(content: Column) -> Column:
    """An array of pages_of_pdf(); without pypdf a PDF file is an error."""
    return F.pandas_udf(lambda rows: rows.map(pages_of_pdf), "array<struct<page:int,text:string,title:string>>")(content)


def log_lines(spark: SparkSession, path: str, step: str) -> DataFrame:
    """value: the lines of log files, each file decoded in that one of two encodings (UTF-8, UTF-16) in which more of it tells a step."""

    def one(data: bytes) -> list[str]:
        texts = [data.decode(c, "ignore").lstrip("\ufeff") for c in ("utf-8", "utf-16")]
        return max(texts, key=lambda t: len(re.findall(rf"{step}[=: ]+[0-9]", t))).splitlines()

    files = spark.read.format("binaryFile").load(path)
    return files.select(F.explode(F.pandas_udf(lambda rows: rows.map(one), "array<string>")("content")).alias("value"))


def log_series(lines: DataFrame, step: str, name: str) -> DataFrame:
    """step, value of each `name`: number in log lines that also tell their step."""
    at = F.regexp_extract("value", rf"{step}[=: ]+([0-9]+)", 1)
    found = F.regexp_extract("value", rf"{name}[=: ]+([0-9.eE+-]+)", 1)
    return lines.where((at != "") & (found != "")).select(at.cast("long").alias("step"), found.cast("double").alias("value"))


def _move(spark: SparkSession, old: str, new: str, replace: bool) -> None:
    jvm = spark._jvm.org.apache.hadoop.fs
    a, b = jvm.Path(old), jvm.Path(new)
    store = b.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(b):
        if not replace:
            raise FileExistsError(new)
        store.delete(b, True)
    if not store.rename(a, b):
        raise OSError(f"{old} could not be moved to {new}")


def write_index(tables: dict[str, DataFrame], path: str, replace: bool = False) -> None:
    """Tables of an index, all or none: they are written beside their place, and moved there at the end. An index is replaced only on request."""
    spark = next(iter(tables.values())).sparkSession
    staged = f"{path}.{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{staged}/{name}")
    _move(spark, staged, path, replace)


def read_index(spark: SparkSession, path: str, dim: int) -> dict[str, DataFrame]:
    """chunks and vectors of an index, after its checks: both are there, a vector for each chunk, all of dimension dim."""
    out = {name: spark.read.parquet(f"{path}/{name}") for name in ("chunks", "vectors")}
    n = out["chunks"].count()
    v = out["vectors"].agg(F.count("*").alias("n"), F.coalesce(F.min(F.size("v")), F.lit(dim)).alias("low"), F.coalesce(F.max(F.size("v")), F.lit(dim)).alias("high")).first()
    if v["n"] != n or v["low"] != dim or v["high"] != dim:
        raise ValueError(f"{n} chunks, {v['n']} vectors of {v['low']} to {v['high']} dimensions; {dim} are expected")
    return out
