"""Packs: a book's structure and its prose apart, and together again; JSON and archive readers."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROSE = ("title", "desc", "fate", "note")


def split(chars: DataFrame, prose: tuple[str, ...] = PROSE) -> tuple[DataFrame, DataFrame]:
    """(structure, prose): empty prose is left out, so absent, null and '' are one."""
    own = [c for c in prose if c in chars.columns]
    empty = lambda c: F.when(F.col(c) != "", F.col(c))
    text = chars.select("id", *[empty(c).alias(c) for c in own])
    return chars.drop(*own), text.where(F.coalesce(*own).isNotNull())


def merge(structure: DataFrame, text: DataFrame) -> DataFrame:
    return structure.join(text, "id", "left")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, with the side."""
    cols = a.columns
    return a.select(cols).exceptAll(b.select(cols)).withColumn("side", F.lit("first")).unionByName(b.select(cols).exceptAll(a.select(cols)).withColumn("side", F.lit("second")))


def read_book(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A book's JSON document, one row."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_pack(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A script pack: ``module.exports = {...};`` around JSON."""
    raw = spark.read.text(path, wholetext=True)
    body = F.regexp_replace(F.regexp_replace("value", r"(?s)^\s*module\.exports\s*=\s*", ""), r";\s*$", "")
    return raw.select(F.from_json(body, schema).alias("book")).select("book.*")


def clean_html(html: str) -> str:
    """Text of a page: no scripts or styles, block ends as line breaks, entities decoded, blank runs joined."""
    from html import unescape

    html = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", "", html)
    html = re.sub(r"(?i)<br\s*/?>|</(p|div|h[1-6]|li|tr|blockquote|section)\s*>", "\n", html)
    text = unescape(re.sub(r"(?s)<[^>]*>", "", html)).replace("\r", "")
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t　]+", " ", text)).strip()


def read_epub(spark: SparkSession, path: str) -> DataFrame:
    """(path, nth, href, text): documents of archives in spine order."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    names = z.namelist()
                    opf = next((n for n in names if n.endswith(".opf")), None)
                    hrefs = [n for n in names if re.search(r"\.x?html?$", n)]
                    if opf:
                        spine = z.read(opf).decode("utf-8", "replace")
                        ids = {}
                        for tag in re.findall(r"<item\b[^>]*>", spine):
                            i, h = re.search(r'\bid="([^"]+)"', tag), re.search(r'\bhref="([^"]+)"', tag)
                            if i and h:
                                ids[i[1]] = h[1]
                        base = opf.rpartition("/")[0]
                        ordered = [f"{base}/{ids[i]}".lstrip("/") for i in re.findall(r'<itemref\b[^>]*idref="([^"]+)"', spine) if i in ids]
                        hrefs = [h for h in ordered if h in names] or hrefs
                    texts = [clean_html(z.read(h).decode("utf-8", "replace")) for h in hrefs]
                n = len(hrefs)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array(hrefs, pa.string()), pa.array(texts, pa.string())], ["path", "nth", "href", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, "path string, nth int, href string, text string")


def optional(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, bool]:
    """(rows, judged): a missing side file is empty and not judged, which isn't the same as no findings."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.read.schema(schema).json(path), True
    return spark.createDataFrame([], schema), False


def export_view(nodes: DataFrame, links: DataFrame, text_judged: bool = True) -> tuple[DataFrame, DataFrame]:
    """Visible nodes and links for an export; refused while prose is missing."""
    if not text_judged:
        raise ValueError("prose is missing: an export would be incomplete")
    return nodes, links.select("src", "dst", "type", "style", "ord")
