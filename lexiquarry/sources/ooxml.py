"""DOCX files as a stream of items: paragraphs and tables in the order of the body."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shipping import ship

NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
ITEMS = "path string, item_order int, kind string, style string, text string, cells array<array<string>>, error string"


def _text(node) -> str:
    out = []
    for x in node.iter():
        if x.tag == f"{NS}t":
            out.append(x.text or "")
        elif x.tag in (f"{NS}tab", f"{NS}br"):
            out.append("\t" if x.tag == f"{NS}tab" else "\n")
    return "".join(out)


def body_items(content: bytes) -> Iterator[tuple]:
    """(order, kind, style, text, cells) of each paragraph and table."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{NS}body")
    for k, node in enumerate(x for x in body if x.tag in (f"{NS}p", f"{NS}tbl")):
        if node.tag == f"{NS}p":
            style = node.find(f"{NS}pPr/{NS}pStyle")
            yield k, "paragraph", style.get(f"{NS}val") if style is not None else None, _text(node), None
        else:
            cells = [["\n".join(_text(p) for p in cell.findall(f"{NS}p")) for cell in row.findall(f"{NS}tc")] for row in node.findall(f"{NS}tr")]
            yield k, "table", None, None, cells


def items(files: DataFrame) -> DataFrame:
    """(path, content) → items; a file that can't be read gives one item with its error."""
    ship(files.sparkSession)

    def read(batches):
        import pandas as pd

        names = [c.split(" ")[0] for c in ("path", "item_order", "kind", "style", "text", "cells", "error")]
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows += [(path, *item, None) for item in body_items(content)]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError) as e:
                    rows.append((path, 0, "error", None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(read, ITEMS)


def plain_text(found: DataFrame) -> DataFrame:
    """path, text: paragraphs, and table rows with cells joined by " | ", a line each, in order."""
    lines = F.when(F.col("kind") == "table", F.array_join(F.transform("cells", lambda r: F.array_join(r, " | ")), "\n")).otherwise(F.col("text"))
    one = found.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("item_order", lines.alias("t")))).alias("xs"))
    return one.select("path", F.array_join(F.filter(F.transform("xs", lambda x: x["t"]), lambda t: F.trim(t) != ""), "\n").alias("text"))


def table_rows(found: DataFrame) -> DataFrame:
    """path, item_order (of the table), row_order, cells."""
    return found.filter("kind = 'table'").select("path", "item_order", F.posexplode("cells").alias("row_order", "cells"))
