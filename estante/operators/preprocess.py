"""Page-marked Markdown to ordered blocks: pages per line, furniture, tables kept whole, figures dropped, paragraphs.

`page_of_lines` and `clean_line` are Columns and windows; `blocks`, whose state "inside a table or figure" runs along the
lines, reads each document in one pass where it lies. Null text gives no block; a table without end reaches to the end of the document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values
PAGE_NUMBER = r'(?i)<!--\s*PageNumber\s*=\s*"(\d+)"\s*-->'
PAGE_BREAK = r"(?i)<!--\s*PageBreak\s*-->"
HEADER_FOOTER = r'(?i)<!--\s*Page(?:Header|Footer)\s*=\s*"([^"]*)"\s*-->'
COMMENT = r"<!--.*?-->"
INLINE_TAG = r"(?i)</?(figure|figcaption|i|b|em|strong|sub|sup|u|span|mark|br|small)\s*/?>"
KEPT_WORDS = 3


def split_lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")


def line_slice(df: DataFrame, text: str, first: int, last: int = 0) -> DataFrame:
    """Lines `first` to `last` (from 1, inclusive; 0 is the end) as (…, line_no, line)."""
    out = df.select("*", F.posexplode(split_lines(F.col(text))).alias("i", "line")).withColumn("line_no", (F.col("i") + 1).cast("bigint")).drop("i", text)
    return out.where((F.col("line_no") >= first) & ((F.col("line_no") <= last) if last else F.lit(True)))


def clean_line(line: Column) -> Column:
    """Header and footer comments stay as text from three words on; other comments and inline tags go."""
    inner = F.trim(F.regexp_extract(line, HEADER_FOOTER, 1))
    long = F.size(F.filter(F.split(inner, r"\s+"), lambda w: w != "")) >= KEPT_WORDS
    kept = F.regexp_replace(line, HEADER_FOOTER, "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(F.when(long, kept).otherwise(line), COMMENT, ""), INLINE_TAG, ""))


def page_of_lines(lines: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, line_no, line) with `page`: a page ends with its break line and takes the first number found in it; a page without a number follows the last numbered one; before any number it is null."""
    order = Window.partitionBy(by).orderBy("line_no")
    number = F.regexp_extract("line", PAGE_NUMBER, 1)
    seg = F.coalesce(F.sum(F.col("line").rlike(PAGE_BREAK).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = lines.withColumns({"seg": seg, "number": F.when(number != "", number.cast("int"))})
    pages = marked.groupBy(by, "seg").agg(F.min_by("number", F.when(F.col("number").isNotNull(), F.col("line_no"))).alias("n"))
    so_far = Window.partitionBy(by).orderBy("seg").rowsBetween(Window.unboundedPreceding, 0)
    numbered = pages.withColumns({"at": F.last(F.when(F.col("n").isNotNull(), F.col("seg")), True).over(so_far), "last_n": F.last("n", True).over(so_far)})
    page = numbered.select(by, "seg", (F.col("last_n") + F.col("seg") - F.col("at")).cast("int").alias("page"))
    return marked.drop("number").join(page, [by, "seg"])


_NUMBER, _BREAK, _HEADED = re.compile(PAGE_NUMBER), re.compile(PAGE_BREAK), re.compile(HEADER_FOOTER)
_COMMENT, _TAG = re.compile(COMMENT), re.compile(INLINE_TAG)


def pages(lines: list[str]) -> list[int | None]:
    """The page of each line: as `page_of_lines`, for lines in memory."""
    out: list[int | None] = []
    page: int | None = None
    start = 0
    for i, line in enumerate(lines):
        if _BREAK.search(line) or i == len(lines) - 1:
            number = next((int(m[1]) for x in lines[start : i + 1] if (m := _NUMBER.search(x))), None)
            page = number if number is not None else page + 1 if page is not None else None
            out += [page] * (i + 1 - start)
            start = i + 1
    return out


def cleaned(line: str) -> str:
    m = _HEADED.search(line)
    if m and len(m[1].split()) >= KEPT_WORDS:
        line = _HEADED.sub(r"\1", line)
    return _TAG.sub("", _COMMENT.sub("", line)).strip()


def parse(text: str) -> list[tuple[str, int | None, list[str], str]]:
    """(kind, page, lines, text) of a document's blocks, in order."""
    lines = re.sub(r"\r\n?", "\n", text).split("\n")
    page_of = pages(lines)
    out: list[tuple[str, int | None, list[str], str]] = []
    held: list[str] = []
    start, mode = 0, "text"

    def flush() -> None:
        if held and mode == "table":
            out.append(("table", page_of[start], [], "\n".join(held).strip()))
        elif held:
            out.append(("paragraph", page_of[start], list(held), "\n".join(held)))
        held.clear()

    for i, line in enumerate(lines):
        low = line.lower()
        if mode == "text":
            opens = low.strip()
            if opens.startswith("<table") or (opens.startswith("<figure") and "</figure>" not in low):
                flush()
                mode, start = ("table" if opens.startswith("<table") else "figure"), i
        if mode == "text":
            clean = cleaned(line)
            if not clean:
                flush()
                continue
            if not held:
                start = i
            held.append(clean)
        elif mode == "table":
            held.append(_COMMENT.sub("", line).rstrip())
            if "</table>" in low:
                flush()
                mode = "text"
        elif "</figure>" in low:
            mode = "text"
    flush()
    return out


def blocks(documents: DataFrame, by: str = "doc_id", text: str = "text") -> DataFrame:
    """(by, block_idx, kind, page, lines, text). A block's page is that of its first line; a paragraph's text is its lines, a table's its raw
    lines, each joined by a newline. One pass over each document where it lies: nothing is shuffled."""
    kind = documents.schema[by].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, n, *block) for k, t in zip(b[by], b[text]) for n, block in enumerate(parse(t))]
            yield pd.DataFrame(rows, columns=[by, "block_idx", "kind", "page", "lines", "text"]).astype({"page": "Int32"})

    docs = documents.where(F.col(text).isNotNull()).select(by, text)
    return docs.mapInPandas(run, f"{by} {kind}, block_idx int, kind string, page int, lines array<string>, text string")
