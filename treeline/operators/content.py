"""Text for the summariser: routing, page and sheet tables, truncation, outcomes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from treeline import fixed_values as fixed
from treeline.functions.values import blank, in_values, lower_value, strip, upper_value
from treeline.operators.hierarchy import resolve
from treeline.operators.skew import HOT_ROWS
from treeline.schema import ensure_columns

# Long documents are joined in sections of this many pieces, then per file.
SECTION = 1000

# White space as in fixed_values.WHITESPACE; (?U) takes in the Unicode spaces.
SPACES = r"(?U)[\s\x1c-\x1f]+"

Summarizer = Callable[[str, str], str]

# Bytes of pieces that a task holds before it sends them on.
FRAME_BYTES = 4 << 20


class Piece(NamedTuple):
    """A part of a file: a `page`, a sheet `row`, a `paragraph`, the `text` or the bytes of an `image`."""

    kind: str
    no: int = 0
    text: str | None = None
    n_images: int = 0
    sheet_no: int = 0
    sheet: str = ""
    data: bytes | None = None


#: The parts of a file, given its route and its place, in any order.
Decoder = Callable[[str, str], Iterable[Piece]]
PIECES = ("drive_id string, path string, kind string, no bigint, text string, n_images bigint, "
          "sheet_no bigint, sheet string, data binary")
KEY = ["drive_id", "path"]


def content_route(ext: Column) -> Column:
    """Reader for an extension: docx, pdf, xlsx, image or text (also if unknown)."""
    e = F.lower(F.coalesce(ext, F.lit("")))
    return (
        F.when(e == ".docx", "docx").when(e == ".pdf", "pdf").when(e == ".xlsx", "xlsx")
        .when(e.isin(fixed.IMAGE_EXTENSIONS), "image")
        .when(e.isin(fixed.TEXT_EXTENSIONS), "text")
        .otherwise("text_attempt")
    )


def utf8_text(content: Column) -> Column:
    """Bytes as text; invalid sequences become replacement characters."""
    return F.make_valid_utf8(content.cast("string"))


def image_base64(content: Column) -> Column:
    """Base64 in one line: the function breaks it every 76 characters."""
    return F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))


def truncate_words(text: Column, limit: int = fixed.DEFAULT_MAX_WORDS) -> Column:
    """The first `limit` words joined by spaces; a shorter text stays as it is.

    The split stops behind the last word needed.
    """
    words = F.split(strip(text), SPACES, limit + 1)
    return F.element_at(F.transform(
        F.array(words),
        lambda w: F.when(F.size(w) <= limit, text).otherwise(F.array_join(F.slice(w, 1, limit), " ")),
    ), 1)


def join_pieces(pieces: DataFrame, keys: list[str], position: str, text: str) -> DataFrame:
    """(keys, content): the pieces of each file in order, one per line.

    A file with very many pieces is put together in sections first, so sorting and
    collecting stay small; the result is one text per file by definition.
    """
    def ordered(pos: str, value: str) -> Column:
        sorted_items = F.array_sort(F.collect_list(F.struct(
            F.col(pos).alias("p"), F.col(value).alias("t"))))
        return F.array_join(F.transform(sorted_items, lambda x: x["t"]), "\n")

    sections = pieces.withColumn("_section", F.floor(F.col(position) / SECTION)).groupBy(
        *keys, "_section").agg(ordered(position, text).alias("_text"))
    return sections.groupBy(*keys).agg(ordered("_section", "_text").alias("content"))


def pdf_content(pages: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(path, content): the non-empty page texts of each PDF in page order."""
    return join_pieces(pages.where(F.col("text") != ""), keys or ["path"], "page_no", "text")


def pdf_complexity(
    pages: DataFrame, known: DataFrame | None = None, keys: list[str] | None = None
) -> DataFrame:
    """(path, n_pages, total_chars, has_images, sparse, is_complex) per PDF.

    Complex: an image on any page, or fewer than 100 characters per page on average.
    `known` (path, pdf_complexity) replaces the image test where it is complex or
    simple; sparseness is always taken from the text. No pages means simple.
    """
    on, real = keys or ["path"], F.col("page_no").isNotNull()
    facts = pages.groupBy(*on).agg(
        F.count_if(real).alias("n_pages"),
        F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("total_chars"),
        F.coalesce(F.bool_or(F.col("n_images") > 0), F.lit(False)).alias("has_images"),
    )
    sparse = (F.col("n_pages") > 0) & (
        F.col("total_chars") / F.greatest(F.col("n_pages"), F.lit(1))
        < fixed.SPARSE_PDF_CHARS_PER_PAGE)
    facts = facts.withColumn("sparse", sparse)
    if known is None:
        return facts.withColumn("is_complex", F.col("has_images") | F.col("sparse"))
    cached = known.select(*on, lower_value(F.col("pdf_complexity")).alias("_known"))
    stated = F.when(F.col("_known") == "complex", True).when(F.col("_known") == "simple", False)
    return facts.join(cached, on, "left").withColumn(
        "is_complex", F.coalesce(stated, F.col("has_images")) | F.col("sparse")).drop("_known")


def fill_pdf_complexity(df: DataFrame, facts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Write complex / simple into .pdf rows without a value and with page facts."""
    df, on = ensure_columns(df, ["pdf_complexity"]), keys or ["path"]
    flags = facts.select(*on, F.col("is_complex").alias("_complex"))
    empty = (F.lower("extension") == ".pdf") & blank(F.col("pdf_complexity"))
    found = F.when(F.col("_complex"), "complex").when(~F.col("_complex"), "simple")
    return df.join(flags, on, "left").withColumn(
        "pdf_complexity",
        F.when(empty & F.col("_complex").isNotNull(), found).otherwise(F.col("pdf_complexity")),
    ).select(*df.columns)


def sheet_preview(
    cells: DataFrame, cap: int = fixed.SHEET_ROW_CAP, keys: list[str] | None = None
) -> DataFrame:
    """First `cap` rows with any text of every sheet, in row order."""
    first = Window.partitionBy(*(keys or ["path"]), "sheet").orderBy("row_no")
    return cells.where(~blank(F.col("line"))).withColumn(
        "shown", F.row_number().over(first)).where(F.col("shown") <= cap)


def sheet_content(
    cells: DataFrame, cap: int = fixed.SHEET_ROW_CAP, keys: list[str] | None = None
) -> DataFrame:
    """(path, content): per workbook each sheet's title line and its first rows."""
    on = keys or ["path"]
    shown = sheet_preview(cells, cap, on).select(*on, "sheet_no", "sheet", "shown", "line")
    titles = cells.select(*on, "sheet_no", "sheet").distinct().select(
        *on, "sheet_no", "sheet", F.lit(0).alias("shown"),
        F.concat(F.lit("Sheet: "), F.col("sheet")).alias("line"))
    lines = shown.unionByName(titles).withColumn(
        "_at", F.col("sheet_no") * (cap + 1) + F.col("shown"))
    return join_pieces(lines, on, "_at", "line")


def paragraph_content(paragraphs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(path, content): the paragraphs with text of each document in order."""
    return join_pieces(paragraphs.where(~blank(F.col("text"))), keys or ["path"], "para_no", "text")


def summarize_eligible(
    df: DataFrame, *, within: tuple[str, ...] = ("drive_id",), hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Files under review (true, 1 or yes), not deleted, without a summary."""
    df = ensure_columns(df, ["summary"])
    resolved = resolve(df, ["review", "decision"], within=within, hot_rows=hot_rows)
    wanted = in_values(F.col("effective_review"), ["true", "1", "yes"])
    deleted = F.coalesce(upper_value(F.col("effective_decision")) == "DELETE", F.lit(False))
    is_dir = F.coalesce(F.col("is_dir"), F.lit(False))
    return resolved.where(wanted & ~deleted & blank(F.col("summary")) & ~is_dir)


def decode_pieces(files: DataFrame, decoder: Decoder, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """The pieces of (drive_id, path, route, uri), one row each; see Piece.

    The file is opened in the task that sends its pieces, and pieces go on in frames of
    about `frame_bytes`: no file's bytes are stored or moved as a whole. Text routes are read
    here, the others by `decoder`. A file that raises has a piece of kind `error`,
    with the message as text, behind those that came before it. A repeated task gives the same
    pieces if the decoder does.
    """
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(),
             pa.string(), pa.binary()]
    names = [c.split()[0] for c in PIECES.split(", ")]

    def of(route: str, uri: str) -> Iterable[Piece]:
        if route in ("text", "text_attempt"):
            with open(uri, "rb") as f:
                return [Piece("text", data=f.read())]
        return decoder(route, uri)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for drive, path, route, uri in zip(*(batch.column(i).to_pylist() for i in range(4))):
                try:
                    for piece in of(route, uri):
                        rows.append((drive, path, *piece))
                        size += len(piece.text or "") + len(piece.data or b"")
                        if size >= frame_bytes:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows, size = [], 0
                except Exception as e:  # whatever a decoder raises is that file's outcome
                    rows.append((drive, path, *Piece("error", text=str(e))))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return files.select(*KEY, "route", "uri").mapInArrow(run, PIECES)


def pdf_facts(files: DataFrame, pieces: DataFrame) -> DataFrame:
    """pdf_complexity of the PDFs that could be read; one without pages is simple.

    files: drive_id, path, route, pdf_complexity.
    """
    failed = pieces.where(F.col("kind") == "error").select(*KEY)
    pdf = files.where(F.col("route") == "pdf").join(failed, KEY, "left_anti").select(*KEY, "pdf_complexity")
    pages = pieces.where(F.col("kind") == "page").select(*KEY, F.col("no").alias("page_no"), "text", "n_images")
    every = pdf.select(*KEY).join(pages, KEY, "left")
    return pdf_complexity(every, pdf, KEY)


def file_contents(files: DataFrame, pieces: DataFrame, facts: DataFrame) -> DataFrame:
    """(drive_id, path, kind, content) of every file: what a summariser is given.

    Kinds are text, complex_pdf, image_b64 and error. A file without pieces has an empty text. `facts` is
    the result of pdf_facts; files is unique by drive_id and path.
    """
    kind = F.col("kind")
    failed = pieces.where(kind == "error").groupBy(*KEY).agg(F.min("text").alias("content"))
    texts = [
        pdf_content(pieces.where(kind == "page").withColumn("page_no", F.col("no")), KEY),
        sheet_content(pieces.where(kind == "row").withColumns(
            {"row_no": F.col("no"), "line": F.col("text")}), keys=KEY),
        paragraph_content(pieces.where(kind == "paragraph").withColumn("para_no", F.col("no")), KEY),
        pieces.where(kind == "text").select(*KEY, F.coalesce("text", utf8_text(F.col("data"))).alias("content")),
    ]
    out = pieces.where(kind == "image").select(
        *KEY, image_base64(F.col("data")).alias("content"), F.lit("image_b64").alias("found"))
    for text in texts:
        out = out.unionByName(text.withColumn("found", F.lit("text")))
    out = out.unionByName(failed.withColumn("found", F.lit("error")))
    # A file that failed halfway has pieces and an error: the error counts.
    one = F.min(F.struct((F.col("found") != "error").alias("later"), "found", "content"))
    best = out.groupBy(*KEY).agg(one.alias("o")).select(*KEY, "o.found", "o.content")
    complex_pdf = facts.where("is_complex").select(*KEY, F.lit(True).alias("_complex"))
    joined = files.select(*KEY).join(best, KEY, "left").join(complex_pdf, KEY, "left")
    found = F.coalesce("found", F.lit("text"))
    return joined.select(
        *KEY, F.when((found == "text") & F.col("_complex"), "complex_pdf").otherwise(found).alias("kind"),
        F.coalesce("content", F.lit("")).alias("content"))


def cut_content(contents: DataFrame, max_words: int = fixed.DEFAULT_MAX_WORDS) -> DataFrame:
    """Texts and complex PDFs cut to `max_words`."""
    return contents.withColumn("content", F.when(
        F.col("kind").isin("text", "complex_pdf"), truncate_words(F.col("content"), max_words)
    ).otherwise(F.col("content")))


def summary_answer(summarizer: Summarizer) -> Callable[[str, str], tuple[str | None, str | None]]:
    """One call of the summariser: (summary, None), or (None, error)."""
    def answer(kind: str, text: str) -> tuple[str | None, str | None]:
        try:
            return summarizer(kind, text).strip(), None
        except Exception as e:  # any failure of the caller's model counts
            return None, str(e)
    return answer


def summary_text(kind: Column, content: Column, reply: Column, error: Column) -> Column:
    """What goes into the inventory: the summary, or why there is none."""
    return F.when(kind == "error", F.concat(F.lit(fixed.SUMMARY_UNREADABLE), content)).otherwise(
        F.coalesce(reply, F.concat(F.lit(fixed.SUMMARY_ERROR), F.coalesce(error, F.lit("")))))


def fold_outcomes(
    df: DataFrame, outcomes: DataFrame, column: str, key: list[str] | None = None,
    only_blank: bool = False,
) -> DataFrame:
    """Overwrite a status column where an outcome exists; no row is added or lost.

    Of several outcomes for one key the last in text order counts. With `only_blank`,
    values that are there already stay.
    """
    keys = key or ["path"]
    df = ensure_columns(df, [column])
    new = outcomes.groupBy(*keys).agg(F.max(column).alias("_new"))
    value = F.coalesce(F.col("_new"), F.col(column))
    if only_blank:
        value = F.when(blank(F.col(column)), value).otherwise(F.col(column))
    return df.join(new, keys, "left").withColumn(column, value).select(*df.columns)
