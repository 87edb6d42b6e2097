"""Delimited text: every column stays text, odd bytes and odd headers are repaired.

Only the header record and one row of counts reach the driver. A file of any size is read in byte ranges: the quotes
of each range tell in which state the next one starts, so records that hold line breaks, also across ranges, stay
whole, and every record has the number it has in its file, however the file was split."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrat.functions.dates import fold_header
from quadrat.functions.text import INVISIBLE_CHARS, SPACE_CHARS, any_of, clean_invisible, is_blank

# Upper halves of the two single-byte code pages, decoded from their byte values.
HIGH_BYTES = bytes(range(0x80, 0x100))
LATIN1_HIGH = HIGH_BYTES.decode("latin-1")
CP850_HIGH = HIGH_BYTES.decode("cp850")
CP1252_HIGH = "".join(bytes([b]).decode("cp1252", "replace").replace("\ufffd", chr(b)) for b in HIGH_BYTES)
# Bytes that speak for a DOS or a Windows file.
DOS_BYTES = (0x81, 0x82, 0x83, 0x87, 0x88, 0xA1, 0xA2, 0xA3, 0xA4, 0xC6)
WINDOWS_BYTES = (0xE1, 0xE3, 0xE7, 0xEA, 0xED, 0xF3, 0xF4, 0xF5, 0xFA)
# Marks of DOS text read as Latin-1, and the letters a repaired cell may hold.
LETTER_MARKS = r"\u0081-\u0083\u0087\u0088\u0090\u009A¡-¥Æ"
STRONG_MARK = rf"[A-Za-z][{LETTER_MARKS}]|[{LETTER_MARKS}][A-Za-z]|[A-Za-z][\u0080\u0085\u0093][A-Za-z]"
WEAK_MARK = (
    rf"[{LETTER_MARKS}\u0080\u0085\u0093¦§µ-·ÒÖäåø]|[A-Za-z]\u00A0|\u00A0[A-Za-z]"
)
PLAIN_TEXT = r"^[\u0001-\u007FáàâãéêíóôõúüçñÁÀÂÃÉÊÍÓÔÕÚÜÇÑªº°]*$"
# Header words of identifier and code columns, where the text NA is a value.
CODE_WORDS = {
    "id", "ids", "uuid", "guid", "code", "codes", "codigo", "codigos", "iso", "sigla", "number", "numbers",
    "numero", "numeros", "tombo", "voucher", "catalog", "catalogo",
}


@dataclass
class ReadReport:
    """What the reader met; counts come from one aggregate."""

    delimiter: str = ","
    sep_line: bool = False
    headers: list[str] = field(default_factory=list)
    header_suspect: bool = False
    encodings: dict[str, int] = field(default_factory=dict)


def pick_delimiter(header: str) -> str:
    """Most frequent of tab, semicolon and comma outside quotes."""
    bare = re.sub('"[^"]*"', "", header)
    tabs, semis, commas = bare.count("\t"), bare.count(";"), bare.count(",")
    if not header:
        return ","
    if tabs >= max(semis, commas):
        return "\t"
    return ";" if semis > commas else ","


def repair_headers(names: list[str]) -> list[str]:
    """Trimmed, never blank, unique (`_1`, `_2`)."""
    seen: dict[str, int] = {}
    taken, out = set(), []
    for i, raw in enumerate(names, start=1):
        clean = re.sub(INVISIBLE_CHARS, "", re.sub(SPACE_CHARS, " ", raw.strip()))
        name = clean or f"col_{i}"
        base = name
        while name in taken:
            seen[base] = seen.get(base, 0) + 1
            name = f"{base}_{seen[base]}"
        taken.add(name)
        out.append(name)
    return out


def header_is_data(names: list[str]) -> bool:
    """A header row that looks like values: numbers, dates, degrees."""
    filled = [n.strip() for n in names if n.strip()]
    pattern = r"^[-+−]?[0-9]+([.,][0-9]+)?\s*(°|m|km)?$|^[0-9]{1,4}[/.-][0-9]{1,2}[/.-][0-9]{1,4}$|^[0-9]+°"
    hits = sum(bool(re.search(pattern, n)) for n in filled)
    return bool(filled) and (hits >= 2 or hits / len(filled) >= 0.25)


def is_code_header(name: str) -> bool:
    return any(w in CODE_WORDS for w in fold_header(name))


def _latin(column: str) -> Column:
    return F.decode(F.col(column).cast("binary"), "ISO-8859-1")


def dos_vote(lines: DataFrame, column: str = "value") -> DataFrame:
    """One row `dos`: whether the lines that are no UTF-8 speak for a DOS code page, by all their bytes."""
    odd = lines.filter(~F.is_valid_utf8(column)).select(_latin(column).alias("l"))

    def hits(codes: tuple[int, ...]) -> Column:
        return F.sum(F.length("l") - F.length(F.translate(F.col("l"), "".join(chr(c) for c in codes), "")))

    return odd.agg(F.coalesce(hits(DOS_BYTES) > hits(WINDOWS_BYTES), F.lit(False)).alias("dos"))


def decode_lines(lines: DataFrame, column: str = "value", dos: Column | None = None) -> DataFrame:
    """Lines as the text source reads them (raw bytes) to text: UTF-8 where valid, else the code page the
    file's bytes vote for. Adds `encoding`. A NUL byte is an error."""
    is_dos = dos_vote(lines, column).scalar() if dos is None else dos
    checked = lines.withColumn("__ok", F.is_valid_utf8(column))
    checked = checked.withColumn("__latin", F.when(~F.col("__ok"), _latin(column)))
    text = (
        F.when(F.col(column).contains("\u0000"), F.raise_error(F.lit("the file has NUL bytes; save it as UTF-8 text")))
        .when(F.col("__ok"), F.col(column))
        .when(is_dos, F.translate(F.col("__latin"), LATIN1_HIGH, CP850_HIGH))
        .otherwise(F.translate(F.col("__latin"), LATIN1_HIGH, CP1252_HIGH))
    )
    kind = F.when(F.col("__ok"), "UTF-8").when(is_dos, "CP850").otherwise("Windows-1252")
    out = checked.withColumn("encoding", kind).withColumn(column, text)
    return out.withColumn(column, F.regexp_replace(F.col(column), r"^\uFEFF", "")).drop("__ok", "__latin")


def clear_na_text(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """The text NA is NULL everywhere if any column that is no identifier holds it; else it is kept."""
    columns = [c for c in df.columns if c != row_id]
    free = [F.coalesce(F.col(f"`{c}`") == "NA", F.lit(False)) for c in columns if not is_code_header(c)]
    seen = df.agg(F.coalesce(F.bool_or(any_of(free)), F.lit(False)).alias("na")).scalar()
    return df.select(
        *[F.col(c) for c in df.columns if c == row_id],
        *[F.when(seen & (F.col(f"`{c}`") == "NA"), F.lit(None).cast("string")).otherwise(F.col(f"`{c}`")).alias(c) for c in columns],
    )


def emptied_codes(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """One row: identifier cells that `clear_na_text` empties."""
    columns = [c for c in df.columns if c != row_id]
    na = {c: F.coalesce(F.col(f"`{c}`") == "NA", F.lit(False)) for c in columns}
    free = F.bool_or(any_of([v for c, v in na.items() if not is_code_header(c)]))
    lost = sum((F.count_if(v) for c, v in na.items() if is_code_header(c)), F.lit(0))
    return df.agg(F.when(F.coalesce(free, F.lit(False)), lost).otherwise(0).alias("lost"))


def _as_cp850(cell: Column) -> Column:
    return F.translate(cell, LATIN1_HIGH, CP850_HIGH)


def repair_dos_accents(df: DataFrame, columns: list[str]) -> DataFrame:
    """`SÆo` back to `São`, only where a strong mark proves it and the result is plain text."""
    out = {}
    for c in columns:
        cell = F.col(f"`{c}`")
        fixed = F.when(cell.rlike(STRONG_MARK), F.when(_as_cp850(cell).rlike(PLAIN_TEXT), _as_cp850(cell)).otherwise(cell)).otherwise(cell)
        out[c] = F.when(cell.rlike(r"[^\x01-\x7f]"), fixed).otherwise(cell)
    return df.withColumns(out)


def dos_accent_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, repaired, unsure): weakly marked cells count as unsure only in a column with a repair."""
    def counts(c: str) -> Column:
        cell = F.coalesce(F.col(f"`{c}`"), F.lit(""))
        plain = _as_cp850(cell).rlike(PLAIN_TEXT)
        strong = cell.rlike(STRONG_MARK)
        done, weak = F.count_if(strong & plain), F.count_if(~strong & cell.rlike(WEAK_MARK) & plain)
        return F.struct(F.lit(c).alias("column"), done.alias("repaired"), F.when(done > 0, weak).otherwise(0).alias("unsure"))

    row = df.agg(*[counts(c).alias(f"c{i}") for i, c in enumerate(columns)])
    return row.select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(columns))])).alias("c")).select("c.*")


def clean_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: clean_invisible(F.col(f"`{c}`")) for c in columns})


def _filled(columns: list[str]) -> Column:
    return sum((F.coalesce(F.col(f"`{c}`").rlike("[^ \\t\\r\\n]"), F.lit(False)).cast("int") for c in columns), F.lit(0))


def drop_empty_rows(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    return df.filter(any_of([~is_blank(F.col(f"`{c}`")) for c in df.columns if c != row_id]))


def row_report(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """One row: empty rows and footer rows (one filled cell in a table of four columns or more)."""
    columns = [c for c in df.columns if c != row_id]
    n = _filled(columns)
    footer = F.count_if(n == 1) if len(columns) >= 4 else F.lit(0)
    return df.agg(F.count("*").alias("rows"), F.count_if(n == 0).alias("empty_rows"), footer.alias("footer_rows"))


# Byte order marks and the encodings they announce.
MARKS = {b"\xff\xfe": "UTF-16LE", b"\xfe\xff": "UTF-16BE"}


def raw_lines(spark: SparkSession, path: str) -> tuple[DataFrame, str | None]:
    """(value, file, block, at) of every line, and the UTF-16 encoding a byte order mark announces.

    `block` is where the byte range of the line starts in its file, `at` grows with the lines of one range. UTF-16 text is
    decoded here; all other lines keep their bytes."""
    first = spark.read.text(path).select(F.col("value").cast("binary").alias("b")).limit(1).collect()
    charset = MARKS.get(bytes(first[0]["b"][:2])) if first else None
    reader = spark.read.option("encoding", charset).option("lineSep", "\n") if charset else spark.read
    lines = reader.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"))
    if charset:
        text = F.regexp_replace(F.decode(F.col("value").cast("binary"), charset), "^\uFEFF|\r$", "")
        lines = lines.withColumn("value", F.explode(F.split(text, "\r"))).withColumn("at", F.monotonically_increasing_id())
    return lines, charset


def whole_records(lines: DataFrame) -> DataFrame:
    """(file, number, value): the records of each file from 0 on, lines inside quotes joined by a line feed.

    A line starts a record if the quotes before it are even in number. Their number inside a byte range is counted for
    both cases; a prefix sum over the ranges, one small row each, then tells which case holds. Only lines of records
    that are longer than one line are brought together."""
    quotes = F.char_length("value") - F.char_length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    own = Window.partitionBy("file", "block").orderBy("at")
    before = F.coalesce(F.sum("quotes").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = lines.withColumn("quotes", quotes).withColumn("odd", before % 2)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumns({f"starts_{k}": F.sum((F.col("odd") == k).cast("long")).over(upto) for k in (0, 1)})
    ranges = marked.groupBy("file", "block").agg(
        F.sum("quotes").alias("q"), F.max("starts_0").alias("s0"), F.max("starts_1").alias("s1"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("inside", F.coalesce(F.sum("q").over(earlier), F.lit(0)) % 2)
    ranges = ranges.withColumn("starts", F.when(F.col("inside") == 0, F.col("s0")).otherwise(F.col("s1")))
    ranges = ranges.select("file", "block", "inside", F.coalesce(F.sum("starts").over(earlier), F.lit(0)).alias("offset"))
    placed = marked.join(ranges, ["file", "block"])
    count = F.when(F.col("inside") == 0, F.col("starts_0")).otherwise(F.col("starts_1"))
    placed = placed.select("file", "block", "at", "value", (F.col("offset") + count - 1).alias("number"), (
        (F.col("odd") == F.col("inside")) & (F.col("quotes") % 2 == 0)).alias("alone"))
    parts = F.sort_array(F.collect_list(F.struct("block", "at", "value")))
    joined = placed.filter(~F.col("alone")).groupBy("file", "number").agg(parts.alias("p"))
    joined = joined.select("file", "number", F.array_join(F.transform("p", lambda x: x["value"]), "\n").alias("value"))
    return placed.filter("alone").select("file", "number", "value").unionByName(joined)


def peek_header(lines: DataFrame) -> tuple[str, bool]:
    """Header record and whether a `sep=` line precedes it, read until the quotes of the record close."""
    first = lines.agg(F.min("file")).first()[0]
    head = lines.filter((F.col("file") == first) & (F.col("block") == 0)).select("value")
    sep, quotes, record = "", 0, []
    for i, row in enumerate(head.toLocalIterator()):
        if i == 0 and re.fullmatch("sep=.", row["value"]):
            sep = row["value"][4] + "\n"
            continue
        record.append(row["value"])
        quotes += row["value"].count('"')
        if quotes % 2 == 0:
            break
    return sep + "\n".join(record), bool(sep)


def read_delimited(spark: SparkSession, path: str, header: bool = True) -> tuple[DataFrame, ReadReport]:
    """All-text table with `row_id`, plus what the header says.

    `row_id` is the number of the record in its file, files in order of their paths; it does not depend on how they
    were split. Every file may start with its own header. Blank lines are no records."""
    import csv
    import io

    raw, charset = raw_lines(spark, path)
    dos = bool(dos_vote(raw).first()["dos"])
    decoded = decode_lines(raw, dos=F.lit(dos))
    head, sep = peek_header(decoded)
    delimiter, record = (head[0], head[2:]) if sep else (pick_delimiter(head), head)
    first = next(csv.reader(io.StringIO(record), delimiter=delimiter), [])
    names = repair_headers(first) if header else [f"col_{i}" for i in range(1, len(first) + 1)]
    kinds = {charset or r["encoding"]: r["count"] for r in decoded.groupBy("encoding").count().collect()}
    report = ReadReport(delimiter, sep, names, header_is_data(first), kinds)
    schema = ", ".join(f"`{n.replace('`', '``')}` STRING" for n in names)
    options = {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "nullValue": ""}
    skip = int(header) + int(sep)
    records = whole_records(decoded.drop("encoding")).filter((F.col("number") >= skip) & (F.col("value") != ""))
    sizes = records.groupBy("file").agg((F.max("number") + 1 - skip).alias("n"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = records.join(starts, "file")
    row_id = (F.col("before") + F.col("number") - skip).alias("row_id")
    parsed = placed.select(row_id, F.from_csv("value", F.lit(schema), options).alias("r"))
    return parsed.select("row_id", *[F.col(f"r.`{n}`") for n in names]), report


def tidy_upload(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """NA text, DOS accents, invisible characters, empty rows."""
    columns = [c for c in df.columns if c != row_id]
    return drop_empty_rows(clean_cells(repair_dos_accents(clear_na_text(df, row_id), columns), columns), row_id)
