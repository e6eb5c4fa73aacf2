"""Text functions as Column expressions; two Arrow UDFs where Spark has no function, behind native guards."""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{Mn}\p{Nd}\p{Pc}]"
SUSPECT = "ÃÄÅÂâ�"
_WIN1252 = {chr(c) for c in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}  # code points that the code page maps to themselves


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def trim_all(x: str | Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(col(x), r"(?U)^\s+|\s+$", "")


def is_blank(x: str | Column) -> Column:
    return col(x).isNull() | ~col(x).rlike(r"(?U)\S")


def suspect_count(x: str | Column) -> Column:
    """Characters that betray UTF-8 read as a Windows code page."""
    return F.length(col(x)) - F.length(F.translate(col(x), SUSPECT, ""))


def repair_text(text: str | None) -> str | None:
    """Undo UTF-8 read as code page 1252, if that leaves fewer suspect characters. Unmapped characters become '?'."""
    if text is None or not any(c in text for c in SUSPECT[:5]):
        return text
    raw = bytearray()
    for c in text:
        raw += bytes([ord(c)]) if c in _WIN1252 else c.encode("cp1252", "replace")
    fixed = raw.decode("utf-8", "replace")
    return fixed if sum(map(fixed.count, SUSPECT)) < sum(map(text.count, SUSPECT)) else text


def _mapped(f, x: Column) -> Column:
    """``f`` over the values of a string column, an Arrow batch at a time."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda t: None if t is None else f(t))

    return run(x)


def compose(text: str) -> str:
    return unicodedata.normalize("NFC", text)


def repair_mojibake(x: str | Column) -> Column:
    return F.when(col(x).rlike("[ÃÄÅÂâ]"), _mapped(repair_text, col(x))).otherwise(col(x))


def nfc(x: str | Column) -> Column:
    """Composed form; ASCII text needs no change and stays in the JVM."""
    return F.when(col(x).rlike(r"[^\x00-\x7F]"), _mapped(compose, col(x))).otherwise(col(x))


def dehyphenate(x: str | Column) -> Column:
    return F.regexp_replace(col(x), rf"({WORD})-\r?\n({WORD})", "$1$2")


def squeeze_blanks(x: str | Column) -> Column:
    return F.regexp_replace(col(x), r"[ \t]+", " ")


def squeeze_newlines(x: str | Column) -> Column:
    return F.regexp_replace(col(x), r"(\r?\n){3,}", "\n\n")


def trimmed_lines(x: str | Column) -> Column:
    return F.transform(F.split(col(x), "\n", -1), trim_all)


def is_kept_line(line: Column, keep_tables: bool = False) -> Column:
    """Blank lines, and lines of 3 characters or more with two letters that are not digits and punctuation only."""
    letters = F.length(F.regexp_replace(line, r"\P{L}", ""))
    kept = (F.length(line) >= 3) & ~line.rlike(r"(?U)^[\d\s.\-()\[\]{}:;,]+$") & (letters >= 2)
    if keep_tables:
        kept = kept | (line.startswith("|") & line.endswith("|") & (F.length(line) > 1))
    return (line == "") | kept


def clean_composed(x: str | Column, keep_tables: bool = False) -> Column:
    """The cleaner's steps after repair and composition; all of them stay in the JVM."""
    lines = trimmed_lines(squeeze_newlines(squeeze_blanks(dehyphenate(F.coalesce(col(x), F.lit(""))))))
    kept = F.array_join(F.filter(lines, lambda line: is_kept_line(line, keep_tables)), "\n")
    return F.when(is_blank(x), F.lit("")).otherwise(kept)


def clean_text(x: str | Column, repair: bool = True, keep_tables: bool = False) -> Column:
    """The whole cleaner; blank and null text become empty."""
    return clean_composed(nfc(repair_mojibake(x) if repair else x), keep_tables)


def clean_pages(pages: str | Column, keep_tables: bool = False) -> Column:
    """An array of (page_number, text) with clean texts. Documents of ASCII alone never leave the JVM."""
    p = col(pages)

    @F.arrow_udf("array<struct<page_number:int,text:string>>")
    def composed(x: pa.Array) -> pa.Array:
        fixed = [None if v is None else [q and q | {"text": q["text"] and compose(repair_text(q["text"]))} for q in v] for v in x.to_pylist()]
        return pa.array(fixed, pa.list_(pa.struct([("page_number", pa.int32()), ("text", pa.string())])))

    whole = F.when(F.exists(p, lambda q: q["text"].rlike(r"[^\x00-\x7F]")), composed(p)).otherwise(p)
    return F.transform(whole, lambda q: F.struct(q["page_number"].alias("page_number"), clean_composed(q["text"], keep_tables).alias("text")))


def drop_page_lines(x: str | Column, page: str | Column, pages: str | Column) -> Column:
    """Without lines that only number the page."""
    n, total = col(page).cast("string"), col(pages).cast("string")
    pattern = F.concat(
        F.lit(r"(?iU)^\s*(?:"), n, F.lit(r"|Page\s*"), n, F.lit("|"), n, F.lit(r"\s*/\s*"), total, F.lit(r"|[-–—]\s*\d+\s*[-–—]|"), n, F.lit(r"\s*of\s*"), total, F.lit(r")\s*$")
    )
    return F.array_join(F.filter(F.split(col(x), "\n", -1), lambda line: ~F.rlike(line, pattern)), "\n")


def search_fold(x: str | Column) -> Column:
    """Lower case by Turkish rules, Turkish letters without their marks; null becomes empty."""
    return F.translate(F.lower(F.translate(F.coalesce(col(x), F.lit("")), "İI", "ii")), "çğıöşü", "cgiosu")


def language(x: str | Column) -> Column:
    return F.when(is_blank(x), F.lit("unknown")).when(col(x).rlike("[çğıöşüÇĞİÖŞÜ]"), F.lit("tr")).otherwise(F.lit("en"))


def token_estimate(x: str | Column, chars_per_token: float = 3.5) -> Column:
    return F.floor(F.length(F.coalesce(col(x), F.lit(""))) / F.lit(chars_per_token)).cast("int")


def sentences(x: str | Column) -> Column:
    """Array of sentences: split after . ! ? where white space follows."""
    return F.filter(F.transform(F.split(col(x), r"(?U)(?<=[.!?])\s+", -1), trim_all), lambda s: s != "")


def steps(x: str | Column, compat: bool = False) -> Column:
    """Array of list items. A number counts as an item's mark at a line's start; with ``compat`` anywhere, digit by digit."""
    mark = r"(?:Step\s*\d+[:.\s]|\d+[.)]\s|[•\-*➤]\s)"
    pattern = rf"(?iU)(?={mark})" if compat else rf"(?imU)(?=^{mark})"
    return F.filter(F.transform(F.split(col(x), pattern, -1), trim_all), lambda s: s != "")


def last_of(x: Column, chars: str) -> Column:
    """0-based place of the last of some characters, -1 if there is none."""
    return F.length(x) - F.length(F.regexp_extract(x, rf"[^{chars}]*$", 0)) - 1


def truncate_at_sentence(x: str | Column, most: Column) -> Column:
    """At most ``most`` characters: up to the last sentence end in the second half, else the last blank in the last 30 %, else cut."""
    text = col(x)

    def shortened(cut: Column) -> Column:
        end, blank = last_of(cut, ".!?"), last_of(cut, " ")
        return (
            F.when(end > most * 0.5, F.substring(cut, F.lit(1), end + 1))
            .when(blank > most * 0.7, F.concat(F.substring(cut, F.lit(1), blank), F.lit("...")))
            .otherwise(F.concat(cut, F.lit("...")))
        )

    return F.when(F.length(text) <= most, text).otherwise(let(F.substring(text, F.lit(1), most), shortened))


def parent_path(x: str | Column) -> Column:
    """A section path without its last part; empty at the top."""
    return F.regexp_extract(F.coalesce(col(x), F.lit("")), r"(?s)^(.+) > ", 1)
