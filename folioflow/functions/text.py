"""Text as Columns: normal form, JSON strings, hashes, markers, labels."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whitespace as Python's str.split sees it (Java's class lacks U+001C..001F).
SPACE = "(?U)[\\s\\x1c-\\x1f]+"
#: Leading list markers (fixed pattern): numbers, ordinals of the Korean alphabet, circled numbers, bullets.
LIST_MARKER = "^\\s*(\\d+[.)](?!\\s*\\d+[.)](?:\\s|$|\\d+[.)]))|\\(\\d+\\)|[가나다라마바사아자차카타파하][.)]|[①-⑳]|[□■○●◦◆◇▶▷\\-–•※ㅇㆍ·∙‣▸▪⇨→])\\s"


def _normalized(values: pa.Array, form: str, one) -> pa.Array:
    """``one`` of each text in a Unicode normal form; texts of ASCII alone are in every form."""
    plain = pc.string_is_ascii(values).to_pylist()
    out = []
    for text, ascii_only in zip(values.to_pylist(), plain):
        if text is not None and not ascii_only and not unicodedata.is_normalized(form, text):
            text = unicodedata.normalize(form, text)
        out.append(None if text is None else one(text))
    return out


def normalized(text: Column, form: str = "NFKC") -> Column:
    """The text in a Unicode normal form, in one Arrow pass."""
    @F.arrow_udf("string")
    def normal(values: pa.Array) -> pa.Array:
        return pa.array(_normalized(values, form, lambda t: t), pa.string())

    return normal(text)


def normal_text(text: Column) -> Column:
    """NFKC with whitespace runs as one blank and none at the ends, in one Arrow pass."""
    @F.arrow_udf("string")
    def normal(values: pa.Array) -> pa.Array:
        return pa.array(_normalized(values, "NFKC", lambda t: " ".join(t.split())), pa.string())

    return normal(text)


def normal_lines(text: Column) -> Column:
    """:func:`normal_text` of each line of a text: whole texts visit Python, once."""
    @F.arrow_udf("array<string>")
    def normal(values: pa.Array) -> pa.Array:
        return pa.array(_normalized(values, "NFKC", lambda t: [" ".join(line.split()) for line in t.split("\n")]), pa.list_(pa.string()))

    return normal(text)


def unicode_normal(df: DataFrame, column: str, form: str = "NFKC") -> DataFrame:
    """``column`` in a Unicode normal form; the input is read once."""
    return df.withColumn(column, normalized(F.col(column), form))


def collapse(text: Column) -> Column:
    """Whitespace runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def json_string(text: Column) -> Column:
    """The text as a JSON string literal, non-ASCII kept, control escapes in lower case; null as ``null``."""
    quoted = F.to_json(F.struct(text.alias("x")))
    out = F.substring(quoted, F.lit(6), F.length(quoted) - 6)
    lower = out
    for code in ("0B", "0E", "0F", *(f"1{d}" for d in "ABCDEF"), "7F"):
        lower = F.regexp_replace(lower, f"(?<!\\\\)((?:\\\\\\\\)*)\\\\u00{code}", f"$1\\\\u00{code.lower()}")
    out = F.when(out.contains("\\u00"), lower).otherwise(out)  # control characters are rare
    return F.when(text.isNull(), "null").otherwise(out)


def content_hash(kind: Column, text: Column, level: Column | None = None, table_json: Column | None = None, asset: Column | None = None) -> Column:
    """Hash of a block's content: ``c_`` and 32 hex digits of the canonical JSON's SHA-256.

    ``text`` is in normal form; ``table_json`` is :func:`table_json`; the
    figure's asset takes part only where there is one.
    """
    level = F.lit(None).cast("int") if level is None else level
    table = F.lit("null") if table_json is None else F.coalesce(table_json, F.lit("null"))
    figure = F.lit("") if asset is None else F.when(asset.isNotNull(), F.concat(F.lit('"figure":'), json_string(asset), F.lit(","))).otherwise("")
    body = F.concat(F.lit("{"), figure, F.lit('"kind":'), json_string(kind), F.lit(',"level":'), F.coalesce(level.cast("string"), F.lit("null")), F.lit(',"table":'), table, F.lit(',"text":'), json_string(text), F.lit(',"v":"norm-v1"}'))
    return F.concat(F.lit("c_"), F.substring(F.sha2(body, 256), 1, 32))


def table_json(n_rows: Column, n_cols: Column, cells: Column) -> Column:
    """Canonical JSON of a table's cells (row, col, rowspan, colspan, header, normal text), by row and column."""
    ordered = F.array_sort(F.transform(cells, lambda c: F.struct(c["row"].alias("row"), c["col"].alias("col"), c["rowspan"].alias("rowspan"), c["colspan"].alias("colspan"), c["header"].alias("header"), c["text"].alias("text"))))
    one = lambda c: F.concat(F.lit("["), F.concat_ws(",", c["row"].cast("string"), c["col"].cast("string"), c["rowspan"].cast("string"), c["colspan"].cast("string"), json_string(c["header"]), json_string(c["text"])), F.lit("]"))
    return F.concat(F.lit('{"cells":['), F.array_join(F.transform(ordered, one), ","), F.lit('],"n_cols":'), n_cols.cast("string"), F.lit(',"n_rows":'), n_rows.cast("string"), F.lit("}"))


def block_id(document_id: Column, content: Column, occurrence: Column) -> Column:
    return F.concat(F.lit("b_"), F.substring(F.sha2(F.concat_ws(chr(31), document_id.cast("string"), content, occurrence.cast("string")), 256), 1, 24))


def document_id(content: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(F.sha2(content, 256), 1, 24))


def asset_key(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def has_list_marker(text: Column) -> Column:
    return text.rlike(LIST_MARKER)


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def is_private_use(char: Column) -> Column:
    code = F.ascii(char)
    return ((code >= 0xE000) & (code <= 0xF8FF)) | (code >= 0xF0000)


def locator_label(locator: Column) -> Column:
    """Where a block is, in words."""
    k = locator["kind"]
    return (
        F.when(k == "page", F.concat(F.lit("page "), locator["page"].cast("string")))
        .when(k == "lines", F.concat(F.lit("lines "), locator["line_start"].cast("string"), F.lit("-"), locator["line_end"].cast("string")))
        .when(k == "slide", F.concat(F.lit("slide "), locator["slide"].cast("string")))
        .otherwise(F.concat(F.lit("paragraph "), (locator["paragraph_index"] + 1).cast("string")))
    )


def size_step(size: Column) -> Column:
    return F.bround(size / 0.5) * 0.5
