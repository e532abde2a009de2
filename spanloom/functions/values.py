"""Column functions on C values, labels and statuses."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PRODUCERS = ("ADDQUE", "WRITE", "WRITEREC", "UPDATEREC", "FWRITE")
CONSUMERS = ("DELQUE", "READ", "GETREC")
WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*|\d+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
#: Kana, ideographs and half-width kana.
CJK = re.compile("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uff66-\uff9f]+")


def c_int(text: Column) -> Column:
    """A C integer literal as a number: sign, hex, binary, leading-zero octal, suffixes u and l; null if it is none."""
    t = F.regexp_replace(F.trim(text), r"[uUlL]+$", "")
    sign = F.when(t.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    body = F.regexp_replace(t, r"^[+-]\s*", "")
    number = (
        F.when(body.rlike(r"^0[xX][0-9a-fA-F]{1,15}$"), F.conv(F.substring(body, 3, 32), 16, 10))
        .when(body.rlike(r"^0[bB][01]{1,62}$"), F.conv(F.substring(body, 3, 64), 2, 10))
        .when(body.rlike(r"^0[0-7]{1,20}$"), F.conv(body, 8, 10))
        .when(body.rlike(r"^(0|[1-9][0-9]{0,17})$"), body)
    )
    return sign * number.try_cast("bigint")


def base_expression(text: Column) -> Column:
    """An expression without a trailing ``+ n`` or ``- n``."""
    return F.regexp_replace(F.trim(text), r"\s*[+-]\s*[0-9]+$", "")


def is_dynamic(text: Column) -> Column:
    """Whether an expression reads a field or an array element."""
    return F.coalesce(text.rlike(r"->|\[|\w\.\w"), F.lit(False))


def confidence(text: Column) -> Column:
    """How sure a raw expression is: literal, macro, dynamic, or expression; none for nothing."""
    t = F.trim(text)
    return (
        F.when(t.isNull() | (t == ""), "none").when(c_int(t).isNotNull(), "literal").when(t.rlike(r"^[A-Z_][A-Z0-9_]*$"), "macro")
        .when(is_dynamic(t), "dynamic").otherwise("expression")
    )


def direction(operation: Column) -> Column:
    """producer, consumer or both."""
    return F.when(operation.isin(*PRODUCERS), "producer").when(operation.isin(*CONSUMERS), "consumer").otherwise("both")


def resource_kind(operation: Column) -> Column:
    """The kind of resource an operation works on; tests run in this order."""
    return (
        F.when(operation.contains("QUE"), "queue").when(operation.contains("PROC"), "process").when(operation.contains("REC"), "record_file")
        .when(operation.isin("READ", "WRITE", "FWRITE"), "file").otherwise("other")
    )


def in_process(path: Column, prefix: Column) -> Column:
    """Whether a path is ``prefix`` or below it; an empty prefix accepts all."""
    return (prefix == "") | (path == prefix) | path.startswith(F.concat(prefix, F.lit("/")))


def source_root(process_root: Column) -> Column:
    """The root that a process's paths are relative to: above ``t-*/src/<process>``, else the process's folder."""
    above = F.regexp_extract(process_root, r"^(.*)/t-[^/]+/src/[^/]+$", 1)
    return F.when(above != "", above).otherwise(process_root)


def numbered(source: Column) -> Column:
    """Source lines with right-aligned numbers of width 5."""
    lines = F.split(source, "\n")
    return F.array_join(F.transform(lines, lambda x, i: F.concat(F.lpad((i + 1).cast("string"), 5, " "), F.lit(" "), x)), "\n")


def signature(source: Column) -> Column:
    """The first line that is not blank and no comment."""
    lines = F.filter(F.split(source, "\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).rlike(r"^(//|/\*|\*|#)"))
    return F.when(F.size(lines) > 0, F.trim(lines[0]))


def whole_tokens(text: str | None) -> list[str]:
    """The tokens of a text after NFKC: identifiers with their snake and camel parts, numbers, and character bigrams of CJK runs, lower case."""
    plain, out = unicodedata.normalize("NFKC", text or ""), []
    for match in WORD.finditer(plain):
        word = match.group().strip("_")
        if not word:
            continue
        parts = [p for piece in word.split("_") for p in CAMEL.split(piece) if p]
        out += [x.lower() for x in ([word, *parts] if len(parts) > 1 else [word])]
    for run in CJK.findall(plain):
        out += [run[i : i + 2] for i in range(max(len(run) - 1, 1))]
    return out


def nfkc(text: Column) -> Column:
    """A text in its compatibility form (NFKC), which Spark has no function for."""

    def form(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else t if t.isascii() else unicodedata.normalize("NFKC", t))

    return F.pandas_udf(form, "string")(text)


def tokens(text: Column) -> Column:
    """:func:`whole_tokens` of a column, in Arrow batches."""

    def split(texts: pd.Series) -> pd.Series:
        return texts.map(whole_tokens)

    return F.pandas_udf(split, "array<string>")(text)
