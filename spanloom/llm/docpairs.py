"""Functions paired with their documentation.

Comment spans are found in the files, function spans are those of the functions' rows; neither knows
of the other. An as-of interval join then gives each function the nearest comment that ends above it
with no statement in between. Descriptions that say nothing are left out.
"""

from __future__ import annotations

import ast
import re
import textwrap
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import lexing
from spanloom.llm.language import EAST, code_language, comment_text, literal_text
from spanloom.operators.joins import containing

#: Words that alone describe nothing. Fixed values.
HOLLOW = frozenset(
    "a an the this function func method routine procedure helper helpers summary description brief desc doc docs docstring documentation comment comments note notes"
    " pending none null nil na n unavailable available missing empty unknown unspecified undocumented undefined placeholder tbd tba todo fixme xxx hack wip no not yet"
    " to be done add document describe me here write default internal private public local static misc miscellaneous utility utilities util utils globals global types"
    " includes constants macros prototypes declarations definitions implementation section data variables return returns param params parameter parameters args arguments".split()
)
REMINDER = re.compile(r"^\W*(?:TODO|FIXME|XXX|HACK|TBD|TBA|WIP|to ?do\b\s*:|fix ?me\b|to be (?:done|documented|written|completed|described)\b)", re.I)
POINTER = re.compile(
    r"^\W*(?:see|see also|cf\.?|refer to|as above|as below|same as|like|ditto|siehe|voir|ver|véase|vedi|zob\.?|patrz|см\.?|смотри|inherit(?:ed|s)?|\{?@inheritdoc\}?|@copydoc|@see|copied from|documented in)(?![^\W_])[^.;!?]{0,80}[.;!?]?\W*$",
    re.I,
)
TAG = re.compile(r"^\s*(?:[@\\](param|arg|return|returns|retval|ret|tparam|throws|exception|see|sa|ref|todo|file|author|date|version|since|ingroup|defgroup|addtogroup|name|fn|def|note|warning|brief|details|short)\b(?:\[[^\]]*\])?|:(param|return|returns|rtype|type|raises|arg)\b([^:]*):?|(Args|Arguments|Parameters|Returns|Raises|Yields)\s*:\s*$)\s*(.*)$", re.I)
TEXT_TAGS = frozenset(("brief", "details", "short", "note", "warning"))
RULE = re.compile(r"^[\W_]*$")
HEADING = re.compile(r"^\s*([=\-*#~_+/<>|]{2,})\s*(.*?)\s*[=\-*#~_+/<>|]{2,}\s*$")
CODE = re.compile(r"[;{}]\s*$|^\s*(?:if|for|while|switch|return|else|case|elif|import|from|def|class|with|try|except|goto|break|continue)\b.*[;:({=)]|[^=!<>]=[^=]|==|!=|->|\+\+|--|&&|\|\||<<|>>|\w\(.*\)|^\s*#\s*(?:if|define|include|endif|else)\b|^[\s{}()\[\];,]+$")
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\d_A-Za-z]+")


def name_parts(name: str | None) -> frozenset[str]:
    """The lower-case words of an identifier."""
    return frozenset(p.lower() for p in NAME_PART.findall(name or ""))


def looks_like_code(line: str) -> bool:
    """Whether a line is a piece of code rather than a sentence."""
    if not CODE.search(line):
        return False
    prose = re.sub(r"\w*\([^()]*\)|\w+(?:->|\.)\w+", " ", line)
    return not re.search(r"(?:[^\W\d_]{2,}(?:['’-][^\W\d_]+)*[,.:]?\s+){3,}[^\W\d_]{2,}", prose) or bool(re.search(r"[;{}]\s*$", line))


def description(text: str | None, name: str | None = None) -> str:
    """What ``text`` says of the function ``name``; empty if it says nothing.

    Decoration, headings, tags without text, placeholders, reminders, pointers elsewhere, code and
    the function's own name go. Null is empty.
    """
    if not text:
        return ""
    own = name_parts(name)
    kept: list[str] = []
    tagged = False  # after a parameter's tag: what goes on there isn't about the function
    for line in text.split("\n"):
        line = line.strip().strip("*").strip() if not line.strip().startswith("**") else line.strip().strip("*").strip()
        if RULE.match(line) and not EAST.search(line):
            tagged = False
            continue
        if HEADING.match(line):
            continue
        if m := TAG.match(line):
            word = (m[1] or m[2] or m[4] or "").lower()
            tagged = word not in TEXT_TAGS
            if tagged:
                continue
            line = m[5]
            if not line:
                continue
        elif tagged:
            continue
        if REMINDER.match(line) or POINTER.match(line) or looks_like_code(line):
            continue
        kept.append(line)
    said = " ".join(kept)
    if name:
        said = re.sub(rf"(?<!\w){re.escape(name)}(?!\w)(?:\(\))?\s*[:.\-]*", " ", said)
    if POINTER.match(said) or REMINDER.match(said):
        return ""
    if len(EAST.findall(said)) >= 4:
        return " ".join(" ".join(kept).split())
    words = [w.lower() for w in WORD.findall(said)]
    telling = [w for w in words if w not in HOLLOW and w not in own]
    # the words of the name alone tell nothing; a sentence may use some of them
    if not telling or len(words) < 2:
        return ""
    if len(telling) < 2 and len(words) < 3:
        return ""
    return " ".join(" ".join(kept).split())


def docstring(source: str) -> str | None:
    """The docstring of a Python function's source, whether or not all of it parses."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            body = ast.parse(textwrap.dedent(source)).body
        if body and isinstance(body[0], (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            return ast.get_docstring(body[0])
        return None
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        pass
    m = re.search(r"\bdef\b[^\n]*", source)
    depth, at = 0, m.start() if m else 0
    while at < len(source):
        c = source[at]
        depth += (c in "([{") - (c in ")]}")
        if c == ":" and depth <= 0:
            break
        at += 1
    m = re.compile(r"(?:\s|#[^\n]*)*").match(source, at + 1)
    start = m.end() if m else at + 1
    found = lexing.PY_SPAN.match(source, start)
    return textwrap.dedent(literal_text(found[0])) if found and found.lastgroup == "str" else None


#: Files are cut into chunks of about so many characters for the lexer's state maps.
FILE_CHUNK_CHARS = 1024


def comment_spans(lang: str, text: str) -> list[tuple[int, int, str]]:
    """(last line, line of the next statement, text) of each comment on lines of its own; 0 where no statement follows.

    Adjoining line comments are one. A comment with code on its first or last line is none of these.
    """
    pieces = lexing.chunks(text, FILE_CHUNK_CHARS)
    states = lexing.start_states([lexing.state_map(lang, p) for p in pieces]) if len(pieces) > 1 else [lexing.CODE]
    spans: list[tuple[str, int, int]] = []
    base = 0
    for piece, state in zip(pieces, states):
        for kind, a, b in lexing.spans(lang, piece, state):
            if state and a == 0 and spans and spans[-1][2] == base:
                spans[-1] = (spans[-1][0], spans[-1][1], base + b)
            else:
                spans.append((kind, base + a, base + b))
        base += len(piece)
    out: list[tuple[int, int, str]] = []
    waiting: list[list] = []  # comments before the next statement: [last line, end offset, kind, texts]
    line, counted = 1, 0

    def statement(start: int, upto: int) -> None:
        """Code stands between the offsets ``start`` and ``upto``, or begins at ``upto``."""
        gap = text[start:upto]
        blank = len(gap) - len(gap.lstrip())
        at = (line_at(start) + gap[:blank].count("\n")) if gap.strip() or upto < len(text) else 0
        out.extend((w[0], at, "\n".join(w[3])) for w in waiting)
        waiting.clear()

    def line_at(offset: int) -> int:
        return line + text.count("\n", counted, offset) if offset >= counted else line - text.count("\n", offset, counted)

    end = 0
    for kind, a, b in spans:
        comment = kind in ("line", "block")
        if text[end:a].strip() or not comment:
            statement(end, a)
        if comment:
            line, counted = line_at(a), a
            last = line + text.count("\n", a, b)
            start, stop = text.rfind("\n", 0, a) + 1, text.find("\n", b)
            if text[start:a].strip() or text[b : len(text) if stop < 0 else stop].strip():
                statement(a, a)
            elif waiting and kind == "line" and waiting[-1][2] == "line" and line == waiting[-1][0] + 1:
                waiting[-1] = [last, b, kind, [*waiting[-1][3], comment_text(text[a:b])]]
            else:
                waiting.append([last, b, kind, [comment_text(text[a:b])]])
        end = b
    statement(end, len(text))
    return out


def comment_rows(files: DataFrame) -> DataFrame:
    """``at`` (process and path), ``last``, ``next`` and ``comment``: the comment spans of all C and Python files."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(q, p, *c) for q, p, g, t in zip(b["process_name"], b["path"], b["lexer"], b["content"]) for c in comment_spans(g, lexing.unify(t))]
            yield pd.DataFrame(rows, columns=["process_name", "path", "last", "next", "comment"])

    lexer = code_language(F.col("path"))
    sources = files.where("content is not null and path is not null").select("process_name", "path", lexer.alias("lexer"), "content").where("lexer <> 'json'")
    found = sources.mapInPandas(find, "process_name string, path string, last int, next int, comment string")
    return found.select(F.struct("process_name", "path").alias("at"), "last", "next", "comment")


def nearest_comments(functions: DataFrame, files: DataFrame, max_gap: int = 0) -> DataFrame:
    """``id``, ``name``, ``comment``: for each function span the nearest comment span that ends above its start.

    An as-of interval join: a comment can serve starts from the line below it to ``max_gap`` blank
    lines further, but not beyond the next statement; of those that can serve, the last one counts.
    """
    spans = comment_rows(files).withColumn("upto", F.col("last") + 1 + max_gap).withColumn("upto", F.when(F.col("next") > 0, F.least("upto", "next")).otherwise(F.col("upto")))
    starts = functions.where("source is not null and file is not null and start_line > 0").select(
        "id", "name", F.col("start_line").alias("line"), F.struct("process_name", F.col("file").alias("path")).alias("at")
    )
    met = containing(starts, spans.withColumn("from", F.col("last") + 1), "at", "line", "from", "upto")
    return met.groupBy("id", "name", "at", "line").agg(F.max(F.struct("last", "comment")).alias("c")).select("id", "name", "c.comment")


ORIGINS = ("comment", "docstring", "summary")


def descriptions(functions: DataFrame, files: DataFrame, max_gap: int = 0) -> DataFrame:
    """``id``, ``description``, ``origin`` of the functions whose documentation says something, once each.

    ``origin`` is where the description is from, the first that says something: ``comment`` (ending
    on the line above ``start_line``, or up to ``max_gap`` blank lines above it), ``docstring`` or
    ``summary``. Functions with a null source are left out; of equal ids the best row counts.
    A null file, or an unknown line (below 1), has no comment; a file without a row neither. Files
    are met by process and path (null equals null). Sources are read where they lie and not shuffled.
    """
    kind = functions.schema["id"].dataType.simpleString()
    out = f"id {kind}, rank int, description string"

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, name, lexer, summary, source in zip(b["id"], b["name"], b["lexer"], b["summary"], b["source"]):
                said = description(docstring(lexing.unify(source)), name) if lexer == "py" else ""
                rank = 1
                if not said:
                    said, rank = description(summary, name), 2
                if said:
                    rows.append((key, rank, said))
            yield pd.DataFrame(rows, columns=["id", "rank", "description"])

    def above(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            said = [description(c, n) for c, n in zip(b["comment"], b["name"])]
            yield pd.DataFrame({"id": b["id"], "rank": 0, "description": said})[[bool(x) for x in said]]

    inside = functions.where("source is not null").select("id", "name", code_language(F.col("file")).alias("lexer"), "summary", "source").mapInPandas(own, out)
    rows = inside.unionByName(nearest_comments(functions, files, max_gap).mapInPandas(above, out))
    best = rows.groupBy("id").agg(F.min("rank").alias("rank"), F.max_by("description", F.struct(-F.col("rank"), "description")).alias("description"))
    return best.select("id", "description", F.element_at(F.array(*map(F.lit, ORIGINS)), F.col("rank") + 1).alias("origin"))


def documented(functions: DataFrame, files: DataFrame, max_gap: int = 0) -> DataFrame:
    """:func:`descriptions` with the ``source`` of each function (of equal ids the greatest)."""
    sources = functions.where("source is not null").groupBy("id").agg(F.max("source").alias("source"))
    return descriptions(functions, files, max_gap).join(sources, "id").select("id", "source", "description", "origin")
