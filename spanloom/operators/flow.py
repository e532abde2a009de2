"""Backward value flow over scanned C sources: which constants reach which argument, and why not.

Every function parameter is a goal. An argument's text is a literal, a macro of its file, a
parameter of the function around it, or unknown; a parameter's values are those of all calls of its
function. The least fixpoint is found semi-naively (:func:`spanloom.operators.graph.goal_values`).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.cexpr import c_formula
from spanloom.operators.csource import DIRECTIVE, HEAD, NOT_CALLS, blanked, plain, scan
from spanloom.operators.graph import goal_values
from spanloom.operators.skew import sized_broadcast


def _split(text: str, code: str, start: int) -> tuple[list[str], int]:
    """The top-level comma parts of the parenthesis that opens at ``start``, and where it closes."""
    depth, parts, at = 0, [], start + 1
    for i in range(start, len(code)):
        c = code[i]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if not depth:
                last = text[at:i].strip()
                return (parts + [last] if parts or last else parts), i
        elif c == "," and depth == 1:
            parts.append(text[at:i].strip())
            at = i + 1
    return [], len(code)


def flow_rows(text: str) -> list[tuple[str, str, str, int, int, str]]:
    """(what, function, callee, line, position, text): static functions, parameters, and arguments of the calls within functions."""
    text = plain(text)
    code = DIRECTIVE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), blanked(text))
    starts = [0]
    for line in code.split("\n"):
        starts.append(starts[-1] + len(line) + 1)
    rows = []
    for what, name, first, last, detail in scan(text):
        if what != "function":
            continue
        if detail == "static":
            rows.append(("static", name, "", first, 0, ""))
        begin, end = starts[first - 1], starts[last] if last < len(starts) else len(code)
        head = re.compile(rf"\b{re.escape(name)}\s*\(").search(code, begin, end)
        if not head:
            continue
        params, close = _split(text, code, head.end() - 1)
        for i, p in enumerate(params):
            ids = re.findall(r"[A-Za-z_]\w*", p)
            if len(ids) > 1 or ids and ids != ["void"]:
                rows.append(("param", name, "", first, i + 1, ids[-1]))
        for call in HEAD.finditer(code, close + 1, end):
            if call[1] not in NOT_CALLS:
                args, _ = _split(text, code, call.end() - 1)
                line = code.count("\n", 0, call.start()) + 1
                rows += [("arg", name, call[1], line, i + 1, " ".join(a.split())) for i, a in enumerate(args)]
    return rows


def scanned_flow(files: DataFrame) -> DataFrame:
    """``process, path, what, function, callee, line, position, text`` of all C files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(q, p, *r) for q, p, t in zip(b["process"], b["path"], b["content"]) for r in flow_rows(t)]
            yield pd.DataFrame(rows, columns=["process", "path", "what", "function", "callee", "line", "position", "text"])

    c = files.where("content is not null").where(F.lower("path").rlike(r"\.[ch]$")).select(F.coalesce("process_name", F.lit("")).alias("process"), "path", "content").distinct()
    return c.mapInPandas(run, "process string, path string, what string, function string, callee string, line int, position int, text string")


def argument_values(flow: DataFrame, macros: DataFrame, targets: DataFrame) -> DataFrame:
    """``path, line, callee, position, text, kind, value`` for each argument of a call of one of ``targets`` (name).

    ``macros`` has path, name, value (a file's first definition). A goal is a parameter of a function
    of a process; a static function, and a call of one in its file, is one of that file. Kinds: CONST, MACRO, PARAM (a value
    from a caller), EXTERNAL_ENTRY (a parameter nobody passes), UNRESOLVED. An argument that several
    values reach has several rows. Nothing is dropped: what is not understood is UNRESOLVED.
    """
    args = flow.where("what = 'arg'").drop("what")
    params = flow.where("what = 'param'").select("process", "path", "function", F.col("position").alias("p"), F.col("text").alias("text"))
    statics = flow.where("what = 'static'").select("process", "path", F.col("function").alias("callee"), F.lit(True).alias("own")).distinct()
    known = args.join(macros.withColumnRenamed("name", "text").withColumnRenamed("value", "body"), ["path", "text"], "left").join(params, ["process", "path", "function", "text"], "left")
    known = known.join(statics, ["process", "path", "callee"], "left").join(statics.select("process", "path", F.col("callee").alias("function"), F.col("own").alias("inside")), ["process", "path", "function"], "left")
    const = c_formula(F.col("text"))
    valued = known.withColumn("value", F.coalesce(F.when(F.col("text").rlike(r"[0-9]"), const), c_formula(F.col("body"))))
    goal = lambda f, p, static: F.concat_ws("#", "process", F.when(static, F.col("path")), f, p.cast("string"))
    valued = valued.withColumns({
        "kind": F.when(F.col("p").isNotNull(), "PARAM").when(F.col("value").isNull(), "UNRESOLVED").when(F.col("body").isNotNull(), "MACRO").otherwise("CONST"),
        "sub": F.when(F.col("p").isNotNull(), goal(F.col("function"), F.col("p"), F.col("inside"))), "goal": goal(F.col("callee"), F.col("position"), F.col("own")),
    })
    facts = valued.where("kind <> 'PARAM'").select("goal", F.concat_ws("|", "kind", F.col("value").cast("string")).alias("value"))
    every = params.join(statics.withColumnRenamed("callee", "function"), ["process", "path", "function"], "left").select(goal(F.col("function"), F.col("p"), F.col("own")).alias("goal")).distinct()
    entry = every.join(valued.select("goal").distinct(), "goal", "left_anti").select("goal", F.lit("EXTERNAL_ENTRY").alias("value"))
    reach = goal_values(valued.where("sub is not null").select("goal", "sub"), "goal", "sub", facts.unionByName(entry))
    names = targets.select(F.col("name").alias("callee")).distinct()
    at = valued.join(sized_broadcast(names, targets.count()), "callee")
    keep = ["path", "line", "callee", "position", "text"]
    own = at.where("sub is null").select(*keep, "kind", "value")
    from_callers = at.where("sub is not null").join(reach.select(F.col("goal").alias("sub"), F.col("value").alias("reached")), "sub", "left").select(
        *keep,
        F.when(F.col("reached") == "EXTERNAL_ENTRY", "EXTERNAL_ENTRY").when(F.col("reached").startswith("UNRESOLVED") | F.col("reached").isNull(), "UNRESOLVED").otherwise("PARAM").alias("kind"),
        F.when(F.col("reached").contains("|"), F.substring_index("reached", "|", -1)).try_cast("bigint").alias("value"),
    )
    return own.unionByName(from_callers).distinct()
