"""What happens inside C functions: which definitions reach a call's arguments, under which guards, with which handles.

A body is parsed into statements and walked once with an environment of reaching definitions. Arms of
if and switch are merged; a missing else or default keeps what was before; a branch that returns
takes its definitions and closed handles with it. Nothing is guessed: what is not understood is an
update or unknown, never the nearest line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.cexpr import c_formula, evaluate
from spanloom.operators.csource import DIRECTIVE, HEAD, HIDDEN, NOT_CALLS, TYPES, blanked, plain, scan

TOKEN = re.compile(r"[A-Za-z_]\w*|\d[\w.]*|<<=|>>=|[-+*/%&|^]=|\+\+|--|==|!=|<=|>=|&&|\|\||->|\.\.\.|[^\s\w]")
NAME = re.compile(r"[A-Za-z_]\w*\Z")
#: Functions that write their second argument's text to their first.
STRING_WRITES = frozenset("strcpy strncpy strlcpy sprintf snprintf memcpy".split())
MOST_SELECTED = 32
Env = dict[str, frozenset[tuple[str, str, int]]]


def _joined(envs: list[Env | None]) -> Env | None:
    live = [e for e in envs if e is not None]
    if not live:
        return None
    out = dict(live[0])
    for e in live[1:]:
        for n in e.keys() | out.keys():
            out[n] = out.get(n, frozenset({("undefined", "", 0)})) | e.get(n, frozenset({("undefined", "", 0)}))
    return out


class Body:
    """One function's walk; ``calls`` maps (offset) to what is known of each call."""

    def __init__(self, text: str, code: str, line_of, begin: int, end: int, closes: frozenset[str]):
        self.text, self.line_of, self.closes = text, line_of, closes
        self.t = [(m[0], m.start()) for m in TOKEN.finditer(code, begin, end)]
        self.t.append((";", end))
        self.calls: dict[int, dict] = {}
        self.exits: list[list[Env | None]] = []
        self.guards: list[str] = []
        self.updated: dict[str, int] = {}  # first line where a name is assigned, updated or its address taken

    def source(self, a: int, b: int) -> str:
        """The text of tokens a to b."""
        return " ".join(self.text[self.t[a][1] : self.t[b][1] if b < len(self.t) else self.t[-1][1]].split()) if a < b else ""

    def close(self, i: int) -> int:
        """The partner of the bracket at token i."""
        depth = 0
        for k in range(i, len(self.t)):
            x = self.t[k][0]
            depth += (x in "([{") - (x in ")]}") if len(x) == 1 else 0
            if not depth:
                return k
        raise IndexError

    def semicolon(self, i: int) -> int:
        depth = 0
        for k in range(i, len(self.t)):
            x = self.t[k][0]
            if x == ";" and depth <= 0:
                return k
            depth += (x in "([{") - (x in ")]}") if len(x) == 1 else 0
        raise IndexError

    def skip(self, i: int) -> int:
        """The token after the statement at i."""
        x = self.t[i][0]
        if x == "{":
            return self.close(i) + 1
        if x == "if":
            k = self.skip(self.close(i + 1) + 1)
            return self.skip(k + 1) if self.t[k][0] == "else" else k
        if x in ("while", "for", "switch"):
            return self.skip(self.close(i + 1) + 1)
        if x == "do":
            return self.semicolon(self.skip(i + 1)) + 1
        return self.semicolon(i) + 1

    def block(self, i: int, end: int, env: Env | None) -> Env | None:
        while i < end:
            env = self.statement(i, env)
            i = self.skip(i) if self.t[i][0] not in ("case", "default") else self.colon(i) + 1
        return env

    def colon(self, i: int) -> int:
        depth = 0
        for k in range(i, len(self.t)):
            x = self.t[k][0]
            if x == ":" and not depth:
                return k
            depth += (x == "?") - (x == ":" and depth > 0)
        raise IndexError

    def guarded(self, guard: str, i: int, env: Env | None) -> Env | None:
        self.guards.append(guard)
        env = self.statement(i, env)
        self.guards.pop()
        return env

    def statement(self, i: int, env: Env | None) -> Env | None:
        if env is None:
            return None
        x = self.t[i][0]
        if x == "{":
            return self.block(i + 1, self.close(i), env)
        if x == "if":
            c = self.close(i + 1)
            cond = self.source(i + 2, c)
            env = self.effects(i + 2, c, env, "condition")
            then = self.guarded(cond, c + 1, dict(env))
            k = self.skip(c + 1)
            other = self.guarded(f"!({cond})", k + 1, dict(env)) if self.t[k][0] == "else" else env
            return _joined([then, other])
        if x in ("while", "for"):
            c = self.close(i + 1)
            bound = None
            if x == "for":
                a = self.semicolon(i + 2)
                b = self.semicolon(a + 1)
                env = self.effects(i + 2, a, env, "ignored")
                cond, step, bound = (a + 1, b), (b + 1, c), self.bounds(i + 2, a, b, c, env)
            else:
                cond, step = (i + 2, c), (c, c)
            env = self.effects(*cond, env, "condition")
            for _ in range(2):  # what the body defines reaches its beginning
                inside = dict(env)
                if bound:
                    inside[bound[0]] = frozenset({("range", bound[1], self.line_of(self.t[i][1]))})
                self.exits.append([])
                end = self.guarded(self.source(*cond), c + 1, inside)
                left = self.exits.pop()
                if end is not None:
                    end = self.effects(*step, end, "ignored")
                env = _joined([env, end, *left])
            return env
        if x == "do":
            self.exits.append([])
            end = self.statement(i + 1, env)
            left = self.exits.pop()
            k = self.skip(i + 1)
            if end is not None:
                end = self.effects(k + 2, self.close(k + 1), end, "condition")
            return _joined([end, *left])
        if x == "switch":
            return self.switch(i, env)
        if x in ("break", "continue"):
            if self.exits:
                self.exits[-1].append(env)
            return None
        if x == "return":
            self.effects(i + 1, self.semicolon(i), env, "returned")
            return None
        if x in ("case", "default"):
            return env
        return self.effects(i, self.semicolon(i), env, "ignored")

    def switch(self, i: int, env: Env) -> Env | None:
        c = self.close(i + 1)
        on = self.source(i + 2, c)
        entry = self.effects(i + 2, c, env, "condition")
        end, k, now, default = self.close(c + 1), c + 2, None, False
        self.exits.append([])
        self.guards.append("")
        while k < end:
            if self.t[k][0] in ("case", "default"):
                e = self.colon(k)
                default = default or self.t[k][0] == "default"
                self.guards[-1] = f"{on} == {self.source(k + 1, e)}" if self.t[k][0] == "case" else f"{on} is none"
                now, k = _joined([now, dict(entry)]), e + 1
                continue
            now = self.statement(k, now)
            k = self.skip(k)
        self.guards.pop()
        return _joined([now, *self.exits.pop(), None if default else entry])

    def bounds(self, init: int, a: int, b: int, c: int, env: Env) -> tuple[str, str] | None:
        """(variable, start:stop:step) of a for loop with constant bounds."""
        m = re.fullmatch(r"(?:int |unsigned |long )?([A-Za-z_]\w*) = ([^,=]+)", self.source(init, a))
        if not m:
            return None
        name = m[1]
        n = re.fullmatch(rf"{name} (<|<=) (.+)|{name}(<|<=)(.+)", self.source(a + 1, b))
        s = re.fullmatch(rf"{name} ?\+\+|\+\+ ?{name}|{name} \+= (\d+)", self.source(b + 1, c))
        first, last = evaluate(m[2]), evaluate((n[2] or n[4]) if n else None)
        if not n or not s or first is None or last is None:
            return None
        step = int(s[1] or 1)
        return (name, f"{first}:{last + ((n[1] or n[3]) == '<=')}:{step}") if step else None

    def touched(self, name: str, at: int) -> None:
        self.updated.setdefault(name, self.line_of(at))

    def effects(self, a: int, b: int, env: Env, use: str) -> Env:
        """The calls, then the definitions of an expression or declaration."""
        t = self.t
        env = dict(env)
        declares = a < b and (t[a][0] in TYPES or a + 1 < b and bool(NAME.match(t[a][0])) and (bool(NAME.match(t[a + 1][0])) or t[a + 1][0] == "*" and a + 3 < b and t[a + 3][0] == "="))
        after: list[tuple[str, tuple[str, str, int]]] = []
        for k in range(a, b):
            name, at = t[k]
            if k + 1 < b and t[k + 1][0] == "(" and NAME.match(name) and name not in NOT_CALLS and name not in TYPES:
                after += self.call(k, a, env, use)
        k = a
        while k < b:
            name, at = t[k]
            line = self.line_of(at)
            follows, before = t[k + 1][0] if k + 1 < b else "", t[k - 1][0] if k > a else ""
            if NAME.match(name) and before not in (".", "->") and name not in TYPES:
                if follows == "=" and (before != "*" or declares):
                    e, depth = k + 2, 0
                    while e < b and (depth or t[e][0] not in (",", ";", ")")):
                        depth += (t[e][0] in "([{") - (t[e][0] in ")]}") if len(t[e][0]) == 1 else 0
                        if depth < 0:
                            break
                        e += 1
                    env[name] = frozenset({("definition", self.source(k + 2, e), line)})
                    if not declares:
                        self.touched(name, at)
                elif len(follows) > 1 and follows[-1] == "=" and follows not in ("==", "!=", "<=", ">=") or follows in ("++", "--") or before in ("++", "--"):
                    env[name] = frozenset({("update", self.source(max(a, k - 1) if before in ("++", "--") else k, min(b, k + 3)), line)})
                    self.touched(name, at)
                elif before == "&" and (k - 2 < a or t[k - 2][0] in ("(", ",", "=", "return")):
                    self.touched(name, at)
                elif declares and not follows.startswith("(") and before not in ("(", "=") and (before in TYPES or before in (",", "*") or k > a and NAME.match(before)) and follows in (",", "", "["):
                    env[name] = frozenset({("undefined", "", line)})
            k += 1
        for name, definition in after:
            if not (definition[0] == "output" and name in env and ("definition", definition[1], definition[2]) in env[name]):
                env[name] = frozenset({definition})
        return env

    def call(self, k: int, a: int, env: Env, use: str) -> list[tuple[str, tuple[str, str, int]]]:
        """Note the call at token k; what it writes to its arguments."""
        t, name, at = self.t, self.t[k][0], self.t[k][1]
        end, line = self.close(k + 1), self.line_of(self.t[k][1])
        args, start, depth = [], k + 2, 0
        for e in range(k + 2, end + 1):
            x = t[e][0]
            if e == end or x == "," and not depth:
                if e > start or e < end or args:
                    args.append(" ".join(self.text[t[start][1] if start < e else t[e - 1][1] + len(t[e - 1][0]) : t[e][1]].split()))
                start = e + 1
            depth += (x in "([{") - (x in ")]}") if len(x) == 1 else 0
        before = t[k - 1][0] if k > a else ""
        how = "assigned" if before == "=" else "argument" if before == "," or before == "(" and k - 2 >= a and NAME.match(t[k - 2][0]) and t[k - 2][0] not in NOT_CALLS else use if before in ("", "!") or use != "ignored" else "operand"
        seen = self.calls.setdefault(at, {"callee": name, "line": line, "args": args, "use": how, "guards": [g for g in self.guards if g], "reaching": [set() for _ in args]})
        for n, arg in enumerate(args):
            for inner in re.findall(r"[A-Za-z_]\w*", arg) if re.fullmatch(r"[A-Za-z_]\w*|[A-Za-z_]\w*\s*\[\s*[A-Za-z_]\w*\s*\]", arg) else []:
                seen["reaching"][n] |= {(inner, *d) for d in env.get(inner, ())}
        out = []
        for n, arg in enumerate(args):
            if m := re.fullmatch(r"&\s*([A-Za-z_]\w*)", arg):
                out.append((m[1], ("output", f"{name}#{n + 1}", line)))
        if name in STRING_WRITES and len(args) > 1 and NAME.match(args[0]):
            what = args[1] if "printf" not in name else args[-1]
            out.append((args[0], ("string", what, line)))
        if name in self.closes and args and NAME.match(args[0]):
            out.append((args[0], ("closed", name, line)))
        return out


def bodies(text: str, closes: frozenset[str] = frozenset({"rtx_close", "close", "fclose"})) -> Iterator[tuple[str, list[str], Body]]:
    """(function, parameters, its walked body) of each C function of a file; functions that can't be followed are left out."""
    text = plain(text)
    code = DIRECTIVE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), blanked(text))
    seen = HIDDEN.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][0] == "/" else m[0], text)
    starts = [0]
    for line in code.split("\n"):
        starts.append(starts[-1] + len(line) + 1)

    def line_of(offset: int) -> int:
        lo, hi = 0, len(starts)
        while lo + 1 < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if starts[mid] <= offset else (lo, mid)
        return lo + 1

    for what, name, first, last, _ in scan(text):
        if what != "function":
            continue
        begin, end = starts[first - 1], min(starts[last] if last < len(starts) else len(code), len(code))
        head = re.compile(rf"\b{re.escape(name)}\s*\(").search(code, begin, end)
        open_ = code.find("{", head.end() if head else begin, end)
        stop = code.rfind("}", begin, end)
        if not head or open_ < 0 or stop <= open_:
            continue
        params = [ids[-1] for p in code[head.end() : code.rfind(")", head.end(), open_)].split(",") if (ids := re.findall(r"[A-Za-z_]\w*", p)) and ids != ["void"]]
        body = Body(seen, code, line_of, open_ + 1, stop, closes)
        try:
            body.block(0, len(body.t) - 1, {p: frozenset({("parameter", p, 0)}) for p in params})
        except (IndexError, RecursionError):
            continue
        yield name, params, body


def argument_rows(text: str) -> list[tuple]:
    """(function, line, callee, position, argument, name, kind, definition, defined_at): the definitions that reach each argument that is a name or selects by one."""
    rows = set()
    for function, _, body in bodies(text):
        for c in body.calls.values():
            for n, (arg, reach) in enumerate(zip(c["args"], c["reaching"])):
                rows |= {(function, c["line"], c["callee"], n + 1, arg, *r) for r in reach}
    return sorted(rows)


def call_rows(text: str) -> list[tuple]:
    """(function, line, callee, arguments, use, guards): each call with what is done with its result and the conditions it is under."""
    return sorted((f, c["line"], c["callee"], len(c["args"]), c["use"], " && ".join(c["guards"])) for f, _, b in bodies(text) for c in b.calls.values())


def handle_rows(text: str, opens: frozenset[str] = frozenset({"rtx_open", "open", "fopen"}), closes: frozenset[str] = frozenset({"rtx_close", "close", "fclose"})) -> list[tuple]:
    """(function, line, callee, handle, opened_at, status) of each call on a handle, a name that an opening defines somewhere in the function.

    OPEN: one opening reaches it; AMBIGUOUS: several, or an opening and something else; CLOSED: only
    closed ones; PARAMETER: it comes from the caller; UNKNOWN else.
    """
    rows = set()
    for function, _, body in bodies(text, closes):
        for c in body.calls.values():
            if not c["args"] or not NAME.match(c["args"][0]) or c["callee"] in opens:
                continue
            reach = {r[1:] for r in c["reaching"][0]}
            is_open = lambda r: r[0] == "definition" and r[1].split("(")[0].strip() in opens
            opened = sorted({r[2] for r in reach if is_open(r)})
            if not opened and not any(r[0] == "closed" for r in reach):
                if {r[0] for r in reach} != {"parameter"}:
                    continue
                status = "PARAMETER"
            elif all(r[0] == "closed" for r in reach):
                status = "CLOSED"
            else:
                status = "OPEN" if len(opened) == 1 and all(is_open(r) for r in reach) else "AMBIGUOUS"
            rows.add((function, c["line"], c["callee"], c["args"][0], opened[0] if status == "OPEN" else None, status))
    return sorted(rows, key=str)


TABLE = re.compile(r"(?:^|[;}\n])\s*(?:static\s+)?(?:const\s+)?(?:[A-Za-z_]\w*\s+)+([A-Za-z_]\w*)\s*\[\s*\w*\s*\]\s*=\s*\{([^{}]*)\}\s*;")


def table_rows(text: str) -> list[tuple[str, int, str, int | None]]:
    """(table, position, element, value) of the constant one-dimensional arrays of a file; the value is null where it is no constant."""
    text = plain(text)
    seen = DIRECTIVE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), HIDDEN.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][0] == "/" else m[0], text))
    rows = []
    for m in TABLE.finditer(seen):
        elements = [" ".join(e.split()) for e in m[2].split(",")]
        rows += [(m[1], i, e, evaluate(e)) for i, e in enumerate(elements) if e]
    return rows


def selected_rows(text: str) -> list[tuple]:
    """(function, line, callee, position, argument, table, index, value): the elements that an argument ``table[i]`` may select.

    The index is a constant, a loop variable with constant bounds or a name whose definitions are
    constants; beyond ``MOST_SELECTED`` values, outside the table or otherwise unknown, the index and value are null.
    """
    tables: dict[str, dict[int, int | None]] = {}
    for name, i, _, value in table_rows(text):
        tables.setdefault(name, {})[i] = value
    rows = set()
    for function, _, body in bodies(text):
        for c in body.calls.values():
            for n, (arg, reach) in enumerate(zip(c["args"], c["reaching"])):
                m = re.fullmatch(r"([A-Za-z_]\w*)\s*\[\s*(\w+)\s*\]", arg)
                if not m or m[1] not in tables:
                    continue
                picks: set[int | None] = set()
                if m[2].isdigit():
                    picks.add(int(m[2]))
                for name, kind, what, _ in reach:
                    if name != m[2]:
                        continue
                    if kind == "range":
                        r = range(*map(int, what.split(":")))
                        picks |= set(r) if len(r) <= MOST_SELECTED else {None}
                    else:
                        picks.add(evaluate(what) if kind == "definition" else None)
                for p in picks or {None}:
                    inside = p is not None and p in tables[m[1]]
                    rows.add((function, c["line"], c["callee"], n + 1, arg, m[1], p if inside else None, tables[m[1]][p] if inside else None))
    return sorted(rows, key=str)


def safe_rows(text: str) -> list[tuple[str, str, bool, int | None]]:
    """(function, parameter, safe, first_touched): whether a parameter is never assigned, updated or lent by its address."""
    return [(f, p, p not in b.updated, b.updated.get(p)) for f, params, b in bodies(text) for p in params]


def over_files(files: DataFrame, rows_of, schema: str) -> DataFrame:
    """``process_name``, ``path`` and the columns of ``schema`` from ``rows_of`` each distinct C file's text: one narrow pass."""
    columns = ["process_name", "path", *[c.split()[0] for c in schema.split(", ")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(q, p, *r) for q, p, t in zip(b["process_name"], b["path"], b["content"]) for r in rows_of(t)]
            frame = pd.DataFrame(rows, columns=columns, dtype=object)
            yield frame

    c = files.where("content is not null").where(F.lower("path").rlike(r"\.[ch]$")).select("process_name", "path", "content")
    return c.mapInPandas(run, f"process_name string, path string, {schema}").distinct()


ARGUMENTS = "function string, line int, callee string, position int, argument string"
REACHING = f"{ARGUMENTS}, name string, kind string, definition string, defined_at int"
CALLS = "function string, line int, callee string, arguments int, use string, guards string"
HANDLES = "function string, line int, callee string, handle string, opened_at int, status string"
TABLES = "table string, position int, element string, value bigint"
SELECTED = "function string, line int, callee string, position int, argument string, table string, index bigint, value bigint"
SAFE = "function string, parameter string, safe boolean, first_touched int"


def every_argument(text: str) -> list[tuple]:
    """(function, line, callee, position, argument) of each call."""
    return sorted({(f, c["line"], c["callee"], n + 1, a) for f, _, b in bodies(text) for c in b.calls.values() for n, a in enumerate(c["args"])})


def settled_arguments(files: DataFrame, macros: DataFrame, targets: DataFrame) -> DataFrame:
    """``process_name, path, function, line, callee, position, argument, rule, values``: each argument of a call of ``targets`` (name) by the first rule that fits.

    LITERAL, TABLE (elements that it may select), MACRO (``macros``: path, name, value), OUTPUT (a
    call wrote it), STRING (a string was copied to it), LOCAL (all its definitions are constants),
    PARAMETER (it comes from the caller alone), else UNRESOLVED. ``values`` are sorted and distinct,
    null where the rule has none. One row an argument, none is dropped; equal calls on one line are one.
    """
    site = ["process_name", "path", "function", "line", "callee", "position", "argument"]
    names = targets.select(F.col("name").alias("callee")).distinct()
    args = over_files(files, every_argument, ARGUMENTS).join(names, "callee", "left_semi")
    reach = over_files(files, argument_rows, REACHING).join(names, "callee", "left_semi").where("argument = name")
    selected = over_files(files, selected_rows, SELECTED).join(names, "callee", "left_semi")
    texts = args.select(F.col("argument").alias("text")).union(reach.where("kind = 'definition'").select("definition")).union(macros.select("value")).distinct()
    value = texts.where(F.col("text").rlike("[0-9]")).withColumn("value", c_formula(F.col("text"))).where("value is not null")
    defined = reach.join(value.withColumnRenamed("text", "definition"), "definition", "left").groupBy(*site).agg(
        F.bool_and((F.col("kind") == "definition") & F.col("value").isNotNull()).alias("local"), F.bool_or(F.col("kind") == "output").alias("output"),
        F.bool_or(F.col("kind") == "string").alias("string"), F.bool_and(F.col("kind") == "parameter").alias("parameter"),
        F.array_sort(F.collect_set("value")).alias("local_values"), F.array_sort(F.collect_set(F.when(F.col("kind") == "string", F.col("definition")))).alias("strings"),
    )
    tables = selected.groupBy(*site).agg(F.bool_and(F.col("value").isNotNull()).alias("table"), F.array_sort(F.collect_set("value")).alias("table_values"))
    named = macros.select("path", F.col("name").alias("argument"), F.col("value").alias("body")).join(value.withColumnRenamed("text", "body").withColumnRenamed("value", "macro_value"), "body", "left").drop("body").withColumn("macro", F.lit(True))
    out = args.join(value.withColumnRenamed("text", "argument"), "argument", "left")
    for side in (tables, defined):
        side = side.select(*[F.col(k).alias(f"_{k}") for k in site], *[c for c in side.columns if c not in site])
        out = out.join(side, [out[k].eqNullSafe(side[f"_{k}"]) for k in site], "left").drop(*[f"_{k}" for k in site])
    out = out.join(named, ["path", "argument"], "left")
    literal = F.col("value").isNotNull() | F.col("argument").rlike('^".*"$')
    rule = (
        F.when(literal, "LITERAL").when(F.col("table"), "TABLE").when(F.col("macro"), "MACRO").when(F.col("output"), "OUTPUT").when(F.col("string"), "STRING")
        .when(F.col("local"), "LOCAL").when(F.col("parameter"), "PARAMETER").otherwise("UNRESOLVED")
    )
    texts_of = lambda c: F.transform(c, lambda x: x.cast("string"))
    values = (
        F.when(F.col("rule") == "LITERAL", F.array(F.coalesce(F.col("value").cast("string"), F.col("argument")))).when(F.col("rule") == "TABLE", texts_of("table_values"))
        .when((F.col("rule") == "MACRO") & F.col("macro_value").isNotNull(), F.array(F.col("macro_value").cast("string"))).when(F.col("rule") == "STRING", F.col("strings")).when(F.col("rule") == "LOCAL", texts_of("local_values"))
    )
    return out.withColumn("rule", rule).withColumn("values", values).select(*site, "rule", "values").distinct()
