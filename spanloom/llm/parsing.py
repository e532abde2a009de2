"""Source files that do not parse.

A file is cut into chunks. Each chunk is mapped without knowing what stands before it: for every
state of the lexer it may start in, the state it ends in, its codes and its bracket summary. The maps
of a file's chunks are reduced by an associative product, first within a task, then by file over the
partitions. Conditional directives then pick the stretches of C that stay, their bracket summaries
are joined, and balanced texts are parsed statement by statement by the grammars: a C recogniser, the
rules of JSON lists and objects (already in the product), and Python's own parser.

All files go this way, whatever their size; contents are read once. Texts beyond ``spread_chars``
characters are mapped by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm import grammars, lexing
from spanloom.operators.skew import sized_broadcast
from spanloom.session import Rounds

CHUNK_CHARS = 1024
#: Where the chunks of a text are mapped: up to so many characters in the task that read it.
SPREAD_CHARS = 1_000_000


def language_of(path: Column) -> Column:
    """``c``, ``py`` or ``json`` by the path's extension, else null."""
    ext = F.lower(F.regexp_extract(path, r"(\.[A-Za-z]+)$", 1))
    return F.when(ext.isin(".c", ".h"), "c").when(ext == ".py", "py").when(ext == ".json", "json")


def flag_names(flags: Column) -> Column:
    """Distinct symbols of a list of build flags: without blanks, ``-D`` or ``-U`` and ``=value``; null as empty."""
    bare = F.transform(flags, lambda x: F.trim(F.split_part(F.regexp_replace(F.trim(x), r"^-[DU]\s*", ""), F.lit("="), F.lit(1))))
    return F.array_distinct(F.filter(F.coalesce(bare, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")))


#: A stretch of C without directives: (its bracket summary, its codes).
Stretch = tuple[tuple[str, str] | None, list[str]]


def stretches(codes: list[str]) -> list[str | Stretch]:
    """C codes as conditional directives and the stretches between them, summed up."""
    if "#" not in " ".join(codes):  # no directive, as in most chunks
        return [(lexing.bracket_summary(codes), codes)] if codes else []
    out: list[str | Stretch] = []
    run: list[str] = []
    for t in codes:
        if t[0] == "#" and len(t) > 1:
            if run:
                out.append((lexing.bracket_summary(run), run))
                run = []
            out.append(t)
        else:
            run.append(t)
    if run:
        out.append((lexing.bracket_summary(run), run))
    return out


def join_stretches(a: list[str | Stretch], b: list[str | Stretch]) -> list[str | Stretch]:
    """The stretches of two pieces, one after the other; associative."""
    if a and b and not isinstance(a[-1], str) and not isinstance(b[0], str):
        return [*a[:-1], (lexing.join_summaries(a[-1][0], b[0][0]), a[-1][1] + b[0][1]), *b[1:]]
    return a + b


def keep_branches(items: list[str | Stretch], on: frozenset[str], off: frozenset[str]) -> list[Stretch] | None:
    """The stretches that stay; None if conditional directives do not pair.

    A condition on a symbol in ``on`` or ``off`` decides; of any other all branches stay. After a
    branch that holds the later ones of its group go.
    """
    out: list[Stretch] = []
    stack: list[list] = []  # [outer stretch stays, this branch stays, a branch held, else seen]
    alive = True

    def holds(mark: str) -> bool | None:
        name = mark[3:]
        if mark[2:3] not in ("+", "-") or not (name in on or name in off):
            return None
        return (name in on) == (mark[2] == "+")

    for t in items:
        if not isinstance(t, str):
            if alive:
                out.append(t)
            continue
        kind = t[1]
        if kind == "i":
            h = holds(t)
            stack.append([alive, h is not False, h is True, False])
            alive = alive and h is not False
            continue
        if not stack:
            return None
        top = stack[-1]
        if kind == "x":
            alive = stack.pop()[0]
            continue
        if top[3]:
            return None
        h = True if kind == "l" else holds(t)
        top[3] = kind == "l"
        # an undecided group keeps all its branches, its else too
        stays = not top[2] and h is not False
        top[2] = top[2] or (kind == "e" and h is True)
        alive = top[0] and stays
    return None if stack else out


def c_valid(items: list[str | Stretch], defines: frozenset[str], undefines: frozenset[str], fallback: frozenset[str], known: dict[bytes, bool] | None = None) -> bool:
    """Whether a text's directives and stretches are valid C with the process's symbols, or else with the fallback undefines too."""
    before = None
    for off in (undefines, undefines | (fallback - defines)):
        kept = keep_branches(items, defines, off)
        if kept is None or kept == before:
            return False
        before = kept
        total: tuple[str, str] | None = ("", "")
        for summary, _ in kept:
            total = lexing.join_summaries(total, summary)
            if total is None or total[0]:
                break
        if total == ("", "") and grammars.c_valid([t for _, run in kept for t in run], known):
            return True
        if off >= fallback - defines:
            return False
    return False


class Digest:
    """The map of a piece of a text: for each state it may start in, what it comes to. ``*`` is the associative product."""

    def __init__(self, lang: str, by_state: list[tuple], text: str = "", raw: bool = False):
        self.lang, self.rows, self.text = lang, by_state, text
        self.raw = [raw] * len(by_state)  # codes that are not summed up yet

    def row(self, state: int) -> tuple:
        """(end state, what the piece comes to) from ``state`` on."""
        if self.raw[state]:
            end, codes = self.rows[state]
            self.rows[state], self.raw[state] = (end, stretches(codes)), False
        return self.rows[state]

    @property
    def by_state(self) -> list[tuple]:
        return [self.row(s) for s in range(len(self.rows))]

    @classmethod
    def of(cls, lang: str, chunk: str) -> Digest:
        if lang == "c":
            return cls(lang, lexing.c_map(chunk), raw=True)
        if lang == "json":
            return cls(lang, lexing.json_map(chunk))
        return cls(lang, lexing.py_map(chunk), chunk)

    def __mul__(self, other: Digest) -> Digest:
        out = []
        for end, a in self.by_state:
            last, b = other.row(end)
            if self.lang == "c":
                out.append((last, join_stretches(a, b)))
            elif self.lang == "json":
                out.append((last, lexing.json_join(a + b)))
            else:
                shift = len(self.text)
                lines = [(shift + at, *lexing.join_depths(a[:2], (c, o))) for at, c, o in b[2]]
                out.append((last, (*lexing.join_depths(a[:2], b[:2]), a[2] + lines)))
        return Digest(self.lang, out, self.text + other.text)

    def valid(self, defines: frozenset[str], undefines: frozenset[str], fallback: frozenset[str], known: dict[bytes, bool] | None = None) -> bool:
        """The verdict on a whole text."""
        end, what = self.row(lexing.CODE)
        if self.lang == "json":
            return end == lexing.CODE and what in ("s", "v")
        if self.lang == "py":
            if end != lexing.CODE:
                return grammars.py_parses(self.text)
            return grammars.py_valid(self.text, [(at, o) for at, _, o in what[2]])
        if end != lexing.CODE:
            return False
        if any(isinstance(x, str) and x[1] in "<=>" for x in what):
            what = stretches(list(lexing.settled(t for x in what for t in ([x] if isinstance(x, str) else x[1]))))
        return c_valid(what, defines, undefines, fallback, known)

    def packed(self) -> list[str]:
        """One text per state."""
        if self.lang == "json":
            return [f"{end}\n{codes}" for end, codes in self.by_state]
        if self.lang == "py":
            return [f"{end}\n{c} {o}\n" + " ".join(f"{a}:{b}:{d}" for a, b, d in lines) for end, (c, o, lines) in self.by_state]
        rows = lambda items: (x if isinstance(x, str) else ("!" if x[0] is None else f"{x[0][0]}|{x[0][1]}") + "\t" + " ".join(x[1]) for x in items)
        return ["\n".join([str(end), *rows(items)]) for end, items in self.by_state]

    @classmethod
    def unpacked(cls, lang: str, states: list[str], text: str) -> Digest:
        out = []
        for s in states:
            end, *rows = s.split("\n")
            if lang == "json":
                out.append((int(end), rows[0]))
            elif lang == "py":
                c, o = map(int, rows[0].split(" "))
                out.append((int(end), (c, o, [tuple(map(int, x.split(":"))) for x in rows[1].split(" ") if x])))
            else:
                items = []
                for r in rows:
                    summary, tab, codes = r.partition("\t")
                    items.append((None if summary == "!" else tuple(summary.split("|")), codes.split(" ")) if tab else r)
                out.append((int(end), items))
        return cls(lang, out, text)


def pieces(lang: str, text: str, size: int | None = None) -> list[str]:
    """The chunks of a text with line ends unified."""
    return (lexing.json_chunks if lang == "json" else lexing.chunks)(text, size or CHUNK_CHARS)


def product(digests: list[Digest]) -> Digest:
    """The product of neighbouring pieces, by halves, so that long texts are not copied piece by piece."""
    while len(digests) > 1:
        digests = [a * b for a, b in zip(digests[::2], digests[1::2])] + digests[len(digests) // 2 * 2 :]
    return digests[0]


def applied(digests: list[Digest]) -> Digest:
    """What the product of all pieces of a text comes to from its start on, without the other states."""
    first = digests[0]
    lang, (end, what) = first.lang, first.row(lexing.CODE)
    if lang == "py":
        depth, size = what[:2], len(first.text)
        lines = list(what[2])
        for d in digests[1:]:
            end, (c, o, more) = d.row(end)
            lines += [(size + at, *lexing.join_depths(depth, (x, y))) for at, x, y in more]
            depth, size = lexing.join_depths(depth, (c, o)), size + len(d.text)
        return Digest(lang, [(end, (*depth, lines))], "".join(d.text for d in digests))
    if lang == "json":
        codes = [what]
        for d in digests[1:]:
            end, more = d.row(end)
            codes.append(more)
        return Digest(lang, [(end, lexing.json_join("".join(codes)) if len(codes) > 1 else what)])
    items: list[str | Stretch] = []
    for n, d in enumerate(digests):
        end, more = d.row(end) if n else (end, what)
        for k, x in enumerate(more):
            if not k and items and not isinstance(x, str) and not isinstance(items[-1], str):
                items[-1][1].extend(x[1])
                items[-1] = (lexing.join_summaries(items[-1][0], x[0]), items[-1][1])
            else:
                items.append(x if isinstance(x, str) else (x[0], list(x[1])))
    return Digest(lang, [(end, items)])


def text_valid(lang: str, text: str, defines=(), undefines=(), fallback=()) -> bool:
    """Whether ``text`` is valid in ``lang``."""
    whole = applied([Digest.of(lang, p) for p in pieces(lang, lexing.unify(text))])
    return whole.valid(frozenset(defines), frozenset(undefines), frozenset(fallback))


KEY = "key string, process_name string, lang string, part bigint"
KEYS = ["key", "process_name", "lang", "part"]
FLAGS = ["defines", "undefines", "fallback_undefines"]
#: Verdicts on statements, kept by a Python worker over its tasks.
_KNOWN: dict[bytes, bool] = {}


def _map_files(spread_chars: int):
    """One pass over the files: the digest of each, or the pieces of a text beyond ``spread_chars``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for *key, text in zip(*(b[k] for k in KEYS), b["content"]):
                lang, text = key[2], lexing.unify(text)
                if len(text) > spread_chars:
                    rows += [(*key, no, None, None, piece) for no, piece in enumerate(pieces(lang, text, max(CHUNK_CHARS, spread_chars // 16)))]
                else:
                    whole = applied([Digest.of(lang, p) for p in pieces(lang, text)])
                    rows.append((*key, 0, whole.packed(), whole.text, None))
            yield pd.DataFrame(rows, columns=[*KEYS, "no", "states", "text", "piece"])

    return run


def _map_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The digests of pieces of long texts, for all states they may start in."""
    for b in batches:
        done = [product([Digest.of(lang, p) for p in pieces(lang, piece)]) for lang, piece in zip(b["lang"], b["piece"])]
        yield pd.DataFrame({**{k: b[k] for k in [*KEYS, "no"]}, "states": [d.packed() for d in done], "text": [d.text for d in done], "piece": None})


def _reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Verdicts on files whose pieces come one after the other."""
    at: tuple | None = None
    flags: list[frozenset[str]] = []
    parts: list[Digest] = []
    last = -1
    for b in batches:
        rows = []
        for *key, no, states, text, on, off, fallback in zip(*(b[k] for k in KEYS), b["no"], b["states"], b["text"], *(b[k] for k in FLAGS)):
            if tuple(key) != at:
                if at:
                    rows.append((at[0], applied(parts).valid(*flags, _KNOWN)))
                at, parts, last = tuple(key), [], -1
                flags = [frozenset(() if f is None else f) for f in (on, off, fallback)]
            if no != last:  # repeated rows have the same pieces
                parts.append(Digest.unpacked(key[2], states, text))
                last = no
        yield pd.DataFrame(rows, columns=["key", "valid"])
    if at:
        yield pd.DataFrame([(at[0], applied(parts).valid(*flags, _KNOWN))], columns=["key", "valid"])


def judged_files(files: DataFrame, configs: DataFrame, spread_chars: int = SPREAD_CHARS) -> DataFrame:
    """``key`` (the file_id) and ``valid`` of each of ``files`` (file_id, process_name, path, content).

    Null contents and other extensions have no row. Empty or comment-only C and Python is
    valid, an empty JSON text is not. A process without a row in ``configs`` (several rows: their
    flags together) has no symbols. Repeated rows are judged once; rows of one file_id that differ
    are judged apart. In Python only the grammar counts: what the compiler alone rejects, as a
    return outside a function, is valid.
    """
    flags = configs.groupBy("process_name").agg(*[F.array_distinct(F.flatten(F.collect_list(flag_names(F.col(c))))).alias(c) for c in FLAGS])
    rows = files.select(
        F.col("file_id").cast("string").alias("key"), "process_name", language_of(F.col("path")).alias("lang"), F.xxhash64("content", "path").alias("part"), "content"
    ).where("content is not null and lang is not null")
    mapped = Rounds(files.sparkSession).cut(rows.mapInPandas(_map_files(spread_chars), f"{KEY}, no int, states array<string>, text string, piece string"))
    long = mapped.where("piece is not null").repartition("key", "part", "no").mapInPandas(_map_pieces, mapped.schema)
    every = mapped.where("piece is null").unionByName(long).drop("piece").join(sized_broadcast(flags, configs.count()), "process_name", "left")
    by_file = every.repartition("key", "part").sortWithinPartitions("key", "part", "process_name", "lang", "no")
    kind = files.schema["file_id"].dataType
    return by_file.mapInPandas(_reduce, "key string, valid boolean").select(F.col("key").cast(kind).alias("key"), "valid")


def invalid_files(files: DataFrame, configs: DataFrame, spread_chars: int = SPREAD_CHARS) -> DataFrame:
    """``file_id`` of each file that is not valid in its extension's language, once each."""
    return judged_files(files, configs, spread_chars).where("not valid").select(F.col("key").alias("file_id")).distinct()


def invalid_rates(files: DataFrame, configs: DataFrame) -> DataFrame:
    """Per ``repository`` and ``lang``: distinct ``files`` with a content, ``invalid`` ones and their ``rate``."""
    about = files.where("content is not null").select("file_id", "repository", language_of(F.col("path")).alias("lang")).where("lang is not null").distinct()
    bad = invalid_files(files, configs).withColumn("bad", F.lit(1))
    return about.join(bad, "file_id", "left").groupBy("repository", "lang").agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bad"), F.lit(0)).alias("invalid"),
        (F.coalesce(F.sum("bad"), F.lit(0)) / F.count(F.lit(1))).alias("rate"),
    )
