"""Natural language in comments and string literals of source text.

Sources are cut into chunks; the lexer's state maps of the chunks, composed by prefix, say where each
starts (:mod:`spanloom.llm.lexing`). Huge texts are spread over tasks that way. Comments and literals
become texts: decoration goes, escapes stand for their characters, adjacent literals and
adjoining comment lines are one text. A text is natural language if it has four words in a row or
six Chinese or Japanese characters; a multinomial logistic regression on hashed character n-grams,
trained here on labelled documents, says which language.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm import lexing
from spanloom.session import Rounds

LANGS = ("en", "de", "fr", "es", "it", "pl", "ru", "ja", "zh")
#: Sources are cut into chunks of about so many characters for the lexer's state maps.
CHUNK_CHARS = 256
#: The pieces of a text of more characters than this are read by many tasks.
SPREAD_CHARS = 1_000_000
BUCKETS = 1 << 14
#: The classifier is fitted on about so many labelled documents, of so many characters, and so many of their texts at most.
SAMPLE_DOCUMENTS, SAMPLE_CHARS, SAMPLE_TEXTS = 4000, 20_000, 9000

WORD = r"[^\W\d_]+(?:['’‑-][^\W\d_]+)*['’]?"
WORDS = re.compile(rf"(?<![\w/.\\%@#=-]){WORD}(?:[,;:.!?…]?\s+[«»\"“„(]?{WORD}){{3,}}(?![\w/\\=(\[])")
EAST = re.compile(r"[぀-ヿ㐀-䶿一-鿿豈-﫿ー々]")
EAST_RUN = re.compile(r"[　-ヿ㐀-䶿一-鿿豈-﫿＀-￯]+")
ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|x([0-9a-fA-F]{2})|([0-7]{1,3})|(.))", re.S)
PLAIN = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v", "\n": ""}
FORMAT = re.compile(r"%[-+ #0]*\d*(?:\.\d+)?(?:hh|h|ll|l|z|j)?[diouxXeEfgGcsp%]")
DECORATION = re.compile(r"^[ \t]*(?:\*+(?!/)|[#/;!]+)?[ \t]?", re.M)
CODE_WORDS = frozenset(
    "int char long short unsigned signed static const void struct union enum extern inline float double return sizeof typedef volatile register auto bool"
    " def class self lambda import pass None True False else elif".split()
)


def unescape(body: str) -> str:
    """A literal's characters: escapes replaced by what they stand for."""
    if "\\" not in body:
        return body

    def one(m: re.Match) -> str:
        if m[1] or m[2]:
            code = int(m[1] or m[2], 16)
            return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else " "
        if m[3]:
            return chr(int(m[3], 16))
        if m[4]:
            return chr(int(m[4], 8))
        return PLAIN.get(m[5], m[5])

    return ESCAPE.sub(one, body)


LITERAL = re.compile(r"""([A-Za-z0-9]{0,2})('''|\"""|'|")""")


def literal_text(token: str) -> str:
    """The text of a string literal as written, prefix and quotes included."""
    m = LITERAL.match(token)
    if not m:  # the rest of a string that a chunk began in
        return unescape(token.removesuffix('"""').removesuffix("'''"))
    body = token[m.end() :]
    body = body.removesuffix(m[2])
    return body if "r" in m[1].lower() else unescape(body)


def comment_text(token: str) -> str:
    """The text of a comment without its marks and the decoration of its lines."""
    if token.startswith("/*"):
        token = token[2:].removesuffix("*/")
        token = token.lstrip("*!<")
        return "\n".join(DECORATION.sub("", line, count=1) for line in token.split("\n"))
    return token.lstrip("/#!<").strip()


def texts(lang: str, source: str) -> list[str]:
    """The texts of the comments and string literals of ``source``, in order."""
    pieces = lexing.chunks(source, CHUNK_CHARS)
    states = lexing.start_states([lexing.state_map(lang, p) for p in pieces]) if len(pieces) > 1 else [lexing.CODE]
    found: list[tuple[str, int, int]] = []
    base = 0
    for piece, state in zip(pieces, states):
        for kind, a, b in lexing.spans(lang, piece, state):
            if state and a == 0 and found and found[-1][2] == base:  # goes on from the chunk before
                found[-1] = (found[-1][0], found[-1][1], base + b)
            else:
                found.append((kind, base + a, base + b))
        base += len(piece)
    out: list[list[str]] = []
    last, end, trailing = "", 0, False
    for kind, a, b in found:
        if kind == "chr":
            last, end = "", b
            continue
        gap = source[end:a]
        joins = last == kind and kind in ("line", "str") and not gap.strip() and (kind == "str" or gap.count("\n") == 1)
        if kind == "str" and not joins and last == "str" and end and gap.replace("\\\n", "").strip() == "":
            joins = True
        if kind == "line" and joins and source[source.rfind("\n", 0, a) + 1 : a].strip():
            joins = False
        # a comment after code on its line is a text of its own
        if kind == "line" and joins and trailing:
            joins = False
        if kind == "line":
            trailing = bool(source[source.rfind("\n", 0, a) + 1 : a].strip()) if not joins else False
        if kind == "str":
            text = literal_text(source[a:b])
            if joins:
                out[-1].append(text)
            else:
                out.append([text])
        else:
            text = comment_text(source[a:b])
            if joins:
                out[-1].append("\n" + text)
            else:
                out.append([text])
        last, end = kind, b
    return ["".join(x) for x in out]


CYRILLIC = re.compile(r"[Ѐ-ԯ]")
SURE = 2.5


def natural(text: str) -> list[str]:
    """The natural language in ``text``: runs of four words, split where the script changes, and its Chinese or Japanese if it has six such characters."""
    parts = []
    if len(EAST.findall(text)) >= 6:
        parts.append(" ".join(EAST_RUN.findall(text)))
    for m in WORDS.finditer(FORMAT.sub(" ", text)):
        words = list(re.finditer(WORD, m[0]))
        scripts = [0 if EAST.search(w[0]) else 1 if CYRILLIC.search(w[0]) else 2 for w in words]
        k = 0
        while k < len(words):
            e = k
            while e < len(words) and scripts[e] == scripts[k]:
                e += 1
            if scripts[k] and e - k >= 4 and sum(w[0] in CODE_WORDS for w in words[k:e]) * 2 < e - k:
                parts.append(m[0][words[k].start() : words[e - 1].end()])
            k = e
    return parts


def fold(text: str) -> str:
    """Lower case without accents, one space between words."""
    bare = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    return " ".join(re.findall(r"[^\W\d_]+", bare))


def features(text: str) -> np.ndarray:
    """Distinct hash buckets of the n-grams of one to four characters and of the words of ``text``."""
    t = f" {fold(text)} "
    grams = {t[i : i + n] for n in (1, 2, 3, 4) for i in range(len(t) - n + 1)}
    grams.update(f"w:{w}" for w in t.split())
    return np.fromiter({zlib.crc32(g.encode()) & (BUCKETS - 1) for g in grams}, dtype=np.int64)


def fit(samples: list[tuple[str, str]], rounds: int = 5, batch: int = 256, seed: int = 7) -> np.ndarray:
    """Weights (buckets x languages) of a multinomial logistic regression; samples are (text, language)."""
    samples = [(t, g) for t, g in samples if g in LANGS]
    weights = np.zeros((BUCKETS, len(LANGS)))
    seen = np.full((BUCKETS, len(LANGS)), 1e-6)
    order = np.random.default_rng(seed).permutation(len(samples))
    counts = np.bincount([LANGS.index(g) for _, g in samples], minlength=len(LANGS)) if samples else np.ones(len(LANGS))
    balance = np.minimum(len(samples) / np.maximum(counts, 1) / len(LANGS), 20)
    batches = []
    for k in range(0, len(order), batch):
        chosen = [samples[i] for i in order[k : k + batch]]
        x = [features(t) for t, _ in chosen]
        y = np.array([LANGS.index(g) for _, g in chosen])
        sizes = np.array([len(f) for f in x])
        at = np.concatenate(x)
        scale = np.repeat(1 / np.sqrt(sizes), sizes)[:, None]
        by_bucket = np.argsort(at, kind="stable")
        touched, first = np.unique(at[by_bucket], return_index=True)
        batches.append((y, at, scale, np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.repeat(np.arange(len(x)), sizes), by_bucket, touched, first))
    for _ in range(rounds):
        for y, at, scale, starts, who, by_bucket, touched, first in batches:
            logits = np.add.reduceat(weights[at] * scale, starts)
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p *= balance[y][:, None] / len(y)
            g = np.add.reduceat((p[who] * scale)[by_bucket], first) + 1e-6 * weights[touched]
            seen[touched] += g * g
            weights[touched] -= 0.3 * g / np.sqrt(seen[touched])
    return weights.astype(np.float32)


def scores(weights: np.ndarray, text: str) -> tuple[str, float]:
    """(most likely language, how far it is ahead); ties go to the first of LANGS."""
    x = features(text)
    if not len(x):
        return LANGS[0], 0.0
    z = weights[x].sum(0) / np.sqrt(len(x))
    top = np.sort(z)
    return LANGS[int(z.argmax())], float(top[-1] - top[-2])


def predict(weights: np.ndarray, text: str) -> str:
    """The most likely language."""
    return scores(weights, text)[0]


def labelled(weights: np.ndarray, text: str) -> list[tuple[str, str]]:
    """(language, run) of the natural language in one text.

    Adjoining comment lines are one text; only if two of its lines by themselves are surely in
    different languages are they labelled apart.
    """
    out = []
    for run in natural(text):
        lines = [x for x in run.split("\n") if len(re.findall(WORD, x)) >= 4]
        if len(lines) > 1:
            each = [(scores(weights, x), x) for x in lines]
            if len({g for (g, ahead), _ in each if ahead >= SURE}) > 1:
                out += [(g, x) for (g, _), x in each]
                continue
        out.append((predict(weights, run), run))
    return out


def training_samples(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS, most: int = SAMPLE_TEXTS, longest: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """(text, language) of sentences of labelled documents: a bounded sample.

    Of the labelled documents of up to ``longest`` characters about ``documents`` are taken, those
    with a hash below a threshold that follows from their number, so that no task sends more than
    its part to the driver; and of their texts as many of each language at most.
    """
    labelled_ = docs.where(F.col("lang").isin(*LANGS))
    share = min(1.0, documents / max(1, labelled_.count()))
    h = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    rows = labelled_.where("text is not null").where(F.length("text") <= longest).select("text", "lang", h.alias("h")).where(F.col("h") < int(share * (1 << 30))).collect()
    taken: dict[str, int] = {}
    kept = []
    for _, text, lang in sorted({(r["h"], r["text"], r["lang"]) for r in rows}):
        for run in (run for line in text.split("\n") for run in natural(line)):
            taken[lang] = taken.get(lang, 0) + 1
            if taken[lang] <= most // len(LANGS):
                kept.append((run, lang))
    return kept


def code_language(file: Column) -> Column:
    """The lexer to use by a path's extension, C where it says nothing."""
    return F.when(F.lower(file).endswith(".py"), "py").when(F.lower(file).endswith(".json"), "json").otherwise("c")


#: A line end after which code follows: what stands before it and after it is never one text.
APART = {
    "c": re.compile(r"""(?<!\\)\n(?=[ \t]*(?:[A-Za-z_]\w*+(?!["'])|[}#]))"""),
    "py": re.compile(r"""(?<!\\)\n(?=@|[A-Za-z_]\w*+(?!["']))"""),
    "json": re.compile(r"\n(?=[ \t]*[\]}])"),
}


def apart(lang: str, text: str, size: int) -> list[str]:
    """``text`` in pieces of about ``size`` characters, none of whose texts goes on in the next one unless that starts inside a comment or string."""
    out, start = [], 0
    while len(text) - start > size and (m := APART[lang].search(text, start + size)):
        out.append(text[start : m.end()])
        start = m.end()
    out.append(text[start:])
    return out


def _groups(maps: pd.Series) -> pd.Series:
    """For the maps of a text's pieces, the number of the piece with which each belongs: the last one before it that starts in code."""

    def one(ms) -> list[int]:
        out: list[int] = []
        for n, state in enumerate(lexing.start_states([tuple(map(int, m.split(","))) for m in ms])):
            out.append(n if state == lexing.CODE else out[-1])
        return out

    return maps.map(one)


def language_spans(functions: DataFrame, weights: np.ndarray, spread_chars: int = SPREAD_CHARS) -> DataFrame:
    """``id``, ``process_name``, ``file``, ``lang``, ``chars`` (of its natural language) and ``source_chars`` per function and language.

    Null and empty sources have no rows; equal rows count once. The pieces of a source beyond
    ``spread_chars`` are mapped where it lies; a prefix composition of the maps then says which
    pieces start in code, and those are read by tasks of their own.
    """
    model = functions.sparkSession.sparkContext.broadcast(weights)
    about = ["id", "process_name", "file"]
    kind = functions.schema["id"].dataType.simpleString()
    shape = f"row bigint, id {kind}, process_name string, file string, lexer string, source_chars bigint, lang string, chars bigint"

    def label(rows_of) -> Iterator[pd.DataFrame]:
        guess = functools.lru_cache(maxsize=20_000)(lambda t: tuple(labelled(model.value, t)))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = [r for x in b.itertuples(index=False) for r in rows_of(x, guess)]
                yield pd.DataFrame(rows, columns=NAMES)

        return run

    def spoken(lexer: str, source: str, guess) -> dict[str, int]:
        chars: dict[str, int] = {}
        for text in texts(lexer, source):
            for g, run in guess(text):
                chars[g] = chars.get(g, 0) + len(run)
        return chars

    def whole(x, guess):
        source = lexing.unify(x.source)
        head = (x.row, x.id, x.process_name, x.file, x.lexer, len(source))
        if len(source) > spread_chars:
            for no, piece in enumerate(apart(x.lexer, source, max(1, spread_chars // 16))):
                yield (*head, None, None, no, piece, ",".join(map(str, lexing.state_map(x.lexer, piece))))
        else:
            for g, n in spoken(x.lexer, source, guess).items():
                yield (*head, g, n, None, None, None)

    def part(x, guess):
        for g, n in spoken(x.lexer, x.piece, guess).items():
            yield (x.row, x.id, x.process_name, x.file, x.lexer, x.source_chars, g, n, None, None, None)

    def run_whole(batches):
        yield from label(whole)(batches)

    def run_part(batches):
        yield from label(part)(batches)

    rows = functions.where("source is not null and source <> ''").select(F.monotonically_increasing_id().alias("row"), *about, code_language(F.col("file")).alias("lexer"), "source")
    read = Rounds(functions.sparkSession).cut(rows.mapInPandas(run_whole, f"{shape}, no int, piece string, map string"))
    long = read.where("piece is not null")
    starts = long.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("no", "map"))).alias("m")).select(
        "row", F.posexplode(F.pandas_udf(_groups, "array<int>")(F.col("m.map"))).alias("no", "group")
    )
    head = ["row", *about, "lexer", "source_chars"]
    joined = long.join(starts, ["row", "no"]).groupBy(*head, "group").agg(F.array_join(F.array_sort(F.collect_list(F.struct("no", "piece")))["piece"], "").alias("piece"))
    parts = joined.mapInPandas(run_part, f"{shape}, no int, piece string, map string")
    sums = parts.groupBy(*about, "row", "lang", "source_chars").agg(F.sum("chars").alias("chars"))
    out = [*about, "lang", "chars", "source_chars"]
    return read.where("piece is null").select(*out).unionByName(sums.select(*out)).distinct()


NAMES = ["row", "id", "process_name", "file", "lexer", "source_chars", "lang", "chars", "no", "piece", "map"]
