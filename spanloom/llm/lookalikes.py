"""One consistent form of text in which texts that look the same are equal.

Strings that look alike are linked: canonically equal ones, full-width and narrow forms with
ordinary ones, kinds of space with the space, characters without a look with nothing, and letters
of other alphabets or signs with those of the same shape. Union-find makes the links transitive
classes; each class's most frequent member in the corpus represents it; a multi-pattern automaton
rewrites all members, the longest first. Accents are taken apart before the rewriting and joined
after it, so a letter's look-alikes also serve with any accent.

What a reader can see stays different: case, digits and their raised or circled forms, quotes,
accents, weight and width of spacing, and all added text.
"""

from __future__ import annotations

import functools
import hashlib
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.skew import hot_split_join
from spanloom.session import Rounds

#: Letters and signs of the same shape, by their Latin or plain form. Fixed values, chosen by hand by the glyphs of common typefaces, as the
#: Unicode database knows no shapes. What it does know (widths, canonical equivalents, numerals and ligatures) is derived from it below.
SAME_SHAPE = {
    "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СϹᏟ", "D": "Ꭰ", "E": "ЕΕᎬ", "G": "ԌᏀ", "H": "НΗᎻ", "I": "ІΙӀ", "J": "ЈᎫͿ", "K": "КΚᏦ", "L": "Ꮮ",
    "M": "МΜᎷϺ", "N": "Νꓠ", "O": "ОΟՕ", "P": "РΡᏢ", "Q": "ԚႭ", "S": "ЅՏᏚ", "T": "ТΤᎢ", "V": "ѴᏙ", "W": "ԜᎳ", "X": "ХΧ", "Y": "УΥҮ", "Z": "ΖᏃ",
    "a": "а", "c": "сϲ", "d": "ԁ", "e": "е", "h": "һ", "i": "і", "j": "јϳ", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ",
    "s": "ѕ", "u": "ս", "v": "ѵν", "w": "ԝ", "x": "х", "y": "уү", "æ": "ӕ", "Æ": "Ӕ", "ə": "ә", "Ə": "Ә", "Г": "Γ", "П": "Π", "Ф": "Φ",
    "-": "‐‑⁃﹣", "/": "⁄∕", ":": "∶ː", "·": "•‧∙⋅・", "|": "ǀ∣", "~": "∼", "!": "ǃ", "*": "∗", "\\": "∖", "<": "˂", ">": "˃", "=": "꓿", "′": "ʹ", "°": "˚",
    "Σ": "∑", "Δ": "∆", "—": "―", "–": "‒", "::": "∷", "ll": "ǁ",
}
#: Characters that look like the plain ones they are made up of by Unicode: Roman numerals, ligatures, dots, doubled signs, digraphs, the micro sign.
MADE_UP = "[\u2160-\u217f\ufb00-\ufb04\ufb06\u2024\u2026\u203c\u2047-\u2049\u01c7-\u01cc\u01f1-\u01f3\u00b5]"
#: Characters without a look beside those of category Cf.
UNSEEN = "͏ᅟᅠ឴឵ㅤﾠ"
BLANK = re.compile(r"\s*\Z")


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        path = []
        while self.up.setdefault(x, x) != x:
            path.append(x)
            x = self.up[x]
        for p in path:
            self.up[p] = x
        return x

    def link(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b, key=lambda x: (len(x), x))] = min(a, b, key=lambda x: (len(x), x))

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in sorted(self.up):
            out.setdefault(self.find(x), []).append(x)
        return out


@functools.lru_cache(maxsize=1)
def classes() -> dict[str, list[str]]:
    """The classes of look-alike strings, by their least member; bounded by Unicode, not by any corpus."""
    c = Classes()
    for plain, others in SAME_SHAPE.items():
        for o in others:
            c.link(unicodedata.normalize("NFD", plain), unicodedata.normalize("NFD", o))
    for code in range(128, sys.maxunicode + 1):
        ch = chr(code)
        kind = unicodedata.category(ch)
        if kind in ("Cn", "Cs", "Co"):
            continue
        if kind == "Zs":
            c.link(" ", ch)
        elif kind == "Cf" or ch in UNSEEN or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or 0x180B <= code <= 0x180F:
            c.link("", ch)
        else:
            d = unicodedata.decomposition(ch)
            if d.startswith(("<wide>", "<narrow>")) or d.startswith("<compat>") and re.match(MADE_UP, ch):
                c.link(unicodedata.normalize("NFD", "".join(chr(int(x, 16)) for x in d.split()[1:])), ch)
    c.link("\n", "\r\n")
    c.link("\n", "\r")
    for x in "\x85 ":
        c.link("\n", x)
    return c.members()


def representatives(counts: dict[str, int]) -> dict[str, str]:
    """What each member is rewritten to: the most frequent of its class (ties: the least); nothing where nothing is a member.

    A sign that looks like several characters is rewritten to the representatives of these, so that
    a sequence has one form however its characters are spelled.
    """
    out, several = {}, {}
    for members in classes().values():
        long = [m for m in members if len(m) > 1]
        if "" in members:
            best = ""
        elif " " in members:
            best = " "
        elif "\n" in members:
            best = "\n"
        elif long:
            several.update({m: max(long, key=lambda m: (len(m), m)) for m in members if len(m) == 1})
            continue
        else:
            best = min(members, key=lambda m: (-counts.get(m, 0), m))
        out.update({m: best for m in members if m != best})
    out.update({m: "".join(out.get(c, c) for c in string) for m, string in several.items()})
    return out


class Rewriter:
    """Greedy rewriting of all members that aren't their class's representative, the longest first.

    Members of several characters are found by an automaton; then each character that is a member
    by itself is replaced from a table, which is what an automaton of depth one comes to.
    """

    def __init__(self, rules: dict[str, str]):
        import ahocorasick

        self.blank = {ord(m): None for m, b in rules.items() if b == "" and len(m) == 1}
        self.single = {ord(m): b for m, b in rules.items() if len(m) == 1 and b}
        self.several = ahocorasick.Automaton()
        long = {m: b for m, b in rules.items() if len(m) > 1}
        for member, best in long.items():
            self.several.add_word(member, (len(member), best))
        if long:
            self.several.make_automaton()
        #: An ASCII text without these characters is its own form.
        self.touched = {c for m in rules if m.isascii() for c in m}

    def __call__(self, text: str) -> str:
        """The text's one form."""
        if text.isascii() and self.touched.isdisjoint(text):
            return text
        text = unicodedata.normalize("NFD", text.translate(self.blank))
        if len(self.several):
            parts, at = [], 0
            for end, (n, best) in self.several.iter_long(text):
                parts += (text[at : end + 1 - n], best)
                at = end + 1
            if parts:
                text = "".join([*parts, text[at:]])
        return unicodedata.normalize("NFC", text.translate(self.single))


def member_counts(texts: DataFrame, text: str) -> dict[str, int]:
    """How often each member of a class occurs in all of ``texts``; partial counts per task, then one row per member."""
    shapes = {m for ms in classes().values() for m in ms if m}
    singles = {m for m in shapes if len(m) == 1}
    several = sorted((m for m in shapes if len(m) > 1), key=lambda m: (-len(m), m))
    pattern = re.compile("|".join(map(re.escape, several)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[str] = Counter()
        for b in batches:
            joined = unicodedata.normalize("NFD", "\x00".join(b["text"]))
            chars = Counter(joined)
            total.update({c: chars[c] for c in singles & chars.keys()})
            total.update(pattern.findall(joined))
        yield pd.DataFrame({"member": list(total), "n": list(total.values())}, columns=["member", "n"])

    rows = texts.select(F.col(text).alias("text")).where("text is not null")
    sums = rows.mapInPandas(count, "member string, n bigint").groupBy("member").agg(F.sum("n").alias("n"))
    return {r["member"]: r["n"] for r in sums.collect()}


def unified(docs: DataFrame, key: str, text: str, hashes: bool = False) -> DataFrame:
    """``key`` and ``form``, the consistent form of each text; with ``hashes``, MD5 of the ``form`` and of the ``raw`` text, null for blank ones.

    A null text has a null form, an empty one an empty form. Rows keep their number, and other
    columns are not read. A text's size is bounded only by its row.
    """
    rules = docs.sparkSession.sparkContext.broadcast(representatives(member_counts(docs, text)))
    kind = docs.schema[key].dataType.simpleString()

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        form = Rewriter(rules.value)
        for b in batches:
            out = [None if t is None else form(t) for t in b["text"]]
            if not hashes:
                yield pd.DataFrame({key: b["key"], "form": out})
                continue
            md5 = lambda t: hashlib.md5(t.encode()).digest()
            keep = [f is not None and not BLANK.match(f) for f in out]
            yield pd.DataFrame({key: b["key"], "form": [md5(f) if k else None for f, k in zip(out, keep)], "raw": [md5(t) if k else None for t, k in zip(b["text"], keep)]})

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(rewrite, f"{key} {kind}, form binary, raw binary" if hashes else f"{key} {kind}, form string")


#: So many rows of a look meet those of the same look in one task.
LOOK_ROWS = 512


def _looks(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(``key``, ``form``, ``raw`` of the rows with a look; of each form ``least`` (key), ``members`` and ``variants``, 2 for several).

    Only hashes are kept and shuffled; they are written once, so each text is rewritten once. A form
    of very many rows is not shuffled to one task (:func:`hot_split_join`).
    """
    rows = Rounds(docs.sparkSession).cut(unified(docs, key, text, hashes=True).where("form is not null").distinct())
    sizes = rows.groupBy("form").agg(
        F.min(key).alias("least"), F.count(F.lit(1)).alias("members"), F.when(F.min("raw") < F.max("raw"), 2).otherwise(1).alias("variants"), F.count(F.lit(1)).alias("_n")
    )
    return rows, sizes


def lookalike_classes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per row with a look: ``key``, ``class_id`` (the least key of its look), ``members``, ``several`` (whether its members' characters differ).

    Null, empty and blank texts have no row; equal rows count once.
    """
    rows, sizes = _looks(docs, key, text)
    out = hot_split_join(rows.where(F.col(key).isNotNull()), sizes, ["form"], "_n", rows.count())
    return out.select(key, F.col("least").alias("class_id"), "members", (F.col("variants") > 1).alias("several")).distinct()


def lookalike_pairs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``{key}_a`` < ``{key}_b`` of each two rows whose texts differ in characters and look the same.

    Forms with a single raw text are dropped by a grouping with partial aggregates before any rows
    meet. Members meet within their look in blocks of ``LOOK_ROWS``, so the pairs of a frequent look,
    quadratically many by definition, are made by many tasks. Null, empty and blank texts are in no pair.
    """
    rows, sizes = _looks(docs, key, text)
    mixed = sizes.where("variants > 1").select("form", "_n", F.ceil(F.col("members") / LOOK_ROWS).cast("int").alias("blocks"))
    kept = hot_split_join(rows, mixed, ["form"], "_n", rows.count())
    a = kept.select("form", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("raw").alias("raw_a"), F.col(key).alias(f"{key}_a"))
    b = kept.select("form", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int").alias("block"), F.col("raw").alias("raw_b"), F.col(key).alias(f"{key}_b"))
    return a.join(b, ["form", "block"]).where(f"raw_a <> raw_b and {key}_a < {key}_b").select(f"{key}_a", f"{key}_b").distinct()
