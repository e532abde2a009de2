"""The structural questions that need no model: which intent a question has, by its cues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cues of each intent, in Japanese and English. Fixed values.
CUES = {
    "resource_writers": ("に書き込", "へ書き込", "を書き込", "書き込むのは", "投入", "送信するのは", "who writes", "what writes", "writes to", "posts to", "produces"),
    "resource_readers": ("を読み", "から読", "読み込むのは", "受信するのは", "購読", "who reads", "what reads", "reads from", "consumes", "subscribes"),
    "reach": ("どう到達", "どのように到達", "経路", "たどり着", "how does", "how do", "reach", "path from"),
    "from_entry": ("main から", "mainから", "エントリ", "起動から", "from main", "entry point"),
    "callers": ("を呼ぶ", "を呼び出す", "呼び出し元", "呼んでいる", "誰が呼", "どこから呼", "who calls", "what calls", "callers of", "called by", "call sites"),
    "callees": ("が呼ぶ", "を呼んでいる関数", "呼び出している関数", "何を呼", "what does", "callees of", "calls what", "which functions does"),
    "define": ("とは", "の定義", "どこで定義", "何をする", "what is", "where is", "show me", "definition of"),
}


def has_cue(question: Column, intent: str) -> Column:
    """Whether the question holds a cue of the intent, in any case."""
    low = F.lower(question)
    return reduce(lambda a, b: a | b, [low.contains(c.lower()) for c in CUES[intent]])


def intent(question: Column, functions: Column, resources: Column) -> Column:
    """The intent of a question that names so many ``functions`` and ``resources``; null where a model has to answer.

    In this order: who writes or reads a resource, a resource alone, the way from one function to
    another, the way from the entry, callers, callees, a definition.
    """
    cue = lambda name: has_cue(question, name)
    return (
        F.when((resources > 0) & cue("resource_writers"), "resource_writers").when((resources > 0) & cue("resource_readers"), "resource_readers")
        .when((resources == 1) & (functions == 0), "resource").when(functions == 0, F.lit(None))
        .when((functions >= 2) & cue("reach"), "reach").when(cue("from_entry") | (cue("reach") & (functions == 1)), "from_entry")
        .when(cue("callers"), "callers").when(cue("callees"), "callees").when(cue("define") & (functions == 1), "define")
    )
