import random

import pandas as pd

from spanloom.llm import docpairs, language, lexing, lookalikes, mixing, tokens


def test_descriptions():
    says = docpairs.description
    for nothing in (None, "", "   ", "-----", "=== helpers ===", "@param n\n@return int", "TODO", "FIXME: document", "n/a", "see above", "Function abc_read_gate.", "read gate", "v = rtx_read(n, 9);", "if (v) {\nv--;\n}", "TBD", "...", "Summary unavailable.", "abc_read_gate()", "No summary.", ":param n:\n:return:"):
        assert says(nothing, "abc_read_gate") == "", nothing
    for text in ("The timer waits for the next reading.", "@brief La deuxième mémoire attend la mesure\n\n@param n", "弁の制御部は二度閉じてはいけません", "abc_read_gate: checks the upper limit first", "Reads the gate record: one late frame locks the slot."):
        assert says(text, "abc_read_gate"), text


def test_comment_spans(monkeypatch):
    text = "// one\n// two\nint a;\n\n/* far */\n\nint b;\nint c; // trailing\nint d;\n/* x */ int e;\n/* first */\n/* near */\nint f;\n/* a */\n/* b */ int g;\n// last"
    want = [(2, 3, "one\ntwo"), (5, 7, "far "), (11, 13, "first "), (12, 13, "near "), (14, 15, "a "), (16, 0, "last")]
    for size in (1, 10, 1000):
        monkeypatch.setattr(docpairs, "FILE_CHUNK_CHARS", size)
        assert docpairs.comment_spans("c", text) == want
    assert docpairs.comment_spans("py", 'x = 1\n# c\n\n\n"""s"""\n') == [(2, 5, "c")]


def test_nearest_comments(spark):
    functions = spark.createDataFrame([(n, n, "p", "a.c", line, "s") for n, line in (("f", 2), ("g", 4), ("h", 7), ("i", 8))], "id string, name string, process_name string, file string, start_line int, source string")
    rows = [("p", "a.c", "// of f\nint f;\n// of g\nint g;\n// far\n\nint h;\nint i;\n"), ("q", "a.c", "// of another process\nint f;\n")]
    files = spark.createDataFrame(rows, "process_name string, path string, content string")
    found = lambda gap: {r["id"]: r["comment"] for r in docpairs.nearest_comments(functions, files, gap).collect()}
    assert found(0) == {"f": "of f", "g": "of g"} and found(3) == {"f": "of f", "g": "of g", "h": "far"}


def test_docstrings():
    assert docpairs.docstring('def f(a):\n    """Says it."""\n    return 1') == "Says it."
    assert docpairs.docstring('    def f(a):\n        # c\n        "x"\n        return (') == "x"
    assert docpairs.docstring("def f(): pass") is None


def test_pairs(spark):
    functions = spark.createDataFrame(
        [("1", "f", "a.c", 2, None, "int f;", None, 1), ("1", "f", "a.c", 2, None, "int f;", None, 1), ("2", "g", "a.c", 3, "pending", "int g;", None, 1), ("3", "h", "b.py", -1, None, 'def h():\n  "Counts all the rows."', "p", 1), ("4", "i", None, None, "Moves the gate to its place.", "x", None, 1), ("5", "j", "a.c", 2, "A real good summary.", None, "p", 1), ("6", "", "a.c", 9, "", "", "p", 1)],
        "id string, name string, file string, start_line int, summary string, source string, process_name string, line int",
    )
    files = spark.createDataFrame([("a.c", "/* Opens the far gate. */\nint f;\nint g;\n", None, 1), ("a.c", "/* Opens the far gate. */\nint f;\nint g;\n", None, 1), ("n.c", None, "p", 1), (None, "x", "p", 1)], "path string, content string, process_name string, line int")
    got = {(r["id"], r["origin"]) for r in docpairs.documented(functions, files).collect()}
    assert got == {("1", "comment"), ("3", "docstring"), ("4", "summary")}
    assert docpairs.documented(functions.limit(0), files).count() == 0 and docpairs.documented(functions, files.limit(0)).count() == 2


def test_texts_of_source():
    c = 'int f() {\n  // a b\n  // c d\n  x = "e\\u00e9" /* g */ "h"\n "i";\n  y = \'"\'; /* j\n * k */ }'
    assert [t.strip() for t in language.texts("c", c)] == ["a b\nc d", "eé", "g", "hi", "j\nk"]
    py = 'def f():\n    """Doc\n    more."""\n    x = r"a\\n" "b"  # c\n    # d\n'
    assert [t.strip() for t in language.texts("py", py)] == ["Doc\n    more.", "a\\nb", "c", "d"]
    assert language.texts("c", "") == []


LONG_C = "\n".join(f'int f{i}() {{ /* comment number\nint {i} goes on */ x("the text has {i} words"\n"of its own"); // line\n}}\n// a line of words\n// and the next of them' for i in range(60))
LONG_PY = "\n".join(f'def f{i}():\n    """The text of number\nint {i} goes on"""\n    x = "the words are" "many"  # line\n# a line of words\n# and the next of them' for i in range(60))


def test_texts_in_chunks_and_pieces_are_those_of_the_whole(monkeypatch):
    for lang, text in (("c", LONG_C), ("py", LONG_PY)):
        monkeypatch.setattr(language, "CHUNK_CHARS", 10**6)
        whole = language.texts(lang, text)
        for size in (20, 50, 256):
            monkeypatch.setattr(language, "CHUNK_CHARS", size)
            assert language.texts(lang, text) == whole
            pieces = language.apart(lang, text, size)
            groups = language._groups(pd.Series([[",".join(map(str, lexing.state_map(lang, p))) for p in pieces]]))[0]
            assert "".join(pieces) == text and len(set(groups)) > 9
            assert [t for g in sorted(set(groups)) for t in language.texts(lang, "".join(p for p, k in zip(pieces, groups) if k == g))] == whole


def test_natural_language():
    for text in ("/var/rtx/cells/unit.cfg", "k=%d;j=%d", "rc = rtx_open(h, 9); if (rc) return rc;", "three words only", "http://a.b/c d", "水位が", "static const unsigned int", "", "unit;level;pump"):
        assert language.natural(text) == [], text
    assert language.natural("[1] the pump has stopped: %s") == ["the pump has stopped"]
    assert len(language.natural("弁の制御部は二度閉じ")) == 1


SENTENCES = {
    "en": ["the pump waits for the next reading", "this loop drops any message without a sender", "the level is unknown and the gate is moving"],
    "de": ["die Pumpe wartet auf den nächsten Messwert", "diese Schleife verwirft Meldungen ohne Absender", "der Füllstand ist unbekannt und das Tor fährt"],
    "ru": ["насос ждёт следующего измерения и не закрывается", "этот цикл отбрасывает сообщения без отправителя"],
    "ja": ["このループは送信元のない通知を捨てます", "水位が不明な場合です"], "zh": ["泵等待下一次读数", "这个循环丢弃没有发送者的消息"],
}


def test_language_labels(spark):
    weights = language.fit([(t, g) for g, ts in SENTENCES.items() for t in ts] * 20)
    assert all(language.predict(weights, t) == g for g, ts in SENTENCES.items() for t in ts)
    assert language.predict(weights, "DIE PUMPE WARTET AUF DEN NAECHSTEN MESSWERT") == "de"
    long = "\n".join([LONG_C] * 3)
    df = spark.createDataFrame(
        [(*r, "p") for r in (("5", "a.c", long, 0), ("5", "a.c", long, 0), ("1", "a.c", "int f() { // the pump waits for the next reading\n x(\"die Pumpe wartet \" \"auf den nächsten Messwert\"); }", 0), ("2", None, None, 0), ("3", "a.c", "", 0), ("4", "a.py", "def f():\n    '''このループは送信元のない通知を捨てます'''\n", 0))],
        "id string, file string, source string, lang int, process_name string",
    )
    rows = sorted(map(tuple, language.language_spans(df, weights).collect()))
    assert {(r[0], r[3]) for r in rows} == {("1", "en"), ("1", "de"), ("4", "ja"), ("5", "en")} and len(rows) == 4
    assert sorted(map(tuple, language.language_spans(df, weights, spread_chars=400).collect())) == rows
    assert language.language_spans(df.limit(0), weights).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    samples = language.training_samples(docs)
    weights = language.fit(samples[::2])
    held = samples[1::2]
    assert sum(language.predict(weights, t) == g for t, g in held) > 0.95 * len(held)


def test_forced_boundaries_change_no_ids():
    enc, certain = tokens.encoding(tokens.VOCABULARY)
    rng = random.Random(0)
    bits = list("ab'st \n\t12.,!é中あ\xa0\u3000\u200bжÅ<|>’") + ["'s", "'ll", "  ", "\n\n", "<|endoftext|>", "word"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))
        assert tokens.encode_text(text, least=1) == enc.encode_ordinary(text)
        assert "".join(tokens.fragments(text, certain, 1)) == text


def test_encode_column(spark):
    enc, certain = tokens.encoding(tokens.VOCABULARY)
    texts = [None, "", "hello world", "long text. " * 20_000, "long text. " * 20_000, "a" * 5000, "<|endoftext|>"]
    assert len(tokens.fragments(texts[3], certain)) > 500
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(2, "hello world", 0), (None, "x", 0)], "doc_id bigint, text string, ids int")
    want = sorted([(i, enc.encode_ordinary(t or "")) for i, t in enumerate(texts)] + [(2, enc.encode_ordinary("hello world"))])
    got = [(r["doc_id"], r["ids"]) for r in tokens.encode_column(df, "doc_id", "text").collect()]
    assert (None, enc.encode_ordinary("x")) in got and sorted(x for x in got if x[0] is not None) == want
    counts = tokens.encode_column(df.where("doc_id is not null"), "doc_id", "text", count_only=True).collect()
    assert sorted((r["doc_id"], r["tokens"]) for r in counts) == [(i, len(x)) for i, x in want]
    assert tokens.encode_column(df.limit(0), "doc_id", "text").count() == 0


def test_mix_reaches_shares(spark):
    rng = random.Random(4)
    rows = [(i, s, rng.randint(0, 40)) for i, s in enumerate(rng.choices(["a", "b", "c", None, "z"], [60, 20, 5, 5, 10], k=4000))]
    sizes = spark.createDataFrame(rows, "id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 5), ("none", 0.1, 3), (None, 0.2, 1)], "source string, target_share double, max_repeats int")
    records, shares = mixing.mix(sizes, targets)
    taken = {r["id"]: (r["source"], r["tokens"], r["repeats"]) for r in records.collect()}
    cap = {"a": 1, "b": 2, "c": 5}
    assert all(1 <= n <= cap[s] for s, _, n in taken.values())
    total = sum(t * n for _, t, n in taken.values())
    for r in shares.collect():
        mixed = sum(t * n for s, t, n in taken.values() if s == r["source"])
        assert r["mixed_tokens"] == mixed and abs(r["actual_share"] - mixed / total) < 1e-9
        if r["source"] in cap:
            assert abs(mixed / total - r["target_share"] / 0.9) < 0.01
    # each source's records differ by one repeat at most, and its budget isn't passed
    for s in cap:
        counts = {taken.get(i, (s, t, 0))[2] for i, x, t in rows if x == s}
        assert max(counts) - min(counts) <= 1
    short = {r["source"]: r for r in mixing.mix(sizes, targets, total=10**9)[1].collect()}
    assert all(short[s]["mixed_tokens"] == cap[s] * short[s]["available_tokens"] for s in cap)
    assert mixing.mix(sizes.limit(0), targets)[0].count() == 0


LOOK = ["Plant Ａ１ café", "Plant A1 cafe\u0301", "Plant\u00a0A1\u200b café", "Рlаnt A1 café", "Plant\u2009А1 ca\u00adfé"]
OTHER = ["plant A1 café", "Plant A1 cafe", "Plant A² café", "Plant A① café", "Plant “A1” café", "Plant A1 café!", "Plant A2 café", "Plant  A1 café"]


def test_lookalikes(spark):
    rows = [*LOOK, *OTHER, LOOK[0], None, "", "  ", "\u200b", "\u00a0"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(rows)], "doc_id bigint, text string, form int")
    pairs = {(r[0], r[1]) for r in lookalikes.lookalike_pairs(df, "doc_id", "text").collect()}
    same = [*range(len(LOOK)), len(LOOK) + len(OTHER)]
    assert pairs == {(a, b) for a in same for b in same if a < b and rows[a] != rows[b]}
    forms = {r["doc_id"]: r["form"] for r in lookalikes.unified(df, "doc_id", "text").collect()}
    assert len({forms[i] for i in same}) == 1 and forms[len(rows) - 5] is None and forms[len(rows) - 4] == ""
    assert lookalikes.lookalike_pairs(df.limit(0), "doc_id", "text").count() == 0
    classes = {r["doc_id"]: (r["class_id"], r["members"], r["several"]) for r in lookalikes.lookalike_classes(df, "doc_id", "text").collect()}
    assert len(classes) == len(LOOK) + len(OTHER) + 1
    assert all(classes[i] == (0, len(same), True) for i in same) and classes[len(LOOK)] == (len(LOOK), 1, False)


def test_lookalikes_of_one_hot_look(spark, monkeypatch):
    import spanloom.operators.skew as skew

    monkeypatch.setattr(skew, "ONE_TASK_ROWS", 0)
    monkeypatch.setattr(lookalikes, "LOOK_ROWS", 7)
    rows = [(i, LOOK[i % 3]) for i in range(60)] + [(100 + i, f"text number {i}") for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    pairs = [tuple(r) for r in lookalikes.lookalike_pairs(df, "doc_id", "text").collect()]
    assert sorted(pairs) == [(a, b) for a in range(60) for b in range(a + 1, 60) if a % 3 != b % 3]
    assert lookalikes.lookalike_classes(df, "doc_id", "text").where("class_id = 0 and members = 60").count() == 60


def test_representatives_are_stable():
    rules = lookalikes.representatives({"a": 5, "а": 9})
    assert rules["a"] == "а" and "а" not in rules
    rewrite = lookalikes.Rewriter(rules)
    for text in ("ﬁrst…", "ｅ\u0301tude", "Ⅳ", "x\r\ny"):
        assert rewrite(rewrite(text)) == rewrite(text)
