"""op11 against a plain coder, and its accuracy on documents that it doesn't learn from."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from quarry.llm import op11_language_id as op11

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_tree(texts):
    tree = defaultdict(Counter)
    for t in texts:
        b = bytes(op11.ORDER) + t
        for i in range(op11.ORDER, len(b)):
            for k in range(op11.ORDER + 1):
                tree[b[i - k:i]][b[i]] += 1
    return tree


def plain_length(tree, text):
    """The code length of a text, symbol by symbol and escape by escape."""
    bits = lambda p: int(np.rint(-np.log2(p) * op11.BIT))
    b, out = bytes(op11.ORDER) + text, 0
    for i in range(op11.ORDER, len(b)):
        for k in range(op11.ORDER, -1, -1):
            seen = tree.get(b[i - k:i])
            if not seen:
                continue
            n, d = sum(seen.values()), len(seen)
            if c := seen.get(b[i]):
                out += bits(c / (n + d))
                break
            out += bits(d / (n + d))
        else:
            out += 8 * op11.BIT
    return out


def made(rng, parts, n):
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


PARTS = {"de": ["sch", "ung", "ein", "ß", "ü", "keit"], "en": ["th", "ing", "er", "ou", "and"], "fr": ["eau", "tion", "é", "ç", "oi"], "": ["漢", "字", "仮", "名"]}


@pytest.fixture(scope="module")
def trees():
    rng = random.Random(11)
    texts = {x: [op11.plain(made(rng, p, 60)) for _ in range(6)] for x, p in PARTS.items()}
    rows = []
    for lang, some in texts.items():
        import pyarrow as pa

        for b in op11.count_grams([pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array([t.decode() for t in some])], names=["lang", "t"])]):
            rows += [tuple(r.values()) for r in b.to_pylist()]
    langs = sorted(texts, key=str.encode)
    of = [[(langs.index(x), g, n) for x, k, g, n in rows if k == i] for i in range(op11.ORDER + 1)]
    return op11.Trees(langs, [tuple(np.array(c, np.int64) for c in zip(*o)) for o in of]).ready(), [plain_tree(texts[x]) for x in langs]


def test_code_lengths_equal_a_plain_coder(trees, monkeypatch):
    fast, slow = trees
    rng = random.Random(4)
    texts = [op11.plain(made(rng, rng.choice(list(PARTS.values())) + ["q", "zz", "ж"], rng.randrange(1, 30))) for _ in range(60)] + [b"x", "ÿ߿".encode(), b"", b" "]
    want = [[plain_length(t, x) for t in slow] for x in texts]
    assert fast.lengths(texts).tolist() == want
    monkeypatch.setattr(op11, "BLOCK", 7)
    assert fast.lengths(texts).tolist() == want


def test_predictions(trees):
    fast, _ = trees
    texts = [None, "", "12 34 !?", "schung", "THING", "漢字", "é " * 5000, "... 漢"]
    lang, score = fast.predict(texts)
    assert lang == ["und", "und", "und", "de", "en", "", "fr", ""] and score[:3] == [0.0] * 3 and all(0 < s <= 1 for s in score[3:])
    assert fast.predict(texts[::-1]) == (lang[::-1], score[::-1])


def test_normal_form():
    assert op11.plain("  A-b\n\n42 Éß!") == " a b éß ".encode() and op11.plain("") == b"" and op11.plain("7") == b" "


def crc(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_table(spark):
    rng = random.Random(2)
    rows = [(k, made(rng, PARTS[x], 20), x, "s", 0) for k, x in enumerate(rng.choices(["de", "en", "fr", ""], k=200))]
    rows += [(None, "sch ung ein", "de", None, None), (300, None, "en", None, None), (301, "", None, None, 0), (302, "1 2 3", "fr", None, 0), (5, rows[5][1], rows[5][2], "s", 0), (303, "thing " * 20000, None, None, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted(map(tuple, op11.languages(docs).collect()), key=repr)
    assert sorted(str(r[0]) for r in got) == sorted(str(r[0]) for r in rows)
    assert all(h == (i is not None and crc(i)) for i, h, _, _ in got)
    truth = {r[0]: r[2] for r in rows}
    assert all(x == truth[i] for i, _, x, _ in got if i is not None and i < 200)
    assert {i: (x, s) for i, _, x, s in got if i in (300, 301, 302)} == {i: ("und", 0.0) for i in (300, 301, 302)}
    more = docs.repartition(7).withColumns({c: F.lit("x") for c in ("t", "h", "share", "of", "k", "gram", "n", "rank", "held_out", "lang_pred", "score")})
    assert sorted(map(tuple, op11.languages(more).collect()), key=repr) == got


def test_held_out_labels_and_ids_are_no_input(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    base = {r.doc_id: (r.lang_pred, r.score) for r in op11.languages(docs).collect()}
    other = docs.withColumn("lang", F.when(op11.held_out(), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("none"))
    assert {r.doc_id: (r.lang_pred, r.score) for r in op11.languages(other).collect()} == base


def test_nothing_to_learn_from(spark):
    assert op11.languages(spark.createDataFrame([], DOCS)).collect() == []
    assert [r.lang_pred for r in op11.languages(spark.createDataFrame([(1, "words", None, None, 0)], DOCS)).collect()] == ["und"]


def test_accuracy_on_held_out_documents(spark, sf):
    big = sf.replace("0.001", "0.01")
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang").collect()}
    got = E.queries()["op11_language"](spark, big).where("held_out").collect()
    assert len(got) > 200 and all(crc(r.doc_id) for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in got) >= 0.98 * len(got)
