from pyspark.sql import functions as F

from quarry.functions import text as tx


def one(spark, expr, value, schema="t string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_tokenize_basic(spark):
    assert one(spark, tx.tokenize("t"), "Hello World Test") == ["hello", "world", "test"]


def test_tokenize_unicode_whitespace_matches_python(spark):
    cases = ["a b", "a b", "a\x1cb\x1fc", "\tlead and trail  ", "", "İstanbul X"]
    for c in cases:
        assert one(spark, tx.tokenize("t"), c) == c.lower().split(), repr(c)


def test_trigram_overlap(spark):
    df = spark.createDataFrame([("Hello world", "hello world"), ("ab", "abc"), ("", "x"),
                                ("  abcd ", "bcde")], "a string, b string")
    got = [r["j"] for r in df.select(tx.trigram_jaccard("a", "b").alias("j")).collect()]

    def ref(a, b):
        a, b = a.lower().strip(), b.lower().strip()
        if not a or not b:
            return 0.0
        g1 = {a[i:i + 3] for i in range(len(a) - 2)}
        g2 = {b[i:i + 3] for i in range(len(b) - 2)}
        if not g1 or not g2:
            return 0.0
        return len(g1 & g2) / len(g1 | g2)
    assert got == [ref(*r) for r in [("Hello world", "hello world"), ("ab", "abc"), ("", "x"), ("  abcd ", "bcde")]]


def test_trigram_non_bmp(spark):
    s = "a\U0001F600bc\U0001F600"
    g = one(spark, tx.char_ngrams("t"), s)
    assert sorted(g) == sorted({s[i:i + 3] for i in range(len(s) - 2)})


def test_doc_id_from_chunk(spark):
    assert one(spark, tx.doc_id_from_chunk("t"), "q1_p2_0") == "q1_p2"
    assert one(spark, tx.doc_id_from_chunk("t"), "plain") == "plain"


def test_query_hash(spark):
    import hashlib
    q = "what is bm25"
    assert one(spark, tx.query_hash("t"), q) == hashlib.sha256(q.encode()).hexdigest()[:12]


def test_client_key(spark):
    df = spark.createDataFrame([("10.0.0.1, 192.168.1.1", "127.0.0.1"), ("", "127.0.0.1"), (None, None)],
                               "x string, h string")
    got = [r["k"] for r in df.select(tx.client_key("x", "h").alias("k")).collect()]
    assert got == ["10.0.0.1", "127.0.0.1", "unknown"]


def test_prefixes(spark):
    assert one(spark, tx.with_prefix("t", "query"), "q") == "query: q"
    assert one(spark, tx.with_prefix("t", "passage"), "d") == "passage: d"
    k1 = one(spark, tx.cache_key(F.col("t"), F.lit(10)), " Hello ")
    k2 = one(spark, tx.cache_key(F.col("t"), F.lit(10)), "hello")
    assert k1 == k2


def test_version_stamp(spark):
    import datetime as dt
    df = spark.createDataFrame([(dt.datetime(2024, 3, 5, 7, 9, 59),)], "t timestamp")
    assert df.select(tx.version_stamp("t").alias("v")).first()["v"] == "20240305-0709"
    assert len(df.select(tx.version_stamp().alias("v")).first()["v"]) == 13
