"""Nulls, empty and long texts, ties, repeated rows, empty tables, further columns with clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from quarry.llm import op1_minhash_dedup, op2_token_counts, op3_license_scan, op4_decontaminate, op5_arc_to_warc, op6_html_text, op7_url_filters, op8_byte_bpe, op9_quality_rules, op10_pii
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

CLEAN = "This is a sentence that has words enough to be kept by every rule, and then it goes on with many others about nothing at all. "
LONG = "word" * 50_000 + " " + " ".join(f"w{k}" for k in range(20_000))
ROWS = [(1, None), (2, ""), (3, " \n "), (None, CLEAN), (None, None), (4, LONG), (5, LONG), (6, CLEAN), (6, CLEAN), (7, CLEAN + "mail a.b@example.com now"),
        (8, "x"), (-9, CLEAN.upper()), (10, "\x00 漢字 😀 " + CLEAN)]
#: Names that operators use for their own columns.
CLASHING = ("n", "class", "sketch", "rep", "v", "w", "t", "own", "ids", "kept", "component", "cleaned", "n_words", "leaks", "h", "key", "host", "template", "archive", "__text", "spans")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, CLEAN), (2, None), (None, "no id"), (3, ""), (4, "three words only"), (4, "three words only")], "item_id long, text string")


def run(name, docs, items):
    return {
        "op1": lambda: op1_minhash_dedup.near_duplicates(docs), "op2": lambda: op2_token_counts.token_counts(docs), "op3": lambda: op3_license_scan.licenses(docs),
        "op4": lambda: op4_decontaminate.leaks(docs, items), "op8": lambda: op8_byte_bpe.digests(docs), "op9": lambda: op9_quality_rules.rules(docs),
        "op10": lambda: op10_pii.personal_data(docs),
    }[name]().collect()


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op8", "op9", "op10"])
def test_documents(spark, docs_of, items, name):
    docs = docs_of(ROWS)
    got = run(name, docs, items)
    if name != "op4":
        assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == sorted((i is not None, i or 0) for i, _ in ROWS)
    more = docs.withColumns({c: F.lit("x") for c in CLASHING})
    assert sorted(map(tuple, run(name, more, items)), key=repr) == sorted(map(tuple, got), key=repr)
    assert run(name, spark.createDataFrame([], DOCS), items) == []
    assert len(run(name, docs_of([(k, None) for k in range(5)]), items)) == (0 if name == "op4" else 5)


def test_documents_defined_results(docs_of, items):
    docs = docs_of(ROWS)
    one = {(r.doc_id, r.n_shingles > 0): (r.component_id, r.kept) for r in run("op1", docs, items)}
    assert one[1, False] == (1, True) and one[2, False] == (2, True) and one[None, True] == (None, True)
    assert one[5, True] == (4, False) and one[6, True] == (-9, False) and one[7, True][0] == -9
    assert {r.doc_id for r in run("op4", docs, items) if r.item_id == 1} == {None, 6, 7, -9, 10}
    found = {r.doc_id: r for r in run("op10", docs, items)}
    assert found[7].n_email == 1 and found[1].spans == ""


def test_no_items(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = docs_of(ROWS)
    assert op4_decontaminate.leaks(docs, none).collect() == []
    assert op4_decontaminate.mark(docs, none).where("size(leaks) = 0").count() == len(ROWS)


PAGES = [(1, None, None), (2, "", ""), (None, "http://a.com/x", "<p>t</p>"), (3, "http://a.com/x", "<p>t</p>"), (3, "http://a.com/x", "<p>t</p>"), (4, "://", "x" * 100_000),
         (5, "http://é.com/漢", "<article>" + "<p>a" * 5000), (6, "\x00 \n", "x" * 100_000)]


@pytest.mark.parametrize("name", ["op5", "op6", "op7"])
def test_pages(spark, pages_of, name):
    f = {"op5": lambda p: op5_arc_to_warc.round_trip(spark, p), "op6": op6_html_text.extract, "op7": op7_url_filters.filter_urls}[name]
    pages = pages_of(PAGES)
    got = f(pages).collect()
    assert sorted((r.page_id is not None, r.page_id or 0) for r in got) == sorted((i is not None, i or 0) for i, _, _ in PAGES)
    more = pages.withColumns({c: F.lit("x") for c in CLASHING})
    drop = {"record_id"}  # names the place in the archives
    flat = lambda rows: sorted((tuple(v for k, v in r.asDict().items() if k not in drop) for r in rows), key=repr)
    assert flat(f(more).collect()) == flat(got)
    assert f(spark.createDataFrame([], pages.schema)).collect() == []


@pytest.mark.parametrize("stage", [n for n, _ in cp.STAGES])
def test_stages(spark, docs_of, sf, stage):
    f = dict(cp.STAGES)[stage]
    docs = docs_of(ROWS)
    got = f(spark, docs, sf)
    rows = got.collect()
    assert got.columns[:5] == docs.columns
    assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)
    assert f(spark, spark.createDataFrame([], DOCS), sf).collect() == []
    more = docs.withColumns({c: F.lit("x") for c in CLASHING if c != "ids" or stage != "byte-level BPE"})
    again = f(spark, more, sf)
    assert [c for c in again.columns if c in more.columns] == more.columns and again.count() == len(rows)
    ids = sorted(r.doc_id for r in rows if r.doc_id is not None)
    if stage == "quality rules":
        assert {6, 7, 10, 4, 5} <= set(ids) and not {1, 2, 3, 8} & set(ids)
    if stage == "near-duplicates":
        assert ids == [-9, 1, 2, 3, 4, 8] or ids == [-9, 1, 2, 3, 4, 8, 10]
        assert sum(r.doc_id is None for r in rows) == 2
    if stage == "personal data":
        assert next(r.text for r in rows if r.doc_id == 7).endswith("mail [EMAIL] now")
    if stage == "byte-level BPE":
        assert len(rows) == len(ROWS)


def test_only_the_entry_guards_the_subpackage():
    import pathlib

    root = pathlib.Path(cp.__file__).parent
    for p in [root / "corpus_pipeline.py", *(root / "quarry" / "llm").glob("*.py")]:
        assert "ImportError" not in p.read_text() and "ModuleNotFoundError" not in p.read_text()
    for p in (root / "quarry").rglob("*.py"):
        assert "llm" in p.parts or "quarry.llm" not in p.read_text()
