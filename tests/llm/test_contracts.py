"""Each query against SQL, a public library or brute force on the smallest tables."""

import collections
import hashlib
import html as htmllib
import random
import re

import numpy as np
import public_tokenizers as P
import pytest

import __spark_entry__ as E
from quarry.llm import (
    op1_minhash_dedup as op1,
    op2_token_counts as op2,
    op3_license_scan as op3,
    op4_decontaminate as op4,
    op5_arc_to_warc as op5,
    op6_html_text as op6,
    op7_url_filters as op7,
    op8_byte_bpe as op8,
    op9_quality_rules as op9,
    op10_pii as op10,
)


@pytest.fixture(scope="module")
def q():
    return E.queries()


@pytest.mark.parametrize("name", ["op3_licenses", "op5_warc", "op7_urls", "op9_quality"])
def test_queries_equal_their_sql(spark, sf, q, same, name):
    same(q[name](spark, sf), E.oracle_sql()[name])


def brute_components(rows, similar=85):
    """Every pair of texts; the smallest doc_id that is reachable."""
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= similar * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_op1_equals_all_pairs(spark, sf, q):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in q["op1_minhash"](spark, sf).collect()}
    assert got == brute_components(rows)


def test_op1_groups_of_near_copies_chains_and_shared_passages(docs_of):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    base = [word() for _ in range(150)]
    passage = [word() for _ in range(45)]
    rows = []
    for k in range(60):  # near copies of many degrees
        w = list(base)
        for _ in range(k // 6):
            w[r.randrange(len(w))] = word()
        rows.append((1000 - k, " ".join(w)))
    chain = [word() for _ in range(100)]
    for k in range(25):  # each links with the next only
        rows.append((2000 + k, " ".join(chain)))
        chain[r.randrange(100)] = word()
    for k in range(40):  # a passage that many share
        rows.append((3000 + k, " ".join([*[word() for _ in range(30)], *passage])))
    rows += [(4000 + k, " ".join(base).upper()) for k in range(5)] + [(5000, "a b"), (5001, "A  B"), (5002, "b a"), (5003, "a b c d e")]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in op1.near_duplicates(docs_of(rows)).collect()}
    assert got == brute_components(rows)


def test_op1_bounds():
    t = op1.least_shared(32, 85)
    assert 8 <= t <= 12  # a pair at the threshold shares fewer with a chance of 1e-10
    assert len(op1.shingle_set("a b c d e f")) == 2 and len(op1.shingle_set("a b c")) == 1 and len(op1.shingle_set(" \n")) == 0
    assert op1.shingle_set("a b c d").tolist() != op1.shingle_set("d c b a").tolist()


def unigram():
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.Unigram(op2.read_pieces(P.path("piece_bpe_32k.model")), unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(r"[\x20\x09-\x0D]+"), "removed"), pre_tokenizers.Metaspace("▁", "always", split=False)])
    return t


def test_op2_counts_as_the_unigram_library_does(spark, sf, q):
    t = unigram()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in q["op2_tokens"](spark, sf).collect():
        assert r.n_tokens == len(t.encode(texts[r.doc_id], add_special_tokens=False).ids)
    r, c = random.Random(5), op2.default_counter()
    for _ in range(500):
        s = "".join(r.choice("abtheino nréß漢😀<>x0A\n") for _ in range(r.randint(0, 40)))
        assert c.text(s)[1] == len(t.encode(s, add_special_tokens=False).ids), s


def test_op4_finds_every_item_that_brute_force_finds(spark, sf, q):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    want = set()
    for d in docs:
        g = op4.shingles(op4.words(d.text))
        want |= {(d.doc_id, i.item_id) for i in items if len((s := op4.shingles(op4.words(i.text))) & g) >= 0.8 * len(s)}
    got = {(r.doc_id, r.item_id) for r in q["op4_leaks"](spark, sf).collect()}
    assert got == want and want


def test_op4_wand_equals_all_scores():
    r = random.Random(1)
    vocabulary = ["".join(r.choice("abcde") for _ in range(3)) for _ in range(80)]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.randint(6, 30)))) for k in range(60)]
    df = collections.Counter(w for _, t in items for w in set(op4.words(t)))
    ix = op4.Index(items, len(items), sum(len(t.split()) for _, t in items) / len(items), df)
    for _ in range(200):
        a = op4.words(r.choice(items)[1])
        query = np.unique(ix.numbers(a[:r.randint(1, len(a))] + [r.choice(vocabulary).encode() for _ in range(r.randint(0, 20))]))
        query = query[query != len(ix.vocabulary)]
        scores = collections.Counter()
        for k in query:
            for i, w in zip(*ix.lists[k], strict=True):
                scores[i] += w
        assert {i for i, _ in ix.wand(query)} == {i for i, s in scores.items() if s >= 1 - op4.SLACK}


def test_op4_blocks_of_items_change_nothing(spark, sf):
    d, b = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = lambda n: sorted(tuple(r) for r in op4.leaks(d, b, block_words=n).select("doc_id", "item_id", "similarity").collect())
    assert rows(300) == rows(op4.BLOCK_WORDS)


def test_op4_repeated_ids_give_the_best_row_in_any_order(spark, docs_of):
    item = "where do the grey herons of the lower valley nest in spring? they nest in the tall poplars beside the old mill."
    items = spark.createDataFrame([(1, item), (1, item)], "item_id long, text string")
    texts = [item, "some words stand before it here " * 9 + item, item + " and a tail"]
    rows = lambda order: sorted(tuple(r) for r in op4.leaks(docs_of([(7, texts[k]) for k in order]).repartition(3), items).collect())
    got = rows((0, 1, 2))
    assert [r[:2] for r in got] == [(7, 1)]
    assert rows((2, 1, 0)) == rows((1, 2, 0)) == got


def test_op4_items_without_their_end_or_scattered_over_a_document(spark, docs_of):
    head = " ".join(f"word{k}" for k in range(40)) + "."
    whole = head + "\nÑ."
    items = spark.createDataFrame([(1, whole), (2, "another item of seven words. stands here")], "item_id long, text string")
    w = head.split()
    far = " ".join(f"far{k}" for k in range(400))
    docs = [(1, whole), (2, head), (3, f"{far} {head} {far}"), (4, f"{far} {' '.join(w[:20])} {far} {' '.join(w[20:])} {far}"), (5, " ".join(w[:20])), (6, far)]
    got = {r.doc_id: r for r in op4.leaks(docs_of(docs), items).collect()}
    assert set(got) == {1, 2, 3, 4} and {r.item_id for r in got.values()} == {1}
    assert got[1].answer_overlap == 1 and got[2].answer_overlap == 0 and got[4].similarity == 32 / 37 and got[4].score < got[3].score


def test_op5_versions_and_archives(spark, pages_of, tmp_path):
    body = "x" * 1500
    rows = [(1, "http://a.example/p q", body), (2, "http://a.example/é", body), (3, None, "short"), (4, "u", "short"), (None, "u", body), (5, "u", None)]
    folder = str(tmp_path / "arc")
    (tmp_path / "arc").mkdir()
    arcs = [r.archive for r in op5.write_arc(pages_of(rows).repartition(2), folder, records=2).collect()]
    assert len(arcs) >= 3
    versions = set()
    for a in arcs:
        fs, p = op5._fs(a)
        with fs.open_input_stream(p, compression=None) as f:
            versions.add(op5.read_arc_version(next(m for _, _, m in op5.members(f))))
        for _, _, fields, _, payload in op5.arc_records(a):
            assert " " not in fields["URL"] and fields["Archive-date"] == op5.ARC_DATE and payload.decode() in (body, "short", "")
    assert versions == {1, 2}
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in op5.round_trip(spark, pages_of(rows)).collect()}
    assert got == {1: ("revisit", 2, 1500), 2: ("response", None, 1500), None: ("revisit", 2, 1500), 3: ("response", None, 5), 4: ("response", None, 5), 5: ("response", None, 0)}


def test_op5_broken_archives_are_refused():
    with pytest.raises(ValueError):
        op5.parse_arc_line(b"http://a 1.2.3.4 20240101000000 text/html\n", 1)
    with pytest.raises(ValueError):
        op5.split_arc(b"http://a 1.2.3.4 20240101000000 text/html 50\nshort", 1)
    assert op5.parse_arc_line(b"http://a b 1.2.3.4 20240101000000 text/html 5\n", 1)["URL"] == "http://a b"
    assert op5.warc_date("20010203040506") == "2001-02-03T04:05:06Z"


def test_op6_text_of_the_articles(spark, sf, q):
    html = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in q["op6_text"](spark, sf).collect():
        a = re.sub(r"</?b>", "", re.search(r"(?s)<article>(.*)</article>", html[r.page_id])[1])
        assert r.text == " ".join(htmllib.unescape(re.sub(r"<[^>]*>", " ", a)).split()) and r.n_chars == len(r.text)


def test_op6_recurring_subtrees_go(pages_of):
    page = "<body><div class=x><span>Shop of {h}</span> opening hours</div><div><p>Text {k} of {h}</p></div><ul><li>one<li>two</ul></body>"
    rows = [(k, f"http://{h}.example/{k}", page.format(h=h, k=k)) for h, n in (("a", 8), ("b", 2)) for k in range(100 * n, 101 * n)]
    got = {r.page_id: r.text for r in op6.extract(pages_of(rows)).collect()}
    assert got[800] == "Text 800 of a"  # on eight pages of its host
    assert got[200] == "Shop of b opening hours Text 200 of b one two"  # on two


def test_op6_copied_articles_stay_and_large_hosts_lose_their_blocks(pages_of):
    body = "".join(f"<p>Paragraph {k} of an article that stands under several addresses of its host.</p>" for k in range(6))
    text = " ".join(re.sub("<[^>]*>", " ", body).split())
    half = body.index("<p>Paragraph 3")
    copies = {"a": "<article><div class=content>{body}</div></article>", "b": "<article><div class=content>{body}</div><p>Posted as number {k}</p></article>",
              "c": "<body><div>Number {k}</div><h1>Title</h1>{body}</body>", "d": "<article><h1>No {k}</h1><section>{one}</section><section>{two}</section></article>",
              "e": "<article><div>{one}</div>{two}<ul><li>a list<li>of it</ul><p>Seen {k} times</p></article>"}
    rows = [(100 * n + k, f"http://{h}.example/{k}", page.format(body=body, one=body[:half], two=body[half:], k=k)) for n, (h, page) in enumerate(copies.items()) for k in range(8)]
    block = "<div><span>Our shop is open from nine to five.</span></div>"
    rows += [(1000 + k, f"http://large.example/{k}", f"<article><p>Text of the page with number {k}, by itself.</p>{block if k < 6 else ''}</article>") for k in range(600)]
    rows += [(2000 + k, f"http://large.example/copy{k}", f"<article><div>{body}</div></article>") for k in range(20)]
    got = {r.page_id: r.text for r in op6.extract(pages_of(rows)).collect()}
    for k in range(8):
        assert [got[100 * n + k] for n in range(5)] == [text, f"{text} Posted as number {k}", f"Number {k} Title {text}", f"No {k} {text}", f"{text} a list of it Seen {k} times"]
    assert all(got[1000 + k] == f"Text of the page with number {k}, by itself." for k in range(600))  # on 1 % of the host's pages
    assert all(got[2000 + k] == text for k in range(20))


def test_op6_markup():
    t = lambda h: op6.text_of(op6.parse(h), set())
    assert t("a<br>b <p>c &nbsp;d&amp;<i>x</i>y<li>q<script>z<p></script><div id=cookie-notice>n</div>") == "a b c d&xy q"
    assert t("<article>A<article class=comment>no</article><form>f</form><p>b<p>c</article><article class='comment'>no</article>") == "A b c"
    assert t("<main>x<!-- <p>no</p> --><style>p{}</style></main>y") == "x"
    assert t("<body class=sidebar-left><div class=content-sidebar><article class='post comments-open'>a<p class='has-ads'>b</p><p class=share-buttons>no</p></article></div></body>") == "a b"
    assert t("<body class='no-sidebar notice'>a<div class='x ad'>no</div></body>") == "a"
    assert t("") == "" and t("<p") == "" and t("</div>a</p>") == "a" and t("a < b") == "a < b"
    assert t("<div>" * 5000 + "deep") == "deep"


def test_op6_names_in_articles():
    t = lambda h: op6.text_of(op6.parse(f"<article>a {h} z</article>"), set())
    for x in ("<section id=related-work>b</section>", "<h2 id=share-prices>b</h2>", "<section id=header-format>b</section>", "<div id=notice-period>b</div>", "<h2 id=search>b</h2>",
              "<section id=comments>b</section>", "<div class=section id=search>b</div>", "<figure><img><figcaption>b</figcaption></figure>", "<math><mi>b</mi></math>",
              "<div class=article-header>b</div>", "<section class=search-methods>b</section>", "<a id=share>b</a>"):
        assert t(x) == "a b z", x
    for x in ("<div class=share>b</div>", "<section class='x comments'>b</section>", "<div id=comments>b</div>", "<ul class=share-buttons>b</ul>", "<div class=related-posts>b</div>",
              "<div id=social_share>b</div>", "<div role=navigation>b</div>", "<div class=post__ad-slot>b</div>", "<p aria-hidden=true>b</p>"):
        assert t(x) == "a z", x
    assert op6.text_of(op6.parse("<section id=search><article>a</article></section>"), set()) == "a"
    assert op6.text_of(op6.parse("<h2 id=share-prices>a</h2><div class=footer-widgets>b</div><div id=top-nav>c</div>"), set()) == "a"


def test_op7_rules_and_globs():
    rules = [*op7.host_rules(), *op7.method_rules()]
    j = lambda *u: [(h, p, r, v) for h, p, r, v in op7.judge(rules, u)]
    assert j("http://A.example.ORG/en/12?x", "http://example.org/es/", "http://org", "http://org/", None, "no", "http://xcom/de/", "http://x.com/de/1",
             "http://evil.net/a.org/b", "ftp://h.net/x.exe", "http://h.net/#x.exe") == [
        ("a.example.org", "/en/12", "example.org/en/1", "block"), ("example.org", "/es/", "example.org/es/", "block"), ("org", "", None, "allow"),
        ("org", "/", "org/", "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("xcom", "/de/", None, "allow"), ("x.com", "/de/1", "com/de/", "block"),
        ("evil.net", "/a.org/b", None, "allow"), ("h.net", "/x.exe", None, "block"), ("h.net", "/", None, "allow")]


def test_op7_automaton_equals_regular_expressions():
    r = random.Random(2)
    globs = ["".join(r.choice(["a", "b", "/", "*", "**"]) for _ in range(r.randint(1, 12))) for _ in range(60)] + ["a" * 150, "**" + "ab" * 60 + "*"]
    plain = [re.compile("".join({"**": "(?s:.*)", "*": "[^/]*"}.get(x, re.escape(x)) for x in re.findall(r"\*\*|\*|.", g))) for g in globs]
    texts = ["".join(r.choice("ab/") for _ in range(r.randint(0, 12))) for _ in range(300)] + ["a" * 150, "x" + "ab" * 60, ""]
    got = op7.ShiftAnd(globs).match([t.encode() for t in texts])
    assert got.tolist() == [[p.fullmatch(t) is not None for p in plain] for t in texts]


def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=op8.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})


def test_op8_equals_tiktoken(spark, sf, q):
    enc = tiktoken_encoding()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in q["op8_bpe"](spark, sf).collect():
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_op8_ties_and_long_pre_tokens():
    enc, own, r = tiktoken_encoding(), op8.default_encoder(), random.Random(4)
    for s in ["a" * 5000, "ab" * 3000, "aaab" * 777, "é" * 999, " " * 50 + "x", "<|endoftext|>", "\u0000\n\r\t"] + [
            "".join(r.choice("aabbthe éß漢'1") for _ in range(r.randint(1, 120))) for _ in range(400)]:
        assert own.encode(s).tolist() == enc.encode_ordinary(s), s


def test_op9_repeats_and_lines(docs_of, same):
    r = random.Random(6)
    rows = [(k, "".join(r.choice(["a", "b", "a b c d e ", " ", "\n", "| x ", "# ", "WORD!! ", "Cookie policy\n", "\t"]) for _ in range(r.randint(0, 60)))) for k in range(300)]
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "x " * 30000)]
    d = docs_of(rows)
    same(op9.rules(d), op9.ORACLE, documents=d.toPandas())


def test_op9_keeps_clean_documents(spark, sf, q):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = q["op9_quality"](spark, sf).join(labels, "doc_id").collect()
    assert all(r.kept for r in got if r.quality == 1 and not r.base_failed)
    assert sum(r.kept for r in got if r.quality == 0) <= 0.05 * sum(r.quality == 0 for r in got)


def brute_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and op10.luhn(d)]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (op10.KINDS.index(s[0]), s[1]))


def test_op10_base_spans(spark, sf, q):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in q["op10_personal"](spark, sf).collect():
        want = brute_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(op10.joined(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in op10.BASE]
        assert not want or set(op10.joined(want).split(",")) <= set(r.spans.split(","))
    rr = random.Random(1)
    for _ in range(5000):
        s = "".join(rr.choice("a.@-+1 4(.9é") for _ in range(rr.randint(0, 40)))
        assert op10.ordered(op10.base_spans(s)) == brute_spans(s), s


def test_op10_held_out_accuracy(spark, sf):
    model = op10.train(spark.read.parquet(f"{sf}/documents.parquet"))
    x, y = op10.examples(["other words around it, here and there"], seed=99, n=1500)
    chosen = model.score(x) >= model.threshold
    assert y[chosen].mean() >= 0.95 and chosen[y == 1].mean() >= 0.9
    text = 'token = "1eb9c654e721b4f812088970e66a6345cee33dd6" and version 2.0.1'
    assert op10.redact(text, op10.method_spans(text, model)) == 'token = "[SECRET]" and version 2.0.1'
    assert op10.redact("a@b.c d", [("email", 0, 5), ("phone", 3, 6)]) == "[EMAIL]d"


def test_pipeline_equals_its_operators_by_brute_force(spark, sf, q):
    """Kept ids: rules, then components, then items, each by its plain version on the rows before it."""
    got = {r.doc_id: r for r in q["pipeline"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    judged = op9.quality(docs).where("kept").select("doc_id", "cleaned", "share_left").collect()
    original = {r.doc_id: r.text for r in docs.collect()}
    rows = [(r.doc_id, original[r.doc_id] if r.share_left == 1 else r.cleaned) for r in judged]
    comp = brute_components(rows)
    rows = [(d, t) for d, t in rows if comp[d][1] == d]
    items = [op4.shingles(op4.words(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [(d, t) for d, t in rows if not any(len(s & op4.shingles(op4.words(t))) >= 0.8 * len(s) for s in items)]
    assert set(got) == {d for d, _ in rows}
    enc = tiktoken_encoding()
    for d, t in rows:
        r = got[d]
        assert not brute_spans(r.text) and r.n_chars == len(r.text)
        assert brute_spans(t) or "token" in t or re.search("[0-9]", t) or r.text == t
        assert r.ids == enc.encode_ordinary(r.text) and r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
