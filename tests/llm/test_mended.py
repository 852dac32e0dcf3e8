"""Archives of any layout, and rows that share a doc_id but not a text."""

import gzip

import pytest

import corpus_pipeline as cp
from quarry.llm import op1_minhash_dedup as op1
from quarry.llm import op5_arc_to_warc as op5

URLS = ["http://a.com/1", "http://b.com/x y?q", None, "http://c.com/3"]


def layouts(version):
    """The same records as one gzip member each, in one member, by twos, and plain; with and without lines between them."""
    name = "part.arc"
    records = [op5.arc_record(version, name, 0, k, u, bytes([65 + k]) * (1500 if k != 2 else 0) + b"\n\n") for k, u in enumerate(URLS)]
    head = op5.arc_head(version, name)
    for gap in (b"", b"\n", b"\r\n\n"):
        parts = [head, *[r + gap for r in records]]
        yield "each.arc.gz", b"".join(gzip.compress(p) for p in parts)
        yield "one.arc.gz", gzip.compress(b"".join(parts))
        yield "twos.arc.gz", b"".join(gzip.compress(b"".join(parts[k:k + 2])) for k in range(0, 5, 2))
        yield "split.arc.gz", b"".join(gzip.compress(b"".join(parts)[k:k + 700]) for k in range(0, len(b"".join(parts)), 700))
        yield "plain.arc", b"".join(parts)


@pytest.mark.parametrize("version", [1, 2])
def test_archives_are_streams_of_records(tmp_path, version):
    for k, (name, data) in enumerate(layouts(version)):
        path = tmp_path / f"{k}-{name}"
        path.write_bytes(data)
        got = list(op5.arc_records(str(path)))
        assert [r[2]["URL"] for r in got] == [op5.clean_url(u) for u in URLS]
        assert [op5.header(r[3], "X-Page-Id") for r in got] == ["0", "1", "2", "3"]
        assert [len(r[4]) for r in got] == [1502, 1502, 2, 1502] and len({r[0] for r in got}) == 4
        for cut in (b"", data[:-5]):
            path.write_bytes(cut)
            with pytest.raises((ValueError, EOFError)):
                list(op5.arc_records(str(path)))


def test_leftovers_are_refused(tmp_path):
    good = op5.arc_head(1, "n") + op5.arc_record(1, "n", 0, 1, "http://a", b"x" * 50)
    for tail in (b"left over\n", b"left", b"\n<html>\n"):
        for data in (good + tail, gzip.compress(good + tail), gzip.compress(good) + gzip.compress(tail)):
            (tmp_path / "a").write_bytes(data)
            with pytest.raises(ValueError):
                list(op5.arc_records(str(tmp_path / "a")))


def test_dates_that_are_no_numbers(tmp_path):
    line = op5.arc_record(1, "n", 0, 1, "http://a", b"x").replace(op5.ARC_DATE.encode(), b"yesterday", 1)
    (tmp_path / "a").write_bytes(op5.arc_head(1, "n") + line)
    (_, _, fields, head, payload), = op5.arc_records(str(tmp_path / "a"))
    record = op5.convert_record("a", 0, fields, head, payload, None)
    assert b"WARC-Date: 2024-01-01T00:00:00Z\r\n" in record and b"X-Archive-Date: yesterday\r\n" in record
    with pytest.raises(ValueError):
        op5.warc_date("yesterday")
    assert op5.warc_date("1999") == "1999-01-01T00:00:00Z"


def test_layouts_by_spark(spark, tmp_path):
    paths = []
    for k, (name, data) in enumerate(layouts(2)):
        (tmp_path / f"{k}-{name}").write_bytes(data)
        paths.append((str(tmp_path / f"{k}-{name}"),))
    (tmp_path / "warc").mkdir()
    index = op5.index_arc(spark.createDataFrame(paths, "archive string"))
    got = op5.read_warc(op5.convert(index, str(tmp_path / "warc"))).collect()
    assert len(got) == 4 * len(paths) and sum(r.record_type == "response" for r in got) == 3 + len(paths)


WORDS = [f"w{k}" for k in range(400)]
A, B, C = " ".join(WORDS[:60]), " ".join(WORDS[100:160]), " ".join(WORDS[200:260])
NEAR_B = B.replace("w100 ", "other ")
SHARED = [(2, A), (5, A), (5, B), (9, NEAR_B), (7, C), (7, ""), (8, C + " more"), (3, None), (3, ""), (5, B), (11, A), (11, C), (None, A)]


def test_one_component_of_an_id(docs_of):
    got = [tuple(r) for r in op1.near_duplicates(docs_of(SHARED)).collect()]
    assert sorted(str(r[0]) for r in got) == sorted(str(i) for i, _ in SHARED)
    ids = {}
    for i, _, c, kept in got:
        ids.setdefault(i, set()).add((c, kept))
    assert all(len(x) == 1 for x in ids.values())
    # 11 has texts of 2's and of 7's group; 5 joins 9 to them
    assert {i: next(iter(x)) for i, x in ids.items()} == {2: (2, True), 5: (2, False), 9: (2, False), 7: (2, False), 8: (2, False), 11: (2, False), 3: (3, True), None: (None, True)}


def test_large_lists_in_parts(docs_of, monkeypatch):
    rows = [(k, A.replace("w0 ", f"x{k} ")) for k in range(40)] + [(100 + k, B.replace("w100 ", f"y{k} ") + " " + " ".join(WORDS[:8])) for k in range(40)]
    whole = sorted(map(tuple, op1.near_duplicates(docs_of(rows)).collect()))
    monkeypatch.setattr(op1, "PART", 3)
    assert sorted(map(tuple, op1.near_duplicates(docs_of(rows)).collect())) == whole
    assert {r[2] for r in whole} == {0, 100}


def test_no_text_is_lost_with_its_id(spark, docs_of, sf):
    kept = sorted(((r.doc_id, r.text) for r in cp.near_duplicates(spark, docs_of(SHARED), sf).collect()), key=repr)
    assert kept == sorted([(2, A), (5, B), (7, C), (7, ""), (3, ""), (3, None), (None, A)], key=repr)


def test_comments_and_notices_under_compound_names():
    from quarry.llm import op6_html_text as op6

    t = lambda h: op6.text_of(op6.parse(f"<article>a {h} z</article>"), set())
    for name in ("comment-thread", "user-comments", "reader-comments", "site-notice", "notice-bar", "comments-count", "visitor_comments_list", "page-notices"):
        assert t(f"<div class={name}>b</div>") == "a z" and t(f"<div id={name}>b</div>") == "a z", name
        assert t(f"<section id={name}>b</section>") == "a b z" and t(f"<h2 id={name}>b</h2>") == "a b z", name
    for name in ("notice-period", "comment-culture", "thread-safety", "user-guide", "reader-response"):
        assert t(f"<div class={name}>b</div>") == "a b z" and t(f"<div id={name}>b</div>") == "a b z", name


def test_comments_by_their_shape():
    from quarry.llm import op6_html_text as op6

    text = "This paragraph belongs to the article and is long enough to show it."
    t = lambda h: op6.text_of(op6.parse(f"<article><h1>T</h1><p>{text}</p>{h}</article>"), set())
    one = "<div class='entry n{k}'><span class=user-name>Ann</span><time>1 May</time><p>I read it with much interest, thank you for writing all of it down.</p></div>"
    two = "<li id=c{k}><b class=author>Ann</b><p>I see.</p><a href=#>Reply</a></li>"
    many = lambda x: "".join(x.format(k=k) for k in range(3))
    for h in (f"<div class=below>{many(one)}</div>", f"<ol>{many(two)}</ol>", f"<div><div><h3>Three thoughts</h3>{many(one)}</div></div>"):
        assert t(h).removesuffix(" Three thoughts") == f"T {text}", h
    # events and a live report with headings aren't comments, nor is what stands before the article's text ends
    for h in ("<ul>" + many("<li><time>18{k}4</time> a war</li>") + "</ul>", "<div>" + many("<div><h2>Goal {k}</h2><span class=author>Ann</span><time>1 May</time><p>It is in.</p></div>") + "</div>",
              f"<div>{many(one)}</div><p>{text}</p>", f"<div>{one.format(k=1)}</div>"):
        assert t(h) != f"T {text}" and ("Ann" in t(h) or "war" in t(h)), h
    assert op6.text_of(op6.parse(f"<article><div>{many(one)}</div></article>"), set()).count("Ann") == 3


def test_buttons_and_labels_amid_sentences():
    from quarry.llm import op6_html_text as op6

    t = lambda h: op6.text_of(op6.parse(f"<article>{h}</article>"), set())
    assert t("<p>Press <button>Start</button> and hold <label>Shift</label> down.</p>") == "Press Start and hold Shift down."
    assert t("<p>a</p><button>Buy</button><label>Name</label><form><p>x <label>Mail</label></p></form><p>b <button class=share>s</button></p>") == "a b"
    assert t("<header><h1>Title</h1></header><h2>Under</h2><p>b</p>") == "Under b"


def test_urls_are_judged_by_their_canonical_form():
    from quarry.llm import op7_url_filters as op7

    rules = [*op7.host_rules(), *op7.method_rules()]
    v = lambda u: next(op7.judge(rules, [u]))[3]
    for u in ("http://a.net/CGI-BIN/x", "http://a.net/%63gi-bin/x", "http://a.net/%2563gi-bin/x", "http://cas%69no.net/", "http://u:p@my.Casino.net:8080/", "http://a.net/x/./y/../../print/", "http://a.net//search",
              "http://a.net/b.EXE", "http://a.net/%63asino", "http://free-bets.co/x", "http://adult-x.info", "http://ads-track.net/a", "http://cheap-pills.biz./", "http://a.net\\print\\x".replace("net\\", "net/")):
        assert v(u) == "block", u
    for u in ("http://a.net/middlesexxx", "http://a.net/casino-royale-film-review", "http://sussex.ac.uk/", "http://a.net/print-history/x", "http://a.net/research/", "http://betsy.net/", "http://a.net/casino/../news",
              "http://loads.net/", "http://a.net/x.exe.html", "http://a.net/?casino", None, "casino"):
        assert v(u) == "allow", u
    assert op7.canonical("", "") == "" and op7.canonical("a.b", "") == "-a-b-/" and op7.canonical("é.de", "/../x//ü") == "-é-de-/x/ü/"
    h, p, rule, verdict = next(op7.judge(rules, ["http://x.Example.org/%65s/CASINO"]))
    assert (h, p, rule, verdict) == ("x.example.org", "/%65s/CASINO", "org/", "allow")  # rules see what stands there


def test_urls_equal_their_sql(spark, pages_of, same):
    import pandas as pd

    from quarry.llm import op7_url_filters as op7

    urls = ["http://a.net/CGI-BIN/x", "http://cas%69no.net/", "http://u@b-ads.net:80/q", "http://a.net/x/../print/", "http://a.net/./search", "http://a.net/x/y/../../print", "http://a.net/b.zip", "http://example.org/es/1", "http://h.com/de/",
            "http://a.net/casino-night", "ftp://a.net", "none", None, "http://a.net/../xxx/"]
    pages = pd.DataFrame([(k, u, "") for k, u in enumerate(urls)], columns=["page_id", "url", "html"])
    same(op7.filter_urls(pages_of([(k, u, "") for k, u in enumerate(urls)])), op7.ORACLE, pages=pages)


def test_candidates_have_a_high_recall():
    from quarry.llm import op10_pii as op10

    spans = lambda t: {(k, t[s:e]) for k, s, e in op10.candidates(t)}
    assert spans("WRITE TO JOHN [AT] EXAMPLE [DOT] COM NOW") >= {("email", "JOHN [AT] EXAMPLE [DOT] COM")} or any("JOHN [AT] EXAMPLE [DOT] COM" in x for _, x in spans("WRITE TO JOHN [AT] EXAMPLE [DOT] COM NOW"))
    assert any("ann (At) b.org" in x for _, x in spans("mail ann (At) b.org"))
    key = "AbCdEfGhIjKlMnOpQrStUvWx"
    assert ("secret", key) in spans(f'token = "{key}"') and ("secret", "0" + key) in spans(f"key: 0{key}")
    assert not spans("Donaudampfschifffahrtsgesellschaft and antidisestablishmentarianism at home")


def test_letter_secrets_and_spelt_addresses_are_found(docs_of):
    from quarry.llm import op10_pii as op10

    plain = [(k, " ".join(f"word{j % 7} and others" for j in range(k % 40 + 5))) for k in range(60)]
    rows = [*plain, (100, 'the token = "QwXzAbLmPoKiJuHyGtFrDeSw" is set'), (101, "contact JOHN [AT] EXAMPLE [DOT] COM today"), (102, "see AbstractUserAccountSettingsControllerFactory for it")]
    got = {r.doc_id: r.spans for r in op10.personal_data(docs_of(rows)).collect()}
    assert got[100].startswith("secret:") and got[101].startswith("email:") and got[102] == ""


def test_leak_index_is_linear_and_made_once(docs_of, spark, monkeypatch):
    import time

    from quarry.llm import op4_decontaminate as op4

    def build(n):
        items = [(k, " ".join(f"w{k}x{j}" if j % 3 else f"c{j}" for j in range(60))) for k in range(n)]
        df = {}
        for _, t in items:
            for w in set(op4.words(t)):
                df[w] = df.get(w, 0) + 1
        t = time.perf_counter()
        index = op4.Index(items, n, 60.0, df)
        return index, time.perf_counter() - t

    _, small = build(300)
    index, large = build(3000)
    assert large < 30 * small + 0.5
    assert [i for i, *_ in index.search(op4.words(index.items[1234][2]))] == [1234]
    monkeypatch.setattr(op4, "CHAIN", 1)
    texts = [" ".join(f"item{k}word{j}" for j in range(20)) for k in range(6)]
    items = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(texts)], "item_id long, text string, ws string, block string")
    docs = docs_of([(k, f"before {t} after") for k, t in enumerate(texts)] + [(99, "nothing of it")])
    want = {(k, k) for k in range(6)}
    assert {(r.doc_id, r.item_id) for r in op4.leaks(docs, items).collect()} == want
    assert {(r.doc_id, r.item_id) for r in op4.leaks(docs, items, block_words=25).collect()} == want  # several blocks, a table between each
