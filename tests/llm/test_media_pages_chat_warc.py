"""Transport streams, page text, chat formatting and WARC archives: round trips, damage, nulls, ties and empty tables."""

import gzip
import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from contestlab.llm import chat, pages, transport, warc

# transport streams


@pytest.mark.parametrize("n", [0, 1, 64, 150, 165, 170, 184, 200, 8191, 8192, 8193, 8192 * 17 + 5])
def test_stream_round_trip(n):
    payload = random.Random(n).randbytes(n)
    media = transport.mux(payload)
    d = transport.demux(media)
    assert len(media) % 188 == 0 and b"".join(u[5] for u in d["units"]) == payload
    assert (d["lost_sync"], d["continuity_errors"], d["bad_tables"], d["tail"]) == (0, 0, 0, 0)
    assert d["programs"] == [(1, 0x100)] and d["streams"] == [(1, 0x101, 6)]
    for i, u in enumerate(d["units"]):
        assert u[1] == i * transport.TICKS and u[3] == (i % 8 == 0) and (u[4] == u[1]) == (i % 8 == 0)


def test_damaged_streams():
    media = transport.mux(random.Random(1).randbytes(30000))
    lost = media[: 188 * 20] + media[188 * 21 :]
    assert transport.demux(lost)["continuity_errors"] == 1
    assert [u[6] for u in transport.demux(lost)["units"]].count(False) == 1 and all(u[6] for u in transport.demux(media)["units"])
    assert not transport.demux(media[:-188])["units"][-1][6]
    twice = media[: 188 * 20] + media[188 * 19 : 188 * 20] + media[188 * 20 :]
    d = transport.demux(twice)
    assert (d["duplicates"], d["continuity_errors"]) == (1, 0) and sum(len(u[5]) for u in d["units"]) == 30000
    table = bytearray(media)
    table[20] ^= 1
    assert transport.demux(bytes(table))["bad_tables"] == 1
    assert transport.demux(b"\0" * 188)["lost_sync"] == 1 and transport.demux(media + b"G")["tail"] == 1
    assert transport.demux(None)["units"] == [] and transport.demux(b"")["packets"] == 0


def test_stored_documents(spark):
    texts = [None, "", "a", "é" * 31, "x" * 64, "long " * 40000, "a"]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, media int")
    rows = transport.inspect(transport.store(df)).collect()
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert r.n_bytes == len(raw) and r.ts.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.ts.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.ts.media_sha256 == hashlib.sha256(r.media).hexdigest()
    assert rows[2].ts == rows[6].ts
    assert transport.inspect(transport.store(df.limit(0))).count() == 0


# pages


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
    return t[0][0]


def test_common_lines_are_longest():
    rng = random.Random(2)
    for _ in range(500):
        a, b = (np.array([rng.randrange(6) for _ in range(rng.randrange(12))], np.uint64) for _ in range(2))
        keep = pages.common_lines(a, b)
        assert keep.sum() == lcs(list(a), list(b))
        assert lcs(list(a[keep]), list(b)) == keep.sum()
    a, b = (np.array([rng.randrange(50) for _ in range(700)], np.uint64) for _ in range(2))
    keep = pages.common_lines(a, b)
    assert keep.sum() == lcs(list(a), list(b)) == lcs(list(a[keep]), list(b))


@pytest.mark.parametrize("part", ['<a title="x ', "<p><b><div ", "<div><p>x</span>", "<!x", """<a b='"'""", "<p>a<", "<script>"])
def test_broken_pages_take_time_by_length(part):
    took = []
    for n in (3000, 12000):
        start = time.time()
        pages.blocks(part * n + "<p>end</p>")
        took.append(time.time() - start)
    assert took[1] < 10 * took[0] + 0.3


def test_names_count_as_a_whole():
    page = '<div class="share">out</div><article><p>a</p><div class="share-of-market"><p>kept</p></div><section id="related-work">too</section><div class="shared noticed">own</div><ol class="comments">no</ol></article>'
    assert [t for t, _ in pages.blocks(page)] == ["a", "kept", "too", "own"]
    assert pages.blocks("<a href=/x/>link</a> after<p/>next") == [("link after", False), ("next", False)]


def test_article_lines_fall_to_differencing(spark):
    """Without differencing the lines that all pages of the host share would stay."""
    rows = [(i, f"http://a.example/{i}", f"<article><p>Story {i}</p><div><p>Sign up for our letter</p></div><p>End {i}</p></article>", i, i) for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, __row int, __gone int")
    got = {r.page_id: (r.text, r["__row"], r["__gone"]) for r in pages.extract(df).collect()}
    assert got == {i: (f"Story {i} End {i}", i, i) for i in range(6)}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header>Top</header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="ad">Buy</div>%s<aside>Side</aside><section id="comments"><p>First!</p></section><form><input value=x><button>Go</button></form><footer>&copy; 2024</footer></body></html>"""


def test_blocks_of_a_page():
    body = "<article><h1>Head &amp; <em>tail</em></h1><p>One  two\n three<br>four<p>five &eacute;&#233;<div class='share'>Share</div><p>six</article>"
    got = [t for t, a in pages.blocks(PAGE % body) if a]
    assert got == ["Head & tail", "One two three four", "five éé", "six"] or " ".join(got) == "Head & tail One two three four five éé six"
    assert pages.blocks(None) == [] and pages.blocks("") == [] and pages.blocks("a < b") == [("a < b", False)]
    assert pages.blocks("<p>unclosed <b>bold<p>next</div>") == [("unclosed bold", False), ("next", False)]
    assert pages.blocks("<p>&amp;lt;x</p><!-- <p>no</p> --><p hidden>no</p>") == [("&lt;x", False)]


def test_differencing_without_article(spark):
    bodies = [f"<div><p>Menu of the site</p><p>Only here {i} alpha</p><p>And more of page {i}</p><p>Imprint</p></div>" for i in range(12)]
    rows = [(i, f"https://www.a.example/x/{i:03d}?q=1#f", b, 1) for i, b in enumerate(bodies)] + [(50, None, "<p>alone</p>", 1), (51, "https://b.example/", None, 1), (52, "https://c.example/", "", 1), (3, "https://www.a.example/x/003?q=1#f", bodies[3], 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    out = pages.extract(df)
    got = {r.page_id: r.text for r in out.collect()}
    assert out.count() == len(rows)
    for i in range(12):
        assert got[i] == f"Only here {i} alpha And more of page {i}", (i, got[i])
    assert (got[50], got[51], got[52]) == ("alone", "", "")
    assert pages.extract(df.limit(0)).count() == 0


def test_copies_keep_their_article(spark):
    html = PAGE % "<article><p>The same story.</p><p>Told twice.</p></article>"
    df = spark.createDataFrame([(i, f"http://a.example/{i}", html) for i in range(6)], "page_id long, url string, html string")
    assert {r.text for r in pages.extract(df).collect()} == {"The same story. Told twice."}


def test_differencing_inside_the_article(spark):
    quote = "<p>Quoted by two pages.</p>"
    bodies = [f"<p>Menu</p><article><p>Story {i} begins</p><p>Join our letter today</p>{quote if i in (4, 5) else ''}<p>Story {i} ends</p></article>" for i in range(8)]
    boxes = [f"<div class='story'><p>Top {i}</p></div><div><p>The long text of page {i} stands outside of the small box</p><p>Imprint</p></div>" for i in range(4)]
    rows = [(i, f"http://a.example/{i}", b) for i, b in enumerate(bodies)] + [(20 + i, f"http://b.example/{i}", b) for i, b in enumerate(boxes)]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(1, 7):
        assert got[i] == f"Story {i} begins {'Quoted by two pages. ' if i in (4, 5) else ''}Story {i} ends"
    for i in range(4):
        assert got[20 + i] == f"Top {i} The long text of page {i} stands outside of the small box"


@pytest.mark.parametrize("chunk", [1, 2, 5, 20_000])
def test_copies_have_neighbours_too(spark, monkeypatch, chunk):
    monkeypatch.setattr(pages, "CHUNK_PAGES", chunk)
    menu = "".join(f"<p>Menu {k}</p>" for k in range(18))
    texts = ["Own a", "Own b", "Own c", "Own c", "Own c", "Own c", "Own d", "Own e"]
    rows = [(i, f"http://a.example/{i}", f"<div>{menu}<p>{t}</p><p>Also {t}</p></div>") for i, t in enumerate(texts)]
    rows += [(20 + i, f"http://b.example/{i}", f"<article><p>Notice</p><p>Tale {i}</p></article>") for i in range(4)] + [(30, "http://a.example/3x", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in pages.extract(df).collect()}
    assert got == {i: f"{t} Also {t}" for i, t in enumerate(texts)} | {20 + i: f"Tale {i}" for i in range(4)} | {30: ""}


# chat


def test_template_is_reversible():
    rng = random.Random(1)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", " ", "\\", "<", ">", "[", "]", "<<ROLE:", ">>", "<</ROLE>>", "a", "\n", "é", "/"]
    for _ in range(4000):
        turns = [(rng.choice(["user", "assistant", "system", "", "x>>y", "a<<ROLE:", "tool>", "".join(rng.choice(bits) for _ in range(3))]), "".join(rng.choice(bits) for _ in range(rng.randrange(9)))) for _ in range(rng.randrange(5))]
        text, mask = chat.render(turns)
        assert chat.parse(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in mask] == [t for r, t in turns if r == "assistant"]


def test_fingerprints_select_mappings():
    assert chat.canonical('{"instruction": "do", "input": "this", "output": "done"}')[1:] == ("instruction", [("user", "do\n\nthis"), ("assistant", "done")])
    assert chat.canonical('{"output": "done", "input": "", "instruction": null}')[2] == [("user", ""), ("assistant", "done")]
    assert chat.canonical('{"conversations": [{"from": "human", "value": "a"}, {"value": "b", "from": "gpt"}]}')[1:] == ("from_value", [("user", "a"), ("assistant", "b")])
    assert chat.canonical('{"messages": []}')[1:] == ("messages", [])
    assert chat.canonical('{"other": 1}')[1:] == (None, None) and chat.canonical("no json") == (None, None, None) and chat.canonical(None) == (None, None, None)
    assert chat.fingerprint(["a", "b"]) == chat.fingerprint(["b", "a", "a"]) != chat.fingerprint(["a.b"])


def test_conversations_round_trip(spark):
    rows = [(c, t, r, x) for c in range(8) for t, (r, x) in enumerate([("user", f"q{c} </s>"), ("assistant", "a [INST] \\ é")])] + [(9, 1, "assistant", None), (9, 0, None, "x"), (9, None, "tool", "y"), (9, 1, "assistant", "b"), (None, 0, "user", "u")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    out = {r.conv_id: r for r in chat.read_back(chat.format_records(chat.records(df))).collect()}
    for c in range(8):
        turns = [("user", f"q{c} </s>"), ("assistant", "a [INST] \\ é")]
        assert out[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest() and out[c].loss_chars == len(turns[1][1])
    assert {out[c].mapping for c in range(4)} == {"messages", "from_value", "prompt_response", "instruction"}
    nine = [("", "x"), ("assistant", ""), ("assistant", "b"), ("tool", "y")]
    assert out[9].n_turns == 4 and out[9].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in nine).encode()).hexdigest() and out[9].loss_sha256 == hashlib.sha256(b"b").hexdigest()
    assert None in out and chat.read_back(chat.format_records(chat.records(df.limit(0)))).count() == 0
    odd = spark.createDataFrame([("{}",), (None,)], "record string")
    assert [r.n_turns for r in chat.read_back(chat.format_records(odd)).collect()] == [None, None]


# WARC


@pytest.mark.parametrize("split", [211, 1 << 20])
def test_archives_round_trip(spark, tmp_path, monkeypatch, split):
    same = "<p>" + "same page " * 20
    inner = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\nbroken"
    rows = [(5, "http://a/", same), (3, "http://b/\r\nX: y", same), (9, None, same), (1, "http://c/", "short"), (2, "http://d/", "short"), (4, "http://e/", None), (6, "http://f/", inner), (7, "http://g/", "é" * 60), (8, "http://h/", "")]
    monkeypatch.setattr(warc, "RECORDS", 4)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    path = str(tmp_path / "w")
    warc.write(df, path)
    warc.write(df, path + "-gz", compression="gzip")
    packed = {int(r.page): (r.digest, r.refers_to) for r in warc.read_archives(spark, path + "-gz").collect()}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)  # splits inside of files, also inside of records and of the magic
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        found = warc.chained(spark, path)[0]
        records = warc.read_archives(spark, path).collect()
        assert split > 1000 or warc.scan(spark, path).select("file", "split").distinct().count() > 5
        assert warc.broken(found).count() == 0
    finally:
        for k, v in zip(("maxPartitionBytes", "openCostInBytes"), before):
            spark.conf.set(f"spark.sql.files.{k}", v)
    got = {int(r.page): r for r in records}
    assert set(got) == {r[0] for r in rows} and len(records) == len(rows) and packed == {i: (r.digest, r.refers_to) for i, r in got.items()}
    for i, _, h in rows:
        raw = (h or "").encode()
        assert (got[i].payload_bytes, got[i].digest) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {5: "3", 9: "3"}
    assert len(list((tmp_path / "w").glob("part-*"))) > 2
    assert warc.scan(spark, path).where("page = '999'").count() == 1  # a candidate that no chain reaches


def test_chain_is_the_plain_walk(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f, a, rng.choice([-1, *range(a + 1, 60)])) for f in ("x", "y", "z") for a in range(0, 60, rng.choice([1, 2, 3]))]
    df = spark.createDataFrame(rows, "file string, at long, next long")
    got = {(r.file, r["at"]) for r in warc.reachable(df).collect()}
    by, want = {(f, a): n for f, a, n in rows}, set()
    for f in ("x", "y", "z"):
        at = 0
        while (f, at) in by:
            want.add((f, at))
            at = by[f, at]
    assert got == want and warc.reachable(df.limit(0)).count() == 0


def test_truncated_archive(tmp_path, spark):
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    d = tmp_path / "t"
    d.mkdir()
    (d / "part-0.gz").write_bytes(gzip.compress(record + record.replace(b":1>", b":2>")[:-6]))
    assert [r.page for r in warc.read_archives(spark, str(d)).collect()] == ["1"]
    plain = tmp_path / "p"
    plain.mkdir()
    (plain / "a.warc").write_bytes(record + b"junk" + record.replace(b":1>", b":2>"))
    assert [r.page for r in warc.read_archives(spark, str(plain)).collect()] == ["1"]
    assert [r["at"] for r in warc.broken(warc.chained(spark, str(plain))[0]).collect()] == [0]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "empty.warc").write_bytes(b"")
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


def test_repeated_and_null_keys(spark, tmp_path):
    rows = [(1, "u", "<p>" + "x" * 200), (1, "u", "<p>" + "x" * 200), (None, None, "<p>" + "x" * 200), (None, "v", None), (2, "w", "y" * 100_000)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string")
    warc.write(df.drop("digest"), str(tmp_path / "w"))
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert sorted((r.page or "", r.payload_bytes) for r in got) == [("", 0), ("", 203), ("1", 203), ("1", 203), ("2", 100_000)]
    assert {r.refers_to for r in got if r.record_type == "revisit"} == {"1"} and sum(r.record_type == "revisit" for r in got) == 1
    warc.write(df.limit(0).drop("digest"), str(tmp_path / "e"))
    assert warc.read_archives(spark, str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize("html,want", [
    ("<html><head><title>x</title><body><article><p>Hello world text</p></article></body>", "Hello world text"),  # </head> may be left out
    ("<html><head><meta charset=utf-8><p>Hello world</p>", "Hello world"),
    ("<head><title>x</title>Plain text<p>more", "Plain text more"),
    ("<body><form id=aspnet><nav><a href=/>Home</a></nav><div><p>A whole page of text in a form.</p><p>And more.</p></div></form></body>", "A whole page of text in a form. And more."),
    ("<body><form><header>Site</header><article><p>Text of the article</p></article><footer>Imprint</footer></form></body>", "Text of the article"),
    ("<body><div class=widget><span>label</span><article><p>The article in a widget</p></article></div></body>", "The article in a widget"),
    ("<body><div class='modal search'><article><h1>T</h1><p>The article in a modal</p></article></div></body>", "T The article in a modal"),
    ("<body><nav><ul><li>Home</ul><article><p>Swallowed by an open nav</p></article>", "Swallowed by an open nav"),
    ("<body><article><header><h1>Own title</h1></header><p>Body of it</p></article>", "Own title Body of it"),
    ("<body><article><div class=search><p>Real text</p></div></article>", "Real text"),
    ("<body><aside>Only an aside with text</aside><nav>Menu</nav>", "Only an aside with text"),
    # what was furniture stays so
    ("<body><header>Site</header><form><input>Search here</form><article><p>The text of it, long enough.</p></article><div class=related><article>Teaser</article></div></body>", "The text of it, long enough."),
    ("<body><article><p>Short.</p></article><div class=comments><p>A comment that is much longer than the article is.</p></div></body>", "Short."),
    ("<body><nav>Menu</nav><p>Text</p><footer>Foot</footer>", "Text"),
])
def test_no_page_shape_comes_out_empty(html, want):
    assert pages.main_text(pages.blocks(html), np.zeros(0, bool)) == want
