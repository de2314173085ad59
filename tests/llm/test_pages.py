"""Page extraction, WARC archives and preference pairs."""

import gzip
import hashlib
import random
import time
from collections import Counter

import pytest

from flowlattice.llm import common, html, preference, warc

SMALL = "/root/testdata/sf0.001"
PAGE = "page_id bigint, url string, html string, text string, host string, content int, row string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "t", "h", 1, "r") for r in rows], PAGE)


def texts(frame):
    return {r["page_id"]: r["text"] for r in html.main_text(frame).collect()}


FULL = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body class="page-header">
<header><h2>Site</h2></header><nav><ul><li>Menu</ul></nav><div class="cookie-notice">Cookies</div><div id="sidebar"><p>Side</p></div>
<article class="post comments-open"><header><h1>A &amp; B&nbsp;&eacute;</h1></header><p>One <b>bold</b>ly
 two<br>three<p>Four<div class="ad">Buy</div><ul><li>five<li>six</ul><!-- no --><form>Mail <input></form>
<section class="comments"><article><p>I think</p></article></section><table><tr><td>x<td>y</table>&lt;p&gt; 1 &#60; 2<aside>Note</aside></article>
<footer>Foot</footer></body></html>"""


def test_declared_article(spark):
    got = texts(pages_of(spark, [(1, "http://h/a", FULL), (2, None, None), (3, "x", ""), (4, "x", "just &lt;text&gt;  here"), (5, "y", "<p>a<nav>b"),
                                 (6, "z", "<main><p>in</p><article>deep</article></main>out"), (7, "z", "<div hidden>no</div><div style='display: none'>no</div>a<b>b</b>c")]))
    assert got == {1: "A & B é One boldly two three Four five six x y <p> 1 < 2", 2: "", 3: "", 4: "just <text> here", 5: "a", 6: "deep", 7: "abc"}


def test_articles_that_are_cards_do_not_replace_the_page(spark):
    rng = random.Random(2)
    body = {i: " ".join(f"own{rng.randint(0, 10**9)}" for _ in range(30)) for i in range(4)}
    card = "<article class=card>one teaser of eight words on every page</article>"
    got = texts(pages_of(spark, [
        (1, "a", "<main><h1>Title</h1><p>body</p><article class=card>teaser</article></main>"),
        (2, "a", "<main><p>in</p><article>first</article><p>mid</p><article>second</article></main><div>out</div>"),
        (3, "b", "<article>x y</article><nav>menu</nav><article>z</article><article> </article>"),
        (4, "c", f"<div>menu</div><article>{body[0]}</article><article></article>"),
        *((10 + i, "http://d/", f"<nav>no</nav><div>{body[i]}</div>{card}") for i in range(4))]))
    assert got == {1: "Title body teaser", 2: "in first mid second", 3: "x y z", 4: body[0], **{10 + i: body[i] for i in range(4)}}


def test_boilerplate_of_a_host_is_found(spark):
    rng = random.Random(1)
    shared = " ".join(f"shared{k}" for k in range(30))
    own = {i: " ".join(f"own{rng.randint(0, 10**9)}" for _ in range(20)) for i in range(40)}
    rows = [(i, f"https://www.a.org/{i}", f"<div>{shared}</div><p>{own[i]}</p><div>{shared} end</div>") for i in range(20)]
    rows += [(i, f"https://b.org:8080/{i}", f"<div>{shared} {own[i]}</div>") for i in (30,)]
    rows += [(39, "https://c.org/", f"<p>{own[39]}"), (38, "https://c.org/copy", f"<p>{own[39]}"), (39, "https://c.org/", f"<p>{own[39]}")]
    got = html.main_text(pages_of(spark, rows)).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    by_id = {r["page_id"]: r["text"] for r in got}
    assert all(by_id[i] == own[i] + " end" or by_id[i] == own[i] for i in range(20))
    # One page of a host repeats nothing; equal pages are no boilerplate of each other.
    assert by_id[30] == f"{shared} {own[30]}" and by_id[38] == by_id[39] == own[39]


def test_main_text_beside_an_article_is_searched(spark):
    """What `main` holds beside a page's article is no text of that page, but says what other pages of the host repeat."""
    note = "read more of our letters in the next issue of spring"
    rows = [(1, "http://h/", f"<main><p>{note}</p><article>{'long article of one page ' * 20}</article></main>"),
            (2, "http://h/", f"<div>{note}</div><p>only here</p>"), (3, "http://g/", f"<div>{note}</div><p>only here</p>"),
            (4, "http://g/", f"<article>{note} and the article goes on</article>")]
    got = texts(pages_of(spark, rows))
    assert got == {1: ("long article of one page " * 20).strip(), 2: "only here", 3: f"{note} only here", 4: f"{note} and the article goes on"}


def brute_repeats(rows):
    """{(host, at, row): length} by comparing every suffix with every one of other content."""
    found = {}
    for k, (host, content, tokens) in enumerate(rows):
        for at in range(len(tokens) - html.RUN + 1):
            best = 0
            for other, differs, words in rows:
                if other == host and differs != content:
                    for start in range(len(words)):
                        n = 0
                        while n < html.DEPTH and at + n < len(tokens) and start + n < len(words) and tokens[at + n] == words[start + n]:
                            n += 1
                        best = max(best, n)
            if best >= html.RUN:
                found[host, at, k] = best
    return found


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_repeats_by_the_order_of_suffixes(spark, partitions):
    """Lengths of repeats are those of a comparison of all suffixes, wherever the edges of tasks fall."""
    rng = random.Random(partitions)
    lines = [[f"w{rng.randint(0, 3)}" for _ in range(rng.randint(5, 25))] for _ in range(6)]
    rows = []
    for k in range(24):
        words = [w for _ in range(rng.randint(0, 3)) for w in [*rng.choice(lines), f"own{rng.randint(0, 5)}"]]
        rows.append((rng.choice("ab"), k, words))
    rows += [("a", 100, ["same"] * 30), ("a", 100, ["same"] * 30), ("b", 101, ["same"] * 30), ("b", 102, ["same"] * 12), ("c", 103, lines[0] * 3)]
    parsed = spark.createDataFrame([(h, c, k, t) for k, (h, c, t) in enumerate(rows)], "host string, content bigint, row bigint, tokens array<string>")
    before = {name: spark.conf.get(name) for name in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        found = html._suffixes(parsed, "row").join(html.repeats(parsed), ["host", "key"]).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    want = brute_repeats(rows)
    assert {(r["host"], r["at"], r["row"]): r["length"] for r in found} == want and len(want) > 100
    assert max(want.values()) == html.DEPTH and len(set(want.values())) > 3


def test_long_and_deep_pages(spark):
    deep = "<div>" * 3000 + "middle" + "</div>" * 3000
    long = "<article>" + "".join(f"<p>word{k} of a long page</p>" for k in range(20_000)) + "</article>"
    got = texts(pages_of(spark, [(1, "a", deep), (2, "a", long)]))
    assert got[1] == "middle" and got[2].count("long page") == 20_000
    assert html.main_text(pages_of(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("page, want", [
    ("<p>one</p><select><option>a<option>b</select><p>two</p>", "one two"),
    ("<p>one<datalist><option>a<option>b</datalist>two", "one two"),
    ("<p>one</p><button><div>x</button><p>two</p>", "one two"),
    ("<p>one</p><video><p>no video</video><p>two</p>", "one two"),
    ("<p>one</p><select><optgroup><option>a</select><object><ul><li>x</object><p>two</p>", "one two"),
    ("<b>one<div>two</b> three</div></b> four", "one two three four"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", "a b c d e"),
    ("<table><tr><td>a<td>b<tr><td>c</table>d", "a b c d"),
    ("<dl><dt>a<dd>b<dt>c<dd>d</dl></p></i>e", "a b c d e"),
])
def test_optional_and_missing_end_tags(page, want):
    for html_text in (page, f"<article>{page}</article>"):
        assert " ".join(text for _, text in html.blocks_of(html_text)) == want


def test_names_of_parts_do_not_drop_text():
    page = ("<article><p>T</p><div class=share-price>Shares rose</div><div class='related-work x'>Earlier work</div><p id=menu-of-the-day>Soup</p>"
            "<div class=cookie-notice>no</div><div class='x site-footer'>no</div><div id=sidebar_left-2>no</div><div class='share buttons'>no</div>End</article>")
    blocks, articles = html.page_of(page)
    assert [t for kind, t in blocks if kind == html.ARTICLE] == ["T", "Shares rose", "Earlier work", "Soup", "End"] and articles == 1


def test_pages_of_unpaired_tags_take_linear_time():
    for page in ("<i></p>" * 40_000, "<div>" + "<i>" * 20_000 + "</b></p>" * 20_000, "<b><div>" + "<i>" * 20_000 + "</b>" * 20_000):
        began = time.process_time()
        html.page_of(page)
        assert time.process_time() - began < 5


def brute_warc(rows):
    best = {}
    for page, _, body in rows:
        raw = (body or "").encode()
        if page is not None and len(raw) >= 1000:
            best[raw] = max(best.get(raw, page), page)
    out = []
    for page, _, body in rows:
        raw = (body or "").encode()
        kept = best.get(raw) if page is not None else None
        again = kept is not None and page < kept
        out.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", kept if again else None))
    return Counter(out)


def test_warc_round_trip(spark):
    copy, fake = "é" * 700, "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n" * 40
    rows = [(1, "u", copy), (2, "u 2\n", copy), (3, None, copy), (4, "u", "é" * 10), (5, "u", "é" * 10), (6, "u", None), (7, "u", ""), (8, "u", fake),
            (9, "u", fake), (None, "u", copy), (10, "u", "line\nend\r\n"), (10, "u", "line\nend\r\n"), (3, None, copy), (11, "u", "y" * 300_000)]
    got = warc.round_trip(pages_of(spark, rows))
    assert Counter(map(tuple, got.collect())) == brute_warc(rows)
    assert warc.round_trip(pages_of(spark, rows).limit(0)).count() == 0


def test_pages_with_long_urls_come_back(spark):
    rows = [(1, "data:," + "x" * 200_000, "a"), (2, "http://h/" + " \n" * 40_000, "b"), (3, "http://h/WARC/1.1", "c"), (4, "\r\nWARC/1.1\r\n\r\n", "d")]
    got = warc.round_trip(pages_of(spark, rows))
    assert Counter(map(tuple, got.collect())) == brute_warc(rows)


def test_a_gap_in_written_archives_is_an_error(spark, tmp_path, monkeypatch):
    (tmp_path / "part.txt").write_bytes(warc.record(1, "u", 1, hashlib.sha1(b"p").digest(), b"p") + b"WARC/1.1\r\nWARC-Type: response\r\n")
    monkeypatch.setattr(warc, "write_archives", lambda pages, folder: str(tmp_path))
    with pytest.raises(Exception, match="header not closed"):
        warc.round_trip(pages_of(spark, [(1, "u", "p")])).count()


def test_payloads_come_back_whole(spark, tmp_path):
    pages = common.table(spark, SMALL, "pages")
    folder = warc.write_archives(pages, str(tmp_path / "warc"))
    read = warc.read_archives(spark, folder).collect()
    assert all(r["gap"] is None for r in read)
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in read if r["record_type"] == "response"}.items() <= {
        str(r["page_id"]): r["html"] or "" for r in pages.collect()}.items()


def some_records(n=6):
    return [warc.record(i, f"http://x/{i}", 40 + i, hashlib.sha1(b"p" * (40 + i)).digest(), b"p" * (40 + i)) for i in range(n)]


@pytest.mark.parametrize("packed", [False, True])
def test_salvage_goes_on_after_damage(packed):
    parts = [gzip.compress(r) if packed else r for r in some_records()]
    hurt = bytearray(parts[2])
    hurt[len(hurt) // 2] ^= 0xFF
    data = parts[0] + parts[1] + bytes(hurt) + b"\x00junk" + parts[3] + parts[4][:-9] + parts[5] + parts[0][:20]
    found = list(warc.salvage(data))
    assert [warc.contents(f, b)["page_id"] for kind, _, _, f, b in found if kind == "record"] == ["0", "1", "3", "5"]
    gaps = [(a, b) for kind, a, b, _, _ in found if kind == "gap"]
    at = len(parts[0]) + len(parts[1])
    mid = at + len(hurt) + 5 + len(parts[3])
    assert gaps == [(at, at + len(hurt) + 5), (mid, mid + len(parts[4]) - 9), (len(data) - 20, len(data))]
    # Records and gaps cover every byte once.
    spans = sorted({(a, b) for _, a, b, _, _ in found})
    assert spans[0][0] == 0 and spans[-1][1] == len(data) and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))


def test_salvage_of_random_damage_never_fails():
    rng, records = random.Random(9), some_records(8)
    whole = b"".join(records)
    for _ in range(150):
        data = bytearray(whole)
        a = rng.randrange(len(data))
        data[a:a + rng.randint(0, 300)] = rng.randbytes(rng.randint(0, 80))
        found = list(warc.salvage(bytes(data)))
        pages = [warc.contents(f, b)["page_id"] for kind, _, _, f, b in found if kind == "record"]
        # A header line is under no digest, so an id itself may be lost.
        known = [p for p in pages if p in "01234567"] if None not in pages else [p for p in pages if p]
        assert len(pages) >= 4 and known == sorted(known)


def brute_example(chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1

    def text(turns):
        return "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)

    def mask(turns):
        return " ".join(f"{len(r) + 5}:0 {len(t) + 8}:{int(r == 'assistant')}" for r, t in turns)

    return n, text(chosen[:n]), text(chosen[n:]), mask(chosen[n:]), text(rejected[n:]), mask(rejected[n:])


def test_preference_examples_match_plain_version(spark):
    rng = random.Random(6)
    sides = {}
    for k in range(60):
        base = [(rng.choice(["user", "assistant", "system", ""]), rng.choice(["", "a", "é\U0001f600", "long " * 50])) for _ in range(rng.randint(0, 5))]
        sides[k] = (base + [("assistant", rng.choice("xy"))] * rng.randint(0, 2), base + [("assistant", rng.choice("xy"))] * rng.randint(0, 2))
    schema = "pair_id bigint, turn int, role string, text string, n string, prompt string"
    tables = [spark.createDataFrame([(k, i * 2, r or None, t or None, "n", "p") for k, s in sides.items() for i, (r, t) in enumerate(s[side])], schema) for side in (0, 1)]
    got = {r["pair_id"]: tuple(r)[1:] for r in preference.preference_examples(preference.pairs_of(*tables)).collect()}
    assert got == {k: brute_example(*s) for k, s in sides.items() if s[0] or s[1]}


def test_repeated_answer_pairs_on_awkward_conversations(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "b"), (1, 4, "user", "s"), (2, 0, "user", "only"),
            (3, 0, "assistant", None), (4, 0, "user", "q"), (4, 1, "assistant", "q"), (5, None, None, None), (6, 1, "assistant", "t"), (6, 1, "assistant", "t"),
            (None, 0, "assistant", "n")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    got = {r["conv_id"]: tuple(r)[1:] for r in preference.preference_examples(preference.repeated_answer_pairs(frame), "conv_id").collect()}
    a = "assistant"
    want = {1: brute_example([("user", "q"), (a, "a"), ("user", "r"), (a, "b")], [("user", "q"), (a, "a"), ("user", "r"), (a, "a")]),
            3: brute_example([(a, "")], [(a, "")]), 4: brute_example([("user", "q"), (a, "q")], [("user", "q"), (a, "q")]),
            6: brute_example([(a, "t"), (a, "t")], [(a, "t"), (a, "t")]), None: brute_example([(a, "n")], [(a, "")])}
    assert got == want
    assert preference.preference_examples(preference.repeated_answer_pairs(frame.limit(0)), "conv_id").count() == 0
