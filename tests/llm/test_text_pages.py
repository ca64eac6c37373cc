"""HTML extraction and WARC bundles."""

import hashlib
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ffspark.llm import html_extract, warc
from ffspark.llm.html_extract import lcs_members, page_lines

NAV = '<nav><ul><li><a href="/x">Home</a></li><li>About</li></ul></nav><!-- ad --><div class="ad">Buy <b>now</b></div>'
FOOT = "<footer>&copy; site</footer></body></html>"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string").repartition(2)


def texts(lines, role):
    return [t for r, t in lines if r == role]


def test_article_lines():
    page = (
        '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body>' + NAV
        + "<article><h1>Head&amp;line&#33;</h1><p><b>One\n two<br>three<p>Four <!-- x --> five</p><aside>no</aside><div class='cookie-notice'>no</div><p class=advert>no<p>yes"
        + "<section id=comments><p>no</p></section><ul><li>a<li>b</ul><form>no</form>&lt;p&gt; &am &copy</article>" + FOOT
    )
    assert texts(page_lines(page), html_extract.ARTICLE) == ["Head&line!", "One two three", "Four five", "yes", "a", "b", "<p> &am ©"]
    assert texts(page_lines(page), html_extract.TEXT) == []
    assert page_lines("") == [] and page_lines("<") == [(0, "<")] and page_lines("a<p>b") == [(0, "a"), (0, "b")]
    cut = "<article><p>One</p><p>Two &am"
    assert texts(page_lines(cut), html_extract.ARTICLE) == ["One", "Two &am"]
    assert texts(page_lines("<article><p>x</p><script>never ends"), html_extract.ARTICLE) == ["x"]


@pytest.mark.parametrize(
    "page",
    [
        "<main class='content with-sidebar'><p>Text</p></main>", "<article class='post has-comments'><p>Text</p></article>", "<div id='page-header-wrap'><article><p>Text</p></article></div>",
        "<div class=header><article><p>Text</p></article></div>", "<article><section id='discussion'><p>Text</p></section></article>", "<article><div class='related-work'><p>Text</p></div></article>",
        "<article><div class='notice'><p>Text</p></div></article>", "<article><div data-id='nav' data-role=menu><p>Text</p></div></article>", "<nav>" + "<b>" * 300 + "menu</nav><article><p>Text</p></article>",
    ],
)
def test_attribute_words_leave_articles_alone(page):
    assert texts(page_lines(page), html_extract.ARTICLE) == ["Text"]


@pytest.mark.parametrize(
    "page, want",
    [
        ("<div class='layout has-sidebar'><article><p>Text</p></article></div>", ["Text"]), ("<div id='social-app'><main><p>Text</p></main></div>", ["Text"]), ("<div class='no-sidebar'><p>Text</p></div>", ["Text"]),
        ("<article><div class='side-effects'><p>Text</p></div></article>", ["Text"]), ("<nav>" + "<span>" * 250 + "menu</nav><p>Text</p>", ["Text"]), ("<div class='sidebar'><p>no</p></div><p>Text</p>", ["Text"]),
    ],
)
def test_names_that_only_look_like_furniture(page, want):
    assert [t for r, t in page_lines(page) if r != html_extract.OTHER] == want


def test_differencing_decides_lines_of_links(spark):
    """Inside articles, repeated lines of links go, lines of links that a page has alone and repeated prose stay."""
    page = lambda k: (
        f"<article><h1>Title {k}</h1><p>Read <a href=/a>this</a> first.</p><p>Repeated prose.</p><ul><li><a href=/s>Share</a></li><li><a href=/m>More</a> <a href=/n>News</a></li></ul><p><a href=/x>Source {k}</a></p></article>"
    )
    rows = [(k, f"http://a.org/{k}", page(k)) for k in range(6)]
    got = {r.page_id: r.text for r in html_extract.extract_main_text(pages(spark, rows)).collect()}
    assert got == {k: f"Title {k}\nRead this first.\nRepeated prose.\nSource {k}" for k in range(6)}
    deleted = sum(len(page_lines(h)) for _, _, h in rows) - sum(t.count("\n") + 1 for t in got.values())
    assert deleted == 12
    alone = html_extract.extract_main_text(pages(spark, rows[:1])).first().text
    assert alone == "Title 0\nRead this first.\nRepeated prose.\nShare\nMore News\nSource 0"


def test_a_very_long_page(spark):
    lines = "".join(f"<p>line {k}</p>" for k in range(20_000))
    rows = [(1, "http://a.org/1", "<p>Menu</p>" + lines + "<p>own 1</p>"), (2, "http://a.org/2", "<p>Menu</p><p>own 2</p>" + "<p>x</p>" * 5_000), (3, "http://b.org/1", "<article><p>" + "word " * 200_000 + "</p></article>")]
    got = {r.page_id: r.text for r in html_extract.extract_main_text(pages(spark, rows)).collect()}
    assert got[1].startswith("line 0\n") and got[1].endswith("line 19999\nown 1") and got[2] == "own 2" + "\nx" * 5_000 and len(got[3]) == 999_999


def brute_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
    return t[0][0]


def is_subsequence(x, b):
    it = iter(b)
    return all(v in it for v in x)


@settings(max_examples=150, deadline=None)
@given(a=st.lists(st.integers(0, 4), max_size=18), b=st.lists(st.integers(0, 4), max_size=18), cells=st.sampled_from([1, 20, 1 << 20]))
def test_lcs(a, b, cells):
    chosen = [x for x, m in zip(a, lcs_members(a, b, cells), strict=True) if m]
    assert len(chosen) == brute_lcs(a, b) and is_subsequence(chosen, b)


def test_long_lcs():
    rng = random.Random(1)
    a, b = [rng.randrange(50) for _ in range(4000)], [rng.randrange(50) for _ in range(4000)]
    assert sum(lcs_members(a, b, 1 << 18)) == sum(lcs_members(a, b))


def test_extraction(spark):
    plain = lambda *own: "<body><p>Welcome</p>" + "".join(f"<p>{x}</p>" for x in own) + "<p>Contact us</p></body>"
    rows = [
        (1, "http://a.org/en/1", plain("First text")), (2, "http://a.org/en/2?x=1", plain("Second text", "More")), (3, "http://b.org/en/1", plain("Alone")), (4, None, "<p>no url</p>"), (5, "http://a.org/z", None),
        (6, "http://c.org/1", "<article><p>Shared line</p></article>"), (7, "http://c.org/2", "<article><p>Shared line</p><p>Own</p></article>"), (8, "http://d.org/1", plain("Same")), (9, "http://d.org/1", plain("Same")), (None, "not a url", ""),
    ]
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        got = {r.page_id: r for r in html_extract.extract_main_text(pages(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    want = {1: "First text", 2: "Second text\nMore", 3: "Welcome\nAlone\nContact us", 4: "no url", 5: "", 6: "Shared line", 7: "Shared line\nOwn", 8: "Welcome\nSame\nContact us", 9: "Welcome\nSame\nContact us", None: ""}
    assert {k: r.text for k, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values()) and got[1].neighbour_id == 2 and got[7].neighbour_id is None  # structure decides both pages of c.org
    assert html_extract.extract_main_text(pages(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><p>Story</p><div class='ad-slot'>no</div><div class=advert_top>no</div><div id='google_ads_1'>no</div><p>end</p></article>", ["Story", "end"]),
        ("<article><p>Story</p><div class='user-comments'><p>no</p></div><ol class=comment-thread><li>no</ol></article>", ["Story"]),
        ("<article><p>Story</p></article><div id='comments'><article class='comment-body'><p>no</p></article></div>", ["Story"]),
        ("<div class=related><article><p>no</p></article></div><article><p>Story</p></article><div class='sidebar'><article>no</article></div>", ["Story"]),
        ("<form id=f><div><p>Story one.</p><input name=x><p>Story two.</p></div></form>", ["Story one.", "Story two."]),
        ("<p>Skip</p><form id=f><p>A long story in a page that is a form as a whole.</p><select><option>no</select></form>", ["Skip", "A long story in a page that is a form as a whole."]),
        ("<form action=/><div class=menu>no</div><article><p>Story</p><form>no</form></article></form>", ["Story"]),
        ("<p>Write to us about what you have read in this paper.</p><form>Name <input><label>no</label></form>", ["Write to us about what you have read in this paper."]),
        ("<article><p>Let <math><mi>x</mi></math> be.</p></article>", ["Let x be."]), ("<div class='content comments-open'><p>Story</p></div>", ["Story"]), ("<div class='ad-free'><p>Story</p></div>", ["Story"]),
    ],
)
def test_adverts_comments_and_forms(page, want):
    assert html_extract.main_text(page_lines(page), None).split("\n") == want


def test_near_copies_keep_their_text(spark):
    """Versions of a page lose lines that are no sentences only; pages with a text of their own lose what they share."""
    story = "<p>Menu</p><p>Long story line one.</p><p>Line two.</p>"
    rows = [(k, f"http://a.org/s?v={k}", f"{story}<p>Version {k}</p>") for k in range(3)] + [(10 + k, f"http://b.org/{k}", f"{story}<p>Version {k}</p>") for k in range(3)]
    rows += [(20 + k, f"http://c.org/{k}", f"<p>We use cookies on this site.</p><p>This is the story number {k} of a long row of them.</p>") for k in range(3)]
    got = {r.page_id: r.text for r in html_extract.extract_main_text(pages(spark, rows)).collect()}
    assert got == {at + k: f"Long story line one.\nLine two.\nVersion {k}" for at in (0, 10) for k in range(3)} | {20 + k: f"This is the story number {k} of a long row of them." for k in range(3)}


def test_only_undecided_pages_are_paired(spark, monkeypatch):
    seen = []
    real = html_extract._pairs
    monkeypatch.setattr(html_extract, "_pairs", lambda reps, most: seen.append(reps.count()) or real(reps, most))
    decided = [(k, f"http://a.org/{k}", f"<article><p>Story {k}</p></article>") for k in range(4)]
    assert {r.text for r in html_extract.extract_main_text(pages(spark, decided + [(9, "http://a.org/9", None)])).collect()} == {"", *(f"Story {k}" for k in range(4))} and not seen
    more = decided + [(10, "http://b.org/1", "<p>Menu</p><p>One</p>"), (11, "http://b.org/2", "<p>Menu</p><p>Two</p>")]
    got = {r.page_id: (r.text, r.neighbour_id) for r in html_extract.extract_main_text(pages(spark, more)).collect()}
    assert seen == [2] and got[10] == ("One", 11) and got[11] == ("Two", 10) and got[2] == ("Story 2", None)


def test_every_page_is_differenced(spark):
    """Also pages that structure decides: differencing first, then the check puts back and takes out."""
    page = lambda k, *more: f"<nav>Menu</nav><div class=ad>Buy {k}</div><article><h1>Title {k}</h1><p>Same line.</p>{''.join(more)}</article><footer>Foot</footer>"
    rows = [(k, f"http://a.org/{k}", page(k)) for k in (1, 2)] + [(3, "http://a.org/2/x", page(3, "<p>And a longer line that this page has alone.</p>")), (4, "http://b.org/1", page(4)), (5, "http://c.org/1", "<p>Menu</p><p>One</p>"), (6, "http://c.org/2", "<p>Menu</p><p>Two</p>"), (7, "http://c.org/3", None)]
    table = pages(spark, rows)
    got = {r.page_id: r for r in html_extract.extract_main_text(table, every_page=True).collect()}
    assert {k: (r.neighbour_id, r.n_shared, r.n_restored, r.n_removed) for k, r in got.items()} == {
        1: (2, 2, 0, 1), 2: (3, 3, 1, 1), 3: (2, 3, 1, 1), 4: (None, 0, 0, 3), 5: (6, 1, 0, 0), 6: (5, 1, 0, 0), 7: (6, 0, 0, 0)
    }
    plain = {r.page_id: r for r in html_extract.extract_main_text(table).collect()}
    assert {k: r.text for k, r in got.items()} == {k: r.text for k, r in plain.items()} and got[3].text == "Title 3\nSame line.\nAnd a longer line that this page has alone."
    assert all(r.n_chars == len(r.text) for r in got.values()) and plain[1].n_shared is None and plain[5].n_shared == 1


def test_the_query_differences_every_page(spark, sf_dir):
    from urllib.parse import urlsplit

    from ffspark.llm import queries

    table = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    place = {r.page_id: (urlsplit(r.url).netloc.lower(), urlsplit(r.url).path) for r in table}
    lines = {r.page_id: [t for _, t in page_lines(r.html)] for r in table}
    sentences = lambda found: sum(len(t) for t in found if html_extract._is_sentence(t))
    seen = 0
    for r in queries.op1_html_extraction(spark, sf_dir).collect():
        host, path = place[r.page_id]
        others = {k: html_extract.common_path(path, p) for k, (h, p) in place.items() if h == host and p != path and lines[k] != lines[r.page_id]}
        if not others:
            assert r.neighbour_id is None or place[r.neighbour_id] == (host, path)
            continue
        seen += 1
        assert others[r.neighbour_id][0] == max(others.values())[0]
        own, near = lines[r.page_id], lines[r.neighbour_id]
        shared = [t for t, gone in zip(own, lcs_members(own, near), strict=True) if gone]
        assert len(shared) == brute_lcs(own, near)
        if sentences(shared) and 5 * sentences(shared) >= 4 * max(sentences(own), sentences(near)):
            shared = [t for t in shared if not html_extract._is_sentence(t)]
        assert r.n_shared == len(shared)
    assert seen == sum(any(h == host and p != path for h, p in place.values()) for host, path in place.values()) > 20


def test_partners_for_any_partitioning(spark, monkeypatch):
    """Pages at range borders, groups of copies and near copies of one path; without an article element."""
    plain = lambda own: f"<p>Welcome</p><p>{own}</p><p>Contact us</p>"
    rows = [(k, f"http://h{k % 3}.org/p/{k:03}", plain(f"text {k}")) for k in range(60)]
    rows += [(100 + k, f"http://h0.org/q?v={k}", plain("Copied")) for k in range(8)]
    rows += [(200 + k, "http://h1.org/r", plain(f"Long</p><p>near</p><p>copy</p><p>version {k}")) for k in range(8)]
    rows += [(300 + k, f"http://h2.org/s/{k}", plain("Mirrored")) for k in range(8)] + [(400, "http://one.org/a?1", plain("one")), (401, "http://one.org/a?2", plain("two"))]
    want = {k: f"text {k}" for k in range(60)} | {100 + k: "Copied" for k in range(8)} | {200 + k: f"Long\nnear\ncopy\nversion {k}" for k in range(8)}
    want |= {300 + k: "Mirrored" for k in range(8)} | {400: "one", 401: "two"}
    seen = []
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for n, most in ((1, html_extract.RANGE_PAGES), (24, html_extract.RANGE_PAGES), (1, 7)):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            monkeypatch.setattr(html_extract, "RANGE_PAGES", most)
            got = {r.page_id: r for r in html_extract.extract_main_text(pages(spark, rows)).collect()}
            assert {k: r.text for k, r in got.items()} == want
            seen.append({k: r.neighbour_id for k, r in got.items()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert seen[0] == seen[1] == seen[2]


def test_extraction_of_the_page_table(spark, sf_dir):
    """These pages hold their text in h1 and p elements of one article."""
    import html
    import re

    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.extract_main_text(table).collect()}
    for r in table.collect():
        inner = re.split("</article>|<footer>", r.html.split("<article>", 1)[1])[0]
        inner = re.sub(r"<[a-z/][^>]*$", "", inner)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if False else "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b), r.page_id


def test_bundle_round_trip():
    rng = random.Random(2)
    payloads = [bytes(rng.randrange(256) for _ in range(rng.randrange(3000))) for _ in range(60)] + [b"", b"\r\n\r\n", b"x" * 50_000]
    writer = warc.BundleWriter(frame_bytes=8000)
    records = [warc.warc_record(k, "http://x/é \r\n", p, hashlib.sha1(p).hexdigest(), None if k % 5 else 7) for k, p in enumerate(payloads)]
    places = [writer.add(r) for r in records]
    bundle = writer.finish()
    reader = warc.BundleReader(pa.BufferReader(bundle))
    assert len(reader.frames) > 5
    for k in rng.sample(range(len(records)), len(records)):
        fields, payload = warc.parse_record(reader.record(*places[k], len(records[k])))
        assert payload == (payloads[k] if k % 5 else b"") and fields["WARC-Record-ID"] == f"<urn:page:{k}>"
        assert fields["WARC-Type"] == ("response" if k % 5 else "revisit")
    import zstandard

    plain = b"".join(zstandard.ZstdDecompressor().stream_reader(bundle, read_across_frames=True).read() for _ in range(1))
    assert plain == b"".join(records)  # any Zstandard reader can read the whole bundle
    with pytest.raises(ValueError):
        warc.BundleReader(pa.BufferReader(b"0" * 40))


def test_stores():
    fs, root = warc.open_store("dbfs:/a/b")
    assert fs.type_name == "local" and root == "/dbfs/a/b"
    assert warc.open_store("file:///a/b")[1] == "/a/b"
    fs, root = warc.open_store("s3a://bucket/a?region=none")
    assert fs.type_name == "s3" and root == "bucket/a"


def test_archive(spark, tmp_path):
    big = "é" * 700
    rows = [(1, "http://a/", big), (2, None, big), (3, "http://c/", "small"), (4, "http://d/", "small"), (5, "u", None), (6, "u", ""), (None, "n", big), (9, "h", "y" * 999), (10, "h", "y" * 999), (11, "z", "q" * 200_000), (11, "z", "q" * 200_000)]
    got = warc.archive_pages(pages(spark, rows), str(tmp_path / "arc")).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for page, url, html in rows:
        data = (html or "").encode()
        assert (by[page].payload_bytes, by[page].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
    assert (by[1].record_type, by[1].refers_to) == ("revisit", 2) and (by[2].record_type, by[2].refers_to, by[2].payload.decode()) == ("response", None, big)
    assert all(by[k].record_type == "response" and by[k].refers_to is None for k in (3, 4, 5, 6, 9, 10, 11))
    assert by[2].url is None and by[1].url == "http://a/"
    assert list((tmp_path / "arc").glob("*.warc.zst"))
    assert warc.archive_pages(pages(spark, rows).limit(0)).count() == 0
