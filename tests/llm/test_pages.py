"""Archives and main texts."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import random
import re
from collections import Counter, defaultdict
from html import unescape
from xml.etree import ElementTree

import brute
import pytest
from helpers import tuples

from spanledger.llm import html_text, warc

STAR = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string, record_type string, host string, path string"
EDGE = [
    (1, "http://a.example/", "<p>one</p>"),
    (2, "http://a.example/2", "<p>one</p>"),
    (2, "http://a.example/2", "<p>one</p>"),
    (9, None, None),
    (4, "", ""),
    (5, "http://b.example/with space and\ttab", "é漢🤯\r\n\r\nWARC/1.0\r\n\x00"),
    (6, "http://b.example/6", "filedesc://x 0.0.0.0 1 text/plain 5\n" + "long " * 50_000),
    (None, "http://c.example/", "<p>one</p>"),
    (None, None, "no tags"),
]


def pages(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], PAGES)
    return df.repartition(3) if rows else df


# Archives

WARC = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def records(rows: list[tuple]) -> list[tuple]:
    """The contract by brute force; which of equal ids is the response makes no difference to the rows."""
    groups = defaultdict(list)
    for k, (page, _, html) in enumerate(rows):
        groups[(html or "").encode()].append(k)
    out = []
    for payload, members in groups.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        first = max(members, key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
        for k in members:
            kind = ("response", None) if k == first else ("revisit", rows[first][0])
            out.append((rows[k][0], len(payload), digest, *kind))
    return out


@pytest.mark.parametrize("per_file", [1000, 3])
def test_records_come_back_as_they_went_in(spark, monkeypatch, per_file):
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", per_file)
    monkeypatch.setitem(warc.WRITE, "maxRecordsPerFile", str(per_file))
    rows = EDGE + [(100 + k, f"http://d.example/{k}", f"page {k % 7}") for k in range(40)]
    got = tuples(warc.archived(pages(spark, rows)), *WARC)
    assert brute.near_equal(got, records(rows))


def test_digests_joined_by_shuffle_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", -1)
    assert brute.near_equal(tuples(warc.archived(pages(spark, EDGE)), *WARC), records(EDGE))


def test_no_pages_no_records(spark):
    assert tuples(warc.archived(pages(spark, []))) == []


def foreign(version: int, records: list[bytes], cut: int = 0) -> bytes:
    block = warc.version_block(version, "own.arc", "20010101000000").encode()
    more = "" if version == 1 else "200 - - 0 own.arc "
    parts = [block + b"\n"]
    for k, body in enumerate(records):
        parts.append(f"http://old.example/{k} 10.0.0.1 20010203040506 image/gif {more}{len(body)}\n".encode() + body + b"\n")
    whole = b"".join(parts)
    return whole[: len(whole) - cut]


@pytest.mark.parametrize("version", [1, 2])
def test_archives_of_others_are_converted(spark, tmp_path, version):
    body = bytes(range(256)) * 3
    record = b"HTTP/1.0 200 OK\r\nServer: old\r\n\r\n" + body
    other = b"HTTP/1.0 404 Not found\r\n\r\n" + b"\n\nno such thing " * 10
    data = foreign(version, [record, other, record])
    cut = foreign(version, [other, record], cut=200)
    (tmp_path / "arc").mkdir()
    # Some archives are one compressed stream, others one for each record; some have junk between records.
    (tmp_path / "arc" / "a.arc.gz").write_bytes(gzip.compress(data[:300]) + gzip.compress(data[300:] + b"junk\n\n"))
    (tmp_path / "arc" / "b.arc.gz").write_bytes(gzip.compress(cut))
    arc, out = f"file://{tmp_path}/arc", f"file://{tmp_path}/warc"
    warc.convert(spark, arc, out)
    found = []
    for path in (tmp_path / "warc").glob("*.gz"):
        found += list(warc.read_warc(io.BytesIO(gzip.decompress(path.read_bytes()))))
    kinds = sorted((r["warc-type"], len(r["block"])) for r in found)
    assert kinds == sorted(
        [("response", len(record)), ("response", len(other)), ("revisit", 32), ("revisit", 26), ("response", len(record) - 199)]
    )
    whole = next(r for r in found if r["block"] == record)
    assert whole["warc-date"] == "2001-02-03T04:05:06Z" and whole["warc-ip-address"] == "10.0.0.1"
    assert whole["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
    ids = {r["warc-record-id"] for r in found}
    assert len(ids) == 5 and all(r["warc-refers-to"] in ids for r in found if r["warc-type"] == "revisit")
    assert sum(r.get("warc-truncated") == "length" for r in found) == 1


def test_damaged_payloads_are_noticed(spark, tmp_path):
    (tmp_path / "w").mkdir()
    record = (
        "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: x\r\n"
        "WARC-Payload-Digest: sha1:AAAA\r\nContent-Length: 23\r\n\r\nHTTP/1.1 200 OK\r\n\r\nbody\r\n\r\n"
    )
    (tmp_path / "w" / "a.gz").write_bytes(gzip.compress(record.encode()))
    with pytest.raises(Exception, match="damaged"):
        warc.warc_records(spark, f"file://{tmp_path}/w").collect()


def arc_records(spark, folder) -> list[dict]:
    """The records of WARC files converted from the ARC files of a folder."""
    out = folder.parent / "converted"
    warc.convert(spark, f"file://{folder}", f"file://{out}")
    return [r for path in out.glob("*.gz") for r in warc.read_warc(io.BytesIO(gzip.decompress(path.read_bytes())))]


def test_plain_and_damaged_archives_are_converted_as_far_as_they_are_sound(spark, tmp_path):
    folder = tmp_path / "arc"
    folder.mkdir()
    rng = random.Random(1)
    bodies = [rng.randbytes(3000) for _ in range(60)]
    blocks = [b"HTTP/1.0 200 OK\r\n\r\n" + b for b in bodies]
    one = [foreign(1, [b]) for b in blocks]
    (folder / "plain.arc").write_bytes(b"".join(one[:10]))
    whole = gzip.compress(foreign(1, blocks[10:40]))
    (folder / "cut.arc.gz").write_bytes(whole[: len(whole) // 2])
    tail = bytearray(gzip.compress(one[40]) + gzip.compress(one[41]))
    tail[-6] ^= 255
    (folder / "tail.arc.gz").write_bytes(tail)
    (folder / "padded.arc.gz").write_bytes(b"".join(map(gzip.compress, one[42:50])) + bytes(512))
    (folder / "noise.arc.gz").write_bytes(gzip.compress(one[50]) + b"no gzip at all")
    (folder / "empty.arc").write_bytes(b"")
    (folder / "stub.arc.gz").write_bytes(b"\x1f\x8b")
    found = arc_records(spark, folder)
    payloads = {warc.http_parts(r["block"])[1] for r in found if "warc-truncated" not in r}
    assert payloads >= set(bodies[:10] + bodies[40:51]) and payloads <= set(bodies)
    # The cut archive gives all that can be inflated: whole records and the part of one.
    assert 10 <= len(payloads & set(bodies[10:40])) <= 16
    part = [r for r in found if "warc-truncated" in r]
    assert len(part) == 1 and any(b.startswith(part[0]["block"]) for b in blocks[10:40])


def test_a_damaged_warc_file_is_an_error(spark, tmp_path):
    warc.write_arc(pages(spark, [(k, "http://a.example/", f"page {k}") for k in range(50)]).coalesce(1), f"file://{tmp_path}/a")
    warc.convert(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/w")
    (tmp_path / "cut").mkdir()
    whole = next((tmp_path / "w").glob("*.gz")).read_bytes()
    (tmp_path / "cut" / "a.gz").write_bytes(whole[: len(whole) // 2])
    with pytest.raises(Exception, match="damaged"):
        warc.warc_records(spark, f"file://{tmp_path}/cut").collect()


@pytest.mark.parametrize(
    "block",
    [
        b"filedesc://x 0.0.0.0 20010101000000 text/plain 11\n1 0 someone\n",
        b"filedesc://x 0.0.0.0 20010101000000 text/plain many\n",
        b"filedesc://x\n",
        b"filedesc://x 0.0.0.0 20010101000000 text/plain 12\n1 0 some\nURL\n",
        b"",
    ],
)
def test_version_blocks_without_field_names(block):
    record = b"http://a.example/ 10.0.0.1 20010203040506 text/html 5\nhello\n"
    bad = b"http://a.example/ 10.0.0.1 20010203040506 text/html -5\n"
    found = list(warc.read_arc(io.BytesIO(block + record + bad + record)))
    assert [(r["url"], r["block"], r["truncated"]) for r in found] == [("http://a.example/", b"hello", False)] * 2


@pytest.mark.parametrize(
    ("block", "head", "body", "page"),
    [
        (b"HTTP/1.0 200 OK\nX-Page-Id: 7\n\nbody\r\n\r\nmore", b"HTTP/1.0 200 OK\nX-Page-Id: 7\n\n", b"body\r\n\r\nmore", 7),
        (b"HTTP/1.0 200 OK\r\nX-Page-Id: -7\r\n\r\n\n\nbody", b"HTTP/1.0 200 OK\r\nX-Page-Id: -7\r\n\r\n", b"\n\nbody", -7),
        (b"HTTP/1.0 200 OK\r\nX-Page-Id: seven\r\n\r\n", b"HTTP/1.0 200 OK\r\nX-Page-Id: seven\r\n\r\n", b"", None),
        (b"HTTP/1.0 200 OK\nX-Page-Id: 99999999999999999999\n\n", b"HTTP/1.0 200 OK\nX-Page-Id: 99999999999999999999\n\n", b"", None),
        (b"HTTP/1.0 204 None", b"HTTP/1.0 204 None", b"", None),
        (b"20010101 dns answer\n\nof two parts", b"", b"20010101 dns answer\n\nof two parts", None),
    ],
)
def test_heads_of_any_form(block, head, body, page):
    assert warc.http_parts(block)[:2] == (head, body)
    assert warc.page_of(warc.http_parts(block)[2]) == page


def test_a_record_of_another_protocol_is_a_resource(spark, tmp_path):
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "a.arc").write_bytes(foreign(1, [b"an answer\n\nin two parts"]))
    (record,) = arc_records(spark, tmp_path / "arc")
    assert record["warc-type"] == "resource" and record["content-type"] == "image/gif"
    assert record["block"] == b"an answer\n\nin two parts"


@pytest.mark.parametrize(
    ("date", "want"),
    [
        ("20010203040506", "2001-02-03T04:05:06Z"),
        ("2000", "2000-01-01T00:00:00Z"),
        ("200012", "2000-12-01T00:00:00Z"),
        ("20000000000000", "2000-01-01T00:00:00Z"),
        ("2001020304050607", "2001-02-03T04:05:06Z"),
        ("-", "1970-01-01T00:00:00Z"),
    ],
)
def test_dates_are_completed(date, want):
    assert warc.warc_date(date) == want


# Main texts


def text(html: str) -> str:
    return html_text.Page(html).main(frozenset(), frozenset(), frozenset())


def test_menus_headers_and_the_like_are_left_out():
    html = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
      <nav><ul><li><a href=x>A</a><li>B</ul></nav><div id="cookie-notice">We use cookies</div><div class="page">
      <article class="post"><header><h1>Head</h1><p>by me</p></header><p>One <b>two</b>&nbsp;three
      <p>four <span class="ad">buy</span> five<br>six &lt;b&gt; &amp;amp; &eacute;
      <aside>side</aside><ul><li>i1<li>i2</ul><form><input>F</form><script>if(a<b)"</p>"</script><!-- no -->
      <footer>foot</footer><section id="comments"><article>no</article></section>
      <table><tr><td>a<td>b<tr><td>c</table></article></div><div role="complementary">more</div><footer>bye"""
    assert text(html) == "Head\n\nOne two three\n\nfour five six <b> &amp; é\n\ni1\n\ni2\n\na\n\nb\n\nc"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", ""),
        ("plain < text & more", "plain < text & more"),
        ("<nav>menu</nav>", ""),
        ("<p>a</p><nav>menu<article><p>b", "b"),
        ("<form><p>all <i>in form</i></form>", "all in form"),
        ("<a href='x>y' b=\">\">t</a> <p title=\"a>b\">u</p>", "t\n\nu"),
        ("<p>open <b>bold<p>next</b> part</p><div>x</span>y</div>", "open bold\n\nnext part\n\nxy"),
        ("<script>never closed <p>text</p>", ""),
        ("<SCRIPT>x</SCRIPT ><P>Up", "Up"),
        ("<!-- open <p>x</p>", ""),
        ("<p>1&nbsp;&#8203;2&#x41;&unknown;</p>", "1 ​2A&unknown;"),
        ('<p class="shadow">kept</p><p class="ad-slot">not</p>', "kept"),
        ('<div id="site-header">Site</div><div class="entry-header">Head</div><p>x', "Head\n\nx"),
        ('<p>x</p><ol class="commentlist"><li>y</ol><div class="copyright">z', "x"),
        ("<article>a</article>between<article>b</article>", "a\n\nb"),
        ('<div aria-label="unclosed>x</div><p>y', "x\n\ny"),
    ],
)
def test_main_text_of_odd_pages(html, want):
    assert text(html) == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<div class='layout has-sidebar'><article><p>a</article><div class=sidebar>b</div></div>", "a"),
        ("<div class='no-sidebar'><main><p>a</main><div class=comments><article>b</article></div></div>", "a"),
        ("<div id='with-comments'><div class='long-form'><article>a<div class=ad>b</div></article></div></div>", "a"),
        ("<article class='post comments-open'><p>a</p><section id=comments><p>b</section></article>", "a"),
        ("<article class='post share-post'>a</article><article class=comment>b</article>", "a"),
        ("<div class='two-col-sidebar'><article>a b c</article><div class=comments><article>d</article></div></div>", "a b c"),
        ("<div class='layout form'><article>most of it</article></div><p>x", "most of it"),
        ("<div class='page-search'><p>most of it</p></div><p>x", "most of it\n\nx"),
        ("<div id=post>a</div><div id=comments><article>most of it</article></div>", "a"),
        ("<article>a<section id=comments><article>most of it</article></section></article>", "a"),
    ],
)
def test_names_with_an_aside_word_do_not_hide_the_article(html, want):
    assert text(html) == want


def test_very_long_and_deep_pages_are_linear():
    assert len(text("<p>" + "word " * 300_000)) == 300_000 * 5 - 1
    assert text("<div>" * 3000 + "x" + "</div>" * 3000) == "x"
    assert text('<a href="' * 2000 + "x") == '<a href="' * 2000 + "x"


def host_pages(n: int = 20) -> list[tuple]:
    """Pages without any telling name: a template text, a list of links, and copies of one article."""
    rows = []
    for k in range(n):
        links = "".join(f"<li><a href=/{j}>place {j * k}</a></li>" for j in range(k % 5 + 1))
        html = (
            f"<title>t{k}</title><div class=x><ul>{links}</ul></div><div class=y>Always the same words</div>"
            f"<div class=z><p>story {k}</p><p>second part {k * k}</p></div>"
        )
        rows.append((k, f"http://user@HOST.example:80/{k}", html))
    copied = "<title>same</title><div class=z><p>copied story</p></div>"
    return rows + [(100 + k, "http://host.example:80/c", copied) for k in range(30)]


@pytest.mark.parametrize("broadcast", [True, False])
def test_template_texts_and_menus_are_deduced_from_a_host_s_pages(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(html_text, "BROADCAST_HOSTS", -1)
    rows = host_pages() + [(500, "http://other.example/", "<div class=y>Always the same words</div>")]
    got = dict(tuples(html_text.main_texts(pages(spark, rows)), "page_id", "text"))
    for k in range(20):
        assert got[k] == f"story {k}\n\nsecond part {k * k}"
    assert {got[100 + k] for k in range(30)} == {"copied story"}
    assert got[500] == "Always the same words"


@pytest.mark.parametrize(("n", "head"), [(20, "<title>Site</title>"), (20, ""), (2, "<title>t{k}</title>"), (5, "")])
def test_templates_need_no_titles_and_no_number_of_pages(spark, n, head):
    rows = []
    for k in range(n):
        own = f"<div class=z><p>story {k}</p><p>second part {k * k}</p></div>"
        html = f"{head.format(k=k)}<div class=h>Site name</div><div class=y>Always the same words</div>{own}"
        rows.append((k, "http://host.example/", html))
        rows.append((100 + k, "http://host.example/copy", rows[0][2]))
        rows.append((200 + k, None, html))
    got = dict(tuples(html_text.main_texts(pages(spark, rows)), "page_id", "text"))
    for k in range(n):
        assert got[k] == got[200 + k] == f"story {k}\n\nsecond part {k * k}" and got[100 + k] == got[0]


def plain_article(html: str) -> str:
    article = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", article.replace("<br>", " "))
    return "\n\n".join(filter(None, (" ".join(unescape(re.sub("<[^>]*>", "", b)).split()) for b in blocks)))


def neutral(html: str, without_advert: bool) -> str:
    """A given page without telling names, and on request without its advert."""
    html = re.sub(r' class="[^"]*"', "", re.sub(r"<(/?)(article|nav|footer)\b", r"<\1div", html))
    return re.sub(r"<!-- ad.*?--><div>.*?</div>", "", html, flags=re.S) if without_advert else html


@pytest.mark.parametrize("some_without", [False, True])
def test_pages_without_telling_names_give_the_same_text(spark, some_without):
    df = spark.read.parquet(f"{STAR.replace('0.001', '0.01')}/pages.parquet")
    rows = tuples(df, "page_id", "url", "html")
    changed = [(i, u, neutral(h, some_without and i % 3 == 0)) for i, u, h in rows]
    got = dict(tuples(html_text.main_texts(pages(spark, changed)), "page_id", "text"))
    layouts = Counter((html_text.host_of(u), some_without and i % 3 == 0) for i, u, _ in rows)
    # A layout that a host has on one page only has nothing to be compared with.
    want = {
        i: plain_article(h) for i, u, h in rows if layouts[html_text.host_of(u), some_without and i % 3 == 0] > 1
    }
    assert len(want) > 180
    right = sum(got[i] == text for i, text in want.items())
    assert right >= 0.95 * len(want)
    # It is the classes that find them: without, adverts and footers come in.
    assert not any(text(h) == plain_article(rows[k][2]) for k, (_, _, h) in enumerate(changed))


def random_page(rng: random.Random, layout: list, k: int) -> str:
    """A page of a random layout: fixed texts, texts of its own, lists of links, nested."""
    out = []
    for part in layout:
        if isinstance(part, list):
            out.append(f"<div>{random_page(rng, part, k)}</div>")
        elif part == "fixed":
            out.append("<p>Always the same</p>")
        elif part == "links":
            out.append("<ul>" + "".join(f"<li><a>go {k} {j}</a></li>" for j in range(rng.randint(1, 4))) + "</ul>")
        elif part == "often":
            out.append("".join(f"<div><p>More</p><p>own {k} {j}</p></div>" for j in range(rng.randint(1, 3))))
        elif part == "seldom":
            out.append(f"<div>now {k}</div>" if rng.random() < 0.5 else "")
        else:
            out.append("".join(f"<p>{'word ' * rng.randint(1, 30)}{k} {j}</p>" for j in range(rng.randint(1, 4))))
    return "".join(out)


def random_layout(rng: random.Random, depth: int = 0) -> list:
    parts = ["fixed", "links", "own", "often", "seldom"]
    return [
        random_layout(rng, depth + 1) if depth < 3 and rng.random() < 0.4 else rng.choice(parts)
        for _ in range(rng.randint(1, 4))
    ]


def deduced(htmls: list[str]) -> list[str]:
    """Classes, menus and slots of one host's pages by brute force, on parsed trees with paths written out."""
    read = []
    for html in htmls:
        elements, blocks = [], []

        def walk(element, plain, placed, elements=elements, blocks=blocks):
            begin = len(blocks)
            at = len(elements)
            elements.append(None)
            kids = [e for e in element if e.tag != "a"]
            words = " ".join("".join(t for e in [element, *element.findall("a")] for t in [e.text or ""]).split())
            if words:
                size = len(words.replace(" ", ""))
                blocks.append((plain, placed, words, size, size if element.find("a") is not None else 0))
            for k, kid in enumerate(kids):
                alike = [j for j, other in enumerate(kids) if other.tag == kid.tag]
                place = (kid.tag, alike.index(k), len(alike)) if len(alike) > 1 else (kid.tag,)
                walk(kid, (*plain, (kid.tag,)), (*placed, place))
            elements[at] = (element.tag, plain, placed, begin, len(blocks))

        walk(ElementTree.fromstring(f"<r>{html}</r>"), (), ())
        read.append((elements, blocks))
    keys = [tuple(b[2] for b in blocks if b[4] < 0.9 * b[3]) for _, blocks in read]
    first = {key: k for k, key in reversed(list(enumerate(keys)))}
    vectors, held = defaultdict(Counter), defaultdict(list)
    for k in first.values():
        elements, blocks = read[k]
        inside = {e[2]: blocks[e[3] : e[4]] for e in elements}
        for tag, plain, placed, begin, end in elements[1:]:
            for token in {plain, placed}:
                vectors[token][k] += 1
                held[token].append((tag, blocks[begin:end], inside[placed[:-1]], token == placed))
        for plain, placed, words, *_ in blocks:
            for token in {plain, placed}:
                vectors[token, words][k] += 1
    pages_of = len(first)
    least = min(pages_of, html_text.LEAST_PAGES)
    template, menus, slots = set(), set(), set()
    for token, vector in vectors.items():
        if len(vector) < 2:
            continue
        if len(token) == 2 and isinstance(token[1], str):
            if len(vector) >= least and vector == vectors.get(token[0]):
                template.add(token)
            continue
        chars = sum(b[3] for _, of, *_ in held[token] for b in of)
        links = sum(b[4] for _, of, *_ in held[token] for b in of)
        if len(vector) >= least and chars and links >= html_text.MENU_LINKS * chars:
            menus.add(token)
        own = sum(b[3] - b[4] for _, of, *_ in held[token] for b in of)
        around = sum(b[3] - b[4] for *_, of, _ in held[token] for b in of)
        contents = {tuple(sorted(b[2] for b in of)) for _, of, *_ in held[token]}
        alone = max(vector.values()) == 1 and held[token][0][0] == "div" and all(h[3] for h in held[token])
        if alone and len(contents) > 1 and own and own >= html_text.MAIN_SHARE * around:
            slots.add(token)
    out = []
    for elements, blocks in read:
        at = ()
        while below := [e for e in elements[1:] if e[2][:-1] == at and e[2] in slots]:
            at = max(below, key=lambda e: sum(b[3] - b[4] for b in blocks[e[3] : e[4]]))[2]
        kept = []
        for plain, placed, words, *_ in blocks:
            if placed[: len(at)] != at or {(plain, words), (placed, words)} & template:
                continue
            if not any(p[:n] in menus for p in (plain, placed) for n in range(1, len(p) + 1)):
                kept.append(words)
        out.append("\n\n".join(kept))
    return out


def test_classes_and_slots_against_brute_force(spark):
    rng, rows, want = random.Random(5), [], []
    for host in range(40):
        layout = random_layout(rng)
        htmls = [random_page(rng, layout, k) for k in range(rng.choice([1, 2, 5, 12]))]
        rows += [(1000 * host + k, f"http://h{host}.example/{k}", html) for k, html in enumerate(htmls)]
        want += deduced(htmls)
    got = dict(tuples(html_text.main_texts(pages(spark, rows)), "page_id", "text"))
    assert [got[r[0]] for r in rows] == want
    # The layouts have all that there is to deduce.
    whole = [text(r[2]) for r in rows]
    assert sum(a != b for a, b in zip(whole, want)) > len(rows) / 3


def test_pages_of_the_given_table(spark):
    df = spark.read.parquet(f"{STAR}/pages.parquet")
    rows = [(1000 + r[0], *r[1:]) for r in tuples(df, "page_id", "url", "html")] + EDGE
    got = tuples(html_text.main_texts(pages(spark, rows)), "page_id", "url", "text", "n_chars")
    assert len(got) == len(rows) and all(r[3] == len(r[2]) for r in got)
    by_id = {r[0]: r[2] for r in got}
    for page, _, html in rows[: -len(EDGE)]:
        assert by_id[page] == plain_article(html)
    assert by_id[9] == by_id[4] == ""


def test_no_pages_no_texts(spark):
    assert tuples(html_text.main_texts(pages(spark, []))) == []


def test_blocks_are_measured_without_being_split_or_digested_again(monkeypatch):
    """The second pass needs characters alone; texts of blocks have single spaces as their only white space."""
    html = "<body><h1>a  b</h1><div><p>one\x0b two &nbsp; three<p><a href=x>four five</a> six</div><nav>menu</nav></body>"
    page = html_text.Page(html)
    page.place()
    assert [html_text.n_chars(b.text) for b in page.blocks] == [len("".join(b.text.split())) for b in page.blocks]
    chars, links, own, _ = page.sums()
    assert (chars, links, own) == ([0, 2, 13, 24, 28], [0, 0, 0, 8, 8], [0, 2, 13, 16, 16])
    calls = []
    monkeypatch.setattr(html_text, "digest", calls.append)
    assert page._main_slot(frozenset()) == {0, 1, 2, 3} and not calls
