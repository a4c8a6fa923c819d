"""HTML extraction by deduction of templates from equivalence classes.

A page is a sequence of tokens: tags and text blocks, each told apart by the path
of its containers.  Tokens of one path are told apart further by their place, as
the i-th of k alike in their container.  Across the pages of a host the tokens
that occur equally often on every page, page by page, form an equivalence class.
A token's container is part of it, so classes are nested, and places keep those
alike in order; what is not alike may change places, as a slot is the content of
an element and no gap between two.  A text block that is in one class with its
container is there whenever the container is: it belongs to the template, like
menus whose slots hold links alone.  What remains are the slots.

The main slot is found from the page's root down.  An element that is once on
each page of its class, differs between them and holds most of its container's
text outside of links is gone into, until none does, with the headings before it.
Names come after that: of the main slot, the part in an article, if there is one,
and outside of what is named a menu, header, footer, sidebar, notice, advert, form
or comment is the main text.  An article that the main slot does not hold
overrules it.

Occurrence vectors are never gathered: a token's vector is a digest of its
(page, count) pairs, aggregated in Spark by host and token, so a host with most
of the pages is many groups.  Pages of the same text outside of links and what is
set aside count as one page, else copies of one article would make it a template;
on hosts of few such pages a template is on all of them.  Pages meet their host's
template in a second pass; the templates are broadcast when they are counted to
be few and joined by shuffle when not.

Defined results: a null or empty page has an empty text; a null url is a host of
its own; rows of one page id are extracted each for itself; white space is
Unicode's; a heading inside an article's header stays; if forms hold all of a
page's text they are taken for its wrapping; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.llm.common import ship, stage

#: Different pages that a token must be on to count as template; all, and two at least, where a host has fewer.
LEAST_PAGES = 8
#: Share of a slot's characters inside links from which it is a menu.
MENU_LINKS = 0.9
#: Share of its container's text from which a slot is gone into; above a half, so that it is the only one.
MAIN_SHARE = 0.6
#: Hosts whose templates are broadcast, and tokens of all of them together.
BROADCAST_HOSTS, BROADCAST_TOKENS = 100_000, 1_000_000

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
#: Tags that end an open one of the same group, up to the nearest of the scope.
SIBLINGS = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
P_SCOPE = CLOSES_P - {"p"} | {"td", "th", "li", "body", "html"}
P = frozenset({"p"})
#: What ends an element whose content is no markup.
SHUT = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are one text or part of a list or table, not containers of a page's parts.
PARTS = HEADINGS | frozenset("p pre li dt dd tr td th caption figcaption summary blockquote address legend".split())

#: Containers that are never main text, and words of classes, ids and roles that say the same.
ASIDE_TAGS = frozenset("nav header footer aside form head button select dialog menu".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation "
    "menu breadcrumb breadcrumbs sidebar aside complementary footer contentinfo masthead cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations comment comments disqus reply replies respond widget widgets pagination pager "
    "search form toolbar skip copyright commentlist discussion topbar sidenav subnav".split()
)
#: Names of a page's header; other names with the word, like an entry's, may hold the headline.
HEADER_WORDS = frozenset("header site page top main global container wrapper".split())
#: Elements whose own class says nothing against their text.
MAIN_TAGS = frozenset("html body main".split())
#: Words of names like has-sidebar, which tell how a page is laid out, not what an element holds.
LAYOUT_WORDS = frozenset("has no with without long".split())
#: Words of readers' own texts, and what follows them in names that say whether these are allowed.
TALK_WORDS = frozenset("comment comments disqus reply replies respond discussion commentlist".split())
STATE_WORDS = frozenset("open closed enabled disabled".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)")


class Block(NamedTuple):
    """A run of text between block tags: its container, where it is, how much of it is links."""

    path: int
    node: int
    token: int
    text: str
    links: int
    article: bool
    aside: bool
    form: bool


class Node:
    """A block element: its container, paths without and with its place, and the blocks in it."""

    __slots__ = ("up", "tag", "name", "path", "role", "begin", "end")

    def __init__(self, up: int, tag: str, name: str, path: int, begin: int):
        self.up = up
        self.tag = tag
        self.name = name
        self.path = path
        self.role = path
        self.begin = begin
        self.end = begin


class Element(NamedTuple):
    tag: str
    path: int
    node: int
    article: bool
    #: Whether the element or one around it is set aside; as a form only; as a header.
    aside: bool
    form: bool
    header: bool
    #: The text of an inline element that is set aside is left out of its block.
    link: bool
    #: Whether a tag around or of it says that it is set aside; whether an article is around it.
    tagged: bool
    nested: bool
    #: The innermost element around it, or itself, that a name sets aside; the text before it.
    named: int
    own: bool
    begin: int


class Named:
    """An element that a word of its names sets aside."""

    def __init__(self, up: int, words: frozenset[str], whole: bool):
        self.up = up
        self.words = words
        #: Whether some name of it is nothing but such words.
        self.whole = whole
        self.chars = 0


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def n_chars(text: str) -> int:
    """Characters of a block's text but its white space, which is single spaces."""
    return len(text) - text.count(" ")


#: What ``_words`` finds in a tag without attributes.
NAMELESS = "", frozenset(), False, frozenset()


def _words(attributes: str) -> tuple[str, frozenset[str], bool, frozenset[str]]:
    """The class, id and role of a tag as written, their words that set it aside, whether a name has
    no others, and all words."""
    if "=" not in attributes:
        return NAMELESS
    written = " ".join(next(filter(None, m[1:]), "") for m in ATTRIBUTE.findall(attributes))
    every, aside, whole = set(), set(), False
    for name in written.split():
        words = [w.lower() for w in WORDS.findall(name)]
        every.update(words)
        found = ASIDE_WORDS.intersection(words)
        if not found or LAYOUT_WORDS.intersection(words[:-1]):
            continue
        if words[-1] in STATE_WORDS and TALK_WORDS.intersection(words):
            continue
        aside |= found
        whole = whole or len(found) == len(set(words))
    return written, frozenset(aside), whole, frozenset(every)


class Page:
    """The blocks and tag tokens of one page."""

    def __init__(self, html: str):
        self._lifted: frozenset[int] = frozenset()
        self._read(html)
        # What is set aside by name alone is known when all of the page has been seen.
        if lifted := self._overruled():
            self._lifted = lifted
            self._read(html)

    def _overruled(self) -> frozenset[int]:
        """Elements that are set aside by name but hold the article or most of the page's text."""
        if not self._named:
            return frozenset()
        most = [2 * n.chars > self._chars for n in self._named]
        chains = []
        for tag, named, chars in self._articles:
            chain, plain, talk = [], True, False
            while named >= 0:
                n = self._named[named]
                chain.append(named)
                plain, talk = plain and not n.whole, talk or n.whole and bool(n.words & TALK_WORDS)
                named = n.up
            # A name that says nothing else stands, unless the article is most of the page and no comment.
            if chars and (plain or 2 * chars > self._chars and not talk):
                chains.append((tag, chain, chars))
        chains = [c for c in chains if c[0] == "article"] or chains
        lifted: set[int] = set()
        if chains and (least := min(len(chain) for _, chain, _ in chains)):
            sizes: Counter[tuple[frozenset[str], ...]] = Counter()
            alike = {}
            for _, chain, chars in chains:
                if len(chain) == least:
                    names = tuple(self._named[k].words for k in chain)
                    sizes[names] += chars
                    alike.setdefault(names, set()).update(chain)
            lifted = alike[max(sizes, key=lambda names: sizes[names])]
        lifted |= {k for k, n in enumerate(self._named) if most[k] and not n.whole and not n.words & TALK_WORDS}
        if not lifted and all(b.aside for b in self.blocks):
            lifted = {k for k, n in enumerate(self._named) if most[k]}
        return frozenset(lifted)

    def _read(self, html: str) -> None:
        self.blocks: list[Block] = []
        self.nodes = [Node(-1, "", "", 0, 0)]
        self._open = [Element("", 0, 0, False, False, False, False, False, False, False, -1, False, 0)]
        self._text: list[str] = []
        self._links = 0
        #: Elements set aside by name; outermost articles and mains with their names and text; the page's text.
        self._named: list[Named] = []
        self._articles: list[tuple[str, int, int]] = []
        self._chars = 0
        at, end = 0, len(html)
        while at < end:
            found = TOKEN.search(html, at)
            self._add(html[at : found.start() if found else end])
            if not found:
                break
            at = found.end()
            close, tag, attributes = found.group(1, 2, 3) if found[2] else found.group(4, 5, 6)
            if not tag:
                continue
            tag = tag.lower()
            if close:
                self._close(tag)
            elif tag in RAW and not attributes.endswith("/"):
                shut = SHUT[tag].search(html, at)
                at = shut.end() if shut else end
            else:
                self._start(tag, attributes)
        self._flush()
        self._pop(1)
        self.nodes[0].end = len(self.blocks)

    def _add(self, raw: str) -> None:
        if not raw:
            return
        top = self._open[-1]
        if not top.tagged:
            self._chars += len(raw) - sum(map(raw.count, " \n\t\r"))
        if top.aside and top.tag in INLINE and not self._block_aside():
            return
        text = unescape(raw) if "&" in raw else raw
        self._text.append(text)
        if top.link:
            self._links += len("".join(text.split()))

    def _block_aside(self) -> bool:
        """Whether the block that is open, not an inline element in it, is set aside."""
        return next(e.aside for e in reversed(self._open) if e.tag not in INLINE)

    def _flush(self) -> None:
        # Links are counted with their text.
        if not self._text:
            return
        text = " ".join("".join(self._text).split())
        if text:
            top = self._open[-1]
            if top.tag in INLINE:
                top = next(e for e in reversed(self._open) if e.tag not in INLINE)
            token = digest(f"{top.path} {text}")
            # A heading in an article's header is part of the article.
            aside = top.aside and not (top.header and top.article and top.tag in HEADINGS)
            self.blocks.append(Block(top.path, top.node, token, text, self._links, top.article, aside, top.form))
        self._text.clear()
        self._links = 0

    def _pop(self, at: int) -> None:
        ended = self._open[at:]
        if self._text and any(e.tag not in INLINE for e in ended):
            self._flush()
        for e in ended:
            if e.own or e.tag == "article" or e.tag == "main":
                self._count(e)
            if e.tag not in INLINE:
                self.nodes[e.node].end = len(self.blocks)
        del self._open[at:]

    def _count(self, e: Element) -> None:
        """Takes down how much text an element that ends held."""
        if e.own:
            self._named[e.named].chars = self._chars - e.begin
        if e.tag in ("article", "main") and not e.nested:
            self._articles.append((e.tag, e.named, self._chars - e.begin))

    def _close(self, tag: str) -> None:
        inline = tag in INLINE
        if not inline and self._text:
            self._flush()
        for at in range(len(self._open) - 1, 0, -1):
            open_tag = self._open[at].tag
            if open_tag == tag:
                self._pop(at)
                return
            # An inline end tag without its start does not reach outside its block.
            if inline and open_tag not in INLINE:
                return

    def _end_open(self, ends: frozenset[str], scope: frozenset[str]) -> None:
        for at in range(len(self._open) - 1, 0, -1):
            tag = self._open[at].tag
            if tag in ends:
                self._pop(at)
                if len(ends) == 1 and ("p" in ends or "li" in ends):
                    return
                continue
            if tag in scope:
                return

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self._text.append(" ")
            return
        inline = tag in INLINE
        if not inline:
            if self._text:
                self._flush()
            if tag in CLOSES_P:
                self._end_open(P, P_SCOPE)
            if tag in SIBLINGS:
                self._end_open(*SIBLINGS[tag])
        if tag in VOID:
            return
        written, aside, whole, words = _words(attributes) if attributes else NAMELESS
        header = "header" in words <= HEADER_WORDS
        own = (bool(aside) or header) and tag not in MAIN_TAGS
        said = own and len(self._named) not in self._lifted
        body = (tag == "article" or tag == "main") and not said
        shunned = tag in ASIDE_TAGS
        if body:
            # An article is not part of a menu or header: their end tags are missing, or wrap the page.
            first = next((k for k, e in enumerate(self._open) if e.tag in ASIDE_TAGS and e.tag != "form"), None)
            if first is not None:
                self._pop(first)
        up = self._open[-1]
        named = up.named
        if own:
            named = len(self._named)
            self._named.append(Named(up.named, aside or frozenset({"header"}), whole or header))
        path, node = up.path, up.node
        if not inline:
            name = f"{tag} {written}"
            path, node = digest(f"{up.path}/{name}"), len(self.nodes)
            self.nodes.append(Node(up.node, tag, name, path, len(self.blocks)))
        fresh = body and up.form
        self._open.append(
            Element(
                tag,
                path,
                node,
                up.article or tag == "article" and not said,
                (up.aside and not fresh) or said or shunned,
                (up.form and not fresh) or (tag == "form" and not up.aside),
                up.header or (tag == "header" and not up.aside),
                up.link or tag == "a",
                (up.tagged and not fresh) or shunned,
                up.nested or up.tag == "article",
                named,
                own,
                self._chars,
            )
        )

    def key(self) -> int:
        """Pages with equal keys are copies of each other as far as templates go."""
        own = [b.text for b in self.blocks if not b.aside and b.links < MENU_LINKS * n_chars(b.text)]
        return digest("\n".join(own))

    def place(self) -> None:
        """Tells elements of one path apart by their place among those alike in their container."""
        alike = Counter((n.up, n.path) for n in self.nodes)
        seen: Counter[tuple[int, int]] = Counter()
        for n in self.nodes[1:]:
            kind = n.up, n.path
            seen[kind] += 1
            of = alike[kind]
            up = self.nodes[n.up]
            if of > 1:
                n.role = digest(f"{up.role}/{n.name} {seen[kind]} of {of}")
            elif up.role != up.path:
                n.role = digest(f"{up.role}/{n.name}")

    def sums(self) -> tuple[list[int], list[int], list[int], list[int]]:
        """Running sums over the blocks: characters, those in links, those of possible main text, digests."""
        sizes = [n_chars(b.text) for b in self.blocks]
        chars = list(accumulate(sizes, initial=0))
        links = list(accumulate([b.links for b in self.blocks], initial=0))
        texts = list(accumulate([digest(b.text) for b in self.blocks], initial=0))
        return chars, links, self.own(sizes), texts

    def own(self, sizes: list[int]) -> list[int]:
        """Running sums of the characters of possible main text, of the blocks' characters."""
        own = [0 if b.aside else n - b.links for b, n in zip(self.blocks, sizes)]
        return list(accumulate(own, initial=0))

    def main(self, template: frozenset[int], menus: frozenset[int], slots: frozenset[int]) -> str:
        """The main text, given the host's template texts, its menus and the elements to go into."""
        self.place()
        inside = self._main_slot(slots)
        if not any(b.article and not b.aside and k in inside for k, b in enumerate(self.blocks)) and any(
            b.article and not b.aside for b in self.blocks
        ):
            inside = set(range(len(self.blocks)))
        listed: set[int] = set()
        done = 0
        for n in self.nodes:
            # Elements are in the order of their starts: one within a menu ends before it.
            if n.end > done and (n.path in menus or n.role in menus):
                listed.update(range(max(n.begin, done), n.end))
                done = n.end
        left = [
            (k, b)
            for k, b in enumerate(self.blocks)
            if k in inside and template.isdisjoint(self.text_tokens(b))
        ]
        within = any(b.article and not b.aside for b in self.blocks)
        for forms in (False, True):
            kept = [
                b.text
                for k, b in left
                if (not b.aside or forms and b.form) and (b.article if within else k not in listed)
            ]
            if kept:
                break
        return "\n\n".join(kept)

    def text_tokens(self, b: Block) -> set[int]:
        """A text's tokens by its container's path without and with places."""
        role = self.nodes[b.node].role
        return {b.token} if role == b.path else {b.token, digest(f"{role} {b.text}")}

    def _main_slot(self, slots: frozenset[int]) -> set[int]:
        """The blocks of the innermost element reached, and of the headings before it."""
        own = self.own([n_chars(b.text) for b in self.blocks])
        children: dict[int, list[int]] = {}
        for k, n in enumerate(self.nodes[1:], 1):
            children.setdefault(n.up, []).append(k)
        at, heads = 0, []
        while self.nodes[at].tag != "article":
            below = [k for k in children.get(at, ()) if self.nodes[k].role in slots]
            if not below:
                break
            into = max(below, key=lambda k: own[self.nodes[k].end] - own[self.nodes[k].begin])
            heads += [k for k in children[at] if k < into and self.nodes[k].tag in HEADINGS]
            at = into
        return {k for j in (at, *heads) for k in range(self.nodes[j].begin, self.nodes[j].end)}


def host_of(url: str | None) -> str | None:
    if url is None:
        return None
    found = HOST.match(url)
    return found[1].rpartition("@")[2].lower() if found else ""


TOKENS = pa.schema(
    [
        ("host", pa.string()),
        ("token", pa.int64()),
        ("parent", pa.int64()),
        ("kind", pa.int8()),
        ("key", pa.int64()),
        ("n", pa.int32()),
        ("text", pa.int64()),
        ("chars", pa.int64()),
        ("links", pa.int64()),
        ("own", pa.int64()),
        ("around", pa.int64()),
    ]
)
#: A page has one token of its own kind, so that its host's pages are counted with the tokens.
TAG, TEXT, PAGE = 0, 1, 2
#: What is decided of a token: text of the template, a menu, an element to go into.
MENU, SLOT = 2, 3


def page_tokens(page: Page) -> list[tuple]:
    """(token, parent, kind, n, text, chars, links, own, around) of every token of a page.

    ``text`` is a digest of all text in an element; ``own`` counts what may be main text in it,
    ``around`` that of its container, for an element that is a container and alone of its kind.
    """
    page.place()
    chars, links, own, texts = page.sums()
    counts: Counter[tuple[int, int, int]] = Counter()
    sums: dict[int, list[int]] = {}
    for n in page.nodes[1:]:
        up = page.nodes[n.up]
        # A container that is one of several of its path counts by its place alone.
        for token, parent in {(n.path, up.path), (n.role, up.role)}:
            counts[token, parent, TAG] += 1
            of = sums.setdefault(token, [0, 0, 0, 0, 0])
            of[0] += texts[n.end] - texts[n.begin]
            of[1] += chars[n.end] - chars[n.begin]
            of[2] += links[n.end] - links[n.begin]
            if token == n.role and n.tag not in PARTS:
                of[3] += own[n.end] - own[n.begin]
                of[4] += own[up.end] - own[up.begin]
    for b in page.blocks:
        # What is set aside anyway needs no template.
        if not b.aside:
            role = page.nodes[b.node].role
            for token in page.text_tokens(b):
                counts[token, b.path if token == b.token else role, TEXT] += 1
    rows = []
    for (token, parent, kind), n in counts.items():
        text, *rest = sums[token] if kind == TAG else (0, 0, 0, 0, 0)
        rows.append((token, parent, kind, n, (text + (1 << 63)) % (1 << 64) - (1 << 63), *rest))
    return rows


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for url, html in zip(*batch.columns):
            page = Page(html.as_py() or "")
            host, key = host_of(url.as_py()), page.key()
            rows.append((host, 0, 0, PAGE, key, 1, 0, 0, 0, 0, 0))
            rows += [(host, t, up, kind, key, *rest) for t, up, kind, *rest in page_tokens(page)]
        columns = zip(*rows) if rows else [[] for _ in TOKENS.names]
        yield pa.RecordBatch.from_pydict(dict(zip(TOKENS.names, columns)), schema=TOKENS)


def templates(pages: DataFrame) -> DataFrame:
    """(host, template, menus, slots): tokens of template text, elements of links alone, and elements to go into."""
    ship(pages.sparkSession)
    rows = pages.select("url", "html").mapInArrow(
        _tokens,
        "host string, token long, parent long, kind byte, key long, n int, text long, chars long, links long, "
        "own long, around long",
    )
    same = ("host", "token", "parent", "kind")
    sums = ("chars", "links", "own", "around")
    tokens = stage(
        rows.groupBy(*same, "key")
        .agg(F.max("n").alias("n"), F.max("text").alias("text"), *[F.max(c).alias(c) for c in sums])
        .groupBy(*same)
        .agg(
            F.count("*").alias("pages"),
            F.bit_xor(F.xxhash64("key", "n")).alias("vector"),
            F.max("n").alias("n"),
            (F.min("text") != F.max("text")).alias("varies"),
            *[F.sum(c).alias(c) for c in sums],
        )
        .where("pages >= 2"),
        "tokens",
    )
    hosts = tokens.where(F.col("kind") == PAGE).select(
        F.col("host").alias("of"), F.least("pages", F.lit(LEAST_PAGES)).alias("least")
    )
    # Nothing is left out for being in an element to go into, so two pages are enough to tell that it differs.
    slots = tokens.where((F.col("kind") == TAG) & (F.col("n") == 1) & F.col("varies") & (F.col("own") > 0)).where(
        F.col("own") >= MAIN_SHARE * F.col("around")
    )
    tokens = tokens.join(hosts, F.col("host").eqNullSafe(F.col("of"))).where("pages >= least").drop("of", "least")
    tags = tokens.where(F.col("kind") == TAG)
    # Container and text are one class when their occurrence vectors are equal.
    text = (
        tokens.where(F.col("kind") == TEXT)
        .alias("t")
        .join(
            tags.alias("c"),
            F.col("t.host").eqNullSafe(F.col("c.host"))
            & (F.col("t.parent") == F.col("c.token"))
            & (F.col("t.vector") == F.col("c.vector")),
            "left_semi",
        )
        .select("host", "token", F.lit(TEXT).alias("kind"))
    )
    menus = tags.where((F.col("chars") > 0) & (F.col("links") >= MENU_LINKS * F.col("chars"))).select(
        "host", "token", F.lit(MENU).alias("kind")
    )
    found = text.union(menus).union(slots.select("host", "token", F.lit(SLOT).alias("kind"))).groupBy("host")
    return found.agg(
        *[
            F.collect_set(F.when(F.col("kind") == kind, F.col("token"))).alias(name)
            for kind, name in ((TEXT, "template"), (MENU, "menus"), (SLOT, "slots"))
        ]
    )


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for html, *known in zip(*batch.columns[2:]):
            texts.append(Page(html.as_py() or "").main(*(frozenset(tokens.as_py() or ()) for tokens in known)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    ship(pages.sparkSession)
    known = stage(templates(pages).withColumnRenamed("host", "of"), "templates")
    size = F.size("template") + F.size("menus") + F.size("slots")
    hosts, tokens = known.agg(F.count("*"), F.sum(size)).first()
    if hosts <= BROADCAST_HOSTS and (tokens or 0) <= BROADCAST_TOKENS:
        known = F.broadcast(known)
    authority = F.regexp_extract("url", HOST.pattern, 1)
    host = F.when(F.col("url").isNull(), F.lit(None)).otherwise(F.lower(F.regexp_replace(authority, "^.*@", "")))
    joined = pages.select(F.col("page_id").cast("long"), "url", "html", host.alias("host")).join(
        known, F.col("host").eqNullSafe(F.col("of")), "left"
    )
    return joined.select("page_id", "url", "html", "template", "menus", "slots").mapInArrow(
        _texts, "page_id long, url string, text string, n_chars long"
    )
