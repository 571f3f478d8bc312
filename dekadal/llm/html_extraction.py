"""HTML extraction: site template removal.

One pass hashes the element subtrees of every page; Spark counts, per host, the pages with different bodies that a
subtree occurs on. Subtrees that recur across many pages of their host are its template, and a second pass deletes them.
A subtree is hashed twice: as it stands, and by its form (names, classes and nesting without the words), since menus and
notices change their words from page to page. By form, only what lies outside an article can be template, and of pages
without one, and inside an article, only subtrees whose text is mostly links; inside an article, of these only divisions
with a class, id or role of their own.

What counts cannot tell, on hosts with few pages above all, markup does: elements that hold no article text by their name
(scripts, forms, menus, footers and so on), containers whose class, id or role is the whole name of such a part, adverts by
such a name in any element, lists of comments by their structure, and, where templates leave text outside an article
element, that text. No such name drops the container of an article, main part or first heading, and no size decides.
"""

from __future__ import annotations

import html
import re
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import saved, table, tuned

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'])(class|id|role|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/\"']|$)", re.I)

# Names of HTML elements by role, and of page parts in class, id and role values.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
TEXT_BLOCK = set("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre figcaption td th tr article main body html head".split())
NO_TEXT = set("head form button select option noscript template svg canvas object label input script style textarea title xmp iframe noembed noframes".split())
NO_ARTICLE = set("nav footer aside dialog menu".split())
ADVERTS = set("ad ads advert adverts advertisement advertisements advertising sponsored".split())
#: What tells a comment by its structure: who, when, and a way to answer; each by element or by class.
WHO, WHEN, ANSWER = set("author byline commenter username fn comment-author".split()), set("time date timestamp datetime comment-date comment-time comment-meta".split()), re.compile(r"repl(?:y|ies)|respond|answer", re.I)
HEADINGS = set("h1 h2 h3".split())
PARTS = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie-banner cookie-notice cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs footer comment comments comment-list commentlist comments-list comments-area comment-area comments-section comment-section comment-thread disqus_thread respond replies social share sharing related-posts recommended widget toolbar pagination pager skip-link complementary contentinfo search".split())
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSABLE = {"p", "li", "dd", "dt", "tr", "td", "th", "option"}
SCOPE = {"ul", "ol", "dl", "table", "article", "main", "section", "div", "body", "html", "blockquote", "form", "nav", "aside"}
NO_INTS: frozenset = frozenset()


def digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


class Element:
    """An open element. parts: its content for the hash; form: what its words leave; holds: an article or first heading."""

    __slots__ = ("name", "key", "kind", "first", "parts", "form", "dropped", "part", "outside", "block", "counted", "holds", "titled", "marks", "items", "n_text", "n_link")

    def __init__(self, name: str, key: str, first: int, block: bool, form: list[str] | None):
        self.name, self.key, self.first, self.block = name, key, first, block
        self.parts, self.form = [key], [] if form is None else form
        self.dropped = self.part = self.outside = self.counted = self.holds = self.titled = False
        self.n_text = self.n_link = self.marks = 0
        self.items: dict[str, list[tuple[int, int]]] = {}  # blocks of what looks like a comment inside, by name and class


class Page:
    """One page read once, front to back, in time that grows with its size: how many elements of a name are open is kept,
    so that no end tag searches for what is not there. subtrees: hashes of the elements that could belong to a template;
    deleted: those of them to leave out."""

    def __init__(self, source: str, deleted=NO_INTS):
        self.blocks: list[tuple[int, int, int, str]] = []  # in an article, in main, in a part that holds no article; text
        self.subtrees: set[int] = set()
        self.deleted = deleted
        self.cut: list[tuple[int, int]] = []  # blocks of template subtrees
        self.outer: list[tuple[int, int, int]] = []  # form, blocks: template only where the page has an article
        self.parts: list[tuple[int, int]] = []  # blocks of containers that are parts by their class, id or role
        self.open: list[Element] = []
        self.blocks_open: dict[str, int] = {}
        self.inline_open: list[dict[str, int]] = [{}]  # by open block
        self.closable: list[dict[str, int]] = [{}]  # by open element of SCOPE
        self.dropped = self.articles = self.mains = self.outside = self.links = 0
        self.has_article = False
        self.run: list[str] = []
        at, size = 0, len(source)
        while at < size:
            m = TAG.search(source, at)
            if m is None:
                self.text(source[at:])
                break
            if m.start() > at:
                self.text(source[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name = name.lower()
            if m[1] or m[4]:
                self.end(name)
                continue
            if m[5] and m.end() == size and source[-1] != ">":
                break  # the page ends inside this tag
            self.start(name, m[3] or m[6] or "")
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(source, at)
                self.end(name)
                at = close.start() if close else size
        self.flush()
        while self.open:
            self.close()
        for form, first, stop in self.outer if self.has_article else ():
            self.subtrees.add(form)
            if form in deleted:
                self.cut.append((first, stop))

    def text(self, raw: str) -> None:
        if self.open:
            top = self.open[-1]
            top.parts.append(raw)
            n = len(raw.strip())
            if n:
                top.n_text += n
                top.n_link += n if self.links else 0
                if not top.form or top.form[-1] != "text":
                    top.form.append("text")
        if not self.dropped:
            self.run.append(html.unescape(raw) if "&" in raw else raw)  # a reference does not reach across a tag

    def flush(self) -> None:
        if self.run:
            text = " ".join("".join(self.run).split())
            self.run = []
            if text:
                self.blocks.append((self.articles, self.mains, self.outside, text))

    def start(self, name: str, attributes: str) -> None:
        if name == "br":
            if not self.dropped:
                self.run.append(" ")
            return
        block = name in BLOCK
        if block:
            self.flush()
            if name not in ("html", "body"):
                self.imply(name)
        if name in VOID:
            return
        key, kind, words = name, name, set()
        if attributes:
            for a, x, y, z in ATTRIBUTE.findall(attributes):
                value = (x or y or z).lower()
                key += f" {a.lower()}={value}"
                kind += f".{' '.join(value.split()[:1])}" if a.lower() == "class" else ""
                words.update(["hidden"] if a.lower() == "hidden" else value.split())
        e = Element(name, key, len(self.blocks), block, None if block or not self.open else self.open[-1].form)
        e.kind = kind
        advert = (not block or name in ("p", "li", "dd", "dt", "figcaption")) and not words.isdisjoint(ADVERTS)
        e.dropped = name in NO_TEXT or "hidden" in words or advert
        who, when = name in ("cite", "address") or not words.isdisjoint(WHO), name == "time" or not words.isdisjoint(WHEN)
        e.marks = who + 2 * when + 4 * (name in ("a", "button") and ANSWER.search(attributes) is not None)
        e.titled = name in HEADINGS
        comment = name == "article" and not words.isdisjoint(PARTS)
        e.outside = name in NO_ARTICLE or comment or (name == "header" and not self.articles)
        e.part = block and name not in TEXT_BLOCK and not words.isdisjoint(PARTS)
        e.counted = block and name not in ("html", "body", "head") and not (self.articles and name in TEXT_BLOCK)
        e.holds = name in ("article", "main", "h1")
        self.open.append(e)
        self.dropped += e.dropped
        self.outside += e.outside
        if name == "a":
            self.links += 1
            if e.form[-1:] != ["a"] and e.form[-2:] != ["a", "text"]:  # any number of links is one form
                e.form.append("a")
        if block:
            self.blocks_open[name] = self.blocks_open.get(name, 0) + 1
            self.inline_open.append({})
        else:
            self.inline_open[-1][name] = self.inline_open[-1].get(name, 0) + 1
        if name in CLOSABLE:
            self.closable[-1][name] = self.closable[-1].get(name, 0) + 1
        if name in SCOPE:
            self.closable.append({})
        self.articles += name == "article" and not comment
        self.mains += name == "main"

    def imply(self, name: str) -> None:
        """Close what a block's start tag closes: an open paragraph, and items or cells of the same list or row."""
        shut = CLOSES.get(name, ())
        inside = self.closable[-1]
        while any(inside.get(n) for n in ("p", *shut)):
            closed = ""
            while closed != "p" and closed not in shut:
                closed = self.open[-1].name
                self.close()
            if closed in shut:
                return

    def end(self, name: str) -> None:
        if name in BLOCK:
            self.flush()
            there = self.blocks_open.get(name)
        else:
            there = self.inline_open[-1].get(name)  # inline end tags reach no further than their block
        while there:
            closed = self.open[-1].name
            self.close()
            if closed == name:
                return

    def close(self) -> None:
        e = self.open.pop()
        name = e.name
        if e.block:
            self.blocks_open[name] -= 1
            self.inline_open.pop()
        else:
            self.inline_open[-1][name] -= 1
        if name in SCOPE:
            self.closable.pop()
        if name in CLOSABLE:
            self.closable[-1][name] -= 1
        if e.block:
            self.flush()
        self.links -= name == "a"
        self.dropped -= e.dropped
        self.outside -= e.outside
        if name == "article" and not (e.outside and name not in NO_ARTICLE):
            self.articles -= 1
            self.has_article |= len(self.blocks) > e.first
        self.mains -= name == "main"
        self.has_article |= name == "main" and len(self.blocks) > e.first
        for spans in e.items.values():
            if len(spans) > 1:  # several alike beside each other: a list of comments
                self.parts += spans
        whole = " ".join("\x00".join(e.parts).split())
        h = digest(whole)
        up = self.open[-1] if self.open else None
        form = 0
        if e.block:
            form = digest(f"form\x00{e.key}{{{','.join(e.form)}}}")
        if up:
            up.parts.append(f"<{h}>")
            up.n_text += e.n_text
            up.n_link += e.n_link
            up.holds |= e.holds
            up.titled |= e.titled
            up.marks |= e.marks
            if e.block and e.marks == 7 and not e.titled and not e.holds:
                up.items.setdefault(e.kind, []).append((e.first, len(self.blocks)))
            if e.block and (not up.form or up.form[-1] != str(form)):
                up.form.append(str(form))
        if e.counted and e.n_text:
            span = (e.first, len(self.blocks))
            self.subtrees.add(h)
            if h in self.deleted:
                self.cut.append(span)
            inside = self.articles or self.mains
            if not e.holds and (not inside or (name in ("div", "section") and e.key != name)):
                if 2 * e.n_link >= e.n_text:
                    self.subtrees.add(form)
                    if form in self.deleted:
                        self.cut.append(span)
                elif not inside:
                    self.outer.append((form, *span))
            if e.part and not e.holds:
                self.parts.append(span)

    def main_text(self) -> tuple[str, int, int]:
        """The main text, how many blocks of the page its host's templates took away, and how many markup alone."""
        template, part = self.covered(self.cut), self.covered(self.parts)
        left = [b for b, t, p in zip(self.blocks, template, part, strict=True) if not (t or p or b[2])]
        own = next((o for o in ([b for b in left if b[k]] for k in (0, 1)) if o), left)
        return "\n".join(b[3] for b in own), sum(template), len(self.blocks) - sum(template) - len(own)

    def covered(self, spans: list[tuple[int, int]]) -> list[bool]:
        """Of each block, whether a span holds it."""
        step = [0] * (len(self.blocks) + 1)
        for a, b in spans:
            step[a] += 1
            step[b] -= 1
        return [n > 0 for n in accumulate(step)][:-1]


def host(url: str) -> Column:
    """The host of a URL in lower case; empty for a null or odd one."""
    return F.coalesce(F.regexp_extract(F.lower(F.col(url)), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit(""))


def site_templates(
    pages: DataFrame, min_pages: int = 4, min_share: float = 0.01, many: int = 1000, url: str = "url", source: str = "html",
) -> DataFrame:
    """(host, subtrees): hashes of the subtrees on at least min_pages pages, and on min_share of the pages or on many pages,
    of the host.

    Pages of one host with the same text count once, so copies of a page make no template; a host with fewer than
    min_pages different texts has none. A host has at most 1 / min_share times as many template subtrees as its mean page
    has subtrees, or 1 / many of its pages' subtrees if that is more. Hot hosts: the counts combine before the shuffle, which deals by
    (host, subtree, body). Null html is an empty page, which has no subtrees; a null url is a host of its own; repeated
    rows are copies; an empty table gives none; other columns are not read. A page is parsed whole.
    """
    rows = pages.select(host(url).alias("host"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("html"))

    def run(batches):
        for batch in batches:
            hosts, out_host, out_body, out_tree = batch.column(0).to_pylist(), [], [], []
            for h, text in zip(hosts, batch.column(1), strict=True):
                page = Page(text.as_py())
                body = digest(page.main_text()[0])
                trees = [*page.subtrees, None]
                out_host += [h] * len(trees)
                out_body += [body] * len(trees)
                out_tree += trees
            columns = [pa.array(out_host, pa.string()), pa.array(out_body, pa.int64()), pa.array(out_tree, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "body", "subtree"])

    seen = rows.mapInArrow(run, "host string, body long, subtree long").distinct()
    counts = seen.groupBy("host", "subtree").agg(F.count("*").alias("n_pages"))
    counts = saved(counts.where(F.col("subtree").isNull() | (F.col("n_pages") >= min_pages)), "template-counts")
    total = counts.where("subtree is null").select("host", F.col("n_pages").alias("total"))
    often = counts.where("subtree is not null").join(total, "host").where(F.col("n_pages") >= F.least(F.col("total") * min_share, F.lit(many)))
    return often.groupBy("host").agg(F.collect_list("subtree").alias("subtrees"))


def extract_main_text(
    pages: DataFrame, id_col: str = "page_id", url: str = "url", source: str = "html",
    templates: DataFrame | None = None, **template,
) -> DataFrame:
    """(id, url, text, n_chars, n_template_blocks, n_markup_blocks) per page; the last ones count the blocks that its host's
    templates took away, whether or not markup would have left them out too, and those that markup alone left out.

    templates: those of an earlier run; else they are counted over these pages. Null html is empty text, a null url a
    host of its own, a null id passes through; repeated rows stay; an empty table gives none; other columns are not read.
    A very long page is read whole, in time that grows with its size and memory of some ten times it. The templates of a
    host are joined by host: a broadcast while their table is below Spark's threshold, else a sort-merge join whose hot
    hosts the adaptive skew join splits.
    """
    if templates is None:
        templates = saved(site_templates(pages, url=url, source=source, **template), "templates")
    rows = pages.select(F.col(f"`{id_col}`"), F.col(f"`{url}`"), host(url).alias("__host"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("__html"))
    joined = rows.join(templates.withColumnsRenamed({"host": "__host", "subtrees": "__subtrees"}), "__host", "left").select(id_col, url, "__html", "__subtrees")
    kinds = dict(rows.dtypes)

    def run(batches):
        known: dict = {}
        for batch in batches:
            made = []
            for h, t in zip(batch.column(2), batch.column(3), strict=True):
                values = t.values.to_numpy() if t.is_valid else None
                key = values.tobytes() if values is not None else b""
                if key not in known:  # pages of one host share its templates
                    known = {key: frozenset(values.tolist()) if values is not None else NO_INTS}
                made.append(Page(h.as_py(), known[key]).main_text())
            texts = [m[0] for m in made]
            counts = [pa.array([len(t) for t in texts], pa.int64()), *[pa.array([m[k] for m in made], pa.int64()) for k in (1, 2)]]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), *counts]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, url, "text", "n_chars", "n_template_blocks", "n_markup_blocks"])

    return joined.mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url}` {kinds[url]}, text string, n_chars long, n_template_blocks long, n_markup_blocks long")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(tuned(spark), sf_dir, "pages"))
