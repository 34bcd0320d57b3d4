"""HTML main text by equivalence-class template deduction.

Tokens of a page are its tags (with class, id and role, under their path of open tags) and
its text nodes.  The occurrence vector of a token over the pages of a host is kept as
mergeable sums: pages, occurrences, and a sum of 64-bit hashes of (page, count) pairs.  Tokens
of one host with equal sums form an equivalence class.  A class is valid when its tokens
stand exactly once on at least half of the host's pages, at least two; valid classes nest
by path into the host's template.  What lies between template tags is its slots, and the template
decides which of them are the main text:

* If ``article`` or ``main`` is a tag of the template, their slots are the content (on a page that
  has text there), and everything beside them is not.
* Else all slots are content, without the template's own text: text nodes of valid classes.  A
  class that holds text of the host's content slot too (the one with most distinct text) is no
  template but what copies of pages share, and stays.
* Slots under navigation, forms, asides, page headers and footers, by element or role, are not
  content.  Names of classes are hints that the sums must confirm: a block that is named as an
  advert, notice, menu or reader comments is left out where it holds less than half of the text of
  the host's pages.

Text inside ``article`` or ``main`` stays even where it is on every page: the article is wanted
whole, and passages that pages share are part of it.  Hosts of one page use the template of all
hosts together.

Pages are read by a scanner that follows the HTML tokenizer where it matters here (quotes mean
something after ``=`` only, ``>`` ends a tag) and looks at each character a bounded number of
times, whatever is left open.

Edge cases: null html is empty and gives an empty text; a null url belongs to the host
``''``; a page of template text only keeps it; a text of any length is read whole; equal counts of
text are decided by the shorter, then the smaller path; repeated rows are pages of their own; an
empty table gives no row; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html as html_entities
import re
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import materialize
from tessella.llm.url_filters import host_of

#: A whole tag of the usual forms; others go through ``_tag_end``.
TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\s+[a-zA-Z][a-zA-Z0-9_:.-]*(?:=(?:"[^"]*"|'[^']*'|[^\s"'=<>`]+))?)*)\s*/?>""")
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
# Elements of HTML.
RAW = frozenset("script style noscript template svg iframe textarea select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
OUTSIDE = frozenset("nav footer aside form head title menu button label".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
CONTENT = frozenset("article main".split())
CLOSED_BY = {"p": ("p",), "li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
# A name says what its last word does ("cookie-notice", not "notice-period"), words of layout aside;
# names count on blocks only.
NAMED_OUTSIDE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adv|banner|sponsor\w*|promo\w*|sidebar|side|menu|nav\w*|breadcrumb\w*|"
    r"footer|notice\w*|cookie\w*|consent|alert|popup|modal|newsletter|subscribe\w*|comment\w*|respond|replies|disqus\w*|"
    r"share|social|related|widget\w*|toolbar|login|pagination|pager)"
    r"(?:[_-](?:area|bar|block|bottom|box|container|content|inner|item|items|left|links|list|outer|right|section|slot|top|unit|wrap|wrapper|\d+))*(?:$|\s)",
    re.I,
)
MASK = (1 << 64) - 1
IN, NAMED, OUT = 0, 1, 2  # of a place: content so far, in a block named as boilerplate, boilerplate by element


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def _tag_end(page: str, at: int) -> int:
    """Where the tag whose name ends at ``at`` ends, behind its ``>``; -1 if it is cut off.  A
    quote opens a value only behind ``=``; one that is never closed does not count."""
    quoted = False  # whether the last character but blanks was "="
    while True:
        m = STOP.search(page, at)
        if m is None:
            return -1
        c = m[0]
        if m.start() > at and not page[at : m.start()].isspace():
            quoted = False
        at = m.end()
        if c == ">":
            return at
        if c == "=":
            quoted = True
            continue
        if quoted and (close := page.find(c, at)) >= 0:
            at = close + 1
        quoted = False


STOP = re.compile("[>=\"']")


def scan(page: str):
    """(begin, end, slash, name, attributes) of every tag, in order; what is not text in between
    (comments, declarations, raw elements) has the name ``''``."""
    at = page.find("<")
    while at >= 0:
        m = TAG.match(page, at)
        if m:
            end, slash, name, rest = m.end(), m[1], m[2], m[3]
        elif page.startswith("<!--", at):
            end = page.find("-->", at + 2) + 3
            slash = name = rest = ""
            if end < 3:
                end = len(page)
        elif page.startswith(("<!", "<?", "</"), at) and not NAME.match(page, at):
            end = page.find(">", at) + 1
            slash = name = rest = ""
            if not end:
                end = len(page)
        elif m := NAME.match(page, at):
            slash, name = "/" if page[at + 1] == "/" else "", m[1]
            end = _tag_end(page, m.end())
            if end < 0:  # the page's end cuts it off
                yield at, len(page), "", "", ""
                return
            rest = page[m.end() : end - 1]
        else:
            at = page.find("<", at + 1)  # a plain character
            continue
        if name and not slash and name.lower() in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, end)
            stop = page.find(">", close.end()) + 1 if close else 0
            yield at, stop or len(page), "", "", name
            end = stop or len(page)
        else:
            yield at, end, slash, name, rest
        at = page.find("<", end)


def kind_of(tag: str, attributes: dict[str, str]) -> int:
    """IN, NAMED or OUT by the element itself; a ``header`` is decided by where it stands."""
    if tag in OUTSIDE or attributes.get("role", "").lower() in ROLES:
        return OUT
    if tag in ("html", "body", "p", *CONTENT) or tag not in BLOCK:
        return IN
    return NAMED if any(NAMED_OUTSIDE.search(attributes.get(k, "")) for k in ("class", "id")) else IN


TAGS: dict[tuple[str, str], tuple[str, bool, str, int]] = {}


def _tag(name: str, rest: str) -> tuple[str, bool, str, int]:
    """(tag, is a block, its path step or "" if it opens none, kind); the last few thousand are
    kept."""
    known = TAGS.get((name, rest))
    if known is None:
        tag = name.lower()
        attributes = _attributes(rest) if "=" in rest else {}
        step = ""
        if tag not in VOID and (tag in BLOCK or tag in OUTSIDE or attributes):
            step = tag + "".join(f".{attributes[k]}" for k in ("class", "id", "role") if k in attributes)
        known = tag, tag in BLOCK, step, kind_of(tag, attributes) if step else IN
        if len(TAGS) > 5000:
            TAGS.clear()
        TAGS[name, rest] = known
    return known


NOWHERE = ((), IN, (), False)


def walk(page: str):
    """Events (kind, place, text) of a page; kind is tag, text or break.

    A place is (path, state, named, in_content).  Its path holds the open containers, each as its
    tag with class, id and role; inline tags without them do not enter it.  ``state`` is IN, NAMED
    or OUT, ``named`` holds the paths of the open blocks that are named as boilerplate, and
    ``in_content`` says that an ``article`` or ``main`` is open."""
    stack: list[tuple[str, tuple]] = []
    open_: dict[str, int] = {}  # how many of a tag are open, so that a stray closing tag costs nothing
    place = NOWHERE
    at = 0

    def pop(k):
        for tag, _ in stack[k:]:
            open_[tag] -= 1
        del stack[k:]
        return stack[-1][1] if stack else NOWHERE

    for begin, end, slash, name, rest in scan(page):
        if begin > at:
            yield "text", place, page[at:begin]
        at = end
        if not name:
            if rest.lower() in ("svg", "iframe", "textarea", "select"):
                yield "break", place, ""
            continue
        tag, block, step, kind = _tag(name, "" if slash else rest)
        if slash:
            if open_.get(tag):
                k = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag)
                place = pop(k)
        elif step and len(stack) < DEEPEST:
            if stack and tag in CLOSED_BY and stack[-1][0] in CLOSED_BY[tag]:
                place = pop(len(stack) - 1)
            path, state, named, inside = place
            if tag == "header" and not inside:
                kind = OUT
            path = (*path, step)
            if kind == NAMED:
                named = (*named, ">".join(path))
            place = path, max(state, kind), named, inside or tag in CONTENT
            stack.append((tag, place))
            open_[tag] = open_.get(tag, 0) + 1
            yield "tag", place, ""
        if block:
            yield "break", place, ""
    if at < len(page):
        yield "text", place, page[at:]


DEEPEST = 256  # containers; tags below this depth belong to the last one, as parsers of HTML do


def clean(text: str) -> str:
    if n := text.count("&"):  # text of plain ampersands needs no table look-up
        text = text.replace("&amp;", "&") if n == text.count("&amp;") else html_entities.unescape(text)
    return " ".join(text.split())


SLOTS: dict[tuple[str, ...], str] = {}


def slot_of(path: tuple[str, ...]) -> str:
    """The content slot that a place belongs to: up to its last ``article`` or ``main``, else
    the containers above paragraphs, lists and tables."""
    slot = SLOTS.get(path)
    if slot is None:
        steps = [x.split(".")[0] for x in path]
        last = max((k for k, x in enumerate(steps) if x in CONTENT), default=-1)
        keep = path[: last + 1] if last >= 0 else [x for x, t in zip(path, steps) if t in ("html", "body", "div", "section", "td", "center")]
        slot = ">".join(keep)
        if len(SLOTS) > 5000:
            SLOTS.clear()
        SLOTS[path] = slot
    return slot


def _hash(*parts: str) -> int:
    return int.from_bytes(blake2b("\x1f".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def tokens_of(page: str) -> dict[tuple[str, str], list[int]]:
    """(path, token) to [occurrences, characters]: tags by path with an empty token, text nodes
    of content slots, hashed, by slot, and the characters of blocks named as boilerplate, by
    path with the token ``named``, or ``inner`` where another such block is around."""
    found: dict[tuple[str, str], list[int]] = {}

    def add(path, token, chars):
        one = found.setdefault((path, token), [0, 0])
        one[0] += 1
        one[1] += chars

    for kind, (path, state, named, _), text in walk(page):
        if kind == "tag":
            add(">".join(path), "", 0)
        elif kind == "text" and state != OUT and (words := text.strip()):
            if state == NAMED:
                for k, block in enumerate(named):
                    add(block, "inner" if k else "named", len(words))
            else:
                add(slot_of(path), f"{_hash(words):016x}", len(words))
    return found


SUMS = ("pages", "occurrences", "low", "high", "chars")
OCCURRENCES = "host string, path string, token string, " + ", ".join(f"{c} long" for c in SUMS)


def occurrences(pages: DataFrame) -> DataFrame:
    """Mergeable occurrence vectors: a row per (host, path, token), added up in each task first."""
    def run(batches):
        sums: dict[tuple[str, str, str], list[int]] = {}

        def rows():
            out = [(*key, *value) for key, value in sums.items()]
            sums.clear()
            kinds = (pa.string(), pa.string(), pa.string(), *(pa.int64() for _ in SUMS))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [f.split()[0] for f in OCCURRENCES.split(", ")])

        for batch in batches:
            for page_id, host, page in zip(*(batch.column(k) for k in range(3))):
                seed = _hash(str(page_id.as_py()))
                text = page.as_py() or ""
                for (path, token), (n, chars) in tokens_of(text).items():
                    value = (seed + n) * 0x9E3779B97F4A7C15 & MASK
                    value ^= value >> 29
                    value = value * 0xBF58476D1CE4E5B9 & MASK
                    s = sums.setdefault((host.as_py(), path, token), [0, 0, 0, 0, 0])
                    for k, x in enumerate((1, n, value & 0xFFFFFFFF, value >> 32, chars)):
                        s[k] += x
                s = sums.setdefault((host.as_py(), "", ""), [0, 0, 0, 0, 0])
                s[0] += 1
                s[1] += 1
                if len(sums) > 200_000:
                    yield rows()
        if sums:
            yield rows()

    return pages.select("page_id", host_of(F.col("url")).alias("host"), "html").mapInArrow(run, OCCURRENCES)


def vectors(pages: DataFrame) -> DataFrame:
    """The occurrence vector of every (host, path, token)."""
    sums = [F.sum(c).alias(c) for c in SUMS]
    return materialize(occurrences(pages).groupBy("host", "path", "token").agg(*sums), "occurrences")


def _is(kind: frozenset) -> object:
    """Whether one of a path's steps is an element of ``kind``."""
    return F.exists(F.split("path", ">"), lambda s: F.split(s, r"\.")[0].isin(*sorted(kind)))


def _often(rows: DataFrame, by_host: DataFrame, share: float) -> DataFrame:
    """Those on at least ``share`` of the host's pages, at least two."""
    sizes = by_host.filter("path = '' and token = ''").select("host", F.col("pages").alias("host_pages"))
    return rows.join(sizes, "host").filter((F.col("pages") >= 2) & (F.col("pages") >= share * F.col("host_pages")))


def templates(by_host: DataFrame, share: float = 0.5) -> DataFrame:
    """(host, path, texts): the template tags of each host, and how many distinct texts lie
    directly in their slots.  Host ``*`` stands for all hosts."""
    sums = [F.sum(c).alias(c) for c in SUMS]
    tags = by_host.filter("token = ''")
    whole = tags.groupBy("path", "token").agg(*sums).withColumn("host", F.lit("*"))
    tags = tags.unionByName(whole)
    text = by_host.filter(F.length("token") == 16).groupBy("host", "path").agg(F.count(F.lit(1)).alias("texts"))
    text = text.unionByName(text.groupBy("path").agg(F.sum("texts").alias("texts")).withColumn("host", F.lit("*")))
    # lists of articles repeat their tag: of all others a template token stands once
    valid = (F.col("occurrences") == F.col("pages")) | _is(CONTENT)
    found = _often(tags.filter("path <> ''"), tags, share).filter(valid)
    return found.join(text, ["host", "path"], "left").select("host", "path", F.coalesce("texts", F.lit(0)).alias("texts"))


def content_slots(by_host: DataFrame, share: float = 0.5) -> DataFrame:
    """(host, slot, article): the template path whose slot holds most distinct text, that of an
    ``article`` or ``main`` first, and whether it is one."""
    rank = F.struct(_is(CONTENT).alias("article"), F.col("texts"), -F.length("path"), F.col("path").alias("path"))
    best = templates(by_host, share).filter(~_is(OUTSIDE)).groupBy("host").agg(F.max(rank).alias("best"))
    return best.select("host", F.col("best.path").alias("slot"), F.col("best.article").alias("article"))


def template_texts(by_host: DataFrame, slots: DataFrame, share: float = 0.5) -> DataFrame:
    """(host, texts): keys of the text nodes that belong to the host's template."""
    once = by_host.filter((F.length("token") == 16) & (F.col("occurrences") == F.col("pages")))
    once = _often(once, by_host, share).join(slots.filter("host <> '*'"), "host", "left")
    content = _is(CONTENT) | F.coalesce(F.startswith(F.concat("path", F.lit(">")), F.concat("slot", F.lit(">"))), F.lit(False))
    key = F.concat("path", F.lit("|"), "token")
    classes = once.groupBy("host", "low", "high").agg(F.max(content).alias("content"), F.collect_list(key).alias("texts"))
    return classes.filter(~F.col("content")).groupBy("host").agg(F.flatten(F.collect_list("texts")).alias("texts"))


def kept_names(by_host: DataFrame, most: float = 0.5) -> DataFrame:
    """(host, kept) of every host with text: the blocks that are named as boilerplate but hold at
    least ``most`` of the host's text, so the name misleads."""
    total = by_host.filter("token <> 'inner'").groupBy("host").agg(F.sum("chars").alias("total")).filter("total > 0")
    named = by_host.filter("token in ('named', 'inner')").select("host", "path", F.col("chars").alias("own"))
    large = F.collect_list(F.when(F.col("own") >= most * F.col("total"), F.col("path")))  # at most 1 / most of them
    return total.join(named, "host", "left").groupBy("host").agg(large.alias("kept"))


def deduced(pages: DataFrame, share: float = 0.5) -> DataFrame:
    """(host, slot, article, texts, kept): what the template of each host says; host ``*`` stands
    for all hosts."""
    by_host = vectors(pages)
    slots = materialize(content_slots(by_host, share), "slots")
    found = slots.join(template_texts(by_host, slots, share), "host", "full").join(kept_names(by_host), "host", "full")
    return materialize(found, "hosts")


def extract(page: str, article: bool = False, template=frozenset(), kept=None, slot: str | None = None) -> str:
    """The blocks of all content of the page, joined by blank lines.  ``article``: content is
    what stands in ``article`` or ``main``, if there is any; ``template``: keys of text nodes that
    are left out elsewhere; ``kept``: paths of blocks that stay in spite of their names, None: all."""
    blocks: list[str] = []
    open_text: list[str] = []
    left_out = False

    def close():
        if block := clean("".join(open_text)):
            blocks.append(block)
        open_text.clear()

    for kind, (path, state, named, inside), text in walk(page):
        if kind == "break":
            close()
        elif kind == "text" and (state == IN or state == NAMED and (kept is None or kept.issuperset(named))):
            if article and not inside:
                left_out = left_out or not text.isspace()
            elif template and not inside and (words := text.strip()) and f"{slot_of(path)}|{_hash(words):016x}" in template and not _under(path, slot):
                left_out = True
            else:
                open_text.append(text)
    close()
    if left_out and not blocks:  # no text in an article, or of the template only
        return extract(page, False, template, kept, slot) if article else extract(page, False, kept=kept)
    return "\n\n".join(blocks)


def _under(path: tuple[str, ...], slot: str | None) -> bool:
    return bool(slot) and f"{'>'.join(path)}>".startswith(f"{slot}>")


def main_text(pages: DataFrame, share: float = 0.5) -> DataFrame:
    """(page_id, url, text): the main text of every page.

    What a template says is one row a host; it is joined by host without a hint, so the planner
    broadcasts it where it is small and splits a hot host where it is not."""
    hosts = deduced(pages, share)
    whole = hosts.filter("host = '*'").first()
    common = bool(whole and whole["article"])

    def run(batches):
        known = {}
        for batch in batches:
            out = []
            for host, slot, article, texts, kept, page in zip(*(batch.column(k) for k in range(2, 8))):
                name = host.as_py()
                if name not in known:
                    if len(known) > 1000:
                        known.clear()
                    mine = article.as_py()
                    known[name] = common if mine is None else mine, frozenset(texts.as_py() or ()), None if kept.as_py() is None else frozenset(kept.as_py()), slot.as_py()
                out.append(extract(page.as_py() or "", *known[name]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of(F.col("url")).alias("host"), "html")
    joined = rows.join(hosts.filter("host <> '*'"), "host", "left").select("page_id", "url", "host", "slot", "article", "texts", "kept", "html")
    return joined.mapInArrow(run, "page_id long, url string, text string")
