"""Main texts of web pages by wrapper induction: union-free regular expressions over the block structure of a host's pages.

A page's token stream is read into nested blocks; markup inside a block (bold, links, line breaks) is part of its text. Streams are aligned
with each other: equal tokens match, text against other text becomes a slot, neighbours of one kind (one block or a run of several)
become a repeated group, and what only one side has becomes optional. The result, a wrapper, is aligned with the next page in turn.

Every page of a host takes part. A task aligns the pages it reads into one wrapper per host; the wrappers of a host are aligned with each
other in two steps, first by task number, so that a host with a third of all pages is not gathered in one task. A wrapper is as long as
the host's layouts are varied, not as its pages are many: it holds counts and hashes, never texts.

A wrapper tells the slots of the main text: below an article (or the block that holds most of the text), outside of everything that is
navigation, advertising, notice, form or comment by its element, class or role, and not the same words on every page.
"""

from __future__ import annotations

import html as markup
import json
import re
import sys
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatwise.llm.common import batches_of

# The elements of HTML by how they lay out text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike "
                   "strong sub sup time tt u var wbr".split())
VOID = frozenset("area base col embed hr input link meta param source track".split())
UNSEEN = frozenset("script style noscript template iframe svg math object canvas audio video head title select textarea button".split())
ASIDE = frozenset("nav footer aside form menu dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
                   "main menu nav ol p pre section table ul".split())
#: An element of this kind ends an open one of these kinds, inside the nearest of the last kinds.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "option": ({"option"}, {"select"})}
#: Words in a class, id or role that say a block is not the article's text.
NOT_TEXT = frozenset("ad ads advert advertisement adverts advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb "
                     "breadcrumbs sidebar rail footer header masthead cookie cookies consent gdpr notice notices notification alert popup modal "
                     "overlay comment comments reply replies disqus discussion share sharing social related recommended recommendations trending newsletter "
                     "subscribe subscription signup login form search widget toolbar pagination pager tags skip contentinfo complementary "
                     "hidden meta byline".split())
#: Words that may stand beside them in a name without changing what it says; any other word does ("share-price", "has-sidebar").
BESIDE = frozenset("area article articles author bar block bottom box button buttons col column container content count desktop entry field fields fixed floating "
                   "global group icon icons inner item items link links list main mobile module outer page post posts primary row secondary section "
                   "single site sticky story text title toggle top wrap wrapper".split())

NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
#: What ends a tag, or begins a quoted value inside of it.
STOP = re.compile(r">|=\s*[\"']")
#: Elements whose content is no markup, each with its end.
RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in "script style noscript template textarea iframe svg title select".split()}
#: Elements nested deeper stand beside each other, as in browsers.
DEEPEST = 512
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)


def tag_end(page: str, at: int, dead: set[int]) -> int:
    """Where the tag ends whose attributes start at ``at``, or -1. A '>' inside a quoted value ends nothing. ``dead`` holds the quotes from
    which no end was found before, so that broken markup is not gone through again and again."""
    seen = []
    while stop := STOP.search(page, at):
        if stop[0] == ">":
            return stop.end()
        if stop.start() in dead:
            break
        seen.append(stop.start())
        closing = page.find(stop[0][-1], stop.end())
        at = closing + 1 if closing >= 0 else stop.end()
    dead.update(seen)
    return -1


def tokens(page: str) -> Iterator[tuple[int, int, bool, str | None, str]]:
    """Start, end, whether it closes, name and attributes of every tag in page order. Comments, declarations and elements without
    markup have no name. A tag with an unclosed quoted value ends at the next '>'; without any '>' the rest is text."""
    at, dead = 0, set()
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            yield start, at, False, None, ""
            continue
        if page[start + 1:start + 2] in ("!", "?"):
            end = page.find(">", start)
            if end < 0:
                return
            at = end + 1
            yield start, at, False, None, ""
            continue
        closes = page.startswith("</", start)
        name = NAME.match(page, start + 1 + closes)
        if not name:
            at = start + 1
            continue
        end = tag_end(page, name.end(), dead)
        if end < 0:
            end = page.find(">", name.end()) + 1
            if not end:
                return
        at, tag = end, name[0].lower()
        if not closes and tag in RAW:
            close = RAW[tag].search(page, end)
            at = close.end() if close else len(page)
            yield start, at, False, None, ""
        else:
            yield start, at, closes, tag, page[name.end():end - 1]


def kind_of(tag: str, attributes: str) -> str:
    """A block's token: its tag, and what the names in its class, id and role have in common with NOT_TEXT. A name counts as a whole."""
    words = set()
    if attributes:
        for name, value in ATTRIBUTE.findall(attributes):
            value = value.strip("\"'")
            if name.lower() == "hidden" or (name.lower() == "aria-hidden" and value.lower() == "true"):
                words.add("hidden")
            else:
                for one in re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().replace("_", "-").split():
                    parts = {part for part in one.split("-") if part and not part.isdigit()}
                    if parts <= NOT_TEXT | BESIDE:
                        words |= parts & NOT_TEXT
    return ".".join([tag, *sorted(words)])


def blocks(page: str) -> Iterator[tuple[tuple[str, ...], str]]:
    """The path of kinds and the text of every block of a page, in page order; blank ones are left out."""
    path: list[str] = []
    parts: list[str] = []

    def text() -> str:
        found = " ".join(markup.unescape("".join(parts)).split())
        parts.clear()
        return found

    def close_to(tags: set[str], inside: set[str]) -> None:
        for i in range(len(path) - 1, -1, -1):
            tag = path[i].partition(".")[0]
            if tag in inside:
                return
            if tag in tags:
                del path[i:]
                return

    at = beyond = 0
    for start, end, closes, tag, attributes in tokens(page):
        if start > at:
            parts.append(page[at:start])
        at = end
        if tag is None:
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            continue
        if found := text():
            yield tuple(path), found
        if closes:
            if beyond:
                beyond -= 1
                continue
            for i in range(len(path) - 1, -1, -1):
                if path[i].partition(".")[0] == tag:
                    del path[i:]
                    break
        elif tag not in VOID:
            if tag in ENDS_P:
                close_to({"p"}, {"article", "section", "div", "body", "td", "li", "blockquote"})
            if tag in ENDS:
                close_to(*ENDS[tag])
            if not attributes.rstrip().endswith("/"):
                if len(path) < DEEPEST:
                    path.append(kind_of(tag, attributes))
                else:
                    beyond += 1
    parts.append(page[at:])
    if found := text():
        yield tuple(path), found


#: Words outside an article that never change over so many different pages are part of the layout.
CONSTANT_FROM = 8

# A wrapper item is [kind, optional, repeated, pages, characters, hash of the constant text or None, items inside]; "#" is a text slot. Its
# pages are the least CONSTANT_FROM hashes of the contents of the pages that have it, so copies of a page count once.
KIND, OPTIONAL, REPEATED, PAGES, CHARS, CONSTANT, INSIDE = range(7)


def different(a: list[int], b: list[int]) -> list[int]:
    return a if a == b else sorted({*a, *b})[:CONSTANT_FROM]


def join(a: list, b: list) -> list:
    """One item for two matching ones. Different texts make a slot."""
    return [a[KIND], a[OPTIONAL] or b[OPTIONAL], a[REPEATED] or b[REPEATED], different(a[PAGES], b[PAGES]), a[CHARS] + b[CHARS],
            a[CONSTANT] if a[CONSTANT] == b[CONSTANT] else None, align(a[INSIDE], b[INSIDE])]


def repeated(a: list, b: list) -> list:
    """One item for two occurrences on the same pages."""
    found = join(a, b)
    found[REPEATED] = True
    return found


def fold(items: list[list], longest: int = 3) -> list[list]:
    """Neighbouring runs of up to ``longest`` items that repeat become one repeated group."""
    out: list[list] = []
    for item in items:
        out.append(item)
        shorter = True
        while shorter:
            shorter = False
            for size in range(1, longest + 1):
                if len(out) >= 2 * size and [x[KIND] for x in out[-size:]] == [x[KIND] for x in out[-2 * size:-size]]:
                    out[-2 * size:] = [repeated(x, y) for x, y in zip(out[-2 * size:-size], out[-size:], strict=True)]
                    shorter = True
                    break
    return out


def align(a: list[list], b: list[list]) -> list[list]:
    """Aligns two item lists by their longest common sequence of kinds; what only one side has becomes optional."""
    if [x[KIND] for x in a] == [x[KIND] for x in b]:
        return [join(x, y) for x, y in zip(a, b, strict=True)]
    head = 0
    while head < min(len(a), len(b)) and a[head][KIND] == b[head][KIND]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail][KIND] == b[-1 - tail][KIND]:
        tail += 1
    first = [join(x, y) for x, y in zip(a[:head], b[:head], strict=True)]
    last = [join(x, y) for x, y in zip(a[len(a) - tail:], b[len(b) - tail:], strict=True)]
    a, b = a[head:len(a) - tail], b[head:len(b) - tail]
    length = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            length[i][j] = length[i + 1][j + 1] + 1 if a[i][KIND] == b[j][KIND] else max(length[i + 1][j], length[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i][KIND] == b[j][KIND]:
            out.append(join(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j >= len(b) or (i < len(a) and length[i + 1][j] >= length[i][j + 1]):
            out.append([*a[i][:OPTIONAL], True, *a[i][REPEATED:]])
            i += 1
        else:
            out.append([*b[j][:OPTIONAL], True, *b[j][REPEATED:]])
            j += 1
    return fold(first + out + last)


def wrapper_of(found: list[tuple[tuple[str, ...], str]]) -> list[list]:
    """The wrapper of one page."""
    root: list[list] = []
    open_path: list[tuple[str, list]] = []
    previous: tuple[str, ...] = ()
    page = zlib.crc32(repr(found).encode("utf-8", "replace"))
    for path, text in found:
        shared = 0
        while shared < min(len(path), len(previous), len(open_path)) and path[shared] == previous[shared]:
            shared += 1
        if shared == len(path) == len(previous) and shared and path[-1].partition(".")[0] in ("p", "li", *HEADINGS):
            shared -= 1  # the next block of the same kind
        del open_path[shared:]
        for kind in path[shared:]:
            item = [kind, False, False, [], 0, None, []]
            (open_path[-1][1] if open_path else root).append(item)
            open_path.append((kind, item[INSIDE]))
        (open_path[-1][1] if open_path else root).append(["#", False, False, [page], len(text), zlib.crc32(text.encode("utf-8", "replace")), []])
        previous = path
    return settle(root)


def settle(items: list[list]) -> list[list]:
    for item in items:
        item[INSIDE] = settle(item[INSIDE])
    return fold(items)


def slots(items: list[list]) -> Iterator[tuple[tuple[str, ...], list]]:
    """Every text slot of a wrapper with its path, in page order."""
    left = [((), item) for item in reversed(items)]
    while left:
        path, item = left.pop()
        if item[KIND] == "#":
            yield path, item
        else:
            left += [((*path, item[KIND]), inner) for inner in reversed(item[INSIDE])]


def article_at(path: tuple[str, ...]) -> int:
    """Where the outermost article or main element of a path is, or -1."""
    return next((i for i, kind in enumerate(path) if kind.partition(".")[0] in ("article", "main")), -1)


def is_text(path: tuple[str, ...]) -> bool:
    """Whether nothing around a slot says that it is not the article's text. Headings stay, also in an article's header."""
    tags = [kind.partition(".")[0] for kind in path]
    article = max((i for i, tag in enumerate(tags) if tag in ("article", "main")), default=-1)
    for i, kind in enumerate(path):
        tag, _, words = kind.partition(".")
        if tag in UNSEEN or tag in ASIDE:
            return False
        if tag == "header" and not (i > article >= 0 and tags[-1] in HEADINGS):
            return False
        if words and tag not in ("html", "body", "article", "main") and not (tag in HEADINGS and words == "header"):
            return False
        if tag in ("article", "main") and {"comment", "comments", "reply", "related", "sidebar", "hidden"} & set(words.split(".")):
            return False
    return True


def main_paths(wrapper: list[list]) -> list[str]:
    """The paths of the slots that hold the main text."""
    every = list(slots(wrapper))
    kept = [(path, item) for path, item in every if is_text(path)]
    inside = [(path, item) for path, item in kept if article_at(path) >= 0]
    if not sum(item[CHARS] for _, item in inside):  # what is around an article says nothing if that leaves none
        inside = [(path, item) for path, item in every if article_at(path) >= 0 and is_text(path[article_at(path):])]
    if not sum(item[CHARS] for _, item in inside):
        inside = [(path, item) for path, item in kept if item[CONSTANT] is None or len(item[PAGES]) < CONSTANT_FROM or item[REPEATED]]
    return sorted({"/".join(path) for path, _ in inside})


def main_text(found: list[tuple[tuple[str, ...], str]], paths: set[str]) -> str:
    """A page's main text by its host's paths; a page that has none of them is read by its own wrapper."""
    if not any("/".join(path) in paths for path, _ in found):
        paths = set(main_paths(wrapper_of(found)))
    return "\n\n".join(text for path, text in found if "/".join(path) in paths)


def host(url: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url).cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def deep_enough() -> None:
    """Aligning goes down as deep as blocks are nested, a few calls each."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * DEEPEST))


def wrappers(pages: DataFrame, url: str = "url", page: str = "html", steps: int = 32) -> DataFrame:
    """host and its wrapper (as JSON), induced from all of its pages."""

    def induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deep_enough()
        own: dict[str, list] = {}

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array([json.dumps(w) for w in own.values()], pa.string())],
                                               ["host", "wrapper"])
            own.clear()
            return batch

        for whole in batches:
            for batch in batches_of(whole, "html"):
                for name, value in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                    made = wrapper_of(list(blocks(value or "")))
                    own[name] = align(own[name], made) if name in own else made
                    if len(own) > 10_000:  # bounded memory: what is known so far goes out and meets the rest later
                        yield flush()
        yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deep_enough()
        held: tuple[str, list] | None = None
        for batch in batches:
            out = []
            for name, text in zip(batch.column("host").to_pylist(), batch.column("wrapper").to_pylist(), strict=True):
                if held and held[0] == name:
                    held = (name, align(held[1], json.loads(text)))
                else:
                    if held:
                        out.append(held)
                    held = (name, json.loads(text))
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in out], pa.string()), pa.array([json.dumps(w) for _, w in out], pa.string())],
                                             ["host", "wrapper"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([json.dumps(held[1])])], ["host", "wrapper"])

    schema = "host string, wrapper string"
    rows = pages.select(host(url).alias("host"), F.col(page).cast("string").alias("html"))
    parts = rows.mapInArrow(induce, schema)
    first = parts.withColumn("step", F.pmod(F.xxhash64("wrapper"), F.lit(steps)))
    first = first.repartition("host", "step").sortWithinPartitions("host", "step", "wrapper").select("host", "wrapper").mapInArrow(meet, schema)
    return first.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(meet, schema)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row: the blocks of the main text, white space made one blank, joined by an empty line.

    A null or empty page, and one without main text, has the empty text. Rows without a readable host share the host ''. Repeated rows
    and null ids come back as they are. Pages are read whole, however long, and unclosed elements end where HTML ends them. An empty
    table gives no rows. Other columns are ignored.
    """

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deep_enough()
        for batch in batches:
            paths = [main_paths(json.loads(w)) for w in batch.column("wrapper").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(paths, pa.list_(pa.string()))], ["host", "paths"])

    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).cast("string").alias("html"), host(url).alias("host"))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    decided = wrappers(pages, url, page).mapInArrow(decide, "host string, paths array<string>")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deep_enough()
        for whole in batches:
            for batch in batches_of(whole, "html"):
                texts = [main_text(list(blocks(value or "")), set(paths or ())) for value, paths in
                         zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                                                  pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    met = rows.join(decided, "host", "left").select("page_id", "url", "html", "paths")
    return met.mapInArrow(read, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
