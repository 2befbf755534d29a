"""Main text of web pages by a path that the pages of a host agree on.

1. Each page is read into its containers. A container earns the length of the text blocks in it, less what is in links, and a
   part of what the containers in it earn. Boilerplate (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
   comments) earns nothing.
2. A container's path is generalised: tags and classes from the body down, digits as ``#``, ids left out. Each page votes for
   the paths of its best containers; votes are added up per host. For a container in a ``main`` or ``article`` the nearest of these
   stands, and for one with unlinked text beside it that is in no other container (a title, an introduction) the one round both.
3. Each page is read again with the winning path of its host: all containers on that path that are not in one another give
   the text, without the boilerplate in them. A page that has no such container falls back to its own best one.

A word of a class or id marks boilerplate when the whole name says so (``cookie-notice``, ``sidebar-left``), never with a word like
``has`` or ``no`` beside it. A mark does not count round the page's ``main``, nor round its largest ``article`` when every one is
marked, nor when most of the page's unlinked text has it: names with other words in them (``search-page``) then mark nothing at all,
whole ones nothing on pages without an unmarked ``main`` or ``article``. Only comments may be longer than the text.

In the text character references are decoded, white space in a block becomes one space, blocks are trimmed
and joined by a line feed, empty ones left out. ``br`` is white space. Nothing is cut off.

Rows: null or empty html, and pages without text outside boilerplate, give an empty text. Pages without a host vote together.
Unclosed tags are closed by what follows or by the end. Ties between paths go to the first by name. Repeated rows vote and are
answered each time. Only ``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from almoner.llm.common import map_batches, slices, staged
from almoner.operators.lookup import fits_broadcast

# Elements of HTML by what they do here.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe textarea xmp noembed noframes".split())
SKIPPED = RAW | set(
    "head title nav header footer aside form button select option menu menuitem dialog svg canvas object audio video map".split()
)
CONTAINERS = set("body main article section div td center blockquote".split())
BLOCKS = CONTAINERS | set(
    "html p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr th pre figure figcaption hr"
    " address details summary fieldset legend hgroup search".split()
)
# Text before and after these does not run together. The other skipped elements stand within a line.
SEPARATE = BLOCKS | set("head title nav header footer aside form menu dialog".split())
# An opening tag ends open ones of these names, up to the nearest of the others.
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
# Words in a class, id or role that mark boilerplate.
BOILERPLATE = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice"
    " notices alert popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu breadcrumb"
    " breadcrumbs sidebar sidenav aside footer header masthead topbar comment comments commentlist respond reply replies discussion"
    " disqus share sharing social related recommended widget pagination pager complementary contentinfo search hidden".split()
)
CONTENT = set("article content post entry story main body text".split())
# They do not change what a name says; those of NEGATING do.
NEUTRAL = CONTENT | set(
    "area bar block bottom box button buttons col column container first form group heading holder icon inner item items last left"
    " link links list outer panel posts primary region right row secondary section site slot title top unit wrap wrapper".split()
)
NEGATING = set("has no non not with without print xs sm md lg xl".split())
DISCUSSION = set("comment comments commentlist respond reply replies discussion disqus".split())
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+'|["'])*+)>|<!--.*?(?:-->|\Z)|<[!?][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""(?i)\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
PASSED_ON = 0.8
ALSO_VOTED = 0.5


def mark(names: list[str]) -> tuple[bool, set[str]] | None:
    """Whether a whole name marks boilerplate, and the words that do; nothing if none does."""
    whole: set[str] = set()
    partly: set[str] = set()
    for name in names:
        words = set(re.findall("[a-z]+", name))
        if words & BOILERPLATE and not words & NEGATING:
            (whole if words <= BOILERPLATE | NEUTRAL else partly).update(words & BOILERPLATE)
    return (True, whole) if whole else (False, partly) if partly else None


class Page:
    """The containers and text blocks of a page."""

    def __init__(self, html: str):
        self._wide: set[int] = set()  # marked elements of a line that hold blocks
        self._start()
        self._read(html)
        if self._wide:
            self._start()
            self._read(html)
        self._marked()
        self.scores = self._scored()
        if not self.scores and self._lines - self._wide:  # the page may be in one of them
            self._wide |= self._lines
            self._start()
            self._read(html)
            self._marked()
            self.scores = self._scored()

    def _start(self) -> None:
        self.tags, self.parents, self.steps, self.skipped = ["html"], [-1], [""], [False]
        self.checks = [0]  # of each path, which is written out for few nodes only
        self.plus = [1.0]
        self.blocks: list[tuple[int, str, int]] = []  # node, text, characters in links
        self.marks: dict[int, tuple[bool, set[str]]] = {}  # whether a whole name says so, and the words
        self._lines: set[int] = set()  # marked elements within a line
        self._pieces: list[str] = []
        self._linked = 0
        self._links = 0
        self._muted: int | None = None  # the open element within a line that is left out

    def _read(self, html: str) -> None:
        stack, at = [0], 0
        while match := TAG.search(html, at):
            self._text(html[at : match.start()])
            at = match.end()
            name = (match[2] or "").lower()
            if not name:
                continue
            if match[1]:
                if name == "br":
                    self._text(" ")
                elif name not in VOID:
                    self._close(stack, name)
                continue
            if name in VOID:
                if name == "br":
                    self._text(" ")
                elif name == "hr":
                    self._flush(stack[-1])
                continue
            if name in SEPARATE:
                self._implied(stack, name)
                self._flush(stack[-1])
                if self._lines:
                    self._wide.update(self._lines.intersection(stack))
            elif len(self.tags) in self._wide:
                self._flush(stack[-1])
            self._open(stack, name, match[3])
            if name in RAW:
                end = re.compile(f"</{name}(?=[\\s/>])", re.I).search(html, at)
                at = end.start() if end else len(html)
        self._text(html[at:])
        self._flush(0)

    def _implied(self, stack: list[int], name: str) -> None:
        ended, limit = CLOSES.get(name, ({"p"}, CONTAINERS | {"td", "th", "li", "table"}))
        for place in range(len(stack) - 1, 0, -1):
            tag = self.tags[stack[place]]
            if tag in ended:
                self._flush(stack[-1])
                self._pop(stack, place)
                if tag == name or name not in CLOSES:
                    return
            elif tag in limit:
                return

    def _open(self, stack: list[int], name: str, attributes: str) -> None:
        parent = stack[-1]
        given = {}
        if attributes and "=" in attributes or "hidden" in attributes:
            for key, value in ATTRIBUTE.findall(attributes):
                given.setdefault(key.lower(), value.strip("\"'"))
        classes = given.get("class", "").lower().split()
        words = set(re.findall("[a-z]+", " ".join([*classes, given.get("id", "").lower()])))
        hidden = "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "")
        role = given.get("role", "").lower()
        found = words & BOILERPLATE and name not in ("html", "body", "main", "article") and mark([*classes, given.get("id", "").lower()])
        roles = ("navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "form")
        skipped = self.skipped[parent] or name in SKIPPED or hidden or role in roles
        node = len(self.tags)
        if found and not skipped:
            self.marks[node] = found
            if name not in SEPARATE and node not in self._wide:
                self._lines.add(node)
                if self._muted is None:
                    self._muted = node
        self.tags.append(name)
        self.parents.append(parent)
        step = ".".join([name, *sorted(re.sub(r"\d+", "#", c) for c in set(classes))])
        step = "" if name in ("html", "body") else f"/{step}"
        self.steps.append(step)
        self.checks.append(crc32(step.encode(), self.checks[parent]))
        self.skipped.append(skipped)
        self.plus.append((1.5 if name in ("article", "main") else 1.0) * (1.25 if words & CONTENT else 1.0))
        if skipped and not self.skipped[parent] and name not in SEPARATE and self._muted is None:
            self._muted = node
        stack.append(node)
        self._links += name == "a"

    def _close(self, stack: list[int], name: str) -> None:
        for place in range(len(stack) - 1, 0, -1):
            tag = self.tags[stack[place]]
            if tag == name:
                if name in SEPARATE or self._wide and self._wide.intersection(stack[place:]):
                    self._flush(stack[-1])
                self._pop(stack, place)
                return
            if tag in CONTAINERS and name not in BLOCKS:
                return

    def _pop(self, stack: list[int], place: int) -> None:
        self._links -= sum(self.tags[n] == "a" for n in stack[place:])
        if self._muted in stack[place:]:
            self._muted = None
        del stack[place:]

    def _text(self, raw: str) -> None:
        if raw and self._muted is None:
            self._pieces.append(raw)
            if self._links:
                self._linked += len(raw)

    def _flush(self, node: int) -> None:
        if self._pieces:
            text = " ".join(entities.unescape("".join(self._pieces)).split())
            if text:
                self.blocks.append((node, text, min(self._linked, len(text))))
            self._pieces.clear()
        self._linked = 0

    def _sums(self, skipped: list[bool]) -> list[int]:
        """The unlinked text in each node."""
        sums = [0] * len(self.tags)
        for node, text, linked in self.blocks:
            if not skipped[node]:
                sums[node] += max(0, len(text) - 2 * linked)
        for node in range(len(sums) - 1, 0, -1):
            sums[self.parents[node]] += sums[node]
        return sums

    def _below(self, tops: Iterable[int]) -> list[bool]:
        """What is left out: all that was already, and what is in ``tops``."""
        out = list(self.skipped)
        for node in tops:
            out[node] = True
        for node in range(1, len(out)):
            out[node] = out[node] or out[self.parents[node]]
        return out

    def _marked(self) -> None:
        """Leaves out what is marked, where the mark counts."""
        marks = {node: m for node, m in self.marks.items() if node not in self._lines or node in self._wide}
        lines = self.marks.keys() - marks.keys()
        if marks:
            everything = self._sums(self.skipped)

            def free(node: int) -> None:
                while node > 0:
                    marks.pop(node, None)
                    node = self.parents[node]

            mains = [n for n, tag in enumerate(self.tags) if tag in ("main", "article") and everything[n]]
            for node in mains:
                if self.tags[node] == "main":
                    free(node)
            left = self._sums(self._below(marks))
            if mains and not any(left[n] for n in mains):
                free(max(mains, key=lambda n: (everything[n], n)))
                left = self._sums(self._below(marks))
            # Words that most of the text has, each element counted in the outermost of its kind.
            most = everything[0] / 2
            loose: dict[str, int] = defaultdict(int)
            inside: dict[int, set[str]] = {}
            for node in range(len(self.tags)):
                seen = inside.get(self.parents[node], set())
                whole, words = marks.get(node, (True, set()))
                if not whole:
                    for word in words - seen:
                        loose[word] += everything[node]
                    seen = seen | words
                if seen:
                    inside[node] = seen
            article = any(left[n] for n in mains)
            for node, (whole, words) in list(marks.items()):
                if whole:
                    freed = everything[node] > most and not article and not words & DISCUSSION
                else:
                    freed = all(loose[word] > most for word in words)
                if freed:
                    del marks[node]
        self.skipped = self._below([*marks, *lines])

    def _container(self, node: int) -> int:
        while node > 0 and self.tags[node] not in CONTAINERS:
            node = self.parents[node]
        return node

    def _scored(self) -> dict[int, float]:
        earned: dict[int, float] = defaultdict(float)
        for node, text, linked in self.blocks:
            worth = len(text) - 2 * linked
            if worth > 0 and not self.skipped[node]:
                earned[self._container(node)] += worth
        self.direct = set(earned)  # containers with unlinked text of their own
        for node in range(len(self.tags) - 1, 0, -1):  # children come after their parents
            if node in earned:
                earned[self._container(self.parents[node])] += PASSED_ON * earned[node]
        self.holding: dict[int, int] = defaultdict(int)  # containers with unlinked text right below
        for node in earned:
            if node:
                self.holding[self._container(self.parents[node])] += 1
        return {node: score * self.plus[node] for node, score in earned.items()}

    def _whole(self, node: int) -> int:
        """The container that holds all of what ``node`` is a part of."""
        up = node
        while up > 0 and self.tags[up] not in ("main", "article"):
            up = self.parents[up]
        marked = up > 0
        node = up or node
        while node > 0 and self.tags[node] != "main":
            up = self._container(self.parents[node])
            # Containers that hold nothing else are passed over.
            while up > 0 and up not in self.direct and self.holding[up] == 1:
                up = self._container(self.parents[up])
            if up not in self.direct or marked and self.tags[up] in ("html", "body"):
                break
            node = up
        return node

    def path(self, node: int) -> str:
        steps = []
        while node > 0:
            steps.append(self.steps[node])
            node = self.parents[node]
        return "".join(reversed(steps))

    def best(self) -> int | None:
        best = max(self.scores, key=lambda n: (self.scores[n], -n), default=None)
        return None if best is None else self._whole(best)

    def votes(self) -> dict[str, float]:
        """A page's vote for each path: its score as a share of the best."""
        most = max(self.scores.values(), default=0)
        found: dict[str, float] = {}
        for node, score in self.scores.items():
            share = score / most
            if share >= ALSO_VOTED:
                path = self.path(self._whole(node))
                found[path] = max(share, found.get(path, 0))
        return found

    def text(self, path: str | None) -> str:
        """The text of the containers on ``path``, or of the best container."""
        chosen: set[int] = set()
        if path is not None:
            check = crc32(path.encode())
            for node, own in enumerate(self.checks):
                if own == check and not self.skipped[node] and (node == 0 or self.tags[node] in CONTAINERS) and self.path(node) == path:
                    chosen.add(node)
        if not chosen:
            best = self.best()
            chosen = set() if best is None else {best}
        if not chosen:  # all text is in links: that of the page's own main part, if it names one
            chosen = {n for n, tag in enumerate(self.tags) if tag in ("main", "article") and not self.skipped[n]}
        if 0 in chosen:
            inside = [not s for s in self.skipped]
        else:
            inside = [False] * len(self.tags)
            for node in range(1, len(self.tags)):
                inside[node] = (node in chosen or inside[self.parents[node]]) and not self.skipped[node]
        return "\n".join(text for node, text, _ in self.blocks if inside[node])


def host(url: Column) -> Column:
    """The host of a url, A-Z lower-cased; empty without ``://``."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def consensus_paths(pages: DataFrame) -> DataFrame:
    """``host, path`` of the path that the pages of each host agree on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes: dict[tuple[str, str], float] = defaultdict(float)
        for batch in batches:
            for part in slices(batch.select([1, 0])):
                for html, name in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for path, share in Page(html).votes().items():
                        votes[name, path] += share
            if len(votes) > 50_000:
                yield _votes(votes)
                votes.clear()
        if votes:
            yield _votes(votes)

    rows = pages.where("html IS NOT NULL").select(host(F.col("url")).alias("host"), "html")
    partial = map_batches(rows, run, "host string, path string, votes double")
    total = partial.groupBy("host", "path").agg(F.round(F.sum("votes"), 6).alias("votes"))
    # The most votes; among equals the first path by name.
    best = total.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("minus"), "path")).alias("best"))
    return staged(best.select("host", "best.path"), "host-paths")


def _votes(votes: dict[tuple[str, str], float]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([h for h, _ in votes], pa.string()),
            pa.array([p for _, p in votes], pa.string()),
            pa.array(list(votes.values()), pa.float64()),
        ],
        ["host", "path", "votes"],
    )


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars, path`` of every row; ``path`` is the host's."""
    paths = consensus_paths(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.select([2, 0, 1, 3])):
                rows = zip(part.column(0).to_pylist(), part.column(3).to_pylist())
                texts = [Page(html).text(path) if html else "" for html, path in rows]
                sizes = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), part.column(2), pa.array(texts, pa.string()), sizes, part.column(3)],
                    ["page_id", "url", "text", "n_chars", "path"],
                )

    small = F.broadcast(paths) if fits_broadcast(paths) else paths
    rows = pages.select(F.col("page_id"), "url", "html", host(F.col("url")).alias("host")).join(small, "host", "left")
    rows = rows.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", "path")
    return map_batches(rows, run, "page_id bigint, url string, text string, n_chars bigint, path string")
