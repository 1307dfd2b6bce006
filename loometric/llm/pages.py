"""Main text of web pages by a style tree for each site.

1. Every page is parsed into its elements. Elements that name what they are (menus, footers, adverts,
   forms, comments ...) are noise on any site; of the rest the article, or the main part, is looked at.
2. The pages of a host are merged: elements with the same path of tags and classes are one node of its
   style tree. Spark counts how often each node shows which content and which sequence of child
   elements; the entropies of these counts, against the entropy of the whole pages, are the node's importance.
3. Branches of low importance, the same on page after page, are removed from each page; the blocks that stay are its text.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loometric.llm.common import over_batches, stored

# Nodes below this importance go; fewer pages than MIN_PAGES say nothing.
THRESHOLD = 0.1
MIN_PAGES = 5
SALTS = 16
# Paths of more elements than this, from the page's root, are named by a running hash.
DEPTH = 24

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math object select".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr "
    "ul".split())
# Start tags that end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr main menu nav ol p pre section summary table ul".split())
# Start tags that end an open element of these names, up to an element of those names.
ENDS = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
        "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
        "tbody": (("tbody", "thead", "tfoot", "tr"), ("table",)), "tfoot": (("tbody", "thead", "tr"), ("table",)), "option": (("option",), ("select",))}
P_SCOPE = frozenset("table td th caption button object html body".split())

NOISE_TAGS = frozenset("nav footer aside form button head dialog menu input label fieldset".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion banner "
    "sidebar aside nav navbar navigation menu menus breadcrumb breadcrumbs header masthead footer cookie cookies consent gdpr notice notices "
    "notification notifications alert alerts comment comments commentlist disqus discussion respond reply replies social share sharing "
    "related recommended recommendations newsletter subscribe subscription signup login popup modal overlay widget widgets toolbar "
    "pagination pager skip copyright disclaimer form forms search".split())
# These hold no article of the page even where they hold an article element.
SURE_WORDS = frozenset("comment comments commentlist disqus discussion respond reply replies related recommended recommendations".split())
MAIN_TAGS = frozenset(("article", "main"))

_TAG = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*+)|[a-zA-Z/!?][^>]*+(?:>|\Z))")
# From a tag's name or the end of a quoted value to the tag's end, or to the quote that opens the next value.
_TO_QUOTE = re.compile(r"(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:[^\s>\"'][^\s>]*+|(?=>))|(?!\s*+=)))*+(?:>|[^\s/>][^\s/>=]*+\s*+=\s*+([\"']))")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")
_HOST = re.compile(r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")


class Element:
    """An element: its name with classes, whether it names itself as noise, and its children, elements or strings."""

    __slots__ = ("tag", "name", "noise", "sure", "children", "holds_main")

    def __init__(self, tag: str, name: str, noise: bool = False, sure: bool = False):
        self.tag, self.name, self.noise, self.sure = tag, name, noise, sure
        self.children: list[Element | str] = []
        self.holds_main = tag in MAIN_TAGS


def _element(tag: str, attributes: str) -> Element:
    sure = noise = tag in NOISE_TAGS
    if not attributes or attributes.isspace():
        return Element(tag, tag, noise, sure)
    named = ""
    for key, double, single, bare in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), double or single or bare
        if key in ("class", "id"):
            words = {w.lower() for w in _WORD.findall(value)}
            noise = noise or not words.isdisjoint(NOISE_WORDS)
            sure = sure or not words.isdisjoint(SURE_WORDS)
            if key == "class":
                named = "." + ".".join(value.split())
        elif key == "role":
            noise = noise or value.strip().lower() in NOISE_ROLES
        elif key == "hidden" or key == "aria-hidden" and value == "true":
            noise = True
    return Element(tag, tag + named, noise, sure)


def _tag_end(text: str, place: int, dead: set[int | str]) -> int:
    """Where the tag ends whose attributes begin at ``place``, or -1 if it has no end.

    Quoted values may be of any length. ``dead`` keeps the places from which no end was found, and the
    quotes that are not there again, so a page is read in linear time.
    """
    tried = []
    while place not in dead:
        tried.append(place)
        found = _TO_QUOTE.match(text, place)
        if found is None:
            break
        if not found[1]:
            return found.end()
        # a quote of this kind that is missing from here on is missing from every later place
        quote = -1 if found[1] in dead else text.find(found[1], found.end())
        if quote < 0:
            dead.add(found[1])
            break
        place = quote + 1
    dead.update(tried)
    return -1


def parse(text: str) -> Element:
    """The element tree of a page. Missing end tags are implied; stray ones are passed over."""
    root = Element("#page", "")
    stack, place, n = [root], 0, len(text)
    open_tags: Counter[str] = Counter()
    dead: set[int | str] = set()

    def close(names: tuple[str, ...], scope) -> None:
        if not any(open_tags[name] for name in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                for gone in stack[i:]:
                    open_tags[gone.tag] -= 1
                del stack[i:]
                return
            if stack[i].tag in scope:
                return

    while place < n:
        found = _TAG.search(text, place)
        if found is None:
            stack[-1].children.append(text[place:])
            break
        if found.start() > place:
            stack[-1].children.append(text[place:found.start()])
        place = found.end()
        if found[1]:
            end = text.find("-->", place)
            place = n if end < 0 else end + 3
            continue
        tag = found[3]
        if tag is None:
            continue
        end = _tag_end(text, place, dead)
        if end < 0:
            place = text.find(">", place) + 1 or n
            continue
        attributes, place = text[place:end - 1], end
        tag = tag.lower()
        if found[2]:
            if tag == "br":
                stack[-1].children.append(" ")
            elif tag not in VOID:
                close((tag,), ())
            continue
        if tag in RAW:
            if not attributes.rstrip().endswith("/"):
                close_tag = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>", re.I).search(text, place)
                place = n if close_tag is None else close_tag.end()
            continue
        if tag in ENDS_P:
            close(("p",), P_SCOPE)
        if tag in ENDS:
            close(*ENDS[tag])
        if tag in VOID:
            stack[-1].children.append("\n\n" if tag == "hr" else " " if tag == "br" else "")
            if tag == "hr":
                stack[-1].children.append(Element("hr", "hr"))
            continue
        element = _element(tag, attributes)
        stack[-1].children.append(element)
        if element.holds_main and not element.noise:
            for above in reversed(stack):
                if above.holds_main:
                    break
                above.holds_main = True
        stack.append(element)
        open_tags[tag] += 1
    return root


def _is_noise(element: Element) -> bool:
    """Noise by its own name; a wrapper with a telling class that holds the article is none."""
    return element.noise and (element.sure or element.tag in MAIN_TAGS or not element.holds_main)


# The number of elements on a path, and its name.
Path = tuple[int, str]
_TOP: Path = (0, "")


def _below(path: Path, element: Element) -> Path:
    """The path of a child: names joined by slashes; from DEPTH on the hash of the path above and the name, so deep pages stay linear."""
    depth, above = path
    name = f"{above}/{element.name}" if depth else element.name
    if depth >= DEPTH:
        name = "#" + hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
    return depth + 1, name


def main_parts(root: Element) -> list[tuple[Element, Path]]:
    """The outermost articles with their paths, else the main element, else the body or the page."""
    for wanted in ("article", "main", "body", "#page"):
        found: list[tuple[Element, Path]] = []
        todo = [(root, _TOP)]
        while todo:
            element, path = todo.pop()
            here = _below(path, element)
            if element.tag == wanted and not (element.noise and wanted in MAIN_TAGS):
                found.append((element, here))
                continue
            if not _is_noise(element) and element.tag != "header":
                todo += [(c, here) for c in reversed(element.children) if isinstance(c, Element)]
        if found:
            return found
    return [(root, (1, ""))]


def blocks(element: Element, path: Path, drop: frozenset[str], inside: bool) -> Iterator[str]:
    """Texts of the blocks in page order, without noise and without the branches whose path is in ``drop``."""
    pieces: list[str] = []
    # an explicit stack: pages may nest as deep as they like
    todo: list[tuple] = [("open", element, path)]
    while todo:
        step, item, here = todo.pop()
        if step == "text":
            pieces.append(html.unescape(item) if "&" in item else item)
            continue
        if step == "close":
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                yield text
            continue
        if drop and here[1] in drop:
            continue
        block = item.tag in BLOCKS or item.tag == "#page"
        if block:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                yield text
            todo.append(("close", None, None))
        for child in reversed(item.children):
            if isinstance(child, str):
                todo.append(("text", child, None))
            elif not _is_noise(child) and (inside or child.tag != "header"):
                todo.append(("open", child, _below(here, child)))


def main_text(text: str, drop: frozenset[str] = frozenset()) -> str:
    """The blocks of the page's main parts, joined by line ends."""
    root = parse(text)
    found: list[str] = []
    for element, path in main_parts(root):
        found += blocks(element, path, drop, element.tag in MAIN_TAGS)
    return "\n".join(found)


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def _number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


# Modulus and base of the hashes of runs of blocks.
_PRIME, _BASE = (1 << 127) - 1, 0x5DEECE66D1CE4E5B9A0761D6478BD64
_NO_BLOCK = 1


class _Runs:
    """The blocks of a page in order, as running hashes: a hash of any run of them is at hand without its texts."""

    def __init__(self):
        self.sums, self.powers = [0], [1]

    def add(self, pieces: list[str]) -> None:
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            number = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=15).digest(), "big") + 2
            self.sums.append((self.sums[-1] * _BASE + number) % _PRIME)
            self.powers.append(self.powers[-1] * _BASE % _PRIME)

    def end(self) -> int:
        return len(self.sums) - 1

    def joined(self, runs: list[tuple[int, int]]) -> int:
        """A number for the blocks of all runs one after the other; an empty run is an empty block."""
        total = blocks_seen = 0
        for start, end in runs:
            if start == end:
                total, blocks_seen = (total * _BASE + _NO_BLOCK) % _PRIME, blocks_seen + 1
            else:
                power = self.powers[end - start]
                total = (total * power + self.sums[end] - self.sums[start] * power) % _PRIME
                blocks_seen += end - start
        return _number(f"{blocks_seen}:{total}")


def style_nodes(text: str) -> dict[str, tuple[int, int, int]]:
    """For each style path of the page's main parts: numbers for its content, its child sequences, and the page.

    The content of a node is a run of the page's blocks, so each text is read once at any depth.
    """
    root = parse(text)
    runs, parts = _Runs(), main_parts(root)
    contents: dict[str, list[list[int]]] = {}
    children: dict[str, list[str]] = {}
    for element, path in parts:
        pieces: list[str] = []
        todo: list[tuple] = [("open", element, path, True)]
        while todo:
            step, item, here, is_node = todo.pop()
            if step == "text":
                pieces.append(html.unescape(item) if "&" in item else item)
                continue
            if step == "close":
                runs.add(pieces)
                if item is not None:
                    item.append(runs.end())
                continue
            run = None
            if item.tag in BLOCKS or item.tag == "#page":
                runs.add(pieces)
                run = [runs.end()] if is_node else None
                todo.append(("close", run, None, False))
            inner = [c for c in item.children if isinstance(c, str) or not _is_noise(c)]
            if run is not None:
                contents.setdefault(here[1], []).append(run)
                children.setdefault(here[1], []).append(",".join(c.name for c in inner if isinstance(c, Element)))
            for child in reversed(inner):
                if isinstance(child, str):
                    todo.append(("text", child, None, False))
                else:  # inline elements are content of their block
                    todo.append(("open", child, _below(here, child), run is not None and child.tag in BLOCKS))
    page = runs.joined([contents[p[1]][0] for _, p in parts])
    return {name: (runs.joined(found), _number(";".join(children[name])), page) for name, found in contents.items()}


def _rows(pages: DataFrame, id_column: str, url_column: str, html_column: str) -> DataFrame:
    return pages.select(F.col(id_column).alias("id"), F.col(url_column).cast("string").alias("url"),
                        F.coalesce(F.col(html_column).cast("string"), F.lit("")).alias("html"))


def style_tree(pages: DataFrame, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(host, path, pages, importance) of every node of every host's style tree.

    Counts are taken before anything is gathered: for each node, how many pages show each content.
    The importance is the larger entropy of content and child sequences over that of the whole
    pages that have the node; 1 where these pages are all alike or too few to tell.
    """
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {"host": [], "path": [], "kind": [], "number": []}
        for url, text in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
            host = host_of(url)
            for path, numbers in style_nodes(text).items():
                for kind, number in enumerate(numbers):
                    out["host"].append(host)
                    out["path"].append(path)
                    out["kind"].append(kind)
                    out["number"].append(number)
        return pa.RecordBatch.from_arrays([pa.array(out["host"], pa.string()), pa.array(out["path"], pa.string()),
                                           pa.array(out["kind"], pa.int32()), pa.array(out["number"], pa.int64())], names=list(out))

    rows = _rows(pages, url_column, url_column, html_column)
    seen = over_batches(rows, run, "host string, path string, kind int, number bigint")
    counted = seen.groupBy("host", "path", "kind", "number").agg(F.count(F.lit(1)).alias("n"))
    by_kind = counted.groupBy("host", "path").agg(
        *[F.sum(F.when(F.col("kind") == k, F.col("n") * F.log(F.col("n").cast("double"))).otherwise(0.0)).alias(f"spread{k}") for k in range(3)],
        F.sum(F.when(F.col("kind") == 2, F.col("n")).otherwise(0)).alias("pages"))
    entropy = [F.log(F.col("pages").cast("double")) - F.col(f"spread{k}") / F.col("pages") for k in range(3)]
    told = (F.col("pages") >= MIN_PAGES) & (entropy[2] > 1e-9)
    return by_kind.select("host", "path", "pages", F.when(told, F.greatest(entropy[0], entropy[1]) / entropy[2]).otherwise(1.0).alias("importance"))


def main_texts(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html",
               threshold: float = THRESHOLD) -> DataFrame:
    """(id, url, text) of every row of ``pages``.

    Null and empty pages give an empty text. Pages with a null url are one site. Repeated rows are
    read each; an empty table gives an empty result. Only paths of unimportant nodes meet the pages
    again; they are salted, since one host may have a third of all pages.
    """
    tree = style_tree(pages, url_column, html_column)
    noise = stored(tree.where(F.col("importance") < threshold).groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("drop")), "site-noise")
    rows = _rows(pages, id_column, url_column, html_column)
    host = F.regexp_extract(F.coalesce("url", F.lit("")), _HOST.pattern, 1)
    salted = noise.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    kind = pages.schema[id_column].dataType.simpleString()
    keyed = rows.withColumn("host", F.lower(host)).withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int"))
    met = keyed.join(salted, ["host", "salt"], "left").select("id", "url", "html", "drop")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(text, frozenset(drop or ())) for text, drop in zip(batch.column("html").to_pylist(), batch.column("drop").to_pylist())]
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], names=["id", "url", "text"])

    return over_batches(met, run, f"id {kind}, url string, text string").select(
        F.col("id").alias(id_column), F.col("url").alias(url_column), "text")
