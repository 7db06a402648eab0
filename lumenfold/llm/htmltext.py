"""Main text of web pages by equivalence-class template deduction.

1. Each page is cut into tokens: tags with their path of open elements, class and id,
   and whole text nodes with their path. A token's occurrence vector over the pages of
   its host is kept as a sum of hashes of (page, count), which partial aggregates build
   without gathering a host's pages, however many they are.
2. Tokens of a host with one vector form an equivalence class. A class is valid if at
   least ``SUPPORT`` pages hold it and half of the host's pages do; its tokens are ordered by their mean
   place, and it nests in the smallest class whose span covers its own and that
   occurs on at least as many pages. The valid classes are the host's template. A
   template is no longer than two pages' tokens, so it is bounded.
3. Each template token that opens a container (``CONTAINER``) bounds a slot: the text right inside it, of all the
   host's pages, is the slot's mass. Slots with less than 1/``MINOR`` of the heaviest slot's mass, and without a
   heading, are what surrounds the text on that host, whatever their tags and names.
4. A page is read against its host's template: template tags bound slots, template text
   is fixed. What is left in the slots, outside minor slots, menus, headers, footers, sidebars,
   notices, adverts, forms, scripts, styles and reader comments, is the text. An ``article``
   element, or else a ``main`` one, is a hint to the slots that count: all others go, unless they
   hold ``HINT`` times as much variable text on a host with a template, and its slots are not minor. Inside these elements a block
   goes where all its texts are fixed, but only if the host has ``SUPPORT`` different pages and less than
   half of what the page would keep is fixed: pages that copy each other keep their articles.

Hosts with fewer than ``SUPPORT`` pages have no template; their pages are one slot, and tags and names alone tell.

Defined results
* null or empty html: empty text. Null url: host unknown, no template.
* unclosed or stray tags, truncated pages: read on as far as they go.
* rows that repeat: each row has its own result. Empty table: no rows.
* extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, keep

SUPPORT = 3
#: Text elsewhere outweighs an article (or main element) from so many times its variable text on.
HINT = 4
#: A slot with less than one part in so many of the heaviest slot's mass is minor.
MINOR = 8

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|[^<]+|<", re.S)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

#: Fixed values of HTML: elements without an end tag, elements whose content is no markup, block elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template svg iframe object select option button".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that hold a part of a page; others (paragraphs, lists, inline ones) belong to the part around them.
CONTAINER = frozenset("address article aside blockquote body center dd details dialog div fieldset figure footer form header hgroup html main menu nav section td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements and class or id words that hold no main text.
APART = frozenset("nav header footer aside form head dialog menu".split()) | RAW
APART_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead cookie cookies consent notice notices banner popup modal newsletter subscribe signup login share sharing social related recommended pagination pager comment comments disqus replies reply respond toolbar widget skip".split())


def host_of(url: str | None) -> str | None:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", url or "")
    return m[1].rpartition("@")[2].lower() if m and m[1] else None


def _hash(path: tuple, what: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{path}\x00{what}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def walk(page: str) -> Iterator[tuple]:
    """("tag", name, names, closing, stack) and ("text", text, stack) in page order.

    stack entries are (name, path hash, apart, level); level 2 is inside an article, 1
    inside a main element, 0 elsewhere. The root entry is first.
    """
    stack = [("", 0, False, 0)]
    at = 0
    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        got = m[0]
        if m[2] is None:
            if got[0] != "<" or got == "<":
                yield "text", got, stack
            continue
        name, closing = m[2].lower(), bool(m[1])
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            yield "tag", name, "", True, stack
            continue
        named = {k.lower(): a or b or c for k, a, b, c in _NAMES.findall(m[3])} if m[3] else {}
        if name in ("p", "li") and stack[-1][0] == name:
            stack.pop()
        label = name + "".join(f".{named[k]}" for k in ("class", "id") if k in named)
        top = stack[-1]
        words = set(re.split(r"[^a-z0-9]+", f"{named.get('class', '')} {named.get('id', '')}".lower()))
        level = 2 if name == "article" else 1 if name == "main" or named.get("role", "").lower() == "main" else 0
        if top[3]:
            words.discard("header")  # an article's own header holds its title
        apart = top[2] or (name in APART and not (top[3] and name == "header")) or bool(words & APART_WORDS and (name not in ("body", "html", "article", "main") or top[3] == 2))
        if level and not words & APART_WORDS and all(not s[2] or s[0] in ("nav", "header") for s in stack):
            apart = False  # an article inside a menu that was never closed
        entry = (name, _hash((top[1],), label), apart, 0 if apart else max(top[3], level))
        if name in VOID:
            yield "tag", name, label, False, stack
            continue
        stack.append(entry)
        yield "tag", name, label, False, stack
        if name in ("script", "style", "textarea", "title"):  # their content is no markup
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            stack.pop()


def container_of(stack: list[tuple]) -> int:
    """Path hash of the nearest container."""
    for name, path, _, _ in reversed(stack):
        if name in CONTAINER:
            return path
    return 0


def tokens(page: str) -> dict[int, list]:
    """token hash -> [count, first place, is text, mass, headings] of one page."""
    seen: dict[int, list] = {}
    for place, step in enumerate(walk(page)):
        if step[0] == "tag":
            if step[3]:
                continue
            top = step[4][-1]
            key = top[1] if step[1] not in VOID else _hash((top[1],), step[2])
        else:
            text = " ".join(step[1].split())
            if not text:
                continue
            top = step[2][-1]
            key = _hash((top[1],), "=" + text)
            if not top[2] and (slot := seen.get(container_of(step[2]))) is not None:
                slot[3] += len(text)
                slot[4] += any(x[0] in HEADINGS for x in step[2])
        got = seen.get(key)
        if got is None:
            seen[key] = [1, place, step[0] == "text", 0, 0]
        else:
            got[0] += 1
    return seen


_MASK = (1 << 31) - 1


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial occurrence vectors: host, token, text, pages, place, v1, v2, mass, headings."""
    held: dict[tuple, list] = {}

    def flush() -> pa.RecordBatch:
        rows = [(*k, *v) for k, v in held.items()]
        held.clear()
        cols = list(zip(*rows, strict=True)) or [[]] * 9
        kinds = (pa.string(), pa.int64(), pa.bool_(), *[pa.int64()] * 6)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["host", "token", "fixed", "pages", "place", "v1", "v2", "mass", "headings"])

    for batch in batches:
        for page_id, url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            host = host_of(url)
            if host is None or not (text := page.as_py()):
                continue
            sig = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
            held.setdefault((host, sig, None), [0] * 6)[0] += 1  # no token: the page as a whole, to count different pages
            for key, (count, place, fixed, mass, headings) in tokens(text).items():
                h = int.from_bytes(hashlib.blake2b(b"%d:%d" % (-1 if page_id is None else page_id, count), digest_size=8).digest(), "little")
                got = held.setdefault((host, key, fixed), [0] * 6)
                got[0] += 1
                got[1] += place
                got[2] += h & _MASK
                got[3] += h >> 33
                got[4] += mass
                got[5] += headings
            if len(held) > 100_000:
                yield flush()
    yield flush()


def templates(pages: DataFrame) -> DataFrame:
    """host, host_pages, different, classes: pages and different pages of each host, and the valid equivalence classes of its tokens."""
    parts = pages.mapInArrow(_vectors, "host string, token long, fixed boolean, pages long, place long, v1 long, v2 long, mass long, headings long")
    found = keep(parts.groupBy("host", "token", "fixed").agg(*[F.sum(c).alias(c) for c in ("pages", "place", "v1", "v2", "mass", "headings")]), "vectors", texts=True)
    sizes = found.groupBy("host").agg(F.max("pages").alias("host_pages"), F.count_if(F.col("fixed").isNull()).alias("different"))
    often = found.filter("fixed is not null").join(sizes, "host").filter((F.col("pages") >= SUPPORT) & (F.col("pages") * 2 >= F.col("host_pages")))
    token = F.struct((F.col("place") / F.col("pages")).alias("place"), "token", "fixed", "mass", "headings")
    classes = often.groupBy("host", "host_pages", "different", "pages", "v1", "v2").agg(F.array_sort(F.collect_list(token)).alias("tokens"))
    span = F.struct("pages", F.col("tokens")[0]["place"].alias("first"), F.element_at("tokens", -1)["place"].alias("last"), "tokens")
    by_host = classes.groupBy("host", "host_pages", "different").agg(F.array_sort(F.collect_list(span)).alias("classes"))
    out = keep(by_host, "templates")
    drop(found)
    return out


def nest(classes: list[dict]) -> list[int]:
    """For each class the index of the class it nests in, -1 for the root."""
    up = []
    for i, c in enumerate(classes):
        best = -1
        for j, d in enumerate(classes):
            covers = d["first"] <= c["first"] and d["last"] >= c["last"] and (d["last"] - d["first"]) > (c["last"] - c["first"])
            if i != j and covers and d["pages"] >= c["pages"] and (best < 0 or d["last"] - d["first"] < classes[best]["last"] - classes[best]["first"]):
                best = j
        up.append(best)
    return up


class Template:
    """Tag tokens that bound slots, and fixed text tokens; ``inside``: whether fixed text may go from articles too."""

    def __init__(self, host_pages: int, classes: list[dict], different: int = 0) -> None:
        up = nest(classes)
        self.inside = different >= SUPPORT
        self.depth = {}
        self.fixed = set()
        slots = {t["token"]: (t["mass"], t["headings"]) for c in classes for t in c["tokens"] if not t["fixed"]}
        most = max((mass for mass, _ in slots.values()), default=0)
        self.minor = {k for k, (mass, headings) in slots.items() if self.inside and not headings and mass * MINOR < most}
        for i, c in enumerate(classes):
            depth, k = 1, up[i]
            while k >= 0:
                depth, k = depth + 1, up[k]
            for t in c["tokens"]:
                if t["fixed"]:
                    if c["pages"] == host_pages:  # on every page
                        self.fixed.add(t["token"])
                else:
                    self.depth[t["token"]] = depth


def extract(page: str | None, template: Template | None) -> tuple[str, int]:
    """Main text and number of slots that hold it."""
    if not page:
        return "", 0
    slots: list[tuple[int, list[tuple[str, bool]]]] = []  # (level, blocks, each with whether all of it is fixed)
    block: list[str] = []
    free = False  # the running block has text that is not fixed
    main_here = 0

    def close() -> None:
        nonlocal free
        text = " ".join(_html.unescape("".join(block)).split())
        block.clear()
        if text:
            if not slots or slots[-1][0] != main_here:
                slots.append((main_here, []))
            slots[-1][1].append((text, not free))
        free = False

    for step in walk(page):
        if step[0] == "tag":
            name, stack = step[1], step[4]
            if name in BLOCK or name == "hr":
                close()
            elif name == "br":
                block.append(" ")
            if template and not step[3] and stack[-1][1] in template.depth and (slots and slots[-1][1]):
                if block:
                    continue  # an inline template tag inside a running block
                slots.append((main_here, []))
            continue
        _, text, stack = step
        top = stack[-1]
        if top[2]:
            continue
        if top[3] != main_here:
            close()
            main_here = top[3]
        plain = " ".join(text.split())
        fixed = bool(template and template.fixed and plain and _hash((top[1],), "=" + plain) in template.fixed)
        if not main_here and (fixed or (template and template.minor and container_of(stack) in template.minor)):
            continue
        free = free or bool(plain and not fixed)
        block.append(text)
    close()
    slots = [s for s in slots if s[1]]
    best = max((s[0] for s in slots), default=0)
    if template and template.inside:
        held = [sum(len(t) for at, blocks in slots if at == level for t, fixed in blocks if not fixed) for level in (0, 1, 2)]
        for level in range(best - 1, -1, -1):
            if held[level] > HINT * sum(held[level + 1 :]):
                best = level
    kept = [s[1] for s in slots if s[0] >= best]
    if template and template.inside:
        every, still = (sum(len(t) for s in kept for t, fixed in s if fixed in which) for which in ((True, False), (True,)))
        if still * 2 < every:
            kept = [left for s in kept if (left := [x for x in s if not x[1]])]
    return "\n".join(t for s in kept for t, _ in s), len(kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, Template] = {}
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            ids, urls, pages = batch.column(0), batch.column(1), batch.column(2)
            texts, slots = [], []
            for k in range(batch.num_rows):
                host, template = batch.column(3)[k].as_py(), None
                if host is not None:
                    if host not in known:
                        if len(known) > 2000:
                            known.clear()
                        known[host] = Template(batch.column(4)[k].as_py(), batch.column(5)[k].as_py(), batch.column(6)[k].as_py())
                    template = known[host]
                text, n = extract(pages[k].as_py(), template)
                texts.append(text)
                slots.append(n)
            yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(slots, pa.int64())], names=["page_id", "url", "text", "n_chars", "n_slots"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_slots for every row."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    found = templates(rows)
    # The table of templates is measured; the optimizer broadcasts it only below its limit, else adaptive joins split hot hosts.
    host = F.lower(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#@]+)", 1))
    joined = rows.withColumn("_host", host).join(found.withColumnRenamed("host", "_known"), F.col("_host") == F.col("_known"), "left")
    got = joined.select("page_id", "url", "html", F.col("_known").alias("host"), "host_pages", "classes", "different").mapInArrow(_extract, "page_id long, url string, text string, n_chars long, n_slots long")
    return keep(got, "pages", texts=True)
