"""Main text of web pages by deducing the template that pages of a host share.

A page is a sequence of tokens: its structural elements, each told by the path that it stands in. Tokens that occur
equally often on each page of a host share an occurrence vector; vectors are compared by a random linear sum over the
pages, so they are aggregates, and no task sees a host's pages together. Tokens with one vector that enough pages have form
an equivalence class. A class is valid if its instances nest: none of another class begins in one slot of it and ends in
another; tokens that don't stand in one order on every page leave it. The tokens of the valid classes, nested by their
paths, are the host's template; text belongs to the slot of the nearest of them.

Slots then decide on every page. Text that is the same on all pages, or consists of links, is the template's; the article
is the smallest part of the template that holds most of the rest. Names of elements and classes drop what else is no
article in there; the elements article and main only decide between parts that would both do.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import short_batches, stash

#: Elements whose content is never text.
RAW = "script style noscript template svg math iframe object select button textarea".split()
#: Elements that are boilerplate wherever they stand.
OUTSIDE = frozenset("head nav header footer aside form menu dialog".split())
#: Elements that hold the article, where there is a choice.
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end a block of text and take part in paths.
BLOCKS = frozenset("html body head title main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr blockquote pre figure figcaption header footer nav aside form menu dialog address fieldset details summary hr center".split())
#: Elements that hold other blocks: only these can be the article's part, or be dropped as a part of it.
HOLDERS = frozenset("html body main article section div ul ol dl table tbody center fieldset details figure".split())
#: An open element that the start of one of these closes.
CLOSES = {"p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "head": frozenset(["body"])}
#: Class names, ids and roles that, as a whole, mark boilerplate on a holder. Fixed values.
MARKED = frozenset(
    "ad ads advert advertisement adverts banner sponsor sponsored promo promotion popup modal overlay cookie cookies consent gdpr notice notices newsletter subscribe subscription signup login share sharing related recommended "
    "recommendations trending sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs pagination pager toc header masthead topbar footer comment comments disqus replies reply respond form search tags "
    "cookie-notice cookie-banner cookie-consent newsletter-signup newsletter-form share-buttons share-bar share-links social-share social-links social-buttons social-media-links sharing-buttons related-posts related-articles related-links related-content "
    "recommended-posts comment-list comment-form comments-area comments-section ad-container ad-slot ad-banner ad-wrapper ad-unit advert-container promo-box post-navigation post-tags tag-list nav-links search-form popular-posts disqus-thread disqus_thread".split()
)
#: Classes count that so large a share of the host's pages have.
LEAST_SUPPORT = 0.5
#: Text is the template's if it is the same on so many pages and on all that have its slot, or linked to so large a share.
SAME_ON, MOST_LINKED = 3, 0.5
#: The article's part holds so large a share of what its parent holds; article and main elements need less.
MOST, HALF = 0.8, 0.5
#: Elements below this depth count to their ancestor at it, so that paths are bounded; their text stays.
DEPTH = 40
#: Templates go to every executor up to so many bytes, beyond that they are joined by host.
BROADCAST_BYTES = 8 << 20

_ATTRS = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b" + _ATTRS + r">.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>" + _ATTRS + r")>|<[!?][^>]*>", re.S | re.I)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)


@lru_cache(maxsize=4096)
def _label(name: str, attrs: str) -> str:
    """An element in a path: its name, its first class (numbers alike), ~ and a name that marks boilerplate, ! if it isn't
    shown. Headings and paragraphs are never marked, and a section's id is made from its title."""
    found: dict[str, str] = {}
    for key, *value in _ATTR.findall(attrs):
        found.setdefault(key.lower(), "".join(value))
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _NOT_SHOWN.search(found.get("style", ""))
    out = name
    if name in HOLDERS and name not in ("html", "body", "main", "article"):
        first = re.sub(r"[^a-z#_-]", "", re.sub(r"\d+", "#", (found.get("class", "").lower().split() or [""])[0]))
        marks = MARKED.intersection(" ".join(found.get(k, "") for k in ("class", "role", *(["id"] if name != "section" else []))).lower().split())
        out += (f".{first}" if first else "") + (f"~{min(marks)}" if marks else "")
    return out + "!" * bool(hidden and name not in ("html", "body"))


def _name(path: str) -> str:
    return re.split(r"[.~!]", path.rpartition("/")[2], maxsplit=1)[0]


@lru_cache(maxsize=1 << 16)
def _bad(path: str) -> str:
    """The path of the innermost boilerplate element at or above a path, or nothing."""
    while path:
        label = path.rpartition("/")[2]
        if _name(path) in OUTSIDE or "~" in label or label.endswith("!"):
            return path
        path = path.rpartition("/")[0]
    return ""


def read(page: str | None) -> tuple[list[str], list[tuple[str, str, int]]]:
    """The paths of the page's structural elements in order, and its blocks of text: path, text, and how many of its
    characters are in links. The page itself is the path of no element."""
    tokens, out = [""], []
    stack: list[tuple[str, str]] = [("", "")]
    parts: list[str] = []
    links, in_link = 0, 0

    def flush() -> None:
        nonlocal links
        text = "".join(parts)
        parts.clear()
        if "&" in text:
            text = html.unescape(text)
        text = " ".join(text.split())
        if text:
            out.append((stack[-1][1], text, min(links, len(text))))
        links = 0

    page, at = page or "", 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text = page[at : m.start()]
            parts.append(text)
            if in_link:
                links += len(text)
        at = m.end()
        name = m.group("name")
        if name is None:
            continue
        name = name.lower()
        if name == "a":
            in_link = 0 if m.group("end") else 1
            continue
        if name in ("br", "td", "th"):
            parts.append(" ")
            continue
        if name not in BLOCKS:
            continue
        flush()
        if m.group("end"):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
                if stack[i][0] in MAIN | {"body", "html"} and name not in ("body", "html", "main", "article", "div"):
                    break
            continue
        while len(stack) > 1 and name in CLOSES.get(stack[-1][0], ()):
            stack.pop()
        if name == "hr":
            continue
        up = stack[-1][1]
        path = up if len(stack) > DEPTH else f"{up}/{_label(name, m.group('attrs') or '')}"
        stack.append((name, path))
        if path != up:
            tokens.append(path)
    parts.append(page[at:])
    flush()
    return tokens, out


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m.group(1).lower() if m else ""


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def slot_of(path: str, tokens) -> str:
    """The nearest of the tokens at or above a path; the page itself is always one."""
    while path and path not in tokens:
        path = path.rpartition("/")[0]
    return path


# ---- classes ---------------------------------------------------------------------------------------------------------

_COUNTED = "host string, token string, pages long, vector long"


def _count(batches):
    """For each host and token: pages that have it, and the sum of its occurrences times a random number of the page."""
    for b in batches:
        found: dict = defaultdict(lambda: [0, 0])
        for page_id, url, page in zip(*(b.column(i).to_pylist() for i in range(3))):
            host, number = host_of(url), _hash(f"{page_id}|{url}|{len(page or '')}")
            for token, n in Counter(read(page)[0]).items():
                got = found[host, token]
                got[0] += 1
                got[1] = (got[1] + n * number) & ((1 << 64) - 1)
        rows = [(h, t, p, v - (1 << 64) if v >> 63 else v) for (h, t), (p, v) in found.items()]
        yield _batch(rows, _COUNTED)


def _batch(rows: list, schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.rsplit(" ", 1) for x in schema.split(", ")))
    types = {"string": pa.string(), "long": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)], list(names))


def classes(pages: DataFrame) -> DataFrame:
    """(host, tokens): of each host the tokens that half of its pages have, as an array of (token, class), where tokens
    with one occurrence vector have one class. pages has (page_id, url, html)."""
    wrap = F.sum(F.col("vector").cast("decimal(38,0)"))  # sums of vectors may pass 64 bits
    counted = short_batches(pages).select(F.col("page_id").cast("long"), "url", "html").mapInArrow(_count, _COUNTED)
    tokens = stash(counted.groupBy("host", "token").agg(F.sum("pages").alias("pages"), wrap.alias("vector")), "tokens")
    most = tokens.where("token = ''").select("host", F.col("pages").alias("most"))
    # Only tokens with support are collected: of those that half of the pages have there are twice a page's at most.
    valid = tokens.join(most, "host").where(F.col("pages") >= LEAST_SUPPORT * F.col("most"))
    slot = F.struct("token", F.xxhash64("pages", F.expr("pmod(vector, 18446744073709551616)")).alias("class"))
    return valid.groupBy("host").agg(F.collect_list(slot).alias("tokens"))


def instances(tokens: list[str], of: dict[str, int]) -> tuple[dict[str, int], set[int]]:
    """On one page: for each token a hash of the tokens of its class that come before it, and the classes that aren't in
    order in each instance or don't nest.

    An instance of a class is one occurrence of each of its tokens; instances lie one after the other. While one is open,
    those that began inside must end before its next token comes; of two that cross, the class of fewer tokens is wrong.
    """
    order: dict[int, list[str]] = defaultdict(list)
    before: dict[str, int] = {}
    for t in dict.fromkeys(tokens):
        if t in of:
            last = order[of[t]][-1:]
            before[t] = (before[last[0]] + _hash(last[0])) & ((1 << 63) - 1) if last else 0
            order[of[t]].append(t)
    place = {t: i for members in order.values() for i, t in enumerate(members)}
    wrong: set[int] = set()
    seen: Counter = Counter()
    open_: list[int] = []
    for t in tokens:
        c = of.get(t)
        if c is None or len(order[c]) == 1 or c in wrong:
            continue
        if place[t] != seen[c] % len(order[c]):
            wrong.add(c)
            open_ = [x for x in open_ if x != c]
            continue
        if not place[t]:
            open_.append(c)
        while open_[-1] != c and c not in wrong:  # what began in an earlier slot of c has not ended
            less = c if len(order[c]) < len(order[open_[-1]]) else open_[-1]
            wrong.add(less)
            open_.remove(less)
        seen[c] += 1
        if c not in wrong and seen[c] % len(order[c]) == 0:
            open_.pop()
    return before, wrong


# ---- templates -------------------------------------------------------------------------------------------------------

_SEEN = "host string, kind long, key string, pages long, words long, linked long, low long, high long"


def _see(batches, known):
    """With the host's classes, for each slot: pages with text in it, its characters, those in links, the smallest and
    largest hash of its text on a page; and for each token on how many pages its class is wrong, and the smallest and
    largest hash of the tokens before it."""
    for b in batches:
        found: dict = defaultdict(lambda: [0, 0, 0, 1 << 63, -(1 << 63)])
        classes_of: dict = {}
        for i, (url, page) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            host = host_of(url)
            if host not in classes_of:
                classes_of[host] = {x["token"]: x["class"] for x in known(b, i, host).get("tokens") or []}
            of, (tokens, blocks) = classes_of[host], read(page)
            order, wrong = instances(tokens, of)
            for token, one in order.items():
                got = found[host, 1, token]
                got[0], got[1], got[3], got[4] = got[0] + 1, got[1] + (of[token] in wrong), min(got[3], one), max(got[4], one)
            slots: dict = defaultdict(list)
            for path, text, linked in blocks:
                slots[slot_of(path, of)].append((path, text, linked))
            for slot, texts in slots.items():
                one, got = _hash("\n".join(t for _, t, _ in texts)), found[host, 0, slot]
                plain = [(len(t), n) for p, t, n in texts if len(_bad(p)) <= len(slot)]  # not what boilerplate below the slot holds
                got[0], got[1], got[2] = got[0] + 1, got[1] + sum(n for n, _ in plain), got[2] + sum(n for _, n in plain)
                got[3], got[4] = min(got[3], one), max(got[4], one)
        yield _batch([(*k, *v) for k, v in found.items()], _SEEN)


@dataclass
class Template:
    """Of each slot whether its text is the article's kind (own words, not links), and the part that holds the article."""

    plain: dict[str, bool] = field(default_factory=dict)
    part: str | None = None
    #: Holders without a plain slot in them.
    empty: frozenset[str] = frozenset()


def _above(path: str) -> Iterable[str]:
    while path:
        path = path.rpartition("/")[0]
        yield path


def main_part(mass: dict[str, float]) -> str | None:
    """The smallest holder with most of the mass: from the page on, down to the child that has nearly all of its
    parent's, or more than half in an article or main element, of which the first on the way is taken."""
    total: dict[str, float] = defaultdict(float)
    children: dict[str, set[str]] = defaultdict(set)
    for path, m in mass.items():
        total[path] += m
        for up in _above(path):
            total[up] += m
            children[up].add(path)
            path = up
    if not total.get(""):
        return None
    here = ""
    while True:
        for share, names in ((HALF, MAIN), (MOST, HOLDERS)):
            below = [c for c in children[here] if _name(c) in names and total[c] >= share * total[here]]
            if below:
                break
        if not below:
            return here
        here = max(below, key=lambda c: (total[c], c))
        if _name(here) in MAIN:
            return here


def template_of(seen: list) -> Template:
    """The template of a host from rows (kind, key, pages, words, linked, low, high) of its slots."""
    plain = {x["key"]: (x["low"] != x["high"] or x["pages"] < SAME_ON) and x["linked"] <= MOST_LINKED * x["words"] for x in seen}
    if not any(plain.values()):  # pages that are all one and the same show no template
        plain = {x["key"]: x["linked"] <= MOST_LINKED * x["words"] for x in seen}
    words = {x["key"]: float(x["words"]) for x in seen if plain[x["key"]]}
    part = main_part({k: n for k, n in words.items() if not _bad(k)})
    part = main_part(words) if part is None else part
    holds = {up for k in words for up in (k, *_above(k))}
    empty = frozenset(up for k in plain for up in (k, *_above(k)) if up and up not in holds and _name(up) in HOLDERS)
    return Template(plain, part, empty)


def templates(pages: DataFrame) -> DataFrame:
    """(host, tokens, slots): the tokens of each host's valid classes, and what its pages have in their slots.

    pages has (page_id, url, html). Classes that are wrong on some page, and tokens that don't stand behind the same tokens
    of their class on every page, leave the template; their slots become part of those around them.
    """
    rows = short_batches(pages).select("page_id", "url", "html")
    found = stash(classes(rows), "classes")
    seen = stash(_by_host(rows.select("url", "html"), found, _see, _SEEN).groupBy("host", "kind", "key").agg(F.sum("pages").alias("pages"), F.sum("words").alias("words"), F.sum("linked").alias("linked"), F.min("low").alias("low"), F.max("high").alias("high")), "seen")
    wrong = seen.where("kind = 1 and (words > 0 or low <> high)").groupBy("host").agg(F.collect_list("key").alias("wrong"))
    slots = seen.where("kind = 0").groupBy("host").agg(F.collect_list(F.struct("key", "pages", "words", "linked", "low", "high")).alias("slots"))
    kept = F.filter("tokens", lambda t: ~F.array_contains(F.coalesce("wrong", F.array().cast("array<string>")), t["token"]))
    return found.join(wrong, "host", "left").join(slots, "host", "left").select("host", F.transform(kept, lambda t: t["token"]).alias("tokens"), "slots")


def _by_host(rows: DataFrame, found: DataFrame, run, schema: str) -> DataFrame:
    """run(batches of rows, known) in Python, where known(batch, i, host) is the row of found for the host of row i.

    found is sent to all executors if its size, which is counted, is small; else the optimizer joins it to rows by the
    host of their url, and splits hosts with very many pages.
    """
    size = F.sum(sum((F.octet_length(F.to_json(F.struct(c))) for c in found.columns[1:]), F.octet_length("host")))
    if (found.agg(size).first()[0] or 0) <= BROADCAST_BYTES:
        held = rows.sparkSession.sparkContext.broadcast({x["host"]: x for x in found.toArrow().to_pylist()})
        return short_batches(rows).mapInArrow(lambda batches: run(batches, lambda b, i, host: held.value.get(host, {})), schema)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    n, names = len(rows.columns), found.columns
    joined = rows.withColumn("host", host).join(found, "host", "left").select(*rows.columns, *found.columns)
    return short_batches(joined).mapInArrow(lambda batches: run(batches, lambda b, i, host: {c: b.column(n + k)[i].as_py() for k, c in enumerate(names)}), schema)


def main_text(page: str | None, template: Template) -> str:
    """The text of the page's article.

    Of the template's part for the article, or where the page lacks it, of the part that holds most of what the template
    calls plain, all blocks count but those in boilerplate elements inside, and those in holders inside whose text is the
    template's. A heading in the part's own header is its title. Everything else of the article stays, repeated or not.
    """
    blocks = read(page)[1]
    slots = [slot_of(path, template.plain) for path, _, _ in blocks]
    part = template.part
    if part is None or not any(f"{path}/".startswith(f"{part}/") for path, _, _ in blocks):
        mass, all_ = Counter(), Counter()
        for (path, text, linked), slot in zip(blocks, slots):
            if template.plain.get(slot, True) and linked <= MOST_LINKED * len(text):
                all_[path] += len(text)
                if not _bad(path):
                    mass[path] += len(text)
        part = main_part(mass)
        part = main_part(all_) if part is None else part
        if part is None:
            return ""
    out = []
    for path, text, linked in blocks:
        if not f"{path}/".startswith(f"{part}/"):
            continue
        bad = _bad(path)
        title = _name(bad) == "header" and "~" not in bad.rpartition("/")[2] and _name(path) in HEADINGS and len(_bad(bad.rpartition("/")[0])) <= len(part)
        if len(bad) > len(part) and not title:
            continue
        if any(len(up) > len(part) and up in template.empty for up in (path, *_above(path))):
            continue
        if _name(part) not in MAIN and linked > MOST_LINKED * len(text):
            continue
        out.append(text)
    return "\n\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for every row of pages: the text of its article, blocks joined by an empty line.

    Null or empty html gives an empty text, null urls belong to one host; rows that repeat stay and count as
    pages of the host; an empty table gives an empty one. Other columns are ignored. Nothing of a page is cut off.
    """
    rows = pages.select("page_id", "url", "html")

    def run(batches, known):
        held: dict = {}
        for b in batches:
            out = []
            for i, (url, page) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                host = host_of(url)
                if host not in held:
                    if len(held) > 1000:
                        held.clear()
                    of = known(b, i, host)
                    held[host] = template_of(_merged(of.get("slots") or [], {*(of.get("tokens") or []), ""}))
                out.append(main_text(page, held[host]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return _by_host(rows, stash(templates(rows), "templates"), run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


def _merged(seen: list, valid: set[str]) -> list:
    """Slots of tokens that left the template count to the slot around them, whose text then differs from page to page if
    any part of it does."""
    out: dict = {}
    for x in seen:
        slot = slot_of(x["key"], valid)
        got = out.setdefault(slot, {"key": slot, "pages": 0, "words": 0, "linked": 0, "low": 0, "high": 0})
        got["pages"] = max(got["pages"], x["pages"])
        got["words"] += x["words"]
        got["linked"] += x["linked"]
        got["high"] += x["high"] != x["low"]
    return list(out.values())
