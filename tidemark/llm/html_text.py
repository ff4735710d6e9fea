"""Main text of web pages by wrappers: union-free regular expressions inferred per host.

A page is read as a stream of text blocks, each named by the path of block elements around it. The
streams of a host's pages are aligned one after another: what stands in both stays, what only one
of them has becomes an optional group, and neighbours that repeat fold into a repeated group. The
result, the host's wrapper, is one regular expression without alternatives over block names; each
of its places is a text slot with what the pages put there: how many pages fill it, how long its
texts are, how much of them is link text, and whether they are the same on every page.

Wrappers are merged within each task while its pages stream by, so what is shuffled is one small
row per host and task, however many pages a host has. A host has two wrappers: one of the pages
with text inside an article or main element, one of its other pages. They tell which slots are main
text: never those below menus, headers, footers, sidebars, notices, adverts, forms or reader
comments; on pages of the first kind those inside an article or main element; on the others the
slots whose text differs between pages, is not mostly links and does not stand outside the main
elements of the first kind on every page.

Defined results: a null or empty html, or one without main text, gives an empty text. Pages with a
null or unreadable URL share one nameless host. Cut-off pages give what they hold. Rows are treated
one by one, so repeated rows give equal results.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from hashlib import blake2b
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ship, stored

ship(__name__)

# HTML element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var "
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mspace mstyle "
    "mpadded mphantom semantics".split())
RAW = frozenset(
    "script style noscript template textarea title iframe noembed noframes xmp svg annotation annotation-xml".split())
IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
BREAKS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dd", ("dl",)), "dd": ("dt", ("dl",)),
          "tr": ("tr", ("table", "tbody", "thead")), "td": ("td", ("tr",)), "th": ("th", ("tr",)),
          "option": ("option", ("select",))}
# What is never main text, by element and by name in class, id or role. A name counts
# as a whole or by its last part (site-footer), unless a part says that it only tells of a layout.
NOT_MAIN = frozenset("head nav footer aside button select dialog menu object canvas".split())
NOT_MAIN_WORDS = frozenset(
    "ad ads advert adverts advertisement adbox banner sponsor sponsored promo nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar side footer header masthead cookie cookies consent notice notices alert "
    "popup modal newsletter subscribe signup login search share sharing social related recommended comment "
    "comments reply replies discussion disqus widget copyright toolbar pagination pager skip complementary "
    "contentinfo".split())
LAYOUT = frozenset("has with without no not is show hide in".split())
#: Layout containers: an article or main element below them is main text all the same.
AROUND = frozenset(
    "banner nav navbar navigation menu sidebar side header masthead notice notices alert search share sharing "
    "social widget copyright toolbar popup modal".split())
HEADS = frozenset(("header", "masthead"))
MAIN = frozenset(("article", "main"))
PAGE_PARTS = frozenset("article aside footer header main nav".split())
MAIN_WORDS = frozenset("article main content post entry story".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:"[^"<]*"|'[^'<]*'|[^'"<>])*>|[^<>]*>?)|<[!?][^>]*>?""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""\s(?:hidden(?=[\s/>=])|aria-hidden\s*=\s*["']?true)""", re.I)
_LETTERS = re.compile(r"[a-z]+")


def _not_main(value: str) -> set[str]:
    """Those names of a class, id or role that stand for what is never main text."""
    found = set()
    for name in value.split():
        parts = _LETTERS.findall(name)
        if parts and parts[-1] in NOT_MAIN_WORDS and not LAYOUT & set(parts):
            found.add(parts[-1])
    return found


_SPACE = re.compile(r"\s+")
#: Why text is never main: it is in a form; in a layout container; in what is out whatever is below.
#: Article and main elements below the first two are main text all the same.
FORM, AROUND_IT, OUT = 1, 2, 3
#: A longer path is replaced by its print, so that deep nesting costs no more than shallow one.
LONG_PATH = 512


class Block:
    """A run of text within one block element."""

    __slots__ = ("form", "level", "linked", "main", "path", "text")

    def __init__(self, path: str, level: int, main: bool, form: int) -> None:
        self.path, self.level, self.main, self.form, self.text, self.linked = path, level, main, form, [], 0


def blocks_of(html: str | None) -> list[tuple[str, bool, bool, str, int]]:
    """(path, never main, inside a main element, text, characters of link text) in page order.

    Text in a form is never main, unless the form spans the page, that is, holds parts of its layout.
    """
    html = html or ""
    # name, path, why never main (0: it can be), inside main
    stack: list[tuple[str, str, int, bool]] = []
    opened: Counter[str] = Counter()
    forms, wide = 0, set()  # number of the last form, numbers of those that span the page
    done: list[tuple[str, int, int, bool, str, int]] = []
    now: Block | None = None

    def close() -> None:
        nonlocal now
        if now is not None:
            text = _SPACE.sub(" ", unescape("".join(now.text))).strip()
            if text:
                done.append((now.path, now.level, now.form, now.main, text, min(now.linked, len(text))))
        now = None

    def pop_to(k: int) -> None:
        if any(e[0] not in INLINE for e in stack[k:]):
            close()
        opened.subtract(e[0] for e in stack[k:])
        del stack[k:]

    def add(text: str) -> None:
        nonlocal now
        if not text:
            return
        if stack and stack[-1][0] == "head" and text.strip():
            pop_to(len(stack) - 1)
        path, level, main = stack[-1][1:] if stack else ("", 0, False)
        if now is not None and now.level != level:
            close()
        if now is None:
            now = Block(path, level, main, forms)
        now.text.append(text)
        if opened["a"] > 0:
            now.linked += len(text.strip())

    at, n = 0, len(html)
    while at < n:
        found = _TAG.search(html, at)
        if found is None:
            add(html[at:])
            break
        add(html[at:found.start()])
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            if found[0].startswith("<!--"):
                end = html.find("-->", found.start() + 4)
                at = n if end < 0 else end + 3
            continue
        if found[1]:
            for k in range(len(stack) - 1, -1, -1) if opened[name] > 0 else ():
                if stack[k][0] == name:
                    pop_to(k)
                    break
            continue
        if stack and stack[-1][0] == "head" and name not in IN_HEAD:
            pop_to(len(stack) - 1)  # the end tag may be left out
        if name == "br":
            add(" ")
            continue
        if name in VOID:
            if name == "hr":
                close()
            continue
        attributes = found[3]
        if name in RAW:
            if not attributes.endswith("/>"):
                end = re.compile(rf"</{re.escape(name)}[\s>/]", re.I).search(html, at)
                at = n if end is None else html.find(">", end.start()) + 1 or n
            continue
        if name in BREAKS_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    pop_to(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        elif name in CLOSES:
            other, until = CLOSES[name]
            for k in range(len(stack) - 1, -1, -1) if opened[name] + opened[other] > 0 else ():
                if stack[k][0] in (name, other):
                    pop_to(k)
                    break
                if stack[k][0] in until:
                    break
        path, out, main = stack[-1][1:] if stack else ("", 0, False)
        words: list[str] = []
        never: set[str] = set()
        mark = ""
        for m in _ATTRIBUTE.finditer(attributes):
            value = (m[2] or m[3] or m[4] or "").lower()
            words += _LETTERS.findall(value)
            never |= _not_main(value)
            if m[1].lower() == "class" and value.split():
                mark = "." + value.split()[0]
        inner = main or name in MAIN
        is_main = inner or (name not in INLINE and not NOT_MAIN_WORDS & set(words) and bool(MAIN_WORDS & set(words)))
        if main:
            never -= HEADS
        if name in MAIN and out in (FORM, AROUND_IT):
            out = 0
        if name in NOT_MAIN or _HIDDEN.search(attributes):
            out = OUT
        elif never and name not in ("article", "main", "body", "html"):
            out = max(out, AROUND_IT if never <= AROUND else OUT)
        elif name == "form":
            out = max(out, OUT if main else FORM)
        elif name == "header" and not main:
            out = max(out, AROUND_IT)
        if name not in INLINE:
            close()
            if len(path) > LONG_PATH:
                path = "~" + blake2b(path.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()
            path = f"{path}>{name}{mark}"
        if name == "form":
            forms += 1
        elif name in PAGE_PARTS and opened["form"] > 0:
            wide.add(forms)
        stack.append((name, path, out, is_main))
        opened[name] += 1
    close()
    return [(path, level > (FORM if form in wide else 0), main, text, linked)
            for path, level, form, main, text, linked in done]


# ---- wrappers ---------------------------------------------------------------------------
# A wrapper is a list of slots {name, opt, rep, out, main, pages, chars, linked, same, body}; ``same``
# is the print of the one text all pages put there, ``body`` that of the longest text of all these
# pages, each None if it differs. Pages with one body are copies and tell nothing about a slot.
def _print(text: str) -> str:
    return f"{len(text)}:{blake2b(text.encode('utf-8', 'surrogatepass'), digest_size=8).hexdigest()}"


def page_wrapper(blocks: list[tuple[str, bool, bool, str, int]]) -> list[dict]:
    """The wrapper of one page: neighbours of one name fold into a repeated slot."""
    slots: list[dict] = []
    texts = [text for _, out, _, text, linked in blocks if not out and linked * 2 <= len(text)]
    body = _print(max(texts, key=len, default=""))
    for path, out, main, text, linked in blocks:
        if slots and slots[-1]["name"] == path and slots[-1]["out"] == out:
            last = slots[-1]
            last.update(rep=True, chars=last["chars"] + len(text), linked=last["linked"] + linked, same=None)
        else:
            slots.append({"name": path, "opt": False, "rep": False, "out": out, "main": main, "pages": 1,
                          "chars": len(text), "linked": linked, "same": _print(text), "body": body})
    return folded(slots)


def _joined(a: dict, b: dict) -> dict:
    return a | {"opt": a["opt"] or b["opt"], "rep": a["rep"] or b["rep"], "main": a["main"] or b["main"],
                "pages": a["pages"] + b["pages"], "chars": a["chars"] + b["chars"],
                "linked": a["linked"] + b["linked"], "same": a["same"] if a["same"] == b["same"] else None,
            "body": a["body"] if a["body"] == b["body"] else None}


def folded(slots: list[dict]) -> list[dict]:
    """Sequences that follow themselves, of up to eight slots, become one repeated sequence."""
    for width in range(1, 9):
        k = 0
        while k + 2 * width <= len(slots):
            one, two = slots[k:k + width], slots[k + width:k + 2 * width]
            if [(s["name"], s["out"]) for s in one] == [(s["name"], s["out"]) for s in two]:
                slots[k:k + 2 * width] = [
                    _joined(a, b) | {"rep": True, "pages": max(a["pages"], b["pages"]), "same": None}
                    for a, b in zip(one, two, strict=True)]
            else:
                k += 1
    return slots


def aligned(a: list[dict], b: list[dict]) -> list[dict]:
    """The wrapper of two wrappers: common slots in order, the rest optional."""
    if not a or not b:
        return [s | {"opt": True} for s in a or b]
    key = [[(s["name"], s["out"]) for s in w] for w in (a, b)]
    if key[0] == key[1]:
        return [_joined(x, y) for x, y in zip(a, b, strict=True)]
    out: list[dict] = []
    for what, i, j, k, m in SequenceMatcher(None, *key, autojunk=False).get_opcodes():
        if what == "equal":
            out += [_joined(x, y) for x, y in zip(a[i:j], b[k:m], strict=True)]
        else:
            out += [s | {"opt": True} for s in [*a[i:j], *b[k:m]]]
    return folded(out)


def expression(wrapper: list[dict]) -> str:
    """The wrapper as a regular expression over block names."""
    return " ".join(s["name"] + ("*" if s["opt"] and s["rep"] else "+" if s["rep"] else "?" if s["opt"] else "")
                    for s in wrapper)


def marked(blocks: list[tuple[str, bool, bool, str, int]]) -> bool:
    """Whether the page has text inside an article or main element."""
    return any(main and not out for _, out, main, _, _ in blocks)


def main_slots(wrapper: list[dict], other: list[dict] | None = None) -> set[str]:
    """Names of the blocks that hold main text; ``other`` is the wrapper of the host's marked pages."""
    around = {(s["name"], s["same"]) for s in other or () if not s["main"] and s["same"] is not None}
    kept = [s for s in wrapper if not s["out"]]
    if any(s["main"] for s in kept):
        return {s["name"] for s in kept if s["main"]}
    kept = [s for s in kept if (s["name"], s["same"]) not in around]
    texts = [s for s in kept if s["linked"] * 2 <= s["chars"] and not (s["same"] is not None and s["body"] is None)]
    return {s["name"] for s in texts or kept}


def extracted(blocks: list[tuple[str, bool, bool, str, int]], names: set[str]) -> str:
    return "\n".join(text for path, out, _, text, _ in blocks if not out and path in names)


# ---- on tables ----------------------------------------------------------------------------
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url: Column) -> Column:
    """Lower-case host, empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def _partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[tuple[str, bool], list[dict]] = {}
    for batch in batches:
        for host, html in zip(batch["host"], batch["html"], strict=True):
            blocks = blocks_of(html)
            one, key = page_wrapper(blocks), (host, marked(blocks))
            if one:
                known[key] = aligned(known[key], one) if key in known else one
    yield pd.DataFrame({"host": [h for h, _ in known], "marked": [m for _, m in known],
                        "wrapper": [json.dumps(w) for w in known.values()]}, dtype=object)


def _merged(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    wrapper: list[dict] | None = None
    for text in sorted(rows["wrapper"]):
        one = json.loads(text)
        wrapper = one if wrapper is None else aligned(wrapper, one)
    return pd.DataFrame({"host": [key[0]], "marked": [key[1]], "wrapper": [json.dumps(wrapper)]})


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    slots: dict[tuple, set[str]] = {}
    for batch in batches:
        texts = []
        for html, one, other in zip(batch["html"], batch["with_main"], batch["without"], strict=True):
            blocks = blocks_of(html)
            if not blocks:
                texts.append("")
                continue
            key = (one, None) if marked(blocks) else (other, one)
            if key not in slots:
                slots = {} if len(slots) > 1000 else slots
                slots[key] = main_slots(json.loads(key[0]), json.loads(key[1] or "[]"))
            texts.append(extracted(blocks, slots[key]))
        yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": texts})


def wrappers(pages: DataFrame, salts: int = 32) -> DataFrame:
    """(host, with_main, without): the wrappers of a host's marked and of its other pages, if any."""
    rows = pages.select(host_of(F.col("url")).alias("host"), "html")
    schema = "host string, marked boolean, wrapper string"
    part = rows.mapInPandas(_partial, schema)
    part = part.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts)))
    part = part.groupBy("host", "marked", "salt").applyInPandas(_merged, schema)
    part = part.groupBy("host", "marked").applyInPandas(_merged, schema)
    return part.groupBy("host").agg(F.max(F.when(F.col("marked"), F.col("wrapper"))).alias("with_main"),
                                    F.max(F.when(~F.col("marked"), F.col("wrapper"))).alias("without"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row."""
    found = stored(wrappers(pages), "wrappers")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html",
                        host_of(F.col("url")).alias("host"))
    return rows.join(found, "host", "left").select(
        "page_id", "url", "html", "with_main", "without").mapInPandas(
        _extract, "page_id long, url string, text string")
