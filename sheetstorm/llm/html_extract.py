"""Main text of web pages by equivalence-class template deduction over pages of one host."""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, text_or_empty
from .url_filters import host_and_path

#: Pages of a host that are compared with each other; a host with more is split into groups by hash.
GROUP_PAGES = 48
#: Host rows that are broadcast; more are joined by shuffling.
BROADCAST_ROWS = 100_000

MARKUP = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.DOTALL)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
SPACE = re.compile(r"\s+")
#: Elements whose content is no text of the page.
HIDDEN = frozenset("script style noscript template svg title iframe object canvas select textarea button option".split())
#: Elements that stand inside a line of text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that never hold others.
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold lines of text, and none around a whole article.
LINES = frozenset("p h1 h2 h3 h4 h5 h6 li dl dt dd ul ol pre blockquote table thead tbody tfoot tr td th caption figure figcaption address summary details hr".split())
#: Headings belong to the article around them.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements beside the article by their meaning.
BESIDE = frozenset("nav aside form dialog menu footer".split())
#: Elements around the article by their meaning: a tie-break.
INSIDE = frozenset("article main".split())
#: Words of class, id and role that mark what is beside the article: for elements that do not hold its main slot.
BESIDE_WORDS = frozenset(
    "ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies consent disqus footer form gdpr header login "
    "menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion related replies reply search share sharing sidebar signup skip social "
    "sponsor sponsored subscribe toolbar widget".split()
)
#: Words that say nothing about what an element holds: a class of these and BESIDE_WORDS alone marks what is beside.
PLAIN_WORDS = frozenset("area bar block bottom box container content group head inner item items left link links list main nav page panel post posts primary right row secondary section site slot text title top unit wrap wrapper".split())
#: Rounds in which tokens of one kind are told apart by their place.
ROUNDS = 3
#: Letters from which a text can tell two pages apart.
LONG = 40
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")


@lru_cache(maxsize=10_000)
def _mark(name: str, attributes: str) -> str:
    marks = sorted({w.lower() for x in ATTRIBUTE.finditer(attributes) for w in WORD.findall(x[2] or x[3] or x[4] or "")})
    return f"{name}.{'.'.join(marks)}" if marks else name


class Page:
    """A page as its tokens: tags with their class, and texts between tags; around has the open elements of each, by the place of their tag."""

    def __init__(self, source: str):
        self.tokens: list[str] = []
        self.texts: dict[int, str] = {}
        self.links: set[int] = set()
        self.around: list[tuple[tuple[int, str], ...]] = []
        self.blocks: list[int] = []
        self._read(source)

    def _read(self, source: str) -> None:
        at, block, stack, hidden, link = 0, 0, (), None, False
        for m in MARKUP.finditer(source):
            if hidden and not (m[1] and m[2] and m[2].lower() == hidden):
                continue
            if not hidden:
                self._text(source[at : m.start()], block, stack, link)
            at = m.end()
            if not m[2]:
                continue
            name, closes = m[2].lower(), bool(m[1])
            hidden = None if closes else name if name in HIDDEN and not m[3].rstrip().endswith("/") else None
            if name == "a":
                link = not closes
            mark = name
            if not closes and m[3]:
                mark = _mark(name, m[3])
            if name == "br" and hidden is None:
                self._text(" ", block, stack, link)
            if name not in INLINE:
                block += 1
            if name not in EMPTY and name not in INLINE and name not in HIDDEN:
                if not closes:
                    above = _name(stack[-1][1]) if stack else ""
                    if above == "head" and name == "body" or above == name and name in ("p", "li"):
                        stack = stack[:-1]
                    stack = (*stack, (len(self.tokens), mark))
                else:
                    found = next((i for i in range(len(stack) - 1, -1, -1) if _name(stack[i][1]) == name), None)
                    if found is not None:
                        stack = stack[:found]
            self._add(("</" if closes else "<") + mark, block, stack)
        if not hidden:
            self._text(source[at:], block, stack, link)

    def _add(self, token: str, block: int, stack: tuple) -> None:
        self.tokens.append(token)
        self.blocks.append(block)
        self.around.append(stack)

    def _text(self, piece: str, block: int, stack: tuple, link: bool) -> None:
        if not piece:
            return
        text = SPACE.sub(" ", entities.unescape(piece))
        if link:
            self.links.add(len(self.tokens))
        self.texts[len(self.tokens)] = text
        self._add(f"={text.strip()}" if text.strip() else "", block, stack)


class TokenClass(NamedTuple):
    """Tokens with one occurrence vector, in page order, and the slot of the class around them (None: the root)."""

    tokens: list[str]
    parent: int | None = None
    slot: int = 0


def template(pages: list[Page]) -> list[TokenClass]:
    """Equivalence classes of the pages' tokens, nested: the root first, every other one after the class around it.

    The root class occurs exactly once in every page, in one order. A further class is valid if its
    tokens always follow each other in the same order, round after round, and every round lies within
    one and the same slot of a class that is already valid: the innermost such class is its parent.
    """
    places: dict[str, dict[int, list[int]]] = defaultdict(dict)
    for k, page in enumerate(pages):
        for at, token in enumerate(page.tokens):
            if token:
                places[token].setdefault(k, []).append(at)
    classes: dict[tuple, list[str]] = defaultdict(list)
    for token, own in places.items():
        if len(own) >= max(3, len(pages) // 2):
            classes[tuple((k, len(found)) for k, found in own.items())].append(token)
    once = tuple((k, 1) for k in range(len(pages)))
    valid = [TokenClass(_in_one_order(classes.pop(once, []), pages))]
    slots = [[_slots(valid[0].tokens, page) for page in pages]]
    for _, members in sorted(classes.items(), key=lambda x: sum(n for _, n in x[0])):
        ordered = _rounds(members, [places[t] for t in members]) if len(members) > 1 else None
        if ordered is None:
            continue
        for parent in range(len(valid) - 1, -1, -1):
            found = {slots[parent][k][at] for t in ordered for k, own in places[t].items() for at in own}
            at = next(iter(found)) if len(found) == 1 else 0  # 0: outside of the class
            if at:
                valid.append(TokenClass(ordered, parent, at))
                slots.append([_slots(ordered, page) for page in pages])
                break
    return valid


def _differentiate(bodies: list[Page], pages: list[Page], root: list[str]) -> bool:
    """Tells tokens of one kind apart by their place: slot of the root, depth, and turn. Whether any page got a new name.

    A tag that can hold a whole part of a page, and that stands equally often in a slot and at a depth of every
    body, is another token at each turn: so that a menu, an article and a footer of equal divs are three. Pages
    in which it stands there as often get the same names.
    """

    def stands(page: Page) -> dict[tuple[str, int, int], list[int]]:
        found: dict[tuple[str, int, int], list[int]] = defaultdict(list)
        for at, (token, slot) in enumerate(zip(page.tokens, _slots(root, page), strict=True)):
            if token[:1] == "<" and "#" not in token and _name(token.lstrip("</")) not in LINES | INLINE | EMPTY | HIDDEN:
                found[token, slot, len(page.around[at])].append(at)
        return found

    of_bodies = [stands(page) for page in bodies]
    fixed = set(root)
    same = {key: len(at) for key, at in of_bodies[0].items() if key[0] not in fixed and all(len(other.get(key, ())) == len(at) for other in of_bodies[1:])}
    for page in pages:
        own = stands(page)
        for key, n in same.items():
            if len(own.get(key, ())) == n:
                for turn, at in enumerate(own[key]):
                    page.tokens[at] = f"{key[0]}#{key[1]}.{key[2]}.{turn}"
    return bool(same)


def _rounds(members: list[str], places: list[dict[int, list[int]]]) -> list[str] | None:
    """The order in which the members follow each other in every round of every page; None if there is none."""
    order = None
    for k, first in places[0].items():
        found = [t for _, t in sorted((at, t) for t, own in zip(members, places, strict=True) for at in own[k])]
        order = order or found[: len(members)]
        if found != order * len(first):
            return None
    return order


def _in_one_order(members: list[str], pages: list[Page]) -> list[str]:
    own = set(members)
    orders = [[t for t in page.tokens if t in own] for page in pages]
    first = orders[0] if orders else []
    if any(order != first for order in orders[1:]):
        at = [{t: i for i, t in enumerate(order)} for order in orders]
        kept: list[str] = []
        for token in first:
            if all(not kept or order[kept[-1]] < order[token] for order in at):
                kept.append(token)
        return kept
    return first


def _slots(tokens: list[str], page: Page) -> list[int]:
    """For each token of the page the last token of the class up to it, numbered from 1."""
    number = {t: i + 1 for i, t in enumerate(tokens)}
    slot, out = 0, []
    for token in page.tokens:
        slot = number.get(token, slot)
        out.append(slot)
    return out


def _name(mark: str) -> str:
    return mark.split(".")[0]


@lru_cache(maxsize=10_000)
def _is_beside(mark: str) -> bool:
    """By an element's meaning, or by its class if it is one that can hold whole parts of a page."""
    name, *words = mark.split(".")
    if name in BESIDE:
        return True
    named = any(w in BESIDE_WORDS for w in words) and all(w in BESIDE_WORDS or w in PLAIN_WORDS or len(w) < 3 for w in words)
    return named and name not in INSIDE and name not in LINES and name not in ("body", "html")


def _bodies(pages: list[Page]) -> list[Page]:
    """One page of each body: of pages that share half of the letters of their long texts, the first.

    Near copies of a page would otherwise make their article a template. Where a notice is longer than
    the articles, different pages count as one too; their texts then stay.
    """
    kept: list[tuple[Page, dict[str, int]]] = []
    for page in pages:
        own = {page.tokens[i]: len(page.tokens[i]) for i in page.texts if len(page.tokens[i]) > LONG and not any(_is_beside(m) for _, m in page.around[i])}
        if not any(own and 2 * sum(n for t, n in own.items() if t in other) >= min(sum(own.values()), sum(other.values())) for _, other in kept if other):
            kept.append((page, own))
    return [page for page, _ in kept]


def extract_group(sources: list[str]) -> list[str]:
    """The main text of each page of a group of same-host pages.

    The template is deduced from pages with different bodies, three at least. Its main slot is the one
    with most text outside links in all pages; the main text is what stands in the template's innermost
    element around that slot (an article element around or inside it breaks ties), less other parts of
    the template: elements beside the article, and texts that fill a whole slot of the root alike in
    every page. A page that the template does not fit, or a group without one, goes by its own largest
    element of text in the same way.
    """
    distinct = list(dict.fromkeys(sources))
    if len(distinct) < len(sources):
        return [*map(dict(zip(distinct, extract_group(distinct), strict=True)).get, sources)]
    pages = [Page(s) for s in sources]
    bodies = _bodies(pages)
    classes = template(bodies) if len(bodies) > 2 else [TokenClass([])]
    for _ in range(ROUNDS):
        if not classes[0].tokens or not _differentiate(bodies, pages, classes[0].tokens):
            break
        classes = template(bodies)
    root = classes[0].tokens
    slots = [_slots(root, page) for page in pages]
    letters: dict[int, int] = defaultdict(int)
    for page, places in zip(pages, slots, strict=True):
        for i, text in page.texts.items():
            letters[places[i]] += len(text.strip()) * (i not in page.links)
    main = max(letters, key=lambda s: (letters[s], -s), default=0) if root else None
    rows = frozenset(t for c in classes[1:] if c.parent == 0 and c.slot != main and any(_is_part(t) for t in c.tokens) for t in c.tokens)
    return [_main_text(page, places, main, frozenset(root), rows) for page, places in zip(pages, slots, strict=True)]


def _is_part(token: str) -> bool:
    """Whether a token opens a row of some kind: an element that can hold parts, or one that has a class."""
    name = _name(token[1:].split("#")[0])
    return token[:1] == "<" and token[1:2] != "/" and (name not in LINES | INLINE | EMPTY | HIDDEN or "." in token)


def _weight(page: Page, chosen: list[int]) -> int:
    return sum(len(page.texts[i].strip()) * (i not in page.links) for i in chosen)


def _container(page: Page, inside: list[int], root: frozenset[str]) -> int | None:
    """The place of the innermost element of the template around most of these texts, as a whole part of the page."""
    around: dict[int, int] = defaultdict(int)
    marks: dict[int, str] = {}
    for i in inside:
        for at, mark in page.around[i]:
            around[at] += len(page.texts[i].strip()) * (i not in page.links)
            marks[at] = mark
    most = max(around.values(), default=0)
    holds = [at for at, n in around.items() if n and 2 * n >= most and _name(marks[at]) not in LINES]
    articles = [at for at in holds if _name(marks[at]) == "article"]
    by_name = articles or [at for at in holds if _name(marks[at]) in INSIDE]
    if by_name:
        return max(by_name) if articles else min(by_name)
    fixed = [at for at in holds if page.tokens[at] in root] if root else [at for at in holds if 5 * around[at] >= 4 * most]
    return max(fixed, default=None)


def _own_texts(page: Page, texts: list[int]) -> list[int]:
    """Without a template: the texts that no element beside the article holds, unless it holds the element with most text too."""
    direct: dict[int, int] = defaultdict(int)
    around: dict[int, set[int]] = {}
    for i in texts:
        whole = [(at, mark) for at, mark in page.around[i] if _name(mark) not in LINES]
        if whole and not _is_beside(whole[-1][1]):
            direct[whole[-1][0]] += len(page.texts[i].strip()) * (i not in page.links)
            around[whole[-1][0]] = {at for at, _ in whole}
    held = around[max(direct, key=lambda at: (direct[at], -at))] if direct else set()
    return [i for i in texts if not any(_is_beside(mark) for at, mark in page.around[i] if at not in held or _name(mark) in BESIDE)] or texts


def _main_text(page: Page, places: list[int], main: int | None, root: frozenset[str], rows: frozenset[str] = frozenset()) -> str:
    """rows: the tokens of nested classes that repeat beside the main slot, whose elements are no text of the article."""
    texts = [i for i in page.texts if page.texts[i].strip()]
    inside = [i for i in texts if places[i] == main] if main is not None else []
    if not _weight(page, inside):  # the template has no slot here
        inside, root, rows = _own_texts(page, texts), frozenset(), frozenset()
    container = _container(page, inside, root)
    held = {at for i in inside for at, _ in page.around[i] if container is None or at <= container}

    def belongs(i: int) -> bool:
        around = page.around[i]
        if container is not None and all(at != container for at, _ in around):
            return False
        return not any(beside(at, mark) for at, mark in around if at not in held or (container is None and _name(mark) in BESIDE))

    def beside(at: int, mark: str) -> bool:
        """By its meaning; by its class only if it belongs to the template, or where there is none; by being a row beside the slot."""
        token = page.tokens[at]
        return token in rows or _name(mark) in BESIDE or (_is_beside(mark) and (not root or token in root or token in rows))

    chosen = [i for i in page.texts if belongs(i) and not _fills_a_slot(page, i, root)]
    if not any(page.texts[i].strip() for i in chosen):  # the remaining slots hold nothing
        chosen = [i for i in page.texts if belongs(i)]
    blocks: dict[int, list[str]] = defaultdict(list)
    for i in chosen:
        blocks[page.blocks[i]].append(page.texts[i])
    joined = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n\n".join(x for x in joined if x)


def _fills_a_slot(page: Page, at: int, root: frozenset[str]) -> bool:
    """Whether a text is of the root and stands alone between two tags of the root."""
    if page.tokens[at] not in root:
        return False
    before = next((t for t in reversed(page.tokens[:at]) if t), "")
    after = next((t for t in page.tokens[at + 1 :] if t), "")
    return before in root and after in root and not before.startswith("=") and not after.startswith("=")


def extract_main_text(pages: DataFrame, *, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", group_pages: int = GROUP_PAGES) -> DataFrame:
    """One row per row of pages: page_id, url, text (empty if none), n_chars (its code points).

    Pages are compared with others of their host (that of url_filters), in groups of about group_pages
    pages that a hash of the page chooses; every page is in one group and every group in one task, so
    that a host with a third of all pages spreads over the cluster; which pages a page is compared with
    so rests on the hash, its text only where groups give other templates. Null html is empty; a page without
    url is compared with others without. A host with fewer than three pages has no template: its pages
    rest on their elements alone. Repeated rows are returned as often as they occur.
    """
    host, _ = host_and_path(pages[url_column].cast("string"))
    rows = pages.select(pages[id_column].alias("page_id"), pages[url_column].alias("url"), text_or_empty(pages, html_column).alias("html"), host.alias("host"))
    hosts = durable(rows.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / group_pages).alias("groups")))
    few = hosts.count() <= BROADCAST_ROWS
    page_key = F.xxhash64(F.col("page_id").cast("string"), "url", F.left("html", F.lit(4096)))
    grouped = rows.join(F.broadcast(hosts) if few else hosts, "host").withColumn("group", F.pmod(page_key, F.col("groups")))

    def extract(group: pd.DataFrame) -> pd.DataFrame:
        order = group["html"].map(len).sort_values(kind="stable").index
        group = group.loc[order]
        texts: list[str] = []
        for at in range(0, len(group), 4 * group_pages):  # repeated rows share a hash and could make a group long
            texts += extract_group(group["html"].iloc[at : at + 4 * group_pages].tolist())
        return pd.DataFrame({"page_id": group["page_id"], "url": group["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return grouped.groupBy("host", "group").applyInPandas(extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
