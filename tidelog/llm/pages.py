"""Main text of web pages by the maximum-scoring run of words and tags.

A page becomes a sequence of words and tags. Words score by where they stand (the block around them,
whether they are part of a link, whether the page says they belong to its article), tags score
by their names; the weights are log odds learnt from labelled pages. A linear scan finds the
contiguous run of the highest sum. Elements that are never main text (menus, forms, scripts and such, by name or role) score 0
and are left out of the run; classes that name furniture (adverts, notices, comments) are features with learnt odds.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.runtime import batched, sampled

#: Labelled pages that the weights are learnt from at most, the first by hash, and their greatest length.
FIT_PAGES, FIT_CHARS = 400, 200_000
#: Words from which a text under a class for furniture inside an article is a sentence, and words that its name weighs against it.
SENTENCE_WORDS, PRIOR_WORDS = 12, 20

# Elements by their part in HTML, and words that name page furniture in classes and ids.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "xmp", "noembed", "noframes", "math")
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
FURNITURE = frozenset("nav menu aside footer form button select option dialog search label input fieldset object canvas audio video map datalist output head".split())
WORDS = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar header "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login "
    "comment comments commentlist respond reply replies discussion disqus related recommended recommendations share sharing social "
    "widget widgets pagination pager skip copyright legal search".split()
)
#: Parts of classes that say nothing of their own.
PLAIN_PARTS = frozenset("list lists item items box boxes wrapper wrap container section block area bar inner outer widget buttons button links link posts form slot unit top bottom left right panel group row text thread count icons main site page primary secondary global body author meta date reply".split())
PROSE = frozenset("p blockquote h1 h2 h3 h4 h5 h6 article dd td pre figcaption".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
CLOSES = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}

_RAW = "|".join(RAW)
_PIECE = re.compile(
    r"<!--.*?(?:-->|$)|<(?P<raw>" + _RAW + r")(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>(?:.*?</(?P=raw)\s*>|.*$)"
    r"|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)",
    re.S | re.I,
)
_MARKS = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)

_ARTICLE = re.compile(r"<article(?=[\s/>])((?:[^>\"']|\"[^\"]*\"|'[^']*')*)", re.I)
_PARTS = re.compile(r"[-_]+")

Piece = tuple  # (kind, value): "tag" with (name, hidden, in the article); "text" with (words, feature, shown, block number, classes)


def class_tokens(rest: str) -> tuple[str, ...]:
    """The classes and ids of a tag of which a part is a word for furniture."""
    out = []
    for key, value in _MARKS.findall(rest):
        if key.lower() in ("class", "id"):
            out += [t for t in value.strip("\"'").lower().split() if not WORDS.isdisjoint(_PARTS.split(t))]
    return tuple(out)


def class_prior(token: str) -> float:
    """What a class says where no page was learnt from: against main text if all its parts name furniture, else nothing."""
    return -2.0 if all(w in WORDS or w in PLAIN_PARTS or not w for w in _PARTS.split(token)) else 0.0


def _is_furniture(name: str, rest: str, inside_article: bool) -> bool:
    """Whether an element is never main text by its name, its role, or as the page hides it."""
    if name in FURNITURE or (name == "header" and not inside_article):
        return True
    if rest and ("=" in rest or "hidden" in rest):
        for key, value in _MARKS.findall(rest):
            key, value = key.lower(), value.strip("\"'").lower()
            if key == "role" and value in ROLES or key == "hidden" and not value or key == "aria-hidden" and value == "true":
                return True
            if key == "style" and re.search(r"display\s*:\s*none", value):
                return True
    return False


def article_names(page: str) -> tuple[str, ...]:
    """The elements that mark a page's article: article, unless all of them are called furniture; without any, main."""
    found = [class_tokens(m[1]) for m in _ARTICLE.finditer(page)]
    return ("article",) if any(all(class_prior(t) == 0 for t in tokens) for tokens in found) else ("main",)


def pieces(page: str) -> Iterator[Piece]:
    """The page as tags and stretches of text, in order."""
    stack: list[tuple[str, bool, tuple, bool]] = []  # open elements: whether one is furniture, its classes for furniture, whether it marks the article
    hidden = links = articles = block = 0
    at, near, named, classes = 0, "body", article_names(page), ()

    def pop_to(i: int) -> None:
        nonlocal hidden, links, articles, near, classes
        for name, furniture, _, marks in stack[i:]:
            hidden -= furniture
            links -= name == "a"
            articles -= marks
        changed = any(tokens for _, _, tokens, _ in stack[i:])
        del stack[i:]
        near = next((x[0] for x in reversed(stack) if x[0] in BLOCK), "body")
        if changed:
            classes = tuple(t for x in stack for t in x[2])

    def text(s: str) -> Iterator[Piece]:
        if s:
            yield "text", (s, (near, links > 0, articles > 0), not hidden, block, classes)

    for m in _PIECE.finditer(page):
        if m.start() > at:
            yield from text(page[at : m.start()])
        at = m.end()
        if m["raw"]:
            yield from text(" ") if m["raw"].lower() not in ("title",) else ()
            continue
        if not m["name"]:
            if m[0].startswith("<![CDATA["):
                yield from text(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        name, end, rest = m["name"].lower(), bool(m["end"]), m["rest"]
        if name in BLOCK:
            block += 1
        if name == "br":
            yield from text(" ")
        inside = articles > 0  # a tag belongs to what is around its element
        if end:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    shut = hidden > 0
                    pop_to(i)
                    yield "tag", (name, shut, articles > 0)
                    break
                if stack[i][0] in ("article", "main", "body", "table") and name not in ("body", "html", "article", "main", "section", "div", "table"):
                    yield "tag", (name, hidden > 0, inside)
                    break
            else:
                yield "tag", (name, hidden > 0, inside)
            continue
        yield "tag", (name, hidden > 0, inside)
        if name in VOID or rest.endswith("/") and name not in BLOCK:
            continue
        for i in range(len(stack) - 1, -1, -1):
            open_ = stack[i][0]
            if name in CLOSES.get(open_, ()):
                pop_to(i)
            elif open_ in BLOCK:
                break
        tokens = class_tokens(rest) if "=" in rest and name not in ("html", "body", "main") else ()
        if articles:
            tokens = tuple(t for t in tokens if "header" not in t)
        marks = name in named and not any(class_prior(t) < 0 for t in tokens)
        furniture = _is_furniture(name, rest, articles > 0)
        stack.append((name, furniture, tokens, marks))
        classes += tokens
        hidden += furniture
        links += name == "a"
        articles += marks
        if name in BLOCK:
            near = name
    if at < len(page):
        yield from text(page[at:])


class Weights:
    """Log odds of words by their place, of tags by their name, of classes for furniture, and where none is known."""

    def __init__(self, words: dict, tags: dict, classes: dict | None = None):
        self.words, self.tags, self.classes = words, tags, classes or {}

    def word(self, near: str, link: bool, article: bool, marked: bool) -> float:
        keys = [(near, link, article)] if marked else []
        keys += [(near, link, None)]
        if link and near in PROSE and not any(k in self.words for k in keys):
            return max(-0.5, 0.3 * self.word(near, False, article, marked))  # a link in running text
        keys += [(None, link, None)]
        return next((self.words[k] for k in keys if k in self.words), -1.0 if link else 0.5)

    def tag(self, name: str) -> float:
        return self.tags.get(name, -0.3)

    def classed(self, tokens: tuple[str, ...]) -> float:
        """What the classes around a word say: the sum of theirs, 0 where there are none."""
        return sum(self.classes[t] if t in self.classes else class_prior(t) for t in set(tokens)) if tokens else 0.0

    def left_out(self, tokens: tuple[str, ...]) -> bool:
        """Whether classes speak so much against a text (an advert or a comment, say) that it is left out of a run around it."""
        return bool(tokens) and self.classed(tokens) <= -1

    def text(self, value: tuple, marked: bool) -> float:
        """The score of a stretch of text; none for what a run that holds it leaves out."""
        string, (near, link, article), shown, _, tokens = value
        n = len(string.split()) if shown and not self.left_out(tokens) else 0
        if not n:
            return 0.0
        own = self.word("article" if near in ("article", "main") else near, link, article, marked)
        classed = self.classed(tokens)
        return n * (min(own, 0.0) + classed if classed < 0 else own)


def learn(labelled: list[tuple[str, bool]] | list[str]) -> Weights:
    """Weights from pages whose article (or main, without one) is the label: what lies in it is main text.

    A class for furniture counts for main text where sentences stand under it inside the article, and against it elsewhere;
    short texts under it inside the article count for neither.
    """
    words: dict[tuple, Counter] = {}
    tags: dict[str, Counter] = {}
    classes: dict[str, Counter] = {}

    def odds(c: Counter) -> float:
        return math.log((c[True] + 1) / (c[False] + 1))

    parted = [list(pieces(page)) for page in labelled]
    for parts in parted:
        for kind, value in parts:
            n = len(value[0].split()) if kind == "text" and value[4] and value[2] else 0
            for t in set(value[4]) if n and (n >= SENTENCE_WORDS or not value[1][2]) else ():
                classes.setdefault(t, Counter())[value[1][2]] += n
    found = Weights({}, {}, {t: max(-3.0, min(0.0, odds(c + Counter({False: PRIOR_WORDS if class_prior(t) else 0})))) for t, c in classes.items()})
    for parts in parted:
        for kind, value in parts:
            if kind == "tag":
                name, hidden, inside = value
                tags.setdefault(name, Counter())[inside and not hidden] += 1
                continue
            string, (near, link, article), shown, _, tokens = value
            if article and found.left_out(tokens):
                continue
            own = "article" if near in ("article", "main") else near
            for k in ((own, link, article), (own, link, None), (None, link, None)):
                words.setdefault(k, Counter())[article and shown] += len(string.split())
    found.words = {k: max(-3.0, min(3.0, odds(c))) for k, c in words.items() if sum(c.values())}
    found.tags = {k: max(-1.0, min(-0.05, odds(c) / 3)) for k, c in tags.items()}
    return found


def extract(page: str | None, weights: Weights) -> str:
    """The page's main text: blocks joined by an empty line, words in a block by a space.
    """
    if not page:
        return ""
    parts = list(pieces(page))
    marked = any(k == "text" and v[1][2] and v[2] and not v[0].isspace() for k, v in parts)
    best, best_range, total, start = 0.0, None, 0.0, 0
    for i, (kind, value) in enumerate(parts):
        if kind == "tag":
            total += weights.tag(value[0]) if not value[1] else 0.0
        else:
            total += weights.text(value, marked)
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, best_range = total, (start, i + 1)
    if best_range is None:
        return ""
    blocks: dict[int, list[str]] = {}
    for kind, value in parts[slice(*best_range)]:
        if kind == "text" and value[2] and not weights.left_out(value[4]):
            blocks.setdefault(value[3], []).append(value[0])
    joined = (" ".join(html.unescape("".join(b)).split()) for b in blocks.values())
    return "\n\n".join(b for b in joined if b)


def train(pages: DataFrame, limit: int = FIT_PAGES) -> Weights:
    """Weights from at most `limit` pages that mark their article themselves, the first by a hash of page and key."""
    marked = pages.where(F.col("html").rlike("(?i)<(article|main)[\\s>]") & (F.length("html") <= FIT_CHARS))
    rows = sampled(marked, limit, marked.count(), "page_id", "html").select("__h", "html").orderBy("__h", "html").limit(limit).collect()
    return learn([r["html"] for r in rows])


def main_text(pages: DataFrame, weights: Weights) -> DataFrame:
    """page_id, url, text and n_chars (code points) for each row of pages (page_id, url, html).

    The whole html is read. A null or empty page, or one without main text, has the empty text; unclosed and
    misplaced tags are taken as browsers do, roughly. Rows that repeat are kept, other columns are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    def scan(batches):
        for b in batches:
            text = [extract(x, shared.value) for x in b.column(2).to_pylist()]
            yield pa.record_batch({"page_id": b.column(0), "url": b.column(1), "text": pa.array(text, pa.string()), "n_chars": pa.array([len(t) for t in text], pa.int64())})

    kind = pages.schema["page_id"].dataType.simpleString()
    return batched(pages.select("page_id", "url", "html")).mapInArrow(scan, f"page_id {kind}, url string, text string, n_chars long")
