"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of tokens: words and tags.  Words score positive, tags
negative, and a menu, form, advert or the like is one negative token;
one linear scan finds the contiguous run of tokens with the highest sum, which
is the content region.  The text of the region, without what such elements
hold, is the page's main text.

The weights are log-odds of a token's kind inside and outside the article on
labelled pages: pages whose markup names their article (one ``article`` or
``main`` element).  They are counted on at most ``train_pages`` pages, those
with the smallest hash of their id, and shrunk towards fixed weights, which
alone hold for kinds that no labelled page has.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(("address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul").split())
ASIDE = frozenset("nav aside footer form button menu dialog fieldset label legend input".split())
ASIDE_WORDS = frozenset(("ad ads adv advert adverts advertisement advertising banner sponsor sponsored sponsors promo promoted promotion "
                         "nav navbar navigation menu breadcrumb breadcrumbs sidebar sidebars aside widget footer header masthead topbar "
                         "cookie cookies consent gdpr notice notices notification alert popup modal overlay paywall newsletter subscribe subscription signup login "
                         "comment comments reply replies respond disqus share sharing social related recommended recommendations toolbar skip pagination pager "
                         "search copyright legal disclaimer").split())
#: Blocks that an article's own text is made of.
PROSE = frozenset("p br h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre header figure figcaption table thead tbody tfoot tr td th".split())
COMMENT_WORDS = frozenset("comment comments reply replies respond disqus related recommended ad ads advert promo sponsored teaser".split())
#: What is called by an aside word and one of these after it is that aside: a "share-bar", but not a "search-history".
HOLDERS = frozenset(("area bar block body box btn button buttons card cell column container content element form frame group heading holder icon icons image inner input item items label layer "
                     "left link links list main module panel posts region right row section slot stories text title top unit wrap wrapper").split())
#: A word after one of these says what an element has or lacks, not what it is.
NOT_ITSELF = frozenset("has with no without".split())
#: Implied ends: a new element of these names ends an open one of the same group.
ENDS = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
#: Scores where labelled pages say nothing: a word, a stretch that is set aside, a tag, an inline tag.
WORD, ASIDE_WORD, TAG, INLINE = 1.0, -2.0, -2.0, -0.3
#: The furthest that labelled pages move a weight from 0.
MOST = 4.0

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>script|style|noscript|template|title|textarea|svg|math|iframe|object|select|canvas|audio|video)"
    r"\b(?>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)|[^>]*)>|<[!?][^>]*>|(?P<text>[^<]+|<)", re.S | re.I)
_PLAIN = re.compile(r"[^<]+|<")
_NAMED = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


def _unclosed(m: re.Match) -> bool:
    """Whether a comment or an element of raw text goes on to the end of the page."""
    found = m.group()
    if found.startswith("<!--"):
        return not found.endswith("-->") or len(found) < 7
    if found[:9].lower() == "<![cdata[":
        return not found.endswith("]]>")
    return bool(m["raw"]) and not re.search(rf"</{m['raw']}\s*>\Z", found, re.I)


def sets_aside(name: str, attrs: str) -> bool:
    """Whether an element's name, class, id or role says that it is not part of an article."""
    if name in ASIDE:
        return True
    if "=" not in attrs or name in ("html", "body"):
        return False
    words = COMMENT_WORDS if name in ("article", "main") else ASIDE_WORDS
    for m in _NAMED.finditer(attrs):
        for part in next(filter(None, m.groups()), "").split():
            said = [w.lower() for w in _SPLIT.split(part) if w]
            # From the end: the last word says what it is, unless it only holds what the word before says.
            k = len(said) - 1
            while k > 0 and said[k] in HOLDERS and said[k] not in words:
                k -= 1
            if k >= 0 and said[k] in words and (k == 0 or said[k - 1] not in NOT_ITSELF):
                return True
    return False


def tokens(page: str) -> list[tuple[str, str, bool]]:
    """``(kind, text, inside)``: of a tag its name and no text, of a run of words ``"=" + element`` and the
    run.  ``inside`` tells whether an article or main element is open.  Whatever is set aside is one token ``"-"``
    for each stretch, without text; if the page names an article, so are words outside it.
    """
    stack: list[tuple[str, int, bool]] = []  # name, whether something above is set aside, whether it is an article
    places: dict[str, list[int]] = {}  # by name, where it is in the stack
    blocks: list[int] = []  # where blocks are in the stack
    around: list[int] = []  # where blocks and links are in the stack
    out: list[tuple[str, str, bool]] = []
    aside, inside, named = 0, 0, False

    def close(k: int) -> None:
        nonlocal aside, inside
        aside = stack[k][1]
        for n, _, i in stack[k:]:
            inside -= i
            places[n].pop()
        del stack[k:]
        for open_ in (blocks, around):
            while open_ and open_[-1] >= k:
                open_.pop()

    def put(kind: str, text: str) -> None:
        if aside:
            if not out or out[-1][0] != "-":
                out.append(("-", "", inside > 0))
        else:
            out.append((kind, text, inside > 0))

    def word(text: str) -> None:
        if text.isspace():
            put(" ", " ")
        else:
            put("=" + (stack[around[-1]][0] if around else ""), text)

    # Behind the last ">" nothing but text and an unclosed comment can come; tags are not looked for there.
    head = page.rfind(">") + 1
    last = None
    for m in _TOKEN.finditer(page, 0, head):
        last = m
        text = m["text"]
        if text is not None:
            word(text)
            continue
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["end"]:
            if not places.get(name):  # closes nothing
                put(" ", " ")
            else:
                put("/" + name, "")
                close(places[name][-1])
            continue
        if name in ENDS and stack:
            # Of the nearest block and what is open within it.
            k = max((places[n][-1] for n in ENDS[name].split() if places.get(n)), default=-1)
            if k >= (blocks[-1] if blocks else 0):
                close(k)
        put(name, "")
        if name not in VOID and not m["attrs"].endswith("/"):
            off = sets_aside(name, m["attrs"]) or (name == "header" and not inside)
            article = name in ("article", "main") and not off
            places.setdefault(name, []).append(len(stack))
            if name in BLOCK:
                blocks.append(len(stack))
            if name in BLOCK or name == "a":
                around.append(len(stack))
            stack.append((name, aside, article))
            # An article is one wherever it stands; a nested one is what its surroundings are.
            aside = 0 if article and not inside else aside + off
            inside, named = inside + article, named or article
    if not (last and last.end() == head and _unclosed(last)):
        rest = page[head:]
        hidden = min((i for mark in ("<!--", "<![cdata[") if (i := rest.lower().find(mark)) >= 0), default=len(rest))
        for text in _PLAIN.findall(rest[:hidden]):
            word(text)
    if named and any(i and k[0] == "=" for k, _, i in out):
        out = [("-", "", i) if k[0] == "=" and not i else (k, t, i) for k, t, i in out]
    return out


def default(kind: str) -> float:
    if kind == " ":
        return 0.0
    if kind[0] in "=-":
        return ASIDE_WORD if kind == "-" else WORD
    return TAG if kind.lstrip("/") in BLOCK and kind.lstrip("/") not in PROSE else INLINE


def fitted(inside: Counter, outside: Counter, shrink: float = 20.0) -> dict[str, float]:
    """Log-odds by kind, shrunk to the fixed weights; words stay positive, tags and what is set aside negative."""
    n_in, n_out = sum(inside.values()), sum(outside.values())
    out = {}
    if not n_in or not n_out:
        return out
    for kind in {*inside, *outside} - {" "}:
        seen = inside[kind] + outside[kind]
        odds = log((inside[kind] + 0.5) / n_in) - log((outside[kind] + 0.5) / n_out)
        value = (seen * odds + shrink * default(kind)) / (seen + shrink)
        out[kind] = min(MOST, max(0.05, value)) if kind[0] == "=" else max(-MOST, min(-0.05, value))
    return out


def count(page: str) -> tuple[Counter, Counter]:
    """Tokens by kind inside and outside the article; none if the page does not name one."""
    got = Counter(), Counter()
    for kind, text, inside in tokens(page):
        got[not inside][kind] += len(text.split()) if kind[0] == "=" else 1
    return got if got[0] else (Counter(), Counter())


def main_text(page: str, weights: dict[str, float]) -> str:
    """The text of the best contiguous region: the first of equal ones, the shortest of those; empty if no region scores above 0."""
    seq = tokens(page)
    best = (0.0, 0, 0)
    total, start = 0.0, 0
    for i, (kind, text, _) in enumerate(seq):
        w = weights.get(kind)
        if w is None:
            w = default(kind)
        total += w * len(text.split()) if kind[0] == "=" else w
        if total > best[0] + 1e-9:
            best = (total, start, i + 1)
        if total <= 0:
            total, start = 0.0, i + 1
    out = []
    for kind, text, _ in seq[best[1]:best[2]]:
        if kind[0] == "=" or kind == " ":
            out.append(html.unescape(text) if "&" in text else text)
        elif kind[0] != "-" and kind.lstrip("/") in BLOCK:
            out.append("\n")
    return " ".join("".join(out).split())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = Counter(), Counter()
    for batch in batches:
        for page in batch.column(0):
            for t, c in zip(total, count(page.as_py()), strict=True):
                t.update(c)
    kinds = sorted({*total[0], *total[1]})
    yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), *(pa.array([t[k] for k in kinds], pa.int64()) for t in total)], ["kind", "inside", "outside"])


def train(pages: DataFrame, train_pages: int = 2_000, page_id: str = "page_id", page: str = "html") -> dict[str, float]:
    """Weights by kind of token, from at most ``train_pages`` pages; at most 1000 kinds, the most frequent."""
    rows = pages.filter(F.col(page).isNotNull()).select(F.col(page).cast("string").alias("html"), F.xxhash64(page_id).alias("order"))
    # The ids are found first, so that only chosen pages' text is moved.
    edge = rows.select("order").orderBy("order").limit(train_pages).agg(F.max("order")).first()[0]
    if edge is None:
        return {}
    rows = rows.filter(F.col("order") <= edge).select("html")
    kinds = rows.mapInArrow(_count, "kind string, inside long, outside long").groupBy("kind").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    got = kinds.orderBy(F.desc(F.col("inside") + F.col("outside")), "kind").limit(1000).collect()
    return fitted(Counter({r.kind: r.inside for r in got}), Counter({r.kind: r.outside for r in got}))


def extract(pages: DataFrame, weights: dict[str, float], page: str = "html", out: str = "text") -> DataFrame:
    """``pages`` without the column ``page`` and with ``out``, its main text; a null or empty page gives an empty text.

    Other columns stay as they are, so their names must differ from ``out``.
    """
    others = [c for c in pages.columns if c != page]
    if out in others:
        raise ValueError(f"the table has a column {out}; name another")
    schema = pages.select(*others, F.lit("").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(p.as_py() or "", weights) for p in batch.column(len(others))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], [*others, out])
    return pages.select(*others, F.col(page).cast("string").alias("html" if "html" not in others else page)).mapInArrow(run, schema)
