"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score zero or more, tags zero or
less; one linear scan finds the contiguous region of the largest total. Weights
are log-odds of "inside the content" counted on labelled pages: pages that mark
their content with an article (or main) element. That mark is the label and no
feature: a key holds "word" or the tag's name, the kind of block around it,
whether it is in a link, and whether an element around it is boilerplate by name,
class or role, all of which pages without a mark have too. Keys that no labelled
page has keep a prior. Leaving or entering a marked region costs MARK words.

Words of boilerplate elements are left out of the region. Names and class words
in the sure lists make an element boilerplate; those that articles use as well
(social, related, header, ...) do so only if half of its words or more are links.

Defined cases: null or empty html and pages without content give an empty text;
unclosed and truncated markup is read as far as it goes; repeated rows are each
extracted; other input columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as _html
import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, workers_find_package

MAX_LABELLED = 2000  #: labelled pages that the weights are counted on
MARK = 40.0

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_HAS_ARTICLE = re.compile(r"<article[\s>/]", re.I)
_HAS_MAIN = re.compile(r"<main[\s>/]", re.I)
_RAW = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "noembed", "noframes", "xmp")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead title tr ul".split()
)
_BOILER = frozenset("aside button datalist dialog footer form head iframe menu nav noscript object script search select style svg template textarea title".split())
_SURE = re.compile(
    r"(?:^|[-_])(?:ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|newsletter|subscri\w+|sidebar|menu|nav|navbar|navigation"
    r"|breadcrumbs?|footer|comments?|commentlist|respond|replies|disqus|popup|modal|pagination|pager|skip)(?:$|[-_])"
)
_MAYBE = re.compile(r"(?:^|[-_])(?:header|masthead|topbar|banner|share|sharing|social|related|recommended|widget|overlay|toolbar|links)(?:$|[-_])")
_NOTICE = frozenset("notice notices alert alerts site-notice cookie-notice notice-bar alert-bar banner-notice".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
_NAMES = _BLOCK | _BOILER | frozenset("a b br em i img input label small span strong sub sup td th u".split())
_KINDS = {n: k for k, names in {"p": "p blockquote pre figcaption dd dt", "li": "li", "cell": "td th tr table tbody thead tfoot caption", "head": "h1 h2 h3 h4 h5 h6 hgroup"}.items() for n in names.split()}


def _boiler(name: str, attrs: str, in_content: bool) -> int:
    """2: boilerplate; 1: if it is mostly links; 0: neither."""
    if name in _BOILER or name == "header" and not in_content:
        return 2
    if "=" not in attrs or name in ("html", "body", "article", "main"):
        return 0
    found = 0
    for k, a, b, c in _ATTR.findall(attrs):
        for x in (a or b or c).lower().split():
            if k.lower() == "role":
                if x in _ROLES:
                    return 2
            elif x in _NOTICE or (_SURE.search(x) and not x.startswith(("no-", "has-", "with-", "without-"))):
                return 2
            elif _MAYBE.search(x):
                found = 1
    return found


class _Open:
    """An open element."""

    __slots__ = ("name", "bad", "maybe", "kind", "link", "content", "marked")

    def __init__(self, name: str, bad: bool, maybe: tuple[int, ...], kind: str, link: bool, content: bool, marked: bool):
        self.name, self.bad, self.maybe, self.kind, self.link, self.content, self.marked = name, bad, maybe, kind, link, content, marked


_ROOT = _Open("", False, (), "div", False, False, False)


def tokens(page: str) -> list[tuple]:
    """(key, words, text, break before it, whether its words are boilerplate, whether the mark is around it). Tags have no text."""
    marker = "article" if _HAS_ARTICLE.search(page) else "main" if _HAS_MAIN.search(page) else ""
    stack: list[_Open] = [_ROOT]
    places: dict[str, list[int]] = {}  # of open elements by name: their depths
    maybe_words: list[list[int]] = []  # of each element that may be boilerplate: words, and words in links
    out: list[tuple] = []  # kind of token, name, words, text, broke, element around it, outermost of its boilerplate
    pos, n, broke = 0, len(page), True

    def put(what: str, words: int, text: str, e: _Open, edge: bool) -> None:
        out.append((what, words, text, broke, e, edge))

    def shut(depth: int) -> None:
        while len(stack) > depth:
            places[stack.pop().name].pop()

    while pos < n:
        m = _TOKEN.search(page, pos)
        end = m.start() if m else n
        if end > pos:
            raw = page[pos:end]
            text = _html.unescape(raw) if "&" in raw else raw
            e, words = stack[-1], len(text.split())
            for k in e.maybe:
                maybe_words[k][0] += words
                maybe_words[k][1] += words * e.link
            put("word", words, text, e, False)
            broke = False
        if not m:
            break
        pos = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attrs = (m[1] or m[4]), (m[3] or m[6] or "")
        if name in _BLOCK:
            broke = True
        known = name if name in _NAMES else "other"
        if closing:
            if not places.get(name):
                continue
            depth = places[name][-1]
            e = stack[depth]
            shut(depth)
            put("mark" if name == marker and e.marked and not stack[-1].marked else "/" + known, 0, "", stack[-1], e.bad and not stack[-1].bad)
            continue
        if name in _BLOCK:  # a block ends an open paragraph, an item the item before
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == "p" or (name == "li" and stack[k].name == "li") or (name in ("dt", "dd") and stack[k].name in ("dt", "dd")):
                    shut(k)
                    break
                if stack[k].name in _BLOCK:
                    break
        e = stack[-1]
        boiler = _boiler(name, attrs, e.content)
        maybe = e.maybe
        if boiler == 1:
            maybe = (*maybe[-7:], len(maybe_words))  # of nested ones the innermost eight decide
            maybe_words.append([0, 0])
        bad = e.bad or boiler == 2
        put("mark" if name == marker and not e.marked else known, 0, "", e, bad and not e.bad)
        if name in ("br", "td", "th", "img", "input"):
            put("blank", 0, " ", e, False)
            broke = False
        if name in _VOID or attrs.endswith("/") and name in ("svg", "path"):
            continue
        if name in _RAW:
            x = _RAW[name].search(page, pos)
            pos = x.start() if x else n
            if x:
                pos = page.find(">", x.end()) + 1 or n
            continue
        places.setdefault(name, []).append(len(stack))
        stack.append(_Open(name, bad, maybe, _KINDS.get(name, "div" if name in _BLOCK else e.kind), e.link or name == "a", e.content or name in ("article", "main", "section"), e.marked or name == marker))
    links = [2 * b >= a and b > 0 for a, b in maybe_words]
    done = []
    for what, words, text, br, e, edge in out:
        drop = e.bad or any(links[k] for k in e.maybe)
        done.append(((what, drop, e.link, e.kind) if what == "word" else (what, drop, edge), words, text, br, drop, e.marked))
    return done


def prior(key: tuple) -> float:
    what, drop, more = key[:3]
    if what == "word":
        return 0.0 if drop else 0.5 if more else 1.0
    if what == "blank":
        return 0.0
    if what == "mark":
        return -MARK
    if more:
        return -2.0  # into boilerplate or out of it
    if drop:
        return -0.02  # within boilerplate: its words are left out anyway
    return -0.1 if what.lstrip("/") in ("p", "b", "i", "em", "strong", "br", "span", "td", "tr", "th", "a") else -0.4


def count_keys(page: str) -> Counter:
    """(key, inside the mark) with words counted one by one; empty if nothing marks the content."""
    found: Counter = Counter()
    if _HAS_ARTICLE.search(page) or _HAS_MAIN.search(page):
        for key, words, _, _, _, marked in tokens(page):
            if key[0] not in ("blank", "mark") and (words or key[0] != "word"):
                found[key, marked] += words or 1
    return found


def fit(counts: Counter) -> dict[tuple, float]:
    """Log-odds by key, smoothed by one count each. Words score from 0 to 1, tags from -2 to just under 0; within boilerplate tags keep their prior."""
    weights = {}
    for key in {k for k, _ in counts}:
        odds = math.log((counts[key, True] + 1) / (counts[key, False] + 1))
        if key[0] == "word":
            weights[key] = max(0.0, min(1.0, odds / 4))
        else:
            weights[key] = prior(key) if key[1] else max(-2.0, min(-0.02, odds))
    return weights


def score_of(found: list[tuple], weights: dict[tuple, float]) -> list[float]:
    """The score of each token; a key that the weights lack is put into them."""
    out = []
    for key, words, *_ in found:
        w = weights.get(key)
        if w is None:
            w = weights[key] = prior(key)
        out.append(w * words if key[0] == "word" else w)
    return out


def best_span(scores: list[float]) -> tuple[int, int]:
    """The contiguous part with the largest total over 0, in one scan; of equal ones the first and shortest. (0, 0) for none."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for k, w in enumerate(scores):
        if total <= 0.0:
            total, start = 0.0, k
        total += w
        if total > best:
            best, span = total, (start, k + 1)
    return span


def extract(page: str | None, weights: dict[tuple, float]) -> str:
    """Text of the best region without boilerplate."""
    found = tokens(page or "")
    first, past = best_span(score_of(found, weights))
    blocks: list[list[str]] = []
    broke = True
    for _, _, text, b, drop, _ in found[first:past]:
        broke = broke or b
        if not text or drop:
            continue
        if broke or not blocks:
            blocks.append([])
            broke = False
        blocks[-1].append(text)
    return "\n\n".join(t for b in blocks if (t := " ".join("".join(b).split())))


def labelled_counts(pages: DataFrame, bound: int = MAX_LABELLED) -> Counter:
    """Counts over at most bound labelled pages, those whose ids hash lowest."""
    sample = bounded_sample(pages.where(F.col("html").rlike("(?i)<(article|main)[\\s>/]")).select("page_id", "html"), ["page_id", "html"], bound).select("html")
    workers_find_package(pages.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in batches:
            for page in b.column(0).to_pylist():
                found.update(count_keys(page))
        rows = [(json.dumps(key), inside, n) for (key, inside), n in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.int64())], ["key", "inside", "n"])

    rows = sample.mapInArrow(count, "key string, inside boolean, n long").groupBy("key", "inside").agg(F.sum("n").alias("n")).collect()  # one row for each key: a few hundred at most
    return Counter({(tuple(json.loads(r["key"])), r["inside"]): r["n"] for r in rows})


def main_text(pages: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html)."""
    weights = fit(labelled_counts(pages, bound))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = dict(weights)
        for b in batches:
            texts = [extract(h.as_py(), own) for h in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    narrow = pages.select("page_id", "url", "html")
    kinds = dict(narrow.dtypes)
    return narrow.mapInArrow(run, f"page_id {kinds['page_id']}, url string, text string, n_chars long")
