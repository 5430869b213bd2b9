"""Main text of web pages by a maximum-scoring run of tokens.

A page is a row of tokens: words score above zero, tags below.  The run of
tokens with the largest sum (one linear scan) is the content region: text that
tags hardly interrupt outweighs menus, which are all tags.

Weights come from labelled pages: pages that mark their main text themselves
with ``article`` or ``main`` say how often every tag stands inside, which weighs
the tag, and how many words stand inside below every kind of element (``nav`` and
the like, words of class and id, role), which weighs the words there: below an
element whose words are mostly no main text they score nothing and are left out of
the region as well.  A weight is the logarithm of odds.  The marks
are labels for fitting only; a page's text is found without them, marked or not.

What labelled pages hardly show is judged as pages usually are built
(``USUALLY_APART``): menus, headers, footers, sidebars, notices, adverts, forms,
comments.  For adverts and the like (``NEVER_MAIN``) no label counts: they stand
in articles, too, but are not of them.  Scripts, styles, hidden parts and markup
never are text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Pages that weights are learned from, in expectation; picked by a hash of the page.  Tags and kinds that a model keeps.
SAMPLE_PAGES, MOST_KINDS = 2000, 4000
#: Occurrences that a tag needs for a weight of its own, and words that a kind of element needs.
LEAST_SEEN = 50
WORD = "#word"
DEFAULT_WEIGHTS = {WORD: 1.0, "": -3.0, "p": -0.5, "br": -0.5, "b": -0.2, "i": -0.2, "em": -0.2, "strong": -0.2, "a": -4.0, "li": -3.0}
#: Below this weight of a kind of element its words are no main text; what unseen usual kinds weigh; words that count against them.
APART, UNSEEN, DOUBT = -1.0, -4.0, 20

#: Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCKS - {"br", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "summary", "head", "html", "body", "title"}
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCES = frozenset("ul ol menu dl table article section div aside main body nav footer header form".split())
FORMATTING = frozenset("a b big code em font i s small strike strong tt u span".split())

NO_TEXT = frozenset(
    "script style noscript template head select input textarea iframe svg object title canvas audio video noembed noframes "
    "datalist button".split()
)
APART_TAGS = frozenset("nav header footer aside form dialog menu".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar alert".split())
NEVER_MAIN = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|aside|related|recommend\w*|"
    r"cookies?|consent|gdpr|popup|modal|newsletter|subscribe|sharing|social|comments?|disqus|replies"
)
USUALLY_APART = re.compile(
    r"side|widget|footer|header|masthead|notice|overlay|signup|login|share|reply|respond|toc|pager|pagination|skip|search|toolbar|legal"
)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: A quote after an equals sign runs to its partner or to the end; other quotes mean nothing. Every "<" plus letter is a tag.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)|([^\s=\"'>/]+)", re.S)
_SPACE = re.compile(r"\s+")
_NAME_END = re.compile(r"[\s_-]+")
_MAIN = frozenset(("article", "main"))


def _attributes(text: str) -> dict[str, str]:
    return {(m[1] or m[3]).lower(): html.unescape((m[2] or "").strip("\"'")) for m in _ATTRIBUTE.finditer(text)}


def _kinds(tag: str, attributes: dict[str, str]) -> tuple[str, ...]:
    """The kinds of an element: its tag where that stands for a part of a page, the words of its class and id, its role.

    ``article`` and ``main`` are labels; other tags hold whatever there is.
    """
    kinds = [f"tag {tag}"] if tag in APART_TAGS else []
    words = _NAME_END.split(f"{attributes.get('class', '')} {attributes.get('id', '')}".lower())
    kinds += [f"name {w}" for w in dict.fromkeys(words) if w]
    if role := attributes.get("role", "").strip().lower():
        kinds.append(f"role {role}")
    return tuple(kinds)


def _usual(kind: str) -> str | None:
    """``never`` or ``apart`` for kinds of elements that usually hold no main text."""
    what, _, word = kind.partition(" ")
    if what == "name":
        return "never" if NEVER_MAIN.fullmatch(word) else "apart" if USUALLY_APART.fullmatch(word) else None
    return "apart" if word in (APART_TAGS if what == "tag" else APART_ROLES) else None


def _invisible(tag: str, attributes: dict[str, str]) -> bool:
    return tag in NO_TEXT or "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(HIDDEN.search(attributes.get("style", "")))


def _weight_of(kind: str, weights: dict[str, float]) -> float:
    usual = _usual(kind)
    return UNSEEN if usual == "never" else weights.get(kind, UNSEEN if usual else 0.0)


def tokens(page: str, weights: dict[str, float]) -> Iterator[tuple[str, str, float, bool, list]]:
    """(kind, value, weight, main, open): kind ``tag`` with its name, ``text`` with its text, ``end`` with its name.

    ``weight``: the least one of the elements around it, minus infinity where nothing
    is text; ``main``: inside ``article`` or ``main``; ``open``: the kinds of the open
    elements, as the list stands at that moment.
    """
    stack: list[tuple[str, tuple[str, ...], float]] = []
    known: dict[tuple[str, str], tuple[tuple[str, ...], float]] = {}
    low, inside = 0.0, 0
    at, size = 0, len(page)

    def pop(n: int) -> Iterator[tuple[str, str, float, bool, list]]:
        nonlocal low, inside
        while len(stack) > n:
            yield "end", stack[-1][0], low, inside > 0, stack
            name, _, _ = stack.pop()
            low = stack[-1][2] if stack else 0.0
            inside -= name in _MAIN

    while at < size:
        m = _TOKEN.search(page, at)
        start = m.start() if m else size
        if start > at:
            yield "text", html.unescape(page[at:start]), low, inside > 0, stack
        if not m:
            break
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                yield "text", m[0][9:].removesuffix("]]>"), low, inside > 0, stack
            continue
        tag = m[2].lower()
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None and not (tag in FORMATTING and any(s[0] in FENCES for s in stack[depth:])):
                yield from pop(depth)
            elif tag in BLOCKS:
                yield "end", tag, low, inside > 0, stack
            continue
        if tag in CLOSES_P:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in ("p", *FENCES)), None)
            if depth is not None and stack[depth][0] == "p":
                yield from pop(depth)
        if tag in SELF_CLOSING:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in SELF_CLOSING[tag] or stack[i][0] in FENCES), None)
            if depth is not None and stack[depth][0] in SELF_CLOSING[tag]:
                yield from pop(depth)
        if (tag, m[3]) not in known:
            attributes = _attributes(m[3]) if m[3].strip() else {}
            kinds = _kinds(tag, attributes)
            known[tag, m[3]] = kinds, -math.inf if _invisible(tag, attributes) else min((_weight_of(k, weights) for k in kinds), default=0.0)
        kinds, weight = known[tag, m[3]]
        before, low = low, min(low, weight)
        inside += tag in _MAIN
        yield "tag", tag, low, inside > 0, stack
        if tag in RAW:
            close = re.compile(f"</{tag}\\s*>", re.I).search(page, at)
            at = close.end() if close else size
        if tag in VOID or tag in RAW:
            low = before
            inside -= tag in _MAIN
        else:
            stack.append((tag, kinds, low))


def best_run(scores: list[float]) -> tuple[int, int]:
    """First and last + 1 of the run with the largest sum; the earliest and longest of equal ones, empty if none is above 0."""
    best, run = 0.0, 0.0
    begin = low = high = 0
    for i, score in enumerate(scores):
        if run < 0:
            run, begin = 0.0, i
        run += score
        if run > best or (run == best and best > 0 and begin == low):
            best, low, high = run, begin, i + 1
    return low, high


def extract(page: str | None, weights: dict[str, float]) -> str:
    """Main text of one page, blocks joined by a line feed; empty for null and for pages without text."""
    parts = [(kind, value, low) for kind, value, low, _, _ in tokens(page or "", weights)]
    other = weights.get("", DEFAULT_WEIGHTS[""])
    scores = []
    for kind, value, low in parts:
        # A part that is left out, an advert between two paragraphs, say, does not end the run either.
        if low < APART or kind == "end":
            scores.append(0.0)
        elif kind == "text":
            scores.append(len(value.split()) * weights[WORD])
        else:
            scores.append(weights.get(value, other))
    first, last = best_run(scores)
    blocks: list[list[str]] = [[]]
    for kind, value, low in parts[first:last]:
        if kind == "text":
            if low >= APART:
                blocks[-1].append(value)
        elif value in BLOCKS:
            blocks.append([])
    lines = (_SPACE.sub(" ", "".join(b)).strip() for b in blocks)
    return "\n".join(line for line in lines if line)


def count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pages that mark their main text: how often tags, and words below kinds of elements, stand inside and outside of it."""
    counts: Counter = Counter()
    for batch in batches:
        for page in batch.column(0):
            own: Counter = Counter()
            marked = False
            for kind, value, low, main, around in tokens(page.as_py() or "", {}):
                marked = marked or main
                if low == -math.inf:
                    continue
                if kind == "text":
                    n = len(value.split())
                    own[WORD, main] += n
                    for k in {k for _, kinds, _ in around for k in kinds}:
                        own[k, main] += n
                elif kind == "tag":
                    own[value, main] += 1
            if marked:
                counts.update(own)
    keys = list(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in keys], pa.string()), pa.array([g for _, g in keys], pa.bool_()), pa.array([counts[k] for k in keys], pa.int64())],
        ["token", "good", "n"],
    )


def weights_from(seen: Counter) -> dict[str, float]:
    """Log odds of standing in the main text: of tags, shifted so that words score above and tags below zero, and
    of the words below kinds of elements, against those of all words."""
    if not seen[WORD, True]:
        return dict(DEFAULT_WEIGHTS)
    odds = lambda t, doubt=1: math.log((seen[t, True] + 1) / (seen[t, False] + doubt))
    word = max(odds(WORD), 1.0)
    enough = {t for t, _ in seen if t != WORD and seen[t, True] + seen[t, False] >= LEAST_SEEN}
    tags = {t: max(-8.0, min(-0.1, odds(t) - word)) for t in enough if " " not in t}
    kinds = {t: max(-8.0, min(8.0, odds(t, DOUBT if _usual(t) else 1) - odds(WORD))) for t in enough if " " in t}
    return {**DEFAULT_WEIGHTS, **tags, **kinds, WORD: 1.0}


def learn_weights(pages: DataFrame, text: str = "html", sample_pages: int = SAMPLE_PAGES) -> dict[str, float]:
    """Weights of tags and kinds of elements, fitted on a bounded sample of pages; only counts reach the driver."""
    rows = pages.select(F.col(text).alias("html")).filter("html IS NOT NULL")
    total = rows.count()
    if not total:
        return dict(DEFAULT_WEIGHTS)
    sample = rows.filter(F.pmod(F.xxhash64("html"), F.lit(1 << 30)) < int(min(1.0, sample_pages / total) * (1 << 30)))
    counts = sample.mapInArrow(count_tokens, "token string, good boolean, n long").groupBy("token", "good").agg(F.sum("n").alias("n"))
    # Kinds seen on the sampled pages; names made up for one page are too rare to be kept.
    told = counts.filter(F.col("n") >= LEAST_SEEN // 2).orderBy(F.desc("n"), "token", "good").limit(MOST_KINDS).collect()
    return weights_from(Counter({(r["token"], r["good"]): r["n"] for r in told}))


def extract_pages(pages: DataFrame, html_column: str = "html", out: str = "text", weights: dict[str, float] | None = None) -> DataFrame:
    """Add the main text of each page; a column of that name is replaced, others and repeated rows are kept.

    Null, empty and textless pages give an empty text; broken markup is read to
    its end.  Without ``weights`` they are learned from the pages themselves.
    """
    scores = learn_weights(pages, html_column) if weights is None else weights

    def texts(column: pa.Array) -> pa.Array:
        return pa.array([extract(x.as_py(), scores) for x in column], pa.string())

    return pages.withColumn(out, F.arrow_udf(texts, "string")(html_column))
