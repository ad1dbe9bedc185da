"""Main text of web pages as the region of highest score.

A page is a sequence of words and tags. Every word has a positive score, every tag a negative one, and a linear
scan finds the contiguous region of highest sum. The scores come from labelled pages: the share of a tag's words
that belong to the content against the share of all words, as a log-odds. Pages with exactly one <article> or
<main> label themselves; a page without takes the weights learned from those. Elements that the labelled pages do not show have
the scores of a prior that states what HTML and common class names mean.

A word counts with the least score of the elements it stands in, so words of a menu or of reader comments are
negative also inside the region; such words are no text. Class names of html, body, main and article, and of the elements
around the content, describe the page and not their words: they do not count.
"""

from __future__ import annotations

import html
from collections import Counter
from collections.abc import Iterator
from math import log

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litevidence.llm.common import hash_sample

TRAINING_PAGES = 2000     # labelled pages that the weights are fitted on, about so many at most
TRAINING_LENGTH = 500_000 # characters of such a page, at most
TRAINING_DEPTH = 500      # of elements, of a training page at most
WORD = 1.0                # score of a word without other evidence
TAG = -0.4                # score of a tag without other evidence
LIMIT = 6.0               # largest size of a word's score, that of the words of an article
EDGE = -40.0              # score of a tag of boilerplate, and of the outer borders of the content
# Elements whose content is never text, and void elements.
_SILENT = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "textarea", "title", "select", "option")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
_BOILERPLATE = frozenset("nav footer header aside form button menu dialog".split())
# Words of class names, ids and roles that mark boilerplate.
_HINTS = frozenset(
    "ad ads advert adverts advertisement banner banners breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer "
    "disqus footer header menu nav navbar navigation newsletter notice notices pager pagination popup promo promotion "
    "related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget "
    "contentinfo complementary discussion modal overlay gdpr login".split()
)
# First words of names that say what a page has or lacks; words of names of readers' comments, and last words of their settings.
_ABOUT = frozenset("has no with without is not".split())
_COMMENT = frozenset("comment comments reply replies".split())
_STATES = frozenset("open opened closed enabled disabled on off status allowed".split())
_CONTENT = frozenset(("article", "main"))
_FRAME = frozenset(("html", "body", *_CONTENT))
# Elements that end at the next one of their kind, or with the element around them.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p "
    "pre section table ul".split()
)
_TOKEN = regex.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)|[^<]+|<",
    regex.DOTALL,
)
_ATTRIBUTE = regex.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", regex.IGNORECASE)
_PART = regex.compile(r"[a-z]+")
_RAW_END = {name: regex.compile(rf"</{name}[\s/>]|\Z", regex.IGNORECASE) for name in _SILENT}


def features(name: str, attributes: str) -> tuple[str, ...]:
    """What is known of an element: its name, and the words of its class, id and role.

    Names that speak of what a page has or lacks (`has-sidebar`, `no-comments`) say nothing of the element. Of an <article>
    only two things count: that it is a reader's comment, and whole names that mark boilerplate (with `~`, as they count inside of
    other content only). Of <main>, <body> and <html> nothing does.
    """
    if name in ("html", "body", "main"):
        return (name,)
    words = []
    for found in _ATTRIBUTE.findall(attributes):
        for named in "".join(found).lower().split():
            parts = _PART.findall(named)
            if not parts or parts[0] in _ABOUT:
                continue
            if name != "article":
                words += [f".{w}" for w in parts]
            elif _COMMENT & set(parts) and parts[-1] not in _STATES:
                words.append(".comment")
            elif named in _HINTS:
                words.append(f"~{named}")
    return (name, *dict.fromkeys(words))


def tokens(page: str) -> Iterator[tuple[str, str, tuple[str, ...]]]:
    """(kind, value, features): kinds are open, close and text. Comments and the content of scripts are left out."""
    at, end = 0, len(page)
    while at < end:
        found = _TOKEN.match(page, at)
        at = found.end()
        name = found.group(2)
        if name is None:
            if found.group()[0] != "<" or found.group() == "<":
                yield "text", found.group(), ()
            continue
        name = name.lower()
        if found.group(1):
            yield "close", name, ()
            continue
        yield "open", name, features(name, found.group(3))
        if name in _RAW_END and not found.group(3).rstrip().endswith("/"):
            at = _RAW_END[name].search(page, at).start()


def prior(feature: str) -> float:
    """Score of a word in an element of which the labelled pages say nothing."""
    if feature[0] in ".~":
        return -LIMIT if feature[1:] in _HINTS else WORD
    return -LIMIT if feature in _BOILERPLATE or feature in _SILENT else WORD


def evidence(found: tuple[str, ...]) -> tuple[str, ...]:
    """The features that weights are learned for: the words of class, id and role, or the name without them."""
    return found[1:] or found


class Weights:
    """Scores of elements: learned log-odds where there are any, the prior elsewhere."""

    def __init__(self, learned: dict[str, float]) -> None:
        self.learned = learned
        self.known: dict[tuple[str, ...], float] = {}

    def word(self, found: tuple[str, ...]) -> float:
        score = self.known.get(found)
        if score is None:
            if found[0] in _FRAME and len(found) == 1:
                score = WORD
            else:
                score = min(WORD, *map(prior, found), *(self.learned.get(f, WORD) for f in evidence(found)))
            self.known[found] = score
        return score


class Open:
    """An open element with what its ancestors add up to, so that no token looks at the whole stack."""

    __slots__ = ("name", "found", "number", "parent", "base", "depth", "content", "inside", "least")

    def __init__(self, name: str, found: tuple[str, ...], number: int, parent: Open | None, depth: int) -> None:
        within = parent.inside if parent else 0
        if name == "article" and not within:
            found = tuple(f for f in found if f[0] != "~")
        self.name, self.found, self.number, self.parent, self.depth = name, found, number, parent, depth
        # The depth that is left without the inline elements on top.
        self.base = (parent.base if parent else 0) if name in _INLINE else depth
        self.content = name in _CONTENT and len(found) == 1
        self.inside = within + self.content
        self.least = parent.least if parent else WORD

    def ancestors(self) -> Iterator[Open]:
        above = self.parent
        while above is not None:
            yield above
            above = above.parent


def walk(found: list[tuple[str, str, tuple[str, ...]]]) -> Iterator[tuple[str, str, Open | None]]:
    """Tokens with an element: the one that opens, or the innermost that is open after the token.

    Missing end tags are supplied as HTML rules have it. The work grows with the number of tokens, however deep they lie.
    """
    stack: list[Open] = []
    names: Counter = Counter()

    def cut(n: int) -> None:
        while len(stack) > n:
            names[stack.pop().name] -= 1

    for number, (kind, value, own) in enumerate(found):
        if kind == "open":
            ends = _CLOSES.get(value, set()) | ({"p"} if value in _ENDS_P else set())
            if ends and stack:
                # Inline elements left open end with their block.
                k = stack[-1].base
                if k and stack[k - 1].name in ends:
                    cut(k - 1)
                    while stack and stack[-1].name in ends:
                        cut(len(stack) - 1)
                elif value in _ENDS_P:
                    cut(k)
            top = Open(value, own, number, stack[-1] if stack else None, len(stack) + 1)
            if value not in _VOID:
                stack.append(top)
                names[value] += 1
            yield kind, value, top
            continue
        if kind == "close" and names[value]:
            while stack[-1].name != value:
                cut(len(stack) - 1)
            cut(len(stack) - 1)
        yield kind, value, stack[-1] if stack else None


def surroundings(found: list[tuple[str, str, tuple[str, ...]]]) -> tuple[int, set[int], int]:
    """Number of content elements, the elements around the first <main> and around an <article> that is the only one, depth."""
    main, article, articles, marks, depth = None, [], 0, 0, 0
    for kind, value, top in walk(found):
        if kind != "open":
            continue
        depth = max(depth, top.depth)
        if top.content:
            marks += 1
            if value == "main" and main is None:
                main = [e.number for e in top.ancestors()]
            elif value == "article":
                articles += 1
                if articles == 1:
                    article = [e.number for e in top.ancestors()]
    return marks, {*(main or ()), *(article if articles == 1 else ())}, depth


def _own_prior(found: tuple[str, ...], around: bool) -> float:
    """Score of an element by its prior; of one around the content, its name alone says something."""
    if found[0] in _FRAME and len(found) == 1:
        return WORD
    return prior(found[0]) if around else min(map(prior, found))


def label(page: str) -> tuple[Counter, Counter] | None:
    """Words inside and outside the content for each feature; None if the page does not label itself, or is very deep."""
    inside, outside = Counter(), Counter()
    found = list(tokens(page))
    marks, around, depth = surroundings(found)
    if marks != 1 or depth > TRAINING_DEPTH:
        return None
    for kind, value, top in walk(found):
        if kind != "text":
            continue
        n = len(value.split())
        to = inside if top and top.inside else outside
        to[""] += n
        counted = set()
        for element in [*reversed([*top.ancestors()]), top] if top else []:
            if not (element.name in _FRAME and len(element.found) == 1) and element.number not in around:
                counted.update(evidence(element.found))
            if _own_prior(element.found, element.number in around) < 0:
                break  # what stands in a menu says nothing about lists elsewhere
        for feature in counted:
            to[feature] += n
    return (inside, outside) if inside[""] else None


def fit(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Log-odds of content for each feature, from its words inside and outside; at most LIMIT in size.

    Only evidence against content is kept: a feature of few words outside says nothing.
    """
    all_inside, all_outside = counts.get("", (0, 0))
    learned = {}
    for feature, (inside, outside) in counts.items():
        if feature in ("", "html", "body", "head", *_CONTENT) or outside < 5:
            continue
        odds = log((inside + 0.5) / (all_inside + 1)) - log((outside + 0.5) / (all_outside + 1))
        if odds < -1:
            learned[feature] = max(-LIMIT, odds)
    return learned


def extract(page: str, weights: Weights) -> str:
    """Blocks of the region of highest score, joined by an empty line; empty if no word is positive.

    White space inside a block is one space; blocks without text are left out.
    """
    found = list(tokens(page))
    _, around, _ = surroundings(found)
    pieces: list[tuple[int, float, str, bool]] = []   # block, score, text, positive
    block = 0
    within = False                          # the last token was inside of the content
    ended: tuple[int, int] | None = None    # piece and parent of the content's last end, if no word has come since

    for kind, value, top in walk(found):
        own = WORD
        if kind == "open":
            own = _own_prior(top.found, True) if top.number in around else weights.word(top.found)
            top.least = min(top.least, own)
        inside = bool(top and top.inside)
        if kind == "text":
            words = len(value.split())
            ended = None if words else ended
            least = top.least if top else WORD
            # Boilerplate inside of an article is no text, and no reason to end the article either.
            each = (LIMIT if inside else WORD) if least > 0 else 0.0 if inside else least
            pieces.append((block, words * each, html.unescape(value), least > 0))
        elif value in _INLINE:
            pieces.append((block, 0.0 if inside else TAG / 4, " " if value in ("br", "img") else "", True))
        else:
            block += 1
            nested = kind == "open" and bool(top.parent and top.parent.inside)
            content = top.content if kind == "open" else value in _CONTENT
            score = EDGE if content and (not inside or kind == "open" and not nested) else 0.0 if inside else TAG
            over = top if kind == "close" else top.parent
            parent = over.number if over else -1
            if kind == "close" and within and not inside:
                ended = len(pieces), parent
            elif kind == "open" and content and not nested:
                # Content that follows its sibling goes on with it.
                if ended and ended[1] == parent:
                    at, score = ended[0], 0.0
                    pieces[at] = (pieces[at][0], 0.0, *pieces[at][2:])
                ended = None
            against = kind == "open" and not inside and own < 0
            pieces.append((block, EDGE if against else score, "", False))
        within = inside

    best, total, start, region = 0.0, 0.0, 0, (0, 0)
    for i, (_, score, _, _) in enumerate(pieces):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, region = total, (start, i + 1)
    blocks: dict[int, list[str]] = {}
    for at, _, text, positive in pieces[region[0] : region[1]]:
        if positive:
            blocks.setdefault(at, []).append(text)
    cleaned = (" ".join("".join(held).split()) for held in blocks.values())
    return "\n\n".join(text for text in cleaned if text)


def learn(pages: DataFrame, training_pages: int = TRAINING_PAGES) -> dict[str, float]:
    """Weights from about `training_pages` self-labelled pages at most, chosen by a hash."""
    marked = pages.select("page_id", "html").where(F.col("html").rlike("(?i)<(article|main)[ >]") & (F.length("html") <= TRAINING_LENGTH))
    sample = hash_sample(marked, ["page_id", "html"], training_pages).select("html")

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            inside, outside = Counter(), Counter()
            for page in batch["html"]:
                found = label(page)
                if found:
                    inside.update(found[0])
                    outside.update(found[1])
            names = sorted(set(inside) | set(outside))
            yield pd.DataFrame({"feature": names, "inside": [inside[f] for f in names], "outside": [outside[f] for f in names]})

    counted = sample.mapInPandas(counts, "feature string, inside long, outside long")
    summed = counted.groupBy("feature").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o")).collect()
    return fit({r["feature"]: (r["i"], r["o"]) for r in summed})


def extract_pages(pages: DataFrame, learned: dict[str, float]) -> DataFrame:
    """The table with one more column, `_text`: the main text of `html`. Null and empty html give an empty text.

    Repeated rows are read one by one. Pages of any length and depth are read whole, in time that grows with their length. A
    column of the table that is called `_text` already is replaced; columns of other names are kept.
    """

    @F.pandas_udf("string")
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = Weights(learned)
        for batch in batches:
            yield batch.fillna("").map(lambda page: extract(page, weights))

    return pages.withColumn("_text", main_text(F.col("html")))
