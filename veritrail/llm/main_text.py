"""The main text of web pages: blocks labelled by a minimum cut between content and the rest."""

from __future__ import annotations

import bisect
import functools
import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# Names of the markup language (fixed values).
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't markup; what isn't closed reaches the page's end.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
#: Elements that show no running text.
UNSEEN = frozenset("head script style title textarea xmp iframe noembed noframes noscript template svg math canvas object audio video button select option datalist".split())
#: A start tag closes an open element of these names, unless one of the second set lies between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: A block closes an open paragraph that lies this side of them.
SCOPE = frozenset("html body table td th caption button object div section article aside main nav header footer form li dd figure blockquote details fieldset".split())

TAG = re.compile(
    r"""<!--(?:.*?-->|.*)|<!\[CDATA\[(?:.*?\]\]>|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)""",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?=[\s/]|$))""", re.IGNORECASE)

#: What elements say of what they hold; the nearest says most, and nothing makes content of what lies in the rest.
TAG_CUES = {"article": 3.5, "main": 2.5, "nav": -7.0, "footer": -7.0, "aside": -7.0, "dialog": -7.0, "search": -7.0, "menu": -7.0}
ROLE_CUES = {"main": 2.5, "article": 3.5} | dict.fromkeys("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split(), -7.0)
GOOD = frozenset("article articlebody post postbody entry story content maincontent main prose hentry blogpost bodytext text".split())
BAD = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar aside footer masthead cookie cookies consent gdpr ad ads advert adverts advertisement advertising adsense "
    "sponsor sponsored promo promotion share sharing social related recommended recommendations newsletter subscribe subscription signup login search disqus respond reply replies "
    "pagination pager toolbar widget popup modal overlay copyright disclaimer skip".split()
)
#: Bad unless a good word stands beside them, as in post-header.
WEAK = frozenset("header banner notice notices alert top bottom hero legal form".split())
HEADER, FORM, CLASS_BAD, CLASS_GOOD = -7.0, -7.0, -7.0, 2.0

#: Headings after which the rest of their element is no longer the article (fixed values).
AFTERWARDS = re.compile(
    r"^(?:\d+\s+)?(?:comments?|responses|kommentare?|commentaires?|comentarios?|leave a (?:reply|comment)|related (?:articles|posts|stories)|share this|you may also like|read more)\b", re.IGNORECASE
)
LEGAL_START = ("©", "(c)", "copyright ")
LEGAL = ("all rights reserved", "alle rechte vorbehalten", "tous droits réservés", "todos los derechos reservados")
COOKIES = re.compile(r"\bcookies?\b", re.IGNORECASE)

#: Classes of a block's features, and the weights that training starts from (logits of being content).
WORDS = (0, 1, 3, 6, 12, 25, 50, 100)
PRIOR = {
    "words": (-2.0, -1.5, -1.0, -0.5, 0.2, 0.9, 1.5, 1.8),
    "links": (0.4, -0.5, -2.0, -3.0),
    "sentence": (-0.6, 0.6),
    "kind": (0.6, 0.2, -0.6, -0.2, 0.0),  # paragraph, heading, list item, cell, other
    "around": (-0.6, -0.1, 0.3, 0.5),
    "legal": (0.0, -2.5),
}
ENDS = frozenset(".!?…:;\"”»")
SIZES = tuple(map(len, PRIOR.values()))
#: Rows that the labelled blocks count as at most, against a prior of one row for each weight.
WORTH = 400.0
TEXT_MOST = 3.0
#: Pages whose blocks train the weights, about.
PAGES = 4000
#: Smoothness of neighbours in page order, and of blocks of one element.
BESIDE, TOGETHER = 1, 1
UNIT = 1000


@dataclass(slots=True)
class Block:
    text: str
    element: int
    above: int
    kind: int
    linked: int
    cue: float = 0.0


@functools.lru_cache(maxsize=100_000)
def _cue(name: str, attributes: str) -> tuple[float, bool, bool, bool]:
    """``(cue, of a class alone, hidden, holds the article)`` of an element."""
    cue = TAG_CUES.get(name, HEADER if name == "header" else FORM if name == "form" else 0.0)
    by_class, hidden, body = False, False, name in ("main", "h1")
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), html.unescape(value.strip("\"'"))
        if key in ("class", "id"):
            words = {w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", value)} | {value.lower()}
            good = not words.isdisjoint(GOOD)
            bad = not words.isdisjoint(BAD) or any(w.startswith("comment") for w in words) or not good and not words.isdisjoint(WEAK)
            if bad and cue >= 0 and name not in ("html", "body"):
                cue, by_class = CLASS_BAD, name != "article"
            elif good and 0 <= cue < CLASS_GOOD:
                cue = CLASS_GOOD
        elif key == "role" and value.lower() in ROLE_CUES:
            cue, by_class = ROLE_CUES[value.lower()], False
        elif key == "itemprop" and value.lower() == "articlebody":
            cue, body = 3.5, True
        elif key == "style":
            hidden |= re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE) is not None
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            hidden = True
    return cue, by_class, hidden, body


def _kind(name: str) -> int:
    if name == "p":
        return 0
    if len(name) == 2 and name[0] == "h" and name[1].isdigit():
        return 1
    return 2 if name in ("li", "dt", "dd") else 3 if name in ("td", "th") else 4


def blocks(page: str) -> list[Block]:
    """The visible blocks of a page in its order, each with its innermost block element, that
    element's parent, letters within links and what the elements around it say."""
    names, parents, ends, cues, classed, holds = ["#"], [-1], [0], [0.0], [False], [False]
    stack: list[tuple[str, int, bool]] = [("#", 0, False)]  # name, element (of blocks), unseen
    opened: dict[str, int] = {}
    out: list[Block] = []
    text: list[str] = []
    linked = links = 0

    def flush():
        nonlocal linked
        if text:
            whole = "".join(text)
            shown = " ".join((html.unescape(whole) if "&" in whole else whole).split())
            if shown:
                at = stack[-1][1]
                out.append(Block(shown, at, parents[at], _kind(names[at]), linked))
            text.clear()
        linked = 0

    def close(n: int):
        """Closes the n innermost elements."""
        nonlocal links
        if any(s[0] in BLOCK for s in stack[-n:]):
            flush()
        for name, element, _ in reversed(stack[-n:]):
            opened[name] -= 1
            if name == "a":
                links -= 1
            if name in BLOCK:
                ends[element] = len(names) - 1
        del stack[-n:]

    def depth(wanted, until) -> int:
        """How many elements to close for one of the wanted to be closed; 0 if none is in reach."""
        for n in range(1, len(stack)):
            if stack[-n][0] in wanted:
                return n
            if stack[-n][0] in until:
                return 0
        return 0

    def say(piece: str):
        nonlocal linked
        if piece and not stack[-1][2]:
            text.append(piece)
            if links:
                linked += len(piece)

    at, low = 0, None
    while True:
        found = TAG.search(page, at)
        if not found:
            say(page[at:])
            break
        say(page[at : found.start()])
        at = found.end()
        slash, name, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not name:
            continue
        name = name.lower()
        if slash:
            if opened.get(name) and (n := depth({name}, () if name in BLOCK or name in UNSEEN else BLOCK)):
                close(n)
            continue
        if name == "br":
            say(" ")
            continue
        if name in BLOCK:
            if opened.get("p") and (n := depth({"p"}, SCOPE)):
                close(n)
            flush()
        if name in CLOSES and any(opened.get(k) for k in CLOSES[name][0]):
            while n := depth(*CLOSES[name]):
                close(n)
        if name in VOID:
            continue
        cue, by_class, hidden, body = _cue(name, attributes)
        unseen, element = stack[-1][2] or hidden or name in UNSEEN, stack[-1][1]
        if name in BLOCK:
            if name == "header" and cues[element] > 0:
                cue = 0.0
            names.append(name)
            parents.append(element)
            ends.append(len(names) - 1)
            cues.append(cue)
            classed.append(by_class)
            holds.append(False)
            element = len(names) - 1
            if body:
                up = element
                while up >= 0 and not holds[up]:
                    holds[up] = True
                    up = parents[up]
        if attributes.endswith("/") and name not in BLOCK and name not in RAW:
            continue
        stack.append((name, element, unseen))
        opened[name] = opened.get(name, 0) + 1
        links += name == "a"
        if name in RAW:
            low = low or page.lower()
            end = low.find(f"</{name}", at) if len(low) == len(page) else -1
            if len(low) != len(page):  # a letter that changes its length
                again = re.compile(f"</{name}", re.IGNORECASE).search(page, at)
                end = again.start() if again else -1
            at = len(page) if end < 0 else end
    flush()
    for n in range(1, len(stack)):
        ends[stack[n][1]] = len(names) - 1
    ends[0] = len(names) - 1
    _spread(out, parents, ends, cues, classed, holds, names)
    return out


def _spread(out: list[Block], parents, ends, cues, classed, holds, names) -> None:
    """Gives each block what the elements around it say: a parent's number is below its child's."""
    said = [0.0] * len(cues)
    for k in range(1, len(cues)):
        above, own = said[parents[k]], cues[k]
        if own < 0 and holds[k] and (classed[k] or names[k] == "form"):
            own = 0.0  # a wrapper of the page's main part
        said[k] = above if above < 0 or own == 0 else own
    for b in out:
        b.cue = said[b.element]
    for i, b in enumerate(out):
        if (b.kind == 1 or len(b.text) < 40) and b.cue >= 0 and AFTERWARDS.match(b.text) and i:
            b.cue = CLASS_BAD
            for later in out[i + 1 :]:
                if not b.above <= later.element <= ends[b.above]:
                    break
                later.cue = min(later.cue, CLASS_BAD)
    for b in out:
        if b.cue <= 0 and len(b.text) < 400 and COOKIES.search(b.text):
            b.cue = min(b.cue, CLASS_BAD)


def _legal(text: str) -> bool:
    low = text.lower()
    return low.startswith(LEGAL_START) or any(phrase in low for phrase in LEGAL)


def features(found: list[Block]) -> list[tuple[int, ...]]:
    """A class for each feature of PRIOR, by blocks: number of words, share of letters in links, whether it
    ends like a sentence, its element, the larger neighbour, and a legal phrase."""
    bins = [bisect.bisect_right(WORDS, b.text.count(" ") + 1) - 1 for b in found]
    around = [max(pair) // 2 for pair in zip([0, *bins], [*bins[1:], 0])]
    out = []
    for b, words, beside in zip(found, bins, around):
        share = b.linked / len(b.text) if b.linked else 0
        links = 0 if share < 0.1 else 1 if share < 0.4 else 2 if share < 0.8 else 3
        out.append((words, links, int(b.text[-1] in ENDS), b.kind, beside, int(_legal(b.text))))
    return out


def cut_side(gain: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """The side of content in a minimum cut: node i costs ``gain[i]`` if positive and not content,
    ``-gain[i]`` if negative and content, an edge (i, j, w) costs w if its ends differ. Of several
    minimum cuts the one with the fewest content nodes. Flow goes in layers of shortest ways, each
    searched with a pointer to the next edge of a node."""
    n = len(gain)
    if all(g <= 0 for g in gain):
        return [False] * n
    if all(g >= 0 for g in gain) and all(gain):
        return [True] * n
    to: list[int] = []
    room: list[int] = []
    at: list[list[int]] = [[] for _ in range(n)]
    for i, j, w in edges:
        at[i].append(len(to))
        at[j].append(len(to) + 1)
        to += (j, i)
        room += (w, w)
    left, open_ = [max(g, 0) for g in gain], [max(-g, 0) for g in gain]
    while True:
        level = [0 if x else -1 for x in left]
        queue = [i for i in range(n) if left[i]]
        reached = False
        for i in queue:
            if open_[i]:
                reached = True
            for e in at[i]:
                j = to[e]
                if room[e] and level[j] < 0:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not reached:
            return [x >= 0 for x in level]
        nexts = [0] * n
        for start in range(n):
            while left[start]:
                way: list[int] = []
                i, flow = start, 0
                while True:
                    if open_[i]:
                        flow = min([left[start], open_[i], *(room[e] for e in way)])
                        break
                    while nexts[i] < len(at[i]):
                        e = at[i][nexts[i]]
                        if room[e] and level[to[e]] == level[i] + 1:
                            break
                        nexts[i] += 1
                    else:
                        if not way:
                            break
                        i = to[way.pop() ^ 1]
                        nexts[i] += 1
                        continue
                    way.append(e)
                    i = to[e]
                if not flow:
                    break
                left[start] -= flow
                open_[i] -= flow
                for e in way:
                    room[e] -= flow
                    room[e ^ 1] += flow


def smoothness(found: list[Block]) -> list[tuple[int, int, int]]:
    """Edges between neighbours in page order, and between a block and the last before it in the
    same parent; a quarter as strong where the elements around two blocks speak against each
    other, or where neighbours are no close relatives."""
    out, last = [], {}
    strong, weak = (UNIT * BESIDE, UNIT * TOGETHER), (UNIT * BESIDE // 4, UNIT * TOGETHER // 4)
    for i, b in enumerate(found):
        if i:
            a = found[i - 1]
            near = a.element == b.element or a.above == b.above or a.above == b.element or a.element == b.above
            out.append((i - 1, i, (strong if near and (a.cue < 0) == (b.cue < 0) else weak)[0]))
        before = last.get(b.above)
        if before is not None:
            out.append((before, i, (strong if (found[before].cue < 0) == (b.cue < 0) else weak)[1]))
        last[b.above] = i
    return out


Weights = tuple[tuple[float, ...], ...]


def content(found: list[Block], weights: Weights) -> list[bool]:
    """Which blocks are the main text."""
    if not found:
        return []
    gain = []
    for b, classes in zip(found, features(found)):
        logit = sum([w[c] for w, c in zip(weights, classes)])
        gain.append(round(UNIT * (min(max(logit, -TEXT_MOST), TEXT_MOST) + b.cue)))
    return cut_side(gain, smoothness(found))


def prior() -> Weights:
    return tuple(PRIOR.values())


def trained(cells: list[tuple[list[int], bool, int]]) -> Weights:
    """Logistic weights from numbers of blocks by classes and label, both labels of equal weight
    and WORTH rows at most; what no block shows keeps its prior. Newton's method."""
    start = np.concatenate(prior())
    offsets = np.cumsum([0, *SIZES[:-1]])
    totals = {label: sum(n for _, y, n in cells if y == label) for label in (True, False)}
    if not all(totals.values()):
        return prior()
    x = np.zeros((len(cells), len(start)))
    for i, (classes, _, _) in enumerate(cells):
        x[i, offsets + np.array(classes)] = 1
    y = np.array([c[1] for c in cells], dtype=np.float64)
    worth = min(WORTH, 2.0 * min(totals.values()))
    weight = np.array([n / totals[label] * worth / 2 for _, label, n in cells])
    w = start.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + (w - start)
        curve = (x.T * (weight * p * (1 - p))) @ x + np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(tuple(part.tolist()) for part in np.split(w, offsets[1:]))


def fitted(pages: DataFrame, most: int = PAGES) -> Weights:
    """Weights from about ``most`` pages, those with the smallest hashes of their address and
    length, or all if there are fewer: a block is labelled by what the elements around it say,
    where they say something, and described by its text and kind. A task sends numbers by classes
    alone, and there are at most as many as combinations of classes."""
    n = pages.count()
    if n > most:
        pages = pages.where(F.pmod(F.xxhash64("page_id", "url", F.length("html")), F.lit(1 << 40)) < int(most / n * (1 << 40)))

    def run(batches):
        numbers: dict[tuple, int] = {}
        for batch in slices(batches):
            for page in batch.column(0):
                found = blocks(page.as_py() or "")
                for b, classes in zip(found, features(found)):
                    if b.cue:
                        key = (*classes, b.cue > 0)
                        numbers[key] = numbers.get(key, 0) + 1
        rows = list(numbers)
        yield pa.RecordBatch.from_arrays(
            [pa.array([list(k[:-1]) for k in rows], pa.list_(pa.int32())), pa.array([k[-1] for k in rows], pa.bool_()), pa.array(list(numbers.values()), pa.int64())], names=["classes", "label", "n"]
        )

    cells = pages.select("html").mapInArrow(run, "classes array<int>, label boolean, n bigint").groupBy("classes", "label").agg(F.sum("n").alias("n"))
    rows = cells.collect()  # at most 2 * prod(SIZES)
    return trained(sorted((list(r.classes), r.label, r.n) for r in rows))


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.

    A null or empty page, or one without main text, has the empty text; null ids and addresses
    stay null, repeated rows are treated one by one, pages of any length are read whole, and
    other columns are ignored. Weights are fitted on the same pages unless given; an empty table, or one
    whose elements say nothing, leaves the prior's. Each page is one row of a narrow pass."""
    weights = fitted(pages) if weights is None else weights
    id_type, url_type = pages.schema["page_id"].dataType.simpleString(), pages.schema["url"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            texts = []
            for page in batch.column(2):
                found = blocks(page.as_py() or "")
                texts.append(" ".join(b.text for b, keep in zip(found, content(found, weights)) if keep))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {id_type}, url {url_type}, text string, n_chars bigint")
