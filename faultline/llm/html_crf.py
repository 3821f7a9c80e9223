"""Main text of web pages by a linear-chain conditional random field (operator 9).

A page is cut into leaf blocks, runs of text between the borders of block-level elements. Each block
has features of its ancestors (tags, words of class, id and role) and of its text (length, share of
links, punctuation). A chain of two labels, main text or not, is trained by gradient ascent on the
likelihood of labelled pages, and a page's best labelling is found by Viterbi's algorithm. The pages
learned from are made by :func:`labelled_pages` out of invented words, in many layouts, each
block with its label; the model is small and fitted anew, the same each time, in a few seconds.
"""

from __future__ import annotations

import html as _html
import math
import random
import re

from pyspark.sql import DataFrame, SparkSession

from . import store
from .tokens import groups_of

# Fixed values of the HTML standard: element names by role. RAW holds what is no text of an article: scripts, styles, fields of
# forms, graphics and players; formulas and the text in an object are text like any other.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mover mrow mspace msqrt mstyle msub msubsup msup mtext munder object q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg canvas audio video textarea select button head title".split())
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</?[A-Za-z][^\s/>]*(?:[^>\"']|\"[^\"]*\"|'[^']*')*>", re.S)
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
#: Elements that an opening tag of one of these ends, if it is open: an unclosed paragraph or item.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


def blocks(page: str) -> list[tuple[tuple, str, float]]:
    """(ancestors, text, share of the text inside links) of each leaf block, in page order.

    Ancestors are names and class words from the outside in. Markup that never ends is text no more
    than to its end; an element that is never closed ends with its parent.
    """
    out: list[tuple[tuple, str, float]] = []
    stack: list[tuple[str, tuple]] = []
    parts: list[str] = []
    path: tuple | None = ()
    linked = depth = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            if text:
                out.append((tuple(x for _, a in stack for x in a), text, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    i, n = 0, len(page)
    while i < n:
        m = _TOKEN.search(page, i)
        a = m.start() if m else n
        if a > i:
            t = page[i:a]
            parts.append(t)
            if depth:
                linked += len(t)
        if not m:
            break
        i = m.end()
        tag = m.group()
        name = _NAME.match(tag)
        if not name:
            continue
        low = name[1].lower()
        if tag[1] == "/":
            if low in INLINE:
                if low == "a" and depth:
                    depth -= 1
                continue
            flush()
            if low == "p" and not any(x == "p" for x, _ in stack):
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == low:
                    del stack[k:]
                    depth = 0
                    break
            continue
        if low in RAW:
            end = _RAW_END[low].search(page, i)
            if low == "head" and (not end or (body := page.lower().find("<body", i)) >= 0 and body < end.start()):
                flush()
                continue
            flush()
            i = end.end() if end else n if low in ("script", "style", "textarea", "title") else i
            continue
        if low in INLINE:
            if low == "a":
                depth = 1
            continue
        if low == "br":
            parts.append(" ")
            continue
        flush()
        if low in VOID:
            continue
        while stack and (stack[-1][0] == "p" or stack[-1][0] in _ENDS.get(low, ())):
            stack.pop()
        words = dict.fromkeys(w for x in _ATTR.findall(tag) for w in _WORD.findall("".join(x[1:]).lower()) if len(w) > 1)
        stack.append((low, (f"<{low}>", *words)))
        depth = 0
        if tag.endswith("/>") and low not in ("p", "div", "li"):
            stack.pop()
    flush()
    return out


def text_features(text: str, links: float) -> tuple[str, ...]:
    n = len(text)
    return (
        f"len{min(6, n.bit_length() // 2)}",
        f"link{0 if links < 0.05 else 1 if links < 0.4 else 2 if links < 0.8 else 3}",
        "end." if text[-1] in ".!?…:;\"”»" else "end-",
        f"stop{min(3, sum(map(text.count, '.!?')))}",
        "mark" if any(c in text for c in "©|»·›") else "nomark",
    )


def features(page: str) -> list[tuple[tuple[str, ...], str]]:
    got = blocks(page)
    out = []
    for k, (path, text, links) in enumerate(got):
        place = "first" if k == 0 else "last" if k == len(got) - 1 else "inner"
        out.append((("bias", place, *dict.fromkeys(path), f"in{path[-1] if path else ''}", *text_features(text, links)), text))
    return out


class Crf:
    """Two labels; a weight for each feature (towards label 1) and for each pair of labels."""

    def __init__(self):
        self.w: dict[str, float] = {}
        self.t = [[0.0, 0.0], [0.0, 0.0]]

    def scores(self, rows) -> list[float]:
        get = self.w.get
        return [sum([get(f, 0.0) for f in fs]) for fs, _ in rows]

    def viterbi(self, s: list[float]) -> list[int]:
        if not s:
            return []
        t, best, back = self.t, [0.0, s[0]], []
        for x in s[1:]:
            a = [0 if best[0] + t[0][j] >= best[1] + t[1][j] else 1 for j in (0, 1)]
            best = [best[a[j]] + t[a[j]][j] + (x if j else 0.0) for j in (0, 1)]
            back.append(a)
        out = [0 if best[0] >= best[1] else 1]
        for a in reversed(back):
            out.append(a[out[-1]])
        return out[::-1]

    def fit(self, pages: list[tuple[list[tuple[str, ...]], list[int]]], epochs: int = 8, rate: float = 0.15, decay: float = 1e-4) -> Crf:
        rng = random.Random(3)
        for e in range(epochs):
            rng.shuffle(pages)
            step = rate / (1 + e)
            for rows, y in pages:
                s, t = self.scores([(r, "") for r in rows]), self.t
                n = len(s)
                fwd, bwd = [[0.0, 0.0] for _ in s], [[0.0, 0.0] for _ in s]
                fwd[0] = [0.0, s[0]]
                for k in range(1, n):
                    for j in (0, 1):
                        fwd[k][j] = (s[k] if j else 0.0) + _lse(fwd[k - 1][0] + t[0][j], fwd[k - 1][1] + t[1][j])
                for k in range(n - 2, -1, -1):
                    for j in (0, 1):
                        bwd[k][j] = _lse(t[j][0] + bwd[k + 1][0], t[j][1] + s[k + 1] + bwd[k + 1][1])
                z = _lse(*fwd[-1])
                for k in range(n):
                    g = y[k] - math.exp(fwd[k][1] + bwd[k][1] - z)
                    if abs(g) > 1e-6:
                        for f in rows[k]:
                            w = self.w.get(f, 0.0)
                            self.w[f] = w + step * (g - decay * w)
                    if k:
                        for i in (0, 1):
                            for j in (0, 1):
                                p = math.exp(fwd[k - 1][i] + t[i][j] + (s[k] if j else 0.0) + bwd[k][j] - z)
                                t[i][j] += step * 0.2 * ((y[k - 1] == i and y[k] == j) - p)
        return self

    def extract(self, page: str | None) -> str:
        rows = features(page or "")
        return " ".join(text for (_, text), y in zip(rows, self.viterbi(self.scores(rows))) if y)


def _lse(a: float, b: float) -> float:
    m = max(a, b)
    return m + math.log1p(math.exp(min(a, b) - m))


# Words that page authors commonly use in class and id attributes.
_MAIN = "article content main post entry story body text page document".split()
_CHROME = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs toc topbar links".split(),
    "header": "header masthead banner branding logo site-header".split(),
    "footer": "footer copyright legal colophon site-footer imprint".split(),
    "aside": "sidebar related widget recommended popular trending tags share social rail".split(),
    "notice": "cookie consent notice alert popup modal gdpr banner message overlay".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion commercial".split(),
    "form": "form newsletter subscribe signup search login contact".split(),
    "comments": "comments comment replies reply discussion respond disqus".split(),
}


def labelled_pages(n: int = 500, seed: int = 11):
    """(page, labels of its blocks): invented words, random layouts, most of them with unclosed markup now and then."""
    rng = random.Random(seed)
    syllables = "ba den ing tor lu mi ké ra sta ten ou re ver la pö ñi the an".split()

    def words(k: int) -> str:
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(k))

    def sentence() -> str:
        return words(rng.randint(1, 18)).capitalize() + "."

    def prose() -> str:
        k = rng.choice((1, 1, 2, 3, 6, 12))
        return " ".join(sentence() for _ in range(k)) if rng.random() > 0.1 else words(rng.randint(1, 6))

    for _ in range(n):
        out: list[str] = []
        labels: list[int] = []

        def put(before: str, text: str, after: str, label: int) -> None:
            out.append(f"{before}{text}{after}")
            labels.append(label)

        def chrome(kind: str) -> None:
            word = rng.choice(_CHROME[kind])
            tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comments": "section"}.get(kind, "div")
            if rng.random() < 0.4:
                tag = rng.choice(("div", "section"))
            semantic = tag == kind
            attr = "" if semantic and rng.random() < 0.6 else f' {rng.choice(("class", "id"))}="{word}"'
            out.append(f"<{tag}{attr}>")
            if kind == "nav" or kind == "aside" and rng.random() < 0.5:
                out.append("<ul>")
                for _ in range(rng.randint(2, 7)):
                    put("<li>", f'<a href="/x">{words(rng.randint(1, 3))}</a>', "</li>", 0)
                out.append("</ul>")
            elif kind == "comments":
                for _ in range(rng.randint(1, 6)):
                    put(rng.choice(('<div class="comment"><p>', '<li class="comment">', "<p>")), prose(), "", 0)
            elif kind == "form":
                put("<p>" if rng.random() < 0.6 else "", sentence() + '<input type="text"><button>Go</button>', "", 0)
            else:
                for _ in range(rng.randint(1, 3)):
                    put(rng.choice(("", "<p>", "<div>", "<h3>")), ("&copy; " if kind == "footer" and rng.random() < 0.6 else "") + prose(), "", 0)
                    if out[-1].startswith("<h3>"):
                        out.append("</h3>")
                    elif out[-1].startswith("<div>"):
                        out.append("</div>")
                    elif out[-1].startswith("<p>"):
                        out.append("</p>")
                    else:
                        out.append("<hr>")
            out.append(f"</{tag}>")

        out.append('<!DOCTYPE html><html><head><meta charset="utf-8"><title>' + sentence() + "</title><style>p{}</style><script>var a='</p>';</script></head><body>")
        before = [k for k in ("header", "nav", "notice", "ad", "aside") if rng.random() < 0.5]
        after = [k for k in ("aside", "comments", "form", "notice", "ad", "nav", "footer") if rng.random() < 0.5]
        inside = [k for k in ("ad", "aside", "form", "notice") if rng.random() < 0.25]
        for k in before:
            chrome(k)
        tag = rng.choice(("article", "article", "main", "div"))
        attr = f' class="{rng.choice(_MAIN)}"' if tag == "div" or rng.random() < 0.3 else ""
        wrap = rng.random() < 0.3
        out.append(("<div>" if wrap else "") + f"<{tag}{attr}>")
        plain = rng.random() < 0.15  # a page whose paragraphs are bare divisions
        if rng.random() < 0.7:
            head = "<div>" if plain else "<h1>"
            put(head, words(rng.randint(1, 9)), head.replace("<", "</"), 1)
        for _ in range(rng.randint(1, 14)):
            style = rng.random()
            if plain:
                put("<div>", prose(), "</div>", 1)
            elif style < 0.6:
                put("<p>", prose(), "</p>", 1)
            elif style < 0.75:
                put("<p><b>", prose(), "<br>", 1)
            elif style < 0.82:
                put("<h2>", words(rng.randint(1, 6)), "</h2>", 1)
            elif style < 0.9:
                out.append("<ul>")
                for _ in range(rng.randint(1, 4)):
                    put("<li>", prose(), "</li>", 1)
                out.append("</ul>")
            elif style < 0.95:
                put("<blockquote><p>", prose(), "</p></blockquote>", 1)
            else:
                put("<p>", f'{words(3)} <a href="/y">{words(2)}</a> {prose()}', "</p>", 1)
            if inside and rng.random() < 0.3:
                chrome(inside.pop())
        out.append(f"</{tag}>" + ("</div>" if wrap else ""))
        for k in after:
            chrome(k)
        if rng.random() < 0.8:
            out.append("</body></html>")
        yield "".join(out), labels


_model: list[Crf] = []


def model() -> Crf:
    if not _model:
        pages = []
        for page, labels in labelled_pages():
            rows = [fs for fs, _ in features(page)]
            if len(rows) == len(labels):
                pages.append((rows, labels))
        _model.append(Crf().fit(pages))
    return _model[0]


def extract(pages: DataFrame, crf: Crf | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page; null or empty html has an empty text."""
    store.small_batches(pages.sparkSession)
    crf = crf or model()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sources = batch.column(2).to_pylist()
            for a, b in groups_of(sources):
                texts = [crf.extract(s) for s in sources[a:b]]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_crf_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
