"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the page.

A page is read into blocks: the text between block-level tags, with the elements it lies in.  Each block gets features
of its ancestors (kinds of regions that tags, classes, ids and roles tell of) and of its text; the field labels the
sequence of blocks main or not, decoded by Viterbi.  It is trained on labelled pages by stochastic gradient on the
likelihood; ``labelled_pages`` makes a default set of a fixed size from layouts, and any list of (html, labels of its
blocks) will do.

Cases: null or empty html has an empty text; markup that is cut off or not closed is read as far as it goes (a script,
style, title, textarea or frame that is never closed goes to the end of the page, as in a browser; any other element that
is never closed takes nothing with it); repeated
rows are extracted alike; a null id or url stays null; other columns are ignored; an empty table gives no rows.  A page is
read in one pass and nothing of it is cut.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import common as C

#: A quote counts only where an attribute's value begins, as in HTML.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>])*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: Fixed lists of HTML: elements that are read up to their end tag and hold no text of the page, those that are
#: only frames of a page, those that don't break a block, those without content.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
FRAME = frozenset("html head body".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var wbr br img input math mi mo mn mrow msup msub mfrac mtext semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What words in tags, classes, ids and roles tell of.
REGIONS = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs toc pagination pager",
    "header": "header masthead topbar logo banner",
    "footer": "footer copyright colophon legal contentinfo",
    "side": "aside sidebar widget related recommended complementary rail",
    "notice": "noscript notice cookie cookies consent gdpr popup modal alert newsletter subscribe subscription paywall dialog toast",
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo",
    "form": "form search login signup button fieldset option",
    "comment": "comment comments reply replies respond discussion",
    "main": "article main content post entry story",
}
REGION_OF = {word: region for region, words in REGIONS.items() for word in words.split()}
#: Elements that end a paragraph, and with it a drawing or a list of choices that was never closed.
ENDS_P = frozenset("p li td th tr dt dd div ul ol dl table section article footer header nav aside form h1 h2 h3 h4 h5 h6 blockquote pre main figure hr".split())
NOISE_WORDS = re.compile(r"\b(cookies?|subscribe|newsletter|advert\w*|sponsored|sign (?:in|up)|log ?in|comments?|reply|copyright|all rights reserved|privacy|terms|share|read more|menu|search)\b|[©·»]", re.I)


def _regions(tag: str, attributes: str) -> list[str]:
    found = {REGION_OF[tag]} if tag in REGION_OF else set()
    if "=" in attributes:
        for _, *values in ATTRIBUTE.findall(attributes):
            found.update(REGION_OF[w] for w in re.split(r"[^a-z0-9]+", "".join(values).lower()) if w in REGION_OF)
    return sorted(found)


def blocks_of(page: str) -> list[tuple[str, tuple[str, ...]]]:
    """(text, features of its elements) of each block with text, in page order."""
    out: list[tuple[str, tuple[str, ...]]] = []
    stack: list[tuple[str, list[str]]] = []
    open_tags: Counter = Counter()
    regions: Counter = Counter()
    pieces: list[str] = []
    drawn: list[str] = []  # text in a drawing, which counts only if the drawing turns out never to be closed
    endless: set[str] = set()
    linked = 0
    at = 0

    def pop() -> None:
        tag, own = stack.pop()
        open_tags[tag] -= 1
        for r in own:
            regions[r] -= 1

    def close(tag: str) -> None:
        while open_tags[tag] > 0:
            last = stack[-1][0] == tag
            pop()
            if last:
                return

    def flush() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(pieces)).split()) if pieces else ""
        if text:
            own = next((t for t, _ in reversed(stack) if t not in INLINE), "none")
            share = linked / max(sum(map(len, pieces)), 1)
            found = ["tag=" + own, "links=" + ("all" if share > 0.8 else "some" if share > 0.2 else "few")]
            found += ["in=" + r for r, n in regions.items() if n > 0]
            if own != "li" and open_tags["li"] > 0:
                found.append("list")
            out.append((text, tuple(found)))
        pieces.clear()
        linked = 0

    n = len(page)
    while at < n:
        m = TAG.search(page, at)
        text = page[at : m.start() if m else n]
        if text and open_tags["svg"]:
            drawn.append(text)
        elif text and not open_tags["select"]:
            pieces.append(text)
            if open_tags["a"] > 0:
                linked += len(text)
        if not m:
            break
        at = m.end()
        ending, tag, attributes = m.group(1), (m.group(2) or "").lower(), m.group(3) or ""
        if not tag:
            continue
        if drawn and tag in ENDS_P:
            pieces.extend(drawn)
            drawn.clear()
        # a drawing stands within its line, and so does what it is made of
        breaks = tag in ENDS_P or not (tag in INLINE or tag == "svg" or open_tags["svg"])
        if ending:
            if breaks:
                flush()
            close(tag)
            if not open_tags["svg"]:
                drawn.clear()
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if breaks:
            flush()
            if tag in ENDS_P:
                for lost in ("svg", "select"):
                    while open_tags[lost] > 0:
                        close(lost)
                close("p")
            if tag in ("li", "option", "tr", "td", "th", "dt", "dd") and stack and stack[-1][0] == tag:
                pop()
        if tag in VOID or attributes.endswith("/") and (tag == "svg" or open_tags["svg"]):
            continue  # a slash closes what belongs to a drawing, and nothing else
        if tag in FRAME:
            continue
        if tag in RAW or tag == "template":
            end = None if tag in endless else re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            if not end:
                endless.add(tag)
            if tag == "template" and not end:
                continue  # never closed: as if it were not there
            at = end.end() if end else n
            continue
        own = _regions(tag, attributes)
        stack.append((tag, own))
        open_tags[tag] += 1
        for r in own:
            regions[r] += 1
    pieces.extend(drawn)
    flush()
    return out


def features(blocks: list[tuple[str, tuple[str, ...]]]) -> list[list[str]]:
    """Feature names of each block of a page."""
    out = []
    for i, (text, found) in enumerate(blocks):
        n = text.count(" ") + 1
        own = ["bias", f"words={min(int(math.log2(n)), 7)}", *found]
        if text[-1] in ".!?…»\"'":
            own.append("sentence")
        if n < 25 and NOISE_WORDS.search(text):
            own.append("noise")
        if not any(f.startswith("in=") for f in found):
            own.append("in=none")
        if i == 0:
            own.append("first")
        if i == len(blocks) - 1:
            own.append("last")
        out.append(own)
    return out


class Field:
    """Weights of a two-label linear chain; label 1 is main text."""

    def __init__(self) -> None:
        self.weights: dict[str, np.ndarray] = {}
        self.moves = np.zeros((2, 2))

    def scores(self, rows: list[list[str]]) -> list[tuple[float, float]]:
        get, none = self.weights.get, (0.0, 0.0)
        out = []
        for row in rows:
            a = b = 0.0
            for f in row:
                w = get(f, none)
                a += w[0]
                b += w[1]
            out.append((a, b))
        return out

    def decode(self, rows: list[list[str]]) -> list[int]:
        if not rows:
            return []
        (m00, m01), (m10, m11) = self.moves.tolist()
        emit = self.scores(rows)
        a, b = emit[0]
        came = []
        for x, y in emit[1:]:
            from0, from1 = (0 if a + m00 >= b + m10 else 1), (0 if a + m01 >= b + m11 else 1)
            a, b = (b + m10 if from0 else a + m00) + x, (b + m11 if from1 else a + m01) + y
            came.append((from0, from1))
        label = int(b > a)
        out = [label]
        for step in reversed(came):
            label = step[label]
            out.append(label)
        return out[::-1]

    def fit(self, pages: list[tuple[list[list[str]], list[int]]], rounds: int = 12, rate: float = 0.3, decay: float = 1e-4, seed: int = 3) -> Field:
        """Stochastic gradient ascent on the log likelihood, adapted by feature."""
        rng = random.Random(seed)
        seen: dict[str, np.ndarray] = {}
        seen_moves = np.full((2, 2), 1e-6)
        order = list(range(len(pages)))
        for _ in range(rounds):
            rng.shuffle(order)
            for p in order:
                rows, labels = pages[p]
                if not rows:
                    continue
                emit = np.array(self.scores(rows))
                n = len(rows)
                fore, back = np.zeros((n, 2)), np.zeros((n, 2))
                fore[0] = emit[0]
                for i in range(1, n):
                    fore[i] = np.logaddexp.reduce(fore[i - 1][:, None] + self.moves, axis=0) + emit[i]
                for i in range(n - 2, -1, -1):
                    back[i] = np.logaddexp.reduce(self.moves + (emit[i + 1] + back[i + 1])[None, :], axis=1)
                total = np.logaddexp.reduce(fore[-1])
                gradient = -np.exp(fore + back - total)
                gradient[np.arange(n), labels] += 1
                for row, g in zip(rows, gradient, strict=True):
                    for f in row:
                        w = self.weights.setdefault(f, np.zeros(2))
                        s = seen.setdefault(f, np.full(2, 1e-6))
                        step = g - decay * w
                        s += step * step
                        w += rate * step / np.sqrt(s)
                change = np.zeros((2, 2))
                for i in range(1, n):
                    change[labels[i - 1], labels[i]] += 1
                    change -= np.exp(fore[i - 1][:, None] + self.moves + (emit[i] + back[i])[None, :] - total)
                seen_moves += change * change
                self.moves = self.moves + rate * change / np.sqrt(seen_moves)
        self.weights = {f: (float(w[0]), float(w[1])) for f, w in self.weights.items()}  # type: ignore[misc]
        return self


def labelled_pages(n: int = 400, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Pages of usual layouts with the label of each block; (html, labels)."""
    rng = random.Random(seed)
    syllables = "ka lo mi ren tas vor el und der que ción le ment ing tion er an the of ß ñe été ü".split()

    def word() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))

    def words(a: int, b: int) -> str:
        return " ".join(word() for _ in range(rng.randint(a, b)))

    def sentence(a: int = 5, b: int = 16) -> str:
        s = words(a, b).capitalize() + rng.choice([".", ".", ".", "!", "?", ""])
        return s if rng.random() < 0.9 else " | ".join(s.split())

    usual = "search menu share terms comments privacy cookie reply subscribe advertising read more sign in copyright".split()

    def prose() -> str:
        if rng.random() < 0.15:  # words of menus and notices are words of articles too
            parts = sentence().split()
            parts.insert(rng.randrange(len(parts)), rng.choice(usual))
            return " ".join(parts)
        return rng.choice(["", "", " ", "\n"]).join(["" if rng.random() < 0.01 else " " + sentence() for _ in range(rng.choice([1, 1, 2, 3, 6]))]).strip() or word()

    made = []
    for _ in range(n):
        parts: list[str] = []
        labels: list[int] = []

        def put(html: str, *own: int) -> None:
            parts.append(html)
            labels.extend(own)

        def attr(*names: str) -> str:
            return rng.choice([f' class="{x}"' for x in names] + [f' id="{x}"' for x in names] + [f' class="box {x} wide"' for x in names])

        def menu() -> None:
            k = rng.randint(2, 7)
            items = "".join(f'<li><a href="/{i}">{words(1, 2)}</a></li>' for i in range(k))
            put(rng.choice([f"<nav><ul>{items}</ul></nav>", f"<ul{attr('menu', 'nav', 'navbar')}>{items}</ul>", f'<div role="navigation"><ul>{items}</ul></div>']), *[0] * k)

        def ad() -> None:
            put(f"<div{attr('ad', 'ads', 'advert', 'sponsored', 'promo-box')}>{sentence()}</div>", 0)

        def notice() -> None:
            put(f"<div{attr('cookie-notice', 'notice', 'consent', 'newsletter', 'popup')}><p>{rng.choice(['We use cookies. ', 'Subscribe! ', ''])}{sentence()}</p></div>", 0)

        def form() -> None:
            put(f"<form{attr('search', 'login')}><label>{words(1, 2)}</label><button>{word()}</button></form>", 0, 0)

        def side() -> None:
            k = rng.randint(1, 3)
            body = "".join(rng.choice([f"<p>{sentence()}</p>", f'<p><a href="#">{words(3, 7)}</a></p>']) for _ in range(k))
            put(rng.choice([f"<aside>{body}</aside>", f"<div{attr('sidebar', 'related', 'widget')}>{body}</div>"]), *[0] * k)

        def comments() -> None:
            k = rng.randint(1, 4)
            body = "".join(rng.choice([f"<div class='comment'><p>{prose()}</p></div>", f"<p>{prose()}</p>", f"<li>{prose()}</li>"]) for _ in range(k))
            put(f"<{(t := rng.choice(['section', 'div', 'ol']))}{attr('comments', 'comment-list', 'replies', 'discussion')}>{body}</{t}>", *[0] * k)

        def article() -> None:
            opening, closing = rng.choice([("<article>", "</article>"), ("<main>", "</main>"), (f"<div{attr('content', 'post', 'entry-content', 'story')}>", "</div>"), ("<div>", "</div>"), ("<article>", "")])
            put(opening)
            if rng.random() < 0.8:
                put(f"<h1>{sentence()}</h1>", 1)
            for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
                r = rng.random()
                if r < 0.72:
                    put(rng.choice([f"<p>{prose()}</p>", f"<p>{prose()}", f"<p><b>{prose()}<br>", f"<p>{prose()} <a href='#'>{word()}</a> {words(1, 3)}</p>", f"<div>{prose()}</div>"]), 1)
                elif r < 0.78:
                    put(f"<h2>{words(2, 6)}</h2>", 1)
                elif r < 0.84:
                    k = rng.randint(1, 4)
                    put("<ul>" + "".join(f"<li>{sentence(2, 9)}</li>" for _ in range(k)) + "</ul>", *[1] * k)
                elif r < 0.88:
                    put(f"<blockquote>{prose()}</blockquote>", 1)
                elif r < 0.94:
                    ad()
                else:
                    rng.choice([notice, form, side])()
            if rng.random() < 0.15:
                comments()
            put(closing)

        def footer() -> None:
            put(rng.choice([f"<footer>&copy; {word()}.example &middot; {sentence()}</footer>", f"<footer><p>{sentence()}</p></footer>", f"<div{attr('footer', 'copyright')}>{sentence()}</div>"]), 0)

        def header() -> None:
            put(rng.choice([f"<header><p>{words(1, 5)}</p></header>", f"<div{attr('header', 'masthead', 'topbar')}>{words(1, 5)}</div>"]), 0)

        bare = rng.random() < 0.2  # an article and nothing around it, often one paragraph
        for make, chance in () if bare else ((header, 0.4), (menu, 0.85), (notice, 0.3), (ad, 0.6), (form, 0.2), (side, 0.2)):
            if rng.random() < chance:
                make()
        if bare and rng.random() < 0.6:
            tag = rng.choice(["article", "main", "div", "section", "body"])
            put(f"<{tag}>" + rng.choice([f"<p>{prose()}</p>", f"<p>{' '.join(prose() for _ in range(rng.randint(1, 12)))}</p>", prose()]) + f"</{tag}>", 1)
        else:
            article()
        for make, chance in () if bare else ((comments, 0.3), (side, 0.3), (ad, 0.2), (form, 0.1), (notice, 0.1), (footer, 0.85)):
            if rng.random() < chance:
                make()
        page = "<!DOCTYPE html><html><head><title>x</title><script>var t='</p>';</script></head><body>" + "".join(parts) + "</body></html>"
        if len(blocks_of(page)) == len(labels):  # else a layout ran two blocks together; the labels would not fit
            made.append((page, labels))
    return made


@lru_cache(4)
def default_field(n: int = 400, seed: int = 11) -> Field:
    return Field().fit([(features(blocks_of(page)), labels) for page, labels in labelled_pages(n, seed)])


def main_text(page: str | None, field: Field) -> str:
    if not page:
        return ""
    blocks = blocks_of(page)
    return "\n".join(text for (text, _), label in zip(blocks, field.decode(features(blocks)), strict=True) if label)


def extract(pages: DataFrame, field: Field | None = None, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    trained = field or default_field()

    def run(column: pd.Series) -> pd.Series:
        return pd.Series([main_text(p if isinstance(p, str) else None, trained) for p in column], dtype=object)

    text = F.pandas_udf(run, "string")(F.col(html))
    out = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), text.alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
