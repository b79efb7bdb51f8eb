"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks, decoded by Viterbi.

A page is read once into leaf blocks (runs of text between block-level tags) with their open ancestors. Features of a
block are its ancestors' tags, what their class, id and role names say, and its text (length, share of linked text,
sentence ends, page-furniture words). Two labels, text and furniture; weights of features and of label transitions
maximise the likelihood of labelled pages (``labelled_pages`` makes a fixed set of varied layouts, with and without a
container of the article, with names that mislead, with much furniture or none; ``train`` takes any).
Blocks labelled text are joined in page order.

Defined results: a null or empty page has the empty text; character references are decoded, white space (no-break
spaces included) inside a block becomes one space, blocks are joined by one space; comments, scripts, styles, titles and
form parts are never text, while the text of formulas, drawings, embedded objects and media is read like any other; unclosed and stray tags are repaired as browsers do for paragraphs, lists and tables;
pages of any length are read whole; repeated rows give repeated results; only the three named columns are read; an
empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML.
RAW = frozenset("script style template noscript title textarea iframe select".split())
#: Without an end tag these reach to the end of the page; of the other raw ones only the tag is skipped then.
TO_THE_END = frozenset("script style title textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul button label".split())
#: An opening tag closes these open ones (up to the nearest of the second set).
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
          "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
KEEPS_P = frozenset("button label".split())
#: What names of classes, ids and roles say.
NAMES = (
    ("ad", r"ads?|adv|advert\w*|sponsor\w*|promo\w*|banner|dfp|outbrain|taboola|partner\w*"),
    ("menu", r"nav\w*|menu\w*|breadcrumbs?|tabs?|toolbar|pagination|pager|toc|skip"),
    ("side", r"side\w*|aside|widgets?|related|recommend\w*|trending|popular|complementary|more|also|rail|recent|archives?"),
    ("foot", r"foot\w*|copyright|colophon|legal|contentinfo"),
    ("head", r"masthead|header|topbar|logo|site|brand\w*"),
    ("comment", r"comments?|commentlist|repl(?:y|ies)|respond|discussion|disqus|reviews?|thread|responses?|feedback"),
    ("notice", r"cookies?|consent|gdpr|notices?|alert\w*|popup|modal|overlay|banner|newsletter|subscri\w*|signup|paywall|warning|announcement|dialog"),
    ("share", r"share\w*|social|tweet|facebook|follow|tags?|tools|actions|buttons?|rating"),
    ("form", r"form\w*|search\w*|login|input|contact|poll|survey"),
    ("main", r"content|article\w*|post\w*|entry\w*|story\w*|main|body|text|prose|single|hentry|page|blog|news"),
    ("by", r"author|byline|meta|date|time|published|caption|credit"),
    ("hidden", r"hidden|invisible|sr|visually|screen|offscreen|print|display:none"),
)
_NAME = re.compile("|".join(rf"(?P<{n}>(?:{p}))\Z" for n, p in NAMES))
#: Names of an article in the generated pages that say something else.
MISLEADING = ("review", "post comments-open", "has-sidebar", "post with-ads", "notice", "post share-on", "story contact")
#: Words of page furniture in a text.
PHRASES = re.compile(
    r"(?P<copy>©|\(c\)|copyright|all rights)|(?P<cookie>cookie|consent|privacy)|(?P<reply>\breply\b|comment|\bsaid:|wrote:)"
    r"|(?P<sub>subscribe|newsletter|sign up|log ?in|sign in)|(?P<more>read more|related|share this|advert|sponsored|skip to)", re.I)  # fmt: skip
_PIECE = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|<""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)


@dataclass
class Block:
    """A leaf block: its text, its open elements (tag, names) and how many of its characters are linked."""

    text: str
    above: tuple
    linked: int


@lru_cache(100_000)
def names_of(attributes: str) -> tuple[str, ...]:
    """What an element's class, id, role and style names say."""
    found = set()
    for key, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        if key.lower() == "hidden" and not value:
            found.add("hidden")
        for word in re.split(r"[\s_\-;]+", re.sub(r"\s*:\s*", ":", value)):
            if m := _NAME.match(word):
                found.add(m.lastgroup)
    return tuple(sorted(found))


def leaf_blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page, in order; blank ones are left out."""
    blocks: list[Block] = []
    stack: list[tuple[str, tuple]] = []
    parts: list[str] = []
    linked = 0
    page = page or ""

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                blocks.append(Block(text, tuple(stack), min(linked, len(text))))
            parts.clear()
        linked = 0

    def said(text: str) -> None:
        nonlocal linked
        if "&" in text:
            text = unescape(text)
        parts.append(text)
        if any(tag == "a" for tag, _ in stack):
            linked += len(text.strip())

    def close(tags: set, within: frozenset | set) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                del stack[k:]
                return
            if stack[k][0] in within:
                return

    at = 0
    while True:
        m = _PIECE.search(page, at)
        if m is None:
            said(page[at:])
            break
        if m.start() > at:
            said(page[at:m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0] == "<":
                said("<")
            continue
        if m[1]:
            if tag in BLOCK:
                flush()
            if any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass
            elif tag == "br":
                parts.append(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page) if tag in TO_THE_END else at
            continue
        if tag in BLOCK:
            flush()
            if tag not in KEEPS_P:
                close({"p"}, BLOCK - {"p"})
            if tag in CLOSES:
                close(*CLOSES[tag])
            if re.fullmatch("h[1-6]", tag):
                close({"h1", "h2", "h3", "h4", "h5", "h6"}, BLOCK)
        if tag in VOID or (m[3].endswith("/") and any(t in ("svg", "math") for t, _ in stack)):
            if tag == "br" or tag == "hr":
                parts.append(" ")
        else:
            stack.append((tag, names_of(m[3]) if m[3].strip() else ()))
    flush()
    return blocks


@lru_cache(50_000)
def place_features(above: tuple) -> tuple[str, ...]:
    """Features of a block's ancestors."""
    out = {f"self={above[-1][0]}"} if above else {"self="}
    inner = outer = ""
    for tag, names in above:
        held = inner
        if tag not in ("html", "body"):
            out.add(f"in={tag}")
        for name in names:
            out.add(f"name={name}")
            inner = name if name in ("main", "comment", "ad", "side", "notice", "menu", "share", "form", "foot") else inner
        if tag in ("nav", "aside", "footer", "header", "form", "article", "main"):
            inner = tag
        outer = held if held != inner else outer
    out |= {f"inner={inner}", f"inner={outer}>{inner}"}
    return tuple(sorted(out))


def text_features(block: Block, k: int, n: int) -> list[str]:
    """Features of a block's text and place in the page."""
    text = block.text
    words = text.count(" ") + 1
    out = ["bias", f"words={min(words.bit_length(), 8)}", f"linked={min(4, 5 * block.linked // max(1, len(text)))}", f"stops={min(3, len(re.findall(r'[.!?](?: |$)', text)))}"]
    if text[-1] in ".!?\"”»":
        out.append("ends")
    said = [m.lastgroup for m in PHRASES.finditer(text)]
    if 60 * len(said) >= words:  # a few of them in a long paragraph are its subject, not furniture
        out += [f"says={name}" for name in said]
    out.append(f"at={4 * k // n}")
    return out


def page_features(blocks: list[Block]) -> list[list[str]]:
    return [[*place_features(b.above), *dict.fromkeys(text_features(b, k, len(blocks)))] for k, b in enumerate(blocks)]


@dataclass
class ChainField:
    """Weights of a two-label linear chain: per feature for the label text against furniture, and per transition."""

    weights: dict[str, float]
    step: list[list[float]]
    start: list[float]
    places: dict[tuple, float] = field(default_factory=dict)

    def weigh(self, row: list[str]) -> float:
        return sum(self.weights.get(f, 0.0) for f in row)

    def gains(self, blocks: list[Block]) -> list[float]:
        """Summed weights of the features of each block; what open elements weigh is kept for the next block with the same."""
        places, out = self.places, []
        if len(places) > 50_000:
            places.clear()
        for k, b in enumerate(blocks):
            if (place := places.get(b.above)) is None:
                place = places[b.above] = self.weigh(place_features(b.above))
            out.append(place + self.weigh(list(dict.fromkeys(text_features(b, k, len(blocks))))))
        return out

    def decode(self, gains: list[float]) -> list[int]:
        """The likeliest labels of a page's blocks (Viterbi), from what each block's features weigh for the label text."""
        if not gains:
            return []
        (s00, s01), (s10, s11) = self.step
        zero, one, back = self.start[0], self.start[1], []
        for k, gain in enumerate(gains):
            if k:
                a, b = (zero + s00, 0) if zero + s00 >= one + s10 else (one + s10, 1)
                c, d = (one + s11, 1) if one + s11 >= zero + s01 else (zero + s01, 0)
                zero, one = a, c
                back.append((b, d))
            one += gain
        out = [int(one > zero)]
        for pair in reversed(back):
            out.append(pair[out[-1]])
        return out[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], steps: int = 150, l2: float = 1e-3, rate: float = 0.15) -> ChainField:
    """Maximum likelihood with a small penalty: forward-backward over all pages at once, Adam steps."""
    pages = [p for p in pages if p[0]]
    index = {f: k for k, f in enumerate(sorted({f for rows, _ in pages for row in rows for f in row}))}
    most, n = max(len(rows) for rows, _ in pages), len(pages)
    flat_rows = [(p, t, [index[f] for f in row]) for p, (rows, _) in enumerate(pages) for t, row in enumerate(rows)]
    x = np.zeros((len(flat_rows), len(index)))
    for r, (_, _, ids) in enumerate(flat_rows):
        x[r, ids] = 1
    at = np.array([(p, t) for p, t, _ in flat_rows])
    y = np.zeros((n, most), int)
    real = np.zeros((n, most), bool)
    for p, (_, labels) in enumerate(pages):
        y[p, :len(labels)], real[p, :len(labels)] = labels, True
    size = len(index)
    theta = np.zeros(size + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    total = len(flat_rows)
    for it in range(1, steps + 1):
        w, step, start = theta[:size], theta[size:size + 4].reshape(2, 2), theta[size + 4:]
        e = np.zeros((n, most, 2))
        e[at[:, 0], at[:, 1], 1] = x @ w
        alpha, beta = np.zeros((n, most, 2)), np.zeros((n, most, 2))
        alpha[:, 0] = start + e[:, 0]
        for t in range(1, most):
            alpha[:, t] = np.where(real[:, t, None], np.logaddexp.reduce(alpha[:, t - 1, :, None] + step, axis=1) + e[:, t], alpha[:, t - 1])
        for t in range(most - 2, -1, -1):
            beta[:, t] = np.where(real[:, t + 1, None], np.logaddexp.reduce(step[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2), 0)
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        p1 = np.exp(alpha[..., 1] + beta[..., 1] - z[:, None])
        grad = np.zeros_like(theta)
        grad[:size] = x.T @ (y - p1)[at[:, 0], at[:, 1]] / total - l2 * w
        pairs = np.exp(alpha[:, :-1, :, None] + step + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * real[:, 1:, None, None]
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:, :-1][real[:, 1:]], y[:, 1:][real[:, 1:]]), 1)
        grad[size:size + 4] = ((seen - pairs.sum((0, 1))) / total).ravel()
        first = np.stack([1 - p1[:, 0], p1[:, 0]], 1).sum(0)
        grad[size + 4:] = (np.bincount(y[:, 0], minlength=2) - first) / total
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + rate * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.99**it)) + 1e-8)
    return ChainField(dict(zip(sorted(index), theta[:size].tolist(), strict=True)), theta[size:size + 4].reshape(2, 2).tolist(), theta[size + 4:].tolist())


def labelled_pages(count: int = 400, seed: int = 11) -> list[tuple[str, list[str]]]:
    """(html, texts of the blocks that are main text) of varied layouts, with invented words."""
    import random

    draw = random.Random(seed)
    sounds = ["ka", "lo", "mi", "ter", "su", "an", "be", "dor", "ei", "fu", "gra", "hin", "é", "ñu", "ße", "ol", "pra", "qui", "ri", "sta"]

    def word() -> str:
        return "".join(draw.choices(sounds, k=draw.randint(1, 4)))

    def words(low: int, high: int) -> str:
        return " ".join(word() for _ in range(draw.randint(low, high)))

    def sentence(low: int = 3, high: int = 18) -> str:
        noise = "".join(draw.choices("!?.,:;%#*|~_$&-=+", k=draw.randint(1, 4))) if draw.random() < 0.3 else ""
        return words(low, high).capitalize() + draw.choice([".", ".", ".", "!", "?", ""]) + draw.choice(["", " "]) * bool(noise) + noise

    def prose(n: int = 4) -> str:
        return " ".join(sentence() for _ in range(draw.randint(1, n)))

    def tag(name: str, inner: str, attributes: str = "") -> str:
        return f"<{name}{' ' + attributes if attributes else ''}>{inner}</{name}>"

    def links(n: int) -> str:
        made = [f'<a href="/{word()}">{words(1, 3)}</a>' for _ in range(n)]
        return tag("ul", "".join(tag("li", a) for a in made)) if draw.random() < 0.7 else draw.choice([" | ", " ", " · "]).join(made)

    def named(*choices: str) -> str:
        return f'{draw.choice(["class", "id", "class"])}="{draw.choice(choices)}"'

    def furniture(kind: str) -> str:
        inner = prose(3) if draw.random() < 0.7 else words(1, 12)
        if kind == "nav":
            return draw.choice([tag("nav", links(draw.randint(2, 9))), tag("div", links(draw.randint(2, 9)), named("menu", "nav-bar", "breadcrumbs", "navigation"))])
        if kind == "header":
            return tag("header", draw.choice([tag("h1", words(1, 4)), tag("div", words(1, 5), named("logo", "site-title")), ""]) + draw.choice(["", tag("nav", links(4)), tag("p", inner)]))
        if kind == "footer":
            return tag(*draw.choice([("footer", "&copy; " + words(1, 3) + " &middot; " + inner), ("footer", tag("p", "Copyright " + inner) + links(3)), ("div", "© " + inner, 'class="footer"')]))
        if kind == "ad":
            return tag("div", draw.choice([inner, tag("p", inner), tag("a", inner, 'href="/x"')]), named("ad", "ads", "advert", "sponsored", "promo-box", "ad-slot", "banner"))
        if kind == "side":
            return draw.choice([tag("aside", tag("h3", words(1, 3)) + draw.choice([links(5), tag("p", inner)])), tag("div", tag("h4", words(1, 3)) + draw.choice([links(4), tag("p", inner)]), named("sidebar", "widget", "related", "side-col"))])
        if kind == "notice":
            return tag(draw.choice(["div", "section", "p"]), draw.choice([inner, "Cookies: " + inner]), named("cookie-notice", "notice", "consent", "alert", "newsletter", "popup"))
        if kind == "form":
            return tag("form", tag("label", words(1, 4)) + '<input name="q">' + tag("button", words(1, 2)) + draw.choice(["", tag("p", inner), tag("select", tag("option", words(1, 2)))]))
        if kind == "share":
            return tag("div", links(3), named("share", "social-links", "post-tags"))
        lines = "".join(tag(draw.choice(["div", "div", "li", "article"]), tag("span", words(1, 2), 'class="author"') + tag("p", prose(3)), named("comment", "reply", "comment-body")) for _ in range(draw.randint(1, 5)))
        return draw.choice([tag("section", tag("h2", words(1, 2)) + lines, named("comments", "discussion", "responses")), tag("div", lines, named("comments", "comment-list", "disqus"))])

    pages = []
    for k in range(count):
        main: list[str] = []

        def text_block(main: list[str] = main) -> str:
            kind = draw.random()
            if kind < 0.68:
                said = prose(6)
                main.append(said)
                html_said = said.replace("&", "&amp;")
                if draw.random() < 0.2:
                    return f"<p><b>{html_said}<br>"
                said_words = html_said.split(" ")
                if draw.random() < 0.2:
                    spot = draw.randrange(len(said_words))
                    said_words[spot] = f'<a href="/{word()}">{said_words[spot]}</a>'
                    html_said = " ".join(said_words)
                return draw.choice([tag("p", html_said), tag("p", html_said), f"<p>{html_said}", tag("div", html_said)])
            if kind < 0.8:
                said = words(1, 8).capitalize()
                main.append(said)
                return tag(draw.choice(["h2", "h3", "h2", "h4"]), said)
            if kind < 0.88:
                items = [sentence(1, 9) for _ in range(draw.randint(2, 5))]
                main.extend(items)
                return tag(draw.choice(["ul", "ol"]), "".join(tag("li", i) for i in items))
            said = prose(2)
            main.append(said)
            return tag(draw.choice(["blockquote", "pre", "td", "figcaption", "dd"]), said) if kind < 0.96 else tag("table", tag("tr", tag("td", said)))

        inside = []
        if draw.random() < 0.8:
            title = words(1, 9).capitalize()
            main.append(title)
            inside.append(tag("h1", title))
        for _ in range(draw.choice([1, 1, 1, 2, 3, 5, 8, 14])):
            inside.append(text_block())
            if draw.random() < 0.07:
                inside.append(furniture(draw.choice(["ad", "share", "side", "notice", "form"])))
        if draw.random() < 0.15:
            inside.append(furniture("comment"))
        body = "".join(inside)
        before = [furniture(x) for x in draw.sample(["nav", "ad", "header", "notice", "form", "side", "nav", "share"], draw.choice([0, 1, 2, 3, 4, 5]))]
        after = [furniture(x) for x in draw.sample(["footer", "comment", "side", "ad", "form", "share", "notice", "nav"], draw.choice([0, 1, 2, 3, 4, 5]))]
        form = draw.random()
        if form < 0.3:
            body = tag("article", body, draw.choice(["", "", 'class="post"', named(*MISLEADING)]))
        elif form < 0.38:
            body = tag("main", body, draw.choice(["", "", named(*MISLEADING)]))
        elif form < 0.52:
            body = tag("div", body, named("content", "article-body", "post-content", "entry", "story-text", "main-content"))
        elif form < 0.7:
            for _ in range(draw.randint(1, 3)):
                body = tag(draw.choice(["div", "div", "section"]), body, draw.choice(["", named("wrapper", "row", "col-8", "container", "inner", "x1", word())]))
        elif form < 0.76:
            body = tag("table", tag("tr", tag("td", body)))
        elif form < 0.8 and not before and not after:
            main[:] = [prose(8)]
            body = main[0].replace("&", "&amp;")
            if draw.random() < 0.5:
                pages.append((body, main))
                continue
        pages.append((f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title><script>var a='</p>';</script></head><body>{''.join(before)}{body}{''.join(after)}</body></html>", main))
    return pages


def labelled_blocks(pages: list[tuple[str, list[str]]]) -> list[tuple[list[list[str]], list[int]]]:
    """Features and labels of pages; a block is text if its text is the next of the page's main texts."""
    out = []
    for html, main in pages:
        blocks, labels, k = leaf_blocks(html), [], 0
        for b in blocks:
            hit = k < len(main) and b.text == " ".join(main[k].split())
            labels.append(int(hit))
            k += hit
        out.append((page_features(blocks), labels))
    return out


@lru_cache(2)
def default_field(count: int = 400, seed: int = 11) -> ChainField:
    return train(labelled_blocks(labelled_pages(count, seed)))


def main_text(page: str | None, model: ChainField) -> str:
    """The main text of a page."""
    blocks = leaf_blocks(page)
    return " ".join(b.text for b, y in zip(blocks, model.decode(model.gains(blocks)), strict=True) if y)


def extract_text(pages: DataFrame, model: ChainField | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    weights = model or default_field()
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                texts = [main_text(h.as_py(), weights) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                                 names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.col("html")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
