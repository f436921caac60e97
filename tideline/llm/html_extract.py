"""HTML extraction with a recurrent block labeller.

A page becomes the sequence of its leaf blocks: runs of text between block-level tags.
Each block has a vector of its tag path (tags, and known parts of class and id names), a
hashed vector of its words, and measures of itself and of the elements around it (how much
text they hold and how much of that is links). A bidirectional LSTM in numpy reads the whole
sequence and labels every block as main text or not. It is trained here, on generated pages of
many layouts whose blocks are known, with telling names, machine-made names and none; batches
of pages run through it inside tasks.
"""

from __future__ import annotations

import functools
import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

WORD, MEASURES, LEVELS = 128, 6, 4
HIDDEN = 24
TRAINING_PAGES = 1600
EPOCHS = 5
SEED = 5

# Fixed values of HTML: elements inside a line of text (of formulas and drawings, too), without an end tag, with text
# that is not shown or stands in form controls, with raw text, those that may stand in a head, those that end an open
# paragraph, and those that a new one of their kind ends.
INLINE = set("a abbr acronym audio b bdi bdo big br canvas cite code data del dfn em font i img ins kbd label map mark object output picture q rp rt ruby s samp small span strike strong sub sup time tt u var video wbr".split())
INLINE |= set("annotation math mfrac mi mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics".split())
INLINE |= set("circle defs ellipse g line lineargradient path polygon polyline radialgradient rect stop svg symbol text tspan use".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TEXT = set("script style noscript template head title iframe select textarea button option".split())
RAW = ("script", "style", "textarea", "title", "iframe", "noscript", "xmp")
IN_HEAD = set("base link meta title style script noscript template".split())
ENDS_PARAGRAPH = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS_OWN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = set("ul ol dl table tbody thead tfoot article section div body main aside nav".split())

# Names that the tag path tells apart: elements, whole words of class, id and role, and parts of such words.
_TAGS = set("address article aside blockquote body center dd details div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header li main menu nav ol p pre section summary table td th tr ul".split())
_WHOLE = set("ad ads ad1 ads1 side rail main body text post page top tools toc bas haut pied kopf fuss alert more".split())
_PARTS = set("advert aktuell alert anzeig article artikel author banner bottom breadcrumb byline colophon comment consent content contenido contenu cookie copyright corps cuerpo discussion disqus entry enlace footer form gdpr head inhalt legal login mast menu meta nav news notice popular post primary privacy promo publici recommend region related replies reply response review search secondary share sharing sidebar sign social sponsor story subscri tag title toolbar topnav trend widget werbung".split())
_PATH_SLOTS = {name: k for k, name in enumerate([*(f"<{t}>" for t in sorted(_TAGS)), *(f"={w}" for w in sorted(_WHOLE)), *sorted(_PARTS)])}
PATH = len(_PATH_SLOTS)
INPUTS = PATH + WORD + MEASURES + 3 * LEVELS

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_STOP = re.compile(r">|=\s*([\"'])")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


class Place:
    """An open element by its names (<tag>, then words of class, id and role) and the one around it."""

    __slots__ = ("around", "names", "depth", "_row")

    def __init__(self, around: Place | None, names: tuple[str, ...]) -> None:
        self.around, self.names, self._row = around, names, None
        self.depth: int = len(names) + (around.depth if around else 0)

    def row(self) -> np.ndarray:
        """Which slots the names from the outermost element to this one fill; each place is computed once."""
        waiting, place = [], self
        while place is not None and place._row is None:
            waiting.append(place)
            place = place.around
        row = place._row if place is not None else np.zeros(PATH, bool)
        for place in reversed(waiting):
            row = row.copy()
            row[[k for name in place.names for k in _path_slots(name)]] = True
            place._row = row
        return row


class Block(NamedTuple):
    text: str
    place: Place | None
    linked: int  # characters inside links


def _spaced(text: str) -> str:
    return " ".join(text.split())


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """start, end, name ("": comment or declaration), whether it ends an element, and attributes of each tag; one pass.

    A quoted value may hold >. Where a quote never closes, the tag ends at the first >; where
    none follows, what is left is text.
    """
    at, unclosed = 0, set()
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(page)
            yield start, at, "", False, ""
            continue
        closing = page.startswith("</", start)
        name = _NAME.match(page, start + 1 + closing)
        if not name:
            end = page.find(">", start) if page[start + 1 : start + 2] in ("!", "?") else -1
            at = end + 1 if end >= 0 else start + 1
            if end >= 0:
                yield start, at, "", False, ""
            continue
        end = name.end()
        while m := _STOP.search(page, end):
            if not m[1]:
                break
            close = page.find(m[1], m.end()) if m[1] not in unclosed else -1
            if close < 0:
                # No later quote of this kind closes either, so the page is searched for it once.
                unclosed.add(m[1])
                end = m.end()
            else:
                end = close + 1
        if not m:
            return
        at = m.end()
        yield start, at, name[0].lower(), closing, page[name.end() : m.start()]


def blocks(page: str) -> list[Block]:
    """Leaf blocks with text, in page order; hidden text is left out, character references are decoded.

    Time and memory grow with the page's length, however its tags are nested or broken.
    """
    out: list[Block] = []
    stack: list[tuple[str, Place | None]] = []
    texts: list[str] = []
    opened: Counter[str] = Counter()
    hidden = linked = 0

    def flush() -> None:
        nonlocal linked
        if not texts:
            return
        text = "".join(texts)
        text = _spaced(html.unescape(text) if "&" in text else text)
        if text:
            out.append(Block(text, stack[-1][1] if stack else None, min(linked, len(text))))
        texts.clear()
        linked = 0

    def pop() -> str:
        nonlocal hidden
        tag, _ = stack.pop()
        opened[tag] -= 1
        hidden -= tag in HIDDEN_TEXT
        return tag

    def close(some: set[str], scope: set[str]) -> None:
        if not any(opened[t] for t in some):
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in some:
                flush()
                while len(stack) > k:
                    pop()
                return
            if stack[k][0] in scope:
                return

    def say(piece: str) -> None:
        nonlocal linked
        if piece and stack and stack[-1][0] == "head" and not piece.isspace():
            pop()  # what can't stand in a head ends it
        if piece and not hidden:
            texts.append(piece)
            if opened["a"]:
                linked += len(_spaced(piece))

    at = 0
    for start, end, tag, closing, attributes in tags(page):
        if start < at:
            continue  # inside raw text
        say(page[at:start])
        at = end
        if not tag:
            continue
        if closing:
            if opened[tag]:
                if tag not in INLINE:
                    flush()
                while pop() != tag:
                    pass
            continue
        if stack and stack[-1][0] == "head" and tag not in IN_HEAD:
            pop()
        if tag in RAW:  # scripts and the like don't part a line of text
            raw_end = _raw_end(tag).search(page, at)
            at = raw_end.end() if raw_end else len(page)
            continue
        if tag not in INLINE:
            flush()
            if tag in ENDS_PARAGRAPH:
                close({"p"}, SCOPES)
            if tag in ENDS_OWN:
                close(ENDS_OWN[tag], SCOPES - {"div", "section", "article"})
        elif tag in ("br", "img"):
            texts.append(" ")
        if tag in VOID or attributes.endswith("/"):
            continue
        place = stack[-1][1] if stack else None
        if tag not in INLINE:
            place = Place(place, (f"<{tag}>", *(n for x in _NAMES.findall(attributes) for n in re.split(r"[\s_-]+", "".join(x).lower()) if n)))
        stack.append((tag, place))
        opened[tag] += 1
        hidden += tag in HIDDEN_TEXT
    say(page[at:])
    flush()
    return out


@functools.cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*>", re.I)


@functools.lru_cache(maxsize=100_000)
def _slot(name: str, size: int) -> int:
    return zlib.crc32(name.encode()) % size


@functools.lru_cache(maxsize=100_000)
def _path_slots(name: str) -> tuple[int, ...]:
    """Slots of a tag or of a word of a class; machine-made names have none."""
    if name.startswith("<"):
        return (_PATH_SLOTS[name],) if name in _PATH_SLOTS else ()
    whole = (_PATH_SLOTS[f"={name}"],) if name in _WHOLE else ()
    return whole + tuple(_PATH_SLOTS[part] for part in sorted(_PARTS) if part in name)


def _held(found: list[Block]) -> dict[Place | None, list[int]]:
    """Characters, and those inside links, that each element around a block holds; None is the page."""
    held: dict[Place | None, list[int]] = {None: [0, 0]}
    for b in found:
        place = b.place
        while place is not None and place not in held:
            held[place] = [0, 0]
            place = place.around
        of = held[b.place]
        of[0] += len(b.text)
        of[1] += b.linked
    for place in sorted((p for p in held if p is not None), key=lambda p: -p.depth):
        of, around = held[place], held[place.around]
        around[0] += of[0]
        around[1] += of[1]
    return held


def vectors(found: list[Block]) -> np.ndarray:
    x = np.zeros((len(found), INPUTS), np.float32)
    held = _held(found)
    page = held[None][0] - held[None][1] or 1
    for row, b in zip(x, found, strict=True):
        depth = 0
        if b.place is not None:
            row[:PATH], depth = b.place.row(), b.place.depth
        words = b.text.lower().split()
        row[PATH : PATH + WORD] = np.bincount([_slot(w.strip(".,:;!?()") or w, WORD) for w in words], minlength=WORD) / len(words)
        n = len(b.text)
        measures, place = [], b.place
        for _ in range(LEVELS):
            chars, linked = held[place]
            measures += [min(1.0, np.log1p(chars) / 10), linked / chars, (chars - linked) / page]
            place = place.around if place is not None else None
        row[PATH + WORD + MEASURES :] = measures
        row[PATH + WORD : PATH + WORD + MEASURES] = (min(1.0, np.log1p(n) / 8), b.linked / n, min(4.0, depth / 16), min(1.0, b.text.count(".") / 8), b.text[-1] in ".!?", min(1.0, n / 40))
    return x


class Labeller(NamedTuple):
    w: np.ndarray  # [2 directions, inputs + hidden + 1, 4 * hidden]
    out: np.ndarray  # [2 * hidden + 1]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(w: np.ndarray, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
    """x [time, pages, inputs], mask [time, pages]: states [time, pages, hidden] and what backward needs."""
    t, n, _ = x.shape
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    states, kept = np.zeros((t, n, HIDDEN), np.float32), []
    ahead = x @ w[:INPUTS] + w[-1]
    for k in range(t):
        z = ahead[k] + h @ w[INPUTS:-1]
        i, f, o = (_sigmoid(z[:, g * HIDDEN : (g + 1) * HIDDEN]) for g in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        c_new = f * c + i * g
        tc = np.tanh(c_new)
        m = mask[k][:, None]
        kept.append((h, c, i, f, o, g, tc))
        h, c = np.where(m, o * tc, h), np.where(m, c_new, c)
        states[k] = h
    return states, kept


def _backward(w: np.ndarray, x: np.ndarray, mask: np.ndarray, kept: list, d_states: np.ndarray) -> np.ndarray:
    grad = np.zeros_like(w)
    dh, dc = np.zeros_like(d_states[0]), np.zeros_like(d_states[0])
    for k in range(len(x) - 1, -1, -1):
        h, c, i, f, o, g, tc = kept[k]
        m = mask[k][:, None]
        dh = dh + d_states[k]
        do, dcn = dh * tc * m, (dc + dh * o * (1 - tc**2)) * m
        dz = np.concatenate([dcn * g * i * (1 - i), dcn * c * f * (1 - f), do * o * (1 - o), dcn * i * (1 - g**2)], 1)
        grad[:INPUTS] += x[k].T @ dz
        grad[INPUTS:-1] += h.T @ dz
        grad[-1] += dz.sum(0)
        dh = np.where(m, dz @ w[INPUTS:-1].T, dh)
        dc = np.where(m, dcn * f, dc)
    return grad


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(len(p) for p in pages)
    x, mask = np.zeros((t, len(pages), INPUTS), np.float32), np.zeros((t, len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, True
    return x, mask


def probabilities(model: Labeller, pages: list[np.ndarray]) -> list[np.ndarray]:
    """Of each block of each page; pages of like length run together."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
    a = 0
    while a < len(order):
        b = a + 1
        while b < len(order) and (b - a + 1) * len(pages[order[b]]) <= 4096:
            b += 1
        some = order[a:b]
        x, mask = _padded([pages[k] for k in some])
        ahead, _ = _forward(model.w[0], x, mask)
        back, _ = _forward(model.w[1], x[::-1], mask[::-1])
        p = _sigmoid(np.concatenate([ahead, back[::-1]], 2) @ model.out[:-1] + model.out[-1])
        for j, k in enumerate(some):
            out[k] = p[: len(pages[k]), j]
        a = b
    return out


def train(pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> Labeller:
    """Adam on the cross-entropy of all blocks, in ever smaller steps."""
    rng = np.random.default_rng(SEED)
    size = INPUTS + HIDDEN + 1
    w = (rng.standard_normal((2, size, 4 * HIDDEN)) * 0.1).astype(np.float32)
    w[:, -1, HIDDEN : 2 * HIDDEN] = 1
    parameters = [w, (rng.standard_normal(2 * HIDDEN + 1) * 0.1).astype(np.float32)]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in parameters]
    step, steps = 0, epochs * -(-len(pages) // 16)
    for _ in range(epochs):
        order = rng.permutation(len(pages))
        for a in range(0, len(order), 16):
            some = [pages[k] for k in order[a : a + 16]]
            x, mask = _padded([p for p, _ in some])
            y = np.zeros(mask.shape, np.float32)
            for k, (_, t) in enumerate(some):
                y[: len(t), k] = t
            w, out = parameters
            ahead, kept = _forward(w[0], x, mask)
            back, kept_back = _forward(w[1], x[::-1], mask[::-1])
            states = np.concatenate([ahead, back[::-1]], 2)
            d = (_sigmoid(states @ out[:-1] + out[-1]) - y) * mask / mask.sum()
            g_out = np.append(np.tensordot(d, states, ((0, 1), (0, 1))), d.sum())
            d_states = d[:, :, None] * out[:-1]
            g_w = np.stack([_backward(w[0], x, mask, kept, d_states[:, :, :HIDDEN]), _backward(w[1], x[::-1], mask[::-1], kept_back, d_states[::-1, :, HIDDEN:])])
            step += 1
            rate = 0.01 * (1.05 - step / steps)
            for p, g, (m1, m2) in zip(parameters, (g_w, g_out), moments, strict=True):
                m1 += 0.1 * (g - m1)
                m2 += 0.001 * (g * g - m2)
                p -= (rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Labeller(*parameters)


# Names that pages give to parts outside the main text, to what holds it, and to what holds anything.
_ASIDE = {
    "nav": "nav menu navbar navigation breadcrumb topnav", "header": "header masthead site-header banner top kopf haut", "footer": "footer site-footer colophon bottom legal fuss pied", "aside": "sidebar aside widget related recommended trending rail popular side",
    "ad": "ad ads advert advertisement sponsored promo banner-ad werbung publicidad", "notice": "cookie notice consent gdpr alert message", "form": "newsletter subscribe signup search login form", "comment": "comments comment comment-list replies discussion reply responses reviews", "share": "share social tags meta-links toolbar",
}
_MAIN = "article content main post entry story text body-text post-content article-body entry-content primary artikel".split()
_ANY = "page site container wrapper content main body row layout region primary".split()
_UTILITY = "flex grid px-4 mt-6 mb-4 text-lg text-sm font-bold bg-white border-t mx-auto max-w-2xl container col-span-8 sticky".split()

# Common words of four languages, and words that stand in parts outside the main text.
_COMMON = [
    "the of and to in is that it was for on with as at by this from they had not are but which one when there".split(),
    "der die das und in zu den ist mit von sich nicht auf ein eine es dem auch als an wurde nach bei noch".split(),
    "le la les de des et en un une du dans que qui il est pour sur pas au plus par avec ce".split(),
    "el la los las de y en un una que se por con para del al es lo como su no más pero".split(),
]
_SAID = {
    "nav": "home news sport business about us contact help login start shop blog inicio accueil startseite next previous index",
    "header": "the daily journal online welcome to skip to content sign in search",
    "footer": "copyright all rights reserved privacy policy terms of use contact imprint © impressum datenschutz alle rechte vorbehalten tous droits réservés mentions légales todos los derechos reservados last updated powered by site",
    "aside": "related articles read more most popular trending now you may also like recent posts archives links mehr zum thema à lire aussi lo más leído categories tools events",
    "ad": "advertisement sponsored buy now anzeige publicidad publicité offer save",
    "notice": "we use cookies to improve your experience accept learn more wir verwenden cookies",
    "form": "subscribe to our newsletter sign up email inbox get updates search abonnez suscríbete your",
    "comment": "thanks great post i agree love this says comments replies reviews thank you",
    "share": "share this twitter facebook email print tweet like",
}


def generated_page(rng: np.random.Generator) -> str:
    """A page in some layout; the blocks of its main text hold the mark \x02 (removed before the model sees them).

    A page names its parts tellingly, tellingly within longer names, by utility classes, by machine-made names or
    not at all, and has semantic tags or not; where nothing names them, links and words tell its parts apart.
    """
    letters = "".join(rng.choice(list("abdeghilmnorstu"), 40))
    common = _COMMON[int(rng.integers(0, 4))] if rng.random() < 0.8 else []
    naming = str(rng.choice(["plain", "longer", "utility", "machine", "none"], p=[0.36, 0.14, 0.12, 0.23, 0.15]))
    semantic = rng.random() < (0.65 if naming in ("plain", "longer") else 0.35)
    told = semantic or naming in ("plain", "longer")
    prefix = str(rng.choice(["css-", "sc-", "_", "k", "x"]))
    machine: dict[str, str] = {}
    by_words = not told or rng.random() < 0.6

    def below(n: int) -> int:
        return int(rng.random() * n)

    def word() -> str:
        if common and rng.random() < 0.45:
            return common[below(len(common))]
        a = below(30)
        return letters[a : a + 2 + below(7)]

    def sentence(n: int) -> str:
        return " ".join(word() for _ in range(n)).capitalize() + [".", ".", ".", "!", "?", ""][below(6)]

    def text(low: int, high: int) -> str:
        return " ".join(sentence(1 + below(13)) for _ in range(low + below(high - low)))

    def title() -> str:
        return sentence(int(rng.integers(1, 12))).rstrip("." if rng.random() < 0.8 else "")

    def said(kind: str, low: int, high: int) -> str:
        """Words of such a part, among any others."""
        if not by_words:
            return text(low, high)
        words = _SAID[kind].split()
        a = int(rng.integers(0, len(words)))
        some = words[a : a + int(rng.integers(1, 8))]
        return (" ".join(some).capitalize() + str(rng.choice([".", "", ""])) + (" " + text(low, high) if rng.random() < 0.35 else "")).strip()

    def link(kind: str) -> str:
        return f'<a href="/{word()}">{said(kind, 1, 2) if rng.random() < 0.3 else sentence(int(rng.integers(1, 7))).rstrip(".")}</a>'

    def links(kind: str, n: int) -> str:
        r = rng.random()
        each = [link(kind) for _ in range(n)]
        if r < 0.55:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in each) + "</ul>"
        if r < 0.7:
            return "".join(f"<div{named('item')}>{x}</div>" for x in each)
        return str(rng.choice(["<br>", " | ", " ", ""])).join(each)

    def named(name: str) -> str:
        if naming == "none" or not name:
            return ""
        if naming == "utility":
            name = " ".join(rng.choice(_UTILITY, 2))
        elif naming == "machine":
            name = machine.setdefault(name, prefix + "".join(rng.choice(list("abcdefghijkmnpqrstuvwxyz0123456789"), int(rng.integers(1, 7)))))
        elif naming == "longer":
            name = str(rng.choice([f"{word()}-{name}", f"{name}__{word()}", f"{name}-wrap {word()}", f"{name}{word()}"]))
        return f' {rng.choice(["class", "id", "class"])}="{name}"'

    def other(kind: str) -> str:
        name = str(rng.choice(_ASIDE[kind].split()))
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, "div")
        plain = tag != "div" and semantic and (naming != "plain" or rng.random() < 0.7)
        open_, close = (f"<{tag}{named(name if rng.random() < 0.3 else '')}>", f"</{tag}>") if plain else (f"<div{named(name)}>", "</div>")
        lead = f"<{(t := str(rng.choice(['h3', 'h2', 'h4', 'div', 'p', 'b'])))}>{said(kind, 1, 2)}</{t}>"
        n = int(rng.integers(2, 10))
        # Only a part whose tag or name tells what it is may hold plain prose.
        prose = (plain or naming in ("plain", "longer")) and rng.random() < 0.7
        body = {
            "nav": lambda: links("nav", n),
            "header": lambda: (f"<p>{said('header', 1, 2)}</p>" if rng.random() < 0.5 else f'<a href="/">{sentence(2)}</a>') + (f"<h1>{sentence(2)}</h1>" if rng.random() < 0.2 and told else "") + links("nav", 3) * int(rng.integers(0, 2)),
            "footer": lambda: (f"&copy; {word()}.example &middot; {text(1, 4) if prose else said('footer', 1, 2)}" if rng.random() < 0.5 else f"<p>{text(1, 3) if prose else said('footer', 1, 3)}</p>" + links("footer", 3)),
            "aside": lambda: lead + links("aside", int(rng.integers(1, 5))) if rng.random() < 0.7 or not prose else f"<h3>{sentence(2)}</h3><p>{text(1, 4)}</p>",
            "ad": lambda: (text(1, 5) if rng.random() < 0.6 else f"<p>{text(1, 4)}</p><a href='/x'>{sentence(2)}</a>") if prose else said("ad", 1, 2) + f" <a href='/x'>{said('ad', 1, 2)}</a>" * int(rng.integers(0, 2)),
            "notice": lambda: f"<p>{text(1, 3) if prose else said('notice', 1, 3)}</p>" + f"<button>{word()}</button>" * int(rng.integers(0, 2)),
            "form": lambda: f"<p>{text(1, 2) if prose else said('form', 1, 3)}</p><label>{word()}</label><input name=q><button>{word()}</button>",
            "comment": lambda: (lead if rng.random() < 0.6 or not prose else "") + "".join(f"<{t}{named('comment')}><p>{said('comment', 1, 3) if not prose else text(1, 6)}</p></{t}>" for t in [str(rng.choice(["div", "li", "article" if told else "div", "section"]))] for _ in range(int(rng.integers(1, 6)))),
            "share": lambda: links("share", 3) if rng.random() < 0.5 else f"<span>{said('share', 1, 2)}</span> <a href='#'>{word()}</a>",
        }[kind]()
        return open_ + body + close

    mark = "\x02"

    def main_block(first: bool) -> str:
        if first:
            t = str(rng.choice(["h1", "h1", "h1", "h2", "div", "b"]))
            if t == "b":
                return f"<p><b>{mark}{title()}</b></p>"
            return f"<{t}{named('headline') if t == 'div' else ''}>{mark}{title()}</{t}>"
        r = rng.random()
        body = mark + (text(1, 9 if r < 0.8 else 3) if rng.random() < 0.75 else sentence(1 + below(4)))
        if r < 0.5:
            return f"<p{named('para') if rng.random() < 0.3 else ''}>{body}</p>"
        if r < 0.62:
            return f"<p><b>{body}<br>"
        if r < 0.7:
            return f"<h{(h := int(rng.integers(2, 4)))}>{mark}{title()}</h{h}>"
        if r < 0.75:
            return f"<blockquote><p>{body}</p></blockquote>" if rng.random() < 0.6 else f"<blockquote>{body}</blockquote>"
        if r < 0.83:
            t = str(rng.choice(["ul", "ol"]))
            return f"<{t}>" + "".join(f"<li>{mark}{sentence(int(rng.integers(2, 12)))}</li>" for _ in range(int(rng.integers(2, 5)))) + f"</{t}>"
        if r < 0.87:
            return "<dl>" + "".join(f"<dt>{mark}{sentence(2)}</dt><dd>{mark}{text(1, 3)}</dd>" for _ in range(int(rng.integers(1, 4)))) + "</dl>"
        if r < 0.91:
            return f"<pre>{body}</pre>"
        if r < 0.94:
            return "<table>" + "".join(f"<tr><td>{mark}{word()}</td><td>{mark}{word()}</td></tr>" for _ in range(int(rng.integers(1, 4)))) + "</table>"
        if r < 0.97:
            return f"<section><p>{body}</p></section>"
        return f"<div>{body}</div>"

    kinds = list(_ASIDE)
    style = rng.random()
    inner = [main_block(k == 0 and rng.random() < 0.8) for k in range(int(rng.integers(1, 12)))]
    if style < 0.12:  # every paragraph in an element of its own
        inner = [inner[0], *(f"<div{named('block')}><div{named('para')}>{mark}{text(1, 6)}</div></div>" if style < 0.06 else f"<div{named('para')}>{mark}{text(1, 6)}</div>" for _ in inner[1:])]
    elif rng.random() < 0.15:
        inner[0] = f"<header>{inner[0]}</header>"
    for kind in rng.choice(["ad", "share", "form", "notice", "aside", "nav"], int(rng.integers(0, 3))):
        inner.insert(int(rng.integers(1, len(inner) + 1)), other(str(kind)))
    if rng.random() < 0.2:
        inner.append(other("comment"))
    r = rng.random()
    main = "".join(inner)
    for _ in range(int(rng.integers(0, 4))):
        main = f"<div{named(str(rng.choice(_MAIN)) if rng.random() < 0.5 else str(rng.choice(_ANY)))}>{main}</div>"
    if told:
        main = f"<article>{main}</article>" if semantic and r < 0.6 else f"<main>{main}</main>" if semantic and r < 0.8 else f"<{(t := str(rng.choice(['div', 'div', 'section'])))}{named(str(rng.choice(_MAIN)))}>{main}</{t}>"
    elif r < 0.85:
        main = f"<div{named('holder')}>{main}</div>"
    before = [other(str(k)) for k in rng.choice(["nav", "header", "ad", "notice", "form", "aside", "share"], int(rng.integers(0, 5)))]
    after = [other(str(k)) for k in rng.choice(kinds, int(rng.integers(0, 5)))]
    if not told and rng.random() < 0.4:  # cells
        foot = f"<tr><td colspan=2>{said('footer', 1, 2)}</td></tr>" if rng.random() < 0.7 else ""
        side, cells = f"<td width=120>{links('nav', int(rng.integers(2, 8)))}</td>", f"<td valign=top>{main}</td>"
        head = f"<tr><td colspan=2>{link('header')}</td></tr>" if rng.random() < 0.6 else ""
        page = f"<table>{head}<tr>{side + cells if rng.random() < 0.6 else cells + side}</tr>{foot}</table>" + ("" if foot or rng.random() < 0.3 else f"<{(t := str(rng.choice(['p', 'center', 'div'])))}><small>{said('footer', 1, 2)}</small></{t}>")
    else:
        page = "".join(before) + main + "".join(after)
        if after and rng.random() < 0.3:  # main text and what stands beside it in one element
            page = "".join(before) + f"<div{named(str(rng.choice(_ANY)))}>{main}{after[0]}</div>" + "".join(after[1:])
    if rng.random() < 0.4:
        page = f"<div{named(str(rng.choice(_ANY)))}>{page}</div>"
    return f"<!DOCTYPE html><html><head><title>{sentence(3)}</title></head><body{named('page') if rng.random() < 0.2 else ''}>{page}</body></html>"


def generated(count: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors and labels of the blocks of generated pages."""
    rng, out = np.random.default_rng(seed), []
    while len(out) < count:
        found = blocks(generated_page(rng))
        labels = np.array(["\x02" in b.text for b in found], np.float32)
        found = [b._replace(text=b.text.replace("\x02", "") or "-") for b in found]
        if found:
            out.append((vectors(found), labels))
    return out


@functools.lru_cache(maxsize=4)
def trained(count: int = TRAINING_PAGES) -> Labeller:
    return train(generated(count, SEED))


def extracted(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars: the main text of each page, its blocks joined by \\n.

    Null and empty pages, and those without main text, have an empty text; every input row
    gives one row. White space inside a block becomes one space; a <br> counts as white space.
    Whole pages of any length are read; other columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                found = [blocks(h or "") for h in part.column("html").to_pylist()]
                p = probabilities(shared.value, [vectors(b) for b in found])
                texts = ["\n".join(x.text for x, q in zip(b, r, strict=True) if q >= 0.5) for b, r in zip(found, p, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
