"""HTML extraction: a recurrent block labeller in numpy.

A page becomes a sequence of leaf blocks: the text between two block-level tags, with
the path of tags, classes and ids above it.  A bidirectional LSTM reads for each block
the summed vectors of its hashed path, the mean vector of its hashed words and a few
measures (length, share of linked text, position, ...), and labels every block in the
context of the whole page.  Blocks labelled as main text are joined.

There are no labels to learn from, so a bounded sample of pages is labelled by what
its markup says (article and main elements against navigation, footers and so on;
``taught``).  Half of the training pages are rewritten: containers get other tags and class
names, and comments, side bars, forms and notices are put in from other pages' blocks, so that
the network learns more than one template's paths.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .learn import Adam, sigmoid

F32 = np.float32
HIDDEN, PATH_DIM, WORD_DIM, MEASURES = 16, 16, 8, 8
PATH_SLOTS, WORD_SLOTS = 8192, 4096
INPUTS = PATH_DIM + WORD_DIM + MEASURES
#: pages that the network is trained on, passes over them, step size
SAMPLE, EPOCHS, RATE, SEED = 400, 12, 0.01, 11

TAG_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
#: what may end a tag or begin a quoted value: quotes count straight after "=" only
STOP = re.compile(r">|=\s*[\"']?")
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME = re.compile(r"[a-z]+")

# fixed values: element names of HTML
BLOCK = frozenset("address article aside base blockquote body button caption center col colgroup dd details dialog dir div dl dt fieldset "
                  "figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html input legend li link "
                  "main menu meta nav noframes ol optgroup option p param plaintext pre search section source summary table tbody td "
                  "tfoot th thead title tr track ul xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements whose content is text up to their end tag, without one up to the end of the page
RAW = frozenset("script style title textarea".split())
#: elements that are skipped with all that is nested in them; without an end tag they are ordinary blocks
SKIPPED = frozenset("noscript iframe template svg math object select".split())
#: of these, the ones that a closing slash makes empty
FOREIGN = frozenset(["svg", "math"])
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table body article section div main aside nav footer header form td blockquote".split())
# what the markup of the training pages says
MAIN_TAGS = frozenset(["article", "main"])
MAIN_NAMES = frozenset("article content post entry story main".split())
OTHER_TAGS = frozenset("nav header footer aside form button menu dialog".split())
OTHER_NAMES = frozenset("nav navigation menu header footer sidebar aside ad ads advert advertisement banner sponsor sponsored promo "
                        "cookie cookies consent notice popup modal newsletter subscribe signup login form comment comments reply "
                        "share social related recommended breadcrumb breadcrumbs pagination pager toolbar widget search copyright "
                        "legal".split())

Block = tuple[tuple[str, ...], str, float]


#: open elements that a tag may close at a distance, and names of a block's path, from the top
DEPTH, PATH_NAMES = 512, 64


class Tags:
    """The tags of a page one after the other, in time linear in the page."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.quotes = True  # until a quoted value is never closed: then every tag ends at the next ">"
        self.unclosed: dict[str, bool] = {}

    def _end(self, at: int) -> int:
        page = self.page
        while self.quotes:
            m = STOP.search(page, at)
            if m is None:
                self.quotes = False
                break
            at, found = m.end(), m[0]
            if found == ">":
                return m.start()
            if found[-1] in "\"'":
                close = -1 if self.unclosed.get(found[-1]) else page.find(found[-1], at)
                if close < 0:
                    self.unclosed[found[-1]] = True  # an ordinary character from here on
                else:
                    at = close + 1
        return -1

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """Begin, end, slash, name (empty: a comment or declaration) and attributes of the first tag from ``at``."""
        page = self.page
        while (begin := page.find("<", at)) >= 0 and begin < self.last or begin >= 0 and page.startswith("<!--", begin):
            at = begin + 1
            if page.startswith("<!--", begin):
                end = page.find("-->", begin + 4)
                return begin, len(page) if end < 0 else end + 3, "", "", ""
            if page[at:at + 1] in "!?":
                return begin, page.find(">", at) + 1, "", "", ""
            m = TAG_NAME.match(page, at)
            if m is None:
                continue
            end = self._end(m.end())
            if end < 0:
                end = page.find(">", m.end())
            return begin, end + 1, m[1], m[2].lower(), page[m.end():end]
        return None

    def after(self, tag: str, at: int) -> int:
        """Where the text element ``tag`` is over: after its end tag, or at the page's end."""
        m = re.compile(f"</{re.escape(tag)}\\b", re.I).search(self.page, at)
        end = self.page.find(">", m.end()) if m else -1
        return end + 1 if end >= 0 else len(self.page)


def skipped_to(tags: Tags) -> dict[int, int]:
    """End of each start tag of a SKIPPED element, and of the end tag that closes it, for the elements that are closed."""
    out: dict[int, int] = {}
    opened: dict[str, list[int]] = {tag: [] for tag in SKIPPED}
    at = 0
    while found := tags.next(at):
        _, at, slash, tag, attributes = found
        if tag in RAW and not slash:
            at = tags.after(tag, at)
        elif tag in SKIPPED:
            if not slash:
                if not empty(tag, attributes):
                    opened[tag].append(at)
            elif opened[tag]:
                out[opened[tag].pop()] = at
    return out


def empty(tag: str, attributes: str) -> bool:
    return tag in FOREIGN and attributes.endswith("/")


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order: path (tags, ``.class`` and ``#id`` names from the top), text, share of linked text."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    open_: Counter = Counter()
    text: list[str] = []
    linked = link = at = 0
    tags = Tags(page)
    ends: dict[int, int] | None = None  # made at the first SKIPPED element

    def flush() -> None:
        nonlocal linked, text
        if text:
            words = " ".join(entities.unescape("".join(text)).split())
            if words:
                path = (x for _, names in stack[:PATH_NAMES] for x in names)
                out.append((tuple(islice(path, PATH_NAMES)), words, min(1.0, linked / len(words))))
            text, linked = [], 0

    def close(k: int) -> None:
        open_.subtract(tag for tag, _ in stack[k:])
        del stack[k:]

    while at < len(page):
        found = tags.next(at)
        piece = page[at:found[0]] if found else page[at:]
        if piece:
            text.append(piece)
            linked += len(piece.strip()) if link else 0
        if not found:
            break
        _, at, slash, tag, attributes = found
        if not tag:
            continue
        block = tag in BLOCK or tag in SKIPPED
        if slash:
            if tag == "a":
                link = 0
            elif block:
                flush()
                link = 0
                if open_[tag]:
                    for k in range(len(stack) - 1, max(-1, len(stack) - 1 - DEPTH), -1):
                        if stack[k][0] == tag:
                            close(k)
                            break
            continue
        if tag == "br":
            text.append(" ")
        elif empty(tag, attributes):
            pass
        elif tag in SKIPPED and (ends := skipped_to(Tags(page)) if ends is None else ends).get(at):
            at = ends[at]
        elif tag in RAW:
            at = tags.after(tag, at)
        elif tag == "a":
            link = 1
        elif block:
            flush()
            link = 0
            closed = CLOSES.get(tag, {"p"})
            for k in range(len(stack) - 1, max(-1, len(stack) - 1 - DEPTH), -1):
                if stack[k][0] in closed or stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in SCOPES:
                    break
            if tag not in VOID:
                names = [tag]
                for a in ATTRIBUTE.finditer(attributes):
                    mark = "." if a[1].lower() == "class" else "#"
                    names += [mark + x for x in NAME.findall((a[2] or a[3] or a[4] or "").lower())]
                stack.append((tag, tuple(names)))
                open_[tag] += 1
    flush()
    return out


def taught(page: list[Block]) -> np.ndarray:
    """What the markup says of each block: 1 for main text."""
    def main(path):
        return any(x in MAIN_TAGS or x[0] in ".#" and x[1:] in MAIN_NAMES for x in path)

    def other(path):
        inner = next((i for i, x in enumerate(path) if x in MAIN_TAGS), len(path))
        return any(x in OTHER_TAGS and not (x == "header" and i > inner) or x[0] in ".#" and x[1:] in OTHER_NAMES
                   for i, x in enumerate(path))

    held = any(main(p) for p, _, _ in page)
    return np.array([(main(p) or not held) and not other(p) for p, _, _ in page], F32)


MAIN_PATHS = (("article",), ("main",), ("div", ".content"), ("div", "#content", ".post"), ("section", ".article", ".body"),
              ("div", "#main"), ("div", ".entry"), ("div",), ("div", ".story", ".text"), ("main", "article"))
NAV_PATHS = (("nav", "ul", "li"), ("div", ".menu", "ul", "li"), ("header", "nav", "ul", "li"), ("ul", ".nav", "li"),
             ("div", "#navigation", "ul", "li"), ("div", ".breadcrumb"), ("div", ".pagination", "ul", "li"))
AD_PATHS = (("div", ".ad"), ("div", ".advert"), ("div", ".advertisement"), ("div", ".banner"), ("aside", ".promo"),
            ("div", ".sponsored"), ("section", ".ads", "p"))
FOOT_PATHS = (("footer",), ("div", ".footer"), ("div", "#footer", ".legal", "p"), ("footer", "p"))
PUT_IN = (  # paths of foreign blocks, and how many at most
    (("section", "#comments", "div", ".comment", "p"), 5), (("div", ".comments", "ul", "li", ".comment"), 5), (("ol", ".comments", "li", "p"), 5),
    (("aside", ".sidebar", "p"), 3), (("aside", "ul", "li"), 5), (("div", ".sidebar", "p"), 3), (("aside", "p"), 3),
    (("div", ".cookie", ".notice", "p"), 1), (("div", ".notice"), 2), (("div", "#cookie", ".consent"), 1), (("div", ".popup", "p"), 1),
    (("form", "p"), 3), (("form", ".newsletter"), 2), (("div", ".subscribe", "form"), 2), (("header", "p"), 2), (("header", "h1"), 1),
    (("div", ".header"), 2), (("div", ".related", "ul", "li"), 4), (("div", ".share", "ul", "li"), 3), (("nav", "ul", "li"), 5))


def rewritten(page: list[Block], y: np.ndarray, foreign: list[str], rng: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """The page in another template, with foreign blocks put in."""
    pick = lambda paths: paths[rng.integers(len(paths))]
    over, nav, ad, foot = pick(MAIN_PATHS), pick(NAV_PATHS), pick(AD_PATHS), pick(FOOT_PATHS)
    top = ("html", "body", *(("div", ".wrap") if rng.random() < 0.3 else ()))
    new = []
    for (path, text, linked), label in zip(page, y):
        if label:
            leaf = path[-1] if path and path[-1][0] not in ".#" and path[-1] not in MAIN_TAGS else "p"
            path = (*top, *over, leaf)
        elif "nav" in path:
            path = (*top, *nav)
        elif "footer" in path:
            path = (*top, *foot)
        else:
            path = (*top, *ad)
        new.append(((path, text, linked), label))
    inside = [i for i, (_, label) in enumerate(new) if label]
    for _ in range(rng.integers(0, 4)):
        path, most = PUT_IN[rng.integers(len(PUT_IN))]
        within = inside and "comment" not in "".join(path) and rng.random() < 0.2
        into = (*top, *over) if within else top
        some = [(((*into, *path), foreign[rng.integers(len(foreign))], 1.0 if path[-1] == "li" and rng.random() < 0.5 else 0.0), 0.0)
                for _ in range(rng.integers(1, most + 1))] if foreign else []
        spot = rng.integers(0, len(new) + 1) if within else (0, len(new))[int(rng.random() < 0.6)]
        if inside and not within and spot == len(new) and rng.random() < 0.7:
            spot = inside[-1] + 1 if inside[-1] + 1 <= len(new) else spot
        new[spot:spot] = some
        inside = [i for i, (_, label) in enumerate(new) if label]
    return [b for b, _ in new], np.array([label for _, label in new], F32)


class Page:
    """Slots and measures of a page's blocks."""

    def __init__(self, page: list[Block]):
        n = len(page)
        self.path = [np.array([zlib.crc32(x.encode()) % PATH_SLOTS for x in (*p, "leaf:" + (p[-1] if p else ""))]) for p, _, _ in page]
        self.word = [np.array([zlib.crc32(w.encode()) % WORD_SLOTS for w in t.lower().split()]) for _, t, _ in page]
        self.measures = np.array([[np.log1p(len(t)) / 6, np.log1p(t.count(" ")) / 4, linked, (t[-1] in ".!?:;\"'") * 1.0,
                                   i / n, (n - 1 - i) / n, min(1.0, sum(map(t.count, "©|»")) / 2), 1.0]
                                  for i, (_, t, linked) in enumerate(page)], F32).reshape(n, MEASURES)


class Labeller:
    def __init__(self, params: dict[str, np.ndarray] | None = None):
        if params is None:
            r = np.random.default_rng(SEED)
            params = {"path": np.zeros((PATH_SLOTS, PATH_DIM)), "word": np.zeros((WORD_SLOTS, WORD_DIM)),
                      "out": r.normal(0, 0.2, 2 * HIDDEN), "skip": r.normal(0, 0.1, INPUTS), "bias": np.zeros(1)}
            for d in "fb":
                params |= {f"x{d}": r.normal(0, 0.2, (INPUTS, 4 * HIDDEN)), f"h{d}": r.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)),
                           f"b{d}": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)}
            params["path"] += r.normal(0, 0.05, params["path"].shape)
            params = {k: v.astype(F32) for k, v in params.items()}
        self.p = params

    def inputs(self, pages: list[Page], steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Inputs (steps x pages x INPUTS) and mask."""
        x, mask = np.zeros((steps, len(pages), INPUTS), F32), np.zeros((steps, len(pages)), F32)
        for k, page in enumerate(pages):
            n = len(page.path)
            if not n:
                continue
            mask[:n, k] = 1
            x[:n, k, PATH_DIM + WORD_DIM:] = page.measures
            for slots, table, a, mean in ((page.path, self.p["path"], 0, False), (page.word, self.p["word"], PATH_DIM, True)):
                size = np.array([len(s) for s in slots])
                rows = np.add.reduceat(table[np.concatenate(slots)], np.cumsum(size) - size)
                x[:n, k, a:a + rows.shape[1]] = rows / size[:, None] if mean else rows
        return x, mask

    def _direction(self, x, mask, d, keep):
        steps, many, _ = x.shape
        a = (x.reshape(-1, INPUTS) @ self.p["x" + d] + self.p["b" + d]).reshape(steps, many, 4 * HIDDEN)
        h = c = np.zeros((many, HIDDEN), F32)
        out, saved = np.zeros((steps, many, HIDDEN), F32), {}
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = a[t] + h @ self.p["h" + d]
            s = sigmoid(g[:, :3 * HIDDEN])
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN:2 * HIDDEN], s[:, 2 * HIDDEN:]
            u = np.tanh(g[:, 3 * HIDDEN:])
            new = f * c + i * u
            tc, m = np.tanh(new), mask[t][:, None]
            if keep:
                saved[t] = (h, c, i, f, o, u, tc)
            h, c = h + m * (o * tc - h), c + m * (new - c)
            out[t] = h
        return out, saved

    def forward(self, x, mask, keep=False):
        hf, kf = self._direction(x, mask, "f", keep)
        hb, kb = self._direction(x, mask, "b", keep)
        logits = np.concatenate((hf, hb), axis=2) @ self.p["out"] + x @ self.p["skip"] + self.p["bias"][0]
        return (logits, hf, hb, kf, kb) if keep else logits

    def gradients(self, pages: list[Page], labels: list[np.ndarray]) -> dict[str, np.ndarray]:
        steps = max(len(y) for y in labels)
        x, mask = self.inputs(pages, steps)
        logits, hf, hb, kf, kb = self.forward(x, mask, True)
        y = np.zeros_like(mask)
        for k, v in enumerate(labels):
            y[:len(v), k] = v
        d = (sigmoid(logits) - y) * mask / mask.sum()
        g = {"out": np.concatenate((hf, hb), axis=2).reshape(-1, 2 * HIDDEN).T @ d.ravel(), "skip": x.reshape(-1, INPUTS).T @ d.ravel(),
             "bias": np.array([d.sum()], F32)}
        dx = d[:, :, None] * self.p["skip"]
        for name, saved, part in (("f", kf, self.p["out"][:HIDDEN]), ("b", kb, self.p["out"][HIDDEN:])):
            w = self.p["h" + name]
            da = np.zeros((steps, len(pages), 4 * HIDDEN), F32)
            gh, dh, dc = np.zeros_like(w), np.zeros((len(pages), HIDDEN), F32), np.zeros((len(pages), HIDDEN), F32)
            for t in range(steps - 1, -1, -1) if name == "f" else range(steps):
                h, c, i, f, o, u, tc = saved[t]
                m = mask[t][:, None]
                dh = dh + d[t][:, None] * part
                dn = dh * m
                dnew = dc * m + dn * o * (1 - tc * tc)
                da[t] = np.concatenate((dnew * u * i * (1 - i), dnew * c * f * (1 - f), dn * tc * o * (1 - o), dnew * i * (1 - u * u)), axis=1)
                gh += h.T @ da[t]
                dh = dh * (1 - m) + da[t] @ w.T
                dc = dc * (1 - m) + dnew * f
            flat = da.reshape(-1, 4 * HIDDEN)
            g |= {"h" + name: gh, "x" + name: x.reshape(-1, INPUTS).T @ flat, "b" + name: flat.sum(0)}
            dx += (flat @ self.p["x" + name].T).reshape(dx.shape)
        g["path"], g["word"] = np.zeros_like(self.p["path"]), np.zeros_like(self.p["word"])
        for k, page in enumerate(pages):
            for t in range(len(page.path)):
                np.add.at(g["path"], page.path[t], dx[t, k, :PATH_DIM])
                np.add.at(g["word"], page.word[t], dx[t, k, PATH_DIM:PATH_DIM + WORD_DIM] / len(page.word[t]))
        return g

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Main text or not, for every block of every page."""
        made = [Page(p) for p in pages]
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted(range(len(pages)), key=lambda k: len(pages[k]))
        lo = 0
        while lo < len(order):  # pages of like length, at most 64 pages and about 64k blocks at a time
            hi = lo + 1
            while hi < len(order) and hi - lo < 64 and (hi - lo + 1) * len(pages[order[hi]]) <= 65_536:
                hi += 1
            steps = len(pages[order[hi - 1]])
            if steps:
                logits = self.forward(*self.inputs([made[k] for k in order[lo:hi]], steps))
                for j, k in enumerate(order[lo:hi]):
                    out[k] = logits[:len(pages[k]), j] > 0
            lo = hi
        return out


def fit(pages: list[str]) -> Labeller:
    rng, model = np.random.default_rng(SEED), Labeller()
    read = [b for b in map(blocks, pages) if b]
    known = [taught(b) for b in read]
    foreign = [t for b, y in zip(read, known) for (_, t, _), v in zip(b, y) if v]
    steps = Adam(model.p, RATE)
    for _ in range(EPOCHS if read else 0):
        drawn = [rewritten(b, y, foreign, rng) if rng.random() < 0.5 else (b, y) for b, y in zip(read, known)]
        made = [(Page(b), y) for b, y in drawn]
        for lo in range(0, len(made), 16):
            part = [made[i] for i in range(lo, min(lo + 16, len(made)))]
            g = model.gradients([p for p, _ in part], [y for _, y in part])
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            steps.step({k: v * min(1, 1 / max(norm, 1e-9)) for k, v in g.items()})
    return model


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            sample: int = SAMPLE) -> DataFrame:
    """One row per input row: ``page_id, url, text, n_chars``.

    A null html counts as empty; a page without text (or without main text) gives the empty string.
    White space of a block becomes one space, blocks are joined in page order by one space.  The network
    is trained on at most ``sample`` pages, least hash of the identifier first.  Rows are independent:
    repeated rows give repeated results, null ids and urls stay null; other columns are ignored.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        text_of(html_col).alias("_html"))
    ids = rows.select("page_id").where("page_id IS NOT NULL").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    chosen = rows.join(F.broadcast(ids), "page_id").groupBy("page_id").agg(F.min("_html").alias("_html")) \
        .orderBy("page_id").collect()  # at most `sample` pages
    sent = spark.sparkContext.broadcast(fit([r["_html"] for r in chosen]).p)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Labeller(sent.value)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                read = [blocks(h) for h in part.column("_html").to_pylist()]
                text = [" ".join(t for (_, t, _), v in zip(page, y) if v) for page, y in zip(read, model.label(read))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(text, pa.string()),
                     pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
