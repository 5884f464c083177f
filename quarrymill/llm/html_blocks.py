"""Operator 10: main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks, the runs of text between block-level tags. Each block becomes a vector: its tag path
and its words, both hashed with signs, and a few shares and sizes. A bidirectional LSTM (numpy alone) reads the page's
blocks in order, so that each is classified by what stands before and behind it; blocks of content make the text.

It is trained here on a bounded sample of the pages that name their parts: what is inside <article> or <main> is content,
what is inside <nav>, <aside>, <footer>, <header>, <form> or an element whose class or id says so is not, other blocks have
no label. Pages are trained on whole, those of more than WINDOW blocks in windows. In training, path elements that say so are hidden at random, so that the
labeller has to learn from words, sizes and neighbours as well. Pages run in lockstep: a lane is a page, a step a block.
"""

from __future__ import annotations

import html
import re
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Pages in the sample that trains, at most about; turns over them; blocks of a window; windows of the sample, at most,
#: drawn from all over its pages where there are more.
SAMPLE, TURNS, WINDOW, WINDOWS = 240, 24, 512, 960
HIDDEN, RATE, HIDE = 16, 0.02, 0.6
PATH, WORDS, SHAPE = 24, 24, 6
WIDTH = PATH + WORDS + SHAPE

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|svg|noscript)(?=[\s/>])[^>]*+(?:>.*?(?:</\1\s*+>|\Z)|\Z)"
    r"|<(/?)([a-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)|([^<]++)|<",
    re.S | re.I,
)
ROLE = re.compile(r"""\b(?:class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT = frozenset("article main".split())
CHROME = frozenset("nav aside footer header form menu dialog ad ads advert banner sidebar menu navbar breadcrumb cookie share related promo comments".split())
HEADLESS = frozenset(("title",))
#: Tags that a new one of the same kind closes.
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}


def blocks(page: str | None) -> list[tuple[str, tuple[str, ...], int]]:
    """(text, path, characters within links) of each leaf block; white space is collapsed, blank blocks are left out.

    Path elements are tag names, with the words of class, id and role behind dots. Broken markup is read as far
    as it goes: an end tag without a start is ignored, what is left open ends with the page.
    """
    out: list[tuple[str, tuple[str, ...], int]] = []
    path: list[str] = []
    text: list[str] = []
    inside = linked = 0

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                out.append((whole, tuple(path), min(linked, len(whole))))
            text.clear()
        linked = 0

    for m in TOKEN.finditer(page or ""):
        run = m[5]
        if run is not None:
            run = html.unescape(run) if "&" in run else run
            text.append(run)
            if inside:
                linked += len(run)
            continue
        tag = m[3]
        if tag is None:
            if m[0] == "<":
                text.append("<")
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                inside = 0 if m[2] else 1
            continue
        flush()
        if tag in VOID:
            continue
        inside = 0
        if m[2]:
            for i in range(len(path) - 1, -1, -1):
                if path[i] == tag or path[i].startswith(tag + "."):
                    del path[i:]
                    break
            continue
        if path and tag in CLOSES and path[-1].partition(".")[0] in CLOSES[tag]:
            path.pop()
        if "=" in m[4]:
            path.append(".".join([tag, *(w for r in ROLE.finditer(m[4]) for w in (r[1] or r[2] or r[3] or "").lower().replace(".", "-").split())]))
        else:
            path.append(tag)
    flush()
    return out


def hints(path: tuple[str, ...]) -> list[int]:
    """Of each path element 1 if it tells content, 0 if it tells the opposite, else -1."""
    out = []
    for x in path:
        tag, *words = x.split(".")
        out.append(0 if tag in CHROME or tag in HEADLESS or not CHROME.isdisjoint(words) else 1 if tag in CONTENT or not CONTENT.isdisjoint(words) else -1)
    return out


def label(path: tuple[str, ...]) -> int:
    """The innermost hint: 1 content, 0 not, -1 unknown."""
    return next((h for h in reversed(hints(path)) if h >= 0), -1)


_elements: dict[str, np.ndarray] = {}


def element_vector(x: str) -> np.ndarray:
    """Signs by the hash of the tag with each of its words, of the tag alone if it has none."""
    if x not in _elements:
        if len(_elements) > 50_000:
            _elements.clear()
        tag, *words = x.split(".")
        total = np.zeros(PATH, np.float32)
        for name in [f"{tag}.{w}" for w in words] or [tag]:
            h = xxhash.xxh64_intdigest(name.encode("utf-8", "replace"))
            total += np.array([1.0 if h >> i & 1 else -1.0 for i in range(PATH)], np.float32)
        _elements[x] = total / max(1.0, float(np.sqrt(len(words))))
    return _elements[x]


def path_vector(path: tuple[str, ...]) -> np.ndarray:
    total = np.zeros(PATH, np.float32)
    for depth, x in enumerate(reversed(path)):
        total += element_vector(x) / (1 + 0.5 * depth)
    return total / max(1.0, float(np.sqrt(len(path))))


def features(pages: list[list[tuple[str, tuple[str, ...], int]]]) -> np.ndarray:
    """(blocks, WIDTH), of all pages' blocks in a row."""
    flat = [b for p in pages for b in p]
    n = len(flat)
    out = np.zeros((n, WIDTH), np.float32)
    if not n:
        return out
    known: dict[tuple[str, ...], np.ndarray] = {}
    for i, (_, path, _) in enumerate(flat):
        if path not in known:
            known[path] = path_vector(path)
        out[i, :PATH] = known[path]
    lower = [t.lower() for t, _, _ in flat]
    begin = 0
    for a, b in common.chunks(lower):
        buf, offsets = common.pack(lower[a:b])
        start, end = common.words(buf)
        h = common.word_hashes(buf, start, end)
        of = np.searchsorted(offsets, start, "right") - 1
        count = np.maximum(np.bincount(of, minlength=b - a), 1)
        place = (h >> np.uint64(40)) % np.uint64(WORDS)
        sign = np.where(h & np.uint64(1), 1.0, -1.0)
        sums = np.bincount(of * WORDS + place.astype(np.int64), sign, (b - a) * WORDS).reshape(b - a, WORDS)
        out[begin : begin + b - a, PATH : PATH + WORDS] = sums / np.sqrt(count)[:, None]
        out[begin : begin + b - a, PATH + WORDS] = np.log1p(count) / 3
        begin += b - a
    size = np.array([len(t) for t in lower])
    out[:, -5] = np.log1p(size) / 5
    out[:, -4] = [k / max(1, len(t)) for t, _, k in flat]
    out[:, -3] = [t[-1] in ".!?…:;\"')" for t in lower]
    out[:, -2] = [len(p) / 8 for _, p, _ in flat]
    out[:, -1] = 1
    return out


def initial(seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {}
    for way in "fb":
        p[f"w{way}"] = (rng.normal(size=(WIDTH + HIDDEN, 4 * HIDDEN)) / np.sqrt(WIDTH + HIDDEN)).astype(np.float32)
        p[f"c{way}"] = np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)  # gates: in, forget, new, out
    p["out"] = (rng.normal(size=2 * HIDDEN + WIDTH) * 0.1).astype(np.float32)
    p["bias"] = np.zeros(1, np.float32)
    return p


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def run_lstm(x: np.ndarray, live: np.ndarray, w: np.ndarray, c0: np.ndarray, keep: list | None = None) -> np.ndarray:
    """x (steps, lanes, WIDTH), live (steps, lanes): states (steps, lanes, HIDDEN); a lane's state stays 0 until it lives."""
    steps, lanes, _ = x.shape
    pre = x @ w[:WIDTH] + c0
    h = np.zeros((lanes, HIDDEN), np.float32)
    c = np.zeros((lanes, HIDDEN), np.float32)
    out = np.zeros((steps, lanes, HIDDEN), np.float32)
    for t in range(steps):
        z = pre[t] + h @ w[WIDTH:]
        gate = _sigmoid(z)
        i, f, o = gate[:, :HIDDEN], gate[:, HIDDEN : 2 * HIDDEN], gate[:, 3 * HIDDEN :]
        g = np.tanh(z[:, 2 * HIDDEN : 3 * HIDDEN])
        m = live[t][:, None]
        before_h, before_c = h, c
        c = np.where(m, f * c + i * g, c)
        th = np.tanh(c)
        h = np.where(m, o * th, h)
        out[t] = h
        if keep is not None:
            keep.append((before_h, before_c, i, f, g, o, th))
    return out


def lstm_gradient(x, live, w, saved, d_out) -> tuple[np.ndarray, np.ndarray]:
    steps, lanes, _ = x.shape
    dz_all = np.zeros((steps, lanes, 4 * HIDDEN), np.float32)
    dh = np.zeros((lanes, HIDDEN), np.float32)
    dc = np.zeros((lanes, HIDDEN), np.float32)
    dw = np.zeros_like(w)
    for t in range(steps - 1, -1, -1):
        before_h, before_c, i, f, g, o, th = saved[t]
        m = live[t][:, None]
        dh_t = (dh + d_out[t]) * m
        dc_t = dh_t * o * (1 - th * th) + dc * m
        dz = np.concatenate([dc_t * g * i * (1 - i), dc_t * before_c * f * (1 - f), dc_t * i * (1 - g * g), dh_t * th * o * (1 - o)], 1)
        dz_all[t] = dz
        dw[WIDTH:] += before_h.T @ dz
        dh = dz @ w[WIDTH:].T + (dh + d_out[t]) * ~m
        dc = dc_t * f + dc * ~m
    dw[:WIDTH] = np.tensordot(x, dz_all, ((0, 1), (0, 1)))
    return dw, dz_all.sum((0, 1))


def padded(x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks in a row to (steps, lanes, WIDTH) and who lives at each step."""
    steps, lanes = int(sizes.max(initial=0)), len(sizes)
    live = np.arange(steps)[:, None] < sizes
    out = np.zeros((lanes, steps, WIDTH), np.float32)
    out[live.T] = x
    return out.transpose(1, 0, 2), live


def forward(x: np.ndarray, live: np.ndarray, p, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of content (steps, lanes), and what the last layer saw."""
    hf = run_lstm(x, live, np.asarray(p["wf"]), np.asarray(p["cf"]), keep and keep[0])
    hb = run_lstm(x[::-1], live[::-1], np.asarray(p["wb"]), np.asarray(p["cb"]), keep and keep[1])[::-1]
    seen = np.concatenate([hf, hb, x], 2)
    return seen @ np.asarray(p["out"]) + np.asarray(p["bias"])[0], seen


def train(pages: list[list[tuple[str, tuple[str, ...], int]]], turns: int = TURNS, seed: int = 5) -> dict[str, np.ndarray]:
    """Weights fitted to the labels that the pages' paths tell; {} if none tells both kinds."""
    pages = [p[i : i + WINDOW] for p in pages for i in range(0, len(p), WINDOW)]
    pages = [p for p in pages if any(label(b[1]) >= 0 for b in p)]
    if len(pages) > WINDOWS:
        pages = [pages[i] for i in sorted(np.random.default_rng(seed).permutation(len(pages))[:WINDOWS].tolist())]
    told = {label(b[1]) for p in pages for b in p}
    if not {0, 1} <= told:
        return {}
    rng = np.random.default_rng(seed)
    p = initial()
    m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
    groups = [order[i : i + 24] for i in range(0, len(order), 24)]
    step = 0
    for turn in range(turns):
        for k in rng.permutation(len(groups)):
            some = [pages[i] for i in groups[k]]
            shown = []
            for page in some:
                hide = rng.random() < HIDE  # a page names its parts or doesn't
                shown.append([(t, tuple(x for x, h in zip(path, hints(path)) if h < 0 or not hide), a) for t, path, a in page])
            sizes = np.array([len(x) for x in some])
            x, live = padded(features(shown), sizes)
            y = np.zeros(live.T.shape, np.float32)
            y[live.T] = [label(b[1]) for page in some for b in page]
            y = y.T
            use = live & (y >= 0)
            keep: tuple[list, list] = ([], [])
            z, seen = forward(x, live, p, keep)
            # Both kinds weigh the same, whatever their share.
            good, bad = max(1, int((use & (y > 0)).sum())), max(1, int((use & (y == 0)).sum()))
            d = np.where(use, (_sigmoid(z) - y) * np.where(y > 0, 0.5 / good, 0.5 / bad), 0).astype(np.float32)
            grad = {"out": np.tensordot(d, seen, ((0, 1), (0, 1))), "bias": np.array([d.sum()], np.float32)}
            back = d[:, :, None] * p["out"]
            grad["wf"], grad["cf"] = lstm_gradient(x, live, p["wf"], keep[0], back[:, :, :HIDDEN])
            grad["wb"], grad["cb"] = lstm_gradient(x[::-1], live[::-1], p["wb"], keep[1], back[::-1, :, HIDDEN : 2 * HIDDEN])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            step += 1
            rate = RATE * 0.5 * (1 + np.cos(np.pi * (turn / turns)))
            for name, g in grad.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.99 * v[name] + 0.01 * g * g
                p[name] = (p[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return p


def classify(pages: list[list[tuple[str, tuple[str, ...], int]]], p) -> list[np.ndarray]:
    """Log-odds of content of each page's blocks. Lanes of about the same length run together."""
    sizes = np.array([len(x) for x in pages], np.int64)
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
    order = np.argsort(sizes, kind="stable")
    at = int(np.searchsorted(sizes[order], 1))
    while at < len(order):
        longest = max(8, int(sizes[order[at]]) * 5 // 4)
        end = min(int(np.searchsorted(sizes[order], longest, "right")), at + max(1, (1 << 15) // longest))
        lanes = order[at:end]
        at = end
        x, live = padded(features([pages[i] for i in lanes]), sizes[lanes])
        z, _ = forward(x, live, p)
        for j, i in enumerate(lanes.tolist()):
            out[i] = z[: sizes[i], j]
    return out


def _marks(html_col: str, names: frozenset[str]) -> Column:
    """Whether the markup seems to have an element or a class, id or role of one of these names."""
    either = "|".join(sorted(names))
    return F.rlike(html_col, F.lit(rf"(?i)<(?:{either})[\s/>]|\b(?:class|id|role)\s*=\s*[\"']?(?:[^\"'>]*\s)?(?:{either})[\s\"'>]"))


def fit(pages: DataFrame, html_col: str, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """From about `sample` different pages among those that have marks of both kinds, or of any kind if none has both,
    chosen by the hash of their HTML."""
    full = common.pick(pages, html=html_col).filter(F.length("html") > 0)
    both, any_ = _marks("html", CONTENT) & _marks("html", CHROME), _marks("html", CONTENT | CHROME)
    for marked in (both, any_):
        total = full.filter(marked).select(F.xxhash64("html").alias("h")).distinct().count()
        if total:
            some = full.filter(marked & common.share(F.col("html"), sample, total)).distinct()
            return train([blocks(t) for t in sorted(r[0] for r in some.collect())])
    return {}


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id_col, text STRING, blocks, kept BIGINT): one row for each row of pages; text is the kept blocks, a line each.

    Null HTML has null text and 0 blocks; empty HTML and such without text have an empty text. Whole pages are read,
    whatever their length. If no page names content, or none anything but content, all blocks are kept. A block whose
    log-odds are 0 goes. Null and repeated ids are passed on with their own rows. Other columns are not read, whatever
    their names; where id_col is called as one of the results is, that one gets an underscore. An empty table gives none.
    """
    p = fit(pages, html_col)
    model = common.Model(pages.sparkSession, "blocks", p)

    @common.tidied
    def run(batches, model):
        for batch in batches:
            sources = batch.column(1).to_pylist()
            for a, b in common.chunks(sources, 2 * common.CHUNK):
                found = [blocks(t) for t in sources[a:b]]
                odds = classify(found, model) if p else [np.ones(len(x)) for x in found]
                texts = ["\n".join(t for (t, _, _), z in zip(x, o.tolist()) if z > 0) for x, o in zip(found, odds)]
                null = np.array([t is None for t in sources[a:b]], bool)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([None if n else t for n, t in zip(null, texts)], pa.string()), pa.array([len(x) for x in found], pa.int64()), pa.array([int((o > 0).sum()) for o in odds], pa.int64())],
                    names=["id", "text", "blocks", "kept"],
                )

    done = common.pick(pages, id=id_col, html=html_col).mapInArrow(partial(run, model=model), f"id {common.kind(pages, id_col)}, text string, blocks bigint, kept bigint")
    return common.named(done, id_col, "text", "blocks", "kept")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(common.table(spark, sf_dir, "pages"))
