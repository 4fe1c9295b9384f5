"""PII: a character-level bidirectional LSTM with CRF transitions, trained in numpy from labelled spans.

Base spans (email, ip, card, phone) come from fixed patterns. The network adds spans of the same kinds in forms that the
patterns do not cover: addresses written with (at) or spaced out, telephone numbers without a plus, cards and IP addresses
with other separators. Each character has a tag (outside, or first / further character of a kind). Two LSTMs read a window
from either end, a linear layer scores the tags, and a CRF adds transition scores, under which a kind can only go on after
it began.

Training: on the driver, on at most ``SAMPLE`` snippets of the corpus, labelled by the base patterns, and ``MADE`` windows
made from them: values of each kind in many forms, and numbers that are no personal data (versions, dates, prices, digests,
keys), are set between words of the corpus. Both bounds are parameters. The gradients of LSTM and CRF are written out below.

Prediction: a text is covered by windows of ``WINDOW`` characters, each beginning ``STRIDE`` after the one before. A span must
hold a digit, an @ or a bracketed "at" (``TRIGGER``), so a window without any decodes to nothing and is not run; all others
are. Windows are decoded one by one (Viterbi), their spans weighted by the posterior of their tags, and then reconciled over
the whole text: parts of a span that a window's edge has cut are put together, spans that fail the exact check of their kind
(digits, Luhn, parts up to 255) or touch a base span are dropped, and of the others the set without overlaps that has the
greatest weight is kept.

Scale: texts are read twice, once for the sample (snippets of ``SNIPPET`` characters leave the tasks) and once for the spans;
nothing but snippets is shuffled. The model is some 80 KB, whatever the corpus. Work is linear in the characters; windows of a
text are run ``BATCH`` at a time, so memory beyond the text itself is bounded.

Defined cases: a null text is empty and has no spans; spans are code points, end exclusive; repeated rows have one answer
each; an empty table gives an empty result (and the network is trained on made windows alone); other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

SAMPLE, MADE = 300, 2600        # snippets of the corpus and made windows that the network is trained on
SNIPPET = 96
WINDOW, STRIDE = 64, 32
BATCH = 128
HIDDEN = 16
EPOCHS, MINIBATCH, RATE = 8, 32, 0.02
SEED = 4211
LEAST = 0.8                     # mean posterior of the tags of a span

# Fixed values of the contract: the characters and patterns of the base spans.
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

TRIGGER = re.compile(r"[0-9@]|[(\[{] ?[aA][tT] ?[)\]}]")

Span = tuple[int, int]


# --- base spans -------------------------------------------------------------------------------------------------------

def luhn(digits: str) -> bool:
    """Whether a string of digits passes the Luhn check."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping addresses, in time linear in the text: each @ is met once, and its local part goes back no
    further than the match or @ before it."""
    out: list[Span] = []
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


def ips(text: str) -> list[Span]:
    """Four numbers joined by dots; in a longer chain every four from the left are one match."""
    out = []
    for m in CHAIN.finditer(text):
        if m.group().count(".") < 3:
            continue
        parts, at = m.group().split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def _digits(text: str) -> str:
    return "".join(DIGIT.findall(text))


def cards(text: str) -> list[Span]:
    found = ((m.span(), _digits(m.group())) for m in CARD.finditer(text) if m.end() - m.start() >= 13)
    return [s for s, d in found if 13 <= len(d) <= 19 and luhn(d)]


def phones(text: str) -> list[Span]:
    return [m.span() for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]


def base_spans(text: str) -> dict[str, list[Span]]:
    """Spans of each kind by the fixed patterns, kinds apart from each other."""
    if not TRIGGER.search(text):
        return {k: [] for k in KINDS}
    return {"email": emails(text), "ip": ips(text), "card": cards(text), "phone": phones(text)}


# --- the network ------------------------------------------------------------------------------------------------------

PAD = 131
TAGS = 1 + 2 * len(KINDS)       # outside; first and further character of each kind
FORBIDDEN = np.float32(-1e4)


def codes(text: str) -> np.ndarray:
    """A small code for each character: ASCII as it is, then other letters, other digits and the rest."""
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    for c in np.unique(cps[cps >= 128]):
        cps[cps == c] = 0x110000 + (128 if chr(c).isalpha() else 129 if chr(c).isdigit() else 130)
    return np.where(cps >= 0x110000, cps - 0x110000, cps).astype(np.int16)


def tag_row(length: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    tags = np.zeros(length, dtype=np.int64)
    for kind, start, end in spans:
        k = 1 + 2 * KINDS.index(kind)
        tags[start:end] = k + 1
        tags[start] = k
    return tags


def _mask() -> np.ndarray:
    """Transitions into a further character are only allowed from characters of its kind."""
    m = np.zeros((TAGS, TAGS), dtype=np.float32)
    for k in range(2, TAGS, 2):
        m[:, k] = FORBIDDEN
        m[k - 1, k] = m[k, k] = 0
    return m


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


class Tagger:
    """Weights: ``x`` (direction, character, gates), ``h`` (direction, hidden, gates), ``b`` (direction, gates), ``o`` and ``ob``
    (both hidden states to tags), ``a`` (transitions). Gates are in the order input, forget, output, candidate."""

    def __init__(self, rng: np.random.Generator, hidden: int = HIDDEN):
        n = hidden
        draw = lambda *shape: (rng.standard_normal(shape) * 0.2).astype(np.float32)
        self.n = n
        self.w = {"x": draw(2, PAD + 1, 4 * n), "h": draw(2, n, 4 * n), "b": np.zeros((2, 4 * n), np.float32), "o": draw(2 * n, TAGS),
                  "ob": np.zeros(TAGS, np.float32), "a": np.zeros((TAGS, TAGS), np.float32)}
        self.w["b"][:, n:2 * n] = 1

    def _run(self, ids: np.ndarray, keep: bool) -> tuple[np.ndarray, dict]:
        """Tag scores (time, row, tag) of windows ``ids`` (row, time), and what the gradient needs."""
        w, n, t = self.w, self.n, ids.T
        x = np.stack([w["x"][0][t], w["x"][1][t[::-1]]]) + w["b"][:, None, None]
        steps, rows = t.shape
        hs, cs = np.zeros((2, steps + 1, rows, n), np.float32), np.zeros((2, steps + 1, rows, n), np.float32)
        gates, squashed = (np.empty((2, steps, rows, 4 * n), np.float32), np.empty((2, steps, rows, n), np.float32)) if keep else (None, None)
        h, c = hs[:, 0], cs[:, 0]
        for k in range(steps):
            z = x[:, k] + h @ w["h"]
            z[..., :3 * n] *= 0.5
            np.tanh(z, out=z)
            z[..., :3 * n] = 0.5 * z[..., :3 * n] + 0.5  # the logistic function
            c = z[..., n:2 * n] * c + z[..., :n] * z[..., 3 * n:]
            tc = np.tanh(c)
            h = z[..., 2 * n:3 * n] * tc
            hs[:, k + 1], cs[:, k + 1] = h, c
            if keep:
                gates[:, k], squashed[:, k] = z, tc
        both = np.concatenate([hs[0, 1:], hs[1, 1:][::-1]], axis=2)
        return both @ w["o"] + w["ob"], {"t": t, "hs": hs, "cs": cs, "gates": gates, "squashed": squashed, "both": both}

    def scores(self, ids: np.ndarray) -> np.ndarray:
        return self._run(ids, False)[0]

    def transitions(self) -> np.ndarray:
        return self.w["a"] + _mask()

    def _lattice(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward log sums (time, row, tag), and the log sum over all paths (row). A window begins as if after
        an outside character."""
        a = self.transitions()
        fore, back = np.empty_like(e), np.zeros_like(e)
        fore[0] = e[0] + a[0]
        for k in range(1, len(e)):
            fore[k] = e[k] + _logsum(fore[k - 1][:, :, None] + a, 1)
        for k in range(len(e) - 2, -1, -1):
            back[k] = _logsum(a + (e[k + 1] + back[k + 1])[:, None, :], 2)
        return fore, back, _logsum(fore[-1], 1)

    def posterior(self, e: np.ndarray) -> np.ndarray:
        fore, back, total = self._lattice(e)
        return np.exp(fore + back - total[None, :, None])

    def decode(self, e: np.ndarray) -> np.ndarray:
        """The best path (row, time)."""
        a = self.transitions()
        best, came = e[0] + a[0], np.empty(e.shape, np.int8)
        for k in range(1, len(e)):
            s = best[:, :, None] + a
            came[k] = s.argmax(axis=1)
            best = e[k] + s.max(axis=1)
        path = np.empty((e.shape[1], len(e)), np.int8)
        path[:, -1] = best.argmax(axis=1)
        rows = np.arange(e.shape[1])
        for k in range(len(e) - 1, 0, -1):
            path[:, k - 1] = came[k][rows, path[:, k]]
        return path

    def gradient(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tags (row, time) and its gradient."""
        w, n = self.w, self.n
        e, s = self._run(ids, True)
        steps, rows, _ = e.shape
        a, (fore, back, total) = self.transitions(), self._lattice(e)
        y = tags.T
        gold = np.take_along_axis(e, y[:, :, None], 2).sum() + a[0][y[0]].sum() + a[y[:-1], y[1:]].sum()
        de = np.exp(fore + back - total[None, :, None])
        pair = np.exp(fore[:-1, :, :, None] + a + (e[1:] + back[1:])[:, :, None, :] - total[None, :, None, None])
        da = pair.sum(axis=(0, 1))
        da[0] += de[0].sum(axis=0)
        np.subtract.at(da, (y[:-1].ravel(), y[1:].ravel()), 1)
        np.subtract.at(da[0], y[0], 1)
        np.put_along_axis(de, y[:, :, None], np.take_along_axis(de, y[:, :, None], 2) - 1, 2)
        # products are taken step by step: small ones stay in one thread
        g = {"a": np.where(_mask() < 0, 0, da), "o": (s["both"].transpose(0, 2, 1) @ de).sum(axis=0), "ob": de.sum(axis=(0, 1))}
        dboth = de @ w["o"].T
        dh_all = np.stack([dboth[..., :n], dboth[::-1, :, n:]])
        dz = np.empty_like(s["gates"])
        dh, dc = np.zeros((2, rows, n), np.float32), np.zeros((2, rows, n), np.float32)
        back_h = w["h"].transpose(0, 2, 1)
        for k in range(steps - 1, -1, -1):
            z, tc = s["gates"][:, k], s["squashed"][:, k]
            i, f, o, c = z[..., :n], z[..., n:2 * n], z[..., 2 * n:3 * n], z[..., 3 * n:]
            dh = dh + dh_all[:, k]
            dc = dc + dh * o * (1 - tc * tc)
            d = dz[:, k]
            d[..., :n] = dc * c * i * (1 - i)
            d[..., n:2 * n] = dc * s["cs"][:, k] * f * (1 - f)
            d[..., 2 * n:3 * n] = dh * tc * o * (1 - o)
            d[..., 3 * n:] = dc * i * (1 - c * c)
            dc = dc * f
            dh = d @ back_h
        g["h"] = (s["hs"][:, :-1].transpose(0, 1, 3, 2) @ dz).sum(axis=1)
        g["b"] = dz.sum(axis=(1, 2))
        g["x"] = np.zeros_like(w["x"])
        for d, seen in enumerate((s["t"].ravel(), s["t"][::-1].ravel())):
            order = np.argsort(seen, kind="stable")
            once, first = np.unique(seen[order], return_index=True)
            g["x"][d][once] = np.add.reduceat(dz[d].reshape(-1, 4 * n)[order], first, axis=0)
        return float(total.sum() - gold) / rows, {k: (v / rows).astype(np.float32) for k, v in g.items()}


def train(ids: np.ndarray, tags: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Tagger:
    """Fits a tagger by Adam with a falling rate and clipped gradients."""
    rng = np.random.default_rng(seed)
    net = Tagger(rng)
    m, v = ({k: np.zeros_like(x) for k, x in net.w.items()} for _ in range(2))
    step, steps = 0, epochs * (-(-len(ids) // MINIBATCH))
    for _ in range(epochs):
        order = rng.permutation(len(ids))
        for at in range(0, len(ids), MINIBATCH):
            part = order[at:at + MINIBATCH]
            _, g = net.gradient(ids[part], tags[part])
            scale = min(1.0, 5.0 / (sum(float((x * x).sum()) for x in g.values()) ** 0.5 + 1e-6))
            step += 1
            rate = RATE * (1 - (step - 1) / steps)
            for k, x in g.items():
                x = x * scale
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                net.w[k] -= (rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return net


# --- labelled spans ---------------------------------------------------------------------------------------------------

PROSE = "The letter came on a cold morning and nobody in the house knew who had sent it, so it lay on the table until the evening. "
LOWER, NUMBERS = "abcdefghijklmnopqrstuvwxyz", "0123456789"


def _of(rng: np.random.Generator, letters: str, n: int) -> str:
    return "".join(letters[k] for k in rng.integers(0, len(letters), n))


def _pick(rng: np.random.Generator, *options: str) -> str:
    return options[int(rng.integers(0, len(options)))]


def made_value(rng: np.random.Generator, kind: str) -> str:
    """A value of a kind, in a form of the base patterns or another one."""
    num = lambda n: _of(rng, NUMBERS, n)
    if kind == "email":
        user = _of(rng, LOWER, int(rng.integers(2, 9))) + _pick(rng, "", "." + num(2), num(2), "_" + _of(rng, LOWER, 4), "." + _of(rng, LOWER, 5))
        host = _of(rng, LOWER, int(rng.integers(3, 8))) + _pick(rng, "", num(1), "-" + _of(rng, LOWER, 3))
        top = _pick(rng, "com", "org", "net", "de", "fr", "co", "example.com")
        at = _pick(rng, "@", "@", "(at)", "[at]", " [at] ", " (at) ", " @ ", "{at}")
        return user + at + host + _pick(rng, ".", ".", ".", "(dot)", " [dot] ", "[.]") + top
    if kind == "ip":
        dot = _pick(rng, ".", ".", "[.]", " . ", "(.)")
        return dot.join(str(int(x)) for x in rng.integers(1, 256, 4))
    if kind == "card":
        d = _pick(rng, "4", "5", "37", "6") + num(14)
        d = next(d[:15] + x for x in NUMBERS if luhn(d[:15] + x))
        return _pick(rng, "", " ", "-", ".", "/", "  ", "_").join(d[k:k + 4] for k in range(0, 16, 4))
    a, b, c = num(3), num(3), num(4)
    return _pick(rng, f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"0{a} {b}{c}", f"00{a[:2]} {b} {c} {num(2)}",
                 f"({a}){b}-{c}", f"{a} {b} {c}", f"0{a}/{b}{c}", f"+{a[:2]} {b} {c}{num(2)}")


def made_other(rng: np.random.Generator) -> str:
    """Something with digits or an @ that is no personal data."""
    num = lambda n: _of(rng, NUMBERS, n)
    year = str(int(rng.integers(1800, 2030)))
    month, day = f"{int(rng.integers(1, 13)):02d}", f"{int(rng.integers(1, 29)):02d}"
    hexes = _of(rng, "0123456789abcdef", int(rng.integers(16, 41)))
    return _pick(rng, f"version {num(1)}.", f"{num(1)}.{num(1)}", f"{num(1)}.{num(1)}.{num(2)}", year, f"{year}-{month}-{day}", f"{day}.{month}.{year}",
                 f"{day}/{month}/{year}", f"{day}:{month}", f"{year}-{month}-{day} {day}:{month}:{num(2)}", f"${num(1)},{num(3)}.{num(2)}", f"{num(2)}.{num(1)} %", f"page {num(3)}", f"No. {num(4)}",
                 f"{num(3)},{num(3)},{num(3)}", f"#{num(8)}", hexes, f'"{hexes}"', f"password={hexes}", f'token = "{hexes}"', f"AKIA{_of(rng, LOWER.upper() + NUMBERS, 16)}",
                 f"ISBN 978-{num(1)}-{num(2)}-{num(6)}-{num(1)}", f"@{_of(rng, LOWER, 7)}", f"{num(3)}-{num(3)}", f"({num(1)})", f"{num(1)}) {num(2)}", f"§ {num(3)}", f"{num(7)}", f"{_of(rng, LOWER, 5)}{num(2)}")


def made_windows(contexts: list[str], n: int, seed: int = SEED) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Texts of about a window with labelled spans: words of the contexts around values of a kind and other numbers."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(int(rng.integers(1, 4))):
            prose = contexts[int(rng.integers(0, len(contexts)))]
            start = int(rng.integers(0, max(len(prose) - 8, 1)))
            text += prose[start:start + int(rng.integers(0, 40))]
            text += _pick(rng, " ", " ", " ", "\n", ": ", " (") if text else ""
            if rng.random() < 0.55:
                kind = KINDS[int(rng.integers(0, len(KINDS)))]
                value = made_value(rng, kind)
                spans.append((kind, len(text), len(text) + len(value)))
            else:
                value = made_other(rng)
            text += value + _pick(rng, " ", " ", " ", ". ", ", ", "\n", ") ")
        out.append((text, spans))
    return out


def labelled_rows(examples: list[tuple[str, list[tuple[str, int, int]]]], seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Windows (row, time) and their tags; a longer text gives a window at a random place, whose edges may cut spans."""
    rng = np.random.default_rng(seed)
    ids, tags = np.full((len(examples), WINDOW), PAD, dtype=np.int64), np.zeros((len(examples), WINDOW), dtype=np.int64)
    for k, (text, spans) in enumerate(examples):
        at = int(rng.integers(0, max(len(text) - WINDOW, 0) + 1))
        cut = [(kind, max(s - at, 0), min(e - at, WINDOW)) for kind, s, e in spans if e > at and s < at + WINDOW]
        part = codes(text[at:at + WINDOW])
        ids[k, :len(part)] = part
        tags[k] = tag_row(WINDOW, cut)
    return ids, tags


def snippets(docs: DataFrame, limit: int = SAMPLE) -> list[str]:
    """At most ``limit`` different snippets around the first digit or @ of texts, chosen by hash."""
    at = F.regexp_instr("text", F.lit("[0-9@]"))
    s = docs.select("text", at.alias("at")).where(F.col("at") > 0)
    s = s.select(F.col("text").substr(F.greatest(F.col("at") - SNIPPET // 2, F.lit(1)), F.lit(SNIPPET)).alias("s"))
    s = s.groupBy(F.xxhash64("s").alias("h")).agg(F.min("s").alias("s"))
    return [r.s for r in s.orderBy("h").limit(limit).collect()]


def fit(sample: list[str], made: int = MADE) -> Tagger:
    """A tagger trained on snippets, labelled by the base patterns, and on windows made from them."""
    real = [(t, [(k, s, e) for k, found in base_spans(t).items() for s, e in found]) for t in sample]
    words = [" ".join(w for w in t.split(" ") if not TRIGGER.search(w)) for t in sample]
    contexts = [w for w in words if len(w) >= 24] or [PROSE]
    return train(*labelled_rows(real + made_windows([*contexts, PROSE], made)))


# --- prediction -------------------------------------------------------------------------------------------------------

def window_starts(text: str) -> list[int]:
    """Starts of the windows that hold a trigger or part of one."""
    out: list[int] = []
    for m in TRIGGER.finditer(text):
        for k in range(max(m.start() // STRIDE - 1, 0), (m.end() - 1) // STRIDE + 1):
            if not out or k * STRIDE > out[-1]:
                out.append(k * STRIDE)
    return out


def passes(kind: str, value: str) -> bool:
    """The exact check of a kind."""
    if not TRIGGER.search(value):
        return False
    d = _digits(value)
    if kind == "email":
        return bool(re.search(r"[A-Za-z0-9][^@]*(?:@|[(\[{] ?at ?[)\]}]).*[A-Za-z0-9].*(?:\.|dot).*[A-Za-z]", value, re.IGNORECASE | re.DOTALL))
    if kind == "ip":
        parts = re.findall(r"[0-9]+", value)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    return 9 <= len(d) <= 15 and not re.search(r"[A-Za-z]", value)


def joined_cuts(spans: list[tuple[str, int, int, float, bool, bool]]) -> list[tuple[str, int, int, float]]:
    """Spans (kind, start, end, weight, cut at the left, cut at the right) of windows in order, with the parts of a span that an
    edge has cut put together. A part that finds no other half stays as it is."""
    out: list[tuple[str, int, int, float]] = []
    last: dict[str, tuple[int, int, float]] = {}  # of each kind, the latest span that a right edge has cut
    for kind, start, end, weight, left, right in spans:
        before = last.get(kind)
        if left and before and before[0] < start <= before[1] <= end:
            start, weight = before[0], before[2] + weight * (end - before[1]) / max(end - start, 1)
        out.append((kind, start, end, weight))
        if right:
            last[kind] = (start, end, weight)
    return out


def reconcile(spans: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int]]:
    """The spans without overlaps that have the greatest weight in all (of equals, the one found first)."""
    order = sorted(set(spans), key=lambda s: (s[2], s[1], s[0], s[3]))
    ends = [s[2] for s in order]
    best = [0.0]
    for k, (_, start, _, weight) in enumerate(order):
        best.append(max(best[k], best[bisect_right(ends, start, 0, k)] + weight))
    out, k = [], len(order)
    while k:
        kind, start, end, _ = order[k - 1]
        if best[k] > best[k - 1]:
            out.append((kind, start, end))
            k = bisect_right(ends, start, 0, k - 1)
        else:
            k -= 1
    return out[::-1]


class Windows:
    """Runs the windows of several texts ``BATCH`` at a time and gathers the spans of each text in order."""

    def __init__(self, net: Tagger):
        self.net, self.todo, self.found = net, [], []

    def add(self, text: str) -> None:
        """Appends the text's list of spans to ``found``; complete after :meth:`flush`."""
        spans: list[tuple[str, int, int, float, bool, bool]] = []
        self.found.append(spans)
        starts = window_starts(text)
        whole = codes(text) if starts else None
        for s in starts:
            self.todo.append((spans, s, len(text), whole[s:s + WINDOW]))
            if len(self.todo) == BATCH:
                self.flush()

    def flush(self) -> None:
        if not self.todo:
            return
        ids = np.full((len(self.todo), WINDOW), PAD, dtype=np.int64)
        for k, (_, _, _, part) in enumerate(self.todo):
            ids[k, :len(part)] = part
        e = self.net.scores(ids)
        path = self.net.decode(e)
        path[ids == PAD] = 0
        rows = np.flatnonzero(path.any(axis=1))
        post = self.net.posterior(e[:, rows]) if len(rows) else None
        for r, k in enumerate(rows.tolist()):
            spans, at, size, part = self.todo[k]
            tags = path[k, :len(part)]
            for start in np.flatnonzero(tags % 2 == 1).tolist():
                end = start + 1
                while end < len(tags) and tags[end] == tags[start] + 1:
                    end += 1
                p = post[np.arange(start, end), r, tags[start:end]]
                if p.mean() >= LEAST:
                    cut = (start == 0 and at > 0, end == len(tags) and at + end < size)
                    spans.append((KINDS[(tags[start] - 1) // 2], at + start, at + end, round(float((p - 0.5).sum()), 3), *cut))
        self.todo.clear()


def added_spans(text: str, base: dict[str, list[Span]], found: list[tuple[str, int, int, float, bool, bool]]) -> list[tuple[str, int, int]]:
    """The spans of a text's windows that pass the checks, reconciled."""
    taken = sorted(s for spans in base.values() for s in spans)
    ends = np.maximum.accumulate([e for _, e in taken]).tolist() if taken else []
    starts = [s for s, _ in taken]

    def free(start: int, end: int) -> bool:
        k = bisect_right(starts, end - 1)  # base spans that begin before the end
        return not k or ends[k - 1] <= start

    ok = []
    for kind, start, end, weight in joined_cuts(found):
        while start < end and text[start].isspace():
            start += 1
        while end > start and text[end - 1].isspace():
            end -= 1
        if end > start and free(start, end) and passes(kind, text[start:end]):
            ok.append((kind, start, end, weight))
    return reconcile(ok)


def private_spans(docs: DataFrame, net: Tagger | None = None, sample: int = SAMPLE, made: int = MADE) -> DataFrame:
    """(doc_id, email, ip, card, phone, added): one row for each input row. The kinds are arrays of base spans (s, e), ``added``
    the spans (kind, s, e) of the network, all by start."""
    net = net or fit(snippets(docs, sample), made)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    span = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
    arrow = pa.schema([("doc_id", pa.int64()), *((k, span) for k in KINDS), ("added", pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int32()), ("e", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = shared.value
        for b in batches:
            windows = Windows(tagger)
            texts = [(t.as_py() or b"").decode("utf-8", "replace") for t in b.column("text")]
            for t in texts:
                windows.add(t)
            windows.flush()
            base = [base_spans(t) for t in texts]
            added = [added_spans(t, x, f) for t, x, f in zip(texts, base, windows.found, strict=True)]
            cols = [pa.array([[{"s": s, "e": e} for s, e in x[k]] for x in base], span) for k in KINDS]
            cols.append(pa.array([[{"kind": k, "s": s, "e": e} for k, s, e in x] for x in added], arrow.field("added").type))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], schema=arrow)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    kinds = ", ".join(f"{k} array<struct<s:int,e:int>>" for k in KINDS)
    return rows.mapInArrow(run, f"doc_id long, {kinds}, added array<struct<kind:string,s:int,e:int>>")
