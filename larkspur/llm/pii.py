"""Personal data: fixed base patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans.

The network is written and trained in numpy from labelled spans: sentences made by a seeded rule (``labelled``), with e-mail
addresses, IP addresses, card and phone numbers in plain and disguised spellings, among prose and look-alikes that are none
(hashes, versions, dates, prices, years, ``at`` and ``dot`` as words, words over and over). ``python -m larkspur.llm.pii`` trains it
and writes the weights that lie beside this module; the same seed gives the same weights.

It reads every character of every text, two a step, and labels each: a text is cut into overlapping windows of ``WINDOW``
characters; the emissions of a
position are averaged over its windows, more weight to windows in which it lies further inside, and the CRF decodes the whole text
at once, so windows agree on one set of spans. A span begins with its kind's first tag and goes on with its second. Positions that no span of ``LEAST_GAIN`` could cover
are none (``possible``); the paths between them are decoded one by one, which gives the best path over the whole text.

An added span gains ``LEAST_GAIN`` or more over being none, does not cut a word or number, overlaps no base span and is no card
number that fails Luhn, no IP address with a part above 255 and no words over and over; no pattern is asked of it.

Defined cases: null and empty texts have no spans; a text of any length is read whole; an empty table gives an empty result; every
input row gives one row; offsets are code points, ends exclusive; other columns are ignored by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import os
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import common

KINDS = ("email", "ip", "card", "phone")
HIDDEN, WINDOW, STRIDE = 20, 512, 472
#: Texts of one window are filled up to a multiple of this, so that many are read at once.
FILL = 32
#: Characters of a training window.
TRAINED = 72
SENTENCES, BATCH, EPOCHS, SEED = 60_000, 128, 9, 7
WEIGHTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "pii_weights.npz")
#: Least score of an added span above that of none at its characters (natural logarithm).
LEAST_GAIN = 3.5
SLICE_BYTES = 1 << 20
#: Windows run through the network at once, and paths decoded at once.
AT_ONCE = 512

Span = tuple[int, int, int]  # kind number, start, end

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(s: str) -> bool:
    d = [int(c) for c in s[::-1]]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def _octet(s: str) -> bool:
    s = s.lstrip("0")
    return len(s) <= 3 and int(s or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """Matches of the base patterns by kind, leftmost and non-overlapping."""
    out: list[Span] = []
    done = at = 0
    while (at := text.find("@", at)) >= 0:  # one @ per address; its local part is the run of local characters before it
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((0, start, m.end()))
            at = done = m.end()
        else:
            done = max(done, at)
            at += 1
    for m in _IP.finditer(text):
        if all(map(_octet, m[0].split("."))):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 16 <= len(d := digits(m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(digits(m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return out


# The network -----------------------------------------------------------------------------------------------------------------

_CHARS = "abcdefghijklmnopqrstuvwxyz@.+()-_%/:[]\"'=,#$&*! "
_CODES = {c: i + 4 for i, c in enumerate(_CHARS)}
CODES = len(_CODES) + 4  # 0 digit, 1 other letter, 2 other sign, 3 outside
TAGS = 1 + 2 * len(KINDS)  # 0 none; 1 + 2k begins kind k; 2 + 2k goes on
#: Transitions (from, to) that may be: a kind goes on only where it began or went on.
ALLOWED = np.array([[b == 0 or b % 2 == 1 or a in (b, b - 1) for b in range(TAGS)] for a in range(TAGS)])
FORBIDDEN = -1e4


#: Codes of the characters below this one are looked up; all others count as letters.
_BEYOND = 0x250
_TABLE = np.array([0 if "0" <= c <= "9" else _CODES.get(c.lower(), 1 if c.isalpha() else 2) for c in map(chr, range(_BEYOND))] + [1], dtype=np.uint8)
_TABLE[[10, 13, 9]] = _CODES[" "]


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return _TABLE[np.minimum(points, _BEYOND)]


_PLAIN = "the a we you they he she it is was are were has will can may then now here there time day week year house street room call write mail send reach ask tell meet look stay server host machine address card number phone order price total code line dot at in on of to for with from and or not but if when after before over polka red point home work school least last once noon".split()


def labelled(n: int, seed: int) -> list[tuple[str, list[Span]]]:
    """Sentences with their labelled spans."""
    r = random.Random(seed)
    onsets = ["", "b", "c", "d", "f", "g", "h", "l", "m", "n", "p", "r", "s", "t", "v", "w", "th", "st", "br", "ch", "sch", "qu", "k", "j", "z", "pr"]
    vowels = ["a", "e", "i", "o", "u", "ou", "ea", "ai", "eu", "ie", "é", "è", "ä", "ö", "ü", "ó", "í", "ê"]
    codas = ["", "", "n", "r", "s", "t", "l", "nd", "nt", "st", "ng", "ß", "ch", "tion", "x"]

    def number(k: int) -> str:
        return "".join(r.choices("0123456789", k=k))

    def syllable(plain: bool) -> str:
        return r.choice(onsets) + r.choice(vowels[:5] if plain else vowels) + (r.choice(codas[:9]) if plain else r.choice(codas))

    pairs = "th he in er an re nd on en at ou ed ha to or it is hi es ng st nt ti ea of le se de que ai oi men en ei ung sch ado ción im zu mit ein ver ge ch be er bo co te ga ja ll rr an eux eau ou ié è ß ä ö im der die das und la el los un par con por del".split()

    def word(plain: bool = False) -> str:
        if r.random() < 0.35:
            return "".join(r.choices(pairs, k=r.choice([1, 1, 2, 2, 3, 4])))
        return "".join(syllable(plain) for _ in range(r.choice([1, 1, 2, 2, 3, 4]))) if plain or r.random() < 0.75 else r.choice(_PLAIN)

    def email() -> str:
        at, dot = r.choice([("@", "."), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("[at]", "[dot]"), ("(at)", "(dot)"), (" at ", " dot "), (" at ", " dot "), (" @ ", " . "), ("(at)", "."), (" AT ", " DOT "), (" at ", "."), ("{at}", "{dot}")])
        parts = [word(True) for _ in range(r.choice([1, 1, 2]))] + ([number(r.randint(1, 3))] if r.random() < 0.2 else [])
        local = r.choice(["", ".", "_", "-", dot]).join(parts)
        domain = [r.choice(["", "", "mail", "my"]) + word(True) + r.choice(["", "", "-" + word(True), number(1)])]
        return local + at + dot.join(domain + r.choice([["com"], ["org"], ["net"], ["example", "com"], ["de"], ["co", "uk"], ["example"], ["io"], ["fr"], ["es"], ["edu"]]))

    def ip() -> str:
        return r.choice([".", "[.]", " . ", "(.)", " dot ", ", ", "[dot]"]).join(str(r.choice([r.randint(0, 255), 10, 192, 168, 172, 1])) for _ in range(4))

    def card() -> str:
        d, style = number(16), r.random()
        return d if style < 0.3 else r.choice([" ", "-", ".", "  ", "/", "_"]).join(d[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return r.choice([f"+{r.randint(1, 99)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{number(2)} {a} {b} {c}", f"{a}.{b}.{c}", f"00{number(2)} {a} {b} {c}", f"0{number(2)}/{number(r.randint(5, 8))}", f"0{number(3)} {number(r.randint(5, 8))}", f"{a} {b} {c}", f"0{number(2)} {number(4)} {number(4)}"])

    def other() -> str:
        return r.choice(
            [
                lambda: f'{r.choice(["token", "secret", "key"])} = "{"".join(r.choices("0123456789abcdef", k=40))}"', lambda: f"version {r.randint(0, 9)}.{r.randint(0, 9)}",
                lambda: f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 30)}", lambda: number(r.randint(1, 6)), lambda: f"${number(3)}.{number(2)}",
                lambda: f"{r.randint(1900, 2030)}", lambda: f"{r.randint(1, 5)}.{r.randint(0, 9)}.{r.randint(0, 9)}", lambda: "at " + word(), lambda: number(8),
                lambda: f"{number(2)}:{number(2)}:{number(2)}", lambda: f"@{word()}", lambda: f"{word()} at {word()}", lambda: number(r.randint(22, 40)), lambda: f"{number(1)},{number(3)},{number(3)}",
                lambda: f"a {word()} dot {word()}", lambda: f"{number(2)}.{number(2)}.{r.randint(1900, 2030)}", lambda: f"page {number(2)}-{number(2)}", lambda: f"{word()}.{word()}.{word()}", lambda: f"http://{word(True)}.com/{word(True)}/{number(4)}",
                lambda: f"{word()} ({word()}) {word()}", lambda: f"{word()} [{number(1)}] {word()}", lambda: "(c) " + number(4), lambda: f"{number(1)}. {word()} {number(1)}. {word()}", lambda: f"we met at {word()} dot", lambda: "".join(r.choices("0123456789abcdefghijklmnopqrstuvwxyz-", k=r.randint(10, 36))),
                lambda: " ".join([word()] * r.randint(2, 20)), lambda: " ".join([f"{word()} {word()}"] * r.randint(2, 9)), lambda: " ".join([r.choice(["at", "dot", "at the", "of", "to", "and", "that"])] * r.randint(1, 8)), lambda: f"{word()} at {word()}. {word().title()}", lambda: f"{word()} at {word()} {word()} {word()}",
                lambda: "-" * r.randint(3, 30), lambda: " ".join(number(r.randint(1, 3)) for _ in range(r.randint(2, 9))), lambda: "".join(r.choices("|/\\-_=+*#~<>", k=r.randint(3, 20))),
            ]
        )()

    made, out = (email, ip, card, phone), []
    for _ in range(n):
        parts, spans, at = [], [], 0
        junk = r.random() < 0.25
        dense = r.choice([0, 0.02, 0.16, 0.3])
        while at < 2 * TRAINED:
            x = r.random()
            if x < dense:
                kind = r.randrange(4)
                s = made[kind]()
                if r.random() < 0.1:
                    s = s.upper()
                spans.append((kind, at, at + len(s)))
                s += r.choice(["", ".", ",", "!!", ";", ")"]) if r.random() < 0.4 else ""
            else:
                s = other() if x < 0.14 + dense else word() + r.choice(["", "", "", "", ".", ",", ":"])
                if r.random() < 0.15:
                    s = r.choice([s.title(), s.title(), s.upper()])
            if junk and r.random() < 0.5:
                s += r.choice(["***", "%%%", "&&&", "###", "$$$", "!!", " |"])
            parts.append(s)
            at += len(s) + 1
        out.append((" ".join(parts), spans))
    return out


@dataclass
class Network:
    """Weights by name; two directions of an LSTM, a linear layer to tags, CRF transitions."""

    w: dict[str, np.ndarray]

    @staticmethod
    def fresh(seed: int) -> Network:
        g = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            for k in "12":  # of the first and the second character of a step
                w[f"x{d}{k}"] = g.normal(0, 0.25, (CODES, 4 * HIDDEN)).astype(np.float32)
            w[f"h{d}"] = g.normal(0, 0.25, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            w[f"x{d}1"][:, HIDDEN : 2 * HIDDEN] += 1  # forget gates begin open
        w["o"] = g.normal(0, 0.25, (2 * HIDDEN, 2 * TAGS)).astype(np.float32)
        w["ob"] = np.zeros(2 * TAGS, dtype=np.float32)
        w["t"] = np.where(ALLOWED, 0, FORBIDDEN).astype(np.float32)
        return Network(w)

    def _lstm(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """Hidden states (batch, steps, HIDDEN) of one direction over codes (batch, time), and what its gradients need."""
        b, t = x.shape[0], x.shape[1] // 2
        one, two, wh = self.w[f"x{d}1"], self.w[f"x{d}2"], self.w[f"h{d}"]
        h = c = np.zeros((b, HIDDEN), dtype=np.float32)
        out, trace = np.empty((b, t, HIDDEN), dtype=wh.dtype), []
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            z = one[x[:, 2 * k]] + two[x[:, 2 * k + 1]] + h @ wh
            s = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            new = f * c + i * g
            tc = np.tanh(new)
            trace.append((k, h, c, i, f, o, g, tc))
            c, h = new, o * tc
            out[:, k] = h
        return out, trace

    def _ready(self) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By direction: input weights of each pair of codes, recurrent and output weights, scaled for ``emissions``; made once."""
        if not hasattr(self, "_made"):
            self._made, two = {}, np.float32(2)
            for d, out in (("f", self.w["o"][:HIDDEN]), ("b", self.w["o"][HIDDEN:])):
                wx = -(self.w[f"x{d}1"][:, None] + self.w[f"x{d}2"][None]).reshape(-1, 4 * HIDDEN)
                wh = np.ascontiguousarray(self.w[f"h{d}"].T * -two)  # states are held at half their size
                wx[:, 3 * HIDDEN :] *= two  # a tanh is a sigmoid of twice its argument
                wh[3 * HIDDEN :] *= two
                self._made[d] = (wx, wh, np.ascontiguousarray(out.T * two))
        return self._made

    def emissions(self, x: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
        """(batch, tags, time) of codes (batch, time): units by rows and windows by columns, one exp for all gates, which takes half the time of a tanh.

        ``sizes``: even lengths of the windows, longest first, each read as if alone; what lies beyond them means nothing. Cells are
        held times -2, so that their exp is that of their tanh as a sigmoid.
        """
        batch, steps = x.shape[0], x.shape[1] // 2
        pairs = np.ascontiguousarray((x[:, ::2].astype(np.intp) * CODES + x[:, 1::2]).T)
        total = np.empty((steps, 2 * TAGS, batch), dtype=np.float32)
        total[:] = self.w["ob"][:, None]
        cuts = np.unique(sizes) // 2 if sizes is not None else np.array([steps])
        parts = [(a, b, batch if sizes is None else int((sizes >= 2 * b).sum())) for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)]
        half, one, two, four = map(np.float32, (0.5, 1, 2, -4))
        with np.errstate(over="ignore"):  # a sigmoid of 1 / (1 + inf) is 0
            for d, (wx, wh, out) in self._ready().items():
                h = c = np.zeros((HIDDEN, 0), dtype=np.float32)
                for a, b, n in parts if d == "f" else parts[::-1]:
                    taken, z, made, *old = (np.zeros(s, dtype=np.float32) for s in ((n, 4 * HIDDEN), (4 * HIDDEN, n), (2 * TAGS, n), (HIDDEN, n), (HIDDEN, n)))
                    for new, was in zip(old, (h, c), strict=True):  # the longest go on, or more begin
                        new[:, : was.shape[1]] = was[:, :n]
                    (h, c), gates, (i, f, o, g) = old, z[: 3 * HIDDEN], z.reshape(4, HIDDEN, n)
                    for k in range(a, b) if d == "f" else range(b - 1, a - 1, -1):
                        np.matmul(wh, h, out=z)
                        z += wx.take(pairs[k, :n], axis=0, out=taken, mode="clip").T
                        np.exp(z, out=z)
                        z += one
                        np.divide(one, gates, out=gates)
                        np.divide(four, g, out=g)
                        g += two
                        g *= i
                        c *= f
                        c += g
                        np.exp(c, out=h)
                        h += one
                        np.divide(one, h, out=h)
                        h -= half
                        h *= o
                        total[k, :, :n] += np.matmul(out, h, out=made)
        flat, e = total.reshape(2 * steps * TAGS, batch), np.empty((batch, TAGS, 2 * steps), dtype=np.float32)
        for k in range(0, batch, 16):  # a cache line of columns at once
            e[k : k + 16] = flat[:, k : k + 16].T.copy().reshape(-1, 2 * steps, TAGS).transpose(0, 2, 1)
        return e

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """CRF loss per character and its gradients."""
        b, t = x.shape
        (hf, tf), (hb, tb) = self._lstm(x, "f"), self._lstm(x, "b")
        h = np.concatenate([hf, hb], axis=2)
        e, tr = (h @ self.w["o"] + self.w["ob"]).reshape(b, t, TAGS), self.w["t"]
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for k in range(1, t):
            alpha[:, k] = _lse(alpha[:, k - 1, :, None] + tr[None], 1) + e[:, k]
        for k in range(t - 2, -1, -1):
            beta[:, k] = _lse(tr[None] + (e[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
        z = _lse(alpha[:, -1], 1)
        de = np.exp(alpha + beta - z[:, None, None])
        rows, times = np.arange(b)[:, None], np.arange(t)[None]
        gold = e[rows, times, y].sum() + tr[y[:, :-1], y[:, 1:]].sum()
        de[rows, times, y] -= 1
        both = np.exp(alpha[:, :-1, :, None] + tr + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])
        dt = both.sum(axis=(0, 1))
        np.add.at(dt, (y[:, :-1], y[:, 1:]), -1)
        n = b * t
        both = de.reshape(b, t // 2, 2 * TAGS)
        g = {"t": np.where(ALLOWED, dt, 0) / n, "o": np.einsum("bth,btk->hk", h, both) / n, "ob": both.sum(axis=(0, 1)) / n}
        dh = both @ self.w["o"].T
        for d, trace, part in (("f", tf, dh[:, :, :HIDDEN]), ("b", tb, dh[:, :, HIDDEN:])):
            one, two, gh = np.zeros_like(self.w[f"x{d}1"]), np.zeros_like(self.w[f"x{d}2"]), np.zeros_like(self.w[f"h{d}"])
            back_h = back_c = np.zeros((b, HIDDEN), dtype=np.float32)
            for k, h0, c0, i, f, o, gg, tc in reversed(trace):
                dhk = part[:, k] + back_h
                dc = back_c + dhk * o * (1 - tc * tc)
                dz = np.concatenate([dc * gg * i * (1 - i), dc * c0 * f * (1 - f), dhk * tc * o * (1 - o), dc * i * (1 - gg * gg)], axis=1)
                np.add.at(one, x[:, 2 * k], dz)
                np.add.at(two, x[:, 2 * k + 1], dz)
                gh += h0.T @ dz
                back_h, back_c = dz @ self.w[f"h{d}"].T, dc * f
            g[f"x{d}1"], g[f"x{d}2"], g[f"h{d}"] = one / n, two / n, gh / n
        return float(z.sum() - gold) / n, g


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


_loaded: list[Network] = []


def loaded() -> Network:
    """The network with the weights beside this module, read once per driver process."""
    if not _loaded:
        with np.load(WEIGHTS) as f:
            _loaded.append(Network({k: f[k] for k in f.files}))
    return _loaded[0]


def train(sentences: int = SENTENCES, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Adam over shuffled batches of labelled windows; the same weights for the same arguments."""
    x, y = np.full((sentences, TRAINED), 3, dtype=np.int64), np.zeros((sentences, TRAINED), dtype=np.int64)
    for row, (text, spans) in enumerate(labelled(sentences, seed)):
        shift = (len(text) - TRAINED) * (row % 4) // 3  # beginnings, middles and ends
        x[row] = codes(text)[shift : shift + TRAINED]
        for kind, a, b in spans:
            a, b = a - shift, min(b - shift, TRAINED)
            if b > max(a, 0):
                y[row, max(a, 0) : b] = 2 + 2 * kind
                if a >= 0:
                    y[row, a] = 1 + 2 * kind
        if row % 5 == 4:  # the text ends within the window, where no span goes on
            end = max([8 + row % (TRAINED - 8), *(b - shift for _, a, b in spans if a - shift < 8 + row % (TRAINED - 8))])
            x[row, end:], y[row, end:] = 3, 0
    net, g = Network.fresh(seed), np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = g.permutation(sentences)
        for at in range(0, sentences, BATCH):
            _, grad = net.gradients(x[order[at : at + BATCH]], y[order[at : at + BATCH]])
            step += 1
            norm = float(np.sqrt(sum((v * v).sum() for v in grad.values())))
            for k, v in grad.items():
                v = v / max(1.0, norm)
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                rate = 0.02 * (1 - (epoch + at / sentences) / epochs) + 1e-4
                net.w[k] = (net.w[k] - rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def starts(n: int) -> list[int]:
    """Where a text's windows begin; the last one ends with the text."""
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW] if n > WINDOW else [0] * (n > 0)


def possible(e: np.ndarray, tr: np.ndarray, begins: np.ndarray, ends: np.ndarray, least: float = -1e-3) -> np.ndarray:
    """Positions of (tags, characters) that some span could cover whose gain over none, with the best neighbours on both sides, is ``least`` or more.

    With the default, every other position is none in every best path, as leaving out a span of negative gain betters a path.
    ``begins`` and ``ends`` are the first and last places of texts; between texts no tag but none is any good.
    """
    first, on = np.arange(1, TAGS, 2), np.arange(2, TAGS, 2)
    follow = np.append(0, first)  # what may come after a span
    enter = (tr[:, first] - tr[:, [0]]).max(axis=0)
    leave = np.array([(tr[[f, o]][:, follow] - tr[0, follow]).max() for f, o in zip(first, on, strict=True)])
    step = np.maximum(tr[first, on], tr[on, on]) - tr[0, 0]
    out = np.zeros(e.shape[1], dtype=bool)
    for k in range(len(KINDS)):
        steps = np.cumsum(e[on[k]] - e[0] + step[k], dtype=np.float64)
        begin = e[first[k]] - e[0] + enter[k] - steps
        begin[begins] -= enter[k]  # a text's ends have one neighbour only
        np.maximum.accumulate(begin, out=begin)
        steps += leave[k]
        steps[ends] -= leave[k]
        begin += np.maximum.accumulate(steps[::-1])[::-1]
        out |= begin >= least
    return out


#: Emission of every tag but none between texts.
APART = -1e6


def emitted(net: Network, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Emissions (tags, characters) of the texts end to end, a place apart, averaged over each one's windows; and where each begins (one more at the end).

    A text of one window is filled up to a multiple of ``FILL``.
    """
    coded = [codes(t) for t in texts]
    first = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(c) + 1 for c in coded], out=first[1:])
    out, weight = np.zeros((TAGS, int(first[-1])), dtype=np.float32), np.zeros(int(first[-1]), dtype=np.float32)
    place = [(min(WINDOW, -(-len(c) // FILL) * FILL), i, at) for i, c in enumerate(coded) for at in starts(len(c))]
    place.sort(key=lambda p: -p[0])  # windows of all lengths are read together, longest first
    edge = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)
    for k in range(0, len(place), AT_ONCE):
        some = place[k : k + AT_ONCE]
        x = np.full((len(some), some[0][0]), 3, dtype=np.uint8)
        for row, (size, i, at) in enumerate(some):
            c = coded[i][at : at + size]
            x[row, : len(c)] = c
        e = net.emissions(x, np.array([size for size, _, _ in some]))
        for row, (size, i, at) in enumerate(some):
            a, n = int(first[i]) + at, min(size, len(coded[i]))
            out[:, a : a + n] += e[row, :, :n] * edge if n == WINDOW else e[row, :, :n]
            weight[a : a + n] += edge if n == WINDOW else 1
    weight[first[1:] - 1] = 1
    out /= weight
    out[1:, first[1:] - 1] = APART
    return out, first


def _paths(tr: np.ndarray, parts: list[np.ndarray], fixed: list[tuple[bool, bool]]) -> list[np.ndarray]:
    """Best tags of runs of emissions whose neighbours (before, after) are none where ``fixed``, and the text's ends where not."""
    out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(parts)
    order = sorted((i for i in range(len(parts)) if len(parts[i])), key=lambda i: len(parts[i]))
    k = 0
    while k < len(order):
        longest = len(parts[order[k]])
        some = [i for i in order[k : k + AT_ONCE] if len(parts[i]) <= 1.3 * longest + 16]
        k += len(some)
        t = len(parts[some[-1]])
        e = np.zeros((len(some), t, TAGS), dtype=np.float32)
        for row, i in enumerate(some):
            n = len(parts[i])
            e[row, :n] = parts[i]
            e[row, 0] += tr[0] if fixed[i][0] else np.where(ALLOWED[0], 0, FORBIDDEN)
            e[row, n - 1] += tr[:, 0] * fixed[i][1]
        ends = np.array([len(parts[i]) for i in some])
        best, back = e[:, 0], np.zeros((len(some), t, TAGS), dtype=np.int8)
        for step in range(1, t):
            every = best[:, :, None] + tr[None]
            arg = every.argmax(axis=1)
            new = every.max(axis=1) + e[:, step]
            on = step < ends  # a path that has ended stays as it is
            back[:, step] = np.where(on[:, None], arg, np.arange(TAGS))
            best = np.where(on[:, None], new, best)
        tag = best.argmax(axis=1)
        path = np.zeros((len(some), t), dtype=np.int64)
        path[:, -1] = tag
        for step in range(t - 1, 0, -1):
            tag = back[np.arange(len(some)), step, tag]
            path[:, step - 1] = tag
        for row, i in enumerate(some):
            out[i] = path[row, : len(parts[i])]
    return out


def decode(net: Network, texts: list[str], least: float = LEAST_GAIN) -> list[list[tuple[Span, float]]]:
    """Spans of each text, by the best path over the whole text, with the score of each above that of none at its characters.

    Spans that could not gain ``least`` are none from the start.
    """
    tr = net.w["t"]
    e, first = emitted(net, texts)
    begins, ends = first[:-1], first[1:] - 2
    some = ends >= begins
    live = possible(e, tr, begins[some], ends[some], least)
    live[first[1:] - 1] = False
    edge = np.flatnonzero(np.diff(live.astype(np.int8), prepend=0, append=0))
    runs = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
    at_begin, at_end = np.zeros(len(live) + 1, dtype=bool), np.zeros(len(live) + 1, dtype=bool)
    at_begin[begins], at_end[first[1:] - 1] = True, True
    found: list[list[tuple[Span, float]]] = [[] for _ in texts]
    for (a, _), tags in zip(runs, _paths(tr, [e[:, a:b].T for a, b in runs], [(not at_begin[a], not at_end[b]) for a, b in runs]), strict=True):
        if not tags.any():
            continue
        i = int(np.searchsorted(first, a, side="right")) - 1
        for kind, s, end in tagged(tags):
            steps = np.arange(s, end)
            gain = float((e[tags[steps], a + steps] - e[0, a + steps]).sum()) + sum(float(tr[x, y] - tr[0, 0]) for x, y in zip([0, *tags[s:end]], [*tags[s:end], 0], strict=True))
            found[i].append(((kind, a - int(first[i]) + s, a - int(first[i]) + end), gain))
    return found


def tagged(tags: np.ndarray) -> list[Span]:
    """Spans of a tag sequence: a begin tag and what goes on with its kind."""
    out: list[Span] = []
    at, n = 0, len(tags)
    while at < n:
        if tags[at] % 2 == 1:
            kind, end = (int(tags[at]) - 1) // 2, at + 1
            while end < n and tags[end] == 2 + 2 * kind:
                end += 1
            out.append((kind, at, end))
            at = end
        else:
            at += 1
    return out


def plausible(kind: int, s: str) -> bool:
    """Whether the checks that a number carries in itself hold: Luhn of a card, parts of an IP address, digits of a phone number; no words over and over."""
    words = s.lower().split()
    if len(words) > 3 * len(set(words)):
        return False
    if kind == 1:
        groups = re.findall(r"[0-9]+", s)
        return not groups or (len(groups) == 4 and all(map(_octet, groups)))
    d = digits(s)
    if kind == 2:
        return 16 <= len(d) <= 19 and luhn(d)
    return kind == 0 or not d or 7 <= len(d) <= 15


def all_spans(net: Network, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans, and all spans (base and added), both by kind, then start."""
    base = [sorted(base_spans(t)) for t in texts]
    out = []
    for text, mine, found in zip(texts, base, decode(net, texts), strict=True):
        added: list[Span] = []
        for (kind, s, e), gain in found:
            while s < e and text[s].isspace():
                s += 1
            while e > s and text[e - 1].isspace():
                e -= 1
            whole = not (text[s - 1 : s].isalnum() and text[s : s + 1].isalnum()) and not (text[e : e + 1].isalnum() and text[e - 1 : e].isalnum())
            if s < e and gain >= LEAST_GAIN and whole and not any(x < e and s < y for _, x, y in mine) and plausible(kind, text[s:e]):
                added.append((kind, s, e))
        out.append((mine, sorted(mine + added)))
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, numbers of base spans by kind, digest of the base spans, all spans."""
    spark = docs.sparkSession
    common.prepare(spark)
    handle = spark.sparkContext.broadcast(loaded())
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "text", SLICE_BYTES):
                found = all_spans(handle.value, [t or "" for t in batch.column("text").to_pylist()])
                columns = {"doc_id": batch.column("doc_id")}
                columns |= {f"n_{k}": pa.array([sum(s[0] == j for s in base) for base, _ in found], pa.int64()) for j, k in enumerate(KINDS)}
                columns |= {"base_sha256": pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found]), "spans": pa.array([written(s) for _, s in found], pa.string())}
                yield pa.RecordBatch.from_pydict(columns)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span (joined where they overlap) replaced by its kind in brackets."""
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns, with the spans in the text column replaced."""
    spark = docs.sparkSession
    common.prepare(spark)
    handle = spark.sparkContext.broadcast(loaded())

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, text, SLICE_BYTES):
                old = batch.column(text).to_pylist()
                found = all_spans(handle.value, [t or "" for t in old])
                new = [t if t is None else masked(t, s) for t, (_, s) in zip(old, found, strict=True)]
                at = batch.schema.get_field_index(text)
                yield pa.RecordBatch.from_arrays([pa.array(new, c.type) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return find(common.documents(spark, sf_dir))


QUERIES = {"op7_pii": op7_pii}
ORACLES: dict[str, str] = {}


if __name__ == "__main__":
    np.savez(WEIGHTS, **train().w)
