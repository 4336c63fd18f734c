"""Personal data: generators propose overlapping spans, boosted trees choose among them, fixed rules stay.

The base rules (e-mail, IPv4, card, phone) find spans by format and check; these are always kept.  High-recall
generators then propose further, overlapping spans: e-mail addresses written out in full or by half, IPv6
addresses (compressed too), telephone numbers without a plus and bare runs of digits, cards with other separators.  Gradient-boosted trees over features of format and
context score each; a span is added where its score reaches its kind's threshold, overlaps no base span and
no better proposal.  The trees are fitted here, on drawn examples of both classes, and each threshold is the
least that keeps the wanted precision on drawn examples of another make, which the fit has not seen.

Defined results: null text is empty; null and empty texts have no spans; repeated rows are rows of their own;
an empty table gives no rows; columns other than doc_id and text are ignored.  Whole texts are searched; every
pattern runs in time linear in the text.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, id_text

#: The kinds in the order of all outputs.
KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match that starts inside a run of digits would also start at the run, so runs are entered at their start only.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Around each at sign: the longest local part that no earlier match has taken, then the longest domain."""
    out, taken, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > taken and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            taken = m.end()
        else:
            taken = at + 1
        at = text.find("@", max(taken, at + 1))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


# Generators: formats that the base rules leave out.
_AT = r"(?:[\x20]?(?:\(at\)|\[at\]|\{at\})[\x20]?|[\x20]at[\x20]|@)"
_DOT = r"(?:[\x20]?(?:\(dot\)|\[dot\]|\{dot\})[\x20]?|[\x20]dot[\x20]|\.)"
_WRITTEN = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{2,63}}){{1,4}}", re.I)
_SPELT = re.compile(r"[(\[{](?:at|dot)[)\]}]|[\x20](?:at|dot)[\x20]", re.I)
_HEX_RUN = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f:]{2,39}(?![0-9A-Za-z:])")
_LOOSE_PHONE = re.compile(r"(?<![0-9A-Za-z+.])(?:\([0-9]{2,5}\)[\x20]?|[0-9]{2,5}[\x20./-])(?:[0-9]{2,5}[\x20./-]){1,4}[0-9]{2,5}(?![0-9A-Za-z])")
_BARE_PHONE = re.compile(r"(?<![0-9A-Za-z+.,/-])[0-9]{7,15}(?![0-9A-Za-z]|[.,/-][0-9])")
_LOOSE_CARD = re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:[./_]|[\x20-]{2,3})[0-9]{4}(?:[./_]|[\x20-]{2,3})[0-9]{4}(?:[./_]|[\x20-]{2,3})[0-9]{1,7}(?![0-9A-Za-z])")
_GROUP = re.compile(r"\(?[0-9]+\)?")


def ip6(run: str) -> bool:
    """Eight groups of up to four hexadecimal digits, or fewer with one gap."""
    head, gap, tail = run.partition("::")
    groups = [g for part in (head, tail) for g in part.split(":") if part]
    return all(1 <= len(g) <= 4 for g in groups) and (len(groups) <= 7 if gap else len(groups) == 8)


def proposals(text: str) -> list[tuple[str, int, int]]:
    """Spans that may be personal data; they overlap, also within a kind: a number is proposed with and without its first and last group."""
    out: list[tuple[str, int, int]] = []
    if _SPELT.search(text):
        for m in _WRITTEN.finditer(text):
            if _SPELT.search(m[0]):
                out.append(("email", *m.span()))
    if "::" in text or text.count(":") >= 2:
        out += [("ip", *m.span()) for m in _HEX_RUN.finditer(text) if m[0].count(":") >= 2 and not m[0].startswith(":::")]
    if not _DIGIT.search(text):
        return out
    for m in _LOOSE_PHONE.finditer(text):
        out.append(("phone", *m.span()))
        groups = [(m.start() + g.start(), m.start() + g.end()) for g in _GROUP.finditer(m[0])]
        for a, b in ((groups[0][0], groups[-2][1]), (groups[1][0], groups[-1][1])):
            if len(_NOT_DIGIT.sub("", text[a:b])) >= 7:
                out.append(("phone", a, b))
    out += [("phone", *m.span()) for m in _BARE_PHONE.finditer(text)]
    out += [("card", *m.span()) for m in _LOOSE_CARD.finditer(text)]
    return out


# Words near a span that speak for a kind or against personal data.
_FOR = {
    "email": re.compile(r"mail|contact|write|reach|address", re.I), "ip": re.compile(r"\bip|host|server|login|address|client", re.I),
    "card": re.compile(r"card|visa|master|amex|pay|credit|debit", re.I), "phone": re.compile(r"phone|call|\btel|mobile|\bcell|fax|contact|whatsapp|ring|dial|number", re.I),
}
_AGAINST = re.compile(r"version|release|isbn|order|invoice|page|\bid\b|serial|date|\bref|chapter|score|price|total|section|time|between|ticket|\bsku|\blot\b|product|batch|\bcode|room|track|count|look|meet|\$|€|%", re.I)
_CONTEXT = 24


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    span = text[start:end]
    digits = _NOT_DIGIT.sub("", span)
    groups = re.findall(r"[0-9]+", span)
    before, after = text[max(0, start - _CONTEXT) : start], text[end : end + _CONTEXT]
    near = before + " " + after
    lens = [len(g) for g in groups] or [0]
    year = any(len(g) == 4 and g[:2] in ("19", "20") for g in groups)
    return [
        KINDS.index(kind), len(digits), end - start, len(groups), lens[0], lens[-1], max(lens), len(set(re.sub(r"[0-9A-Za-z]", "", span))),
        float(luhn(digits)) if len(digits) >= 12 else 0.0, float("(" in span), float("-" in span), float("." in span), float("/" in span), span.count(":"),
        float(bool(_FOR[kind].search(before))), float(bool(_AGAINST.search(near))), float(before[-1:].isalnum()), float(after[:1].isalnum()), float(year),
        float(bool(re.search(r"[A-Fa-f]", span))), float(bool(re.search(r"\bat\b|\(at|\[at|\{at", span, re.I))), float(bool(re.search(r"dot|\.", span, re.I))),
        float(ip6(span)), span.count("::"), float(bool(re.search(r"[(\[{](at|dot)", span, re.I))), float(before[-1:] in "-./" and before[-1:] != "" or after[:1] in "-/" and after[:1] != ""),
    ]


@dataclass
class Trees:
    """Gradient-boosted trees on the logistic loss: each a complete tree of fixed depth."""

    base: float
    trees: list
    thresholds: dict

    def scores(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while at.size and at[0] < len(feature):
                at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > cut[at])
            f += value[at - len(feature)]
        return 1 / (1 + np.exp(-f))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3) -> tuple[float, list]:
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    f, trees = np.full(len(y), base), []
    cuts = [(np.unique(x[:, j])[:-1] + np.diff(np.unique(x[:, j])) / 2)[:32] for j in range(x.shape[1])]
    inner = 2**depth - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for k in range(inner):
            own = np.flatnonzero(node == k)
            best = (1e-9, 0, np.inf)
            total_g, total_h = g[own].sum(), h[own].sum()
            for j, edges in enumerate(cuts):
                for c in edges:
                    left = own[x[own, j] <= c]
                    gl, hl = g[left].sum(), h[left].sum()
                    gain = gl**2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - total_g**2 / (total_h + 1)
                    if gain > best[0]:
                        best = (gain, j, c)
            feature[k], cut[k] = best[1], best[2]
            node[own] = 2 * k + 1 + (x[own, best[1]] > best[2])
        leaf = node - inner
        value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + 1)
        f += value[leaf]
        trees.append((feature, cut, value))
    return base, trees


def drawn_examples(n: int, seed: int, make: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of proposals in drawn sentences, half with personal data and half with look-alikes.

    The two makes differ in formats and in the words around the spans: the trees are fitted on one and their
    thresholds set on the other.
    """
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 9)))
    of = lambda *two: r.choice(two[make])

    def card() -> str:
        body = r.choice("3456") + d(14)
        body += str((10 - sum((int(c) * 2 - 9 * (int(c) > 4)) if k % 2 == 0 else int(c) for k, c in enumerate(reversed(body))) % 10) % 10)
        return of((".", "/", "_", "  ", " - "), ("/", ".", "--", "  ")).join(body[i : i + 4] for i in range(0, 16, 4))

    def six() -> str:
        groups = [f"{r.randrange(65536):x}" for _ in range(8)]
        if r.random() < 0.5:
            return ":".join(groups)
        a, b = r.randint(0, 4), r.randint(1, 3)
        return ":".join(groups[:a]) + "::" + ":".join(groups[:b])

    def mail() -> str:
        at = of((" at ", " (at) ", " [at] ", "(at)", "{at}", "@"), (" (at) ", "[at]", " at ", " {at} ", "@"))
        dot = of((" dot ", "(dot)", " [dot] "), (" dot ", " (dot) ", "[dot]")) if at == "@" or r.random() < 0.6 else "."
        return f"{w()}{r.choice(('', '.' + w()))}{at}{w()}{dot}{of(('com', 'org', 'net', 'de'), ('com', 'io', 'fr', 'edu'))}"

    def number() -> str:
        return of((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(2)} {d(4)} {d(4)}"), (f"({d(3)}){d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(3)} {d(3)} {d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"({d(3)}) {d(3)} {d(4)}"))

    true = [
        lambda: (of(("call ", "tel ", "phone: ", "my mobile is ", ""), ("ring me on ", "phone ", "fax ", "contact ", "")), number()),
        lambda: (of(("call ", "phone: ", "dial "), ("ring me on ", "my number is ", "tel: ")), d(r.choice((9, 10, 10, 11)))),
        lambda: (of(("pay with card ", "visa ", ""), ("credit card ", "paid by visa ", "")), card()),
        lambda: (of(("host ", "from ip ", "client ", ""), ("login from ", "server ", "ip address ")), six()),
        lambda: (of(("mail ", "write to ", "contact "), ("reach me: ", "e-mail ", "my address: ")), mail()),
    ]
    false = [
        lambda: (of(("on ", "date ", ""), ("since ", "until ", "dated ")), f"{r.choice(('19', '20'))}{d(2)}-{d(2)}-{d(2)}"),
        lambda: (of(("version ", "release ", "section "), ("chapter ", "version ", "v ")), f"{d(2)}.{d(2)}.{d(2)}"),
        lambda: (of(("isbn ", "order ", "invoice ", "ref "), ("order no ", "isbn ", "ticket ")), f"{d(3)}-{d(2)}-{d(5)}-{d(3)}"),
        lambda: (of(("score ", "", "between "), ("page ", "", "total ")), f"{d(2)}-{d(2)}-{d(2)}"),
        lambda: (of(("at ", "time ", ""), ("by ", "around ", "")), f"{d(2)}:{d(2)}:{d(2)}"),
        lambda: (of(("serial ", "id ", ""), ("serial ", "code ", "")), of((".", "/", "_"), ("/", "_")).join(d(4) for _ in range(4))),
        lambda: ("", f"{w()} at {w()} dot {w()}{w()}"),
        lambda: (of(("look ", "", "we met "), ("", "they look ", "sold ")), f"at {w()}.{of(('com', 'org'), ('com', 'net'))}"),
        lambda: (of(("pages ", "total ", ""), ("rooms ", "count ", "")), f"{d(4)} {d(4)} {d(2)}"),
        lambda: ("", f"{d(2)}/{d(2)}/{r.choice(('19', '20'))}{d(2)}"),
        lambda: (of(("order ", "id ", "", "lot "), ("ticket ", "sku ", "", "tracking ")), d(r.randint(7, 15))),
        lambda: (of(("in ", ""), ("of ", "")), r.choice((f"{r.choice('abcdef')}::{r.choice(('add', 'b', 'fade'))}", f"{r.choice(('bed', 'dad', 'cafe'))}::{r.choice('abcdef')}", f"{d(1)}::{d(1)}"))),
    ]
    x, y = [], []
    while len(x) < n:
        good = r.random() < 0.5
        lead, body = r.choice(true if good else false)()
        lead = f"{w()} {w()} {lead}"
        text = f"{lead}{body} {w()} {w()}"
        for kind, a, b in proposals(text):
            if a < len(lead) + len(body) and b > len(lead):
                x.append(features(text, kind, a, b))
                y.append(float(good and b - a >= 0.8 * len(body) and abs(a - len(lead)) <= 1))
    return np.array(x[:n]), np.array(y[:n])


def train(n: int = 3000, seed: int = 5) -> Trees:
    """Fit on ``n`` drawn examples; thresholds on as many of the other make, for each kind."""
    model = Trees(0.0, [], {})
    model.base, model.trees = boost(*drawn_examples(n, seed))
    x, y = drawn_examples(n, seed + 1, make=1)
    s = model.scores(x)
    for k, kind in enumerate(KINDS):
        own = x[:, 0] == k
        order = np.argsort(-s[own])
        right = np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
        good = np.flatnonzero(right >= PRECISION)
        model.thresholds[kind] = max(0.5, float(s[own][order][good[-1]])) if len(good) else 2.0
    return model


def added_spans(text: str, base: list[tuple[str, int, int]], model: Trees) -> list[tuple[str, int, int]]:
    """The proposals that the trees select: best first, none overlapping what is there."""
    found = [p for p in proposals(text) if not any(a < p[2] and p[1] < b for _, a, b in base)] if len(base) < 50 else _clear(proposals(text), base)
    if not found:
        return []
    scores = model.scores(np.array([features(text, *p) for p in found]))
    ranked = sorted((-s, p[1], p) for s, p in zip(scores.tolist(), found) if s >= model.thresholds[p[0]])
    out: list[tuple[str, int, int]] = []
    for _, _, p in ranked:
        if not _clear([p], out):
            continue
        out.append(p)
    return out


def _clear(found: list, taken: list) -> list:
    """Those of ``found`` that overlap nothing of ``taken`` (which may overlap among itself)."""
    if not taken:
        return found
    spans = sorted((a, b) for _, a, b in taken)
    starts = np.array([a for a, _ in spans])
    furthest = np.maximum.accumulate([b for _, b in spans])
    out = []
    for p in found:
        k = int(np.searchsorted(starts, p[2]))  # spans that start before the end
        if not k or furthest[k - 1] <= p[1]:
            out.append(p)
    return out


def spell(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find(documents: DataFrame, model: Trees | None = None) -> DataFrame:
    """doc_id, base and spans (both as kind:start:end, comma-joined); a document stays in its partition."""
    model = model or train()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            base, every = [], []
            for text in batch["text"]:
                own = base_spans(text) if isinstance(text, str) else []
                more = added_spans(text, own, model) if isinstance(text, str) else []
                base.append(spell(own))
                every.append(spell(own + more))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "base": base, "spans": every})

    found = gathered(documents).select(id_text(), "text").mapInPandas(run, "doc_id string, base string, spans string")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def redact_text(text: str, model: Trees) -> str:
    base = base_spans(text)
    spans = sorted(base + added_spans(text, base, model), key=lambda s: (s[1], -s[2]))
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out.append(f"{text[at:a]}[{kind.upper()}]")
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(documents: DataFrame, model: Trees | None = None) -> DataFrame:
    """``documents`` with each span of its texts replaced by the kind in brackets; overlapping spans go as one.

    All other columns pass through as they are, in Arrow.
    """
    model = model or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index("text")
            kind = batch.schema.field(at).type
            texts = (t.as_py() for t in batch.column(at))
            yield batch.set_column(at, batch.schema.field(at), pa.array((None if t is None else redact_text(t, model) for t in texts), kind))

    return gathered(documents).mapInArrow(run, documents.schema)
