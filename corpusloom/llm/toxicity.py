"""Toxicity: a linear-chain conditional random field tags toxic spans; its marginals give document scores.

Fitting.  A bounded sample of labelled documents (at most FIT_PER_CLASS of each label, those first in the order
of a hash) is brought to the driver.  Stems, that is words and their prefixes of three to five letters, that
mark toxic documents label the tokens of these documents; half of the sample picks the stems and the other
half confirms them, so that names of one document don't count.  A field with the states clean and toxic is
fitted to the labelled tokens by gradient ascent: emission weights for classes of evidence and transition
weights.  A logistic layer turns features of the marginals into the score of a document, with the classes
weighed as they are among the labels.

Scoring.  Executors run forward-backward over each whole text.  Tokens without evidence share one emission, so
a run of g of them is the g-th power of one 2 x 2 matrix, in closed form.

Defined results: null and empty texts have no evidence and get the score of such texts; repeated rows are rows
of their own; with no labels of both kinds every score is the share of toxic labels (0 without labels); an
empty table gives no rows; labels of null doc_id or toxic are left out.  Neither doc_id, lang nor source
enters a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, id_text

#: Documents of each label in the sample that is fitted, on whole texts; places that are fitted at a time (10 MB).
FIT_PER_CLASS, FIT_ITEMS = 2_000, 200_000
PREFIXES = (3, 4, 5)
#: Evidence needed by a stem: toxic documents in each half, and odds against clean documents.
LEAST_DOCS, LEAST_ODDS = 4, 20.0
#: A prefix counts only if no one word makes up more than this share of its documents; else the word itself counts.
MOST_ONE_WORD = 0.6
_TOKEN = re.compile(r"\w+")


def stems(word: str) -> list[str]:
    """The word itself, then its prefixes with a mark that tells them from words."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]


@dataclass
class Model:
    evidence: dict = field(default_factory=dict)  # stem -> class of evidence, from 1
    emission: np.ndarray = field(default_factory=lambda: np.zeros((1, 2)))  # log weights: class, state
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    transition: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(4))
    prior: float = 0.0
    fitted: bool = False


def token_class(word: str, evidence: dict) -> int:
    return max((evidence.get(s, 0) for s in stems(word)), default=0)


def pick_stems(docs: list[list[str]], toxic: np.ndarray) -> dict:
    """Stems whose odds hold in both halves of the sample, with their class of evidence (1 to 4)."""
    counts = [[Counter(), Counter()], [Counter(), Counter()]]
    size = np.zeros((2, 2))
    for k, (words, y) in enumerate(zip(docs, toxic)):
        size[k % 2][int(y)] += 1
        if y:
            counts[k % 2][1].update({s for w in set(words) for s in stems(w)})
    # Of clean documents only the stems that may be picked are counted.
    may = {s for s, n in counts[0][1].items() if n >= LEAST_DOCS and counts[1][1][s] >= LEAST_DOCS}
    for k, (words, y) in enumerate(zip(docs, toxic)):
        if not y:
            counts[k % 2][0].update({s for w in set(words) for s in stems(w)} & may)
    commonest: Counter = Counter()
    for word in {w for words, y in zip(docs, toxic) if y for w in words}:
        for s in stems(word)[1:]:
            if s in may:
                commonest[s] = max(commonest[s], counts[0][1][word] + counts[1][1][word])
    found = {}
    for s in sorted(may):
        n = counts[0][1][s]
        if commonest[s] > MOST_ONE_WORD * (n + counts[1][1][s]):
            continue
        odds = min((counts[h][1][s] + 0.5) / (size[h][1] + 1) / ((counts[h][0][s] + 0.5) / (size[h][0] + 1)) for h in (0, 1))
        if odds >= LEAST_ODDS:
            found[s] = 1 + int(np.clip(np.log(odds / LEAST_ODDS) / np.log(3), 0, 3))
    return found


def scaled(plain: np.ndarray) -> np.ndarray:
    """The matrix over its larger eigenvalue, so that none of its powers vanishes."""
    spread = math.sqrt((plain[0, 0] - plain[1, 1]) ** 2 + 4 * plain[0, 1] * plain[1, 0])
    return plain / ((plain[0, 0] + plain[1, 1] + spread) / 2)


def pass_over(model: Model, classes: np.ndarray, gaps: np.ndarray, tail: int) -> np.ndarray:
    """P(toxic) of each token with evidence; gaps: tokens without evidence before each, tail: after the last."""
    n = len(classes)
    t = np.exp(model.transition)
    plain = scaled(t * np.exp(model.emission[0])[None, :])  # one step into a token without evidence
    powers = {}

    def power(g: int) -> np.ndarray:
        if g not in powers:
            powers[g] = np.linalg.matrix_power(plain, g)
        return powers[g]

    emit = np.exp(model.emission[classes])
    forward, a = np.empty((n, 2)), np.exp(model.start)
    for i in range(n):
        g = int(gaps[i])
        if i == 0 and g == 0:
            a = a * emit[i]
        elif i == 0:
            a = ((a * np.exp(model.emission[0])) @ power(g - 1) @ t) * emit[i]
        else:
            a = (a @ power(g) @ t) * emit[i]
        a = a / a.sum()
        forward[i] = a
    backward, b = np.empty((n, 2)), power(tail).sum(axis=1)
    for i in range(n - 1, -1, -1):
        backward[i] = b / b.sum()
        b = power(int(gaps[i])) @ (t @ (emit[i] * backward[i]))
    p = forward * backward
    return p[:, 1] / p.sum(axis=1)


def compress(classes: np.ndarray, at: np.ndarray, n_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """A token sequence as its first token and its tokens with evidence: their classes, and the tokens without
    evidence after each of them (up to the next one, or to the end)."""
    if not len(at) or at[0] > 0:
        classes, at = np.concatenate(([0], classes)), np.concatenate(([0], at))
    return classes.astype(np.int8), np.diff(np.concatenate((at, [n_tokens]))) - 1


def gap_powers(plain: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """plain ** g for each gap g, and its derivatives by the logarithm of each entry of ``plain``, by squaring."""
    base, slope = plain, np.zeros((2, 2, 2, 2))
    for i in (0, 1):
        for j in (0, 1):
            slope[i, j, i, j] = plain[i, j]
    power, change = np.tile(np.eye(2), (len(gaps), 1, 1)), np.zeros((len(gaps), 2, 2, 2, 2))
    for bit in range(int(gaps.max(initial=0)).bit_length()):
        on = (gaps >> bit & 1).astype(bool)
        change[on] = change[on] @ base + power[on][:, None, None] @ slope
        power[on] = power[on] @ base
        slope = slope @ base + base @ slope
        base = base @ base
    return power, change


def batches_of(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of sequences, longest first, that fill at most FIT_ITEMS places (or hold one sequence)."""
    first = 0
    while first < len(lengths):
        last = min(len(lengths), first + max(1, FIT_ITEMS // int(lengths[first])))
        yield first, last
        first = last


def fit_field(model: Model, sequences: list[tuple[np.ndarray, np.ndarray]], toxic: list[bool], steps: int = 60) -> None:
    """Gradient ascent on the likelihood of the labelled tokens of whole texts.

    A sequence is what ``compress`` returns; tokens with evidence are toxic in toxic documents, all others are
    clean.  Expectations over a gap come from the derivatives of the power that stands for it.
    """
    order = np.argsort([-len(s[0]) for s in sequences], kind="stable")
    length = np.array([len(sequences[i][0]) for i in order])
    k, classes = len(sequences), len(model.emission)
    gaps, place = np.unique(np.concatenate([sequences[i][1] for i in order]), return_inverse=True)
    ends = np.cumsum(length)
    parts = []
    seen_e, seen_t, seen_s = np.zeros((classes, 2)), np.zeros((2, 2)), np.zeros(2)
    for first, last in batches_of(length):
        own = length[first:last]
        x, g, y = (np.zeros((int(own[0]), last - first), kind) for kind in (np.int8, np.int32, np.int8))
        for j, i in enumerate(order[first:last]):
            x[: own[j], j] = sequences[i][0]
            g[: own[j], j] = place[ends[first + j] - own[j] : ends[first + j]]
            y[: own[j], j] = (sequences[i][0] > 0) * int(toxic[i])
        alive = np.searchsorted(-own, -np.arange(1, int(own[0]) + 1), "right")
        live = np.arange(last - first) < alive[:, None]
        parts.append((x, g, alive, live))
        np.add.at(seen_e, (x[live], y[live]), 1)
        seen_s += np.bincount(y[0], minlength=2)
        gap = gaps[g]
        seen_e[0, 0] += gap[live].sum()
        seen_t[0, 0] += np.maximum(gap[live] - 1, 0).sum()
        np.add.at(seen_t, (y[live & (gap > 0)], 0), 1)
        then = live[1:]
        np.add.at(seen_t, (np.where(gap > 0, 0, y)[:-1][then], y[1:][then]), 1)
    scale_e = seen_e.sum(axis=1, keepdims=True) + 10
    scale_t = seen_t.sum(axis=1, keepdims=True) + 10
    for turn in range(steps):
        rate = 0.5 / (1 + turn / 20)
        emit, t = np.exp(model.emission), np.exp(model.transition)
        power, change = gap_powers(scaled(t * emit[0][None, :]), gaps)
        want_e, want_t, want_s = np.zeros((classes, 2)), np.zeros((2, 2)), np.zeros(2)
        for x, g, alive, live in parts:
            most = len(x)
            forward, backward = np.ones((*x.shape, 2)), np.ones((*x.shape, 2))
            a = np.exp(model.start)[None, :] * emit[x[0]]
            forward[0] = a / a.sum(axis=1, keepdims=True)
            for i in range(1, most):
                m = alive[i]
                over = (forward[i - 1, :m, None, :] @ power[g[i - 1, :m]])[:, 0]
                a = (over @ t) * emit[x[i, :m]]
                forward[i, :m] = a / a.sum(axis=1, keepdims=True)
            # What follows a token's gap: the next token, or nothing
            after = np.ones((*x.shape, 2))
            for i in range(most - 1, -1, -1):
                m = alive[i]
                if i + 1 < most:
                    n = alive[i + 1]
                    b = (emit[x[i + 1, :n]] * backward[i + 1, :n]) @ t.T
                    after[i, :n] = b / b.sum(axis=1, keepdims=True)
                b = (power[g[i, :m]] @ after[i, :m, :, None])[:, :, 0]
                backward[i, :m] = b / b.sum(axis=1, keepdims=True)
            p = forward * backward
            p /= p.sum(axis=2, keepdims=True)
            want_s += p[0].sum(axis=0)
            for s in (0, 1):
                want_e[:, s] += np.bincount(x[live], p[..., s][live], classes)
            f, r, at = forward[live], after[live], g[live]
            for c in range(0, len(f), 50_000):
                fc, rc, ac = f[c : c + 50_000], r[c : c + 50_000], at[c : c + 50_000]
                whole = np.einsum("ni,nij,nj->n", fc, power[ac], rc)
                inside = np.einsum("na,nijab,nb->nij", fc, change[ac], rc) / whole[:, None, None]
                want_t += inside.sum(axis=0)
                want_e[0] += inside.sum(axis=(0, 1))
            # The step from a gap to the token after it
            then = live[1:]
            if then.any():
                over = (forward[:-1][then][:, None, :] @ power[g[:-1][then]])[:, 0]
                right = emit[x[1:][then]] * backward[1:][then]
                pair = over[:, :, None] * t[None] * right[:, None, :]
                want_t += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        model.emission += rate * ((seen_e - want_e) / scale_e * 2 - 0.02 * model.emission)
        model.transition += rate * ((seen_t - want_t) / scale_t * 2 - 0.02 * model.transition)
        model.start += rate * ((seen_s - want_s) / k - 0.02 * model.start)
        for weights in (model.emission, model.transition, model.start):
            np.clip(weights, -8, 8, out=weights)


def summary(p: np.ndarray, n_tokens: int) -> np.ndarray:
    """Features of a document: constant, log odds that some token is toxic, expected toxic tokens, their density."""
    some = 1 - np.exp(np.log1p(-np.minimum(p, 1 - 1e-9)).sum()) if len(p) else 0.0
    return np.array([1.0, some, np.log1p(p.sum()), np.sqrt(p.sum() / max(n_tokens, 1))])


def evidence_of(words: list[str], evidence: dict, cache: dict) -> tuple[np.ndarray, np.ndarray]:
    """Places and classes of the tokens with evidence."""
    at, classes = [], []
    for i, w in enumerate(words):
        c = cache.get(w)
        if c is None:
            c = cache[w] = token_class(w.lower(), evidence)
        if c:
            at.append(i)
            classes.append(c)
    return np.array(at, np.int64), np.array(classes, np.int64)


def marginals(model: Model, words: list[str], cache: dict) -> tuple[np.ndarray, np.ndarray]:
    at, classes = evidence_of(words, model.evidence, cache)
    if not len(at):
        return at, np.zeros(0)
    gaps = np.diff(np.concatenate(([-1], at))) - 1
    return at, pass_over(model, classes, gaps, len(words) - 1 - int(at[-1]))


def fit(texts: list[str], toxic: np.ndarray, share: float) -> Model:
    """Fit on a sample of texts; share: of toxic among all labels that may be learned from."""
    model = Model(prior=float(share))
    if not len(toxic) or toxic.all() or not toxic.any():
        return model
    pool: dict[str, str] = {}  # one object for each distinct word
    docs = [[pool.setdefault(w, w) for w in map(str.lower, _TOKEN.findall(t or ""))] for t in texts]
    model.evidence = pick_stems(docs, toxic)
    cache: dict = {}
    sequences, truth = [], []
    for words, y in zip(docs, toxic):
        if not words:
            continue
        at, found = evidence_of(words, model.evidence, cache)
        sequences.append(compress(found, at, len(words)))
        truth.append(bool(y))
    top = 1 + max(model.evidence.values(), default=0)
    model.emission, model.start, model.transition = np.zeros((top, 2)), np.zeros(2), np.zeros((2, 2))
    if sequences:
        fit_field(model, sequences, truth)
    x = np.array([summary(marginals(model, w, cache)[1], len(w)) for w in docs])
    y = toxic.astype(float)
    weigh = np.where(toxic, share / toxic.mean(), (1 - share) / (1 - toxic.mean()))
    weights = np.zeros(x.shape[1])
    for _ in range(30):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (weigh * (y - p)) - 1e-2 * weights
        hessian = (x * (weigh * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        weights = weights + np.clip(np.linalg.solve(hessian, gradient), -4, 4)
    model.weights, model.fitted = weights, True
    return model


def score_text(model: Model, text: str | None, cache: dict) -> tuple[float, list[tuple[int, int, float]]]:
    """The score and the offending spans (code points, end exclusive, greatest marginal in the span)."""
    if not model.fitted:
        return model.prior, []
    text = text or ""
    words = _TOKEN.findall(text)  # lower-cased one by one, as lower-casing a text may move offsets
    at, p = marginals(model, words, cache)
    value = float(1 / (1 + np.exp(-np.clip(summary(p, len(words)) @ model.weights, -30, 30))))
    spans: list = []
    hot = {int(i): float(q) for i, q in zip(at, p) if q >= 0.5}
    if hot:
        last = None
        for i, m in enumerate(_TOKEN.finditer(text)):
            if i in hot:
                if last == i - 1:
                    spans[-1] = (spans[-1][0], m.end(), max(spans[-1][2], hot[i]))
                else:
                    spans.append((m.start(), m.end(), hot[i]))
                last = i
    return value, spans


def learnable(df: DataFrame) -> DataFrame:
    return df.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0)


def train(documents: DataFrame, labels: DataFrame) -> Model:
    """Fit the model on the bounded sample; only rows that may be learned from are looked at."""
    known = learnable(labels.where("doc_id is not null and toxic is not null")).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    sizes = {bool(r["toxic"]): r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    picked = None
    for kind in (True, False):
        first = known.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(FIT_PER_CLASS)
        picked = first if picked is None else picked.unionByName(first)
    # At most 2 * FIT_PER_CLASS ids: a bound that holds at every size
    texts = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    rows = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"] * 2654435761) % (1 << 32))
    total = sum(sizes.values())
    return fit([r["text"] for r in rows], np.array([r["toxic"] for r in rows], bool), sizes.get(True, 0) / total if total else 0.0)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, spans (start, end, marginal) of each document; a document stays in its partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, cache = model, {}
        for batch in batches:
            done = []
            for text in batch["text"]:
                if len(cache) > 500_000:
                    cache.clear()
                done.append(score_text(own, text if isinstance(text, str) else None, cache))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": [d[0] for d in done], "spans": [[{"start": a, "end": b, "marginal": q} for a, b, q in d[1]] for d in done]})

    scored = gathered(documents).select(id_text(), "text").mapInPandas(run, "doc_id string, score double, spans array<struct<start:int,end:int,marginal:double>>")
    return scored.withColumn("doc_id", F.col("doc_id").cast("long"))
