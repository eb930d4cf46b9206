"""Toxic spans by a linear-chain conditional random field.

Document labels are turned into token labels: a token of a toxic document is toxic if one of its features (the word, its
beginnings and endings) occurs far more often in toxic documents than in others. A two-state chain with those features is
fitted to the labelled tokens; forward-backward marginals tag every token of every text and add up to the document's score."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import fresh, widen

TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}']+")
#: Buckets of hashed features; most words whose scores a task remembers.
BUCKETS, REMEMBERED = 1 << 17, 400_000


@dataclass(frozen=True)
class Fit:
    """The classifier is fitted on at most ``docs`` labelled documents of each label (those of lowest hash of the id), none
    longer than ``chars`` characters. A token's feature marks toxicity if at least ``least`` sampled toxic documents have it
    and its share among toxic documents is over ``odds`` times that among others."""

    docs: int = 1500
    chars: int = 20_000
    least: int = 5
    odds: float = 8.0
    rounds: int = 40
    decay: float = 1e-5


def features(word: str) -> list[int]:
    names = [f"w{word}", f"s{word[-4:]}", *(f"p{word[:k]}" for k in (4, 5, 6, 7)), f"n{min(len(word), 12)}"]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % (BUCKETS - 1) for x in names] + [BUCKETS - 1]


class Ragged:
    """Sequences laid out by time: at each step the sequences that are that long, longest first, are contiguous."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        n = lengths[self.order]
        steps = int(n[0]) if len(n) else 0
        self.active = np.searchsorted(-n, -np.arange(steps), "left") if steps else np.zeros(0, np.int64)
        self.start = np.cumsum(self.active) - self.active
        rank = np.empty(len(n), np.int64)
        rank[self.order] = np.arange(len(n))
        owner = np.repeat(np.arange(len(lengths)), lengths)
        time = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.place = self.start[time] + rank[owner] if steps else time  # of each token in reading order


def marginals(emission: np.ndarray, lengths: np.ndarray, moves: np.ndarray, pairs: bool = False):
    """P(token is toxic) for tokens in reading order. ``moves``: log weights [[OO, OT], [TO, TT]]; a chain starts after O.

    With two states each message is one number, the odds of T against O, so a step for all sequences is a few array
    operations. ``pairs`` also returns the expected transitions (for fitting)."""
    lay = Ragged(lengths)
    oo, ot, to, tt = np.exp(moves.ravel())
    e = np.exp(np.clip(emission, -60, 60))
    grid = np.empty(len(e))
    grid[lay.place] = e
    ahead, behind = np.empty(len(e)), np.ones(len(e))
    last = None
    for a, n in zip(lay.start.tolist(), lay.active.tolist(), strict=True):
        if last is None:
            ahead[a : a + n] = grid[a : a + n] * (ot / oo)
        else:
            r = ahead[last : last + n]
            ahead[a : a + n] = grid[a : a + n] * (r * tt + ot) / (r * to + oo)
        last = a
    for t in range(len(lay.start) - 2, -1, -1):
        a, b, n = lay.start[t], lay.start[t + 1], lay.active[t + 1]
        s = grid[b : b + n] * behind[b : b + n]
        behind[a : a + n] = (tt * s + to) / (ot * s + oo)
    odds = ahead * behind
    p = (odds / (1 + odds))[lay.place]
    if not pairs:
        return p
    expected = np.zeros((2, 2))
    for t in range(len(lay.start)):
        a, n = lay.start[t], lay.active[t]
        r = ahead[lay.start[t - 1] :][:n] if t else np.zeros(n)
        s = grid[a : a + n] * behind[a : a + n]
        w = np.array([np.full(n, oo), ot * s, to * r, tt * r * s])
        total = w.sum(0)
        expected += (w / total).sum(1).reshape(2, 2)
    return p, expected


@dataclass
class Model:
    weights: np.ndarray
    moves: np.ndarray
    scale: np.ndarray

    def word(self, word: str) -> float:
        return float(self.weights[features(word)].sum())


def _evidence(p: np.ndarray, owner: np.ndarray, docs: int) -> np.ndarray:
    """Per document: a constant, the log odds of its likeliest toxic token, and the log of the expected number of toxic tokens
    among those that are not negligible (so that a long text is not toxic by its length)."""
    best = np.full(docs, 1e-5)
    np.maximum.at(best, owner, np.minimum(p, 1 - 1e-5))
    return np.c_[np.ones(docs), np.log(best / (1 - best)), np.log1p(np.bincount(owner, np.where(p > 0.1, p, 0.0), docs))]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted logistic regression with a ridge on all but the constant, by Newton's steps that are halved until they gain."""
    keep = ridge * np.r_[0.0, np.ones(x.shape[1] - 1)]
    loss = lambda w: float((weight * np.logaddexp(0.0, np.where(y == 1, -1.0, 1.0) * (x @ w))).sum() + (keep * w * w).sum() / 2)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * q * (1 - q))[:, None]).T @ x + np.diag(keep + 1e-6)
        step, before = np.linalg.solve(h, x.T @ (weight * (y - q)) - keep * w), loss(w)
        while loss(w + step) > before and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(texts: list[str], toxic: list[int], priors: tuple[int, int] = (1, 1), fit: Fit = Fit()) -> Model:
    """From labelled texts; ``priors``: how many documents of label 0 and 1 the sample stands for. With only one label, or
    none, the model is a constant."""
    y = np.array(toxic, np.int64)
    n0, n1 = int((y == 0).sum()), int((y == 1).sum())
    constant = math.log((priors[1] + 0.5) / (priors[0] + 0.5)) if sum(priors) else -3.0
    model = Model(np.zeros(BUCKETS), np.log(np.array([[0.98, 0.02], [0.6, 0.4]])), np.array([constant, 0.0, 0.0]))
    if not n0 or not n1:
        return model
    ids: dict[str, int] = {}
    seqs = [np.array([ids.setdefault(w, len(ids)) for w in TOKEN.findall(t.lower())], np.int64) for t in texts]
    table = np.array([features(w) for w in ids], np.int64).reshape(-1, len(features("")))
    seen = {0: Counter(), 1: Counter()}
    for s, label in zip(seqs, y.tolist(), strict=True):
        seen[label].update(np.unique(table[np.unique(s)][:, :-2]).tolist())
    marks = np.zeros(BUCKETS, bool)
    for f, n in seen[1].items():
        marks[f] = n >= fit.least and n / n1 > fit.odds * (seen[0][f] + 1) / n0
    marked = marks[table[:, :-2]].any(1)
    lengths = np.array([len(s) for s in seqs])
    words = np.concatenate(seqs)
    owner = np.repeat(np.arange(len(seqs)), lengths)
    truth = (marked[words] & (y[owner] == 1)).astype(float)
    # observed transitions, chains starting after O
    prior = np.r_[0.0, truth[:-1]] if len(truth) else truth
    prior[(np.cumsum(lengths) - lengths)[lengths > 0]] = 0.0
    observed = np.array([[((1 - prior) * (1 - truth)).sum(), ((1 - prior) * truth).sum()], [(prior * (1 - truth)).sum(), (prior * truth).sum()]])
    base = np.bincount(words, truth, len(ids))
    total = max(1, len(words))
    m, v = [np.zeros(BUCKETS), np.zeros((2, 2))], [np.zeros(BUCKETS), np.zeros((2, 2))]
    for step in range(1, fit.rounds + 1):  # Adam on the mean log-likelihood
        p, expected = marginals(model.weights[table].sum(1)[words], lengths, model.moves, True)
        per_word = (base - np.bincount(words, p, len(ids))) / total
        grads = (np.bincount(table.ravel(), np.repeat(per_word, table.shape[1]), BUCKETS) - fit.decay * model.weights, (observed - expected) / total - fit.decay * model.moves)
        for i, (x, g) in enumerate(((model.weights, grads[0]), (model.moves, grads[1]))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.98 * v[i] + 0.02 * g * g
            x += (0.25, 0.1)[i] * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.98**step)) + 1e-7)
    p = marginals(model.weights[table].sum(1)[words], lengths, model.moves)
    x = _evidence(p, owner, len(seqs))
    weight = np.where(y == 1, priors[1] / n1, priors[0] / n0)
    model.scale = _logistic(x, y, weight / weight.sum() * len(y))
    return model


class Scorer:
    """One task's view of a model."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def _emission(self, word: str) -> float:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        e = self.known[word] = self.model.word(word)
        return e

    def marginals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        known, new = self.known, self._emission
        emission, lengths = [], []
        for t in texts:
            words = TOKEN.findall(t.lower())
            lengths.append(len(words))
            emission += [e if (e := known.get(w)) is not None else new(w) for w in words]
        n = np.array(lengths, np.int64)
        return marginals(np.array(emission, float), n, self.model.moves), n

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, n = self.marginals(texts)
        z = _evidence(p, np.repeat(np.arange(len(texts)), n), len(texts)) @ self.model.scale
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), p, n

    def spans(self, text: str, p: np.ndarray) -> list[dict]:
        """Runs of tokens that are likelier toxic than not, as offsets in characters of the text."""
        out: list[dict] = []
        low = text.lower()
        where = [m.span() for m in TOKEN.finditer(low)]
        if len(low) != len(text):  # a few letters are longer in lower case
            origin = [i for i, c in enumerate(text) for _ in c.lower()]
            where = [(origin[a], origin[b - 1] + 1) for a, b in where]
        before = -2
        for i in np.flatnonzero(p >= 0.5).tolist():
            if i == before + 1:
                out[-1]["end"] = where[i][1]
            else:
                out.append({"start": where[i][0], "end": where[i][1]})
            before = i
        return out


TAGS = "struct<score: double, predicted: int, spans: array<struct<start: int, end: int>>>"


def tag(docs: DataFrame, model: Model) -> tuple[DataFrame, str]:
    """``docs`` (text and any others) with a struct column, whose name is returned too: score, predicted (1 if the score is
    0.5 or more) and spans, the offsets of toxic passages. Null and empty texts have no spans and the score that no evidence
    gives. Only the text is an input."""
    shared, name = docs.sparkSession.sparkContext.broadcast(model), fresh(docs.columns, "toxicity")

    def factory():
        own = Scorer(shared.value)

        def run(texts: list[str]) -> list[dict]:
            score, p, n = own.score(texts)
            ends = np.cumsum(n)
            hot = np.zeros(len(texts), bool)
            hot[np.repeat(np.arange(len(texts)), n)[p >= 0.5]] = True
            spans = [own.spans(t, p[e - k : e]) if h else [] for t, e, k, h in zip(texts, ends.tolist(), n.tolist(), hot.tolist(), strict=True)]
            return [{"score": s, "predicted": int(s >= 0.5), "spans": x} for s, x in zip(score.tolist(), spans, strict=True)]

        return run

    return widen(docs, name, TAGS, factory, 6 << 20), name


def remainder(doc_id: str = "doc_id"):
    """crc32 of the id as text, mod 5; 0 is held out and never learnt from."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5))


def learn(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic) without the held-out rows. The sample is chosen
    among labels alone, so its ids, twice ``fit.docs`` at most, may be broadcast to the documents, whose texts are read once
    and of which only the sampled ones move, one for each id. Null labels are no labels; of several for one id the greatest counts."""
    label = labels.where("toxic is not null and doc_id is not null").where(remainder() != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r["count"] for r in label.groupBy("toxic").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = label.where("toxic = 0").orderBy(*order).limit(fit.docs).unionByName(label.where("toxic = 1").orderBy(*order).limit(fit.docs))
    few = docs.sparkSession.createDataFrame(chosen.collect(), label.schema)
    rows = docs.select("doc_id", "text").where(F.length("text") <= fit.chars).join(F.broadcast(few), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.text))
    return train([r.text for r in rows], [r.toxic for r in rows], (counts.get(0, 0), counts.get(1, 0)), fit)


def toxicity_filter(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with its columns."""
    tagged, name = tag(docs, learn(docs, labels, fit))
    return tagged.where(F.col(name)["predicted"] == 0).drop(name)
