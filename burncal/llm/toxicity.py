"""Toxicity: a linear-chain conditional random field tags toxic spans; its marginals give document scores and offsets.

1. Labelled tokens. From a bounded sample of labelled documents (about MAX_LABELLED, by the hash of the id; never a held-out one)
   Spark counts in how many toxic and other documents each word and each word beginning occurs. Those with a strong positive
   association (likelihood ratio) are seeds: a token with a seed in a toxic document is labelled toxic, all other tokens are not. The seeds
   label, they are no features, and none is left out for being rare.
2. The CRF has two states, other and toxic. Its features are hashed: the word, its beginnings and endings, its shape, the word before and
   the word after; with them a bias and transitions. It is fitted by its exact gradient, observed minus expected counts from the
   forward-backward pass, on at most about MAX_WINDOWS windows of labelled tokens, until the gradient is small.
3. Every whole text is scored: forward-backward over all its tokens, whatever their words. The tokens of a batch are cut into blocks that
   run side by side, each with so many tokens before and after it that what lies further off can't change a marginal by more than 1e-12
   (each step of a chain contracts by a known factor), so the marginals are those of the full chain.
4. The two largest marginals, the expected number of toxic tokens and the number of all tokens (one token of many can be chance),
   calibrated by logistic regression, are the document's score. Tokens with
   a marginal of at least 0.5 are its offending offsets; a document whose score is 0.5 or more without such a token names the one
   with the largest marginal (the first of equals), on which its score rests.

Cases: null and empty texts have no tokens and get the lowest score; without toxic and other labels, or without a seed, every score is
the share of toxic labels (0.5 without labels) and there are no offsets; very long texts are scored whole; equal texts get equal scores;
repeated rows each get a row, and repeated label rows count each; labels that are null or not 0/1 are not learnt from; further columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burncal.llm.common import cut, held_out, id_and_text, map_batches, sampled_copies, smallest_hashes, texts

WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS, ENDINGS = (4, 5, 6), (3, 4)
OWN = 2 + len(BEGINNINGS) + len(ENDINGS)
PER_TOKEN = OWN + 2
HASH_BITS = 18
MAX_LABELLED = 10_000
MAX_WINDOWS = 12_000
MIN_DOCUMENTS = 3
MIN_RATIO = 20.0
HALF = 8
WIDTH = 2 * HALF + 1
CACHE = 500_000
BLOCK = 256


def beginnings(word: str) -> list[str]:
    """What can be a seed: the word and its beginnings."""
    return ["=" + word, *(word[:k] for k in BEGINNINGS if len(word) >= k)]


#: An odd factor for each feature of a token, which deals the checksums of its parts anew.
_FACTORS = np.random.RandomState(17).randint(1 << 30, 1 << 31, PER_TOKEN).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _crc(part: str) -> int:
    return zlib.crc32(part.encode("utf-8", "surrogatepass"))


def _shape(token: str) -> int:
    case = 0 if token.islower() else 1 if token.isupper() else 2 if token.istitle() else 3
    return (case * 2 + (not token.isascii())) * 16 + min(len(token), 12)


def features(tokens: list[str]) -> np.ndarray:
    """Hashed features [n, PER_TOKEN] of tokens: OWN of their own (0: none), that is the word, its shape, beginnings and endings; then what each
    is to its neighbours, the word before and the word after."""
    low = [t.lower() for t in tokens]
    whole = list(map(_crc, low))
    parts = [whole, list(map(_shape, tokens)), *([_crc(w[:k]) if len(w) >= k else -1 for w in low] for k in BEGINNINGS), *([_crc(w[-k:]) if len(w) >= k else -1 for w in low] for k in ENDINGS), whole, whole]
    codes = np.array(parts, np.int64).reshape(PER_TOKEN, -1).T
    mixed = ((codes.astype(np.uint64) + np.uint64(1)) * _FACTORS) >> np.uint64(20)
    mixed = (mixed ^ (mixed >> np.uint64(17))) % np.uint64((1 << HASH_BITS) - 1)
    return np.where(codes < 0, 0, mixed.astype(np.int64) + 1)


@dataclass
class Model:
    weights: np.ndarray  # of hashed features; weights[0] is 0
    bias: float
    transitions: np.ndarray  # log potentials [from, to]; state 1 is toxic
    calibration: np.ndarray  # of 1 and the evidence
    constant: float | None = None  # the score of all, if nothing can be learnt
    seeds: list[str] = field(default_factory=list)


def likelihood_ratio(a: Column, b: Column, n1: int, n0: int) -> Column:
    """G2 of the two-by-two table of a of n1 toxic and b of n0 other documents that have a feature."""
    have, total = a + b, float(n1 + n0)

    def cell(observed: Column, of: int, column: Column) -> Column:
        return F.when(observed > 0, observed * F.log(observed * total / (F.lit(float(of)) * column))).otherwise(0.0)

    return 2 * (cell(a, n1, have) + cell(b, n0, have) + cell(n1 - a, n1, total - have) + cell(n0 - b, n0, total - have))


def _labelled(docs: DataFrame, labels: DataFrame, label_col: str) -> DataFrame:
    """doc_id, text, label of about MAX_LABELLED rows at most; the chosen labels are a bounded side to broadcast."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    chosen = smallest_hashes(known.filter(F.col("label").isin(0, 1) & ~held_out()), MAX_LABELLED, "doc_id")
    return docs.join(F.broadcast(chosen), "doc_id")


def mine_seeds(labelled: DataFrame) -> tuple[set[str], int, int]:
    """The seeds, and the numbers of toxic and other documents."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        pos, neg = Counter(), Counter()
        for text, label in zip(texts(batch), batch.column("label").to_pylist()):
            seen = {f for w in set(WORD.findall(text.lower())) for f in beginnings(w)}
            (pos if label else neg).update(seen)
        names = list(pos | neg)
        return pa.record_batch([pa.array(names, pa.string()), pa.array([pos[x] for x in names], pa.int64()), pa.array([neg[x] for x in names], pa.int64())], ["feature", "pos", "neg"])

    sizes = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return set(), n1, n0
    counts = map_batches(labelled.select("text", "label"), count, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    a, b = F.col("pos").cast("double"), F.col("neg").cast("double")
    strong = counts.filter((a >= MIN_DOCUMENTS) & (a * n0 > 5 * b * n1) & (likelihood_ratio(a, b, n1, n0) >= MIN_RATIO))
    return {r.feature for r in strong.select("feature").collect()}, n1, n0  # all of a bounded sample


def windows(labelled: DataFrame, seeds: set[str]) -> list[tuple[list[str], list[int]]]:
    """Training windows (tokens, labels): around the seeds of all documents, and the middle of those without one."""

    def is_seed(token: str) -> bool:
        return any(f in seeds for f in beginnings(token.lower()))

    def cut_out(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows, marks = [], []
        for text, label in zip(texts(batch), batch.column("label").to_pylist()):
            tokens = WORD.findall(text)
            hits, free = [i for i, t in enumerate(tokens) if is_seed(t)] or [len(tokens) // 2], -1
            for at in hits:
                if at > free and tokens:
                    part = tokens[max(0, at - HALF) : at + HALF + 1]
                    rows.append(part)
                    marks.append([int(bool(label) and is_seed(t)) for t in part])
                    free = at + HALF
        return pa.record_batch([pa.array(rows, pa.list_(pa.string())), pa.array(marks, pa.list_(pa.int32()))], ["tokens", "marks"])

    found = map_batches(labelled.select("text", "label"), cut_out, "tokens array<string>, marks array<int>")
    found = sorted(((r.tokens, r.marks, r.copies) for r in sampled_copies(cut(found), MAX_WINDOWS).collect()))  # not the order of tasks
    return [(tokens, marks) for tokens, marks, copies in found for _ in range(copies)]


def arrays(rows: list[tuple[list[str], list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features [n, WIDTH, PER_TOKEN], labels [n, WIDTH], and which tokens exist."""
    names = sorted({t for tokens, _ in rows for t in tokens})
    known, table = dict(zip(names, range(len(names)))), features(names)
    x, y = np.zeros((len(rows), WIDTH, PER_TOKEN), np.int64), np.zeros((len(rows), WIDTH), np.int64)
    there = np.zeros((len(rows), WIDTH), bool)
    for i, (tokens, marks) in enumerate(rows):
        own = table[[known[t] for t in tokens]]
        x[i, : len(own), :OWN] = own[:, :OWN]
        x[i, 1 : len(own), OWN], x[i, : len(own) - 1, OWN + 1] = own[:-1, OWN], own[1:, OWN + 1]
        y[i, : len(own)], there[i, : len(own)] = marks, True
    return x, y, there


def chain_marginals(emission: np.ndarray, there: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward on padded chains: P(toxic) [n, t], and the summed pair marginals [2, 2]. emission: log potential of toxic."""
    n, t = emission.shape
    step, potential = np.exp(transitions), np.stack([np.ones_like(emission), np.exp(emission)], 2)
    forward = np.zeros((n, t, 2))
    forward[:, 0] = potential[:, 0] / potential[:, 0].sum(1, keepdims=True)
    for k in range(1, t):
        now = (forward[:, k - 1] @ step) * potential[:, k]
        forward[:, k] = np.where(there[:, k, None], now / now.sum(1, keepdims=True), forward[:, k - 1])
    backward, pairs = np.ones((n, t, 2)), np.zeros((2, 2))
    for k in range(t - 2, -1, -1):
        on = there[:, k + 1]
        ahead = potential[:, k + 1] * backward[:, k + 1]
        now = ahead @ step.T
        backward[:, k] = np.where(on[:, None], now / now.sum(1, keepdims=True), 1.0)
        joint = forward[:, k, :, None] * step * ahead[:, None, :]
        pairs += (joint / joint.sum((1, 2), keepdims=True))[on].sum(0)
    both = forward * backward
    return both[:, :, 1] / both.sum(2), pairs


def fit_chain(x: np.ndarray, y: np.ndarray, there: np.ndarray, steps: int = 60, rate: float = 0.1, l2: float = 0.05, enough: float = 1e-3) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and transitions by Adam on the exact gradient of the penalized conditional likelihood, until no part of the gradient
    is over `enough` of the windows."""
    used, flat = np.unique(np.append(0, x), return_inverse=True)  # only features that occur have weights
    flat = flat.ravel()[1:]
    x, size = flat.reshape(x.shape), len(used)
    theta = np.zeros(size + 1 + 4)  # weights, bias, transitions
    theta[size] = -3.0
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    follows, seen = there[:, 1:], np.zeros((2, 2))
    np.add.at(seen, (y[:, :-1][follows], y[:, 1:][follows]), 1)
    for k in range(1, steps + 1):
        p, pairs = chain_marginals(np.clip(theta[:size][x].sum(2) + theta[size], -40, 40), there, theta[size + 1 :].reshape(2, 2))
        off = np.where(there, y - p, 0.0)
        gradient = np.concatenate([np.bincount(flat, np.repeat(off.ravel(), PER_TOKEN), size), [off.sum()], (seen - pairs).ravel()]) - l2 * theta
        gradient[0] = gradient[size + 1] = 0.0  # no weight for no feature; other-other is the reference
        if np.abs(gradient).max() <= enough * len(x):
            break
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        theta = theta + rate * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
    weights = np.zeros(1 << HASH_BITS)
    weights[used] = theta[:size]
    return weights, float(theta[size]), theta[size + 1 :].reshape(2, 2)


def reach(transitions: np.ndarray, error: float = 1e-12) -> int:
    """The number of steps after which a chain has forgotten where it came from, up to an error: each step contracts the distance (of log
    odds) between any two states of knowledge by the hyperbolic tangent of a quarter of the log of the cross ratio."""
    contraction = math.tanh(abs(transitions[0, 0] + transitions[1, 1] - transitions[0, 1] - transitions[1, 0]) / 4)
    return 1 if contraction <= error else math.ceil(math.log(error / 100) / math.log(min(contraction, 1 - 1e-6)))


def marginals(emission: np.ndarray, first: np.ndarray, transitions: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """P(toxic) of the tokens of some chains, one after the other; first: which tokens begin a chain. Blocks run side by side."""
    n = len(emission)
    if not n:
        return np.zeros(0)
    (a, b), (c, d) = np.exp(transitions)
    margin = reach(transitions)
    block = max(block, margin)
    weight = np.exp(np.clip(emission, -60, 60))
    last = np.append(first[1:], True)
    begins = np.arange(0, n, block)
    forward, backward = np.empty((block, len(begins))), np.empty((block, len(begins)))
    odds = np.ones(len(begins))
    for t in range(-margin, block):
        at = np.clip(begins + t, 0, n - 1)
        moved = (b + odds * d) / (a + odds * c)
        odds = weight[at] * np.where(first[at], 1.0, moved)
        if t >= 0:
            forward[t] = odds
    odds = np.ones(len(begins))
    for t in range(block + margin - 1, -1, -1):
        at = np.minimum(begins + t, n - 1)
        ahead = weight[np.minimum(at + 1, n - 1)] * odds
        odds = np.where(last[at], 1.0, (c + ahead * d) / (a + ahead * b))
        if t < block:
            backward[t] = odds
    both = (forward * backward).T.ravel()[:n]
    return both / (1 + both)


class Tagger:
    """Exact marginals of the model at every token of whole texts; keeps the weights of the tokens it has seen."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, 3))

    def _learn(self, tokens: set[str]) -> None:
        new = sorted(tokens - self.known.keys())
        if len(self.known) + len(new) > CACHE and self.known:
            self._forget()
            new = sorted(tokens)
        if new:
            w = self.model.weights[features(new)]
            self.known.update(zip(new, range(len(self.table), len(self.table) + len(new))))
            self.table = np.vstack([self.table, np.stack([w[:, :OWN].sum(1), w[:, OWN], w[:, OWN + 1]], 1)])

    def tag(self, batch: list[str]) -> list[np.ndarray]:
        """P(toxic) of the tokens of each text."""
        split = [WORD.findall(t) for t in batch]
        self._learn({t for own in split for t in own})
        sizes = np.array([len(own) for own in split], np.int64)
        ids = np.fromiter((self.known[t] for own in split for t in own), np.int64, int(sizes.sum()))
        first = np.zeros(len(ids) + 1, bool)
        stops = np.cumsum(sizes)
        first[stops - sizes] = True
        own = self.table[ids]
        emission = own[:, 0] + self.model.bias
        emission[1:] += np.where(first[1:-1], 0.0, own[:-1, 1])
        emission[:-1] += np.where(first[1:-1], 0.0, own[1:, 2])
        return np.split(marginals(np.clip(emission, -40, 40), first[:-1], self.model.transitions), stops[:-1])

    def evidence(self, p: np.ndarray) -> tuple[float, ...]:
        """What the score rests on: logits of the two largest marginals, log1p of the expected number of toxic tokens, and -log1p of that of
        all tokens."""
        two = np.append(np.partition(p, len(p) - 2)[-2:] if len(p) > 1 else p, [0.0, 0.0])
        logit = [max(-12.0, math.log(v / (1 - v))) if v > 0 else -12.0 for v in sorted(np.minimum(two, 1 - 1e-12).tolist())[:-3:-1]]
        return *logit, math.log1p(float(p.sum())), -math.log1p(len(p))

    def score(self, p: np.ndarray) -> float:
        if self.model.constant is not None:
            return self.model.constant
        z = self.model.calibration[0] + float(np.dot(self.model.calibration[1:], self.evidence(p)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of 1 and the columns of x, by Newton's method; the weights of columns are kept from being negative."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, penalty = np.zeros(x.shape[1]), l2 * np.diag([1e-6] + [1.0] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w[1:] = np.maximum(w[1:], 0.0)
    return w


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Model:
    labelled = cut(_labelled(id_and_text(docs, id_col, text_col), labels.withColumnRenamed(id_col, "doc_id"), label_col))  # one pass over the texts
    seeds, n1, n0 = mine_seeds(labelled)
    if not seeds:
        return Model(np.zeros(1 << HASH_BITS), 0.0, np.zeros((2, 2)), np.zeros(5), n1 / (n1 + n0) if n1 + n0 else 0.5)
    weights, bias, transitions = fit_chain(*arrays(windows(labelled, seeds)))
    model = Model(weights, bias, transitions, np.zeros(5), seeds=sorted(seeds))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def evidence(batch: pa.RecordBatch) -> pa.RecordBatch:
        tagger = Tagger(shared.value)
        rows = [tagger.evidence(p) for p in tagger.tag(texts(batch))]
        return pa.record_batch([batch.column("label"), pa.array(rows, pa.list_(pa.float64()))], ["label", "evidence"])

    known = map_batches(labelled.select("text", "label"), evidence, "label int, evidence array<double>").collect()  # MAX_LABELLED rows at most
    known = np.array(sorted((r.label, *r.evidence) for r in known), float)
    model.calibration = logistic(known[:, 1:], known[:, 0])
    return model


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, score, spans (code points and marginal of each offending token) for every row."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    taggers: list[Tagger] = []  # one for each task, for what it keeps of its words

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not taggers:
            taggers.append(Tagger(shared.value))
        tagger, scores, spans, own = taggers[0], [], [], texts(batch)
        for text, p in zip(own, tagger.tag(own)):
            score = tagger.score(p)
            scores.append(round(score, 6))
            bound = threshold if not len(p) or p.max() >= threshold or score < threshold else p.max()
            offending = set(np.flatnonzero(p >= bound).tolist()) if tagger.model.constant is None else set()
            if len(offending) > 1 and bound < threshold:
                offending = {min(offending)}
            spans.append([{"start": m.start(), "end": m.end(), "p": float(p[i])} for i, m in enumerate(WORD.finditer(text)) if i in offending] if offending else [])
        return pa.record_batch([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(spans, span)], ["doc_id", "score", "spans"])

    return map_batches(id_and_text(docs, id_col, text_col), per_batch, "doc_id long, score double, spans array<struct<start:long,end:long,p:double>>")
