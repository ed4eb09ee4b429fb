"""Secret scans: a character convolutional network over every candidate and its surrounding context.

Candidates are all runs of at least 12 token characters (letters, digits and + / _ = . @ : -) and all quoted values of at least 8
characters without white space, whether a rule finds them or not. The network (numpy) reads a candidate and CONTEXT characters on
both sides: character embeddings, convolutions of width 5, maxima over the candidate and over the whole window, one logit.

Labels are findings: a candidate that a fixed rule (assign, access, hex) touches is a secret; others are unlabelled. So that the
network judges the token and not only what the rule reads, each labelled secret is also learnt without its context, and in upper case. As rules
find few formats, MADE secrets of other formats and as many tokens that only look like secrets come from a generator (`made`), between
characters of the corpus and without them; one format is held out of it.
The unlabelled candidates are taken as no secrets in a first fit; those that look like secrets without their context then are left out of
the second one, but for words (letters of one case). There are two networks. Candidates, made ones too, are dealt to FOLDS by the crc32 of their own characters, a network learns from one half of the folds and
scores the other half, so none scores a token, or a copy of it, that it has learnt from. Within its half, three fifths are fitted and one fifth calibrates the
logit (logistic regression). Both networks' calibrated probabilities of these fifths together set a threshold for each kind of finding, and one for the made
formats: the highest that recalls RECALL of the secrets, so that a probability means the same in both. The last fifth is never used by any of this and
measures the recall (`Scorer.report`).

A candidate becomes a span of kind `cnn`, its own characters without the rule's keyword, if its probability reaches the threshold of the
rule that touches it. Where no rule does, the greater of the probabilities with and without context has to reach the
threshold of the made formats. Base spans always stay, with the highest
probability of the candidates in them; a base span without any has none.

One pass over the texts finds the candidates with their windows. A start is fitted on the driver to a bounded number of them (`train`: MAX_FINDINGS of
secrets, of other candidates with a digit, and of the rest, copies in proportion to their number). Where there are more, `learn` goes on from there over all of them: in each
of ROUNDS every task learns from its PART_ROWS or so of the distinct windows, from the same parameters, and the next round begins with the mean of what
the tasks come to. A window weighs as its copies, and the three groups together as in the start. Calibration, thresholds and recall come from all candidates of
their fifths: sums and order statistics on Spark. Scoring takes all. Long candidates are read in several windows, each may be learnt from, and the best
counts.

Cases: null and empty texts have no candidates; without candidates of both labels in every fold nothing is added to the rules' findings
and no probability is given; equal candidates with equal context get equal probabilities, ties at a threshold are taken; repeated rows
are kept; very long texts are scanned whole; offsets are code points, ends exclusive; further columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable
from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burncal.llm.common import cut, id_and_text, map_batches, shared_copies, texts
from burncal.llm.made import OTHERS, made
from burncal.llm.toxicity import logistic

#: The rules.
KINDS = ("assign", "access", "hex", "cnn")
ASSIGN = re.compile(r"""(?a)(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run is as long as it gets, so the shorter ones need no match
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
TOKEN = re.compile(r"[A-Za-z0-9+/_=.@:-]{12,}")
QUOTED = re.compile(r"""(["'])([^\s"']{8,})\1""")
MAX_FINDINGS = 2_500
MADE = 3_000  # of secrets, and of what only looks like them
CONTEXT, BODY, WIDTH, FILTERS, EMBED = 16, 40, 5, 24, 12
LENGTH = BODY + 2 * CONTEXT
CLASSES = 130  # ASCII, other, none
RECALL = 0.98
PART_ROWS, ROUNDS = 20_000, 2
BATCH, RATE = 128, 1e-3  # of the rounds over all candidates
CELLS = 1 << 32  # parameters are summed as whole numbers of this fraction, so that the order of tasks does not matter
TELLING = 12  # characters; the last window of a long candidate is learnt from only if it has so many of them
FOLDS = 10  # the first five for one network, the others for the other
FORM = ("side", "kind", "y", "w", "size", "weight", "copies")  # what a form is judged from
ALONE, FORMAT = "alone", "format"  # kinds of labelled secrets: the rules' without their context, and made ones


def rule_findings(text: str) -> list[tuple[str, int, int]]:
    """The rules' matches, leftmost without overlap for each kind; sorted by start, then kind."""
    low = text.lower()
    found = []
    if any(k in low for k in KEYWORDS) or not text.isascii():
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Tokens and quoted values with the first kind of rule that touches them, or cnn; by start."""
    spans = {m.span() for m in TOKEN.finditer(text)}
    if '"' in text or "'" in text:
        spans |= {m.span(2) for m in QUOTED.finditer(text)}
    if not spans:
        return []
    rules, out, first = sorted((s, e, k) for k, s, e in rule_findings(text)), [], 0
    reach = 0  # rules are read along with the tokens; an earlier one can reach far
    open_rules: list[tuple[int, int, str]] = []
    for s, e in sorted(spans):
        while first < len(rules) and rules[first][0] < e:
            open_rules.append(rules[first])
            first += 1
        if reach < s:
            open_rules = [r for r in open_rules if r[1] > s]
            reach = s
        kinds = [k for x, y, k in open_rules if x < e and s < y]
        out.append((min(kinds, key=KINDS.index) if kinds else "cnn", s, e))
    return out


def windows(text: str, start: int, end: int) -> list[str]:
    """The text around a candidate, in pieces of BODY characters with CONTEXT on both sides; \\0 where there is none."""
    return [
        text[max(0, s - CONTEXT) : s].rjust(CONTEXT, "\0") + (text[s : min(end, s + BODY)] + text[min(end, s + BODY) : min(end, s + BODY) + CONTEXT]).ljust(BODY + CONTEXT, "\0")
        for s in range(start, end, BODY)
    ]


def encode(rows: list[str]) -> np.ndarray:
    """Character classes [n, LENGTH]."""
    points = np.frombuffer("".join(rows).encode("utf-32-le", "replace"), np.uint32).reshape(len(rows), LENGTH)
    return np.where(points == 0, CLASSES - 1, np.minimum(points, CLASSES - 2)).astype(np.int64)


class CharNet:
    """Embeddings, one convolution, maxima over candidate and window, one logit; trained by Adam."""

    def __init__(self, seed: int = 5):
        rng = np.random.RandomState(seed)
        self.p = {
            "embed": rng.standard_normal((CLASSES, EMBED)) * 0.3,
            "conv": rng.standard_normal((WIDTH * EMBED, FILTERS)) * (2 / (WIDTH * EMBED)) ** 0.5,
            "bias": np.zeros(FILTERS),
            "out": rng.standard_normal(2 * FILTERS) * 0.1,
            "shift": np.zeros(1),
        }
        self.p = {n: v.astype(np.float32) for n, v in self.p.items()}
        self.calibration, self.thresholds = np.array([0.0, 1.0]), {FORMAT: 0.5}

    def _forward(self, x: np.ndarray):
        view = np.lib.stride_tricks.sliding_window_view(self.p["embed"][x], WIDTH, axis=1)  # n, places, EMBED, WIDTH
        patches = view.transpose(0, 1, 3, 2).reshape(len(x), LENGTH - WIDTH + 1, WIDTH * EMBED)
        hidden = np.maximum(patches @ self.p["conv"] + self.p["bias"], 0.0)
        inside = hidden[:, CONTEXT : CONTEXT + BODY - WIDTH + 1]
        best = np.stack([inside.argmax(1) + CONTEXT, hidden.argmax(1)], 1)  # n, 2, FILTERS
        pooled = np.take_along_axis(hidden, best.reshape(len(x), 2, FILTERS), 1).reshape(len(x), 2 * FILTERS)
        return patches, best, pooled, pooled @ self.p["out"] + self.p["shift"]

    def logits(self, x: np.ndarray, step: int = 256) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + step])[3] for i in range(0, len(x), step)] or [np.zeros(0)]).astype(float)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 3e-3, seed: int = 11, weight: np.ndarray | None = None) -> CharNet:
        rng, mean, square, k = np.random.RandomState(seed), {n: 0.0 for n in self.p}, {n: 0.0 for n in self.p}, 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                rows = order[i : i + batch]
                patches, best, pooled, logit = self._forward(x[rows])
                own = 1 / len(rows) if weight is None else weight[rows] / weight[rows].sum()
                off = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[rows]) * own).astype(np.float32)
                back = (off[:, None] * self.p["out"]).reshape(-1, 2, FILTERS) * (pooled > 0).reshape(-1, 2, FILTERS)
                chosen = patches[np.arange(len(rows))[:, None, None], best]  # n, 2, FILTERS, WIDTH * EMBED
                g = {"out": pooled.T @ off, "shift": off.sum(keepdims=True), "bias": back.sum((0, 1)), "conv": np.einsum("nkf,nkfp->pf", back, chosen)}
                into = (back[..., None] * self.p["conv"].T).reshape(len(rows), 2, FILTERS, WIDTH, EMBED)
                places = x[rows][np.arange(len(rows))[:, None, None, None], best[..., None] + np.arange(WIDTH)]
                g["embed"] = np.stack([np.bincount(places.ravel(), column, CLASSES) for column in into.reshape(-1, EMBED).T], 1).astype(np.float32)
                k += 1
                for n, value in g.items():
                    mean[n], square[n] = 0.9 * mean[n] + 0.1 * value, 0.999 * square[n] + 0.001 * value**2
                    self.p[n] = self.p[n] - rate * (mean[n] / (1 - 0.9**k)) / (np.sqrt(square[n] / (1 - 0.999**k)) + 1e-7)
        return self

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.calibration[0] + self.calibration[1] * self.logits(x), -30, 30)))

    def calibrate(self, x: np.ndarray, y: np.ndarray, kinds: list[str], recall: float = RECALL) -> CharNet:
        """Logistic calibration, and for each kind of secret the highest threshold that recalls the given share of it."""
        self.calibration = logistic(self.logits(x)[:, None], y, l2=0.01)
        self.thresholds |= thresholds_of(self.probabilities(x), y, kinds, recall)
        return self

    def takes(self, kind: str, p: float) -> bool:
        """Whether a candidate is a secret: by the threshold of its rule, else by that of the made formats."""
        return p >= self.thresholds.get(FORMAT if kind == "cnn" else kind, self.thresholds[FORMAT])


def thresholds_of(p: np.ndarray, y: np.ndarray, kinds: list[str], recall: float = RECALL) -> dict[str, float]:
    """For each kind the highest probability that the given share of its secrets reaches."""
    found = {}
    for kind in sorted({k for k, own in zip(kinds, y) if own}):
        secrets = np.sort(p[(np.array(kinds) == kind) & (y == 1)])
        found[kind] = float(secrets[int(np.floor((1 - recall) * len(secrets)))])
    return found


@dataclass
class Scorer:
    """Two networks; each scores the folds that the other has learnt from."""

    nets: tuple[CharNet, CharNet]
    report: dict[str, tuple[int, float]]  # kind -> secrets of the parts that nothing was learnt from, share of them found

    def judge(self, rows: list[tuple[str, int, list[str]]]) -> list[tuple[float, bool]]:
        """(probability, whether it is a secret) of candidates given as (kind, fold, windows)."""
        out: list[tuple[float, bool]] = [(0.0, False)] * len(rows)
        for side, net in enumerate(self.nets):
            own = [i for i, (_, fold, _) in enumerate(rows) if (fold < FOLDS // 2) != (side == 0)]
            if own:
                p = net.probabilities(encode([w for i in own for w in rows[i][2]]))
                stops = np.cumsum([len(rows[i][2]) for i in own])
                best = np.maximum.reduceat(p, np.append(0, stops[:-1])).tolist()
                for i, x in zip(own, best):
                    out[i] = x, net.takes(rows[i][0], x)
        return out


def alone(window: str, size: int) -> str:
    """The window without what is around its `size` characters of the candidate."""
    return "\0" * CONTEXT + window[CONTEXT : CONTEXT + size].ljust(BODY + CONTEXT, "\0")


def views(kind: str, text: str, start: int, end: int) -> list[str]:
    """What the network reads of a candidate: its windows, and where no rule speaks for it, each also without context."""
    own = windows(text, start, end)
    return own if kind != "cnn" else own + [alone(w, min(BODY, end - start - k * BODY)) for k, w in enumerate(own)]


def fold_of(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % FOLDS


def find_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base (the rules' findings) and found (kind, fold, start, end, windows) for every row."""
    span = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]
    base_type = pa.list_(pa.struct(span))
    found_type = pa.list_(pa.struct([*span, ("fold", pa.int32()), ("windows", pa.list_(pa.string()))]))

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = texts(batch)
        base = [[{"kind": k, "start": s, "end": e} for k, s, e in rule_findings(t)] for t in own]
        found = [[{"kind": k, "start": s, "end": e, "fold": fold_of(t[s:e]), "windows": views(k, t, s, e)} for k, s, e in candidates(t)] for t in own]
        return pa.record_batch([batch.column("doc_id"), pa.array(base, base_type), pa.array(found, found_type)], ["doc_id", "base", "found"])

    schema = "doc_id long, base array<struct<kind:string,start:long,end:long>>, found array<struct<kind:string,start:long,end:long,fold:int,windows:array<string>>>"
    return map_batches(id_and_text(docs, id_col, text_col), per_batch, schema)


def learnable(rows: list[tuple[str, int, str, int]]) -> list[tuple[str, int, str, str]]:
    """(window, label, kind, the same without context) of candidates given as (kind, label, window, length of the token in it): secrets also
    without context, in both cases of letters, others also without context."""
    out = []
    for kind, label, window, size in rows:
        bare = alone(window, size)
        forms = {bare, bare.upper()} if label and bare.isascii() else {bare}
        out += [(window, label, kind, bare), *((w, label, ALONE if label else kind, bare) for w in sorted(forms))]
    return out


def plain_word(bare: str) -> bool:
    """Whether a token without context is letters of one case, but for its first: such tokens are words."""
    token = bare.strip("\0").rstrip(".:-")
    return token.isalpha() and (token[1:].islower() or token[1:].isupper())


def made_rows(around: list[str], n: int) -> list[tuple[int, str, int, int]]:
    """(label, window, length of the token in it, fold) of made tokens, between the characters of windows of the corpus; longer ones by all their windows."""
    rng, out = np.random.RandomState(9), []
    for label, tokens in ((1, made(n)), (0, made(n, 7, OTHERS))):
        for _, token in tokens:
            w = around[rng.randint(len(around))] if around else "\0" * LENGTH
            before, after = w[:CONTEXT].lstrip("\0"), w[-CONTEXT:].rstrip("\0").replace("\0", " ")
            whole = windows(before + token + after, len(before), len(before) + len(token))
            sizes = [min(BODY, len(token) - k * BODY) for k in range(len(whole))]
            out += [(label, own, size, fold_of(token)) for own, size in zip(whole, sizes) if size >= TELLING]
    return out


def candidate_windows(found: DataFrame) -> DataFrame:
    """kind, y, fold, size and w of the distinct windows that can be learnt from, their group (0: secrets, 1: others with a digit, 2: the rest) and copies."""
    one = found.select(F.explode("found").alias("f")).select(
        "f.kind", (F.col("f.kind") != "cnn").cast("int").alias("y"), "f.fold", (F.col("f.end") - F.col("f.start")).alias("size"), F.posexplode("f.windows").alias("k", "w")
    )
    one = one.filter((F.col("k") == 0) | (F.col("k") * BODY + TELLING <= F.col("size")))  # windows with context; the others are made from them
    one = one.select("kind", "y", "fold", F.least(F.lit(BODY), F.col("size") - F.col("k") * BODY).cast("int").alias("size"), "w")
    digit = F.substring("w", CONTEXT + 1, BODY).rlike("[0-9]")
    return one.groupBy(*one.columns).agg(F.count(F.lit(1)).alias("copies")).withColumn("g", F.when(F.col("y") == 1, 0).when(digit, 1).otherwise(2))


def counts_of(counted: DataFrame) -> dict[tuple[int, int], tuple[int, int]]:
    """(fold, group) -> windows and distinct ones; 3 * FOLDS at most."""
    return {(r.fold, r.g): (r.n, r.m) for r in counted.groupBy("fold", "g").agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("m")).collect()}


def shares_of(counts: dict[tuple[int, int], tuple[int, int]]) -> list[float]:
    """The share of each group that makes MAX_FINDINGS of it."""
    return [min(1.0, MAX_FINDINGS / max(1, sum(n for (_, g), (n, _) in counts.items() if g == own))) for own in range(3)]


def train(found: DataFrame) -> Scorer | None:
    """The networks from about MAX_FINDINGS windows each of secrets, of other candidates with a digit, and of the rest; None if a label is
    missing in a part of them. The start of `learn`."""
    counted = cut(candidate_windows(found))
    return begin(counted, shares_of(counts_of(counted)))[0]


def begin(counted: DataFrame, shares: list[float]) -> tuple[Scorer | None, list[tuple[int, str, int, int]]]:
    """The networks from shares of the groups, and the made rows that they have learnt from beside."""
    rows = [r for g, share in enumerate(shares) for r in shared_copies(counted.filter(F.col("g") == g).drop("g"), share).collect()]
    rows = sorted(rows, key=lambda r: (zlib.crc32(r.w.encode("utf-8", "surrogatepass")), r.w, r.kind))  # training must not depend on the order of tasks
    rows = [r for r in rows for _ in range(r.copies)]
    extra = made_rows([r.w for r in rows if not r.y], MADE)
    return fit_rows(rows, extra), extra


def made_forms(extra: list[tuple[int, str, int, int]], side: int, folds: tuple[int, ...]) -> list[tuple[str, int, str, str]]:
    """What is learnt from the made rows of some folds of a side, each also without context; as `learnable`."""
    half = FOLDS // 2
    own = [(label, w, alone(w, size)) for label, w, size, fold in extra if fold // half == side and fold % half in folds]
    return [(v, label, FORMAT if label else "made", bare) for label, w, bare in own for v in (w, bare)]


def fit_rows(rows: list, extra: list[tuple[int, str, int, int]]) -> Scorer | None:
    """The networks from rows on the driver."""
    half = FOLDS // 2
    fitted, held, last = [], [], []
    for side in (0, 1):
        own = [[(r.kind, r.y, r.w, r.size) for r in rows if r.fold // half == side and r.fold % half in folds] for folds in ((0, 1, 2), (3,), (4,))]
        if any({row[1] for row in part} != {0, 1} for part in own[:2]):
            return None
        parts = [learnable(part) for part in own]
        for part, folds in zip(parts, ((0, 1, 2), (3,), (4,))):
            part += made_forms(extra, side, folds)
        (x, y, bare), (hx, hy, hbare) = ((encode([r[0] for r in part]), np.array([r[1] for r in part], float), encode([r[3] for r in part])) for part in parts[:2])
        known, hknown = (np.array([bool(r[1]) or r[2] == "made" or plain_word(r[3]) for r in part]) for part in parts[:2])
        net = CharNet().fit(x, y, epochs=6)
        sure, held_sure = known | (net.probabilities(bare) < 0.5), hknown | (net.probabilities(hbare) < 0.5)
        net.fit(x[sure], y[sure], epochs=3).calibrate(hx[held_sure], hy[held_sure], [r[2] for r, s in zip(parts[1], held_sure) if s])
        fitted.append(net)
        held.append((net.probabilities(hx[held_sure]), hy[held_sure], [r[2] for r, s in zip(parts[1], held_sure) if s]))
        last.append([(r[0], r[2]) for r in parts[2] if r[1]])
    common = thresholds_of(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), [k for h in held for k in h[2]])
    measured = []
    for net, secrets in zip(fitted, last):
        net.thresholds |= common
        p = net.probabilities(encode([w for w, _ in secrets])) if secrets else []
        measured += [(k, net.takes(k if k not in (ALONE, FORMAT) else "cnn", x)) for (_, k), x in zip(secrets, p)]
    kinds = sorted({k for k, _ in measured})
    return Scorer((fitted[0], fitted[1]), {k: (sum(k == x for x, _ in measured), float(np.mean([t for x, t in measured if x == k]))) for k in kinds})


def sure_forms(net: CharNet, rows: list[tuple[str, int, str, int]], weak: bool = True) -> tuple[list[tuple[str, int, str, str]], np.ndarray]:
    """The learnable forms of candidates and the row that each is of; unlabelled candidates that look like secrets without their context are left
    out if `weak`, but for words."""
    forms = [learnable([row]) for row in rows]
    doubtful = [i for i, own in enumerate(forms) if weak and not own[0][1] and not plain_word(own[0][3])]
    out = {i for i, z in zip(doubtful, net.logits(encode([forms[i][0][3] for i in doubtful])) if doubtful else []) if z >= 0}
    kept = [(i, form) for i, own in enumerate(forms) if i not in out for form in own]
    return [form for _, form in kept], np.array([i for i, _ in kept], np.int64)


def _network(p: dict[str, np.ndarray]) -> CharNet:
    net = CharNet()
    net.p = p
    return net


def _candidates_of(rows: pa.Table | pa.RecordBatch) -> list[tuple[str, int, str, int]]:
    return list(zip(*(rows.column(c).to_pylist() for c in ("kind", "y", "w", "size"))))


def learn_round(weighed: DataFrame, nets: list[dict[str, np.ndarray]], extra: list, parts: int, weak: bool, rate: float) -> list[dict[str, np.ndarray]]:
    """The parameters of both sides after every task has learnt once from its part of the windows (side, part, kind, y, w, size, weight): the means over the parts.
    Made rows are learnt from in every part, and weigh as much in all of them together as once."""
    names, ends = list(nets[0]), np.cumsum([v.size for v in nets[0].values()])
    own = [made_forms(extra, side, (0, 1, 2)) for side in (0, 1)]
    held = weighed.sparkSession.sparkContext.broadcast((nets, [(encode([f[0] for f in forms]).astype(np.uint8) if forms else np.zeros((0, LENGTH), np.uint8), np.array([f[1] for f in forms], float)) for forms in own]))

    def one(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("w", "kind", "size")])
        side, part = rows.column("side")[0].as_py(), rows.column("part")[0].as_py()
        given, beside = held.value
        net = _network(given[side])
        forms, at = sure_forms(net, _candidates_of(rows), weak)
        weight = np.append(rows.column("weight").to_numpy()[at], np.full(len(beside[side][1]), 1 / parts))
        x = np.concatenate([encode([f[0] for f in forms]) if forms else np.zeros((0, LENGTH), np.int64), beside[side][0].astype(np.int64)])
        net.fit(x, np.append(np.array([f[1] for f in forms], float), beside[side][1]), epochs=1, batch=BATCH, rate=rate, seed=11 + part, weight=weight)
        flat = np.concatenate([net.p[n].ravel() for n in names]).astype(float)
        return pa.table({"side": pa.array(np.full(len(flat), side, np.int32)), "cell": pa.array(np.arange(len(flat), dtype=np.int32)), "value": pa.array(np.round(flat * CELLS).astype(np.int64))})

    moved = weighed.repartition(2 * parts, "side", "part").groupBy("side", "part").applyInArrow(one, "side int, cell int, value long")
    flat = [np.concatenate([v.ravel() for v in p.values()]).astype(float) for p in nets]
    for r in moved.groupBy("side", "cell").agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n")).collect():  # two networks
        flat[r.side][r.cell] = r.value / CELLS / r.n
    return [{n: v.reshape(nets[0][n].shape).astype(np.float32) for n, v in zip(names, np.split(p, ends[:-1]))} for p in flat]


def form_logits(rows: DataFrame, nets: list[dict[str, np.ndarray]]) -> DataFrame:
    """side, kind, y, z, weight and copies of every form that is judged; z: the logit."""
    return map_batches(rows.select(*FORM), _logits_of(rows, nets), "side int, kind string, y int, z double, weight double, copies long")


def form_probabilities(rows: DataFrame, nets: list[dict[str, np.ndarray]], calibrations: list[np.ndarray]) -> DataFrame:
    """kind, p and copies of every form that is judged. In one step: two in a row hold two Python workers for each task, and Spark keeps them all."""
    logits = _logits_of(rows, nets)
    return map_batches(rows.select(*FORM), lambda batch: _probabilities(logits(batch), calibrations), "kind string, p double, copies long")


def _logits_of(rows: DataFrame, nets: list[dict[str, np.ndarray]]) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    held = rows.sparkSession.sparkContext.broadcast(nets)

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        sides, own, out = np.array(batch.column("side").to_pylist()), _candidates_of(batch), []
        weight, copies = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("weight", "copies"))
        for side in (0, 1):
            mine = np.flatnonzero(sides == side)
            net = _network(held.value[side])
            forms, at = sure_forms(net, [own[i] for i in mine])
            if forms:
                z = net.logits(encode([f[0] for f in forms]))
                out += [(side, f[2], f[1], float(v), float(weight[mine[i]]), int(copies[mine[i]])) for f, v, i in zip(forms, z, at)]
        kinds = (pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.int64())
        return pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["side", "kind", "y", "z", "weight", "copies"])

    return per_batch


def with_probability(scored: DataFrame, calibrations: list[np.ndarray]) -> DataFrame:
    """kind, p, copies."""
    return map_batches(scored.select("side", "kind", "z", "copies"), lambda batch: _probabilities(batch, calibrations), "kind string, p double, copies long")


def _probabilities(batch: pa.RecordBatch, calibrations: list[np.ndarray]) -> pa.RecordBatch:
    both = np.stack(calibrations)[batch.column("side").to_numpy(zero_copy_only=False)]
    p = 1 / (1 + np.exp(-np.clip(both[:, 0] + both[:, 1] * batch.column("z").to_numpy(zero_copy_only=False), -30, 30)))
    return pa.record_batch([batch.column("kind"), pa.array(p), batch.column("copies")], ["kind", "p", "copies"])


def calibrate_sums(scored: DataFrame, beside: list[tuple[np.ndarray, np.ndarray]], l2: float = 0.01, steps: int = 30) -> list[np.ndarray]:
    """What `logistic` gives for the weighed logits of each side and those beside (logits, labels), by sums on Spark; exact ones, so that the order of tasks does not matter."""
    found, penalty = [np.zeros(2), np.zeros(2)], l2 * np.diag([1e-6, 1.0])
    for _ in range(steps):
        at = F.when(F.col("side") == 0, float(found[0][0]) + float(found[0][1]) * F.col("z")).otherwise(float(found[1][0]) + float(found[1][1]) * F.col("z"))
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), at))))
        rows = scored.select("side", "z", "weight", "y", p.alias("p"))
        bend, off = F.col("weight") * (F.col("p") * (1 - F.col("p")) + 1e-9), F.col("weight") * (F.col("y") - F.col("p"))
        terms = {"a": bend, "b": bend * F.col("z"), "c": bend * F.col("z") * F.col("z"), "d": off, "e": off * F.col("z")}
        sums = {r.side: r for r in rows.groupBy("side").agg(*(F.sum(t.cast("decimal(28,16)")).cast("double").alias(n) for n, t in terms.items())).collect()}
        moved = 0.0
        for side, (z, y) in enumerate(beside):
            x, own, w = np.stack([np.ones(len(z)), z], 1), sums.get(side), found[side]
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hessian, gradient = (x * (q * (1 - q) + 1e-9)[:, None]).T @ x + penalty, x.T @ (y - q) - penalty @ w
            if own is not None:
                hessian, gradient = hessian + [[own.a, own.b], [own.b, own.c]], gradient + [own.d, own.e]
            found[side] = w + np.linalg.solve(hessian, gradient)
            found[side][1] = max(found[side][1], 0.0)
            moved = max(moved, float(np.abs(found[side] - w).max()))
        if moved < 1e-7:  # the next step's would be of the order of its square
            break
    return found


def thresholds_on_spark(scores: DataFrame, recall: float = RECALL) -> dict[str, float]:
    """What `thresholds_of` gives for rows of kind, p and copies: running totals come from range partitions and the sums of those before, so no task
    sees all of a kind."""
    counts = scores.groupBy("kind", "p").agg(F.sum("copies").alias("n"))
    dealt = cut(counts.repartitionByRange("kind", "p").withColumn("part", F.spark_partition_id()))
    before, whole = Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("kind")  # one row per partition
    offsets = dealt.groupBy("kind", "part").agg(F.sum("n").alias("m")).select("kind", "part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("n0"), F.sum("m").over(whole).alias("total"))
    inside = Window.partitionBy("kind", "part").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    steps = dealt.join(F.broadcast(offsets), ["kind", "part"]).withColumn("upto", F.col("n0") + F.sum("n").over(inside))
    reached = steps.filter(F.col("upto") > F.floor(F.lit(1 - recall) * F.col("total")))
    return {r.kind: r.p for r in reached.groupBy("kind").agg(F.min("p").alias("p")).collect()}  # kinds are few


def learn(found: DataFrame) -> Scorer | None:
    """The networks from all candidates; None if a label is missing in a part of them."""
    counted = cut(candidate_windows(found))
    counts, half = counts_of(counted), FOLDS // 2
    for side in (0, 1):
        for folds in ((0, 1, 2), (3,)):
            if len({g == 0 for fold, g in counts if fold // half == side and fold % half in folds}) < 2:
                return None
    shares = shares_of(counts)
    start, extra = begin(counted, shares)
    if min(shares) == 1 and start:
        return start  # it has learnt from every candidate
    weight = F.col("copies") * F.element_at(F.array(*map(F.lit, shares)), F.col("g") + 1)
    weighed = counted.withColumns({"side": F.floor(F.col("fold") / half).cast("int"), "role": F.col("fold") % half, "weight": weight})
    fitted = sum(m for (fold, _), (_, m) in counts.items() if fold % half < 3)
    parts = max(1, round(fitted / (2 * PART_ROWS)))
    parted = weighed.filter("role < 3").withColumn("part", F.pmod(F.xxhash64("w", "kind", "size"), F.lit(parts)).cast("int"))
    parted = parted.select("side", "part", "kind", "y", "w", "size", "weight")
    nets = [net.p for net in start.nets] if start else [CharNet().p, CharNet().p]
    for weak in [True] * ROUNDS if start else [False] * 6 + [True] * 3:
        nets = learn_round(parted, nets, extra, parts, weak, RATE if start else 3 * RATE)
    done = [_network(p) for p in nets]
    logits: Callable[[int, list], np.ndarray] = lambda side, forms: done[side].logits(encode([f[0] for f in forms])) if forms else np.zeros(0)
    held = [made_forms(extra, side, (3,)) for side in (0, 1)]
    scored = cut(form_logits(weighed.filter("role = 3").coalesce(2 * parts + 6), nets))  # read in every step, so not by many small tasks
    for net, fit in zip(done, calibrate_sums(scored, [(logits(side, forms), np.array([f[1] for f in forms], float)) for side, forms in enumerate(held)])):
        net.calibration = fit
    p = np.concatenate([net.probabilities(encode([f[0] for f in forms])) if forms else np.zeros(0) for net, forms in zip(done, held)])
    common = thresholds_of(p, np.array([f[1] for forms in held for f in forms], float), [f[2] for forms in held for f in forms])
    common |= thresholds_on_spark(with_probability(scored.filter("y = 1"), [net.calibration for net in done]))
    for net in done:
        net.thresholds |= common
    taken = F.create_map(*(F.lit(x) for kind in (*KINDS[:3], ALONE) for x in (kind, float(done[0].thresholds.get(FORMAT if kind == ALONE else kind, done[0].thresholds[FORMAT])))))
    last = form_probabilities(weighed.filter("role = 4 and y = 1"), nets, [net.calibration for net in done])
    last = last.groupBy("kind").agg(F.sum("copies").alias("n"), F.sum(F.when(F.col("p") >= taken[F.col("kind")], F.col("copies")).otherwise(0)).alias("hits")).collect()
    report = {r.kind: (r.n, r.hits / r.n) for r in last}
    beside = [net.takes("cnn", x) for side, net in enumerate(done) for forms in [[f for f in made_forms(extra, side, (4,)) if f[1]]] if forms for x in net.probabilities(encode([f[0] for f in forms]))]
    return Scorer((done[0], done[1]), report | ({FORMAT: (len(beside), float(np.mean(beside)))} if beside else {}))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and secrets (kind, start, end, p) for every row, by start, then kind; p: the calibrated probability."""
    found = cut(find_candidates(docs, id_col, text_col))
    scorer = learn(found)
    secret = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        base = [[(f["kind"], f["start"], f["end"]) for f in row] for row in batch.column("base").to_pylist()]
        own = [[(f["kind"], f["start"], f["end"], f["fold"], f["windows"]) for f in row] for row in batch.column("found").to_pylist()]
        rows = [[{"kind": k, "start": s, "end": e, "p": p} for k, s, e, p in row] for row in decide(scorer, base, own)]
        return pa.record_batch([batch.column("doc_id"), pa.array(rows, secret)], ["doc_id", "secrets"])

    return map_batches(found, per_batch, "doc_id long, secrets array<struct<kind:string,start:long,end:long,p:double>>")


def decide(scorer: Scorer | None, base: list[list[tuple[str, int, int]]], found: list[list[tuple[str, int, int, int, list[str]]]]) -> list[list[tuple[str, int, int, float | None]]]:
    """The spans of some texts, from the rules' findings and the candidates (kind, start, end, fold, windows)."""
    if scorer is None:
        return [[(k, s, e, None) for k, s, e in row] for row in base]
    judged = iter(scorer.judge([(k, fold, w) for row in found for k, _, _, fold, w in row]))
    out = []
    for rules, row in zip(base, found):  # a row's candidates come by start
        scores = [(s, e, *next(judged)) for _, s, e, _, _ in row]
        spans: list[tuple[str, int, int, float | None]] = [("cnn", s, e, p) for s, e, p, taken in scores if taken]
        starts, reach = [s for s, *_ in scores], list(accumulate((e for _, e, *_ in scores), max))
        for k, s, e in rules:
            inside, i = [], bisect_left(starts, e) - 1
            while i >= 0 and reach[i] > s:
                if scores[i][1] > s:
                    inside.append(scores[i][2])
                i -= 1
            spans.append((k, s, e, max(inside, default=None)))
        out.append(sorted(spans, key=lambda f: (f[1], KINDS.index(f[0]), f[2])))
    return out


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of the rules' findings, the checksum of their spans, and all spans, as text."""

    def spans(of):
        return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("secrets", lambda s: s["kind"] != "cnn")
    counts = [F.size(F.filter(F.col("secrets")["kind"], lambda k: k == F.lit(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]]
    return scanned.select("doc_id", *counts, F.sha2(spans(base), 256).alias("base_sha256"), spans(F.col("secrets")).alias("spans"))


def redact(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with each span, overlapping ones as one, replaced by a mark."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame) -> DataFrame:
    """The same rows and columns with secrets in `text` replaced, and n_chars, if there, counted anew; null texts stay null. The networks
    are trained on the candidates of all rows; texts are scanned again where they are redacted, so that no text is shuffled."""
    scorer = learn(cut(find_candidates(docs)))
    names = docs.columns

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = batch.column("text").to_pylist()
        base = [rule_findings(t or "") for t in own]
        found = [[(k, s, e, fold_of(t[s:e]), views(k, t, s, e)) for k, s, e in candidates(t)] if t else [] for t in own]
        clean = [redact(t, [(s, e) for _, s, e, _ in spans]) if spans else t for t, spans in zip(own, decide(scorer, base, found))]
        columns = {n: batch.column(n) for n in names} | {"text": pa.array(clean, pa.string())}
        return pa.record_batch([columns[n] for n in names], names)

    out = map_batches(docs, per_batch, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def sha(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
