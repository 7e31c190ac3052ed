"""Quality of a document from a linear-chain conditional random field over its lines.

Every line is good or bad.  A line's features are its own and its neighbours' shapes
(case, digits, symbols, repetition, punctuation); transitions tie adjacent lines.  The
forward-backward marginals of "good", weighted by line length, are the document's score.
The model is fitted on a bounded sample of labelled documents, all of whose lines carry
the document's label; features of texts are computed where the texts are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riverbed.llm.common import text_of

#: The largest number of labelled documents that the fit uses (those with the least hash of their id).
SAMPLE = 6000
STEPS, RATE, DECAY = 150, 0.08, 1e-3

_CLASSES = ("upper", "lower", "digit", "space", "stop", "bang", "comma", "bar", "symbol", "other")
_TABLE = np.full(0x250, _CLASSES.index("other"), np.uint8)
for _c in range(0x250):
    _ch = chr(_c)
    for _name, _is in (("upper", _ch.isupper()), ("lower", _ch.islower()), ("digit", _ch.isdigit()), ("space", _ch.isspace()), ("stop", _ch in ".?"), ("bang", _ch == "!"), ("comma", _ch in ",;:"), ("bar", _ch == "|"), ("symbol", _ch in "#*$%&<>@^~_=+\\/{}[]")):
        if _is:
            _TABLE[_c] = _CLASSES.index(_name)
            break
#: Features of one line; with both neighbours' and a constant they are a row of the model.
N_LINE = len(_CLASSES) - 1 + 13
N_ROW = 3 * N_LINE + 3


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each line, neighbours included, and the lines' lengths."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.where(points < 0x250, _TABLE[np.minimum(points, 0x24F)], _CLASSES.index("lower"))
    ends = np.append(np.flatnonzero(points == 10), len(points))
    starts = np.append(0, ends[:-1] + 1)
    n = (ends - starts).astype(np.float64)
    counts = np.empty((len(n), len(_CLASSES)))
    for c in range(len(_CLASSES)):
        total = np.append(0, np.cumsum(kinds == c))
        counts[:, c] = total[ends] - total[starts]
    seen: set[str] = set()
    words = np.zeros((len(n), 8))
    for k, line in enumerate(text.split("\n")):
        w = line.split()
        if w:
            inner = sum(1 for x in w if not x[:-1].isalnum() and len(x) > 3)
            words[k] = (len(w), len(set(w)) / len(w), sum(a == b for a, b in zip(w, w[1:])) / len(w), sum(map(len, w)) / len(w) / 12, line in seen, w[0][:1].isupper(), w[-1][-1] in ".?!", inner / len(w))
            seen.add(line)
    share = counts[:, :-1] / np.maximum(n, 1)[:, None]
    own = np.column_stack([share, np.log1p(n) / 7, np.log1p(words[:, 0]) / 5, words[:, 1:], n < 30, share[:, 0] > 0.5, share[:, 7] > 0.01, share[:, 8] > 0.02])
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    edge = np.zeros((len(n), 3))
    edge[:, 0] = 1
    edge[0, 1] = edge[-1, 2] = 1
    return np.column_stack([own, before, after, edge]).astype(np.float32), n + 1


class Crf:
    """Two states (0 bad, 1 good): emissions of "good", 2 x 2 transitions, a start weight."""

    def __init__(self, weights: np.ndarray | None = None):
        self.w = np.zeros(N_ROW + 5) if weights is None else weights

    def _parts(self) -> tuple[np.ndarray, np.ndarray, float]:
        return self.w[:N_ROW], self.w[N_ROW : N_ROW + 4].reshape(2, 2), self.w[N_ROW + 4]

    def batch(self, emit: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log partition, marginals of "good" and expected transitions of padded chains ``(docs, lines)``."""
        _, trans, first = self._parts()
        docs, lines = emit.shape
        e = np.stack([np.zeros_like(emit), emit], axis=-1)
        alpha = np.empty((docs, lines, 2))
        alpha[:, 0] = e[:, 0] + np.array([0.0, first])
        for t in range(1, lines):
            nxt = np.logaddexp(alpha[:, t - 1, 0, None] + trans[0], alpha[:, t - 1, 1, None] + trans[1]) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], nxt, alpha[:, t - 1])
        log_z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        beta = np.zeros((docs, lines, 2))
        pairs = np.zeros((docs, 2, 2))
        for t in range(lines - 2, -1, -1):
            into = e[:, t + 1] + beta[:, t + 1]
            step = np.logaddexp(trans[None, :, 0] + into[:, None, 0], trans[None, :, 1] + into[:, None, 1])
            live = mask[:, t + 1]
            beta[:, t] = np.where(live[:, None], step, 0.0)
            joint = np.exp(alpha[:, t, :, None] + trans[None] + into[:, None, :] - log_z[:, None, None])
            pairs += np.where(live[:, None, None], joint, 0.0)
        good = np.exp(alpha[..., 1] + beta[..., 1] - log_z[:, None]) * mask
        return log_z, good, pairs

    def fit(self, chains: list[tuple[np.ndarray, int]]) -> Crf:
        """Maximise the conditional likelihood of the label sequences, balanced over the labels, by Adam."""
        chains = sorted(chains, key=lambda c: len(c[0]))
        share = np.bincount([y for _, y in chains], minlength=2)
        if not share.all():
            return self
        groups, k = [], 0
        while k < len(chains):  # padded together: so many docs that the block stays small
            m = max(1, min(512, 40_000 // len(chains[min(k + 511, len(chains) - 1)][0])))
            part = chains[k : k + m]
            k += m
            longest = len(part[-1][0])
            mask = np.array([[t < len(x) for t in range(longest)] for x, _ in part])
            groups.append((np.concatenate([x for x, _ in part]).astype(np.float64), mask, np.array([y for _, y in part], float)))
        cost = len(chains) / (2 * share)
        m1, m2 = np.zeros_like(self.w), np.zeros_like(self.w)
        for step in range(1, STEPS + 1):
            grad = DECAY * self.w
            for x, mask, y in groups:
                emit = np.zeros(mask.shape)
                emit[mask] = x @ self.w[:N_ROW]
                _, good, pairs = self.batch(emit, mask)
                per = cost[y.astype(int)] / mask.sum(1) / len(chains)
                off = (good - y[:, None]) * mask * per[:, None]
                grad[:N_ROW] += off[mask] @ x
                grad[N_ROW + 4] += off[:, 0].sum()
                seen = np.zeros_like(pairs)
                seen[:, 1, 1], seen[:, 0, 0] = y * (mask.sum(1) - 1), (1 - y) * (mask.sum(1) - 1)
                grad[N_ROW : N_ROW + 4] += ((pairs - seen) * per[:, None, None]).sum(0).ravel()
            m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
            self.w = self.w - RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        return self

    def score(self, text: str) -> float:
        """Length-weighted mean marginal of "good" over the lines of a text."""
        x, n = line_features(text)
        emit = (x @ self.w[:N_ROW].astype(np.float32)).astype(np.float64)[None]
        _, good, _ = self.batch(emit, np.ones(emit.shape, bool))
        return float(min(1.0, max(0.0, good[0] @ n / n.sum())))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Crf:
    """Fit on at most ``sample`` of the labelled documents; only their features reach the driver."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text")).join(F.broadcast(chosen), "id").select("text", "y")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [line_features(t)[0].tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), b.column("y")], names=["x", "y"])

    found = texts.mapInArrow(features, "x binary, y int").collect()
    chains = sorted(((bytes(r.x), r.y) for r in found))
    return Crf().fit([(np.frombuffer(x, np.float32).reshape(-1, N_ROW), y) for x, y in chains])


def classify(docs: DataFrame, model: Crf, cut_off: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text.

    Returns ``id_col, held_out, score, predicted`` for each input row.  A null or empty
    text is one empty line.  ``held_out`` is whether crc32 of the id as text is a multiple
    of 5 (false for a null id).  Repeated rows get equal scores; further columns are
    ignored; an empty table gives no rows.  An unfitted model scores 0.5.
    """
    weights = model.w
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = Crf(weights)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([crf.score(t) for t in b.column("text").to_pylist()], pa.float64())], names=schema.names)

    scored = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text")).mapInArrow(run, schema)
    return scored.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= cut_off).cast("int").alias("predicted"))


def held_out(doc_id):
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))
