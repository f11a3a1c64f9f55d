"""Language identification by a bidirectional gated recurrent network over bytes (operator 7).

The network is trained in numpy by backpropagation through time on a bounded sample of rows with a `lang` label, plus
generated windows of symbols and digits for the class "und". It labels every byte of every text; the positions'
probabilities are averaged to the document's. Texts are cut into windows of `WINDOW` bytes, the last one padded, so that
many windows advance together; every byte of the text lies in one window.

Defined results: a document is "und", and rejected, when that class has a mean probability of at least `REJECT`, so a
short text full of numbers and marks is kept; else its language is the likeliest of the others. Null and empty texts
are "und" with probability 1. Without any labelled row everything is "und", and every text that isn't empty is accepted, as
there is nothing to tell by. A text may be of any length. Of languages equally likely the first in order of their names
counts. An empty table gives an empty result. Repeated rows are judged alike; extra columns are ignored by the report and kept by the filter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioq.llm._spark import keep_texts, map_texts, sampled, table
from folioq.llm._text import as_bytes

#: Bound of the training sample: labelled rows, and windows drawn from each.
TRAIN_ROWS = 600
TRAIN_WINDOWS = 6
WINDOW = 128
HIDDEN = 6
REJECT = 0.75
UNKNOWN = "und"
_LANES = 1024


@dataclass
class Network:
    """Weights of the two directions (x: byte table, u: recurrent, b: candidate bias) and of the output layer."""

    labels: list
    x: list
    u: list
    b: list
    out: np.ndarray
    bias: np.ndarray

    def weights(self) -> list:
        return [*self.x, *self.u, *self.b, self.out, self.bias]


def _squash(v: np.ndarray) -> np.ndarray:
    """The network's activation, v / (1 + |v|): cheaper than tanh by far, with the same range."""
    return v / (1 + np.abs(v))


def _slope(y: np.ndarray) -> np.ndarray:
    """Derivative of the activation at the point where its value is y."""
    return np.square(1 - np.abs(y))


def new_network(labels: list, hidden: int, rng: np.random.Generator) -> Network:
    def made(*shape: int) -> np.ndarray:
        return rng.normal(0, 0.3, shape)

    return Network(labels, [made(3 * hidden, 256) for _ in "fb"], [made(3 * hidden, hidden) for _ in "fb"], [np.zeros((hidden, 1)) for _ in "fb"], made(len(labels), 2 * hidden), np.zeros((len(labels), 1)))


def gradients(net: Network, data: np.ndarray, target: np.ndarray) -> tuple[float, list]:
    """Mean cross-entropy over all positions of data (windows x bytes), and its gradient for each weight."""
    lanes, steps = data.shape
    hidden = net.u[0].shape[1]
    states, saved = np.zeros((2, steps, hidden, lanes)), [[], []]
    for way in (0, 1):
        h = np.zeros((hidden, lanes))
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            gx, gh = net.x[way][:, data[:, t]], net.u[way] @ h
            gate = _squash(gx[: 2 * hidden] + gh[: 2 * hidden])
            z, r = 0.5 + 0.5 * gate[:hidden], 0.5 + 0.5 * gate[hidden:]
            c = gh[2 * hidden :] + net.b[way]
            n = _squash(gx[2 * hidden :] + r * c)
            saved[way].append((t, h, z, r, c, n, 0.5 * _slope(gate)))
            h = n + z * (h - n)
            states[way, t] = h
    both = np.concatenate(states, axis=1)
    score = net.out @ both + net.bias
    score -= score.max(1, keepdims=True)
    p = np.exp(score)
    p /= p.sum(1, keepdims=True)
    rows = np.arange(lanes)
    loss = -np.log(p[:, target, rows] + 1e-12).mean()
    p[:, target, rows] -= 1
    p /= lanes * steps
    d_out, d_bias = np.einsum("tcl,thl->ch", p, both), p.sum((0, 2))[:, None]
    d_both = net.out.T @ p
    dx, du, db = [np.zeros_like(w) for w in net.x], [np.zeros_like(w) for w in net.u], [np.zeros_like(w) for w in net.b]
    for way in (0, 1):
        dh = np.zeros((hidden, lanes))
        for t, h, z, r, c, n, slope in reversed(saved[way]):
            dh = dh + d_both[t, way * hidden : (way + 1) * hidden]
            dn = dh * (1 - z) * _slope(n)
            dz = dh * (h - n) * slope[:hidden]
            dr = dn * c * slope[hidden:]
            dg = np.concatenate([dz, dr, dn])
            dgh = np.concatenate([dz, dr, dn * r])
            np.add.at(dx[way].T, data[:, t], dg.T)
            du[way] += dgh @ h.T
            db[way] += (dn * r).sum(1, keepdims=True)
            dh = dh * z + net.u[way].T @ dgh
    return loss, [*dx, *du, *db, d_out, d_bias]


def train(texts: list, labels: list, hidden: int = HIDDEN, steps: int = 260, span: int = 48, lanes: int = 96, seed: int = 3) -> Network:
    """Fit the network by Adam on windows of `span` bytes drawn from the labelled texts and from generated noise."""
    rng = np.random.default_rng(seed)
    names = [*sorted(set(labels) - {UNKNOWN}), UNKNOWN]
    net = new_network(names, hidden, rng)
    windows, target = [], []
    for text, label in zip(texts, labels, strict=True):
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        for at in rng.integers(0, max(1, len(raw) - span + 1), min(TRAIN_WINDOWS, 1 + len(raw) // span)):
            part = raw[at : at + span]
            if len(part):
                windows.append(np.concatenate([part, np.full(span - len(part), 32, np.uint8)]))
                target.append(names.index(label))
    noise = np.frombuffer(b"0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~ \n\t\x00\x01\x7f", np.uint8)
    each = max(8, len(windows) // (2 * len(names)))
    windows += [rng.choice(noise, span) if k % 2 else rng.integers(0, 256, span).astype(np.uint8) for k in range(each)]
    target += [names.index(UNKNOWN)] * each
    data, goal = np.stack(windows), np.array(target)
    # Each label is drawn equally often.
    weight = 1 / np.bincount(goal, minlength=len(names))[goal]
    m, v = [np.zeros_like(w) for w in net.weights()], [np.zeros_like(w) for w in net.weights()]
    for k in range(1, steps + 1):
        pick = rng.choice(len(data), lanes, p=weight / weight.sum())
        _, grad = gradients(net, data[pick], goal[pick])
        rate = 0.03 * (1 - 0.9 * k / steps)
        for w, g, a, b in zip(net.weights(), grad, m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= rate * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-8)
    return net


def compiled(net: Network) -> dict:
    """Weights for inference: single precision, with the half of r = (1 + gate) / 2 folded into what r multiplies."""
    hidden = net.u[0].shape[1]
    half = np.r_[np.ones(2 * hidden), np.full(hidden, 0.5)][:, None]
    f = np.float32
    return {"labels": net.labels, "x": [x.astype(f) for x in net.x], "u": [(u * half).astype(f) for u in net.u], "b": [(b * 0.5).astype(f) for b in net.b], "out": net.out.astype(f), "bias": net.bias.astype(f)}


def _run(model: dict, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each window (a row of data, `size` bytes of which count): the sums over positions of the probabilities and
    of the labels given, both windows x labels."""
    lanes, steps = data.shape
    hidden, labels = model["u"][0].shape[1], len(model["labels"])
    data = np.ascontiguousarray(data.T)
    inside = np.arange(steps)[:, None] < size
    full = inside.all(1)
    both = np.empty((steps, 2 * hidden, lanes), np.float32)
    total, given = np.zeros((labels, lanes), np.float32), np.zeros((labels, lanes), np.float32)
    g, gh = np.empty((3 * hidden, lanes), np.float32), np.empty((3 * hidden, lanes), np.float32)
    size = np.empty((2 * hidden, lanes), np.float32)
    p = np.empty((labels, lanes), np.float32)
    n, c, zr, gate, z, r = g[2 * hidden :], gh[2 * hidden :], g[: 2 * hidden], gh[: 2 * hidden], g[:hidden], g[hidden : 2 * hidden]
    half, one = np.float32(0.5), np.float32(1)
    for way in (0, 1):
        x, u, b = model["x"][way], model["u"][way], model["b"][way]
        h = np.zeros((hidden, lanes), np.float32)
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            np.take(x, data[t], axis=1, out=g, mode="clip")
            np.matmul(u, h, out=gh)
            zr += gate
            np.abs(zr, out=size)
            size += one
            zr /= size
            c += b
            n += c
            c *= r
            n += c
            np.abs(n, out=size[:hidden])
            size[:hidden] += one
            n /= size[:hidden]
            z *= half
            z += half
            h -= n
            h *= z
            h = np.add(h, n, out=both[t, way * hidden : (way + 1) * hidden])
            if way:
                # Padding stands at the window's end, where the backward pass begins.
                if not full[t]:
                    h *= inside[t]
                np.matmul(model["out"], both[t], out=p)
                p += model["bias"]
                p -= p.max(0)
                given += (p == 0) & inside[t]
                np.exp(p, out=p)
                p *= inside[t] / p.sum(0)
                total += p
            h = h.copy()
    return total.T, given.T


def predict(model: dict, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: its label's index, the label's mean probability, and the share of bytes that were given it."""
    data, offset = as_bytes(texts)
    size = np.diff(offset) - 1
    count = -(-size // WINDOW)
    first = np.r_[0, np.cumsum(count)]
    doc = np.repeat(np.arange(len(texts)), count)
    start = offset[doc] + (np.arange(first[-1]) - first[doc]) * WINDOW
    width = np.minimum(WINDOW, offset[doc] + size[doc] - start)
    sums = np.zeros((2, len(texts), len(model["labels"])))
    for lo in range(0, len(start), _LANES):
        s, w, d = start[lo : lo + _LANES], width[lo : lo + _LANES], doc[lo : lo + _LANES]
        at = np.minimum(s[:, None] + np.arange(int(w.max())), len(data) - 1)
        for k, x in enumerate(_run(model, data[at], w)):
            np.add.at(sums[k], d, x)
    mean = sums / np.maximum(size, 1)[:, None]
    none = size == 0
    mean[:, none] = np.eye(len(model["labels"]))[-1]
    known = mean[0][:, :-1]
    best = np.where(mean[0][:, -1] >= REJECT, len(model["labels"]) - 1, known.argmax(1) if known.shape[1] else 0)
    rows = np.arange(len(texts))
    return best, mean[0][rows, best], mean[1][rows, best]


def fitted(docs: DataFrame) -> dict:
    """Train on the TRAIN_ROWS labelled rows of least hash."""
    order = F.xxhash64("doc_id", "text")
    known = docs.where("lang IS NOT NULL AND length(text) > 0").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), order.alias("h"))
    rows = sampled(known, "h", TRAIN_ROWS)
    if not rows:
        return compiled(new_network([UNKNOWN], HIDDEN, np.random.default_rng(0)))
    return compiled(train([r.text for r in rows], [r.lang for r in rows]))


def accepted(model: dict, texts: list, best: np.ndarray) -> np.ndarray:
    """Whether each text, whose label has the index `best`, is taken for a language."""
    if model["labels"] == [UNKNOWN]:
        return np.array([bool(t) for t in texts], bool)
    return best != len(model["labels"]) - 1


def identified(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """(doc_id, language, probability, positions, accepted) of every row; positions is the share of bytes given the
    language. The model, a few kB whatever the input, travels in the task's closure."""
    model = model or fitted(docs)

    def judge(texts: list) -> tuple[None, dict]:
        best, p, share = predict(model, texts)
        names = np.array(model["labels"], object)[best]
        return None, {"language": names, "probability": p, "positions": share, "accepted": accepted(model, texts, best)}

    return map_texts(docs, judge, "language string, probability double, positions double, accepted boolean")


def accept(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """Rows of `docs` whose text is accepted as one of the languages."""
    model = model or fitted(docs)
    return keep_texts(docs, lambda texts: accepted(model, texts, predict(model, texts)[0]))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, probability and share of positions of every document that is accepted."""
    return identified(table(spark, sf_dir, "documents")).where("accepted")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return accept(docs)
