"""Quality rules by line sequence labelling (operator 1).

A linear-chain conditional random field labels each line of a text content or boilerplate; Viterbi decoding gives the
likeliest sequence, and a document is retained when content makes up at least `SHARE` of its characters.

The field is trained here, on a bounded sample of documents with a `quality` label. Their lines have no labels of their
own, so training alternates: all lines of good documents are content, apart from those with a licence cue; lines of bad
documents begin as boilerplate and are decoded anew after each fit.

Defined results: null and empty texts have no content and are not retained; lines of white space alone belong to neither
label. A text of any length is one sequence; equal labellings are settled in favour of content. Of several texts of a
labelled doc_id the least is trained on. Without any labelled document fixed weights are used (`DEFAULT`). Each row is judged by itself, also with a null
or repeated doc_id; extra columns are ignored by the report and kept by the filter; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioq.llm._spark import keep_texts, map_texts, table
from folioq.llm._text import SPACE, mix, range_hash, words

#: Bound of the training sample: labelled documents, and lines of each, in sequences.
TRAIN_ROWS = 1500
TRAIN_LINES = 128
TRAIN_PARTS = 4
SHARE = 0.5
#: Decay of the chain's weights: labels must not spread from a licence line to the sentences beside it.
CHANGE_DECAY = 0.01

FEATURES = ["bias", "marks", "many_marks", "capitals", "digits", "bars", "shouts", "repeats", "long_words", "short_words", "brief", "open_end", "licence", "again", "plain"]
_LICENCE = re.compile(rb"licen[sc]ed? under|rights reserved|copyright|\(c\) ?\d{4}|is licensed|cookie|subscribe|privacy policy|terms of (?:use|service)|click here|sign up", re.I)
#: Weights of boilerplate against content where there is nothing to learn from, and of a change of label.
DEFAULT = (np.array([-2.0, 2, 3, 3, 1, 3, 3, 3, 1, 1, 0, 0.3, 3, 1, -1]), np.array([[0.5, -0.5], [-0.5, 0.5]]))

_KIND = np.zeros(256, np.uint8)  # 1 capital, 2 digit, 3 mark; sentence marks and quotes count as neither
_KIND[65:91] = 1
_KIND[48:58] = 2
for _c in b"#$%&*+/<=>@[\\]^_`{|}~!":
    _KIND[_c] = 3


@dataclass
class Lines:
    """Lines of a batch with more than white space: text, features, characters; text i has lines first[i]:first[i + 1]."""

    doc: np.ndarray
    x: np.ndarray
    size: np.ndarray
    first: np.ndarray


def lines(texts: list) -> Lines:
    w = words(texts, lower=False)
    data = w.data
    end = np.flatnonzero(data == 10)
    start = np.r_[0, end[:-1] + 1]
    word = np.searchsorted(w.start, np.r_[start, len(data)])
    used = np.flatnonzero(np.diff(word) > 0)
    n_words = np.diff(word)[used].astype(float)
    start, end, lo, hi = start[used], end[used], word[:-1][used], word[1:][used]
    doc = w.doc[lo] if len(used) else np.zeros(0, np.int64)
    kind = _KIND[data]

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, np.int32)
        np.cumsum(mask, out=total[1:])
        return (total[end] - total[start]).astype(float)

    size = count(~SPACE[data])
    marks, capitals, digits = count(kind == 3) / size, count(kind == 1) / size, count(kind == 2) / size
    bars = count(data == 124)
    shouts = count((data == 33) & np.r_[data[1:] == 33, False])
    line_of = np.repeat(np.arange(len(used)), (hi - lo))
    distinct = np.bincount(line_of[np.unique(mix(w.hash + mix(line_of.astype(np.uint64))), return_index=True)[1]], minlength=len(used)) if len(used) else n_words
    whole = mix(range_hash(data, start, end) + mix(doc.astype(np.uint64)))
    again = np.ones(len(used))
    again[np.unique(whole, return_index=True)[1]] = 0
    tail = data[w.end[hi - 1] - 1] if len(used) else np.zeros(0, np.uint8)
    licence = np.zeros(len(used))
    for m in _LICENCE.finditer(data.tobytes()):
        licence[np.searchsorted(start, m.start(), "right") - 1] = 1
    mean = size / n_words
    repeats, open_end = (distinct / n_words < 0.5) & (n_words >= 4), ~np.isin(tail, list(b".!?:;\"')"))
    plain = (marks <= 0.04) & (capitals <= 0.4) & (digits <= 0.25) & (bars < 2) & (shouts < 2) & ~repeats & ~open_end & (licence == 0)
    x = np.stack([np.ones(len(used)), marks > 0.04, marks > 0.15, capitals > 0.4, digits > 0.25, bars >= 2, shouts >= 2, repeats, mean > 14, mean < 2.5, n_words < 4, open_end, licence, again, plain], 1).astype(float)
    return Lines(doc, x, size, np.searchsorted(doc, np.arange(len(texts) + 1)))


def _lanes(found: Lines) -> tuple[np.ndarray, np.ndarray]:
    """Documents by falling number of lines, and how many of them have more than t lines, for each t."""
    n = np.diff(found.first)
    order = np.argsort(-n, kind="stable")
    most = int(n.max()) if len(n) else 0
    return order, np.searchsorted(-n[order], -np.arange(most), "left")


def viterbi(found: Lines, weights: np.ndarray, change: np.ndarray) -> np.ndarray:
    """The likeliest label of each line, 1 for boilerplate, over each document as one sequence."""
    score = found.x @ weights
    order, active = _lanes(found)
    begin = found.first[order]
    best = np.zeros((2, len(order)))
    back = np.zeros((2, len(score)), np.int8)
    for t, m in enumerate(active.tolist()):
        at = begin[:m] + t
        if t == 0:
            best[1, :m] = score[at]
            continue
        via = best[:, None, :m] + change[:, :, None]
        from_ = via.argmax(0)
        back[:, at] = from_
        best[:, :m] = via.max(0)
        best[1, :m] += score[at]
    label = np.zeros(len(score), np.int8)
    now = best.argmax(0)
    for t in range(len(active) - 1, -1, -1):
        m = int(active[t])
        at = begin[:m] + t
        label[at] = now[:m]
        if t:
            now[:m] = back[now[:m], at]
    return label


def _gradient(found: Lines, gold: np.ndarray, weights: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the log-likelihood: observed less expected counts, by the forward-backward recursions."""
    score = found.x @ weights
    order, active = _lanes(found)
    begin = found.first[order]
    unary = np.stack([np.zeros_like(score), score])
    alpha, beta = np.zeros((2, len(score))), np.zeros((2, len(score)))
    for t, m in enumerate(active.tolist()):
        at = begin[:m] + t
        alpha[:, at] = unary[:, at] if t == 0 else unary[:, at] + np.logaddexp(*(alpha[:, at - 1][:, None] + change[:, :, None]))
    pair = np.zeros((2, 2))
    for t in range(len(active) - 1, 0, -1):
        at = begin[: active[t]] + t
        into = unary[:, at] + beta[:, at]
        joint = alpha[:, at - 1][:, None] + change[:, :, None] + into[None]
        joint -= np.logaddexp(np.logaddexp(joint[0, 0], joint[0, 1]), np.logaddexp(joint[1, 0], joint[1, 1]))
        expected = np.exp(joint)
        pair -= expected.sum(2)
        np.add.at(pair, (gold[at - 1], gold[at]), 1)
        beta[:, at - 1] = np.logaddexp(change[:, 0, None] + into[0], change[:, 1, None] + into[1])
    odds = alpha + beta
    p = 1 / (1 + np.exp(np.clip(odds[0] - odds[1], -50, 50)))
    return found.x.T @ (gold - p), pair


def fit(found: Lines, quality: np.ndarray, rounds: int = 3, steps: int = 120) -> tuple[np.ndarray, np.ndarray]:
    """Weights from documents with a quality of 0 or 1; of a long one, TRAIN_PARTS sequences of TRAIN_LINES lines that are evenly
    spaced over it."""
    parts = []
    for a, b in itertools.pairwise(found.first.tolist()):
        begins = np.arange(a, b, TRAIN_LINES)
        if len(begins) > TRAIN_PARTS:
            begins = begins[np.linspace(0, len(begins) - 1, TRAIN_PARTS).astype(int)]
        parts += [np.arange(x, min(b, x + TRAIN_LINES)) for x in begins.tolist()]
    if parts:
        rows = np.concatenate(parts)
        found = Lines(found.doc[rows], found.x[rows], found.size[rows], np.r_[0, np.cumsum([len(p) for p in parts])])
    bad = quality[found.doc] == 0
    licence = found.x[:, FEATURES.index("licence")] > 0
    gold = (bad | licence).astype(np.int8)
    weights, change = DEFAULT[0].copy(), DEFAULT[1].copy()
    for k in range(rounds):
        if k:
            gold = np.where(bad, viterbi(found, weights, change), gold)
        moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(change), np.zeros_like(change)]
        for s in range(1, steps + 1):
            a, b = _gradient(found, gold, weights, change)
            n = max(1, len(gold))
            for g, x, m, v in ((a / n - 1e-4 * weights, weights, 0, 1), (b / n - CHANGE_DECAY * change, change, 2, 3)):
                moments[m] += 0.1 * (g - moments[m])
                moments[v] += 0.01 * (g * g - moments[v])
                x += 0.1 * (moments[m] / (1 - 0.9**s)) / (np.sqrt(moments[v] / (1 - 0.99**s)) + 1e-9)
    return weights, change


def shares(model: tuple, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: lines, content lines, and content's share of the characters."""
    found = lines(texts)
    content = viterbi(found, *model) == 0
    n = len(texts)
    total = np.bincount(found.doc, found.size, n)
    return np.diff(found.first), np.bincount(found.doc, content, n).astype(np.int64), np.bincount(found.doc, found.size * content, n) / np.maximum(total, 1)


def fitted(docs: DataFrame, labels: DataFrame) -> tuple:
    """Train on the TRAIN_ROWS labelled documents of least hash. Of several labels the least counts."""
    known = labels.select(F.col("doc_id").cast("long").alias("k"), F.col("quality").cast("int").alias("q")).where("k IS NOT NULL AND q IN (0, 1)").groupBy("k").agg(F.min("q").alias("q"))
    chosen = known.orderBy(F.xxhash64("k"), "k").limit(TRAIN_ROWS)
    rows = docs.select(F.col("doc_id").cast("long").alias("k"), F.col("text").cast("string").alias("t")).join(F.broadcast(chosen), "k").groupBy("k").agg(F.min("t").alias("t"), F.min("q").alias("q")).orderBy("k").collect()
    return fit(lines([r.t for r in rows]), np.array([r.q for r in rows])) if rows else DEFAULT


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lines, content_lines, content_share, retained) of every row."""
    model = fitted(docs, labels)

    def judge(texts: list) -> tuple[None, dict]:
        n, content, share = shares(model, texts)
        return None, {"lines": n, "content_lines": content, "content_share": share, "retained": (n > 0) & (share >= SHARE)}

    return map_texts(docs, judge, "lines long, content_lines long, content_share double, retained boolean")


def retain(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of `docs` that are retained, with all columns."""
    model = fitted(docs, labels)
    return keep_texts(docs, lambda texts: shares(model, texts)[2] >= SHARE)


def op1_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, content lines and content share of every document that is retained."""
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).where("retained")
