"""Personal data by a skip-chain conditional random field (operator 2).

Every word is a node, joined with the next by a transition potential. Words that repeat in a document where one of them
shows a sign of an entity share a skip potential with the clearest of them (so many places take as many edges), and words
alike (the same pattern of digits, letters and marks) with the next such word, at any distance. Loopy sum-product messages
give each node's marginals, so that a token that is clear in one place decides the unclear ones.

Signs of an entity are shapes (digits of all scripts, @), and contexts: what follows `password =` or `name is`, a title
before capitalised words, an address spelt with (at) and dot. Between them lie runs of plain words, which all have the
same potentials; the messages of such a run approach a fixed point, which `stationary` computes once. Beyond `REACH` words
from a sign the messages have reached it (a test compares with the whole graph), so these words are O without
further work, and only the words around signs are held as arrays. Messages of a text stop when that text's own have
settled, so its labels don't depend on the texts beside it.

A word that holds a shape between brackets, labels or other marks is split around it, so that the entity is a node of its
own.

The weights are trained here by gradient ascent, with expectations from the same message passing, on a bounded sample of
documents labelled by high-precision patterns and on generated sentences whose entities are known (`drills`); features are
dropped at random in training, which makes the field learn to rely on neighbours and on repetitions.

Defined results: null and empty texts have no entities. Each row is searched by itself, also with a null or repeated
doc_id; equal rows give equal results. A text may be of any length: it is one graph, in memory that is a multiple of its
own. Of two labels equally likely the first in `LABELS` counts. The report has the documents with entities only (doc_id,
entities, redacted, whatever else the table's columns are called); the filter keeps all rows and columns and replaces the
entities by their label in `text`, with `n_chars` (where it is an integer column) following. An empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioq.llm._spark import map_arrow, map_texts, sampled, table
from folioq.llm._text import SLICE, SPACE, Words, mix, range_hash, slices, words

#: Bound of the training sample, in documents with a digit or an @, and number of generated sentences.
TRAIN_ROWS = 600
DRILLS = 420
#: Words on either side of a sign that are held as arrays.
REACH = 8
#: The same in training.
NEAR = 2
LABELS = ["O", "EMAIL", "PHONE", "IP", "CARD", "SECRET", "ID", "NAME"]
FEATURES = [
    "bias", "email", "long_number", "ip", "plus", "area", "local", "phone", "hex", "quoted", "after_equals", "after_key", "number", "plain", "assigned", "grouped",
    "ssn", "isbn", "years", "after_version", "after_count", "named", "spelt", "keyed", "echo",
]
_AT = {name: k for k, name in enumerate(FEATURES)}
_EMAIL, _PHONE, _IP, _CARD, _SECRET, _ID, _NAME = range(1, 8)
_KEYS = {b"token", b"key", b"secret", b"password", b"passwd", b"pwd", b"apikey", b"api_key", b"auth", b"bearer", b"access_token", b"passphrase", b"passwort", b"credential", b"contrase\xc3\xb1a"}
_TITLES = {b"mr", b"mrs", b"ms", b"dr", b"prof", b"miss", b"herr", b"frau", b"monsieur", b"madame", b"mme", b"se\xc3\xb1or", b"se\xc3\xb1ora", b"sr", b"sra"}
_NAMES = {b"name", b"named", b"surname", b"fullname", b"nombre", b"nom"}
_VERSIONS = {b"version", b"v", b"ver", b"release", b"section", b"chapter"}
_COUNTS = {b"order", b"isbn", b"invoice", b"no", b"nr", b"ref", b"serial", b"ean"}
_LINKS = (b"=", b":", b":=", b"is", b"was", b"=>", b"->")
_MARKS = b".,;:!?%&$#*|\"'`<>[]{}"
_SHAPES = [
    (1, re.compile(rb"[\w.+%-]+@[\w-]+(?:\.[\w-]+)+")),
    (2, re.compile(rb"\d(?:[ -]?\d){12,18}")),
    (3, re.compile(rb"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)")),
    (4, re.compile(rb"\+\d{1,3}")),
    (5, re.compile(rb"\(\d{2,5}\)")),
    (6, re.compile(rb"\d{3}[-.]\d{4}")),
    (7, re.compile(rb"(?:\+?\d{1,3}[-.]?)?(?:\(?\d{3}\)?[-.]\d{3}[-.]|\(\d{3}\)\d{3}[-.]?)\d{4}|\+\d{10,14}")),
    (8, re.compile(rb"(?=[a-f]*\d)(?:[0-9a-f]{24,}|[0-9A-F]{24,})")),
    (16, re.compile(rb"\d{3}-\d{2}-\d{4}")),
]
_ASSIGNED = re.compile(rb"(?:token|key|secret|password|passwd|pwd|passphrase|api_?key|auth)[\"']?[=:][\"']?[\w./+!@-]{8,}", re.I)
#: A shape inside a word: marks, brackets or the word's ends on both sides, a full stop only where a sentence may end.
_EDGE = rb"()=/~,;:!?%&$#*|\"'`<>\[\]{}"
_INNER = re.compile(rb"(?<![^" + _EDGE + rb"])(?:" + b"|".join(b"(?:" + p + b")" for p in (_ASSIGNED.pattern.replace(b"(?:token", b"(?i:token"), *(dict(_SHAPES)[k].pattern for k in (1, 3, 16, 7, 2, 8, 5, 6, 4)))) + rb")(?=\.*(?:[" + _EDGE + rb"]|$))")
_OUTER = b"()=/~:"
_RUN = re.compile(rb"[A-Za-z\x80-\xff]+")
_WHOLE = re.compile(rb"\d")
_GROUP = re.compile(rb"\d{4}")
_YEAR = re.compile(rb"(?:1[5-9]|20)\d\d")
_FOREIGN = re.compile(r"(?=[^\x00-\x7f])\d")

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = np.zeros(256, bool)  # bytes that a word's core may begin or end with
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True


def _hash(cues: set) -> np.ndarray:
    text = b" ".join(sorted(cues))
    data = np.frombuffer(text, np.uint8)
    ends = np.array([*np.flatnonzero(data == 32).tolist(), len(data)])
    return np.sort(range_hash(data, np.r_[0, ends[:-1] + 1], ends))


_KEY_HASH, _TITLE_HASH, _NAME_HASH, _AT_HASH = (_hash(c) for c in (_KEYS, _TITLES, _NAMES, {b"at"}))


@dataclass
class Graph:
    """Nodes (text, byte bounds in that text, features), chain and skip edges of a batch of texts, and the nodes whose
    neighbour before (cut[0]) or after (cut[1]) is a word that isn't held."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    x: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    cut: tuple


def _ascii(token: bytes) -> bytes:
    """The word with the digits of other scripts written as ASCII ones."""
    if token.isascii():
        return token
    return "".join(str(int(c)) if c.isdecimal() else c for c in token.decode("utf-8", "replace")).encode()


def _features(token: bytes, before: bytes, before_that: bytes) -> list[int]:
    """Features of a word with a digit or an @, by its shape and the two words before it."""
    core = token.strip(_MARKS)
    found = [0, *(k for k, shape in _SHAPES if shape.fullmatch(core))]
    if _ASSIGNED.fullmatch(core):
        found.append(_AT["assigned"])
    digits = core.replace(b"-", b"")
    if digits.isdigit() and len(digits) in (10, 13) and (len(digits) == 13 or b"isbn" in (before + before_that).lower()) and (len(digits) == 10 or digits[:3] in (b"978", b"979")):
        found.append(_AT["isbn"])
    if len(found) == 1:
        found.append(_AT["number"])
    if token[:1] in b"\"'" and len(core) >= 16:
        found.append(_AT["quoted"])
    said, said_that = (t.strip(_MARKS + b"=()").lower() for t in (before, before_that))
    if before.strip(b".,;!?%&$#*|\"'") in (b"=", b":") or before.endswith((b"=", b":")):
        found.append(_AT["after_equals"])
        if said_that in _KEYS or said in _KEYS:
            found.append(_AT["after_key"])
    if said in _VERSIONS or core[:1] in b"vV":
        found.append(_AT["after_version"])
    if said in _COUNTS or said_that in _COUNTS:
        found.append(_AT["after_count"])
    return found


def _pieces(token: bytes) -> list[int]:
    """Where to split a word so that a shape in it stands alone; else brackets and the like are split off its ends."""
    core = token.strip(_MARKS)
    if core.isalnum() or _ASSIGNED.fullmatch(core) or any(shape.fullmatch(core) for _, shape in _SHAPES):
        return []
    cuts = {at for m in _INNER.finditer(token) for at in m.span()}
    if not cuts:
        cuts = {len(token) - len(token.lstrip(_OUTER + _MARKS)), len(token.rstrip(_OUTER + _MARKS))} if core.strip(_OUTER) != core else set()
    return sorted(cuts - {0, len(token)})


def _split(w: Words, cue: np.ndarray) -> Words:
    """The words with those split that hold a shape."""
    data = w.data.tobytes()
    cuts = [(k, a + at) for k, a, b in zip(cue.tolist(), w.start[cue].tolist(), w.end[cue].tolist(), strict=True) for at in _pieces(data[a:b])]
    if not cuts:
        return w
    word, at = np.array(cuts, np.int64).T
    start, end = np.sort(np.concatenate([w.start, at])), np.sort(np.concatenate([w.end, at]))
    return replace(w, start=start, end=end, doc=np.sort(np.concatenate([w.doc, w.doc[word]])))


def _phone_groups(tokens: list, follows: list) -> list[int]:
    """Words that write a phone number in groups of digits: 3, 3 and 4, the first perhaps in brackets and maybe a 1 before; a
    country code with + and groups of 2 to 5, 7 to 14 digits in all; or groups that begin with 0, 10 or 11 digits in all."""
    found: list = []
    bare = [t.strip(_MARKS) for t in tokens]
    digits = [t.isdigit() for t in bare]
    k = 0
    while k < len(tokens):
        end = k + 1
        while digits[k] and end < len(tokens) and follows[end] and digits[end] and tokens[end - 1][-1:].isdigit() and tokens[end][:1].isdigit():
            end += 1
        size = [len(t) for t in bare[k:end]]
        if digits[k] and (size == [3, 3, 4] or (size == [1, 3, 3, 4] and bare[k] == b"1")):
            found += range(k, end)
        elif digits[k] and size == [3, 4] and k and follows[k] and re.fullmatch(rb"\(\d{3}\)", tokens[k - 1]):
            found += range(k - 1, end)
        elif digits[k] and k and follows[k] and re.fullmatch(rb"\+\d{1,3}", tokens[k - 1].lstrip(_MARKS)) and 7 <= sum(size) <= 14 and max(size) <= 5 and min(size) >= 2:
            found += range(k - 1, end)
        elif digits[k] and bare[k][:1] == b"0" and 2 <= len(size) <= 5 and 10 <= sum(size) <= 11 and min(size) >= 2:
            found += range(k, end)
        k = end
    return found


class _Reader:
    """The words of a batch as bytes, with what precedes and follows in the same text."""

    def __init__(self, w: Words):
        self.w, self.data = w, w.data.tobytes()

    def __call__(self, k: int, text: int) -> bytes:
        w = self.w
        return _ascii(self.data[w.start[k] : w.end[k]]) if 0 <= k < len(w.start) and w.doc[k] == text else b""


def _told(read: _Reader, key: np.ndarray, title: np.ndarray, name: np.ndarray, spelt: np.ndarray) -> dict[int, set]:
    """Signs that context alone gives: {word: features}."""
    found: dict[int, set] = {}
    w = read.w

    def target(k: int) -> tuple[int, bool]:
        """The word that a cue at k points at (-1: none), and whether a mark says so."""
        text = int(w.doc[k])
        here, following = read(k, text), read(k + 1, text)
        if here.endswith((b"=", b":")):
            return k + 1, True
        return (k + 2, following not in (b"is", b"was")) if following in _LINKS else (-1, False)

    for k in key.tolist():
        at, marked = target(k)
        if at >= 0 and len(read(at, int(w.doc[k])).strip(_MARKS + b"()=")) >= (6 if marked else 8):
            found.setdefault(at, set()).add(_AT["keyed"])
    for k, at in [(k, k + 1) for k in title.tolist() if read(k, int(w.doc[k])).lstrip(_MARKS + b"(")[:1].isupper() or read(k, int(w.doc[k]))[:1] > b"\x7f"] + [(k, target(k)[0]) for k in name.tolist()]:
        for j in range(at, at + 3) if at >= 0 else ():
            token = read(j, int(w.doc[k]))
            core = token.strip(_MARKS + b"()").decode("utf-8", "replace")
            if len(core) < 2 or not core[0].isupper() or not all(c.isalpha() or c in "-'’." for c in core) or core.isupper():
                break
            found.setdefault(j, set()).add(_AT["named"])
            if token[-1:] in b".,;:!?)":
                break
    for k in spelt.tolist():
        text, end = int(w.doc[k]), k + 1
        dot = lambda j, text=text: read(j, text).strip(_MARKS + b"()").lower() == b"dot"
        if not read(k - 1, text) or not read(k + 1, text):
            continue
        while dot(end + 1) and read(end + 2, text):
            end += 2
        if end > k + 1 or b"." in read(end, text).rstrip(b"."):
            for j in range(k - 1, end + 1):
                found.setdefault(j, set()).add(_AT["spelt"])
    return found


def graph(texts: list, reach: int | None = REACH) -> Graph:
    """The words within `reach` of a sign or of a repetition of one; all words for None."""
    w = words(texts, lower=False, hashed=False)
    cue_byte = ((w.data >= 48) & (w.data < 58)) | (w.data == 64)
    for k, text in enumerate(texts):
        if text and not text.isascii():
            at = [m.start() for m in _FOREIGN.finditer(text)]
            if at:  # digits of other scripts: places in characters to places in bytes
                span = w.data[w.offset[k] : w.offset[k + 1]]
                cue_byte[w.offset[k] + np.flatnonzero((span & 0xC0) != 0x80)[at]] = True
    # Marks inside a word may part a key from its value.
    tied = np.flatnonzero((w.data[:-1] == 61) | (w.data[:-1] == 58)) if len(w.data) else np.zeros(0, np.int64)
    tied = tied[~SPACE[w.data[tied + 1]]]
    cue_at = np.flatnonzero(cue_byte)
    holder = lambda at: np.unique(np.searchsorted(w.start, at, "right") - 1) if len(w.start) else np.zeros(0, np.int64)
    raw = w.data.tobytes()
    assigned = [k for k in holder(tied).tolist() if w.start[k] >= 0 and _ASSIGNED.search(raw[w.start[k] : w.end[k]])]
    assigned_at = w.start[assigned] if assigned else np.zeros(0, np.int64)
    w = _split(w, np.unique(np.r_[holder(cue_at), np.array(assigned, np.int64)]))
    n = len(w.start)
    # Bounds of each word's core, and the hash of the core in small letters.
    ins = _INSIDE[w.data]
    place = np.arange(len(w.data), dtype=np.int64)
    last_in = np.maximum.accumulate(np.where(ins, place, -1)) if n else place
    next_in = np.minimum.accumulate(np.where(ins, place, len(place))[::-1])[::-1] if n else place
    lo = np.minimum(next_in[w.start], w.end) if n else w.start
    hi = np.maximum(last_in[w.end - 1] + 1, lo) if n else w.end
    h = range_hash(_LOWER[w.data], lo, hi) if n else np.zeros(0, np.uint64)
    which = lambda known: np.flatnonzero(known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h)
    spelt = which(_AT_HASH)
    spelt = spelt[np.isin(w.data[w.start[spelt]], list(b"([{<"))]
    read = _Reader(w)
    told = _told(read, which(_KEY_HASH), which(_TITLE_HASH), which(_NAME_HASH), spelt)
    shaped = holder(cue_at)
    if len(assigned_at):
        for k in np.searchsorted(w.start, assigned_at).tolist():
            for j in range(k, min(k + 3, n)):
                if _ASSIGNED.fullmatch(raw[w.start[j] : w.end[j]].strip(_MARKS)):
                    told.setdefault(j, set()).add(_AT["assigned"])
    told = {k: v for k, v in told.items() if k < n}
    marked = np.zeros(n, bool)
    marked[shaped] = True
    hot = marked.copy()
    hot[list(told)] = True
    key = mix(h + mix(w.doc.astype(np.uint64)))
    echo = np.isin(key, key[hot & (hi - lo >= 4)]) & (hi - lo >= 4) if hot.any() else hot
    core = np.flatnonzero(hot | echo)
    if reach is None:
        near = np.arange(n)
    else:
        held = np.zeros(n + 1, np.int64)
        first = _first(w)
        np.add.at(held, np.maximum(core - reach, first[w.doc[core]]), 1)
        np.add.at(held, np.minimum(core + reach + 1, first[w.doc[core] + 1]), -1)
        near = np.flatnonzero(np.cumsum(held)[:n] > 0)
    x = np.zeros((len(near), len(FEATURES)))
    x[:, 0] = x[:, _AT["plain"]] = 1
    doc = w.doc[near]
    joined = np.r_[False, (np.diff(near) == 1) & (np.diff(doc) == 0)] if len(near) else np.zeros(0, bool)
    last: dict = {}
    places: dict = {}
    skip: set = set()
    hot_nodes = np.flatnonzero(hot[near] | echo[near])
    for k in hot_nodes.tolist():
        word, d = int(near[k]), int(doc[k])
        token = read(word, d)
        if hot[word]:
            found = [0, *told.get(word, ())]
            if marked[word]:
                found += _features(token, read(word - 1, d), read(word - 2, d))
            x[k] = 0
            x[k, found] = 1
        else:
            x[k, [_AT["plain"], _AT["echo"]]] = 0, 1
        bare = token.strip(_MARKS)
        if bare:
            places.setdefault((d, bare.lower()), []).append(k)
        if marked[word] and len(bare) > 5:
            alike = d, _RUN.sub(b"a", _WHOLE.sub(b"9", bare))
            if alike in last:
                skip.add((last[alike], k))
            last[alike] = k
    weak = [_AT[f] for f in ("bias", "plain", "number", "echo")]
    for same in places.values():
        if len(same) > 1:
            hub = same[int((x[same].sum(1) - x[same][:, weak].sum(1)).argmax())]
            skip |= {(min(hub, k), max(hub, k)) for k in same if k != hub}
    _grouped(read, near, doc, joined, marked, x)
    chain = np.flatnonzero(joined)
    before, after = near - 1, near + 1
    cut_left = np.flatnonzero(~joined & (before >= 0) & (w.doc[np.maximum(before, 0)] == doc)) if len(near) else np.zeros(0, np.int64)
    follows = np.r_[joined[1:], False] if len(near) else joined
    cut_right = np.flatnonzero(~follows & (after < n) & (w.doc[np.minimum(after, n - 1)] == doc)) if len(near) else np.zeros(0, np.int64)
    base = w.offset[doc]
    edges = np.array(sorted(skip), np.int64).reshape(-1, 2)
    edges = edges[near[edges[:, 1]] > near[edges[:, 0]] + 1]  # neighbours are joined already
    return Graph(doc, w.start[near] - base, w.end[near] - base, x, np.stack([chain - 1, chain], 1), edges, (cut_left, cut_right))


def _first(w: Words) -> np.ndarray:
    """Number of the first word of each text, after words have been split."""
    return np.searchsorted(w.doc, np.arange(len(w.offset)))


def _grouped(read: _Reader, near: np.ndarray, doc: np.ndarray, joined: np.ndarray, marked: np.ndarray, x: np.ndarray) -> None:
    """Features of numbers that are written in several words: four groups of four digits, phone numbers."""
    at = np.flatnonzero(marked[near])
    # Words before a number may be `(743)` or `+1`, which have digits too, so runs of marked words are all there is to see.
    for run in np.split(at, np.flatnonzero((np.diff(at) != 1) | ~joined[at[1:]]) + 1) if len(at) else ():
        if len(run) < 2:
            continue
        tokens = [read(int(near[k]), int(doc[k])) for k in run.tolist()]
        four = [_GROUP.fullmatch(t.strip(_MARKS)) is not None for t in tokens]
        k = 0
        while k < len(run):
            end = k
            while end < len(run) and four[end]:
                end += 1
            if end - k >= 4:
                years = all(_YEAR.fullmatch(t.strip(_MARKS)) for t in tokens[k:end])
                x[run[k:end], _AT["years" if years else "grouped"]], x[run[k:end], _AT["number"]] = 1, 0
            k = max(end, k + 1)
        phone = run[_phone_groups(tokens, [False] + [True] * (len(run) - 1))]
        x[phone, _AT["phone"]] = 1
        x[np.ix_(phone, [_AT["number"], _AT["area"], _AT["plus"]])] = 0


@dataclass
class Weights:
    unary: np.ndarray
    change: np.ndarray
    agree: np.ndarray


def _norm(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return top + np.log(np.exp(a - top).sum(axis, keepdims=True))


def _sent(belief: np.ndarray, pot: np.ndarray) -> np.ndarray:
    """Normalised log-messages over edges whose potential's exponential is the matrix `pot`."""
    out = np.exp(belief - belief.max(1, keepdims=True)) @ pot
    return np.log(out / out.sum(1, keepdims=True) + 1e-300)


def stationary(w: Weights, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Messages that a long run of plain words sends to the word after it, and to the word before it."""
    plain, out = w.unary[:, 0] + w.unary[:, _AT["plain"]], []
    for pot in (np.exp(w.change), np.exp(w.change).T):
        m = np.zeros((1, len(LABELS)))
        for _ in range(rounds):
            m = _sent(m + plain, pot)
        out.append(m[0])
    return out[0], out[1]


def propagate(g: Graph, w: Weights, x: np.ndarray | None = None, rounds: int = 60, tolerance: float = 1e-5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-marginals of the nodes, and expected transitions and agreements over the edges. Each round sends a message both ways
    over each edge of the texts that haven't settled; those over skip edges are damped."""
    unary = (g.x if x is None else x) @ w.unary.T
    before, after = stationary(w)
    unary[g.cut[0]] += before
    unary[g.cut[1]] += after
    n_chain = len(g.chain)
    a, b = np.concatenate([g.chain, g.skip]).T
    k = len(LABELS)
    to_a, to_b = np.full((len(a), k), -np.log(k)), np.full((len(a), k), -np.log(k))
    change, agree = np.exp(w.change), 1 + np.diag(np.expm1(w.agree))
    text = g.doc[a]
    live = np.arange(len(a))
    whole = lambda: _beliefs(unary, a, b, to_a, to_b, n_chain)
    belief = whole()
    for _ in range(rounds):
        if not len(live):
            break
        split = int(np.searchsorted(live, n_chain))
        ea, eb = belief[a[live]] - to_a[live], belief[b[live]] - to_b[live]
        new_b = np.concatenate([_sent(ea[:split], change), _sent(ea[split:], agree)])
        new_a = np.concatenate([_sent(eb[:split], change.T), _sent(eb[split:], agree)])
        moved = np.maximum(np.abs(new_a - to_a[live]).max(1), np.abs(new_b - to_b[live]).max(1))
        new_a[split:], new_b[split:] = (new_a[split:] + to_a[live[split:]]) / 2, (new_b[split:] + to_b[live[split:]]) / 2
        to_a[live], to_b[live] = new_a, new_b
        belief = whole()
        unsettled = np.zeros(int(text.max()) + 1, bool)
        unsettled[text[live[moved >= tolerance]]] = True
        live = live[unsettled[text[live]]]
    pa_, pb_ = (np.exp(v - v.max(1, keepdims=True)) for v in (belief[a] - to_a, belief[b] - to_b))
    chain, skip = slice(0, n_chain), slice(n_chain, None)
    z = np.einsum("ei,ij,ej->e", pa_[chain], change, pb_[chain])
    transitions = change * ((pa_[chain] / z[:, None]).T @ pb_[chain])
    z = np.einsum("ei,ij,ej->e", pa_[skip], agree, pb_[skip])
    agreements = (pa_[skip] * pb_[skip] / z[:, None]).sum(0) * np.exp(w.agree)
    return belief - _norm(belief, 1) if len(belief) else belief, transitions, agreements


def _beliefs(unary: np.ndarray, a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray, n_chain: int) -> np.ndarray:
    belief = unary.copy()
    belief[a[:n_chain]] += to_a[:n_chain]  # a node has one chain edge on either side
    belief[b[:n_chain]] += to_b[:n_chain]
    np.add.at(belief, a[n_chain:], to_a[n_chain:])
    np.add.at(belief, b[n_chain:], to_b[n_chain:])
    return belief


def pattern_labels(g: Graph) -> np.ndarray:
    """Labels that the features alone make certain: the sample's training labels."""
    f = {name: g.x[:, k] > 0 for k, name in enumerate(FEATURES)}
    gold = np.zeros(len(g.x), np.int64)
    gold[f["named"]] = _NAME
    gold[f["hex"] | (f["quoted"] & f["after_key"]) | f["assigned"] | (f["keyed"] & ~f["number"])] = _SECRET
    gold[(f["long_number"] & ~f["isbn"] & ~f["after_count"]) | f["grouped"]] = _CARD
    gold[f["phone"]] = _PHONE
    gold[f["ssn"] & ~f["after_count"]] = _ID
    gold[f["ip"] & ~f["after_version"]] = _IP
    gold[f["email"] | f["spelt"]] = _EMAIL
    for a, b in g.chain.tolist():
        if f["area"][a] and f["local"][b]:
            gold[[a, b]] = _PHONE
    for a, b in reversed(g.chain.tolist()):
        if f["plus"][a] and (gold[b] == _PHONE):
            gold[a] = _PHONE
    return gold


def drills(n: int = DRILLS, seed: int = 11) -> list[tuple[str, list]]:
    """Generated sentences and the (label number, first byte, end byte) of their entities: each kind in several contexts, half
    of them again far below without a context, and look-alikes that are none."""
    rng = np.random.default_rng(seed)
    pick = lambda *options: options[int(rng.integers(len(options)))]
    number = lambda k, first="123456789": pick(*first) + "".join(map(str, rng.integers(0, 10, k - 1)))
    letters = "etaoinshrdlu" * 20
    word = lambda lo=2, hi=9: "".join(letters[v] for v in rng.integers(0, 240, int(rng.integers(lo, hi))).tolist())
    octets = lambda: ".".join(str(int(v)) for v in rng.integers(0, 256, 4))
    hexes = lambda: "".join(rng.choice(list("0123456789abcdef"), int(rng.integers(24, 48)))) + "7"
    code = lambda: "".join(rng.choice(list("ABCDEFGHabcdefgh0123456789"), int(rng.integers(10, 30)))) + "4q"

    def one(k: int) -> tuple[str, str, int]:
        kind = k % 14
        if kind == 0:
            return pick("mail ", "write to ", "Email: ", ""), f"{word()}.{word()}@{word()}.{pick('org', 'net', 'com')}", _EMAIL
        if kind == 1:
            return pick("", "mail "), f"{word()} {pick('(at)', '[at]')} {word()} {pick('dot', '(dot)', '[dot]')} {pick('org', 'net', 'com')}", _EMAIL
        if kind == 2:
            return pick("call ", "phone: ", ""), pick(f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}", f"+{number(1)} ({number(3)}) {number(3)}-{number(4)}", f"+44 {number(2)} {number(4)} {number(4)}", f"0{number(3)} {number(3)} {number(4)}", f"{number(3)} {number(3)} {number(4)}"), _PHONE
        if kind == 3:
            return pick("host ", "from ", ""), octets(), _IP
        if kind == 4:
            return pick("card ", "paid with ", ""), pick(number(16), " ".join(number(4, "3456789") for _ in range(4)), "-".join(number(4) for _ in range(4))), _CARD
        if kind == 5:
            return pick('token = "', "api_key: ", "secret = ", "password is "), pick(hexes(), code()), _SECRET
        if kind == 6:
            return pick("password = ", "my password is ", "secret: ", "passphrase = "), word(9, 20), _SECRET
        if kind == 7:
            return pick("SSN ", "ssn: ", ""), f"{number(3)}-{number(2)}-{number(4)}", _ID
        if kind == 8:
            return pick("Mr. ", "Mrs ", "Dr. ", "my name is ", "Name: "), " ".join(word(3, 9).capitalize() for _ in range(int(rng.integers(1, 3)))), _NAME
        if kind == 9:
            return pick("in the years ", "of "), " ".join(str(int(v)) for v in rng.integers(1900, 2030, 4)), 0
        if kind == 10:
            return pick("ISBN ", "isbn: "), "978" + number(10), 0
        if kind == 11:
            return pick("order number ", "invoice ", "order no. "), number(int(rng.integers(13, 18))), 0
        if kind == 12:
            return "", pick("password=", "secret:", "api_key=", "auth=") + word(9, 20), _SECRET
        return pick("version ", "release "), ".".join(str(int(v)) for v in rng.integers(0, 20, 4)), 0

    out = []
    for k in range(n):
        before, value, label = one(k)
        tell = lambda m: " ".join(word() for _ in range(m))
        text, spans = f"{tell(int(rng.integers(1, 12)))} {before}", []
        for again in range(1 + int(k // 14 % 2 and (label or rng.random() < 0.5))):
            if again:
                text += f" {tell(int(rng.integers(20, 40)))} "
            if label:
                spans.append((label, len(text.encode()), len(text.encode()) + len(value.encode())))
            text += value + (pick("", '"') if '"' in before else "") + pick(" ", ". ", ", ")
        out.append((text + f" {tell(int(rng.integers(1, 12)))} {number(int(rng.integers(1, 5)))}.", spans))
    return out


def start_weights() -> Weights:
    """Weights to begin with: each shape speaks for its label."""
    w = Weights(np.zeros((len(LABELS), len(FEATURES))), np.zeros((len(LABELS),) * 2), np.ones(len(LABELS)))
    for label, shapes in ((_EMAIL, ("email", "spelt")), (_PHONE, ("phone",)), (_IP, ("ip",)), (_CARD, ("long_number", "grouped")), (_SECRET, ("hex", "assigned", "keyed")), (_ID, ("ssn",)), (_NAME, ("named",)), (0, ("bias", "number", "plain", "isbn", "years", "after_version", "after_count"))):
        w.unary[label, [_AT[s] for s in shapes]] = 3
    w.unary[_PHONE, [_AT["area"], _AT["local"]]] = 1
    w.change[_PHONE, _PHONE] = 3
    return w


def fit(texts: list, steps: int = 45, drop: float = 0.15, seed: int = 5) -> Weights:
    """Weights from texts labelled by pattern and from the drills."""
    drilled = drills()
    g, w = graph([*texts, *(t for t, _ in drilled)], NEAR), start_weights()
    gold, rng = pattern_labels(g), np.random.default_rng(seed)
    known = g.doc >= len(texts)
    gold[known] = 0
    bounds = np.searchsorted(g.doc, np.arange(len(texts), len(texts) + len(drilled) + 1))
    for k, (_, spans) in enumerate(drilled):
        lo, hi = bounds[k], bounds[k + 1]
        for label, a, b in spans:
            gold[lo:hi][(g.start[lo:hi] < b) & (g.end[lo:hi] > a)] = label
    every = np.eye(len(LABELS))[gold]
    seen = np.zeros_like(w.change)
    np.add.at(seen, (gold[g.chain[:, 0]], gold[g.chain[:, 1]]), 1)
    same = gold[g.skip[:, 0]]
    both = np.bincount(same[same == gold[g.skip[:, 1]]], minlength=len(LABELS))
    free = np.array([k for k in range(len(FEATURES)) if FEATURES[k] not in ("bias", "plain", "number")])
    moments = [np.zeros_like(v) for v in (w.unary, w.unary, w.change, w.change, w.agree, w.agree)]
    for k in range(1, steps + 1):
        x = g.x.copy()
        x[:, free] *= rng.random((len(x), 1)) >= drop
        node, transitions, agreements = propagate(g, w, x, rounds=4)
        n = len(x) / 100
        grads = (every - np.exp(node)).T @ x / n - 1e-3 * w.unary, (seen - transitions) / n - 1e-3 * w.change, (both - agreements) / max(1, len(g.skip) / 10) - 1e-3 * w.agree
        rate = 0.2 * (1 - 0.8 * k / steps)
        for i, (v, grad) in enumerate(zip((w.unary, w.change, w.agree), grads, strict=True)):
            m, s = moments[2 * i], moments[2 * i + 1]
            m += 0.2 * (grad - m)
            s += 0.02 * (grad * grad - s)
            v += rate * (m / (1 - 0.8**k)) / (np.sqrt(s / (1 - 0.98**k)) + 1e-3)
    return w


_JOINED = {"PHONE", "NAME"}


def entities(texts: list, w: Weights) -> list[list[tuple[str, int, int]]]:
    """(label, first byte, end byte) of each entity of each text; adjacent words of a phone number, of a name, of a spelt
    address or groups of a card's number are one entity."""
    found: list[list] = [[] for _ in texts]
    g = graph(texts)
    if not len(g.x):
        return found
    label = propagate(g, w)[0].argmax(1)
    raw: dict[int, bytes] = {}
    for k in np.flatnonzero(label).tolist():
        d, a, b = int(g.doc[k]), int(g.start[k]), int(g.end[k])
        if d not in raw:
            raw[d] = texts[d].encode("utf-8", "replace")
        token = raw[d][a:b]
        a += len(token) - len(token.lstrip(_MARKS))
        b -= len(token) - len(token.rstrip(_MARKS))
        name, spelt = LABELS[label[k]], g.x[k, _AT["spelt"]] > 0
        if b > a and found[d] and k and label[k - 1] == label[k] and g.doc[k - 1] == d and (name in _JOINED or spelt or (name == "CARD" and g.x[k, _AT["grouped"]])):
            gap = raw[d][found[d][-1][2] : a]
            if found[d][-1][0] == name and found[d][-1][2] >= int(g.end[k - 1]) - 3 and (SPACE[list(gap)].all() or (spelt and not gap.strip(b" []{}<>()")) or (name == "NAME" and gap.strip() == b".")):
                found[d][-1] = (name, found[d][-1][1], b)
                continue
        if b > a:
            found[d].append((name, a, b))
    return found


def redact(text: str, spans: list) -> str:
    raw, at, out = text.encode("utf-8", "replace"), 0, []
    for name, a, b in spans:
        out += [raw[at:a], b"<", name.encode(), b">"]
        at = b
    return b"".join([*out, raw[at:]]).decode("utf-8", "replace")


def fitted(docs: DataFrame) -> Weights:
    """Train on the TRAIN_ROWS documents with candidates of least hash."""
    known = docs.select(F.col("text").cast("string").alias("t")).where(F.col("t").rlike("[0-9@]")).withColumn("h", F.xxhash64("t"))
    return fit([r.t for r in sampled(known, "h", TRAIN_ROWS)])


def found(docs: DataFrame) -> DataFrame:
    """(doc_id, entities, redacted) of the documents with entities; bounds count bytes of the UTF-8 text."""
    w = fitted(docs)

    def search(texts: list) -> tuple[list, dict]:
        spans = entities(texts, w)
        rows = [[{"label": n, "start": a, "end": b} for n, a, b in s] for s in spans]
        kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return [bool(s) for s in spans], {"entities": pa.array(rows, kind), "redacted": pa.array([redact(t, s) if s else None for t, s in zip(texts, spans, strict=True)], pa.string())}

    return map_texts(docs, search, "entities array<struct<label:string,start:int,end:int>>, redacted string")


def redacted(docs: DataFrame) -> DataFrame:
    """`docs` with entities replaced by <LABEL> in the text."""
    w = fitted(docs)
    names = docs.columns
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            changed = {}
            for part in slices(np.array([len(t or "") for t in texts], np.int64), SLICE):
                for k, s in enumerate(entities(texts[part], w)):
                    if s:
                        changed[part.start + k] = redact(texts[part.start + k], s)
            columns = batch.columns
            if changed:
                columns[at] = pa.array([changed.get(k, t) for k, t in enumerate(texts)], columns[at].type)
                if size is not None and pa.types.is_integer(columns[size].type):
                    n = columns[size].to_pylist()
                    columns[size] = pa.array([len(changed[k]) if k in changed and v is not None else v for k, v in enumerate(n)], columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return map_arrow(docs, run, docs.schema)


def op2_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redacted(docs)
