"""Token counts by finite-state tokenizer compilation (operator 6).

A byte-pair tokenizer is compiled into two deterministic transducers:

* the splitter reads characters by class and marks where the tokenizer's pattern begins a new piece. It has nine states
  and a delay of one character. A batch is cut into chunks; each chunk's state map (where it leads from each of the nine
  states) is computed for all chunks at once, the maps are composed by a parallel prefix scan, and with the states so
  known the chunks are read once more for the marks;
* the counter reads a piece's bytes; each transition is annotated with the number of tokens that it adds (or takes back,
  where a longer token replaces some). A state holds what the rest can depend on: for each open start of a next token, its
  place in the vocabulary's trie, the token before it, and the tokens emitted since. Its transitions are compiled when they
  are first met and kept in a table of blocks of `BLOCK` bytes' columns, made where a state has a transition. Beyond `MOST_STATES`, looked at in every step, the table is emptied but for the
  states in use, which changes no result. Long pieces are cut into chunks whose state maps, of the entry states that
  occur, are made side by side and composed in order.

Counts are exactly the tokenizer's. The vocabulary is a rank file (`VOCABULARY`, a parameter), read where a task runs.

Defined results: null and empty texts have 0 tokens; texts and pieces may be of any length. Every row is counted, also with a null or repeated doc_id. Extra
columns are ignored; an empty table gives an empty result. Special tokens' strings are ordinary text.
"""

from __future__ import annotations

import base64
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from folioq.llm._spark import KEPT, map_texts, table

#: Place of the rank file. It must be readable wherever tasks run.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CHUNK = 128
#: Bound of the counter's table, in states. Few of a state's transitions ever occur, so its columns are kept in blocks.
MOST_STATES = 250_000
BLOCK = 16
#: The initial state: as each state, the bytes of triples (place, token before, tokens since) of 32-bit integers.
ROOT = array("i", (0, -1, 0)).tobytes()
#: Pieces of more bytes are counted in chunks of so many; bytes before a chunk that give its first entry state.
LONG, WARM = 1024, 64

# Classes of characters. R: r and v, which e may follow in a contraction; S: s, t, m, d.
_LETTER, _S, _R, _L, _E, _NUMBER, _SPACE, _WHITE, _QUOTE, _OTHER, _END = range(11)
# States of the splitter. BEGIN: whatever follows begins a piece; QUOTED: after a quote that may open a contraction.
_BEGIN, _WORD, _DIGITS, _MARKS, _BLANK, _WHITES, _QUOTED, _QUOTED_R, _QUOTED_L = range(9)
_HERE, _BACK = 1, 2  # a piece begins at this character, at the one before


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of each code point."""
    out = np.full(0x110000, _OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = _LETTER
        elif kind == "N":
            out[c] = _NUMBER
    out[[*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _WHITE
    for chars, kind in (("stmd", _S), ("rv", _R), ("l", _L), ("e", _E), (" ", _SPACE), ("'", _QUOTE)):
        out[[ord(c) for c in chars]] = kind
    return out


@lru_cache(1)
def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks for class * 9 + state."""

    def plain(kind: int, state: int) -> tuple[int, int]:
        if kind == _END:
            return _BEGIN, 0
        letter, white = kind <= _E, kind in (_SPACE, _WHITE)
        to = _WORD if letter else _DIGITS if kind == _NUMBER else _BLANK if kind == _SPACE else _WHITES if kind == _WHITE else _MARKS
        if state in (_BLANK, _WHITES):
            if white:
                return to, 0
            if state == _BLANK:
                return to, _BACK  # the last space belongs to what follows
            return (_QUOTED if kind == _QUOTE else to), _BACK | _HERE
        if kind == _QUOTE and state != _MARKS:
            return _QUOTED, _HERE
        same = (state, to) in ((_WORD, _WORD), (_DIGITS, _DIGITS), (_MARKS, _MARKS))
        return to, 0 if same else _HERE

    def step(kind: int, state: int) -> tuple[int, int]:
        if state == _QUOTED:
            if kind in (_S, _R, _L):
                return {_S: _BEGIN, _R: _QUOTED_R, _L: _QUOTED_L}[kind], 0
            return plain(kind, _MARKS)
        if (state, kind) in ((_QUOTED_R, _E), (_QUOTED_L, _L)):
            return _BEGIN, 0
        if state in (_QUOTED_R, _QUOTED_L):  # no contraction: the letter began a word
            to, mark = plain(kind, _WORD)
            return to, mark | _BACK
        return plain(kind, state)

    both = [step(kind, state) for kind in range(11) for state in range(9)]
    return np.array([a for a, _ in both], np.uint8), np.array([b for _, b in both], np.uint8)


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """State maps (9 x n, a column each) that apply `first`, then `then`."""
    return np.take_along_axis(then, first.astype(np.int64), 0)


def scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan of the composition of state maps, in a logarithmic number of steps."""
    maps, reach = maps.copy(), 1
    while reach < maps.shape[1]:
        maps[:, reach:] = compose(maps[:, :-reach], maps[:, reach:])
        reach *= 2
    return maps


def marks(kinds: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each character, given the characters' classes, texts separated by _END."""
    to, mark = splitter()
    n = len(kinds)
    lanes = -(-n // CHUNK)
    padded = np.full(lanes * CHUNK, _END, np.uint8)
    padded[:n] = kinds
    steps = np.ascontiguousarray(padded.reshape(lanes, CHUNK).T) * np.uint8(9)
    state = np.repeat(np.arange(9, dtype=np.uint8)[:, None], lanes, 1)
    for row in steps:
        state += row
        state = to[state]
    entry = np.r_[np.uint8(_BEGIN), scan(state)[_BEGIN, :-1]]
    out = np.empty((CHUNK, lanes), np.uint8)
    for k, row in enumerate(steps):
        at = entry + row
        out[k] = mark[at]
        entry = to[at]
    found = out.T.ravel()[:n]
    begins = (found & _HERE) > 0
    begins[:-1] |= (found[1:] & _BACK) > 0
    return begins


class Counter:
    """The byte transducer of a rank file."""

    def __init__(self, path: str, most: int = MOST_STATES):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.most = most
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        self.child: dict[int, int] = {}  # by place * 256 + byte
        self.token, self.inner = [-1], bytearray(1)
        for word, rank in self.ranks.items():
            self.bytes[rank] = word
            at = 0
            for c in word:
                nxt = self.child.get(at * 256 + c)
                if nxt is None:
                    nxt = self.child[at * 256 + c] = len(self.token)
                    self.token.append(-1)
                    self.inner[at] = 1
                    self.inner.append(0)
                at = nxt
            self.token[at] = rank
        self.restart()

    def restart(self, wide: int = 128 // BLOCK) -> None:
        self.fits: dict[int, bool] = {}
        self.state = {ROOT: 0}
        self.open = [ROOT]
        self.column = np.full(256, -1, np.int32)  # of each byte met
        self.byte: list[int] = []
        self.block = np.zeros((4096, wide), np.int32)  # of each state's columns; block 0 is empty
        self.blocks, self.pool = 1, np.full((4096, BLOCK), -1, np.int32)

    def meet(self, data: np.ndarray) -> None:
        """Give the bytes that are new a column of the table."""
        for c in np.flatnonzero((np.bincount(data, minlength=256) > 0) & (self.column < 0)).tolist():
            if len(self.byte) == self.block.shape[1] * BLOCK:
                self.block = np.concatenate([self.block, np.zeros_like(self.block)], 1)
            self.column[c] = len(self.byte)
            self.byte.append(c)

    def merged(self, word: bytes) -> list[int]:
        """Tokens of a piece by the merges themselves: the pair of least rank first, the leftmost of equals."""
        parts = [bytes([c]) for c in word]
        while len(parts) > 1:
            best, at = min((self.ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def follows(self, before: int, token: int) -> bool:
        """Whether the merges keep the two tokens apart. before = -1: whether they make the token at all."""
        key = before * len(self.bytes) + token
        known = self.fits.get(key)
        if known is None:
            if before < 0:
                known = self.merged(self.bytes[token]) == [token]
            else:
                known = self.merged(self.bytes[before] + self.bytes[token]) == [before, token]
            self.fits[key] = known
        return known

    def compile(self, state: int, column: int) -> None:
        """Add one transition. Of the tokens that end here, one fits what precedes it: it ends the piece so far."""
        moved, last, back, byte = [], -1, 0, self.byte[column]
        triples = iter(array("i", self.open[state]))
        for place, before, since in zip(triples, triples, triples, strict=True):
            nxt = self.child.get(place * 256 + byte)
            if nxt is not None:
                if last < 0 and self.token[nxt] >= 0 and self.follows(before, self.token[nxt]):
                    last, back = self.token[nxt], since
                if self.inner[nxt]:
                    moved.append((nxt, before, since))
        change = 1 - back
        key = array("i")
        for place, before, since in moved:
            key.extend((place, before, since + change))
        key.extend((0, last, 0))
        to = self.number(key.tobytes())
        block = self.block[state, column // BLOCK]
        if not block:
            if self.blocks == len(self.pool):
                self.pool = np.concatenate([self.pool, np.full_like(self.pool[: len(self.pool) // 2], -1)])
            block = self.block[state, column // BLOCK] = self.blocks
            self.blocks += 1
        self.pool[block, column % BLOCK] = to * 256 + change + 128

    def found(self, at: np.ndarray) -> np.ndarray:
        """Transitions of state * width + column; -1 for those not compiled."""
        return self.pool.reshape(-1)[self.block.reshape(-1)[at // BLOCK].astype(np.int64) * BLOCK + at % BLOCK]

    def afresh(self, state: np.ndarray) -> np.ndarray:
        """Empty the table but for the states in use, and give these their new numbers."""
        used, at = np.unique(state, return_inverse=True)
        keys = [self.open[k] for k in used.tolist()]
        columns, fits = (self.column, self.byte), {} if len(self.fits) > 4 * self.most else self.fits
        self.restart(self.block.shape[1])
        self.fits, (self.column, self.byte) = fits, columns
        return np.array([self.number(key) for key in keys], np.int64)[at]

    def number(self, key: bytes) -> int:
        """The state's number; a new one if it isn't known."""
        at = self.state.get(key)
        if at is None:
            at = self.state[key] = len(self.open)
            self.open.append(key)
            if at == len(self.block):
                self.block = np.concatenate([self.block, np.zeros_like(self.block)])
        return at

    def walk(self, column: np.ndarray, begin: np.ndarray, size: np.ndarray, keys: list | None = None) -> tuple[np.ndarray, list | None]:
        """Tokens that are added from each entry state (`keys`; the initial one for None) by column[begin : begin + size], and
        the states in the end if entry states were given. All lanes advance together; the table's bound holds at each step."""
        order = np.argsort(-size, kind="stable")
        begin, total, width = begin[order], np.zeros(len(size), np.int64), self.block.shape[1] * BLOCK
        active = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), "left")
        state = np.zeros(len(size), np.int64) if keys is None else np.array([self.number(keys[k]) for k in order.tolist()], np.int64)
        for k, n in enumerate(active.tolist()):
            at = state[:n] * width + column[begin[:n] + k]
            got = self.found(at)
            if (missing := got < 0).any():
                for x in np.unique(at[missing]).tolist():
                    self.compile(*divmod(x, width))
                got = self.found(at)
            state[:n] = got >> 8
            total[:n] += (got & 255) - 128
            if len(self.open) > self.most + len(state):
                state = self.afresh(state)
        out = np.empty_like(total)
        out[order] = total
        if keys is None:
            return out, None
        ends: list = [None] * len(size)
        for k, x in zip(order.tolist(), state.tolist(), strict=True):
            ends[k] = self.open[x]
        return out, ends

    def count(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of each piece data[start:end]. Pieces over LONG bytes are cut into chunks. A chunk's map, from entry state to
        tokens and exit state, begins with the state that WARM bytes before it lead to from the initial one, for all chunks
        at once; the maps are composed in order, and an entry state that a map lacks is added when it is met. Equal chunks
        share a map."""
        size = end - start
        self.meet(data)
        column = self.column[data]
        total = np.zeros(len(start), np.int64)
        short = np.flatnonzero(size <= LONG)
        if len(short):
            total[short] = self.walk(column, start[short], size[short])[0]
        for k in np.flatnonzero(size > LONG).tolist():
            at = np.arange(start[k], end[k], LONG)
            length = np.minimum(LONG, end[k] - at)
            warm = np.minimum(WARM, at - start[k])
            _, guess = self.walk(column, at - warm, warm, [ROOT] * len(at))
            added, ends = self.walk(column, at, length, guess)
            raw = [data[a : a + n].tobytes() for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            maps: dict[bytes, dict[bytes, tuple]] = {}
            for chunk, entry, n, out in zip(raw, guess, added.tolist(), ends, strict=True):
                maps.setdefault(chunk, {})[entry] = n, out
            now = ROOT
            for j, chunk in enumerate(raw):
                if now not in maps[chunk]:
                    n, out = self.walk(column, at[j : j + 1], length[j : j + 1], [now])
                    maps[chunk][now] = int(n[0]), out[0]
                n, now = maps[chunk][now]
                total[k] += n
        return total


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


KEPT.append(counter)


def token_counts(texts: list, model: Counter) -> np.ndarray:
    """Number of tokens of each text; None counts as empty."""
    whole = "\0".join(t or "" for t in texts) + "\0"
    points = np.frombuffer(whole.encode("utf-32-le", "replace"), np.uint32)
    ends = np.cumsum([len(t or "") + 1 for t in texts]) - 1
    kinds = classes()[points]
    kinds[ends] = _END
    data = np.frombuffer(whole.encode("utf-8", "replace"), np.uint8)
    char = np.flatnonzero((data & 0xC0) != 0x80)  # first byte of each character
    begins = np.flatnonzero(marks(kinds))
    text = np.searchsorted(ends, begins)
    # A piece ends where the next begins, the last one of a text at the text's end.
    after = np.r_[begins[1:], len(kinds)]
    after = np.minimum(after, ends[text])
    return np.bincount(text, model.count(data, char[begins], char[after]), len(texts)).astype(np.int64)


def counted(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens) of every row."""
    return map_texts(docs, lambda texts: (None, {"tokens": token_counts(texts, counter(vocabulary))}), "tokens long", keeps=counter)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(table(spark, sf_dir, "documents"))
