"""Token counts by finite-state tokenizer compilation (operator 10).

Two deterministic transducers, compiled from a public vocabulary file:

* the *splitter* runs over character classes and emits the starts of the
  pre-tokens (contractions, letters, numbers, other characters, white space).
  A chunk of text is cut into equal pieces; the state map of every piece (end
  state for each possible start state) is computed for all pieces at once, the
  maps are composed by a parallel prefix scan, and a last pass from the now
  known start states reads off the emitted starts;
* the *merger* runs over the bytes of one pre-token. Its state holds, for each
  start position whose bytes so far may still grow into a token, the trie node,
  the token before it and the tokens counted up to it; a transition is annotated
  with the change of the token count. It rests on two facts on byte-pair
  encoding: each prefix of an encoding is the encoding of that prefix, and a
  sequence is an encoding if all its neighbouring pairs are. States are
  determinised when first reached and kept, a bounded number of them. At the end
  of a pre-token every state becomes the start, so the maps of pre-tokens compose
  by adding their counts; a long pre-token is cut into chunks whose maps, from
  state to state and count, compose pairwise in a balanced tree.

The counts equal those of the library for the same file; nothing is cut off.
Null and empty texts have no tokens. Special strings inside a text count as the
library's default has it: one token each.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import buffers, map_chunks, span_hashes

SPACE, WHITE, LETTER, NUMBER, APOSTROPHE, OTHER, STMD, R, V, L, E, END = range(12)
N_CLASSES = 12
START, S_LETTER, S_NUMBER, S_OTHER, SPACE1, WHITE1, SPACES, WHITES, FRESH, DONE, FRESH_R, FRESH_V, FRESH_L = range(13)
N_STATES = 13
HERE, BEFORE = 1, 2
#: The merger's state before a pre-token: no token, nothing begun.
FRESH_STATE = (-1, ())
#: Bytes of a pre-token's chunk, and of what is read before one to find its likely first state.
CHUNK, OVERLAP = 4096, 256
#: White space as the pattern's \s has it (fixed values).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def char_classes() -> np.ndarray:
    """Class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    out[WHITE_SPACE] = WHITE
    for chars, kind in ((" ", SPACE), ("'", APOSTROPHE), ("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E)):
        out[[ord(x) for x in chars]] = kind
    return out


@functools.cache
def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emission (HERE, BEFORE: a pre-token starts at this or the previous character), by state and class."""
    begin = {SPACE: SPACE1, WHITE: WHITE1, NUMBER: S_NUMBER, APOSTROPHE: FRESH, OTHER: S_OTHER}
    letters = (LETTER, STMD, R, V, L, E)

    def fresh(c: int) -> tuple[int, int]:
        return begin.get(c, S_LETTER), HERE

    def step(s: int, c: int) -> tuple[int, int]:
        if c == END:
            return START, BEFORE if s in (FRESH_R, FRESH_V, FRESH_L) else 0
        if s == S_LETTER and c in letters or s == S_NUMBER and c == NUMBER or s == S_OTHER and c in (OTHER, APOSTROPHE):
            return s, 0
        if s in (SPACE1, WHITE1, SPACES, WHITES):
            if c in (SPACE, WHITE):
                return (SPACES if c == SPACE else WHITES), 0
            if s in (SPACE1, SPACES):  # the last space joins what follows
                return (S_OTHER if c == APOSTROPHE else fresh(c)[0]), BEFORE if s == SPACES else 0
            return fresh(c)[0], HERE | (BEFORE if s == WHITES else 0)
        if s == FRESH:
            if c in (OTHER, APOSTROPHE):
                return S_OTHER, 0
            if c in (STMD, R, V, L):
                return {STMD: DONE, R: FRESH_R, V: FRESH_V, L: FRESH_L}[c], 0
        if s in (FRESH_R, FRESH_V, FRESH_L):
            if c == (L if s == FRESH_L else E):
                return DONE, 0
            after, emits = step(S_LETTER, c)  # no contraction: a lone apostrophe, then letters
            return after, emits | BEFORE
        return fresh(c)

    table = np.array([[step(s, c) for c in range(N_CLASSES)] for s in range(N_STATES)], np.uint8)
    return table[..., 0].copy(), table[..., 1].copy()


def split(codes: np.ndarray, pieces: int = 2048) -> np.ndarray:
    """Positions in a stream of character classes at which pre-tokens start."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    after, emits = splitter()
    after, emits = after.ravel(), emits.ravel()
    pieces = max(1, min(pieces, n // 64))
    steps = -(-n // pieces)
    padded = np.full(pieces * steps, END, np.uint8)
    padded[:n] = codes
    grid = np.ascontiguousarray(padded.reshape(pieces, steps).T)
    maps = np.repeat(np.arange(N_STATES, dtype=np.uint8)[:, None], pieces, axis=1)
    for row in grid:
        maps = after.take(maps.astype(np.uint16) * np.uint16(N_CLASSES) + row)
    reach = 1
    while reach < pieces:  # prefix scan: compose each map with the one `reach` pieces before it
        composed = maps.copy()
        composed[:, reach:] = np.take_along_axis(maps[:, reach:], maps[:, :-reach], axis=0)
        maps, reach = composed, 2 * reach
    state = np.zeros(pieces, np.uint8)
    state[1:] = maps[START, :-1]
    out = np.empty_like(grid)
    for k, row in enumerate(grid):
        at = state.astype(np.uint16) * np.uint16(N_CLASSES) + row
        out[k], state = emits.take(at), after.take(at)
    flat = out.T.ravel()
    starts = (flat & HERE).astype(bool)
    starts[:-1] |= (flat[1:] & BEFORE).astype(bool)
    return np.flatnonzero(starts[:n])


class Pretokens:
    """The pre-tokens of a chunk: byte starts and ends, the document of each, a hash of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        text = bytes(data).decode("utf-8", "surrogatepass")
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n_docs = len(offsets) - 1
        is_lead = (data & 0xC0) != 0x80
        doc_chars = np.concatenate([[0], np.cumsum(is_lead)])[offsets]
        byte_at = np.append(np.flatnonzero(is_lead), len(data))
        stream = np.insert(char_classes()[points], doc_chars[1:], END)
        ends_at = doc_chars[1:] + np.arange(n_docs)
        starts = split(stream)
        self.doc = np.searchsorted(ends_at, starts)
        self.starts = byte_at[starts - self.doc]
        self.ends = np.append(self.starts[1:], 0)
        last = np.flatnonzero(np.append(np.diff(self.doc) != 0, True)) if len(starts) else np.zeros(0, np.int64)
        self.ends[last] = offsets[self.doc[last] + 1]
        self.data, self.n_docs = data, n_docs
        self.hashes = span_hashes(data, self.starts, self.ends)

    def distinct(self) -> tuple[list[bytes], np.ndarray]:
        """The distinct pre-tokens, and for each pre-token which of them it is."""
        _, first, inverse = np.unique(self.hashes, return_index=True, return_inverse=True)
        raw = bytes(self.data)
        return [raw[a:b] for a, b in zip(self.starts[first].tolist(), self.ends[first].tolist(), strict=True)], inverse


@functools.cache
def byte_of_char() -> dict[str, int]:
    """The printable characters that vocabulary files of byte-level encodings write for bytes."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merger:
    """The transducer over the bytes of one pre-token, compiled from the vocabulary and merges of `path`."""

    def __init__(self, path: str, states: int = 200_000):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, of = whole["model"], byte_of_char()
        raw = lambda s: bytes(of[c] for c in s)
        self.ids = {raw(s): i for s, i in model["vocab"].items() if all(c in of for c in s)}
        self.bytes = {i: s for s, i in self.ids.items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {(self.ids[raw(a)], self.ids[raw(b)]): k for k, (a, b) in enumerate(pairs)}
        self.parts = {self.ids[self.bytes[a] + self.bytes[b]]: (a, b, k) for (a, b), k in self.rank.items()}
        self.edges: tuple[dict, dict] = ({}, {})
        self.special = [x["content"] for x in whole["added_tokens"] if x["special"]]
        self.trie: list[dict[int, int]] = [{}]
        self.token = [-1]
        for s, i in self.ids.items():
            node = 0
            for b in s:
                if (below := self.trie[node].get(b)) is None:
                    below = self.trie[node][b] = len(self.trie)
                    self.trie.append({})
                    self.token.append(-1)
                node = below
            self.token[node] = i
        self.most_states, self.pairs = states, {}
        self.known: dict[bytes, int] = {}
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = [FRESH_STATE]
        self.number = {FRESH_STATE: 0}
        self.moves: dict[int, tuple[int, int]] = {}

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The sub-tokens at one edge of a token as merges build it (side 0: its first, 1: its last), each with the rank of the merge that ends it."""
        if (known := self.edges[side].get(token)) is None:
            known, ends = [], 1 << 30
            while token is not None:
                known.append((token, ends))
                parts = self.parts.get(token)
                ends, token = (parts[2], parts[side]) if parts else (0, None)
            known.reverse()
            self.edges[side][token if token is not None else known[-1][0]] = known
        return known

    def follows(self, a: int, b: int) -> bool:
        """Whether the encoding of the two tokens' bytes is the two tokens: no merge over their border comes first."""
        key = a << 20 | b
        if (known := self.pairs.get(key)) is not None:
            return known
        left, right, rank = self.edge(a, 1), self.edge(b, 0), self.rank
        i = j = 0
        known = True
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            r = rank.get((x, y), 1 << 30)
            if r < x_ends and r <= y_ends and r < 1 << 30:
                known = False
                break
            if x_ends <= y_ends:
                i += 1
                if i == len(left):
                    break
            else:
                j += 1
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        self.pairs[key] = known
        return known

    def move(self, state: int, byte: int) -> tuple[int, int]:
        """Next state and the change of the token count."""
        last, live = self.states[state]
        grown, found = [], None
        for node, before, counted in (*live, (0, last, 0)):
            if (below := self.trie[node].get(byte)) is None:
                continue
            grown.append((below, before, counted))
            t = self.token[below]
            if found is None and t >= 0 and (before < 0 or self.follows(before, t)):
                found = (t, counted + 1)
        if found is None:
            raise ValueError("the vocabulary lacks a byte")
        t, delta = found
        to = (t, tuple((n, b, c - delta) for n, b, c in grown if self.trie[n]))
        k = self.numbered(to)
        self.moves[state << 8 | byte] = (k, delta)
        return k, delta

    def numbered(self, state: tuple) -> int:
        if (k := self.number.get(state)) is None:
            k = self.number[state] = len(self.states)
            self.states.append(state)
        return k

    def run(self, state: tuple, data: bytes) -> tuple[tuple, int]:
        """State and tokens after some bytes from a state; at most `most_states` states are kept at a time."""
        at, total, moves = self.numbered(state), 0, self.moves
        for b in data:
            to = moves.get(at << 8 | b)
            if to is None:
                if len(self.states) > self.most_states:
                    here = self.states[at]
                    self.reset()
                    at, moves = self.numbered(here), self.moves
                to = self.move(at, b)
            at, delta = to
            total += delta
        return self.states[at], total

    def count(self, word: bytes) -> int:
        """Tokens of one pre-token."""
        if len(word) > CHUNK:
            return ChunkMap.of(self, word, 0, len(word)).apply(FRESH_STATE)[1]
        if (known := self.known.get(word)) is None:
            known = self.run(FRESH_STATE, word)[1]
            if len(word) <= 64:
                if len(self.known) > 400_000:
                    self.known.clear()
                self.known[word] = known
        return known


class ChunkMap:
    """The map of a range of bytes from a state to the state after it and the tokens in it, where it has been asked for.

    A range is one chunk, or two halves whose maps compose: the state after the
    first is where the second begins, and their counts add. Chunks are first
    mapped from the state that the bytes before them lead to from a fresh start,
    which nearly always is the state that composition finds; for another one the
    chunk is run again, so the result is exact.
    """

    def __init__(self, machine: Merger, data: bytes, halves: tuple[ChunkMap, ChunkMap] | None):
        self.machine, self.data, self.halves = machine, data, halves
        self.known: dict[tuple, tuple[tuple, int]] = {}

    @classmethod
    def of(cls, machine: Merger, word: bytes, begin: int, end: int) -> ChunkMap:
        if end - begin <= CHUNK:
            leaf = cls(machine, word[begin:end], None)
            leaf.apply(machine.run(FRESH_STATE, word[max(0, begin - OVERLAP) : begin])[0])
            return leaf
        middle = begin + -(-(end - begin) // CHUNK // 2) * CHUNK
        return cls(machine, b"", (cls.of(machine, word, begin, middle), cls.of(machine, word, middle, end)))

    def apply(self, state: tuple) -> tuple[tuple, int]:
        if (found := self.known.get(state)) is None:
            if self.halves:
                between, first = self.halves[0].apply(state)
                after, second = self.halves[1].apply(between)
                found = after, first + second
            else:
                found = self.machine.run(state, self.data)
            self.known[state] = found
        return found


@functools.cache
def merger(path: str) -> Merger:
    return Merger(path)


def without_special(column: pa.Array, special: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts cut at special strings: the parts, the document of each part, the special strings of each document."""
    rows = np.arange(len(column))
    n_special = np.zeros(len(column), np.int64)
    import pyarrow.compute as pc

    column = column.fill_null("")
    hit = np.zeros(len(column), bool)
    for s in special:
        hit |= pc.match_substring(column, s).to_numpy(zero_copy_only=False)
    if not hit.any():
        return column, rows, n_special
    parts, owner = [], []
    for k, text in enumerate(column.to_pylist()):
        pieces = [text]
        for s in special if hit[k] else []:
            pieces = [x for p in pieces for x in p.split(s)]
        n_special[k] = len(pieces) - 1
        parts += pieces
        owner += [k] * len(pieces)
    return pa.array(parts, pa.string()), np.array(owner), n_special


def count_column(column: pa.Array, path: str) -> np.ndarray:
    """Tokens of each text."""
    machine = merger(path)
    parts, owner, out = without_special(column, machine.special)
    tokens = Pretokens(*buffers(parts))
    if len(tokens.starts):
        words, which = tokens.distinct()
        each = np.array([machine.count(w) for w in words], np.int64)
        out = out + np.bincount(owner[tokens.doc], weights=each[which], minlength=len(out)).astype(np.int64)
    return out


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep`, and n_bytes (UTF-8) and n_tokens of every row, in place of kept columns of those names.

    No shuffle: each task reads texts and writes two numbers. `vocabulary` is the
    path of a byte-level BPE file that all executors can read. A null text has no
    bytes and no tokens; rows are kept as they are, repeated ids included; an
    empty table gives an empty result; further columns are not read; a very long
    text is counted whole.
    """
    keep = tuple(c for c in keep if c not in ("n_bytes", "n_tokens"))
    rows = docs.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text") + ", n_bytes long, n_tokens long"

    def count(chunk: pa.RecordBatch) -> dict[str, object]:
        column = chunk.column("__text")
        return {c: chunk.column(c) for c in keep} | {"n_bytes": np.diff(buffers(column)[1]), "n_tokens": count_column(column, vocabulary)}

    return map_chunks(rows, count, schema, "__text")


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every document for the 50k byte-level vocabulary."""
    import public_tokenizers

    from .text import table

    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))

