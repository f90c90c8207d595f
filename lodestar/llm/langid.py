"""Language identification by segmentation-marginalised unigrams (operator 9).

Each language has a probability for every piece of a fixed public vocabulary. A
word's likelihood is the sum over all its segmentations into pieces, computed by
a forward algorithm along a trie of the vocabulary, for all distinct words of a
chunk and all languages at once; a text's is the product over its words. A long
word, as in scripts without spaces, is taken whole: where no piece of the
vocabulary crosses a place, all segmentations part there and the sum is the
product of both sides; what still is long is summed byte by byte in logarithms.
Sums are scaled on the way, so no likelihood becomes zero, however rare pieces are.

The probabilities come from all documents with a language: a forward-backward
pass with weights that do not depend on the language gives the expected count of
each piece in each word, and these are summed by language. A task keeps one
vector of counts for each language; the sums have a row for each language and
piece at most, whatever the size of the input.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Words, buffers, chunks, map_chunks, table

#: Languages that a model may have; each costs one number for each piece.
MAX_LANGUAGES = 500
#: Bytes of the longest piece that is used, and of the parts of words that one pass takes together.
LONGEST_PIECE, PART = 32, 64
#: Words of one forward pass, and the numbers that it may hold.
_BLOCK, _CELLS = 16_384, 8 << 20
#: Every byte counts as this factor, so that products stay in the range of doubles; sums are scaled after so many bytes.
_LIFT, _SCALE_EVERY = 16.0, 8
#: Weights that find the expected counts: of a piece, and of a single byte.
_PIECE, _SINGLE = 1e-2, 1e-4
#: Words are runs of a-z (after lower-casing A-Z) and all bytes beyond ASCII.
LETTERS = np.array([0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
_SPACE = 0x20


def vocabulary_pieces(path: str) -> list[bytes]:
    """The pieces of a sentencepiece file, with a space for the word mark, and a piece for each single byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    usable = [p for p in plain if p and len(p) <= LONGEST_PIECE and all(LETTERS[b] for b in (p[1:] if p[0] == _SPACE else p))]
    return sorted({*usable, *(bytes([b]) for b in [_SPACE, *np.flatnonzero(LETTERS).tolist()])})


class Trie:
    """The pieces as a table: next node by node and byte, piece by node."""

    def __init__(self, pieces: list[bytes]):
        self.symbol = np.full(256, 0, np.int64)
        used = [_SPACE, *np.flatnonzero(LETTERS).tolist()]
        self.symbol[used] = np.arange(len(used))
        children: list[dict[int, int]] = [{}]
        piece = [-1]
        for number, p in enumerate(pieces):
            node = 0
            for b in p:
                if (below := children[node].get(b)) is None:
                    below = children[node][b] = len(children)
                    children.append({})
                    piece.append(-1)
                node = below
            piece[node] = number
        self.width = len(used)
        self.next = np.zeros(len(children) * self.width, np.int32)
        for node, of in enumerate(children):
            for b, below in of.items():
                self.next[node * self.width + self.symbol[b]] = below
        self.piece = np.array(piece, np.int64)
        self.single = np.array([len(p) == 1 for p in pieces])

    def steps(self, grid: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(begin, end, words, pieces) of all pieces in the words, by begin; words must come longest first."""
        alive = len(lengths) - np.searchsorted(lengths[::-1], np.arange(grid.shape[1] + 1), "right")
        for begin in range(grid.shape[1]):
            at, node = np.arange(alive[begin]), np.zeros(alive[begin], np.int32)
            for end in range(begin + 1, grid.shape[1] + 1):
                if alive[end - 1] < len(at):
                    more = np.searchsorted(at, alive[end - 1])
                    at, node = at[:more], node[:more]
                node = self.next[node * self.width + grid[at, end - 1]]
                on = node > 0
                at, node = at[on], node[on]
                if not len(at):
                    break
                piece = self.piece[node]
                whole = piece >= 0
                yield begin, end, at[whole], piece[whole]

    def reach(self, data: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """End of the longest piece from each place, within the word that ends at `ends`."""
        out, live, node = at + 1, np.arange(len(at)), np.zeros(len(at), np.int64)
        for k in range(LONGEST_PIECE):
            fits = at[live] + k < ends[live]
            live, node = live[fits], node[fits]
            node = self.next[node * self.width + self.symbol[data[at[live] + k]]]
            on = node > 0
            live, node = live[on], node[on]
            if not len(live):
                break
            whole = self.piece[node] >= 0
            out[live[whole]] = at[live[whole]] + k + 1
        return out

    def arcs(self, symbols: np.ndarray) -> list[list[tuple[int, int]]]:
        """(end, piece) of all pieces from each place of one long part."""
        follow, piece, width, n = self.next, self.piece, self.width, len(symbols)
        symbols = symbols.tolist()
        out = []
        for begin in range(n):
            node, here = 0, []
            for end in range(begin, min(n, begin + LONGEST_PIECE)):
                node = int(follow[node * width + symbols[end]])
                if not node:
                    break
                if piece[node] >= 0:
                    here.append((end + 1, int(piece[node])))
            out.append(here)
        return out


@functools.lru_cache(4)
def trie(pieces: tuple[bytes, ...]) -> Trie:
    return Trie(list(pieces))


class Runs:
    """The distinct words of a chunk; those longer than PART bytes as the parts between places that no piece crosses."""

    def __init__(self, words: Words, t: Trie):
        _, first, self.inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        starts, ends = words.starts[first], words.ends[first]
        self.n, self.data, self.symbol = len(first), words.data, t.symbol
        long = ends - starts > PART
        self.word, self.start, self.end = np.flatnonzero(~long), starts[~long], ends[~long]
        self.marked = np.ones(len(self.word), bool)
        if long.any():
            # the mark before the word takes part: its longest piece may cross the first cuts
            length = (ends - starts)[long]
            offs = np.cumsum(length + 1) - length - 1
            marked = np.zeros(int((length + 1).sum()), np.uint8)
            marked[offs] = _SPACE
            inside = np.ones(len(marked), bool)
            inside[offs] = False
            owner = np.repeat(np.arange(len(length)), length + 1)
            source = np.arange(len(marked)) - offs[owner] + starts[long][owner] - 1
            marked[inside] = words.data[source[inside]]
            reach = t.reach(marked, np.arange(len(marked)), (offs + length + 1)[owner])
            cut = np.append(True, np.maximum.accumulate(reach)[:-1] <= np.arange(1, len(marked)))
            begin = np.flatnonzero(cut)
            end = np.append(begin[1:], len(marked))
            self.word = np.concatenate([self.word, np.flatnonzero(long)[owner[begin]]])
            self.start = np.concatenate([self.start, source[begin] + ~inside[begin]])
            self.end = np.concatenate([self.end, source[end - 1] + 1])
            self.marked = np.concatenate([self.marked, ~inside[begin]])
        self.length = self.end - self.start + self.marked
        self.long = np.flatnonzero(self.length > PART + 1)

    def blocks(self, wide: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(word of each part, symbols, lengths), longest first, without the long parts; `wide` numbers are kept for each byte."""
        order = np.argsort(-self.length, kind="stable")[len(self.long) :]
        size = max(64, min(_BLOCK, _CELLS // (wide * (PART + 2))))
        for k in range(0, len(order), size):
            at = order[k : k + size]
            n = self.length[at]
            place = self.start[at, None] + np.arange(n[0]) - self.marked[at, None]
            inside = np.arange(n[0]) < n[:, None]
            byte = self.data[np.where(inside, np.clip(place, 0, len(self.data) - 1), 0)]
            byte[self.marked[at], 0] = _SPACE
            yield self.word[at], self.symbol[byte], n

    def long_parts(self) -> Iterator[tuple[int, np.ndarray]]:
        """(word, symbols) of each long part."""
        for k in self.long.tolist():
            symbols = self.symbol[self.data[self.start[k] : self.end[k]]]
            yield int(self.word[k]), np.append(self.symbol[_SPACE], symbols) if self.marked[k] else symbols


def expected_counts(words: Words, language: np.ndarray, n_languages: int, pieces: tuple[bytes, ...]) -> np.ndarray:
    """Expected pieces by language: a forward-backward pass in which all segmentations count, those into fewer pieces more."""
    t = trie(pieces)
    weight = np.where(t.single, _SINGLE, _PIECE)
    out = np.zeros((n_languages, len(pieces)))
    runs = Runs(words, t)
    times = np.bincount(runs.inverse * n_languages + language[words.doc], minlength=runs.n * n_languages).reshape(runs.n, n_languages)
    for word, grid, lengths in runs.blocks():
        alpha, beta = np.zeros((2, len(word), grid.shape[1] + 1))
        alpha[:, 0] = 1
        rows = np.arange(len(word))
        seen = []
        for step in t.steps(grid, lengths):
            begin, end, at, piece = step
            alpha[at, end] += alpha[at, begin] * weight[piece] * _LIFT ** (end - begin)
            seen.append(step)
        beta[rows, lengths] = 1
        whole = 1 / alpha[rows, lengths]
        own = times[word]
        for begin, end, at, piece in reversed(seen):
            onward = weight[piece] * _LIFT ** (end - begin) * beta[at, end]
            beta[at, begin] += onward
        for begin, end, at, piece in seen:
            share = alpha[at, begin] * weight[piece] * _LIFT ** (end - begin) * beta[at, end] * whole[at]
            for k in range(n_languages):
                out[k] += np.bincount(piece, weights=share * own[at, k], minlength=len(pieces))
    for word, symbols in runs.long_parts():
        _count_long(t.arcs(symbols), np.log(weight), times[word], out)
    return out


def _count_long(arcs: list[list[tuple[int, int]]], log_weight: np.ndarray, times: np.ndarray, out: np.ndarray) -> None:
    """Add the expected pieces of one long part, in logarithms."""
    n = len(arcs)
    low, cost = -math.inf, log_weight.tolist()
    alpha, beta = [low] * (n + 1), [low] * (n + 1)
    alpha[0] = beta[n] = 0.0

    def both(x: float, y: float) -> float:
        high, less = (x, y) if x > y else (y, x)
        return high if less == low else high + math.log1p(math.exp(less - high))

    for begin, here in enumerate(arcs):
        for end, piece in here:
            alpha[end] = both(alpha[end], alpha[begin] + cost[piece])
    for begin in range(n - 1, -1, -1):
        for end, piece in arcs[begin]:
            beta[begin] = both(beta[begin], beta[end] + cost[piece])
    share: dict[int, float] = {}
    for begin, here in enumerate(arcs):
        for end, piece in here:
            share[piece] = share.get(piece, 0.0) + math.exp(alpha[begin] + cost[piece] + beta[end] - alpha[n])
    at = np.fromiter(share, np.int64, len(share))
    out[:, at] += times[:, None] * np.fromiter(share.values(), np.float64, len(share))


@dataclass
class Model:
    """Languages in order, log priors, and the pieces' probabilities (piece by language)."""

    languages: list[str]
    prior: np.ndarray
    probability: np.ndarray
    pieces: tuple[bytes, ...]

    def word_scores(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihood of each distinct word by language, and which of them each word is."""
        t = trie(self.pieces)
        runs = Runs(words, t)
        n_languages = len(self.languages)
        out = np.zeros((runs.n, n_languages))
        for word, grid, lengths in runs.blocks(n_languages):
            alpha = np.zeros((grid.shape[1] + 1, len(word), n_languages))
            alpha[0] = 1
            scale = np.zeros((len(word), n_languages))
            scaled = 0
            for begin, end, at, piece in t.steps(grid, lengths):
                if begin >= scaled + _SCALE_EVERY:  # the longer words come first
                    scaled = begin
                    live = alpha[begin : begin + LONGEST_PIECE, : np.searchsorted(-lengths, -begin)]
                    most = live.max(axis=0)
                    live /= most
                    scale[: len(most)] += np.log(most)
                alpha[end, at] += alpha[begin, at] * (self.probability[piece] * _LIFT ** (end - begin))
            np.add.at(out, word, np.log(alpha[lengths, np.arange(len(word))]) + scale)
        logs = np.log(self.probability) if len(runs.long) else None
        for word, symbols in runs.long_parts():
            arcs, n = t.arcs(symbols), len(symbols)
            ring = np.full((LONGEST_PIECE + 1, n_languages), -np.inf)
            ring[0] = 0
            for begin, here in enumerate(arcs):
                own = ring[begin % len(ring)].copy()
                ring[begin % len(ring)] = -np.inf
                for end, piece in here:
                    ring[end % len(ring)] = np.logaddexp(ring[end % len(ring)], own + logs[piece])
            out[word] += ring[n % len(ring)] + n * np.log(_LIFT)
        return out, runs.inverse


def fit(docs: DataFrame, vocabulary: str, lang: str = "lang", text: str = "text", smooth: float = 0.05) -> Model:
    """Learn from every row that has a text and a language, repeated rows included; runs the count when called.

    An empty table gives a model without languages; other columns are not read.
    """
    pieces = tuple(vocabulary_pieces(vocabulary))
    rows = docs.select(F.col(lang).cast("string").alias("__lang"), F.col(text).alias("__text")).filter("`__lang` is not null and `__text` is not null")
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[str, int] = {}
        total, n_docs = np.zeros((0, len(shared.value))), np.zeros(0)
        for chunk in chunks(batches, "__text"):
            language = np.array([of.setdefault(x, len(of)) for x in chunk.column("__lang").to_pylist()])
            if len(of) > len(total):
                total = np.pad(total, ((0, len(of) - len(total)), (0, 0)))
                n_docs = np.pad(n_docs, (0, len(of) - len(n_docs)))
            n_docs += np.bincount(language, minlength=len(of))
            here, local = np.unique(language, return_inverse=True)
            words = Words(*buffers(chunk.column("__text")), LETTERS, lower=True)
            if len(words.hashes):
                total[here] += expected_counts(words, local, len(here), shared.value)
        names = list(of)
        k, piece = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([
            pa.array([names[i] for i in k] + names, pa.string()), pa.array(np.concatenate([piece, np.full(len(names), -1)]).astype(np.int64)),
            pa.array(np.concatenate([total[k, piece], n_docs]).astype(np.float64)),
        ], ["language", "piece", "n"])

    sums = rows.mapInArrow(count, "language string, piece long, n double").groupBy("language", "piece").agg(F.sum("n").alias("n"))
    got = sums.toArrow()  # a row for each language and piece at most
    languages = sorted(pc.unique(got.column("language")).to_pylist())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"a model may have {MAX_LANGUAGES} languages; the table has {len(languages)}")
    counts, n_docs = np.zeros((len(languages), len(pieces))), np.zeros(len(languages))
    if languages:
        row = pc.index_in(got.column("language"), value_set=pa.array(languages, pa.string())).to_numpy()
        piece, n = got.column("piece").to_numpy(), got.column("n").to_numpy()
        n_docs[row[piece < 0]] = n[piece < 0]
        counts[row[piece >= 0], piece[piece >= 0]] = np.round(n[piece >= 0], 6)
    probability = (counts + smooth) / (counts + smooth).sum(axis=1, keepdims=True) if len(languages) else counts
    return Model(languages, np.log((n_docs + 1) / (n_docs + 1).sum()) if len(languages) else n_docs, np.ascontiguousarray(probability.T), pieces)


def identify(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep`, and lang_pred and score (its posterior probability) of every row, in place of kept columns of those names.

    A null text, or one without a letter, is `und` with the score 0, and so is
    every text if the model has no language. Texts and words of any length are
    scored whole. Of languages that are equally likely the first by name is taken.
    Repeated rows are judged each; an empty table gives an empty result; other
    columns are not read.
    """
    keep = tuple(c for c in keep if c not in ("lang_pred", "score"))
    rows = docs.select(*keep, F.col(text).alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text") + ", lang_pred string, score double"

    def work(chunk: pa.RecordBatch) -> dict[str, object]:
        m, column = shared.value, chunk.column("__text")
        data, offsets = buffers(column)
        words = Words(data, offsets, LETTERS, lower=True)
        n = len(column)
        if not m.languages:
            return {c: chunk.column(c) for c in keep} | {"lang_pred": ["und"] * n, "score": np.zeros(n)}
        total = np.tile(m.prior, (n, 1))
        if len(words.hashes):
            scores, which = m.word_scores(words)
            for k in range(len(m.languages)):
                total[:, k] += np.bincount(words.doc, weights=scores[which, k], minlength=n)
        best = total.argmax(axis=1)
        posterior = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        ascii_letters = np.concatenate([[0], np.cumsum(LETTERS[words.data] & (words.data < 0x80))])
        letters = np.diff(ascii_letters[offsets]) > 0
        for i in np.flatnonzero(~letters & (words.counts > 0)).tolist():
            letters[i] = any(c.isalpha() for c in column[i].as_py())
        return {c: chunk.column(c) for c in keep} | {"lang_pred": [m.languages[k] if on else "und" for k, on in zip(best.tolist(), letters.tolist(), strict=True)], "score": np.where(letters, posterior, 0.0)}

    return map_chunks(rows, work, schema, "__text")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    import public_tokenizers

    from .toxicity import held_out

    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out()).select("lang", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
