"""Toxicity by a lexicon with misspellings and context (operator 8).

The lexicon is learned: words that labelled toxic documents hold far more often
than others, each distinct text counted once. Its terms form a trie. The distinct
words of a chunk are matched by running a Levenshtein automaton along the trie:
one edit for terms of five letters or more, two from nine on. Before that, a
vectorised test keeps the words that share a piece with a term, which every word
within the distance does (a term is cut into one piece more than edits).

Each match is scored in its window of words: learned weights of the words around
it and quotation marks separate a quoted term from an abusive one. A logistic
regression over the counts and window scores gives the score of the document.

The fit uses a bounded sample of the labelled rows (`sample`); the lexicon and
the context words are some of its words, and so bounded, and broadcast. Scoring reads every
whole text, without a shuffle.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import ALNUM, Spans, Words, binary_column, buffers, bytes_of, map_chunks, materialise, mix, span_hashes, table

#: Labelled rows of the fit.
SAMPLE = 20_000
#: Bytes of a term, and toxic texts that hold it, at least.
LEAST_BYTES, LEAST_TEXTS = 3, 3
#: Words on each side of a match.
WINDOW = 6
FEATURES = 7
#: Quotation marks; those that open and those that close if the words around do not say otherwise (fixed values).
_OPENING, _CLOSING, _EITHER = "«„‹", "»”›", '"“'


def letters(word: bytes) -> list[int]:
    """Code points of a word: an edit changes one of them, however many bytes it has."""
    return [ord(c) for c in word.decode("utf-8", "replace")]


def plain_words(column: pa.Array) -> tuple[Words, np.ndarray]:
    """The words of texts, with marks beyond ASCII (typographic quotes and dashes, no-break spaces, CJK stops) taken as spaces; and the bytes as they were."""
    data, offsets = buffers(column)
    out = data.copy()
    if len(data) > 2:
        a, b, c = data[:-2], data[1:-1], data[2:]
        three = ((a == 0xE2) & (b == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c < 0x92))  # U+2000 to U+203F, U+3000 to U+3011
        at = np.flatnonzero(three)
        out[at] = out[at + 1] = out[at + 2] = 0x20
    if len(data) > 1:
        at = np.flatnonzero((data[:-1] == 0xC2) & (data[1:] >= 0xA0) & ~np.isin(data[1:], [0xAA, 0xB5, 0xBA]))  # Latin-1 signs, not its letters
        out[at] = out[at + 1] = 0x20
    return Words(out, offsets, ALNUM, lower=True), data


def edits_for(term: bytes) -> int:
    """Edits that a misspelling of the term may have."""
    n = len(letters(term))
    return 0 if n < 5 else 1 if n < 9 else 2


class Lexicon:
    """Terms with weights, as a trie that Levenshtein automata run along."""

    def __init__(self, terms: dict[bytes, float]):
        self.terms = list(terms)
        self.weight = np.array([terms[t] for t in self.terms], np.float64)
        self.number = {t: i for i, t in enumerate(self.terms)}
        children: list[dict[int, int]] = [{}]
        term, edits, shortest, longest = [-1], [0], [255], [0]
        spelled = [letters(t) for t in self.terms]
        for i, t in enumerate(spelled):
            node, k = 0, edits_for(self.terms[i])
            for b in (*t, None):
                # what holds for all terms below a node cuts the search short
                edits[node], shortest[node], longest[node] = max(edits[node], k), min(shortest[node], len(t) - k), max(longest[node], len(t) + k)
                if b is None:
                    break
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    for column, start in ((term, -1), (edits, 0), (shortest, 255), (longest, 0)):
                        column.append(start)
                node = children[node][b]
            term[node] = i
        self.term, self.edits, self.shortest, self.longest = (np.array(c, np.int64) for c in (term, edits, shortest, longest))
        self.begin = np.concatenate([[0], np.cumsum([len(c) for c in children])])
        self.letter = np.array([b for c in children for b in c], np.int64)
        self.below = np.array([n for c in children for n in c.values()], np.int64)
        self.allowed = np.array([edits_for(t) for t in self.terms], np.int64)
        # pieces of the terms by (place, length), with the word's length: a word within the distance has one of them there
        pieces: dict[tuple[int, int], set[tuple[tuple[int, ...], int]]] = {}
        for term, t in zip(self.terms, spelled, strict=True):
            k = edits_for(term)
            cuts = [len(t) * i // (k + 1) for i in range(k + 2)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                for shift in range(-k, k + 1):
                    if x + shift >= 0:
                        pieces.setdefault((x + shift, y - x), set()).update((tuple(t[x:y]), n) for n in range(len(t) - k, len(t) + k + 1))
        self.pieces = {}
        for at, of in pieces.items():
            data = np.array([c for p, _ in of for c in p], np.uint32)
            starts = np.arange(len(of)) * at[1]
            lengths = np.array([n for _, n in of], np.uint64)
            self.pieces[at] = np.sort(mix(span_hashes(data, starts, starts + at[1]) ^ lengths))

    def candidates(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which of the words, spans of the code points `data`, can be within the distance of a term."""
        out = np.zeros(len(starts), bool)
        live = np.flatnonzero((ends - starts >= self.shortest[0]) & (ends - starts <= self.longest[0])) if self.terms else np.zeros(0, np.int64)
        lengths = (ends - starts).astype(np.uint64)
        spans = Spans(data) if len(live) else None
        for (at, length), known in self.pieces.items():
            fit = live[~out[live] & (starts[live] + at + length <= ends[live])]
            if len(fit):
                h = mix(spans.hashes(starts[fit] + at, starts[fit] + at + length) ^ lengths[fit])
                out[fit[known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h]] = True
        return out

    def match(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(term, edits) of the nearest term of each word, the heavier one of equals; -1 if none is near enough."""
        term, edits = np.full(len(words), -1), np.full(len(words), -1)
        for begin in range(0, len(words), 2048):
            term[begin : begin + 2048], edits[begin : begin + 2048] = self._run(words[begin : begin + 2048])
        return term, edits

    def _run(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Run the automata of all words along the trie together, level by level.

        A state is the row of distances between the trie's path and each prefix of
        the word; it dies when no term below can be near enough.
        """
        spelled = [letters(w) for w in words]
        size = np.array([len(w) for w in spelled])
        wide = int(size.max())
        grid = np.zeros((len(words), wide), np.int32)
        for i, w in enumerate(spelled):
            grid[i, : len(w)] = w
        word, node = np.arange(len(words)), np.zeros(len(words), np.int64)
        rows = np.tile(np.arange(wide + 1, dtype=np.int16), (len(words), 1))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(word):
            fan = self.begin[node + 1] - self.begin[node]
            parent = np.repeat(np.arange(len(word)), fan)
            at = np.repeat(self.begin[node] - np.cumsum(fan) + fan, fan) + np.arange(fan.sum())
            child, n = self.below[at], size[word[parent]]
            fits = (n >= self.shortest[child]) & (n <= self.longest[child])
            parent, at, child = parent[fits], at[fits], child[fits]
            if not len(parent):
                break
            old, letter = rows[parent], self.letter[at]
            word = word[parent]
            new = np.empty_like(old)
            new[:, 0] = old[:, 0] + 1
            replaced = np.minimum(old[:, :-1] + (grid[word] != letter[:, None]), old[:, 1:] + 1)
            for i in range(wide):
                np.minimum(replaced[:, i], new[:, i] + 1, out=new[:, i + 1])
            live = new.min(axis=1) <= self.edits[child]
            word, node, rows = word[live], child[live], new[live]
            t = self.term[node]
            distance = rows[np.arange(len(word)), size[word]]
            hit = (t >= 0) & (distance <= self.allowed[t])
            found.append((word[hit], t[hit], distance[hit].astype(np.int64)))
        term, edits = np.full(len(words), -1), np.full(len(words), -1)
        if found:
            w, t, d = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((t, -self.weight[t], d, w))
            first = order[np.append(True, np.diff(w[order]) != 0)] if len(order) else order
            term[w[first]], edits[w[first]] = t[first], d[first]
        return term, edits


@dataclass
class Model:
    """What scoring needs: terms, context weights by word hash, weights of the features."""

    terms: dict[bytes, float]
    context: dict[int, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    centre: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES - 1))
    scale: np.ndarray = field(default_factory=lambda: np.ones(FEATURES - 1))

    @functools.cached_property
    def lexicon(self) -> Lexicon:
        return Lexicon(self.terms)

    @functools.cached_property
    def context_table(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.array(sorted(self.context), np.int64)
        return keys, np.array([self.context[k] for k in keys.tolist()], np.float64)

    @functools.cached_property
    def known(self) -> dict[bytes, tuple[int, int]]:
        """Matches of words seen before, a bounded number of them."""
        return {}

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("terms", "context", "weights", "centre", "scale")}


class Matches:
    """The matches of a chunk: index of the word, weight, edits, whether it stands in quotation marks."""

    def __init__(self, column: pa.Array, model: Model):
        self.words, whole = plain_words(column)
        words = self.words
        _, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        lexicon, raw, known = model.lexicon, bytes(words.data), model.known
        points = np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        place = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])  # code points before each byte
        maybe = np.flatnonzero(lexicon.candidates(points, place[words.starts[first]], place[words.ends[first]]))
        weight, edits = np.zeros(len(first)), np.full(len(first), -1)
        spelled = [raw[a:b] for a, b in zip(words.starts[first[maybe]].tolist(), words.ends[first[maybe]].tolist(), strict=True)]
        if len(known) > 500_000:
            known.clear()
        if fresh := [w for w in spelled if w not in known]:
            known.update(zip(fresh, zip(*(x.tolist() for x in lexicon.match(fresh)), strict=True), strict=True))
        for i, w in zip(maybe.tolist(), spelled, strict=True):
            term, edits[i] = known[w]
            weight[i] = lexicon.weight[term] if term >= 0 else 0
        self.at = np.flatnonzero(edits[inverse] >= 0) if len(first) else np.zeros(0, np.int64)
        self.weight, self.edits = weight[inverse[self.at]], edits[inverse[self.at]]
        self.doc = words.doc[self.at]
        begins, closes = quotations(whole, words.offsets)
        k = np.searchsorted(begins, words.starts[self.at], "right") - 1
        self.quoted = ((k >= 0) & (words.starts[self.at] < closes[k])).astype(float) if len(begins) else np.zeros(len(self.at))

    def around(self) -> tuple[np.ndarray, np.ndarray]:
        """(match, word) for the words in the windows, within the same text."""
        steps = np.array([s for s in range(-WINDOW, WINDOW + 1) if s])
        match = np.repeat(np.arange(len(self.at)), len(steps))
        word = (self.at[:, None] + steps).ravel()
        inside = (word >= self.words.offs[self.doc[match]]) & (word < self.words.offs[self.doc[match] + 1])
        return match[inside], word[inside]


def quotations(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte after and place of the mark at the end of each quotation.

    A mark opens or closes by its form; a straight one, or one of a form that
    languages use either way, by the white space around it. A quotation is an
    opening mark with the closing one that is the next mark of the text, so a
    mark without its partner changes nothing else.
    """
    places, sizes, kinds = [], [], []
    for kind, marks in enumerate((_OPENING, _CLOSING, _EITHER)):
        for mark in marks:
            raw = mark.encode()
            at = np.flatnonzero(data == raw[0])
            for i, b in enumerate(raw[1:], 1):
                at = at[at + i < len(data)]
                at = at[data[at + i] == b]
            places.append(at)
            sizes.append(np.full(len(at), len(raw)))
            kinds.append(np.full(len(at), kind))
    at = np.concatenate(places)
    if len(at) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(at)
    at, size, kind = at[order], np.concatenate(sizes)[order], np.concatenate(kinds)[order]
    doc = np.searchsorted(offsets, at, "right") - 1
    apart = np.isin(data, np.frombuffer(b" \t\r\n\v\f([{", np.uint8))
    before = (at == offsets[doc]) | apart[np.maximum(at - 1, 0)]
    after = (at + size == offsets[doc + 1]) | apart[np.minimum(at + size, len(data) - 1)]
    opens = np.where(kind == 2, before, np.where(kind == 0, before | ~after, before & ~after))
    pair = np.flatnonzero(opens[:-1] & ~opens[1:] & (doc[1:] == doc[:-1]))
    return at[pair] + size[pair], at[pair + 1]


def features(column: pa.Array, model: Model) -> np.ndarray:
    """A row for each text: exact and misspelled hits, their weight, their share, quoted share, window score."""
    found = Matches(column, model)
    n, doc = found.words.n_docs, found.doc
    keys, weights = model.context_table
    match, word = found.around()
    window = np.zeros(len(found.at))
    if len(keys) and len(word):
        h = found.words.hashes[word].view(np.int64)
        k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        window = np.bincount(match, weights=np.where(keys[k] == h, weights[k], 0.0), minlength=len(window))
    per = lambda x=None: np.bincount(doc, weights=x, minlength=n)
    exact, near = per((found.edits == 0).astype(float)), per((found.edits > 0).astype(float))
    hits = np.maximum(exact + near, 1)
    free = found.weight * (1 - 0.5 * found.edits) * (1 - found.quoted)
    return np.stack([
        np.log1p(exact), np.log1p(near), np.log1p(np.maximum(per(free), 0)), np.log1p(1000 * exact / np.maximum(found.words.counts, 1)),
        per(found.quoted) / hits, np.clip(per(window) / hits, -5, 5),
    ], axis=1)


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton's steps; the last weight is the constant."""
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    keep = np.append(np.full(z.shape[1] - 1, ridge), 1e-6)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep), z.T @ (y - p) - keep * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w, centre, scale


def _llr(a: Column, b: Column, na: float, nb: float) -> Column:
    """Log-likelihood ratio of a word that a of na toxic and b of nb other documents hold."""
    p = (a + b) / F.lit(na + nb)
    term = lambda k, n: F.when(k > 0, k * F.log(k / (p * F.lit(n)))).otherwise(0.0)
    return 2 * (term(a, na) + term(b, nb))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """Learn from the `sample` labelled rows with the smallest hash of their ids.

    Labels that are null or neither 0 nor 1 are left out; of several labels of one
    id the largest counts. A null text has no words; copies of a text count once
    for the lexicon, whose terms have LEAST_BYTES bytes and stand in LEAST_TEXTS
    toxic texts at least. Runs the fit when called. Without labelled texts of both kinds the model has no
    terms and gives every text the share of toxic labels.
    """
    spark = docs.sparkSession
    one = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(label).cast("int").alias("__y"))
    chosen = one.orderBy(F.xxhash64(doc_id), doc_id).limit(sample)
    rows = materialise(docs.select(doc_id, F.col(text).alias("__text")).join(F.broadcast(chosen), doc_id).select("__text", "__y"))
    base = {r["__y"]: r["n"] for r in rows.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = base.get(0, 0), base.get(1, 0)
    model = Model({})
    rate = (n1 + 0.5) / (n0 + n1 + 1)
    model.weights[-1] = np.log(rate / (1 - rate))
    if not n0 or not n1:
        return model

    def count(chunk: pa.RecordBatch) -> dict[str, object]:
        """Documents of either kind that hold a word."""
        words, _ = plain_words(chunk.column("__text"))
        y = chunk.column("__y").to_numpy()[words.doc]
        order = np.lexsort((words.doc, words.hashes))
        h, d = words.hashes[order], words.doc[order]
        new_word = np.append(True, h[1:] != h[:-1]) if len(h) else np.zeros(0, bool)
        new = new_word | np.append(True, d[1:] != d[:-1]) if len(h) else new_word
        number = np.cumsum(new_word) - 1
        size = number[-1] + 1 if len(h) else 0
        toxic = np.bincount(number[new & (y[order] == 1)], minlength=size)
        other = np.bincount(number[new & (y[order] == 0)], minlength=size)
        first = order[new_word]
        keep = toxic > 0
        spelled = [bytes(words.data[s:e]) for s, e in zip(words.starts[first[keep]], words.ends[first[keep]], strict=True)]
        rest = np.flatnonzero(~keep)
        spelled += [bytes(words.data[s:e]) for s, e in zip(words.starts[first[rest]], words.ends[first[rest]], strict=True)]
        at = np.concatenate([np.flatnonzero(keep), rest])
        return {"word": pa.array(spelled, pa.binary()), "toxic": toxic[at], "other": other[at]}

    # copies of a text tell nothing new of its words
    once = materialise(rows.dropDuplicates(["__text", "__y"]))
    distinct = {r["__y"]: r["n"] for r in once.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    u0, u1 = distinct[0], distinct[1]
    counted = map_chunks(once, count, "word binary, toxic long, other long", "__text")
    totals = counted.groupBy("word").agg(F.sum("toxic").alias("a"), F.sum("other").alias("b"))
    odds = F.log((F.col("a") + 0.5) / (u1 + 1)) - F.log((F.col("b") + 0.5) / (u0 + 1))
    terms = totals.filter((F.octet_length("word") >= LEAST_BYTES) & (F.col("a") >= LEAST_TEXTS)).withColumns({"odds": odds, "llr": _llr(F.col("a"), F.col("b"), u1, u0)})
    terms = terms.filter("odds > 2 and llr > 25").orderBy(F.desc("llr"), "word").collect()
    model.terms = {bytes(r["word"]): float(r["odds"]) for r in terms}
    if not model.terms:
        return model

    def windows(chunk: pa.RecordBatch) -> dict[str, object]:
        found = Matches(chunk.column("__text"), model)
        _, word = found.around()
        y = chunk.column("__y").to_numpy()[found.words.doc[word]]
        h, at = np.unique(found.words.hashes[word].view(np.int64), return_inverse=True)
        return {"h": h, "a": np.bincount(at[y == 1], minlength=len(h)), "b": np.bincount(at[y == 0], minlength=len(h))}

    near = map_chunks(rows, windows, "h long, a long, b long", "__text").groupBy("h").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    near = near.filter("a + b >= 5").orderBy(F.desc(F.col("a") + F.col("b")), "h").collect()
    na, nb = sum(r["a"] for r in near) + 100, sum(r["b"] for r in near) + 100
    model.context = {r["h"]: float(np.log((r["a"] + 100 * rate) / na) - np.log((r["b"] + 100 * (1 - rate)) / nb) - np.log(rate / (1 - rate))) for r in near} if nb > 100 else {}

    def measured(chunk: pa.RecordBatch) -> dict[str, object]:
        x = features(chunk.column("__text"), model)
        return {"x": binary_column(x.ravel(), np.full(len(x), x.shape[1])), "y": chunk.column("__y")}

    got = map_chunks(rows, measured, "x binary, y int", "__text").toArrow()  # `sample` rows of a few numbers at most
    x = np.frombuffer(bytes_of(got.column("x").combine_chunks()), np.float64).reshape(-1, FEATURES - 1)
    model.weights, model.centre, model.scale = fit_weights(x, got.column("y").to_numpy().astype(float))
    return model


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep`, and score, n_hits, n_near, quoted of every row, in place of kept columns of those names.

    A null or empty text has no hits and the score of that; texts of any length
    are scored whole. Of two terms that are equally near the heavier one counts,
    of equals the first. Repeated rows are scored each; an empty table gives an
    empty result; other columns are not read.
    """
    keep = tuple(c for c in keep if c not in ("score", "n_hits", "n_near", "quoted"))
    rows = docs.select(*keep, F.col(text).alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text") + ", score double, n_hits long, n_near long, quoted double"

    def work(chunk: pa.RecordBatch) -> dict[str, object]:
        m = shared.value
        x = features(chunk.column("__text"), m)
        z = np.column_stack([(x - m.centre) / m.scale, np.ones(len(x))]) @ m.weights
        return {c: chunk.column(c) for c in keep} | {"score": 1 / (1 + np.exp(-np.clip(z, -30, 30))), "n_hits": np.rint(np.expm1(x[:, 0])), "n_near": np.rint(np.expm1(x[:, 1])), "quoted": x[:, 4]}

    return map_chunks(rows, work, schema, "__text")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score of every document, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").filter(~held_out()).select("doc_id", "toxic"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
