"""Each corpus operator against a plain version, and its edge cases."""

import collections
import random
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestar.llm import components, decontaminate, langid, near_dup, packing, quality_rules, queries, sharding, substring_dedup, token_counts, toxicity, url_filter

DIR = "/root/testdata/sf0.001"
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
have_tables = pytest.mark.skipif(not Path(DIR).exists(), reason="no tables")
RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 6))) for _ in range(120)]


def prose(n, rng=RNG):
    out = [rng.choice(VOCABULARY) for _ in range(n)]
    for i in range(rng.randint(5, 9), n, 9):
        out[i] += rng.choice([".", ".", "!\n", ","])
    return " ".join(out)


def edge_texts():
    """Nulls, empties, marks, very long words, repeats, ties."""
    return [None, "", "   \n\t", "a", "One two", "é ß ñ — 你好", "x" * 5000, "same words here now " * 60, prose(120), prose(120, random.Random(1)), prose(120, random.Random(1)), '"' + prose(30) + '"', "<|endoftext|> in <|endoftext|>", "#*$% " * 80]


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(None if i == 3 else i, t, "en" if i % 3 else None, i) for i, t in enumerate(edge_texts())]
    rows += [rows[8], rows[8], (None, prose(120, random.Random(1)), None, 1)]
    # further columns whose names clash with what the operators add
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words long").withColumns({"kept": F.lit("mine"), "shard": F.lit(1.5), "score": F.lit("s")})


def _normal(df):
    return sorted(tuple("" if x is None or x != x else f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@have_tables
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, DIR).toPandas(), con.execute(queries.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and _normal(got) == _normal(want)


# --- 1
def test_url_filter(spark):
    urls = ["https://A.Example.com/en/7?x#y", "http://www.example.com/en/8", "x://net/de/", None, "no scheme", "http://", "http://example.com.evil.org/es/", "http://notcom/en/"]
    pages = spark.createDataFrame([(i, u, "v") for i, u in enumerate(urls)], "page_id int, url string, verdict string")
    listed = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, listed).collect()}
    assert got[0] == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[1][2:] == ("com/en/", "block") and got[2][2:] == ("net/de/", "allow")
    assert got[3] == got[4] == ("", "", None, "allow") and got[6][3] == "block" and got[7][2] is None
    assert url_filter.filter_urls(pages.limit(0), listed).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(pages, listed.limit(0), "block").collect()} == {"block"}


# --- 2
def test_sharding(spark, edges):
    placed = sharding.shuffle_shards(edges, 5, bucket_bytes=500).toPandas()
    assert len(placed) == edges.count()
    sizes = placed.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1
    for _, g in placed.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    named = edges.filter("doc_id is not null")
    place = lambda df: sorted((r["doc_id"], r["shard"], r["slot"]) for r in sharding.shuffle_shards(df, 5, bucket_bytes=500).collect())
    assert place(named) == place(named.repartition(3))
    assert sharding.shuffle_shards(edges.limit(0), 5).count() == 0


def test_fisher_yates_is_a_permutation():
    assert sorted(sharding.fisher_yates(1000, 3)) == list(range(1000))


# --- 3
def _shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def _components(docs, k, percent=80):
    sets = {i: _shingles(t, k) for i, t in docs}
    ids, low = sorted(sets), {i: i for i in sets}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                low[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def _near(words, share, rng):
    return [rng.choice(VOCABULARY) if rng.random() < share else w for w in words]


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(11)
    base = prose(160, rng).split()
    docs = [(i, " ".join(_near(base, rng.choice([0.005, 0.01, 0.02, 0.04]), rng))) for i in range(160)]  # a crowded region with several components
    docs += [(200 + i, prose(rng.randint(1, 60), rng)) for i in range(60)] + [(300 + i, docs[i][1]) for i in range(40)] + [(400, None), (401, ""), (402, "one"), (403, "ONE")]
    got = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), 4).collect()
    want = _components(docs, 4)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_edges(spark, edges):
    got = near_dup.near_duplicates(edges, 5).collect()
    assert len(got) == edges.count()
    of = collections.defaultdict(set)
    for r in got:
        of[r["doc_id"]].add((r["component_id"], r["kept"]))
    assert of[8] == {(8, True)} and of[10] == {(9, False)} and of[0] == {(0, True)}
    assert of[None] == {(None, True), (9, False)}
    kept = near_dup.drop_near_duplicates(edges, 5)
    assert kept.columns == edges.columns and sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == sorted([0, 1, 2, 4, 5, 6, 7, 8, 8, 8, 9, 11, 12, 13])
    assert kept.filter("doc_id is null").count() == 1
    assert near_dup.near_duplicates(edges.limit(0)).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (200, 30)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long").repartition(6)).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 200: 0}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 4
def test_packing_round_trip(spark, edges):
    from tokenizers import Tokenizer

    texts = edges.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, prose(RNG.randint(1, 3000))) for i in range(40)], "doc_id long, text string"))
    rows = texts.collect()
    got = packing.pack(texts, BPE, window=256).toPandas()
    library = Tokenizer.from_file(BPE)
    want = collections.Counter((r["doc_id"], tuple(library.encode(r["text"] or "", add_special_tokens=False).ids) + (0,)) for r in rows)
    got["ids"] = got["ids"].map(lambda b: np.frombuffer(b, "<u4"))
    assert (got["ids"].map(len) == got["length"]).all()
    by_doc = collections.defaultdict(list)
    for r in got.itertuples():
        by_doc[None if r.doc_id != r.doc_id else int(r.doc_id)].append(r)
    for doc, texts_of in ((d, [t for (x, t), n in want.items() if x == d for _ in range(n)]) for d in {d for d, _ in want}):
        if len(texts_of) == 1:
            parts = sorted(by_doc[doc], key=lambda r: r.start)
            assert tuple(np.concatenate([p.ids for p in parts])) == texts_of[0] and all(p.doc_tokens == len(texts_of[0]) for p in parts)
        assert sum(p.length for p in by_doc[doc]) == sum(map(len, texts_of))
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g["offset"]) == [0, *np.cumsum(g["length"])[:-1]] and (n := g["length"].sum()) <= 256 and n & (n - 1) == 0
    assert packing.pack(edges.limit(0), BPE).count() == 0
    with pytest.raises(ValueError):
        packing.pack(edges, BPE, window=100)


def test_neighbours_are_ranked_by_bm25():
    docs = [np.array(x, np.uint32) for x in ([1, 2, 3], [1, 2, 9], [7, 8, 9], [3, 3, 3])]
    shard = packing.Shard(docs, np.ones(10), 3.0)
    shard.take(0)
    assert list(shard.neighbours(0)) == [3, 1, 2] or list(shard.neighbours(0))[:2] == [1, 3]


# --- 5
def test_decontamination(spark, edges):
    bench = spark.createDataFrame([(1, "alpha beta gamma"), (2, " ".join(f"w{i}" for i in range(12))), (3, None), (None, "lone"), (4, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x Alpha, BETA; gamma y"), (2, "a " + " ".join(f"w{i}" for i in range(11)) + " b"), (3, "w1 w2"), (4, None), (5, "lone")], "doc_id long, text string").withColumn("n_hit", F.lit("mine"))
    plain = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.scan(docs, bench).collect()}
    assert plain == {1: (5, 3, ["1"]), 2: (13, 11, ["2"]), 3: (2, 0, []), 4: (0, 0, []), 5: (1, 1, [""])}
    joined = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.scan(docs, bench, max_windows=0).collect()}
    assert joined == plain
    left = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, bench, drop_share=0.7).collect()}
    assert left == {1: "x  y", 3: "w1 w2", 4: None}
    assert decontaminate.scan(edges, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.scan(edges.limit(0), bench).count() == 0


# --- 6
def _repeat_stats(words):
    n, best = len(words), collections.Counter()
    longest = [0] * n
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and words[i + k] == words[j + k]:
                k += 1
            longest[i], longest[j] = max(longest[i], k), max(longest[j], k)
    cover = lambda least: len({p for i, k in enumerate(longest) if k >= least for p in range(i, i + k)})
    return len({p for i, k in enumerate(longest) if k >= 3 for p in range(i, i + 3)}), cover(8), max([k for k in longest if k >= 8], default=0), best


def test_quality_counts(spark, edges):
    rng = random.Random(2)
    chunk = prose(30, rng)
    texts = [t for t in edge_texts()] + [" ".join([prose(20, rng), chunk, prose(20, rng), chunk]) for _ in range(5)] + ["line one\nline one\n\nline two\r\n" * 3]
    got = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        repeat, covered, longest, _ = _repeat_stats(words)
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")))
        assert (r["n_repeat_words"], r["n_covered"], r["longest_repeat"]) == (repeat, covered, longest)
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["base_failed"] == (len(words) < 50 or 100 * repeat > 50 * len(words)) and (not r["base_failed"] or not r["kept"])
    judged = quality_rules.judge(edges)
    assert judged.count() == edges.count() and dict(judged.dtypes)["kept"] == "boolean"
    assert quality_rules.judge(edges.limit(0)).count() == 0


# --- 7
def test_substring_dedup(spark, edges):
    passage = "This passage of many plain words stands in several texts. It goes on for a second long sentence here. And a third one closes it well."
    docs = spark.createDataFrame([(1, f"Start one. {passage} End one."), (2, f"Other start. {passage} Other end."), (3, None), (4, ""), (5, "Short. Short. Short.")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got[1] == (0, f"Start one. {passage} End one.") and got[2] == (3, "Other start. Other end.")
    assert got[3] == (0, None) and got[4] == (0, "") and got[5][0] == 0
    assert substring_dedup.remove_repeats(edges).count() == edges.count()
    assert substring_dedup.remove_repeats(edges.limit(0)).count() == 0


def test_passages_in_long_sentences(spark):
    """No passage of 50 words is left in two texts, wherever its sentences end; the first text that holds it keeps it."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(21)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(n))
    long, cut, two = fresh(60), fresh(55), f"{fresh(40)}. {fresh(30)}"
    texts = [f"{fresh(20)} {p} {fresh(n)}." for p in (long, cut, two) for n in (15, 30)] + [f"Start. {long}", f"{fresh(9)}, {cut[5:]}! End here.", two, fresh(49), "same words here now " * 60, None, f"é {long} é"]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_chars int").repartition(3)
    got = {r["doc_id"]: r["text"] for r in pipeline.substring_dedup(spark, docs, DIR).collect()}
    windows = collections.Counter()
    for t in got.values():
        words = re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
        windows.update({tuple(words[i : i + 50]) for i in range(len(words) - 49)})
    assert windows and max(windows.values()) == 1
    assert all(got[i] == texts[i] for i in (0, 2, 4, 9, 11))
    assert all(len(got[i].split()) <= len(texts[i].split()) - 26 for i in (1, 3, 5)) and got[6].startswith("Start.") and got[7].endswith("! End here.")
    assert got[10].split()[:26] == texts[10].split()[:26] and len(got[10].split()) < 60 and got[12].startswith("é ") and got[12].endswith(" é")


# --- 8
def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_automata_find_all_misspellings():
    rng = random.Random(4)
    make = lambda: bytes(rng.choice(b"abcdeilorst") for _ in range(rng.randint(3, 12)))
    terms = {make(): rng.random() for _ in range(120)}
    lexicon, words = toxicity.Lexicon(terms), {make() for _ in range(300)}
    for t in rng.choices(list(terms), k=400):
        w = bytearray(t)
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(w))
            if rng.random() < 0.5:
                w[i] = rng.choice(b"abcdeilorst")
            elif rng.random() < 0.5:
                w.insert(i, rng.choice(b"abcdeilorst"))
            elif len(w) > 1:
                del w[i]
        words.add(bytes(w))
    words = sorted(words)
    term, edits = lexicon.match(words)
    ends = np.cumsum([len(w) for w in words])
    may = lexicon.candidates(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends)
    for w, k, d, m in zip(words, term, edits, may, strict=True):
        best = min(((_distance(w, t), -terms[t]) for t in terms if _distance(w, t) <= toxicity.edits_for(t)), default=None)
        assert (k < 0) == (best is None) and (best is None or (m and (d, -terms[lexicon.terms[k]]) == best))


def test_toxicity_on_held_out_rows(spark, edges):
    rng = random.Random(8)
    rows = []
    for i in range(600):
        words = prose(60, rng).split()
        toxic = i % 5 == 0
        for _ in range(3 * toxic):
            words[rng.randrange(60)] = rng.choice(["wretched", "vermin", "scoundrel"])
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), docs.filter("doc_id < 400").select("doc_id", "toxic"))
    assert {b"wretched", b"vermin", b"scoundrel"} <= set(model.terms)
    got = toxicity.score(docs.filter("doc_id >= 400"), model, keep=("doc_id", "toxic")).toPandas()
    assert ((got["score"] >= 0.5) == (got["toxic"] == 1)).mean() > 0.97
    assert toxicity.score(spark.createDataFrame([(1, "a wretchd vrmin")], "doc_id long, text string"), model).first()["n_near"] == 2
    scored = toxicity.score(edges, model).toPandas()
    assert len(scored) == edges.count() and scored["score"].between(0, 1).all()
    none = toxicity.fit(edges.limit(0), docs.limit(0).select("doc_id", "toxic"))
    assert toxicity.score(edges, none).filter("score is null").count() == 0


def test_terms_of_fixed_phrases(spark):
    """A term may follow one and the same word always; the words of a copied text are no terms."""
    rng = random.Random(12)
    copied = prose(60, rng) + " zzcopied"
    rows = [(i, f"{prose(30, rng)} you vermin {prose(20, rng)}", 1) for i in range(60)] + [(100 + i, copied, 1) for i in range(60)] + [(1000 + i, prose(50, rng), 0) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert b"vermin" in model.terms and b"zzcopied" not in model.terms


def test_quotation_is_seen():
    import pyarrow as pa

    model = toxicity.Model({b"vermin": 3.0})
    x = toxicity.features(pa.array(['they said "you vermin" today', "you vermin today", None]), model)
    assert list(x[:, 4]) == [1.0, 0.0, 0.0] and x[0, 2] == 0 and x[1, 2] > 0


# --- 9
def test_forward_algorithm_sums_all_segmentations():
    from lodestar.llm.text import Words

    pieces = tuple(sorted({b" a", b"ab", b"b", b"a", b" ab", b"ba", *(bytes([b]) for b in [32, *np.flatnonzero(langid.LETTERS)])}))
    rng = np.random.default_rng(1)
    p = rng.random((len(pieces), 2)) / 10
    model = langid.Model(["x", "y"], np.zeros(2), p, pieces)
    number = {s: i for i, s in enumerate(pieces)}

    def total(word, k):
        if not word:
            return 1.0
        return sum(p[number[word[:n]], k] * total(word[n:], k) for n in range(1, len(word) + 1) if word[:n] in number)

    data = b"abba ab aab"
    words = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), langid.LETTERS, lower=True)
    scores, which = model.word_scores(words)
    for i, w in enumerate(data.split()):
        want = [np.log(total(b" " + w, k)) + (len(w) + 1) * np.log(langid._LIFT) for k in (0, 1)]
        assert np.allclose(scores[which[i]], want)


def test_language_of_held_out_rows(spark, edges):
    rng = random.Random(9)
    kinds = {"aa": "the and of to in that with for".split(), "bb": "der die und das mit nicht ein auf".split()}
    rows = [(i, " ".join(rng.choice(kinds[k]) for _ in range(20)), k) for i, k in enumerate(rng.choices(list(kinds), k=200))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs.filter("doc_id < 120"), PIECES)
    got = langid.identify(docs.filter("doc_id >= 120"), model, keep=("doc_id", "lang")).toPandas()
    assert (got["lang"] == got["lang_pred"]).all() and got["score"].between(0, 1).all()
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify(edges, model).collect()}
    assert found[0] == found[1] == found[2] == found[13] == "und" and found[5] != "und" and found[6] != "und"
    assert langid.identify(edges, langid.fit(edges.limit(0), PIECES)).filter("lang_pred <> 'und'").count() == 0


# --- 10
def test_token_counts_equal_the_library(spark, edges):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    odd = ["it's we'll 'twas ' s", "  lead", "trail  ", "a\n\n b\t c", "12 345 x9", "é́ ＡＢ \u00a0 \u2003x", "don''t 'RE 're 'r 'l 'v 'll!", "…!?'s", "𝟙𝟚 ²³ ½"]
    docs = edges.select("doc_id", "text").unionByName(spark.createDataFrame([(50 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    for r in token_counts.count_tokens(docs.withColumn("copy", F.col("text")), BPE, keep=("doc_id", "copy")).collect():
        assert r["n_tokens"] == len(library.encode(r["copy"] or "", add_special_tokens=False).ids), r["copy"]
        assert r["n_bytes"] == len((r["copy"] or "").encode())
    assert token_counts.count_tokens(edges.limit(0), BPE).count() == 0


@have_tables
def test_tables_against_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    counts = {r["doc_id"]: r["n_tokens"] for r in queries.QUERIES["op10_token_counts"](spark, DIR).collect()}
    ids = {d: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for d, t in texts.items()}
    assert counts == {d: len(x) - 1 for d, x in ids.items()}
    for r in queries.QUERIES["op4_packing"](spark, DIR).collect():
        assert zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]


@have_tables
def test_near_dedup_query_against_all_pairs(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.QUERIES["op3_near_dedup"](spark, DIR).collect()}
    assert got == _components(docs, 4)


@have_tables
@pytest.mark.parametrize("name, column, truth", [("op8_toxicity", "predicted", "toxic"), ("op9_language_id", "lang_pred", "lang")])
def test_held_out_accuracy(spark, name, column, truth):
    rows = pd.DataFrame([r.asDict() for r in queries.QUERIES[name](spark, "/root/testdata/sf0.01").collect()])
    known = spark.read.parquet(f"/root/testdata/sf0.01/{'labels' if truth == 'toxic' else 'documents'}.parquet").select("doc_id", truth).toPandas()
    both = rows[rows["held_out"]].merge(known, on="doc_id")
    assert len(both) > 50 and (both[column] == both[truth]).mean() > 0.93


@have_tables
@pytest.mark.parametrize("some", [True, False])
def test_pipeline_edges(spark, edges, some):
    """All stages take nulls, empties, repeats and an empty table, and give the columns of documents."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = edges.select("doc_id", "text", "lang", F.lit(None).cast("string").alias("source"), F.length("text").cast("long").alias("n_chars"))
    docs = docs if some else docs.limit(0)
    for _, stage in pipeline.STAGES[:-1]:
        out = pipeline.materialise(stage(spark, docs, DIR))
        assert out.dtypes == docs.dtypes and out.count() <= docs.count()
        assert out.filter("not (n_chars <=> length(text))").count() == 0
        docs = out if stage is not pipeline.quality_rules else docs  # the rules leave little of these rows
    pieces = pipeline.STAGES[-1][1](spark, docs, DIR)
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


@have_tables
def test_pipeline_against_plain_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    frames = [docs]
    for _, stage in pipeline.STAGES[:-1]:
        frames.append(pipeline.materialise(stage(spark, frames[-1], DIR)))
        assert frames[-1].columns == docs.columns
    rows = [{r["doc_id"]: r["text"] for r in f.select("doc_id", "text").collect()} for f in frames]
    # near duplicates: one of each group of the documents that the rules kept
    want = {i for i, (_, c) in _components(list(rows[1].items()), 5).items() if c == i}
    assert set(rows[2]) == want
    # nothing of the benchmark is left
    assert decontaminate.scan(frames[4], spark.read.parquet(f"{DIR}/benchmark.parquet")).filter("n_hit > 0").count() == 0
    # the pieces hold all tokens of all texts
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    got = collections.Counter()
    for r in pipeline.STAGES[-1][1](spark, frames[4], DIR).collect():
        got[r["doc_id"]] += r["length"]
    assert got == {d: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in rows[4].items()}
