"""Misspellings with letters of several bytes, and quotations."""

from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.llm import toxicity


def test_an_edit_is_a_letter():
    lexicon = toxicity.Lexicon({"imbécile".encode(): 1.0, "злодей".encode(): 1.0, b"moron": 1.0})
    words = ["imbécile", "imbecile", "imbéçile", "imbeçile", "злодеи", "злдей", "злоде", "мороз", "morón", "marón"]
    term, edits = lexicon.match([w.encode() for w in words])
    assert list(edits) == [0, 1, 1, -1, 1, 1, 1, -1, 1, -1]
    points = np.array([ord(c) for w in words for c in w], np.uint32)
    ends = np.cumsum([len(w) for w in words])
    may = lexicon.candidates(points, ends - [len(w) for w in words], ends)
    assert all(m for m, t in zip(may, term, strict=True) if t >= 0)


def test_features_of_texts_with_letters_of_several_bytes():
    model = toxicity.Model({"imbécile".encode(): 3.0})
    x = toxicity.features(pa.array(["é ß 你好 un imbecile là", "un imbécile", "rien ici é", None]), model)
    assert list(np.rint(np.expm1(x[:, 0]))) == [0, 1, 0, 0] and list(np.rint(np.expm1(x[:, 1]))) == [1, 0, 0, 0]


def test_marks_without_partners_change_nothing():
    model = toxicity.Model({b"vermin": 3.0})
    texts = ['a 5" pipe and vermin', '"you vermin" he said', 'an " open mark, then "vermin" again', "« vermin » dit-il", "„vermin“ sagte er", "“vermin” he said", 'vermin "quoted" vermin', '"', ""]
    assert list(toxicity.features(pa.array(texts), model)[:, 4]) == [0, 1, 1, 1, 1, 1, 0, 0, 0]


def test_terms_of_several_edits_against_plain_distances():
    rng = np.random.default_rng(3)
    letters = "aéößżя"
    make = lambda: "".join(rng.choice(list(letters), rng.integers(4, 11)))
    terms, words = {make().encode(): 1.0 for _ in range(40)}, [make() for _ in range(200)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    _, edits = toxicity.Lexicon(terms).match([w.encode() for w in words])
    for w, e in zip(words, edits, strict=True):
        best = min((d for t in terms if (d := distance(w, t.decode())) <= toxicity.edits_for(t)), default=-1)
        assert e == best


def test_kept_columns_that_clash(spark):
    """Outputs stand in place of kept columns of their names, in operators 8, 9 and 10."""
    import public_tokenizers

    from lodestar.llm import langid, token_counts

    docs = spark.createDataFrame([(1, "one text", "s", "l", 5), (2, None, "t", "m", 6)], "doc_id long, text string, score string, lang_pred string, n_tokens int").withColumns({"n_hits": F.lit("x"), "n_bytes": F.lit(1.5)})
    keep = tuple(c for c in docs.columns if c != "text")
    scored = toxicity.score(docs, toxicity.Model({}), keep=keep)
    assert scored.columns == ["doc_id", "lang_pred", "n_tokens", "n_bytes", "score", "n_hits", "n_near", "quoted"] and {type(r.score) for r in scored.collect()} == {float}
    model = langid.fit(docs.select(F.lit("en").alias("lang"), "text"), public_tokenizers.path("piece_bpe_32k.model"))
    assert [r.lang_pred for r in langid.identify(docs, model, keep=keep).orderBy("doc_id").collect()] == ["en", "und"]
    assert [(r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=keep).orderBy("doc_id").collect()] == [(8, 2), (0, 0)]


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="no tables")
def test_held_out_rows(spark):
    """On held-out rows: nearly all that is called toxic is, most of what is toxic is found, and it ranks high."""
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = toxicity.op8_toxicity(spark, folder).filter("held_out").join(labels, "doc_id").toPandas()
    rank = rows["score"].rank()
    n1 = int((rows["toxic"] == 1).sum())
    auc = (rank[rows["toxic"] == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(rows) - n1))
    found = int(((rows["toxic"] == 1) & (rows["predicted"] == 1)).sum())
    assert auc > 0.95 and found / n1 > 0.87 and found / int((rows["predicted"] == 1).sum()) > 0.97
