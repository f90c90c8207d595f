"""Matching at size against plain versions: dictionaries, names, searches, trees."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.functions.text import norm
from lodestar.operators import alerts, code_index, dictionary, similar, taxonomy, tree


def _found(rows, key="id"):
    return {r[key]: {m["phrase"]: (m["words"], m["n"], tuple(m["found"])) for m in r["matches"]} for r in rows}


def _plain(texts, pairs, plural=False):
    clean = lambda s: " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in (s or "").lower()).split())
    values = {}
    for p, v in pairs:
        if clean(p) and v is not None:
            for form in [clean(p), clean(p) + "s"] if plural else [clean(p)]:
                values.setdefault(form, set()).add(v)
    out = {}
    for i, t in texts:
        words = clean(t).split()
        out[i] = {}
        for p, v in values.items():
            q = p.split()
            n = sum(words[k : k + len(q)] == q for k in range(len(words) - len(q) + 1))
            if n:
                out[i][p] = (len(q), n, tuple(sorted(v)))
    return out


def _texts(seed, n, most, alphabet="abc"):
    rng = random.Random(seed)
    return [(i, " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 2))) for _ in range(rng.randint(0, most)))) for i in range(n)]


@pytest.mark.parametrize("plural", [False, True])
@pytest.mark.parametrize("limit, piece", [(64 << 20, 256), (64 << 20, 7), (0, 256)])
def test_dictionary_equals_plain(spark, monkeypatch, plural, limit, piece):
    monkeypatch.setattr(dictionary, "AUTOMATON_BYTES", limit)
    monkeypatch.setattr(dictionary, "PIECE", piece)
    texts = _texts(1, 60, 90, "abs") + [(100, None), (101, ""), (102, "A-b  c!"), (103, "a " * 3000)]
    rng = random.Random(2)
    pairs = [(" ".join("".join(rng.choice("abs") for _ in range(rng.randint(1, 2))) for _ in range(rng.randint(1, 6))), f"v{rng.randint(0, 9)}") for _ in range(150)]
    pairs += [("a", "one"), ("a a a", "three"), ("A, B", "ab"), ("", "none"), ("!?", "none"), (None, "none"), ("b", None)]
    docs = spark.createDataFrame(texts, "id long, text string").withColumn("matches", F.lit(5))
    got = dictionary.find_phrases(docs, spark.createDataFrame(pairs, "phrase string, value string"), plural=plural)
    assert got.columns == ["id", "text", "matches"]
    assert _found(got.collect()) == _plain(texts, pairs, plural)


def test_fifty_thousand_aliases(spark):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("steel", "ring", "bolt", "gear") for b in range(200)]
    pairs = [(" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))), str(i % 97)) for i in range(50_000)]
    texts = [(i, " ".join(rng.choice(words) for _ in range(40)) + " " + rng.choice(pairs)[0]) for i in range(300)]
    index = {}
    for p, v in pairs:
        index.setdefault(p, set()).add(v)
    found = dictionary.find_phrases(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(pairs, "phrase string, value string")).select("id", "matches", dictionary.longest(F.col("matches")).alias("codes")).collect()
    for r, (_, t) in zip(sorted(found, key=lambda r: r["id"]), texts, strict=True):
        w = t.split()
        have = {p for n in range(1, 5) for k in range(len(w) - n + 1) if (p := " ".join(w[k : k + n])) in index}
        assert {m["phrase"] for m in r["matches"]} == have
        top = max(map(len, have))
        assert r["codes"] == sorted(set().union(*(index[p] for p in have if len(p) == top)))


def test_automaton_of_nothing():
    empty = dictionary.Automaton(pa.array([], pa.string()), pa.array([], pa.list_(pa.string())))
    assert empty.matches(pa.array(["a b", None, ""])).to_pylist() == [[], [], []]


def test_expand_all_is_expand_for_each(spark):
    synonyms = {"ring": ["gear", "the steel bolt"], "red goods": ["crimson ring"], "goods of": ["never"]}
    queries = ["Red goods and a ring for the valve", "goods", "", None, "RED GOODS of steel"]
    relation = spark.createDataFrame([(k, s) for k, v in synonyms.items() for s in v], "phrase string, synonym string")
    got = taxonomy.expand_all(spark.createDataFrame(list(enumerate(queries)), "id long, text string"), relation).orderBy("id").collect()
    assert [r["further"] for r in got] == [sorted(taxonomy.expand(q or "", synonyms)) for q in queries]


@pytest.mark.parametrize("percent, block", [(50, 2000), (50, 3), (80, 10), (30, 7), (100, 5)])
def test_similar_names_equal_all_pairs(spark, monkeypatch, percent, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    rng = random.Random(4)
    stems = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(3, 14))) for _ in range(40)]
    said = [s[:k] + rng.choice("abxyz ") + s[k:] for s in stems for k in (0, 2, 5, len(s))] + stems + [None, "", "!!", "a", "Ä b", "a b", "A-B", "a b"]
    names = {}
    for s in said:
        clean = " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in (s or "").lower().replace("ä", "a")).split())
        if clean:
            names.setdefault(clean, []).append(s)
    grams = {n: {f" {n} "[i : i + 3] for i in range(len(n))} for n in names}
    want = {(a, b, len(names[a]), len(names[b]), len(grams[a] & grams[b]), len(grams[a] | grams[b])) for a in names for b in names if a < b and 100 * len(grams[a] & grams[b]) >= percent * len(grams[a] | grams[b])}
    found = similar.similar_names(spark.createDataFrame([(s,) for s in said], "name string"), "name", percent)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and (want or percent == 100)


def test_a_common_trigram_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 10)
    rows = spark.createDataFrame([(f"same start {i:03d}",) for i in range(120)], "name string")
    assert similar.similar_names(rows, "name", 30).count() == 120 * 119 // 2


def test_many_searches_are_ranked_one_by_one(spark):
    rng = random.Random(6)
    parts = ["red", "steel", "ring", "widget", "widgets", "bolting", "bolt", "goods", "gear", "gears", "of", "ze"]
    said = lambda n: " ".join(rng.choice(parts) for _ in range(rng.randint(0, n)))
    nodes = [(f"{i // 9:04d}{i % 9:02d}" + ("10" if i % 5 == 0 else ""), 8 if i % 5 == 0 else 6, said(4), said(3), said(2), said(2), said(2)) for i in range(60)]
    fields = ["own", "context", "head", "en", "enctx"]
    known = spark.createDataFrame(nodes, f"code string, level int, {', '.join(f + ' string' for f in fields)}").withColumns({f: norm(F.col(f)) for f in fields})
    synonyms = {"ring": ["gear", "steel bolt"], "red goods": ["widget"]}
    queries = [(i, said(4), ["000101"] if i % 3 == 0 else None, ["0002"] if i % 4 == 0 else None) for i in range(14)] + [(90, None, None, None), (91, "of the", None, None), (92, "ring ring bolti", None, None), (93, "bolti", None, None)]
    rows = spark.createDataFrame(queries, "query_id long, text string, preferred array<string>, boosted array<string>")
    relation = spark.createDataFrame([(k, s) for k, v in synonyms.items() for s in v], "phrase string, synonym string")
    found = code_index.search_many(code_index.postings(known), known, taxonomy.expand_all(rows, relation), limit=7).collect()
    for i, text, preferred, boosted in queries:
        want = taxonomy.ranked(known, text or "", synonyms, preferred or (), boosted or (), 7).collect()
        assert sorted((r["code"], r["score"]) for r in found if r["query_id"] == i) == sorted((r["code"], r["score"]) for r in want), text


def _above(parent, node):
    out, seen = [], set()
    while (node := parent.get(node)) is not None:
        if node in seen:
            return None
        seen.add(node)
        out.append(node)
    return out


def test_trees_of_any_depth(spark):
    rng = random.Random(8)
    parent = {i: i - 1 if i % 37 else None for i in range(150)}  # chains of 37
    parent |= {200 + i: rng.choice([None, 5, 36, 1000, *range(200, 200 + i)]) for i in range(60)}  # 1000 has no row
    circle = {500: 501, 501: 502, 502: 500, 503: 501, 504: 504, 505: 504}
    rows = list((parent | circle).items())
    edges = spark.createDataFrame(rows + rows[:3], "node long, parent long")
    lifted = {r["node"]: (r["root"], r["depth"]) for r in tree.lifted(edges).collect()}
    assert {r["node"] for r in tree.circles(edges).collect()} == set(circle)
    ways = {n: _above(parent, n) for n in parent} | {1000: []}
    assert lifted == {n: (w[-1] if w else n, len(w)) for n, w in ways.items()} | dict.fromkeys(circle, (None, None))
    found = [tuple(r) for r in tree.ancestors(edges).collect()]
    assert len(found) == len(set(found)) and set(found) == {(n, a, k + 1) for n, w in ways.items() for k, a in enumerate(w)}
    gone = {7, 200, 502}
    left = {r["node"] for r in tree.cascade(edges, F.col("node").isin(*gone)).collect()}
    below = {n for n in parent if n in gone or gone & set(ways[n])} | {500, 501, 502, 503}
    assert left == (set(parent) | set(circle)) - below
    crumbs = {r["node"]: r["crumbs"] for r in tree.crumbs(edges.withColumn("label", F.concat(F.lit("n"), "node")), "label").collect()}
    assert crumbs[36] == " › ".join(f"n{i}" for i in range(37)) and crumbs[37 * 2] == "n74"
    with pytest.raises(Exception, match="several parents"):
        tree.lifted(spark.createDataFrame([(1, 2), (1, 3)], "node long, parent long"))
    assert tree.ancestors(edges.limit(0)).count() == 0


def test_categories_by_keyword_then_search_then_default(spark):
    nodes = spark.createDataFrame([("090111", 6, " raw coffee beans ", " ", " coffee "), ("151311", 6, " crude oil of coconuts ", " ", " oils ")], "code string, level int, own string, context string, head string")
    keywords = spark.createDataFrame([(1, "palm oil", "1511"), (0, "vanilla", "0905"), (2, "oil", "1500")], "place int, keyword string, category string")
    asked = [(1, "Vanilla and palm oil", "0905", "keyword"), (2, "coffee in bags", "0901", "search"), (3, "coconuts", "1513", "search"), (4, "nothing known", "9999", "default"), (5, None, "9999", "default"), (6, "Palm-oil", "1511", "keyword"), (7, "", "9999", "default")]
    queries = spark.createDataFrame([a[:2] for a in asked], "query_id long, text string")
    got = code_index.categories(queries, keywords, code_index.postings(nodes), nodes, "9999").orderBy("query_id").collect()
    assert [tuple(r) for r in got] == [(a[0], *a[2:]) for a in asked]


def test_new_alerts_are_made_once_and_not_shuffled(spark):
    rng = random.Random(8)
    made = lambda rows, schema: spark.createDataFrame(rows, schema)
    days = ["2024-01-20", "2024-01-29", "2023-05-01"]
    ships = [(rng.randint(0, 30), 1, rng.choice(days), f"h{rng.randint(0, 6)}") for _ in range(160)]
    entities = [(i, rng.choice([1, 2, None])) for i in range(31)]
    followed = [(a, f"h{rng.randint(0, 6)}") for a in range(25) for _ in range(3)] + [(1, None)]
    wanted = [(a, rng.choice([1, 2, 2, None])) for a in range(25) for _ in range(a % 3)]
    allowed = [(a, a % 5) for a in range(25)]
    none = made([], "account long, entity_id long, saved_at timestamp")
    shipped = made(ships, "entity_id long, supplier_id long, day string, heading string").withColumn("day", F.to_date("day"))
    found = alerts.alerts(shipped, made([(1, False)], "supplier_id long, is_home boolean"), made(entities, "entity_id long, region int"), none, made(allowed, "account long, alerts int"), made(followed, "account long, heading string"), made(wanted, "account long, region int"), "region", "2024-01-31", "2024-01-31")
    assert found._jdf.queryExecution().optimizedPlan().nodeName() == "Union"
    first, heads, place = {}, {}, dict(entities)
    for e, _, d, h in ships:
        first[e] = min(d, first.get(e, d))
        heads.setdefault(e, set()).add(h)
    want = set()
    for a, n in allowed:
        wishes = {w for b, w in wanted if b == a} or {None}
        want |= {(a, "new", f"nb:{e}") for e, d in first.items() if n and d >= "2023-12-17" and heads[e] & {h for b, h in followed if b == a} and (None in wishes or place[e] in wishes)}
    rows = [tuple(r) for r in found.collect()]
    assert want and len(rows) == len(set(rows)) and set(rows) == want


@pytest.mark.parametrize("by_gram", [True, False])
@pytest.mark.parametrize("percent, block", [(50, 8192), (50, 9), (60, 30), (20, 15)])
def test_names_met_by_grams_or_each_once_give_all_pairs(spark, monkeypatch, by_gram, percent, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    rng = random.Random(9)
    said = sorted({" " + "".join(rng.choice("abc ") for _ in range(rng.randint(1, 30))).strip() + " " for _ in range(150)})
    grams = {n: sorted({n[i : i + 3] for i in range(len(n) - 2)}) for n in said if len(n) > 2}
    known = {g: k for k, g in enumerate(sorted({g for v in grams.values() for g in v}))}
    sets = spark.createDataFrame([(n, 1, sorted(known[g] for g in v)) for n, v in grams.items()], "name string, n long, grams array<int>")
    want = sorted((a.strip(), b.strip(), len(set(grams[a]) & set(grams[b]))) for a in grams for b in grams if a < b and 100 * len(set(grams[a]) & set(grams[b])) >= percent * len(set(grams[a]) | set(grams[b])))
    assert want and sorted((r["a"], r["b"], r["common"]) for r in similar.joined(sets, percent, by_gram).collect()) == want


def test_matches_are_given_out_in_parts(monkeypatch):
    monkeypatch.setattr(dictionary, "VALUES", 50)
    values = [[f"v{k}" for k in range(n)] for n in (20, 70, 1)]
    held = dictionary.Automaton(pa.array(["a", "b", "c"]), pa.array(values))
    texts = pa.array(["a", "b c", "a c", None, "x", "c"] * 7)
    parts = list(held.parts(texts))
    assert [b for b, _, _ in parts][1:] == [e for _, e, _ in parts][:-1] and parts[-1][1] == len(texts)
    assert all(e - b == 1 or sum(1 + len(m["found"]) for row in x.to_pylist() for m in row) <= 50 for b, e, x in parts)
    assert [r for _, _, x in parts for r in x.to_pylist()] == held.matches(texts).to_pylist()


def test_ngrams_that_are_no_phrases_are_not_joined(spark, monkeypatch):
    monkeypatch.setattr(dictionary, "AUTOMATON_BYTES", 0)
    texts = spark.createDataFrame([(i, f"no word of text {i} but red ring {i}") for i in range(200)], "id long, text string")
    found = dictionary.find_phrases(texts, spark.createDataFrame([(f"red ring {i}", "v") for i in range(0, 200, 2)], "phrase string, value string"))
    assert "explode" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.filter(F.size("matches") > 0).count() == 100


def test_new_alerts_are_stored_in_little_space(spark, tmp_path):
    accounts, n = spark.range(6000), 400
    ships = spark.range(2 * n).select((F.col("id") % n).alias("entity_id"), F.lit(1).cast("long").alias("supplier_id"), F.lit("2024-01-20").cast("date").alias("day"), F.lit("h").alias("heading"))
    old = spark.createDataFrame([(0, 1, "2023-05-01", "h"), (1, 1, None, "h"), (n, 1, None, "h"), (None, 1, "2024-01-20", "h")], "entity_id long, supplier_id long, day string, heading string").withColumn("day", F.to_date("day"))
    entities, followed = spark.range(n + 1).select(F.col("id").alias("entity_id"), F.lit(1).alias("region")), accounts.select(F.col("id").alias("account"), F.lit("h").alias("heading"))
    none = spark.createDataFrame([], "account long, entity_id long, saved_at timestamp")
    suppliers = spark.createDataFrame([(1, False)], "supplier_id long, is_home boolean")
    found = alerts.alerts(ships.union(old), suppliers, entities, none, followed.select("account", F.lit(1).alias("alerts")), followed, none.select("account", F.lit(1).alias("region")), "region", "2024-01-31", "2024-01-31")
    found.write.parquet(str(tmp_path / "alerts"))
    rows = spark.read.parquet(str(tmp_path / "alerts"))
    # entity 0 is known and the last has no day
    assert rows.distinct().count() == rows.count() == 6000 * (n - 1)
    assert {r[0] for r in rows.select("dedup_key").distinct().collect()} == {f"nb:{i}" for i in range(1, n)}
    assert sum(f.stat().st_size for f in (tmp_path / "alerts").glob("*.parquet")) < 0.5 * rows.count()
