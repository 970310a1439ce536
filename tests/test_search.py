"""Stems, full-text search, fuzzy names, communities: against published words and plain Python."""

import itertools
import math
import random
import re
import struct
from collections import defaultdict

import duckdb
import pytest
from conftest import SF
from pyspark.sql import functions as F

from zenithal.functions.stem import stem_sql, stems
from zenithal.operators import communities, fulltext, retrieval, trigrams
from zenithal.plans.registry import QUERIES

#: The sample vocabulary published with the rules, and their examples.
WORDS = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consisting consist consists consist
consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol consols consol
consonant conson consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir
constable constabl constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee
kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit
knives knive knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot
skies sky dying die news news inning inning innings inning proceed proceed generate generat generously generous communication communic arsenal arsenal hopping hop hoping hope tied tie cries cri gas gas this this gaps gap kiwis kiwi
luxuriated luxuri happy happi say say by by cry cri enjoy enjoy relational relat rational ration analogies analog sensibilities sensibl boys boy youth youth bed bed feed feed agreed agre at at formative format rate rate roll roll""".split()


def test_stems_of_published_words(spark):
    want = dict(itertools.batched(WORDS, 2))
    got = {r.word: r.stem for r in stems(spark.createDataFrame([(w,) for w in [*want, None]], "word string")).collect()}
    assert got == want | {None: None}
    con = duckdb.connect()
    con.sql("create table w (word varchar)")
    con.executemany("insert into w values (?)", [(w,) for w in want])
    assert dict(con.sql(stem_sql("SELECT word FROM w")).fetchall()) == want


def ranked(docs, query, stem):
    cut = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    asked = sorted({stem(w) for w in cut(query) if w not in fulltext.STOP})
    out = {}
    for key, text in docs:
        at = defaultdict(set)
        for i, w in enumerate(cut(text)):
            if w not in fulltext.STOP:
                at[stem(w)].add(i + 1)
        if not asked or any(s not in at for s in asked):
            continue
        if len(asked) == 1:
            out[key] = 0.1 * sum(1 / i**2 for i in range(1, len(at[asked[0]]) + 1)) / 1.64493406685
            continue
        left = 1.0
        for a, b in itertools.combinations(asked, 2):
            for p, q in itertools.product(at[a], at[b]):
                if 0 < abs(p - q) <= 100:
                    left *= 1 - 0.1 * math.sqrt(1 / (1.005 + 0.05 * math.exp(abs(p - q) / 1.5 - 2)))
        out[key] = 1 - left if left < 1 else 1e-20
    return sorted(((round(s, 9), k) for k, s in out.items()), key=lambda x: (-x[0], x[1]))


def test_full_text_ranks_by_positions(spark):
    docs = [(1, "The satellites orbit. An orbiting satellite, orbits!"), (2, "orbit " + "x " * 99 + "satellite"), (3, "orbit " + "x " * 120 + "satellite"), (4, "satellite"), (5, None), (6, ""), (7, "the of and"), (8, "Satellite debris orbiting debris " * 70), (9, "Bahn-Satelliten É99 orbit's")]
    queries = [(1, "orbiting satellites"), (2, "the"), (3, "debris"), (4, "debris orbit the satellite"), (5, "nothing here"), (6, None), (7, "É99"), (8, "orbit orbits")]
    names = {w for _, t in [*docs, *queries] for w in re.split(r"[\W_]+", (t or "").lower()) if w}
    table = {r.word: r.stem for r in stems(spark.createDataFrame([(w,) for w in names], "word string")).collect()}
    index = fulltext.build(spark.createDataFrame(docs, "id long, body string").repartition(3), "id", "body")
    got = defaultdict(list)
    for r in fulltext.search(index, spark.createDataFrame(queries, "query long, text string"), 5).orderBy("query", "rank").collect():
        got[r.query].append((r.score, r.key))
    for n, q in queries:
        want = ranked(docs, q, table.__getitem__)[:5]
        assert [k for _, k in got[n]] == [k for _, k in want] and [s for s, _ in got[n]] == pytest.approx([s for s, _ in want], abs=2e-9), q


def test_a_search_reads_the_buckets_of_its_words(spark):
    index = fulltext.build(spark.createDataFrame([(i, f"word{i} common") for i in range(200)], "id long, body string"), "id", "body")
    assert index.postings.count() == 400
    plan = index.places(spark.createDataFrame([("word7",)], "stem string"))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (=|IN)", plan)


def grams(name):
    return {("  " + w + " ")[i : i + 3] for w in re.split("[^a-z0-9]+", name.lower()) if w for i in range(len(w) + 1)}


@pytest.mark.parametrize("piece", [3, 1 << 15])
@pytest.mark.parametrize("least", [0.3, 0.5, 1.0])
def test_trigram_search_equals_all_pairs(spark, piece, least, monkeypatch):
    monkeypatch.setattr(trigrams, "PIECE", piece)  # a small piece cuts every frequent trigram
    names = ["red widget", "red widgets", "Red-Widget", "large red widget", "wid", "w", "", None, "...", "blue gadget", "blue gadgets", "ab", "abc", "abcd", "widget red red", "x y z", "zyx"] + [f"widget {i}" for i in range(12)]
    asked = ["red widgets", "abc", "nothing alike", "", None, "blue gadget", "blue gadget", "widget 1"]
    index = trigrams.build(spark.createDataFrame([(n,) for n in names], "name string"), "name", least)
    got = {(r.query, r.name): round(r.similarity, 9) for r in trigrams.search(index, spark.createDataFrame([(n,) for n in asked], "query string")).collect()}
    alike = lambda a, b: len(grams(a) & grams(b)) / max(1, len(grams(a) | grams(b)))
    assert got == {(a, b): round(alike(a, b), 9) for a in {x for x in asked if x} for b in {x for x in names if x} if grams(a) and alike(a, b) >= least}
    if piece == 3:
        assert index.grams.agg(F.max("pieces")).first()[0] > 3


def test_the_index_refuses_lower_similarities_than_its_own(spark):
    index = trigrams.build(spark.createDataFrame([("abc",)], "name string"), "name", 0.5)
    with pytest.raises(ValueError):
        trigrams.search(index, spark.createDataFrame([("abc",)], "query string"), 0.3)


def test_communities_of_a_hub_and_of_cliques(spark):
    """A hub with many neighbours keeps the cliques apart; edges may be repeated, loops and nulls are there."""
    cliques = [(f"c{c}-{i}", f"c{c}-{j}") for c in range(4) for i in range(6) for j in range(i)]
    edges = cliques + [("c0-0", "c1-0"), ("c2-0", "c3-0")] + [("hub", f"leaf{i:03}") for i in range(200)] + [("hub", "c0-1"), ("c0-0", "c0-0"), (None, "c0-0"), ("c0-0", None)]
    members, levels = communities.louvain(spark.createDataFrame(edges, "src string, dst string"))
    label = {r.id: r.community for r in members.collect()}
    assert len(label) == 24 + 201 and all(label[f"c{c}-{i}"] == f"c{c}-0" for c in range(4) for i in range(6))
    assert all(label[f"leaf{i:03}"] == "hub" for i in range(200)) and label["hub"] == "hub"
    assert levels.count() >= 1


def test_communities_without_edges(spark):
    members, levels = communities.louvain(spark.createDataFrame([], "src long, dst long"))
    assert members.collect() == [] and levels.collect() == []


def brute_sparse(texts, queries, k):
    """(query, key) to score: products of word weights to twelve digits, each query's k best."""

    def weights(t):
        n = defaultdict(int)
        for w in (t or "").lower().split():
            n[w] += 1
        return {w: c / max(n.values()) for w, c in n.items()}

    out = {}
    for q, asked in queries:
        asked, scores = weights(asked), []
        for key, t in texts:
            have = weights(t)
            if both := set(asked) & set(have):
                scores.append((-sum(math.floor(have[w] * asked[w] * 1e12 + 0.5) for w in both), key))
        out |= {(q, key): -s / 1e12 for s, key in sorted(scores)[:k]}
    return out


def test_sparse_search_equals_all_pairs_and_shuffles_lists_only(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 7)  # several blocks
    rng = random.Random(3)
    texts = [(i, " ".join(f"W{int(rng.paretovariate(0.6))}" for _ in range(rng.randrange(40)))) for i in range(300)]
    texts += [(300 + i, "same words same") for i in range(40)] + [(400, None), (401, ""), (402, " \t ")]
    queries = [*texts[::20], (900, "same"), (901, None), (902, "unheard of")]
    df = spark.createDataFrame(texts, "id long, x string").repartition(3)
    asked = retrieval.term_weights(spark.createDataFrame(queries, "id long, x string"), "id", "x").withColumnRenamed("key", "query")
    found = retrieval.sparse_search(df, "id", "x", asked, 5)
    assert {(r["query"], r.key): r.score for r in found.collect()} == brute_sparse(texts, queries, 5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan  # no row for each pair


@pytest.mark.parametrize("least", [None, 0.2])
def test_dense_search_equals_all_pairs(spark, least, monkeypatch):
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 7)
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(2 + i % 2)]) for i in range(300)] + [(300 + i, [1.0, 2.0]) for i in range(300)] + [(900, None), (901, []), (902, [0.0, 0.0]), (903, [1.0, None])]
    queries = [*rows[::25], (950, [2.0, 4.0]), (951, [-1.0, -2.0]), (952, None), (953, [1.0] * 9)]
    found = retrieval.dense_search(spark.createDataFrame(rows, "id int, v array<float>"), spark.createDataFrame(queries, "query int, v array<float>"), "id", "v", 5, least)
    got = {(r["query"], r["rank"]): r.key for r in found.collect()}
    f32 = lambda v: [struct.unpack("f", struct.pack("f", x))[0] for x in v]
    unit = lambda v: [x / math.hypot(*v) for x in v] if v and None not in v and any(v) else None
    want = {}
    for q, a in queries:
        a, scores = unit(a and None not in a and f32(a)), []
        for key, b in rows:
            b = unit(b and None not in b and f32(b))
            if a and b and len(a) == len(b) and ((s := sum(x * y for x, y in zip(a, b, strict=True))) >= (least or -2)):
                scores.append((-round(s, 9), key))
        want |= {(q, i): key for i, (_, key) in enumerate(sorted(scores)[:5])}
    assert got == want
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_r13_meets_the_texts_once_and_sorts_none(spark):
    plan = QUERIES["r13_retrieval_pipeline"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "n_chars" not in plan  # documents are not met again; what it reads are the texts of its lists


def test_fuzzy_names_gather_no_candidates(spark):
    index = trigrams.build(spark.createDataFrame([(f"Customer#{i:09d}",) for i in range(300)], "name string"), "name", 0.8)
    found = trigrams.search(index, spark.createDataFrame([("Customer#000000100",)], "query string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Join") == 1
    mine, names = grams("Customer#000000100"), [f"Customer#{i:09d}" for i in range(300)]
    assert sorted(r.name for r in found.collect()) == [n for n in names if len(mine & grams(n)) / len(mine | grams(n)) >= 0.8]


def test_words_are_dealt_out_and_places_meet_matches_only(spark, monkeypatch):
    """The lexicon is as many files as a shuffle has tasks, whatever its size; no place of a text without all stems is a hit."""
    made, keep = {}, fulltext.materialize
    monkeypatch.setattr(fulltext, "materialize", lambda df, name: made.setdefault(name, keep(df, name)))
    index = fulltext.build(spark.createDataFrame([(i, f"word{i} common") for i in range(200)], "id long, body string"), "id", "body")
    assert len({r[0] for r in index.lexicon.select(F.input_file_name()).distinct().collect()}) > 1
    found = fulltext.search(index, spark.createDataFrame([(1, "common"), (2, "common word7")], "query long, text string"), 3).collect()
    assert sorted((r.query, r.key) for r in found) == [(1, 0), (1, 1), (1, 2), (2, 7)] and made["fulltext-hits"].count() == 2
