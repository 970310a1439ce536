import numpy as np
import pytest

import corpus_pipeline as pipeline
from zenithal.llm import jaccard, simhash


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(texts):
    """For each text the least place of its component, by comparing every pair."""
    sets, comp = [shingle_set(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) and comp[i] != comp[j]:
                a, b = max(comp[i], comp[j]), min(comp[i], comp[j])
                comp = [b if c == a else c for c in comp]
    return comp


def texts_near_the_threshold():
    """Copies with words changed in several places, most between Jaccard 0.7 and 0.95, all with a line in common."""
    rng, out = np.random.default_rng(8), []
    for _ in range(40):
        words = [f"w{j}" for j in rng.integers(0, 3000, rng.integers(30, 300))]
        for share in (0, 0.01, 0.02, 0.025, 0.03):
            copy = [w if rng.random() >= share else "changed" for w in words]
            out.append(" ".join(copy) + " this line of the licence is in each and every one of them")
    return [*out, "", None, " ", "one two", "ONE two", "one two three", "a b c d e f", "this line of the licence is in each and every one of them"]


@pytest.mark.parametrize("sample", [20_000, 10])
def test_stage_against_all_pairs(spark, monkeypatch, sample):
    monkeypatch.setattr(jaccard, "SAMPLE", sample)
    texts = texts_near_the_threshold()
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = {r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert got == set(brute(texts))


def test_large_groups_near_and_below_the_threshold(spark):
    """Hundreds of texts that are mostly one passage, most pairs of them just below 0.8, and copies of some."""
    rng = np.random.default_rng(9)
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join(passage + [f"w{j}" for j in rng.integers(0, 10**6, rng.integers(6, 11))]) for _ in range(250)]
    texts += [t + " end" for t in texts[:40]] + texts[:40]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = {r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert got == set(brute(texts))


def test_one_row_of_each_group_stays_without_and_with_equal_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(None, a), (None, b), (None, b + " more"), (5, c), (None, c), (5, d), (6, d), (7, d + " more"), (8, ""), (None, None)]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in pipeline.drop_near_duplicates(spark, docs, "").collect()), key=str)
    assert len(got) == 5 and {(None, a), (5, c), (5, d), (8, "")} <= set(got)
    assert sum(k is None and t.startswith(b) for k, t in got) == 1


def test_near_copies_are_not_compared_pair_by_pair(spark, monkeypatch):
    """Hundreds of near copies, a third of whose pairs are links: a few comparisons for each text join them."""
    rng, texts, compared, confirm = np.random.default_rng(10), [], [], jaccard.confirm

    def counted(pairs, *others):
        compared.append(pairs.select("a", "b").distinct().count())
        return confirm(pairs, *others)

    for i in range(300):
        words = [f"w{j}" for j in range(149)]
        for at in rng.choice(12, 2, replace=False).tolist():
            words[6 + 12 * at] = f"x{at}"
        texts.append(" ".join([*words, f"u{i}"]))
    monkeypatch.setattr(jaccard, "confirm", counted)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = {r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert got == set(brute(texts)) and sum(compared) < 300 * 30, compared


def test_marks_never_differ_in_more_bits_than_sets(spark):
    rng = np.random.default_rng(11)
    sets = [np.unique(rng.integers(-(2**63), 2**63 - 1, n)) for n in (0, 1, 40, 400, 3000)]
    sets += [np.unique(np.concatenate([s[5:], rng.integers(-(2**63), 2**63 - 1, 7)])) for s in sets]
    own = np.stack([c.to_numpy() for c in jaccard.marks(sets)]).view(np.uint64)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert np.bitwise_count(own[:, i] ^ own[:, j]).sum() <= len(np.setxor1d(a, b))


def test_wide_marks_fold_and_never_differ_in_more_bits_than_sets():
    rng = np.random.default_rng(12)
    sets = [np.unique(rng.integers(-(2**63), 2**63 - 1, n)) for n in (0, 40, 512, 513, 1024, 1025, 5000)]
    sets += [np.unique(np.concatenate([s[len(s) // 9 :], rng.integers(-(2**63), 2**63 - 1, len(s) // 40)])) for s in sets]
    wide = jaccard.wide_marks(sets).to_pylist()
    assert [w is None for w in wide] == [len(s) <= 512 for s in sets] and [len(w) for w in wide[3:7]] == [128, 128, 256, 1024]
    known = [k for k, w in enumerate(wide) if w]
    for i in known:
        for j in known:
            differ, apart = jaccard.differing(wide[i], wide[j]), len(np.setxor1d(sets[i], sets[j]))
            assert differ <= apart and (abs(i - j) in (0, 7) or 9 * differ > len(sets[i]) + len(sets[j]) or 4 * max(len(wide[i]), len(wide[j])) > 5 * min(len(wide[i]), len(wide[j])))


def near_duplicates_noted(spark, monkeypatch, module, name, texts):
    """What the stage keeps, and how many rows each table ``name`` has that it writes."""
    rows, write = [], module.materialize

    def noted(df, its_name, *others):
        out = write(df, its_name, *others)
        if its_name == name:
            rows.append(out.count())
        return out

    monkeypatch.setattr(module, "materialize", noted)
    monkeypatch.setattr(jaccard, "FREQUENT", 0)  # in so few texts what they share would be put last, beyond the prefixes
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    return {r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, "").collect()}, rows


def test_whole_sets_of_long_texts_that_share_a_passage_are_not_compared(spark, monkeypatch):
    """Two copies are; marks of 512 bits leave all other pairs possible, as texts have 1,500 shingles."""
    rng, passage = np.random.default_rng(13), [f"p{i}" for i in range(60)]
    texts = [" ".join([*passage, *(f"w{j}" for j in rng.integers(0, 10**6, 1500))]) for _ in range(40)]
    texts += [texts[0] + " end", " ".join(texts[1].split()[:-200])]
    kept, rows = near_duplicates_noted(spark, monkeypatch, jaccard, "jaccard-pairs", texts)
    assert kept == set(brute(texts)) == set(range(40)) and 2 <= sum(rows) < 20, rows


def test_texts_without_a_partner_of_their_size_are_not_in_the_index(spark, monkeypatch):
    line = " ".join(f"p{i}" for i in range(40))
    texts = [" ".join([line, *(f"w{k}-{j}" for j in range(k))]) for k in (20, 60, 150, 300)]
    kept, rows = near_duplicates_noted(spark, monkeypatch, simhash, "jaccard-index", texts)
    assert kept == set(brute(texts)) and rows == [0]
