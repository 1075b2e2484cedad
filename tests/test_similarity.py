import random
from itertools import combinations

from pyspark.sql import functions as F

from verascope.operators import bots, similarity


def texts(n, seed=4):
    """Accounts of variants of a few texts, copies, short texts of frequent words, and a hot account."""
    rng = random.Random(seed)
    common = ["the", "of", "a", "and"]
    word = lambda: f"w{rng.randint(0, 3000)}"
    bases = [[word() for _ in range(rng.randint(3, 60))] for _ in range(12)]
    rows = []
    for i in range(n):
        account = "hot" if rng.random() < 0.6 else f"a{rng.randint(0, 5)}"
        kind = rng.random()
        if kind < 0.4:
            t = list(rng.choice(bases))
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = word()
        elif kind < 0.6:
            t = rng.sample(common, rng.randint(1, 4))
        else:
            t = common + [word() for _ in range(rng.randint(1, 40))]
        rows.append((account, " ".join(x.upper() if rng.random() < 0.1 else x for x in t)))
    return rows + [("hot", None), ("hot", ""), ("hot", " \t"), (None, "the of"), ("one", "alone"), ("two", ""), ("two", "")]


def plain(rows, limit):
    out = {}
    for account in {a for a, _ in rows if a is not None}:
        sets = [set((t or "").lower().split()) for a, t in rows if a == account]
        alike = sum(bool(x and y) and len(x & y) / len(x | y) > limit for x, y in combinations(sets, 2))
        pairs = len(sets) * (len(sets) - 1) // 2
        out[account] = (len(sets), pairs, alike / pairs if pairs else 0.0)
    return out


def test_all_pairs_over_the_limit(spark):
    rows = texts(700)
    for limit in (0.85, 0.5, 0.8):
        found = bots.cloning_of_all(spark.createDataFrame(rows, "account string, text string"), limit=limit).collect()
        assert {r[0]: (r[1], r[2], r[3]) for r in found} == plain(rows, limit)
    assert bots.cloning_of_all(spark.createDataFrame([], "account string, text string")).collect() == []


def test_few_pairs_are_candidates_and_no_word_gathers_them(spark):
    rng = random.Random(2)
    rows = [("hot", " ".join(["the", "of", "and", *(f"w{rng.randint(0, 5000)}" for _ in range(30))])) for _ in range(1500)]
    rows += [("hot", rows[i % 7][1] + " more") for i in range(200)]  # copies are one set
    sets = similarity.by_rarity(similarity.word_sets(spark.createDataFrame(rows, "account string, text string"), "account", "text")).cache()
    n = sets.count()
    assert n == 1507
    found = similarity.candidates(sets, "account", 0.85)
    assert found.count() < 0.01 * n * (n - 1) / 2
    pairs = similarity.similar_pairs(sets, "account", 0.85)
    assert sorted(r[0] for r in pairs.groupBy("copies").count().collect()) == [28, 29]
    # the index holds rare words: none of those in every text
    heads = sets.select(F.explode(F.slice("words", 1, 6)).alias("word")).groupBy("word").count().agg(F.max("count")).first()[0]
    assert heads < 0.02 * n


def test_any_order_finds_the_same_pairs(spark):
    rows = texts(300, seed=9)
    sets = similarity.word_sets(spark.createDataFrame(rows, "account string, text string").where("account is not null"), "account", "text")
    one, two = ({(r.x, r.y) for r in similarity.similar_pairs(similarity.by_rarity(sets, k), "account", 0.6).collect()} for k in (3, 1 << 16))
    assert one == two and len(one) > 20


def test_one_shared_rare_word_makes_no_candidate(spark):
    """Eighty sets of words of their own but for one rare word; ten variants of a text stay candidates."""
    rng = random.Random(3)
    own = lambda i, k: [f"v{i}x{j}" for j in range(k)]
    some = lambda k: rng.sample([f"w{j}" for j in range(300)], k)
    rows = [("a", " ".join(["rare", *own(i, 1), *some(30)])) for i in range(80)] + [("b", " ".join(some(60))) for i in range(600)]
    base = own("base", 40)
    rows += [("a", " ".join([*base[:-1], f"last{i}"])) for i in range(10)]
    sets = similarity.by_rarity(similarity.word_sets(spark.createDataFrame(rows, "account string, text string"), "account", "text")).cache()
    assert similarity.similar_pairs(sets, "account", 0.85).where("account = 'a'").count() == 45
    assert similarity.candidates(sets, "account", 0.85).where("account = 'a'").count() < 100
