import random
import re
from collections import Counter

import numpy as np
import pytest

from verascope.llm import phrases
from verascope.llm.automaton import SuffixAutomaton

SCHEMA = "doc_id long, text string, lang string, phrase string, f int, n int"


def plain(rows, least, most_words, per_lang):
    """Every phrase, every cut and every longer phrase."""
    total, f = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, most_words + 1) for i in range(len(w) - k + 1))
    kept = {x: c for x, c in f.items() if c >= least and len(x[1]) > 1}
    out = {}
    for (lang, p), a in kept.items():
        if any(lg == lang and len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (lg, q), b in kept.items()):
            continue
        cuts = [(1000 * a * total[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i, p.decode(), -a, left, right, total[lang], -s) for lang, x in out.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:per_lang], 1))


def found(spark, rows, least, most_words=5, per_lang=2000):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, phrases.collocations(df, least, most_words, per_lang).collect()))


def texts(n, seed=2):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "new", "york", "city", "a", "é", "Ünd", "x1", "état", " "]
    common = ["in New York city hall", "of the", "a a a", "no-one else\tknows"]
    part = lambda: rng.choice(common) if rng.random() < 0.3 else rng.choice(vocabulary)
    return [(i, "".join(part() + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", "\r", "; "]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "en", "fr", None, "und", ""]), "", 0, 0) for i in range(n)]


@pytest.mark.parametrize("least, most_words, per_lang, shard", [(3, 5, 2000, 300), (5, 3, 7, 1 << 20), (2, 5, 40, 5000)])
def test_equals_brute_force(spark, monkeypatch, least, most_words, per_lang, shard):
    monkeypatch.setattr(phrases, "SHARD", shard)
    rows = texts(150)
    expected = plain(rows, least, most_words, per_lang)
    assert len(expected) > 20
    assert found(spark, rows, least, most_words, per_lang) == expected


def test_awkward_rows(spark):
    rows = [(1, None, "en", "", 0, 0), (2, "", None, "", 0, 0), (3, " .,;\n", "de", "", 0, 0), (4, "solo", "it", "", 0, 0), (5, "la " * 40000, "fr", "", 0, 0)] + [(6, "same words here", "en", "", 0, 0)] * 5 + [(None, "w" * 200000 + " end", "en", "", 0, 0)]
    assert found(spark, rows, 3) == plain(rows, 3, 5, 2000)
    assert found(spark, [], 2) == []


def test_large_counts_stay_exact(spark):
    # products pass 64 bits
    rows = [("en", 0, "", 9 * 10**15), ("en", 1, "p", 7 * 10**12 + 1), ("en", 1, "q", 3 * 10**12 + 7), ("en", 2, "p q", 10**12 + 3)]
    got = phrases.scored(spark.createDataFrame(rows, "lang string, k int, phrase string, f long")).first()
    assert got["score"] == 1000 * (10**12 + 3) * 9 * 10**15 // ((7 * 10**12 + 1) * (3 * 10**12 + 7))


def test_states_are_classes_of_end_places():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 3, 400)
    run = np.ones(400, np.int64)
    for i in range(1, 400):
        run[i] = 1 if rng.random() < 0.1 else run[i - 1] + 1
    depth = 6
    made = SuffixAutomaton(words, run, depth)
    ends = {}
    for i in range(400):
        for k in range(1, min(depth, run[i]) + 1):
            ends.setdefault(tuple(words[i - k + 1 : i + 1]), []).append(i)
    longest, link = made.states()
    assert sum(len(x.count) for x in made.levels) == len(ends)
    for k, level in enumerate(made.levels, 1):
        for j, place in enumerate(level.place.tolist()):
            s = tuple(words[place - k + 1 : place + 1])
            assert level.count[j] == len(ends[s])
            left = [ends[x] for x in ends if len(x) == k + 1 and x[1:] == s]
            assert longest[k - 1][j] == (ends[s] not in left)
            shorter = [m for m in range(1, k) if ends[s[k - m :]] != ends[s]]
            assert link[k - 1][j] == max(shorter, default=0)
