import random
import re
import time
from hashlib import sha256

import pytest

from verascope.llm import personal

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    doubled = [int(c) * 2 for c in digits[-2::-2]]
    return (sum(int(c) for c in digits[-1::-2]) + sum(x // 10 + x % 10 for x in doubled)) % 10 == 0


def plain(text):
    """The contract's expressions as they stand."""
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            fits = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")), "card": lambda: 13 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}
            if fits[kind]():
                out.append((kind, *m.span()))
    return out


def by_hand(rows, rounds=4, least_known=3, sure=0.6):
    """All rows' spans with the graph in dictionaries."""
    mentions, edges = [], {}
    for i, (_, text) in enumerate(rows):
        text = text or ""
        base = plain(text)
        near = [(k, True, a, b) for k, a, b in base] + [(k, False, a, b) for a, b in personal.loose(text, base) for k in personal.shapes(text[a:b].lower())]
        for k, seed, a, b in near:
            for c in personal.contexts(text, a, b):
                key = (f"{k} {c}", f"{k} {text[a:b].lower()}")
                mentions.append((i, k, seed, a, b, key))
                edges[key] = edges.get(key, False) or seed
    belief, confident = {}, {}
    for _ in range(rounds):
        known = {}
        for (p, v), seed in edges.items():
            known.setdefault(p, []).append(1.0 if seed else belief.get(v, 0.0))
        confident = {p: sum(x) / len(x) for p, x in known.items() if sum(x) >= least_known and sum(x) >= sure * len(x)}
        doubt = {}
        for (p, v), seed in edges.items():
            if not seed and p in confident:
                doubt[v] = doubt.get(v, 1.0) * (1 - min(confident[p], 0.999))
        belief = {v: 1 - x for v, x in doubt.items()}
    out = []
    for i, (doc, text) in enumerate(rows):
        base = plain(text or "")
        added = []
        for kind in personal.KINDS:
            spans = sorted({(a, -b) for j, k, seed, a, b, (p, v) in mentions if j == i and k == kind and not seed and not edges[p, v] and p in confident})
            end = 0
            for a, b in spans:
                if a >= end:
                    added.append((kind, a, -b))
                    end = -b
        order = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (personal.KINDS.index(s[0]), s[1])))
        out.append((doc, *[sum(k == x for k, _, _ in base) for x in personal.KINDS], sha256(order(base).encode()).hexdigest(), order(base + added), len(added)))
    return sorted(out, key=repr)


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "doc_id long, text string, kind string, uid string, base int")
    return sorted(map(tuple, personal.digests(personal.personal_data(df)).collect()), key=repr)


def test_base_equals_the_expressions():
    rng = random.Random(3)
    parts = ["a", "b@", "@", "c.d", ".", "-", "+", "1", "22", "255", "256", "0", " ", "  ", "(", ")", "\n", "é", "4111111111111111", "4111 1111 1111 1111", "%", "_", "a@b.c", "1.2.3.4", "+1 (988) 555-2485", "007"]
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert personal.base_spans(text) == plain(text), text


@pytest.mark.parametrize("text", ["a" * 1_000_000, "1 " * 300_000, "a.b@" * 200_000, "+" + " 1(" * 200_000, "1." * 200_000, "+1 " * 200_000])
def test_long_texts_take_linear_time(text):
    began = time.time()
    personal.base_spans(text)
    list(personal.loose(text, []))
    assert time.time() - began < 10


def corpus():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for i in range(12):
        rows.append((i, f"{word()} please contact jo{i}@mail{i}.example.com for details {word()}"))
        rows.append((100 + i, f"{word()} call me at +1 (988) 555-24{i:02} after nine {word()}"))
        rows.append((200 + i, f"{word()} release {i}.{i + 1}.30.400 is out now {word()}"))  # no address: a part is over 255
        rows.append((300 + i, f"{word()} on host {10 + i}.1.2.{i} runs {word()}"))
    rows.append((400, "please contact root@localhost for details"))  # no dot: only its context tells
    rows += [(410 + i, f"write to {x}@intranet or else contact {x}@intranet for details") for i, x in enumerate("abcd")]
    rows.append((420, "well write to zed@intern or else"))  # found by a pattern that only learned instances teach
    rows.append((430, "you may call me at 988 555 2485 after nine, not at 12 34"))
    rows.append((440, "release 1.2.30.401 is out now, in 2024 10 11 12 as well"))
    return rows


def test_contexts_reveal_what_the_base_misses(spark):
    rows = corpus()
    got = {r[0]: r for r in found(spark, rows)}
    cut = lambda doc: [dict(rows)[doc][int(a) : int(b)] for _, a, b in (s.split(":") for s in got[doc][6].split(",") if s)]
    assert cut(400) == ["root@localhost"] and got[400][1] == 0 and got[400][7] == 1
    assert cut(410) == ["a@intranet", "a@intranet"]
    assert cut(420) == ["zed@intern"]
    assert cut(430) == ["988 555 2485"]
    assert cut(440) == [] and all(cut(200 + i) == [] for i in range(12))
    assert cut(0) == ["jo0@mail0.example.com"] and got[0][7] == 0


def test_equals_a_plain_version_on_awkward_rows(spark):
    rows = corpus() + [(None, "please contact root@localhost for details"), (None, None), (7, ""), (7, None), (1, corpus()[0][1]), (8, "  \n\t "), (9, "please contact x@y"), (10, "word " * 30000 + "please contact far@off for details"), (11, "1@" * 20000)]
    rows += [rows[48]] * 30  # copies teach nothing
    assert found(spark, rows) == by_hand(rows)
    assert found(spark, []) == []
