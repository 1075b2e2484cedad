"""Personal data: exact patterns of four kinds, and identifiers that bootstrapped contexts reveal.

The base finds e-mail and IP addresses, card and phone numbers by fixed shapes. They are the seeds: the words around a
seed induce lexical patterns (kind, side, words). Everything that looks roughly like a kind, but isn't found by the base, is
an instance without a kind. Patterns and instances form a bipartite graph of distinct edges, so that copies count once.
Spark scores it in rounds: a pattern's confidence is the mean confidence of the instances in it, of which enough must be
known; an instance that is no seed is believed as the noisy-or of its confident patterns. Instances believed in the last round
become spans wherever a confident pattern holds them.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verascope.llm.common import written
from verascope.llm.tokens import portions

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Words that may name someone: with a digit or an `@`, and such words in a row.
_LOOSE = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+(?:\x20[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)*+")
_TRIM = "\"'`.,;:!?<>[]{}|=*_~#"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Characters beside a span in which its pattern's words are looked for, and the longest instance.
REACH, LONGEST = 64, 128


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """`[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, in time linear in the text: leftwards from each `@`."""
    end = 0
    for m in _DOMAIN.finditer(text):
        at = start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            end = m.end()
            yield start, end


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(x := g.lstrip("0")) <= 3 and int(x or "0") <= 255 for g in m.groups()):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 13 <= len(digits := m.group().replace(" ", "").replace("-", "")) <= 19 and _luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(m.group())) <= 15:
            yield m.span()


_FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed shapes, by kind and start; positions are code points."""
    return [(kind, *span) for kind, find in _FINDERS.items() for span in find(text)]


def shapes(value: str) -> list[str]:
    """Kinds that an instance can have by its characters alone; far wider than the base."""
    digits = sum("0" <= c <= "9" for c in value)
    out = []
    if "@" in value[1:-1]:
        out.append("email")
    elif digits:
        parts = re.split(r"[.:]", value)
        if 4 <= len(parts) <= 8 and all(re.fullmatch(r"[0-9A-Fa-f]{0,4}|\*|[xX]{1,3}", x) for x in parts):
            out.append("ip")
        if not re.search(r"[^0-9\x20().+/-]", value):
            if 12 <= digits <= 19 and not re.search(r"[().+/]", value):
                out.append("card")
            if 7 <= digits <= 15:
                out.append("phone")
    return out


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a span: two words before it, two after it, one on each side; lower-cased, digits as 0."""
    plain = lambda x: _DIGIT.sub("0", x.lower()).strip(_TRIM)
    cut = max(0, start - REACH)
    left = text[cut:start]
    before = _WORD.findall(left)
    if cut and before and not left[0].isspace():
        before = before[1:]  # a part of a word is no word
    right = text[end : end + REACH]
    after = _WORD.findall(right)
    if end + REACH < len(text) and after and not right[-1].isspace():
        after = after[:-1]
    before, after = [w for x in before[-3:] if (w := plain(x))][-2:], [w for x in after[:3] if (w := plain(x))][:2]
    out = []
    if len(before) == 2:
        out.append(f"< {before[0]} {before[1]}")
    if len(after) == 2:
        out.append(f"> {after[0]} {after[1]}")
    if before and after:
        out.append(f"<> {before[-1]} {after[0]}")
    return out


def loose(text: str, taken: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """Spans of words with a digit or `@`, and of such words in a row, apart from the spans taken."""
    held = sorted((a, b) for _, a, b in taken)
    starts = [a for a, _ in held]

    def free(a: int, b: int) -> bool:
        i = bisect_right(starts, a)
        return (i == 0 or held[i - 1][1] <= a) and (i == len(held) or held[i][0] >= b)

    for m in _LOOSE.finditer(text):
        words = [w.span() for w in _WORD.finditer(text, *m.span())]
        whole = [(m.start(), m.end())] if 1 < len(words) <= 8 else []
        for a, b in whole + words:
            value = text[a:b]
            a += len(value) - len(value.lstrip(_TRIM))
            b -= len(value) - len(value.rstrip(_TRIM))
            if a < b and b - a <= LONGEST and free(a, b):
                yield a, b


_MENTION = "struct<kind:string,seed:boolean,start:long,stop:long,value:string,contexts:array<string>>"
_SPANS = "array<struct<kind:string,start:long,stop:long>>"
_FOUND = f"uid string, base {_SPANS}, mentions array<{_MENTION}>"


def _found(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each row: its id, a uid, base spans, and mentions: base spans and loose ones with their contexts."""
    source = df.select(F.expr("uuid()").alias("uid"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])
        mention = pa.struct([("kind", pa.string()), ("seed", pa.bool_()), ("start", pa.int64()), ("stop", pa.int64()), ("value", pa.string()), ("contexts", pa.list_(pa.string()))])
        for b in portions(batches, 1):
            bases, mentions = [], []
            for text in b.column(1).to_pylist():
                base = base_spans(text or "")
                near = []
                for k, x, y in base:
                    near.append({"kind": k, "seed": True, "start": x, "stop": y, "value": text[x:y].lower(), "contexts": contexts(text, x, y)})
                for x, y in loose(text or "", base):
                    value = text[x:y].lower()
                    if kinds := shapes(value):
                        around = contexts(text, x, y)
                        near += [{"kind": k, "seed": False, "start": x, "stop": y, "value": value, "contexts": around} for k in kinds]
                bases.append([{"kind": k, "start": x, "stop": y} for k, x, y in base])
                mentions.append(near)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bases, pa.list_(span)), pa.array(mentions, pa.list_(mention)), b.column(2)], ["uid", "base", "mentions", "id"])

    return source.mapInArrow(run, f"{_FOUND}, id {kind}")


def believed(edges: DataFrame, rounds: int = 4, least_known: int = 3, sure: float = 0.6) -> DataFrame:
    """(pattern, value) of what bootstrapping adds: edges (pattern, value, seed), distinct, a pattern's kind in its name.

    Each round: a pattern's confidence is the sum of its instances' beliefs over their number, if that sum is least_known or
    more and the confidence `sure` or more; an instance's belief is one for seeds, else one minus the product of
    (1 - confidence) over its confident patterns. Beliefs only grow, as patterns do.
    """
    edges = written(edges, "pii-edges")
    belief = None
    confident = None
    for _ in range(rounds):
        if belief is None:
            weighted = edges.withColumn("belief", F.col("seed").cast("double"))
        else:
            weighted = edges.join(belief, "value", "left").withColumn("belief", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("belief", F.lit(0.0)))).select("pattern", "belief")
        sums = weighted.groupBy("pattern").agg(F.sum("belief").alias("known"), F.count("*").alias("n"))
        sums = sums.where((F.col("known") >= least_known) & (F.col("known") >= sure * F.col("n")))
        now = written(sums.select("pattern", (F.col("known") / F.col("n")).alias("confidence")), "pii-patterns")
        marks = now.agg(F.count("*"), F.sum(F.round(F.col("confidence"), 6))).first()
        if not marks[0] or marks == confident:
            break
        confident = marks
        doubt = F.sum(F.log1p(-F.least("confidence", F.lit(0.999))))
        belief = edges.where("not seed").join(now, "pattern").groupBy("value").agg((1 - F.exp(doubt)).alias("belief"))
        belief = written(belief, "pii-beliefs")
    if not marks[0]:
        return edges.select("pattern", "value").limit(0)
    return edges.where("not seed").join(now, "pattern").select("pattern", "value")


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 4, least_known: int = 3, sure: float = 0.6) -> DataFrame:
    """(doc_id, base, added) of every row: arrays of (kind, start, stop), base by kind and start; code points, stop exclusive.

    Null and empty texts have none. Repeated rows stay, a null id is no key and stays, too. Instances and contexts of copies
    count once. Where two kinds claim one place, both may be added; added spans never meet base ones nor an earlier
    added one of their kind. Other columns are not read. An empty table gives none. Texts may have any length.
    """
    found = written(_found(df, id_col, text_col), "pii-found")
    mentions = found.select("uid", F.explode("mentions").alias("m")).select("uid", "m.*")
    named = mentions.withColumn("pattern", F.explode("contexts")).withColumn("pattern", F.concat_ws(" ", "kind", "pattern"))
    # an instance is a seed of a kind, or a loose one that a kind may claim
    named = named.withColumn("value", F.concat_ws(" ", "kind", "value"))
    edges = named.groupBy("pattern", "value").agg(F.max("seed").alias("seed"))
    # patterns without enough seeds stay unknown unless other patterns teach their instances: both need a seed of the kind in reach
    added = believed(edges, rounds, least_known, sure)
    loose_ones = named.where("not seed").join(added, ["pattern", "value"], "left_semi")
    spans = loose_ones.select("uid", F.struct("kind", "start", "stop").alias("span")).groupBy("uid").agg(F.collect_set("span").alias("added"))
    both = found.join(spans, "uid", "left").select(F.col("id").alias("doc_id"), "base", "added")
    kind = both.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            apart = pa.array([_apart(x or []) for x in b.column(2).to_pylist()], b.schema.field(1).type)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), apart], ["doc_id", "base", "added"])

    return both.mapInArrow(run, f"doc_id {kind}, base {_SPANS}, added {_SPANS}")


def _apart(spans: list[dict]) -> list[dict]:
    """Spans by kind and start, of those that meet the first, of those that start together the longest."""
    out: list[dict] = []
    for x in sorted(spans, key=lambda x: (KINDS.index(x["kind"]), x["start"], -x["stop"])):
        if not out or out[-1]["kind"] != x["kind"] or out[-1]["stop"] <= x["start"]:
            out.append(x)
    return out


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of personal_data()."""
    kind = found.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"]
        line = lambda spans: ",".join(f"{k}:{a}:{b}" for _, a, b, k in sorted((KINDS.index(x["kind"]), x["start"], x["stop"], x["kind"]) for x in spans))
        for b in batches:
            base, added = b.column(1).to_pylist(), b.column(2).to_pylist()
            count = [[sum(x["kind"] == k for x in row) for row in base] for k in KINDS]
            sha = [sha256(line(row).encode()).hexdigest() for row in base]
            spans = [line(x + y) for x, y in zip(base, added, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in count], pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array([len(x) for x in added], pa.int64())], names)

    return found.select("doc_id", "base", "added").mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
