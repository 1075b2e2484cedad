"""Byte-level BPE: DuckDB contracts token-position rows inside each Spark partition.

A partition's texts are cut into pieces by the tokenizer's pattern. Pieces that are tokens are done;
the distinct others go to DuckDB as rows (piece, position, id). A recursive query joins neighbouring
rows with the merge table, contracts the leftmost pair of least rank of every piece, and repeats until
no piece has a pair left. Ordered aggregation of a document's ids, joined with the vocabulary, decodes it.

A piece of over LONG_PIECE bytes goes alone: all its pairs of least rank are contracted in one step, from the left, which
gives the same ids unless the new token has pairs of less rank than its own (of such, one pair a step), and the query stops
after some steps and is asked again, so that its rows stay few. A piece of over HUGE_PIECE bytes may need as many steps as
bytes, over as many rows, if it repeats a pair of the second kind; a heap contracts those by the same rule.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG_PIECE, HUGE_PIECE = 256, 8192
#: Pieces that a worker remembers in each of two generations, bytes that one DuckDB query gets, bytes of text at a time.
REMEMBERED, QUERY_BYTES, TEXT_BYTES = 200_000, 600_000, 1_500_000

#: place: the piece's number and, in the low 16 bits, the token's position in it.
CONTRACT = """
WITH RECURSIVE state(place, id, ended) AS (
  SELECT w::BIGINT * 65536 + p, id, false FROM start
  UNION ALL
  (WITH pair AS MATERIALIZED (
     SELECT place, id, lead(id) OVER o AS id2, lead(place) OVER o AS place2 FROM state WHERE NOT ended WINDOW o AS (ORDER BY place)
   ), best AS (
     SELECT place >> 16 AS w, min(m.merged::BIGINT * 65536 + (place & 65535)) AS key, arg_min(place2, m.merged::BIGINT * 65536 + (place & 65535)) AS gone
     FROM pair JOIN merges m ON pair.id = m.l AND pair.id2 = m.r WHERE place >> 16 = place2 >> 16 GROUP BY 1
   )
   SELECT place, CASE WHEN key & 65535 = place & 65535 THEN (key >> 16)::INTEGER ELSE id END, best.w IS NULL
   FROM pair LEFT JOIN best ON best.w = place >> 16 WHERE best.w IS NULL OR place <> gone)
)
SELECT place, id FROM state WHERE ended ORDER BY place
"""

#: One piece: `steps` contractions at most. spot: the place among the rows that are left; a run of overlapping pairs
#: (their spots follow one another) gives every other one.
CONTRACT_LONG = """
WITH RECURSIVE state(p, id, step, ended) AS (
  SELECT p, id, 0, false FROM start
  UNION ALL
  (WITH pair AS MATERIALIZED (
     SELECT s.p, s.id, s.p2, s.spot, s.step, m.merged
     FROM (SELECT p, id, step, lead(id) OVER o AS id2, lead(p) OVER o AS p2, row_number() OVER o AS spot FROM state WHERE NOT ended AND step < {steps} WINDOW o AS (ORDER BY p)) s
     LEFT JOIN merges m ON s.id = m.l AND s.id2 = m.r
   ), least AS MATERIALIZED (
     SELECT p, p2, merged, spot, spot - row_number() OVER (ORDER BY p) AS run FROM pair WHERE merged = (SELECT min(merged) FROM pair)
   ), chosen AS MATERIALIZED (
     SELECT p, p2, merged FROM (SELECT *, min(spot) OVER (PARTITION BY run) AS first, min(spot) OVER () AS front FROM least) WHERE CASE WHEN merged IN (SELECT id FROM risky) THEN spot = front ELSE (spot - first) % 2 = 0 END
   )
   SELECT pair.p, coalesce(c.merged, pair.id), pair.step + 1, NOT EXISTS (FROM chosen) FROM pair LEFT JOIN chosen c ON c.p = pair.p WHERE pair.p NOT IN (SELECT p2 FROM chosen))
)
SELECT p, id, ended FROM state WHERE ended OR step = {steps} ORDER BY p
"""
#: Rows that the steps of one such query may leave behind.
LONG_ROWS = 4_000_000

DECODE = "SELECT w, string_agg(v.hex, '' ORDER BY p) AS hex FROM given g JOIN vocabulary v ON v.id = g.id GROUP BY w"


class Coder:
    """The tables of one rank file, and what this process has encoded so far."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.find = regex.compile(pattern).findall
        pairs = [
            (self.ranks[t[:i]], self.ranks[t[i:]], rank)
            for t, rank in self.ranks.items()
            for i in range(1, len(t))
            if t[:i] in self.ranks and t[i:] in self.ranks
        ]
        left, right, merged = (pa.array(c, pa.int32()) for c in zip(*pairs, strict=True)) if pairs else [pa.array([], pa.int32())] * 3
        self.con = duckdb.connect()
        self.con.execute("SET threads = 1")
        self.con.execute("SET memory_limit = '400MB'")
        self.con.execute("SET temp_directory = ''")
        self.con.register("merges_in", pa.table({"l": left, "r": right, "merged": merged}))
        self.con.execute("CREATE TABLE merges AS SELECT * FROM merges_in")
        self.con.register(
            "vocabulary_in",
            pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "hex": [t.hex() for t in self.ranks]}),
        )
        self.con.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary_in")
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        #: tokens that are part of a pair of less rank than their own
        risky = {x for a, b, m in pairs for x in (a, b) if m < x}
        self.con.register("risky_in", pa.table({"id": pa.array(risky, pa.int32())}))
        self.con.execute("CREATE TABLE risky AS SELECT * FROM risky_in")
        #: Piece -> its ids as little-endian unsigned 32-bit integers.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def contract(self, pieces: list[bytes]) -> list[bytes]:
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts = np.cumsum(lengths) - lengths
        total = int(lengths.sum())
        piece = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
        position = (np.arange(total) - np.repeat(starts, lengths)).astype(np.int32)
        ids = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        self.con.register("start", pa.table({"w": piece, "p": position, "id": ids}))
        out = self.con.sql(CONTRACT).to_arrow_table()
        packed = out.column("id").to_numpy().astype("<u4").tobytes()
        ends = (4 * np.searchsorted(out.column("place").to_numpy() >> 16, np.arange(len(pieces) + 1))).tolist()
        return [packed[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def contract_long(self, piece: bytes) -> bytes:
        """The ids of one piece of any length."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        ended = not len(ids)
        while not ended:
            self.con.register("start", pa.table({"p": np.arange(len(ids), dtype=np.int64), "id": ids}))
            steps = max(1, LONG_ROWS // len(ids))
            out = self.con.sql(CONTRACT_LONG.format(steps=steps)).to_arrow_table()
            ids, ended = out.column("id").to_numpy().astype(np.int32), out.column("ended")[0].as_py()
        return ids.astype("<u4").tobytes()

    def contract_by_heap(self, piece: bytes) -> bytes:
        """The same rule by a heap of (rank, position) over a linked list."""
        n, ids = len(piece), [int(self.byte_ids[b]) for b in piece]
        text, after, before = [bytes([b]) for b in piece], list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, bytes]] = []

        def offer(i: int) -> None:
            if 0 <= i and text[i] and after[i] < n and (rank := self.ranks.get(both := text[i] + text[after[i]])) is not None:
                heapq.heappush(heap, (rank, i, both))

        for i in range(n - 1):
            offer(i)
        while heap:
            rank, i, both = heapq.heappop(heap)
            j = after[i]
            if not text[i] or j >= n or text[i] + text[j] != both:
                continue
            ids[i], text[i], text[j], after[i] = rank, both, b"", after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            offer(before[i])
        return np.array([ids[k] for k in range(n) if text[k]], "<u4").tobytes()

    def learn(self, pieces: set[str]) -> None:
        queued: list[str] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if queued:
                self.known.update(zip(queued, self.contract([q.encode() for q in queued]), strict=True))
                queued.clear()
                size = 0

        for piece in pieces:
            raw = piece.encode()
            if (rank := self.ranks.get(raw)) is not None:
                self.known[piece] = rank.to_bytes(4, "little")
            elif len(raw) > LONG_PIECE:
                self.known[piece] = self.contract_long(raw) if len(raw) <= HUGE_PIECE else self.contract_by_heap(raw)
            else:
                queued.append(piece)
                size += len(raw)
                if size > QUERY_BYTES:
                    flush()
        flush()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text."""
        cut = [self.find(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        missing = set().union(*cut) - known.keys()
        known.update((p, older[p]) for p in missing if p in older)
        self.learn(missing - known.keys())
        return [b"".join(map(known.__getitem__, pieces)) for pieces in cut]

    def decode(self, packed: list[bytes | None]) -> list[bytes]:
        """Bytes of whole id sequences; ids that no token has give nothing."""
        arrays = [np.frombuffer(b or b"", "<u4") for b in packed]
        lengths = np.array([len(a) for a in arrays], np.int64)
        if not lengths.sum():
            return [b""] * len(packed)
        starts = np.cumsum(lengths) - lengths
        given = {
            "w": np.repeat(np.arange(len(arrays), dtype=np.int32), lengths),
            "p": (np.arange(int(lengths.sum())) - np.repeat(starts, lengths)).astype(np.int32),
            "id": np.concatenate(arrays).view(np.int32),
        }
        self.con.register("given", pa.table(given))
        out = [b""] * len(packed)
        for w, h in self.con.sql(DECODE).fetchall():
            out[w] = bytes.fromhex(h)
        return out


_CODERS: dict[tuple[str, str], Coder] = {}


def coder(ranks_path: str, pattern: str) -> Coder:
    """One per process: worker processes keep it from task to task."""
    key = (ranks_path, pattern)
    if key not in _CODERS:
        _CODERS[key] = Coder(ranks_path, pattern)
    return _CODERS[key]


def slices(batch: pa.RecordBatch, column: int, limit: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about limit bytes of one column, a row at least each."""
    offsets = np.zeros(batch.num_rows + 1, np.int64)
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    offsets[1:] = np.cumsum(sizes.to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) of every row: ids as little-endian unsigned 32-bit integers, and the bytes they decode to.

    Null and empty texts give empty ids and decode to nothing. Repeated rows and ids stay apart, a null doc_id too; of pairs
    of one rank the leftmost goes first. Texts, and pieces within them, may have any length. Other columns are not read, so
    their names may clash. An empty table gives no row.
    """
    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(ranks_path, pattern)
        for whole in batches:
            for part in slices(whole, 1):
                ids = c.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(c.decode(ids), pa.binary())], ["doc_id", "ids", "decoded"])

    return source.mapInArrow(run, f"doc_id {kind}, ids binary, decoded binary")


def decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded) of rows of packed ids; null ids decode to nothing."""
    source = df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(ranks_path, pattern)
        for whole in batches:
            for part in slices(whole, 1):
                out = pa.array(c.decode(part.column(1).to_pylist()), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), out], ["doc_id", "decoded"])

    return source.mapInArrow(run, f"doc_id {kind}, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    """Counts and SHA-256 digests of what encode() returns."""
    return encoded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
