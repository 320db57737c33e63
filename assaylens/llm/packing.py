"""Packing documents into sequences: dominance reduction, then best fit.

Documents become token pieces of at most ``capacity`` tokens. Which piece goes where
depends on lengths alone, and there are at most ``capacity`` different ones, so the
instance that is solved is the histogram of lengths, whatever the number of documents:

1. Reduction after Martello and Toth. For the longest piece left, a set of pieces is
   sought that dominates every other set that fits with it: exchanging the others for
   it can never need more sequences. Such a set is fixed for good, as many times as the
   counts allow, and the instance shrinks. Sets of one (nothing fits beside it), two
   (the partner fills the gap, or no combination of the pieces left reaches past it) and
   three pieces are tried.
2. The rest is packed by best fit, longest first. Equal sequences are kept as one run
   with a count, so a step handles all pieces of a length together.

The outcome is a table of slots: pieces ranked from r on of a length go to the sequences
from s on, m to each, at an offset. A run is only ever cut into a used part and a rest,
so the table stays in the order of the number of lengths.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaylens.llm.tables import stored

CAPACITY = 2048
END = 0  # the id that ends a document


# ---------------------------------------------------------------- the plan


@dataclass
class Slot:
    """``count`` pieces of a length from rank ``rank`` on: ``each`` to a sequence from ``first`` on."""

    length: int
    rank: int
    count: int
    first: int
    each: int
    offset: int


class _Instance:
    """Counts of lengths, with what has been dealt out of each."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.left = {k: v for k, v in counts.items() if v > 0}
        self.lengths = sorted(self.left)
        self.dealt: dict[int, int] = defaultdict(int)
        self.slots: list[Slot] = []
        self.sequences = 0

    def take(self, length: int, count: int, first: int, each: int, offset: int) -> None:
        self.slots.append(Slot(length, self.dealt[length], count, first, each, offset))
        self.dealt[length] += count
        self.left[length] -= count
        if not self.left[length]:
            del self.left[length]
            self.lengths.pop(bisect.bisect_left(self.lengths, length))

    def largest(self, limit: int, spare: dict[int, int]) -> int:
        """The largest length up to a limit of which more is left than ``spare``; 0 if none."""
        at = bisect.bisect_right(self.lengths, limit) - 1
        while at >= 0 and self.left[self.lengths[at]] <= spare.get(self.lengths[at], 0):
            at -= 1
        return self.lengths[at] if at >= 0 else 0

    def fix(self, members: tuple[int, ...]) -> None:
        """Give as many sequences of their own to a set of lengths as there are copies of it."""
        need = {x: members.count(x) for x in members}
        times = min(self.left[x] // n for x, n in need.items())
        offset = 0
        for x, n in need.items():
            self.take(x, times * n, self.sequences, n, offset)
            offset += n * x
        self.sequences += times


def _reachable(instance: _Instance, gap: int) -> int:
    """Bits of the sums up to a gap that two or more pieces can make, each used at will."""
    mask = (1 << (gap + 1)) - 1
    usable = [x for x in instance.lengths if x <= gap]
    sums = 0
    for x in usable:
        sums |= 1 << x
    for x in usable:
        shift = x
        while shift <= gap:
            sums |= (sums << shift) & mask
            shift *= 2
    two = 0
    for x in usable:
        two |= (sums << x) & mask
    return two


def dominating(instance: _Instance, j: int, capacity: int) -> tuple[int, ...] | None:
    """A set with the length j that dominates all other sets with it, or None.

    A set dominates another if the other's pieces can be shared out among the set's, each
    sharing being no longer than the piece it goes to.
    """
    gap = capacity - j
    spare = {j: 1}
    a = instance.largest(gap, spare)
    if not a:
        return (j,)
    if a == gap:
        return (j, a)
    smallest = instance.lengths[0]
    if smallest + a > gap and not _reachable(instance, gap) >> (a + 1):
        # whatever else fits beside j is no longer than a in all
        return (j, a)
    if 3 * smallest > gap:
        # at most two more pieces fit: the pair of the largest two, if any other pair is
        # no longer piece by piece, or in all no longer than a
        spare[a] = spare.get(a, 0) + 1
        b = instance.largest(gap - a, spare)
        if b:
            for y in instance.lengths[bisect.bisect_right(instance.lengths, b) :]:
                if 2 * y > gap:
                    break
                x = instance.largest(gap - y, {})
                if x >= y and x + y > a:
                    return None
            return (j, a, b)
    return None


def reduce(instance: _Instance, capacity: int) -> int:
    """Fix dominating sets while there are any; the number of sequences they take.

    Fixing as many copies at once as there are is sound: what is taken away only leaves
    fewer alternatives. A length that no set dominates for is passed over.
    """
    for j in list(reversed(instance.lengths)):
        while j in instance.left and (members := dominating(instance, j, capacity)):
            instance.fix(members)
    return instance.sequences


def best_fit(instance: _Instance, capacity: int) -> None:
    """Best fit, longest first: a piece goes to the fullest sequence that has room for it."""
    runs: dict[int, list[tuple[int, int]]] = {}  # room: [(first sequence, sequences)]
    rooms: list[int] = []

    def put(room: int, first: int, n: int) -> None:
        if not n or not room:
            return
        if room not in runs:
            runs[room] = []
            bisect.insort(rooms, room)
        runs[room].append((first, n))

    for length in list(reversed(instance.lengths)):
        while length in instance.left:
            at = bisect.bisect_left(rooms, length)
            left = instance.left[length]
            if at == len(rooms):
                each = capacity // length
                full, rest = divmod(left, each)
                if full:
                    instance.take(length, full * each, instance.sequences, each, 0)
                    put(capacity - each * length, instance.sequences, full)
                    instance.sequences += full
                if rest:
                    instance.take(length, rest, instance.sequences, rest, 0)
                    put(capacity - rest * length, instance.sequences, 1)
                    instance.sequences += 1
                break
            room = rooms[at]
            first, n = runs[room].pop()
            if not runs[room]:
                del runs[room]
                rooms.pop(at)
            each = room // length
            full = min(n, left // each)
            offset = capacity - room
            if full:
                instance.take(length, full * each, first, each, offset)
                put(room - each * length, first, full)
                first, n, left = first + full, n - full, left - full * each
            if n and left:
                instance.take(length, left, first, left, offset)
                put(room - left * length, first, 1)
                first, n = first + 1, n - 1
            put(room, first, n)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Slot], int, int]:
    """Slots for all pieces, the number of sequences, and how many the reduction fixed."""
    instance = _Instance(counts)
    fixed = reduce(instance, capacity)
    best_fit(instance, capacity)
    return instance.slots, instance.sequences, fixed


# ---------------------------------------------------------------- tokens


_SPACES = re.compile(r"\s{4096}")
_SPECIAL = "<|endoftext|>"


class Tokens:
    """Token ids as ``tokenizers`` gives them, by a faster encoder of the same vocabulary.

    ``vocabulary`` is a tokenizers file; ``ranks`` the same vocabulary as tiktoken ranks.
    Texts with the special token's string or very long white space go to ``tokenizers`` itself.
    """

    def __init__(self, vocabulary: str | None = None, ranks: str | None = None) -> None:
        import public_tokenizers

        self.vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
        self.ranks = ranks or (None if vocabulary else public_tokenizers.path("byte_bpe_50k.tiktoken"))
        self.pattern = public_tokenizers.PATTERN
        self._slow = self._fast = None

    def slow(self, text: str) -> list[int]:
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.vocabulary)
        return self._slow.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> list[int]:
        if self.ranks is None or _SPECIAL in text or len(text) > 100_000 and _SPACES.search(text):
            return self.slow(text)
        if self._fast is None:
            import base64

            import tiktoken

            with open(self.ranks, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self._fast = tiktoken.Encoding(
                "same", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={}
            )
        return self._fast.encode_ordinary(text)


PIECE = "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; a longer one's first piece takes the rest."""
    if n <= capacity:
        return [(0, n)]
    rest = n % capacity
    return [(0, rest)] * bool(rest) + [(s, capacity) for s in range(rest, n, capacity)]


def pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    vocabulary: str | None = None,
    ranks: str | None = None,
) -> DataFrame:
    """The pieces of all documents, stored. ``nth`` counts a task's pieces of the same length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part = context.partitionId() if context else 0
        tokens = Tokens(vocabulary, ranks)
        dealt: dict[int, int] = defaultdict(int)
        for batch in batches:
            columns: list[list[int | None]] = [[] for _ in range(7)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*tokens(text.as_py() or ""), END], dtype="<u4")
                for k, (start, length) in enumerate(cuts(len(ids), capacity)):
                    crc = zlib.crc32(ids[start : start + length].tobytes())
                    for column, value in zip(
                        columns, (doc, k, start, length, crc, part, dealt[length]), strict=True
                    ):
                        column.append(value)
                    dealt[length] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                names=["id", "piece", "start", "length", "ids_crc32", "part", "nth"],
            )

    source = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return stored(source.mapInArrow(run, PIECE), "pieces")


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    vocabulary: str | None = None,
    ranks: str | None = None,
) -> DataFrame:
    """Each piece of each document with its sequence_id and offset.

    A document is its tokens and the end id, so NULL and empty texts are one piece of one
    token; repeated rows are packed each for itself; no rows give no rows. Other columns
    are not looked at. What reaches the driver is the histogram of at most ``capacity``
    lengths; what goes out are the slots, whose number depends on the lengths alone.
    """
    found = pieces(docs, id_col, text_col, capacity, vocabulary, ranks)
    runs = stored(found.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "runs")
    counts = {r["length"]: r["n"] for r in runs.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, _, _ = plan(counts, capacity)
    slots.sort(key=lambda s: (s.length, s.rank))
    table = {k: np.array([getattr(s, k) for s in slots], dtype=np.int64) for k in Slot.__dataclass_fields__}
    # one number that orders slots by length and rank
    starts = (table["length"] << 48) + table["rank"]

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, nth = length.to_numpy().astype(np.int64), rank.to_numpy().astype(np.int64)
        at = np.searchsorted(starts, (size << 48) + nth, side="right") - 1
        inside = nth - table["rank"][at]
        return pd.DataFrame(
            {
                "sequence_id": table["first"][at] + inside // table["each"][at],
                "offset": table["offset"][at] + inside % table["each"][at] * size,
            }
        )

    # a row for each task and length meets here, not the pieces
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks_of = runs.select(
        F.col("part").alias("r_part"),
        F.col("length").alias("r_length"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
    )
    same = (F.col("part") == F.col("r_part")) & (F.col("length") == F.col("r_length"))
    ranked = found.join(ranks_of, same).withColumn("rank", F.col("nth") + F.col("before"))
    return ranked.withColumn("place", placed("length", "rank")).select(
        "id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset"
    )
