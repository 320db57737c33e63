"""Byte-level BPE by a dynamic program over byte prefixes: encode, append, edit, decode.

A token sequence is the encoding of its bytes exactly if every two neighbours stay as
they are when their bytes are encoded together: the first merge that broke the sequence
would cross one boundary, and it would do so with these two tokens alone. Hence every
byte prefix of a piece has a unique last token: the token that ends there and stays
beside the last token of the prefix before it. ``PrefixVocabulary`` stores that token
for every prefix, one number per byte. From it follow

* the encoding of any prefix, by walking back token by token,
* exact appends: the table is extended, what it holds stays true,
* edits: the table holds up to the edit, is computed anew from there, and as soon as it
  agrees with the old one over as many bytes as the longest token has, the rest agrees.

Texts are first cut into pieces by a pattern. A match depends on the text from its start
to two characters past its end, so pieces well before an edit stay, and once a new piece
starts where an old one did, behind the edit, the old pieces follow.

Spark distributes the documents; a task sees one after another and holds the pieces of a
part of a text at a time, so a text of any length needs room for its ids only. The ids of
pieces are remembered; how many is bounded and affects speed alone.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain
from os.path import commonprefix
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PIECES = 300_000  # pieces whose ids a worker remembers, and as many older ones
PAIRS = 500_000  # pairs of tokens it remembers
PART = 1 << 19  # characters of a text that are cut into pieces at a time
FLUSH = 1 << 20  # ids in a batch that goes back to Spark
LOOKAHEAD = 2  # characters past its end that decide a match of the pattern
NEVER = 1 << 40


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: lines of a base64 token and its rank."""
    with open(path, "rb") as lines:
        entries = (line.split() for line in lines if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in entries}


class PrefixVocabulary:
    """A vocabulary of ranked tokens, and the encodings that it gives to bytes.

    The ranks must be those of a trained vocabulary: all single bytes are in it, and every
    longer token is made by merges of lower rank. Other vocabularies are an error.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte-level vocabulary has a token for every byte")
        self.ranks = ranks
        self.spelling = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self._known: dict[tuple[int, int], bool] = {}
        # the tokens within a token that end (start) where it does, from its outer byte on
        self._ends: dict[int, tuple[int, ...]] = {}
        self._starts: dict[int, tuple[int, ...]] = {}
        for token, rank in sorted(ranks.items(), key=lambda entry: entry[1]):
            left, right = self._halves(token, rank) if len(token) > 1 else (rank, rank)
            self._ends[rank] = (*self._ends.get(right, ()), rank)
            self._starts[rank] = (*self._starts.get(left, ()), rank)
        self._find = self._finder()

    def _halves(self, token: bytes, rank: int) -> tuple[int, int]:
        """The two tokens that the last merge of a token joins: those that stay until then."""
        for middle in range(1, len(token)):
            left, right = (self.ranks.get(part, NEVER) for part in (token[:middle], token[middle:]))
            if max(left, right) < rank and self.stays(left, right, below=rank):
                return left, right
        raise ValueError(f"no merges of lower rank make token {rank}")

    def _finder(self) -> ahocorasick.Automaton:
        """Finds all tokens in bytes; these are given as characters of the same numbers."""
        found = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            found.add_word(token.decode("latin-1"), (len(token), rank))
        found.make_automaton()
        return found

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_find", "_known")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, _known={})
        self._find = self._finder()

    def stays(self, left: int, right: int, below: int = NEVER) -> bool:
        """Whether the bytes of two tokens are encoded as these two, by merges below a rank.

        Merges happen in the order of their ranks, on both sides of the boundary on their
        own, until one that crosses it has the lowest rank.
        """
        outer, inner = self._ends[left], self._starts[right]
        i = j = 0
        while True:
            after_left = outer[i + 1] if i + 1 < len(outer) else NEVER
            after_right = inner[j + 1] if j + 1 < len(inner) else NEVER
            crossing = self.ranks.get(self.spelling[outer[i]] + self.spelling[inner[j]], NEVER)
            # of equal ranks the merge further left comes first
            if crossing < below and crossing < after_left and crossing <= after_right:
                return False
            if after_left == after_right == NEVER:
                return True
            if after_left <= after_right:
                i += 1
            else:
                j += 1

    def extend(self, last: list[int], data: bytes, stop: Callable[[list[int]], bool] | None = None) -> list[int]:
        """Extend the last tokens of prefixes to all prefixes of ``data``; in place.

        ``last`` holds those of its first ``len(last)`` bytes. ``stop(last)`` may end it early.
        """
        known = self._known
        done = len(last)
        # tokens by where they end, of those the longest first; exactly one holds at each place
        for at, (size, token) in self._find.iter(data.decode("latin-1"), max(0, done + 1 - self.longest)):
            if at < done:
                continue
            if size <= at:
                pair = (last[at - size], token)
                holds = known.get(pair)
                if holds is None:
                    if len(known) >= PAIRS:
                        known.clear()
                    holds = known[pair] = self.stays(*pair)
                if not holds:
                    continue
            last.append(token)
            done += 1
            if stop is not None and stop(last):
                break
        return last

    def change(self, last: list[int], old: bytes, new: bytes) -> list[int]:
        """The last tokens of the prefixes of ``new``, given those of ``old``.

        Only bytes near the difference are encoded again.
        """
        same = len(commonprefix([old, new]))
        tail = 0
        most = min(len(old), len(new)) - same
        while tail < most and old[-1 - tail] == new[-1 - tail]:
            tail += 1
        shift = len(old) - len(new)
        first = len(new) - tail  # where the bytes are the old ones again
        agreed = 0

        def settled(now: list[int]) -> bool:
            nonlocal agreed
            at = len(now) - 1
            agreed = agreed + 1 if at >= first and now[at] == last[at + shift] else 0
            return agreed >= self.longest

        out = self.extend(last[:same], new, stop=settled)
        return out + last[len(out) + shift :] if len(out) < len(new) else out

    def ids(self, last: list[int]) -> tuple[int, ...]:
        """The encoding of a prefix, walked back along its last tokens."""
        out = []
        at = len(last)
        spelling = self.spelling
        while at:
            token = last[at - 1]
            out.append(token)
            at -= len(spelling[token])
        return tuple(out[::-1])

def stand_ins() -> dict[int, str]:
    """Characters that tiktoken and the regex module class differently, and ones of tiktoken's class.

    The two follow different versions of Unicode, in which the newest letters differ.
    """
    import tiktoken

    single = {bytes([b]): b for b in range(256)}
    everything = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out: dict[int, str] = {}
    theirs = {}
    for kind in (r"\p{L}", r"\p{N}"):
        matching = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks=single, special_tokens={})
        theirs[kind] = set(bytes(matching.encode_ordinary(everything)).decode())
        for c in theirs[kind] ^ set(regex.findall(kind, everything)):
            out[ord(c)] = "\ue000"
    for kind, stand_in in ((r"\p{L}", "q"), (r"\p{N}", "0")):
        out.update((c, stand_in) for c in out if chr(c) in theirs[kind])
    return out


class Cutter:
    """Cuts texts into the matches of a pattern, as tiktoken does.

    The pattern must match all characters, so that the pieces put together are the text.
    """

    def __init__(self, pattern: str) -> None:
        self._pattern = regex.compile(pattern)
        self._stand_ins = stand_ins()
        self._high = re.compile(f"[{chr(min(self._stand_ins, default=0x10FFFF))}-\U0010ffff]")

    def _matches(self, part: str) -> list[str]:
        if not self._high.search(part) or not set(map(ord, set(part))) & self._stand_ins.keys():
            return self._pattern.findall(part)
        ends = [match.end() for match in self._pattern.finditer(part.translate(self._stand_ins))]
        return [part[a:b] for a, b in zip([0, *ends], ends)]

    def pieces(self, text: str, start: int = 0) -> Iterator[list[str]]:
        """The pieces of a text from a position on, for a part of it at a time."""
        size = PART
        while start < len(text):
            part = text[start : start + size]
            pieces = self._matches(part)
            end = len(part)
            if start + end < len(text):
                # matches this near to the cut might be others if the text went on
                while pieces and end > len(part) - LOOKAHEAD:
                    end -= len(pieces.pop())
            if pieces:
                yield pieces
                start += end
                size = PART
            else:
                size *= 2


class _Pieces(dict):
    """The ids of pieces, found when they are first asked for.

    When ``PIECES`` are there, they become the older half; of those only the ones asked
    for again are kept when that happens next.
    """

    def __init__(self, vocabulary: PrefixVocabulary) -> None:
        self._vocabulary = vocabulary
        self._older: dict[str, tuple[int, ...]] = {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= PIECES:
            self._older = dict(self)
            self.clear()
        ids = self._older.get(piece)
        if ids is None:
            ids = self._vocabulary.ids(self._vocabulary.extend([], piece.encode()))
        self[piece] = ids
        return ids


class TextEncoder:
    """Texts to ids and back, by a vocabulary and the pattern that cuts texts into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.vocabulary = PrefixVocabulary(ranks)
        self.cutter = Cutter(pattern)
        self._known = _Pieces(self.vocabulary)

    def __getstate__(self) -> dict:
        return {"vocabulary": self.vocabulary, "cutter": self.cutter}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, _known=_Pieces(state["vocabulary"]))

    def ids(self, text: str) -> list[int]:
        """The ids of a text."""
        out: list[int] = []
        for pieces in self.cutter.pieces(text):
            out.extend(chain.from_iterable(map(self._known.__getitem__, pieces)))
        return out

    def prefixes(self, text: str) -> Prefixes:
        """A text with the last tokens of all prefixes of its pieces."""
        return self._tables(text, [], [], [], 0, lambda chars: False)[0]

    def edit(self, before: Prefixes, start: int, stop: int, replacement: str) -> Prefixes:
        """The text with characters from ``start`` to ``stop`` replaced; exact.

        Only the pieces near the edit are cut anew, and within a piece that was there only
        the bytes near the edit are encoded anew. An append is an edit at the end.
        """
        if not 0 <= start <= stop <= len(before.text):
            raise ValueError(f"no characters {start} to {stop} in a text of {len(before.text)}")
        text = before.text[:start] + replacement + before.text[stop:]
        shift = len(text) - len(before.text)
        kept = bisect_right(before.chars, start - LOOKAHEAD)
        starts = before.chars  # the old pieces start where the ones before them end

        def joined(chars: int) -> bool:
            at = bisect_left(starts, chars - shift)
            return chars - shift >= stop and at < len(starts) and starts[at] == chars - shift

        n_bytes = before.ends[kept - 1] if kept else 0
        out, met = self._tables(
            text, before.chars[:kept], before.ends[:kept], before.last[:n_bytes], kept, joined, before
        )
        if met is not None:
            old = bisect_left(starts, met - shift)
            grown = out.ends[-1] - before.ends[old]
            out.chars.extend(c + shift for c in before.chars[old + 1 :])
            out.ends.extend(e + grown for e in before.ends[old + 1 :])
            out.last.extend(before.last[before.ends[old] :])
        return out

    def _tables(
        self,
        text: str,
        chars: list[int],
        ends: list[int],
        last: list[int],
        kept: int,
        joined: Callable[[int], bool],
        before: Prefixes | None = None,
    ) -> tuple[Prefixes, int | None]:
        """Continue tables to the end of a text, or to where ``joined`` holds of a piece's end."""
        out = Prefixes(text, list(last), list(chars), list(ends))
        at = out.chars[-1] if out.chars else 0
        size = out.ends[-1] if out.ends else 0
        first = True
        for pieces in self.cutter.pieces(text, at):
            for piece in pieces:
                data = piece.encode()
                if first and before is not None and kept < len(before.ends):
                    # the old piece that started here is the base of the new one
                    table = before.last[size : before.ends[kept]]
                    table = self.vocabulary.change(table, before.piece(kept), data)
                else:
                    table = self.vocabulary.extend([], data)
                first = False
                at += len(piece)
                size += len(data)
                out.last.extend(table)
                out.chars.append(at)
                out.ends.append(size)
                if joined(at):
                    return out, at
        return out, None

    def ids_of(self, prefixes: Prefixes) -> list[int]:
        """The ids of a text, from its table."""
        out: list[int] = []
        start = 0
        for end in prefixes.ends:
            out.extend(self.vocabulary.ids(prefixes.last[start:end]))
            start = end
        return out


@dataclass
class Prefixes:
    """A text, the last token of each byte prefix of each piece, and where the pieces end."""

    text: str
    last: list[int]  # a token for each byte
    chars: list[int]  # ends of pieces in characters
    ends: list[int]  # and in bytes

    def piece(self, n: int) -> bytes:
        return self.text[self.chars[n - 1] if n else 0 : self.chars[n]].encode()


# ---------------------------------------------------------------- on Spark

TABLES = "id bigint, text string, last array<int>, chars array<int>, ends array<int>"


class Model(NamedTuple):
    """An encoder, and the bytes of its ids alone, as broadcasts."""

    encoder: Broadcast
    spelling: Broadcast


def encoder(spark: SparkSession, path: str | None = None, pattern: str | None = None) -> Model:
    """The model of a rank file and a pattern; the driver reads the file.

    It is as large as the vocabulary, whatever the data. The default is the public
    multilingual vocabulary of 50,256 tokens.
    """
    if path is None or pattern is None:
        import public_tokenizers

        path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
        pattern = pattern or public_tokenizers.PATTERN
    work = TextEncoder(read_ranks(path), pattern)
    send = spark.sparkContext.broadcast
    return Model(send(work), send(work.vocabulary.spelling))


def _lists(values: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.fromiter(chain.from_iterable(values), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _batches(rows: Iterator[tuple[list, int]], convert: Callable[[list], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Record batches of rows that come with their sizes, none much above ``FLUSH``."""
    held, size = [], 0
    for row, weight in rows:
        held.append(row)
        size += weight + 1
        if size >= FLUSH:
            yield convert(held)
            held, size = [], 0
    if held:
        yield convert(held)


def encode(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) for each row; ``model`` comes from ``encoder``.

    NULL text counts as empty and has no ids. Repeated rows and NULL ids stay as they
    are, no rows give no rows, and other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work: TextEncoder = model.encoder.value

        def rows() -> Iterator[tuple[list, int]]:
            for batch in batches:
                for id_, text in zip(batch.column(0), batch.column(1)):
                    found = work.ids(text.as_py() or "")
                    yield [id_.as_py(), found], len(found)

        def convert(held: list) -> pa.RecordBatch:
            ids = pa.array([r[0] for r in held], pa.int64())
            return pa.RecordBatch.from_arrays([ids, _lists([r[1] for r in held])], names=["id", "ids"])

        yield from _batches(rows(), convert)

    source = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return source.mapInArrow(run, "id bigint, ids array<int>")


def decode(encoded: DataFrame, model: Model) -> DataFrame:
    """The frame of ``encode`` with the decoded bytes of each row beside its ids.

    NULL ids are none; an id that the vocabulary does not have is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling: dict[int, bytes] = model.spelling.value
        for batch in batches:
            ids = batch.column(1).fill_null([])
            flat, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
            data = [b"".join(map(spelling.__getitem__, flat[a:b].tolist())) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(data, pa.binary())], names=["id", "ids", "decoded"]
            )

    return encoded.select("id", "ids").mapInArrow(run, "id bigint, ids array<int>, decoded binary")


def _table_batch(held: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in held], pa.int64()),
            pa.array([r[1].text for r in held], pa.string()),
            *[_lists([getattr(r[1], name) for r in held]) for name in ("last", "chars", "ends")],
        ],
        names=["id", "text", "last", "chars", "ends"],
    )


def tables(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, last, chars, ends): texts with their prefix tables, to be kept for edits.

    ``last`` has the last token of each byte prefix of each piece, the others the ends of
    the pieces in characters and bytes. NULL text counts as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work: TextEncoder = model.encoder.value

        def rows() -> Iterator[tuple[list, int]]:
            for batch in batches:
                for id_, text in zip(batch.column(0), batch.column(1)):
                    found = work.prefixes(text.as_py() or "")
                    yield [id_.as_py(), found], len(found.last)

        yield from _batches(rows(), _table_batch)

    source = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return source.mapInArrow(run, TABLES)


def amend(stored: DataFrame, edits: DataFrame, model: Model) -> DataFrame:
    """Prefix tables after edits (id, start, stop, replacement); the others as they are.

    An edit replaces the characters from ``start`` to before ``stop``, both counted in the
    text as it was; NULL replacement deletes. Edits of one text must not overlap; they are
    made from the last to the first (of those at one place, the least replacement ends up
    first). An edit reaches all rows with its id, and none if no row has it. Edits outside
    the text are an error.
    """
    gathered = edits.where("id IS NOT NULL").groupBy("id").agg(
        F.sort_array(
            F.collect_list(F.struct("start", "stop", F.coalesce("replacement", F.lit("")).alias("by"))), asc=False
        ).alias("edits")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work: TextEncoder = model.encoder.value

        def rows() -> Iterator[tuple[list, int]]:
            for batch in batches:
                for row in zip(*batch.columns):
                    id_, text, last, chars, ends, edits = (value.as_py() for value in row)
                    table = Prefixes(text, last, chars, ends)
                    limit = len(text)
                    for edit in edits or ():
                        if edit["stop"] > limit:
                            raise ValueError(f"edits of text {id_} overlap or pass its end")
                        table = work.edit(table, edit["start"], edit["stop"], edit["by"])
                        limit = edit["start"]
                    yield [id_, table], len(table.last)

        yield from _batches(rows(), _table_batch)

    return stored.select("id", "text", "last", "chars", "ends").join(gathered, "id", "left").mapInArrow(run, TABLES)


def table_ids(stored: DataFrame, model: Model) -> DataFrame:
    """(id, ids) of texts, read off their prefix tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work: TextEncoder = model.encoder.value
        for batch in batches:
            rows = zip(*(batch.column(n) for n in range(3)))
            found = [work.ids_of(Prefixes("", *(v.as_py() for v in (last, ends, ends)))) for _, last, ends in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(found)], names=["id", "ids"])

    return stored.select("id", "last", "ends").mapInArrow(run, "id bigint, ids array<int>")


def joined_ids(ids: Column) -> Column:
    """Ids in decimal, joined by commas."""
    return F.array_join(ids.cast("array<string>"), ",")
