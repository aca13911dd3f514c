"""Packing of token sequences by bin completion branch-and-bound.

Documents are tokenized in Arrow batches and only documents longer than a
sequence are cut. What a packing needs to know is how many pieces there are of
each length, at most ``capacity`` counts however many pieces, so the search runs
on counts: sequences are filled around the longest piece that is left, by
undominated fillings, and branches whose waste exceeds what the best known
packing allows are cut off; best fit gives the first one known. A filling serves
as many sequences as the counts allow. Pieces find their places by their rank
among the pieces of their length, in tasks of bounded size.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from struct import pack as packed_ids

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quarry.llm.bytesview import LOWER, slices
from quarry.llm.wordcodes import blocks
from quarry.scratch import materialize

#: How often each filling (lengths, longest first) is used.
Packing = list[tuple[tuple[int, ...], int]]

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 13, 32]] = True
_PLAIN = re.compile("[a-zß-öø-ÿ]+")
_PROBES = ("word", "Word", "ÉTÉ", "naïveté", "x", "Straße", "unbelievable", "Ab12c...Déjà-3?!", "a_b@c.d", "x²", "don't", "5€", "ÀB×c÷", ">>x|y\"")
# how byte-level vocabularies write bytes: printable Latin-1 as it is, the others from 256 on
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or (161 <= b and b != 173)]
_BYTE_CHARACTERS = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}
# parts of words: letters (Latin-1 ones are 0xC3 and a second byte), single digits, and what else ASCII prints; white space is of no kind
_LETTER, _DIGIT, _OTHER, _ODD = 1, 2, 3, 4
_KIND = np.where(SPACE, 0, _ODD).astype(np.uint8)
_KIND[33:127] = _OTHER
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _KIND[128:192] = _KIND[0xC3] = _LETTER
_SECOND = np.zeros(256, dtype=bool)
_SECOND[128:192] = True
_SECOND[[0x97, 0xB7]] = False  # the signs of multiplication and division
_LOWER = LOWER.tobytes()
_HELD = 3 << 17
BLOCK = 4 << 20
#: Fillings kept for one sequence, completions of the whole search, and ranks of a length in a task.
FILLINGS, STEPS, RANKS = 6, 4_000, 1_000


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Ids:
    """Token ids (little-endian, 32 bits each) of words between white space and of their parts.

    A vocabulary that keeps letters, digits and the rest apart encodes each of
    them by itself, so words of Latin-1 letters and printable ASCII are cut there
    and folded before distinct parts are told: far fewer than distinct words.
    Words that hold anything else stay whole: other characters may combine or
    fold by what stands beside them, an apostrophe may begin a part of its own
    (``'re``), and added tokens are looked for before anything is folded. A worker
    process encodes a part once as long as it stands among the last few hundred
    thousand.
    """

    def __init__(self, path: str):
        self.whole, self.new, self.old = _tokenizer(path), {}, {}
        self.model = self.whole.model
        self.kind = _KIND.copy()
        added = {t.content[0] for t in self.whole.get_added_tokens_decoder().values()}
        # parts may go to the model itself if the file says no more about them than case and bytes
        self.plain = all(c.isascii() and not c.isalnum() for c in added)
        if self.plain:
            self.kind[[ord(c) for c in {"'", *added}]] = _ODD
            self.plain = self._agrees()
            self.new.clear()

    def _agrees(self) -> bool:
        for text in _PROBES:
            parts = [p for b in blocks(pa.array([text]), ~SPACE, SPACE, fold=False, split=self.split) for p in np.array(b.words, dtype=object)[b.code]]
            if b"".join(self.of(parts)) != np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes():
                return False
        return True

    def split(self, raw: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For :func:`blocks`: where parts start, and the bytes with those of words that are cut in lower case."""
        if not self.plain:
            return raw, start
        held = raw.tobytes()
        low, kind = np.frombuffer(bytearray(held).translate(_LOWER), dtype=np.uint8), np.frombuffer(held.translate(self.kind.tobytes()), dtype=np.uint8)
        odd = np.flatnonzero(kind == _ODD)
        high = np.flatnonzero(raw >= 128)
        if len(high):
            here, after, before = raw[high], np.minimum(high + 1, len(raw) - 1), np.maximum(high - 1, 0)
            first = (here == 0xC3) & _SECOND[raw[after]] & ~start[after]
            second = _SECOND[here] & (raw[before] == 0xC3) & ~start[high]
            capital = high[second & (here < 0x9F)]
            low[capital] += 32
            odd = np.concatenate([odd, high[~(first | second)]])
        begins = np.empty_like(start)
        begins[:1] = False
        begins[1:] = kind[1:] != kind[:-1]
        begins |= kind == _DIGIT
        begins &= kind != 0
        begins |= start
        if len(odd):
            words = np.append(np.flatnonzero(start), len(raw))
            whole = np.unique(np.searchsorted(words, odd, side="right") - 1)
            edge = np.zeros(len(raw) + 1, dtype=np.int8)
            edge[words[whole]] += 1
            edge[words[whole + 1]] -= 1
            uncut = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
            low = np.where(uncut, raw, low)
            begins &= ~uncut | start
        return low, begins

    def of(self, words: list[bytes]) -> list[bytes]:
        found = list(map(self.new.get, words))
        missing = []
        for i in [i for i, ids in enumerate(found) if ids is None]:
            word = words[i]
            if (ids := self.old.get(word)) is not None:
                self.new[word] = found[i] = ids
            elif self.plain and word.isalpha():  # ASCII letters, in lower case by now
                self.new[word] = found[i] = self._of_model(word.decode())
            else:
                missing.append(i)
        for a in range(0, len(missing), 4096):
            some = missing[a : a + 4096]
            self._encode([words[i] for i in some])
            for i in some:
                found[i] = self.new[words[i]]
        if len(self.new) > _HELD:
            self.new, self.old = {}, self.new
        return found

    def _encode(self, words: list[bytes]) -> None:
        rest = []
        for word in words:
            text = word.decode("utf-8", "replace")
            if self.plain and _PLAIN.fullmatch(text):
                self.new[word] = self._of_model(word.decode("latin-1").translate(_BYTE_CHARACTERS))
            else:
                rest.append((word, text))
        if rest:
            self._encode_text(*zip(*rest, strict=True))

    def _of_model(self, shown: str) -> bytes:
        """A part of lower-case letters: one piece of text for the model, its bytes written as characters."""
        found = self.model.tokenize(shown)
        return packed_ids(f"<{len(found)}I", *[t.id for t in found])

    def _encode_text(self, words: tuple[bytes, ...], texts: tuple[str, ...]) -> None:
        """All words in one text; a token belongs to the word it starts in."""
        begin = np.cumsum([0] + [len(t) + 1 for t in texts])
        code = self.whole.encode(" ".join(texts), add_special_tokens=False)
        at = np.fromiter((a for a, _ in code.offsets), dtype=np.int64, count=len(code.ids))
        count = np.bincount(np.searchsorted(begin, at, side="right") - 1, minlength=len(words))
        stop = np.cumsum(count) * 4
        raw = np.array(code.ids, dtype="<u4").tobytes()
        self.new.update((w, raw[a:b]) for w, a, b in zip(words, (stop - count * 4).tolist(), stop.tolist(), strict=True))


@lru_cache(maxsize=2)
def _ids(path: str) -> _Ids:
    return _Ids(path)


def _tokens(column: pa.Array, ids: _Ids, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows one after another, each row closed by ``end``, and row offsets into them."""
    flat, sizes = [], np.zeros(len(column), dtype=np.int64)
    for block in blocks(column, ~SPACE, SPACE, fold=False, limit=BLOCK, split=ids.split, stretches=False):
        known = ids.of(block.words)
        length = np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // 4
        first = np.concatenate([[0], np.cumsum(length)])
        own = length[block.code]
        stop = np.cumsum(own)
        at = np.arange(stop[-1]) + np.repeat(first[block.code] - stop + own, own)
        flat.append(np.frombuffer(b"".join(known), dtype="<u4")[at])
        sizes += np.bincount(block.row, weights=own, minlength=len(column)).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
    out = np.full(offsets[-1], end, dtype="<u4")
    body = np.ones(offsets[-1], dtype=bool)
    body[offsets[1:] - 1] = False
    out[body] = np.concatenate(flat) if flat else np.zeros(0, dtype="<u4")
    return out, offsets


def pieces(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, ``piece, start, length`` and ``ids binary`` (little-endian, 32 bits each).

    A document is the ids that the library gives for ``tokenizer``, without
    added special tokens, then ``end``. Only documents of more than ``capacity``
    ids are cut, into pieces of that length, the last one shorter. The
    vocabulary must drop white space and keep letters, digits and other characters
    apart, as then words are encoded by themselves, each distinct one of a task
    about once. Texts are read in
    blocks. A null text is empty; null ids and repeated rows are documents like
    any other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        known = _ids(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, at = _tokens(part.column("text"), known, end)
                size = np.diff(at)
                n = -(-size // capacity)
                doc = np.repeat(np.arange(len(part)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, size[doc] - start)
                raw = memoryview(ids).cast("B")
                lo = (at[doc] + start) * 4
                for a in range(0, len(doc), 1024):
                    b = min(a + 1024, len(doc))
                    held = pa.array([raw[x : x + 4 * y].tobytes() for x, y in zip(lo[a:b].tolist(), length[a:b].tolist(), strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(doc[a:b])), pa.array(piece[a:b], pa.int32()), pa.array(start[a:b]), pa.array(length[a:b]), held], ["id", "piece", "start", "length", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids binary").withColumnRenamed("id", id_col)


def best_fit(counts: dict[int, int], capacity: int) -> Packing:
    """Longest first, each piece into the fullest sequence that takes it; equal pieces and sequences are dealt with together."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by room that is left
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for room in sorted(r for r in open_ if r >= length):
            fits = room // length
            while left and open_.get(room):
                held, n = open_[room].pop()
                full, rest = divmod(left, fits)
                if full >= n:
                    filled = [(n, fits)]
                else:
                    filled = [(full, fits)] + ([(1, rest)] if rest else [])
                used = 0
                for times, q in filled:
                    if times:
                        open_.setdefault(room - q * length, []).append(((*held, *[length] * q), times))
                        used += times
                        left -= times * q
                if used < n:
                    open_.setdefault(room, []).append((held, n - used))
                    break
            if not left:
                break
        fits = capacity // length
        full, rest = divmod(left, fits)
        for times, q in ((full, fits), (1, rest)):
            if times and q:
                open_.setdefault(capacity - q * length, []).append(((length,) * q, times))
    return [bin_ for bins in open_.values() for bin_ in bins]


def fillings(counts: dict[int, int], lengths: list[int], capacity: int, limit: int = FILLINGS) -> list[tuple[int, ...]]:
    """Undominated fillings around the longest piece left, fullest first, at most ``limit`` of them; ``lengths`` of ``counts`` ascend.

    A filling is dominated if one or two pieces of it can give way to one piece
    that is not shorter than they are together and still fits: what is then left
    over could be used at least as well.
    """
    longest, found, looks = lengths[-1], [], 0

    def spare(x: int, chosen: list[int]) -> bool:
        return chosen.count(x) + (x == longest) < counts[x]

    def grow(top: int, room: int, chosen: list[int]) -> bool:
        """Longest first, so exact fillings of few pieces come first; False stops the search."""
        nonlocal looks
        grew = False
        for i in range(min(top, bisect_right(lengths, room) - 1), -1, -1):
            x = lengths[i]
            if not spare(x, chosen):
                continue
            grew, looks = True, looks + 1
            chosen.append(x)
            going = grow(i, room - x, chosen)
            chosen.pop()
            if not going or looks > 32 * limit:
                return False
        if not grew:
            found.append((room, tuple(chosen)))
            return sum(r == 0 for r, _ in found) < limit
        return True

    def dominated(room: int, chosen: tuple[int, ...]) -> bool:
        for size in (1, 2):
            for some in set(combinations(chosen, size)):
                total = sum(some)
                # one piece for one must be longer, one for two may be as long as they are together
                at = bisect_left(lengths, total + (size == 1))
                while at < len(lengths) and lengths[at] <= total + room:
                    if spare(lengths[at], list(chosen)):
                        return True
                    at += 1
        return False

    grow(len(lengths) - 1, capacity - longest, [])
    kept = [f for f in found if not dominated(*f)]
    return [(longest, *chosen) for _, chosen in sorted(kept or found, key=lambda f: (f[0], len(f[1])))[:limit]]


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences: by the sum of lengths, with pieces over ``capacity - k`` alone for the best ``k``."""
    at = np.zeros(capacity + 1, dtype=object)
    for x, n in counts.items():
        at[x] = n
    many = [0, *np.cumsum(at).tolist()]  # many[i]: pieces below length i
    mass = [0, *np.cumsum(at * np.arange(capacity + 1)).tolist()]
    best = 0
    for k in range(capacity // 2 + 1):
        alone = many[-1] - many[capacity - k + 1]
        halves = many[capacity - k + 1] - many[capacity // 2 + 1]
        rest = mass[capacity - k + 1] - mass[k]
        best = max(best, alone + max(halves, -(-rest // capacity)))
    return best


def pack_counts(counts: dict[int, int], capacity: int, steps: int = STEPS) -> Packing:
    """A packing of ``counts`` pieces by length into as few sequences as the search finds.

    Best fit is the first incumbent; if it reaches the lower bound, nothing can
    beat it. Else sequences are completed one kind after another, depth first,
    and a branch ends when its waste is more than a packing with one sequence
    less could have. After ``steps`` completions the best packing known is taken.
    """
    counts = {x: n for x, n in counts.items() if n}
    best = best_fit(counts, capacity)
    fewest, bound = sum(n for _, n in best), least_bins(counts, capacity)
    total = sum(x * n for x, n in counts.items())
    # (parent, pieces left, waste so far, filling, how often): fillings are taken off when their turn comes
    Node = tuple[tuple | None, dict[int, int], int, tuple[int, ...], int]
    stack: list[Node] = [(None, counts, 0, (), 0)]

    def path(node: Node | None) -> Packing:
        out = []
        while node is not None and node[3]:
            out.append((node[3], node[4]))
            node = node[0]
        return out[::-1]

    for step in range(steps):
        if not stack or fewest <= bound:
            break
        node = parent, left, waste, filling, times = stack.pop()
        if filling:
            left = dict(left)
            for x in set(filling):
                left[x] -= times * filling.count(x)
                if not left[x]:
                    del left[x]
            node = (parent, left, waste, filling, times)
        if waste > (fewest - 1) * capacity - total:
            continue
        if not left or step % 64 == 0:  # the rest by best fit may be better already
            whole = path(node) + best_fit(left, capacity)
            if sum(n for _, n in whole) < fewest:
                best, fewest = whole, sum(n for _, n in whole)
        if left:
            lengths = sorted(left)
            for f in reversed(fillings(left, lengths, capacity)):
                n = min(left[x] // f.count(x) for x in set(f))
                stack.append((node, left, waste + n * (capacity - sum(f)), f, n))
    return best


def places(packing: Packing) -> dict[int, list[tuple[int, int, int, int]]]:
    """By length ``(rank, sequence, offset, slots)``: pieces from ``rank`` on go to ``sequence`` and those after it, ``slots`` side by side from ``offset``."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for filling, times in packing:
        offset = 0
        for x in sorted(set(filling), reverse=True):
            slots = filling.count(x)
            out.setdefault(x, []).append((ranks.get(x, 0), sequence, offset, slots))
            ranks[x] = ranks.get(x, 0) + times * slots
            offset += slots * x
        sequence += times
    return out


def pack(rows: DataFrame, *, capacity: int = 2048, length_col: str = "length", steps: int = STEPS) -> DataFrame:
    """``rows`` with ``sequence_id`` and ``offset``: where each lies, without gaps, in sequences of at most ``capacity``.

    Only counts by length reach the driver, ``capacity`` numbers at most. A
    length that very many rows share is ranked in parts. Lengths are 1 to
    ``capacity``; an empty table gives an empty one; columns named as the two
    new ones are replaced.
    """
    spark = rows.sparkSession
    plain = {c: f"c{i}" for i, c in enumerate(c for c in rows.columns if c.lower() not in ("sequence_id", "offset"))}
    size = F.col(plain[length_col])
    held = materialize(rows.select(*[F.col(f"`{c}`").alias(p) for c, p in plain.items()]).withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = {r[0]: r[1] for r in held.groupBy(size).count().collect()}
    if any(x is None or not 1 <= x <= capacity for x in counts):
        raise ValueError(f"lengths must be 1 to {capacity}")
    packing = pack_counts(counts, capacity, steps)
    table = [(x, -(-counts[x] // RANKS), where) for x, where in places(packing).items()]
    known = F.broadcast(spark.createDataFrame(table, f"{plain[length_col]} long, parts long, places array<struct<first:long,sequence:long,at:long,slots:long>>"))
    ranked = held.withColumn(plain[length_col], size.cast("long")).join(known, plain[length_col]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))
    # rows of earlier parts of a length come first
    per = ranked.groupBy(plain[length_col], "part").agg(F.count("*").alias("n"))
    first = per.withColumn("before", F.sum("n").over(Window.partitionBy(plain[length_col]).orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).drop("n")
    own = F.row_number().over(Window.partitionBy(plain[length_col], "part").orderBy("row")) - 1
    ranked = ranked.withColumn("own", own).join(first, [plain[length_col], "part"]).withColumn("rank", F.col("own") + F.col("before"))
    place = F.element_at(F.filter("places", lambda p: p.first <= F.col("rank")), -1)
    ranked = ranked.withColumn("place", place).withColumn("nth", F.col("rank") - F.col("place.first"))
    sequence = F.col("place.sequence") + F.call_function("div", F.col("nth"), F.col("place.slots"))
    offset = F.col("place.at") + F.pmod(F.col("nth"), F.col("place.slots")) * size
    return ranked.select(*[F.col(p).alias(c) for c, p in plain.items()], sequence.alias("sequence_id"), offset.alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, length``: the ids of each sequence's pieces in order, from :func:`pack` over rows that hold ``ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts"))
    return whole.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda s, p: F.concat(s, p.ids)).alias("ids"), "length")
