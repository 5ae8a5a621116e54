"""Best-fit packing by bin completion.

Documents are tokenised, cut where they exceed a sequence, and packed into as few sequences as possible. Full pieces are
sequences of their own. The others are dealt at random, in equal shares, to groups of about GROUP pieces, and each group
is packed on its own: best-fit decreasing gives the first incumbent; if it misses the bound on sequences, a branch and
bound over the whole group fills sequences around the largest piece that is left. It tries the undominated fillings in
order of waste, drops a branch when its waste leaves no room for fewer sequences than the incumbent's or when the bound
on what is left does, and completes prefixes by best fit to get better incumbents. It ends with a proof that there is
nothing better, or after EFFORT choices. A group wastes about half a sequence in its last one, so the shares cost about
one sequence in ten thousand.

Text is tokenised once; what is shuffled is a few numbers a piece.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, beside_ids

CAPACITY = 2048
#: Pieces in a group, and choices that the search of a group may look at: the limit of its effort.
GROUP, EFFORT = 20_000, 50_000
#: Prefixes of one dive that are completed by best fit.
COMPLETED = 64
END = b"\x00\x00\x00\x00"
#: Words whose ids a Python worker remembers.
REMEMBER = 500_000
#: White space to str.split() but not to the tokenizer's pattern.
_ODD_SPACE = "\x1c\x1d\x1e\x1f"
#: Characters for which lower case before the tokenizer's own steps might come out differently.
_OTHER = re.compile("[^\x00-\u012f\u0131-\u024f]")
#: An ASCII mark other than an apostrophe behind a letter, where the tokenizer always begins a new word. Looking for the
#: mark first takes half the time.
_MARK = re.compile("[!-&(-/:-@\\[-`{-~](?<=[a-zß-öø-ÿ].)", re.DOTALL)


def _byte_letters() -> str:
    """The letter by which a byte-level vocabulary writes each byte: itself if it prints, else the next from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return "".join(chr(b if b in prints else next(others)) for b in range(256))


class WordIds(dict):
    """Token ids of texts as little-endian bytes, by a tokenizer that never joins words across white space.

    Words are keys, and are encoded when they are first asked for. New words of letters alone go to the tokenizer's
    model, as its other steps change nothing in them; other words go through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core; threads for single words only wait

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokens, self.letters = self.tokenizer.model.tokenize, _byte_letters()
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if word.isalpha() and (word.isascii() or not _OTHER.search(word)):
            tokens = self.tokens(word.lower().encode().decode("latin-1").translate(self.letters))
            found = b"".join([self.id_bytes[t.id] for t in tokens])
        else:
            found = self._encode(word)
        self[word] = found
        return found

    def ids(self, text: str | None) -> bytes:
        """The ids of a text; a null has none."""
        if not text:
            return b""
        if any(c in text for c in _ODD_SPACE):
            return self._encode(text)
        if "<|" not in text:  # fewer different words: without their marks, in lower case
            text = _MARK.sub(r" \g<0>", text.lower() if text.isascii() or not _OTHER.search(text) else text)
        if len(self) > REMEMBER:
            self.clear()
        return b"".join(map(self.__getitem__, text.split()))


@cache
def word_ids(path: str) -> WordIds:
    """One memory of words for all tasks of a Python worker."""
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each row's ids with the closing id 0, cut only where longer than capacity."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, step = word_ids(tokenizer_path), 4 * capacity
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for r, text in enumerate(b.column("text").to_pylist()):
                raw = words.ids(text)
                n = len(raw) + 4
                if n <= step:
                    row.append(r)
                    piece.append(0)
                    start.append(0)
                    length.append(n // 4)
                    crc.append(zlib.crc32(END, zlib.crc32(raw)))
                    continue
                raw = memoryview(raw + END)
                for i, at in enumerate(range(0, n, step)):
                    part = raw[at : at + step]
                    row.append(r)
                    piece.append(i)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield beside_ids(b, {"piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}, row)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each size goes where it leaves least room."""
    room: list[tuple[int, int]] = []  # (free, bin), sorted
    bins: list[list[int]] = []
    for s in sorted(sizes, reverse=True):
        i = bisect_left(room, (s, -1))
        if i == len(room):
            bins.append([s])
            if s < capacity:
                insort(room, (capacity - s, len(bins) - 1))
        else:
            free, b = room.pop(i)
            bins[b].append(s)
            if free > s:
                insort(room, (free - s, b))
    return bins


def fewest_bins(left: np.ndarray, capacity: int) -> int:
    """A lower bound on the bins for left[s] pieces of each size s: by their sum, and by those too large to share a bin.

    For a limit a up to half the capacity: pieces over capacity - a are alone, those over half the capacity are one to
    a bin, and what pieces of a to half the capacity exceed the room beside the latter needs more bins.
    """
    half, s = capacity // 2, np.arange(capacity + 1)
    number, total = np.append(0, np.cumsum(left)), np.append(0, np.cumsum(left * s))  # of sizes below the index
    best = -(-int(total[-1]) // capacity)
    a = np.arange(1, half + 1)
    alone = number[-1] - number[capacity - a + 1]
    wide, wide_sum = number[capacity - a + 1] - number[half + 1], total[capacity - a + 1] - total[half + 1]
    over = total[half + 1] - total[a] - (wide * capacity - wide_sum)
    need = alone + wide + np.maximum(0, -(-over // capacity))
    return max(best, int(need.max())) if len(a) else best


def _smear(bits: int, n: int) -> int:
    """bits or-ed with themselves moved up by 1 to n."""
    done = 0
    while done < n:
        by = min(done + 1, n - done)
        bits |= bits << by
        done += by
    return bits


def dominated(filling: tuple[int, ...], room: int, stock: int) -> bool:
    """Whether a piece that is left over (bit s of stock: one of size s) could stand for some of filling's pieces.

    That is one that fits into the room beside them, one larger than a piece by no more than that room, or one as large as
    two and more pieces together, or larger by no more than that room. The other filling holds as much at least, and
    the pieces that it leaves go wherever the one that it takes would have gone.
    """
    one, more, sums = 0, 0, 1  # sums of single pieces, of two and more, and of any
    for f in filling:
        more |= (sums & ~1) << f
        one |= 1 << f
        sums |= sums << f
    better = _smear(more, room) | (_smear(1, room) & ~1)
    if room:
        better |= _smear(one << 1, room - 1)
    return bool(better & stock)


def fillings(left: list[int], free: int, most_waste: int | None = None, effort: list[int] | None = None) -> Iterator[tuple[int, ...]]:
    """The undominated sets of pieces for the room free, of left[s] pieces of each size s: least waste first.

    Of equal waste, single pieces and pairs come first, then those whose smallest piece is the largest, as small pieces are
    what fills gaps later. They are made as they are asked for; a
    table of the sums that smaller sizes can reach keeps the search off dead ends. effort[0] is lowered by one for each
    choice that is looked at; the search ends when it reaches 0.
    """
    effort = [1 << 62] if effort is None else effort
    sizes = [s for s in range(min(free, len(left) - 1), 0, -1) if left[s]]
    stock = 0
    for s in sizes:
        stock |= 1 << s

    def good(filling: tuple[int, ...], room: int) -> bool:
        rest = stock
        for s in set(filling):
            if filling.count(s) >= left[s]:
                rest &= ~(1 << s)
        return not dominated(filling, room, rest)

    reach = [1]  # by number of sizes, from the largest: the sums that they make up to free

    def exact(low: int, target: int) -> Iterator[tuple[int, ...]]:
        """Sets of the low largest sizes with the sum target, of those with the largest smallest piece first."""
        if not target:
            yield ()
            return
        for n in range(1, low + 1):
            s = sizes[n - 1]
            for k in range(1, min(left[s], target // s) + 1):
                rest = target - s * k
                if reach[n - 1] >> rest & 1:
                    effort[0] -= 1
                    if effort[0] <= 0:
                        return
                    for larger in exact(n - 1, rest):
                        yield *larger, *(s,) * k

    short = set()  # singles and pairs without waste need no table
    if free and free < len(left) and left[free] and good((free,), 0):
        short.add((free,))
        yield (free,)
    for s in reversed(sizes):
        if free - s <= s < free and left[free - s] > (free - s == s) and good((s, free - s), 0):
            short.add((s, free - s))
            yield s, free - s
    full = (1 << (free + 1)) - 1
    for s in sizes:
        sums, n, step = reach[-1], min(left[s], free // s), 1
        while n:
            k = min(step, n)
            sums |= (sums << (s * k)) & full
            n, step = n - k, step * 2
        reach.append(sums)
    for waste in range(min(free, free if most_waste is None else most_waste) + 1):
        if reach[-1] >> (free - waste) & 1:
            for f in exact(len(sizes), free - waste):
                if f not in short and good(f, waste):
                    yield f
        if effort[0] <= 0:
            return


def pack(sizes: list[int], capacity: int = CAPACITY, effort: int = EFFORT) -> list[list[int]]:
    """Sizes (1 to capacity) in bins: best fit decreasing, then bin completion if that misses the bound.

    effort limits the choices that are looked at; where the search ends before, the bins are as few as can be.
    """
    best = best_fit(sizes, capacity)
    left = np.bincount(np.array(sizes, np.int64), minlength=capacity + 1)
    fewest, total, left = fewest_bins(left, capacity), sum(sizes), left.tolist()
    tops = [s for s in range(capacity, 0, -1) if left[s]]
    step, budget = max(1, len(best) // COMPLETED), [effort]
    done: list[list[int]] = []

    def take(filling: list[int], n: int) -> None:
        for s in filling:
            left[s] -= n

    def spare() -> int:
        """The waste that fewer bins than the incumbent's have in all."""
        return (len(best) - 1) * capacity - total

    def branches(top: int, waste: int) -> Iterator[list[int]]:
        """Fillings around the largest piece left."""
        left[top] -= 1
        for f in fillings(left, capacity - top, spare() - waste, budget):
            left[top] += 1
            yield [top, *f]
            left[top] -= 1
        left[top] += 1

    at, wasted = [0], [0]  # for each open bin: where its largest piece stands in tops, and the waste before it
    open_ = [branches(tops[0], 0)] if len(best) > fewest else []
    while open_ and budget[0] > 0 and len(best) > fewest:
        budget[0] -= 1
        filling = next(open_[-1], None)
        if filling is None:
            del open_[-1], at[-1], wasted[-1]
            if done:
                take(done.pop(), -1)
            continue
        waste, i = wasted[-1] + capacity - sum(filling), at[-1]
        if waste > spare():
            continue
        take(filling, 1)
        done.append(filling)
        while i < len(tops) and not left[tops[i]]:
            i += 1
        if i == len(tops):
            if len(done) < len(best):
                best = done.copy()
        else:
            promising = True
            if len(done) % step == 0:
                promising = len(done) + fewest_bins(np.array(left), capacity) < len(best)
                rest = best_fit([s for s in tops[i:] for _ in range(left[s])], capacity) if promising else []
                if promising and len(done) + len(rest) < len(best):
                    best = done + rest
            if promising:
                open_.append(branches(tops[i], waste))
                at.append(i)
                wasted.append(waste)
                continue
        take(done.pop(), -1)
    return best


def pack_sequences(pieces_: DataFrame, capacity: int = CAPACITY, group: int = GROUP, effort: int = EFFORT) -> DataFrame:
    """pieces_ (doc_id, piece, start, length, ids_crc32, ...) with sequence_id and offset.

    Pieces of full length are sequences of their own. The others are dealt round robin to groups of about group pieces.
    Equal lengths are interchangeable. An empty table gives no rows.
    """
    full = pieces_.where(F.col("length") >= capacity)
    rest = pieces_.where(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if len(b)]
        if not rows:
            return
        rows = pa.Table.from_batches(rows).combine_chunks()
        lengths = rows["length"].to_numpy()
        order = np.argsort(lengths, kind="stable")
        first = {int(s): int(i) for s, i in zip(*np.unique(lengths[order], return_index=True), strict=True)}
        seq, off = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
        base = (rows["__part"][0].as_py() + 1) << 33
        for k, b in enumerate(pack(lengths.tolist(), capacity, effort)):
            at = 0
            for s in b:
                i = order[first[s]]
                first[s] += 1
                seq[i], off[i] = base + k, at
                at += s
        yield from rows.drop_columns("__part").append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off)).to_batches()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces_.schema) + ", sequence_id long, offset long"
    dealt = rest.repartition(groups).withColumn("__part", F.spark_partition_id())
    alone = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return dealt.mapInArrow(run, schema).unionByName(alone)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, group: int = GROUP, effort: int = EFFORT) -> DataFrame:
    """A row per piece of each row of docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    docs needs doc_id and text. A null or empty text has only the closing id 0 and makes a piece of length 1. Rows that
    share a doc_id, and null ids, are packed each for itself. Pieces of a sequence follow each other without a gap.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    return pack_sequences(scratch.keep(pieces(docs, tokenizer_path, capacity)), capacity, group, effort)
