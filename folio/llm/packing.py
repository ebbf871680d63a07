"""Best-fit packing improved by swap-based local search.

Documents become token ids (word BPE, then an end id), and only longer ones are cut into pieces of
``capacity``. Pieces are dealt at random over groups of about ``GROUP``; each group is packed online, a piece in the fullest bin with
room for it, and then searched locally: pieces of the emptiest bins move into fuller ones, or change places with one smaller piece
of a fuller bin or with two that are smaller together, or two of them with one that is smaller. Each step takes length from an emptier bin to a fuller one, so it raises
the sum of squared fills; the search ends when there are as few bins as the lengths allow, or when no bin, with any of the
donors that are tried, gains; in the last case it is begun once more from the longest pieces. What each group holds in its emptiest bin is then packed again with that of the other groups, until
one group is left. No bin or search step depends on the number of rows outside its group.

The tokenizer splits at white space and at the borders between letters, digits and other characters,
so ids are looked up in bounded tables per chunk between white space, then per part of a chunk; only
parts that are not there go through the model. A test holds the ids against the tokenizer's own.
"""

from __future__ import annotations

import json
import sys
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import record, save, slices

CAPACITY = 4096
END = 1
GROUP = 20_000
#: Pieces of a bin up to which pairs of them are tried for one that is longer.
PAIRED = 24
VOCABULARY = "word_bpe_49k.json"
_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_PIECE_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Marks that end a chunk as one part.
_MARKS = ".,;:!?|#$%&*()[]{}<>/\\\"+-=_~^@`"
#: Chunks that a worker keeps at most; the table is not emptied, so frequent chunks, which come early, stay.
KEPT = 300_000
_tables: dict = {}
assert array("I").itemsize == 4 and sys.byteorder == "little"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Encoder:
    """Texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        # For chunks, which hold no special token as it is written: lower-casing must not make one.
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.kept: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        # How the vocabulary file splits and writes bytes. Where Unicode's forms could matter, the tokenizer itself is asked.
        self.split = regex.compile(json.loads(Path(path).read_text())["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.plain = regex.compile("[\x21-\x7e\xa1-\xff]+")
        printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        other = [b for b in range(256) if b not in printed]
        self.shown = {b: chr(b) for b in printed} | {b: chr(256 + k) for k, b in enumerate(other)}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _tables:
            _tables[path] = cls(path)
        return _tables[path]

    def _part(self, part: str) -> bytes:
        """The ids of letters, a digit or other characters that the tokenizer would not split again."""
        if (got := self.parts.get(part)) is None:
            raw = part if part.isascii() else "".join(map(self.shown.__getitem__, part.encode()))
            got = array("I", [t.id for t in self.model.tokenize(raw)]).tobytes()
            if len(self.parts) < 2 * KEPT and len(part) <= 64:
                self.parts[part] = got
        return got

    def _new(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "replace")
        if not text.isascii():
            text = text.lower()
        stem = text.rstrip(_MARKS)
        if stem.isalpha() and (stem.isascii() or self.plain.fullmatch(stem)):
            out = self._part(stem) + self._part(text[len(stem) :]) if len(stem) < len(text) else self._part(stem)
        elif self.plain.fullmatch(text):
            out = b"".join(map(self._part, self.split.findall(text)))
        else:
            out = array("I", self.tokenizer.encode(chunk.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()
        if len(self.kept) < KEPT and len(chunk) <= 64:
            self.kept[chunk] = out
        return out

    def __call__(self, text: str | None) -> bytes:
        if text and any(t in text for t in self.special):
            return array("I", self.whole.encode(text.encode("utf-8", "replace").decode("utf-8"), add_special_tokens=False).ids).tobytes()
        chunks = (text or "").encode("utf-8", "replace").lower().split()
        got = list(map(self.kept.get, chunks))
        if None in got:
            got = [self._new(c) if g is None else g for c, g in zip(chunks, got)]
        return b"".join(got)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, text) to a row per piece: doc_id, piece, start, length, ids_crc32. A null text is empty: the end id alone."""
    end = END.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.of(path)
        for b in slices(batches, 256):
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = encode(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield record(_PIECE, *zip(*rows))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _PIECE_DDL)


def best_fit(lengths: list[int], capacity: int, order: list[int] | None = None) -> list[list[int]]:
    """Online best fit, in the pieces' order or the given one: bins as lists of positions."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free, bin), in order
    for i in range(len(lengths)) if order is None else order:
        n = lengths[i]
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            free, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if free > n:
            insort(room, (free - n, b))
    return bins


class Search:
    """Local search over bins: moves and exchanges, each of which takes length from an emptier bin to a fuller one, so raises the sum of squared fills."""

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.bins, self.lengths, self.capacity = [list(b) for b in bins], lengths, capacity
        self.fill = [sum(lengths[i] for i in b) for b in self.bins]
        self.least = -(-sum(self.fill) // capacity)
        self.moves = self.exchanges = self.pairs = 0

    def _apply(self, new: list[int], owner: dict[int, int], host: int, out: list[int]) -> int:
        """Put ``new`` in the host for ``out``, which goes where the first of them was; gives that bin."""
        donor = owner[new[0]]
        for x in new:
            self.bins[owner[x]].remove(x)
            self.fill[owner[x]] -= self.lengths[x]
        back = sum(self.lengths[i] for i in out)
        self.bins[donor] += out
        self.fill[donor] += back
        self.bins[host] = [i for i in self.bins[host] if i not in out] + new
        self.fill[host] += sum(self.lengths[x] for x in new) - back
        self.moves += not out
        self.exchanges += len(out) == len(new) == 1
        self.pairs += len(out) + len(new) == 3
        return donor

    def _best(self, host: int, pool: list[tuple[int, int]], two: bool) -> tuple[int, list[int], list[int]]:
        """What fills the host most: (gain, places in the pool, what leaves the host for them)."""
        room, sizes, best = self.capacity - self.fill[host], self.lengths, (0, [], [])
        content = self.bins[host]
        outs = [[], *[[i] for i in content]]
        if not two and len(content) <= PAIRED:
            outs += [[i, j] for k, i in enumerate(content) for j in content[:k]]
        for out in outs:
            gone = sum(sizes[i] for i in out)
            if two:  # the longest two of the pool that fit together
                low, high = 0, bisect_right(pool, (gone + room, len(sizes))) - 1
                while low < high and pool[high][0] >= gone:  # no bin of theirs may gain
                    both = pool[low][0] + pool[high][0]
                    if both > gone + room:
                        high -= 1
                        continue
                    if both - gone > best[0]:
                        best = (both - gone, [high, low], out)
                    low += 1
            else:
                at = bisect_right(pool, (gone + room, len(sizes))) - 1
                if at >= 0 and pool[at][0] - gone > best[0]:
                    best = (pool[at][0] - gone, [at], out)
            if best[0] == room:
                break
        return best

    def _fill(self, donors: list[int], two: bool = False) -> bool:
        """One turn of every fuller underfull bin, fullest first, with the donors' pieces; whether anything moved."""
        owner = {i: d for d in donors for i in self.bins[d]}
        pool = sorted((self.lengths[i], i) for i in owner)
        top = max(self.fill[d] for d in donors)
        taken = set(donors)
        hosts = sorted((b for b in range(len(self.bins)) if b not in taken and top <= self.fill[b] < self.capacity), key=lambda b: (-self.fill[b], b))
        changed = False
        for b in hosts:
            while pool and self.fill[b] < self.capacity:
                gain, places, out = self._best(b, pool, two)
                if not gain:
                    break
                new = [pool.pop(at)[1] for at in places]  # the later place first
                donor = self._apply(new, owner, b, out)
                for x in new:
                    del owner[x]
                for i in out:
                    owner[i] = donor
                    insort(pool, (self.lengths[i], i))
                changed = True
        return changed

    def run(self) -> list[list[int]]:
        """Till there are as few bins as there can be, or nothing moves any more."""
        while True:
            live = [b for b in range(len(self.bins)) if self.bins[b]]
            over = len(live) - self.least
            if over <= 0:
                break
            under = sorted((b for b in live if self.fill[b] < self.capacity), key=lambda b: (self.fill[b], b))
            # The donors: what must go, and half as much again; then the emptiest bin alone, and twice as many each time.
            sizes = [over + over // 2 + 1, *(1 << k for k in range(len(under).bit_length()))]
            if not (any(self._fill(under[:k]) for k in sizes) or any(self._fill(under[:k], two=True) for k in sizes[1:5])):
                break
        return [b for b in self.bins if b]


def improve(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Empty underfull bins by local search."""
    return Search(bins, lengths, capacity).run()


def packed(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best fit in the pieces' order, searched; where that leaves more bins than the lengths need, also from the longest piece on: the fewer bins of both."""
    found = improve(best_fit(lengths, capacity), lengths, capacity)
    if len(found) * capacity >= sum(lengths) + capacity:
        found = min(found, improve(best_fit(lengths, capacity, sorted(range(len(lengths)), key=lambda i: -lengths[i])), lengths, capacity), key=len)
    return found


def pack(found: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Pieces (with a length of at most ``capacity``) to the same rows with sequence_id and offset.

    Every sequence is gapless from offset 0. Rows that are alike, with a null doc_id or not, are packed apiece and dealt over
    the groups. Columns that are called sequence_id or offset are replaced. No rows give none.
    The pieces should be a saved table: they are read once a round.
    """
    found = found.drop("sequence_id", "offset")
    names, mark = found.columns, "_group"
    while mark in names:
        mark += "_"
    whole = [f for f in found.schema.fields]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole)
    todo, done, level = found, [], 0
    while True:
        n = todo.count()
        groups = max(1, -(-n // group))
        last = groups == 1

        def run(batches: Iterator[pa.RecordBatch], level: int = level, last: bool = last) -> Iterator[pa.RecordBatch]:
            """The partition comes in order of group."""
            held: list[pa.RecordBatch] = []

            def placed(t: pa.Table) -> Iterator[pa.RecordBatch]:
                lengths = t.column("length").to_pylist()
                bins = packed(lengths, capacity)
                rest = min(range(len(bins)), key=lambda b: sum(lengths[i] for i in bins[b])) if not last else -1
                order = [i for b in bins for i in b]
                number = (level << 56) + (t.column(mark)[0].as_py() << 20)
                ids, at = [], []
                for b, content in enumerate(bins):
                    offset = 0
                    for i in content:
                        ids.append(None if b == rest else number + b)
                        at.append(offset)
                        offset += lengths[i]
                t = t.drop_columns(mark).take(pa.array(order, pa.int64()))
                t = t.append_column("sequence_id", pa.array(ids, pa.int64())).append_column("offset", pa.array(at, pa.int64()))
                yield from t.to_batches(max_chunksize=65536)

            now = None
            for b in batches:
                ids = b.column(b.num_columns - 1).to_numpy()
                for part in np.split(np.arange(b.num_rows), np.flatnonzero(np.diff(ids)) + 1):
                    if not len(part):
                        continue
                    if now is not None and ids[part[0]] != now:
                        yield from placed(pa.Table.from_batches(held))
                        held = []
                    now = ids[part[0]]
                    held.append(b.slice(part[0], len(part)))
            if held:
                yield from placed(pa.Table.from_batches(held))

        order = F.xxhash64(F.lit(level), F.monotonically_increasing_id(), *[c for c in ("doc_id", "piece") if c in names])
        dealt = todo.withColumn(mark, F.pmod(order, F.lit(groups)).cast("long"))
        dealt = dealt.repartition(mark).sortWithinPartitions(mark) if groups > 1 else dealt.coalesce(1)
        out = dealt.mapInArrow(run, ddl + ", sequence_id long, offset long")
        if last:
            done.append(out)
            break
        out = save(out, f"packed{level}")
        done.append(out.where("sequence_id is not null"))
        todo = save(out.where("sequence_id is null").select(names), f"rest{level}")
        level += 1
    all_ = done[0]
    for more in done[1:]:
        all_ = all_.unionByName(more)
    return all_


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """All documents as pieces with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(save(pieces(docs, path or vocabulary_path(), capacity), "pieces"), capacity)


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    from folio.llm.common import table

    return pack_documents(table(spark, sf_dir, "documents"))
