"""Best-fit packing of tokenized documents into sequences.

Pieces are packed by best-fit decreasing: longest first, each into the open sequence with the least
room that still holds it, found in a segment tree over remaining capacities. Equal lengths are
interchangeable, so the whole run needs only how many pieces there are of each length: bins of equal
room are handled together, and the plan (a few thousand runs at most, whatever the corpus) says
which bins the i-th piece of a length goes to. Pieces find their i from counts per task and length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from codefindings.llm.common import doc_id, documents, stored, whole_text
from codefindings.llm.registry import query
from codefindings.llm.words import buffer_of, slices, span_hashes, word_spans

CAPACITY = 2048
END = 0
TOKENIZER = 'word_bpe_49k.json'
CACHED = 2_000_000
MARKS = '!#$%&*+,-./:;=?@\\^_`|~()[]{}"'
SPECIAL = b'<|'


class WordTokens:
    """Ids of texts, word by word, without a Python object per word.

    The tokenizer lower-cases, drops white space and never joins across it, so a text's ids are those
    of its words in turn. Words are told apart by their 64-bit hashes; a sorted table leads from a
    hash to the word's ids. A new word of Latin letters followed by ASCII punctuation is one or two
    units, each of which the tokenizer keeps together and ends with an id of its own kind; new units
    are encoded in one call and told apart by those ids. Every other new word, and every text that
    may hold a special token, goes to the tokenizer by itself. The table starts anew at ``CACHED``
    words, which bounds the memory.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(1 + max(vocabulary.values()), bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith('</w>')]] = True
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.place = np.zeros((0, 2), np.int64)
        self.ids = np.zeros(1 << 16, '<u4')
        self.used = 0

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, known) of each hash; a place is a start in ``ids`` and a length."""
        if not len(self.keys):
            return np.zeros((len(hashes), 2), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return self.place[at], self.keys[at] == hashes

    def add(self, hashes: np.ndarray, ids: list[bytes]) -> None:
        """Enter new words; hashes may be in any order and hold repeats of equal words."""
        lengths = np.array([len(i) for i in ids], np.int64) // 4
        new = np.frombuffer(b''.join(ids), '<u4')
        while self.used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used:self.used + len(new)] = new
        starts = self.used + np.cumsum(lengths) - lengths
        self.used += len(new)
        hashes, first = np.unique(hashes, return_index=True)
        at = np.searchsorted(self.keys, hashes)
        self.keys = np.insert(self.keys, at, hashes)
        self.place = np.insert(self.place, at, np.stack([starts, lengths], 1)[first], 0)

    def learn(self, words: list[bytes], hashes: np.ndarray) -> None:
        """Enter words that the table does not have."""
        lowered = b'\n'.join(words).decode().lower().split('\n') if words else []
        whole, cut = [], []
        for i, (word, low) in enumerate(zip(words, lowered, strict=True)):
            letters = low.rstrip(MARKS)
            if letters.isalpha() and (letters.isascii() or max(letters) < '\u0250'):
                cut.append((i, letters, low[len(letters):]))
            else:
                whole.append((i, self.encoded(word.decode())))
        units = self.units({u for _, letters, marks in cut for u in (letters, marks) if u})
        entries = whole + [(i, units[letters] + units[marks] if marks else units[letters]) for i, letters, marks in cut]
        if entries:
            self.add(hashes[[i for i, _ in entries]], [ids for _, ids in entries])

    def units(self, units: set[str]) -> dict[str, bytes]:
        """The ids of units, from the table if a word of that spelling is in it."""
        order = sorted(units)
        if not order:
            return {}
        data, offsets = buffer_of(pa.array(order))
        place, known = self.find(span_hashes(data, offsets[:-1], offsets[1:]))
        out = {order[i]: self.ids[place[i, 0]:place[i, 0] + place[i, 1]].tobytes() for i in np.flatnonzero(known)}
        new = [order[i] for i in np.flatnonzero(~known)]
        ids = np.array(self.tokenizer.encode(' '.join(new), add_special_tokens=False).ids, '<u4')
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(new):
            return out | {u: self.encoded(u) for u in new}
        raw, start = ids.tobytes(), 0
        for unit, end in zip(new, (4 * cuts).tolist()):
            out[unit] = raw[start:end]
            start = end
        return out

    def encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, '<u4').tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): the ids of text ``i`` with the end id are ``ids[bounds[i]:bounds[i + 1]]``."""
        if len(self.keys) >= CACHED:
            self.forget()
        data, offsets = buffer_of(texts)
        starts, ends = word_spans(data, offsets)
        hashes = span_hashes(data, starts, ends)
        order = np.argsort(hashes, kind='stable')
        ranked = hashes[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else order
        distinct_hashes = ranked[first]
        _, known = self.find(distinct_hashes)
        fresh = order[first][~known]
        raw = data.tobytes()
        self.learn([raw[a:b] for a, b in zip(starts[fresh].tolist(), ends[fresh].tolist())], hashes[fresh])
        place, _ = self.find(distinct_hashes)
        which = np.empty(len(hashes), np.int64)
        which[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ranked))))
        begin, count = place[which, 0], place[which, 1]
        doc = np.searchsorted(offsets, starts, 'right') - 1
        total = np.bincount(doc, count, len(texts)).astype(np.int64) + 1
        bounds = np.concatenate([[0], np.cumsum(total)])
        out = np.full(bounds[-1], END, '<u4')
        before = np.cumsum(count) - count
        step = np.arange(int(count.sum()))
        out[step + np.repeat(doc, count)] = self.ids[step + np.repeat(begin - before, count)]
        return out, bounds


PIECES = 'doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, place bigint'


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, place) for every piece of every row of ``docs``.

    A document is its tokens and the end id, cut into pieces of ``capacity`` ids. ``place`` counts
    the pieces of one length within the task ``part``. Needs doc_id and text. A NULL or empty text is
    the end id alone; repeated rows are packed once each.
    """
    size = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, seen = WordTokens(tokenizer_path), TaskContext.get().partitionId(), Counter()
        end = np.array([END], '<u4').tobytes()
        for batch in batches:
            for run in slices(batch, 'text'):
                rows, texts = [], run.column('text')
                ids, bounds = words.encode(texts)
                special = pc.match_substring(texts, SPECIAL.decode()).to_pylist()
                for k, doc_id in enumerate(run.column('doc_id').to_pylist()):
                    own = ids[bounds[k]:bounds[k + 1]].tobytes()
                    if special[k]:
                        own = words.encoded(texts[k].as_py()) + end
                    for piece, at in enumerate(range(0, len(own), size)):
                        part_ids = own[at:at + size]
                        length = len(part_ids) // 4
                        rows.append((doc_id, piece, at // 4, length, zlib.crc32(part_ids), part, seen[length]))
                        seen[length] += 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
                        pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))],
                        names=['doc_id', 'piece', 'start', 'length', 'ids_crc32', 'part', 'place'])

    return docs.select(doc_id(), whole_text().alias('text')).mapInArrow(cut, PIECES)


class Room:
    """Segment tree over remaining capacities: is there an open bin with that much room?"""

    def __init__(self, capacity: int):
        self.leaves = 1 << (capacity + 1).bit_length()
        self.any = bytearray(2 * self.leaves)

    def put(self, room: int, there: bool) -> None:
        at = room + self.leaves
        self.any[at] = there
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, length: int) -> int | None:
        """The smallest room of at least ``length``."""
        at = length + self.leaves
        while not self.any[at]:
            while at & 1:
                at //= 2
                if at <= 1:
                    return None
            at += 1
            if at & (at - 1) == 0:
                return None
        while at < self.leaves:
            at = 2 * at if self.any[2 * at] else 2 * at + 1
        return at - self.leaves


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (first, length, bin, per_bin, offset) of best-fit decreasing over pieces in order of length.

    Pieces are numbered from 0, longest first. Piece ``first + j`` of a run goes to bin
    ``bin + j // per_bin`` at ``offset + (j % per_bin) * length``.
    """
    room, bins, runs, first, made = Room(capacity), {}, [], 0, 0

    def add(left: int, start: int, count: int) -> None:
        if count and left:
            if not bins.get(left):
                room.put(left, True)
            bins.setdefault(left, []).append((start, count))

    for length in sorted(counts, reverse=True):
        open_pieces = counts[length]
        while open_pieces:
            left = room.tightest(length)
            if left is None:
                per_bin = capacity // length
                start, count = made, -(-open_pieces // per_bin)
                left, made = capacity, made + count
            else:
                start, count = bins[left].pop()
                if not bins[left]:
                    room.put(left, False)
                per_bin = left // length
            full = min(count, open_pieces // per_bin)
            more = min(open_pieces - full * per_bin, per_bin) if full < count else 0
            runs.append((first, length, start, per_bin, capacity - left))
            placed = full * per_bin + more
            first, open_pieces = first + placed, open_pieces - placed
            add(left - per_bin * length, start, full)
            if more:
                add(left - more * length, start + full, 1)
            add(left, start + full + (more > 0), count - full - (more > 0))
    return runs


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece.

    Only lengths, counts and digests of pieces are stored and shuffled, never ids; the driver gets at
    most ``capacity`` counts. An empty table gives no rows.
    """
    own = stored(pieces(docs, tokenizer_path, capacity), 'pack-pieces')
    tasks = own.groupBy('part', 'length').agg(F.count(F.lit(1)).alias('n'))
    earlier = Window.partitionBy('length').orderBy('part').rowsBetween(Window.unboundedPreceding, -1)
    before = tasks.withColumn('before', F.coalesce(F.sum('n').over(earlier), F.lit(0))).drop('n')
    counts = {r.length: r.n for r in tasks.groupBy('length').agg(F.sum('n').alias('n')).collect()}
    runs = np.array(plan(counts, capacity), np.int64).reshape(-1, 5)
    lengths = np.array(sorted(counts, reverse=True), np.int64)
    ahead = np.concatenate([[0], np.cumsum([counts[n] for n in lengths.tolist()])]).astype(np.int64)

    @F.pandas_udf('sequence_id bigint, offset bigint')
    def place(length, rank):
        import pandas as pd
        number = ahead[np.searchsorted(-lengths, -length.to_numpy())] + rank.to_numpy()
        run = runs[np.searchsorted(runs[:, 0], number, 'right') - 1]
        j, per_bin = number - run[:, 0], run[:, 3]
        return pd.DataFrame({'sequence_id': run[:, 2] + j // per_bin,
                             'offset': run[:, 4] + (j % per_bin) * run[:, 1]})

    return (own.join(before, ['part', 'length'])
            .withColumn('_at', place('length', F.col('place') + F.col('before')))
            .select('doc_id', 'piece', 'start', 'length', 'ids_crc32', '_at.sequence_id', '_at.offset'))


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the installed file of a public tokenizer lies; the same on driver and executors."""
    import public_tokenizers
    return public_tokenizers.path(name)


@query('op10_pack_best_fit')
def op10_pack_best_fit(spark, sf_dir):
    return pack(documents(spark, sf_dir), tokenizer_path())
