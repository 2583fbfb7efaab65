"""SentencePiece encoding and decoding by suffix-array matching.

The text of a batch is cut where no piece of the vocabulary can reach across (before a run of blanks that follows
something else, and around line breaks that occur in no piece); the different stretches are laid end to end and
indexed by a suffix array, sorted by prefix doubling up to the longest piece. A binary search of every piece, several
characters at a time, finds the range of suffixes that begin with it, that is all its occurrences; these are the edges
of the lattice, sorted by position. Then the lattice is relaxed in the order that the byte-pair model asks for: in
each round every stretch joins its best-scored adjacent pair (the leftmost among equals) until no pair is a piece.
Characters without a piece fall back to bytes. A worker remembers the ids of stretches for two generations: what the
last one knows moves on when it is met again, and the rest is forgotten with it.

Decoding maps each id to its bytes, turns the blank mark into a space and takes off the one that encoding put first.

The vocabulary file is a parameter and must be a byte-pair model with byte fallback, an identity normaliser and a
dummy prefix. Nothing is trained. Whole texts are encoded; a stretch longer than ``LONG`` characters is relaxed with a
heap, so that time grows with its length and not its square.

Defined results: a null text encodes as an empty one, to no ids; a literal blank mark (U+2581) in a text reads back
as a space, as in the format itself, and such a text is reported as not round-tripping; rows are encoded one by one.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.batches import slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The blank mark of the format.
BLANK = "▁"
#: Characters of different stretches that one suffix array indexes.
INDEX_CHARS = 1 << 18
LONG = 256
#: Stretches, and their characters, that a worker remembers in one generation; it holds the present and the last one.
REMEMBERED, REMEMBERED_CHARS = 200_000, 8 << 20
#: Rank of "no piece"; a rank and a place in a short stretch share 31 bits.
_NONE = (1 << 23) - 1
#: Upper bounds of the lengths of stretches that are relaxed together.
_WIDTHS = (4, 8, 12, 16, 32, 64, LONG)


class _Numbers(dict):
    """Numbers stretches as they are first asked for, and lists the new ones."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, stretch: str) -> int:
        n = self[stretch] = len(self)
        self.fresh.append(stretch)
        return n


class _Generation:
    """Ids of stretches, one after the other, and where those of each number begin and end."""

    def __init__(self) -> None:
        self.number = _Numbers()
        self.flat, self.cuts, self.chars = np.empty(0, np.int32), np.zeros(1, np.int64), 0

    def ids_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the stretches, one after the other, and how many each has."""
        begins, sizes = self.cuts[numbers], self.cuts[numbers + 1] - self.cuts[numbers]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(begins - (ends - sizes), sizes)], sizes

    def add(self, ids: list[np.ndarray], sizes: list[np.ndarray]) -> None:
        self.flat = np.concatenate([self.flat, *ids])
        self.cuts = np.append(self.cuts, self.cuts[-1] + np.cumsum(np.concatenate(sizes)))


class Codec:
    """Vocabulary tables, and the encoder of stretches."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.bytes_id = {int(pieces[i][3:-1], 16): i for i in range(n) if sp.is_byte(i)}
        if len(self.bytes_id) != 256:
            raise ValueError("the model has no byte fallback")
        usable = [i for i in range(n) if not sp.is_byte(i) and not special[i]]
        self.pieces, self.ids = [pieces[i] for i in usable], np.array(usable, np.int32)
        scores = np.array([sp.get_score(i) for i in usable])
        levels = np.unique(-scores)
        self.rank = np.append(np.searchsorted(levels, -scores), _NONE).astype(np.int32)  # last: no piece
        self.longest = max(map(len, self.pieces))
        self.content = [
            bytes([int(pieces[i][3:-1], 16)]) if sp.is_byte(i) else b"" if special[i] else pieces[i].replace(BLANK, " ").encode()
            for i in range(n)
        ]
        letters = sorted(set(chain.from_iterable(self.pieces)))
        self.code = np.zeros(0x110000, np.int64)
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)  # 0: in no piece
        self.base = len(letters) + 1
        self.width = 1  # characters in one packed number
        while self.base ** (2 * self.width) < 1 << 62:
            self.width *= 2
        self.lengths = np.array([len(p) for p in self.pieces])
        self.words = -(-self.longest // self.width)
        spelled = np.zeros((len(self.pieces), self.words * self.width), np.int64)
        for k, p in enumerate(self.pieces):
            spelled[k, : len(p)] = self.code[[ord(c) for c in p]]
        powers = self.base ** np.arange(self.width - 1, -1, -1, dtype=np.int64)
        #: Each piece in packed numbers, and how many packed numbers begin with the last one's characters.
        self.packed = spelled.reshape(-1, self.words, self.width) @ powers
        free = np.clip(self.width * np.arange(1, self.words + 1) - self.lengths[:, None], 0, self.width)
        self.room = self.base ** free.astype(np.int64)
        apart = "".join(c for c in "\n\t\r" if self.code[ord(c)] == 0)
        alone = f"|[{apart}]" if apart else ""
        if any(BLANK in p.lstrip(BLANK) for p in self.pieces):
            self.stretch = re.compile(f"[^{apart}]+{alone}" if apart else r"(?s:.+)")
        else:
            self.stretch = re.compile(f"{BLANK}*[^{BLANK}{apart}]+|{BLANK}+{alone}")
        self.young, self.old = _Generation(), _Generation()

    # -- index ------------------------------------------------------------------------------------------------

    def _pack(self, codes: np.ndarray) -> np.ndarray:
        """The next ``width`` characters of every place as one number."""
        key, width = codes, 1
        while width < self.width:
            ahead = np.zeros_like(key)
            ahead[:-width] = key[width:]
            key, width = key * self.base**width + ahead, 2 * width
        return key

    def _suffixes(self, key: np.ndarray) -> np.ndarray:
        """Places in the order of their next ``longest`` characters, by prefix doubling from the packed ones."""
        n, width = len(key), self.width
        while True:
            order = np.argsort(key)
            if width >= self.longest:
                return order
            sorted_key = key[order]
            rank = np.empty_like(order)
            rank[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
            ahead = np.zeros_like(rank)
            ahead[:-width] = rank[width:] + 1
            key, width = rank * (n + 1) + ahead, 2 * width

    def _ranges(self, key: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each piece, the range of suffixes that begin with it: a binary search, one packed number after another."""
        head = key[order]
        low = np.searchsorted(head, self.packed[:, 0])
        high = np.searchsorted(head, self.packed[:, 0] + self.room[:, 0])
        key = np.concatenate((key, np.zeros(self.longest, np.int64)))
        for word in range(1, self.words):
            some = np.flatnonzero((self.lengths > word * self.width) & (low < high))
            bounds = []
            for value in (self.packed[some, word], self.packed[some, word] + self.room[some, word]):
                a, b = low[some], high[some]
                going = np.arange(len(some))
                while len(going):
                    mid = (a[going] + b[going]) >> 1
                    right = key[order[mid] + word * self.width] < value[going]
                    a[going[right]] = mid[right] + 1
                    b[going[~right]] = mid[~right]
                    going = going[a[going] < b[going]]
                bounds.append(a)
            low[some], high[some] = bounds
        return low, high

    def _edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, piece) of every occurrence of every piece, sorted by place."""
        key = self._pack(codes)
        order = self._suffixes(key)
        low, high = self._ranges(key, order)
        counts = high - low
        piece = np.repeat(np.arange(len(self.pieces)), counts)
        # Ranges of the suffix array, one after the other: steps of one with jumps where a range begins.
        at = np.arange(len(piece))
        at += np.repeat(low - (np.cumsum(counts) - counts), counts)
        bits = len(self.pieces).bit_length()
        edge = order[at] << bits | piece
        edge.sort()
        return edge >> bits, edge & ((1 << bits) - 1)

    # -- relaxation -------------------------------------------------------------------------------------------

    def _relax(self, best: np.ndarray, size: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> None:
        """Join adjacent symbols of all stretches at once, one pair per stretch and round.

        ``size`` holds the characters of the symbol at each place, 0 where one was joined to an earlier symbol.
        """
        width, rows = self.longest + 2, int((ends - begins).max())
        back = np.arange(-1, len(size) - 1)  # where the symbol before begins

        def rank(at: np.ndarray, together: np.ndarray) -> np.ndarray:
            return self.rank[best[at * width + np.minimum(together, width - 1)]]

        places = begins + np.arange(rows)[:, None]
        key = rank(np.minimum(places, len(size) - 1), np.where(places + 1 < ends, 2, width - 1)) << 8
        key |= np.arange(rows, dtype=np.int32)[:, None]
        while True:
            least = key.min(0)
            live = np.flatnonzero(least < _NONE << 8)
            if not len(live):
                return
            if 2 * len(live) < len(begins):
                key, begins, ends, least = key[:, live], begins[live], ends[live], least[live]
                live = np.arange(len(begins))
            row = least[live] & 255
            begin, end = begins[live], ends[live]
            at = begin + row
            other = at + size[at]
            key[other - begin, live] = _NONE << 8 | (other - begin)
            size[at] += size[other]
            size[other] = 0
            after = at + size[at]
            on = after < end
            back[after[on]] = at[on]
            together = np.full(len(at), width - 1)
            together[on] = size[at[on]] + size[after[on]]
            key[row, live] = rank(at, together) << 8 | row
            inner = np.flatnonzero(at > begin)
            before = back[at[inner]]
            row = before - begin[inner]
            key[row, live[inner]] = rank(before, size[before] + size[at[inner]]) << 8 | row

    def _relax_long(self, best: np.ndarray, size: np.ndarray, begin: int, end: int) -> None:
        """The same order of joins for one long stretch, with a heap."""
        width = self.longest + 2
        sizes, back = [1] * (end - begin), list(range(-1, end - begin - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = i + sizes[i]
            if j < end - begin and sizes[i] + sizes[j] <= self.longest:
                r = int(self.rank[best[(begin + i) * width + sizes[i] + sizes[j]]])
                if r < _NONE:
                    heapq.heappush(heap, (r, i, sizes[i], sizes[j]))

        for i in range(end - begin):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            if sizes[i] != a or sizes[i + a] != b:
                continue
            sizes[i], sizes[i + a] = a + b, 0
            if i + a + b < end - begin:
                back[i + a + b] = i
            offer(i)
            if back[i] >= 0:
                offer(back[i])
        size[begin:end] = sizes

    def _encode_stretches(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all stretches, one after the other, and how many each has."""
        joined = "\0".join(stretches)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
        ends = np.cumsum(sizes + 1) - 1
        begins = ends - sizes
        codes = self.code[points]
        codes[ends[:-1]] = 0  # between stretches
        place, piece = self._edges(codes)
        width = self.longest + 2  # the last column: longer than any piece
        best = np.full(len(codes) * width, len(self.pieces), np.int32)
        best[place * width + self.lengths[piece]] = piece
        size = np.ones(len(codes), np.int64)
        size[ends[:-1]] = 0
        low = 0
        for high in _WIDTHS:
            some = np.flatnonzero((sizes > low) & (sizes <= high))
            if len(some):
                self._relax(best, size, begins[some], ends[some])
            low = high
        for k in np.flatnonzero(sizes > LONG):
            self._relax_long(best, size, int(begins[k]), int(ends[k]))
        starts = np.flatnonzero(size)
        of = np.repeat(np.arange(len(stretches)), sizes + 1)[starts]
        ids = np.append(self.ids, -1)[best[starts * width + size[starts]]]
        counts = np.ones(len(ids), np.int64)
        missing = np.flatnonzero(ids < 0)
        if len(missing):  # characters without a piece, by their bytes
            spelled = [[self.bytes_id[b] for b in chr(points[at]).encode("utf-8", "replace")] for at in starts[missing].tolist()]
            counts[missing] = [len(x) for x in spelled]
            out = np.repeat(ids, counts)
            out[out < 0] = list(chain.from_iterable(spelled))
            ids = out
        return ids, np.bincount(of, counts, len(stretches)).astype(np.int64)

    def _learn(self) -> None:
        """Ids for the stretches that the present generation has numbered but not encoded.

        Those that the last generation knows are taken over, so that what is frequent is never encoded again.
        """
        young, old = self.young, self.old
        fresh = young.number.fresh
        young.number.fresh = []
        known = np.fromiter((old.number.get(s, -1) for s in fresh), np.int64, len(fresh))
        seen, new = np.flatnonzero(known >= 0), np.flatnonzero(known < 0)
        taken, taken_sizes = old.ids_of(known[seen])
        ids, sizes = [taken], [taken_sizes]
        begin = 0
        while begin < len(new):
            end, size = begin, 0
            while end < len(new) and (end == begin or size < INDEX_CHARS):
                size += len(fresh[new[end]]) + 1
                end += 1
            found, counts = self._encode_stretches([fresh[k] for k in new[begin:end].tolist()])
            ids.append(found.astype(np.int32))
            sizes.append(counts)
            begin = end
        # Back into the order of the numbers.
        where = np.argsort(np.concatenate((seen, new)), kind="stable")
        loose = _Generation()
        loose.add(ids, sizes)
        flat, counts = loose.ids_of(where)
        young.add([flat], [counts])
        young.chars += sum(map(len, fresh))

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the bounds of each text's ids."""
        if len(self.young.number) > REMEMBERED or self.young.chars > REMEMBERED_CHARS:
            self.young, self.old = _Generation(), self.young
        cut = [self.stretch.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        n = np.fromiter(map(len, cut), np.int64, len(cut))
        at = np.fromiter(map(self.young.number.__getitem__, chain.from_iterable(cut)), np.int64, int(n.sum()))
        if self.young.number.fresh:
            self._learn()
        values, sizes = self.young.ids_of(at)
        return values, np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(n))]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        values, bounds = self.encode_all(texts)
        return [values[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        content = self.content
        said = b"".join(map(content.__getitem__, ids.tolist()))
        return (said[1:] if said[:1] == b" " else said).decode("utf-8", "replace")


_loaded: dict[str, Codec] = {}


def _codec(path: str) -> Codec:
    if path not in _loaded:
        _loaded[path] = Codec(path)
    return _loaded[path]


#: Characters of text that are encoded together.
BATCH_CHARS = 1 << 20


def _parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > BATCH_CHARS:
            yield begin, i
            begin, size = i, 0
        size += len(t or "") + 1
    if begin < len(texts):
        yield begin, len(texts)


def encode(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text (null: empty), ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            for begin, end in _parts(texts):
                values, bounds = codec.encode_all(texts[begin:end])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(begin, end - begin),
                        batch.column(1).slice(begin, end - begin),
                        pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values)),
                    ],
                    ["doc_id", "text", "ids"],
                )

    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    ).mapInArrow(run, "doc_id bigint, text string, ids array<int>")


_DIGESTS = "doc_id bigint, n_ids bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean"
_DECODED = f"{_DIGESTS}, decoded string, ids array<int>"


def _decoded(
    codec: Codec, doc_ids: pa.Array, texts: list[str], values: np.ndarray, bounds: np.ndarray, digests: bool = False
) -> pa.RecordBatch:
    """The rows of ``decode`` for ids that lie one after the other."""
    rows = [values[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    said = [codec.decode(r) for r in rows]
    columns = {
        "doc_id": doc_ids,
        "n_ids": pa.array([len(r) for r in rows], pa.int64()),
        "ids_sha256": pa.array([hashlib.sha256(r.astype("<i4", copy=False)).hexdigest() for r in rows], pa.string()),
        "decoded_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in said], pa.string()),
        "round_trip": pa.array([t == o for t, o in zip(said, texts, strict=True)], pa.bool_()),
    }
    if not digests:
        columns["decoded"] = pa.array(said, pa.string())
        columns["ids"] = pa.ListArray.from_arrays(
            pa.array(bounds - bounds[0], pa.int32()), pa.array(values[bounds[0] : bounds[-1]], pa.int32())
        )
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``encoded`` (doc_id, text, ids) with decoded, the text that the ids spell, and digests of ids and text.

    ``ids_sha256`` is over the ids as 4-byte little-endian integers, ``decoded_sha256`` over the UTF-8 text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in slices(batches):
            lists = batch.column(2)
            bounds = lists.offsets.to_numpy()
            yield _decoded(codec, batch.column(0), batch.column(1).to_pylist(), lists.values.to_numpy(), bounds)

    return encoded.select("doc_id", "text", "ids").mapInArrow(run, _DECODED)


def round_trip(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """``decode(encode(docs))`` in one Python step, so that a task holds one worker and one vocabulary.

    With ``digests`` only, decoded and ids stay in the worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in slices(batches):
            texts = batch.column(1)
            for begin, end in _parts(texts.to_pylist()):
                part = texts.slice(begin, end - begin).to_pylist()
                values, bounds = codec.encode_all(part)
                yield _decoded(codec, batch.column(0).slice(begin, end - begin), part, values, bounds, digests)

    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    ).mapInArrow(run, _DIGESTS if digests else _DECODED)
