"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of hashed word 5-grams (a shorter text, but not a wordless one, is one gram of all its words); texts
are linked when the Jaccard similarity of their sets is 0.8 or more.

1. Texts with equal sets are one class; everything below works on classes, so copies cost nothing.
2. A class has ``BANDS * ROWS + CHECKS`` MinHash values. The first ``BANDS * ROWS`` form bands; classes that agree on
   a whole band share a bucket.
3. Buckets with the same members as one of an earlier band are dropped; each pair belongs to the first band in which
   it agrees, so it is judged once. Large buckets are dealt into tiles: pairs of hashed chunks of bounded size.
4. In a tile, the ``CHECKS`` further values of each pair are compared step by step; with a uniform prior, the
   probability that the similarity reaches the threshold given m agreements out of n is a binomial tail, and pairs
   for which it falls below ``TOLERANCE`` are dropped.
5. The rest are verified exactly on their sets. A tile returns, per class, how many documents it links to and the
   smallest class it hangs together with there: a spanning forest, never all pairs. Components of these forests are
   the near-duplicate groups.

What is lost: a link exactly at the threshold shares no band with probability (1 - 0.8**4)**28 = 3.9e-7 and is dropped
by one of the six steps with 5.4e-8, together about one in 2.2 million; links of 0.85 are lost with 1.5e-9 (``loss``
computes both parts).

Defined results: a text without words (or null) is alone: no links, and a class of its own. Rows that repeat a doc_id
with different texts are judged each by its own text. A null doc_id comes after all others; class_id and copy_id are
null only where all of the class have none. Of rows with equal sets and ids the one with the smallest hash of the text
stands for them.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm import wordhash
from tabulon.llm.batches import slices
from tabulon.llm.common import cut, id_parts, lookup, rest_hash, text_hashes
from tabulon.llm.components import components

GRAM = 5
THRESHOLD = 0.8
BANDS, ROWS, CHECKS, STEP = 28, 4, 48, 8
TOLERANCE = 1e-8
#: Members, and bytes of sets, of one chunk; a tile holds two, and compares them a block of members at a time.
CHUNK_MEMBERS, CHUNK_BYTES, BLOCK_MEMBERS = 512, 8 << 20, 512
#: Classes whose names are sent to every task to find their texts; more of them meet the texts in a shuffle.
SENT_CLASSES = 500_000

_N = BANDS * ROWS + CHECKS
_rng = np.random.default_rng(8)
_FLIP = _rng.integers(0, 1 << 63, _N, dtype=np.uint64) * np.uint64(2)
_SCALE = _rng.integers(0, 1 << 63, _N, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_agreements(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For n = STEP, 2 STEP, ...: the fewest agreements out of n with P(similarity >= threshold) >= tolerance.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1); its upper tail is a binomial sum.
    """
    out = []
    for n in range(STEP, CHECKS + 1, STEP):
        tail = 0.0
        for m in range(n + 1):
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                out.append(m)
                break
    return out


def loss(similarity: float) -> tuple[float, float]:
    """Probabilities that a pair of this similarity shares no band, and that the steps drop it."""
    dropped, alive = 0.0, {0: 1.0}
    for least in _LEAST:
        after: dict[int, float] = {}
        for m, p in alive.items():
            for k in range(STEP + 1):
                after[m + k] = after.get(m + k, 0.0) + p * comb(STEP, k) * similarity**k * (1 - similarity) ** (STEP - k)
        dropped += sum(p for m, p in after.items() if m < least)
        alive = {m: p for m, p in after.items() if m >= least}
    return (1 - similarity**ROWS) ** BANDS, dropped


def gram_sets(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct gram hashes of all texts, text by text and sorted within each, and the bounds of each text."""
    w = wordhash.words(texts)
    at, hashes = wordhash.grams(w, GRAM)
    of = np.searchsorted(w.first, at, "right") - 1
    counts = np.diff(w.first)
    for i in np.flatnonzero((counts > 0) & (counts < GRAM)):
        lo = int(w.first[i])
        acc = np.uint64(0)
        with np.errstate(over="ignore"):
            for h in w.hashes[lo : lo + int(counts[i])]:
                acc = acc * wordhash._STEP + h
        hashes = np.append(hashes, wordhash.mix(np.array([acc + np.uint64(counts[i])])))
        of = np.append(of, i)
    order = np.lexsort((hashes, of))
    of, hashes = of[order], hashes[order]
    fresh = np.ones(len(of), bool)
    fresh[1:] = (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])
    of, hashes = of[fresh], hashes[fresh]
    return hashes, np.searchsorted(of, np.arange(len(texts) + 1))


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(text, _N) MinHash values, 32 bits each; zeros for empty sets."""
    out = np.zeros((len(bounds) - 1, _N), np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        for k in range(_N):
            out[full, k] = np.minimum.reduceat((hashes ^ _FLIP[k]) * _SCALE[k], bounds[full]) >> np.uint64(32)
    return out


def fingerprints(hashes: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """128 bits of each set, from two sums over its members; None for empty sets."""
    full = np.flatnonzero(np.diff(bounds))
    out: list[bytes | None] = [None] * (len(bounds) - 1)
    if len(full):
        a = np.add.reduceat(hashes, bounds[full])
        b = np.add.reduceat(wordhash.mix(hashes + np.uint64(0x5851F42D4C957F2D)), bounds[full])
        both = np.stack([wordhash.mix(a ^ (b << np.uint64(1))), b], 1).astype(">u8")
        for i, f in zip(full, both, strict=True):
            out[i] = f.tobytes()
    return out


def _bands(sig: np.ndarray) -> np.ndarray:
    """(text, BANDS) hashes of the bands."""
    rows = sig[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
    acc = rows[:, :, 0] + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)
    for k in range(1, ROWS):
        acc = wordhash.mix(acc) + rows[:, :, k]
    return wordhash.mix(acc).view(np.int64)


def _keys(nulls: np.ndarray, ids: np.ndarray, hashes: list[np.ndarray]) -> list[bytes]:
    """Names of rows that order as (id, null last, hashes of the text)."""
    out = np.empty((len(ids), 25), np.uint8)
    out[:, 0] = nulls
    for k, v in enumerate((ids.view(np.uint64) ^ np.uint64(1 << 63), *(h.view(np.uint64) for h in hashes))):
        out[:, 1 + 8 * k : 9 + 8 * k] = v.astype(">u8")[:, None].view(np.uint8)
    return [row.tobytes() for row in out]


def _key_id(key: Column) -> Column:
    """The id in a name; null where it has none."""
    signed = F.conv(F.hex(F.substring(key, 2, 8)), 16, 10).cast("decimal(20,0)") - F.expr("9223372036854775808BD")
    return F.when(F.hex(F.substring(key, 1, 1)) == "00", signed.cast("bigint"))


_SEEN = "no_id boolean, id bigint, ha bigint, hb bigint, rest bigint, key binary, fp binary, n_grams bigint, bands array<bigint>"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.strip().split(" ")[0] for part in _SEEN.split(",")]
    for batch in slices(batches):
        texts = batch.column(5).to_pylist()
        for begin, end in wordhash.blocks(texts):
            part = batch.slice(begin, end - begin)
            hashes, bounds = gram_sets(texts[begin:end])
            bands = _bands(signatures(hashes, bounds))
            nulls, ids, ha, hb = (part.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(k) for k in range(5)),
                    pa.array(_keys(nulls, ids, [ha, hb]), pa.binary()),
                    pa.array(fingerprints(hashes, bounds), pa.binary()),
                    pa.array(np.diff(bounds)),
                    pa.ListArray.from_arrays(np.arange(len(bands) + 1, dtype=np.int32) * BANDS, pa.array(bands.ravel())),
                ],
                names,
            )


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signature and set of each class; a row whose text isn't of the class it was fetched for is left out."""
    for batch in slices(batches):
        texts, wanted = batch.column(1).to_pylist(), batch.column(0).to_pylist()
        for begin, end in wordhash.blocks(texts):
            hashes, bounds = gram_sets(texts[begin:end])
            sig = signatures(hashes, bounds)
            out: dict[str, list] = {"fp": [], "sig": [], "grams": []}
            for i, f in enumerate(fingerprints(hashes, bounds)):
                if f == wanted[begin + i]:
                    out["fp"].append(f)
                    out["sig"].append(sig[i].tobytes())
                    out["grams"].append(hashes[bounds[i] : bounds[i + 1]].tobytes())
            yield pa.RecordBatch.from_pydict(out, pa.schema([(k, pa.binary()) for k in out]))


_LEAST = least_agreements()


def judge(band: int, sig: np.ndarray, grams: list[np.ndarray], left: np.ndarray, right: np.ndarray, same: bool) -> np.ndarray:
    """Linked pairs (i, j) of members ``left`` x ``right`` (or within ``left``) that belong to this band."""
    a, b = sig[left], sig[right]
    first = np.full((len(left), len(right)), -1)
    for k in range(band + 1):
        agree = np.ones(first.shape, bool)
        for j in range(k * ROWS, (k + 1) * ROWS):
            agree &= a[:, j, None] == b[None, :, j]
        first[(first < 0) & agree] = k
    mine = first == band
    if same:
        mine &= np.arange(len(left))[:, None] < np.arange(len(right))
    i, j = np.nonzero(mine)
    agreed = np.zeros(len(i), np.int64)
    for step, least in enumerate(_LEAST):  # most pairs of unlike texts fall out after one or two steps
        if not len(i):
            break
        cols = slice(BANDS * ROWS + step * STEP, BANDS * ROWS + (step + 1) * STEP)
        agreed += (a[i, cols] == b[j, cols]).sum(1)
        stay = agreed >= least
        i, j, agreed = i[stay], j[stay], agreed[stay]
    if not len(i):
        return np.empty((0, 2), np.int64)
    sizes = np.fromiter(map(len, grams), np.int64, len(grams))
    li, rj = left[i], right[j]
    if len(i) <= 4 * (len(left) + len(right)):
        shared = np.array([len(np.intersect1d(grams[p], grams[q], assume_unique=True)) for p, q in zip(li, rj, strict=True)])
    else:
        shared = _shared(grams, left, right)[i, j]
    linked = shared >= np.ceil(THRESHOLD / (1 + THRESHOLD) * (sizes[li] + sizes[rj]) - 1e-9)
    return np.stack([li[linked], rj[linked]], 1)


def _shared(grams: list[np.ndarray], left: np.ndarray, right: np.ndarray, width: int = 4096) -> np.ndarray:
    """Sizes of all intersections, by products of incidence matrices over stretches of the vocabulary."""
    parts = [grams[k] for k in (*left, *right)]
    rows = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    _, column, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    often = count[column] > 1  # others are in no intersection
    rows, column = rows[often], column[often]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    if len(column):  # renumber without holes
        column = np.concatenate(([0], np.cumsum(column[1:] != column[:-1])))
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, (at, at + width))
        m = np.zeros((len(parts), width), np.float32)
        m[rows[lo:hi], column[lo:hi] - at] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out.astype(np.int64)


def _blocks(members: np.ndarray) -> list[np.ndarray]:
    return [members[a : a + BLOCK_MEMBERS] for a in range(0, len(members), BLOCK_MEMBERS)]


def _tile(members: list[tuple]) -> list[tuple]:
    """Rows (name, linked documents, name of the root it hangs together with) of one tile."""
    band, i, j = members[0][0], members[0][1], members[0][2]
    members = list({m[4]: m for m in members}.values())
    sig = np.stack([np.frombuffer(m[6], np.uint32) for m in members])
    grams = [np.frombuffer(m[7], np.uint64) for m in members]
    chunk, size = np.array([m[3] for m in members]), np.array([m[5] for m in members])
    left, right = _blocks(np.flatnonzero(chunk == i)), _blocks(np.flatnonzero(chunk == j))
    links, root = np.zeros(len(members)), np.arange(len(members))
    for p, one in enumerate(left):
        for q, other in enumerate(right):
            if i == j and q < p:
                continue
            pairs = judge(band, sig, grams, one, other, i == j and p == q)
            links += np.bincount(pairs[:, 0], size[pairs[:, 1]], len(members)) + np.bincount(pairs[:, 1], size[pairs[:, 0]], len(members))
            while True:  # hang the higher root of each pair on the lower one
                a, b = root[pairs[:, 0]], root[pairs[:, 1]]
                if (a == b).all():
                    break
                low = np.minimum(a, b)
                np.minimum.at(root, a, low)
                np.minimum.at(root, b, low)
                while (root[root] != root).any():
                    root = root[root]
    return [(members[k][4], int(links[k]), members[root[k]][4]) for k in np.flatnonzero(links)]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by tile; a tile may go over from one batch to the next."""
    schema = pa.schema([("node", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])
    held: list[tuple] = []
    key = None

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    for batch in slices(batches):
        rows: list[tuple] = []
        for bucket, *member in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            now = (bucket, member[1], member[2])
            if now != key:
                if len(held) > 1:
                    rows += _tile(held)
                held, key = [], now
            held.append(tuple(member))
        if rows:
            yield out(rows)
    if len(held) > 1 and (rows := _tile(held)):
        yield out(rows)


def _named(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """What tells rows apart: id, two hashes of the text, and a hash of everything else."""
    no_id, whole = id_parts(F.col(id_col))
    ha, hb = text_hashes(F.col(text_col))
    return [no_id.alias("no_id"), whole.alias("id"), ha.alias("ha"), hb.alias("hb"), rest_hash(docs).alias("rest")]


def _judged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per row of ``docs``: its names (``_named``, key), n_grams, and of its class copy, component, n_links."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text")
    seen = cut(docs.select(*_named(docs, id_col, text_col), text).mapInArrow(_summaries, _SEEN))
    classes = cut(
        seen.where(F.col("fp").isNotNull())
        .groupBy("fp")
        .agg(
            F.min(F.struct("key", "ha", "hb")).alias("rep"),
            F.count("*").alias("size"),
            F.first("n_grams").alias("n_grams"),
            F.first("bands").alias("bands"),
        )
        .select("fp", "rep.*", "size", "n_grams", "bands")
    )
    banded = classes.select("fp", "key", "ha", "hb", "size", "n_grams", F.posexplode("bands").alias("band", "bucket"))
    buckets = cut(
        banded.groupBy("bucket", "band")
        .agg(
            F.count("*").alias("members"),
            F.sum(F.col("n_grams") * 8).alias("bytes"),
            F.bit_xor(F.xxhash64("fp")).alias("set_a"),
            F.bit_xor(F.xxhash64("fp", F.lit(1))).alias("set_b"),
        )
        .where("members > 1")
        .groupBy("members", "set_a", "set_b")
        .agg(F.min(F.struct("band", "bucket")).alias("one"), F.first("bytes").alias("bytes"))
        .select(
            "one.*",
            "members",
            F.greatest(F.ceil(F.col("members") / CHUNK_MEMBERS), F.ceil(F.col("bytes") / CHUNK_BYTES)).cast("int").alias("chunks"),
        )
    )
    total = classes.count() * BANDS
    members = cut(
        lookup(banded, buckets, ["bucket", "band"], "members", total).select(
            "bucket", "band", "chunks", F.pmod(F.xxhash64("fp", F.lit(2)), "chunks").cast("int").alias("chunk"), "fp", "size", "key", "ha", "hb"
        )
    )
    wanted = cut(members.select("ha", "hb", "fp").distinct())
    # Equal texts are one before they are sent, so that many copies of a text travel as one from each task.
    texts = docs.select(*(c.alias(n) for c, n in zip(text_hashes(F.col(text_col)), ("ha", "hb"), strict=True)), text)
    if wanted.count() <= SENT_CLASSES:
        texts = texts.join(F.broadcast(wanted), ["ha", "hb"]).dropDuplicates(["ha", "hb"])
    else:
        texts = texts.dropDuplicates(["ha", "hb"]).join(wanted, ["ha", "hb"])
    payload = texts.select("fp", "text").mapInArrow(_payloads, "fp binary, sig binary, grams binary")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    found = cut(
        members.join(payload, "fp")
        .select("bucket", "band", "chunk", "key", "size", "sig", "grams", other)
        .select(
            "bucket",
            "band",
            F.least("chunk", "other").alias("i"),
            F.greatest("chunk", "other").alias("j"),
            "chunk",
            "key",
            "size",
            "sig",
            "grams",
        )
        .repartition("bucket", "i", "j")
        .sortWithinPartitions("bucket", "i", "j")
        .mapInArrow(_tiles, "node binary, links bigint, root binary")
    )
    groups = components(found, "node", "root")
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    verdicts = cut(
        classes.select("fp", F.col("key").alias("copy"), "size")
        .join(groups.withColumnRenamed("node", "copy"), "copy", "left")
        .join(linked.withColumnRenamed("node", "copy"), "copy", "left")
        .select("fp", "copy", "size", F.coalesce("component", "copy").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    )
    # Rows without words have no class; they meet nothing and keep their own name.
    worded = lookup(seen.where(F.col("fp").isNotNull()).drop("bands"), verdicts, ["fp"], "size", seen.count())
    alone = seen.where(F.col("fp").isNull()).drop("bands")
    return worded.unionByName(
        alone.select("*", F.col("key").alias("copy"), F.lit(1).cast("bigint").alias("size"), F.col("key").alias("component"), F.lit(0).cast("bigint").alias("n_links"))
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_links, copy_id, n_grams.

    ``copy_id`` is the smallest id with an equal set, ``class_id`` the smallest id of the near-duplicate group, and
    ``n_links`` the number of other documents at the threshold or above.
    """
    return _judged(docs, id_col, text_col).select(
        F.when(~F.col("no_id"), F.col("id")).alias("doc_id"),
        _key_id(F.col("component")).alias("class_id"),
        F.col("n_links").cast("bigint").alias("n_links"),
        _key_id(F.col("copy")).alias("copy_id"),
        "n_grams",
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each near-duplicate group, with all its columns: that with the smallest id.

    Rows that agree in id and text are copies of each other, with words or without; the smallest hash of the whole row
    chooses between them.
    """
    names = ["no_id", "id", "ha", "hb"]
    stay = _judged(docs, id_col, text_col).where("key = component").groupBy(*names).agg(F.min("rest").alias("rest"))
    named = docs.select(F.struct("*").alias("doc"), *_named(docs, id_col, text_col))
    # Rows that are equal in every column are one before they are sent.
    return named.dropDuplicates([*names, "rest"]).join(stay, [*names, "rest"], "left_semi").select("doc.*")
