"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of ten consecutive words (an item of fewer words, but not none, is one
window). A document contains a window exactly when the window's words occur in it in a row, so *every* shingle
of the window must occur: any one of them is a necessary prefix, and the rarest in the corpus is the cheapest.

1. One pass over all documents counts how often each benchmark shingle (five words; all words of a shorter
   item) occurs; the counts are summed by key after a partial sum in each task.
2. The shingles of each window are ordered by that count; the first is its prefix token.
3. A second pass emits, for each document, the places of prefix tokens together with the words around them.
   They join the windows on the token; the place of the token inside the window gives the only possible start,
   which must lie inside the document (positional bound) and leave room for the window (length bound).
4. The words of the window are compared one by one. The surviving spans are united per document.

The benchmark goes to the executors in blocks of windows with about ``MAX_SHINGLES`` shingles each, whatever its size
and that of its items: different windows are dealt by a hash, the query set is handled block by block against all
rows, and the blocks' results are combined.

Defined results: null or wordless texts have no words and are never hit; items without words have no windows;
items that repeat an item_id count as one item with the windows of both; a null item_id is counted as an item
named by the empty string. Rows that repeat a doc_id are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm import wordhash
from tabulon.llm.batches import slices
from tabulon.llm.common import cut, text_hashes

WINDOW = 10
SHINGLE = 5
#: Shingles of the benchmark that go to the executors at once (8 bytes each, and their windows).
MAX_SHINGLES = 200_000


def _windows(batches: Iterator[pa.RecordBatch], window: int, shingle: int) -> Iterator[pa.RecordBatch]:
    """Windows of items: item_id, the words, and the shingle hash at each offset."""
    for batch in slices(batches):
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out: dict[str, list] = {"item_id": [], "win_words": [], "shingles": []}
        for item, text in zip(ids, texts, strict=True):
            w = wordhash.words([text])
            n = len(w.hashes)
            if not n:
                continue
            parts = [w.folded[s:e] for s, e in zip(w.starts, w.ends, strict=True)]
            hashes = wordhash.grams(w, min(shingle, n))[1].view(np.int64)
            size = min(window, n)
            for k in range(n - size + 1):
                out["item_id"].append(item)
                out["win_words"].append(parts[k : k + size])
                out["shingles"].append(hashes[k : k + size - min(shingle, n) + 1].tolist())
        yield pa.RecordBatch.from_pydict(out, schema=_WINDOW_SCHEMA)


_WINDOW_SCHEMA = pa.schema(
    [("item_id", pa.string()), ("win_words", pa.list_(pa.binary())), ("shingles", pa.list_(pa.int64()))]
)


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("binary").alias("text")
    )
    return items.mapInArrow(
        lambda batches: _windows(batches, window, shingle), "item_id string, win_words array<binary>, shingles array<bigint>"
    ).dropDuplicates(["item_id", "win_words"])


class _Finder:
    """Places in a block of texts whose shingle is one of a sorted set, for each shingle length."""

    def __init__(self, tokens: dict[int, np.ndarray]) -> None:
        self.tokens = {k: np.sort(v.view(np.uint64)) for k, v in tokens.items()}
        self.sieve = {}
        for k, v in self.tokens.items():
            self.sieve[k] = np.zeros(1 << 20, bool)
            self.sieve[k][(v >> np.uint64(44)).astype(np.int64)] = True

    def __call__(self, w: wordhash.Words) -> tuple[np.ndarray, np.ndarray]:
        places, found = [], []
        for k, tokens in self.tokens.items():
            at, hashes = wordhash.grams(w, k)
            maybe = np.flatnonzero(self.sieve[k][(hashes >> np.uint64(44)).astype(np.int64)])
            at, hashes = at[maybe], hashes[maybe]
            if len(at) and len(tokens):
                hit = tokens[np.minimum(np.searchsorted(tokens, hashes), len(tokens) - 1)] == hashes
                places.append(at[hit])
                found.append(hashes[hit])
        if not places:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.concatenate(places)
        order = np.argsort(at, kind="stable")
        return at[order], np.concatenate(found)[order].view(np.int64)


def _count(batches: Iterator[pa.RecordBatch], finder: _Finder) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = batch.column(0).to_pylist()
        seen = []
        for begin, end in wordhash.blocks(texts):
            seen.append(finder(wordhash.words(texts[begin:end]))[1])
        tokens, n = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.empty(0, np.int64),) * 2
        yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(n.astype(np.int64))], ["token", "n"])


_PLACE = pa.struct([("token", pa.int64()), ("pos", pa.int64()), ("around_from", pa.int64()), ("around", pa.list_(pa.binary()))])


def _places(batches: Iterator[pa.RecordBatch], finder: _Finder, window: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = batch.column(2).to_pylist()
        rows, n_words = [], []
        for begin, end in wordhash.blocks(texts):
            w = wordhash.words(texts[begin:end])
            at, tokens = finder(w)
            n_words.append(np.diff(w.first))
            cuts = np.searchsorted(at, w.first)
            for i in range(end - begin):
                lo, hi, places = int(w.first[i]), int(w.first[i + 1]), []
                for j in range(cuts[i], cuts[i + 1]):
                    p = int(at[j])
                    a, b = max(lo, p - window + 1), min(hi, p + window)
                    around = [w.folded[s:e] for s, e in zip(w.starts[a:b], w.ends[a:b], strict=True)]
                    places.append({"token": int(tokens[j]), "pos": p - lo, "around_from": a - lo, "around": around})
                rows.append(places)
        counts = np.concatenate(n_words) if n_words else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(counts.astype(np.int64)), pa.array(rows, pa.list_(_PLACE))],
            ["row", "doc_id", "n_words", "places"],
        )


def _block_windows(windows: DataFrame, max_shingles: int) -> int:
    """Into how many blocks the windows go. They are all different and have at most ``WINDOW`` shingles each, so a block
    strays from its share only by the chance of the hash."""
    total = windows.agg(F.sum(F.size("shingles"))).first()[0] or 0
    return -(-total // max_shingles)


def contaminated_spans(docs: DataFrame, windows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, doc_id, n_words, start, size, item_id) of verified windows of one block; unhit rows once, with nulls.

    ``docs`` has row, doc_id and text (binary).
    """
    sc = docs.sparkSession.sparkContext
    lengths: dict[int, set[int]] = {}
    held = [(r.item_id, r.win_words, r.shingles) for r in windows.collect()]  # bounded: one block
    for _, win, shingles in held:
        lengths.setdefault(len(win) - len(shingles) + 1, set()).update(shingles)
    every = sc.broadcast(_Finder({k: np.array(sorted(v), np.int64) for k, v in lengths.items()}))
    frequency = dict(
        docs.select("text")
        .mapInArrow(lambda b: _count(b, every.value), "token bigint, n bigint")
        .groupBy("token")
        .agg(F.sum("n").alias("n"))
        .collect()  # bounded: shingles of one block
    )
    rarest: dict[int, set[int]] = {}
    rows = []
    for item, win, shingles in held:
        n, token, offset = min((frequency.get(s, 0), s, i) for i, s in enumerate(shingles))
        if n:  # a shingle that occurs nowhere: its windows occur nowhere
            rarest.setdefault(len(win) - len(shingles) + 1, set()).add(token)
            rows.append((token, offset, item, [bytes(x) for x in win]))
    finder = sc.broadcast(_Finder({k: np.array(sorted(v), np.int64) for k, v in rarest.items()}))
    prefix = docs.sparkSession.createDataFrame(rows, "token bigint, offset int, item_id string, win_words array<binary>")
    places = (
        docs.select("row", "doc_id", "text")
        .mapInArrow(
            lambda b: _places(b, finder.value, window),
            "row bigint, doc_id bigint, n_words bigint,"
            " places array<struct<token: bigint, pos: bigint, around_from: bigint, around: array<binary>>>",
        )
        .select("row", "doc_id", "n_words", F.explode_outer("places").alias("p"))
        .select("row", "doc_id", "n_words", "p.*")
    )
    start, size = F.col("pos") - F.col("offset"), F.size("win_words")
    inside = (start >= 0) & (start + size <= F.col("n_words"))
    same = F.slice("around", (start - F.col("around_from") + 1).cast("int"), size) == F.col("win_words")
    return (
        places.join(F.broadcast(prefix), "token", "left")
        .withColumn("hit", F.when(inside, same).otherwise(F.lit(False)))
        .select(
            "row",
            "doc_id",
            "n_words",
            F.when(F.col("hit"), F.struct(start.cast("bigint").alias("start"), size.cast("bigint").alias("size"))).alias("span"),
            F.when(F.col("hit"), F.col("item_id")).alias("item_id"),
        )
    )


def _covered(spans: Column) -> Column:
    """Words under the union of spans sorted by start."""
    step = F.reduce(
        F.array_sort(spans),
        F.struct(F.lit(0).cast("bigint").alias("to"), F.lit(0).cast("bigint").alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["to"], s["start"] + s["size"]).alias("to"),
            (acc["n"] + F.greatest(F.lit(0), s["start"] + s["size"] - F.greatest(acc["to"], s["start"]))).alias("n"),
        ),
    )
    return step["n"]


def _judged(rows: DataFrame, windows: DataFrame, n: int, window: int) -> DataFrame:
    """``rows`` (row, doc_id, text) without text, with n_words, n_hit, items and contaminated; ``windows`` in ``n`` blocks."""
    found = None
    for k in range(max(n, 1)):
        block = windows.where(F.pmod(F.xxhash64("item_id", "win_words"), F.lit(n)) == k) if n > 1 else windows
        part = contaminated_spans(rows, block, window)
        found = part if found is None else found.unionByName(part)
    return (
        found.groupBy("row", "doc_id", "n_words")
        .agg(F.collect_set("span").alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"))
        .select("row", "doc_id", "n_words", _covered(F.col("spans")).alias("n_hit"), "items")
        .withColumn("contaminated", F.col("n_hit") > 0)
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, max_shingles: int = MAX_SHINGLES
) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, n_words, n_hit, items (array of item_id), contaminated."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
    )
    windows = cut(benchmark_windows(benchmark, window, shingle))
    n = _block_windows(windows, max_shingles)
    if n > 1:  # the row numbers must stay the same over several passes
        rows = cut(rows)
    return _judged(rows, windows, n, window)


#: Contaminated texts whose hashes are sent to every task; more of them meet the documents in a shuffle.
SENT_TEXTS = 500_000


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that no benchmark window occurs in, with all their columns.

    The verdict depends on the text alone; contaminated rows are found again by two 64-bit hashes of it.
    """
    ha, hb = text_hashes(F.col(text_col))
    # Equal texts share a name and are judged as one.
    named = docs.select(hb.alias("row"), ha.alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    windows = cut(benchmark_windows(benchmark))
    judged = _judged(named, windows, _block_windows(windows, MAX_SHINGLES), WINDOW)
    hit = cut(judged.where("contaminated").select(F.col("doc_id").alias("ha"), F.col("row").alias("hb")))
    if hit.count() <= SENT_TEXTS:
        hit = F.broadcast(hit)
    return docs.select(F.struct("*").alias("doc"), ha.alias("ha"), hb.alias("hb")).join(hit, ["ha", "hb"], "left_anti").select("doc.*")
