"""Line deduplication by a deletion-neighbourhood join.

Lines are compared without the blanks around them. A line is dropped when an earlier line, in the order of document
id and line number, equals it, or is within one edit of it (one character inserted, deleted or replaced). The earliest
stays. Lines without text are never dropped and take no part.

1. One pass over the texts names every line by two 64-bit hashes and writes names, places and the keys of step 2 as a
   table; equal lines meet by name, after a partial minimum in each task.
2. A lossless screen: of two lines within one edit, the shorter of length m, one half (the first m // 2 characters or
   the last m - m // 2) is the same. Each line has the keys of its halves for m and m - 1; only lines that share a key
   with a different line go on, and a second pass over the texts fetches them.
3. Those emit every variant with one character deleted, as a hashed key with the place of the deletion, and
   themselves. Lines with an equal variant *and* place differ in that one character; a line that equals a variant of
   another differs by that deletion. So the earliest of each such group settles all of its members, and no group is
   ever expanded into pairs. A group has at most (m + 1) x alphabet different lines.
4. The edit distance of each dropped line and the line it yields to is verified on their texts.

Hashes of variants are differences of prefix sums of a polynomial, so a line costs time in proportion to its length.

Defined results: a null or empty text has one empty line; a null doc_id comes after all others. Every row is a document
of its own: rows that repeat a doc_id, or have none, stand in the order of a hash of their texts, and those with equal
texts in the order in which they were read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm import wordhash
from tabulon.llm.batches import slices
from tabulon.llm.common import cut, id_parts, text_hashes, written

#: Names of lines that are sent to every task; more of them meet the lines in a shuffle.
SENT_NAMES = 1_000_000
#: Fixed value: the blanks around a line that do not count.
BLANKS = " \t\r\x0b\x0c"

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_SALTS = tuple(np.uint64(x) for x in (0x94D049BB133111EB, 0xBF58476D1CE4E5B9))
_CHUNK = 1 << 16


_tables: dict[tuple[str, int], np.ndarray] = {}


def _powers_for(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, kept for the next block."""
    if ("up", which) not in _tables or len(_tables["up", which]) < n:
        size = max(n, wordhash.BLOCK_BYTES + 1024)
        _tables["up", which] = wordhash._powers(_BASES[which], size)
        _tables["down", which] = wordhash._powers(pow(_BASES[which], -1, 1 << 64), size)
    return _tables["up", which], _tables["down", which]


def _values(codes: np.ndarray, which: int) -> np.ndarray:
    """A random number for each character; those of the first plane are looked up."""
    if ("value", which) not in _tables:
        _tables["value", which] = wordhash.mix(np.arange(0x10000, dtype=np.uint64) + _SALTS[which])
    if len(codes) and codes.max() >= 0x10000:
        return wordhash.mix(codes.astype(np.uint64) + _SALTS[which])
    return _tables["value", which][codes]


class _Sums:
    """Prefix sums of a polynomial over the characters of many lines in one row, and powers to compare places."""

    def __init__(self, codes: np.ndarray, which: int) -> None:
        n = len(codes) + 1
        self.up, self.down = _powers_for(which, n + 1)
        self.at = np.zeros(n, np.uint64)
        np.cumsum(_values(codes, which) * self.up[: n - 1], out=self.at[1:])

    def raw(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Polynomial of characters [a, b), as if it began at place 0."""
        return (self.at[b] - self.at[a]) * self.down[a]

    def without(self, a: np.ndarray, p: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Polynomial of [a, b) with the character at p deleted."""
        return self.raw(a, p) + self.raw(p + 1, b) * self.up[p - a]


def _finish(raw: np.ndarray, length: np.ndarray) -> np.ndarray:
    return wordhash.mix(raw + length.astype(np.uint64)).view(np.int64)


def _split(texts: list[str | None]) -> tuple[list[str], list[int]]:
    lines, counts = [], []
    for text in texts:
        found = [line.strip(BLANKS) for line in (text or "").split("\n")]
        lines += found
        counts.append(len(found))
    return lines, counts


def _laid_out(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Character codes of all lines, and where each begins and ends."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)))
    return codes, np.concatenate(([0], ends[:-1])) if len(lines) else ends, ends


def _names(codes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, _Sums]:
    sums = _Sums(codes, 0)
    return _finish(sums.raw(begins, ends), ends - begins), _finish(_Sums(codes, 1).raw(begins, ends), ends - begins), sums


def _halves(sums: _Sums, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(line, 4): keys of the halves for m = length and m = length - 1."""
    n, out = ends - begins, []
    for m in (n, n - 1):
        m = np.maximum(m, 0)
        half = m // 2
        for side, a, b in ((1, begins, begins + half), (2, ends - (m - half), ends)):
            out.append(wordhash.mix(sums.raw(a, b) + (m * 4 + side).astype(np.uint64) * np.uint64(_BASES[1])).view(np.int64))
    return np.stack(out, 1)


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > wordhash.BLOCK_BYTES:
            yield begin, i
            begin, size = i, 0
        size += len(t or "") + 1
    if begin < len(texts):
        yield begin, len(texts)


#: The place of a line: these columns, in this order, are the order of lines.
_PLACE = ("no_id", "id", "text_hash", "row", "line_no")
_PLACE_TYPES = "no_id boolean, id bigint, text_hash bigint, row bigint, line_no int"
_LINE = f"{_PLACE_TYPES}, name bigint, other bigint, n_chars int, halves array<bigint>"


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place, names and length of every line, and the keys of its halves at its first place in a block of texts."""
    for batch in slices(batches):
        texts = batch.column(4).to_pylist()
        for begin, end in _blocks(texts):
            lines, counts = _split(texts[begin:end])
            codes, begins, ends = _laid_out(lines)
            name, other, sums = _names(codes, begins, ends)
            size = ends - begins
            at = np.unique(name, return_index=True)[1]
            at = np.sort(at[size[at] > 0])
            new = np.zeros(len(lines), np.int32)
            new[at] = 4
            n = np.array(counts)
            numbers = np.arange(len(lines)) - np.repeat(np.cumsum(n) - n, n)
            of = pa.array(np.repeat(np.arange(begin, end), n))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k).take(of) for k in range(4)),
                    pa.array(numbers.astype(np.int32)),
                    pa.array(name),
                    pa.array(other),
                    pa.array(size.astype(np.int32)),
                    pa.ListArray.from_arrays(np.append(0, np.cumsum(new)).astype(np.int32), pa.array(_halves(sums, begins[at], ends[at]).ravel())),
                ],
                [*_PLACE, "name", "other", "n_chars", "halves"],
            )


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names and text of the lines; each once per block."""
    for batch in slices(batches):
        texts = batch.column(0).to_pylist()
        for begin, end in _blocks(texts):
            lines, _ = _split(texts[begin:end])
            lines = list(dict.fromkeys(lines))
            codes, begins, ends = _laid_out(lines)
            name, other, _sums = _names(codes, begins, ends)
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(other), pa.array(lines, pa.string())], ["name", "other", "line"])


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Variant, deleted place and place of each line with one character deleted, and of the line itself (-1)."""
    for batch in slices(batches):
        lines = batch.column(0).to_pylist()
        for first, last in _blocks(lines):
            codes, begins, ends = _laid_out(lines[first:last])
            sums = (_Sums(codes, 0), _Sums(codes, 1))
            of_all = np.repeat(np.arange(last - first, dtype=np.int32), ends - begins)
            for a in (-1, *range(0, len(codes), _CHUNK)):
                if a < 0:  # the lines themselves
                    of, where = np.arange(last - first), np.full(last - first, -1, np.int32)
                    key = [_finish(s.raw(begins, ends), ends - begins) for s in sums]
                else:
                    p = np.arange(a, min(len(codes), a + _CHUNK))
                    of = of_all[p]
                    z, e = begins[of], ends[of]
                    key = [_finish(s.without(z, p, e), e - z - 1) for s in sums]
                    where = (p - z).astype(np.int32)
                at = pa.array(of + first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[0]), pa.array(key[1]), pa.array(where), *(batch.column(k).take(at) for k in range(1, 6))],
                    ["variant", "variant_b", "place", *_PLACE],
                )


def near_lines(texts: DataFrame, lines: DataFrame, names: DataFrame) -> DataFrame:
    """(name, other, earlier): lines that yield to an earlier line within one edit, and its place; verified.

    ``texts`` has text, ``lines`` the columns of ``_LINE``, and ``names`` name, other and the first place (``first``) of
    each distinct line.
    """
    keys = lines.where(F.size("halves") > 0).select(F.explode("halves").alias("key"), "name")
    shared = keys.groupBy("key").agg(F.min("name").alias("a"), F.max("name").alias("b")).where("a <> b").select("key")
    chosen = cut(keys.join(shared, "key", "left_semi").select("name").distinct())
    if chosen.count() <= SENT_NAMES:
        chosen = F.broadcast(chosen)
    said = texts.select("text").mapInArrow(_texts, "name bigint, other bigint, line string")
    long = cut(
        said.join(chosen, "name", "left_semi").dropDuplicates(["name", "other"]).join(names, ["name", "other"])
    )
    variants = long.select("line", "first.*").mapInArrow(_variants, f"variant bigint, variant_b bigint, place int, {_PLACE_TYPES}")
    itself = F.col("place") == -1
    group = Window.partitionBy("variant", "variant_b")
    same_place = Window.partitionBy("variant", "variant_b", "place")
    found = (
        variants.withColumn("who", F.struct(*_PLACE))
        .withColumn("whole", F.min(F.when(itself, F.col("who"))).over(group))
        .withColumn("shorter", F.min(F.when(~itself, F.col("who"))).over(group))
        .withColumn("replaced", F.min("who").over(same_place))
        .withColumn("to", F.when(itself, F.col("shorter")).otherwise(F.least("whole", "replaced")))
        .where(F.col("to") < F.col("who"))
        .groupBy("row", "line_no")
        .agg(F.min("to").alias("to"))
        .select("row", "line_no", "to", F.col("to.row").alias("to_row"), F.col("to.line_no").alias("to_no"))
    )
    placed = long.select(F.col("first.row").alias("row"), F.col("first.line_no").alias("line_no"), "name", "other", "line")
    other = placed.select(F.col("row").alias("to_row"), F.col("line_no").alias("to_no"), F.col("line").alias("to_line"))
    return (
        found.join(placed, ["row", "line_no"])
        .join(other, ["to_row", "to_no"])
        # A hit of levenshtein needs both texts; its third argument ends the work at the bound.
        .where(F.levenshtein("line", "to_line", 1) == 1)
        .select("name", "other", F.col("to").alias("earlier"))
    )


def _numbered(docs: DataFrame, row: Column, id_col: str, text_col: str) -> DataFrame:
    no_id, whole = id_parts(F.col(id_col))
    text = F.col(text_col).cast("string")
    return docs.select(no_id.alias("no_id"), whole.alias("id"), text_hashes(text)[0].alias("text_hash"), row.alias("row"), text.alias("text"))


def _verdicts(texts: DataFrame) -> DataFrame:
    """One row per line of ``_numbered`` texts: doc_id, row, line_no, n_chars, name, other, kept, reason, yields_to."""
    lines = written(texts.mapInArrow(_lines, _LINE))
    place = F.struct(*_PLACE)
    names = lines.where("n_chars > 0").groupBy("name", "other").agg(F.min(place).alias("first"))
    near = near_lines(texts, lines, names)
    settled = cut(names.join(near, ["name", "other"], "left"))
    judged = lines.drop("halves").join(settled, ["name", "other"], "left").withColumn(
        "reason",
        F.when(F.col("n_chars") == 0, "").when(place > F.col("first"), "equal").when(F.col("earlier").isNotNull(), "near").otherwise(""),
    )
    to = F.when(F.col("reason") == "equal", F.col("first")).when(F.col("reason") == "near", F.col("earlier"))
    return judged.select(
        F.when(~F.col("no_id"), F.col("id")).alias("doc_id"),
        "row",
        "line_no",
        "n_chars",
        "name",
        "other",
        (F.col("reason") == "").alias("kept"),
        "reason",
        F.when(~to["no_id"], to["id"]).alias("yields_to"),
    )


def line_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line: doc_id, row (a number of the document), line_no, n_chars, name, other, kept, reason ('', 'equal'
    or 'near'), yields_to (a doc_id)."""
    return _verdicts(_numbered(docs, F.monotonically_increasing_id(), id_col, text_col))


def document_digests(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts, the numbers of its dropped lines, the documents they yield to, and a digest
    of the names of the lines that stay, in order."""
    v = line_verdicts(docs)
    per = v.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.count("*").alias("n_lines"),
        F.count_if("kept").alias("n_kept"),
        F.count_if(F.col("reason") == "equal").alias("n_equal"),
        F.count_if(F.col("reason") == "near").alias("n_near"),
        F.sum(F.when(F.col("kept"), F.col("n_chars")).otherwise(0)).alias("kept_chars"),
        F.array_sort(F.collect_list(F.when(~F.col("kept"), F.col("line_no")))).alias("dropped_lines"),
        F.array_sort(F.collect_set(F.when(~F.col("kept"), F.col("yields_to")))).alias("yields_to"),
        F.array_sort(F.collect_list(F.when(F.col("kept"), F.struct("line_no", "name", "other")))).alias("stay"),
    )
    named = F.array_join(F.transform("stay", lambda s: F.concat_ws(":", s["name"].cast("string"), s["other"].cast("string"))), ",")
    return per.withColumn("kept_sha256", F.sha2(named.cast("binary"), 256)).drop("stay", "row")


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the dropped lines taken out of each text; a document may be left with an empty text.

    The rows are numbered in a copy in the shared folder, since a number must mean the same row twice.
    """
    copy = cut(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")))
    dropped = (
        _verdicts(_numbered(copy, F.col("row"), f"doc.{id_col}", f"doc.{text_col}"))
        .where("NOT kept")
        .groupBy("row")
        .agg(F.collect_set("line_no").alias("out"))
    )
    text = F.col(f"doc.{text_col}")
    stays = F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains("out", i)), "\n")
    cleaned = F.when(F.col("out").isNull(), F.col("doc")).otherwise(F.col("doc").withField(text_col, stays))
    return copy.join(dropped, "row", "left").select(cleaned.alias("doc")).select("doc.*")
