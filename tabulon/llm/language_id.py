"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read as UTF-8 bytes in segments of ``SEGMENT`` bytes. Two gated recurrent layers read each segment, one
from either end; at every byte both states together give a probability of each language (a label for every
position), and a document's probabilities are the mean over the bytes of its letters. The network is trained in
numpy by backpropagation through time on a bounded, balanced sample: of every language about ``DOCS_PER_LANG``
documents, each whole, chosen by a hash of id and text. Prediction covers every byte of every text.

Probabilities of languages sum to 1 for noise as well, so ``identified`` also asks how well the pairs of letters of
a text fit the learned languages, against the same letters in random order. All languages count at every pair, so a
text that mixes them fits as well as one of a single language.

Defined results: ``und`` with score 0 for a text that is null or has no letter; with nothing to learn from, every
text is ``und``. A text's score is the pooled probability of its predicted language. Only text and non-null lang of
documents that are not held out are learned from. Rows that repeat a doc_id are judged one by one; those with equal id
and text are learned from once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.batches import slices
from tabulon.llm.common import free_name, held_out

SEGMENT = 64
EMBED = 8
HIDDEN = 8
#: Bound of the training sample.
DOCS_PER_LANG = 300
#: Segments that one step of the network handles together.
LANES = 2048
UNDETERMINED = "und"

#: A text is noise if its fit lies below the mean of clean segments by this share of the way to letters in random
#: order and by this many of their standard deviations at the text's number of letters.
NOISE_SHARE = 0.75
NOISE_SIGMAS = 6.0

#: Bytes that belong to letters: A-Z, a-z and everything beyond ASCII.
_LETTER = np.array([0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A or c >= 0x80 for c in range(256)])
#: Letters as they count in pairs: small ones, and one space for all the rest.
_FOLDED = np.array([(c | 0x20 if c < 0x80 else c) if _LETTER[c] else 0x20 for c in range(256)])


def segments(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segments padded with spaces, length of each, text of each)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = -(-sizes // SEGMENT)
    padded = np.frombuffer(b"".join(t.ljust(n * SEGMENT) for t, n in zip(texts, counts.tolist(), strict=True)), np.uint8)
    of = np.repeat(np.arange(len(texts)), counts)
    lengths = np.full(len(of), SEGMENT)
    ends = np.cumsum(counts)[counts > 0]
    lengths[ends - 1] = (sizes - (counts - 1) * SEGMENT)[counts > 0]
    return padded.reshape(-1, SEGMENT), lengths, of


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _letters(part: np.ndarray, size: np.ndarray) -> np.ndarray:
    return _LETTER[part] & (np.arange(SEGMENT) < size[:, None])


def _pairs(part: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the pair (byte before, byte) at all but the first byte of each segment, and where the byte is of a letter."""
    folded = _FOLDED[part]
    return folded[:, :-1] * 256 + folded[:, 1:], _letters(part, size)[:, 1:]


def _lanes(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """At most ``LANES`` segments at a time: (text of each, segments, lengths)."""
    begin = 0
    while begin < len(texts):
        end, lanes = begin, 0
        while end < len(texts) and (end == begin or lanes < LANES):
            lanes += -(-len(texts[end]) // SEGMENT)
            end += 1
        data, lengths, of = segments(texts[begin:end])
        for a in range(0, len(data), LANES):
            yield of[a : a + LANES] + begin, data[a : a + LANES], lengths[a : a + LANES]
        begin = end


class Network:
    """Parameters: byte vectors, gate and candidate weights of both directions, output weights."""

    def __init__(self, langs: list[str], seed: int = 7) -> None:
        self.langs = langs
        self.fit: np.ndarray | None = None  # log probability of each pair of letters; with it, what clean text has
        self.clean = self.shuffled = self.spread = 0.0
        rng = np.random.default_rng(seed)
        rows = EMBED + HIDDEN + 1  # what a cell sees: byte vector, state, and a constant for the bias
        self.p: dict[str, np.ndarray] = {"embed": rng.normal(0, 0.5, (EMBED, 256))}
        for way in ("fore", "back"):
            self.p[f"{way}_gates"] = rng.normal(0, 0.3, (2 * HIDDEN, rows))
            self.p[f"{way}_new"] = rng.normal(0, 0.3, (HIDDEN, rows))
            self.p[f"{way}_out"] = rng.normal(0, 0.3, (len(langs), HIDDEN))
        self.p["bias"] = np.zeros((len(langs), 1))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    # -- training ---------------------------------------------------------------------------------------------

    def _run(self, way: str, steps: np.ndarray, mask: np.ndarray) -> list[tuple]:
        gates, new = self.p[f"{way}_gates"], self.p[f"{way}_new"]
        n = steps.shape[1]
        h, ones, kept = np.zeros((HIDDEN, n), np.float32), np.ones((1, n), np.float32), []
        for t in range(len(steps)):
            x = self.p["embed"][:, steps[t]]
            seen = np.concatenate((x, h, ones))
            zr = _sigmoid(gates @ seen)
            z, r = zr[:HIDDEN], zr[HIDDEN:]
            seen_new = np.concatenate((x, r * h, ones))
            c = np.tanh(new @ seen_new)
            out = (c + z * (h - c)) * mask[t]
            kept.append((seen, seen_new, z, r, c, h, out))
            h = out
        return kept

    def _gradients(self, batch: np.ndarray, lengths: np.ndarray, target: np.ndarray) -> tuple[dict, float]:
        steps = batch.T
        mask = (np.arange(SEGMENT)[:, None] < lengths).astype(np.float32)
        weight = mask * _LETTER[steps]
        weight /= max(1.0, weight.sum())
        fore, back = self._run("fore", steps, mask), self._run("back", steps[::-1], mask[::-1])
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        loss, n = 0.0, batch.shape[0]
        d_fore, d_back = [None] * SEGMENT, [None] * SEGMENT
        for t in range(SEGMENT):
            hf, hb = fore[t][6], back[SEGMENT - 1 - t][6]
            logits = self.p["fore_out"] @ hf + self.p["back_out"] @ hb + self.p["bias"]
            logits -= logits.max(0)
            e = np.exp(logits)
            prob = e / e.sum(0)
            loss -= float((weight[t] * np.log(prob[target, np.arange(n)] + 1e-9)).sum())
            prob[target, np.arange(n)] -= 1
            d = prob * weight[t]
            g["fore_out"] += d @ hf.T
            g["back_out"] += d @ hb.T
            g["bias"] += d.sum(1, keepdims=True)
            d_fore[t], d_back[SEGMENT - 1 - t] = self.p["fore_out"].T @ d, self.p["back_out"].T @ d
        for way, kept, dout, order, m in (("fore", fore, d_fore, steps, mask), ("back", back, d_back, steps[::-1], mask[::-1])):
            gates, new, dh = self.p[f"{way}_gates"], self.p[f"{way}_new"], np.zeros((HIDDEN, n), np.float32)
            dx_all = np.empty((SEGMENT, EMBED, n), np.float32)
            for t in range(SEGMENT - 1, -1, -1):
                seen, seen_new, z, r, c, h, _ = kept[t]
                dh = (dh + dout[t]) * m[t]
                da = dh * (1 - z) * (1 - c * c)
                g[f"{way}_new"] += da @ seen_new.T
                ds = new.T @ da
                dx, drh = ds[:EMBED], ds[EMBED : EMBED + HIDDEN]
                dzr = np.concatenate((dh * (h - c) * z * (1 - z), drh * h * r * (1 - r)))
                g[f"{way}_gates"] += dzr @ seen.T
                ds = gates.T @ dzr
                dx_all[t] = dx + ds[:EMBED]
                dh = dh * z + drh * r + ds[EMBED : EMBED + HIDDEN]
            at = order.ravel()
            for k in range(EMBED):
                g["embed"][k] += np.bincount(at, dx_all[:, k].ravel(), 256).astype(np.float32)
        return g, loss

    def train(
        self, data: np.ndarray, lengths: np.ndarray, target: np.ndarray, docs: np.ndarray, updates: int = 240, batch: int = 256, rate: float = 0.02
    ) -> list[float]:
        """Adam; every batch is drawn anew: a language, a document of it, a segment of that. Returns the loss of each update.

        The segments of a document lie one after the other; ``docs`` says which document each is of.
        """
        rng = np.random.default_rng(11)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        first = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
        size = np.diff(np.append(first, len(docs)))
        by_lang = [np.flatnonzero(target[first] == k) for k in range(len(self.langs))]
        losses = []
        for step in range(1, updates + 1):
            langs = rng.integers(0, len(self.langs), batch)
            chosen = np.array([by_lang[k][rng.integers(len(by_lang[k]))] for k in langs])
            rows = first[chosen] + rng.integers(0, size[chosen])
            g, loss = self._gradients(data[rows], lengths[rows], target[rows])
            losses.append(loss)
            norm = float(np.sqrt(sum(float((x * x).sum()) for x in g.values())))
            scale, now = min(1.0, 1.0 / (norm + 1e-9)), rate * (1 - 0.9 * step / updates)
            for k, x in g.items():
                x *= scale
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return losses

    # -- prediction -------------------------------------------------------------------------------------------

    def _logits(self, way: str, steps: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """Output of one direction at every step; sigmoids are tanh, with their halves folded into the weights."""
        gates, new, out = self.p[f"{way}_gates"] * np.float32(0.5), self.p[f"{way}_new"], self.p[f"{way}_out"]
        n = steps.shape[1]
        seen = np.zeros((EMBED + HIDDEN + 1, n), np.float32)
        seen[-1] = 1
        state, h = seen[EMBED : EMBED + HIDDEN], np.zeros((HIDDEN, n), np.float32)
        zr, c = np.empty((2 * HIDDEN, n), np.float32), np.empty((HIDDEN, n), np.float32)
        z, r = zr[:HIDDEN], zr[HIDDEN:]
        result = np.empty((len(steps), len(self.langs), n), np.float32)
        half = np.float32(0.5)
        for t in range(len(steps)):
            np.take(self.p["embed"], steps[t], axis=1, out=seen[:EMBED], mode="clip")
            state[:] = h
            np.matmul(gates, seen, out=zr)
            np.tanh(zr, out=zr)
            zr *= half
            zr += half
            state *= r
            np.matmul(new, seen, out=c)
            np.tanh(c, out=c)
            h -= c
            h *= z
            h += c
            if mask is not None:
                h *= mask[t]
            np.matmul(out, h, out=result[t])
        return result

    def position_probabilities(self, batch: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(position, language, segment): the probabilities at every byte."""
        steps = np.ascontiguousarray(batch.T)
        mask = (np.arange(SEGMENT)[:, None] < lengths).astype(np.float32)
        short = bool((lengths < SEGMENT).any())
        logits = self._logits("fore", steps, None)
        logits += self._logits("back", steps[::-1], mask[::-1] if short else None)[::-1]
        logits += self.p["bias"]
        np.exp(np.minimum(logits, np.float32(80), out=logits), out=logits)
        logits /= logits.sum(1, keepdims=True)
        return logits

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """(text, language): mean probability over the bytes of letters; zeros for a text without letters."""
        total, count = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        for at, part, size in _lanes(texts):
            weight = _letters(part, size).astype(np.float32)
            if self.langs:
                sums = np.einsum("tln,nt->nl", self.position_probabilities(part, size), weight)
                for k in range(len(self.langs)):
                    total[:, k] += np.bincount(at, sums[:, k], len(texts))
            count += np.bincount(at, weight.sum(1), len(texts))
        return total / np.maximum(count, 1)[:, None]

    # -- noise ------------------------------------------------------------------------------------------------

    def learn_pairs(self, data: np.ndarray, lengths: np.ndarray, target: np.ndarray) -> None:
        """Pairs of letters of each language, and the fit of clean segments and of their letters in random order."""
        pairs, at = _pairs(data, lengths)
        mixed, lone = np.zeros((256, 256)), []
        for k in range(len(self.langs)):
            seen = np.bincount(pairs[target == k][at[target == k]], minlength=1 << 16).reshape(256, 256)
            single = (seen.sum(0) + 0.5) / (seen.sum() + 128)
            mixed += (seen + 2 * single) / (seen.sum(1, keepdims=True) + 2)
            lone.append((seen.sum(1) / max(1, seen.sum()), seen.sum(0) / max(1, seen.sum())))
        self.fit = np.log(mixed / len(self.langs)).astype(np.float32).ravel()
        n = at.sum(1)
        mean = (self.fit[pairs] * at).sum(1) / np.maximum(n, 1)
        of = [(target == k) & (n > 0) for k in range(len(self.langs))]
        means = [float(np.average(mean[m], weights=n[m])) for m in of if m.any()]
        if not means:
            self.fit = None
            return
        self.clean = min(means)
        table = self.fit.reshape(256, 256).astype(float)
        self.shuffled = float(np.mean([before @ table @ after for before, after in lone if after.any()]))
        self.spread = float(np.sqrt(np.average((mean - self.clean) ** 2 * n, weights=n > 0)))

    def noise(self, texts: list[bytes]) -> np.ndarray:
        """Whether the letters of each text fit none of the languages."""
        if self.fit is None:
            return np.zeros(len(texts), bool)
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for at, part, size in _lanes(texts):
            pairs, letters = _pairs(part, size)
            total += np.bincount(at, (self.fit[pairs] * letters).sum(1), len(texts))
            count += np.bincount(at, letters.sum(1), len(texts))
        n = np.maximum(count, 1)
        bound = np.minimum(self.clean - NOISE_SHARE * (self.clean - self.shuffled), self.clean - NOISE_SIGMAS * self.spread / np.sqrt(n))
        return (count > 0) & (total / n < bound)

    def judge(self, texts: list[bytes], lettered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the best language of each text (one past the last: undetermined) and its pooled probability."""
        none = len(self.langs)
        if not none or not texts:
            return np.full(len(texts), none), np.zeros(len(texts))
        pooled = self.pooled(texts)
        score = np.minimum(pooled.max(1), 1.0)
        best = np.where(lettered & (score > 0), pooled.argmax(1), none)
        return best, np.where(best < none, score, 0.0)


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The segments of each text that have a letter, one after the other, and the length of each."""
    for batch in slices(batches):
        out: dict[str, list] = {"lang": [], "place": [], "data": [], "sizes": []}
        for lang, place, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data, lengths, _ = segments([text])
            some = _letters(data, lengths).any(1)
            if some.any():
                for k, v in (("lang", lang), ("place", place), ("data", data[some].tobytes()), ("sizes", lengths[some].astype(np.uint8).tobytes())):
                    out[k].append(v)
        yield pa.RecordBatch.from_pydict(
            out, pa.schema([("lang", pa.string()), ("place", pa.int64()), ("data", pa.binary()), ("sizes", pa.binary())])
        )


def train(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> Network:
    rows = docs.select(
        F.col("lang").cast("string").alias("lang"),
        F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).alias("place"),
        F.col("text").cast("binary").alias("text"),
        held_out(F.col("doc_id")).alias("held"),
    ).where("NOT held AND lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    # One row per language: the network has weights for each of them, so their number bounds what is sent.
    share = F.lit(docs_per_lang).cast("double") / F.col("n")
    quota = rows.groupBy("lang").agg(F.count("*").alias("n")).select("lang", F.when(share >= 1, F.lit(2**63 - 1)).otherwise((share * 2.0**64 - 2.0**63).cast("bigint")).alias("last"))
    sample = (
        rows.join(F.broadcast(quota), "lang")
        .where("place <= last")
        .select("lang", "place", "text")
        .dropDuplicates(["lang", "place"])
        .mapInArrow(_sample, "lang string, place bigint, data binary, sizes binary")
        .toArrow()  # about ``docs_per_lang`` rows of each language
        .sort_by([("lang", "ascending"), ("place", "ascending")])
    )
    names, sizes = sample.column("lang").to_pylist(), sample.column("sizes").to_pylist()
    langs = sorted(set(names))
    network = Network(langs)
    if langs:
        number = {k: i for i, k in enumerate(langs)}
        data = np.frombuffer(b"".join(sample.column("data").to_pylist()), np.uint8).reshape(-1, SEGMENT)
        lengths = np.frombuffer(b"".join(sizes), np.uint8).astype(np.int64)
        documents = np.repeat(np.arange(len(sizes)), [len(x) for x in sizes])
        target = np.array([number[k] for k in names])[documents]
        network.train(data, lengths, target, documents)
        network.learn_pairs(data, lengths, target)
    return network


def predict(docs: DataFrame, network: Network) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            langs = np.array([*shared.value.langs, UNDETERMINED], object)
            best, score = shared.value.judge(
                [t or b"" for t in batch.column(2).to_pylist()], batch.column(3).to_numpy(zero_copy_only=False)
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(langs[best], pa.string()), pa.array(score)],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("text").cast("binary").alias("text"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"),
    ).mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, network: Network | None = None) -> DataFrame:
    """The rows of ``docs`` whose language can be told, with all their columns; nothing is shuffled.

    Texts without letters and texts whose letters fit none of the languages (``Network.noise``) are rejected. Texts of
    several languages stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network or train(docs))
    names, text = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            known = shared.value.langs
            texts = [t or b"" for t in batch.column(text).cast(pa.binary()).to_pylist()]
            lettered = batch.column(len(names)).to_numpy(zero_copy_only=False)
            stays = pa.array((shared.value.judge(texts, lettered)[0] < len(known)) & ~shared.value.noise(texts))
            yield batch.select(list(range(len(names)))).filter(stays)

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias(free_name(docs, "lettered"))
    return docs.select("*", lettered).mapInArrow(run, docs.schema)


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, train(docs))
