"""Plain versions, written for clarity and not for speed, that the operators must agree with."""

import html
import math
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tabulon.llm import html_extract, jaccard_join, language_id, sharding, toxicity, wordhash


def test_ftrl_equals_a_plain_version():
    rng = random.Random(3)
    rows = [sorted(rng.sample(range(40), rng.randrange(1, 12))) for _ in range(60)]
    labels = [int(2 in r or rng.random() < 0.2) for r in rows]
    alpha, beta, l2, epochs, weight = 0.5, 1.0, 0.1, 4, 3.0
    l1 = min(10.0, max(1.0, 0.03 * weight * sum(labels)))
    z, n = defaultdict(float), defaultdict(float)

    def w(i):
        bound = 0.0 if i == "intercept" else l1
        if abs(z[i]) <= bound:
            return 0.0
        return -math.copysign(1, z[i]) * (abs(z[i]) - bound) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for label, row in zip(labels, rows, strict=True):
            active = [*row, "intercept"]
            now = {i: w(i) for i in active}
            g = (1 / (1 + math.exp(-sum(now.values()))) - label) * (weight if label else 1.0)
            for i in active:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - sigma * now[i]
                n[i] += g * g
    model = toxicity.fit(labels, [np.array(r, np.int32) for r in rows])
    got = dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True))
    plain = {i: w(i) for i in range(40) if abs(z[i]) > l1}
    assert got.keys() == plain.keys() and all(math.isclose(got[i], plain[i], rel_tol=1e-5) for i in plain)
    assert math.isclose(model.intercept, w("intercept"), rel_tol=1e-9)


def test_features_are_words_pairs_and_skip_pairs():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(60)]
    texts = [" ".join(rng.choices(vocabulary, k=n)) for n in (0, 1, 2, 3, 50, 400)]
    of, buckets = toxicity._features(wordhash.words([t.encode() for t in texts]))
    named = {}
    for k, t in enumerate(texts):
        w = t.split()
        plain = {("w", x) for x in w} | {("p", *x) for x in zip(w, w[1:], strict=False)} | {("s", *x) for x in zip(w, w[2:], strict=False)}
        found = set(buckets[of == k].tolist())
        assert len(plain) * 0.99 <= len(found) <= len(plain)  # fewer only where two fall into one bucket
        alone = set(toxicity._features(wordhash.words([t.encode()]))[1].tolist())
        assert alone == found
        named[t] = found
    model = toxicity.Model(np.array(sorted(named[texts[3]]), np.int32), np.ones(len(named[texts[3]]), np.float32), -1.0)
    assert np.allclose(model.scores([texts[3].encode()])[0], 1 / (1 + math.exp(1.0 - len(named[texts[3]]))))


def test_pooled_probabilities_equal_a_plain_forward_pass():
    net = language_id.Network(["a", "b", "c"], seed=5)
    p = {k: v.astype(float) for k, v in net.p.items()}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    h_n, size = language_id.HIDDEN, language_id.SEGMENT

    def states(way, part):
        h, out = np.zeros(h_n), []
        for byte in part:
            x = p["embed"][:, byte]
            zr = sigmoid(p[f"{way}_gates"] @ np.concatenate((x, h, [1])))
            c = np.tanh(p[f"{way}_new"] @ np.concatenate((x, zr[h_n:] * h, [1])))
            h = (1 - zr[:h_n]) * c + zr[:h_n] * h
            out.append(h)
        return out

    rng = random.Random(6)
    texts = [bytes(rng.choices(b"abc xyz 12.", k=n)) + "é漢".encode() for n in (0, 1, 60, 62, 64, 130, 200)] + [b"", b"12 34"]
    for text, got in zip(texts, net.pooled(texts), strict=True):
        total, count = np.zeros(3), 0
        for at in range(0, len(text), size):
            part = text[at : at + size]
            fore, back = states("fore", part), states("back", part[::-1])[::-1]
            for byte, f, b in zip(part, fore, back, strict=True):
                e = np.exp(p["fore_out"] @ f + p["back_out"] @ b + p["bias"][:, 0])
                if chr(byte).isascii() and not chr(byte).isalpha():
                    continue
                total, count = total + e / e.sum(), count + 1
        assert np.allclose(got, total / max(count, 1), atol=1e-5)


def test_places_equal_a_plain_order(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(300) if rng.random() < 0.9 else None, "".join(rng.choices("abc é", k=rng.randrange(40))) or None) for _ in range(500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("vslot", F.lit(1)).withColumn("shard", F.lit(1))
    got = sharding.shard_documents(df, 7, n_slots=64).collect()
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r)
    assert len(got) == len(rows) and by_shard.keys() <= set(range(7))
    for members in by_shard.values():
        plain = sorted(members, key=lambda r: (r.vslot, r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32))
        assert [r.slot for r in sorted(members, key=lambda r: r.slot)] == list(range(len(members)))
        assert [(r.doc_id, r.size, r.text_crc32) for r in sorted(members, key=lambda r: r.slot)] == [(r.doc_id, r.size, r.text_crc32) for r in plain]
    assert all(len({r.shard for r in got if r.vslot == s}) <= 1 for s in range(64))


def test_generated_pages_give_their_articles():
    rng = random.Random(10)
    stop = "the of and to in a is that for was on with as".split()
    nouns = ["house", "river", "café", "A&B", "x < y", "Straße", "letter", "winter"]

    def sentence():
        return " ".join(rng.choice(stop) if rng.random() < 0.5 else rng.choice(nouns) for _ in range(rng.randrange(12, 30))).capitalize() + "."

    for _ in range(60):
        parts, said = [], []
        for _ in range(rng.randrange(1, 7)):
            kind = rng.choice(["p", "h2", "ad", "script", "list"])
            if kind == "p":
                text = sentence()
                said.append(text)
                words = text.split(" ")
                k = rng.randrange(len(words))
                marked = " ".join(f"<b>{html.escape(w)}</b>" if i == k else html.escape(w) for i, w in enumerate(words))
                parts.append(f"<p class=x>{marked.replace(' ', rng.choice([' ', '  ', chr(10)]), 1)}</p>")
            elif kind == "h2":
                said.append("Short title")
                parts.append("<h2>Short title</h2>")
            elif kind == "ad":
                parts.append(f"<div class='ad'>{html.escape(sentence())}</div>")
            elif kind == "script":
                parts.append("<script>var a = '<p>no</p>';</script><!-- <p>no</p> -->")
            else:
                items = [sentence() for _ in range(3)]
                said += items
                parts.append("<ul>" + "".join(f"<li>{html.escape(i)}" for i in items) + "</ul>")
        page = (
            f"<html><head><title>T</title></head><body><nav><ul><li><a href=/>Home</a></ul></nav><header>Site</header><article>{''.join(parts)}</article>"
            f"<section id=comments><p>{html.escape(sentence())}</p></section><footer>{sentence()}</footer></body></html>"
        )
        assert html_extract.main_text(page) == " ".join(said)


def test_links_equal_an_exact_join_on_documents(spark):
    """Every pair of documents of sf0.001 at 0.8 or more, from plain sets, is found."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    fold = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
    sets = {}
    for r in rows:
        w = (r.text or "").encode().translate(fold).split(b" ")
        w = [x for x in w if x]
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids, links = list(sets), defaultdict(int)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y):
                links[a] += 1
                links[b] += 1
    got = jaccard_join.near_duplicates(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()
    assert {r.doc_id: r.n_links for r in got} == {i: links[i] for i in ids} and sum(links.values()) > 0
