"""Lattice scores, collocations and whitening against plain Python versions of them."""

import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestone.llm import lattice, toxicity, tries, whitening

PIECES = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, word string, row long, path string"


def texts(seed, n):
    r = random.Random(seed)
    words = ["the", "The", "of", "heat", "antion", "zu", "où", "naïve", "x\x00y", "日本語", "don't", "a|b", "　", "q" * 40]
    join = [" ", "  ", "\t", "\n", "\r\n", "\x0b", ". ", ", ", "!", " ? "]
    return ["".join(r.choice(words[: r.randint(2, len(words))]) + r.choice(join) for _ in range(r.randint(0, 60))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, la, "w", 1, "p") for i, t, la in rows], DOCS)


# ---- lattices ----


def test_all_segmentations():
    pieces, logp = lattice.vocabulary(PIECES)
    assert abs(np.exp(logp).sum() - 1) < 1e-9 and {bytes([b]) for b in range(256)} <= set(pieces)
    known = dict(zip(pieces, logp))

    def every(s):
        """Probability of a word and the sum of pieces over its segmentations, one by one."""
        if not s:
            return 1.0, Counter()
        total, counts = 0.0, Counter()
        for k in range(1, len(s) + 1):
            if s[:k] in known:
                p, c = every(s[k:])
                q = math.exp(known[s[:k]])
                total += q * p
                for x, v in c.items():
                    counts[x] += q * v
                counts[s[:k]] += q * p
        return total, counts

    words = [b"", b"the", b"heat", "où".encode(), b"x\x00y", b"antion"]
    model = lattice.Lattice(pieces, logp)
    assert np.allclose(model.log_likelihood(words), [math.log(every(b" " + w)[0]) for w in words], rtol=1e-12)
    want = Counter()
    for w in words:
        p, c = every(b" " + w)
        for x, v in c.items():
            want[x] += v / p
    assert np.allclose(model.expected(words), [want[x] for x in pieces], atol=1e-9)
    long = b"onndreat" * 3000
    assert -math.inf < model.log_likelihood([long, b"the"])[0] < 5 * model.log_likelihood([long[:4000]])[0] < 0


def plain_scores(rows, model):
    """Base and model scores, word by word."""
    tokens = [((t or "").encode().lower().split(), zlib.crc32(str(i).encode() if i is not None else b"") % 5 == 1) for i, t, _ in rows]
    train, ends = Counter(), 0
    for w, out in tokens:
        if not out:
            train.update(w)
            ends += 1
    n_words, v_words = sum(train.values()), len(train)
    n, v = n_words + ends, v_words + (ends > 0)
    seen = Counter(train.values())
    d = seen[1] / (seen[1] + 2 * seen[2]) if seen[1] and seen[2] else 0.5
    end = (ends + 0.5) / (n + 1)
    for w, out in tokens:
        base = sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in [*(train[x] for x in w), ends])
        score = math.log10(end)
        for x, spelled in zip(w, np.exp(model.log_likelihood(w)) if w else []):
            p = (max(train[x] - d, 0) + d * v_words * spelled) / n_words if n_words else spelled
            score += math.log10((1 - end) * p)
        yield out, len(w) + 1, sum(train[x] > 0 for x in w) + (ends > 0), n, base, score


@pytest.mark.parametrize("head", [0, 3, 1000])
def test_scores(spark, head):
    rows = [(i, t, "en") for i, t in enumerate(texts(1, 40))] + [(7, "The the", None), (None, "heat heat", "en"), (101, None, "en"), (102, "", "en"), (1, "antion " * 2000, "en")]
    got = lattice.score_texts(frame(spark, rows), PIECES, head_words=head).collect()
    counted = lattice.count_words(frame(spark, rows).select("doc_id", "text", lattice.held_out(F.col("doc_id")).alias("held_out")).na.fill("", ["text"]))
    model = lattice.estimate(counted, lattice.Lattice(*lattice.vocabulary(PIECES)), lattice.EM_ROUNDS)
    want = sorted(plain_scores(rows, model), key=repr)
    have = sorted([tuple(r)[1:] for r in got], key=repr)
    key = lambda x: (x[1], x[2], round(x[4], 6), round(x[5], 6))
    assert [x[:4] for x in sorted(have, key=key)] == [x[:4] for x in sorted(want, key=key)]
    assert np.allclose([x[4:] for x in sorted(have, key=key)], [x[4:] for x in sorted(want, key=key)], rtol=1e-9)


def test_scores_without_training(spark):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    got = lattice.score_texts(frame(spark, [(i, t, None) for i, t in zip(held, ["the heat", "", None])]), PIECES).orderBy("doc_id").collect()
    assert all(r["held_out"] and r["n_known"] == r["train_tokens"] == 0 and abs(r["base_score"]) < 1e-12 for r in got)
    assert got[0]["score"] < got[1]["score"] == got[2]["score"] < 0
    assert lattice.score_texts(frame(spark, []), PIECES).collect() == []


def test_estimated_weights_spell_new_words_better(spark):
    """Re-estimated weights give words of the held-out texts more than the vocabulary's own."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = lattice.count_words(docs.select("doc_id", "text", lattice.held_out(F.col("doc_id")).alias("held_out")).na.fill("", ["text"]))
    new = [bytes(r["word"]) for r in words.where("c = 0").collect()]
    start = lattice.Lattice(*lattice.vocabulary(PIECES))
    assert len(new) > 100 and lattice.estimate(words, start, 2).log_likelihood(new).mean() > start.log_likelihood(new).mean() + 1


# ---- collocations ----


def plain_collocations(rows, depth, least, share, top):
    counts, words = {}, Counter()
    for _, t, lang in rows:
        lang = "und" if lang is None else lang
        raw = (t or "").encode().lower().translate(bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"." * 10))
        for piece in raw.split(b"."):
            w = piece.replace(b"\t", b" ").split(b" ")
            w = [x for x in w if x]
            words[lang] += len(w)
            for m in range(1, depth + 1):
                for i in range(len(w) - m + 1):
                    counts[lang, tuple(w[i : i + m])] = counts.get((lang, tuple(w[i : i + m])), 0) + 1
    found = {}
    for (lang, p), a in counts.items():
        if len(p) >= 2 and a >= least:
            cuts = [(math.floor(Fraction(1000000 * a * a, counts[lang, p[:k]] * counts[lang, p[k:]])), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found[lang, p] = (a, counts[lang, p[:k]], counts[lang, p[k:]], words[lang], score)
    kept = {}
    for (lang, p), v in found.items():
        inside = [a for (la, q), (a, *_) in found.items() if la == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if not any(100 * a >= share * v[0] for a in inside):
            kept.setdefault(lang, []).append((-v[4], -v[0], b" ".join(p), v))
    return sorted((lang, k, p.decode(), *v) for lang, all_ in kept.items() for k, (_, _, p, v) in enumerate(sorted(all_)[:top], 1))


@pytest.mark.parametrize(("depth", "range_nodes"), [(3, 10**9), (3, 40), (3, 5), (2, 30), (4, 30)])
def test_collocations(spark, depth, range_nodes, monkeypatch):
    """Ranges that begin in the middle of a frequent prefix, and tries of a few words."""
    rows = [(i, t, ["en", "de", None, "und", ""][i % 5]) for i, t in enumerate(texts(2, 120))] + [(1, None, "en"), (None, "of the heat " * 500, "en"), (2, "x. " * 30, "xx")]
    if range_nodes == 40:
        monkeypatch.setattr(tries, "SLICE", 50)
    got = tries.collocations(frame(spark, rows).repartition(5), depth=depth, least=5, top=20, range_nodes=range_nodes).collect()
    cols = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(tuple(r[c] for c in cols) for r in got) == plain_collocations(rows, depth, 5, tries.SHARE, 20)
    assert tries.collocations(frame(spark, [])).collect() == []


def test_streams_go_on_from_trie_to_trie():
    words = [w for t in texts(3, 30) for part in tries.tokens_of(t.encode()) for w in part]
    whole, cut = tries.Stream(), tries.Stream()
    whole.add(words)
    some = []
    for i in range(0, len(words), 7):
        cut.add(words[i : i + 7])
        some.append(cut.trie(3, ended=False))
    some.append(cut.trie(3, ended=True))
    a, b = whole.trie(3, ended=True), tries.Trie.merged([tries.Trie.load(*t.dump(), 3) for t in some])
    assert [(a.path(i), a.counts[i]) for i in range(len(a.counts))] == [(b.path(i), b.counts[i]) for i in range(len(b.counts))]


# ---- toxicity of texts full of matches ----


def test_clauses_are_read_once():
    """Every clause of a text that is full of them is judged as if it stood alone."""
    grammar = toxicity.Grammar({"=" + w: 3.0 for w in toxicity.INSULTS})
    clauses = ["you idiot", "he said you are a moron", "you are not stupid", "I will kill you", "nothing here", "clown and idiot"]
    alone = sum(np.expm1(grammar.features(c)[: len(toxicity.MARKS)]) for c in clauses)
    for end in (". ", "\n", "; ", "| ", "!? "):
        whole = np.expm1(grammar.features(end.join(clauses * 200))[: len(toxicity.MARKS)])
        assert np.allclose(whole, 200 * alone), end


# ---- whitening ----


@pytest.mark.parametrize("d", [1, 2, 7, 40])
def test_jacobi(d):
    a = np.random.default_rng(d).standard_normal((3 * d, d))
    value, axes = whitening.jacobi(a.T @ a)
    assert np.allclose(value, np.linalg.eigvalsh(a.T @ a)[::-1], rtol=1e-12)
    assert np.allclose(axes.T @ axes, np.eye(d), atol=1e-13) and np.allclose(axes * value @ axes.T, a.T @ a, atol=1e-11 * value[0])


def test_jacobi_small_eigenvalues():
    """A graded matrix whose eigenvalues are known: the small ones stay accurate."""
    size = 10.0 ** -np.arange(0, 24, 3.0)
    mixed = np.eye(8) + 0.1 * np.random.default_rng(0).standard_normal((8, 8))
    graded = size[:, None] * (mixed @ mixed.T) * size[None, :]
    value, _ = whitening.jacobi(graded)
    inverse, _ = whitening.jacobi(np.linalg.inv(mixed @ mixed.T) / size[:, None] / size[None, :])
    assert np.allclose(value * inverse[::-1], 1.0, rtol=1e-9)


def test_whitening(spark):
    rng = np.random.default_rng(5)
    v = (rng.standard_normal((300, 5)) @ rng.standard_normal((5, 5))).tolist()
    odd = [(1000, None), (1001, []), (1002, [1.0, None, 1.0, 1.0, 1.0]), (1003, [math.nan] * 5), (1004, [math.inf] * 5)]
    rows = [(i, x) for i, x in enumerate(v)] + odd + [(None, v[0]), (7, v[7]), (2000, [1.0]), (2001, [3.0]), (2002, [1.0, 1.0])]
    got = whitening.whiten(spark.createDataFrame([(i, x, i, 0.5) for i, x in rows], "vec_id long, embedding array<double>, n long, whitened double")).collect()
    fit = [x for _, x in rows if x and len(x) == 5 and all(c is not None and math.isfinite(c) for c in x)]
    x = np.floor(64 * np.array(fit)).astype(int) + 1_000_000
    n, s = len(x), x.sum(0)
    cov = np.cov(x.T.astype(float), bias=True)
    value = np.linalg.eigvalsh(cov)[::-1]
    five = [r for r in got if r["n"] == n]
    assert len(five) == 5 * n and len(got) == 5 * n + 2 and {r["vec_id"] for r in five} == {None, *range(300)}
    assert sorted(r["deviation"] for r in five if r["component"] == 1) == sorted(((n * x - s) ** 2).sum(1).tolist())
    for k in range(1, 6):
        y = np.array([r["whitened"] for r in five if r["component"] == k])
        assert abs((y * y).mean() - 1) < 1e-9 and abs(y.mean()) < 1e-9
        e = {r["explained"] for r in five if r["component"] == k}
        assert len(e) == 1 and abs(e.pop() - value[k - 1] / value.sum()) < 1e-9
    assert all(r["identity_error"] < 1e-9 for r in got)
    lone = sorted((r["vec_id"], r["deviation"], round(abs(r["whitened"]), 9)) for r in got if r["n"] == 2)
    assert lone == [(2000, 128**2, 1.0), (2001, 128**2, 1.0)]
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_whitening_of_many_lengths_and_large_entries(spark):
    rows = [(100 * d + i, [float(i * (k + 1) % 7) for k in range(d)]) for d in range(1, 71) for i in range(2)] + [(1, [1e300]), (2, [-1e300])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["n"] for r in got} == {2, 4} and {r["vec_id"] for r in got} >= {100 * d + i for d in range(1, 71) for i in range(2)}
    assert [r["deviation"] for r in got if r["vec_id"] in (1, 2)] == [None, None]
