"""The text operators against brute force, and their odd cases."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from lodestone.llm import licenses, mixing, ngram_join, packing, quality, substrings, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, key string, g long"


def docs_of(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["a"] * len(texts))[i], None if t is None else len(t), "x", "y", 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def passages(seed, n, words=40):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(2, 6))) for _ in range(60)]
    base = [" ".join(r.choice(vocabulary) for _ in range(words)) for _ in range(6)]
    out = []
    for _ in range(n):
        kind = r.random()
        text = r.choice(base).split()
        if kind < 0.3:
            for _ in range(r.randint(0, 3)):
                text[r.randrange(len(text))] = r.choice(vocabulary)
        elif kind < 0.6:
            text = [r.choice(vocabulary) for _ in range(r.randint(0, 30))] + text[: r.randint(3, 30)] + [r.choice(vocabulary)]
        elif kind < 0.8:
            text = [r.choice(vocabulary) for _ in range(r.randint(0, 50))]
        out.append(" ".join(text))
    return [*out, "", None, "A", "a", "one two", "One TWO", "aaaa" * 30, "aaaa" * 30, base[0].upper()]


def brute_removal(texts, window):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + window] for b in raw for i in range(len(b) - window + 1))
    out = []
    for b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = len(re.findall("1+", "".join("01"[g] for g in gone)))
        out.append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [2000, 1])
def test_substrings_equal_brute_force(spark, hot):
    texts = passages(1, 120)
    got = {r["doc_id"]: tuple(r)[1:] for r in substrings.remove_repeats(docs_of(spark, texts), window=30, trigger=6, hot_class=hot).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removal(texts, 30)


@pytest.mark.parametrize("hot", [2000, 2])
def test_long_substrings_of_long_texts(spark, hot):
    """Windows of 200 bytes; texts beyond the seam of two pieces; one passage in many surroundings."""
    r = random.Random(4)
    noise = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = noise(420)
    long_ = noise((1 << 18) - 150)
    texts = [long_ + passage + noise(90_000), noise(500) + long_[-300:] + passage[:260], "ab" * 1000, long_[:199], "x" * 199, None]
    texts += [noise(r.randint(0, 300)) + passage[r.randint(0, 60) :] + noise(r.randint(0, 300)) for _ in range(40)]
    got = {x["doc_id"]: tuple(x)[1:] for x in substrings.remove_repeats(docs_of(spark, texts), hot_class=hot).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removal(texts, 200)


def test_substrings_of_odd_rows_and_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(None, text + " end", 1), (4, text, 2), (4, text, 2), (5, "alone", 3), (None, None, 4), (6, "", 5)]
    df = spark.createDataFrame([(i, t, n, "z", b"k", None) for i, t, n in rows], "doc_id long, text string, n_bytes int, row string, z binary, key string")
    out = substrings.without_repeats(df)
    got = sorted(((x["doc_id"] or -1), x["text"], x["n_bytes"]) for x in out.collect())
    assert out.columns == df.columns and got == [(-1, "", 4), (-1, " end", 1), (5, "alone", 3), (6, "", 5)]


def test_substrings_over_many_batches(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BATCH_TEXTS", 7)
    texts = passages(2, 150)
    got = {r["doc_id"]: tuple(r)[1:] for r in substrings.remove_repeats(docs_of(spark, texts).repartition(5), window=25, trigger=8).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removal(texts, 25)


def brute_components(texts):
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in texts]
    words = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in low]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for w in words]
    at = list(range(len(texts)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                at[max(a, b)] = min(a, b)
    return [(len(s), root(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("batch", [3000, 9])
def test_ngram_join_equals_brute_force(spark, monkeypatch, batch):
    monkeypatch.setattr(ngram_join, "BATCH_TEXTS", batch)
    r = random.Random(5)
    texts = passages(3, 80, words=60)
    hub = [f"w{i}" for i in range(120)]
    for _ in range(40):  # many near copies of one text, most of which link with it only
        copy = list(hub)
        for _ in range(r.randint(1, 3)):
            copy[r.randrange(len(copy))] = f"x{r.random()}"
        texts.append(" ".join(copy))
    texts.append(" ".join(hub))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.components(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)


def test_shingles_of_words_that_polynomials_confuse(spark):
    word = "a"
    for _ in range(10):  # sums of any odd base modulo 2^64 agree on this word and its complement
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.components(docs_of(spark, [word, other, f"a b {word} c d", f"a b {other} c d"])).collect()}
    assert got == {i: i for i in range(4)}


def test_ngram_join_of_odd_rows(spark):
    long_ = " ".join(f"w{i}" for i in range(30_000))
    rows = [(None, long_), (7, long_), (7, long_), (3, "  "), (4, None), (9, long_ + " more"), (5, "  ")]
    df = spark.createDataFrame([(i, t, 1, b"", 2) for i, t in rows], "doc_id long, text string, n int, digest binary, class_id int")
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in ngram_join.components(df).collect())
    assert got == [(-1, 29_996, None), (3, 0, 3), (4, 0, 4), (5, 0, 5), (7, 29_996, 7), (7, 29_996, 7), (9, 29_997, 7)]
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 3, 4, 5, 7]


def test_mixing_meets_targets(spark):
    r = random.Random(2)
    texts = [" ".join(["w"] * r.choice([0, 1, 5, 80, 400])) for _ in range(300)] + [None]
    sources = [r.choice(["b", "b", "b", "a", None, "é"]) for _ in texts]
    docs = docs_of(spark, texts, sources)
    rows = mixing.mix_sources(docs, shard_words=900).collect()
    again = mixing.mix_sources(docs.repartition(3), shard_words=900).collect()
    assert sorted((x["doc_id"], x["taken"]) for x in rows) == sorted((x["doc_id"], x["taken"]) for x in again)
    assert len(rows) == len(texts)
    taken, target, size = Counter(), {}, Counter()
    for x in rows:
        assert 0 <= x["taken"] <= 2 * x["size"]
        taken[x["source"]] += x["taken"]
        size[x["source"]] += x["size"]
        target[x["source"]] = x["target"]
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6 * sum(size.values()) + 1e-9
    for s, t in target.items():
        assert abs(taken[s] - t) <= 0.01 * t + mixing.BLOCK_WORDS * 12


def highest_quotients(votes, seats):
    import heapq
    from fractions import Fraction

    got = [0] * len(votes)
    heap = [(-Fraction(v), i) for i, v in enumerate(votes) if v]
    heapq.heapify(heap)
    for _ in range(seats if heap else 0):
        _, i = heapq.heappop(heap)
        got[i] += 1
        heapq.heappush(heap, (-Fraction(votes[i], 2 * got[i] + 1), i))
    return got


def test_mix_equals_plain_version(spark, monkeypatch):
    """From the shards and seeded ranks on: every quota and share, seat by seat."""
    monkeypatch.setattr(mixing, "TEAM_SHARDS", 3)
    r = random.Random(6)
    texts = [" ".join(["w"] * r.choice([0, 1, 3, 40, 300])) for _ in range(250)] + [None, None]
    sources = [r.choice(["b", "b", "b", "a", None, "é"]) for _ in texts]
    rows = mixing.mix_sources(docs_of(spark, texts, sources), shard_words=700).collect()
    order = sorted(set(sources), key=lambda x: (x is None, (x or "").encode()))
    size = [sum(len((t or "").split()) for t, s in zip(texts, sources) if s == o) for o in order]
    target = mixing.water_fill(size, [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5, 2.0)
    block = max(1, min(16, int(sum(target) // (1000 * len(order)))))
    seats = dict(zip(order, highest_quotients([int(t * 1000) for t in target], round(sum(target) / block))))
    shards = defaultdict(list)
    for x in rows:
        assert (x["size"], x["source"], x["source_size"]) == (len((texts[x["doc_id"]] or "").split()), sources[x["doc_id"]], size[order.index(x["source"])])
        assert abs(x["target"] - target[order.index(x["source"])]) < 1e-6
        shards[x["source"], x["shard"]].append(x)
    for source in order:
        own = sorted(k for s, k in shards if s == source)
        total = {k: sum(x["size"] for x in shards[source, k]) for k in own}
        teams = sorted({k // 3 for k in own})
        of_team = dict(zip(teams, highest_quotients([sum(total[k] for k in own if k // 3 == t) for t in teams], seats[source])))
        for t in teams:
            some = [k for k in own if k // 3 == t]
            for k, quota in zip(some, highest_quotients([total[k] for k in some], of_team[t])):
                allowed = min(quota * block, 2 * total[k])
                rest = allowed - (allowed // total[k] if total[k] else 0) * total[k]
                for x in sorted(shards[source, k], key=lambda x: (x["rank_key"], x["doc_id"])):
                    part = min(rest, x["size"])
                    rest -= part
                    assert x["taken"] == (allowed // total[k] if total[k] else 0) * x["size"] + part


def test_small_corpora_are_mixed(spark):
    rows = mixing.mix_sources(docs_of(spark, ["a b c", "d"], ["x", "y"])).collect()
    assert sorted((x["doc_id"], x["taken"], x["target"]) for x in rows) == [(0, 4, 30 / 7), (1, 2, 12 / 7)]


def test_mixed_texts_hold_what_was_taken(spark):
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (30, 100, 7, 64, 200, 1)]
    docs = docs_of(spark, texts, ["a", "a", "b", "b", "c", "c"])
    words = Counter()
    for x in mixing.apply_mix(docs).collect():
        words[x["doc_id"]] += len(x["text"].split())
    assert words == Counter({x["doc_id"]: x["taken"] for x in mixing.mix_sources(docs).collect() if x["taken"]})


def test_mix_keeps_rows_that_have_no_id_or_repeat_one(spark):
    counts = [(None, 90), (None, 200), (4, 70), (4, 70), (4, 30), (5, 120), (None, 90)]
    rows = [(i, " ".join(f"w{k}" for k in range(n)), "en", None if k == 3 else "a", n, "x", "y", 3) for k, (i, n) in enumerate(counts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want, got, most = Counter(), Counter(), Counter()
    for x in mixing.mix_sources(docs).collect():
        want[x["doc_id"], x["source"]] += x["taken"]
        most[x["doc_id"], x["source"]] += 2 * x["size"]
    mixed = mixing.apply_mix(docs).collect()
    for x in mixed:
        got[x["doc_id"], x["source"]] += len(x["text"].split())
        assert x["n_chars"] == len(x["text"]) or x["text"] in {r[1] for r in rows}
    assert got == want and got[None, "a"] > 0 and all(got[k] <= most[k] for k in got)


def test_apportionment():
    assert mixing.sainte_lague([53000, 24000, 23000], 7).tolist() == [3, 2, 2]
    assert mixing.sainte_lague([0, 0], 3).tolist() == [0, 0]
    assert mixing.sainte_lague([1, 1, 1], 2).tolist() == [1, 1, 0]
    assert mixing.water_fill([10, 100, 100], [5, 2, 1], 1.5, 2.0) == [20.0, 196.66666666666666, 98.33333333333333]


def test_packing_gives_new_words_to_the_tokenizer_together():
    public = pytest.importorskip("public_tokenizers")
    words = packing.WordTokenizer(public.path("word_bpe_49k.json"))
    plain, asked = words.tokenizer, []

    class Counting:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return plain.encode_batch_fast(texts, **options)

    words.tokenizer = Counting()
    letters = "abcdefghij\u00e9\u00df"
    texts = [" ".join(f"{a}{b}{c}{d}" for c in letters for d in letters) + f". {a}{b}," for a in letters for b in letters]
    odd = ["x_. a.b...c", "\n", None, "a\n\n b\xa0c\x85 \xaa.\xb2,", "it's, <| It'S", "\u0130. \u65e5a", "tail\n"]
    for _ in range(2):  # the second time all words are known
        ids, counts = words.encode([*texts, *odd], 2)
        expected = [[*plain.encode(t or "", add_special_tokens=False).ids, 2] for t in [*texts, *odd]]
        assert counts.tolist() == [len(x) for x in expected]
        assert ids.tolist() == [y for x in expected for y in x]
    assert len(asked) < 1000  # of some 20,000 distinct words


def test_packing_leaves_few_words_in_its_workers(spark):
    import pyarrow as pa

    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    letters = "abcdefghijklmnop"
    texts = [" ".join(f"{a}{b}{c}{d}" for b in letters for c in letters for d in letters) for a in letters]
    assert packing.pack(docs_of(spark, texts).coalesce(1), path).count() > len(texts)

    def held(batches):
        for _ in batches:
            known = packing._tokenizers.get(path)
            yield pa.RecordBatch.from_arrays([pa.array([known.n if known else 0], pa.int64())], names=["n"])

    # tasks enough to reach every worker
    assert max(r.n for r in spark.range(0, 64, 1, 64).mapInArrow(held, "n long").collect()) <= packing.KEPT_WORDS


def test_packing_round_trip(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    texts = ["\x00end", "", None, "Hello, World! It's 'S fine...", "é É İ! ́x ½", "a\x1cb c\td\r\n<|endoftext|> <|ENDOFTEXT|>", "ﬁ ΣΑΣ. 日本 語", "word " * 9000, *passages(4, 60)]
    rows = packing.pack(docs_of(spark, texts), path, with_ids=True).collect()
    plain = Tokenizer.from_file(path)
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append(r)
        assert zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r["ids"])) == r["ids_crc32"]
    for i, t in enumerate(texts):
        own = sorted(pieces[i], key=lambda r: r["start"])
        ids = [x for r in own for x in r["ids"]]
        assert ids == plain.encode(t or "", add_special_tokens=False).ids + [2]
        assert all(r["doc_tokens"] == len(ids) for r in own)
        assert [r["start"] for r in own] == [sum(r["length"] for r in own[:k]) for k in range(len(own))]
    padded = 0
    for own in bins.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(r["length"] for r in own[:k]) for k in range(len(own))]
        total = sum(r["length"] for r in own)
        assert total <= 4096
        padded += 0 if total & (total - 1) == 0 else 4096 - total
    assert padded < 4 * 4096  # one bin of tails a partition at most


def test_licenses(spark):
    texts = [
        "All Rights\nreserved. all rights reserved", "This work is licensed under the GNU General Public License, version 3.", "cc-by cc by", None, "", "...",
        "x\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that following conditions are met:\ny", "general public licenses",
    ]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs_of(spark, texts)).collect()}
    assert (got[0]["n_base"], got[0]["first_word"], got[0]["last_word"], got[0]["base_labels"]) == (2, 0, 3, "reserved")
    assert got[1]["base_labels"] == "gpl" and got[1]["n_words"] == 12
    assert (got[2]["n_base"], got[2]["labels"]) == (2, "cc-by")
    assert all((got[i]["n_words"], got[i]["n_base"], got[i]["first_word"], got[i]["labels"], got[i]["score"]) == (0, 0, None, "", 0.0) for i in (3, 4, 5))
    assert got[6]["labels"] == "bsd" and got[6]["base_labels"] == "" and 0.8 <= got[6]["score"] < 1
    assert got[7]["n_base"] == 0


def test_wrapped_licenses_equal_brute_force(spark):
    r = random.Random(8)
    texts = []
    for _ in range(60):
        words = [r.choice(["so", "the", "license", "of"]) for _ in range(r.randint(0, 30))]
        for _, t in r.sample(licenses.TEMPLATES, 2):
            words += [w if r.random() < 0.9 else r.choice(["x", "y", "the"]) for w in t.split()] + [r.choice("pq") for _ in range(r.randint(0, 9))]
        texts.append("".join(w + r.choice([" ", " ", " ", "\n * ", ",\n"]) for w in words))
    texts.append("# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are met:")
    got = {x["doc_id"]: x for x in licenses.scan_licenses(docs_of(spark, texts), base={"no such words": "none"}).collect()}
    for i, text in enumerate(texts):
        words = re.findall(r"[a-z0-9]+", text.lower())
        best = {}
        for label, t in licenses.TEMPLATES:
            held, n = set(t.split()), len(t.split())
            blocks = [words[k : k + n] for k in range(len(words))]
            most = max((len(held & set(b)) for b in blocks), default=0)
            if 10 * most >= 8 * len(held):
                best[label] = max(best.get(label, 0), most / len(held))
        assert (got[i]["labels"], got[i]["score"]) == (",".join(sorted(best)), max(best.values(), default=0.0))
    assert got[60]["labels"] == "bsd"


def labelled(spark, rows, name):
    return spark.createDataFrame([(i, y) for i, y in rows], f"doc_id long, {name} int")


def test_toxicity(spark):
    r = random.Random(1)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    texts, marks = [], []
    for i in range(400):
        t = [r.choice(words) for _ in range(30)]
        if i % 8 == 0:
            t[r.randrange(30)] = "zorg" + r.choice(words)
        texts.append(" ".join(t))
        marks.append((i, int(i % 8 == 0)))
    rows = toxicity.score_toxicity(docs_of(spark, [*texts, "", None]), labelled(spark, marks, "toxic")).collect()
    assert all(0 <= x["score"] <= 1 and x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in rows)
    assert all(x["predicted"] == marks[x["doc_id"]][1] for x in rows if x["doc_id"] < 400)
    assert all(x["predicted"] == 0 for x in rows if x["doc_id"] >= 400)
    empty = toxicity.score_toxicity(docs_of(spark, ["you idiot", "fine"]), labelled(spark, [], "toxic")).collect()
    assert [x["predicted"] for x in sorted(empty, key=lambda x: x["doc_id"])] == [1, 0]


def test_grammar_marks():
    assert toxicity.compose(["R", "o", "I"]) == ["R", "o", "Ir"]
    assert toxicity.compose(["N", "o", "I"]) == ["N", "o", "In"]
    assert toxicity.compose(["N", "o", "o", "o", "I"])[-1] == "I"
    assert toxicity.compose(["Y", "I"]) == ["Y", "It"] and toxicity.compose(["I", "Y"]) == ["It", "Y"]


def test_quality(spark):
    r = random.Random(3)
    good = lambda: " ".join(r.choice(["the", "word", "of", "thing"]) for _ in range(40)) + "."
    bad = lambda: " ".join(r.choice(["THE!!", "WORD$$$", "OF%%%"]) for _ in range(40))
    texts = [bad() if i % 4 == 0 else good() for i in range(400)] + ["", None]
    rows = quality.score_quality(docs_of(spark, texts), labelled(spark, [(i, int(i % 4 != 0)) for i in range(0, 400, 3)] + [(10**9, 1)], "quality")).collect()
    assert sum(x["predicted"] == int(x["doc_id"] % 4 != 0) for x in rows if x["doc_id"] < 400) == 400
    kept = quality.keep_good(docs_of(spark, texts), labelled(spark, [(i, int(i % 4 != 0)) for i in range(0, 400, 3)], "quality"))
    assert kept.columns == docs_of(spark, texts).columns and kept.where("doc_id < 400").count() == 300
    assert all(x["score"] == 1 for x in quality.score_quality(docs_of(spark, texts), labelled(spark, [], "quality")).collect())


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    public = pytest.importorskip("public_tokenizers")
    for df in (substrings.remove_repeats(none), ngram_join.components(none), mixing.mix_sources(none), licenses.scan_licenses(none), toxicity.score_toxicity(none, labels), quality.score_quality(none, labels), packing.pack(none, public.path("word_bpe_49k.json"))):
        assert df.collect() == []


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    from lodestone.llm import shingles

    r = random.Random(9)
    texts = [" ".join("".join(r.choice("abc") for _ in range(r.randint(1, 40))) for _ in range(300)), "x" * 9000, "", "a b c d e f", None]
    want = shingles.shingle_sets(texts)
    for piece in (1, 100, 5000):
        monkeypatch.setattr(shingles, "PIECE", piece)
        got = shingles.shingle_sets(texts)
        assert all((a == b).all() for a, b in zip(want, got))
        shingles._words.clear()


def test_content_features_do_not_depend_on_blocks(monkeypatch):
    import pyarrow as pa

    texts = pa.array(["Hello, world! 123", "", None, "a" * 50 + "\n" + "a" * 50, "x"])
    rest = [["en", None, "en", "de", "fr"], [None, "a", "a", "b", "a"], [17, None, 0, 101, 1]]
    want = quality.view_features(texts, *rest)
    monkeypatch.setattr(quality, "BLOCK", 7)
    assert all((a == b).all() for a, b in zip(quality.view_features(texts, *rest), want))


def test_rounds_of_co_training_help():
    """Two views that each tell the class by 5 of 60 columns; 50 labels, a pool without."""
    import numpy as np

    signal = 0.6 * (np.arange(60) < 5)
    right = []
    for rounds in (0, 4):
        rng, got = np.random.default_rng(3), []

        def rows(n, rng=rng):
            y = rng.random(n) < 0.5
            return y.astype(float), [rng.standard_normal((n, 60)) + np.where(y, 1, -1)[:, None] * signal for _ in range(2)]

        for _ in range(10):
            (y, known), (_, pool), (test_y, test) = rows(50), rows(1500), rows(1000)
            views = quality.CoTrained().fit(tuple(known), y, tuple(pool), rounds).score(*test)
            got.append([((s >= 0.5) == test_y).mean() for s in views])
        right.append(np.mean(got, axis=0))
    assert (right[1] > right[0] + 0.01).all()


def test_quality_of_odd_rows(spark):
    texts = ["the word of thing. " * 20 if i % 3 else "THE!! WORD$$$ " * 20 for i in range(90)]
    rows = [(i, t, "en", None, None, 1.5, "y", 3) for i, t in enumerate(texts)] + [(None, "the word of thing. " * 20, None, "s", 4, 2.5, None, 3)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, y string, content_score long")
    labels = labelled(spark, [(i, int(i % 3 > 0)) for i in range(90)] + [(0, 1), (None, 1), (10**6, 0)], "quality")
    kept = quality.keep_good(docs, labels, pool_rows=0)
    assert kept.columns == docs.columns and sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in kept.collect()) == [-1, -1, *(i for i in range(90) if i % 3)]


def test_very_long_texts(spark):
    """Tens of thousands of words around what each operator looks for; ties and clashing names."""
    filler = "plain words of no meaning at all " * 3_000
    notice = licenses.TEMPLATES[9][1]
    df = spark.createDataFrame([(1, filler + notice + " " + filler, 1, "x"), (2, filler, 1, "x"), (2, filler, 1, "x"), (None, notice, 1, "x")], "doc_id long, text string, n_words int, labels string")
    got = sorted(((r["doc_id"] or 0, r["n_words"], r["labels"]) for r in licenses.scan_licenses(df).collect()))
    n = 7 * 3_000
    assert got == [(0, len(notice.split()), "mit"), (1, 2 * n + len(notice.split()), "mit"), (2, n, ""), (2, n, "")]
    toxic = spark.createDataFrame([(1, filler + "you stupid idiot. " + filler, 0.5), (2, filler, 0.5), (None, "", 0.5), (2, filler, 0.5)], "doc_id long, text string, score double")
    scored = sorted((r["doc_id"] or 0, r["predicted"]) for r in toxicity.score_toxicity(toxic, labelled(spark, [], "toxic")).collect())
    assert scored == [(0, 0), (1, 1), (2, 0), (2, 0)]
    mixed = {r["doc_id"]: (r["size"], r["taken"]) for r in mixing.mix_sources(df.where("doc_id is not null").dropDuplicates(["doc_id"]).selectExpr("*", "'a' as source", "0 as taken")).collect()}
    assert mixed[1][0] == 2 * n + len(notice.split()) and all(t <= 2 * s for s, t in mixed.values())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no tables here")
def test_held_out_accuracy(spark):
    """Both classifiers on the fifth of the labels that they never learn from."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    truth = {r["doc_id"]: (r["quality"], r["toxic"]) for r in labels.collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    rows = [(truth[r["doc_id"]][1], r["predicted"], r["score"]) for r in toxicity.score_toxicity(docs, labels).collect() if r["held_out"] and r["doc_id"] in truth]
    bad, good = [s for y, _, s in rows if y], [s for y, _, s in rows if not y]
    assert sum((a > b) + 0.5 * (a == b) for a in bad for b in good) >= 0.95 * len(bad) * len(good)
    assert sum(p for y, p, _ in rows if y) >= 0.9 * len(bad) and sum(p for y, p, _ in rows if not y) <= 0.01 * len(good)
    known = labels.where(~toxicity.held_out(labels["doc_id"]))
    rows = [(truth[r["doc_id"]][0], r["predicted"]) for r in quality.score_quality(docs, known).collect() if r["doc_id"] in truth and held(r["doc_id"])]
    assert sum(y == p for y, p in rows) >= 0.99 * len(rows)


def test_workers_give_memory_back():
    """What one batch or one group took at most is not what the worker keeps."""
    import os

    import pandas as pd

    from lodestone.llm.common import lean, lean_group

    def anonymous():
        with open("/proc/self/smaps_rollup") as f:
            return sum(int(x.split()[1]) for x in f if x.startswith("Anonymous")) / 1024

    if not os.path.exists("/proc/self/smaps_rollup"):
        pytest.skip("memory can't be read here")

    def litter():
        # many small pieces below one that stays: the heap can't shrink from its end
        held = [bytes(1000) for _ in range(150_000)]
        pin = bytearray(1000)
        return held, pin

    def run(batches):
        for p in batches:
            held, pin = litter()
            pins.append(pin)
            del held
            yield p

    def group(pdf):
        held, pin = litter()
        pins.append(pin)
        return pdf

    pins: list = []
    assert list(lean(run)(iter([1, 2]))) == [1, 2]
    before = anonymous()
    for _ in range(3):
        list(lean(run)(iter([1])))
        assert len(lean_group(group)(pd.DataFrame({"a": [1]}))) == 1
    assert anonymous() < before + 60


def test_suffix_order_takes_little_memory():
    """The order of 2 MB of strings stays under 64 bytes a byte, with the same ties."""
    import tracemalloc

    import numpy as np

    from lodestone.llm.parsing import suffix_ranks

    r = np.random.default_rng(1)
    texts = [r.integers(97, 123, 20_000, np.uint8).tobytes() for _ in range(25)]
    texts += texts[:5]
    tracemalloc.start()
    rank, shared = suffix_ranks(texts, 200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 * sum(map(len, texts)), peak / sum(map(len, texts))
    own = np.repeat(np.arange(30), 20_000)
    place = np.tile(np.arange(20_000), 30)
    assert (shared == (((own < 5) | (own >= 25)) & (place <= 20_000 - 200))).all()
    assert (rank[place > 20_000 - 200] == -1).all()
