"""The whole pipeline on small tables, with odd rows."""

import random

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_bytes int, row string, size long, taken long, component_id long"


def write(spark, at, rows, labels):
    spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), 1, "r", 2, 3, 4) for i, t, lang, s in rows], SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")


def test_pipeline_of_odd_rows(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    r = random.Random(1)
    words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(500)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n)) + "."
    passage = prose(60)
    rows = [(i, prose(80), "en", "a" if i % 3 else None) for i in range(60)]
    rows += [(100 + i, "BUY!! NOW$$ " * 40, "en", "b") for i in range(30)]
    near = rows[5][1].split()
    rows += [(200, " ".join([*near[:70], "x", *near[71:]]), "en", "a"), (201, rows[6][1], "en", "a")]
    rows += [(300, prose(40) + passage + prose(40), None, "a"), (301, prose(30) + passage, "en", "c")]
    rows += [(None, prose(90), "en", "a"), (None, prose(85), "en", None), (400, None, None, None), (401, "", "en", "a"), (7, rows[7][1], "en", "a"), (402, prose(8000), "en", "a")]
    labels = [(i, 1, 0) for i in range(0, 60, 2)] + [(100 + i, 0, 0) for i in range(0, 30, 2)] + [(None, 1, 0), (10**9, 0, 0)]
    write(spark, tmp_path, rows, labels)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    held = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = corpus_pipeline.keep(stage(spark, held, str(tmp_path)), name.replace(" ", "-"))
        assert held.columns == docs.columns
        seen.append({(x["doc_id"], x["text"]) for x in held.collect()})
    ids = [{i for i, _ in s} for s in seen]
    assert not ids[0] & set(range(100, 130)) and set(range(60)) | {200, 201, 300, 301, 402, None} <= ids[0]
    assert ids[1] == ids[0] - {200, 201} and sum(i is None for i, _ in seen[1]) == 2
    texts = dict(seen[2])
    assert passage not in texts[300] and passage not in texts[301] and texts[402] == rows[-1][1]
    assert ids[3] <= ids[2] and None in ids[3] and len({t for _, t in seen[3]}) > 40
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"] for x in packed} == ids[3]
    length = {}
    for x in packed:
        length[x["sequence_id"]] = length.get(x["sequence_id"], 0) + x["length"]
    assert max(length.values()) <= 4096


def test_pipeline_of_nothing(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    write(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
