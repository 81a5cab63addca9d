from __future__ import annotations

import numpy as np

import corpus_pipeline
from lanewright.llm import registry
from tests.llm import brute


def test_stages_end_to_end(spark, docs, rows, labels, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    frame, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, frame, str(tmp_path))
        path = str(tmp_path / name.replace(" ", "_"))
        made.write.parquet(path)
        frame = spark.read.parquet(path)
        seen.append(frame)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert frame.columns == docs.columns
    texts = [{r["doc_id"]: r["text"] for r in f.collect()} for f in seen[:4]]
    stats = brute.word_statistics(rows)
    assert set(texts[0]) == {i for i, t, *_ in rows if not stats[i][5] and "###" not in t}
    lines = brute.lines([(i, t) for i, t in texts[0].items()])
    assert {i: brute.sha(t.encode()) for i, t in texts[1].items()} == {i: x[2] for i, x in lines.items()}
    near = brute.near_pairs([(i, t) for i, t in texts[1].items()])
    assert set(texts[2]) == {i for i, x in near.items() if x[2]}
    assert set(texts[3]) <= set(texts[2])
    assert {r["doc_id"] for r in seen[4].collect()} == set(texts[3]) and all(r["round_trip"] for r in seen[4].collect())
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert np.all(sorted(r["doc_id"] for r in whole.collect()) == sorted(r["doc_id"] for r in seen[4].collect()))


def test_every_operator_is_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES)
    assert numbers == list(range(1, 11))
