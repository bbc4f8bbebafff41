"""The pipeline over a small folder of tables, stage by stage against brute force."""

import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from ledgerline.llm import quality_net, secrets
from ledgerline.llm.queries import vocabulary

from .test_operators import brute_groups, edited, words


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    good = lambda: ". ".join(words(rng, 9, 4000).capitalize() for _ in range(rng.randrange(4, 14))) + "."
    rows = {k: good() for k in range(160)}
    rows |= {200 + k: " ".join(w + "###" for w in words(rng, 60, 4000).split()) for k in range(60)}
    rows |= {300 + k: edited(rng, rows[k], 1) for k in range(20)} | {330 + k: rows[k] for k in range(10)}
    item = good()
    rows |= {400: good() + " " + item + " " + good(), 401: good() + " password = hunter22xyz " + good()}
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int("###" not in t), 0) for i, t in rows.items() if i < 300], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows


def test_stages_equal_brute_force(spark, folder):
    d, rows = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, kept = docs.columns, dict(rows)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        if k == 0:
            scored = {r.doc_id: r.predicted for r in quality_net.quality_scores(docs, spark.read.parquet(f"{d}/labels.parquet")).collect()}
            assert all(scored[i] == int("###" not in t) for i, t in rows.items())
            kept = {i: t for i, t in kept.items() if scored[i]}
        elif k == 1:
            kept = {i: kept[i] for i, _, c in brute_groups(sorted(kept.items()), 5, 80) if i == c}
        elif k == 2:
            kept = {i: t for i, t in kept.items() if i != 400}
        elif k == 3:
            assert secrets.base_spans(kept[401])
            kept = {i: secrets.redacted(t) for i, t in kept.items()}
            assert "hunter22xyz" not in kept[401]
        if k < 4:
            assert out.columns == columns
            got = {r.doc_id: r.text for r in out.collect()}
            assert got == kept
            docs = out
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    final = out.collect()
    assert {r.doc_id for r in final} == set(kept)
    for r in final:
        ids = sp.encode(kept[r.doc_id], add_bos=True, add_eos=True)
        assert r.ids == ids and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert corpus_pipeline.run(spark, d).count() == len(kept)
