"""The pipeline, stage by stage, against plain versions of what each stage decides."""

import hashlib
import inspect

import pytest
import sentencepiece

import corpus_pipeline
from quillfund.llm.common import scratch_path
from quillfund.llm.pieces import default_model
from quillfund.llm.simhash import fingerprint
from quillfund.llm.surrogates import KEY_SETTING, _rewritten

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    spark.conf.set(KEY_SETTING, "test")
    docs, found = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, "test-stage")
        stage(spark, docs, DATA).write.parquet(path)
        found.append((docs, docs := spark.read.parquet(path)))
    spark.conf.unset(KEY_SETTING)
    return found


def test_shape(outputs):
    assert [len(inspect.signature(f).parameters) for _, f in corpus_pipeline.STAGES] == [3] * 5
    for before, after in outputs[:-1]:
        assert after.dtypes == before.dtypes
    assert outputs[-1][1].count() == outputs[-1][0].count()


def test_filters_only_drop_whole_rows(outputs):
    for before, after in outputs[:3]:
        assert after.exceptAll(before).isEmpty()
        assert 0.5 * before.count() < after.count() <= before.count()


def test_near_dedup_keeps_one_of_each_group(outputs):
    before, after = ([(r.doc_id, fingerprint((r.text or "").encode())) for r in d.collect()] for d in outputs[1])
    label = {k: k for k, _ in before}
    for k, a in sorted(before):
        for j, b in sorted(before):
            if j < k and (a ^ b).bit_count() <= 4 and label[j] != label[k]:
                low, high = sorted((label[j], label[k]))
                label = {x: low if y == high else y for x, y in label.items()}
    assert sorted(k for k, _ in after) == sorted(set(label.values()))


def test_surrogates_and_tokens(outputs):
    before, after = ({r.doc_id: r for r in d.collect()} for d in outputs[3])
    for k, row in before.items():
        assert after[k].text == _rewritten(row.text, None, b"test")
    library = sentencepiece.SentencePieceProcessor(model_proto=default_model())
    for row in outputs[4][1].collect():
        ids = library.encode(after[row.doc_id].text)
        assert list(row.ids) == ids and row.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
