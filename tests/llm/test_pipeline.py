"""The pipeline against plain Python on the same documents."""

from __future__ import annotations

import corpus_pipeline
import numpy as np
from burncal.llm import common, decontaminate, pieces, quality, secrets
from tests.conftest import SF
from tests.llm.data import frame, near_copies


def test_pipeline_equals_plain(spark):
    docs = [tuple(r) for r in common.documents(spark, SF).select("doc_id", "text").collect()]
    model = quality.fit(common.cut(quality.document_statistics(common.documents(spark, SF))), common.table(spark, SF, "labels"))
    left = [(i, t) for i, t in docs if model.score(np.array([quality.statistics(t or "")]))[0] >= 0.3]
    of = near_copies(left)
    left = [(i, t) for i, t in left if of[i] == i]
    bench = decontaminate.Benchmark([(r.item_id, r.text) for r in common.table(spark, SF, "benchmark").collect()])
    left = [(i, t) for i, t in left if not bench.matches(t or "")]
    codec = pieces.Codec(pieces.Vocabulary.read())
    scan = secrets.scan_secrets(spark.createDataFrame(left, "doc_id long, text string")).collect()
    spans = {r.doc_id: [(s.start, s.end) for s in r.secrets] for r in scan}
    assert all({(s, e) for _, s, e in secrets.rule_findings(t)} <= set(spans[i]) for i, t in left)
    expected = {i: secrets.redact(t, spans[i]) for i, t in left}
    found = corpus_pipeline.run(spark, SF).collect()
    assert len(found) == len(expected)
    got = {r.doc_id: codec.decode(np.array(r.ids, int)) for r in found}
    assert got == expected


def test_stages_keep_columns_and_odd_rows(spark):
    docs = frame(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert stage(spark, frame(spark, []), SF).count() == 0
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count() > 0
