"""The pipeline against its stages' brute-force versions."""

from collections import Counter

import corpus_pipeline
from assay.llm import packing
from tests.llm.test_operators import documents, plain_bootstrap, plain_components, plain_fingerprint, plain_spans


def test_stages(spark, sf):
    docs = documents(spark, sf)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, docs, sf)
    assert kept.columns == docs.columns and kept.count() == docs.count()  # all are clean
    kept = stages["near_dedup"](spark, kept, sf)
    rows = docs.orderBy("doc_id").collect()
    roots = plain_components([plain_fingerprint(r.text) for r in rows])
    assert sorted(r.doc_id for r in kept.collect()) == sorted(rows[k].doc_id for k in set(roots))
    masked = stages["mask_pii"](spark, kept, sf)
    before, after = {r.doc_id: r for r in kept.collect()}, {r.doc_id: r for r in masked.collect()}
    assert masked.columns == docs.columns and before.keys() == after.keys()
    more = plain_bootstrap({i: r.text or "" for i, r in before.items()}, extra=True)
    for i, r in after.items():
        text, at, out = before[i].text, 0, ""
        for start, end, kind in sorted((s, e, k) for k, s, e in [*plain_spans(text), *more.get(i, ())]):
            out += text[at:start] + f"[{kind.upper()}]" if start >= at else ""
            at = max(at, end)
        assert r.text == out + text[at:] and r.n_chars == len(r.text) and not plain_spans(r.text)
    mixed = stages["mix_sources"](spark, masked, sf)
    assert mixed.columns == docs.columns
    n = Counter(r.doc_id for r in mixed.collect())
    packed = corpus_pipeline.run(spark, sf)
    tokens = packing.encoder(packing.default_vocabulary())
    want = Counter({i: k * (1 + len(tokens.ids(after[i].text))) for i, k in n.items()})
    got = Counter()
    for r in packed.collect():
        got[r.doc_id] += r.length
    assert got == want


def test_empty_and_odd_documents(spark, sf, tmp_path):
    from tests.llm.test_operators import frame, odd_rows

    clash = ["base", "more", "copy", "fp", "component_id", "rejected", "key"]
    for rows in (odd_rows(), []):
        docs = frame(spark, rows).selectExpr("*", *[f"'{c}' AS `{c}`" for c in clash])
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, sf).write.parquet(path := str(tmp_path / f"{len(rows)}-{k}"))
            docs = spark.read.parquet(path)
            if name != "pack":
                assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *clash]
                assert all(r[c] == c for r in docs.collect() for c in clash)
