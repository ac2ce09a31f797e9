"""The pipeline against a plain version of its stages."""

from __future__ import annotations

import duckdb

import corpus_pipeline
from shutterlake.llm import sql

from .test_methods import brute_hits

#: The smallest scale at which every stage has something to do.
SF = "/root/testdata/sf0.01"


def test_pipeline(spark):
    oracle = duckdb.connect()
    for name in ("documents", "benchmark"):
        oracle.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    kept = oracle.sql(f"WITH {sql.quality_sql()} SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars FROM judged j JOIN documents d USING (doc_id) WHERE j.kept").df()
    oracle.register("kept_docs", kept)
    single = oracle.sql(f"WITH RECURSIVE {sql.near_dup_sql('kept_docs')} SELECT k.* FROM components c JOIN kept_docs k USING (doc_id) WHERE c.doc_id = component_id").df()
    hits = {d for d, _ in brute_hits(list(zip(single.doc_id, single.text, strict=True)), oracle.sql("SELECT item_id, text FROM benchmark").df().values.tolist())}
    clean = single[~single.doc_id.isin(hits)].reset_index(drop=True)
    assert set(got) == set(clean.doc_id) and hits and len(single) < len(kept)
    oracle.register("clean_docs", clean)
    spans = oracle.sql(f"WITH {sql.secret_sql('clean_docs')} SELECT doc_id, start, stop FROM s_docs JOIN s_spans USING (rid) ORDER BY doc_id, start, rank").df()
    by_doc = {d: [(int(a), int(b)) for a, b in zip(g.start, g.stop, strict=True)] for d, g in spans.groupby("doc_id")}
    for d, text in zip(clean.doc_id, clean.text, strict=True):
        out, at = "", 0
        for a, b in by_doc.get(d, []):
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        assert got[d].text == (out + text[at:] if d in by_doc else text)
        assert got[d].n_chars == len(got[d].text)
    assert by_doc and len({r.position for r in got.values()}) == len(got)
    assert [x for x, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "secret_scans", "source_mixing"]
