"""Findings of the fourth round on training-data operators."""

from __future__ import annotations

import pyarrow.parquet as pq

from cellscape.llm import filter_audit


def test_shards_are_written_in_small_row_groups(spark, monkeypatch):
    """A task holds a row group when it writes or reads; of rows of megabytes that must be few."""
    monkeypatch.setattr(filter_audit, "SHARD_BYTES", 1 << 15)
    text = "concat_ws(' ', transform(sequence(1, 2000), i -> concat('w', id, 'x', i)))"
    docs = spark.range(30).selectExpr("id doc_id", "'a' source", f"{text} text").coalesce(1)
    files = [f.removeprefix("file:") for f in filter_audit.term_matrix(docs).dictionary.inputFiles()]
    groups = [pq.ParquetFile(f).metadata.row_group(i) for f in files for i in range(pq.ParquetFile(f).num_row_groups)]
    assert sum(g.num_rows for g in groups) >= 20
    assert max(g.num_rows for g in groups) <= 4, [g.num_rows for g in groups]
    rows = filter_audit.failed_filters(docs).collect()
    assert {(r.n_words, r.n_distinct) for r in rows} == {(2000, 2000)} and len(rows) == 30
