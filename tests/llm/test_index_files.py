"""What a reader of the index holds at a time is bounded: blocks of a file, documents of a block."""

from pathlib import Path

import pyarrow.parquet as pq

from atlasfold.llm import ranking


def test_files_and_blocks_are_bounded(spark, make, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK_BYTES", 200)
    monkeypatch.setattr(ranking, "DOCUMENTS", 7, raising=False)
    index = ranking.build(make([(i, f"w{i % 5} w" if i % 2 else "") for i in range(400)]).coalesce(1))
    files = list(Path(index.blocks.folder.removeprefix("file://")).glob("*.parquet"))
    assert max(pq.read_metadata(f).num_rows for f in files) <= 4 < sum(pq.read_metadata(f).num_rows for f in files)
    assert max(len(r.ids) for r in index.blocks.select("ids").collect()) <= 7 and index.documents == 200
