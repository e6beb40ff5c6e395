"""Token alignment of whole calls: its cost beside the encoding itself, and results that don't depend on where calls and blocks end."""

import random
import time
from types import SimpleNamespace

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from breakweave.llm import token_align

FOLDER = "/opt/tokenizers"
TEXTS = ["the cat sat on the mat", "", None, "▁x", "a  b\t\nc", "</s> <s> naïve " * 9, "日本語 😀", " ", "1234567890 --- !!!"] * 3


@pytest.fixture(autouse=True)
def without_spark(monkeypatch):
    context = SimpleNamespace(partitionId=lambda: 0)
    monkeypatch.setattr(token_align, "TaskContext", SimpleNamespace(get=lambda: context))


def blocks(texts):
    table = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    return [row for batch in token_align._blocks(iter(table.to_batches(max_chunksize=1000)), FOLDER) for row in batch.to_pylist()]


def by_document(rows):
    found = {}
    for row in rows:
        at = 0
        for doc in row["docs"]:
            held = slice(at, at + doc["held"])
            at = held.stop
            found[doc["doc_id"]] = doc, sorted(zip((row["keys"][x] for x in row["at"][held]), row["times"][held], strict=True))
        assert at == len(row["at"]) == len(row["times"])
        assert sum(row["links"]) == sum(row["times"])
    return found


def test_alignment_costs_less_than_encoding():
    """Walking, naming and counting take less CPU time than both encoders together; before they took about twice as much."""
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()
    table = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    pair, whole, alone = token_align._pair(FOLDER), [], []
    for _ in range(3):
        start = time.process_time()
        pair.first([" " + (x or "") for x in texts])
        pair.second.encode([x or "" for x in texts], num_threads=1)
        alone.append(time.process_time() - start)
        start = time.process_time()
        assert sum(len(batch.column(0)) for batch in token_align._blocks(iter(table.to_batches()), FOLDER)) > 0
        whole.append(time.process_time() - start)
    assert min(whole) < 2 * min(alone)


@pytest.mark.parametrize("call, block", [(1, 1), (1, 1 << 20), (400, 900), (1 << 20, 1)])
def test_calls_and_blocks_end_anywhere(monkeypatch, call, block):
    want = by_document(blocks(TEXTS))
    monkeypatch.setattr(token_align, "CALL_BYTES", call)
    monkeypatch.setattr(token_align, "BLOCK_BYTES", block)
    assert by_document(blocks(TEXTS)) == want


def test_empty_texts_fill_a_block(monkeypatch):
    monkeypatch.setattr(token_align, "CALL_BYTES", 1000)
    monkeypatch.setattr(token_align, "BLOCK_BYTES", 2000)
    found = blocks([None, ""] * 100)
    assert len(found) == 10 and {len(x["docs"]) for x in found} == {20}


@pytest.mark.parametrize("most", [400, 60_000, 20_000_000])
def test_long_tokens(most):
    """Sizes beyond one byte, some of which differ in their higher bytes only."""
    rng = random.Random(most)
    shared = sorted(rng.sample(range(1, most), 200))
    ends = [sorted({*shared, *rng.sample(range(1, most), 20), most}) for _ in range(2)]
    got = []
    for i, j, m, n in token_align.common_ends(*ends):
        got += [ends[0][i + m - 1]] if n else ends[0][i : i + m]
        assert n or ends[0][i : i + m] == ends[1][j : j + m]
    assert got == sorted(set(ends[0]) & set(ends[1]))
    assert list(token_align.common_ends([256, 600], [512, 600])) == [(0, 0, 2, 2)]
