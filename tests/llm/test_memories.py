import pyarrow as pa

from tidelog.llm import common, packing, tokens


def test_a_worker_keeps_one_operators_memory():
    """A worker outlives the steps of a pipeline; what the tokenizer remembers goes when another operator's task begins."""
    path = tokens.public_path("byte_bpe_50k.json")
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["some words here", ""]})
    first = [(d, x.tolist()) for d, x in packing.encoded([batch], path, 1)]
    held = tokens.tokenizer(path)
    assert "some" in held.known and first == [(d, x.tolist()) for d, x in packing.encoded([batch], path, 1)]
    assert tokens.tokenizer(path) is held  # its own next task finds it
    assert [b.num_rows for b in common.slices([batch], 1)] == [1, 1]  # another operator's task
    assert not tokens._loaded
    assert first == [(d, x.tolist()) for d, x in packing.encoded([batch], path, 1)]
