"""What a Python worker holds of an Arrow batch."""

import tracemalloc

import numpy as np
import pyarrow as pa

from rolesieve.llm import packing, toxic_crf
from rolesieve.llm.queries import tokenizer_path


def batch_of(words: int, rows: int) -> pa.RecordBatch:
    texts = [" ".join(f"w{(i * words + k) % 977}x" for k in range(words)) for i in range(rows)]
    return pa.record_batch({"doc_id": pa.array([*range(rows - 2), None, 7], pa.int64()), "text": [*texts[:-2], None, ""]})


def test_only_one_run_of_a_batch_is_python_strings():
    batch = batch_of(800, 4000)  # 16 MB
    seen = []

    def score(texts):
        seen.append(sum(map(len, texts)))
        return np.array([len(t) for t in texts])

    tracemalloc.start()
    got = list(toxic_crf.passing(iter([batch]), score, lambda s: s > 0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert max(seen) <= 1_000_000 and sum(seen) > 15_000_000
    assert peak < 6_000_000
    assert pa.Table.from_batches(got).equals(pa.Table.from_batches([batch.slice(0, 3998)]))


def test_pieces_of_null_ids_and_texts():
    t = packing.CachedTokenizer(tokenizer_path("word_bpe_49k.json"))
    batch = batch_of(900, 5)
    rows = pa.Table.from_batches(packing.cut_batches(iter([batch]), t, 2048, 1)).to_pylist()
    assert [(r["doc_id"], r["length"]) for r in rows[-2:]] == [(None, 1), (7, 1)]
    for d in range(3):
        own = [r for r in rows if r["doc_id"] == d]
        assert sum(r["length"] for r in own) == own[0]["doc_tokens"] == len(t.whole(batch["text"][d].as_py())) // 4 + 1
