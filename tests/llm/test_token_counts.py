import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wavemill.llm import kernels as K
from wavemill.llm.token_counts import PieceCounter, safe_starts, token_counts

import numpy as np
import pyarrow as pa

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE, PARTS = Tokenizer.from_file(PATH), PieceCounter(PATH)


def by_pieces(text):
    buf, offsets = K.text_buffer(pa.array([text]))
    starts = safe_starts(buf, offsets)
    return int(PARTS(buf, starts, np.append(starts[1:], len(buf))).sum()) if len(starts) else 0


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab'sre1 2.\n\t\r 　 \u0085éßñ漢<|>\x1c-"), max_size=60))
def test_pieces_add_up(text):
    for t in (text, text + "<|endoftext|>" + text):
        assert by_pieces(t) == len(WHOLE.encode(t, add_special_tokens=False))


def test_rows(spark):
    texts = ["", None, "Hello  world's 3 cats", "x" * 5000, "a b " * 60000, "Hello  world's 3 cats", "<|endoftext|> <|endoftext|>"]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "one", "z"), (2, texts[2], "again")]
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), PATH, 1024).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted(
        (i if i is not None else -1, len((t or "").encode()), n := len(WHOLE.encode(t or "", add_special_tokens=False)), n > 1024) for i, t, _ in rows
    )
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
