"""The registered queries of operators 1 and 9 over whole tables, against the libraries text by text."""

import math

import public_tokenizers
import sentencepiece
import tokenizers

from wavemill.llm import queries


def documents(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_op1(spark, sf):
    docs, coder = documents(spark, sf), tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coder.no_truncation()
    coder.no_padding()
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.queries()["op1_token_counts"](spark, sf).collect()}
    want = {}
    for d, text in docs.items():
        n = len(coder.encode(text or "", add_special_tokens=False).ids)
        want[d] = (len((text or "").encode()), n, n > 1024)
    assert got == want


def test_op9(spark, sf):
    docs, model = documents(spark, sf), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = {r["doc_id"]: r for r in queries.queries()["op9_piece_sampling"](spark, sf).collect()}
    again = {r["doc_id"]: r for r in queries.queries()["op9_piece_sampling"](spark, sf).collect()}
    assert rows.keys() == docs.keys() and rows == again and all(r["lossless"] for r in rows.values())
    # a sampled segmentation has no fewer pieces than characters over the longest piece, and no more than bytes and one each
    longest = max(len(model.id_to_piece(k)) for k in range(model.get_piece_size()))
    for d, text in docs.items():
        assert math.ceil(len(text or "") / longest) <= rows[d]["n_pieces"] <= 2 * len((text or "").encode()) + 2
