"""BPE and token counts against the libraries, and the cache's effect."""

import hashlib
import random

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from cellscape.llm import bpe, queries, token_counts
from cellscape.llm.common import shared_folder

BYTE = public_tokenizers.path("byte_bpe_50k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")


def fuzz(n, seed):
    rng = random.Random(seed)
    letters = "aabcdeeehiilmnnoorssttuy     \n\t'.,!?0123456789ÄéßñЖ日本🙂\u00a0\u2028\u0000<|>endoftext"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 200))) for _ in range(n)]


def test_words_match_library_and_round_trip():
    lib, own = Tokenizer.from_file(BYTE), bpe.PairBpe(BYTE)
    texts = [*fuzz(3000, 1), "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "thththththinginging" * 50, " " * 999, "é" * 500]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        want = lib.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, text
        assert own.decode(want) == lib.decode(want, skip_special_tokens=False)


def test_failing_words_are_merged_exactly():
    """The proposal is not always right; those words must still come out exact."""
    own = bpe.PairBpe(BYTE)
    words = sorted({w for t in fuzz(2000, 2) for w in own.segments(t)})
    differ = [w for w in words if own.propose(w.encode()) != own.merge(w.encode())]
    assert differ
    own.learn_words(words)
    assert all(list(own.known[w]) == own.merge(w.encode()) for w in words)


def test_broken_bytes_decode_like_the_library():
    lib, own = Tokenizer.from_file(BYTE), bpe.PairBpe(BYTE)
    rng = np.random.default_rng(3)
    for _ in range(300):
        ids = rng.integers(0, 50257, rng.integers(1, 12)).tolist()
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_bpe_odd_rows(spark, odd_docs, no_docs):
    lib = Tokenizer.from_file(BYTE)
    rows = bpe.decode_documents(bpe.encode_documents(odd_docs, BYTE), BYTE).collect()
    assert len(rows) == odd_docs.count()
    texts = {(r.doc_id, r.text or "") for r in odd_docs.collect()}
    for r in rows:
        assert (r.doc_id, r.decoded) in texts
        assert list(r.ids) == lib.encode(r.decoded, add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
    assert bpe.decode_documents(bpe.encode_documents(no_docs, BYTE), BYTE).count() == 0


def test_bpe_query(spark):
    lib = Tokenizer.from_file(BYTE)
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op7_bpe_speculate(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_token_counts_odd_rows_and_cache(spark, odd_docs, no_docs):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    cache = shared_folder(spark, "cache_test")
    got = token_counts.count_tokens(odd_docs, PIECE, cache).collect()
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(lib.encode(r.text or ""))) for r in odd_docs.collect())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got) and any(r.over_limit for r in got)
    distinct = odd_docs.selectExpr("coalesce(text, '')").distinct().count()
    assert spark.read.parquet(cache).count() == distinct
    more = odd_docs.unionByName(spark.createDataFrame([(99, "a new text")], "doc_id long, text string"), allowMissingColumns=True)
    assert token_counts.count_tokens(more, PIECE, cache).count() == len(want) + 1
    assert spark.read.parquet(cache).count() == distinct + 1  # only the miss was encoded and appended
    assert token_counts.count_tokens(no_docs, PIECE, shared_folder(spark, "cache_test")).count() == 0


def test_versions_do_not_share_counts(spark, odd_docs):
    cache = shared_folder(spark, "cache_test")
    token_counts.count_tokens(odd_docs, PIECE, cache).count()
    lib = Tokenizer.from_file(BYTE)
    got = token_counts.count_tokens(odd_docs, BYTE, cache).collect()
    want = sorted((str(r.doc_id), len(lib.encode(r.text or "", add_special_tokens=False).ids)) for r in odd_docs.collect())
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == want


def test_token_count_query(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    sf = "/root/testdata/sf0.001"
    want = sorted((r.doc_id, len(lib.encode(r.text or ""))) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sorted((r.doc_id, r.n_tokens) for r in queries.op8_token_count_cache(spark, sf).collect()) == want
