import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import sentencepiece
import tiktoken
from cases import DOCUMENTS, clashing, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from sievestone.llm import bpe, token_counts

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
PIECES = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
ENCODER = bpe.Encoder(bpe.Replay(RANKS), P.PATTERN)
TEXT = st.text(alphabet=st.one_of(st.sampled_from(" \n\t'aeiounth<>|=.,▁ \x1c\x85é漢Ж0123"), st.characters(exclude_categories=("Cs",))), max_size=80)
ODD = ["", " ", "  ", " a", "a ", "a  b", "a\n b", "a \nb", "it's they'll", "aaaaaaaaaaaaaaaaa", "ababababab", " the the  the", "<|endoftext|>", "▁▁a ▁ b", "  x", "x\x1c y", "</s><s><0x0A>", "é ﬁ １", "\x00"]


def test_replay_is_the_library(spark):
    for text in ODD:
        assert np.frombuffer(ENCODER.encode([text])[0], "<u4").tolist() == LIBRARY.encode_ordinary(text), text


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_replay_on_any_text(texts):
    got = ENCODER.encode(texts)
    decoder = bpe.Decoder(RANKS)
    together = ENCODER.encode_all(pa.array(texts, pa.string()))
    assert together.to_pylist() == got and decoder.decode_all(together).to_pylist() == [t.encode() for t in texts]
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode_ordinary(text)
        assert decoder.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_counts_on_any_text(text):
    pieces = token_counts.Pieces(P.path("piece_bpe_32k.model"))
    words = token_counts.pretokens(text)
    known = pieces.learn([words])
    assert sum(known[w] for w in words) == len(PIECES.encode(text))


def test_counts_of_odd_rows(spark):
    assert all(sum(map(lambda w: token_counts.Pieces(P.path("piece_bpe_32k.model")).learn([[w]])[w], token_counts.pretokens(t))) == len(PIECES.encode(t)) for t in ODD)
    got = sorted(map(tuple, token_counts.token_counts(clashing(documents(spark))).collect()), key=repr)
    want = sorted(((r[0], len((r[1] or "").encode()), len(PIECES.encode(r[1] or ""))) for r in DOCUMENTS), key=repr)
    assert got == want
    assert token_counts.token_counts(documents(spark, [])).count() == 0


def test_caches_of_any_size_agree(spark, monkeypatch):
    """Caches that overflow at every chunk, and words too long to keep, change nothing."""
    from sievestone.llm import common

    texts = [t or "" for _, t, *_ in DOCUMENTS] + ODD
    want = [(len(PIECES.encode(t)), LIBRARY.encode_ordinary(t)) for t in texts]
    for module, name, value in ((token_counts, "KEPT", 3), (token_counts, "LONGEST", 2), (bpe, "KEPT", 3), (bpe, "LONGEST", 2), (bpe, "REPLAY_BYTES", 5), (common, "CHUNK_CHARS", 50)):
        monkeypatch.setattr(module, name, value)
    pieces, encoder = token_counts.Pieces(P.path("piece_bpe_32k.model")), bpe.Encoder(bpe.Replay(RANKS), P.PATTERN)
    for t, (n, ids) in zip(texts * 2, want * 2, strict=True):
        words = token_counts.pretokens(t)
        known = pieces.learn([words])
        assert sum(known[w] for w in words) == n
        assert np.frombuffer(encoder.encode([t])[0], "<u4").tolist() == ids
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_all(pa.array(texts)).to_pylist()] == [ids for _, ids in want]
    part = pa.array(["skipped"] + texts).slice(1)
    assert bpe.Decoder(RANKS).decode_all(encoder.encode_all(part).slice(2)).to_pylist() == [t.encode() for t in texts[2:]]


def test_whole_tables_are_the_libraries(spark):
    """Every document of sf0.1, in slices as tasks cut them, against both libraries."""
    from pyspark.sql import functions as F

    from sievestone.session import table

    docs = table(spark, "/root/testdata/sf0.1", "documents")
    rows = token_counts.token_counts(bpe.encode(docs, keep=("doc_id", "text")), keep=("doc_id", "text", "ids")).withColumn("ids", F.sha2("ids", 256)).collect()
    assert len(rows) == docs.count()
    texts = [r.text or "" for r in rows]
    assert [r.n_tokens for r in rows] == list(map(len, PIECES.encode(texts))) and [r.n_bytes for r in rows] == [len(t.encode()) for t in texts]
    assert [r.ids for r in rows] == [hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest() for x in LIBRARY.encode_ordinary_batch(texts)]


def test_ids_of_pieces(spark):
    pieces = token_counts.Pieces(P.path("piece_bpe_32k.model"), ids=True)
    for t in ODD + [t or "" for _, t, *_ in DOCUMENTS]:
        words = token_counts.pretokens(t)
        known = pieces.learn([words])
        assert np.frombuffer(b"".join(known[w] for w in words), "<u4").tolist() == PIECES.encode(t)


def test_encoding_of_odd_rows(spark):
    rows = bpe.decode(bpe.encode(clashing(documents(spark)))).collect()
    got = sorted(((r.doc_id, hashlib.sha256(r.ids).hexdigest(), bytes(r.decoded)) for r in rows), key=repr)
    want = sorted(((r[0], hashlib.sha256(np.array(LIBRARY.encode_ordinary(r[1] or ""), "<u4").tobytes()).hexdigest(), (r[1] or "").encode()) for r in DOCUMENTS), key=repr)
    assert got == want
    assert bpe.decode(bpe.encode(documents(spark, []))).count() == 0
