"""Token counts under a sentencepiece BPE model, by pre-token.

Pieces of the model never hold a space mark after another character, so no merge crosses the place
before a run of space marks: a text falls into pre-tokens (a run of marks and what follows up to the
next one) whose pieces don't depend on what stands around them.

In each task, the distinct pre-tokens of a chunk of documents (found by Arrow, without a Python string for each
occurrence) are counted once by the library and kept for later chunks; each document's pre-token frequencies are
joined to those counts and summed, so no document's ids are ever made.  The join stays inside the
task: dealing (document, pre-token) pairs out by pre-token would shuffle several times the
input's size, and a corpus's vocabulary has no bound that would allow a broadcast.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievestone.llm.common import map_rows
from sievestone.session import table

MODEL, LIMIT = "piece_bpe_32k.model", 4096
#: Pre-tokens kept in a task, and the longest that is kept.
KEPT, LONGEST = 400_000, 64
_GROUP = re.compile(" *[^ ]+| +$")


def model_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pretokens(text: str) -> list[str]:
    """The text's pre-tokens, each without its first space mark (which the library puts before it).

    Empty text: none.  The mark U+2581 in a text is a space, as to the library.
    """
    if not text:
        return []
    if "▁" in text:
        text = text.replace("▁", " ")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [x[1:] for x in _GROUP.findall(" " + text)]


class Pieces:
    """Each pre-token's number of ids, or the ids as bytes, computed once for each distinct one."""

    def __init__(self, model: str, ids: bool = False):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        self.known: dict = {}
        self.long: list[str] = []
        self.measure = (lambda x: array("I", x).tobytes()) if ids else len  # of 4 bytes each, as numpy's uint32

    def learn(self, split: list) -> dict:
        """A mapping that holds all the pre-tokens of the given collections, for use until the next call."""
        known = self.known
        for w in self.long:
            del known[w]
        distinct = split[0] if len(split) == 1 else set().union(*split)
        new = [w for w in distinct if w not in known]  # a difference of sets would go through all that is known
        if len(known) + len(new) > KEPT:
            known.clear()
            new = distinct
        # A lone space mark has an id of its own, but the library gives none for an empty text.
        words = [w for w in new if w]
        known.update(zip(words, map(self.measure, self.library.encode(words, num_threads=1)), strict=True))
        if len(words) < len(new):
            known[""] = self.measure([self.library.piece_to_id("▁")])
        self.long = list({w for w in words if len(w) > LONGEST})
        return known


def split_pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the pre-tokens of all texts, the number of the text that each is of).

    Texts without two spaces in a row, a space at an end or a space mark fall at their spaces; the others are taken one by one.
    """
    plain = pc.invert(pc.match_substring_regex(texts, "^ |  | $|\u2581|^$")).to_numpy(zero_copy_only=False)
    split = pc.split_pattern(texts.filter(pa.array(plain)), " ")
    lists = [pretokens(texts[i].as_py()) for i in np.flatnonzero(~plain).tolist()]
    sizes = np.append(np.asarray(pc.list_value_length(split)), np.array(list(map(len, lists)), dtype=np.int64)).astype(np.int64)
    document = np.repeat(np.append(np.flatnonzero(plain), np.flatnonzero(~plain)), sizes)
    return pa.concat_arrays([split.flatten(), pa.array([w for x in lists for w in x], texts.type)]), document


def _make(model: str):
    def make():
        pieces = Pieces(model)

        def work(texts: pa.Array) -> dict:
            texts = pc.fill_null(texts, "")
            words, owner = split_pieces(texts)
            coded = words.dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            known = pieces.learn([distinct])
            counts = np.fromiter(map(known.__getitem__, distinct), dtype=np.int64, count=len(distinct))
            # Each document's pre-tokens and their frequencies, joined to the counts.
            place = owner * max(1, len(distinct)) + coded.indices.to_numpy()
            place, frequency = np.unique(place, return_counts=True)
            document, word = np.divmod(place, max(1, len(distinct)))
            totals = np.bincount(document, weights=frequency * counts[word], minlength=len(texts)) if len(place) else np.zeros(len(texts))
            return {"n_bytes": pc.binary_length(texts).cast(pa.int64()), "n_tokens": totals.astype(np.int64)}

        return work

    return make


def token_counts(docs: DataFrame, text: str = "text", keep: tuple = ("doc_id",), model: str | None = None) -> DataFrame:
    """The columns `keep`, n_bytes (UTF-8) and n_tokens of each row's whole text; null counts as empty: 0 and 0.

    Repeated rows have a row each, an empty table gives none, and extra columns may have any name.
    """
    return map_rows(docs, text, "n_bytes bigint, n_tokens bigint", _make(model or model_path(MODEL)), list(keep), arrow=True)


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    """n_bytes, n_tokens and over_limit of every row of `documents`."""
    return token_counts(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
