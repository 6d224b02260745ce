"""Quality rules: how public tokenisers take a text, held against bands for its language or script.

Four measures of each whole text, under two vocabularies: with the sentencepiece one with byte fallback,
code points in words per token, the share of byte-fallback ids, and the entropy of the token ids over
its maximum, log2 of the number of tokens; with the byte-level one for many languages, code points per
token again, each word taken by itself after a space.  Each measure gets a band for each group: fences
beyond the measure's quartiles, in multiples of their distance over all documents of the
group, and wider for short texts, whose measures vary more: by MIN_WORDS over the number of
words.  A group whose quartiles coincide takes the distance over all groups; where that is
nothing too, the measure rejects nothing.  Only the sides that mean trouble reject: too few
or too many characters per token, too much byte fallback, too little entropy.  Of a group whose measure
is spread normally, a fence at 2 distances rejects 1 in 2,700 on its side, one at 2.5 1 in 39,000 and one at 3 1 in
850,000; what lies beyond is of another kind than the group.

A group is the text's language code where that is two or three letters (at most
18,252 of them), else its most frequent script, so the bands are a table of proven
size.  Groups of fewer than GROUP_ROWS documents take the bands over all.  Quartiles come from histograms of
fixed cells, counted with map-side combining over every document; they don't depend on the order of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievestone.llm.bpe import ranks_path, read_ranks
from sievestone.llm.common import free_name, gathered, map_rows, repeated_ids, repeated_lines
from sievestone.llm.token_counts import MODEL, Pieces, model_path, split_pieces
from sievestone.session import table, written

MIN_WORDS, MAX_REPEAT_SHARE = 50, 50
#: (measure, cells in one, fence below and above in distances of the quartiles; None: that side doesn't reject)
MEASURES = (("chars_per_token", 1000, 2.5, 3.0), ("chars_per_token_multi", 1000, 2.5, 3.0), ("byte_share", 10000, None, 3.0), ("token_entropy", 1000, 2.0, None))
#: Documents with at least MIN_WORDS words that a group needs for bands of its own; smaller ones share those of all.
GROUP_ROWS = 20
SYMBOLS = "#*$%&|<>"
#: The byte-level vocabulary, and how many words a task keeps counts of, and the longest that is kept.
RANKS, KEPT, LONGEST = "byte_bpe_multi_50k.tiktoken", 400_000, 64
#: Bytes of text that are measured at once; several numbers are held for each token.
CHUNK = 2_000_000
#: First code points of blocks and the scripts that they hold.
SCRIPTS = ((0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "indic"), (0x0E00, "thai"), (0x1100, "hangul"), (0x1E00, "latin"), (0x3040, "kana"), (0x3400, "han"), (0xAC00, "hangul"), (0xD800, "other"))
SCHEMA = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_tokens bigint, n_tokens_multi bigint, chars_per_token double, chars_per_token_multi double, byte_share double, token_entropy double, script string"


def script_of(text: str) -> str:
    """The script with most letters; ties to the first in SCRIPTS, none: other."""
    if text.isascii():
        return "latin" if any(map(str.isalpha, text[:1000])) or any(map(str.isalpha, text)) else "other"
    codes = np.frombuffer("".join(filter(str.isalpha, text)).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if not len(codes):
        return "other"
    counts = np.bincount(np.searchsorted([a for a, _ in SCRIPTS], codes, side="right"), minlength=len(SCRIPTS) + 1)
    totals: dict[str, int] = {}
    for n, (_, name) in zip(counts[1:], SCRIPTS, strict=True):
        totals[name] = totals.get(name, 0) + int(n)
    return max(totals, key=totals.get)


class WordTokens:
    """How many tokens of a byte-level vocabulary each word has after a space; counted once for each distinct word."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        self.library = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
        self.known: dict[str, int] = {}
        self.long: list[str] = []
        self.feed = self.library.encode_ordinary("\n")[0]

    def _tokens(self, words: list[str]) -> list[int]:
        """Each word's tokens after a space.  Words go to the library together, with line feeds between, which are tokens of their own."""
        out = np.zeros(len(words), dtype=np.int64)
        plain = [i for i, w in enumerate(words) if not (w[0].isspace() or w[-1].isspace())]
        for i in range(0, len(plain), 50_000):
            part = plain[i : i + 50_000]
            ids = np.array(self.library.encode_ordinary(" " + "\n ".join([words[j] for j in part])), dtype=np.int64)
            out[part] = np.diff(np.append(np.flatnonzero(ids == self.feed), len(ids)), prepend=-1) - 1
        for i in set(range(len(words))).difference(plain) if len(plain) < len(words) else ():
            out[i] = len(self.library.encode_ordinary(" " + words[i]))
        return out.tolist()

    def learn(self, distinct: list[str]) -> dict[str, int]:
        """A mapping that holds all the words, for use until the next call."""
        known = self.known
        for w in self.long:
            del known[w]
        new = [w for w in distinct if w not in known]
        if len(known) + len(new) > KEPT:
            known.clear()
            new = distinct
        known.update(zip(new, self._tokens(new), strict=True))
        self.long = [w for w in new if len(w) > LONGEST]
        return known


def _make(model: str, ranks: str):
    def make():
        pieces = Pieces(model, ids=True)
        size = pieces.library.get_piece_size()
        is_byte = np.array([pieces.library.is_byte(i) for i in range(size)])
        multi = WordTokens(ranks)

        def ids_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            """(the piece ids of all texts, the number of the text that each is of)."""
            words, owner = split_pieces(texts)
            coded = words.dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            values = list(map(pieces.learn([distinct]).__getitem__, distinct))
            counts = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // 4
            place = coded.indices.to_numpy()
            ids, _ = gathered(np.frombuffer(b"".join(values), dtype="<u4"), (np.cumsum(counts) - counts)[place], counts[place])
            return ids, np.repeat(owner, counts[place])

        def entropies(ids: np.ndarray, owner: np.ndarray, n: np.ndarray) -> np.ndarray:
            """Of the ids of each text, over log2 of their number; one id has 1."""
            pairs, counts = np.unique(owner * size + ids, return_counts=True)
            total = np.bincount(pairs // size, weights=counts * np.log2(counts), minlength=len(n))
            bits = np.log2(np.maximum(n, 2))
            return np.where(n > 1, (bits - total / np.maximum(n, 1)) / bits, 1.0)

        def work(texts: pa.Array) -> dict:
            texts = pc.fill_null(texts, "")
            plain, rows = texts.to_pylist(), len(texts)
            ids, owner = ids_of(texts)
            n = np.bincount(owner, minlength=rows)
            some = n > 0
            split = pc.ascii_split_whitespace(texts)
            sizes = np.asarray(pc.list_value_length(split)).astype(np.int64)
            words, of = split.flatten(), np.repeat(np.arange(rows), sizes)
            full = np.asarray(pc.binary_length(words)) > 0  # blanks at an end leave an empty word there
            coded, of = words.filter(pa.array(full)).dictionary_encode(), of[full]
            distinct, place = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
            counts = np.fromiter(map(multi.learn(distinct).__getitem__, distinct), dtype=np.int64, count=len(distinct))
            lengths = np.asarray(pc.utf8_length(coded.dictionary)).astype(np.int64)
            n_words = np.bincount(of, minlength=rows)
            m, chars = (np.bincount(of, weights=x[place], minlength=rows).astype(np.int64) for x in (counts, lengths))
            ends = np.cumsum(n_words)
            ratio = lambda a, b: [float(x) if ok else None for x, ok in zip(a / np.maximum(b, 1), b > 0, strict=True)]
            entropy = entropies(ids, owner, n)
            return {
                "n_words": n_words, "word_chars": chars, "n_symbols": [sum(map(t.count, SYMBOLS)) for t in plain], "n_dup_lines": [repeated_lines(t)[1] for t in plain],
                "n_repeat_words": [repeated_ids(place[b - k : b], len(distinct)) for b, k in zip(ends.tolist(), n_words.tolist(), strict=True)], "n_tokens": n, "n_tokens_multi": m,
                "chars_per_token": ratio(chars, n), "chars_per_token_multi": ratio(chars, m), "byte_share": ratio(np.bincount(owner, weights=is_byte[ids], minlength=rows), n),
                "token_entropy": [float(x) if ok else None for x, ok in zip(entropy, some, strict=True)], "script": [script_of(t) for t in plain],
            }

        return work

    return make


def measured(docs: DataFrame, text: str = "text", lang: str | None = "lang", keep: tuple = ("doc_id",), model: str | None = None, ranks: str | None = None, into: str = "measures") -> DataFrame:
    """The columns `keep` and a struct `into` of the measures, the group and base_failed."""
    source = docs.select(*[docs[f"`{c}`"].alias(f"__keep{i}") for i, c in enumerate(keep)], (docs[f"`{lang}`"] if lang else F.lit(None).cast("string")).alias("__lang"), docs[f"`{text}`"].alias("__text"))
    rows = map_rows(source, "__text", SCHEMA, _make(model or model_path(MODEL), ranks or ranks_path(RANKS)), [c for c in source.columns if c != "__text"], arrow=True, chunk=CHUNK)
    code = F.lower(F.col("__lang"))
    group = F.when(code.rlike("^[a-z]{2,3}$"), code).otherwise(F.concat(F.lit("script:"), F.col("script")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_SHARE * F.col("n_words"))
    fields = [F.col(x.split()[0]) for x in SCHEMA.split(", ")]
    return rows.select(*[F.col(f"__keep{i}").alias(c) for i, c in enumerate(keep)], F.struct(*fields, group.alias("grp"), failed.alias("base_failed")).alias(into))


def bands(measures: DataFrame, into: str = "measures") -> DataFrame:
    """(grp, and for each measure _low, _high, its quartiles, and _spread, their distance, null where they coincide) from the documents that pass the base rules; grp null: over all groups."""
    rows = measures.filter(~F.col(into)["base_failed"]).select(f"{into}.*")
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.round(F.col(name) * per).cast("bigint").alias("cell")) for i, (name, per, *_) in enumerate(MEASURES)]))
    by_group = rows.select("grp", cells.alias("x")).groupBy("grp", "x.m", "x.cell").agg(F.count("*").alias("n"))
    both = by_group.union(by_group.groupBy(F.lit(None).cast("string").alias("grp"), "m", "cell").agg(F.sum("n").alias("n")))
    order = Window.partitionBy("grp", "m").orderBy("cell")  # as many rows as a histogram has cells
    ranked = both.withColumn("upto", F.sum("n").over(order)).withColumn("total", F.sum("n").over(Window.partitionBy("grp", "m")))
    quartile = lambda q: F.min(F.when(F.col("upto") >= F.col("total") * q, F.col("cell")))
    found = ranked.groupBy("grp", "m").agg(quartile(0.25).alias("q1"), quartile(0.75).alias("q3"), F.first("total").alias("total")).filter((F.col("total") >= GROUP_ROWS) | F.col("grp").isNull())
    ends = []
    for i, (name, per, *_) in enumerate(MEASURES):
        own = lambda c, i=i: F.max(F.when(F.col("m") == i, c))
        ends += [own(F.col("q1") / per).alias(f"{name}_low"), own(F.col("q3") / per).alias(f"{name}_high"), own(F.nullif(F.col("q3") - F.col("q1"), F.lit(0)) / per).alias(f"{name}_spread")]
    return found.groupBy("grp").agg(*ends)


def judged(measures: DataFrame, into: str = "measures", verdict: str = "kept") -> DataFrame:
    """The rows of `measures` and a boolean: false where base rules failed or a measure lies outside its band."""
    table_ = written(bands(measures, into))
    names = [c for c in table_.columns if c != "grp"]
    own = F.broadcast(table_.filter("grp is not null").select(F.col("grp").alias("__grp"), F.struct(*names).alias("__own")))
    every = table_.filter("grp is null").first()
    joined = measures.join(own, F.col(into)["grp"] == F.col("__grp"), "left")
    inside = F.lit(True)
    wider = 1 + MIN_WORDS / F.greatest(F.col(into)["n_words"], F.lit(1))
    for name, _, below, above in MEASURES:
        low, high, spread = (F.coalesce(F.col("__own")[f"{name}_{end}"], F.lit(every and every[f"{name}_{end}"]).cast("double")) for end in ("low", "high", "spread"))
        value = F.col(into)[name]
        if below is not None:
            inside = inside & F.coalesce(value >= low - below * spread * wider, F.lit(True))
        if above is not None:
            inside = inside & F.coalesce(value <= high + above * spread * wider, F.lit(True))
    return joined.withColumn(verdict, ~F.col(into)["base_failed"] & inside).drop("__grp", "__own")


def quality_rules(docs: DataFrame, text: str = "text", lang: str | None = "lang", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and the measures, for every row of `docs`.

    A null or empty text has no words, fails the base rules and has null measures.
    Repeated rows each have their row and count each in the bands; an empty table gives no rows.  Extra columns may have any name.
    """
    rows = judged(written(measured(docs, text, lang, (doc_id,))))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return rows.select(doc_id, *[f"measures.{c}" for c in base], "kept", *[f"measures.{c}" for c in ("n_tokens", "n_tokens_multi", "chars_per_token", "chars_per_token_multi", "byte_share", "token_entropy", "grp")])


def keep_by_rules(docs: DataFrame, text: str = "text", lang: str | None = "lang") -> DataFrame:
    """The rows of `docs` that the rules keep, with their columns.

    Null and empty texts fail the base rules and go.  Repeated rows are judged each; an empty table gives no rows, and extra columns may have
    any name.
    """
    into, verdict = free_name(docs, "__measures"), free_name(docs, "__kept")
    lang = lang if lang in docs.columns else None
    rows = judged(written(measured(docs, text, lang, tuple(docs.columns), into=into)), into, verdict)
    return rows.filter(F.col(verdict)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_tokeniser_fertility(spark, sf_dir: str) -> DataFrame:
    """The base counts, base_failed, kept and the measures of every row of `documents`."""
    return quality_rules(table(spark, sf_dir, "documents"))
