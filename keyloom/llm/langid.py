"""Language identification by compression.

For each language a raw-content zstandard dictionary holds the words of a bounded sample of labelled texts, the most frequent
last, where a reference to them is shortest. A text's letters are encoded with every dictionary, in blocks (so that a long text
can't become its own dictionary), and the language whose dictionary gives the fewest bytes wins; where that is close, a slower
encoder's bytes are added. `score` is the winner's share when each language weighs 2 ** -(its bytes beyond the fewest). A text
is `rejected` where the margin to the runner-up is narrow, under `MIN_MARGIN` bytes or under `MIN_SHARE` of the winner's encoded
bytes, or where there is no letter. (On held-out labelled rows of the test tables the margin is a quarter of the encoded bytes in
the median and 0.08 at the first percentile, texts that repeat one word included; texts in none of the languages stay under
0.02, halves of two languages are at 0.016 in the median, and every wrong prediction is a tie.)

The sample is the one bounded part: for each language the `SAMPLE_ROWS` different texts of least hash, each read whole. Learning
uses text and lang only. A dictionary holds `DICT_BYTES` of words, so the rarest may not fit. Every document is classified over
its whole text.

Defined cases: null text, empty text and text without a letter give `und`, score 0 and rejected; ties go to the language first
by code point (and are rejected); without any labelled row every text is `und`; a label whose texts hold no letter is never
predicted; other columns of any name are ignored; null or repeated ids are rows like any other, equal texts are learnt once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import by_position, named_again, picked, remainder_is, texts_of, written

SAMPLE_ROWS = 400
#: Hashes are taken up to this many times the share that would give the sample, so that it is full in spite of the estimate.
SPARE = 3
DICT_BYTES = 256 * 1024
BLOCK = 1024
MIN_MARGIN, MIN_SHARE = 1, 0.03
#: Below this margin in bytes the text is encoded again, with matches from three bytes and an exhaustive parser, and both sizes count.
CLOSE = 4
UNKNOWN = "und"
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")


def prepared(text: str) -> bytes:
    """Lower-case words of letters, a space before, between and after; empty if there is no letter."""
    words = _NOT_LETTERS.sub(" ", text.lower()).strip()
    return f" {words} ".encode() if words else b""


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, word, n) of each text; a word beyond a block is as long as a block."""
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
            n = Counter(w[:BLOCK] for w in prepared(text or "").split())
            yield pa.record_batch([pa.array([lang] * len(n), pa.string()), pa.array(list(n), pa.binary()), pa.array(n.values(), pa.int64())], names=["lang", "word", "n"])


def learn(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """(text, lang) -> a dictionary's content for each language."""
    rows = labelled.filter("lang is not null and text is not null").select("lang", "text", F.xxhash64(F.lit("langid"), "text").alias("at"))
    # A row for each language, so it is small where the languages are; its size as a file decides how it is joined.
    sizes = written(rows.groupBy("lang").agg(F.approx_count_distinct("at").alias("n")), "languages").withColumnRenamed("lang", "of")
    near = F.shiftrightunsigned("at", 11) / F.lit(float(1 << 53)) < SPARE * sample_rows / F.col("n")
    some = rows.join(sizes, F.col("lang") == F.col("of")).filter(near).groupBy("lang", "at").agg(F.min("text").alias("text"))
    least = F.row_number().over(Window.partitionBy("lang").orderBy("at")) <= sample_rows
    sample = some.withColumn("least", least).filter("least").select("lang", "text")
    counts = sample.mapInArrow(_words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy("lang").orderBy(F.col("n").desc(), "word").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = counts.withColumn("size", F.sum(F.octet_length("word") + 1).over(upto)).filter(F.col("size") <= dict_bytes).collect()
    out: dict[str, bytes] = {}
    for lang in sorted({r.lang for r in held}):
        words = sorted((r["n"], bytes(r.word)) for r in held if r.lang == lang)
        content = b" " + b" ".join(w for _, w in words) + b" "
        out[lang] = content * -(-8 // len(content))  # the encoder takes no dictionary under eight bytes
    return out


def classifier(dictionaries: dict[str, bytes], block: int = BLOCK) -> Callable[[str | None], tuple[str, float, int, bool]]:
    """text -> (language, score, margin in bytes, rejected)."""
    params = zstandard.ZstdCompressionParameters(window_log=19, hash_log=18, chain_log=18, search_log=2, min_match=4, target_length=16, strategy=zstandard.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0)
    finest = zstandard.ZstdCompressionParameters(window_log=19, hash_log=18, chain_log=19, search_log=6, min_match=3, target_length=256, strategy=zstandard.STRATEGY_BTULTRA2, write_content_size=0, write_checksum=0, write_dict_id=0)

    def encoders_with(p: zstandard.ZstdCompressionParameters) -> list[tuple[str, zstandard.ZstdCompressor]]:
        out = []
        for lang, content in sorted(dictionaries.items()):
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=p)
            out.append((lang, zstandard.ZstdCompressor(dict_data=held, compression_params=p)))
        return out

    encoders, closer = encoders_with(params), encoders_with(finest)

    def classify(text: str | None) -> tuple[str, float, int, bool]:
        data = prepared(text) if text else b""
        if not data or not encoders:
            return UNKNOWN, 0.0, 0, True
        blocks = [data[k : k + block] for k in range(0, len(data), block)]
        sizes = [(sum(len(e.compress(b)) for b in blocks), lang) for lang, e in encoders]
        if len(sizes) > 1 and sorted(sizes)[1][0] - min(sizes)[0] < CLOSE:
            sizes = [(n + sum(len(e.compress(b)) for b in blocks), lang) for (n, lang), (_, e) in zip(sizes, closer, strict=True)]
        least, lang = min(sizes)
        margin = sorted(sizes)[1][0] - least if len(sizes) > 1 else least
        score = 1 / sum(2.0 ** -min(n - least, 60) for n, _ in sizes)
        return lang, score, margin, margin < max(MIN_MARGIN, MIN_SHARE * least)

    return classify


def _run(dictionaries: dict[str, bytes], carried: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches whose last column is the text -> the other columns with lang_pred, score, margin, rejected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = classifier(dictionaries)
        for batch in batches:
            found = [classify(x) for x in texts_of(batch.column(carried))]
            cols = list(zip(*found, strict=True)) if found else [[], [], [], []]
            arrays = [batch.column(k) for k in range(carried)] + [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.bool_())]
            yield pa.record_batch(arrays, names=[*batch.schema.names[:carried], "lang_pred", "score", "margin", "rejected"])

    return run


def identify(docs: DataFrame, held_out: Callable[[Column], Column], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, margin, rejected; learns from labelled rows not held out.

    held_out: from the id's column to whether the row is held out.
    """
    slim = picked(docs, doc_id=id_col, text=text_col, lang=lang_col).withColumn("held_out", held_out(F.col("doc_id")))
    dictionaries = learn(slim.filter("not held_out").select("text", "lang"))
    rows = slim.select("doc_id", "held_out", "text")
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_run(dictionaries, 2), f"doc_id {kind}, held_out boolean, lang_pred string, score double, margin long, rejected boolean")


def accepted(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that the classifier, learnt from all labelled rows, doesn't reject; all their columns."""
    dictionaries = learn(picked(docs, text=text_col, lang=lang_col))
    rows, at = by_position(docs), docs.columns.index(text_col)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = classifier(dictionaries)
        for batch in batches:
            keep = pa.array([not classify(x)[3] for x in texts_of(batch.column(at))], pa.bool_())
            yield pa.record_batch(batch.filter(keep).columns, names=names)

    return named_again(rows.mapInArrow(run, rows.schema), docs)


def held_out(key: Column) -> Column:
    return remainder_is(key, 4, 2)
