"""Language-model scoring with a log-frequency Bloom filter of quantised n-gram counts.

Counts of all n-grams (orders 1 to `ORDER`) of the training texts are gathered in hash buckets: a task packs its sorted
hashes and counts, a bucket's task adds them up. A count c becomes the level 1 + floor(log_BASE c), and the n-gram enters the
filter once for each level up to that. The buckets' filters, side by side, are the filter that is broadcast; probing levels
until the first miss gives back the level, and the mean count of the level stands for the count. Probabilities are smoothed
with a Dirichlet prior: p(w) = (c(w) + 1) / (N + V + 1), p(w | u) = (c(uw) + PRIOR * p(w)) / (c(u) + PRIOR), and so on.

The filter grows with the corpus and holds every n-gram. Up to `FILTER_BYTES` it is broadcast. Beyond, it stays in its buckets
and the questions go there: texts are put together in chunks, a chunk asks each bucket for the levels of its different n-grams,
and the answers come back to the chunk. Both ways probe the same bits and give the same scores. Exact token counts (for n_known and base_score) come from a join: the `HEAD` most frequent tokens
are broadcast, the other tokens of a document are joined to the table of counts by token.

Defined cases: null text is empty and has one token, its end; null ids and repeated rows are rows like any other; without
training rows every token is unknown; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import added, hashes_of, joined, mix, packed, picked, remainder_is, texts_of, unpacked, words_of, written

ORDER = 2
BASE = 1.5
PRIOR = 300.0
BITS = 8
PROBES = 6
FILTER_BYTES = 256 << 20
HEAD = 400_000
#: Different tokens that a task counts, and hashes that it holds, before it hands them on.
FLUSH_TOKENS, FLUSH_HASHES = 600_000, 4_000_000
#: N-grams of a bucket, about; tokens that are scored at a time.
BUCKET, SCORED = 4_000_000, 400_000
#: The least level that is remembered, and n-grams at which a task stops to remember more.
REMEMBERED, REMEMBERED_AT_MOST = 3, 1_000_000
BEGIN, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
_48 = np.uint64((1 << 48) - 1)


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> (token, n); the null token stands for the ends."""
    counts, ends = Counter(), 0

    def out() -> Iterator[pa.RecordBatch]:
        keys = list(counts)
        for at in range(0, len(keys), 50_000):
            part = keys[at : at + 50_000]
            yield pa.record_batch([pa.array(part, pa.binary()), pa.array([counts[k] for k in part], pa.int64())], names=["token", "n"])

    for batch in batches:
        ends += len(batch)
        for text in texts_of(batch.column(0)):
            counts.update(words_of(text))
            if len(counts) >= FLUSH_TOKENS:
                yield from out()
                counts = Counter()
    yield from out()
    yield pa.record_batch([pa.array([None], pa.binary()), pa.array([ends], pa.int64())], names=["token", "n"])


def grams(tokens: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each token, for each order. tokens: the begin, the words, the end."""
    out, last = [mix(tokens)[1:] & _48], tokens
    for _ in range(2, order + 1):
        last = joined(last[:-1], tokens[len(tokens) - len(last) + 1 :])
        out.append(mix(last) & _48)
    return out


def sequence(text: str | None) -> np.ndarray:
    return np.concatenate(([BEGIN], hashes_of(words_of(text)), [END]))


def _gathered(order: int, buckets: int):
    """Texts -> (bucket, packed n-gram counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                values, n = np.unique(np.concatenate(held), return_counts=True)
                of = (values % np.uint64(buckets)).astype(np.int64)
                at = np.argsort(of, kind="stable")
                edges = np.searchsorted(of[at], np.arange(buckets + 1))
                some = [k for k in range(buckets) if edges[k] < edges[k + 1]]
                blobs = [packed(values[at[edges[k] : edges[k + 1]]], n[at[edges[k] : edges[k + 1]]]) for k in some]
                yield pa.record_batch([pa.array(some, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "packed"])

        for batch in batches:
            for text in texts_of(batch.column(0)):
                tokens = sequence(text)
                mine = [mix(tokens[:1]) & _48, *grams(tokens, order)]  # the begin counts as a context
                held += mine
                size += sum(map(len, mine))
                if size >= FLUSH_HASHES:
                    yield from out()
                    held, size = [], 0
        yield from out()

    return run


def level_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(BASE) + 1e-9).astype(np.int64)


def _halves(hashes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of (n-gram, level); the filter bits are at one + k * two for each probe k."""
    e = mix(hashes + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64)))
    return e & np.uint64(0xFFFFFFFF), (e >> np.uint64(32)) | np.uint64(1)


def _filled(key, table):
    """A bucket's packed counts -> its filter: bucket, size, bits, sums, ns (count and number of n-grams by level)."""
    parts = [unpacked(x.as_py()) for x in table.column("packed")]
    hashes, counts = added(np.concatenate([h for h, _ in parts]), np.concatenate([c for _, c in parts]))
    levels = level_of(counts)
    size = max(64, BITS * int(levels.sum()) + 7 & ~7)
    bits = np.zeros(size, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        one, two = _halves(hashes[levels >= level], level)
        for k in range(PROBES):
            bits[(one + np.uint64(k) * two) % np.uint64(size)] = True
    top = int(levels.max(initial=0)) + 1
    sums, ns = np.bincount(levels, counts, top), np.bincount(levels, minlength=top)
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "size": pa.array([size], pa.int64()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()), "sums": pa.array([sums.tolist()], pa.list_(pa.float64())), "ns": pa.array([ns.tolist()], pa.list_(pa.int64()))})


class Filter:
    """The whole filter: the buckets' bits side by side."""

    def __init__(self, rows: list[tuple[int, int, bytes]], buckets: int, means: np.ndarray):
        self.buckets, self.means = buckets, means
        self.sizes, self.starts = np.full(buckets, 64, np.uint64), np.zeros(buckets, np.uint64)
        at, parts = 8, [bytes(8)]  # an empty bucket looks at 64 zeros
        for bucket, size, bits in rows:
            self.sizes[bucket], self.starts[bucket] = size, 8 * at
            parts.append(bits)
            at += len(bits)
        self.bits = np.frombuffer(b"".join(parts), np.uint8)

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        """About the count of each n-gram: its level's mean, 0 where no level is there."""
        return self.means[self.levels(hashes)]

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """The level of each n-gram: the last one before the first that misses. N-grams are probed bucket by bucket, so that the
        bits that are looked at lie near each other."""
        of = (hashes % np.uint64(self.buckets)).astype(np.uint16 if self.buckets <= 1 << 16 else np.int64)
        levels = np.zeros(len(hashes), np.uint8)
        at = np.argsort(of, kind="stable")
        of = of[at]
        asked, size, start = hashes[at], self.sizes[of], self.starts[of]
        for level in range(1, len(self.means)):
            one, two = _halves(asked, level)
            for k in range(PROBES):  # after each probe only those that hit go on
                place = (one + np.uint64(k) * two) % size + start
                hit = (self.bits[(place >> np.uint64(3)).view(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
                if not hit.all():
                    at, asked, one, two, size, start = at[hit], asked[hit], one[hit], two[hit], size[hit], start[hit]
            if not len(at):
                break
            levels[at] = level
        return levels


class Remembered:
    """A filter, with the levels of n-grams that were found often: these cost most probes and come again with each piece."""

    def __init__(self, held: Filter):
        self.held, self.means = held, held.means
        self.hashes, self.found = np.zeros(0, np.uint64), np.zeros(0, np.uint8)

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        return self.means[self.levels(hashes)]

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """As `Filter.levels`; hashes are sought once each."""
        if not len(self.hashes):
            levels = self.held.levels(hashes)
            fresh = levels >= REMEMBERED
        else:
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            levels = self.found[at]
            new = self.hashes[at] != hashes
            levels[new] = self.held.levels(hashes[new])
            fresh = new & (levels >= REMEMBERED)
        if len(self.hashes) < REMEMBERED_AT_MOST:
            both = np.concatenate((self.hashes, hashes[fresh]))
            by_hash = np.argsort(both, kind="stable")
            self.hashes, self.found = both[by_hash], np.concatenate((self.found, levels[fresh]))[by_hash]
        return levels


class Answers:
    """The levels of a chunk's different n-grams, as the buckets gave them; counts as a `Filter` has."""

    def __init__(self, hashes: np.ndarray, levels: np.ndarray, means: np.ndarray):
        self.hashes, self.levels, self.means = hashes, levels, means

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        return self.means[self.levels[np.searchsorted(self.hashes, hashes)]]


def log_probabilities(tokens: np.ndarray, distinct: tuple[np.ndarray, np.ndarray], docs: np.ndarray, held: Filter, order: int, n: int, v: int, prior: float = PRIOR) -> np.ndarray:
    """log10 p of each token but the begins. tokens: texts one after another, each from its begin to its end; distinct: the
    different tokens and the place of each token among them; docs: the text of each."""
    single = held.counts(mix(distinct[0]) & _48)[distinct[1]]
    p = (single + 1.0) / (n + v + 1.0)
    last, context = tokens, single
    for k in range(2, order + 1):
        last = joined(last[:-1], tokens[k - 1 :])
        inside = docs[k - 1 :] == docs[: len(docs) - k + 1]
        values, place = np.unique(mix(last[inside]) & _48, return_inverse=True)
        before, c = context[: len(last)], np.zeros(len(last))
        c[inside] = held.counts(values)[place]
        c = np.minimum(c, before)
        p[k - 1 :] = np.where(inside, (c + prior * p[k - 1 :]) / (before + prior), p[k - 1 :])
        context = c
    return np.log10(p)


KIND_OF_TAIL = pa.list_(pa.struct([("token", pa.binary()), ("n", pa.int64())]))


def laid_out(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Words of each text -> the tokens of all, lengths, the different tokens with the place of each token, the text of each."""
    tokens = np.concatenate([x for words in texts for x in ([BEGIN], hashes_of(words), [END])])
    lengths = np.array([len(words) + 2 for words in texts])
    return tokens, lengths, np.unique(tokens, return_inverse=True), np.repeat(np.arange(len(texts)), lengths)


def tails_of(texts: list[list[bytes]], starts: np.ndarray, place: np.ndarray, docs: np.ndarray, rare: np.ndarray) -> pa.Array:
    """Each text's different words at the positions `rare`, with how often they are there."""
    _, first, n = np.unique(docs[rare] * (int(place.max(initial=0)) + 1) + place[rare], return_index=True, return_counts=True)
    first = rare[first]
    of = docs[first]
    tokens = [texts[d][k] for d, k in zip(of.tolist(), (first - starts[of] - 1).tolist(), strict=True)]
    edges = np.searchsorted(of, np.arange(len(texts) + 1))
    rows = pa.StructArray.from_arrays([pa.array(tokens, pa.binary()), pa.array(n.astype(np.int64))], fields=list(KIND_OF_TAIL.value_type))
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), rows)


def scores_of(columns: list[pa.Array], texts: list[list[bytes]], held: Filter | Answers, head: np.ndarray, logs_of: np.ndarray, order: int, n: int, v: int) -> pa.RecordBatch:
    """row, doc_id, held_out and the words of their texts -> row, doc_id, held_out, n_tokens, known, base, score, tail.

    head: sorted hashes of the frequent tokens and of the end; logs_of: the log10 of each one's count + 1.
    """
    tokens, lengths, (distinct, place), docs = laid_out(texts)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    near = np.minimum(np.searchsorted(head, distinct), len(head) - 1)
    frequent = head[near] == distinct
    known = frequent[place]
    base = np.add.reduceat(np.where(frequent, logs_of[near], 0.0)[place], starts) - math.log10(n + v + 1.0) * (lengths - 1)
    n_known = np.add.reduceat(known.astype(np.int64), starts)
    known[starts] = known[starts + lengths - 1] = True  # begin and end are no words
    tails = tails_of(texts, starts, place, docs, np.flatnonzero(~known))
    logs = log_probabilities(tokens, (distinct, place), docs, held, order, n, v)
    logs[starts] = 0.0  # the begin is given
    return pa.record_batch(
        [*columns, pa.array(lengths - 1), pa.array(n_known), pa.array(base), pa.array(np.add.reduceat(logs, starts)), tails],
        names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "tail"],
    )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """(row, doc_id, held_out, text) in parts of about `SCORED` tokens, with the words of their texts."""
    for batch in batches:
        at = 0
        while at < len(batch):
            texts, size, first = [], 0, at
            while at < len(batch) and size < SCORED:
                texts.append(words_of(batch.column(3)[at].as_py()))
                size += len(texts[-1])
                at += 1
            yield batch.slice(first, at - first), texts


def _scored(shared, order: int, n: int, v: int):
    """(row, doc_id, held_out, text) -> the columns of scores_of, by the broadcast filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, head, logs_of = shared.value
        held = Remembered(held)
        for part, texts in _pieces(batches):
            yield scores_of(part.columns[:3], texts, held, head, logs_of, order, n, v)

    return run


class Questions:
    """Takes the place of a filter to learn which n-grams a chunk asks for."""

    def __init__(self) -> None:
        self.asked: list[np.ndarray] = []

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        self.asked.append(hashes)
        return np.zeros(len(hashes))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, doc_id, held_out, text) -> the same with the chunk: the row of its first text."""
    for part, _ in _pieces(batches):
        chunk = pa.array(np.full(len(part), part.column(0)[0].as_py()), pa.int64())
        yield pa.record_batch([chunk, *part.columns], names=["chunk", *part.schema.names])


def questions_of(texts: list[list[bytes]], buckets: int, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different n-grams that these texts ask for, by bucket; the buckets, and where each one's n-grams begin."""
    tokens, _, distinct, docs = laid_out(texts)
    questions = Questions()
    log_probabilities(tokens, distinct, docs, questions, order, 0, 0)
    hashes = np.unique(np.concatenate(questions.asked))
    of = (hashes % np.uint64(buckets)).astype(np.int64)
    at = np.argsort(of, kind="stable")
    return hashes[at], *np.unique(of[at], return_index=True)


def _asked(buckets: int, order: int):
    """(chunk, row, text) -> (chunk, part, bucket, packed): the different n-grams that a part of a chunk asks each bucket for.

    A chunk's texts follow one another. Two tasks may read one in parts; a part is named by the row of its first text.
    """

    def ask(chunk: int, part: int, texts: list[list[bytes]]) -> pa.RecordBatch:
        hashes, some, firsts = questions_of(texts, buckets, order)
        blobs = [packed(x, np.zeros(len(x))) for x in np.split(hashes, firsts[1:])]
        return pa.record_batch([pa.array([chunk] * len(some), pa.int64()), pa.array([part] * len(some), pa.int64()), pa.array(some), pa.array(blobs, pa.binary())], names=["chunk", "part", "bucket", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, texts = None, None, []
        for batch in batches:
            for chunk, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2))):
                if texts and chunk != now:
                    yield ask(now, first, texts)
                    texts = []
                if not texts:
                    now, first = chunk, row
                texts.append(words_of(text))
        if texts:
            yield ask(now, first, texts)

    return run


def _answered(buckets: int, means: np.ndarray):
    """A bucket's questions and its filter -> (chunk, part, bucket, levels): the levels in the order of the n-grams."""

    def run(key, asked, bucket):
        held = Filter([(r["bucket"], r["size"], r["bits"]) for r in bucket.to_pylist()], buckets, means)
        blobs = [zstandard.compress(held.levels(unpacked(x.as_py())[0]).astype(np.uint8).tobytes(), 1) for x in asked.column("packed")]
        return pa.table({"chunk": asked.column("chunk"), "part": asked.column("part"), "bucket": asked.column("bucket"), "levels": pa.array(blobs, pa.binary())})

    return run


def _scored_chunk(shared, buckets: int, means: np.ndarray, order: int, n: int, v: int):
    """A chunk and its answers -> the columns of scores_of."""

    def run(key, chunk, answers):
        head, logs_of = shared.value
        chunk, answers, out = chunk.combine_chunks().sort_by("row"), answers.sort_by([("part", "ascending"), ("bucket", "ascending")]), []
        parts = answers.column("part").to_numpy()
        edges = np.append(np.searchsorted(chunk.column("row").to_numpy(), np.unique(parts)), len(chunk))
        for part, at, end in zip(np.unique(parts), edges, edges[1:]):
            rows = chunk.slice(at, end - at).combine_chunks()
            texts = [words_of(x) for x in texts_of(rows.column("text"))]
            hashes, _, _ = questions_of(texts, buckets, order)
            mine = answers.column("levels").filter(pa.array(parts == part))
            levels = np.concatenate([np.frombuffer(zstandard.decompress(x.as_py()), np.uint8) for x in mine])
            by_hash = np.argsort(hashes)
            columns = [rows.column(name).chunk(0) for name in ("row", "doc_id", "held_out")]
            out.append(scores_of(columns, texts, Answers(hashes[by_hash], levels[by_hash].astype(np.int64), means), head, logs_of, order, n, v))
        return pa.Table.from_batches(out)

    return run


def train(texts: DataFrame, tokens: int, order: int = ORDER) -> tuple[DataFrame, int, np.ndarray, int]:
    """texts: one column; tokens: how many there are in all, about. -> the buckets' filters (bucket, size, bits), how many
    buckets there are, the mean count of each level, the bytes of all filters."""
    buckets = max(8, -(-tokens * order // BUCKET))
    parts = texts.mapInArrow(_gathered(order, buckets), "bucket long, packed binary")
    filters = written(parts.groupBy("bucket").applyInArrow(_filled, "bucket long, size long, bits binary, sums array<double>, ns array<long>"), "filters")
    by_level = filters.select(F.posexplode(F.arrays_zip("sums", "ns")).alias("level", "x")).groupBy("level").agg(F.sum("x.sums").alias("c"), F.sum("x.ns").alias("n"))
    found = {r["level"]: r["c"] / max(r["n"], 1) for r in by_level.collect()}  # one row a level
    means = np.array([found.get(k, 0.0) for k in range(max(found, default=0) + 1)])
    return filters.select("bucket", "size", "bits"), buckets, means, (filters.agg(F.sum("size")).first()[0] or 0) // 8


def lm_scores(docs: DataFrame, held_out: Callable[[Column], Column], id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    held_out: from the id's column to whether the row is held out.
    """
    context = docs.sparkSession.sparkContext
    texts = picked(docs, doc_id=id_col, text=text_col).withColumn("held_out", held_out(F.col("doc_id")))
    training = texts.filter("not held_out").select("text")
    counts = training.mapInArrow(_token_counts, "token binary, n long").groupBy("token").agg(F.sum("n").alias("c"))
    counts = written(counts.filter("c > 0"), "token-counts")
    n, v, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.max(F.when(F.col("token").isNull(), F.col("c"))), F.lit(0))).first()
    filters, buckets, means, size = train(training, n, order)

    level = F.floor(F.log2("c") * 8).cast("int")
    words = counts.filter("token is not null")
    left, edge = HEAD, 0
    for r in sorted(words.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        left -= r["count"]
        if left < 0:
            edge = r["level"] + 1
            break
    top = words.filter(level >= edge).toArrow()
    hashes = np.concatenate((hashes_of(top.column("token").to_pylist()), [END]))
    logs = np.log10(np.concatenate((top.column("c").to_numpy(), [ends])) + 1.0)
    if not ends:  # nothing is known without training texts
        hashes[-1] = 0
    by_hash = np.argsort(hashes)
    hashes, logs = hashes[by_hash], logs[by_hash]

    rows = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    kind = dict(rows.dtypes)["doc_id"]
    out = f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, score double, tail array<struct<token: binary, n: long>>"
    if size <= filter_bytes:
        whole = Filter([(r["bucket"], r["size"], r["bits"]) for r in filters.toArrow().to_pylist()], buckets, means)
        scored = rows.mapInArrow(_scored(context.broadcast((whole, hashes, logs)), order, n, v), out)
    else:
        chunks = written(rows.mapInArrow(_chunks, f"chunk long, row long, doc_id {kind}, held_out boolean, text string"), "chunks")
        asked = chunks.select("chunk", "row", "text").mapInArrow(_asked(buckets, order), "chunk long, part long, bucket long, packed binary")
        answers = asked.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(_answered(buckets, means), "chunk long, part long, bucket long, levels binary")
        scored = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_scored_chunk(context.broadcast((hashes, logs)), buckets, means, order, n, v), out)
    scored = written(scored, "scored")
    rest = words.filter(level < edge).withColumnRenamed("token", "word")
    found = scored.select("row", F.inline("tail")).join(rest, F.col("token") == F.col("word"))
    sums = found.groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + F.lit(1.0))).alias("add")).withColumnRenamed("row", "of")
    return scored.drop("tail").join(sums, F.col("row") == F.col("of"), "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("add", F.lit(0.0))).alias("base_score"),
        "score",
    )


def held_out(key: Column) -> Column:
    return remainder_is(key, 7, 2)


__all__ = ["Filter", "held_out", "lm_scores", "train"]
