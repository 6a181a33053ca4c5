"""Token counts without materialising ids.

Each document's pre-token frequencies are joined to piece counts that are made
once per distinct pre-token. The most frequent pre-tokens (``frequent`` at most,
none longer than 64 bytes, so their table has a fixed bound) are counted once
and broadcast; the rest meet by a shuffle on the pre-token, where each distinct one is counted once
a task, and their sums return to the documents by a second, partially aggregated one. Of the
rest those up to 64 bytes are no hot keys, as they aren't frequent; longer ones may be, so
their documents are dealt to all tasks.

Defined results: a null or empty text has no tokens; every row is counted for
itself, also when ids repeat or are null; empty tables give no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytelevel import PATTERN, byte_level, words
from .store import stored

LONGEST_SHARED = 64


class ByteLevelCounter:
    """Pre-tokens of the byte-level pattern."""

    def __init__(self, path: str):
        import regex

        self.encoder = byte_level(path)
        self.find = regex.compile(PATTERN).findall
        specials = sorted(self.encoder.specials, key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, specials))).split if specials else None
        self.seen: dict[str, tuple[str, ...]] = {}

    def frequencies(self, text: str) -> Counter:
        """Pre-token -> how often; special strings are counted under None."""
        out: Counter = Counter()
        parts = [text]
        if self.encoder.has_special(text):
            parts = self.cut(text)
            out[None] += len(parts) - 1
        for part in parts:
            if not part:
                continue
            first, *rest = words(part)
            out.update(self.find(first))
            for word, n in Counter(rest).items():
                found = self.seen.get(word)
                if found is None:
                    found = tuple(self.find(" " + word))
                    if len(self.seen) < 200_000 and len(word) <= 64:
                        self.seen[word] = found
                for x in found:
                    out[x] += n
        return out

    def pieces(self, pretokens: list[str]) -> list[int]:
        return [len(x.ids) for x in self.encoder.library.encode_batch_fast(pretokens, add_special_tokens=False)]


class WholeTextCounter:
    """Other vocabularies (.json of another kind, or .model): the whole text is its only pre-token."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._pieces = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            library.no_truncation()
            library.no_padding()
            self._pieces = lambda texts: [len(x.ids) for x in library.encode_batch_fast(texts, add_special_tokens=False)]

    def frequencies(self, text: str) -> Counter:
        return Counter([text]) if text else Counter()

    def pieces(self, pretokens: list[str]) -> list[int]:
        return self._pieces(pretokens)


@lru_cache(maxsize=4)
def counter(path: str) -> ByteLevelCounter | WholeTextCounter:
    if path.endswith(".json"):
        try:
            return ByteLevelCounter(path)
        except ValueError:
            pass
    return WholeTextCounter(path)


def _task_counts(path: str):
    """Pre-tokens met twice or more between two flushes, with their counts: none that is frequent in the whole is missing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, total = counter(path), Counter()

        def flush() -> pa.RecordBatch:
            kept = [(k, n) for k, n in total.items() if n > 1 and k is not None and len(k.encode()) <= LONGEST_SHARED]
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["pretoken", "n"])

        for b in batches:
            for text in b.column(0):
                total.update(c.frequencies(text.as_py() or ""))
                if len(total) > 400_000:
                    yield flush()
        yield flush()

    return run


def frequent_pieces(docs: DataFrame, path: str, frequent: int) -> dict[str, int]:
    """Piece counts of at most ``frequent`` pre-tokens, by falling frequency; the cut is found from a histogram of counts."""
    counted = stored(docs.select(F.col("text").cast("string")).mapInArrow(_task_counts(path), "pretoken string, n bigint").groupBy("pretoken").agg(F.sum("n").alias("n")), "pretokens")
    step = F.floor(F.log2("n") * 8)
    least, total = None, 0
    for level, n in counted.groupBy(step.alias("level")).count().orderBy(F.desc("level")).collect():
        if total + n > frequent:
            break
        least, total = level, total + n
    if least is None:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counter(path).pieces(b.column(0).to_pylist()), pa.int32())], ["pretoken", "pieces"])

    table = counted.filter(step >= least).select("pretoken").mapInArrow(run, "pretoken string, pieces int").toArrow()
    return dict(zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True))


def count_tokens(docs: DataFrame, path: str, frequent: int = 200_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_pieces(docs, path, frequent))
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id"), F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("bigint").alias("n_bytes"), F.col("text").cast("string").alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document with what the shared table counts, and one for each other pre-token of it."""
        c, known = counter(path), shared.value
        for b in batches:
            rids = b.column(0).to_pylist()
            sums, rest_rid, rest_token, rest_n = [], [], [], []
            for rid, text in zip(rids, b.column(3), strict=True):
                total = 0
                for k, n in c.frequencies(text.as_py() or "").items():
                    pieces = 1 if k is None else known.get(k)
                    if pieces is None:
                        rest_rid.append(rid)
                        rest_token.append(k)
                        rest_n.append(n)
                    else:
                        total += pieces * n
                sums.append(total)
            n, m = len(rids), len(rest_rid)
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([b.column(0), pa.array(rest_rid, pa.int64())]), pa.concat_arrays([b.column(1), pa.nulls(m, b.column(1).type)]), pa.concat_arrays([b.column(2).cast(pa.int64()), pa.nulls(m, pa.int64())]), pa.concat_arrays([pa.nulls(n, pa.string()), pa.array(rest_token, pa.string())]), pa.array(sums + rest_n, pa.int64())],
                ["rid", "doc_id", "n_bytes", "pretoken", "n"],
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``n`` becomes tokens: rows with a pre-token meet its piece count, made once for each distinct one."""
        c, done = counter(path), {None: 1}
        for b in batches:
            tokens = b.column(3).to_pylist()
            new = list({t for t in tokens if t not in done})
            if len(done) + len(new) > 1_000_000:
                done = {None: 1}
                new = list({t for t in tokens if t is not None})
            done.update(zip(new, c.pieces(new), strict=True))
            n = [done[t] * k for t, k in zip(tokens, b.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64())], ["rid", "doc_id", "n_bytes", "n"])

    rows = base.mapInArrow(spread, f"rid bigint, doc_id {kind}, n_bytes bigint, pretoken string, n bigint")
    # Rows with the documents' own sums go by row; long pre-tokens, of which any may be hot (dividers, data), by row as well, over as many tasks as there are.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_row = F.when(F.octet_length("pretoken") > LONGEST_SHARED, F.pmod(F.xxhash64("rid"), F.lit(tasks))).otherwise(0)
    met = rows.repartition(F.when(F.col("pretoken").isNull(), F.xxhash64("rid")).otherwise(F.xxhash64("pretoken", by_row)))
    sums = met.mapInArrow(count, f"rid bigint, doc_id {kind}, n_bytes bigint, n bigint")
    return sums.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens")).drop("rid")
