"""Language-model scores of documents.

Two models learn from the training documents: add-one word unigrams, whose
counts cover every word, and prediction by partial matching (PPM): a trie of byte
contexts up to ``order`` bytes, escape method C, symbol exclusion. All its counts
stay in a stored table. As a fast path, the ``nodes`` most frequent contexts are broadcast
as a trie, which decides positions whose whole context it holds. The other positions' cells
(context and symbol) are counted by text, meet the training counts with the same last 3 context
bytes by a shuffle, are scored there from all contexts, and go back by a shuffle join. Contexts
of fewer than 3 bytes are broadcast whole; the alphabet bounds them, not the corpus. Texts end with
a symbol of their own, byte 0xFF, which UTF-8 never holds; contexts of first bytes are padded with it.

Words are counted by 64-bit hash. Frequent words (``frequent`` at most) are
looked up in a broadcast table; the others, none of which is a hot key, meet their
counts by a shuffle join.

Defined results: a null or empty text is the end symbol alone; a null id counts as
training and isn't held out; rows are scored each for itself; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .frequent import at_most
from .store import stored

END = 0xFF
_WORD, _CELL = 0, 1
_GROUP = 3  # rare contexts are dealt by so many of their last bytes


def fold(doc_id: str | Column, k: int) -> Column:
    """crc32 of the id as text, modulo k."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % k if isinstance(doc_id, str) else F.crc32(doc_id.cast("string").cast("binary")) % k


def padded(s: tv.Slice, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased bytes with an end symbol after each text and padding before it; first position and one past the end symbol of each text."""
    gap = max(order, 1)
    n = len(s.data) + gap * (s.n + 1)
    out = np.full(n, END, np.uint8)
    at = np.arange(len(s.data)) + gap * (1 + np.repeat(np.arange(s.n), np.diff(s.off)))
    out[at] = tv.LOWER[s.data]
    first = s.off[:-1] + gap * (1 + np.arange(s.n))
    return out, np.stack([first, first + np.diff(s.off) + 1])


def predicted(span: np.ndarray, n: int) -> np.ndarray:
    """Mask of the positions whose symbol is predicted: texts and their end symbols."""
    step = np.zeros(n + 1, np.int8)
    step[span[0]] = 1
    np.subtract.at(step, span[1], 1)
    return np.cumsum(step[:n], dtype=np.int8).astype(bool)


def cells(data: np.ndarray, mask: np.ndarray, order: int) -> np.ndarray:
    """For each predicted position its context and symbol, as one number of order + 1 bytes."""
    at = np.flatnonzero(mask)
    key = np.zeros(len(at), np.uint64)
    for k in range(order, -1, -1):
        key = (key << np.uint64(8)) | data[at - k].astype(np.uint64)
    return key


@dataclass
class Trie:
    """Node 0 is the empty context; ``child[node, symbol]`` extends it to the left (-1: not kept); ``log10p[node, symbol]``."""

    order: int
    symbol: np.ndarray  # byte -> symbol number; 0 for bytes never seen
    child: np.ndarray
    log10p: np.ndarray
    whole: int = 0  # nodes from here on are contexts of ``order`` bytes

    def place(self, data: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """The node of the longest kept context at each predicted position."""
        at = np.flatnonzero(mask)
        sym = self.symbol[data]
        width = self.child.shape[1]
        child, node = self.child.ravel(), np.zeros(len(at), np.int32)
        live = np.arange(len(at))
        for k in range(1, self.order + 1):
            got = child[node[live] * width + sym[at[live] - k]]
            more = got >= 0
            if not more.all():
                live, got = live[more], got[more]
            node[live] = got
        return node

    def score(self, data: np.ndarray, mask: np.ndarray, node: np.ndarray | None = None) -> np.ndarray:
        """log10 probability at each predicted position."""
        node = self.place(data, mask) if node is None else node
        return self.log10p.ravel()[node * self.child.shape[1] + self.symbol[data[mask]]].astype(np.float64)


def build_trie(order: int, levels: list[tuple[np.ndarray, np.ndarray]]) -> Trie:
    """levels[k]: cells (context of k bytes, symbol) of the kept contexts, and their counts."""
    seen = np.unique(np.concatenate([c & np.uint64(255) for c, _ in levels[:1]])).astype(np.int64) if len(levels) else np.zeros(0, np.int64)
    symbol = np.zeros(256, np.int32)
    symbol[seen] = np.arange(1, len(seen) + 1)
    width, unseen = len(seen) + 1, 256 - len(seen)
    contexts = [np.unique(c >> np.uint64(8)) if k else np.zeros(1, np.uint64) for k, (c, _) in enumerate(levels)] or [np.zeros(1, np.uint64)]
    first = np.concatenate([[0], np.cumsum([len(c) for c in contexts])])
    total = int(first[-1])
    count = np.zeros((total, width), np.float32)
    parent = np.zeros(total, np.int64)
    child = np.full((total, width), -1, np.int32)
    for k, (c, n) in enumerate(levels):
        if len(c):
            node = first[k] + np.searchsorted(contexts[k], c >> np.uint64(8) if k else np.zeros(len(c), np.uint64))
            count[node, symbol[(c & np.uint64(255)).astype(np.int64)]] = n
        if k and len(contexts[k]):
            here = contexts[k]
            shorter = here & np.uint64((1 << 8 * (k - 1)) - 1)
            parent[first[k] : first[k + 1]] = first[k - 1] + np.searchsorted(contexts[k - 1], shorter)
            child[parent[first[k] : first[k + 1]], symbol[(here >> np.uint64(8 * (k - 1))).astype(np.int64)]] = np.arange(first[k], first[k + 1])
    depth = np.concatenate([np.full(len(c), k) for k, c in enumerate(contexts)])
    weight = np.ones(width)
    weight[0] = unseen  # symbol 0 stands for every byte never seen
    out = np.empty((total, width), np.float32)
    for a in range(0, total, 8192):
        node = np.arange(a, min(total, a + 8192))
        p = np.zeros((len(node), width))
        open_ = np.ones((len(node), width), bool)  # not excluded yet
        escape = np.ones(len(node))
        going = np.ones(len(node), bool)
        for _ in range(int(depth[node].max()) + 1):
            c = np.where(open_, count[node], 0) * going[:, None]
            t, d = c.sum(1), (c > 0).sum(1)
            whole = np.maximum(t + d, 1)
            p += escape[:, None] * c / whole[:, None]
            escape = np.where(d > 0, escape * d / whole, escape)
            open_ &= c == 0
            going &= depth[node] > 0
            node = np.where(going, parent[node], node)
        rest = (open_ * weight).sum(1)
        p += np.where(open_, (escape / np.maximum(rest, 1))[:, None], 0)
        none_left = rest == 0
        p[none_left] /= (1 - escape[none_left])[:, None]
        out[a : a + len(node)] = np.log10(np.maximum(p, 1e-300))
    return Trie(order, symbol, child, out, int(first[-2]))


@dataclass
class Level:
    """Cells of contexts of one length and their counts; contexts, their totals and numbers of symbols, and the total of these symbols after the context one byte shorter."""

    cell: np.ndarray
    n: np.ndarray
    context: np.ndarray
    total: np.ndarray
    symbols: np.ndarray
    shorter: np.ndarray


def _low(x: np.ndarray, n: int) -> np.ndarray:
    """The last n bytes."""
    return x & np.uint64((1 << 8 * n) - 1)


def _find(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted table, and whether x is there."""
    if not len(table):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return at, table[at] == x


def level(k: int, cell: np.ndarray, n: np.ndarray, below: Level | None) -> Level:
    """cell: numbers of k + 1 bytes, repeated or not; below: the level of k - 1, which holds all their suffixes."""
    cell, at = np.unique(cell, return_inverse=True)
    n = np.bincount(at, n, len(cell))
    context, at = np.unique(cell >> np.uint64(8), return_inverse=True)
    shorter = np.zeros(len(cell))
    if below is not None and len(cell):
        shorter = below.n[_find(below.cell, _low(cell, k))[0]]
    sums = lambda w: np.bincount(at, w, len(context))
    return Level(cell, n, context, sums(n), sums(None).astype(np.float64), sums(shorter))


def exact_log10(asked: np.ndarray, levels: list[Level]) -> np.ndarray:
    """log10 probability of cells of len(levels) bytes from all counts; as ``build_trie``, but for the asked cells alone."""
    p, escape, done = np.zeros(len(asked)), np.ones(len(asked)), np.zeros(len(asked), bool)
    out_total, out_symbols = np.zeros(len(asked)), np.zeros(len(asked))  # excluded
    for k in range(len(levels) - 1, -1, -1):
        x = levels[k]
        if not len(x.cell):
            continue
        at, met = _find(x.context, _low(asked >> np.uint64(8), k))
        cell, has = _find(x.cell, _low(asked, k + 1))
        t, d = np.where(met, x.total[at] - out_total, 0), np.where(met, x.symbols[at] - out_symbols, 0)
        whole = np.maximum(t + d, 1)
        hit = met & has & ~done
        p = np.where(hit, escape * x.n[cell] / whole, p)
        done |= hit
        escape = np.where(d > 0, escape * d / whole, escape)
        out_total, out_symbols = np.where(met, x.shorter[at], 0), np.where(met, x.symbols[at], 0)
    rest = 256 - len(levels[0].cell)
    p = np.where(done, p, escape / max(rest, 1)) if rest else p / (1 - escape)
    return np.log10(np.maximum(p, 1e-300))


def adaptive_log10(text: str, order: int = 4) -> float:
    """PPM that starts empty and learns from the text as it goes (counts at all orders, method C, exclusion)."""
    data = bytes([END] * order) + tv.LOWER[np.frombuffer(text.encode(), np.uint8)].tobytes() + bytes([END])
    counts: dict[bytes, dict[int, int]] = {}
    total = 0.0
    for i in range(order, len(data)):
        s, out, p = data[i], set(), 1.0
        for k in range(order, -1, -1):
            c = {x: n for x, n in counts.get(data[i - k : i], {}).items() if x not in out}
            if not c:
                continue
            whole = sum(c.values()) + len(c)
            if s in c:
                p *= c[s] / whole
                break
            p *= len(c) / whole
            out |= c.keys()
        else:
            p /= 256 - len(out)
        total += np.log10(p)
        for k in range(order + 1):
            c = counts.setdefault(data[i - k : i], {})
            c[s] = c.get(s, 0) + 1
    return float(total)


def _task_counts(order: int):
    def give(kind: int, c: tv.Counts) -> pa.RecordBatch:
        keys, n = c.take()
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int8)), pa.array(tv.signed(keys)), pa.array(n.astype(np.int64))], ["kind", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {_WORD: tv.Counts(), _CELL: tv.Counts()}
        for b in batches:
            for s in tv.slices(b.column(0)):
                held[_WORD].add(tv.Words(s, lower=True).hash)
                data, span = padded(s, order)
                held[_CELL].add(cells(data, predicted(span, len(data)), order))
                for kind, c in held.items():
                    if c.full():
                        yield give(kind, c)
        for kind, c in held.items():
            yield give(kind, c)

    return run


@dataclass
class Model:
    trie: Trie
    train_tokens: int
    distinct: int
    end_count: int
    words: np.ndarray
    counts: np.ndarray
    short: list[Level]
    cells: DataFrame | None  # key, n of all training cells; stays with the driver


def _column(table: pa.Table, name: str, kind=np.int64) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False).astype(kind)


def learn(train: DataFrame, order: int = 5, nodes: int = 100_000, frequent: int = 500_000) -> tuple[Model, DataFrame]:
    """The model, and the counts (key, n) of every training word."""
    counted = stored(train.select(F.col("text").cast("string")).mapInArrow(_task_counts(order), "kind tinyint, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n")), "lm-counts")
    words, cell = counted.filter(F.col("kind") == _WORD).select("key", "n"), counted.filter(F.col("kind") == _CELL)
    texts = train.count()
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = at_most(words, "n", frequent)
    shared = words.filter(F.col("n") >= least).toArrow()

    mask = lambda k: F.lit((1 << 8 * (k + 1)) - 1)
    per_order = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("key").bitwiseAND(mask(k)).alias("cell")) for k in range(order + 1)])).alias("x")
    by_order = stored(cell.select(per_order, "n").groupBy("x.k", "x.cell").agg(F.sum("n").alias("n")), "lm-cells").withColumn("context", F.shiftright("cell", 8))
    contexts = by_order.groupBy("k", "context").agg(F.sum("n").alias("total"))
    # A shorter suffix is met at least as often, so whatever the bound a kept context's suffixes are kept.
    enough = at_most(contexts, "total", nodes)
    kept = contexts.filter((F.col("total") >= enough) | (F.col("k") == 0)).select("k", "context")
    got = by_order.join(F.broadcast(kept), ["k", "context"], "left_semi").select("k", "cell", "n").toArrow()
    k, c, n = _column(got, "k"), _column(got, "cell", np.uint64), _column(got, "n")
    trie = build_trie(order, [(c[k == i], n[k == i]) for i in range(order + 1)])
    few = by_order.filter(F.col("k") < min(_GROUP, order)).select("k", "cell", "n").toArrow()
    k, c, n = _column(few, "k"), _column(few, "cell", np.uint64), _column(few, "n")
    short: list[Level] = []
    for i in range(min(_GROUP, order)):
        short.append(level(i, c[k == i], n[k == i], short[-1] if short else None))
    return Model(trie, int(total) + texts, int(distinct) + (texts > 0), texts, _column(shared, "key").view(np.uint64), _column(shared, "n"), short, cell.select("key", "n")), words


def _scored_cells(order: int, shared):
    """Batches (suffix, key, n) in order of the suffix, the last ``_GROUP`` context bytes; n is null for cells asked for. Gives key and value, the log10 probability."""

    def give(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        asked = np.isnan(n)
        asked, key, n = key[asked], key[~asked], n[~asked]
        levels = list(shared.value.short)
        for k in range(len(levels), order + 1):
            levels.append(level(k, _low(key, k + 1), n, levels[-1] if levels else None))
        return pa.RecordBatch.from_arrays([pa.array(asked.astype(np.int64)), pa.array(exact_log10(asked, levels))], ["key", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for b in batches:
            held.append([b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.uint64), b.column(2).to_numpy(zero_copy_only=False).astype(np.float64)])
            if sum(len(x[0]) for x in held) > 300_000:
                suffix, key, n = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.searchsorted(suffix, suffix[-1]))  # the last suffix may go on
                if cut:
                    yield give(key[:cut], n[:cut])
                held = [[suffix[cut:], key[cut:], n[cut:]]]
        if held:
            _, key, n = (np.concatenate(x) for x in zip(*held, strict=True))
            yield give(key, n)

    return run


def _times(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, row), and how often each occurs."""
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])])) if len(key) else np.zeros(0, np.int64)
    return key[first], row[first], np.diff(np.append(first, len(key)))


def score(docs: DataFrame, model: Model, words: DataFrame) -> DataFrame:
    """doc_id, held_out's input columns left to the caller: n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(replace(model, cells=None))
    base = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.col("text").cast("string").alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    whole = model.train_tokens + model.distinct + 1
    lowest = -float(np.log10(whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        table = tv.HashTable(m.words)
        log_of = np.log10(m.counts + 1.0) + lowest
        for b in batches:
            for s in tv.slices(b.column(2)):
                w = tv.Words(s, lower=True)
                at = table.find(w.hash)
                known = at >= 0
                n_known = np.bincount(w.row[known], minlength=s.n) + (m.end_count > 0)
                sums = np.bincount(w.row[known], log_of[at[known]], s.n) + np.log10(m.end_count + 1.0) + lowest
                data, span = padded(s, m.trie.order)
                mask = predicted(span, len(data))
                node = m.trie.place(data, mask)
                decided = node >= m.trie.whole
                p = np.zeros(len(data) + 1)
                p[:-1][mask] = np.where(decided, m.trie.score(data, mask, node), 0)
                p = np.add.reduceat(p, span.T.ravel())[::2] if s.n else p[:0]
                of = np.repeat(np.arange(s.n), span[1] - span[0])
                rare, row, times = _times(w.hash[~known], w.row[~known])
                cell, cell_row, cell_times = _times(cells(data, mask, m.trie.order)[~decided], of[~decided])
                sort = np.repeat(np.array([_WORD, _CELL], np.int8), [len(rare), len(cell)])
                rare, row, times = np.concatenate([rare, cell]), np.concatenate([row, cell_row]), np.concatenate([times, cell_times])
                rid = b.column(0).slice(s.first, s.n)
                k = len(rare)
                none = lambda t, k=k: pa.nulls(k, t)
                some = lambda x, t, k=k: pa.concat_arrays([pa.array(x, t), none(t)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([rid, rid.take(pa.array(row))]),
                        pa.concat_arrays([b.column(1).slice(s.first, s.n), none(b.column(1).type)]),
                        some(w.count + 1, pa.int64()),
                        some(n_known, pa.int64()),
                        some(sums, pa.float64()),
                        some(p, pa.float64()),
                        pa.concat_arrays([pa.nulls(s.n, pa.int64()), pa.array(tv.signed(rare))]),
                        pa.concat_arrays([pa.nulls(s.n, pa.int64()), pa.array(times.astype(np.int64))]),
                        pa.concat_arrays([pa.nulls(s.n, pa.int8()), pa.array(sort)]),
                    ],
                    ["rid", "doc_id", "n_tokens", "n_known", "base_score", "score", "key", "times", "kind"],
                )

    schema = f"rid bigint, doc_id {kind}, n_tokens bigint, n_known bigint, base_score double, score double, key bigint, times bigint, kind tinyint"
    rows = stored(base.mapInArrow(run, schema), "lm-rows")
    order = model.trie.order
    asked = rows.filter(F.col("kind") == _CELL).select("key").distinct()
    both = model.cells.select("key", "n").unionByName(asked.withColumn("n", F.lit(None).cast("bigint")))
    dealt = both.select(F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * _GROUP) - 1)).alias("suffix"), "key", "n").repartition("suffix").sortWithinPartitions("suffix")
    scored = dealt.mapInArrow(_scored_cells(order, shared), "key bigint, value double")
    values = words.select(F.lit(_WORD).cast("tinyint").alias("kind"), "key", F.col("n").cast("double").alias("value")).unionByName(scored.select(F.lit(_CELL).cast("tinyint").alias("kind"), "key", "value"))
    # A row without a word gets a kind and a key of its own, so it has no value.
    met = rows.withColumn("key", F.coalesce("key", F.xxhash64("rid"))).withColumn("kind", F.coalesce("kind", F.lit(2).cast("tinyint"))).join(values, ["kind", "key"], "left")
    word, c = F.col("kind") == _WORD, F.coalesce("value", F.lit(0.0))
    return (
        met.groupBy("rid")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("n_tokens").alias("n_tokens"),
            (F.max("n_known") + F.coalesce(F.sum(F.when(word & (c > 0), F.col("times"))), F.lit(0))).alias("n_known"),
            F.lit(model.train_tokens).cast("bigint").alias("train_tokens"),
            (F.max("base_score") + F.coalesce(F.sum(F.when(word, F.col("times") * (F.log10(c + 1.0) + lowest))), F.lit(0.0))).alias("base_score"),
            (F.max("score") + F.coalesce(F.sum(F.when(F.col("kind") == _CELL, F.col("times") * F.col("value"))), F.lit(0.0))).alias("score"),
        )
        .drop("rid")
    )
