"""Operators on training data against plain versions, round trips and held-out accuracy."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pathspace.llm import bytelevel, fingerprint, jaccard, lm, packing, pieces, pii, quality, queries, store, tokens, toxicity, urls
from pathspace.llm import textvec as tv
from pathspace.llm.components import components

DATA = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [(1, None, "en"), (2, "", "en"), (3, " \n\t ", "en"), (4, "one two", "en"), (4, "one two", "en"), (None, "one two", "en"), (5, "a b c d e f " * 400 + "x" * 3000, "en"), (6, "Ünïcode 日本語 ▁ <|endoftext|>   é", "en"), (7, "line one\nline one\n\nline two", "en")]


def words(t):
    return WORD.findall((t or "").translate(LOW))


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and long texts, repeated rows, and a column whose name clashes with results."""
    return spark.createDataFrame([(i, t, g, 9) for i, t, g in EDGE], "doc_id long, text string, lang string, score int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


# --- 6


def base_counts(t):
    t = t or ""
    w = WORD.findall(t)
    at = collections.defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    again = {j for x in at.values() if len(x) > 1 for i in x for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again)


def test_quality_counts(spark, docs, edge):
    for df in (docs.select("doc_id", "text"), edge.filter("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text")):
        text = {r.doc_id: r.text for r in df.collect()}
        for r in quality.quality(df).collect():
            n = base_counts(text[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
            assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0]) and not (r.base_failed and r.kept)


def test_quality_verdicts_follow_the_labels(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas().set_index("doc_id").quality
    got = quality.quality(df).toPandas().set_index("doc_id").join(labels, how="inner")
    clean = got[(got.quality == 1) & ~got.base_failed]
    assert clean.kept.mean() > 0.97 and got[got.quality == 0].kept.mean() < 0.1


def test_verdicts_are_those_of_plain_em(spark, docs, edge):
    """Expectation-maximisation document by document, votes from the counts in plain arithmetic."""
    both = docs.select("doc_id", "text").unionByName(edge.select(F.col("doc_id") + 100_000, "text").toDF("doc_id", "text"))
    rows = quality.count_features(both, ["doc_id"]).toPandas()
    got = quality.quality(both).toPandas()
    vote = lambda bad, good=False: -1 if bad else 1 if good else 0
    votes = []
    for r in rows.itertuples():
        w, letters, lines = max(r.n_words, 1), max(r.n_letters, 1), max(r.n_lines, 1)
        latin = 5 * r.n_beyond <= r.n_letters
        size = r.word_chars / w
        votes.append([
            vote(r.n_symbols / w > 0.2), vote(r.n_upper / letters > 0.4), vote(r.n_marks / w > 0.5), vote(r.n_dup_lines / lines > 0.35), vote(r.n_repeat_words / w > 0.4), vote(r.n_stutter / w > 0.3),
            vote(r.n_words >= 20 and latin and r.n_stop / w < 0.06, r.n_stop / w >= 0.12), vote(latin and (size < 2.5 or size > 9), 3.5 <= size <= 6.5),
        ])
    votes = np.array(votes)
    start = {1: {-1: 0.02, 0: 0.48, 1: 0.50}, 0: {-1: 0.40, 0: 0.40, 1: 0.20}}
    theta, share, post = {(k, c, v): start[c][v] for k in range(8) for c in (0, 1) for v in (-1, 0, 1)}, 0.85, np.zeros(len(votes))
    for _ in range(200):
        good, bad = (np.array([(share if c else 1 - share) * math.prod(theta[k, c, v] for k, v in enumerate(x)) for x in votes]) for c in (1, 0))
        new = good / (good + bad)
        done, post = np.abs(new - post).max() < 1e-9, new
        if done:
            break
        for c, p in ((1, post), (0, 1 - post)):
            for k in range(8):
                n = {v: p[votes[:, k] == v].sum() + 20 * start[c][v] for v in (-1, 0, 1)}
                for v in n:
                    theta[k, c, v] = n[v] / sum(n.values())
        share = (post.sum() + 20 * 0.85) / (len(votes) + 20)
    want = sorted(zip(rows.doc_id.fillna(-1), np.round(post, 6), strict=True))
    assert [(i, pytest.approx(p, abs=2e-6)) for i, p in want] == sorted(zip(got.doc_id.fillna(-1), np.round(got.quality_probability, 6), strict=True))
    assert (got.kept == (~got.base_failed & (got.quality_probability >= 0.5))).all()


def test_rules_abstain_beyond_the_latin_script(spark):
    rows = [(1, "это длинный текст на другом языке который хороший и не имеет ни одного слова из списка потому что он русский совсем да"), (2, "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore magna aliqua enim minim veniam quis nostrud ullamco"), (3, "ÄÖÜ ДОМ ΩΑ abc")]
    r = {x.doc_id: x for x in quality.count_features(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).select("*", quality.rules()["stop_words"].alias("vote")).collect()}
    assert r[1].vote == 0 and r[2].vote == -1 and (r[3].n_upper, r[3].n_letters, r[3].n_beyond) == (8, 11, 5)


def test_filters_keep_columns_and_rows(spark, edge):
    assert quality.keep_good(edge).columns == edge.columns
    assert quality.quality(edge.limit(0)).count() == 0


# --- 5


def brute_segments(x):
    """All maximal segments by their definition: split at the best one (without a beginning or end that adds nothing) and go on to its left and right."""

    def best(a, b):
        top = max(((sum(x[i:j]), i, -j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
        if top[0] <= 0:
            return []
        i, j = top[1], -top[2]
        return best(a, i) + [(i, j, top[0])] + best(j, b)

    return best(0, len(x))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([-3, -2, -1, 1, 2, 3, 5]), max_size=14))
def test_maximal_segments(x):
    assert sum(s for _, _, s in toxicity.maximal_segments(x)) == sum(s for _, _, s in brute_segments(x))
    assert max([s for _, _, s in toxicity.maximal_segments(x)], default=0) == max([s for _, _, s in brute_segments(x)], default=0)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 14), st.integers(0, 2**31))
def test_maximal_segments_lie_where_they_must(n, seed):
    x = np.random.default_rng(seed).normal(-0.2, 1, n).tolist()  # no ties
    assert [(a, b, pytest.approx(v)) for a, b, v in brute_segments(x)] == sorted(toxicity.maximal_segments(x))


def test_evidence_is_never_capped():
    x = toxicity.bent(np.array([0.0, 1.0, 20.0, 40.0, 80.0]))
    assert x[0] == 0 and (np.diff(x) > 0.9).all() and abs(x[1] - 1) < 0.03


def test_toxicity_on_held_out_documents(spark, edge):
    d = "/root/testdata/sf0.1"
    got = queries.op5_toxic_segments(spark, d).toPandas().merge(spark.read.parquet(f"{d}/labels.parquet").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.held_out == held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert (held.predicted == held.toxic).mean() > 0.97 and held[held.toxic == 0].predicted.mean() < 0.02
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(edge, none).count() == len(EDGE)


# --- 9


def test_word_model(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    train = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 7 != 2]
    c = collections.Counter(w for r in train for w in [*words(r.text), None])
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in queries.op9_ppm_scores(spark, DATA).collect()}
    for r in rows:
        w = [*words(r.text), None]
        x = got[r.doc_id]
        assert (x.n_tokens, x.n_known, x.train_tokens) == (len(w), sum(c[a] > 0 for a in w), n)
        assert x.base_score == pytest.approx(sum(math.log10((c[a] + 1) / (n + v + 1)) for a in w), rel=1e-9)


def test_trie_is_a_distribution_and_matches_plain_ppm():
    texts = ["abracadabra", "abra", "cadaver", "é ab"]
    order = 3
    s = next(tv.slices(pa.array(texts)))
    data, span = lm.padded(s, order)
    mask = lm.predicted(span, len(data))
    levels = []
    key = lm.cells(data, mask, order)
    for k in range(order + 1):
        levels.append(np.unique(key & np.uint64((1 << 8 * (k + 1)) - 1), return_counts=True))
    trie = lm.build_trie(order, levels)
    counts = collections.defaultdict(collections.Counter)
    for t in texts:
        b = b"\xff" * order + t.encode() + b"\xff"
        for i in range(order, len(b)):
            for k in range(order + 1):
                counts[b[i - k : i]][b[i]] += 1

    def plain(context, sym):
        out, p = set(), 1.0
        for k in range(order, -1, -1):
            c = {x: n for x, n in counts.get(context[len(context) - k :], {}).items() if x not in out}
            if c:
                if sym in c:
                    return p * c[sym] / (sum(c.values()) + len(c))
                p *= len(c) / (sum(c.values()) + len(c))
                out |= c.keys()
        return p / (256 - len(out))

    for context in (b"abr", b"xab", b"\xff\xff\xff", b"zzz"):
        assert sum(plain(context, x) for x in range(256)) == pytest.approx(1)
    new = ["abrazz", "", "q"]
    s = next(tv.slices(pa.array(new)))
    data, span = lm.padded(s, order)
    mask = lm.predicted(span, len(data))
    got = trie.score(data, mask)
    want = [math.log10(plain((b"\xff" * order + t.encode() + b"\xff")[i : i + order], (b"\xff" * order + t.encode() + b"\xff")[i + order])) for t in new for i in range(len(t.encode()) + 1)]
    assert got == pytest.approx(want, abs=1e-4)
    assert lm.adaptive_log10("abababababababab") / 17 > lm.adaptive_log10("abcdefgh") / 9


@pytest.mark.parametrize("nodes", [0, 30, 100_000])
def test_scores_use_all_contexts_whatever_the_trie(spark, nodes):
    train, new, order = ["abracadabra abracadabra", "abra cadaver", "é ab", "cadabra"], ["abracadaver", "", "zé abra", "abracadabra abracadabra"], 5
    counts = collections.defaultdict(collections.Counter)
    for t in train:
        b = b"\xff" * order + t.encode() + b"\xff"
        for i in range(order, len(b)):
            for k in range(order + 1):
                counts[b[i - k : i]][b[i]] += 1

    def plain(context, sym):
        out, p = set(), 1.0
        for k in range(order, -1, -1):
            c = {x: n for x, n in counts.get(context[order - k :], {}).items() if x not in out}
            if c:
                if sym in c:
                    return p * c[sym] / (sum(c.values()) + len(c))
                p *= len(c) / (sum(c.values()) + len(c))
                out |= c.keys()
        return p / (256 - len(out))

    table = lambda x: spark.createDataFrame(list(enumerate(x)), "doc_id long, text string")
    model, words_ = lm.learn(table(train), nodes=nodes)
    for r in lm.score(table(new), model, words_).collect():
        b = b"\xff" * order + new[r.doc_id].encode() + b"\xff"
        assert r.score == pytest.approx(sum(math.log10(plain(b[i - order : i], b[i])) for i in range(order, len(b))), abs=1e-3)


def test_scores_of_odd_rows(spark, edge, docs):
    model, table = lm.learn(docs)
    assert lm.score(edge, model, table).count() == len(EDGE)
    empty, none = lm.learn(edge.limit(0))
    assert lm.score(edge, empty, none).count() == len(EDGE)


# --- 7, 3


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"ab'sé1 \n\t .!日😀\u001c", "<|endoftext|>", "  ", " \n", "'ll"]), max_size=30).map("".join))
def test_byte_level_ids_equal_the_library(text):
    e = bytelevel.byte_level(BPE)
    want = e.library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(e.encode(text), "<u4").tolist() == want
    c = tokens.counter(BPE)
    assert sum(n * (1 if k is None else c.pieces([k])[0]) for k, n in c.frequencies(text).items()) == len(want)


@pytest.mark.parametrize("frequent", [0, 50, 100_000])
def test_token_counts(spark, docs, edge, frequent):
    library = Tokenizer.from_file(BPE)
    both = docs.select("doc_id", "text").limit(60).unionByName(edge.select("doc_id", "text"))
    want = sorted((r.doc_id or -1, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in both.collect())
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in tokens.count_tokens(both, BPE, frequent).collect()) == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60), st.integers(1, 6))
def test_best_fit_is_that_of_a_plain_list(lengths, open_bins):
    b, bins, still = packing.BestFit(20, open_bins), [], []  # still: open bins by the time they got their free space
    for n in lengths:
        fits = [i for i in still if 20 - bins[i] >= n]
        if fits:
            least = min(20 - bins[i] for i in fits)
            want, shut = [i for i in fits if 20 - bins[i] == least][-1], []
        else:
            want, shut = len(bins), []
            bins.append(0)
            if len(still) >= open_bins and n < 20:
                least = min(20 - bins[i] for i in still)
                shut = [[i for i in still if 20 - bins[i] == least][-1]]
                still.remove(shut[0])
        offset = bins[want]
        bins[want] += n
        still = [i for i in still if i != want]
        if bins[want] == 20:
            shut = [*shut, want]
        else:
            still.append(want)
        assert b.place(n) == (want, offset, shut) and bins[want] <= 20 and b.open == len(still) <= open_bins


@pytest.mark.parametrize("parts", [1, 32, 211])
def test_packing_fills_sequences_whatever_the_partitions(spark, parts):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").repartition(parts)
    out = packing.pack(docs, BPE).drop("ids").persist()
    r = packing.fill(out).first()
    assert r.filled > 0.97 and r.tokens == out.toPandas().length.sum(), r
    odd = packing.pack(spark.createDataFrame([(None, None), (None, ""), (1, "a"), (1, "a")], "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("open", F.lit(2)), BPE).toPandas()
    assert len(odd) == 4 and odd.sequence_id.nunique() == 1 and sorted(odd.offset) == list((odd.sort_values("offset").length.cumsum() - odd.sort_values("offset").length))
    assert packing.pack(docs.limit(0), BPE).count() == 0


def test_packing(spark, docs, edge):
    library = Tokenizer.from_file(BPE)
    both = docs.select("doc_id", "text").unionByName(edge.filter("doc_id is not null").dropDuplicates(["doc_id"]).selectExpr("doc_id + 100000 doc_id", "text"))
    out = packing.pack(both, BPE).toPandas()
    for r in both.collect():
        x = out[out.doc_id == r.doc_id].sort_values("piece")
        assert np.frombuffer(b"".join(x.ids), "<u4").tolist() == [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        assert (x.length.iloc[1:] == 2048).all() and (x.start == x.length.cumsum() - x.length).all()
    by = out.sort_values("offset").groupby("sequence_id").length
    assert (by.cumsum() - out.length == out.offset).all() and out.length.sum() / 2048 / by.ngroups > 0.97


# --- 4


def test_sentencepiece_paths(spark, docs, edge):
    path = public_tokenizers.path("piece_bpe_32k.model")
    e = pieces.encoder(path)
    texts = [r.text or "" for r in docs.limit(40).collect()] + [t or "" for _, t, _ in EDGE] + [" a", "a ", "  a  b ", "\n\n x\t y", "😀😀 z"]
    for t, ids in zip(texts, e.encode(texts), strict=True):
        want = e.best_path(("▁" + t.replace(" ", "▁")).encode()) if t else []
        assert np.frombuffer(ids, "<i4").tolist() == want
        assert e.decode(ids) == t.replace("▁", " ")
    assert pieces.decode(pieces.encode(edge, path), path).count() == len(EDGE)


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from(list("theinga▁é\n日")), min_size=1, max_size=7))
def test_viterbi_is_optimal(text):
    e = pieces.encoder(public_tokenizers.path("piece_bpe_32k.model"))
    data, score = text.encode(), e.vocabulary.scores
    known = {p.encode(): score[i] for i, (p, k) in enumerate(zip(e.vocabulary.pieces, e.vocabulary.kinds, strict=True)) if k == pieces.NORMAL}

    def best(t):
        return max((best(t[:i]) + (known[t[i:].encode()] if t[i:].encode() in known else e.unknown_score if len(t) - i == 1 else -(10**12)) for i in range(len(t))), default=0)

    ids = e.best_path(data)
    total = sum(int(score[i]) for i in ids if e.byte_of[i] < 0)
    lost = sum(1 for i in ids if e.byte_of[i] >= 0)
    chars = len(bytes(int(e.byte_of[i]) for i in ids if e.byte_of[i] >= 0).decode()) if lost else 0
    assert total + chars * e.unknown_score == best(text)


# --- 8


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        least[find(a)] = min(i, least.get(find(a), i))
    return {i: (len(x), least[find(a)]) for a, (i, x) in enumerate(sets)}


@pytest.mark.parametrize("few", [48, 0])
def test_jaccard_components(spark, docs, few):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 400, 80)]
    rows = [(r.doc_id, r.text) for r in docs.limit(80).collect()] + [(5000, None), (5001, "  "), (5002, "One two"), (5003, "one TWO "), (5004, "one two three four five")]
    for k in range(70):  # near copies around one text, some too far from most others
        w = list(base)
        for at in rng.integers(0, 80, k % 4):
            w[at] = f"x{rng.integers(0, 9999)}"
        rows.append((6000 + k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(df, few=few).collect()}
    assert got == brute_components(rows)


@settings(max_examples=60, deadline=None)
@given(st.integers(5, 60), st.integers(0, 12), st.integers(0, 2**31))
def test_linked_sets_share_a_key(n, edits, seed):
    rng = np.random.default_rng(seed)
    x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
    y = np.unique(np.concatenate([rng.permutation(x)[: max(1, len(x) - edits // 2)], rng.integers(0, 2**63, edits // 2, dtype=np.uint64)]))
    classes = rng.integers(1, 4, 1 << jaccard.SKETCH_BITS).astype(np.int8)
    both = len(np.intersect1d(x, y))
    if 100 * both >= 80 * (len(x) + len(y) - both) and len(x) != both:
        assert set(jaccard.keys_of(x, classes, 80, 100)[0].tolist()) & set(jaccard.keys_of(y, classes, 80, 100)[0].tolist())


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 12), st.integers(0, 3), st.integers(0, 2), st.integers(0, 2**31))
def test_linked_sets_of_unequal_size_share_a_key(n, more, less, seed):
    rng = np.random.default_rng(seed)
    x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
    y = np.unique(np.concatenate([rng.permutation(x)[: max(1, len(x) - less)], rng.integers(0, 2**63, more, dtype=np.uint64)]))
    classes = rng.integers(1, 4, 1 << jaccard.SKETCH_BITS).astype(np.int8)
    both = len(np.intersect1d(x, y))
    if 100 * both >= 80 * (len(x) + len(y) - both) and not np.array_equal(x, y):
        assert set(jaccard.keys_of(x, classes, 80, 100)[0].tolist()) & set(jaccard.keys_of(y, classes, 80, 100)[0].tolist())


def test_jaccard_links_four_shingles_with_five(spark):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h i"), (3, "z a b c d e f g h"), (4, "a b c d e f g x")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows) and got[2] == (5, 1)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 300), st.integers(0, 40), st.integers(0, 40), st.integers(0, 2**31))
def test_bitmaps_allow_every_link(n, more, less, seed):
    rng = np.random.default_rng(seed)
    x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
    y = np.unique(np.concatenate([rng.permutation(x)[: max(1, len(x) - less)], rng.integers(0, 2**63, more, dtype=np.uint64)]))
    both = len(np.intersect1d(x, y))
    if 100 * both >= 80 * (len(x) + len(y) - both):
        assert jaccard.may_link(len(x), jaccard.parity(x), len(y), jaccard.parity(y), 80, 100)
    z = rng.integers(0, 2**63, 300, dtype=np.uint64)
    assert not jaccard.may_link(300, jaccard.parity(z), 300, jaccard.parity(rng.integers(0, 2**63, 300, dtype=np.uint64)), 80, 100)


def test_jaccard_rows_under_one_id(spark):
    """Equal ids, null ids and copies: rows are told apart by their texts, and each text is sent once."""
    base = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(base))] * 200 + [(2, " ".join(base[:59] + ["x"]))] * 200 + [(None, " ".join(base[1:])), (None, "a b c d e f g"), (7, "a b c d e f g"), (7, "q r s t u v"), (None, "n o one two three")]
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {(1, 56, 1): 200, (2, 56, 1): 200, (None, 55, 1): 1, (None, 3, 7): 1, (7, 3, 7): 1, (7, 2, 7): 1, (None, 1, None): 1}


def test_jaccard_odd_rows(spark, edge):
    got = jaccard.similar_documents(edge).collect()
    assert len(got) == len(EDGE) and {r.component_id for r in got if r.n_shingles == 1} == {4}
    assert jaccard.similar_documents(edge.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    assert {(r.node, r.root) for r in components(df).collect()} == {(i, 0) for i in range(201)} | {(500, 500), (501, 500)}


# --- 10


def test_fingerprints(spark, docs):
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {r.doc_id: r for r in fingerprint.edit_embedding(docs).collect()}
    for k, (i, t) in enumerate(rows):
        changed = fingerprint.edited(t, rows[(k + 1) % len(rows)][1])
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert r.near_next == fingerprint.likeness(r.fingerprint, got[rows[(k + 1) % len(rows)][0]].fingerprint)
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.95


def test_fingerprint_steps_and_small_edits():
    text = "the quick brown fox jumps over the lazy dog " * 20
    one, two, other, empty, again = fingerprint.fingerprints([text, text[:300] + "X" + text[300:], text[::-1], "", text])
    assert one == again and fingerprint.likeness(one, two) > 0.6 > fingerprint.likeness(one, other) and len(empty) == 16
    steps, bit = fingerprint.walk(20)
    t = 0
    shown = []
    for c in fingerprint.classes_of(text):
        n = int(steps[c, t % fingerprint.PERIOD])
        shown += [c] * n
        t += n
    octaves = t.bit_length()
    at = np.concatenate([fingerprint.sampled(k, 20) for k in range(octaves)])
    bits = np.array([bit[shown[s]] if s < t else bit[fingerprint.CLASSES] for s in at]) ^ fingerprint._flips(octaves, 20)
    assert np.packbits(bits.astype(np.uint8)).tobytes().hex() == one


def test_fingerprint_rows_and_pairs(spark, edge, docs):
    assert fingerprint.edit_embedding(edge).count() == len(EDGE) and fingerprint.edit_embedding(edge.limit(0)).count() == 0
    prints = fingerprint.edit_embedding(docs).select("doc_id", "fingerprint")
    for r in fingerprint.near_pairs(prints).collect():
        assert r.a < r.b and r.likeness >= 0.8


def test_bands_find_nine_in_ten_near_pairs(spark):
    """Recall against all pairs, on groups of copies with some edits each."""
    rng = np.random.default_rng(4)
    texts = []
    for g in range(40):
        base = "".join(rng.choice(list("abcdefgh ijklmnop"), rng.integers(200, 1500)))
        for _ in range(4):
            t = list(base)
            for at in rng.integers(0, len(t), rng.integers(0, max(2, len(t) // 60))):
                t[at] = rng.choice([t[at] + "x", "", "zy"])
            texts.append("".join(t))
    prints = fingerprint.fingerprints(texts, 20)
    near = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if prints[a] != prints[b] and fingerprint.likeness(prints[a], prints[b]) >= 0.8}
    got = {(r.a, r.b) for r in fingerprint.near_pairs(spark.createDataFrame(list(enumerate(prints)), "doc_id long, fingerprint string")).collect()}
    least = {p: i for i, p in reversed(list(enumerate(prints)))}
    want = {(least[prints[a]], least[prints[b]]) for a, b in near}
    want = {(min(p), max(p)) for p in want}
    assert len(want) > 60 and {(min(p), max(p)) for p in got} <= want and len(got) >= 0.9 * len(want), (len(got), len(want))


def test_near_pairs_in_one_bucket(spark):
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(12)]
    texts = [t for x in texts for t in (x, x[:-1] + "z")]
    rows = dict(enumerate(fingerprint.fingerprints(texts, 20)))
    one = {}
    for i, f in rows.items():
        one.setdefault(f, i)
    want = {(a, b) for f, a in one.items() for g, b in one.items() if a < b and fingerprint.likeness(f, g) >= 0.8}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, fingerprint string")
    for tile in (500, 5):  # no band has bits here, so all that reach the same octave share each bucket
        got = [(r.a, r.b) for r in fingerprint.near_pairs(df, bands=2, band_bits=0, tile=tile).collect()]
        assert want and len(got) == len(set(got)) and set(got) == want


# --- 2


def test_urls(spark):
    rows = [(1, "http://A.example.NET/en/x?q"), (2, "https://foo.net/a"), (3, None), (4, "no scheme"), (5, "http://example.com/de/1#t"), (6, "http://x.org/fr/1"), (7, "http://net"), (8, "http://www.cheappillscasino.example.org/en/1"), (9, "http://badexample.net/en/1"), (10, "http://gardennews.example.org/en/2")]
    html = "<p>garden news of the garden and the news</p>"
    many = [(100 + i, f"http://www.free-bets.example.org/en/{i}") for i in range(20)] + [(200 + i, f"http://garden.example.org/en/{i}") for i in range(60)]
    # The rules label these: the words of the others' hosts are learnt from them.
    many += [(300 + i, f"http://www.cheapbets{'casino' * (i % 2)}.example.net/de/{i}") for i in range(20)] + [(400 + i, f"http://garden{'news' * (i % 2)}.example.org/fr/{i}") for i in range(60)]
    df = spark.createDataFrame([(i, u, html) for i, u in rows + many], "page_id long, url string, html string")
    got = {r.page_id: r for r in urls.judge(df, queries.URL_RULES).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(1, 8)] == [("a.example.net", "/en/x", "example.net/en/"), ("foo.net", "/a", "net/"), ("", "", None), ("", "", None), ("example.com", "/de/1", "example.com/de/"), ("x.org", "/fr/1", "org/fr/"), ("net", "", None)]
    assert [got[i].verdict for i in (1, 2, 5, 6, 8, 9, 10)] == ["allow", "block", "block", "allow", "block", "block", "allow"]
    assert got[8].host_words[1:4] == ["cheap", "pills", "casino"]


def plain_urls(rows, rules):
    """Words by a plain Viterbi over all counts, plain multinomial naive Bayes on the pages that a rule decides."""
    low = lambda t: t.translate(LOW)
    counts = collections.Counter({w: urls.SEED_COUNT for w in set(urls.SPAM_WORDS) | set(urls.PLAIN_WORDS)})
    for w in urls.SPAM_WORDS + urls.PLAIN_WORDS:
        counts[w] += 0 if counts[w] else urls.SEED_COUNT
    parsed = []
    for i, url, html in rows:
        rest = url.split("://", 1)[1].split("#")[0].split("?")[0] if "://" in url else ""
        host, slash, path = rest.partition("/")
        parsed.append((i, low(host), slash + path))
        seen = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ", html) + " " + slash + path
        counts.update(w for w in re.split(r"[\W\d_]+", seen.lower()) if 1 <= len(w) <= 24)
    total = sum(counts.values())
    log_p, words = {w: math.log(n / total) for w, n in counts.items()}, {}
    for i, host, path in parsed:
        words[i] = [w for run in re.findall(r"[^\W\d_]+|\d+", (host + " " + path).lower()) for w in ([urls.NUMBER] if run[0].isdigit() else urls.segment(run, log_p, math.log(1 / total)))]
    named = {w for r in rules for w in re.findall(r"[^\W\d_]+|\d+", r)}
    label = {}
    for i, host, path in parsed:
        fits = [r for r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        if fits:
            label[i] = rules[max(fits, key=len)] == "block"
    y = {c: collections.Counter(w for i, x in label.items() if x == c for w in words[i] if w not in named) for c in (True, False)}
    y[True].update(urls.SPAM_WORDS)
    size = len(y[True].keys() | y[False].keys()) + 1
    p = lambda c, w: math.log((y[c][w] + 0.5) / (sum(y[c].values()) + 0.5 * size))
    prior = math.log((sum(label.values()) + 1) / (len(label) - sum(label.values()) + 1))
    return {i: prior + sum(p(True, w) - p(False, w) for w in words[i] if w not in named) for i in words}, label


@pytest.mark.parametrize("frequent", [50_000, 20])
def test_url_scores_are_those_of_plain_bayes(spark, frequent):
    """Whatever the number of broadcast words."""
    rng = np.random.default_rng(5)
    words = ["garden", "news", "cheap", "bets", "pills", "house", "and", "car", "den", "gar", "rare"]
    rows = [(i, f"http://{''.join(rng.choice(words, rng.integers(1, 4)))}.example.{rng.choice(['net', 'org', 'com'])}/{rng.choice(['en', 'fr', 'de'])}/{rng.choice(words)}{i}?x#y", f"<p>{' '.join(rng.choice(words[:9], 6))}</p><script>noise</script>") for i in range(80)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), queries.URL_RULES, frequent).collect()}
    want, label = plain_urls(rows, queries.URL_RULES)
    assert {i: pytest.approx(x, abs=1e-6) for i, x in want.items()} == {i: r.log_odds for i, r in got.items()}
    assert all(r.verdict == (("block" if label[i] else "allow") if i in label else "block" if r.log_odds > 0 else "allow") for i, r in got.items())


def test_urls_odd_rows(spark):
    long = "http://" + "gardennews" * 300 + ".example.com/en/" + "x" * 3000
    rows = [(1, None, None, 1), (1, None, None, 1), (None, "http://a.net/", "<b>", 2), (2, long, "", 3), (3, "", "", 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, rule int")
    got = urls.judge(df, queries.URL_RULES).collect()
    assert sorted((r.page_id or -1, r.host[:3], r.verdict if r.rule else "", r.rule or "") for r in got) == [(-1, "a.n", "block", "net/"), (1, "", "", ""), (1, "", "", ""), (2, "gar", "", ""), (3, "", "", "")]
    assert sum(map(len, next(r for r in got if r.page_id == 2).host_words)) == 3000 + len("examplecom")
    assert urls.judge(df.limit(0), queries.URL_RULES).count() == 0 and urls.judge(df.drop("html"), queries.URL_RULES).count() == 5


def test_segmentation_is_optimal():
    p = {"a": -2.0, "ab": -3.0, "b": -2.5, "ba": -3.5, "abba": -9.0}

    def best(t):
        return max((best(t[:i]) + p.get(t[i:], -20 - (len(t) - i) * math.log(10)) for i in range(len(t))), default=0.0)

    for t in ("abba", "abab", "xab", ""):
        assert sum(p.get(w, -20 - len(w) * math.log(10)) for w in urls.segment(t, p, -20)) == pytest.approx(best(t))


# --- 1

KEY = "a key"


def test_pii(spark, edge):
    rows = [(1, "Mail jo.5@mail3.example.com or JO.5@mail3.example.com, +1 (017) 555-7713; card 4111 1111 1111 1111 and 4111111111111111."), (2, 'Mrs. Anna Smith met Mr. John Smith. token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" 152.143.123.131###'), (3, "nothing in it 12, 2024."), (4, None), (5, "e\u0001 a@b.co")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.replace_pii(df, KEY).collect()}
    for gone in ("jo.5@", "JO.5@", "555-7713", "4111", "Anna", "Smith", "24be6443", "152.143"):
        assert gone not in got[1] + got[2]
    a, b = re.findall(r"[\w.]+@[\w.]+\w", got[1])
    assert a == b.lower() and got[3] == rows[2][1] and got[4] is None and "a@b.co" not in got[5]
    c = re.findall(r"(?:\d{4} ){3}\d{4}|\d{16}", got[1])
    assert c[0].replace(" ", "") == c[1] and sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(c[1]))) % 10 == 0
    m = re.match(r"Mrs\. (\w+na) (\w+) met Mr\. (\w+n) (\w+)\.", got[2])
    assert m and m[2] == m[4] and m[1] != m[3]
    assert pii.replace_pii(edge, KEY).count() == len(EDGE) and pii.replace_pii(edge, KEY).columns == edge.columns


ENTITIES = {
    "email": ["x@y.co"],
    "ipv6": ["a:b:c:d:e:f:a:b"],
    "ipv4": ["8.8.8.8", "1.1.1.1", "192.168.0.1"],
    "secret": ["AKIA" + "QWERTYUIOPASDFGH", "ghp_abcdefghijklmnopqrst", "gho-abcdefghijklmnopqrst", "sk-a1b2c3d4e5f6g7h8i9j0", "pk_abcdefghijklmnopqrst", "xoxb-abcdefghijklmnopqrst", "xoxp-abcdefghijklmnopqrst", "abcdefab" * 4, "a1b2c3d4" * 4, "token=abcdefghij"],
    "iban": ["DE89 3704 0044 0532 0130 00"],
    "ssn": ["123-45-6789"],
    "card": ["4111 1111 1111 1111"],
    "phone": ["+1 (2) 34 56", "(555) 555-1234", "555.555.1234"],
    "person": ["Mr. Smith", "госпожа Иванова", "Dr Who"],
}


def test_pii_found_without_other_hints(spark):
    assert ENTITIES.keys() == pii.PATTERNS.keys()
    rows = [(f"so {e} it is", e) for es in ENTITIES.values() for e in es] + [("a 1 b 2.x sky pkg", None)]
    df = spark.createDataFrame(rows, "text string, e string")
    for r in pii.replace_pii(df, KEY, count="n").collect():
        assert (r.n == 0 and r.text == "a 1 b 2.x sky pkg") if r.e is None else (r.n == 1 and r.e.split("=")[-1] not in r.text), r.e


def test_pii_takes_long_entities_whole(spark):
    long = "a1B2c3D4e5" * 70
    jwt = "-".join(["eyJhbGciOiJIUzI1NiJ9", "abcDEF123_" * 60, "Q" * 300])
    rows = ["0123456789abcdef" * 40, "sk_" + long, "ghp_" + long, f"token={jwt}", f"password: {long}", long + "@mail.example.org", "jo@" + "a9." * 30 + "org", "secret=" + "x7" * 20_000]
    df = spark.createDataFrame([(i, f"so {t} end") for i, t in enumerate(rows)], "i int, text string")
    for r in pii.replace_pii(df, KEY, count="n").collect():
        old = rows[r.i].removeprefix("token=").removeprefix("password: ").removeprefix("secret=")
        new = r.text.removeprefix("so ").removesuffix(" end").removeprefix("token=").removeprefix("password: ").removeprefix("secret=")
        assert r.n == 1 and not set(re.findall(".{12}", new)) & {old[k : k + 12] for k in range(len(old))}, r.i
        assert "@" in old or len(new) == len(old)


def test_pii_surrogates_are_distinct(spark):
    # Short local parts collide often: 2,000 of one to two letters share 441 * 20 swaps.
    mails = [f"{a}{b}@x{c}.example.com" for a in "abcdefgh" for b in "mnop" for c in range(20)]
    names = [f"{t} {a.title()}{x} {b.title()}" for t in ("Mr.", "Mrs.", "Dr") for a in ("jon", "kim", "lia") for x in "bcd" for b in ("lee", "poe", "ray", "иванов", "иванова")]
    phones = [f"+1 ({i}) 55 {10 + j}" for i in range(10) for j in range(40)]
    many = spark.createDataFrame([(1, e) for e in mails + names + phones], "t int, s string")
    got = pii.resolve(many, "k").collect()
    assert len(got) == many.count() and not {r.surrogate for r in got} & {r.s for r in got}
    one = [r for r in got if r.kind != "person"]
    assert len({r.surrogate for r in one}) == len(one)
    # Names: one surrogate for each person, whatever the title; Dr is of the same gender as no other title here, so it joins one of the two.
    people = collections.defaultdict(set)
    for r in got:
        if r.kind == "person" and not r.s.startswith("Dr"):
            people[r.surrogate.split(" ", 1)[1]].add(r.s)
    assert all(len(x) == 1 for x in people.values()) and len(people) == 2 * 9 * 5
    family = {}
    for r in got:
        if r.kind == "person":
            assert family.setdefault(r.s.split()[-1], r.surrogate.split()[-1]) == r.surrogate.split()[-1]
    assert len(set(family.values())) == 5 and family["Иванов"] + "а" == family["Иванова"]
    assert {r.s: r.surrogate for r in pii.resolve(many, "k").collect()} == {r.s: r.surrogate for r in got}
    assert {r.s: r.surrogate for r in pii.resolve(many, "j").collect()} != {r.s: r.surrogate for r in got}


def test_pii_coreference_and_formats(spark):
    rows = [
        (1, "Mrs Kim Lee met Dr Kim Lee. Then Lee left; Kim Lee stayed, Leeds too. Mr John Smith-Jones and Jones."),
        (2, "Jo.5@mail3.acme.de JO.5@MAIL3.acme.de +49 30 1234567 +49301234567 password: ******** x"),
        (3, "Господин Иванов и госпожа Иванова. Иванов ушёл. Mr Παπαδόπουλος and Mr. SMITH Mr Smith"),
        (4, "Kim Lee and Lee without a title are no one's"),
    ]
    got = {r.doc_id: (r.text, r.n) for r in pii.replace_pii(spark.createDataFrame(rows, "doc_id long, text string"), KEY, count="n").collect()}
    one, n = got[1]
    m = re.fullmatch(r"Mrs (\w+na) (\w+) met Dr \1 \2\. Then \2 left; \1 \2 stayed, Leeds too\. Mr (\w+n) (\w+)-(\w+) and \5\.", one)
    assert m and n == 6, one
    m = re.fullmatch(r"([A-Z][a-z]\.\d)@([a-z]{4}\d)\.example\.com (\S+)@\2\.example\.com \+49 (\d\d) (\d{7}) \+49\4\5 password: \S{9,} x", got[2][0])
    assert m and m[3] == m[1].upper() and got[2][1] == 5, got[2]
    m = re.fullmatch(r"Господин (\w+) и госпожа \1а\. \1 ушёл\. Mr ([α-ωΑ-Ω]+) and Mr\. (\w+) Mr (\w+)", got[3][0])
    assert m and m[3] == m[4].upper() and got[3][1] == 6, got[3]
    assert got[4] == (rows[3][1], 0)


def test_pii_odd_rows(spark, edge):
    got = pii.replace_pii(edge, KEY, count="n").collect()
    assert sorted(map(str, [(r.doc_id, r.text, r.lang, r.score, r.n) for r in got])) == sorted(map(str, [(i, t, g, 9, 0) for i, t, g in EDGE]))
    none = pii.replace_pii(edge.limit(0), KEY)
    assert none.columns == edge.columns and none.count() == 0
    clash = spark.createDataFrame([(1, "a@b.co", 1, "x", "y")], "rid int, text string, parts int, t string, s string")
    got = pii.replace_pii(clash, KEY).collect()
    assert len(got) == 1 and got[0][0] == 1 and got[0].text.endswith("@example.com") and got[0][2:] == (1, "x", "y")
    long = spark.createDataFrame([(1, "Mrs Ada Byron and Byron wrote to a@b.co. " * 20_000), (1, "Mrs Ada Byron and Byron wrote to a@b.co. ")], "doc_id int, text string")
    got = sorted(r.text for r in pii.replace_pii(long, KEY).collect())
    assert "Byron" not in got[1] and got[1] == got[0] * 20_000


def test_store_writes_into_the_shared_folder(spark):
    df = store.stored(spark.range(3), "x")
    assert df.count() == 3 and all(store.shared_dir(spark) in f for f in df.inputFiles())
