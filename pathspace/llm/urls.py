"""URL filters: rules on hosts and paths, else naive Bayes on segmented names.

Hosts hold words run together. A unigram model of the words of the pages' visible texts and
url paths, and of the seed words, splits each run of letters by Viterbi: once for each distinct run, whole,
with all words up to ``longest`` letters. The ``frequent`` most frequent are broadcast; which others a
run holds is found by a join on its substrings, so no word is left out.

Multinomial naive Bayes then scores the words of host and path. It learns from the pages that a
rule decides (their verdicts are its labels), without the words that the rules
themselves name; seed words are a prior of the class block. Counts cover all such pages and all words, and meet
the pages' words by a join. A rule that fits decides instead of the score.

Defined results: a null url, or one without ://, has an empty host and path, no rule,
and the verdict of the prior; urls of any length are taken whole; a page without html counts by its url alone;
equal probabilities go to the split with the longer last word, log-odds of 0 to allow; repeated rows and
equal or null ids are judged each for itself; an empty table gives no rows; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import math
import re
from collections import ChainMap
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frequent import at_most
from .store import stored

# Words that mark hosts as unwanted, and frequent parts of host names.
SPAM_WORDS = """ads adult banner bet bets betting bonus bookie cams casino cheap cialis click clicks coupon
crack cracked crypto dating deals discount earn escort farm forex free gamble gambling hack hot jackpot keygen
loan loans lottery lucky mall malware meds naked nude offers payday pharma pharmacy pills poker popup porn prize
prizes profit promo replica rich sale sex sexy slot slots spam spins sweepstakes torrent track tracker tracking
viagra warez weightloss win winner winning xxx""".split()
PLAIN_WORDS = """about archive blog com data de doc docs edu en es example fr gov help home html img info
it mail main media mobile net news org page pages press shop site static store support web wiki www""".split()
#: How often each seed word counts as seen in texts, and in blocked urls.
SEED_COUNT, SEED_WEIGHT = 1000, 1


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host after the first :// up to / ? # or the end, A-Z in lower case, and the path up to ? # or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substring(url, F.instr(url, "://") + 3, F.length(url)), "#", 1))
    rest = F.substring_index(rest, "?", 1)
    host = F.translate(F.substring_index(rest, "/", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.when(F.instr(rest, "/") > 0, F.substring(rest, F.instr(rest, "/"), F.length(rest)))
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """The longest rule that fits (host or any subdomain, path by its beginning), and its verdict; else null."""
    rule = verdict = None
    for text in sorted(rules, key=lambda x: (-len(x), x)):
        name, slash, begin = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + begin)
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(rules[text])) if verdict is None else verdict.when(fits, F.lit(rules[text]))
    null = F.lit(None).cast("string")
    return (null, null) if rule is None else (rule, verdict)


def segment(name: str, log_p: Mapping[str, float], unknown: float, longest: int = 24) -> list[str]:
    """The most probable split of ``name`` into words (Viterbi); an unknown word of n letters costs a tenth for each letter. Ties go to the longer last word."""
    n = len(name)
    best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    for j in range(1, n + 1):
        for i in range(max(0, j - longest), j):
            word = name[i:j]
            x = best[i] + log_p.get(word, unknown - (j - i) * math.log(10))
            if x > best[j]:
                best[j], back[j] = x, i
    out = []
    while n:
        out.append(name[back[n] : n])
        n = back[n]
    return out[::-1]


_RUN = r"\\p{L}+|\\p{Nd}+"
NUMBER = "<number>"


def _sql_runs(name: str) -> str:
    return f"regexp_extract_all(lower({name}), '{_RUN}', 0)"


def counted_words(pages: DataFrame, longest: int) -> DataFrame:
    """word, n of the pages' visible texts, the urls' paths, and the seed words."""
    # Hosts are left out: a name that runs words together mustn't become a word.
    _, path = host_and_path(F.col("url").cast("string"))
    visible = F.regexp_replace(F.coalesce(F.col("html").cast("string"), F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ") if "html" in pages.columns else F.lit("")
    low = pages.select(F.lower(F.concat_ws(" ", visible, path)).alias("seen"))
    seen = low.select(F.explode(F.split("seen", r"[^\p{L}]+")).alias("word")).filter(F.length("word").between(1, longest)).groupBy("word").agg(F.count("*").alias("n"))
    seeds = pages.sparkSession.createDataFrame([(w, SEED_COUNT) for w in SPAM_WORDS + PLAIN_WORDS], "word string, n bigint")
    return seen.unionByName(seeds).groupBy("word").agg(F.sum("n").alias("n"))


def segmented(runs: DataFrame, counts: DataFrame, frequent: int, longest: int) -> DataFrame:
    """run, words for distinct runs of letters; counts: word, n (stored)."""
    spark = runs.sparkSession
    total = counts.agg(F.sum("n")).first()[0] or 1
    least = at_most(counts, "n", frequent)
    common = spark.sparkContext.broadcast({r[0]: math.log(r[1] / total) for r in counts.filter(F.col("n") >= least).collect()})
    unknown = math.log(1 / total)

    def substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = common.value
        for b in batches:
            for run in b.column(0).to_pylist():
                words = sorted({run[i:j] for i in range(len(run)) for j in range(i + 1, min(len(run), i + longest) + 1)} - known.keys())
                for k in range(0, len(words), 100_000):
                    part = words[k : k + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([run] * len(part), pa.string()), pa.array(part, pa.string())], ["run", "word"])

    held = runs.mapInArrow(substrings, "run string, word string").join(counts.filter(F.col("n") < least), "word")
    held = held.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("more"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = common.value
        for b in batches:
            words = []
            for run, more in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = {w: math.log(n / total) for w, n in more or []}
                words.append(segment(run, ChainMap(own, known) if own else known, unknown, longest))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.string()))], ["run", "words"])

    return runs.join(held, "run", "left").mapInArrow(split, "run string, words array<string>")


def train(words: DataFrame, rules: dict[str, str], alpha: float = 0.5) -> tuple[DataFrame, float, float]:
    """word, odds (log-odds block against allow) of every word of the labelled pages (word, label: 1 for block) and of the seed words; the odds of any other word; and the prior's.

    A page without words has a row with a null word.
    """
    named = {w for rule in rules for w in re.findall(r"[^\W\d_]+|\d+", rule.lower())}
    pages = {r[0]: r[1] for r in words.groupBy("label").agg(F.count_distinct("rid")).collect()}
    seen = words.filter(F.col("word").isNotNull() & ~F.col("word").isin([*named, ""])).groupBy("word").agg(F.sum("label").alias("y1"), F.sum(1 - F.col("label")).alias("y0"))
    seeds = words.sparkSession.createDataFrame([(w, SEED_WEIGHT, 0) for w in SPAM_WORDS], "word string, y1 bigint, y0 bigint")
    per = stored(seen.unionByName(seeds).groupBy("word").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0")), "url-words")
    t1, t0, size = per.agg(F.sum("y1"), F.sum("y0"), F.count("*")).first()
    odds = lambda a, b: F.log((a + alpha) / (t1 + alpha * (size + 1))) - F.log((b + alpha) / (t0 + alpha * (size + 1)))
    other = math.log((t0 + alpha * (size + 1)) / (t1 + alpha * (size + 1)))
    ignored = words.sparkSession.createDataFrame([(w, 0.0) for w in sorted(named)], "word string, odds double")
    table = per.filter(~F.col("word").isin([*named, ""])).select("word", odds(F.col("y1"), F.col("y0")).alias("odds")).unionByName(ignored)
    return table, other, math.log((pages.get(1, 0) + 1) / (pages.get(0, 0) + 1))


def judge(pages: DataFrame, rules: dict[str, str], frequent: int = 50_000, longest: int = 24, folds: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, the words found, the log-odds of every page, and whether it was held out (with ``folds``, ids whose crc32 is a multiple of it aren't learnt from)."""
    host, path = host_and_path(F.col("url").cast("string"))
    base = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    held = F.lit(False) if folds is None else F.coalesce(F.crc32(F.col("page_id").cast("string")) % folds == 0, F.lit(False))
    base = base.select("*", rule.alias("rule"), verdict.alias("ruled"), held.alias("held_out"), F.monotonically_increasing_id().alias("rid"))
    base = stored(base, "urls")
    counts = stored(counted_words(pages, longest), "url-counts")

    runs = base.selectExpr("rid", f"{_sql_runs('host')} as h", f"{_sql_runs('path')} as p")
    runs = runs.selectExpr("rid", "size(h) as n", "posexplode(concat(h, p)) as (pos, run)").withColumn("digits", F.col("run").rlike(r"^\p{Nd}"))
    split = stored(segmented(runs.filter("not digits").select("run").distinct(), counts, frequent, longest), "url-runs")
    found = runs.filter("not digits").join(split, "run").select("rid", "n", "pos", "words").unionByName(runs.filter("digits").select("rid", "n", "pos", F.array(F.lit(NUMBER)).alias("words")))
    found = stored(found, "url-parts")

    each = found.select("rid", F.explode("words").alias("word"))
    labelled = base.filter(F.col("ruled").isNotNull() & ~F.col("held_out")).select("rid", (F.col("ruled") == "block").cast("int").alias("label"))
    table, other, prior = train(labelled.join(each, "rid", "left"), rules)
    scores = each.join(table, "word", "left").groupBy("rid").agg(F.sum(F.coalesce("odds", F.lit(other))).alias("score"))
    in_host = F.filter("w", lambda x: x["pos"] < x["n"])
    words = found.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("pos", "n", "words"))).alias("w")).select("rid", F.flatten(F.transform(in_host, lambda x: x["words"])).alias("host_words"))
    out = base.join(scores, "rid", "left").join(words, "rid", "left").withColumn("log_odds", F.lit(prior) + F.coalesce("score", F.lit(0.0)))
    guess = F.when(F.col("log_odds") > 0, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", guess).alias("verdict"), F.coalesce("host_words", F.array().cast("array<string>")).alias("host_words"), "log_odds", "held_out", guess.alias("guess"))


def agreement(pages: DataFrame, rules: dict[str, str], folds: int = 5) -> DataFrame:
    """pages, agreed (share of them where the score alone says what the rule says), larger (share of the more frequent verdict), over the held-out pages that a rule decides."""
    out = judge(pages, rules, folds=folds).filter("held_out and rule is not null")
    block = F.avg((F.col("verdict") == "block").cast("int"))
    return out.agg(F.count("*").alias("pages"), F.avg((F.col("guess") == F.col("verdict")).cast("int")).alias("agreed"), F.greatest(block, 1 - block).alias("larger"))
