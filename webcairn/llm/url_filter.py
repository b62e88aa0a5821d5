"""URL filter: domain and path rules first, then a classifier over segmented names.

Concatenated host labels are split into words by a unigram Viterbi: every substring of a
distinct label is joined with the word counts, and the best split is found per label.
Words of host and path are scored by multinomial naive Bayes over hashed words, trained
on all pages: a page whose host holds a seed word is an example to block, the others are
examples to allow.  The word counts and the examples grow with the data and stay in
Spark; what reaches the tasks is one weight per hash bucket, a fixed number.
"""

from __future__ import annotations

import math
from collections import namedtuple
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from webcairn.llm.common import materialize, table

Rule = namedtuple("Rule", "rule verdict")

RULES = (
    Rule("org/", "allow"),
    Rule("example.org/es/", "block"),
    Rule("example.org/en/1", "block"),
    Rule("com/fr/", "allow"),
    Rule("com/de/", "block"),
)
#: Host words that mark a page as an example to block.
SEEDS = ("ads", "adult", "bets", "betting", "casino", "gambling", "pills", "poker", "porn", "spam", "track", "viagra", "xxx")
BUCKETS = 1 << 14
LONGEST_WORD = 20
SMOOTHING = 0.05
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as struct(size, rule, verdict); null without one."""
    fits = []
    for rule, verdict in rules:
        name, slash, rest = rule.partition("/")
        fit = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        fits.append(F.when(fit, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    kind = "struct<size:int,rule:string,verdict:string>"
    return F.array_max(F.array_compact(F.array(*fits, F.lit(None).cast(kind))))


def unigrams(texts: DataFrame, column: str) -> DataFrame:
    """word, n: lower-cased words of letters in a text column, counted over all rows."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(column), F.lit(""))), r"[^\p{L}]+"), lambda w: w != "")
    return (
        texts.select(F.explode(words).alias("word"))
        .where(F.length("word") <= LONGEST_WORD)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _best_splits(total):
    """Most likely split of each label from the words that its substrings hit."""
    unseen = [0.0] + [math.log(10.0 / total) - n * math.log(10.0) for n in range(1, LONGEST_WORD + 1)]

    def scan(batches):
        for batch in batches:
            out = []
            for label, hits in zip(batch.column("label").to_pylist(), batch.column("hits").to_pylist()):
                known = {(h["at"], h["size"]): h["n"] for h in hits or ()}
                best = [(0.0, 0)] + [(-math.inf, 0)] * len(label)
                for end in range(1, len(label) + 1):
                    for size in range(1, min(end, LONGEST_WORD) + 1):
                        n = known.get((end - size, size))
                        cost = math.log(n / total) if n else unseen[size]
                        score = best[end - size][0] + cost
                        if score > best[end][0]:
                            best[end] = (score, end - size)
                words, end = [], len(label)
                while end:
                    start = best[end][1]
                    words.append(label[start:end])
                    end = start
                out.append(words[::-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array(out, pa.list_(pa.string()))], ["label", "words"]
            )

    return scan


def segment(labels: DataFrame, words: DataFrame) -> DataFrame:
    """label, words: every distinct label split by unigram Viterbi over ``words`` (word, n).

    A word without count costs ten times more per letter; labels are cut into substrings
    of at most LONGEST_WORD characters.  Empty and null labels are left out.
    """
    labels = labels.select("label").where("label <> ''").distinct()
    total = float(words.agg(F.sum("n")).first()[0] or 1)
    size = F.length("label")
    spots = labels.select("label", F.explode(F.sequence(F.lit(0), size - 1)).alias("at"), size.alias("all")).select(
        "label", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), F.col("all") - F.col("at")))).alias("size")
    )
    hits = (
        spots.withColumn("word", F.expr("substring(label, at + 1, size)"))
        .join(words, "word")
        .groupBy("label")
        .agg(F.collect_list(F.struct("at", "size", "n")).alias("hits"))
    )
    return labels.join(hits, "label", "left").mapInArrow(_best_splits(total), "label string, words array<string>")


def _bucket(words: Column) -> Column:
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def _score(weights, prior):
    def scan(batches):
        for batch in batches:
            buckets = batch.column("buckets")
            flat = weights[buckets.flatten().to_numpy()] if len(batch) else np.zeros(0)
            sums = np.r_[0.0, np.cumsum(flat)]
            size = np.array([len(x) if x.is_valid else 0 for x in buckets], np.int64)
            end = np.cumsum(size)
            score = prior + sums[end] - sums[end - size]
            names = [c for c in batch.schema.names if c != "buckets"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(score)], [*names, "score"])

    return scan


def filter_urls(
    pages: DataFrame,
    words: DataFrame,
    url: str = "url",
    rules: Sequence[Rule] = RULES,
    seeds: Sequence[str] = SEEDS,
    smoothing: float = SMOOTHING,
) -> DataFrame:
    """Rows of ``pages`` with host, path, host_words, score (log odds of block), rule and verdict.

    A rule's verdict stands; else a positive score blocks.  Columns of these names are
    replaced.  Without examples to block every page without rule is allowed.
    """
    rest = [c for c in pages.columns if c not in ("host", "path", "host_words", "score", "rule", "verdict")]
    host, path = host_and_path(F.col("__url"))
    rows = pages.select(*rest, F.col(url).cast("string").alias("__url")).select(*rest, host.alias("host"), path.alias("path"))
    hosts = materialize(rows.select("host").distinct())
    labels = hosts.select(
        "host", F.posexplode(F.filter(F.split("host", r"[^\p{L}]+"), lambda x: x != "")).alias("pos", "label")
    )
    split = segment(labels, words)
    named = materialize(
        labels.join(split, "label")
        .groupBy("host")
        .agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "words"))), lambda x: x["words"])).alias("host_words"))
    )
    path_words = F.transform(
        F.filter(F.split(F.translate("path", _UPPER, _LOWER), r"[^\p{L}\p{N}]+"), lambda x: x != ""),
        lambda w: F.concat(F.lit("/"), F.regexp_replace(w, r"\p{N}+", "0")),
    )
    empty = F.array().cast("array<string>")
    joined = rows.join(named, "host", "left").withColumn("host_words", F.coalesce("host_words", empty))
    ready = joined.withColumns(
        {
            "buckets": _bucket(F.concat("host_words", path_words)),
            "bad": F.arrays_overlap("host_words", F.array(*[F.lit(s) for s in seeds])),
        }
    )
    model = (
        ready.select("bad", F.explode(F.concat("buckets", F.array(F.lit(BUCKETS)))).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count_if("bad").alias("block"), F.count_if(~F.col("bad")).alias("allow"))
        .toArrow()
    )  # at most BUCKETS + 1 rows; the last counts pages
    count = np.zeros((2, BUCKETS + 1))
    count[0, model["bucket"].to_numpy()] = model["block"].to_numpy()
    count[1, model["bucket"].to_numpy()] = model["allow"].to_numpy()
    logs = np.log(count[:, :BUCKETS] + smoothing) - np.log(count[:, :BUCKETS].sum(axis=1, keepdims=True) + smoothing * BUCKETS)
    weights = np.where(count[:, :BUCKETS].sum(axis=0) > 0, logs[0] - logs[1], 0.0)  # unseen words say nothing
    prior = float(np.log(count[0, BUCKETS] + 1e-9) - np.log(count[1, BUCKETS] + 1e-9))
    schema = ready.select(*rest, "host", "path", "host_words").schema.add("score", "double")
    scored = ready.select(*rest, "host", "path", "host_words", "buckets").mapInArrow(_score(weights, prior), schema)
    found = rule_for(F.col("host"), F.col("path"), rules)
    return scored.withColumn("__rule", found).select(
        *rest,
        "host",
        "path",
        "host_words",
        "score",
        F.col("__rule.rule").alias("rule"),
        F.coalesce("__rule.verdict", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"),
    )


def vocabulary(pages: DataFrame, html: str = "html", url: str = "url", seeds: Sequence[str] = SEEDS) -> DataFrame:
    """word, n: words of page text and titles, of hosts only what no single host makes a word.

    Left out of the text are scripts, styles, tags and names of hosts.  From hosts come
    the last label, and the parts of hyphenated labels that two hosts have; a label
    written in one word is what is to be split.  A seed counts as the average word at least.
    """
    text = F.regexp_replace(F.col(html), r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", " "), r"\S+://\S+|(?:[\p{L}\p{N}-]+\.)+\p{L}{2,}", " ")
    counted = unigrams(pages.select(text.alias("text")), "text")
    names = pages.select(host_and_path(F.col(url))[0].alias("host")).distinct().select("host", F.split("host", r"\.").alias("labels"))
    last = unigrams(names.select(F.element_at("labels", -1).alias("text")), "text")
    hyphenated = F.flatten(F.transform(F.filter("labels", lambda x: F.contains(x, F.lit("-"))), lambda x: F.split(x, r"[^\p{L}]+")))
    parts = (
        names.select("host", F.explode(F.array_distinct(hyphenated)).alias("word"))
        .where((F.col("word") != "") & (F.length("word") <= LONGEST_WORD))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    found = materialize(counted.unionByName(last).unionByName(parts).groupBy("word").agg(F.sum("n").alias("n")))
    total, number = found.agg(F.sum("n"), F.count(F.lit(1))).first()
    least = pages.sparkSession.createDataFrame([(s, max(1, (total or 0) // max(1, number))) for s in seeds], "word string, n bigint")
    return materialize(found.unionByName(least).groupBy("word").agg(F.max("n").alias("n")))


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages.select("page_id", "url"), vocabulary(pages)).select(
        "page_id", "host", "path", "rule", "verdict", "host_words", "score"
    )
