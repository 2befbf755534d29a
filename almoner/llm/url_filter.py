"""URL filter: rules first, then host word segmentation and naive Bayes.

Host names run words together, so their letter runs are split by the most likely division under a unigram model (Viterbi). The
model's counts come from the titles of all pages, plus a short list of words that tell something about a
site. A multinomial naive Bayes over the words of host and path then says allow or block.

The ``LEXICON`` most frequent title words and the ``VOCABULARY`` most frequent url words go to every task. The others stay tables,
and are joined to what needs them: title words to the distinct letter runs that hold them, url words to the urls. So results do
not hang on either number, and no word is left out.

No url is labelled. The listed words stand in: a url that holds one of ``RISKY`` counts as an example to block, any other
as one to allow, over all rows. A word that alone made its url an example to block is no feature of that example. So what is learnt is
what comes along with listed words, and a listed word weighs what other listed words say of it. What is known of it beforehand
counts as little as being seen ``LISTED_SEEN`` times in an example to block: on a host without anything learnt, one listed word speaks
for blocking and two often decide it. The rules label nothing: they speak of whole domains and languages, whatever their words.

Rows: a null url, or one without ``://``, has an empty host and path, and no words; it gets the more frequent verdict. With no
examples at all the verdict is allow, as it is for equal probabilities. Repeated rows count, and are judged, each time. Of a page
only ``page_id``, ``url`` and the title in ``html`` are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from almoner.llm.common import Remembered, map_batches, slices, staged
from almoner.llm.html_consensus import host
from almoner.operators.lookup import lookup

# The rules in force: (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
# Words of sites to block, and of ordinary ones.
RISKY = (
    "adult ads affiliate bet bets betting bingo bonus casino cheap clickbait crack cracked escort free gambling hack jackpot"
    " keygen lottery malware nude pharma phishing pills poker porn replica scam sex slots spam torrent track tracker tracking"
    " viagra virus warez webcam win winner xxx"
).split()
ORDINARY = (
    "about academy art article articles blog book books city club code community company daily data design dev docs education farm"
    " food forum garden guide health help history home house info journal learn library life local music nature news online open"
    " paper photo post press project recipes research review school science shop sport sports store story studio team tech the"
    " times travel university video weather wiki work world www"
).split()
LEXICON = 50_000
LISTED_COUNT = 1000
LONGEST_WORD = 20
VOCABULARY = 100_000
ALPHA = 1.0
LISTED_SEEN = 1


def path(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host_column: Column, path_column: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null if none does."""
    name = verdict = F.lit(None).cast("string")
    for site, start, said in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host_column == site) | host_column.endswith("." + site)) & path_column.startswith(start)
        name = F.when(fits, F.lit(site + start)).otherwise(name)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


class Segmenter:
    """Splits a run of letters into its most likely words.

    ``total`` is the sum of all counts when ``counts`` holds only the most frequent words. Words of more than ``LONGEST_WORD`` letters
    must be known ones."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        self.total = max(1, sum(counts.values()) if total is None else total)
        self.log = {word: math.log(n / self.total) for word, n in counts.items()}
        self.long = {len(word) for word in counts if len(word) > LONGEST_WORD}
        self.unknown = math.log(0.1 / self.total)
        self.split = Remembered(self.divided, 50_000)

    def _cost(self, word: str) -> float:
        """Unknown words cost more the longer they are."""
        known = self.log.get(word)
        return self.unknown - 2.5 * len(word) if known is None else known

    def divided(self, run: str, more: dict[str, int] | None = None) -> tuple[str, ...]:
        """The words of ``run``; ``more`` are counts of words in it that are not among the most frequent."""
        rare = {word: math.log(n / self.total) for word, n in (more or {}).items()}
        long = sorted(self.long | {len(word) for word in rare if len(word) > LONGEST_WORD}, reverse=True)
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(run) + 1):
            options = []
            for s in range(max(0, end - LONGEST_WORD), end):
                word = run[s:end]
                options.append((best[s][0] + (rare[word] if word in rare else self._cost(word)), s))
            for length in long:
                word = run[max(0, end - length) : end]
                if length <= end and (word in rare or word in self.log):
                    options.append((best[end - length][0] + (rare[word] if word in rare else self.log[word]), end - length))
            best.append(max(options))
        out, end = [], len(run)
        while end:
            start = best[end][1]
            out.append(run[start:end])
            end = start
        return tuple(reversed(out))


_RUNS = re.compile(r"[a-z]+|[0-9]+|[^\x00-\x7f]+")


def _texts(host_text: str, path_text: str) -> tuple[tuple[str, str], ...]:
    return ("h:", host_text.rpartition(".")[0]), ("p:", path_text.lower())


def url_words(host_text: str, path_text: str, segmenter: Segmenter, known: dict[str, Sequence[str]] | None = None) -> list[str]:
    """Words of host (without its last label) and path; numbers count as ``#``. A word of the
    host is marked, as it weighs otherwise than one of the path. ``known`` are runs that were divided before."""
    out = []
    for mark, text in _texts(host_text, path_text):
        for run in _RUNS.findall(text):
            parts = ("#",) if run[0].isdigit() else known[run] if known and run in known else segmenter.split[run]
            out += [mark + word for word in parts]
    return out


@dataclass(frozen=True)
class Lexicon:
    """Counts of the words of all titles and of the listed words."""

    words: dict[str, int]  # the most frequent
    total: int  # of all
    rest: DataFrame | None  # word, n of the others
    long: tuple[int, ...]  # lengths over LONGEST_WORD among the others


def lexicon(pages: DataFrame) -> Lexicon:
    title = F.regexp_extract(F.lower(F.coalesce("html", F.lit(""))), r"(?s)<title[^>]*>([^<]*)", 1)
    word = F.explode(F.split(title, "[^a-z]+")).alias("word")
    counts = staged(pages.select(word).where("length(word) >= 2").groupBy("word").agg(F.count("*").alias("n")), "title-words")
    listed = sorted({*RISKY, *ORDINARY})
    found = {r["word"]: r["n"] for r in counts.orderBy(F.desc("n"), "word").limit(LEXICON).collect()}
    below = _below(counts, F.col("n"), list(found.items()), LEXICON)
    rest, long = None, ()
    if below is not None:
        found |= {r["word"]: r["n"] for r in below.where(F.col("word").isin(listed)).collect()}
        rest = below.where(~F.col("word").isin(listed))
        long = tuple(r[0] for r in rest.select(F.length("word")).where(f"length(word) > {LONGEST_WORD}").distinct().collect())
    total = (counts.agg(F.sum("n")).first()[0] or 0) + LISTED_COUNT * len([*RISKY, *ORDINARY])
    for word in (*RISKY, *ORDINARY):
        found[word] = found.get(word, 0) + LISTED_COUNT
    return Lexicon(found, total, rest, long)


def _below(counts: DataFrame, n: Column, top: list[tuple[str, int]], most: int) -> DataFrame | None:
    """The rows of ``counts`` after its ``top`` ones, which come by ``n`` and then by word; nothing if those may be all."""
    if len(top) < most:
        return None
    word, least = top[-1]
    return counts.where((n < least) | (n == least) & (F.col("word") > word))


@dataclass(frozen=True)
class Model:
    words: dict[str, int]
    prior: float  # log odds of block
    odds: dict[str, float]  # log odds of block for each word, the most frequent ones
    unseen: float
    lexicon: Lexicon | None = None
    sums: tuple[int, int, int] = (0, 0, 0)  # words to block, words to allow, distinct words
    rest: DataFrame | None = field(default=None)  # word, block, allow of the others


def _log_odds(sums: tuple[int, int, int], blocked: int, allowed: int) -> float:
    # Smoothing counts follow the classes' sizes, so a word that was never seen speaks for neither verdict. If a class has
    # no words, no word tells the classes apart.
    if not sums[0] or not sums[1]:
        return 0.0
    share = sums[0] / (sums[0] + sums[1])
    distinct = sums[2] + 1
    block, allow = 2 * ALPHA * share, 2 * ALPHA * (1 - share)
    return math.log((blocked + block) / (sums[0] + block * distinct)) - math.log((allowed + allow) / (sums[1] + allow * distinct))


_URLS = "page_id bigint, host string, path string, words array<string>"


def _urls(pages: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``page_id, host, path, words`` of every row."""
    url = F.col("url")
    parts = pages.select(host(url).alias("host"), path(url).alias("path"), F.col("page_id").cast("bigint").alias("page_id"))
    words, total = lexicon.words, lexicon.total
    if lexicon.rest is None:
        known = F.lit(None).cast("array<struct<run: string, parts: array<string>>>")
        rows = parts.select("host", "path", "page_id", known.alias("known"))
    else:
        parts = staged(parts.withColumn("row", F.monotonically_increasing_id()), "urls")
        divided = _divided(parts, lexicon)
        rows = parts.join(divided, "row", "left").select("host", "path", "page_id", "known")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(words, total)
        for batch in batches:
            for part in slices(batch):
                out = []
                for site, rest, known in zip(*(part.column(i).to_pylist() for i in (0, 1, 3))):
                    out.append(url_words(site, rest, segmenter, {k["run"]: k["parts"] for k in known or ()}))
                columns = [part.column(2), part.column(0), part.column(1), pa.array(out, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "host", "path", "words"])

    return map_batches(rows, run, _URLS)


def _divided(parts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """For each row the words of its letter runs that hold a word which is not among the most frequent: ``row, known``."""
    words, total, long = lexicon.words, lexicon.total, lexicon.long

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows, out = [], []
                for row, *texts in zip(*(part.column(i).to_pylist() for i in (2, 0, 1))):
                    found = {r for _, text in _texts(*texts) for r in _RUNS.findall(text) if not r[0].isdigit()}
                    rows += [row] * len(found)
                    out += sorted(found)
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(out, pa.string())], ["row", "run"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners: list[str] = []
        out: list[str] = []

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(owners, pa.string()), pa.array(out, pa.string())], ["run", "word"])

        lengths = [*range(2, LONGEST_WORD + 1), *long]
        for batch in batches:
            for run in batch.column(0).to_pylist():
                found = {run[s : s + n] for n in lengths if n <= len(run) for s in range(len(run) - n + 1)}
                found = [w for w in found if w not in words]
                owners += [run] * len(found)
                out += found
                if len(out) >= 20_000:
                    yield sent()
                    owners.clear()
                    out.clear()
        yield sent()

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(words, total)
        for batch in batches:
            known = batch.column(0).to_pylist()
            out = [segmenter.divided(r, {m["word"]: m["n"] for m in more}) for r, more in zip(known, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], ["run", "parts"])

    uses = map_batches(parts.select("host", "path", "row"), runs, "row bigint, run string")
    held = map_batches(uses.select("run").distinct(), pieces, "run string, word string").join(lexicon.rest, "word")
    held = held.groupBy("run").agg(F.collect_list(F.struct("word", "n")).alias("more"))
    divided = staged(map_batches(held, divide, "run string, parts array<string>"), "divided-runs")
    found = lookup(uses, divided, "run")
    return found.groupBy("row").agg(F.collect_list(F.struct("run", "parts")).alias("known"))


_RISKY = frozenset(RISKY)


def example(words: Sequence[str]) -> tuple[bool, list[str]]:
    """Whether the words of a url make it an example to block, and its features: all but a word that is the only reason."""
    reasons = {w[2:] for w in words} & _RISKY
    return bool(reasons), [w for w in words if len(reasons) > 1 or w[2:] not in reasons]


def train(pages: DataFrame) -> Model:
    found = lexicon(pages)
    return _train(_urls(pages, found), found)


def _train(urls: DataFrame, found: Lexicon) -> Model:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def sent() -> pa.RecordBatch:
            keys = list(counts)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([w for w, _ in keys], pa.string()),
                    pa.array([b for _, b in keys], pa.bool_()),
                    pa.array([counts[k] for k in keys], pa.int64()),
                ],
                ["word", "block", "n"],
            )

        for batch in batches:
            for words in batch.column(0).to_pylist():
                block, kept = example(words)
                counts.update((w, block) for w in kept)
                counts[None, block] += 1  # a url
            if len(counts) > 100_000:
                yield sent()
                counts.clear()
        if counts:
            yield sent()

    partial = map_batches(urls.select("words"), run, "word string, block boolean, n bigint")
    listed = [(mark + word, True, LISTED_SEEN) for mark, _ in _texts("", "") for word in RISKY]
    partial = partial.unionByName(urls.sparkSession.createDataFrame(listed, "word string, block boolean, n bigint"))
    block, allow = F.when(F.col("block"), F.col("n")).otherwise(0), F.when(F.col("block"), 0).otherwise(F.col("n"))
    counts = staged(partial.groupBy("word").agg(F.sum(block).alias("block"), F.sum(allow).alias("allow")), "url-words")
    sums = counts.groupBy(F.col("word").isNull().alias("urls")).agg(F.sum("block"), F.sum("allow"), F.count("*")).collect()
    words, n = counts.where("word IS NOT NULL"), F.col("block") + F.col("allow")
    top = words.orderBy(F.desc(n), "word").limit(VOCABULARY).collect()
    of = {r[0]: tuple(r[1:]) for r in sums}
    seen, total = of.get(True, (0, 0, 0)), of.get(False, (0, 0, 0))
    if not seen[0] or not seen[1] or not total[2]:  # one verdict only, or none
        return Model(found.words, 1.0 if seen[0] else -1.0, {}, 0.0, found)
    odds = {w: _log_odds(total, b, a) for w, b, a in top}
    rest = _below(words, n, [(w, b + a) for w, b, a in top], VOCABULARY)
    return Model(found.words, math.log(seen[0] / seen[1]), odds, _log_odds(total, 0, 0), found, total, rest)


def judge(pages: DataFrame, model: Model | None = None, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, block_probability`` of every row; the last is the classifier's."""
    if model is None:
        found = lexicon(pages)
        urls = _urls(pages, found) if found.rest is None else staged(_urls(pages, found), "url-words-of-rows")
        model = _train(urls, found)
    else:
        urls = _urls(pages, model.lexicon or Lexicon(model.words, sum(model.words.values()), None, ()))
    prior, odds, unseen, sums = model.prior, model.odds, model.unseen, model.sums
    if model.rest is None:
        rows = urls.withColumn("more", F.lit(None).cast("array<struct<word: string, block: bigint, allow: bigint>>"))
    else:
        urls = staged(urls.withColumn("row", F.monotonically_increasing_id()), "urls-to-judge")

        def outside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pairs = [(r, w) for r, words in zip(*(c.to_pylist() for c in batch.columns)) for w in set(words) if w not in odds]
                columns = [pa.array([r for r, _ in pairs], pa.int64()), pa.array([w for _, w in pairs], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["row", "word"])

        needed = map_batches(urls.select("row", "words"), outside, "row bigint, word string").join(model.rest, "word")
        more = needed.groupBy("row").agg(F.collect_list(F.struct("word", "block", "allow")).alias("more"))
        rows = urls.join(more, "row", "left").select("page_id", "host", "path", "words", "more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = []
                for words, more in zip(part.column(3).to_pylist(), part.column(4).to_pylist()):
                    rare = {m["word"]: _log_odds(sums, m["block"], m["allow"]) for m in more or ()}
                    total = prior + sum(rare[w] if w in rare else odds.get(w, unseen) for w in words)
                    out.append(1 / (1 + math.exp(-max(-700.0, min(700.0, total)))))
                columns = [part.column(0), part.column(1), part.column(2), pa.array(out, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "host", "path", "block_probability"])

    scored = map_batches(rows, run, "page_id bigint, host string, path string, block_probability double")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    learnt = F.when(F.col("block_probability") > 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learnt).alias("verdict"), "block_probability")
