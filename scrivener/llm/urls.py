"""URL filters: listed rules first, then naive Bayes over the words of host and path.

A unigram model with Viterbi search splits concatenated names into words ("cheappills" is cheap, pills). Its words and their
shares are counted on the corpus itself, over all rows. Multinomial naive Bayes scores the words of a URL: words of plain
addresses are drawn from the corpus, words of unwanted ones partly from listed topics, a parameter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, materialize, scratch

#: (verdict, host, path): a rule holds for its host and all subdomains where the path begins with its path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: Training rows of the unwanted class: words of topics that a corpus should not be fetched from.
TOPICS = {
    "gambling": "casino casinos poker roulette blackjack baccarat jackpot jackpots slots lottery betting bets bet bookmaker bookmakers gamble gambling wager sportsbook odds",
    "medicines": "pharmacy pharma drugstore pills pill tablets viagra cialis levitra steroids meds prescription slimming",
    "adult": "adult adults porn porno xxx sex sexy nude nudes naked erotic erotica escort escorts webcam cams fetish hentai hookup",
    "advertising": "ads ad adserver adserve banner banners popup popups tracker tracking track clicks pixel affiliate affiliates sponsor telemetry",
    "spam": "spam spammer farm linkfarm mailer bulk backlinks clickbait cheap free win winner winners prize prizes giveaway coupon coupons",
    "money": "loan loans payday lender casino forex bitcoin crypto doubler cash rich millionaire investment profit",
    "piracy": "warez crack cracked keygen serial torrent torrents pirate pirated nulled replica counterfeit",
    "fraud": "phishing phish malware virus trojan hacked scam fake fraud keylogger ransomware",
}
#: Share of an unwanted address's words that are drawn from the topics, share of unwanted addresses, letters of a word at most.
TOPIC_SHARE, PRIOR, MOST_WORD = 0.1, 0.2, 24
#: A corpus word is known if it makes up this share of all words at least: so no more than its inverse can be known.
LEAST_SHARE = 1 / 50_000
#: Share of words that nobody knows.
UNKNOWN_SHARE = 0.01


def word_shares(corpus: DataFrame, text_col: str = "html") -> dict[str, float]:
    """Share of each known word among all words of all rows; words are lower-cased runs of letters outside of <tags>.

    One aggregation over the whole corpus; at most 1 / LEAST_SHARE words reach the driver. Null texts have no words; an
    empty corpus knows no word.
    """
    plain = F.lower(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"(?s)<[^>]*>", " "))
    words = corpus.select(F.explode(F.regexp_extract_all(plain, F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    with scratch(corpus.sparkSession):
        counts = materialize(words.groupBy("word").agg(F.count("*").alias("n")), "words")
        total = counts.agg(F.sum("n")).first()[0] or 0
        known = counts.filter((F.col("n") >= total * LEAST_SHARE) & (F.length("word") <= MOST_WORD))
        return {r["word"]: r["n"] / total for r in known.collect()}


@dataclass
class Judge:
    """Unigram segmenter and naive Bayes. shares: of corpus words; topics: words of the unwanted class by topic."""

    shares: Mapping[str, float] = field(default_factory=dict)
    topics: Mapping[str, str] = field(default_factory=lambda: TOPICS)
    prior: float = PRIOR

    def __post_init__(self) -> None:
        listed = Counter(w for words in self.topics.values() for w in words.split())
        total = sum(listed.values())
        # a listed word that the corpus hardly has counts as half a least known one
        share = {w: max(self.shares.get(w, 0.0), LEAST_SHARE / 2) for w in (*self.shares, *listed)}
        self.cost = {w: -math.log(p) for w, p in share.items()}
        self.odds = {w: math.log((1 - TOPIC_SHARE) + TOPIC_SHARE * (n / total) / share[w]) for w, n in listed.items()}
        self.other = math.log(1 - TOPIC_SHARE)
        self.base = math.log(self.prior / (1 - self.prior))
        self.segment = lru_cache(100_000)(self._segment)

    def _unknown(self, n: int) -> float:
        """Cost of a stretch of n letters that is no known word, any letter as likely: one such stretch costs less than two."""
        return -math.log(UNKNOWN_SHARE) + n * math.log(26)

    def _segment(self, name: str) -> tuple[str, ...]:
        """The likeliest split of a run of letters into words; equal splits: the one with the longest last word.

        Words have at most MOST_WORD letters, so the search is linear in the length of the run.
        """
        best, cut = [0.0], [0]
        for end in range(1, len(name) + 1):
            options = []
            for begin in range(max(0, end - MOST_WORD), end):
                w = name[begin:end]
                options.append((best[begin] + min(self.cost.get(w, math.inf), self._unknown(end - begin)), begin))
            cost, begin = min(options)
            best.append(cost)
            cut.append(begin)
        words, end = [], len(name)
        while end:
            words.append(name[cut[end] : end])
            end = cut[end]
        return tuple(reversed(words))

    def words(self, host: str, path: str) -> list[str]:
        """Words of host and path; the last label of the host is no name. Long paths are read whole."""
        labels = host.rpartition(".")[0]
        return [w for run in re.findall(r"[^\W\d_]+", f"{labels}/{path}".lower()) for w in (self.segment(run) if len(run) <= 200 else self._segment(run))]

    def score(self, host: str, path: str) -> float:
        """Probability of block; the verdict is block above even odds."""
        odds = self.base + sum(self.odds.get(w, self.other) for w in self.words(host, path))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def host_of(url: Column) -> Column:
    # A-Z alone are lower-cased
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null; equally long ones: the first listed."""
    fits = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        test = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        hit = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        fits = F.when(test, hit) if fits is None else fits.when(test, hit)
    return fits if fits is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, judge: Judge | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each input row: page_id, host, path, rule, verdict, p_block, words (as the method splits host and path).

    Null, or no ``://``: host and path are empty, no rule fits, and without words the prior decides (allow). Rules outrank
    the model. Even odds allow. Repeated rows give repeated results; ids of any type come back as they are, null ones too; an
    empty table gives an empty result; other columns are not read.
    """
    judge = judge or Judge()
    shares, topics, prior = judge.shares, judge.topics, judge.prior
    own: list[Judge] = []  # one for each Python task

    def run(batch: dict[str, list], _: int) -> Iterator[tuple[None, dict]]:
        if not own:
            own.append(Judge(shares, topics, prior))
        urls = list(zip(batch["_host"], batch["_path"], strict=True))
        yield None, {"p_block": [own[0].score(h, p) for h, p in urls], "words": [" ".join(own[0].words(h, p)) for h, p in urls]}

    url = F.col(url_col)
    parts = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    scored = in_arrow(parts.select("*", F.col("host").alias("_host"), F.col("path").alias("_path")), run, "p_block double, words string", ["page_id", "host", "path"])
    rule = rule_of(F.col("host"), F.col("path"), rules)
    return scored.withColumn("r", rule).select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce("r.verdict", F.when(F.col("p_block") > 0.5, "block").otherwise("allow")).alias("verdict"), "p_block", "words",
    )
