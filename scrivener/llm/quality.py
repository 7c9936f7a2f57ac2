"""Quality rules by weak supervision (native: DataFrame and SQL functions only).

Every rule votes good (1), bad (-1) or abstains (0) on a document. Expectation-maximisation over the table of vote
patterns (at most 3^rules rows, however many documents there are) estimates the share of good documents and how often each
rule votes good, bad or abstains in either class, and so what each of the three is worth. The posterior probability of
"good" replaces the demand that all rules pass. Nothing is clamped and no label is read: the only knowledge put in is where
EM starts, documents with two bad votes or more as bad, since every fault is seen by two rules or more.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, materialize, text_of

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
STOPS = ".!?"


@dataclass(frozen=True)
class Rule:
    """good and bad are SQL predicates over the columns of ``features``; where neither holds the rule abstains."""

    name: str
    good: str
    bad: str


#: Each fault is seen by two rules or more, from different counts: their agreement is what EM learns accuracies from.
RULES = (
    Rule("length", "n_words >= 100", "n_words < 50"),
    Rule("mean_word", "10 * word_chars between 35 * n_words and 65 * n_words", "word_chars < 3 * n_words or word_chars > 7 * n_words"),
    Rule("symbols", "20 * n_symbols <= n_words", "5 * n_symbols > n_words"),
    Rule("symbol_chars", "200 * n_symbols <= word_chars", "20 * n_symbols > word_chars"),
    Rule("punctuation", "100 * n_punctuation <= 6 * word_chars", "100 * n_punctuation > 12 * word_chars"),
    Rule("sentences", "40 * n_stops >= n_words", "100 * n_stops < n_words"),
    Rule("dup_lines", "20 * n_dup_lines <= n_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("repeats", "20 * n_repeat_words <= n_words", "5 * n_repeat_words > n_words"),
    Rule("capitals", "200 * n_capitals >= word_chars and 20 * n_capitals <= word_chars", "5 * n_capitals > word_chars or n_capitals = 0"),
    Rule("variety", "2 * n_distinct >= n_words", "10 * n_distinct < 3 * n_words"),
)
#: Imagined documents of every outcome, so that no rate is 0; steps of expectation-maximisation; the first guess of what a bad
#: vote, none and a good vote are worth: nine good votes outweigh one bad vote, eight don't outweigh two.
PSEUDO, ITERATIONS, START = 1.0, 25, (-2.0, 0.0, 0.25)

# The lambda over a one-element array binds a value once; a plain alias could be expanded at every use.
_REPEATS = """
transform(array(sort_array(slice(transform(w, (x, i) -> named_struct('h', xxhash64(x, get(w, i + 1), get(w, i + 2)), 'p', i)),
                                 1, greatest(size(w) - 2, 0)))),
  s -> aggregate(
    sort_array(transform(filter(s, (x, i) -> get(s, i - 1).h = x.h or get(s, i + 1).h = x.h), x -> x.p)),
    named_struct('e', 0, 'n', 0),
    (a, p) -> named_struct('e', p + 3, 'n', a.n + p + 3 - greatest(p, a.e)),
    a -> a.n))[0]
"""
_WORDS = rf"""
transform(array(regexp_extract_all(_t, r'[^\x20\x09-\x0D]+', 0)), w -> named_struct(
  'n_words', size(w), 'n_distinct', size(array_distinct(w)), 'n_repeat_words', {_REPEATS}))[0]
"""
_LINES = r"""
transform(array(filter(split(_t, '\n'), x -> x rlike r'[^\x20\x09-\x0D]')), l -> named_struct(
  'n_lines', size(l), 'n_dup_lines', size(l) - size(array_distinct(l))))[0]
"""


def _counted(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """The columns ``keep`` and the counts of every whole text."""
    counted = docs.select(*keep, text_of(text_col).alias("_t")).select(
        *keep,
        F.expr(_WORDS).alias("_w"),
        F.expr(_LINES).alias("_l"),
        (F.length("_t") - F.length(F.translate("_t", BLANKS, ""))).alias("_blanks"),
        F.length("_t").alias("_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).alias("_symbols"),
        (F.length("_t") - F.length(F.translate("_t", CAPITALS, ""))).alias("_capitals"),
        (F.length("_t") - F.length(F.translate("_t", PUNCTUATION, ""))).alias("_punctuation"),
        (F.length("_t") - F.length(F.translate("_t", STOPS, ""))).alias("_stops"),
    )
    long = lambda c, name: c.cast("long").alias(name)
    counts = [
        long(F.col("_w.n_words"), "n_words"),
        long(F.col("_chars") - F.col("_blanks"), "word_chars"),
        long(F.col("_symbols"), "n_symbols"),
        long(F.col("_l.n_dup_lines"), "n_dup_lines"),
        long(F.col("_w.n_repeat_words"), "n_repeat_words"),
        long(F.col("_l.n_lines"), "n_lines"),
        long(F.col("_capitals"), "n_capitals"),
        long(F.col("_w.n_distinct"), "n_distinct"),
        long(F.col("_punctuation"), "n_punctuation"),
        long(F.col("_stops"), "n_stops"),
    ]
    return counted.select(*keep, *counts)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of every whole text; one row for each input row, null text as the empty text.

    A word belongs to n_repeat_words if it lies in a window of three words whose 64-bit hash occurs twice or more.
    """
    return _counted(docs, [id_col], text_col)


def votes(rules: tuple[Rule, ...] = RULES) -> Column:
    return F.array(*[F.when(F.expr(r.bad), -1).when(F.expr(r.good), 1).otherwise(0) for r in rules])


#: What a fit returns: log odds of the share of good documents, and for each rule the log odds of a bad vote, none, a good one.
Model = tuple[float, list[list[float]]]


def fit(counted: DataFrame, rules: tuple[Rule, ...] = RULES) -> Model:
    """The model by EM over the counts of vote patterns.

    One aggregation over all documents; the loop runs inside one SQL expression on one row of at most 3^rules patterns,
    starting from START. An empty table gives even odds.
    """
    k = len(rules)
    patterns = (
        counted.groupBy(votes(rules).alias("v"))
        .agg(F.count("*").cast("double").alias("n"))
        .agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("pats"))
    )
    # w is the posterior of "good"; the sums of both classes over all patterns, and over those in which rule j casts the vote
    total = lambda w, test="true": f"aggregate(ps, 0D, (a, r) -> a + case when {test} then r.n * {w} else 0D end)"
    good, bad = "r.w", "(1D - r.w)"
    rate = lambda w, vote: f"({total(w, f'r.v[j] = {vote}')} + {PSEUDO}D) / ({total(w)} + {3 * PSEUDO}D)"
    worth = ", ".join(f"ln(({rate(good, vote)}) / ({rate(bad, vote)}))" for vote in (-1, 0, 1))
    odds = f"aggregate(sequence(0, {k} - 1), m.b, (o, j) -> o + m.l[j][r.v[j] + 1])"
    posts = f"transform(pats, r -> named_struct('v', r.v, 'n', r.n, 'w', 1D / (1D + exp(-{odds}))))"
    step = f"""transform(array({posts}), ps -> named_struct(
        'b', ln(({total(good)} + {PSEUDO}D) / ({total(bad)} + {PSEUDO}D)),
        'l', transform(sequence(0, {k} - 1), j -> array({worth}))))[0]"""
    start = f"named_struct('b', 0D, 'l', array_repeat(array({', '.join(f'{x}D' for x in START)}), {k}))"
    model = patterns.select(F.expr(f"aggregate(sequence(1, {ITERATIONS}), {start}, (m, t) -> {step})").alias("m")).first()["m"]
    return model["b"], [list(x) for x in model["l"]]


def posterior(model: Model, rules: tuple[Rule, ...] = RULES) -> Column:
    b, worth = model
    odds = F.lit(b)
    for r, (bad, none, good) in zip(rules, worth, strict=True):
        odds = odds + F.when(F.expr(r.bad), bad).when(F.expr(r.good), good).otherwise(none)
    return 1 / (1 + F.exp(-odds))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each input row: its counts, base_failed, the posterior probability of "good" and kept.

    base_failed: n_words < 50 or 100 * n_repeat_words > 50 * n_words. kept: not base_failed and posterior >= 0.5.
    Null and empty texts have no words, so base_failed holds. Repeated rows give repeated results, null ids stay null; other
    columns are ignored. An empty table gives an empty result.
    """
    counted = materialize(features(docs, id_col, text_col), "quality")
    return _judged(counted, fit(counted, rules), rules)


def _judged(counted: DataFrame, model: Model, rules: tuple[Rule, ...]) -> DataFrame:
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.select("*", failed.alias("base_failed"), posterior(model, rules).alias("p_good")).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def drop_low_quality(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that the rules keep, with all their columns, whatever their names.

    The documents are written once beside their counts, so that texts are counted once and nothing is joined or shuffled.
    """
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), docs[text_col].alias("_text"))
    counted = materialize(_counted(packed, ["_doc"], "_text"), "quality-docs")
    kept = _judged(counted, fit(counted, rules), rules).filter("kept")
    return kept.select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])
