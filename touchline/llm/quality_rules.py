"""Quality by weak supervision: rules vote or abstain, and expectation-maximisation weighs them.

Everything that touches rows is a DataFrame expression. The fit needs only how often each pattern of votes
occurs (at most 3 ** len(RULES) rows, whatever the input), and runs on those counts.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.lineage import cut_lineage

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5  # words
MIN_WORDS, MOST_REPEATED = 10, 20  # base rules: fewest words, largest share of repeated words in percent
# A rule's ratio (numerator * per over denominator): under `good` it votes for quality, over `bad` against, else it abstains.
# (name, numerator, denominator, good, bad)
RULES = (
    ("length", "100", "n_words", 4.0, 8.0),
    ("long_words", "word_chars", "n_words", 8.0, 12.0),
    ("short_words", "n_words", "word_chars", 0.34, 0.5),
    ("symbols", "n_symbols", "n_words", 0.02, 0.1),
    ("shouting", "n_marks", "n_words", 0.05, 0.3),
    ("capitals", "n_capitals", "word_chars", 0.1, 0.4),
    ("lines", "n_dup_lines", "n_lines", 0.1, 0.3),
    ("repetition", "n_repeat_words", "n_words", 0.02, 0.1),
)
ROUNDS = 20
START_ACCURACY, START_PRIOR = 0.8, 0.8


def _size_without(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def repeated_words(windows: Column) -> Column:
    """Words covered by windows that occur twice or more; ``windows`` holds the window that begins at each word."""
    places = F.transform(windows, lambda w, i: F.struct(F.xxhash64(w).alias("h"), i.alias("i")))

    def covered(s: Column) -> Column:
        at = F.transform(s, lambda x, j: F.when(
            ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | (F.get(s, j + 1)["h"] == x["h"]), x["i"]))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(
            F.sort_array(F.filter(at, lambda i: i.isNotNull())), start,
            lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")), lambda a: a["n"])

    # the sorted places are bound to a name once: a lambda over a list of one
    several = F.element_at(F.transform(F.array(F.sort_array(places)), covered), 1)
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), several).otherwise(0).cast("long")


def with_counts(rows: DataFrame, text: Column) -> DataFrame:
    """``rows`` and a column ``q`` of counts of the whole ``text`` (NULL: empty): those of the base rules and those of :data:`RULES`."""
    clean = F.coalesce(text.cast("string"), F.lit(""))
    words = F.trim(F.regexp_replace(clean, SPACE, " "))
    window = "(?<![^ ])(?=(" + " ".join(["[^ ]++"] * WINDOW) + "))"
    lines = F.filter(F.split(clean, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    staged = rows.withColumn("_words", words).withColumn("_windows", F.regexp_extract_all("_words", F.lit(window), 1)).withColumn("_lines", lines)
    n_words = F.when(F.col("_words") == "", 0).otherwise(_size_without(F.col("_words"), " ") + 1).cast("long")
    return staged.withColumn("q", F.struct(
        n_words.alias("n_words"), F.length(F.regexp_replace("_words", " ", "")).cast("long").alias("word_chars"),
        _size_without(F.col("_words"), r"[#*$%&|<>]").cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_windows")).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"), _size_without(F.col("_words"), "!").cast("long").alias("n_marks"),
        _size_without(F.col("_words"), "[A-Z]").cast("long").alias("n_capitals"))).drop("_words", "_windows", "_lines")


def base_failed() -> Column:
    return (F.col("q.n_words") < MIN_WORDS) | (100 * F.col("q.n_repeat_words") > MOST_REPEATED * F.col("q.n_words"))


def pattern() -> Column:
    """The votes of all rules as one number: a digit 0 (against), 1 (abstains) or 2 (for) each. No words: all abstain."""
    out = F.lit(0)
    for _, top, under, good, bad in RULES:
        top = F.lit(float(top)) if top.isdigit() else F.col(f"q.{top}").cast("double")
        under = F.col(f"q.{under}").cast("double")
        vote = F.when(under == 0, 1).when(top > bad * under, 0).when(top <= good * under, 2).otherwise(1)
        out = out * 3 + vote
    return out


def fit(counts: dict[int, int], rounds: int = ROUNDS) -> dict[int, float]:
    """Posterior probability of quality for each pattern, by expectation-maximisation over the counts of patterns.

    Given the class, a rule that does not abstain is right with a probability of its own; abstaining tells nothing.
    Sums start from one right vote in ``START_ACCURACY`` and one wrong in the rest, so that no accuracy is 0 or 1.
    """
    n = len(RULES)
    votes = {p: [p // 3 ** (n - 1 - i) % 3 - 1 for i in range(n)] for p in counts}
    prior, right = START_PRIOR, [[START_ACCURACY] * n, [START_ACCURACY] * n]  # of class 0 (poor) and 1 (good)
    post: dict[int, float] = {}
    for _ in range(rounds):
        for p, v in votes.items():
            odds = log(prior / (1 - prior)) + sum(
                log(right[1][i] / (1 - right[0][i])) if x > 0 else log((1 - right[1][i]) / right[0][i]) for i, x in enumerate(v) if x)
            post[p] = 1 / (1 + exp(-odds)) if odds > -700 else 0.0
        weight = [{p: c * (1 - post[p]) for p, c in counts.items()}, {p: c * post[p] for p, c in counts.items()}]
        good, total = sum(weight[1].values()), sum(counts.values())
        prior = (good + START_PRIOR) / (total + 1)
        for c, sign in ((0, -1), (1, 1)):
            for i in range(n):
                voted = sum(w for p, w in weight[c].items() if votes[p][i])
                hit = sum(w for p, w in weight[c].items() if votes[p][i] == sign)
                right[c][i] = (hit + START_ACCURACY) / (voted + 1)
    return post


def posteriors(patterns: DataFrame) -> dict[int, float]:
    """From a DataFrame with a column ``pattern``: only its counts, at most 3 ** len(RULES) rows, come to the driver."""
    return fit({r["pattern"]: r["n"] for r in patterns.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()})


def _known(post: dict[int, float], threshold: float) -> Column:
    good = sorted(p for p, x in post.items() if x >= threshold)
    return F.col("pattern").isin(good) if good else F.lit(False)


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """For every row of ``docs``: ``doc_id``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``base_failed`` and ``kept``.

    A row is kept if no base rule fails and the posterior of its votes reaches ``threshold``. NULL and empty texts have
    no words and fail the base rules. A NULL doc_id stays NULL, repeated rows are judged alike, an empty table gives an
    empty result, other columns are left aside. Windows are compared by 64-bit hashes within a text.
    """
    counted = with_counts(docs.select("doc_id", F.col("text").alias("_text")), F.col("_text"))
    rows = cut_lineage(counted.select("doc_id", "q.*", base_failed().alias("base_failed"), pattern().alias("pattern")))
    kept = ~F.col("base_failed") & _known(posteriors(rows), threshold)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def drop_poor(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The kept rows of ``docs``, columns as they are."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").alias("_text"))
    rows = with_counts(whole, F.col("_text")).select("_row", base_failed().alias("failed"), pattern().alias("pattern"))
    return rows.filter(~F.col("failed") & _known(posteriors(rows), threshold)).select("_row.*")


def oracle() -> str:
    """DuckDB SQL of :func:`judge`; every round of the fit is a pair of sub-queries."""
    space = r"[\x20\x09-\x0D]+"
    digits = []
    for _, top, under, good, bad in RULES:
        digits.append(f"CASE WHEN {under} = 0 THEN 1 WHEN CAST({top} AS DOUBLE) > {bad} * {under} THEN 0 WHEN CAST({top} AS DOUBLE) <= {good} * {under} THEN 2 ELSE 1 END")
    code = "0"
    for d in digits:
        code = f"({code}) * 3 + {d}"
    n = len(RULES)
    logs = " + ".join(
        f"CASE v{i} WHEN 1 THEN ln(g{i} / (1 - b{i})) WHEN -1 THEN ln((1 - g{i}) / b{i}) ELSE 0 END" for i in range(n))
    rounds = [f"m0 AS (SELECT {START_PRIOR} AS prior, " + ", ".join(f"{START_ACCURACY} AS g{i}, {START_ACCURACY} AS b{i}" for i in range(n)) + ")"]
    share = lambda cls, sign, i: (
        f"(coalesce(sum(c * {cls}) FILTER (v{i} = {sign}), 0) + {START_ACCURACY}) / (coalesce(sum(c * {cls}) FILTER (v{i} <> 0), 0) + 1)")
    for r in range(1, ROUNDS + 1):
        rounds.append(f"e{r} AS MATERIALIZED (SELECT p.*, 1 / (1 + exp(-(ln(prior / (1 - prior)) + {logs}))) AS post FROM p, m{r - 1})")
        rounds.append(f"m{r} AS MATERIALIZED (SELECT (sum(c * post) + {START_PRIOR}) / (sum(c) + 1) AS prior, " + ", ".join(
            f"{share('post', 1, i)} AS g{i}, {share('(1 - post)', -1, i)} AS b{i}" for i in range(n)) + f" FROM e{r})")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT r, i, list_aggregate(words[i:i + {WINDOW - 1}], 'string_agg', ' ') AS gram
      FROM (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) >= {WINDOW})),
t AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS after FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, sum(least({WINDOW}, coalesce(after - i, {WINDOW}))) AS n FROM t GROUP BY r),
q AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{space}', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
        len(lines) AS n_lines, length(text) - length(replace(text, '!', '')) AS n_marks,
        length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals
      FROM w LEFT JOIN rep USING (r)),
v AS MATERIALIZED (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, {code} AS pattern FROM q),
p AS MATERIALIZED (SELECT pattern, CAST(count(*) AS DOUBLE) AS c, {", ".join(f"CAST(pattern // {3 ** (n - 1 - i)} % 3 - 1 AS INTEGER) AS v{i}" for i in range(n))} FROM v GROUP BY pattern),
{", ".join(rounds)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND post >= 0.5 AS kept
FROM v JOIN e{ROUNDS} USING (pattern)"""
