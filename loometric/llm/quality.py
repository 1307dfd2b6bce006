"""Quality rules as weak supervision, in DataFrame operations only.

Six rules look at a text and vote good (1), bad (-1) or abstain (0). How far each rule can be
trusted is not set by hand: expectation-maximisation over the votes of all documents estimates
how often it is right, and how common each class is. A document is kept when its posterior
probability of being good is at least one half, unless it fails the base rule. Junk of one sort
breaks the rule about it and passes the others, so there is a class of bad documents for each rule
beside the good ones, and each class has its own rate of bad votes for each rule.

The votes of a document are one of 3 ** 6 patterns, so expectation-maximisation works on at
most 729 counted patterns, whatever the size of the corpus: each round is one aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loometric.functions import computed
from loometric.llm.common import stored

RULES = ("symbols", "word_length", "line_copies", "repetition", "capitals", "sentences")
ROUNDS = 10
# Shares of bad votes among a rule's votes: (start, least, most) on good documents, on the bad ones
# that the rule is about, and on other bad ones. The bounds only keep the classes what they are named for: a bad class breaks its own
# rule more often than not, and no bad class is common. A rule may turn out to be wrong on nearly all good documents.
ON_GOOD = (0.005, 0.0005, 0.95)
ON_OWN = (0.9, 0.5, 0.99)
ON_OTHER = (0.1, 0.005, 0.9)
# Share of each bad class: (start, least, most).
SHARE = (0.03, 0.0005, 0.15)

_SPACE = r"[\x20\x09-\x0D]"
_SPACES = " \t\n\x0b\x0c\r"


def _limits(k: int, j: int) -> tuple[float, float, float]:
    """Start and bounds of the share of bad votes of rule j in class k; class 0 is good, class j + 1 is about rule j."""
    return ON_GOOD if k == 0 else ON_OWN if k == j + 1 else ON_OTHER


@dataclass(frozen=True)
class RuleModel:
    """Share of each class, the good one first, and in each class the share of bad votes among each rule's votes."""

    shares: tuple[float, ...]
    bad: tuple[tuple[float, ...], ...]


def start_model() -> RuleModel:
    n = len(RULES)
    return RuleModel((1 - n * SHARE[0], *(SHARE[0],) * n), tuple(tuple(_limits(k, j)[0] for j in range(n)) for k in range(n + 1)))


def measured(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``row`` (the whole given row) and what the rules look at.

    A null text counts as empty, with zeros everywhere. Texts of any length are used whole.
    """
    start = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("t"))
    trimmed = F.btrim("t", F.lit(_SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPACE + "+"))
    lines = F.filter(F.split("t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    split = computed(start, w=words, lines=lines)

    def triple(i: Column) -> Column:
        return F.concat_ws(" ", F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))

    none = F.array().cast("array<string>")
    counted = computed(
        split,
        n_words=F.size("w").cast("bigint"),
        word_chars=F.length(F.array_join("w", "")).cast("bigint"),
        n_symbols=F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("bigint"),
        n_lines=F.size("lines").cast("bigint"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint"),
        n_capitals=F.regexp_count("t", F.lit("[A-Z]")).cast("bigint"),
        n_ends=F.regexp_count("t", F.lit("[.!?]")).cast("bigint"),
        triples=F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), triple)).otherwise(none),
    ).drop("t", "w", "lines")
    # copies of a triple stand side by side once sorted; most texts have none and skip the sort
    numbered = F.sort_array(F.transform("triples", lambda t, i: F.struct(t.alias("t"), i.alias("i"))))
    no_marks = F.array().cast("array<struct<t:string,i:int>>")
    marks = F.when(F.size(F.array_distinct("triples")) == F.size("triples"), no_marks).otherwise(numbered)
    sorted_triples = computed(counted, marks=marks).drop("triples")

    def again(x: Column, i: Column) -> Column:
        return (F.get("marks", i - 1)["t"] == x["t"]) | (F.get("marks", i + 1)["t"] == x["t"])

    repeated = F.filter("marks", again)
    covered = F.array_distinct(F.flatten(F.transform(repeated, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    return computed(sorted_triples, n_repeat_words=F.size(covered).cast("bigint")).drop("marks")


def _vote(good: Column, bad: Column, speaks: Column) -> Column:
    return F.when(~speaks, 0).when(bad, -1).when(good, 1).otherwise(0)


def votes() -> dict[str, Column]:
    """The rules over the columns of ``measured``."""
    n, chars = F.col("n_words"), F.col("word_chars")
    some, enough = n > 0, n >= 20
    return {
        "symbols": _vote(100 * F.col("n_symbols") <= 2 * n, 10 * F.col("n_symbols") > n, some),
        "word_length": _vote((chars >= 3 * n) & (chars <= 9 * n), (chars < 2 * n) | (chars > 20 * n), some),
        "line_copies": _vote(10 * F.col("n_dup_lines") <= F.col("n_lines"), 10 * F.col("n_dup_lines") > 4 * F.col("n_lines"),
                             F.col("n_lines") >= 2),
        "repetition": _vote(10 * F.col("n_repeat_words") <= n, 2 * F.col("n_repeat_words") > n, enough),
        "capitals": _vote(10 * F.col("n_capitals") <= chars, 10 * F.col("n_capitals") > 3 * chars, some),
        "sentences": _vote((200 * F.col("n_ends") >= n) & (3 * F.col("n_ends") <= n),
                           (F.col("n_ends") == 0) | (2 * F.col("n_ends") > n), enough),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def with_votes(features: DataFrame) -> DataFrame:
    return features.select("*", *[v.alias(f"vote_{name}") for name, v in votes().items()], base_failed().alias("base_failed"))


def class_weights(model: RuleModel) -> list[Column]:
    """For each class its share times the probability of the votes."""
    # written as SQL: a few expressions for Spark to read instead of hundreds of calls to build them
    found = []
    for share, rates in zip(model.shares, model.bad):
        parts = [f"CASE vote_{name} WHEN -1 THEN {rate!r}D WHEN 1 THEN {1 - rate!r}D ELSE 1D END" for name, rate in zip(RULES, rates)]
        found.append(F.expr(" * ".join([f"{share!r}D", *parts])))
    return found


def quality_of(model: RuleModel) -> Column:
    """Posterior probability that a document is good."""
    weights = class_weights(model)
    return weights[0] / reduce(lambda a, b: a + b, weights)


def fit(voted: DataFrame, rounds: int = ROUNDS) -> RuleModel:
    """Expectation-maximisation over the votes of all rows of ``voted``.

    The patterns are counted in one pass. Without any row the start values come back.
    """
    columns = [f"vote_{name}" for name in RULES]
    patterns = stored(voted.groupBy(*columns).agg(F.count(F.lit(1)).alias("c")).coalesce(1), "vote-patterns")
    model = start_model()
    classes = range(len(RULES) + 1)
    for _ in range(rounds):
        weighed = patterns.select("*", *[w.alias(f"w{k}") for k, w in enumerate(class_weights(model))])
        total = " + ".join(f"w{k}" for k in classes)
        shares_of = F.array(*[F.expr(f"c * w{k} / ({total})") for k in classes])
        mine = weighed.select(*columns, F.posexplode(shares_of).alias("k", "r"))
        sums = [F.sum("r").alias("n")]
        for j, column in enumerate(columns):
            sums.append(F.expr(f"sum(CASE WHEN {column} = -1 THEN r ELSE 0D END) AS bad{j}"))
            sums.append(F.expr(f"sum(CASE WHEN {column} <> 0 THEN r ELSE 0D END) AS all{j}"))
        found = {row["k"]: row for row in mine.groupBy("k").agg(*sums).collect()}  # one row for each class
        if not found:
            return model
        rows = sum(found[k]["n"] for k in classes)
        shares = [_bounded(found[k]["n"], rows, SHARE) for k in classes[1:]]
        rates = tuple(tuple(_bounded(found[k][f"bad{j}"], found[k][f"all{j}"], _limits(k, j)) for j in range(len(RULES))) for k in classes)
        model = RuleModel((1 - sum(shares), *shares), rates)
    return model


def _bounded(part: float, whole: float, limits: tuple[float, float, float]) -> float:
    start, least, most = limits
    return min(most, max(least, part / whole)) if whole > 0 else start


def judged(voted: DataFrame, model: RuleModel) -> DataFrame:
    """``voted`` with the posterior probability ``quality`` and the verdict ``kept``."""
    with_quality = voted.withColumn("quality", quality_of(model))
    return with_quality.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


def quality_rules(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Measures, votes, posterior and verdict of every row of ``docs``, beside its id.

    Null and empty texts have no words and fail the base rule. Rows are judged one by one, so
    repeated rows and repeated ids give a row each. An empty table gives an empty result.
    The measures are small next to the texts; they are written once and used for fitting and for judging.
    """
    features = with_votes(measured(docs, text_column)).withColumn("id", F.col("row").getField(id_column)).drop("row")
    kept = stored(features, "quality-features")
    return judged(kept, fit(kept)).withColumnRenamed("id", id_column)


def filtered(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    The measures are taken twice, for fitting and for filtering: texts never pass a shuffle.
    """
    model = fit(with_votes(measured(docs, text_column)))
    return judged(with_votes(measured(docs, text_column)), model).where("kept").select("row.*")


# --- the same in SQL --------------------------------------------------------------

_SQL_MEASURES = r"""
texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM {table}),
words AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM texts),
triples AS (SELECT r, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS tri
    FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
copies AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, tri) AS n FROM triples) WHERE n >= 2),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM copies, (VALUES (0), (1), (2)) AS steps(k) GROUP BY r),
measures AS (SELECT words.r, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    len(regexp_extract_all(t, '[A-Z]'))::BIGINT AS n_capitals, len(regexp_extract_all(t, '[.!?]'))::BIGINT AS n_ends,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words
    FROM words LEFT JOIN covered USING (r)),
voted AS MATERIALIZED (SELECT *,
    CASE WHEN n_words = 0 THEN 0 WHEN 10 * n_symbols > n_words THEN -1 WHEN 100 * n_symbols <= 2 * n_words THEN 1 ELSE 0 END AS v0,
    CASE WHEN n_words = 0 THEN 0 WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN -1
        WHEN word_chars >= 3 * n_words AND word_chars <= 9 * n_words THEN 1 ELSE 0 END AS v1,
    CASE WHEN n_lines < 2 THEN 0 WHEN 10 * n_dup_lines > 4 * n_lines THEN -1 WHEN 10 * n_dup_lines <= n_lines THEN 1 ELSE 0 END AS v2,
    CASE WHEN n_words < 20 THEN 0 WHEN 2 * n_repeat_words > n_words THEN -1
        WHEN 10 * n_repeat_words <= n_words THEN 1 ELSE 0 END AS v3,
    CASE WHEN n_words = 0 THEN 0 WHEN 10 * n_capitals > 3 * word_chars THEN -1 WHEN 10 * n_capitals <= word_chars THEN 1 ELSE 0 END AS v4,
    CASE WHEN n_words < 20 THEN 0 WHEN n_ends = 0 OR 2 * n_ends > n_words THEN -1
        WHEN 200 * n_ends >= n_words AND 3 * n_ends <= n_words THEN 1 ELSE 0 END AS v5,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
    FROM measures),
patterns AS MATERIALIZED (SELECT v0, v1, v2, v3, v4, v5, count(*) AS c FROM voted GROUP BY ALL)
"""


def sql_steps(table: str = "documents", rounds: int = ROUNDS) -> str:
    """Common table expressions of the whole method; the last one is ``judged``."""
    n = len(RULES)
    start = start_model()
    classes, rules = range(n + 1), range(n)
    first = [f"{start.shares[k]}::DOUBLE AS s{k}" for k in classes] + [f"{start.bad[k][j]}::DOUBLE AS p{k}_{j}" for k in classes for j in rules]
    steps = [_SQL_MEASURES.format(table=table).strip(), f"m0 AS (SELECT {', '.join(first)})"]

    def weight(k: int) -> str:
        return " * ".join([f"s{k}"] + [f"CASE v{j} WHEN -1 THEN p{k}_{j} WHEN 1 THEN 1 - p{k}_{j} ELSE 1 END" for j in rules])

    def bounded(part: str, whole: str, limits: tuple[float, float, float]) -> str:
        return f"CASE WHEN {whole} > 0 THEN least({limits[2]}, greatest({limits[1]}, {part} / {whole})) ELSE {limits[0]} END"

    weights = ", ".join(f"{weight(k)} AS w{k}" for k in classes)
    total = "(" + " + ".join(f"w{k}" for k in classes) + ")"
    for step in range(1, rounds + 1):
        sums = [f"sum(r{k}) AS n{k}" for k in classes]
        sums += [f"sum(CASE WHEN v{j} = -1 THEN r{k} ELSE 0 END) AS b{k}_{j}, sum(CASE WHEN v{j} <> 0 THEN r{k} ELSE 0 END) AS a{k}_{j}"
                 for k in classes for j in rules]
        rows = "(" + " + ".join(f"n{k}" for k in classes) + ")"
        shares = [bounded(f"n{k}", rows, SHARE) for k in classes[1:]]
        values = [f"1 - ({' + '.join(shares)}) AS s0"] + [f"{share} AS s{k}" for k, share in zip(classes[1:], shares)]
        values += [f"{bounded(f'b{k}_{j}', f'a{k}_{j}', _limits(k, j))} AS p{k}_{j}" for k in classes for j in rules]
        steps.append(f"e{step} AS MATERIALIZED (SELECT {', '.join(sums)} FROM (SELECT *, "
                     + ", ".join(f"c * w{k} / {total} AS r{k}" for k in classes)
                     + f" FROM (SELECT patterns.*, {weights} FROM patterns, m{step - 1})))")
        steps.append(f"m{step} AS MATERIALIZED (SELECT {', '.join(values)} FROM e{step})")
    steps.append(f"judged AS (SELECT *, NOT base_failed AND w0 / {total} >= 0.5 AS kept FROM "
                 f"(SELECT voted.*, {weights} FROM voted, m{rounds}))")
    return ",\n".join(steps)
