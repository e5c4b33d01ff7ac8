"""Quality rules as weak supervision, in DataFrame functions only.

Each rule looks at a few measures of a text and votes good (1), bad (0) or abstains (null). Expectation-maximisation over the counted vote patterns
(at most 3 to the number of rules, whatever the data) estimates how often each rule votes bad on good and on bad texts, and the share of good
texts. A text is kept if the posterior probability that it is good reaches a threshold, and the base limits hold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import stored, text_or_empty, unused

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MARKS = "!\"#$%&()*+,./:;<=>?@[]^_`{|}~"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
ROUNDS = 20
KEEP_FROM = 0.5


def let(value: Column, use) -> Column:
    """use(value) with value computed once, however often use refers to it."""
    return F.transform(F.array(value), use)[0]


def _neighbours(items: Column, pair) -> Column:
    """pair(a, b) for each two neighbouring items."""
    rest = F.greatest(F.size(items) - 1, F.lit(0))
    return F.zip_with(F.slice(items, F.lit(1), rest), F.slice(items, F.lit(2), rest), pair)


def repeated_words(words: Column) -> Column:
    """Words inside windows of eight words that occur twice or more, the first occurrence included; linear but for one sort.

    Windows are compared by a 64-bit hash of their words.
    """

    def covered(starts: Column) -> Column:
        steps = _neighbours(starts, lambda a, b: F.least(b - a, F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(WINDOW), lambda total, step: total + step)

    def found(hashes: Column) -> Column:
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        none = F.array().cast("array<int>")
        both = let(by_hash, lambda s: _neighbours(s, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(none)))
        return let(F.sort_array(F.array_distinct(F.flatten(both))), covered)

    last = F.size(words) - (WINDOW - 1)
    windows = F.slice(F.transform(words, lambda w, i: F.xxhash64(F.slice(words, i + 1, WINDOW))), F.lit(1), F.greatest(last, F.lit(0)))
    count = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), found(h)).otherwise(F.lit(0)))
    return F.when(last >= 2, count).otherwise(F.lit(0))


def without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def measures(text: Column) -> Column:
    """A struct of whole-text counts; `text` must not be null."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    length = F.length(text)

    def counted(w: Column, x: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            without(text, " \t\n\x0b\x0c\r").cast("long").alias("word_chars"),
            (length - without(text, SYMBOLS)).cast("long").alias("n_symbols"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
            F.size(x).cast("long").alias("n_lines"),
            (length - without(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long").alias("n_capitals"),
            (length - without(text, "!")).cast("long").alias("n_cries"),
            (length - without(text, ".?!")).cast("long").alias("n_stops"),
            (length - without(text, MARKS)).cast("long").alias("n_marks"),
        )

    return let(words, lambda w: let(lines, lambda x: counted(w, x)))


#: Rules as (name, good if, bad if); neither: the rule abstains. Integer arithmetic, so that every engine decides alike.
RULES = (
    ("length", "n_words >= 50", "n_words < 20"),
    ("word_size", "word_chars >= 3 * n_words and word_chars <= 10 * n_words", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    ("symbols", "50 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    ("marks", "20 * n_marks <= word_chars", "10 * n_marks > word_chars"),
    ("lines", "n_lines >= 2 and n_dup_lines = 0", "10 * n_dup_lines > 3 * n_lines"),
    ("repeats", "10 * n_repeat_words <= n_words", "5 * n_repeat_words > n_words"),
    ("capitals", "10 * n_capitals <= word_chars", "10 * n_capitals > 3 * word_chars"),
    ("cries", "50 * n_cries <= n_words", "5 * n_cries > n_words"),
    ("stops", "50 * n_stops >= n_words", "200 * n_stops < n_words"),
)
BASE_FAILED = f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"


def _condition(rule: str, m: Column) -> Column:
    """A rule's condition over a struct of measures."""
    out = None
    for word in rule.split(" or "):
        every = None
        for term in word.split(" and "):
            left, sign, right = _sides(term)
            a, b = _amount(left, m), _amount(right, m)
            one = {">=": a >= b, "<=": a <= b, "<": a < b, ">": a > b, "=": a == b}[sign]
            every = one if every is None else every & one
        out = every if out is None else out | every
    return out


def _sides(term: str) -> tuple[str, str, str]:
    for sign in (">=", "<=", "<", ">", "="):
        if f" {sign} " in term:
            left, right = term.split(f" {sign} ")
            return left, sign, right
    raise ValueError(term)


def _amount(side: str, m: Column) -> Column:
    out = F.lit(1).cast("long")
    for factor in side.split(" * "):
        out = out * (F.lit(int(factor)).cast("long") if factor.strip().isdigit() else m[factor.strip()])
    return out


def votes(m: Column) -> dict[str, Column]:
    return {name: F.when(_condition(bad, m), 0).when(_condition(good, m), 1) for name, good, bad in RULES}


# --- expectation-maximisation -----------------------------------------------------------------

#: Where the estimates start: rules seldom vote bad on good texts.
START = {"share": 0.8, "good": [0.01] * len(RULES), "bad": [0.25] * len(RULES)}


def log_odds(vote: list[Column], p: dict) -> Column:
    """Log odds of good: the share's, plus what each cast vote says."""
    total = F.lit(math.log(p["share"] / (1 - p["share"])))
    for v, g, b in zip(vote, p["good"], p["bad"]):
        total = total + F.when(v == 0, F.lit(math.log(g / b))).when(v == 1, F.lit(math.log((1 - g) / (1 - b)))).otherwise(F.lit(0.0))
    return total


def fit(patterns: DataFrame, rounds: int = ROUNDS) -> dict:
    """patterns: one column per rule and n, the number of texts. Every round is one aggregate over the patterns; its one row is the estimate.

    good[j] and bad[j]: how often rule j, when it votes, votes bad on good and on bad texts; one text of each kind is added to
    every count, so that no estimate is 0 or 1.
    """
    names = [r[0] for r in RULES]
    p = START
    for _ in range(rounds):
        q = 1 / (1 + F.exp(-log_odds([F.col(n) for n in names], p)))
        weighed = patterns.select(*names, (F.col("n") * q).alias("g"), (F.col("n") * (1 - q)).alias("b"))
        sums = [F.sum("g").alias("g"), F.sum("b").alias("b")]
        for i, name in enumerate(names):
            for c in ("g", "b"):
                sums.append(F.sum(F.when(F.col(name) == 0, F.col(c)).otherwise(0.0)).alias(f"{c}0_{i}"))
                sums.append(F.sum(F.when(F.col(name).isNotNull(), F.col(c)).otherwise(0.0)).alias(f"{c}_{i}"))
        r = weighed.agg(*sums).first()
        if r["g"] is None:
            return START
        p = {
            "share": (r["g"] + 1) / (r["g"] + r["b"] + 2),
            "good": [(r[f"g0_{i}"] + 1) / (r[f"g_{i}"] + 2) for i in range(len(names))],
            "bad": [(r[f"b0_{i}"] + 1) / (r[f"b_{i}"] + 2) for i in range(len(names))],
        }
    return p


def fitted(measured: DataFrame, column: str = "_m", rounds: int = ROUNDS) -> dict:
    by_pattern = measured.select(*[v.alias(k) for k, v in votes(F.col(column)).items()]).groupBy(*[r[0] for r in RULES])
    return fit(stored(by_pattern.agg(F.count(F.lit(1)).alias("n")), "vote-patterns"), rounds)


def base_failed(m: Column) -> Column:
    return _condition(BASE_FAILED, m)


def judged(m: Column, p: dict) -> tuple[Column, Column]:
    """(posterior probability of good, kept) from a struct of measures."""
    posterior = 1 / (1 + F.exp(-log_odds(list(votes(m).values()), p)))
    return posterior, ~base_failed(m) & (posterior >= KEEP_FROM)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge_quality(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """A row per document: its counts, base_failed, posterior and kept.

    A null text counts as empty: no words, base_failed. Repeated rows and null ids are judged like any other row; ties of the posterior with the
    threshold are kept; other columns are not looked at. No documents, no rows.
    """
    measured = stored(documents.select(F.col(id_col), measures(text_or_empty(text_col)).alias("_m")), "measures")
    posterior, kept = judged(F.col("_m"), fitted(measured, rounds=rounds))
    return measured.select(id_col, *[F.col(f"_m.{c}") for c in COUNTS], base_failed(F.col("_m")).alias("base_failed"), kept.alias("kept"), posterior.alias("posterior"))


def keep_good(documents: DataFrame, text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """The documents that judge_quality keeps, with all their columns. Texts are measured once, stored beside their measures, and never shuffled.

    A null text counts as empty and goes; repeated rows and null ids are judged like any other row. No documents, no rows.
    """
    m = unused(documents, "_m")
    measured = stored(documents.withColumn(m, measures(text_or_empty(text_col))), "measured")
    p = fitted(measured, m, rounds)
    return measured.where(judged(F.col(m), p)[1]).select(*documents.columns)


# --- the same in DuckDB SQL ---------------------------------------------------------------------

def _sql_log_odds() -> str:
    parts = ["ln(share / (1 - share))"]
    for i, (name, _, _) in enumerate(RULES):
        parts.append(f"case {name} when 0 then ln(g{i} / b{i}) when 1 then ln((1 - g{i}) / (1 - b{i})) else 0 end")
    return " + ".join(parts)


def _sql_rounds(rounds: int) -> str:
    start = ", ".join([f"{START['share']} share"] + [f"{START['good'][i]} g{i}, {START['bad'][i]} b{i}" for i in range(len(RULES))])
    steps = [f"p0 as materialized (select {start})"]
    for k in range(rounds):
        est = ["(sum(g) + 1) / (sum(g) + sum(b) + 2) share"]
        for i, (name, _, _) in enumerate(RULES):
            for c in "gb":
                est.append(f"(sum(case when {name} = 0 then {c} else 0 end) + 1) / (sum(case when {name} is not null then {c} else 0 end) + 2) {c}{i}")
        inner = f"select pattern.*, n / (1 + exp(-({_sql_log_odds()}))) g, n - n / (1 + exp(-({_sql_log_odds()}))) b from pattern, p{k}"
        steps.append(f"p{k + 1} as materialized (select {', '.join(est)} from ({inner}))")
    return ",\n".join(steps)


def sql(table: str = "documents", rounds: int = ROUNDS) -> str:
    """CTEs up to `verdict` (doc_id, counts, base_failed, kept); without a leading "with" or a final select."""
    vote = ", ".join(f"case when {bad} then 0 when {good} then 1 end {name}" for name, good, bad in RULES)
    names = ", ".join(r[0] for r in RULES)
    return f"""
row as (select row_number() over () r, * from {table}),
text as (select r, coalesce(text, '') t from row),
word as (select r, t, list_filter(regexp_split_to_array(t, '{SPACES}'), lambda y: y <> '') w,
         list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '[^\\x20\\x09-\\x0D]')) x from text),
win as (select r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') s from (select r, w, unnest(range(1, len(w) - {WINDOW - 2})) i from word)),
twice as (select r, i from (select r, i, count(*) over (partition by r, s) c from win) where c > 1),
rep as (select r, count(distinct p) c from (select r, unnest(range(i, i + {WINDOW})) p from twice) group by r),
measure as (
  select r, len(w)::bigint n_words, length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::bigint word_chars,
    (length(t) - length(translate(t, '{SYMBOLS}', '')))::bigint n_symbols, (len(x) - len(list_distinct(x)))::bigint n_dup_lines,
    coalesce(c, 0)::bigint n_repeat_words, len(x)::bigint n_lines,
    (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')))::bigint n_capitals,
    (length(t) - length(replace(t, '!', '')))::bigint n_cries, (length(t) - length(translate(t, '.?!', '')))::bigint n_stops,
    (length(t) - length(translate(t, '{MARKS}', '')))::bigint n_marks
  from word left join rep using (r)),
vote as materialized (select *, {vote} from measure),
pattern as materialized (select {names}, count(*)::double n from vote group by all),
{_sql_rounds(rounds)},
verdict as (
  select row.*, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({BASE_FAILED}) base_failed,
    not ({BASE_FAILED}) and 1 / (1 + exp(-({_sql_log_odds()}))) >= {KEEP_FROM} kept
  from vote join row using (r), p{rounds})"""


SQL = f"with {sql()}\nselect doc_id, {', '.join(COUNTS)}, base_failed, kept from verdict"
