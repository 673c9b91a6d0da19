"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation estimates how far each rule
can be trusted, and the posterior probability of good quality decides."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestlab.llm.common import SPACE, let, materialise, read, words

#: Each rule: name, measure, vote "good" inside [low, high], vote "bad" outside [least, most], else abstain.
RULES = (
    ("length", "n_words", 50, 1e18, 10, 1e18),
    ("symbols", "symbols_per_word", 0, 0.05, 0, 0.10),
    ("symbol_heavy", "symbols_per_word", 0, 0.15, 0, 0.30),
    ("letters", "letters_per_char", 0.90, 1, 0.82, 1),
    ("shouting", "capitals_per_letter", 0, 0.15, 0, 0.35),
    ("exclaiming", "exclaims_per_word", 0, 0.10, 0, 0.30),
    ("dup_lines", "dup_lines_per_line", 0, 0.15, 0, 0.35),
    ("repetition", "repeats_per_word", 0, 0.20, 0, 0.45),
    ("word_size", "chars_per_word", 3, 9, 2, 14),
)
ITERATIONS = 15
#: Start of the estimation, and the pseudo-votes that keep estimates off 0 and 1.
START_GOOD, START_HIT, START_FALSE, PSEUDO = 0.85, 0.995, 0.5, 10.0
#: Posterior from which a document is kept.
KEEP_FROM = 0.5


def repeated_words(w: Column) -> Column:
    """Words of w that lie in a 3-word window found at least twice in w. Where all hashes of windows differ, so do the
    windows; else sorting puts equal windows side by side, and their words decide."""
    three = lambda f: lambda i: f(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    at = F.sequence(F.lit(0), F.size(w) - 3)
    differ = let(F.transform(at, three(F.xxhash64)), lambda h: F.size(F.array_distinct(h)) == F.size(h))
    windows = F.transform(at, lambda i: F.struct(three(lambda *x: F.concat_ws(" ", *x))(i).alias("k"), i.alias("i")))

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, j: (x["k"] == F.get(s, j - 1)["k"]) | (x["k"] == F.get(s, j + 1)["k"]))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    return F.when(F.size(w) < 4, F.lit(0)).when(differ, F.lit(0)).otherwise(let(F.sort_array(windows), covered))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def features(text: Column) -> Column:
    """Struct of a text's counts (null text: all 0)."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    return F.struct(
        let(words(text), of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        F.length(F.regexp_replace(t, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.length(t) - F.length(F.regexp_replace(t, "[!?]+", ""))).cast("long").alias("n_exclaims"),
        (F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}+", ""))).cast("long").alias("n_capitals"),
        (F.length(t) - F.length(F.regexp_replace(t, r"\p{L}+", ""))).cast("long").alias("n_letters"),
    )


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts of each whole text and the ratios that the rules look at (same-named columns are replaced)."""
    x = F.col("__f")
    counts = {"n_words": x["w"]["n_words"], "word_chars": x["word_chars"], "n_symbols": x["n_symbols"], "n_dup_lines": x["l"]["n_dup_lines"], "n_repeat_words": x["w"]["n_repeat_words"]}
    ratios = {
        "symbols_per_word": _ratio(x["n_symbols"], x["w"]["n_words"]), "capitals_per_letter": _ratio(x["n_capitals"], x["n_letters"]), "letters_per_char": _ratio(x["n_letters"], x["word_chars"]), "exclaims_per_word": _ratio(x["n_exclaims"], x["w"]["n_words"]),
        "dup_lines_per_line": _ratio(x["l"]["n_dup_lines"], x["l"]["n_lines"]), "repeats_per_word": _ratio(x["w"]["n_repeat_words"], x["w"]["n_words"]), "chars_per_word": _ratio(x["word_chars"], x["w"]["n_words"]),
    }
    # explode() of one element keeps Catalyst from working the struct out anew for each field taken from it
    return docs.select("*", F.explode(F.array(features(F.col(text)))).alias("__f")).withColumns(counts | ratios).drop("__f")


def vote(rule: tuple) -> Column:
    """1 good, 0 bad, -1 abstain."""
    _, measure, low, high, least, most = rule
    c = F.col(measure)
    return F.when((c < least) | (c > most), 0).when((c >= low) & (c <= high), 1).otherwise(-1)


def estimate(patterns: Iterable[tuple[tuple[int, ...], int]], n_rules: int = len(RULES), iterations: int = ITERATIONS) -> tuple[float, list[tuple[float, float]]]:
    """EM over vote patterns and their document counts (at most 3 ** n_rules patterns, whatever the data's size).
    Returns the share of good documents, and for each rule P(votes good | good) and P(votes good | bad) among votes."""
    patterns = sorted(patterns)
    good, rates = START_GOOD, [(START_HIT, START_FALSE)] * n_rules
    for _ in range(iterations):
        total = weight = 0.0
        sums = [[0.0, 0.0, 0.0, 0.0] for _ in range(n_rules)]
        for votes, n in patterns:
            q = posterior(votes, good, rates)
            total, weight = total + n * q, weight + n
            for s, v in zip(sums, votes, strict=True):
                if v >= 0:
                    s[0] += n * q * v
                    s[1] += n * q
                    s[2] += n * (1 - q) * v
                    s[3] += n * (1 - q)
        good = (total + PSEUDO * START_GOOD) / (weight + PSEUDO)
        rates = [((a + PSEUDO * START_HIT) / (b + PSEUDO), (c + PSEUDO * START_FALSE) / (d + PSEUDO)) for a, b, c, d in sums]
    return good, rates


def posterior(votes: tuple[int, ...], good: float, rates: list[tuple[float, float]]) -> float:
    z = math.log(good / (1 - good))
    for v, (p, q) in zip(votes, rates, strict=True):
        if v >= 0:
            z += math.log(p / q) if v else math.log((1 - p) / (1 - q))
    return 1 / (1 + math.exp(-z))


def judge(counted: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of measured() with votes, quality and kept. One job counts the vote patterns of all rows."""
    names = [f"vote_{r[0]}" for r in RULES]
    seen = counted.groupBy(*[vote(r).alias(n) for r, n in zip(RULES, names, strict=True)]).count()
    good, rates = estimate([(tuple(r[n] for n in names), r["count"]) for r in seen.collect()])
    z = F.lit(math.log(good / (1 - good)))
    for n, (p, q) in zip(names, rates, strict=True):
        z = z + F.when(F.col(n) == 1, math.log(p / q)).when(F.col(n) == 0, math.log((1 - p) / (1 - q))).otherwise(0.0)
    out = counted.withColumns({n: vote(r) for r, n in zip(RULES, names, strict=True)}).withColumn("quality", 1 / (1 + F.exp(-z)))
    return out.withColumn("kept", F.col("quality") >= keep_from).withColumns({n: F.when(F.col(n) >= 0, F.col(n)) for n in names})


def score_quality(docs: DataFrame, text: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """Every row of docs with counts, votes (vote_<rule>: 1 good, 0 bad, null abstains), quality (the posterior) and
    kept (quality >= keep_from). The first job counts vote patterns over all rows; the second only evaluates columns.

    A null or empty text has all counts 0. Repeated rows are scored alike, each on its own. An empty table gives an
    empty result. Columns of docs that bear a computed name are replaced; all others stay."""
    return judge(measured(docs, text), keep_from)


def base_failed() -> Column:
    """Of the columns of measured(): too few words, or more than half of them in repeated 3-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def keep_good(docs: DataFrame, text: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of docs that pass the base rules and whose posterior quality is high enough. Counts are worked out once and
    written with their rows, as the rules' accuracies must be known before the first row can be judged."""
    held = materialise(measured(docs.select(F.struct("*").alias("__own"), F.col(text).alias("text"))).drop("text"), "quality")
    return judge(held, keep_from).where(~base_failed() & F.col("kept")).select("__own.*")


def op8(spark, sf_dir):
    failed = base_failed()
    # the counts are small beside the texts: written once, the texts are read in one pass
    out = judge(materialise(measured(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "op8"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"), F.round("quality", 6).alias("quality"))


def _sql() -> str:
    """The same in DuckDB's SQL; each iteration of the estimation is a table of one row."""
    parts = [
        r"""w as (select doc_id, coalesce(text, '') t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents)""",
        r"""p as (select rowid, doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] k from (select doc_id, row_number() over () rowid, w, unnest(range(1, len(w) - 1)) i from w))""",
        r"""r as (select doc_id, count(distinct j) n from (select doc_id, unnest([i, i+1, i+2]) j from p join (select doc_id, k from p group by 1, 2 having count(*) > 1) using (doc_id, k)) group by 1)""",
        r"""f as (select doc_id, len(w)::bigint n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint n_symbols,
 (length(t) - length(translate(t, '!?', '')))::bigint n_exclaims, (length(t) - length(regexp_replace(t, '\p{Lu}+', '', 'g')))::bigint n_cap, (length(t) - length(regexp_replace(t, '\p{L}+', '', 'g')))::bigint n_let,
 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l, coalesce(r.n, 0)::bigint n_repeat_words from w left join r using (doc_id))""",
        """m as (select *, (len(l) - len(list_distinct(l)))::bigint n_dup_lines, case when n_words > 0 then n_symbols::double / n_words else 0 end symbols_per_word, case when n_let > 0 then n_cap::double / n_let else 0 end capitals_per_letter,
 case when word_chars > 0 then n_let::double / word_chars else 0 end letters_per_char, case when len(l) > 0 then (len(l) - len(list_distinct(l)))::double / len(l) else 0 end dup_lines_per_line,
 case when n_words > 0 then n_exclaims::double / n_words else 0 end exclaims_per_word, case when n_words > 0 then n_repeat_words::double / n_words else 0 end repeats_per_word, case when n_words > 0 then word_chars::double / n_words else 0 end chars_per_word from f)""",
    ]
    ks = range(len(RULES))
    votes = ", ".join(f"case when {m} < {least} or {m} > {most} then 0 when {m} >= {low} and {m} <= {high} then 1 else -1 end v{k}" for k, (_, m, low, high, least, most) in enumerate(RULES))
    z = "ln(g / (1 - g))" + "".join(f" + case v{k} when 1 then ln(p{k} / q{k}) when 0 then ln((1 - p{k}) / (1 - q{k})) else 0 end" for k in ks)
    parts += [f"v as (select *, {votes} from m)", f"c as materialized (select {', '.join(f'v{k}' for k in ks)}, count(*)::double n from v group by all)"]
    parts.append(f"e0 as materialized (select {START_GOOD}::double g, {', '.join(f'{START_HIT}::double p{k}, {START_FALSE}::double q{k}' for k in ks)})")
    for i in range(ITERATIONS):
        new = ", ".join(f"(coalesce(sum(n * y * v{k}) filter (v{k} >= 0), 0) + {PSEUDO * START_HIT}) / (coalesce(sum(n * y) filter (v{k} >= 0), 0) + {PSEUDO}) p{k}, (coalesce(sum(n * (1 - y) * v{k}) filter (v{k} >= 0), 0) + {PSEUDO * START_FALSE}) / (coalesce(sum(n * (1 - y)) filter (v{k} >= 0), 0) + {PSEUDO}) q{k}" for k in ks)
        parts.append(f"e{i + 1} as materialized (select (sum(n * y) + {PSEUDO * START_GOOD}) / (sum(n) + {PSEUDO}) g, {new} from (select c.*, 1 / (1 + exp(-({z}))) y from c, e{i}))")
    failed = "(n_words < 50 or 100 * n_repeat_words > 50 * n_words)"
    return f"with {', '.join(parts)} select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} base_failed, not {failed} and y >= {KEEP_FROM} kept, round(y, 6) quality from (select v.*, 1 / (1 + exp(-({z}))) y from v, e{ITERATIONS})"


QUERIES = {"op8_quality_rules": op8}
ORACLES = {"op8_quality_rules": _sql()}
