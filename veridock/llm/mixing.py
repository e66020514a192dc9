"""Mixing to target weights with soft domain membership, in DataFrame operations only.

1. A naive Bayes classifier is fitted on a bounded sample of a labelled table: how often the most telling words of each
   domain occur in its texts, and mean and spread of four measures of a text's shape. It gives every document a posterior
   over the domains.
2. A document used at rate r adds r * tokens * posterior to the expected token totals of the domains. Projected gradient
   steps on the squared differences between these totals and the targets fit a nonnegative rate for each document, from
   1 on. Differences are scaled by the domains' sizes and steps by the documents' lengths, which keeps the problem well
   conditioned; as the scaling is diagonal, cutting rates off at 0 still is the projection. An iteration is one
   aggregate over the stored posteriors that returns one number for each domain, so nothing that reaches the driver
   grows with the corpus. It ends when all shares are within the tolerance, or after the given number of iterations.

Targets that the corpus cannot meet, such as a share of a domain that no document is likely to be from, end at the least
squares compromise.

Defined cases: a null text is read as empty and has no tokens; rows that repeat a doc_id are documents of their own; rows
without one are never learned from; labelled ids that are missing or null, or have no domain, are passed over, and of an
id labelled twice the first domain in order counts; every domain that the labels have is kept (there is one posterior
column each, so they are meant to be a closed list of tens); with no usable label or no token every rate is 1 and no posterior is
known; an empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridock.llm.common import id_and_text, table, tidy, written

#: Labelled rows that the classifier is fitted on at most, and words of each domain that it counts.
SAMPLE_ROWS, WORDS = 6000, 64
#: Texts that a word must occur in, and how much the evidence counts: its parts are not independent.
SUPPORT, TEMPER = 5, 0.5
ITERATIONS, TOLERANCE = 60, 1e-4

#: The query's domains and the shares of tokens they are to have.
TARGETS = {"high": 0.75, "low": 0.23, "toxic": 0.02}

_MEASURES = ("m_length", "m_distinct", "m_word", "m_letters")


def domains_of_labels(labels: DataFrame) -> DataFrame:
    """The labels table as (doc_id, domain): toxic, or else high or low by quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain.alias("domain"))


def _features(rows: DataFrame) -> DataFrame:
    """doc_id, tokens, the distinct words and the measures of each text."""
    text = F.coalesce("text", F.lit(""))
    out = rows.select("doc_id", *[c for c in rows.columns if c not in ("doc_id", "text")], F.length(text).alias("_n"), F.array_remove(F.split(F.lower(text), r"[^\p{L}]+"), "").alias("_words"), F.size(F.array_remove(F.split(text, r"\s+"), "")).cast("long").alias("tokens"))
    out = out.withColumn("words", F.array_distinct("_words"))
    some = F.greatest(F.size("_words"), F.lit(1))
    letters = F.length(F.array_join("_words", ""))
    measures = {
        "m_length": F.log1p(F.col("tokens").cast("double")),
        "m_distinct": F.size("words") / some,
        "m_word": letters / some,
        "m_letters": letters / F.greatest(F.col("_n"), F.lit(1)),
    }
    return out.select(*[c for c in out.columns if c not in ("_n", "_words")], *[m.cast("double").alias(n) for n, m in measures.items()])


def _adding(weights: Column):
    return lambda total, word: total + F.element_at(weights, word)


class Classifier:
    """Posteriors as column expressions."""

    def __init__(self, domains: list[str], priors: list[float], words: dict[str, list[float]], empty: list[float], shapes: list[list[tuple[float, float]]]):
        self.domains, self.priors, self.words, self.empty, self.shapes = domains, priors, words, empty, shapes

    def posteriors(self) -> list[Column]:
        """One column for each domain, from the columns of ``_features``."""
        hits = F.array_intersect(F.col("words"), F.array(*[F.lit(w) for w in self.words])) if self.words else None
        logs = []
        for k in range(len(self.domains)):
            evidence = F.lit(self.empty[k])
            if self.words:
                weights = F.create_map(*[x for w, p in self.words.items() for x in (F.lit(w), F.lit(p[k]))])
                evidence = evidence + F.aggregate(hits, F.lit(0.0), _adding(weights))
            for m, (mean, sd) in zip(_MEASURES, self.shapes[k], strict=True):
                z = F.least((F.col(m) - F.lit(mean)) / F.lit(sd), F.lit(6.0))
                evidence = evidence - F.lit(0.5) * z * z - F.lit(math.log(sd))
            logs.append(F.lit(math.log(self.priors[k])) + F.lit(TEMPER) * evidence)
        return logs


def fit(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Classifier | None:
    """A classifier from ``labelled`` (doc_id, domain) and the texts of ``docs``; none if no label can be used."""
    chosen = labelled.where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    chosen = chosen.orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(sample_rows)  # bounded, so broadcast
    known = written(_features(id_and_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")), "labelled")
    sums = [f(m).alias(f"{n}_{m}") for m in _MEASURES for n, f in (("avg", F.avg), ("sd", F.stddev_pop))]
    rows = {r["domain"]: r for r in known.groupBy("domain").agg(F.count("*").alias("n"), *sums).collect()}
    if not rows:
        return None
    domains = sorted(rows)
    total = sum(rows[d]["n"] for d in domains)
    counts = known.select("domain", F.explode("words").alias("word")).groupBy("word").agg(*[F.count_if(F.col("domain") == d).alias(f"c{k}") for k, d in enumerate(domains)])
    every = sum((F.col(f"c{k}") for k in range(1, len(domains))), F.col("c0"))
    odds = [F.log((F.col(f"c{k}") + 0.5) / (rows[d]["n"] + 1.0)) - F.log((every - F.col(f"c{k}") + 0.5) / (total - rows[d]["n"] + 1.0)) for k, d in enumerate(domains)]
    best = counts.where(every >= SUPPORT).withColumn("odds", F.greatest(*odds) if len(odds) > 1 else odds[0]).orderBy(F.desc("odds"), "word").limit(WORDS * len(domains)).collect()
    words, empty = {}, [0.0] * len(domains)
    for r in best:
        share = [(r[f"c{k}"] + 0.5) / (rows[d]["n"] + 1.0) for k, d in enumerate(domains)]
        words[r["word"]] = [math.log(p / (1 - p)) for p in share]
        empty = [e + math.log(1 - p) for e, p in zip(empty, share, strict=True)]
    shapes = [[(rows[d][f"avg_{m}"] or 0.0, max(rows[d][f"sd_{m}"] or 0.0, 0.02)) for m in _MEASURES] for d in domains]
    return Classifier(domains, [rows[d]["n"] / total for d in domains], words, empty, shapes)


def predict(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text", keep_row: bool = False) -> DataFrame:
    """doc_id, tokens, a posterior p0, p1, ... for each of the classifier's domains and, if asked for, the row itself."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept_row")] * keep_row))
    own = ["doc_id", "tokens", *["kept_row"] * keep_row]
    logs = _features(rows).select(*own, *[c.alias(f"l{k}") for k, c in enumerate(classifier.posteriors())])
    names = [F.col(f"l{k}") for k in range(len(classifier.domains))]
    most = F.greatest(*names) if len(names) > 1 else names[0]
    raised = logs.select(*own, *[F.exp(n - most).alias(f"e{k}") for k, n in enumerate(names)])
    total = sum((F.col(f"e{k}") for k in range(1, len(names))), F.col("e0"))
    return raised.select(*own, *[(F.col(f"e{k}") / total).alias(f"p{k}") for k in range(len(names))])


def rates(scored: DataFrame, goals: list[float], iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> Column:
    """The rate of each row of ``scored`` (tokens, p0, p1, ...), a stored table, as an expression of its posteriors."""
    n = len(goals)
    p = [F.col(f"p{k}") for k in range(n)]
    tokens = F.col("tokens").cast("double")
    first = scored.agg(F.sum(tokens).alias("t"), *[F.sum(tokens * p[k]).alias(f"g{k}") for k in range(n)], *[F.sum(tokens * p[j] * p[k]).alias(f"h{j}_{k}") for j in range(n) for k in range(j, n)]).first()
    total = first["t"] or 0.0
    if not total:
        return F.lit(1.0)
    size = [max((first[f"g{k}"] or 0.0) / total, 1e-9) for k in range(n)]
    # the largest eigenvalue of the scaled Gram matrix is at most the largest sum of a row
    gram = [[(first[f"h{min(j, k)}_{max(j, k)}"] or 0.0) / total / math.sqrt(size[j] * size[k]) for k in range(n)] for j in range(n)]
    step = 1.0 / max(max(sum(abs(x) for x in row) for row in gram), 1e-12)
    rate, share = F.lit(1.0), list(size)
    for _ in range(iterations):
        error = [s - g for s, g in zip(share, goals, strict=True)]
        if max(abs(e) for e in error) <= tolerance:
            break
        slope = sum((F.lit(step * error[k] / size[k]) * p[k] for k in range(1, n)), F.lit(step * error[0] / size[0]) * p[0])
        rate = F.greatest(F.lit(0.0), rate - slope)
        now = scored.agg(*[F.sum(tokens * p[k] * rate).alias(f"s{k}") for k in range(n)]).first()
        share = [(now[f"s{k}"] or 0.0) / total for k in range(n)]
    return rate


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, tokens, a posterior ``p_<domain>`` for each domain of ``targets``, and rate. The targets are shares of the
    corpus's tokens and are scaled to add up to 1; a domain that the labels do not have gets a posterior of 0, one that
    the targets do not have a target of 0."""
    spark_rows = id_and_text(docs, id_col, text_col)
    model = fit(docs, labelled, id_col, text_col)
    names = sorted(targets)
    if model is None:
        tokens = _features(spark_rows).select("doc_id", "tokens")
        return tokens.select("doc_id", "tokens", *[F.lit(None).cast("double").alias(f"p_{d}") for d in names], F.lit(1.0).alias("rate"))
    scored = written(predict(docs, model, id_col, text_col), "posteriors")
    whole = sum(targets.values()) or 1.0
    rate = rates(scored, [targets.get(d, 0.0) / whole for d in model.domains], iterations, tolerance)
    of = {d: F.col(f"p{k}") for k, d in enumerate(model.domains)}
    return scored.select("doc_id", "tokens", *[of.get(d, F.lit(0.0)).alias(f"p_{d}") for d in names], rate.alias("rate"))


def sampled(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> DataFrame:
    """``docs`` in the mixture, all columns as they are: a document of rate r is there floor(r) times, and once more with
    the probability that is left, decided by a hash of its id and text. The rows are stored with their posteriors, of
    which rates are expressions, so nothing is joined."""
    model = fit(docs, labelled, id_col, text_col)
    if model is None:
        return docs
    scored = written(predict(docs, model, id_col, text_col, keep_row=True), "posteriors")
    whole = sum(targets.values()) or 1.0
    rate = rates(scored, [targets.get(d, 0.0) / whole for d in model.domains], iterations, tolerance)
    tidy(docs.sparkSession)
    draw = F.pmod(F.xxhash64(F.lit(11), F.col(f"kept_row.`{id_col}`"), F.col(f"kept_row.`{text_col}`")), F.lit(1 << 30)) / float(1 << 30)
    times = F.floor(rate + draw).cast("int")
    return scored.select("kept_row", times.alias("times")).where("times > 0").select("kept_row", F.explode(F.sequence(F.lit(1), "times")).alias("copy")).select("kept_row.*")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), domains_of_labels(table(spark, sf_dir, "labels")), TARGETS)


QUERIES = {"op5_source_mixing": op5_source_mixing}
SQL: dict[str, str] = {}
