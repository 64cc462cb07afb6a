"""Mixing documents to target weights of domains that are known only softly.

A classifier learned from the table of labels gives every document a probability of each domain. A document of n tokens then
counts n * p tokens to each domain. Rates say how often a document is taken; they start at 1 and are moved by projected
gradient steps of the least-squares distance between the expected tokens of the domains and their targets, never
below 0. A step needs one aggregate over all documents: the domains' expected tokens and their second moments over
the documents that still move, which scale the gradient so that few steps are enough. Rates are not stored in
between: a document's rate follows from its probabilities and the list of steps.

DataFrame operations only; the driver sees numbers per domain, never documents.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from wattlens.plans.staging import stage

TARGETS = {"good": 0.85, "poor": 0.12, "toxic": 0.03}
TRAINING_ROWS = 20_000  # bound of the labelled sample that the classifier and its word list are learned from
LIST_WORDS, LEAST_SUPPORT, LEAST_SHARE = 40, 5, 0.02  # a listed word is in that many toxic documents, and that share of them
MAX_STEPS, CLOSE = 60, 1e-7
SHARPNESS = 0.5  # the classes' log-likelihoods are weighted down, as the features are not independent
FEATURES = ["symbols", "capitals", "repeats", "word_length", "listed"]
WORD = r"[^\x20\x09-\x0D]++"
LEAST_ODDS = 4
SIGNS = "\t\n\x0b\f\r!\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~"  # what parts words


def domain_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 1, "good").when(quality == 0, "poor")


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, bound: int) -> DataFrame:
    """At most about `bound` labelled documents, by a hash of the id; the share is taken from the number of labels."""
    known = labels.select(F.col("doc_id").alias("_id"), domain_of(F.col("quality"), F.col("toxic")).alias("domain"))
    known = known.filter("_id is not null and domain is not null").groupBy("_id").agg(F.min("domain").alias("domain"))
    number = known.count()
    share = min(1.0, bound / max(1, number))
    chosen = known.filter(F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)))
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id")


def word_list(sample: DataFrame) -> list[str]:
    """The words that tell toxic documents from others best, by the ratio of their document frequencies.

    A word must do so, with enough support, in either half of the sample (by a hash of the id): a word that only a few
    documents have would tell little of others, and every listed word costs time on all texts.
    """
    words = F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+"))
    halves = [F.pmod(F.xxhash64("_id", F.lit(9)), F.lit(2)) == i for i in (0, 1)]
    toxic = F.col("domain") == "toxic"
    sizes = sample.agg(*[F.count_if(h & x) for h in halves for x in (toxic, ~toxic)]).first()
    if not all(sizes):
        return []
    marked = sample.select(*[(h & x).cast("int").alias(f"{kind}{i}") for i, h in enumerate(halves)
                             for kind, x in (("t", toxic), ("o", ~toxic))], F.explode(words).alias("word"))
    seen = (marked.filter("length(word) > 1").groupBy("word").agg(*[F.sum(f"{k}{i}").alias(f"{k}{i}") for i in (0, 1) for k in "to"])
            .filter(" and ".join(f"t{i} >= {max(LEAST_SUPPORT, LEAST_SHARE * sizes[2 * i])}" for i in (0, 1))))
    odds = [((F.col(f"t{i}") + 0.5) / sizes[2 * i]) / ((F.col(f"o{i}") + 0.5) / sizes[2 * i + 1]) for i in (0, 1)]
    least = F.least(*odds)
    best = seen.filter(least >= LEAST_ODDS).orderBy(F.desc((F.col("t0") + F.col("t1")) * F.log(least)), "word")
    return [r["word"] for r in best.limit(LIST_WORDS).collect()]


def with_features(docs: DataFrame, text_col: str, words: list[str]) -> DataFrame:
    """Add n_tokens (runs of characters other than white space) and the classifier's features of the whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.withColumn("n_tokens", F.regexp_count(text, F.lit(WORD)).cast("long"))
    n = F.greatest(F.col("n_tokens"), F.lit(1))
    chars = F.greatest(F.length(text), F.lit(1))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>!", ""))
    apart = F.split(F.translate(F.lower(text), SIGNS, " " * len(SIGNS)), " ")  # cheaper than an alternation of the words
    listed = F.size(F.filter(apart, lambda w: w.isin(words))) if words else F.lit(0)
    return counted.withColumns({
        "symbols": F.log1p(100 * symbols / n), "capitals": F.log1p(10 * capitals / n),
        "repeats": F.log1p(100 * F.regexp_count(text, F.lit(r"\b(\p{L}++) \1\b")) / n),
        "word_length": F.log(chars / n), "listed": F.log1p(1000 * listed / n)})


def fit(sample: DataFrame, words: list[str], domains: list[str]) -> dict[str, tuple[float, list[float], list[float]]]:
    """Per domain its share and each feature's mean and variance (at least 0.05), in one aggregate."""
    stats = with_features(sample, "text", words).groupBy("domain").agg(
        F.count("*").alias("n"), *[F.avg(f).alias(f"m_{f}") for f in FEATURES],
        *[F.var_pop(f).alias(f"v_{f}") for f in FEATURES]).collect()
    total = sum(r["n"] for r in stats)
    found = {r["domain"]: (r["n"] / total, [r[f"m_{f}"] for f in FEATURES], [max(0.05, r[f"v_{f}"]) for f in FEATURES])
             for r in stats}
    return {d: found[d] for d in domains if d in found}


def posteriors(model: dict, domains: list[str]) -> list[Column]:
    """The domains' probabilities of a row with FEATURES; equal shares without a model, 0 for domains not learned."""
    if not model:
        return [F.lit(1.0 / len(domains)) for _ in domains]
    logs = {}
    for domain, (share, means, variances) in model.items():
        fit_ = sum((((F.col(f) - m) * (F.col(f) - m)) / v + math.log(v) for f, m, v in zip(FEATURES, means, variances)), F.lit(0.0))
        logs[domain] = F.lit(math.log(share)) - SHARPNESS * 0.5 * fit_
    top = F.greatest(*logs.values()) if len(logs) > 1 else next(iter(logs.values()))
    weights = {d: F.exp(x - top) for d, x in logs.items()}
    total = sum(weights.values(), F.lit(0.0))
    return [weights[d] / total if d in weights else F.lit(0.0) for d in domains]


def solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Solution of a small linear system by elimination; directions without weight get 0."""
    n = len(right)
    rows = [list(row) + [right[i]] for i, row in enumerate(matrix)]
    scale = max((abs(x) for row in matrix for x in row), default=0.0) or 1.0
    for i in range(n):
        pivot = max(range(i, n), key=lambda r: abs(rows[r][i]))
        rows[i], rows[pivot] = rows[pivot], rows[i]
        if abs(rows[i][i]) < 1e-12 * scale:
            rows[i] = [0.0] * (n + 1)
            continue
        for r in range(n):
            if r != i and rows[r][i]:
                factor = rows[r][i] / rows[i][i]
                rows[r] = [a - factor * b for a, b in zip(rows[r], rows[i])]
    return [rows[i][n] / rows[i][i] if rows[i][i] else 0.0 for i in range(n)]


def rate_of(steps: list[list[float]], domains: list[str]) -> Column:
    """The rate after the given steps, each projected to 0 or more."""
    if not steps:
        return F.lit(1.0)
    names = [F.col(f"p_{d}") for d in domains]
    listed = F.array(*[F.array(*[F.lit(float(x)) for x in step]) for step in steps])
    return F.aggregate(listed, F.lit(1.0), lambda r, s: F.greatest(
        F.lit(0.0), r - sum((names[i] * s[i] for i in range(len(names))), F.lit(0.0))))


def fit_rates(scored: DataFrame, targets: dict[str, float]) -> list[list[float]]:
    """Steps that bring the domains' expected tokens as near to their targets' shares of all tokens as rates of 0 or more can.

    Steps are scaled by the second moments as long as each at least halves the distance. Targets out of reach end that;
    from the best point on, plain gradient steps of a length that never overshoots go on until the distance stays.
    """
    domains, steps, scaled = list(targets), [], True
    p = [F.col(f"p_{d}") for d in domains]
    k, weight = len(domains), sum(targets.values())
    best, best_steps, last = math.inf, [], math.inf
    for _ in range(MAX_STEPS):
        rated = scored.withColumn("_rate", rate_of(steps, domains))
        moving = F.when(F.col("_rate") > 0, F.col("n_tokens")).otherwise(0)
        row = rated.agg(
            F.sum("n_tokens"), *[F.sum(F.col("n_tokens") * F.col("_rate") * x) for x in p],
            *[F.sum(moving * a * b) for a in p for b in p], *[F.sum(F.col("n_tokens") * a * a) for a in p]).first()
        tokens = row[0]
        if not tokens:
            return []
        gaps = [row[1 + i] / tokens - targets[d] / weight for i, d in enumerate(domains)]
        error = sum(g * g for g in gaps)
        if error < CLOSE ** 2:
            return steps
        if scaled and error > 0.25 * last:
            scaled, steps, last = False, list(best_steps), math.inf
            continue
        if not scaled and error > (1 - 1e-6) * last:
            break
        last = error
        if error < best:
            best, best_steps = error, list(steps)
        if scaled:
            moments = [[row[1 + k + i * k + j] / tokens for j in range(k)] for i in range(k)]
            steps.append(solve(moments, gaps))
        else:
            steps.append([g * tokens / sum(row[1 + k + k * k:]) for g in gaps])
    return best_steps


def mix(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        targets: dict[str, float] | None = None, training_rows: int = TRAINING_ROWS, keep: list[str] | None = None) -> DataFrame:
    """Per row: the id, n_tokens, p_<domain> for each target domain, rate, copies.

    `labels` has doc_id, quality and toxic; a document labelled several times counts once. Expected domain tokens, the sum of
    rate * n_tokens * p, meet the targets' shares of all tokens as nearly as nonnegative rates can. copies is the rate
    rounded up or down by a hash of the id (of the text where it is null), so that its mean is the rate: 0 drops the row.
    Tokens are words between white space. Equal rows get equal results, null and empty texts have 0 tokens, very long ones
    are read whole. Without labels all rates are equal. Other columns are left out but for those of `keep`; an empty
    table stays empty.
    """
    targets = dict(targets or TARGETS)
    domains = list(targets)
    sample = stage(labelled_sample(docs, labels, id_col, text_col, training_rows), "labelled")
    words = word_list(sample)
    model = fit(sample, words, domains)
    stay = {f"_keep_{i}": c for i, c in enumerate(keep or [])}
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[F.col(f"`{c}`").alias(k) for k, c in stay.items()])
    drawn = own.withColumn("_draw", F.when(F.col("_id").isNull(), F.xxhash64("_text", F.lit(7))).otherwise(F.xxhash64("_id", F.lit(7))))
    featured = with_features(drawn, "_text", words)
    scored = stage(featured.select("_id", *stay, "_draw", "n_tokens", *[
        c.alias(f"p_{d}") for d, c in zip(domains, posteriors(model, domains))]), "posteriors")
    rate = rate_of(fit_rates(scored, targets), domains)
    chance = F.pmod(F.col("_draw"), F.lit(1 << 30)) / float(1 << 30)
    return (scored.withColumn("rate", rate).withColumn("copies", F.floor(F.col("rate") + chance).cast("long"))
            .drop("_draw").withColumnsRenamed({"_id": id_col, **stay}))


def op8_soft_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
