"""Quality rules: word and line rules, and outliers by a minimum covariance determinant.

The counts are taken inside a row by built-in functions; texts are read once and
never move.  Their transformed vectors are staged and, for each language and
source, a robust centre and covariance are found: from two deterministic
starts, concentration steps take the half of the rows nearest to the centre and
estimate anew from them, until the determinant falls no more; the start that
ends with the least determinant counts.  A step is two aggregations (the distance
that the nearest part lies within, then moments) of fixed-point integers, so a
source with most of the rows is pre-aggregated in every task and reruns agree
exactly.  A group with fewer than MIN_ROWS rows is judged by the estimate of all
usable rows of its language, and where those are too few as well, of the table:
every document that passes the rules is judged.  A table with too few rows for a
covariance is judged all the same, by the least standard deviations around its half.

Defined results: a null text has no words and fails the rules; null languages
and sources are groups of their own; a document is judged on its counts alone,
so repeated rows and ties get equal verdicts; a very long text is counted whole in its
own row; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanledger.llm.common import SPACE, SPACE_CHARS, Rows, small, stage, text_or_empty

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = "#*$%&|<>"

#: Part of a group's rows that the estimate rests on, and the factor that makes the covariance of
#: that part consistent for four normal variables: 0.5 / P(chi2(6) <= quantile of chi2(4) at 0.5).
#: Nearly half of the rows may be anything; steps go on until no determinant falls, for which STEPS is ample.
PART = 0.5
CONSISTENT = 2.109
STEPS = 60
MIN_ROWS = 60
#: Fixed point of the vectors; least standard deviation of each variable, in its own unit.
UNIT = 4096
VARIABLES = ("word_length", "symbols", "dup_lines", "repeats")
FLOOR = {"word_length": 0.08, "symbols": 0.03, "dup_lines": 0.10, "repeats": 0.10}
#: Squared distance beyond which a document is an outlier: chi2(4) at 1 - 1e-6.
CUTOFF = 33.4

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated(hashes: Column, width: int) -> Column:
    """Words covered by the windows whose hash occurs twice or more."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    n = F.size(hashes)

    def same(pairs: Column, k: Column, other: Column) -> Column:
        return F.get(pairs, k)["h"] == F.get(pairs, other)["h"]

    # One lambda call for the whole array keeps the sorted pairs from being made again for each index.
    places = F.aggregate(
        F.array(ordered),
        F.array().cast("array<int>"),
        lambda _, pairs: F.sort_array(
            F.transform(
                F.filter(
                    F.sequence(F.lit(0), n - 1),
                    lambda k: F.coalesce(same(pairs, k, k - 1), F.lit(False))
                    | F.coalesce(same(pairs, k, k + 1), F.lit(False)),
                ),
                lambda k: F.get(pairs, k)["i"],
            )
        ),
    )
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).alias("words"), F.lit(-width).alias("last")),
        lambda s, at: F.struct(
            (s["words"] + F.least(F.lit(width), at - s["last"])).alias("words"), at.alias("last")
        ),
        lambda s: s["words"],
    )
    return F.when(F.size(F.array_distinct(hashes)) == n, 0).otherwise(covered)


def with_counts(docs: DataFrame) -> DataFrame:
    """``docs`` (with a column text) and its counts, in place of the text."""
    rest = [c for c in docs.columns if c != "text"]
    bare = F.btrim("text", F.lit(SPACE_CHARS))
    split = docs.select(
        *rest,
        "text",
        F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"{SPACE}+")).alias("words"),
        F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(SPACE_CHARS)) != "").alias("lines"),
    )
    at = [lambda i, k=k: F.get("words", i + k) for k in range(WINDOW)]
    hashed = split.withColumn(
        "windows",
        F.when(
            F.size("words") >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.size("words") - WINDOW), lambda i: F.xxhash64(*[word(i) for word in at])
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    return hashed.select(
        *rest,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("windows"), WINDOW).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def vector() -> dict[str, Column]:
    """The transformed statistics; a few notional words and lines keep short texts near the usual."""
    ratios = {
        "word_length": F.log((F.col("word_chars") + 250) / (F.col("n_words") + 50)),
        "symbols": F.sqrt(F.col("n_symbols") / (F.col("word_chars") + 200)),
        "dup_lines": F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 5)),
        "repeats": F.sqrt(F.col("n_repeat_words") / (F.col("n_words") + 50)),
    }
    return {name: F.round(ratio * UNIT).cast("long") for name, ratio in ratios.items()}


def _models(rows: DataFrame) -> DataFrame:
    """For each language and source (``of``): the model that judges it, ``judge``, and the models
    that its rows enter, ``enters``; staged.

    A group of MIN_ROWS usable rows or more has a model of its own.  A smaller one is judged by that of all
    usable rows of its language, its large groups included, and where those are too few as well, by
    that of the whole table, however few rows that has.  Models that judge no group are not made.
    """
    groups = (
        rows.where("usable")
        .groupBy(_key("lang", "source").alias("of"), _key("lang").alias("language"))
        .agg(F.count("*").alias("n"))
    )
    language = Window.partitionBy("language")
    enough = F.col("n") >= MIN_ROWS
    groups = stage(
        groups.select(
            "of",
            "language",
            enough.alias("own"),
            (F.sum("n").over(language) >= MIN_ROWS).alias("spoken"),
            F.min(enough).over(language).alias("all_own"),
        ),
        "groups",
    )
    table = F.xxhash64(F.lit("table"))
    # A language with fewer rows has no group with enough.
    rare = groups.agg(F.coalesce(F.bool_or(~F.col("spoken")), F.lit(False))).scalar()
    models = groups.select(
        "of",
        F.when(F.col("own"), F.col("of")).when(F.col("spoken"), F.col("language")).otherwise(table).alias("judge"),
        F.array_compact(
            F.array(
                F.when(F.col("own"), F.col("of")),
                F.when(F.col("spoken") & ~F.col("all_own"), F.col("language")),
                F.when(rare, table),
            )
        ).alias("enters"),
    )
    # Counted before the joins, which then move no rows to their group.
    return small(models, "models")


def _key(*columns: str) -> Column:
    return F.xxhash64(F.lit(len(columns)), *[x for c in columns for x in (F.col(c).isNull(), F.coalesce(c, F.lit("")))])


def _moments(rows: DataFrame) -> DataFrame:
    """Centre and Cholesky factor of the floored covariance for each (grp, start)."""
    v = VARIABLES
    pairs = [(i, j) for i in range(len(v)) for j in range(i + 1)]
    wide = "decimal(20,0)"
    sums = rows.groupBy("grp", "start").agg(
        F.count("*").alias("n"),
        *[F.sum(F.col(x).cast(wide)).alias(f"s_{i}") for i, x in enumerate(v)],
        *[F.sum((F.col(v[i]) * F.col(v[j])).cast(wide)).alias(f"s_{i}{j}") for i, j in pairs],
    )
    n = F.col("n").cast("double")
    mean = {i: F.col(f"s_{i}").cast("double") / n for i in range(len(v))}
    out = sums.select(
        "grp",
        "start",
        *[mean[i].alias(f"m_{i}") for i in mean],
        *[
            (
                CONSISTENT * (F.col(f"s_{i}{j}").cast("double") / n - mean[i] * mean[j])
                + (F.lit((FLOOR[v[i]] * UNIT) ** 2) if i == j else F.lit(0.0))
            ).alias(f"c_{i}{j}")
            for i, j in pairs
        ],
    )
    return _factor(out)


def _factor(cov: DataFrame) -> DataFrame:
    """Cholesky factor of the columns c_ij, row by row, and the logarithm of the determinant."""
    p = len(VARIABLES)
    for i in range(p):
        for j in range(i + 1):
            rest = F.col(f"c_{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}")
            if i == j:
                # The floors keep it positive but for rounding.
                cov = cov.withColumn(f"l_{i}{j}", F.sqrt(F.greatest(rest, F.lit(1.0))))
            else:
                cov = cov.withColumn(f"l_{i}{j}", rest / F.col(f"l_{j}{j}"))
    log_det = sum((F.log(f"l_{i}{i}") for i in range(1, p)), F.log("l_00"))
    names = [f"m_{i}" for i in range(p)] + [f"l_{i}{j}" for i in range(p) for j in range(i + 1)]
    return cov.select("grp", "start", log_det.alias("log_det"), *names)


def _distance() -> Column:
    """Squared Mahalanobis distance of a row joined with its group's model."""
    z: list[Column] = []
    for i, x in enumerate(VARIABLES):
        rest = F.col(x) - F.col(f"m_{i}")
        for k in range(i):
            rest = rest - F.col(f"l_{i}{k}") * z[k]
        z.append(rest / F.col(f"l_{i}{i}"))
    return sum((x * x for x in z[1:]), z[0] * z[0])


def _grid(distance: Column) -> Column:
    """Distances on a logarithmic grid: an exact quantile needs a bounded number of them."""
    return F.round(F.log1p(distance) * 512).cast("int")


def _nearest(rows: DataFrame, model: DataFrame) -> DataFrame:
    """For each start the PART of a group's rows nearest to its centre."""
    cut = (
        rows.join(model, "grp")
        .groupBy("grp", "start")
        .agg(F.percentile(_grid(_distance()), F.lit(PART)).alias("cut"))
    )
    # Counted before the join with the rows is planned, which then moves no rows.
    reach = small(model.join(cut, ["grp", "start"]), "mcd")
    return rows.join(reach, "grp").where(_grid(_distance()) <= F.col("cut"))


def estimates(rows: DataFrame) -> DataFrame:
    """One model per group of ``rows`` (grp and the variables)."""
    v = VARIABLES
    # Starts: all rows as they are; and rows weighed by medians, each variable for itself.
    medians = rows.groupBy("grp").agg(*[F.percentile(x, F.lit(0.5)).alias(f"m_{i}") for i, x in enumerate(v)])
    flat = medians.select(
        "grp",
        F.lit(1).alias("start"),
        F.lit(0.0).alias("log_det"),
        *[f"m_{i}" for i in range(len(v))],
        *[
            F.lit(FLOOR[v[i]] * UNIT if i == j else 0.0).alias(f"l_{i}{j}")
            for i in range(len(v))
            for j in range(i + 1)
        ],
    )
    whole = _moments(rows.withColumn("start", F.lit(0)))
    # Those of the starts are not of half of the rows: the first step always counts.
    model = small(whole.unionByName(flat).withColumn("log_det", F.lit(float("inf"))), "mcd")
    ended = model.limit(0)
    for _ in range(STEPS):
        last = model.select("grp", "start", F.col("log_det").alias("last"))
        after = small(_moments(_nearest(rows, model)).join(last, ["grp", "start"]), "mcd")
        # The floors may let a determinant rise again; then the model before it counts.
        ended = ended.unionByName(model.join(after.where("log_det >= last"), ["grp", "start"], "left_semi"))
        model = after.where("log_det < last").drop("last")
        if model.isEmpty():
            break
    model = ended.unionByName(model)
    best = Window.partitionBy("grp").orderBy("log_det", "start")
    ranked = model.withColumn("rank", F.row_number().over(best))
    return stage(ranked.where("rank = 1").drop("rank", "start"), "models")


def judge(counts: DataFrame) -> DataFrame:
    """A staged table with lang, source and the counts, and base_failed and kept."""
    failed = base_failed()
    rows = stage(
        counts.withColumns({**vector(), "base_failed": failed, "usable": ~failed, "grp": _key("lang", "source")}),
        "vectors",
    )
    models = _models(rows)
    usable = rows.where("usable").join(models, F.col("grp") == F.col("of"))
    model = estimates(usable.select(F.explode("enters").alias("grp"), *VARIABLES))
    judged = models.join(model.withColumnRenamed("grp", "judge"), "judge").drop("enters")
    joined = rows.join(small(judged, "judges"), F.col("grp") == F.col("of"), "left")
    # Only documents that failed the rules can be without a model.
    near = F.coalesce(_distance() <= CUTOFF, F.lit(False))
    return joined.select(*counts.columns, "base_failed", (~F.col("base_failed") & near).alias("kept"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document."""
    own = docs.select("doc_id", "lang", "source", text_or_empty().alias("text"))
    counts = stage(with_counts(own), "counts")
    return judge(counts).select("doc_id", *COUNTS, "base_failed", "kept")


def passing(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    rows = Rows(docs, "texts")
    texts = rows.values(lang=F.col("doc.lang"), source=F.col("doc.source"), text=text_or_empty("doc.text"))
    return rows.without(judge(stage(with_counts(texts), "counts")).where("not kept"))
