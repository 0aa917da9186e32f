"""Quality rules: plain limits, then robust multivariate outliers per language and source.

Every text gets a vector of transformed statistics. The minimum covariance determinant (MCD) of a
group is its centre and scatter over the half of its rows that lie closest together. It is found
by concentration steps from two starts: take the half that is nearest under the present estimate,
estimate again, repeat; the start with the smaller determinant wins. A row is rejected when its
Mahalanobis distance from the reweighted estimate is beyond a chi-square quantile.

A step is one aggregation: rows are summed by group and by a fine, logarithmic class of their
distance, so that the nearest half is a sum over classes and no group is ever sorted or gathered.
Only DataFrame functions are used.

Defined results: a null text counts as empty; a text without words has no vector and fails the
plain limits; a null language or source is a value like any other; groups below ``min_group`` rows
are judged together with the other small groups of their language; repeated rows and ids are
judged each for itself; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradebook.llm.columns import BLANKS, let, text_of, words_of, written

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Smallest standard deviation that a statistic is taken to have, so that one that is the same in
#: most texts of a group doesn't turn the rest into outliers. Repeated lines can reject by themselves (from half of
#: the lines on, in a group without any); repeated words, which the plain limit ends at 0.3, only together with others.
FLOORS = {"x_word_length": 0.08, "x_symbols": 0.03, "x_repeats": 0.165, "x_lines": 0.165}
FEATURES = tuple(FLOORS)
CLASSES_PER_OCTAVE = 32
PAIRS = tuple((i, j) for i in range(len(FEATURES)) for j in range(i + 1))


def _repeated_words(words: Column) -> Column:
    """Words covered by 8-word windows that the text has twice or more."""

    def covered(hashes: Column) -> Column:
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(rows: Column) -> Column:
            return F.sort_array(
                F.transform(
                    F.filter(
                        F.transform(
                            rows,
                            lambda r, i: F.struct(
                                r["i"].alias("at"),
                                (
                                    F.coalesce(F.get(rows, i - 1)["h"] == r["h"], F.lit(False))
                                    | F.coalesce(F.get(rows, i + 1)["h"] == r["h"], F.lit(False))
                                ).alias("twice"),
                            ),
                        ),
                        lambda r: r["twice"],
                    ),
                    lambda r: r["at"],
                )
            )

        def length(at: Column) -> Column:
            return F.aggregate(
                F.transform(at, lambda p, i: F.least(F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))),
                F.lit(0).cast("long"),
                lambda total, x: total + x,
            )

        return let(by_hash, lambda rows: let(positions(rows), length))

    def counted(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
        return F.when(F.size(w) <= WINDOW, F.lit(0).cast("long")).otherwise(
            let(
                hashes,
                lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)),
            )
        )

    return counted(words)


def _duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def _lines(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != ""))


def statistics(docs: DataFrame) -> DataFrame:
    """Plain statistics of each whole text: doc_id, lang, source, n_words, word_chars, ..."""
    text = text_of("text")
    counts = let(words_of(text), lambda w: F.struct(F.size(w).alias("n_words"), _repeated_words(w).alias("n_repeat_words")))
    found = docs.select(
        "doc_id",
        "lang",
        "source",
        counts.alias("counts"),
        F.length(F.translate(text, BLANKS, "")).alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
        _duplicate_lines(text).alias("n_dup_lines"),
        _lines(text).alias("n_lines"),
    )
    whole = [F.col(c).cast("long").alias(c) for c in ("word_chars", "n_symbols", "n_dup_lines")]
    return found.select(
        "doc_id",
        "lang",
        "source",
        F.col("counts.n_words").cast("long").alias("n_words"),
        *whole,
        F.col("counts.n_repeat_words").alias("n_repeat_words"),
        F.col("n_lines").cast("long").alias("n_lines"),
    ).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _vector() -> dict[str, Column]:
    """Transformed statistics; null without a word."""
    words = F.col("n_words").cast("double")
    return {
        "x_word_length": F.log(F.try_divide("word_chars", words)) - math.log(5),
        "x_symbols": F.sqrt(F.try_divide("n_symbols", F.col("word_chars").cast("double"))),
        "x_repeats": F.sqrt(F.try_divide("n_repeat_words", words)),
        "x_lines": F.sqrt(F.try_divide("n_dup_lines", F.col("n_lines").cast("double"))),
    }


def _chi_square(x: float, dof: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))


def chi_square_quantile(share: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi_square(mid, dof) < share else (low, mid)
    return high


def _consistency(share: float) -> float:
    """What the scatter of the nearest ``share`` of normal rows is too small by."""
    p = len(FEATURES)
    return share / _chi_square(chi_square_quantile(share, p), p + 2)


def _sums() -> list[Column]:
    return [
        F.count("*").alias("n"),
        *(F.sum(x).alias(f"s_{i}") for i, x in enumerate(FEATURES)),
        *(F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"s_{i}_{j}") for i, j in PAIRS),
    ]


def _added() -> list[Column]:
    names = ["n", *(f"s_{i}" for i in range(len(FEATURES))), *(f"s_{i}_{j}" for i, j in PAIRS)]
    return [F.sum(c).alias(c) for c in names]


def _estimate(sums: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Centre m_i, inverse w_i_j of the scatter's Cholesky factor, and log determinant."""
    p = len(FEATURES)
    out = sums.select(
        *keys,
        *((F.col(f"s_{i}") / F.col("n")).alias(f"m_{i}") for i in range(p)),
        *(
            (
                factor * (F.col(f"s_{i}_{j}") / F.col("n") - F.col(f"s_{i}") / F.col("n") * F.col(f"s_{j}") / F.col("n"))
                + (FLOORS[FEATURES[i]] ** 2 if i == j else 0.0)
            ).alias(f"c_{i}_{j}")
            for i, j in PAIRS
        ),
    )
    for j in range(p):
        for i in range(j, p):
            rest = F.col(f"c_{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            out = out.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l_{j}_{j}"))
    for j in range(p):
        for i in range(j, p):
            if i == j:
                value = 1 / F.col(f"l_{i}_{i}")
            else:
                value = F.lit(0.0)
                for k in range(j, i):
                    value = value - F.col(f"l_{i}_{k}") * F.col(f"w_{k}_{j}")
                value = value / F.col(f"l_{i}_{i}")
            out = out.withColumn(f"w_{i}_{j}", value)
    log_det = sum((F.log(F.col(f"l_{i}_{i}")) for i in range(p)), F.lit(0.0))
    return out.select(*keys, *(f"m_{i}" for i in range(p)), *(f"w_{i}_{j}" for i, j in PAIRS), log_det.alias("log_det"))


def _distance() -> Column:
    """Squared Mahalanobis distance."""
    total = F.lit(0.0)
    for i in range(len(FEATURES)):
        z = F.lit(0.0)
        for j in range(i + 1):
            z = z + F.col(f"w_{i}_{j}") * (F.col(FEATURES[j]) - F.col(f"m_{j}"))
        total = total + z * z
    return total


def _concentrate(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """One concentration step of every group and start."""
    share = 0.5
    measured = rows.join(estimates, "grp").withColumn(
        "class", F.floor(CLASSES_PER_OCTAVE * F.log2(_distance() + 1e-6)).cast("int")
    )
    classes = measured.groupBy("grp", "start", "class").agg(*_sums())
    upto = Window.partitionBy("grp", "start").orderBy("class")
    total = Window.partitionBy("grp", "start")
    nearest = classes.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(total)}).filter(
        F.col("upto") - F.col("n") < share * F.col("total")
    )
    return _estimate(nearest.groupBy("grp", "start").agg(*_added()), ["grp", "start"], _consistency(share))


def _starts(rows: DataFrame) -> DataFrame:
    """Two starts: medians with quartile ranges, and plain means with the plain covariance."""
    p = len(FEATURES)
    plain = _estimate(rows.groupBy("grp").agg(*_sums()), ["grp"], 1.0).withColumn("start", F.lit("plain"))
    quartiles = rows.groupBy("grp").agg(*(F.percentile_approx(x, [0.25, 0.5, 0.75], 10_000).alias(x) for x in FEATURES))
    ranges = quartiles.select(
        "grp",
        *(F.col(x)[1].alias(f"m_{i}") for i, x in enumerate(FEATURES)),
        *(
            (1 / F.sqrt(((F.col(FEATURES[i])[2] - F.col(FEATURES[i])[0]) / 1.349) ** 2 + FLOORS[FEATURES[i]] ** 2)
             if i == j else F.lit(0.0)).alias(f"w_{i}_{j}")
            for i, j in PAIRS
        ),
        F.lit(0.0).alias("log_det"),
        F.lit("quartiles").alias("start"),
    )
    names = ["grp", *(f"m_{i}" for i in range(p)), *(f"w_{i}_{j}" for i, j in PAIRS), "log_det", "start"]
    return plain.select(names).unionByName(ranges.select(names))


def estimates(rows: DataFrame, steps: int = 5) -> DataFrame:
    """Reweighted MCD estimate of every group of ``rows`` (grp and the statistics), one row each."""
    now = written(_starts(rows), "mcd")
    for _ in range(steps):
        now = written(_concentrate(rows, now), "mcd")
    best = now.groupBy("grp").agg(F.min_by(F.struct(*[c for c in now.columns if c != "grp"]), F.struct("log_det", "start")).alias("e"))
    inner = chi_square_quantile(0.975, len(FEATURES))
    near = rows.join(best.select("grp", "e.*"), "grp").filter(_distance() <= inner)
    again = _estimate(near.groupBy("grp").agg(*_sums()), ["grp"], _consistency(0.975))
    return written(again, "mcd")


def judge(docs: DataFrame, min_group: int = 50, steps: int = 5, tail: float = 1e-3) -> DataFrame:
    """One row for each document: its statistics, ``base_failed``, ``distance`` and ``kept``.

    ``docs`` has doc_id, text, lang and source; other columns are ignored. ``tail`` is the share of
    normally distributed rows that the limit on the distance would reject. Texts without a word, and
    groups of which no row is near the estimate, have no distance; the latter are kept.
    """
    group = F.to_json(F.struct("lang", "source"))
    # Texts are read once; what follows works on a few numbers a row.
    stats = written(statistics(docs).withColumns(_vector() | {"own": group, "pool": F.to_json(F.struct("lang"))}), "quality")
    sizes = stats.filter("n_words > 0").groupBy("own").agg(F.count("*").alias("members"))
    grouped = stats.join(sizes, "own", "left").withColumn(
        "grp", F.when(F.coalesce("members", F.lit(0)) >= min_group, F.col("own")).otherwise(F.col("pool"))
    )
    grouped = written(grouped.drop("own", "pool", "members"), "quality")
    found = estimates(grouped.filter("n_words > 0").select("grp", *FEATURES), steps)
    limit = chi_square_quantile(1 - tail, len(FEATURES))
    judged = grouped.join(found, "grp", "left").withColumn("distance", F.when(F.col("n_words") > 0, F.sqrt(_distance())))
    return judged.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(F.col("distance") <= math.sqrt(limit), F.lit(True))).alias("kept"),
        "distance",
    )
