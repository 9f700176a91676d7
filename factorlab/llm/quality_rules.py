"""Quality rules: base counts, and robust outliers by minimum covariance determinant for each language and source.

All of it is DataFrame functions: counts are array expressions within a row, so texts are never shuffled. A concentration step takes
each row's distance from its group's estimate, sums the rows by cells of distance, and makes the next estimate from the nearest half,
so only sums by cell are shuffled. Estimates are made for all documents, for each language and for each language and source at once;
small groups lean on their language and small languages on all.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, Scratch, matched, written

#: The base rules.
MIN_WORDS, MAX_REPEATED = 50, 50
#: Share of a group that a concentration step keeps: the half that leaves most room for outliers.
SHARE = 0.5
#: What covariances are multiplied by: of the nearest half, 0.5 / P(chi2(7) <= q), q the median of chi2(5); of rows within WITHIN, the
#: 0.975 quantile of chi2(5), the same with 0.975.
CONSISTENT, WITHIN, CONSISTENT_WITHIN = 1.9122, 12.8325, 1.0555
#: Steps of every start, after which the start of least determinant goes on; steps that it takes at most; a log determinant's fall that counts.
FIRST_STEPS, STEPS, FALL = 2, 10, 1e-3
#: Documents that a group's own estimate is weighed against: one of n has a weight of n / (n + PRIOR), its language the rest.
PRIOR = 30
#: Estimates (three for a group) that are broadcast. If there can be more, those of groups with over one in HOT of the rows are, which are
#: fewer than HOT estimates, and the others are joined.
BROADCAST, HOT = 20_000, 1000
#: Squared distance beyond which a document is an outlier: the 1 - 1e-9 quantile of chi2(5), so that a billion clean documents lose about one.
CUT = 49.6
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: The statistics and, for each, a spread below which differences mean nothing; it is added to the spread that is found.
SPREADS = {"length": 0.25, "word_length": 0.04, "symbols": 0.35, "dup_lines": 0.35, "repeats": 0.35}
P = len(SPREADS)
#: Cells that a unit of a statistic, and a doubling of a distance, are cut into for quantiles.
CELLS, NEAR_CELLS = 256, 32
#: From so many words on places don't leave room for a hash in one number.
MANY_WORDS = 1 << 17


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES)), " "), "")


def repeated_words(own: Column) -> Column:
    """Words in 3-word windows that the text holds twice or more.

    Windows are sorted by hash and place, so that equal ones are neighbours, and neighbours are held against each other word by
    word. Below MANY_WORDS a number has 47 bits of hash above the place; from there on 64-bit hashes and places are sorted as structs.
    """
    mask = F.lit(MANY_WORDS - 1).cast("long")
    alike = lambda i, j: (F.get(own, i) == F.get(own, j)) & (F.get(own, i + 1) == F.get(own, j + 1)) & (F.get(own, i + 2) == F.get(own, j + 2))
    windows = lambda form: F.transform(F.sequence(F.lit(0), F.size(own) - 3), lambda i: form(F.xxhash64(F.get(own, i), F.get(own, i + 1), F.get(own, i + 2)), i))

    def count(places: Column) -> Column:
        three = F.lit(3).cast("long")
        gaps = let(F.sort_array(places), lambda at: F.transform(at, lambda i, k: F.least(three, F.coalesce((F.get(at, k + 1) - i).cast("long"), three))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x)

    def few(ordered: Column) -> Column:
        at = lambda x: x.bitwiseAND(mask).cast("int")
        same = lambda x, y: (x.bitwiseAND(-1 - mask) == y.bitwiseAND(-1 - mask)) & alike(at(x), at(y))
        return count(F.transform(F.filter(ordered, lambda x, k: same(x, F.get(ordered, k + 1)) | same(x, F.get(ordered, k - 1))), at))

    def many(ordered: Column) -> Column:
        same = lambda x, y: (x["h"] == y["h"]) & alike(x["i"], y["i"])
        return count(F.transform(F.filter(ordered, lambda x, k: same(x, F.get(ordered, k + 1)) | same(x, F.get(ordered, k - 1))), lambda x: x["i"]))

    packed = let(F.sort_array(windows(lambda h, i: h.bitwiseAND(-1 - mask).bitwiseOR(i.cast("long")))), few)
    structs = let(F.sort_array(windows(lambda h, i: F.struct(h.alias("h"), i.alias("i")))), many)
    return F.when(F.size(own) < 4, F.lit(0).cast("long")).when(F.size(own) < MANY_WORDS, packed).otherwise(structs)


def statistics(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed. A null text is an empty one."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    counts = let(
        words(F.col("text")),
        lambda own: F.struct(F.size(own).cast("long").alias("n_words"), repeated_words(own).alias("n_repeat_words")),
    )
    return (
        docs.withColumn("_counts", counts)
        .withColumns(
            {
                "n_words": F.col("_counts.n_words"),
                "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
                "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
                "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
                "n_repeat_words": F.col("_counts.n_repeat_words"),
            }
        )
        .drop("_counts")
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))
    )


def vector() -> list[Column]:
    """The transformed statistics, in the order of SPREADS."""
    n = F.greatest("n_words", F.lit(1))
    return [
        F.log(n),
        F.log(F.greatest("word_chars", F.lit(1)) / n),
        F.log1p(200 * F.col("n_symbols") / F.greatest("word_chars", F.lit(1))),
        F.log1p(100 * F.col("n_dup_lines") / n),
        F.log1p(20 * F.col("n_repeat_words") / n),
    ]


X, M, Y = ([f"_{v}{i}" for i in range(P)] for v in "xmy")
LOW = [(i, j) for i in range(P) for j in range(i + 1)]
COV = [f"_c{i}_{j}" for i, j in LOW]
KEYS = ["_group", "_start"]

# The formulas below are SQL text: one of some dozen terms is parsed at once, and later ones name the values of earlier ones.


def _medians(rows: DataFrame, values: list[Column]) -> DataFrame:
    """_group and the medians of the values, as columns _m0, _m1, ...; counted by cells of 1 / CELLS, of which a group has few."""
    each = rows.select("_group", F.posexplode(F.array(*values)).alias("_at", "_value"))
    counts = each.groupBy("_group", "_at", F.floor(F.col("_value") * CELLS).cast("long").alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy("_group", "_at")
    share = F.sum("_n").over(own.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("_n").over(own)
    found = counts.withColumn("_share", share).filter("_share >= 0.5").groupBy("_group", "_at").agg(F.min("_cell").alias("_cell"))
    return found.groupBy("_group").agg(*[F.max(F.when(F.col("_at") == i, (F.col("_cell") + 0.5) / CELLS)).alias(M[i]) for i in range(P)])


def _with_inverse(groups: DataFrame, carry: list[str]) -> DataFrame:
    """carry, centres, the inverses _p0_0 ... of the covariances _c0_0 ..., to which spreads that mean nothing are added, and _logdet: by Cholesky."""
    less = lambda i, j: "".join(f" - _l{i}_{k} * _l{j}_{k}" for k in range(j))
    given = [f"_c{i}_{j}{f' + {spread * spread}D' if i == j else ''} AS _k{i}_{j}" for (i, spread) in enumerate(SPREADS.values()) for j in range(i + 1)]
    factor = [f"sqrt(greatest(_k{j}_{j}{less(j, j)}, 1e-9D)) AS _l{j}_{j}" if i == j else f"(_k{i}_{j}{less(i, j)}) / _l{j}_{j} AS _l{i}_{j}" for j in range(P) for i in range(j, P)]
    inverse = [f"1D / _l{i}_{i} AS _a{i}_{i}" if i == j else f"-({' + '.join(f'_l{i}_{k} * _a{k}_{j}' for k in range(j, i))}) / _l{i}_{i} AS _a{i}_{j}" for i in range(P) for j in range(i + 1)]
    products = [f"{' + '.join(f'_a{k}_{i} * _a{k}_{j}' for k in range(i, P))} AS _p{i}_{j}" for i, j in LOW]
    logdet = f"2 * ({' + '.join(f'ln(_l{i}_{i})' for i in range(P))}) AS _logdet"
    return groups.selectExpr(*carry, *M, *given, *factor, *inverse, *products, logdet).select(*carry, *M, *[f"_p{i}_{j}" for i, j in LOW], "_logdet")


def _beside(rows: DataFrame, groups: DataFrame, uses: DataFrame | None, how: str = "inner") -> DataFrame:
    """rows with their groups' columns. Without `uses`, the rows of each group, all groups are broadcast; with it only those of groups with
    many rows are, so that no task gets such a group whole. Groups that `groups` lacks are joined as nulls, so theirs are spread as well."""
    if uses is None:
        return rows.join(F.broadcast(groups), "_group", how)
    found = matched(rows, uses.join(groups.withColumn("_there", F.lit(True)), "_group", "left"), "_group", HOT)
    return (found if how == "left" else found.filter("_there")).drop("_there")


def _apart(rows: DataFrame, groups: DataFrame, uses: DataFrame | None, how: str = "inner") -> DataFrame:
    """rows with their groups' columns, deviations _y0 ... and the squared distance _d2."""
    near = _beside(rows, groups, uses, how).selectExpr("*", *[f"{x} - {m} AS {y}" for x, m, y in zip(X, M, Y, strict=True)])
    return near.selectExpr("*", " + ".join(f"{1 if i == j else 2} * _p{i}_{j} * {Y[i]} * {Y[j]}" for i, j in LOW) + " AS _d2")


def _moments(row: str = "{}") -> list[Column]:
    """Number, sums and sums of products of deviations."""
    values = {"_n": "1L"} | {f"_s{i}": y for i, y in enumerate(Y)} | {f"_q{i}_{j}": f"{Y[i]} * {Y[j]}" for i, j in LOW}
    return [F.expr(f"sum({row.format(v)}) AS {name}") for name, v in values.items()]


def _estimate(sums: DataFrame, groups: DataFrame, keys: list[str], factor: float, carry: list[str]) -> DataFrame:
    """carry, centres and covariances from the moments about the centres of `groups`."""
    found = sums.join(groups.select(*keys, *M, F.col("_logdet").alias("_old")), keys)
    cov = [f"{factor}D * (_q{i}_{j} / _n - _s{i} / _n * _s{j} / _n) AS _c{i}_{j}" for i, j in LOW]
    return found.selectExpr(*carry, *[f"{m} + _s{i} / _n AS {m}" for i, m in enumerate(M)], *cov)


def _concentrated(rows: DataFrame, groups: DataFrame, uses: DataFrame | None) -> DataFrame:
    """One step: the estimates from the nearest SHARE of each group's rows, by the estimates given, and whether the determinant fell."""
    cells = _apart(rows, groups, uses).groupBy(*KEYS, F.floor(F.log2(F.col("_d2") + 1e-6) * NEAR_CELLS).cast("long").alias("_cell")).agg(*_moments())
    own = Window.partitionBy(*KEYS)
    before = F.sum("_n").over(own.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    near = cells.withColumn("_before", before / F.sum("_n").over(own)).filter(F.col("_before") < SHARE)
    names = ["_n", *[f"_s{i}" for i in range(P)], *[f"_q{i}_{j}" for i, j in LOW]]
    sums = near.groupBy(*KEYS).agg(*[F.expr(f"sum({c}) AS {c}") for c in names])
    after = _with_inverse(_estimate(sums, groups, KEYS, CONSISTENT, [*KEYS, "_old"]), [*KEYS, "_old"])
    return after.withColumn("_fell", F.col("_old") - F.col("_logdet") > FALL).drop("_old")


def _starts(rows: DataFrame, uses: DataFrame | None, scratch: Scratch) -> DataFrame:
    """Three estimates to start from: medians with median absolute deviations; means with covariances; medians with the covariances of signs."""
    middle = scratch.written(_medians(rows, [F.col(x) for x in X]))
    about = _beside(rows, middle, uses)
    off = _medians(about, [F.abs(F.col(x) - F.col(m)) for x, m in zip(X, M, strict=True)])
    spread = middle.join(off.withColumnsRenamed({m: f"_o{i}" for i, m in enumerate(M)}), "_group")
    first = spread.selectExpr("_group", "0 AS _start", *M, *[f"pow(1.4826D * _o{i}, 2) AS _c{i}_{j}" if i == j else f"0D AS _c{i}_{j}" for i, j in LOW])
    second = rows.groupBy("_group").agg(*[F.expr(f"avg({x}) AS {m}") for x, m in zip(X, M, strict=True)], *[F.expr(f"covar_pop({X[i]}, {X[j]}) AS _c{i}_{j}") for i, j in LOW]).selectExpr("_group", "1 AS _start", *M, *COV)
    # signs in units of the spreads that mean something
    units = list(SPREADS.values())
    signed = about.selectExpr("*", *[f"({x} - {m}) / {u}D AS {y}" for x, m, u, y in zip(X, M, units, Y, strict=True)])
    signed = signed.selectExpr("*", f"greatest({' + '.join(f'{y} * {y}' for y in Y)}, 1e-18D) AS _size")
    third = signed.groupBy("_group", *M).agg(*[F.expr(f"avg({Y[i]} * {Y[j]} / _size) * {units[i] * units[j]}D AS _c{i}_{j}") for i, j in LOW]).selectExpr("_group", "2 AS _start", *M, *COV)
    return _with_inverse(first.unionByName(second).unionByName(third), KEYS)


def robust(rows: DataFrame, uses: DataFrame | None, scratch: Scratch) -> DataFrame:
    """_group, _n, centres _m and covariances _c of the reweighted minimum-covariance-determinant estimate, from rows with _group and statistics.

    Every start takes FIRST_STEPS concentration steps; the one of least determinant goes on until no group's determinant falls any more. Rows
    within the 0.975 quantile of the distance make the estimate. `uses` is (_group, uses), the rows of each group, where groups are too many to
    be broadcast.
    """
    groups = scratch.written(_starts(rows, uses, scratch))
    for _ in range(FIRST_STEPS):
        groups = scratch.written(_concentrated(rows, groups, uses))
    best = groups.groupBy("_group").agg(F.min(F.struct("_logdet", "_start")).alias("_best")).select("_group", F.col("_best._start").alias("_start"))
    groups, done = scratch.written(groups.join(best, KEYS)), []
    for _ in range(STEPS):
        after = scratch.written(_concentrated(rows, groups, uses))
        done.append(after.filter(~F.col("_fell")))
        groups = after.filter("_fell")
        if not groups.limit(1).count():
            break
    groups = scratch.written(reduce(lambda a, b: a.unionByName(b), done, groups))
    sums = _apart(rows, groups, uses).groupBy("_group").agg(*_moments(f"CASE WHEN _d2 <= {WITHIN}D THEN {{}} END"), F.count(F.lit(1)).alias("_all"))
    near = sums.filter("_n > 0")
    return _estimate(near, groups, ["_group"], CONSISTENT_WITHIN, ["_group", "_all AS _n"])


def _uses(rows: DataFrame) -> DataFrame:
    """_group and its number of rows."""
    return rows.groupBy("_group").agg(F.count(F.lit(1)).alias("uses"))


def _leaning(own: DataFrame, on: DataFrame, by: str) -> DataFrame:
    """own's estimates, each weighed against the one of `on` that its column `by` names."""
    on = on.selectExpr(f"_group AS {by}", *[f"{c} AS _on{c}" for c in [*M, *COV]])
    return own.join(on, by, "left").selectExpr(*[c for c in own.columns if c not in [*M, *COV]], *[f"coalesce((_n * {c} + {PRIOR} * _on{c}) / (_n + {PRIOR}), {c}) AS {c}" for c in [*M, *COV]])


def _name(level: int, *columns: str) -> Column:
    """A group's name; nulls are left out of it, so they are names of their own."""
    return F.xxhash64(F.to_json(F.struct(F.lit(level).alias("level"), *columns)))


def judge(docs: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """doc_id, the counts, base_failed, distance (squared; null where base_failed) and kept, one row for each row of docs; `extra` columns stay,
    but for those with the name of one of these.

    Documents that fail a base rule are not kept and take no part in estimates. A group of n documents has an estimate of its own with a
    weight of n / (n + PRIOR); the rest is its language's, of which the same holds against all documents. Null languages and sources
    are groups of their own. An empty table gives no rows.
    """
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    stay = [c for c in extra or [] if c not in ("doc_id", *counts, "distance", "kept")]
    # they travel as one, so none can be taken for one of this module's
    carried = [F.struct(*stay).alias("_stay")] if stay else []
    docs = docs.select("doc_id", "text", "lang", "source", *carried)
    with Scratch(docs.sparkSession) as scratch:
        named = statistics(docs).withColumns({"_all": F.lit(0).cast("long"), "_lang": _name(1, "lang"), "_group": _name(2, "lang", "source")})
        table = scratch.written(named.select("doc_id", *(["_stay"] if stay else []), *counts, "_all", "_lang", "_group", *[v.cast("double").alias(x) for x, v in zip(X, vector(), strict=True)]))
        fit = table.filter(~F.col("base_failed"))
        names = scratch.written(fit.select("_all", "_lang", "_group").distinct())
        many = 3 * names.count() > BROADCAST
        rows = fit.select(*X, F.explode(F.array("_all", "_lang", "_group")).alias("_group"))
        estimates = scratch.written(robust(rows, scratch.written(_uses(rows)) if many else None, scratch))
        everyone = estimates.filter("_group = 0")
        langs = _leaning(estimates.join(names.select("_all", F.col("_lang").alias("_group")).distinct(), "_group"), everyone, "_all")
        groups = _leaning(estimates.join(names.select("_lang", "_group"), "_group"), scratch.written(langs), "_lang")
        groups = scratch.written(_with_inverse(groups, ["_group"]))
        distance = F.when(~F.col("base_failed"), F.col("_d2"))
        kept = ~F.col("base_failed") & F.coalesce(F.col("_d2") <= CUT, F.lit(True))
        return written(_apart(table, groups, scratch.written(_uses(table)) if many else None, "left").select("doc_id", *[F.col("_stay")[c].alias(c) for c in stay], *counts, distance.alias("distance"), kept.alias("kept")))
