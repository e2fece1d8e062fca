"""Quality rules: robust multivariate outliers of text statistics by language and source, in DataFrame operations only.

Counts of each text become a vector of logarithms and roots. For each language and source the minimum covariance determinant is
sought: of all sets of three quarters of the documents the one whose covariance has the least determinant. Concentration steps find
it: distances from the estimate, the nearest three quarters, their mean and covariance again. Vectors are whole
numbers of 1/512, so that sums don't depend on the order of rows, and reruns agree; distances are counted in ranges of
1/32, which hold the sums of their vectors too, so a step is one aggregation and no task sorts or collects a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdigris.llm.filters import word_list
from verdigris.llm.store import release, small, stored

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Units of a coordinate and ranges of a distance; distances from the last range on are counted there.
UNITS, RANGES, LAST = 512, 32, 4095
#: Every text counts as having so many more words of five characters, so that the shares of short ones are no extremes.
MORE_WORDS = 50
#: Least standard deviation of each coordinate: a statistic that is nearly always 0 has no spread of its own, and what the base rules let pass is no outlier alone.
FLOORS = (0.5, 0.05, 0.04, 0.7, 0.12)
P = len(FLOORS)
#: How far the covariance of the nearest three quarters of five normal coordinates falls short of that of all.
SHORT = 0.7058
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def repeated_words(w: Column, size: int = 5) -> Column:
    """Words of a list in windows of ``size`` that the list has twice or more.

    Windows are compared by 64 bits of hash. Only a list whose hashes aren't all different is sorted: equal
    neighbours give the windows' places, and a window's words count as far as the next place.
    """
    hashes = F.when(F.size(w) < size, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - size, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)])))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, k, x: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        again = F.transform(F.array(pairs), lambda s: F.filter(s, lambda x, k: same(s, k + 1, x) | same(s, k - 1, x)))[0]
        places = F.sort_array(F.transform(again, lambda x: x["i"]))
        return F.transform(F.array(places), lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(size), F.coalesce(F.get(p, k + 1) - x, F.lit(size)))), F.lit(0), lambda a, b: a + b))[0]

    return F.transform(F.array(hashes), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))[0]


def counts(text: Column) -> Column:
    """A struct of BASE for a text, null being empty."""
    text = F.coalesce(text, F.lit(""))
    spaced = text
    for space in BLANKS[1:]:
        spaced = F.replace(spaced, F.lit(space), F.lit(" "))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rtrim(x, F.lit(BLANKS)) != "")
    of_words = F.transform(F.array(word_list(text)), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("again")))[0]
    return F.transform(
        F.array(of_words),
        lambda w: F.struct(
            w["n"].alias("n_words"),
            F.char_length(F.replace(spaced, F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long").alias("n_dup_lines"),
            w["again"].alias("n_repeat_words"),
        ),
    )[0]


def base_failed(least_words: int = 10, most_repeated: int = 20) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))


def vector() -> list[Column]:
    """The coordinates x0... of counts, in whole UNITS: logarithms of words, their mean length and repeated lines, roots of the shares of symbols and repeated words."""
    n, more = F.col("n_words"), F.lit(MORE_WORDS)
    characters = F.col("word_chars") + 5 * more
    values = [F.log(n.cast("double")), F.log(characters / (n + more)), F.sqrt(F.col("n_symbols") / characters), F.log((F.col("n_dup_lines") + 1).cast("double")), F.sqrt(F.col("n_repeat_words") / (n + more))]
    return [F.floor(UNITS * x + 0.5).cast("long").alias(f"x{i}") for i, x in enumerate(values)]


def groups(rows: DataFrame, least: int) -> DataFrame:
    """(lang, source, gid) of rows (lang, source): each pair with ``least`` rows is a group; smaller ones of a language are one, and so
    are the rows of all languages whose rest is smaller. A rest of fewer than ``least`` rows has no gid."""
    pairs = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    own = F.col("n") >= least
    rest = pairs.filter(~own).groupBy(F.col("lang").alias("l")).agg(F.sum("n").alias("rest"))
    joined = pairs.join(rest, F.col("lang").eqNullSafe(F.col("l")), "left").drop("l")
    pooled = F.col("rest") >= least
    last = rest.filter(F.col("rest") < least).agg(F.sum("rest")).first()[0] or 0
    name = F.when(own, F.to_json(F.struct(F.lit(1), "lang", "source"))).when(pooled, F.to_json(F.struct(F.lit(2), "lang"))).when(F.lit(last >= least), "3")
    return joined.select("lang", "source", name.alias("gid"))


SUMS = ["n", *[f"s{i}" for i in range(P)], *[f"s{i}{j}" for i, j in PAIRS]]
ESTIMATE = [*[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i, j in PAIRS]]


def _moments() -> list[Column]:
    return [F.expr(c) for c in ["count(1) AS n", *[f"sum(x{i}) AS s{i}" for i in range(P)], *[f"sum(x{i} * x{j}) AS s{i}{j}" for i, j in PAIRS]]]


def _root(sums: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., m0..., l00...): means and the Cholesky root of the covariance, whose diagonal has the floors added, from SUMS."""
    mean = [f"s{i} / n AS m{i}" for i in range(P)]
    root = []
    for i, j in PAIRS:
        rest = f"s{i}{j} / n - m{i} * m{j}"
        rest = f"greatest({rest}, 0D) + {(FLOORS[i] * UNITS) ** 2!r}D" if i == j else rest
        rest += "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
        root.append(f"sqrt({rest}) AS l{i}{i}" if i == j else f"({rest}) / l{j}{j} AS l{i}{j}")
    return sums.selectExpr(*keep, *mean, *root)


def _distance(rows: DataFrame) -> DataFrame:
    """Adds ``d``, the Mahalanobis distance of x0... by m0... and l00...: forward substitution."""
    steps = [f"(x{i} - m{i}" + "".join(f" - l{i}{k} * y{k}" for k in range(i)) + f") / l{i}{i} AS y{i}" for i in range(P)]
    square = " + ".join(f"y{i} * y{i}" for i in range(P))
    return rows.selectExpr("*", *steps, f"sqrt({square}) AS d").drop(*[f"y{i}" for i in range(P)], *ESTIMATE)


def _range() -> Column:
    return F.least(F.floor(RANGES * F.col("d")), F.lit(LAST)).cast("int").alias("range")


def _medians(rows: DataFrame) -> DataFrame:
    """(gid, m0..., l00...): each coordinate's median and, as its spread, a quarter range; from counted values."""
    each = rows.select("gid", F.posexplode(F.array(*[f"x{i}" for i in range(P)])).alias("k", "x")).groupBy("gid", "k", "x").agg(F.count(F.lit(1)).alias("n"))
    up_to = F.sum("n").over(Window.partitionBy("gid", "k").orderBy("x"))  # distinct whole numbers of 1/UNITS
    total = F.sum("n").over(Window.partitionBy("gid", "k"))
    quarter = lambda q: F.min(F.when(4 * F.col("up_to") >= q * F.col("total"), F.col("x")))
    found = each.select("gid", "k", "x", up_to.alias("up_to"), total.alias("total")).groupBy("gid", "k").agg(*[quarter(q).alias(f"q{q}") for q in (1, 2, 3)])
    pick = lambda i, c: F.max(F.when(F.col("k") == i, F.col(c)))
    wide = found.groupBy("gid").agg(*[pick(i, f"q{q}").alias(f"c{i}{q}") for i in range(P) for q in (1, 2, 3)])
    spread = lambda i: (F.col(f"c{i}3") - F.col(f"c{i}1")) / F.lit(1.349)
    root = lambda i: F.sqrt(spread(i) * spread(i) + F.lit((FLOORS[i] * UNITS) ** 2))
    return wide.select("gid", *[F.col(f"c{i}2").cast("double").alias(f"m{i}") for i in range(P)], *[(root(i) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i, j in PAIRS])


def estimates(rows: DataFrame, share: float = 0.75, steps: int = 6) -> DataFrame:
    """(gid, m0..., l00...): the robust mean and covariance root of each group of rows (gid, x0...).

    Concentration starts twice, from medians and quarter ranges and from all rows; the smaller determinant counts.
    """
    whole = _root(rows.groupBy("gid").agg(*_moments()), ["gid"])
    now = stored(_medians(rows).withColumn("start", F.lit(0)).unionByName(whole.withColumn("start", F.lit(1))), "outlier-start")
    along = Window.partitionBy("gid", "start").orderBy("range")  # LAST + 1 rows at most
    whole_of = Window.partitionBy("gid", "start")
    for _ in range(steps):
        ranged = _distance(rows.join(small(now), "gid")).groupBy("gid", "start", _range()).agg(*_moments())
        placed = ranged.select("*", F.sum("n").over(along).alias("up_to"), F.sum("n").over(whole_of).alias("total"))
        nearest = placed.filter(F.col("up_to") - F.col("n") < F.lit(share) * F.col("total"))
        after = stored(_root(nearest.groupBy("gid", "start").agg(*[F.expr(f"sum({c}) AS {c}") for c in SUMS]), ["gid", "start"]), "outlier-step")
        release(now)
        now = after
    determinant = F.expr(" * ".join(f"l{i}{i}" for i in range(P)))
    best = stored(now.groupBy("gid").agg(F.min_by(F.struct(*ESTIMATE), F.struct(determinant, "start")).alias("b")).select("gid", "b.*"), "outlier-estimates")
    release(now)
    return best


def judge(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: list[str] | None = None, least: int = 100, share: float = 0.75, most: float = 4.5) -> DataFrame:
    """Adds BASE, base_failed, distance and kept to ``df`` (or its columns ``keep``).

    Documents that fail the base rules are rejected and take no part in the estimates. Of the others those farther
    than ``most`` from their group's centre are rejected, in standard deviations of normal
    coordinates: few of 1000 normal vectors are. A pair of language and source with fewer than ``least`` such documents shares a group, see ``groups``; in a rest that is
    still smaller none is an outlier (distance null). Null texts are empty and fail, null languages and sources are values like others,
    repeated rows count each and have one fate, columns named like a result are replaced; an empty table gives no rows.
    """
    results = [*BASE, "base_failed", "distance", "kept"]
    stay = [c for c in df.columns if c not in results and (keep is None or c in keep)]
    own = [F.col(f"`{c}`").alias(f"own_{k}") for k, c in enumerate(stay)]
    counted = df.select(*own, F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{source_col}`").cast("string").alias("source"), F.inline(F.array(counts(F.col(f"`{text_col}`")))))  # a generator: the struct is made once for all its fields
    light = stored(counted.withColumn("base_failed", base_failed()), "outlier-light")
    passed = light.filter("NOT base_failed")
    named = stored(groups(passed, least), "outlier-groups")
    member = lambda d: d.alias("d").join(small(named).alias("g"), F.col("d.lang").eqNullSafe(F.col("g.lang")) & F.col("d.source").eqNullSafe(F.col("g.source")), "left").select("d.*", "g.gid")
    rows = stored(member(passed).filter("gid IS NOT NULL").select("gid", *vector()), "outlier-rows")
    found = estimates(rows, share)
    release(rows)
    near = _distance(member(light).withColumn("gid", F.when(~F.col("base_failed"), F.col("gid"))).select("*", *vector()).join(small(found), "gid", "left"))
    out = near.withColumn("distance", F.col("d") * F.lit(SHORT**0.5))
    return out.select(*[F.col(f"own_{k}").alias(c) for k, c in enumerate(stay)], *BASE, "base_failed", "distance", (~F.col("base_failed") & F.coalesce(F.col("distance") <= most, F.lit(True))).alias("kept"))
