"""Queries over linear models that fit every row, with oracles by normal equations.

The oracles solve small systems by determinants, written out for the number of features at hand.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from vitalframe.operators import gaussian as P
from vitalframe.operators import gram as G
from vitalframe.operators import loso as L
from vitalframe.operators import trees as T
from vitalframe.plans.catalog import register
from vitalframe.plans.roles import table

FEATURES = ["f1", "f2", "f3", "f4"]


def studied(s, d):
    """All orders that have lines, with features of these; a customer is a participant, the status a session."""
    li = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.avg("l_quantity").alias("f1"), F.avg("l_discount").alias("f2"), F.sum("l_extendedprice").alias("f3"), F.avg("l_tax").alias("f4"))
    return table(s, d, "orders").join(li, "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus", (50 * F.ln("o_totalprice")).alias("glc"), *FEATURES, (F.col("o_custkey") % 5).alias("part"), (F.floor(F.col("o_custkey") / 5) % 3).alias("inner"))


STUDIED = """
l AS (SELECT l_orderkey AS k, avg(l_quantity) AS x1, avg(l_discount) AS x2, sum(l_extendedprice) AS x3, avg(l_tax) AS x4 FROM lineitem GROUP BY 1),
d AS (SELECT o_custkey AS who, o_orderkey, o_orderstatus AS session, 50 * ln(o_totalprice::DOUBLE) AS y, x1::DOUBLE AS x1, x2::DOUBLE AS x2, x3::DOUBLE AS x3, x4::DOUBLE AS x4, o_custkey % 5 AS part, (o_custkey // 5) % 3 AS inn FROM orders JOIN l ON o_orderkey = k)"""
ALPHA = "a(alpha) AS (VALUES (0.01::DOUBLE), (0.1::DOUBLE), (1::DOUBLE), (10::DOUBLE), (100::DOUBLE))"


def _names(p: int) -> list[str]:
    v = [*map(str, range(1, p + 1)), "y"]
    return ["n", *[f"s{i}" for i in v], *[f"q{i}_{j}" for k, i in enumerate(v) for j in v[k:]]]


def _sums(p: int) -> str:
    """Counts, sums and sums of products of x1..xp and y, in doubles."""
    v = [*[f"x{i}" for i in range(1, p + 1)], "y"]
    of = lambda e: f"sum({e})"
    return ", ".join(f"{e} AS {n}" for e, n in zip(["count(*)::DOUBLE", *map(of, v), *[of(f"{a} * {b}") for k, a in enumerate(v) for b in v[k:]]], _names(p)))


def _less(p: int, a: str, b: str) -> str:
    return ", ".join(f"{a}.{n} - coalesce({b}.{n}, 0) AS {n}" for n in _names(p))


def _det(m: list[list[str]]) -> str:
    if len(m) == 1:
        return m[0][0]
    terms = [f"{'-' if k % 2 else '+'} ({e}) * ({_det([row[:k] + row[k + 1 :] for row in m[1:]])})" for k, e in enumerate(m[0])]
    return " ".join(terms).lstrip("+ ")


def _scaled(p: int, keys: str, source: str) -> str:
    """Scaled normal equations of a table of sums: c{i}_{j} is X'X, b{i} X'y, d{i} the deviations."""
    c = lambda i, j: f"(q{i}_{j} - s{i} * s{j} / n)"
    d = lambda i: f"sqrt({c(i, i)} / n)"
    r = range(1, p + 1)
    return (f"SELECT {keys}, n, sy, " + ", ".join(f"s{i}, {d(i)} AS d{i}, {c(i, 'y')} / {d(i)} AS b{i}" for i in r) + ", "
            + ", ".join(f"{c(i, j)} / ({d(i)} * {d(j)}) AS c{i}_{j}" for i in r for j in r if i <= j) + f" FROM {source}")


def _solved(of: list[int], alpha: str) -> list[str]:
    """The coefficients on scaled features `of`, by Cramer's rule."""
    entry = lambda i, j: f"c{min(i, j)}_{max(i, j)}" + (f" + {alpha}" if i == j else "")
    whole = [[entry(i, j) for j in of] for i in of]
    return [f"({_det([[f'b{i}' if j == k else e for j, e in enumerate(row)] for i, row in zip(of, whole)])}) / ({_det(whole)})" for k in range(len(of))]


def _ridge(p: int, keys: str, source: str) -> str:
    """w0..wp of ridge on scaled features, from a table of sums with alpha."""
    w = ", ".join(f"({e}) / d{i} AS w{i}" for i, e in enumerate(_solved(list(range(1, p + 1)), "alpha"), 1))
    s = ", ".join(f"s{i}" for i in range(1, p + 1))
    inner = f"SELECT {keys}, n, sy, {s}, {w} FROM ({_scaled(p, keys, source)})"
    return f"SELECT *, (sy - {' - '.join(f'w{i} * s{i}' for i in range(1, p + 1))}) / n AS w0 FROM ({inner})"


def _error(p: int, h: str, of: list[int] | None = None) -> str:
    """The sum of squared errors on the sums of h."""
    of = of or list(range(1, p + 1))
    square = [f"{'' if i == j else '2 * '}w{i} * w{j} * {h}.q{i}_{j}" for i in of for j in of if i <= j]
    return f"({' + '.join([f'w0 * w0 * {h}.n', *[f'2 * w0 * w{i} * {h}.s{i} - 2 * w{i} * {h}.q{i}_y' for i in of], *square])} - 2 * w0 * {h}.sy + {h}.qy_y)"


_NESTED = f"""
WITH {STUDIED}, {ALPHA}, cell AS (SELECT part, inn, {_sums(3)} FROM d GROUP BY 1, 2), fold AS (SELECT part, {_sums(3)} FROM d GROUP BY 1), every AS (SELECT {_sums(3)} FROM d),
train AS (SELECT f.part, {_less(3, "e", "f")} FROM fold f, every e),
held AS (SELECT f.part, i.inn, {", ".join(f"sum(c.{n}) AS {n}" for n in _names(3))} FROM fold f, (SELECT DISTINCT inn FROM cell) i JOIN cell c ON c.inn = i.inn WHERE c.part <> f.part GROUP BY 1, 2),
left_in AS (SELECT h.part, h.inn, alpha, {_less(3, "t", "h")} FROM held h JOIN train t USING (part), a),
tried AS (SELECT m.part, m.alpha, avg(sqrt({_error(3, "h")} / h.n)) AS e FROM ({_ridge(3, "part, inn, alpha", "left_in")}) m JOIN held h USING (part, inn) GROUP BY 1, 2),
best AS (SELECT part, arg_min(alpha, e) AS alpha FROM tried GROUP BY 1),
final AS ({_ridge(3, "part, alpha", "(SELECT * FROM train JOIN best USING (part))")})
SELECT m.part::INT AS part, m.alpha, m.n::BIGINT AS n_train, f.n::BIGINT AS n_test, round(sqrt({_error(3, "f")} / f.n), 4) AS rmse, round(1 - {_error(3, "f")} / (f.qy_y - f.sy * f.sy / f.n), 4) AS r2 FROM final m JOIN fold f USING (part)"""

register("nested_ridge", lambda s, d: G.nested_linear(studied(s, d), "part", "inner", "glc", FEATURES[:3], {"ridge": G.LINEAR["ridge"]}).select(
    F.col("part").cast("int"), F.replace("setting", F.lit("alpha="), F.lit("")).cast("double").alias("alpha"), "n_train", "n_test", F.round("rmse", 4).alias("rmse"), F.round("r2", 4).alias("r2")), _NESTED)

#: Everyone else's sums, the penalty that is best over their parts, and the ridge of it, for each participant of rows d.
_OTHERS = f"""
{ALPHA}, own AS (SELECT who, any_value(part) AS part, {_sums(3)} FROM d GROUP BY 1), parts AS (SELECT part, {_sums(3)} FROM d GROUP BY 1), every AS (SELECT {_sums(3)} FROM d),
rest AS (SELECT o.who, {_less(3, "e", "o")} FROM own o, every e),
held0 AS (SELECT o.who, p.part, {", ".join(f"p.{n} - CASE WHEN o.part = p.part THEN o.{n} ELSE 0 END AS {n}" for n in _names(3))} FROM own o, parts p),
held AS (SELECT * FROM held0 WHERE n > 0.5),
left_in AS (SELECT h.who, h.part, alpha, {_less(3, "r", "h")} FROM held h JOIN rest r USING (who), a),
tried AS (SELECT m.who, m.alpha, avg(sqrt(greatest({_error(3, "h")}, 0) / h.n)) AS e FROM ({_ridge(3, "who, part, alpha", "left_in")}) m JOIN held h USING (who, part) GROUP BY 1, 2),
best AS (SELECT who, arg_min(alpha, e) AS alpha FROM tried GROUP BY 1),
model AS ({_ridge(3, "who, alpha", "(SELECT * FROM rest JOIN best USING (who))")})"""
_METRICS = "round(sqrt(avg((p - y) ** 2)), 4) AS rmse, round(avg(abs(p - y)), 4) AS mae, round(CASE WHEN var_pop(y) > 0 THEN 1 - sum((p - y) ** 2) / (var_pop(y) * count(*)) END, 4) AS r2, round(avg(p - y), 4) AS bias"


def _shown(rows, *keys):
    return rows.select(*keys, F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), F.round("r2", 4).alias("r2"), F.round("bias", 4).alias("bias"))


register("loso_ridge", lambda s, d: _shown(L.loso_regression(studied(s, d), "o_custkey", "part", "glc", FEATURES[:3])[0], "o_custkey", "alpha", "n"), f"""
WITH {STUDIED}, {_OTHERS}
SELECT who AS o_custkey, alpha, count(*) AS n, {_METRICS} FROM (SELECT d.who, alpha, y, w0 + w1 * x1 + w2 * x2 + w3 * x3 AS p FROM d JOIN model USING (who)) GROUP BY 1, 2""")
register("loso_ridge_summary", lambda s, d: L.loso_regression(studied(s, d), "o_custkey", "part", "glc", FEATURES[:3])[1].select(
    "participants", *[F.round(c, 4).alias(c) for c in ("mean_rmse", "std_rmse", "mean_mae", "std_mae", "global_rmse", "global_mae")], F.round("global_r2", 4).alias("global_r2")), f"""
WITH {STUDIED}, {_OTHERS}, p AS (SELECT d.who, y, w0 + w1 * x1 + w2 * x2 + w3 * x3 AS p FROM d JOIN model USING (who)),
e AS (SELECT who, sqrt(avg((p - y) ** 2)) AS rmse, avg(abs(p - y)) AS mae FROM p GROUP BY 1)
SELECT (SELECT count(*) FROM e) AS participants, (SELECT round(avg(rmse), 4) FROM e) AS mean_rmse, (SELECT round(stddev_pop(rmse), 4) FROM e) AS std_rmse, (SELECT round(avg(mae), 4) FROM e) AS mean_mae, (SELECT round(stddev_pop(mae), 4) FROM e) AS std_mae,
round(sqrt(avg((p - y) ** 2)), 4) AS global_rmse, round(avg(abs(p - y)), 4) AS global_mae, round(1 - sum((p - y) ** 2) / (var_pop(y) * count(*)), 4) AS global_r2 FROM p""")

#: The four methods' predictions for second sessions; m has who, w0..w3, and mean and number of the training rows.
_PERSONAL = f"""
pred AS (SELECT t.who, session, y, w0 + w1 * x1 + w2 * x2 + w3 * x3 AS p, m.n AS others, m.sy / m.n AS mean, row_number() OVER (PARTITION BY t.who, session ORDER BY o_orderkey) - 1 AS place FROM held_rows t JOIN model m USING (who)),
one AS (SELECT who, count(*) FILTER (session = 'F') AS n_s1, count(*) FILTER (session = 'O') AS n_s2, avg(y - p) FILTER (session = 'F') AS fix, sum(y) FILTER (session = 'F') AS total FROM pred GROUP BY 1),
two AS (SELECT p.*, n_s1, n_s2, fix, total FROM pred p JOIN one USING (who) WHERE session = 'O' AND n_s1 > 0),
each AS (SELECT who, 'residual_personalization' AS method, n_s1, n_s2, fix AS scalar_correction, y, p + fix AS p FROM two UNION ALL SELECT who, 'baseline_dummy_no_subject_data', n_s1, n_s2, NULL, y, mean FROM two
  UNION ALL SELECT who, 'baseline_dummy_with_s1', n_s1, n_s2, NULL, y, (mean * others + total) / (others + n_s1) FROM two
  UNION ALL SELECT t.who, 'baseline_repeat_s1_glc', n_s1, n_s2, NULL, t.y, f.y FROM two t JOIN pred f ON f.who = t.who AND f.session = 'F' AND f.place = t.place % n_s1)
SELECT who AS o_custkey, method, n_s1, n_s2, round(scalar_correction, 4) AS scalar_correction, {_METRICS} FROM each GROUP BY who, method, n_s1, n_s2, scalar_correction"""
_TWO = STUDIED.replace("ON o_orderkey = k)", "ON o_orderkey = k WHERE o_orderstatus IN ('F', 'O'))")


def _methods(rows):
    return _shown(rows, "o_custkey", "method", "n_s1", "n_s2", F.round("scalar_correction", 4).alias("scalar_correction"))


register("personalised_loso", lambda s, d: _methods(L.loso_personalised(studied(s, d), "o_custkey", "o_orderstatus", "part", "o_orderkey", "glc", FEATURES[:3], "F", "O")),
         f"WITH {_TWO}, {_OTHERS}, held_rows AS (SELECT * FROM d), {_PERSONAL}")


def _pools(s, d):
    """Three quarters of the participants as the training pool, the others as the locked test table."""
    rows = studied(s, d)
    return rows.where("o_custkey % 4 <> 0"), rows.where("o_custkey % 4 = 0")


register("locked_test", lambda s, d: _methods(L.locked_test(*_pools(s, d), "o_custkey", "o_orderstatus", "part", "o_orderkey", "glc", FEATURES[:3], "F", "O")), f"""
WITH {_TWO.replace("d AS (", "all_rows AS (")}, d AS (SELECT * FROM all_rows WHERE who % 4 <> 0), held_rows AS (SELECT * FROM all_rows WHERE who % 4 = 0), {ALPHA},
parts AS (SELECT part, {_sums(3)} FROM d GROUP BY 1), every AS (SELECT {_sums(3)} FROM d), left_in AS (SELECT p.part, alpha, {_less(3, "e", "p")} FROM parts p, every e, a),
tried AS (SELECT m.alpha, avg(sqrt({_error(3, "p")} / p.n)) AS e FROM ({_ridge(3, "part, alpha", "left_in")}) m JOIN parts p USING (part) GROUP BY 1),
best AS (SELECT arg_min(alpha, e) AS alpha FROM tried), fitted AS ({_ridge(3, "alpha", "(SELECT * FROM every, best)")}), model AS (SELECT DISTINCT h.who, f.* FROM held_rows h, fitted f), {_PERSONAL}""")


register("gp_personalised_loso", lambda s, d: _methods(P.loso_process(studied(s, d), "o_custkey", "o_orderstatus", "part", "o_orderkey", "glc", FEATURES[:3], "F", "O")))
register("gp_locked_test", lambda s, d: _methods(P.locked_process(*_pools(s, d), "o_custkey", "o_orderstatus", "part", "o_orderkey", "glc", FEATURES[:3], "F", "O")))


def _chosen_sql() -> str:
    """Backward elimination of four features to two: every subset's coefficients, then the least at each step."""
    size = lambda of: [f"abs({e}) AS z{''.join(map(str, of))}_{k}" for k, e in zip(of, _solved(of, "0"))]
    threes = list(combinations(range(1, 5), 3))
    least = lambda of: " ".join(f"WHEN {' AND '.join(f'z{t}_{k} <= z{t}_{o}' for o in of if o != k)} THEN {k}" for t in ["".join(map(str, of))] for k in reversed(of))
    first = f"CASE {least((1, 2, 3, 4))} END"
    second = "CASE " + " ".join(f"WHEN gone = {(set(range(1, 5)) - set(of)).pop()} THEN CASE {least(of)} END" for of in threes) + " END"
    zs = ", ".join(x for of in [(1, 2, 3, 4), *threes] for x in size(list(of)))
    pairs = list(combinations(range(1, 5), 2))
    w = {of: dict(zip(of, _solved(list(of), "0"))) for of in pairs}
    cases = ", ".join("CASE " + " ".join(f"WHEN pair = '{i}{j}' THEN ({w[i, j][k]}) / d{k}" for i, j in pairs if k in (i, j)) + f" ELSE 0 END AS w{k}" for k in range(1, 5))
    return f"""
WITH {STUDIED}, own AS (SELECT who, {_sums(4)} FROM d GROUP BY 1), every AS (SELECT {_sums(4)} FROM d), rest AS (SELECT o.who, {_less(4, "e", "o")} FROM own o, every e),
eq AS ({_scaled(4, "who", "rest")}), z AS (SELECT *, {zs} FROM eq), g AS (SELECT *, {first} AS gone FROM z), h AS (SELECT *, {second} AS next FROM g),
pair AS (SELECT *, array_to_string(list_filter([1, 2, 3, 4], lambda k: k <> gone AND k <> next), '') AS pair FROM h),
w AS (SELECT *, {cases} FROM pair), m AS (SELECT *, (sy - w1 * s1 - w2 * s2 - w3 * s3 - w4 * s4) / n AS w0 FROM w)
SELECT m.who AS o_custkey, 'f' || pair[1] || ',f' || pair[2] AS chosen, o.n::BIGINT AS n, round(sqrt(greatest({_error(4, "o")}, 0) / o.n), 4) AS rmse FROM m JOIN own o USING (who)"""


register("loso_selection", lambda s, d: L.loso_selection(studied(s, d), "o_custkey", "part", "glc", FEATURES, 2).select("o_custkey", F.array_join("chosen", ",").alias("chosen"), "n", F.round(F.sqrt("mse"), 4).alias("rmse")), _chosen_sql())
register("selection_stability", lambda s, d: L.selection_stability(L.loso_selection(studied(s, d), "o_custkey", "part", "glc", FEATURES, 2)), f"""
WITH c AS ({_chosen_sql()}), f AS (SELECT unnest(string_split(chosen, ',')) AS feature FROM c) SELECT feature, count(*) AS count, count(*)::DOUBLE / (SELECT count(*) FROM c) AS frequency, count(*)::DOUBLE / (SELECT count(*) FROM c) >= 0.5 AS stable FROM f GROUP BY 1""")


def _pls_sql() -> str:
    """Two components of three features by deflation, on correlations scaled to sample deviations."""
    r = (1, 2, 3)
    c = lambda i, j: f"c{min(i, j)}_{max(i, j)}"
    unit = lambda v: f"sqrt({' + '.join(f'{v}{i} * {v}{i}' for i in r)})"
    sign = lambda v: f"sign(CASE WHEN abs({v}1) >= abs({v}2) AND abs({v}1) >= abs({v}3) THEN {v}1 WHEN abs({v}2) >= abs({v}3) THEN {v}2 ELSE {v}3 END)"
    each = lambda f: ", ".join(map(f, r))
    return f"""
WITH {STUDIED}, t AS (SELECT {_sums(3)} FROM d), eq0 AS ({_scaled(3, "1 AS one", "t")}),
eq AS (SELECT n, {each(lambda i: f"s{i} / n AS m{i}, d{i} * sqrt(n / (n - 1)) AS e{i}, b{i} * sqrt((n - 1) / n) AS b{i}")}, {", ".join(f"{c(i, j)} * (n - 1) / n AS {c(i, j)}" for i in r for j in r if i <= j)} FROM eq0),
u1 AS (SELECT *, {each(lambda i: f"{sign('b')} * b{i} / {unit('b')} AS w{i}")} FROM eq),
v1 AS (SELECT *, {" + ".join(f"w{i} * w{j} * {c(i, j)}" for i in r for j in r)} AS tt, {" + ".join(f"w{i} * b{i}" for i in r)} AS ty FROM u1),
l1 AS (SELECT *, {each(lambda i: f"({' + '.join(f'{c(i, j)} * w{j}' for j in r)}) / tt AS p{i}")} FROM v1),
k2 AS (SELECT *, {each(lambda i: f"b{i} - p{i} * ty AS g{i}")} FROM l1),
u2 AS (SELECT *, {each(lambda i: f"{sign('g')} * g{i} / {unit('g')} AS z{i}")} FROM k2),
r2 AS (SELECT *, {each(lambda i: f"z{i} - w{i} * ({' + '.join(f'p{j} * z{j}' for j in r)}) AS r{i}")} FROM u2)
SELECT o_orderkey, round({" + ".join(f"w{i} * (x{i} - m{i}) / e{i}" for i in r)}, 4) AS pls1, round({" + ".join(f"r{i} * (x{i} - m{i}) / e{i}" for i in r)}, 4) AS pls2 FROM d, r2"""


register("pls_scores", lambda s, d: G.pls_scores(studied(s, d), "o_orderkey", "glc", FEATURES[:3]).select("o_orderkey", F.round("pls1", 4).alias("pls1"), F.round("pls2", 4).alias("pls2")), _pls_sql())

TREE = ["l_quantity", "l_discount", "l_tax"]


def _split_sql(level: int) -> str:
    """The best split of each node of a level: sums up to each value of each feature."""
    return f"""
u{level} AS (SELECT node, y, unnest([1, 2, 3]) AS f, unnest([x1, x2, x3]) AS v FROM r{level}),
h{level} AS (SELECT node, f, v, count(*)::DOUBLE AS w, sum(y) AS s FROM u{level} GROUP BY 1, 2, 3),
g{level} AS (SELECT node, f, v, sum(w) OVER p AS lw, sum(s) OVER p AS ls, sum(w) OVER a AS w, sum(s) OVER a AS s FROM h{level} WINDOW p AS (PARTITION BY node, f ORDER BY v), a AS (PARTITION BY node, f)),
b{level} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY ls * ls / lw + (s - ls) * (s - ls) / (w - lw) DESC, f, v) AS n FROM g{level} WHERE w - lw >= 1) WHERE n = 1),
r{level + 1} AS (SELECT r.* EXCLUDE (node), r.node * 2 + (CASE b.f WHEN 1 THEN x1 WHEN 2 THEN x2 ELSE x3 END > b.v)::INT AS node FROM r{level} r JOIN b{level} b ON b.node = r.node)"""


register("regression_tree", lambda s, d: T.tree_table(s, T.fit_tree(table(s, d, "lineitem"), "l_extendedprice", TREE, depth=2), TREE).select(
    "node", "feature", F.round("threshold", 4).alias("threshold"), F.col("n").cast("long").alias("n"), F.round("value", 4).alias("value")), f"""
WITH r0 AS (SELECT l_extendedprice::DOUBLE AS y, l_quantity::DOUBLE AS x1, l_discount::DOUBLE AS x2, l_tax::DOUBLE AS x3, 1 AS node FROM lineitem), {_split_sql(0)}, {_split_sql(1)},
n AS (SELECT node, y FROM r0 UNION ALL SELECT node, y FROM r1 UNION ALL SELECT node, y FROM r2), b AS (SELECT node, f, v FROM b0 UNION ALL SELECT node, f, v FROM b1)
SELECT n.node, ['l_quantity', 'l_discount', 'l_tax'][any_value(b.f)] AS feature, round(any_value(b.v), 4) AS threshold, count(*) AS n, round(avg(y), 4) AS value FROM n LEFT JOIN b ON b.node = n.node GROUP BY n.node""")


def _boosted(s, d):
    """Errors of boosting on all lines after each number of rounds."""
    rows = table(s, d, "lineitem")
    model = T.fit_boosted(rows, "l_extendedprice", TREE, rounds=4, depth=2, rate=0.5)
    x, y = F.array(*[F.col(f).cast("double") for f in TREE]), F.col("l_extendedprice").cast("double")
    error = F.inline(F.array(*[F.struct(F.lit(k).alias("round"), (model.predicted(x, k) - y).alias("e")) for k in range(5)]))
    return rows.select(error).groupBy("round").agg(F.count("e").alias("n"), F.round(F.sqrt(F.avg(F.col("e") * F.col("e"))), 4).alias("rmse"))


def _forest(s, d):
    """Mean prediction and error of a forest per quantity."""
    rows = table(s, d, "lineitem").withColumn("id", F.xxhash64("l_orderkey", "l_linenumber"))
    model = T.fit_forest(rows, "id", "l_extendedprice", TREE, trees=4, depth=3, share=0.7)
    made = model.predict(rows)
    return made.groupBy("l_quantity").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("predicted"), 4).alias("predicted"), F.round(F.sqrt(F.avg((F.col("predicted") - F.col("l_extendedprice")) ** 2)), 4).alias("rmse"))


register("boosted_trees", _boosted)
register("random_forest", _forest)
