"""Queries of sources with their policies, optimizers, decompositions, order-dependent learners, text functions and streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import arrays, random, text
from ..functions.random import draw_sql
from ..operators import blocks, linalg, rl, sketches, split, symbolic
from ..operators.augment import augment
from ..operators.frame import dimension
from ..operators.models import components
from ..operators.optim import Optimizer, solve_linear, solve_quadratic
from ..operators.stats import zscore
from ..sources import readers
from ..streaming import streams
from .feature_queries import E
from .registry import embeddings, parts, pulls, query, r, table
from .relational_queries import _drained, _event_stream, _scratch


def _csv(df, **options) -> str:
    path = _scratch(df.sparkSession)
    df.write.options(header=True, **options).csv(path)
    return path


@query("SELECT c_custkey, c_name, NULL::INT AS absent FROM customer")
def csv_header_policies(spark, sf_dir):
    """Columns by name in another order, one that wasn't asked for, one that is missing."""
    path = _csv(table(spark, sf_dir, "customer").select("c_nationkey", "c_name", "c_custkey"))
    return readers.read_csv(spark, path, {"c_custkey": "long", "c_name": "string", "absent": "int"}, ignore_missing=True).select("c_custkey", "c_name", "absent")


@query("""SELECT c_custkey, 'a "' || c_name || '", b' AS remark FROM customer""")
def csv_quotes(spark, sf_dir):
    quoted = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit('a "'), "c_name", F.lit('", b')).alias("remark"))
    return readers.read_csv(spark, _csv(quoted, quote='"', escape='"'), {"c_custkey": "long", "remark": "string"}, quote='"')


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'")
def csv_comments(spark, sf_dir):
    """Lines that begin with the comment sign are passed over; here those of finished orders."""
    mark = F.when(F.col("o_orderstatus") == "F", F.lit("#")).otherwise(F.lit(""))
    path = _csv(table(spark, sf_dir, "orders").select(F.concat(mark, F.col("o_orderkey").cast("string")).alias("o_orderkey"), "o_orderstatus"), comment="~")  # or the sign would be quoted
    return readers.read_csv(spark, path, {"o_orderkey": "long", "o_orderstatus": "string"}, comment="#")


def _overflow(name, policy, sql):
    def run(spark, sf_dir):
        path = _csv(table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 997 - 40_000).alias("n")))
        return readers.read_csv(spark, path, {"p_partkey": "long", "n": "smallint"}, overflow=policy).select("p_partkey", F.col("n").cast("int").alias("n"))

    run.__name__ = name
    query(f"SELECT p_partkey, ({sql})::INT AS n FROM (SELECT p_partkey, p_partkey * 997 - 40000 AS n FROM part)")(run)


_overflow("csv_overflow_clamp", "clamp", "greatest(-32768, least(32767, n))")
_overflow("csv_overflow_null", "null", "CASE WHEN n BETWEEN -32768 AND 32767 THEN n END")


@query("SELECT p_partkey, round(p_retailprice, 2) AS price FROM part")
def csv_decimal_comma(spark, sf_dir):
    comma = F.replace(F.format_string("%.2f", F.col("p_retailprice").cast("double")), F.lit("."), F.lit(","))
    path = _csv(table(spark, sf_dir, "part").select("p_partkey", comma.alias("price")), quote='"')
    return readers.read_csv(spark, path, {"p_partkey": "long", "price": "double"}, quote='"', decimal_comma=True).select("p_partkey", F.round("price", 2).alias("price"))


@query("SELECT n_name AS line, length(n_name) AS n FROM nation WHERE n_regionkey <> 0")
def line_reader(spark, sf_dir):
    """Lines without carriage returns, comment lines and empty ones, of 64 characters at most."""
    path, name = _scratch(spark), F.col("n_name")
    line = F.when(F.col("n_regionkey") == 0, F.concat(F.lit("  // "), name)).otherwise(F.concat(name, F.lit("\r")))
    table(spark, sf_dir, "nation").select(F.explode(F.array(line, F.lit(" \r"))).alias("value")).write.text(path)
    lines = readers.read_lines(spark, path, single_comment="//", skip_empty=True, longest=64)
    return lines.select(F.col("value").alias("line"), F.length("value").cast("long").alias("n"))


@query("SELECT p_partkey AS row_id, round((p_size::FLOAT / 10)::FLOAT::DOUBLE, 5) AS sepal, round((p_retailprice / 1000)::FLOAT::DOUBLE, 4) AS petal, ['Iris-setosa', 'Iris-versicolor', 'Iris-virginica'][(p_partkey % 3 + 1)::INT] AS species, (p_partkey % 3)::INT AS y FROM part")
def iris_load(spark, sf_dir):
    """An Iris table made of parts: ids from 1, features as 32-bit floats, classes by name."""
    kinds = F.array(*[F.lit(f"Iris-{s}") for s in ("setosa", "versicolor", "virginica")])
    size, price = F.col("p_size").cast("double") / 10, F.col("p_retailprice").cast("double") / 1000
    flowers = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("Id"), size.alias("SepalLengthCm"), size.alias("SepalWidthCm"), price.alias("PetalLengthCm"), price.alias("PetalWidthCm"), F.element_at(kinds, (F.col("p_partkey") % 3 + 1).cast("int")).alias("Species"))
    df = readers.iris(spark, _csv(flowers))
    return df.select("row_id", F.round(F.col("x")[0], 5).alias("sepal"), F.round(F.col("x")[3], 4).alias("petal"), "species", F.col("y").cast("int").alias("y"))


@query("""SELECT 'no "' || p_partkey || '", live' AS name, p_type AS artists, round((p_size / 50.0)::FLOAT::DOUBLE, 4) AS valence, round((p_retailprice / 2000)::FLOAT::DOUBLE, 4) AS speechiness FROM part""")
def tracks_load(spark, sf_dir):
    """A track table made of parts: quoted names with commas, columns in any order."""
    share, price = F.col("p_size").cast("double") / 50, F.col("p_retailprice").cast("double") / 2000
    columns = ["speechiness", "liveness", "instrumentalness", "energy", "danceability", "acousticness"]
    songs = table(spark, sf_dir, "part").select(F.concat(F.lit('no "'), F.col("p_partkey").cast("string"), F.lit('", live')).alias("name"), *[price.alias(c) for c in columns], F.lit(1999).alias("year"), share.alias("valence"), F.col("p_type").alias("artists"))
    df = readers.tracks(spark, _csv(songs, quote='"', escape='"'), limit=1 << 30)
    return df.select("name", "artists", F.round(F.col("x")[0], 4).alias("valence"), F.round(F.col("x")[6], 4).alias("speechiness"))


@query("WITH g AS (SELECT unnest(generate_series(0, 99)) AS k), p AS (SELECT k, -1 + (k // 10) * (2.0::DOUBLE / 9) AS a, -1 + (k % 10) * (2.0::DOUBLE / 9) AS b FROM g) SELECT k AS row_id, round(a, 6) + 0.0 AS a, round(b, 6) + 0.0 AS b, round(a * b, 6) + 0.0 AS ab, CASE WHEN (a > 0) <> (b > 0) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM p")
def cross_feature(spark, sf_dir):
    return readers.xor_grid(spark, 10, cross=True).select("row_id", *[r(F.col("x")[k]).alias(n) for k, n in enumerate(("a", "b", "ab"))], "y")


@query("SELECT p_partkey, upper(p_type) AS kind, (CASE lower(upper(p_type)) WHEN 'small' THEN 0 WHEN 'large' THEN 1 END)::INT AS code, p_type AS trimmed FROM part")
def codes_and_trim(spark, sf_dir):
    padded = F.concat(F.lit(" \t"), F.col("p_type"), F.lit("\t \r"))
    return table(spark, sf_dir, "part").select("p_partkey", F.upper("p_type").alias("kind"), text.enum_code(F.upper("p_type"), ["Small", "LARGE"]).cast("int").alias("code"), text.trim_blanks(padded).alias("trimmed"))


@query("SELECT event_id, date_trunc('hour', ts) AS hour, year(ts)::INT AS year, regexp_replace(event_type, '[aeiou]', '_', 'g') AS masked, regexp_matches(event_type, '^p') AS is_p, (event_id & 12)::BIGINT AS low_bits, xor(event_id, 5)::BIGINT AS flipped, md5(event_type) AS digest, {'k': event_type}['k'] AS from_map FROM events")
def native_functions(spark, sf_dir):
    """Dates, regular expressions, bits, hashes and maps."""
    kind, n = F.col("event_type"), F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), F.year("ts").alias("year"), F.regexp_replace(kind, "[aeiou]", "_").alias("masked"), kind.rlike("^p").alias("is_p"),
        n.bitwiseAND(12).cast("long").alias("low_bits"), n.bitwiseXOR(5).cast("long").alias("flipped"), F.md5(kind.cast("binary")).alias("digest"), F.create_map(F.lit("k"), kind)["k"].alias("from_map"),
    )


@query(E + " SELECT max(len(x))::INT AS d, count(*) AS n, count(DISTINCT len(x)) AS lengths FROM e")
def validation(spark, sf_dir):
    """The common length of all vectors, which `dimension` returns only if there is one."""
    e = embeddings(spark, sf_dir)
    return e.agg(F.lit(dimension(e)).cast("int").alias("d"), F.count(F.lit(1)).alias("n"), F.count_distinct(F.size("x")).alias("lengths"))


@query("SELECT p_partkey AS row_id, p_size::DOUBLE AS size FROM part")
def augment_none(spark, sf_dir):
    return augment(parts(spark, sf_dir), "none").select("row_id", F.col("x")[0].alias("size"))


GRAM = "WITH b AS (SELECT p_size::DOUBLE / 50 AS u, p_retailprice / 1000 AS v FROM part), g AS (SELECT sum(u * u) / count(*) AS uu, sum(u * v) / count(*) AS uv, sum(v * v) / count(*) AS vv FROM b) "


def _gram(spark, sf_dir) -> np.ndarray:
    df = parts(spark, sf_dir).select(F.array(F.col("x")[0] / 50, F.col("x")[1] / 1000).alias("x"))
    return linalg.collect_small(linalg.gramian(df), 2, 2) / df.count()


@query(GRAM + "SELECT 0 AS i, 0 AS j, round(uu, 6) AS v FROM g UNION ALL SELECT 0, 1, round(uv, 6) FROM g UNION ALL SELECT 1, 0, round(uv, 6) FROM g UNION ALL SELECT 1, 1, round(vv, 6) FROM g")
def qr_product(spark, sf_dir):
    """Q R of a Gram matrix is the matrix; Q is orthogonal, R upper triangular, or nothing comes back."""
    q, upper = linalg.householder_qr(_gram(spark, sf_dir))
    right = np.allclose(q.T @ q, np.eye(2)) and np.allclose(upper, np.triu(upper))
    return spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(q @ upper) for j, v in enumerate(row) if right], "i int, j int, v double").select("i", "j", r(F.col("v")).alias("v"))


@query(GRAM + "SELECT round((uu + vv) / 2 + sqrt(pow((uu - vv) / 2, 2) + uv * uv), 6) AS first, round((uu + vv) / 2 - sqrt(pow((uu - vv) / 2, 2) + uv * uv), 6) AS second, round(2 * abs(uv), 6) AS off_diagonal FROM g")
def qr_eigenvalues(spark, sf_dir):
    a = _gram(spark, sf_dir)
    values, _ = linalg.eigen_by_qr(a)
    return spark.createDataFrame([(float(values[0]), float(values[1]), float(abs(a).sum() - abs(np.diag(a)).sum()))], "first double, second double, off_diagonal double").select(*[r(F.col(c)).alias(c) for c in ("first", "second", "off_diagonal")])


TWO = "WITH z AS (SELECT avg(p_size::DOUBLE) AS m, stddev_pop(p_size::DOUBLE) AS s, avg(p_retailprice) AS my, stddev_pop(p_retailprice) AS sy FROM part), p AS (SELECT p_partkey, (p_size - m) / (s + 1e-8) AS u, (p_retailprice - my) / (sy + 1e-8) AS v FROM part, z), c AS (SELECT sum(u * u) / (count(*) - 1) AS a, sum(u * v) / (count(*) - 1) AS b, sum(v * v) / (count(*) - 1) AS d FROM p), l AS (SELECT (a + d) / 2 + sqrt(pow((a - d) / 2, 2) + b * b) AS l1, (a + d) / 2 - sqrt(pow((a - d) / 2, 2) + b * b) AS l2, a, b FROM c) "


@query(TWO + "SELECT round(l1, 5) AS first, round(l2, 5) AS second, round(l1 / (l1 + l2), 5) AS share FROM l")
def pca_two_variances(spark, sf_dir):
    _, values = components.fit_pca(zscore(parts(spark, sf_dir).select("row_id", "x"), 2), 2)
    return spark.createDataFrame([(float(values[0]), float(values[1]), float(values[0] / values.sum()))], "first double, second double, share double").select(*[r(F.col(c), 5).alias(c) for c in ("first", "second", "share")])


@query(TWO + "SELECT p_partkey AS row_id, round(abs(u * b + v * (l1 - a)) / sqrt(b * b + (l1 - a) * (l1 - a)), 3) AS first FROM p, l")
def pca_two_projection(spark, sf_dir):
    """Coordinates on the first component, without their sign, which is arbitrary."""
    df = zscore(parts(spark, sf_dir).select("row_id", "x"), 2)
    basis, _ = components.fit_pca(df, 1)
    return components.project(df, basis).select("row_id", r(F.abs(F.col("x")[0]), 3).alias("first"))


RATES = {"gd": 0.05, "sgd": 0.05, "adagrad": 0.8, "rmsprop": 0.05, "adam": 0.1, "adamw": 0.1}
_g = "2 * (x - c)"
STEPS = {
    "gd": (f"x - 0.05 * {_g}", "m", "v"),
    "sgd": (f"x - 0.05 * {_g}", "m", "v"),
    "adagrad": (f"x - 0.8 * {_g} / (sqrt(v + pow({_g}, 2)) + 1e-8)", "m", f"v + pow({_g}, 2)"),
    "rmsprop": (f"x - 0.05 * {_g} / (sqrt(0.99 * v + 0.01 * pow({_g}, 2)) + 1e-8)", "m", f"0.99 * v + 0.01 * pow({_g}, 2)"),
    "adam": (f"x - 0.1 * ((0.9 * m + 0.1 * {_g}) / (1 - pow(0.9, k + 1))) / (sqrt((0.999 * v + 0.001 * pow({_g}, 2)) / (1 - pow(0.999, k + 1))) + 1e-8)", f"0.9 * m + 0.1 * {_g}", f"0.999 * v + 0.001 * pow({_g}, 2)"),
    "adamw": (f"x * (1 - 0.1 * 0.01) - 0.1 * ((0.9 * m + 0.1 * {_g}) / (1 - pow(0.9, k + 1))) / (sqrt((0.999 * v + 0.001 * pow({_g}, 2)) / (1 - pow(0.999, k + 1))) + 1e-8)", f"0.9 * m + 0.1 * {_g}", f"0.999 * v + 0.001 * pow({_g}, 2)"),
}


def _optimizer(kind):
    def run(spark, sf_dir):
        """40 steps from 0 towards the mean of a column: the slope of the mean squared distance is one aggregate a run."""
        centre, opt, x, found = float(table(spark, sf_dir, "part").agg(F.avg(F.col("p_size") / 10)).first()[0]), Optimizer(kind, RATES[kind]), np.zeros(1), []
        for k in range(40):
            x = opt.step(x, 2 * (x - centre))
            found.append((k + 1, float(x[0])))
        return spark.createDataFrame(found, "step int, x double").select("step", r(F.col("x")).alias("x"))

    run.__name__ = f"optimizer_{kind}"
    x, m, v = STEPS[kind]
    query(f"WITH RECURSIVE a AS (SELECT avg(p_size / 10.0::DOUBLE) AS c FROM part), t AS (SELECT 0 AS k, 0.0::DOUBLE AS x, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v UNION ALL SELECT k + 1, {x}, {m}, {v} FROM t, a WHERE k < 40) SELECT k AS step, round(x, 6) + 0.0 AS x FROM t WHERE k > 0")(run)


for _kind in STEPS:
    _optimizer(_kind)


@query("WITH s AS (SELECT avg(p_size::DOUBLE) / 10 AS top, count(*) / 1000.0::DOUBLE + 1 AS wide, avg(p_retailprice) / 500 AS all_ FROM part), x AS (SELECT top, wide, all_, least(top, all_) AS x0 FROM s) SELECT round(x0, 6) AS x0, round(least(wide, all_ - x0), 6) + 0.0 AS x1, round(3 * x0 + 2 * least(wide, all_ - x0), 6) AS objective, true AS optimal FROM x")
def linear_program_of_parts(spark, sf_dir):
    """3 x0 + 2 x1 under x0 + x1 <= all, x0 <= top, x1 <= wide, all of the table: the dearer one is filled first."""
    top, wide, everything = map(float, table(spark, sf_dir, "part").agg(F.avg("p_size") / 10, F.count(F.lit(1)) / 1000 + 1, F.avg(F.col("p_retailprice").cast("double")) / 500).first())
    s = solve_linear([3, 2], [[1, 1], [1, 0], [0, 1]], [everything, top, wide])
    return spark.createDataFrame([(*map(float, s.solution), s.objective, s.optimal)], "x0 double, x1 double, objective double, optimal boolean").select(*[r(F.col(c)).alias(c) for c in ("x0", "x1", "objective")], "optimal")


@query("WITH s AS (SELECT avg(p_size::DOUBLE) / 60 AS a, avg(p_retailprice) / 4000 AS b FROM part), x AS (SELECT greatest(0, least(1, (1 + a - b) / 2)) AS x0 FROM s) SELECT round(x0, 3) AS x0, round(1 - x0, 3) AS x1, true AS converged FROM x")
def quadratic_program_of_parts(spark, sf_dir):
    """The point of the unit segment nearest to one made of the table."""
    a, b = map(float, table(spark, sf_dir, "part").agg(F.avg("p_size") / 60, F.avg(F.col("p_retailprice").cast("double")) / 4000).first())
    s = solve_quadratic(np.diag([2.0, 2.0]), [-2 * a, -2 * b], [0, 0], [1, 1], [1, 1], 1.0)
    return spark.createDataFrame([(*map(float, s.solution), bool(s.converged))], "x0 double, x1 double, converged boolean").select(r(F.col("x0"), 3).alias("x0"), r(F.col("x1"), 3).alias("x1"), "converged")


@query("WITH g AS (SELECT unnest(generate_series(0, 999)) AS k), c AS (SELECT k AS row_id, CASE WHEN k % 2 = 1 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS far, 2 * pi() * (k // 2) / 500 AS angle FROM g) SELECT row_id, round(far * cos(angle), 6) + 0.0 AS a, round(far * sin(angle), 6) + 0.0 AS b, CASE WHEN far > 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y FROM c")
def circle_points(spark, sf_dir):
    return readers.circles(spark).select("row_id", r(F.col("x")[0]).alias("a"), r(F.col("x")[1]).alias("b"), "y")


@query("SELECT least(64, count(*)) AS without, least(64, count(*)) AS different, 64::BIGINT AS with_replacement FROM part")
def minibatches(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey")
    one, other = split.minibatch(df, 64, "p_partkey", 3), split.minibatch(df, 64, "p_partkey", 3, replacement=True)
    return spark.createDataFrame([(one.count(), one.distinct().count(), other.count())], "without long, different long, with_replacement long")


@query("SELECT p_partkey, round((p_size / 10.0::DOUBLE + 2) * 3, 6) AS value, ['s'] AS names FROM part")
def expr_substitute(spark, sf_dir):
    """A bound variable is gone; those that are left are named once, in order."""
    e = ((symbolic.var("s") + symbolic.var("t")) * symbolic.var("k")).substitute(t=2.0, k=3.0).simplify()
    base = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size").cast("double") / 10).alias("s"))
    return base.select("p_partkey", r(e.column()).alias("value"), F.array(*[F.lit(n) for n in e.variables()]).alias("names"))


@query("SELECT start, count(*) AS n, round(sum(value), 3) AS total FROM (SELECT unnest([time_bucket(INTERVAL 1 DAY, ts), time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 1 DAY]) AS start, value FROM events) GROUP BY 1")
def sliding_windows(spark, sf_dir):
    return streams.sliding(table(spark, sf_dir, "events"), "ts", "value", "2 days", "1 day").select("start", "n", F.round("total", 3).alias("total"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_deduplicated(spark, sf_dir):
    """Within a watermark longer than the log all repeats go."""
    found = streams.deduplicated(_event_stream(spark, sf_dir), "ts", ["user_id", "event_type"], "10000 days").select("user_id", "event_type")
    return _drained(spark, found, "append").drop("batch")


@query("SELECT event_type AS arm, count(*)::INT AS held, round(avg(value) + 1e-9, 5) AS mean FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC, value DESC) <= 200) GROUP BY 1")
def stream_recent(spark, sf_dir):
    """Each arm's last 200 rewards, kept as a stream's state."""
    log = _event_stream(spark, sf_dir).select(F.col("event_type").alias("arm"), F.col("event_id").alias("t"), F.col("value").cast("double").alias("reward"))
    out = _drained(spark, streams.streaming_recent(log, 200), "update", True)
    return out.groupBy("arm").agg(F.max_by(F.struct("held", "mean"), F.struct("last", "batch")).alias("s")).select("arm", "s.held", r(F.col("s.mean") + 1e-9, 5).alias("mean"))


@query("SELECT arm, t, place FROM (SELECT event_type AS arm, event_id AS t, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS place FROM events) WHERE place <= 5")
def best_pulls(spark, sf_dir):
    """The five best pulls of each arm: only the best of each task are shuffled."""
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("arm").orderBy(F.desc("reward"), "t"))
    return pulls(spark, sf_dir).withColumn("place", place.cast("long")).filter("place <= 5").select("arm", "t", "place")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN -1.5::DOUBLE ELSE p_size::DOUBLE END AS a, CASE WHEN p_partkey % 2 = 1 THEN -1.5::DOUBLE ELSE p_retailprice::DOUBLE END AS b FROM part")
def element_update(spark, sf_dir):
    """One element of each row is set, its place from the row."""
    x = arrays.put(F.col("x"), (F.col("row_id") % 2).cast("int"), -1.5)
    return parts(spark, sf_dir).select(F.col("row_id").alias("p_partkey"), x[0].alias("a"), x[1].alias("b"))


@query("WITH e AS (SELECT label, embedding::DOUBLE[] AS x, list_transform(embedding::DOUBLE[], lambda v: exp(v - list_max(embedding)::DOUBLE)) AS e FROM embeddings), p AS (SELECT label, x, list_transform(e, lambda v: v / (list_sum(e) + 1e-10)) AS p FROM e) SELECT label, round(avg((x[1] - x[2]) * ln(greatest(p[label + 1], 1e-8))), 6) + 0.0 AS policy_loss, round(avg(pow(x[1] - x[2], 2)), 6) AS critic_loss, round(avg(-list_sum(list_transform(p, lambda v: v * ln(v)))), 6) AS entropy, count(*) AS steps FROM p GROUP BY label")
def policy_losses(spark, sf_dir):
    """Softmax policies over 64 actions; the value is a row's first feature, the target its second, the action its label."""
    steps = embeddings(spark, sf_dir).select(F.col("y").cast("int").alias("action"), arrays.softmax(F.col("x")).alias("p"), F.col("x")[0].alias("value"), F.col("x")[1].alias("target"))
    losses = rl.policy_losses(steps.withColumn("label", F.col("action").cast("long")).groupBy("label"))
    return losses.select("label", *[r(F.col(c)).alias(c) for c in ("policy_loss", "critic_loss", "entropy")], "steps")


@query("WITH l AS (SELECT unnest([[0,1,2],[3,4,5],[6,7,8],[0,3,6],[1,4,7],[2,5,8],[0,4,8],[2,4,6]]) AS line), b AS (SELECT p_partkey, p_size % 9 AS cell, [p_partkey // (3 ** i)::BIGINT % 3 for i in range(9)] AS board FROM part), q AS (SELECT p_partkey, cell, list_transform(line, lambda i: CASE WHEN i = cell THEN 2 ELSE board[i + 1] END) AS theirs, list_transform(line, lambda i: CASE WHEN i = cell THEN 1 ELSE board[i + 1] END) AS ours, list_contains(line, cell) AS through FROM b, l) SELECT p_partkey, round(CASE WHEN bool_or(theirs = [2, 2, 2]) THEN 3 ELSE 0 END + CASE WHEN cell = 4 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN cell IN (0, 2, 6, 8) THEN 0.15::DOUBLE ELSE 0 END + sum(CASE WHEN through AND NOT list_contains(ours, 2) THEN 0.05::DOUBLE / 3 * len(list_filter(ours, lambda v: v = 1)) ELSE 0 END), 6) AS quality FROM q GROUP BY p_partkey, cell")
def move_quality(spark, sf_dir):
    """The first player's move on a board whose cells are the key's digits to base 3."""
    key, board = F.col("p_partkey"), F.array(*[(F.floor(F.col("p_partkey") / 3**i) % 3).cast("int") for i in range(9)])
    return table(spark, sf_dir, "part").withColumn("board", board).select(key, r(rl.move_quality(F.col("board"), F.col("p_size") % 9, 1, 3)).alias("quality"))


@query("WITH x AS (SELECT vec_id AS i, unnest(generate_series(1, 64)) AS j, embedding FROM embeddings), y AS (SELECT unnest(generate_series(0, 4095)) AS c) SELECT i, c % 64 AS j, round(sum(embedding[j]::DOUBLE * ((j * 5 - 5 + c % 64 * 3) % 11 - 5)), 6) + 0.0 AS v FROM x JOIN y ON j - 1 = c // 64 GROUP BY 1, 2")
def matmul_blocks(spark, sf_dir):
    """All embeddings, as a long matrix, times a 64 x 64 one, by blocks."""
    cells = embeddings(spark, sf_dir).select(F.col("row_id").alias("i"), F.posexplode("x").alias("j", "v"))
    c = F.col("id")
    right = spark.range(4096).select(F.floor(c / 64).alias("i"), (c % 64).alias("j"), ((F.floor(c / 64) * 5 + c % 64 * 3) % 11 - 5).cast("double").alias("v"))
    return blocks.block_matmul(cells, right).select("i", "j", r(F.col("v")).alias("v"))


@query("WITH x AS (SELECT vec_id, unnest(generate_series(1, 64)) AS i, embedding AS e FROM embeddings) SELECT i - 1 AS i, j - 1 AS j, round(sum(e[i]::DOUBLE * e[j]::DOUBLE), 6) + 0.0 AS v FROM x, (SELECT unnest(generate_series(1, 64)) AS j) GROUP BY 1, 2")
def gram_by_blocks(spark, sf_dir):
    """The embeddings' transpose times themselves: a small product of a long inner index, cut into slabs."""
    cells = embeddings(spark, sf_dir).select(F.col("row_id").alias("i"), F.posexplode("x").alias("j", "v"))
    return blocks.block_matmul(cells.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), cells).select("i", "j", r(F.col("v")).alias("v"))


@query("WITH x AS (SELECT vec_id, unnest(generate_series(1, 64)) AS i, embedding AS e FROM embeddings) SELECT (i - 1)::INT AS i, (j - 1)::INT AS j, round(sum(e[i]::DOUBLE * e[j]::DOUBLE), 5) + 0.0 AS v, true AS orthogonal FROM x, (SELECT unnest(generate_series(1, 64)) AS j) GROUP BY 1, 2")
def qr_tall(spark, sf_dir):
    """QR of all embeddings by a tree: R'R is the Gram matrix, and the rows of Q together are orthogonal."""
    q, upper = blocks.tall_qr(embeddings(spark, sf_dir).select("row_id", "x"))
    off = linalg.gramian(q).agg(F.max(F.abs(F.col("v") - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))).alias("off"))
    cells = spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(upper.T @ upper) for j, v in enumerate(row)], "i int, j int, v double")
    return cells.crossJoin(off).select("i", "j", r(F.col("v"), 5).alias("v"), (F.col("off") < 1e-9).alias("orthogonal"))


@query("SELECT event_type, count(*) AS n, true AS distinct_within, true AS quantiles_within, true AS top_within, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def sketches_by_day(spark, sf_dir):
    """Sketches of each type and day, stored, then merged by type: estimates within their bounds of the exact figures, which are computed beside them."""
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    path = _scratch(spark)
    sketches.sketched(events, ["event_type", "day"], "user_id", "value", "user_id").write.parquet(path)
    found = sketches.read(sketches.merged(spark.read.parquet(path), ["event_type"]), [0.1, 0.5, 0.9], 1)
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))
    below = events.join(found.select("event_type", "quantiles"), "event_type").groupBy("event_type").agg(F.array(*(F.avg((F.col("value") <= F.col("quantiles")[k]).cast("double")) for k in range(3))).alias("ranks"))
    often = events.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("c")).groupBy("event_type").agg(F.max("c").alias("most"))
    near = [F.abs(F.col("ranks")[k] - q) <= sketches.RANK_ERROR + 0.01 for k, q in enumerate((0.1, 0.5, 0.9))]
    # a count of a heavy hitter is off by 3.5 * n / items at most; where none is listed (no item stands out of that error), the most frequent has no more
    top = F.abs(F.coalesce(F.get("top", F.lit(0))["count"], F.lit(0)) - F.col("most")) <= F.greatest(F.lit(1.0), F.col("n") * 3.5 / sketches.MAX_ITEMS)
    joined = found.join(exact, "event_type").join(below, "event_type").join(often, "event_type")
    return joined.select("event_type", "n", (F.abs(F.col("distinct") - F.col("users")) <= F.col("users") * sketches.DISTINCT_ERROR).alias("distinct_within"), (near[0] & near[1] & near[2]).alias("quantiles_within"), top.alias("top_within"), "users")


_DRAWN = {k: draw_sql("p_partkey", 7, k) for k in range(4)}


@query(f"WITH d AS (SELECT p_partkey, {_DRAWN[0]} AS drawn, ({_DRAWN[1]} + 0.5::DOUBLE) / 2147483647 AS u, ({_DRAWN[2]} + 0.5::DOUBLE) / 2147483647 AS a, ({_DRAWN[3]} + 0.5::DOUBLE) / 2147483647 AS b FROM part) SELECT p_partkey, drawn, round(sqrt(-2 * ln(a)) * cos(2 * pi() * b), 6) + 0.0 AS gauss, CASE WHEN u < 0.5 THEN 0 WHEN u < 0.75 THEN 2 ELSE 3 END AS side FROM d")
def random_numbers(spark, sf_dir):
    """Three draws for each part, by its key alone."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(key, random.draw(key, 7).alias("drawn"), r(random.normal(key, 7, 1)).alias("gauss"), random.discrete(key, [2.0, 0.0, 1.0, 1.0], 7, 1).alias("side"))
