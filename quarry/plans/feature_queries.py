"""Queries over feature vectors: algebra, functions, statistics, augmentation, splits."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import arrays, ieee, text
from ..operators import linalg, split, stats
from ..operators.augment import FourierFeatures, augment
from ..operators.frame import to_long, to_wide
from ..operators.models.kernels import kernel_matrix
from .registry import embeddings, lines, parts, pulls, query, r, table

#: Common table expressions of the SQL forms.
E = "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)"
A = E + ", c AS (SELECT vec_id AS i, unnest(generate_series(0, 63)) AS j, unnest(x) AS v FROM e)"
L = "WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, [l_quantity::DOUBLE, l_extendedprice::DOUBLE, l_discount::DOUBLE, l_tax::DOUBLE] AS x, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y FROM lineitem)"


def _cells(spark, sf_dir):
    return to_long(embeddings(spark, sf_dir).select("row_id", "x"))


@query(A + " SELECT a.i, a.j::INT AS j, round(a.v + b.v, 6) + 0.0 AS v FROM c a JOIN c b ON a.i = b.i AND a.j = b.j")
def mat_add(spark, sf_dir):
    c = _cells(spark, sf_dir)
    return linalg.add(c, c).select("i", "j", r(F.col("v")).alias("v"))


@query(A + " SELECT a.i, a.j::INT AS j, round(a.v - b.v * 0.25, 6) + 0.0 AS v FROM c a JOIN c b ON a.i = b.i AND a.j = b.j")
def mat_sub(spark, sf_dir):
    c = _cells(spark, sf_dir)
    return linalg.subtract(c, linalg.scale(c, 0.25)).select("i", "j", r(F.col("v")).alias("v"))


@query(A + " SELECT i, j::INT AS j, round(v * -1.5, 6) + 0.0 AS v FROM c")
def mat_scale(spark, sf_dir):
    return linalg.scale(_cells(spark, sf_dir), -1.5).select("i", "j", r(F.col("v")).alias("v"))


@query(A + " SELECT a.i, a.j::INT AS j, round(a.v * b.v, 6) + 0.0 AS v FROM c a JOIN c b ON a.i = b.i AND a.j = b.j")
def hadamard(spark, sf_dir):
    c = _cells(spark, sf_dir)
    return linalg.hadamard(c, c).select("i", "j", r(F.col("v")).alias("v"))


@query(A + " SELECT j AS i, i::INT AS j, round(v, 6) + 0.0 AS v FROM c")
def transpose_long(spark, sf_dir):
    return linalg.transpose(_cells(spark, sf_dir)).select("i", "j", r(F.col("v")).alias("v"))


@query(A + " SELECT a.i, k::INT AS j, round(sum(a.v * ((a.j * 3 + k) % 7 - 3)), 6) + 0.0 AS v FROM c a, (SELECT unnest(generate_series(0, 2)) AS k) GROUP BY 1, 2")
def matmul_long(spark, sf_dir):
    right = spark.range(192).select(F.floor(F.col("id") / 3).alias("i"), (F.col("id") % 3).cast("int").alias("j"), (F.col("id") % 7 - 3).cast("double").alias("v"))
    return linalg.matmul(_cells(spark, sf_dir), right).select("i", "j", r(F.col("v")).alias("v"))


@query(E + ", w AS (SELECT vec_id, unnest(generate_series(0, 2)) AS k, x FROM e) SELECT vec_id AS row_id, k::INT AS k, round(list_sum(list_transform(x, lambda v, j: v * (((j - 1) * 3 + k) % 7 - 3))), 6) + 0.0 AS v FROM w")
def matmul_wide(spark, sf_dir):
    import numpy as np

    right = np.arange(64 * 3).reshape(64, 3) % 7 - 3.0
    out = linalg.matmul_small(embeddings(spark, sf_dir).select("row_id", "x"), right)
    return out.select("row_id", F.posexplode("x").alias("k", "v")).select("row_id", "k", r(F.col("v")).alias("v"))


@query("SELECT i, j::INT AS j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM (SELECT unnest(generate_series(0, 15)) AS i), (SELECT unnest(generate_series(0, 15)) AS j)")
def eye(spark, sf_dir):
    return linalg.identity(spark, 16)


@query("SELECT true AS same, false AS different")
def mat_equals(spark, sf_dir):
    c = _cells(spark, sf_dir)
    return spark.createDataFrame([(linalg.equal(c, c.withColumn("v", F.col("v") + 1e-11)), linalg.equal(c, linalg.scale(c, 2.0)))], "same boolean, different boolean")


@query(E + " SELECT vec_id AS row_id, round(x[1], 6) AS first, round(x[64], 6) AS last, len(x)::INT AS d FROM e")
def wide_long_roundtrip(spark, sf_dir):
    wide = to_wide(to_long(embeddings(spark, sf_dir).select("row_id", "x")), 64)
    return wide.select("row_id", r(F.col("x")[0]).alias("first"), r(F.col("x")[63]).alias("last"), F.size("x").alias("d"))


def _map(name, f, sql):
    def run(spark, sf_dir):
        return embeddings(spark, sf_dir).select("row_id", F.posexplode(arrays.each(F.col("x"), lambda v: f(v * 4.0))).alias("j", "v")).select("row_id", "j", r(F.col("v")).alias("v"))

    run.__name__ = name
    query(E + f", u AS (SELECT vec_id AS row_id, unnest(generate_series(0, 63))::INT AS j, 4.0 * unnest(x) AS v FROM e) SELECT row_id, j, round({sql}, 6) + 0.0 AS v FROM u")(run)


for _name, _f, _sql in (
    ("act_relu", ieee.relu, "greatest(v, 0.0)"),
    ("act_relu_slope", ieee.relu_slope, "CASE WHEN v <= 0 THEN 0.0 ELSE 1.0 END"),
    ("act_sigmoid", ieee.sigmoid, "1.0 / (1.0 + exp(-v))"),
    ("act_sigmoid_slope", ieee.sigmoid_slope, "(1.0 / (1.0 + exp(-v))) * (1.0 - 1.0 / (1.0 + exp(-v)))"),
    ("act_tanh", F.tanh, "tanh(v)"),
    ("act_tanh_slope", ieee.tanh_slope, "1.0 - tanh(v) * tanh(v)"),
    ("sign_perceptron", lambda v: ieee.sign(v, -1).cast("double"), "CASE WHEN v > 0 THEN 1.0 ELSE -1.0 END"),
    ("sign_svm", lambda v: ieee.sign(v, 1).cast("double"), "CASE WHEN v >= 0 THEN 1.0 ELSE -1.0 END"),
    ("clamped", lambda v: ieee.clamp(v, -0.25, 0.25), "least(greatest(v, -0.25), 0.25)"),
):
    _map(_name, _f, _sql)


@query("SELECT event_id, round(CASE WHEN value > 50 THEN ln(value - 50) END, 6) AS log_part, value = 50 AS at_zero FROM events")
def ieee_logs(spark, sf_dir):
    v = F.col("value") - 50
    return table(spark, sf_dir, "events").select("event_id", r(F.when(v > 0, ieee.ieee_log(v))).alias("log_part"), (ieee.ieee_log(v) == float("-inf")).alias("at_zero"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CASE WHEN value > 0 THEN 'inf' WHEN value < 0 THEN '-inf' ELSE 'nan' END ELSE 'number' END AS kind FROM events")
def ieee_division(spark, sf_dir):
    q = ieee.ieee_div(F.col("value"), (F.col("event_id") % 4).cast("double"))
    kind = F.when(F.isnan(q), "nan").when(q == float("inf"), "inf").when(q == float("-inf"), "-inf").otherwise("number")
    return table(spark, sf_dir, "events").select("event_id", kind.alias("kind"))


@query(E + ", p AS (SELECT vec_id, list_transform(x, lambda v: exp(v - list_max(x))) AS p FROM e), u AS (SELECT vec_id AS row_id, unnest(generate_series(0, 63))::INT AS j, unnest(p) / (list_sum(p) + 1e-10) AS v FROM p) SELECT row_id, j, round(v, 6) AS v FROM u")
def softmax(spark, sf_dir):
    return embeddings(spark, sf_dir).select("row_id", F.posexplode(arrays.softmax(F.col("x"))).alias("j", "v")).select("row_id", "j", r(F.col("v")).alias("v"))


@query("SELECT vec_id AS row_id, j::INT AS j, CASE WHEN label = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM embeddings, (SELECT unnest(generate_series(0, 9)) AS j)")
def onehot(spark, sf_dir):
    return embeddings(spark, sf_dir).select("row_id", F.posexplode(arrays.one_hot(F.col("y"), 10)).alias("j", "v"))


@query(E + " SELECT vec_id AS row_id, (list_position(x, list_max(x)) - 1)::INT AS top, (list_position(x, list_min(x)) - 1)::INT AS bottom FROM e")
def argmax_argmin(spark, sf_dir):
    return embeddings(spark, sf_dir).select("row_id", arrays.argmax(F.col("x")).alias("top"), arrays.argmin(F.col("x")).alias("bottom"))


@query(E + ", m AS (SELECT vec_id, unnest(generate_series(0, 8)) AS j, unnest(x[1:9]) AS v FROM e) SELECT vec_id AS row_id, j::INT AS j, round(CASE WHEN (vec_id + j) % 3 = 0 THEN v ELSE -1e9 END, 6) AS v FROM m")
def masked_logits(spark, sf_dir):
    allowed = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda j: (F.col("row_id") + j) % 3 == 0)
    return embeddings(spark, sf_dir).select("row_id", F.posexplode(arrays.mask_actions(F.slice("x", 1, 9), allowed)).alias("j", "v")).select("row_id", "j", r(F.col("v")).alias("v"))


@query("SELECT event_id, unnest(list_filter(generate_series(0, 8), lambda c: (event_id // (c + 1)) % 3 = 0))::INT AS action FROM events")
def valid_actions(spark, sf_dir):
    board = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda c: F.floor(F.col("event_id") / (c + 1)) % 3)
    return table(spark, sf_dir, "events").select("event_id", F.explode(arrays.empty_cells(board)).alias("action"))


#: Queries: rows whose id is divisible by 20, each against all rows.
PAIRS = E + ", p AS (SELECT a.vec_id AS i, b.vec_id AS j, list_inner_product(a.x, b.x) AS d, list_distance(a.x, b.x) AS f FROM e a, e b WHERE a.vec_id % 20 = 0)"


def _pairs(spark, sf_dir, name):
    e = embeddings(spark, sf_dir).select("row_id", "x")
    return linalg.cells_with_all(e.filter("row_id % 20 = 0"), e, lambda a, b: kernel_matrix(name, a, b, 0.7), 6)


def _kernel(name, sql):
    def run(spark, sf_dir):
        return _pairs(spark, sf_dir, name)

    run.__name__ = f"kernel_{name}"
    query(PAIRS + f" SELECT i, j, round({sql}, 6) + 0.0 AS v FROM p")(run)


for _name, _sql in (("linear", "d"), ("poly2", "(1 + d) * (1 + d)"), ("poly3", "(1 + d) * (1 + d) * (1 + d)"), ("rbf", "exp(-0.7 * f * f)")):
    _kernel(_name, _sql)


@query(PAIRS + " SELECT i, j, round(d, 6) + 0.0 AS v FROM p")
def gram_matrix(spark, sf_dir):
    return _pairs(spark, sf_dir, "linear")


@query(E + ", t AS (SELECT x[1:7] AS t FROM e WHERE vec_id = 0), z AS (SELECT vec_id, list_cosine_similarity(x[1:7], t) AS c FROM e, t) SELECT vec_id AS row_id, round(1 + 9 / (1 + exp(-20 * (c - 0.55))), 6) AS reward FROM z")
def cosine_reward(spark, sf_dir):
    e = embeddings(spark, sf_dir).select("row_id", F.slice("x", 1, 7).alias("x"))
    target = e.filter("row_id = 0").select(F.col("x").alias("t"))  # one row
    return e.crossJoin(F.broadcast(target)).select("row_id", r(arrays.cosine_reward(F.col("x"), F.col("t"), 7)).alias("reward"))


@query(E + ", t AS (SELECT x[1:7] AS t FROM e WHERE vec_id = 0), z AS (SELECT label, 1 + 9 / (1 + exp(-20 * (list_cosine_similarity(x[1:7], t) - 0.55))) AS w FROM e, t) SELECT label::INT AS cluster, round(avg(w), 5) AS mean_reward, round(stddev_pop(w), 5) AS std_reward, count(*) AS members FROM z GROUP BY 1")
def cluster_reward_stats(spark, sf_dir):
    e = embeddings(spark, sf_dir).select(F.slice("x", 1, 7).alias("x"), "row_id", F.col("y").cast("int").alias("cluster"))
    target = e.filter("row_id = 0").select(F.col("x").alias("t"))
    out = stats.cluster_rewards(e.crossJoin(F.broadcast(target)).withColumn("reward", arrays.cosine_reward(F.col("x"), F.col("t"), 7)), "cluster", "reward")
    return out.select("cluster", r(F.col("mean_reward"), 5).alias("mean_reward"), r(F.col("std_reward"), 5).alias("std_reward"), "members")


def _normalised(name, f, sql):
    def run(spark, sf_dir):
        df = parts(spark, sf_dir).select("row_id", "x")
        return f(df, 2).select("row_id", r(F.col("x")[0]).alias("size"), r(F.col("x")[1]).alias("price"))

    run.__name__ = name
    each = "SELECT avg(p_size::DOUBLE) AS m1, avg(p_retailprice) AS m2, stddev_pop(p_size::DOUBLE) AS s1, stddev_pop(p_retailprice) AS s2, sqrt(greatest(sum(p_size::DOUBLE * p_size), 1e-12)) AS n1, sqrt(greatest(sum(p_retailprice * p_retailprice), 1e-12)) AS n2 FROM part"
    query(f"WITH t AS ({each}) SELECT p_partkey AS row_id, round({sql.format('p_size', 1)}, 6) + 0.0 AS size, round({sql.format('p_retailprice', 2)}, 6) + 0.0 AS price FROM part, t")(run)


_normalised("zscore", stats.zscore, "({0} - m{1}) / (s{1} + 1e-8)")
_normalised("center_cols", stats.center, "{0} - m{1}")
_normalised("l2_norm_cols", stats.l2_normalize, "{0} / n{1}")


@query("SELECT round(avg(l_quantity), 4) AS mean_quantity, round(stddev_pop(l_quantity), 4) AS std_quantity, round(avg(l_tax), 6) AS mean_tax, round(stddev_pop(l_tax), 6) AS std_tax FROM lineitem")
def column_stats(spark, sf_dir):
    s = stats.column_stats(lines(spark, sf_dir), 4)
    return s.select(r(F.col("mean")[0], 4).alias("mean_quantity"), r(F.col("std")[0], 4).alias("std_quantity"), r(F.col("mean")[3]).alias("mean_tax"), r(F.col("std")[3]).alias("std_tax"))


@query("WITH l AS (SELECT [l_quantity::DOUBLE, l_discount::DOUBLE, l_tax::DOUBLE] AS x FROM lineitem), m AS (SELECT [avg(x[1]), avg(x[2]), avg(x[3])] AS m, count(*) AS n FROM l), j AS (SELECT unnest([1, 2, 3]) AS j) SELECT (a.j - 1)::BIGINT AS i, (b.j - 1)::INT AS j, round(sum((x[a.j] - m[a.j]) * (x[b.j] - m[b.j])) / (any_value(n) - 1), 5) + 0.0 AS v FROM l, m, j a, j b GROUP BY 1, 2")
def pca_covariance(spark, sf_dir):
    df = lines(spark, sf_dir).select(arrays.pick(F.col("x"), [0, 2, 3]).alias("x"))
    return stats.covariance(stats.center(df, 3), df.count()).select("i", "j", r(F.col("v"), 5).alias("v"))


def _poly(k):
    def run(spark, sf_dir):
        df = augment(parts(spark, sf_dir).select("row_id", F.transform("x", lambda v: v / 100).alias("x")), f"poly_{k}")
        return df.select("row_id", F.posexplode("x").alias("j", "v")).select("row_id", "j", r(F.col("v"), 4).alias("v"))

    run.__name__ = f"poly_features_{k}"
    powers = " UNION ALL ".join(f"SELECT row_id, {2 * p + c}::INT AS j, round({' * '.join([name] * (p + 1))}, 4) + 0.0 AS v FROM b" for p in range(k) for c, name in enumerate(("s", "v")))
    query(f"WITH b AS (SELECT p_partkey AS row_id, p_size::DOUBLE / 100 AS s, p_retailprice / 100 AS v FROM part) {powers}")(run)


for _k in (2, 3, 4, 5):
    _poly(_k)

_fixed = FourierFeatures.draw(2, 4, 0.75, 3)


@query(
    "WITH b AS (SELECT p_partkey AS row_id, p_size::DOUBLE / 50 AS s, p_retailprice / 1000 AS v FROM part) "
    + " UNION ALL ".join(f"SELECT row_id, {k}::INT AS j, round(sqrt(2.0 / 4) * cos(s * ({_fixed.w[0, k]!r}::DOUBLE) + v * ({_fixed.w[1, k]!r}::DOUBLE) + ({_fixed.b[k]!r}::DOUBLE)), 6) + 0.0 AS v FROM b" for k in range(4)).replace("np.float64(", "(")
)
def rff_features(spark, sf_dir):
    df = parts(spark, sf_dir).select("row_id", F.array(F.col("x")[0] / 50, F.col("x")[1] / 1000).alias("x"))
    return augment(df, "rff", fourier=_fixed).select("row_id", F.posexplode("x").alias("j", "v")).select("row_id", "j", r(F.col("v")).alias("v"))


@query("WITH k AS (SELECT p_partkey AS row_id, row_number() OVER (ORDER BY (p_partkey * 7919) % 10007, p_partkey) AS n, count(*) OVER () AS c FROM part) SELECT row_id, n <= floor(0.8 * c) AS is_train FROM k")
def exact_split(spark, sf_dir):
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"))
    return split.exact_split(df, 0.8, "row_id", order=((F.col("row_id") * 7919) % 10007).cast("int")).select("row_id", "is_train")


@query("SELECT floor(0.8 * count(*))::BIGINT AS train, (count(*) - floor(0.8 * count(*)))::BIGINT AS test FROM orders")
def exact_split_hashed(spark, sf_dir):
    df = split.exact_split(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id")), 0.8, "row_id", seed=4)
    return df.agg(F.count_if("is_train").alias("train"), F.count_if(~F.col("is_train")).alias("test"))


@query("SELECT least(100, count(*)) AS n, least(100, count(*)) AS different FROM part")
def sample_without_replacement(spark, sf_dir):
    return split.sample_exact(table(spark, sf_dir, "part"), 100, "p_partkey", 9).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p_partkey").alias("different"))


@query("WITH n AS (SELECT count(*) AS n, gcd(count(*), 4) AS world FROM embeddings) SELECT vec_id AS row_id FROM embeddings, n WHERE vec_id // (n // world) = world - 1")
def shard_equal(spark, sf_dir):
    """The last of four equal shards; of two or one where the rows can't be cut into four."""
    e = embeddings(spark, sf_dir)
    n = e.count()
    world = math.gcd(n, 4)
    return split.equal_shard(e, n, world - 1, world).select("row_id")


@query("SELECT vec_id AS row_id FROM embeddings WHERE vec_id % 4 = 3")
def shard_strided(spark, sf_dir):
    return split.strided_shard(embeddings(spark, sf_dir), 3, 4).select("row_id")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END::INT AS code, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END::INT AS signed FROM orders")
def label_encode(spark, sf_dir):
    code = text.label_code(F.col("o_orderstatus"), ["F", "O", "P"])
    return table(spark, sf_dir, "orders").select("o_orderkey", code.cast("int").alias("code"), F.when(code == 0, 1).otherwise(-1).alias("signed"))


@query("SELECT count(*) AS n, round(avg(l_quantity), 4) AS quantity FROM lineitem WHERE l_returnflag IN ('A', 'R')")
def class_filter(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag").isin("A", "R")).agg(F.count(F.lit(1)).alias("n"), r(F.avg("l_quantity"), 4).alias("quantity"))


@query("SELECT event_id, props->>'$.k' AS k, lower(event_type) AS kind, url_encode(props) AS encoded FROM events")
def json_and_url(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.json_field(F.col("props"), "k").alias("k"), F.lower("event_type").alias("kind"), F.replace(F.url_encode("props"), F.lit("+"), F.lit("%20")).alias("encoded"))


@query("SELECT p_partkey, unnest(regexp_extract_all('exp(x) + max(1.25, _y2) - sigmoid(z) / min(abs(.5), log2)' || p_partkey::VARCHAR, '(?:[0-9]+(?:\\.[0-9]*)?|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[A-Za-z_][A-Za-z0-9_]*|[-+*/^(),]')) AS token FROM part")
def tokens(spark, sf_dir):
    source = F.concat(F.lit("exp(x) + max(1.25, _y2) - sigmoid(z) / min(abs(.5), log2)"), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(text.lexemes(source)).alias("token"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN -2 WHEN o_orderkey % 3 = 1 THEN -1 ELSE o_orderkey::INT END AS episode FROM orders")
def episode_numbers(spark, sf_dir):
    path = F.concat(F.lit("/runs/a1/"), F.when(F.col("o_orderkey") % 3 == 0, "best").when(F.col("o_orderkey") % 3 == 1, "final").otherwise(F.concat(F.lit("episode_"), F.col("o_orderkey"))), F.lit(".model"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.episode_number(path).alias("episode"))


@query("SELECT p_partkey, round(p_retailprice * 10000)::INT AS code FROM part")
def regression_codes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.regression_code(F.col("p_retailprice")).alias("code"))


@query("SELECT event_id, round(greatest(0.05, 1.0 * exp(-0.01 * event_id)), 6) AS by_rate, round(CASE WHEN pow(0.99, event_id) > 0.05 THEN pow(0.99, event_id) ELSE greatest(pow(0.99, event_id), 0.0495) END, 6) AS by_factor FROM events")
def eps_schedule(spark, sf_dir):
    n = F.col("event_id").cast("double")
    return table(spark, sf_dir, "events").select("event_id", r(ieee.decayed(1.0, 0.05, 0.01, n)).alias("by_rate"), r(ieee.decayed_by_factor(1.0, 0.05, 0.99, n)).alias("by_factor"))


@query(E + " SELECT a.vec_id AS row_id, round(list_distance(a.x, b.x), 6) AS away, round(list_inner_product(a.x, b.x), 6) + 0.0 AS inner_product FROM e a, e b WHERE b.vec_id = 1")
def distances(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    one = F.broadcast(e.filter("row_id = 1").select(F.col("x").alias("o")))  # one row
    return e.crossJoin(one).select("row_id", r(arrays.distance(F.col("x"), F.col("o"), 64)).alias("away"), r(arrays.dot(F.col("x"), F.col("o"), 64)).alias("inner_product"))


@query("SELECT round(max(abs(l_quantity) + abs(l_extendedprice) + abs(l_discount) + abs(l_tax)), 4) AS norm FROM lineitem")
def max_row_sum(spark, sf_dir):
    total = F.aggregate("x", F.lit(0.0), lambda s, v: s + F.abs(v))
    return lines(spark, sf_dir).agg(r(F.max(total), 4).alias("norm"))


@query("SELECT event_type AS arm, mode_value AS top, n FROM (SELECT event_type, (value::INT % 7) AS mode_value, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, value::INT % 7) AS k FROM (SELECT event_type, floor(value) AS value FROM events) GROUP BY 1, 2) WHERE k = 1")
def majority_vote(spark, sf_dir):
    votes = pulls(spark, sf_dir).select("arm", (F.floor("reward").cast("int") % 7).alias("top"))
    best = stats.majority(votes, ["arm"], "top")
    counts = votes.groupBy("arm", "top").agg(F.count(F.lit(1)).alias("n"))
    return best.join(counts, ["arm", "top"]).select("arm", "top", "n")


@query("SELECT round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS loss, round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM (SELECT 1 / (1 + exp(-(l_discount * 30 - 1.5))) AS p, CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS y FROM lineitem)")
def log_loss(spark, sf_dir):
    df = lines(spark, sf_dir).select(ieee.sigmoid(F.col("x")[2] * 30 - 1.5).alias("p"), (F.col("y") == 1).cast("double").alias("y"))
    return df.agg(r(stats.log_loss(F.col("p"), F.col("y"))).alias("loss"), r(stats.accuracy((F.col("p") >= 0.5).cast("double"), F.col("y"))).alias("accuracy"))


