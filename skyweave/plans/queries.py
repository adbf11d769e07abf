"""Queries of the engine's operators over star-schema tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyweave.functions import sky
from skyweave.operators import aggregates, identity, joins, layout, spatial, zorder
from skyweave.plans import field, groups, region
from skyweave.storage import fresh_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Half-open bands of l_quantity.
BANDS = [("a", 1.0, 11.0), ("b", 11.0, 21.0), ("c", 21.0, 31.0), ("d", 31.0, 41.0), ("e", 41.0, 50.0)]
BAND_SQL = "CASE " + " ".join(f"WHEN l_quantity >= {a} AND l_quantity < {b} THEN '{n}'" for n, a, b in BANDS) + " END"
C = F.col


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def vectors(self) -> DataFrame:
        """vec_id, x0 to x5 (double), label."""
        return self.embeddings.select("vec_id", *[F.get("embedding", F.lit(k)).cast("double").alias(f"x{k}") for k in range(6)], "label")


VEC = "v AS (SELECT vec_id, " + ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS x{k}" for k in range(6)) + ", label FROM embeddings)"
XYZ = ["x0", "x1", "x2"]


def query(sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        name = "q_" + f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE[name] = sql
        return f

    return add


def r(x, n: int = 6):
    """Rounded, because sums and percentiles of engines differ in the last bit; no negative zero."""
    return F.round(x, n) + F.lit(0.0)


# --- selection ---


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE trim(o_orderstatus) = 'O' AND o_totalprice >= 1000 AND isfinite(o_totalprice) AND o_orderkey > 0 AND o_orderpriority LIKE '1%'")
def select_primary(t: Tables) -> DataFrame:
    return t.orders.where((F.trim("o_orderstatus") == "O") & (C("o_totalprice") >= 1000) & sky.finite(C("o_totalprice")) & (C("o_orderkey") > 0) & C("o_orderpriority").startswith("1")).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) AS weight FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 0 AND isfinite(l_extendedprice * (1 - l_discount)) AND l_quantity >= 10 AND l_quantity < 20")
def validity_weight(t: Tables) -> DataFrame:
    w = C("l_extendedprice") * (1 - C("l_discount"))
    return t.lineitem.where((w > 0) & sky.finite(w) & (C("l_quantity") >= 10) & (C("l_quantity") < 20)).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", r(w).alias("weight"))


@query("SELECT p_partkey, p_brand, p_size FROM part WHERE p_size NOT IN (1, 2, 3) AND p_retailprice <> 0 AND isfinite(p_retailprice) AND p_partkey IN (SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING count(*) >= 5)")
def filters(t: Tables) -> DataFrame:
    rich = t.lineitem.groupBy("l_partkey").count().where("count >= 5").select(C("l_partkey").alias("p_partkey"))
    return joins.members(t.part.where(~C("p_size").isin(1, 2, 3) & (C("p_retailprice") != 0) & sky.finite(C("p_retailprice"))), rich, "p_partkey").select("p_partkey", "p_brand", "p_size")


MASKS = """m AS (SELECT *, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 0 END AS dark, (CASE WHEN l_linestatus = 'O' THEN 2 ELSE 0 END | CASE WHEN l_quantity > 40 THEN 8 ELSE 0 END | CASE WHEN l_quantity < 5 THEN 16 ELSE 0 END) AS bright FROM lineitem),
f AS (SELECT *, (CASE WHEN (bright & 15) <> 0 THEN 1 ELSE 0 END | CASE WHEN (bright & 2) <> 0 THEN 2 ELSE 0 END | CASE WHEN (dark & 1) <> 0 THEN 4 ELSE 0 END | CASE WHEN (dark & 2) <> 0 THEN 8 ELSE 0 END | CASE WHEN (dark & 4) <> 0 THEN 16 ELSE 0 END) AS raw FROM m),
g AS (SELECT *, CASE WHEN raw = 0 THEN 32 ELSE raw END AS flags FROM f)"""


def flagged(t: Tables) -> DataFrame:
    dark = F.when(C("l_returnflag") == "R", 1).when(C("l_returnflag") == "A", 2).otherwise(0)
    bright = sky.bit_or(F.when(C("l_linestatus") == "O", 2).otherwise(0), F.when(C("l_quantity") > 40, 8).otherwise(0), F.when(C("l_quantity") < 5, 16).otherwise(0))
    return t.lineitem.withColumn("flags", sky.target_flags(sky.bit_or(dark), bright))


@query(f"WITH {MASKS} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(flags | CASE WHEN l_tax > 0.04 THEN 64 ELSE 0 END AS INTEGER) AS type, l_tax > 0.04 AS quasar FROM g")
def target_flags(t: Tables) -> DataFrame:
    byte = sky.type_byte(C("flags"), C("l_tax") > 0.04)
    return flagged(t).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", byte.alias("type"), sky.is_quasar(byte).alias("quasar"))


@query(f"WITH {MASKS} SELECT bit, CAST(count_if((flags & (1 << bit)) <> 0) AS BIGINT) AS n FROM g, (SELECT CAST(unnest(range(6)) AS INTEGER) AS bit) GROUP BY bit")
def label_counts(t: Tables) -> DataFrame:
    return aggregates.label_counts(flagged(t), "flags", 6)


# --- joins ---


@query("SELECT o_orderkey, coalesce(c_acctbal, 0) AS c_acctbal, c_custkey IS NOT NULL AS found FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def exact_lookup(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", C("o_custkey").alias("c_custkey"))
    return joins.lookup(rows, t.customer.where("c_acctbal > 0"), "c_custkey", "c_acctbal", 0.0, "found").drop("c_custkey")


PART_CODES = "CASE WHEN p_type LIKE '%1%' THEN 0 ELSE 4 END"


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, coalesce(p_size, 255) AS p_size, coalesce(p_brand, '?') AS p_brand, coalesce(p_retailprice, -1.0) AS p_retailprice FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 25) ON l_partkey = p_partkey")
def typed_defaults(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", C("l_partkey").alias("p_partkey"))
    return joins.with_defaults(rows, t.part.where("p_size > 25"), "p_partkey", {"p_size": 255, "p_brand": "?", "p_retailprice": -1.0}).drop("p_partkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def semi(t: Tables) -> DataFrame:
    return joins.members(t.orders, t.lineitem.where("l_quantity > 45").select(C("l_orderkey").alias("o_orderkey")), "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def anti(t: Tables) -> DataFrame:
    return joins.others(t.orders, t.lineitem.where("l_quantity > 45").select(C("l_orderkey").alias("o_orderkey")), "o_orderkey").select("o_orderkey", "o_totalprice")


EXISTS = "SELECT p_partkey, p_name FROM part WHERE p_size BETWEEN 10 AND 40 AND EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 40)"


@query(EXISTS)
def exists(t: Tables) -> DataFrame:
    return t.spark.sql(EXISTS.replace("FROM part", "FROM {part}").replace("FROM lineitem", "FROM {lineitem}"), part=t.part, lineitem=t.lineitem)


@query("SELECT c_custkey, c_name, source_hits FROM customer JOIN (SELECT o_custkey, count(*) AS source_hits FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def multiplicity(t: Tables) -> DataFrame:
    return joins.with_multiplicity(t.customer.select("c_custkey", "c_name"), t.orders.select(C("o_custkey").alias("c_custkey")), "c_custkey")


@query(f"SELECT band, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM (SELECT *, {BAND_SQL} AS band FROM lineitem) GROUP BY band")
def interval_join(t: Tables) -> DataFrame:
    return t.lineitem.withColumn("band", joins.interval(C("l_quantity"), BANDS)).groupBy("band").agg(F.count("*").alias("n"), r(F.sum("l_extendedprice"), 2).alias("price"))


@query("SELECT p_partkey, count(*) AS n, round(sum(l_quantity), 2) AS quantity, min(l_orderkey) AS first FROM lineitem JOIN part ON l_extendedprice / l_quantity >= p_retailprice - p_size / 50.0 AND l_extendedprice / l_quantity < p_retailprice + p_size / 100.0 GROUP BY p_partkey")
def range_join(t: Tables) -> DataFrame:
    bands = t.part.select("p_partkey", (C("p_retailprice") - C("p_size") / 50.0).alias("low"), (C("p_retailprice") + C("p_size") / 100.0).alias("high"))
    rows = t.lineitem.select("l_orderkey", "l_quantity", (C("l_extendedprice") / C("l_quantity")).alias("price"))
    totals = {"n": (F.count("*"), F.sum), "quantity": (F.sum("l_quantity"), F.sum), "first": (F.min("l_orderkey"), F.min)}
    met = joins.interval_totals(rows, "price", bands, "low", "high", totals)
    return met.groupBy("p_partkey").agg(F.sum("n").alias("n"), r(F.sum("quantity"), 2).alias("quantity"), F.min("first").alias("first"))


@query(f"WITH c AS (SELECT {BAND_SQL} AS band, l_partkey, max(l_tax) AS tax FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2), l AS (SELECT *, {BAND_SQL} AS band FROM lineitem) SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, l.band, coalesce(c.tax, 0) AS tax, c.l_partkey IS NOT NULL AS matched FROM l LEFT JOIN c ON l.band = c.band AND l.l_partkey = c.l_partkey")
def interval_id(t: Tables) -> DataFrame:
    cache = t.lineitem.where("l_returnflag = 'R'").groupBy(joins.interval(C("l_quantity"), BANDS).alias("band"), "l_partkey").agg(F.max("l_tax").alias("tax"))
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    return joins.by_interval_and_key(rows, cache, C("l_quantity"), BANDS, "l_partkey", "band", "tax").drop("l_quantity")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN a.p_partkey IS NOT NULL THEN a.p_retailprice WHEN b.p_partkey IS NOT NULL AND l_quantity >= 10 THEN b.p_retailprice * 2 ELSE 0 END AS price, CASE WHEN a.p_partkey IS NOT NULL THEN 0 WHEN b.p_partkey IS NOT NULL AND l_quantity >= 10 THEN 1 END AS source FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 15) a ON l_partkey = a.p_partkey LEFT JOIN (SELECT * FROM part WHERE p_size BETWEEN 10 AND 35) b ON l_partkey = b.p_partkey")
def precedence(t: Tables) -> DataFrame:
    one = t.part.where("p_size < 15").select(C("p_partkey").alias("l_partkey"), C("p_retailprice").alias("price"))
    two = t.part.where("p_size BETWEEN 10 AND 35").select(C("p_partkey").alias("l_partkey"), (C("p_retailprice") * 2).alias("price"))
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    return joins.precedence(rows, [one, two], "l_partkey", "price", [F.lit(True), C("l_quantity") >= 10]).drop("l_quantity")


@query("SELECT p_partkey, CASE WHEN p_size >= 10 AND p_size < 30 THEN coalesce(n, 0) ELSE p_retailprice END AS price FROM part LEFT JOIN (SELECT p_partkey AS k, p_retailprice * 3 AS n FROM part WHERE p_retailprice > 1000) ON p_partkey = k")
def range_override(t: Tables) -> DataFrame:
    new = t.part.where("p_retailprice > 1000").select("p_partkey", (C("p_retailprice") * 3).alias("n"))
    return t.part.join(new, "p_partkey", "left").select("p_partkey", joins.override_range(C("p_retailprice"), C("n"), C("p_size"), 10, 30).alias("price"))


def estimates(t: Tables) -> DataFrame:
    unit = t.lineitem.groupBy("l_partkey").agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("got"))
    return unit.join(t.part.select(C("p_partkey").alias("l_partkey"), C("p_retailprice").alias("ref")), "l_partkey")


EST = "e AS (SELECT l_partkey, sum(l_extendedprice) / sum(l_quantity) AS got, any_value(p_retailprice) AS ref FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_partkey)"


@query(f"WITH {EST} SELECT count(*) AS count, round(corr(got, ref), 6) AS pearson, round(avg(got - ref), 6) AS bias, round(quantile_cont(abs(got - ref), 0.5), 6) AS median_diff, round(quantile_cont(abs(got - ref), 0.9), 6) AS p90_diff, round(quantile_cont(abs(got - ref), 0.99), 6) AS p99_diff, " + ", ".join(f"round(quantile_cont({c}, {p}), 6) AS {c}_p{round(100 * p)}" for c in ("ref", "got") for p in (0.01, 0.5, 0.99)) + ", round(avg(CASE WHEN abs(ref) >= 0.5 THEN CAST(sign(got) = sign(ref) AS INTEGER) END), 6) AS sign_agreement, CAST(count_if(abs(ref) >= 0.5) AS BIGINT) AS sign_compared FROM e")
def agreement(t: Tables) -> DataFrame:
    out = aggregates.agreement(estimates(t), "got", "ref")
    return out.select(*[C(c) if c in ("count", "sign_compared") else r(C(c)).alias(c) for c in out.columns])


@query("WITH b AS (SELECT p_partkey, CASE WHEN p_size > 40 THEN NULL ELSE p_size END AS p_size, CASE WHEN p_size < 5 THEN 'nan'::DOUBLE ELSE p_retailprice END AS p_retailprice FROM part) SELECT count(*) AS shared, CAST(count_if(a.p_size IS DISTINCT FROM b.p_size) AS BIGINT) AS p_size_differs, CAST(count_if(a.p_retailprice IS DISTINCT FROM b.p_retailprice) AS BIGINT) AS p_retailprice_differs FROM part a JOIN b USING (p_partkey)")
def nan_safe_diff(t: Tables) -> DataFrame:
    b = t.part.select("p_partkey", F.when(C("p_size") <= 40, C("p_size")).alias("p_size"), F.when(C("p_size") < 5, F.lit(float("nan"))).otherwise(C("p_retailprice")).alias("p_retailprice"))
    return joins.null_safe_differences(t.part, b, "p_partkey", ["p_size", "p_retailprice"])


@query("SELECT CAST(count_if(b IS NULL) AS BIGINT) AS left_only, CAST(count_if(a IS NULL) AS BIGINT) AS right_only, CAST(count_if(a > 1 OR b > 1) AS BIGINT) AS repeated FROM (SELECT c_custkey AS k, count(*) AS a FROM customer WHERE c_acctbal > 0 GROUP BY 1) FULL JOIN (SELECT o_custkey AS k, count(*) AS b FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) USING (k)")
def strict_1to1(t: Tables) -> DataFrame:
    return joins.mismatches(t.customer.where("c_acctbal > 0").select(C("c_custkey").alias("k")), t.orders.where("o_orderstatus = 'F'").select(C("o_custkey").alias("k")), "k")


@query("SELECT n_name, r_name, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name")
def dim_join(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("price"))
    full = lines.join(t.supplier, C("l_suppkey") == C("s_suppkey")).join(t.nation, C("s_nationkey") == C("n_nationkey")).join(t.region, C("n_regionkey") == C("r_regionkey"))
    return full.groupBy("n_name", "r_name").agg(F.sum("n").alias("n"), r(F.sum("price"), 2).alias("price"))


@query("WITH k AS (SELECT o_orderkey % 2 = 1 AS odd, row_number() OVER (PARTITION BY o_orderkey % 2 ORDER BY o_orderkey) - 1 AS row_index, o_orderkey FROM orders) SELECT event_id, o_orderkey FROM events JOIN k ON (event_id % 2 = 1) = odd AND CAST(floor(event_id / 2) AS BIGINT) = row_index")
def composite_lookup(t: Tables) -> DataFrame:
    parts = [layout.ordinal(t.orders.where(f"o_orderkey % 2 = {k}").select("o_orderkey"), "o_orderkey", "row_index").withColumn("odd", F.lit(bool(k))) for k in (0, 1)]
    rows = t.events.select("event_id", (C("event_id") % 2 == 1).alias("odd"), F.floor(C("event_id") / 2).cast("long").alias("row_index"))
    return rows.join(parts[0].unionByName(parts[1]), ["odd", "row_index"]).select("event_id", "o_orderkey")


@query("WITH a AS (SELECT p_partkey % 12 AS chunk, row_number() OVER (PARTITION BY p_partkey % 12 ORDER BY p_partkey) - 1 AS pos, p_partkey FROM part), b AS (SELECT c_custkey % 12 AS chunk, row_number() OVER (PARTITION BY c_custkey % 12 ORDER BY c_custkey) - 1 AS pos, c_custkey FROM customer) SELECT chunk, pos, p_partkey, c_custkey FROM a JOIN b USING (chunk, pos)")
def positional_zip(t: Tables) -> DataFrame:
    def numbered(df: DataFrame, key: str) -> DataFrame:
        return layout.positions(df.select((C(key) % 12).alias("chunk"), key), "chunk", [key]).select("chunk", "pos", key)

    return joins.zip_rows(numbered(t.part, "p_partkey"), numbered(t.customer, "c_custkey"), "chunk", "pos")


@query("WITH u AS (SELECT o_orderkey AS k, 1 AS side FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, 2 FROM orders WHERE o_orderstatus <> 'O') SELECT count(*) AS n, count(DISTINCT k) AS keys, (SELECT count(*) FROM (SELECT k FROM u GROUP BY k HAVING count(*) > 1)) AS overlap FROM u")
def merge_disjoint(t: Tables) -> DataFrame:
    o = t.orders.select(C("o_orderkey").alias("k"), "o_orderstatus")
    both = joins.disjoint_union(o.where("o_orderstatus = 'O'"), o.where("o_orderstatus <> 'O'"), "k")
    return both.groupBy("k").agg(F.count("*").alias("c")).agg(F.sum("c").alias("n"), F.count("*").alias("keys"), F.count_if(C("c") > 1).alias("overlap"))


@query("WITH a AS (SELECT l_partkey, l_returnflag AS g, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2), b AS (SELECT l_partkey, l_linestatus AS g, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2) SELECT a.g AS a_g, b.g AS b_g, count(*) AS shared, round(avg(abs(a.v - b.v)), 6) AS diff FROM a JOIN b USING (l_partkey) GROUP BY a.g, b.g")
def agreement_matrix(t: Tables) -> DataFrame:
    mean = lambda g: t.lineitem.groupBy("l_partkey", C(g).alias("g")).agg(F.avg("l_quantity").alias("v"))
    return joins.matrix(mean("l_returnflag"), mean("l_linestatus"), "l_partkey", "g", r(F.avg(F.abs(C("a_v") - C("b_v")))).alias("diff"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 42")
def point_lookup(t: Tables) -> DataFrame:
    return t.customer.where("c_custkey = 42").select("c_custkey", "c_name", "c_acctbal")


@query("WITH a AS (SELECT o_orderpriority AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_orderpriority AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) SELECT k, a.n AS first, b.n AS second, a.n - b.n AS change FROM a FULL JOIN b USING (k)")
def report_compare(t: Tables) -> DataFrame:
    side = lambda k, n: t.orders.where(C("o_orderstatus") == k).groupBy(C("o_orderpriority").alias("k")).agg(F.count("*").alias(n))
    return side("F", "first").join(side("O", "second"), "k", "full_outer").withColumn("change", C("first") - C("second"))


# --- deduplication ---


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def dedup_max(t: Tables) -> DataFrame:
    return aggregates.keep_best(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", C("o_totalprice"), -C("o_orderkey"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k = 1")
def dedup_first(t: Tables) -> DataFrame:
    return aggregates.keep_best(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", -C("o_orderkey"))


@query("SELECT l_orderkey, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY l_orderkey HAVING min(l_returnflag) = max(l_returnflag) AND min(l_linestatus) = max(l_linestatus)")
def conflict_exclude(t: Tables) -> DataFrame:
    return aggregates.conflict_free(t.lineitem, "l_orderkey", ["l_returnflag", "l_linestatus"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicates(t: Tables) -> DataFrame:
    return aggregates.duplicates(t.lineitem, "l_orderkey", "l_linenumber")


@query("SELECT repeats, count(*) AS n FROM (SELECT coalesce(lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) = l_linenumber, false) AS repeats FROM lineitem) GROUP BY repeats")
def adjacent_duplicates(t: Tables) -> DataFrame:
    return layout.adjacent_duplicates(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"]).groupBy("repeats").agg(F.count("*").alias("n"))


@query("WITH g AS (SELECT l_orderkey, l_linenumber, count(*) AS copies, max(l_extendedprice) - min(l_extendedprice) AS span, arg_min(l_quantity, {'a': l_partkey, 'b': l_suppkey, 'c': l_quantity, 'd': l_tax}) AS q, arg_min(l_tax, {'a': l_partkey, 'b': l_suppkey, 'c': l_quantity, 'd': l_tax}) AS x FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) SELECT l_orderkey, l_linenumber, any_value(copies) AS copies, round(max(sqrt((l_quantity - q) ** 2 + (l_tax - x) ** 2)), 6) AS separation, round(any_value(span), 6) AS span FROM lineitem JOIN g USING (l_orderkey, l_linenumber) GROUP BY 1, 2")
def dup_consistency(t: Tables) -> DataFrame:
    rows = t.lineitem
    out = aggregates.consistency(rows, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"], ["l_quantity", "l_tax"], "l_extendedprice")
    return out.select("l_orderkey", "l_linenumber", "copies", r("separation").alias("separation"), r("span").alias("span"))


# --- aggregates ---


@query("SELECT o_orderstatus, count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high, round(32767 / greatest(abs(min(o_totalprice)), abs(max(o_totalprice))), 9) AS scale FROM orders GROUP BY 1")
def class_minmax(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), r(32767 / F.greatest(F.abs(F.min("o_totalprice")), F.abs(F.max("o_totalprice"))), 9).alias("scale"))


@query("SELECT l_suppkey, count(*) AS n, round(median(l_extendedprice), 6) AS median_l_extendedprice, round(1.4826 * mad(l_extendedprice), 6) AS spread_l_extendedprice FROM lineitem GROUP BY 1")
def robust_spread(t: Tables) -> DataFrame:
    return aggregates.robust_spread(t.lineitem, "l_suppkey", "l_extendedprice").select("l_suppkey", "n", r("median_l_extendedprice").alias("median_l_extendedprice"), r("spread_l_extendedprice").alias("spread_l_extendedprice"))


COMPRESS = """m AS (SELECT l_suppkey AS igrp, l_orderkey AS igal, l_linenumber > 1 AS spec, l_extendedprice - 30000 AS offset_, l_quantity * 200 AS across FROM lineitem),
s AS (SELECT igrp, count(*) AS spec, 1.4826 * mad(offset_) AS sp, 1.4826 * mad(across) AS st FROM m WHERE spec GROUP BY igrp),
e AS (SELECT *, sp / st AS elongation, greatest(0.08, least(1.0, st / sp)) AS alpha FROM s WHERE spec >= 5 AND sp > 0 AND st > 0 AND sp / st >= 1.5)"""


def measured(t: Tables) -> DataFrame:
    return t.lineitem.select(C("l_suppkey").alias("igrp"), C("l_orderkey").alias("igal"), (C("l_linenumber") > 1).alias("spec"), (C("l_extendedprice") - 30000).alias("offset"), (C("l_quantity") * 200).alias("across"))


@query(f"WITH {COMPRESS} SELECT igrp, spec, round(sp, 6) AS sigma_parallel, round(st, 6) AS sigma_perp, round(elongation, 6) AS elongation, round(alpha, 6) AS alpha FROM e")
def group_compress(t: Tables) -> DataFrame:
    stats, _ = groups.compress(measured(t))
    return stats.select("igrp", "spec", *[r(c).alias(c) for c in ("sigma_parallel", "sigma_perp", "elongation", "alpha")])


@query(f"WITH {COMPRESS} SELECT m.igrp, count(*) AS n, CAST(count_if(d <> 0) AS BIGINT) AS moved, round(sum(d), 2) AS total FROM (SELECT m.igrp, coalesce(greatest(-300, least(300, (alpha - 1) * offset_)), 0) AS d FROM m LEFT JOIN e USING (igrp)) m GROUP BY m.igrp")
def group_shift(t: Tables) -> DataFrame:
    _, moved = groups.compress(measured(t))
    return moved.withColumn("d", F.coalesce(sky.compressed_delta(C("offset"), C("alpha")), F.lit(0.0))).groupBy("igrp").agg(F.count("*").alias("n"), F.count_if(C("d") != 0).alias("moved"), r(F.sum("d"), 2).alias("total"))


@query("SELECT l_returnflag, round(avg(l_extendedprice), 4) AS mean, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99 FROM lineitem GROUP BY 1")
def percentiles(t: Tables) -> DataFrame:
    found = aggregates.exact_percentiles(t.lineitem, "l_extendedprice", [0.5, 0.95, 0.99], "l_returnflag")
    at = t.lineitem.sparkSession.createDataFrame([(g, x) for g, x in found.items()], "l_returnflag string, p array<double>")
    p = t.lineitem.groupBy("l_returnflag").agg(F.avg("l_extendedprice").alias("m")).join(F.broadcast(at), "l_returnflag")
    return p.select("l_returnflag", r("m", 4).alias("mean"), *[r(C("p")[k], 4).alias(n) for k, n in enumerate(("p50", "p95", "p99"))])


def histogram_sql(value: str, table: str, signed: bool) -> str:
    low = "-top" if signed else "0.0"
    return f"""WITH x AS (SELECT CAST({value} AS DOUBLE) AS x FROM {table} WHERE isfinite({value})), p AS (SELECT greatest(quantile_cont({'abs(x)' if signed else 'x'}, 0.99), 1e-6) AS top FROM x WHERE x <> 0),
b AS (SELECT CASE WHEN x = 0 THEN -2 WHEN x < {low} OR x > top THEN -1 ELSE least(floor((x - ({low})) / ((top - ({low})) / 40)), 39) END AS bin FROM x, p),
c AS (SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n FROM b GROUP BY 1)
SELECT CAST(s.bin AS INTEGER) AS bin, CASE WHEN s.bin >= 0 THEN round({low} + (top - ({low})) / 40 * s.bin, 4) END AS low, CASE WHEN s.bin >= 0 THEN round({low} + (top - ({low})) / 40 * (s.bin + 1), 4) END AS high, coalesce(n, 0) AS n FROM (SELECT unnest(range(-2, 40)) AS bin) s CROSS JOIN p LEFT JOIN c ON s.bin = c.bin"""


def rounded_bins(df: DataFrame) -> DataFrame:
    return df.select("bin", r("low", 4).alias("low"), r("high", 4).alias("high"), "n")


@query(histogram_sql("l_extendedprice", "lineitem", False))
def histogram(t: Tables) -> DataFrame:
    return rounded_bins(aggregates.histogram(t.lineitem, "l_extendedprice"))


@query(histogram_sql("c_acctbal", "customer", True))
def histogram_signed(t: Tables) -> DataFrame:
    return rounded_bins(aggregates.histogram(t.customer, "c_acctbal", signed=True))


@query("SELECT CAST(floor((l_extendedprice - 900) / 5000) AS BIGINT) AS shell, CAST(count_if(l_returnflag = 'A') AS BIGINT) AS a, CAST(count_if(l_returnflag = 'N') AS BIGINT) AS n, CAST(count_if(l_returnflag = 'R') AS BIGINT) AS r FROM lineitem GROUP BY 1")
def shells(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.floor((C("l_extendedprice") - 900) / 5000).cast("long").alias("shell")).agg(*[F.count_if(C("l_returnflag") == f).alias(f.lower()) for f in "ANR"])


@query(f"SELECT band, count(*) AS n, round(avg(l_discount), 6) AS mean, round(quantile_cont(l_extendedprice, 0.5), 4) AS mid, round(max(l_tax), 6) AS top FROM (SELECT *, {BAND_SQL} AS band FROM lineitem) WHERE band IS NOT NULL GROUP BY band")
def irregular_bins(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("band", joins.interval(C("l_quantity"), BANDS)).where("band IS NOT NULL")
    mid = aggregates.grouped_percentiles(rows, "band", "l_extendedprice", [0.5]).select("band", r(F.get("p", F.lit(0)), 4).alias("mid"))
    return rows.groupBy("band").agg(F.count("*").alias("n"), r(F.avg("l_discount")).alias("mean"), r(F.max("l_tax")).alias("top")).join(mid, "band").select("band", "n", "mean", "mid", "top")


@query("SELECT a, b, count(*) AS shared FROM (SELECT DISTINCT o_custkey, o_orderpriority AS a FROM orders) JOIN (SELECT DISTINCT o_custkey, o_orderpriority AS b FROM orders) USING (o_custkey) WHERE a < b GROUP BY a, b")
def intersections(t: Tables) -> DataFrame:
    return aggregates.intersections(t.orders, "o_custkey", "o_orderpriority")


@query("WITH s AS (SELECT l_suppkey, CAST(count_if(l_returnflag = 'R') AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS n FROM lineitem WHERE l_linenumber = 1 GROUP BY 1), w AS (SELECT l_suppkey, s / n AS p, 1.959963984540054 * 1.959963984540054 AS z2, n FROM s), c AS (SELECT *, (p + z2 / (2 * n)) / (1 + z2 / n) AS center, 1.959963984540054 * sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n) AS half FROM w) SELECT l_suppkey, round_even(p * 10000, 0) AS estimate, round_even(greatest(0, center - half) * 10000, 0) AS low, round_even(least(1, center + half) * 10000, 0) AS high FROM c")
def wilson(t: Tables) -> DataFrame:
    s = t.lineitem.where("l_linenumber = 1").groupBy("l_suppkey").agg(F.count_if(C("l_returnflag") == "R").alias("s"), F.count("*").alias("n"))
    return s.select("l_suppkey", *[x.alias(n) for x, n in zip(aggregates.wilson(C("s"), C("n"), F.lit(10000)), ("estimate", "low", "high"))])


@query("SELECT CAST(l_suppkey % 12 AS INTEGER) AS chunk, count(*) AS n, CAST(count_if(l_discount <> 0) AS BIGINT) AS nonzero, round(sum(l_tax), 4) AS tax FROM lineitem GROUP BY ROLLUP (CAST(l_suppkey % 12 AS INTEGER))")
def totals_rollup(t: Tables) -> DataFrame:
    return t.lineitem.withColumn("chunk", (C("l_suppkey") % 12).cast("int")).rollup("chunk").agg(F.count("*").alias("n"), F.count_if(C("l_discount") != 0).alias("nonzero"), r(F.sum("l_tax"), 4).alias("tax"))


@query("SELECT CAST(count_if(v <> 0) AS BIGINT) AS nonzero, CAST(count_if(v > 0) AS BIGINT) AS positive, CAST(count_if(v < 0) AS BIGINT) AS negative, CAST(count_if(v = 0) AS BIGINT) AS zero, bool_and(v > -100) AS all_above, bool_or(v < 0) AS any_below, count(*) = (SELECT count(c_custkey) FROM customer) AS recount FROM (SELECT CASE WHEN c_nationkey = 3 THEN 0 ELSE c_acctbal END AS v FROM customer)")
def conditional_counts(t: Tables) -> DataFrame:
    v = t.customer.select(F.when(C("c_nationkey") == 3, 0.0).otherwise(C("c_acctbal")).alias("v"))
    again = t.customer.where("c_custkey IS NOT NULL").count()
    out = v.agg(F.count_if(C("v") != 0).alias("nonzero"), F.count_if(C("v") > 0).alias("positive"), F.count_if(C("v") < 0).alias("negative"), F.count_if(C("v") == 0).alias("zero"), F.bool_and(C("v") > -100).alias("all_above"), F.bool_or(C("v") < 0).alias("any_below"), F.count("*").alias("n"))
    return out.select(*out.columns[:-1], (C("n") == again).alias("recount"))


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1")
def value_counts(t: Tables) -> DataFrame:
    return aggregates.value_counts(t.part, "p_brand")


@query("SELECT o_orderpriority, CAST(count_if(c_custkey IS NOT NULL) AS BIGINT) AS hits, count(*) AS n, round(count_if(c_custkey IS NOT NULL) / count(*), 9) AS fraction FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) ON o_custkey = c_custkey GROUP BY 1")
def coverage(t: Tables) -> DataFrame:
    rows = joins.membership(t.orders.withColumn("c_custkey", C("o_custkey")), t.customer.where("c_acctbal > 5000"), "c_custkey", "kept")
    out = rows.groupBy("o_orderpriority").agg(*aggregates.share(C("kept")))
    return out.withColumn("fraction", r("fraction", 9))


@query(f"WITH {VEC}, s AS (SELECT sqrt(x3*x3 + x4*x4 + x5*x5) AS size, abs(x3*x0 + x4*x1 + x5*x2) / sqrt(x0*x0 + x1*x1 + x2*x2) AS radial FROM v), q AS (SELECT size, radial, sqrt(greatest(0, size*size - radial*radial)) AS transverse FROM s) SELECT " + ", ".join([f"round(avg({c}), 6) AS {c}_mean" for c in field.SHIFT_RANKS] + [f"round(quantile_cont({c}, {k / 100}), 6) AS {c}_p{k}" for c, ranks in field.SHIFT_RANKS.items() for k in ranks]) + " FROM q")
def vector_stats(t: Tables) -> DataFrame:
    out = field.shift_statistics(t.vectors, ["x3", "x4", "x5"], XYZ)
    return out.select(*[r(c).alias(c) for c in out.columns])


@query(f"WITH {VEC}, b AS (SELECT (max(x0) - min(x0)) * 1.2 AS b0, (max(x1) - min(x1)) * 1.2 AS b1, (max(x2) - min(x2)) * 1.2 AS b2 FROM v), m AS (SELECT *, CAST(greatest(1, ceil(b0 / 0.05)) AS BIGINT) AS m0, CAST(greatest(1, ceil(b1 / 0.05)) AS BIGINT) AS m1, CAST(greatest(1, ceil(b2 / 0.05)) AS BIGINT) AS m2 FROM b) SELECT round(b0, 6) AS box0, round(b1, 6) AS box1, round(b2, 6) AS box2, m0 AS mesh0, m1 AS mesh1, m2 AS mesh2, m0 * m1 * m2 AS cells, round(m0 * m1 * m2 * 48 / 1073741824.0, 9) AS least_gib, round(3 * (m0 * m1 * m2 * 48 / 1073741824.0), 9) AS recommended_gib FROM m")
def preflight(t: Tables) -> DataFrame:
    out = aggregates.preflight(t.vectors, XYZ, 0.05)
    return out.select(*[r(c, 9 if c.endswith("gib") else 6).alias(c) if c.startswith("box") or c.endswith("gib") else C(c) for c in out.columns])


# --- sets ---


@query("SELECT 'union_all' AS op, count(*) AS n FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier) UNION ALL SELECT 'union', count(*) FROM (SELECT c_nationkey FROM customer WHERE c_nationkey < 15 UNION SELECT s_nationkey FROM supplier WHERE s_nationkey > 9) UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_nationkey FROM customer WHERE c_nationkey < 15 INTERSECT SELECT s_nationkey FROM supplier WHERE s_nationkey > 9) UNION ALL SELECT 'except', count(*) FROM (SELECT c_nationkey FROM customer WHERE c_nationkey < 15 EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey > 9)")
def setops(t: Tables) -> DataFrame:
    c, s = t.customer.select(C("c_nationkey").alias("k")), t.supplier.select(C("s_nationkey").alias("k"))
    a, b = c.where("k < 15"), s.where("k > 9")
    out = None
    for name, df in (("union_all", c.unionByName(s)), ("union", a.union(b).distinct()), ("intersect", a.intersect(b)), ("except", a.subtract(b))):
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# --- windows, order, sampling ---


SEQUENCE = "s AS (SELECT l_suppkey % 12 AS chunk, row_number() OVER (PARTITION BY l_suppkey % 12 ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice) - 1 AS pos, CAST((l_partkey * 977) % 65536 - 32768 AS INTEGER) AS q FROM lineitem)"


def sequence(t: Tables) -> DataFrame:
    order = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
    rows = t.lineitem.select(*order, (C("l_suppkey") % 12).alias("chunk"), ((C("l_partkey") * 977) % 65536 - 32768).cast("int").alias("q"))
    return layout.positions(rows, "chunk", order).select("chunk", "pos", "q")


@query(f"WITH {SEQUENCE} SELECT chunk, pos, q, CAST(((q - coalesce(lag(q) OVER (PARTITION BY chunk ORDER BY pos), 0) + 32768) % 65536 + 65536) % 65536 - 32768 AS INTEGER) AS dq FROM s")
def delta_encode(t: Tables) -> DataFrame:
    return layout.delta_encode(sequence(t), ["q"], "chunk", "pos")


@query(f"WITH {SEQUENCE} SELECT chunk, pos, q AS q_decoded FROM s")
def cumsum_decode(t: Tables) -> DataFrame:
    coded = layout.delta_encode(sequence(t), ["q"], "chunk", "pos").drop("q")
    return layout.delta_decode(coded, ["q"], "chunk", "pos").select("chunk", "pos", "q_decoded")


QUANT = "q AS (SELECT vec_id, CAST(round_even(x0 * 20000, 0) AS BIGINT) AS qx, CAST(round_even(x1 * 20000, 0) AS BIGINT) AS qy, CAST(round_even(x2 * 20000, 0) AS BIGINT) AS qz FROM v)"


def spread_sql(x: str) -> str:
    x = f"((({x} + 32768) >> 6) & 1023)"
    for shift, mask in ((16, 0x30000FF), (8, 0x300F00F), (4, 0x30C30C3), (2, 0x9249249)):
        x = f"(({x} | ({x} << {shift})) & {mask})"
    return x


def quantised(t: Tables) -> DataFrame:
    return t.vectors.select("vec_id", *[sky.quantise_position(C(x), 20000.0).alias(n) for x, n in zip(XYZ, ("qx", "qy", "qz"))])


MORTON_SQL = f"{spread_sql('qx')} | ({spread_sql('qy')} << 1) | ({spread_sql('qz')} << 2)"
CHUNK_SQL = "CAST(abs(17 * qx + 59 * qz + 101 * qy) % 12 AS INTEGER)"


@query(f"WITH {VEC}, {QUANT} SELECT vec_id, {MORTON_SQL} AS morton FROM q")
def morton(t: Tables) -> DataFrame:
    return quantised(t).select("vec_id", sky.morton(C("qx"), C("qy"), C("qz")).alias("morton"))


@query(f"WITH {VEC}, {QUANT}, k AS (SELECT vec_id, {CHUNK_SQL} AS chunk, {MORTON_SQL} AS morton FROM q) SELECT vec_id, chunk, row_number() OVER (PARTITION BY chunk ORDER BY morton, vec_id) - 1 AS pos_in_chunk FROM k")
def hash_chunk(t: Tables) -> DataFrame:
    return layout.ordered_chunks(quantised(t), row="vec_id").select("vec_id", "chunk", C("pos_in_chunk").cast("long").alias("pos_in_chunk"))


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) % 2 = 0 AS is_train FROM orders")
def even_odd(t: Tables) -> DataFrame:
    return layout.even_odd(t.orders.select("o_orderkey"), "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % greatest(1, (SELECT count(*) FROM orders) // 700) = 0")
def stride(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey")
    return layout.stride(rows, "o_orderkey", rows.count(), 700)


@query("SELECT block, min(k) AS low, max(k) AS high, count(*) AS n FROM (SELECT o_orderkey AS k, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS block FROM orders) GROUP BY block")
def blocks(t: Tables) -> DataFrame:
    return layout.key_blocks(t.orders.select(C("o_orderkey").alias("k")), "k", 1000)


@query("SELECT o_orderkey, round(o_totalprice - (SELECT avg(o_totalprice) FROM orders), 4) AS shift FROM orders ORDER BY abs(round(o_totalprice - (SELECT avg(o_totalprice) FROM orders), 4)) DESC, o_orderkey LIMIT 25")
def topk(t: Tables) -> DataFrame:
    mean = t.orders.agg(F.avg("o_totalprice")).first()[0]
    rows = t.orders.select("o_orderkey", r(C("o_totalprice") - mean, 4).alias("shift"))
    return layout.largest(rows, C("shift"), "o_orderkey")


@query("SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|42'), o_orderkey) AS k FROM orders) WHERE k <= 20")
def hash_sample(t: Tables) -> DataFrame:
    return layout.hash_sample(t.orders.select("o_orderpriority", "o_orderkey"), "o_orderpriority", "o_orderkey", 20)


@query("WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS n FROM customer), b AS (SELECT c_acctbal, row_number() OVER (ORDER BY md5(CAST(c_custkey AS VARCHAR) || '|42')) AS n FROM customer) SELECT a.c_custkey, c.c_acctbal, b.c_acctbal AS shuffled_c_acctbal FROM a JOIN b USING (n) JOIN customer c ON a.c_custkey = c.c_custkey")
def shuffle_control(t: Tables) -> DataFrame:
    return layout.shuffled(t.customer, "c_custkey", "c_acctbal")


@query("WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal FROM orders), c AS (SELECT count(*) AS n FROM orders) SELECT ordinal, o_orderkey FROM n WHERE ordinal IN (SELECT CAST(floor(i * (n / 37.0)) AS BIGINT) FROM c, (SELECT unnest(range(37)) AS i))")
def even_picks(t: Tables) -> DataFrame:
    return layout.even_picks(t.orders.select("o_orderkey"), "o_orderkey", 37)


@query("SELECT o_orderkey, CAST(ntile(7) OVER (ORDER BY o_orderkey) AS INTEGER) AS part FROM orders")
def ntile(t: Tables) -> DataFrame:
    return layout.equal_split(t.orders.select("o_orderkey"), "o_orderkey", 7)


# --- distance ---

DIST = "sqrt((a.x0-b.x0)*(a.x0-b.x0) + (a.x1-b.x1)*(a.x1-b.x1) + (a.x2-b.x2)*(a.x2-b.x2))"


def knn_sql(k: int) -> str:
    return f"WITH {VEC}, d AS (SELECT a.vec_id AS q_id, b.vec_id AS p_id, {DIST} AS distance FROM v a, v b WHERE a.vec_id <> b.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY distance, p_id) AS rank FROM d) SELECT q_id, CAST(rank AS INTEGER) AS rank, p_id, round(distance, 9) AS distance FROM k WHERE rank <= {k}"


def knn(t: Tables, k: int) -> DataFrame:
    """All rows against all others: one neighbour more, less the row itself."""
    near = spatial.nearest(t.vectors, t.vectors, "vec_id", XYZ, k + 1).where("q_id <> p_id")
    order = Window.partitionBy("q_id").orderBy("rank")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("distance", r("distance", 9))


@query(knn_sql(1))
def knn1(t: Tables) -> DataFrame:
    return knn(t, 1)


@query(knn_sql(8))
def knn8(t: Tables) -> DataFrame:
    return knn(t, 8)


@query(f"WITH {VEC} SELECT a.vec_id AS a, b.vec_id AS b, round({DIST}, 9) AS distance FROM v a, v b WHERE a.vec_id < b.vec_id AND {DIST} <= 0.05")
def pairs_radius(t: Tables) -> DataFrame:
    return spatial.pairs_within(t.vectors, "vec_id", XYZ, 0.05).withColumn("distance", r("distance", 9))


SUPPORT = f"""{VEC}, rnd AS (SELECT *, (row_number() OVER (ORDER BY vec_id) - 1) % 2 AS half FROM v WHERE label < 6),
h AS (SELECT min({DIST}) AS d FROM rnd a, rnd b WHERE a.half = 1 AND b.half = 0 GROUP BY a.vec_id), p AS (SELECT quantile_cont(d, 0.99) AS radius FROM h)"""


@query(f"WITH {SUPPORT}, n AS (SELECT a.vec_id, min({DIST}) AS d FROM v a, rnd b WHERE a.label >= 6 AND b.half = 0 GROUP BY a.vec_id) SELECT vec_id, round(radius, 9) AS support_radius, d <= radius AS supported FROM n, p")
def support(t: Tables) -> DataFrame:
    v = t.vectors
    return spatial.supported(v.where("label >= 6"), v.where("label < 6"), "vec_id", XYZ).select("vec_id", r("support_radius", 9).alias("support_radius"), "supported")


UNIT = "u AS (SELECT vec_id, label, CAST(cos(radians(x1 * 80)) * cos(radians(x0 * 180)) AS FLOAT)::DOUBLE AS x0, CAST(cos(radians(x1 * 80)) * sin(radians(x0 * 180)) AS FLOAT)::DOUBLE AS x1, CAST(sin(radians(x1 * 80)) AS FLOAT)::DOUBLE AS x2 FROM v)"


@query(f"""WITH {VEC}, {UNIT}, rnd AS (SELECT *, (row_number() OVER (ORDER BY vec_id) - 1) % 2 AS half FROM u WHERE label < 6),
d AS (SELECT a.vec_id, a.label >= 6 AS candidate, {DIST} AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY {DIST}, b.vec_id) AS k FROM (SELECT vec_id, label, x0, x1, x2 FROM u WHERE label >= 6 UNION ALL SELECT vec_id, label, x0, x1, x2 FROM rnd WHERE half = 1) a, rnd b WHERE b.half = 0),
e AS (SELECT vec_id, candidate, min(d) AS nearest, max(CASE WHEN k = 8 THEN d END) AS kth FROM d WHERE k <= 8 GROUP BY 1, 2), p AS (SELECT quantile_cont(nearest, 0.99) AS t1, quantile_cont(kth, 0.99) AS tk FROM e WHERE NOT candidate)
SELECT vec_id, round(nearest, 9) AS nearest, round(kth, 9) AS kth, nearest <= t1 AS near, kth <= tk AS dense, round(degrees(2 * asin(t1 / 2)) * 60, 6) AS near_arcmin, round(degrees(2 * asin(tk / 2)) * 60, 6) AS dense_arcmin FROM e, p WHERE candidate""")
def angular(t: Tables) -> DataFrame:
    u = t.vectors.select("vec_id", "label", *[x.alias(n) for x, n in zip(sky.unit_vector(C("x0") * 180, C("x1") * 80), XYZ)])
    out = spatial.angular_audit(u.where("label >= 6"), u.where("label < 6"), "vec_id", XYZ)
    return out.select("vec_id", r("nearest", 9).alias("nearest"), r("kth", 9).alias("kth"), "near", "dense", r("near_arcmin").alias("near_arcmin"), r("dense_arcmin").alias("dense_arcmin"))


@query(f"WITH {VEC}, f AS (SELECT vec_id, label, greatest(abs(x0), abs(x1)) <= 0.15 AS a, greatest(abs(x1), abs(x2)) <= 0.15 AS b FROM v) SELECT vec_id, CASE WHEN a AND NOT b THEN 'A' WHEN b AND NOT a THEN 'B' END AS region, a AND b AS ambiguous FROM f")
def region_unique(t: Tables) -> DataFrame:
    a, b = F.greatest(F.abs("x0"), F.abs("x1")) <= 0.15, F.greatest(F.abs("x1"), F.abs("x2")) <= 0.15
    return t.vectors.select("vec_id", F.when(a & ~b, "A").when(b & ~a, "B").alias("region"), (a & b).alias("ambiguous"))


def mesh_sql() -> str:
    parts = []
    for i in (0, 1):
        for j in (0, 1):
            for k in (0, 1):
                w = " * ".join(f"(f{n})" if s else f"(1 - f{n})" for n, s in enumerate((i, j, k)))
                parts.append(f"SELECT b0 + {i} AS i, b1 + {j} AS j, b2 + {k} AS k, {w} AS w FROM g")
    return f"WITH {VEC}, a AS (SELECT (x0 + 1) / 0.25 AS a0, (x1 + 1) / 0.25 AS a1, (x2 + 1) / 0.25 AS a2 FROM v), g AS (SELECT CAST(floor(a0) AS BIGINT) AS b0, CAST(floor(a1) AS BIGINT) AS b1, CAST(floor(a2) AS BIGINT) AS b2, a0 - floor(a0) AS f0, a1 - floor(a1) AS f1, a2 - floor(a2) AS f2 FROM a), c AS ({' UNION ALL '.join(parts)}) SELECT i, j, k, round(sum(w), 6) AS value FROM c GROUP BY i, j, k"


@query(mesh_sql())
def mesh_deposit(t: Tables) -> DataFrame:
    return field.deposit(t.vectors.withColumn("one", F.lit(1.0)), XYZ, "one", [-1.0, -1.0, -1.0], 0.25).withColumn("value", r("value"))


@query()
def field_shift(t: Tables) -> DataFrame:
    v = t.vectors.select("vec_id", *[(C(x) * 100 + 500).alias(x) for x in XYZ], F.lit("all").alias("field"), F.lit(1.0).alias("weight"))
    mesh, geometry = field.reconstruct(v.where("vec_id % 2 = 0"), v.where("vec_id % 2 = 1"), XYZ, 5.0, 10.0, 1.5, 0.7)
    return field.shifts_at(v, mesh, geometry, "vec_id", XYZ).select("vec_id", *[F.round(c, 6).alias(c) for c in ("sx", "sy", "sz", "delta_mpc")])


CENTER = "c AS (SELECT x0 AS c0, x1 AS c1, x2 AS c2, sqrt(x0*x0 + x1*x1 + x2*x2) AS cl FROM v WHERE vec_id = 7)"


def region_sql() -> str:
    frame = """n AS (SELECT *, c0/cl AS a0, c1/cl AS a1, c2/cl AS a2 FROM c),
o AS (SELECT *, CASE WHEN abs(a2) <= 0.95 THEN -a1 ELSE a2 END AS r0, CASE WHEN abs(a2) <= 0.95 THEN a0 ELSE 0 END AS r1, CASE WHEN abs(a2) <= 0.95 THEN 0 ELSE -a0 END AS r2 FROM n),
p AS (SELECT *, r0/sqrt(r0*r0+r1*r1+r2*r2) AS u0, r1/sqrt(r0*r0+r1*r1+r2*r2) AS u1, r2/sqrt(r0*r0+r1*r1+r2*r2) AS u2 FROM o),
w AS (SELECT *, a1*u2-a2*u1 AS w0, a2*u0-a0*u2 AS w1, a0*u1-a1*u0 AS w2 FROM p)"""
    dots = lambda x, y, z, s: ", ".join(f"({x}-c0)*{m}0 + ({y}-c1)*{m}1 + ({z}-c2)*{m}2 AS {n}{s}" for m, n in (("u", "u_"), ("w", "v_"), ("a", "w_")))
    return f"""WITH {VEC}, {CENTER}, {frame},
m AS (SELECT vec_id, x0, x1, x2, label * 0.01 - 0.04 AS delta, sqrt(x0*x0+x1*x1+x2*x2) AS rr FROM v),
d AS (SELECT *, x0 + x0/rr*delta AS y0, x1 + x1/rr*delta AS y1, x2 + x2/rr*delta AS y2 FROM m),
l AS (SELECT vec_id, delta, {dots('x0', 'x1', 'x2', '')}, {dots('y0', 'y1', 'y2', '2')} FROM d, w)
SELECT vec_id, round(u_, 9) + 0.0 AS u, round(v_, 9) + 0.0 AS v, round(w_, 9) + 0.0 AS w, round(u_2, 9) + 0.0 AS u2, round(v_2, 9) + 0.0 AS v2, round(w_2, 9) + 0.0 AS w2, abs(u_2) <= 0.15 AND abs(v_2) <= 0.15 AND abs(w_2) <= 0.2 AS retained FROM l WHERE abs(u_) <= 0.15 AND abs(v_) <= 0.15 AND abs(w_) <= 0.2"""


@query(region_sql())
def region_box(t: Tables) -> DataFrame:
    points = t.vectors.withColumn("delta", C("label") * 0.01 - 0.04)
    inside = region.box(points, "vec_id", XYZ, 7, (0.3, 0.3, 0.4))
    return inside.select("vec_id", *[r(c, 9).alias(c) for c in ("u", "v", "w", "u2", "v2", "w2")], "retained")


@query(region_sql())
def region_box_pruned(t: Tables) -> DataFrame:
    folder, ids = fresh_folder(t.spark, "zorder"), fresh_folder(t.spark, "identities")
    zorder.store(t.vectors, folder, XYZ)
    known = t.spark.table(identity.store(t.vectors.select("vec_id", *XYZ), "vec_id", ids))
    inside = region.pruned_box(zorder.Laid(t.spark, folder), known, "vec_id", 7, (0.3, 0.3, 0.4), C("label") * 0.01 - 0.04)
    return inside.select("vec_id", *[r(c, 9).alias(c) for c in ("u", "v", "w", "u2", "v2", "w2")], "retained")


@query("SELECT o_orderkey, o_custkey, c_name, coalesce(c_acctbal, 0) AS c_acctbal FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def identity_join(t: Tables) -> DataFrame:
    rows = identity.store(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", fresh_folder(t.spark, "identities"))
    table = identity.store(t.customer.where("c_acctbal > 0").select(C("c_custkey").alias("o_custkey"), "c_name", "c_acctbal"), "o_custkey", fresh_folder(t.spark, "identities"))
    return joins.with_defaults(t.spark.table(rows), t.spark.table(table), "o_custkey", {"c_name": None, "c_acctbal": 0.0})


# --- scalars ---


NODES = [0.0, 3.0, 5.5, 7.0, 7.5, 7.75]
INTERP = "[" + ", ".join(f"{x}" for x in NODES) + "]"


@query(f"WITH a AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_tax, greatest(0.0, least(5.0, l_discount / 0.02)) AS pos FROM lineitem), k AS (SELECT *, CAST(least(floor(pos), 4) AS INTEGER) AS k FROM a), d AS (SELECT *, {INTERP}[k + 1] + ({INTERP}[k + 2] - {INTERP}[k + 1]) * (pos - k) AS d FROM k) SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(d, 9) + 0.0 AS d, round(d * cos(radians(l_tax * 900)) * cos(radians(l_partkey % 360)), 9) + 0.0 AS x FROM d")
def interp_distance(t: Tables) -> DataFrame:
    d = sky.interpolate(C("l_discount"), 0.0, 0.02, NODES)
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", r(d, 9).alias("d"), r(sky.sky_to_cartesian(C("l_partkey") % 360, C("l_tax") * 900, d)[0], 9).alias("x"))


@query("WITH m AS (SELECT p_partkey, CASE WHEN p_retailprice - 1200 > 0 THEN 22.5 - 2.5 * log10(p_retailprice - 1200) ELSE 'nan'::DOUBLE END AS mag FROM part) SELECT p_partkey, CASE WHEN isnan(mag) THEN NULL ELSE round(mag, 9) END AS mag, CAST(CASE WHEN isnan(mag) THEN 128 ELSE greatest(0, least(255, round_even((mag - 14 + 0.5) * 85, 0))) END AS INTEGER) AS colour FROM m")
def magnitude(t: Tables) -> DataFrame:
    mag = sky.magnitude(C("p_retailprice") - 1200)
    return t.part.select("p_partkey", F.when(~F.isnan(mag), F.round(mag, 9)).alias("mag"), sky.quantise_colour(mag - 14, 85).alias("colour"))


@query("SELECT p_partkey, CAST(0.01::FLOAT + CAST(c AS FLOAT) * CAST((2.5 - 0.01) / 65535 AS FLOAT) AS FLOAT)::DOUBLE AS z, CAST(round_even(CAST(CAST(c AS FLOAT) / 9.7::FLOAT AS FLOAT) * 8.3::FLOAT, 0) AS INTEGER) AS code FROM (SELECT p_partkey, (p_partkey * 7919) % 65536 AS c FROM part)")
def requantise(t: Tables) -> DataFrame:
    c = (C("p_partkey") * 7919) % 65536
    return t.part.select("p_partkey", sky.dequantise_redshift(c, 0.01, 2.5).cast("double").alias("z"), sky.requantise(c, 9.7, 8.3).alias("code"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_tax::FLOAT >= 0.01::FLOAT AND l_tax::FLOAT < 0.05::FLOAT THEN 'low' WHEN l_tax::FLOAT >= 0.05::FLOAT AND l_tax::FLOAT < 0.08::FLOAT THEN 'high' END AS band FROM lineitem")
def interval_f32(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", joins.interval32(C("l_tax"), [("low", 0.01, 0.05), ("high", 0.05, 0.08)]).alias("band"))


@query("SELECT page_id, regexp_extract(url, '^(https?)://([^/]+)', 1) AS scheme, lower(regexp_extract(url, '^(https?)://([^/]+)', 2)) AS host, replace(regexp_extract(url, '^https?://[^/]+/(.*)$', 1), '/', '|') AS path, lpad(CAST(page_id AS VARCHAR), 6, '0') AS number FROM pages")
def url_parts(t: Tables) -> DataFrame:
    host = r"^(https?)://([^/]+)"
    return t.pages.select("page_id", F.regexp_extract("url", host, 1).alias("scheme"), F.lower(F.regexp_extract("url", host, 2)).alias("host"), F.replace(F.regexp_extract("url", r"^https?://[^/]+/(.*)$", 1), F.lit("/"), F.lit("|")).alias("path"), F.lpad(C("page_id").cast("string"), 6, "0").alias("number"))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_props(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, sha256(text) AS digest, lower(lang) AS lang FROM documents")
def digest(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2(C("text").cast("binary"), 256).alias("digest"), F.lower("lang").alias("lang"))


@query("SELECT p_partkey, CASE p_brand WHEN 'Brand#1' THEN 0 ELSE 255 END AS brand, CAST(CASE trim(upper(split_part(p_type, ' ', 1))) WHEN 'PSF' THEN 0 ELSE 255 END AS INTEGER) AS morph FROM part")
def codes(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.when(C("p_brand") == "Brand#1", 0).otherwise(255).alias("brand"), sky.morphology_code(F.upper(F.split("p_type", " ")[0])).alias("morph"))


def component_sql() -> str:
    value = "CASE WHEN c_custkey % 3 = 0 THEN a WHEN c_custkey % 3 = 1 THEN b ELSE a + b END"
    return f"WITH s AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_acctbal END AS a, c_nationkey - 12.0 AS b FROM customer), v AS (SELECT c_custkey, {value} AS applied FROM s), k AS (SELECT *, CAST(round_even(greatest(0.0, least(1.0, abs(applied) / 5000)) * 255, 0) AS BIGINT) AS level FROM v) SELECT c_custkey, applied, CASE WHEN applied > 0 THEN '#' || lpad(lower(to_hex(level)), 2, '0') || '3030' WHEN applied < 0 THEN '#3030' || lpad(lower(to_hex(level)), 2, '0') ELSE '#808080' END AS colour FROM k"


@query(component_sql())
def component(t: Tables) -> DataFrame:
    a, b = F.when(C("c_custkey") % 5 == 0, 0.0).otherwise(C("c_acctbal")), C("c_nationkey") - 12.0
    value = F.when(C("c_custkey") % 3 == 0, sky.applied(a, b, "fog")).when(C("c_custkey") % 3 == 1, sky.applied(a, b, "rsd")).otherwise(sky.applied(a, b, "both"))
    return t.customer.select("c_custkey", value.alias("applied")).select("c_custkey", "applied", sky.colour_code(C("applied"), 5000.0).alias("colour"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, (l_orderkey % 4194304) | ((l_partkey % 1048576) << 22) | ((l_suppkey % 65536) << 42) AS target, CAST(l_suppkey % 65536 AS BIGINT) AS release FROM lineitem")
def pack_id(t: Tables) -> DataFrame:
    target = sky.pack_target(C("l_orderkey") % 4194304, C("l_partkey") % 1048576, C("l_suppkey") % 65536)
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", target.alias("target"), sky.unpack_target(target)[2].alias("release"))


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts(t: Tables) -> DataFrame:
    from skyweave.streaming.match import windowed_counts as counts

    return counts(t.events, "ts", "event_type")
