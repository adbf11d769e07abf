"""Gates that abort a plan: each is one aggregate, checked on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.functions.sky import finite


class GateError(ValueError):
    """A condition on the data doesn't hold."""


def require(ok: bool, what: str) -> None:
    if not ok:
        raise GateError(what)


def exactly_one(df: DataFrame):
    """The only row."""
    rows = df.take(2)
    require(len(rows) == 1, f"{'no row' if not rows else 'more than one row'} where one is due")
    return rows[0]


def unique(df: DataFrame, *keys: str) -> DataFrame:
    twice = df.groupBy(*keys).count().where("count > 1").take(1)
    require(not twice, f"{keys} repeat: {twice}")
    return df


def unique_and_finite(df: DataFrame, key: str, value: str) -> DataFrame:
    bad = df.agg(F.count_if(~finite(F.col(value))).alias("n")).first()["n"]
    require(not bad, f"{bad} values of {value} are not finite")
    return unique(df, key)


def row_count(df: DataFrame, want: int) -> DataFrame:
    n = df.count()
    require(n == want, f"{n} rows; {want} are due")
    return df


def vacant(spark: SparkSession, folder: str) -> None:
    """The folder, wherever its store is, doesn't exist or holds nothing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    require(not store.exists(path) or not len(store.listStatus(path)), f"{folder} isn't empty")


def found(rows: DataFrame, dim: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined with dim, whose keys are unique; a row without a partner aborts."""
    lost = rows.join(unique(dim, *keys), keys, "left_anti").take(1)
    require(not lost, f"out of range: {lost}")
    return rows.join(dim, keys)


def within(df: DataFrame, column: str, cap: float) -> DataFrame:
    """abs(column) is at most cap, and finite."""
    most = df.agg(F.max(F.abs(column)).alias("m"), F.count_if(~finite(F.col(column))).alias("n")).first()
    require(not most["n"] and (most["m"] is None or most["m"] <= cap), f"{column} reaches {most['m']}; the cap is {cap}")
    return df


def coverage(df: DataFrame, hit: Column, least: float = 0.10) -> DataFrame:
    got = df.agg(F.count_if(hit).alias("hits"), F.count("*").alias("n")).first()
    require(got["n"] > 0 and got["hits"] >= least * got["n"], f"{got['hits']} of {got['n']} rows are covered; {least} is the floor")
    return df


def same_keys(left: DataFrame, right: DataFrame, key: str) -> None:
    """Both sides hold the same keys, each once."""
    a, b = (df.groupBy(key).agg(F.count("*").alias(n)) for df, n in ((left, "a"), (right, "b")))
    bad = a.join(b, key, "full_outer").where("a IS NULL OR b IS NULL OR a > 1 OR b > 1").take(1)
    require(not bad, f"sides differ: {bad}")


def not_relaxed(given: dict, floor: dict) -> None:
    """No threshold is weaker than its floor: (name: value), where a positive floor is a minimum and a negative one a maximum."""
    for name, least in floor.items():
        value = given[name]
        require(value >= least if least >= 0 else value <= -least, f"{name} = {value} relaxes {abs(least)}")


def exclusive(**flags: bool) -> None:
    require(sum(map(bool, flags.values())) <= 1, f"only one of {sorted(flags)} may be set")


def digests(found: DataFrame, want: dict[str, str]) -> None:
    """SHA-256 of files (path), by name; they are streamed by tasks, so none is too large."""
    from skyweave.sources import files

    got = {r["name"]: r["sha256"] for r in files.digests(found).collect()}
    bad = sorted(n for n, sha in want.items() if got.get(n) != sha)
    require(not bad, f"digests differ: {bad}")


def sequence_digest(df: DataFrame, group: str, order: list[str], columns: list[str]) -> DataFrame:
    """A digest of the rows of each group in order, to replay an order exactly: group, digest, rows.

    The order's columns are part of each row's hash, so sums of hashes tell any other order; no group is gathered.
    """
    sha = F.sha2(F.to_json(F.struct(*order, *columns)), 256)
    part = lambda k: F.sum(F.conv(F.substring(sha, 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    sums = F.sha2(F.concat_ws(",", *[part(k) for k in range(4)], F.count("*").cast("string")), 256)
    return df.groupBy(group).agg(sums.alias("digest"), F.count("*").alias("rows"))


def untouched(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> None:
    """These columns are the same for every key on both sides."""
    same_keys(before, after, key)
    a, b = before.select(key, *[F.col(c).alias(f"{c}_a") for c in columns]), after.select(key, *[F.col(c).alias(f"{c}_b") for c in columns])
    differ = F.lit(False)
    for c in columns:
        differ = differ | ~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))
    bad = a.join(b, key).where(differ).take(1)
    require(not bad, f"changed: {bad}")
