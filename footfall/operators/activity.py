"""The most active, best paying and fastest growing users.

Every ranking first adds up the log per user, which leaves one row per user and input partition, and
only then joins the user table: a user with very many log rows is no burden to the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.numbers import exact_money, is_unusable_money, money_sum
from footfall.functions.times import shift_days, within

Period = tuple[str, str]
VISIT, PURCHASE = 0, 1
TOP = 10


def log_in_period(log: DataFrame, action_type: int, period: Period) -> DataFrame:
    return log.where((F.col("actionType") == action_type) & within(log, "actionTime", *period))


def unusable_purchases(log: DataFrame, period: Period) -> DataFrame:
    """Purchases whose amount can't be added, such as NaN. The rankings leave these amounts out."""
    return log_in_period(log, PURCHASE, period).where(is_unusable_money(F.col("purchaseMoney")))


def amount_check(log: DataFrame, period: Period) -> DataFrame:
    """How many purchases of each user a ranking by spend counts, and how many it leaves out or rounds.

    ``purchases``, ``unusable`` (their amounts can't be added), ``rounded`` (more than ten digits after the point) and
    ``missing`` (no amount at all). Users of whom nothing is left out are rows too, so the table can be added up.
    """
    money = F.col("purchaseMoney")
    exact = exact_money(money)
    return (
        log_in_period(log, PURCHASE, period)
        .groupBy("userId")
        .agg(
            F.count(F.lit(1)).alias("purchases"),
            F.count_if(is_unusable_money(money)).alias("unusable"),
            F.count_if(exact.isNotNull() & (exact.cast("double") != money)).alias("rounded"),
            F.count_if(money.isNull()).alias("missing"),
        )
    )


def _named(per_user: DataFrame, users: DataFrame, metric: str) -> DataFrame:
    """Add the user name. Groups again, without a shuffle, so that repeated user rows add up."""
    joined = per_user.join(users.select("userId", "username"), "userId")
    return joined.groupBy("userId", "username").agg(F.try_sum(metric).alias(metric))


def _rounded(totals: DataFrame, metric: str) -> DataFrame:
    return totals.withColumn(metric, F.round(metric, 2).cast("double"))


def top_users(totals: DataFrame, metric: str, top: int = TOP) -> DataFrame:
    return totals.orderBy(F.desc(metric), F.asc("userId")).limit(top)


def top_visits(log: DataFrame, users: DataFrame, period: Period, top: int = TOP) -> DataFrame:
    per_user = log_in_period(log, VISIT, period).groupBy("userId").agg(F.count("logId").alias("actionCount"))
    return top_users(_named(per_user, users, "actionCount"), "actionCount", top)


def top_spend(log: DataFrame, users: DataFrame, period: Period, top: int = TOP) -> DataFrame:
    metric = "totalPurchaseMoney"
    per_user = log_in_period(log, PURCHASE, period).groupBy("userId").agg(
        F.try_sum(exact_money(F.col("purchaseMoney"))).alias(metric)
    )
    return top_users(_rounded(_named(per_user, users, metric), metric), metric, top)


def signed_periods(log: DataFrame, action_type: int, current: Period, previous: Period) -> DataFrame:
    """Log rows of both periods: those of the current one count up, those of the previous one down.

    One scan; a row that lies in both periods gives two rows.
    """
    now, before = within(log, "actionTime", *current), within(log, "actionTime", *previous)
    signs = F.array(F.when(now, F.lit(1).cast("bigint")), F.when(before, F.lit(-1).cast("bigint")))
    rows = log.where((F.col("actionType") == action_type) & (now | before))
    signed = rows.select("logId", "userId", "purchaseMoney", F.explode(F.array_compact(signs)).alias("actionValue"))
    return signed.select(
        "logId", "userId", "actionValue", (F.col("purchaseMoney") * F.col("actionValue")).alias("purchaseMoney")
    )


def span_of(current: Period, previous: Period) -> Period:
    """The days from the first of both periods to the last."""
    return min(current[0], previous[0]), max(current[1], previous[1])


def _growth(log: DataFrame, action_type: int, current: Period, previous: Period, value: Column) -> DataFrame:
    """Signed sum per user in one scan of both periods."""
    now, before = within(log, "actionTime", *current), within(log, "actionTime", *previous)
    sign = now.cast("int") - before.cast("int")
    rows = log.where((F.col("actionType") == action_type) & (now | before))
    return rows.groupBy("userId").agg(F.try_sum(value * sign).alias("growth"))


def visit_growth(
    log: DataFrame, users: DataFrame, current: Period, previous: Period, top: int = TOP
) -> DataFrame:
    per_user = _growth(log, VISIT, current, previous, F.lit(1).cast("bigint"))
    totals = _named(per_user, users, "growth").withColumnRenamed("growth", "actionIncr")
    return top_users(totals, "actionIncr", top)


def spend_growth(
    log: DataFrame, users: DataFrame, current: Period, previous: Period, top: int = TOP
) -> DataFrame:
    per_user = _growth(log, PURCHASE, current, previous, exact_money(F.col("purchaseMoney")))
    totals = _rounded(_named(per_user, users, "growth"), "growth")
    return top_users(totals.withColumnRenamed("growth", "purchaseMoneyIncr"), "purchaseMoneyIncr", top)


def first_days_span(registered: Period, days: int = 7) -> Period:
    """The days in which the first ``days`` days of users registered in a period can fall."""
    return registered[0], shift_days(registered[1], days - 1)


def first_days_log(
    log: DataFrame, users: DataFrame, action_type: int, registered: Period, days: int = 7
) -> DataFrame:
    """Log rows of the registration day, from the registration on, and of the days after it.

    The registration range bounds the action times too, so the log scan reads that span only. The
    join is on the user, with the time condition inside it.
    """
    rows = log_in_period(log, action_type, first_days_span(registered, days)).alias("log")
    newcomers = users.where(within(users, "registTime", *registered)).alias("newcomer")
    opened = F.to_date("newcomer.registTime")
    started = F.col("log.actionTime") >= F.col("newcomer.registTime")
    ended = F.to_date("log.actionTime") >= F.date_add(opened, days)
    same_user = F.col("log.userId") == F.col("newcomer.userId")
    return rows.join(newcomers, same_user & started & ~ended).select(
        "newcomer.userId", "newcomer.username", "log.logId", "log.purchaseMoney"
    )


def first_days_visits(
    log: DataFrame, users: DataFrame, registered: Period, days: int = 7, top: int = TOP
) -> DataFrame:
    rows = first_days_log(log, users, VISIT, registered, days)
    totals = rows.groupBy("userId", "username").agg(F.count("logId").alias("actionCount"))
    return top_users(totals, "actionCount", top)


def first_days_spend(
    log: DataFrame, users: DataFrame, registered: Period, days: int = 7, top: int = TOP
) -> DataFrame:
    rows = first_days_log(log, users, PURCHASE, registered, days)
    totals = rows.groupBy("userId", "username").agg(
        money_sum(F.col("purchaseMoney")).alias("purchaseMoneyTotal")
    )
    return top_users(totals, "purchaseMoneyTotal", top)
