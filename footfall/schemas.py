"""Explicit schemas of the input tables. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_L, _I, _S, _D = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType()
_TS, _NTZ, _DATE = T.TimestampType(), T.TimestampNTZType(), T.DateType()

USER_VISIT_ACTION = _struct(
    ("date", _DATE),
    ("user_id", _L),
    ("session_id", _S),
    ("page_id", _L),
    ("action_time", _NTZ),
    ("search_keyword", _S),
    ("click_category_id", _L),
    ("click_product_id", _L),
    ("order_category_ids", _S),
    ("order_product_ids", _S),
    ("pay_category_ids", _S),
    ("pay_product_ids", _S),
    ("city_id", _L),
)

# The same table as text loggers deliver it: times and dates are still strings.
USER_VISIT_ACTION_RAW = T.StructType(
    [
        T.StructField(f.name, _S if f.name in ("date", "action_time") else f.dataType, True)
        for f in USER_VISIT_ACTION.fields
    ]
)

USER_INFO = _struct(
    ("user_id", _L),
    ("username", _S),
    ("name", _S),
    ("age", _I),
    ("professional", _S),
    ("city", _S),
    ("sex", _S),
)
CITY_INFO = _struct(("city_id", _L), ("city_name", _S), ("area", _S))
PRODUCT_INFO = _struct(("id", _L), ("product_name", _S), ("info", _S))

USER_BASE_INFO_JSON = _struct(("userId", _L), ("username", _S), ("registTime", _S))
USER_ACTION_LOG_JSON = _struct(
    ("logId", _L), ("userId", _L), ("actionTime", _S), ("actionType", _L), ("purchaseMoney", _D)
)

AD_CLICK = _struct(("ts", _TS), ("province", _S), ("city", _S), ("user_id", _L), ("ad_id", _L))
AD_BLACKLIST = _struct(("user_id", _L))

TASK = _struct(
    ("task_id", _L),
    ("task_name", _S),
    ("create_time", _S),
    ("start_time", _S),
    ("finish_time", _S),
    ("task_type", _S),
    ("task_status", _S),
    ("task_param", _S),
)
# Parameter values arrive as JSON strings or numbers; strings accept both.
TASK_PARAM = _struct(
    ("startDate", _S),
    ("endDate", _S),
    ("startAge", _S),
    ("endAge", _S),
    ("professionals", _S),
    ("cities", _S),
    ("sex", _S),
    ("keywords", _S),
    ("categoryIds", _S),
    ("targetPageFlow", _S),
    ("cycle", _S),
)
