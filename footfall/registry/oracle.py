"""The registered questions as plain SQL, written without looking at how the queries compute them."""

from __future__ import annotations

from footfall.registry import settings as S

# --- the behaviour tables over the star schema

_VIEWS = {
    "v_ev": """
        SELECT event_id, ts, user_id, event_type, value,
               CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k
        FROM events""",
    "user_visit_action": """
        SELECT CAST(ts AS DATE) AS date, user_id,
               concat('s_', user_id, '_', CAST(ts AS DATE)) AS session_id, k % 10 AS page_id,
               date_trunc('second', ts) AS action_time,
               CASE WHEN event_type = 'view' THEN concat('kw', k % 12) END AS search_keyword,
               CASE WHEN event_type = 'click' THEN k END AS click_category_id,
               CASE WHEN event_type = 'click' THEN event_id % 200 END AS click_product_id,
               CASE WHEN event_type = 'signup' THEN concat(k, ',', (k + 1) % 100) END AS order_category_ids,
               CASE WHEN event_type = 'signup' THEN CAST(event_id % 200 AS VARCHAR) END AS order_product_ids,
               CASE WHEN event_type = 'purchase' THEN CAST(k AS VARCHAR) END AS pay_category_ids,
               CASE WHEN event_type = 'purchase' THEN CAST(event_id % 200 AS VARCHAR) END AS pay_product_ids,
               user_id % 25 AS city_id
        FROM v_ev""",
    "user_info": """
        SELECT c_custkey AS user_id, c_name AS username, c_name AS name,
               CAST(18 + c_custkey % 50 AS INTEGER) AS age, c_mktsegment AS professional, n_name AS city,
               CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS sex
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "city_info": """
        SELECT CAST(n_nationkey AS BIGINT) AS city_id, n_name AS city_name, r_name AS area
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "product_info": """
        SELECT p_partkey AS id, p_name AS product_name,
               concat('{"product_status":', p_size % 2, '}') AS info
        FROM part""",
    "user_base_info": """
        SELECT c_custkey AS userId, c_name AS username,
               DATE '2024-01-01' + CAST(c_custkey % 20 AS INTEGER) + INTERVAL '6' HOUR AS registTime
        FROM customer""",
    "user_action_log": """
        SELECT event_id AS logId, user_id AS userId, date_trunc('second', ts) AS actionTime,
               CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS actionType,
               CASE WHEN event_type = 'purchase' THEN value ELSE 0.0 END AS purchaseMoney
        FROM v_ev""",
    "ad_click_log": """
        SELECT ts, CAST(ts AS DATE) AS date, area AS province, city_name AS city, user_id, k % 10 AS ad_id
        FROM v_ev JOIN city_info ON user_id % 25 = city_id WHERE event_type IN ('click', 'view')""",
    # --- steps that several questions share
    "actions": f"""
        SELECT * FROM user_visit_action
        WHERE action_time >= TIMESTAMP '{S.START}' AND action_time < DATE '{S.END}' + INTERVAL '1' DAY""",
    "rollup": """
        SELECT a.session_id, a.user_id, search_keywords, click_category_ids, visit_length, step_length,
               start_time, age, professional, city, sex, words, cats
        FROM (SELECT session_id, arg_min(user_id, (action_time, user_id)) AS user_id,
                     string_agg(DISTINCT search_keyword, ',' ORDER BY search_keyword) AS search_keywords,
                     array_to_string(list_sort(list(DISTINCT click_category_id)
                         FILTER (click_category_id IS NOT NULL)), ',') AS click_category_ids,
                     list(DISTINCT search_keyword) FILTER (search_keyword IS NOT NULL) AS words,
                     list(DISTINCT click_category_id) FILTER (click_category_id IS NOT NULL) AS cats,
                     date_diff('second', min(action_time), max(action_time)) AS visit_length,
                     count(*) AS step_length, min(action_time) AS start_time
              FROM actions GROUP BY session_id) a
        JOIN user_info u ON a.user_id = u.user_id""",
    "clicks": """
        SELECT city_id, click_product_id AS product_id FROM actions WHERE click_product_id IS NOT NULL""",
    "area_counts": """
        SELECT area, product_id, count(*) AS click_count,
               string_agg(DISTINCT concat(city_id, ':', city_name), ',' ORDER BY concat(city_id, ':', city_name))
                   AS city_infos
        FROM clicks JOIN city_info USING (city_id) GROUP BY area, product_id""",
    "touches": """
        SELECT 'click' AS kind, click_category_id AS category_id FROM actions
        WHERE click_category_id IS NOT NULL
        UNION ALL
        SELECT 'order', CAST(unnest(string_split(order_category_ids, ',')) AS BIGINT) FROM actions
        WHERE order_category_ids IS NOT NULL
        UNION ALL
        SELECT 'pay', CAST(unnest(string_split(pay_category_ids, ',')) AS BIGINT) FROM actions
        WHERE pay_category_ids IS NOT NULL""",
    "counts": """
        SELECT category_id, count(*) FILTER (kind = 'click') AS click_count,
               count(*) FILTER (kind = 'order') AS order_count, count(*) FILTER (kind = 'pay') AS pay_count
        FROM touches GROUP BY category_id""",
    "pairs": """
        SELECT session_id, page_id AS from_page,
               lead(page_id) OVER (PARTITION BY session_id ORDER BY action_time, page_id) AS to_page
        FROM actions""",
    "user_counts": """
        SELECT date, user_id, ad_id, count(*) AS click_count FROM ad_click_log GROUP BY date, user_id, ad_id""",
    "blacklist": f"""
        SELECT DISTINCT user_id FROM user_counts WHERE click_count >= {S.BLACKLIST_THRESHOLD}""",
    "stat": """
        SELECT date, province, city, ad_id, count(*) AS click_count FROM ad_click_log
        GROUP BY date, province, city, ad_id""",
    "sliced": f"""
        SELECT *, date_diff('day', min(date) OVER (), date) // {S.REPLAY_DAYS} AS slice FROM ad_click_log""",
    "listed": f"""
        SELECT user_id, min(slice) AS slice
        FROM (SELECT slice, user_id FROM sliced GROUP BY slice, date, user_id, ad_id
              HAVING count(*) >= {S.BLACKLIST_THRESHOLD})
        GROUP BY user_id""",
    "clean": """
        SELECT c.ts, c.date, c.province, c.city, c.user_id, c.ad_id
        FROM sliced c LEFT JOIN listed l ON c.user_id = l.user_id
        WHERE l.slice IS NULL OR c.slice <= l.slice""",
    "province_stat": """
        SELECT date, province, ad_id, CAST(sum(click_count) AS BIGINT) AS click_count FROM stat
        GROUP BY date, province, ad_id""",
}

_NEEDS = {
    "user_visit_action": ["v_ev"],
    "user_action_log": ["v_ev"],
    "ad_click_log": ["v_ev", "city_info"],
    "actions": ["user_visit_action"],
    "rollup": ["actions", "user_info"],
    "clicks": ["actions"],
    "area_counts": ["clicks", "city_info"],
    "touches": ["actions"],
    "counts": ["touches"],
    "pairs": ["actions"],
    "user_counts": ["ad_click_log"],
    "blacklist": ["user_counts"],
    "stat": ["ad_click_log"],
    "province_stat": ["stat"],
    "sliced": ["ad_click_log"],
    "listed": ["sliced"],
    "clean": ["sliced", "listed"],
    "filtered": ["rollup"],
    "filtered_actions": ["actions", "filtered"],
    "sample": ["rollup"],
    "filtered_sample": ["filtered"],
    "rates": ["pairs", "actions"],
    "top_cats": ["filtered_actions"],
    "top_sess": ["top_cats", "filtered_actions"],
}


def _texts(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


_ALL = S.ALL_FILTERS
_VIEWS["filtered"] = f"""
        SELECT * FROM rollup
        WHERE age BETWEEN {_ALL.start_age} AND {_ALL.end_age} AND professional IN ({_texts(_ALL.professionals)})
          AND sex = '{_ALL.sex}' AND list_has_any(words, [{_texts(_ALL.keywords)}])"""
_VIEWS["filtered_actions"] = """
        SELECT * FROM actions WHERE session_id IN (SELECT session_id FROM filtered)"""
_VIEWS["sample"] = f"""
        SELECT session_id, start_time, search_keywords, click_category_ids
        FROM (SELECT *, row_number() OVER (PARTITION BY date_hour ORDER BY md5(concat(session_id, '{S.SEED}')), session_id)
                     AS draw,
                     (count(*) OVER (PARTITION BY date_hour)) * {S.SAMPLE_SIZE} // (count(*) OVER ()) AS quota
              FROM (SELECT *, strftime(start_time, '%Y-%m-%d_%H') AS date_hour FROM rollup))
        WHERE draw <= quota"""
_VIEWS["filtered_sample"] = _VIEWS["sample"].replace("FROM rollup", "FROM filtered")
_VIEWS["top_cats"] = """
        SELECT category_id, count(*) FILTER (kind = 'click') AS click_count,
               count(*) FILTER (kind = 'order') AS order_count, count(*) FILTER (kind = 'pay') AS pay_count
        FROM (SELECT 'click' AS kind, click_category_id AS category_id FROM filtered_actions
              WHERE click_category_id IS NOT NULL
              UNION ALL
              SELECT 'order', CAST(unnest(string_split(order_category_ids, ',')) AS BIGINT) FROM filtered_actions
              UNION ALL
              SELECT 'pay', CAST(unnest(string_split(pay_category_ids, ',')) AS BIGINT) FROM filtered_actions)
        GROUP BY category_id
        ORDER BY click_count DESC, order_count DESC, pay_count DESC, category_id LIMIT 10"""
_VIEWS["top_sess"] = """
        SELECT category_id, session_id, click_count
        FROM (SELECT *, row_number() OVER (PARTITION BY category_id ORDER BY click_count DESC, session_id) AS r
              FROM (SELECT click_category_id AS category_id, session_id, count(*) AS click_count
                    FROM filtered_actions
                    WHERE click_category_id IN (SELECT category_id FROM top_cats)
                    GROUP BY 1, 2))
        WHERE r <= 10"""


def _share(part: str, total: str) -> str:
    """Exact half-up rounding to two digits, in integers."""
    return f"((200 * {part} + {total}) // (2 * {total})) / 100.0"


_STEPS = [(i + 1, a, b) for i, (a, b) in enumerate(zip(S.FLOW, S.FLOW[1:]))]
_VIEWS["rates"] = (
    "SELECT step, page_split, pv, prev_pv,"
    f" CASE WHEN prev_pv > 0 THEN CAST({_share('pv', 'prev_pv')} AS DOUBLE) END AS convert_rate"
    " FROM (SELECT step, page_split, pv, coalesce(lag(pv) OVER (ORDER BY step),"
    f" (SELECT count(*) FROM actions WHERE page_id = {S.FLOW[0]})) AS prev_pv FROM ("
    + " UNION ALL ".join(
        f"SELECT {i} AS step, '{a}_{b}' AS page_split,"
        f" (SELECT count(*) FROM pairs WHERE from_page = {a} AND to_page = {b}) AS pv"
        for i, a, b in _STEPS
    )
    + "))"
)


def _with(body: str, *names: str) -> str:
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    ctes = ",\n".join(f"{name} AS ({_VIEWS[name]})" for name in ordered)
    return f"WITH {ctes}\n{body}"


_ROLLUP = (
    "session_id, user_id, search_keywords, click_category_ids, visit_length, step_length, start_time,"
    " age, professional, city, sex"
)
_LENGTHS = [
    ("1s_3s", "BETWEEN 1 AND 3"),
    ("4s_6s", "BETWEEN 4 AND 6"),
    ("7s_9s", "BETWEEN 7 AND 9"),
    ("10s_30s", "BETWEEN 10 AND 30"),
    ("30s_60s", "BETWEEN 31 AND 60"),
    ("1m_3m", "BETWEEN 61 AND 180"),
    ("3m_10m", "BETWEEN 181 AND 600"),
    ("10m_30m", "BETWEEN 601 AND 1800"),
    ("30m", "> 1800"),
]
_DEPTHS = [
    ("1_3", "BETWEEN 1 AND 3"),
    ("4_6", "BETWEEN 4 AND 6"),
    ("7_9", "BETWEEN 7 AND 9"),
    ("10_30", "BETWEEN 10 AND 30"),
    ("30_60", "BETWEEN 31 AND 60"),
    ("60", "> 60"),
]
_BUCKETS = [(f"visit_length {c}", n) for n, c in _LENGTHS] + [(f"step_length {c}", n) for n, c in _DEPTHS]


def _bucket_counts() -> str:
    return ", ".join(f"count(*) FILTER ({c}) AS \"{n}\"" for c, n in _BUCKETS)


def _bucket_shares() -> str:
    shares = (
        f"CAST({_share(f'count(*) FILTER ({c})', 'count(*)')} AS DOUBLE) AS \"{n}\"" for c, n in _BUCKETS
    )
    return ", ".join(shares)


def _label(column: str, ranges) -> str:
    return "CASE " + " ".join(f"WHEN {column} {c} THEN '{n}'" for n, c in ranges) + " END"


def _period(column: str, period) -> str:
    return f"{column} >= TIMESTAMP '{period[0]}' AND {column} < DATE '{period[1]}' + INTERVAL '1' DAY"


def _top_users(metric: str, value: str, where: str) -> str:
    return _with(
        f"SELECT u.userId, u.username, {value} AS {metric} FROM user_action_log l"
        f" JOIN user_base_info u ON l.userId = u.userId WHERE {where}"
        f" GROUP BY u.userId, u.username ORDER BY {metric} DESC, u.userId LIMIT 10",
        "user_action_log",
        "user_base_info",
    )


_RANGE = (S.START, S.END)
_MONEY = "CAST(round(sum(CAST(purchaseMoney AS DECIMAL(38,10)){sign}), 2) AS DOUBLE)"
_SIGN = f"(CASE WHEN {_period('actionTime', S.CURRENT_PERIOD)} THEN 1 ELSE -1 END)"
_EITHER = f"(({_period('actionTime', S.CURRENT_PERIOD)}) OR ({_period('actionTime', S.PREVIOUS_PERIOD)}))"
_FIRST_DAYS = (
    f"{_period('registTime', S.REGISTERED)} AND actionTime >= registTime"
    " AND actionTime < CAST(registTime AS DATE) + INTERVAL '7' DAY"
)
_LOG_LINE = """
    CASE WHEN event_id % 4 <> 3 THEN
    concat('{"logId": ', CASE WHEN event_id % 4 = 0 THEN '0' ELSE '' END, event_id, ',"userId": ', user_id,
           ', "actionTime": "', CASE WHEN event_id % 4 = 1 THEN 'bad' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END,
           '", "actionType": ',
           CASE WHEN event_type = 'purchase' THEN '1' ELSE '0' END, ', "purchaseMoney": ',
           CASE WHEN event_type = 'purchase' THEN CAST(value AS VARCHAR) ELSE '0.0' END, '}') END"""

_OWN, _OTHER = "自营商品", "第三方商品"
_STATUS = (
    f"CASE WHEN json_extract_string(info, '$.product_status') = '0' THEN '{_OWN}' ELSE '{_OTHER}' END"
)
_PROVINCE_TOP3 = """
    SELECT date, province, ad_id, click_count
    FROM (SELECT *, row_number() OVER (PARTITION BY date, province ORDER BY click_count DESC, ad_id) AS r
          FROM province_stat)
    WHERE r <= 3"""
_SLIDING = """
    SELECT window_start, window_start + INTERVAL '60' MINUTE AS window_end, ad_id, count(*) AS click_count
    FROM (SELECT ad_id, time_bucket(INTERVAL '10' MINUTE, ts) - to_minutes(10 * CAST(unnest(range(6)) AS INTEGER))
              AS window_start FROM ad_click_log) GROUP BY 1, 3"""
_TREND = """
    SELECT date, strftime(ts, '%H') AS hour, strftime(ts, '%M') AS minute, ad_id, count(*) AS click_count
    FROM ad_click_log GROUP BY 1, 2, 3, 4"""
_AREA_TOP3 = _with(
    "SELECT area, CASE WHEN area IN ('ASIA', 'EUROPE') THEN 'A级地区'"
    " WHEN area IN ('AMERICA', 'AFRICA') THEN 'B级地区' ELSE 'E级地区' END AS area_level,"
    f" product_id, click_count, city_infos, product_name, {_STATUS} AS product_status"
    " FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY click_count DESC, product_id) AS r"
    " FROM area_counts JOIN product_info ON product_id = id) WHERE r <= 3",
    "area_counts",
    "product_info",
)
_BAD_LOG_LINES = (
    "SELECT CASE event_id % 5"
    " WHEN 0 THEN concat_ws(' ', epoch_us(ts) // 1000, concat('province', user_id % 5), concat('city', user_id % 25), user_id)"
    " WHEN 1 THEN concat_ws(' ', epoch_us(ts) // 1000, concat('province', user_id % 5), concat('city', user_id % 25),"
    " concat('u', user_id), k % 10)"
    " WHEN 2 THEN concat_ws(' ', '99999999999999999 province1 city1', user_id, k % 10)"
    " WHEN 3 THEN concat_ws(' ', epoch_us(ts) // 1000, concat('province', user_id % 5), concat('city', user_id % 25),"
    " user_id, k % 10, 1)"
    " ELSE '' END AS line FROM v_ev WHERE event_type = 'error'"
)
_DETAIL = (
    "user_id, session_id, page_id, action_time, search_keyword, click_category_id, click_product_id,"
    " order_category_ids, order_product_ids, pay_category_ids, pay_product_ids"
)
_TASK_TABLES = {
    "session_aggr_stat": f"SELECT count(*) AS session_count, {_bucket_shares()} FROM filtered HAVING count(*) > 0",
    "session_random_extract": "SELECT * FROM filtered_sample",
    "session_detail": f"SELECT {_DETAIL} FROM actions WHERE session_id IN (SELECT session_id FROM filtered_sample)",
    "top10_category": "SELECT * FROM top_cats",
    "top10_category_session": "SELECT * FROM top_sess",
    "top10_session_detail": f"SELECT {_DETAIL} FROM actions WHERE session_id IN (SELECT session_id FROM top_sess)",
}

ORACLE: dict[str, str] = {
    "action_scan": _with("SELECT * FROM actions", "actions"),
    "click_scan": _with("SELECT * FROM clicks", "clicks"),
    "session_rollup": _with(f"SELECT {_ROLLUP} FROM rollup", "rollup"),
    "session_filter_age": _with(
        f"SELECT {_ROLLUP} FROM rollup WHERE age BETWEEN {S.AGES[0]} AND {S.AGES[1]}", "rollup"
    ),
    "session_filter_in_list": _with(
        f"SELECT {_ROLLUP} FROM rollup WHERE professional IN ({_texts(S.PROFESSIONALS)})"
        f" AND city IN ({_texts(S.CITIES)})",
        "rollup",
    ),
    "session_filter_sex": _with(f"SELECT {_ROLLUP} FROM rollup WHERE sex = '{S.SEX}'", "rollup"),
    "session_filter_keywords": _with(
        f"SELECT {_ROLLUP} FROM rollup WHERE list_has_any(words, [{_texts(S.KEYWORDS)}])", "rollup"
    ),
    "session_filter_categories": _with(
        f"SELECT {_ROLLUP} FROM rollup WHERE list_has_any(cats, {list(S.CATEGORIES)}::BIGINT[])", "rollup"
    ),
    "session_filter_all": _with(f"SELECT {_ROLLUP} FROM filtered", "filtered"),
    "session_spans": _with(
        "SELECT session_id, user_id, start_time, visit_length, step_length FROM filtered", "filtered"
    ),
    "session_bucket_counts": _with(
        f"SELECT count(*) AS session_count, {_bucket_counts()} FROM rollup", "rollup"
    ),
    "session_histogram": _with(
        f"SELECT count(*) AS session_count, {_bucket_shares()} FROM filtered HAVING count(*) > 0", "filtered"
    ),
    "session_bucket_labels": _with(
        f"SELECT {_label('visit_length', _LENGTHS)} AS length_bucket,"
        f" {_label('step_length', _DEPTHS)} AS step_bucket, count(*) AS session_count FROM rollup GROUP BY 1, 2",
        "rollup",
    ),
    "session_hour_quota": _with(
        "SELECT date_hour, n AS session_count, total,"
        f" least(n * {S.SAMPLE_SIZE} // total, n) AS quota FROM ("
        "SELECT date_hour, n, CAST(sum(n) OVER () AS BIGINT) AS total FROM ("
        "SELECT strftime(start_time, '%Y-%m-%d_%H') AS date_hour, count(*) AS n FROM rollup GROUP BY 1))",
        "rollup",
    ),
    "session_sample": _with("SELECT * FROM sample", "sample"),
    "session_sample_detail": _with(
        "SELECT * FROM actions WHERE session_id IN (SELECT session_id FROM sample)", "actions", "sample"
    ),
    "category_counts": _with("SELECT * FROM counts", "counts"),
    "category_counts_left_join": _with("SELECT * FROM counts", "counts"),
    "category_touches": _with("SELECT * FROM touches", "touches"),
    "filtered_action_count": _with("SELECT count(*) AS action_count FROM filtered_actions", "filtered_actions"),
    "top10_category": _with("SELECT * FROM top_cats", "top_cats"),
    "top10_session_per_category": _with("SELECT * FROM top_sess", "top_sess"),
    "top10_session_detail": _with(
        "SELECT * FROM actions WHERE session_id IN (SELECT session_id FROM top_sess)", "top_sess"
    ),
    "page_pairs": _with(
        "SELECT from_page, to_page, count(*) AS pv FROM pairs WHERE "
        + " OR ".join(f"(from_page = {a} AND to_page = {b})" for _, a, b in _STEPS)
        + " GROUP BY 1, 2",
        "pairs",
    ),
    "page_pairs_all": _with(
        "SELECT from_page, to_page, count(*) AS pv FROM pairs WHERE to_page IS NOT NULL GROUP BY 1, 2", "pairs"
    ),
    "start_page_pv": _with(f"SELECT count(*) AS pv FROM actions WHERE page_id = {S.FLOW[0]}", "actions"),
    "page_convert_rate": _with("SELECT * FROM rates", "rates"),
    "page_convert_packed": _with(
        "SELECT string_agg(concat(page_split, '=', convert_rate), '|' ORDER BY step) AS convert_rate FROM rates",
        "rates",
    ),
    "page_convert_json": _with(
        "SELECT concat('[{', string_agg(concat('\"', page_split, '\":', convert_rate), ',' ORDER BY step), '}]')"
        " AS result FROM rates",
        "rates",
    ),
    "area_click_basic": _with(
        "SELECT city_id, city_name, area, product_id FROM clicks JOIN city_info USING (city_id)",
        "clicks",
        "city_info",
    ),
    "area_product_counts": _with("SELECT * FROM area_counts", "area_counts"),
    "area_product_counts_salted": _with("SELECT * FROM area_counts", "area_counts"),
    "area_product_info": _with(
        "SELECT a.*, product_name, info FROM area_counts a JOIN product_info ON product_id = id",
        "area_counts",
        "product_info",
    ),
    "area_top3_product": _AREA_TOP3,
    "active_top10_visits": _top_users(
        "actionCount", "count(logId)", f"{_period('actionTime', _RANGE)} AND actionType = 0"
    ),
    "active_top10_spend": _top_users(
        "totalPurchaseMoney", _MONEY.format(sign=""), f"{_period('actionTime', _RANGE)} AND actionType = 1"
    ),
    "active_growth_visits": _top_users(
        "actionIncr", f"CAST(sum({_SIGN}) AS BIGINT)", f"{_EITHER} AND actionType = 0"
    ),
    "active_growth_spend": _top_users(
        "purchaseMoneyIncr", _MONEY.format(sign=f" * {_SIGN}"), f"{_EITHER} AND actionType = 1"
    ),
    "period_union": _with(
        f"SELECT logId, userId, CAST({_SIGN} AS BIGINT) AS actionValue, purchaseMoney * {_SIGN} AS purchaseMoney"
        f" FROM user_action_log WHERE {_EITHER} AND actionType = 1",
        "user_action_log",
    ),
    "first7d_log": _with(
        "SELECT u.userId, u.username, logId, purchaseMoney FROM user_action_log l"
        f" JOIN user_base_info u ON l.userId = u.userId WHERE {_FIRST_DAYS} AND actionType = 0",
        "user_action_log",
        "user_base_info",
    ),
    "first7d_visits": _top_users("actionCount", "count(logId)", f"{_FIRST_DAYS} AND actionType = 0"),
    "purchase_amount_check": _with(
        "SELECT userId, count(*) AS purchases,"
        " count(*) FILTER (m IS NOT NULL AND TRY_CAST(m AS DECIMAL(38,10)) IS NULL) AS unusable,"
        " count(*) FILTER (CAST(TRY_CAST(m AS DECIMAL(38,10)) AS DOUBLE) <> m) AS rounded,"
        " count(*) FILTER (m IS NULL) AS missing"
        " FROM (SELECT userId, CASE WHEN logId % 7 = 0 THEN purchaseMoney * 1e30 WHEN logId % 7 = 1 THEN NULL"
        " WHEN logId % 7 = 2 THEN purchaseMoney / 3 ELSE purchaseMoney END AS m FROM user_action_log"
        f" WHERE actionType = 1 AND {_period('actionTime', _RANGE)}) GROUP BY userId",
        "user_action_log",
    ),
    "first7d_spend": _top_users(
        "purchaseMoneyTotal", _MONEY.format(sign=""), f"{_FIRST_DAYS} AND actionType = 1"
    ),
    "ad_log_parse": _with(
        "SELECT date_trunc('millisecond', ts) AS ts, concat('province', user_id % 5) AS province,"
        " concat('city', user_id % 25) AS city, user_id, k % 10 AS ad_id"
        " FROM v_ev WHERE event_type IN ('click', 'view')",
        "v_ev",
    ),
    "ad_log_quarantine": _with(_BAD_LOG_LINES, "v_ev"),
    "ad_user_daily_counts": _with("SELECT * FROM user_counts", "user_counts"),
    "ad_blacklist": _with("SELECT * FROM blacklist", "blacklist"),
    "ad_blacklist_filter": _with(
        "SELECT ts, province, city, user_id, ad_id FROM ad_click_log"
        " WHERE user_id NOT IN (SELECT user_id FROM blacklist)",
        "blacklist",
    ),
    "ad_count_lookup": _with(
        "SELECT * FROM user_counts WHERE (date, user_id, ad_id) IN"
        " (SELECT (CAST(ts AS DATE), user_id, k % 10) FROM v_ev WHERE event_type = 'purchase')",
        "user_counts",
    ),
    "ad_stat": _with("SELECT * FROM stat", "stat"),
    "ad_province_rollup": _with("SELECT * FROM province_stat", "province_stat"),
    "ad_province_top3": _with(_PROVINCE_TOP3, "province_stat"),
    "ad_click_trend": _with(_TREND, "ad_click_log"),
    "ad_sliding_hour": _with(_SLIDING, "ad_click_log"),
    "stream_user_counts": _with("SELECT * FROM user_counts", "user_counts"),
    "stream_blacklist": _with("SELECT * FROM blacklist", "blacklist"),
    "stream_ad_stat": _with("SELECT * FROM stat", "stat"),
    "stream_province_top3": _with(_PROVINCE_TOP3, "province_stat"),
    "stream_click_trend": _with(_TREND, "ad_click_log"),
    "stream_sliding_hour": _with(_SLIDING, "ad_click_log"),
    "stream_clean_clicks": _with("SELECT ts, province, city, user_id, ad_id FROM clean", "clean"),
    "stream_blacklist_by_day": _with(
        "SELECT date, user_id, ad_id, count(*) AS click_count FROM clean GROUP BY date, user_id, ad_id", "clean"
    ),
    "area_product_counts_hot_keys": _with("SELECT * FROM area_counts", "area_counts"),
    "area_top3_sql": _AREA_TOP3,
    "task_area_products": f"SELECT *, CAST(7 AS INTEGER) AS task_id FROM ({_AREA_TOP3})",
    "task_session_results": _with(
        " UNION ALL BY NAME ".join(
            f"SELECT *, CAST(1 AS INTEGER) AS task_id, '{name}' AS result FROM ({sql})" for name, sql in _TASK_TABLES.items()
        ),
        "filtered", "filtered_sample", "actions", "top_cats", "top_sess",
    ),
    "observed_action_counts": _with(
        "SELECT 'actions' AS counted, count(*) AS row_count FROM actions UNION ALL SELECT 'sessions', count(*) FROM filtered"
        + "".join(f" UNION ALL SELECT '{name}', count(*) FROM ({sql})" for name, sql in _TASK_TABLES.items()),
        "filtered", "filtered_sample", "actions", "top_cats", "top_sess",
    ),
    "ad_count_point_lookup": _with(
        "SELECT * FROM user_counts WHERE user_id IN (SELECT user_id FROM user_counts GROUP BY user_id"
        f" ORDER BY sum(click_count) DESC, user_id LIMIT {S.LOOKED_UP})",
        "user_counts",
    ),
    "session_bucketed_detail": _with(
        "SELECT * FROM actions WHERE session_id IN (SELECT session_id FROM sample)", "actions", "sample"
    ),
    "stream_log_clicks": _with(
        "SELECT date_trunc('millisecond', ts) AS ts, concat('province', user_id % 5) AS province,"
        " concat('city', user_id % 25) AS city, user_id, k % 10 AS ad_id FROM v_ev WHERE event_type IN ('click', 'view')",
        "v_ev",
    ),
    "stream_log_quarantine": _with(_BAD_LOG_LINES, "v_ev"),
    "stream_snapshot_totals": _with(
        "SELECT date, province, city, ad_id, count(*) AS click_count FROM"
        " (SELECT c.*, l.slice AS listed, c.slice AS came FROM sliced c LEFT JOIN listed l ON c.user_id = l.user_id)"
        " WHERE came <= 2 AND (listed IS NULL OR came <= listed) GROUP BY date, province, city, ad_id",
        "sliced", "listed",
    ),
    "stream_closed_windows": _with(
        f"""SELECT window_start, ad_id, count(*) AS click_count, CASE WHEN late THEN 'late' ELSE 'closed' END AS kind
            FROM (SELECT *, coalesce(window_start + INTERVAL '90' MINUTE <= newest, false) AS late
                  FROM (SELECT *, date_trunc('hour', ts) AS window_start,
                               least({S.WINDOW_BATCHES - 1}, date_diff('day', DATE '{S.FIRST_DAY}', date) // {S.REPLAY_DAYS}
                                     + CASE WHEN user_id % 10 = 0 THEN 1 ELSE 0 END) AS batch FROM ad_click_log) c
                  LEFT JOIN (SELECT b.batch, max(ts) AS newest FROM range({S.WINDOW_BATCHES}) b(batch)
                             JOIN (SELECT ts, least({S.WINDOW_BATCHES - 1}, date_diff('day', DATE '{S.FIRST_DAY}', date)
                                     // {S.REPLAY_DAYS} + CASE WHEN user_id % 10 = 0 THEN 1 ELSE 0 END) AS came
                                   FROM ad_click_log) t ON t.came < b.batch GROUP BY b.batch) w ON c.batch = w.batch)
            WHERE late OR window_start + INTERVAL '90' MINUTE <= (SELECT max(ts) FROM ad_click_log)
            GROUP BY ALL""",
        "ad_click_log",
    ),
    "action_log_json": _with(
        "SELECT event_id AS logId, user_id AS userId, date_trunc('second', ts) AS actionTime,"
        " CAST(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS BIGINT) AS actionType,"
        " CASE WHEN event_type = 'purchase' THEN value ELSE 0.0 END AS purchaseMoney"
        " FROM v_ev WHERE event_type <> 'error'",
        "v_ev",
    ),
    "action_log_json_quarantine": _with(
        f"SELECT {_LOG_LINE} AS line FROM v_ev WHERE event_type = 'error' AND event_id % 4 <> 2", "v_ev"
    ),
    "user_base_json": _with("SELECT * FROM user_base_info WHERE userId % 7 <> 0", "user_base_info"),
    "task_params": """
        SELECT c_custkey AS task_id, concat('task ', c_name) AS task_name,
               strftime(DATE '2024-01-01' + CAST(c_custkey % 20 AS INTEGER), '%Y-%m-%d 10:00:00') AS start_date,
               '2024-01-30 10:00:00' AS end_date, CAST(20 + c_custkey % 10 AS INTEGER) AS start_age,
               CAST(50 + c_custkey % 10 AS INTEGER) AS end_age,
               concat('kw', c_custkey % 12, ',kw1') AS keywords, concat('1,2,', c_custkey % 7) AS target_page_flow,
               CASE c_custkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' END AS sex,
               concat('p', c_custkey % 3, ',p9') AS professionals, concat('c', c_custkey % 4) AS cities,
               concat(c_custkey % 10, ',50') AS category_ids,
               CASE WHEN c_custkey % 2 = 0 THEN 'week' ELSE 'month' END AS cycle
        FROM customer""",
    "scalar_dates": """
        SELECT event_id, CASE WHEN event_type <> 'error' THEN date_trunc('second', ts) END AS parsed,
               strftime(ts, '%Y-%m-%d %H:%M:%S') AS time_text, strftime(ts, '%Y-%m-%d') AS date_text,
               strftime(ts, '%Y%m%d') AS date_key, strftime(ts, '%Y%m%d%H%M') AS minute_key,
               CAST(ts AS DATE) AS key_date, strftime(ts, '%Y-%m-%d_%H') AS date_hour,
               CAST(ts AS DATE) - 1 AS yesterday,
               CASE WHEN event_type <> 'error' THEN CAST(date_diff('second', date_trunc('day', ts),
                   date_trunc('second', ts)) AS BIGINT) END AS second_of_day,
               event_type <> 'error' AND date_trunc('second', ts) < TIMESTAMP '2024-01-15' AS is_before,
               event_type <> 'error' AND date_trunc('second', ts) > TIMESTAMP '2024-01-15' AS is_after,
               CAST(ts AS DATE) + 7 AS week_later,
               CAST(date_trunc('year', ts) AS DATE) AS year_start,
               CAST(date_trunc('year', ts) - INTERVAL '1' YEAR AS DATE) AS year_before,
               CAST(date_trunc('month', ts) AS DATE) AS month_start,
               CAST(date_trunc('month', ts) - INTERVAL '1' MONTH AS DATE) AS month_before,
               CAST(date_trunc('week', ts) AS DATE) AS week_start,
               CAST(date_trunc('week', ts) - INTERVAL '7' DAY AS DATE) AS week_before,
               CAST(ts AS DATE) AS day_start, CAST(ts AS DATE) - 1 AS day_before
        FROM events""",
    "scalar_strings": """
        SELECT p_partkey, p_size % 5 = 0 OR p_name = '' AS is_empty, concat(p_type, ',') AS trimmed,
               CASE WHEN length(CAST(p_size AS VARCHAR)) = 2 THEN CAST(p_size AS VARCHAR)
                    ELSE concat('0', p_size) END AS two_digits,
               concat(p_partkey, ':', p_name) AS id_and_name, CAST(CASE WHEN p_size % 3 = 0 THEN 3 ELSE 2 END AS INTEGER) AS id_count,
               CASE WHEN p_partkey % 7 <> 0 THEN
                    CAST(((200 * p_size + p_partkey % 7) // (2 * (p_partkey % 7))) / 100.0 AS DOUBLE) END AS ratio,
               -p_size AS negated
        FROM part""",
    "scalar_json": _with(
        "SELECT id, json_extract_string(info, '$.product_status') AS status_text,"
        " json_extract_string(info, '$.nothing') AS missing, CASE WHEN id % 2 = 1 THEN json_extract_string(info, '$.product_status') END AS broken,"
        f" {_STATUS} AS product_status FROM product_info",
        "product_info",
    ),
    "packed_field_get_set": _with(
        """SELECT event_id, concat('s', user_id) AS session_id,
                  CASE WHEN event_type = 'view' THEN 'view' END AS search_keywords, k AS step_length,
                  CAST(NULL AS VARCHAR) AS age,
                  concat('session_id=s', user_id, '|search_keywords=',
                         CASE WHEN event_type = 'view' THEN 'view' ELSE '' END, '|step_length=', k + 1) AS changed,
                  concat('session_id=s', user_id, '|search_keywords=',
                         CASE WHEN event_type = 'view' THEN 'view' ELSE '' END, '|step_length=', k) AS unchanged
           FROM v_ev""",
        "v_ev",
    ),
}
