"""DuckDB's SQL of those general queries whose SQL is long: times in many manners, and drifting JSON."""

from __future__ import annotations

from fedsql.operators.instants import ZONES

#: Minutes that zone abbreviations are ahead of UTC.
_ZONES = {k: (-1 if v[0] == "-" else 1) * (int(v[1:3]) * 60 + int(v[4:])) for k, v in ZONES.items()}
_CLOCK = r"(?:[T ] ?(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?)?\s*(.*)$"
_NAMES = "['y', 'm', 'd', 'h', 'i', 's', 'f', 'rest']"
_TIMES = f"""
        texts AS (SELECT *, trim(regexp_replace(translate(text, '０１２３４５６７８９：－／．，＋　ＴＺ', '0123456789:-/.,+ TZ'), '\\s+', ' ', 'g')) AS v FROM raw),
        shaped AS (SELECT *, CASE
            WHEN regexp_matches(v, '^\\d{{4}}[-/.]') THEN regexp_extract(v, '^(\\d{{4}})[-/.](\\d{{1,2}})[-/.](\\d{{1,2}}){_CLOCK}', {_NAMES})
            WHEN regexp_matches(v, '^\\d{{1,2}}[-/.]\\d') THEN (SELECT {{'y': e.y, 'm': e.m, 'd': e.d, 'h': e.h, 'i': e.i, 's': e.s, 'f': e.f, 'rest': e.rest}} FROM (SELECT regexp_extract(v, '^(\\d{{1,2}})[-/.](\\d{{1,2}})[-/.](\\d{{4}}){_CLOCK}', ['d', 'm', 'y', 'h', 'i', 's', 'f', 'rest']) AS e))
            WHEN regexp_matches(v, '^\\d{{4}}年') THEN regexp_extract(v, '^(\\d{{4}})年(\\d{{1,2}})月(\\d{{1,2}})[日号](?: ?(\\d{{1,2}})[时点:](\\d{{1,2}})[分:]?(?:(\\d{{1,2}})(?:[.,](\\d{{1,9}}))?秒?)?)?\\s*(.*)$', {_NAMES})
            WHEN regexp_matches(v, '^\\d{{8}}(T?\\d{{4}}(\\d{{2}})?)?(Z|[+-]\\d{{2}}:?\\d{{2}})?$') THEN regexp_extract(v, '^(\\d{{4}})(\\d{{2}})(\\d{{2}})(?:T?(\\d{{2}})(\\d{{2}})(?:(\\d{{2}})(?:[.,](\\d{{1,9}}))?)?)?(Z|[+-]\\d{{2}}:?\\d{{2}})?$', {_NAMES})
            WHEN regexp_matches(v, '^([A-Za-z]{{3,9}}\\.?,? )?\\d{{1,2}}[ -][A-Za-z]') THEN (SELECT {{'y': e.y, 'm': e.m, 'd': e.d, 'h': e.h, 'i': e.i, 's': e.s, 'f': '', 'rest': e.rest}} FROM (SELECT regexp_extract(v, '^(?:[A-Za-z]{{3,9}}\\.?,? )?(\\d{{1,2}})[ -]([A-Za-z]{{3,9}})\\.?,?[ -](\\d{{4}})(?:,? (\\d{{1,2}}):(\\d{{2}})(?::(\\d{{2}}))?)?\\s*(.*)$', ['d', 'm', 'y', 'h', 'i', 's', 'rest']) AS e))
            WHEN regexp_matches(v, '^[A-Za-z]{{3,9}}\\.? \\d{{1,2}},? \\d{{4}}') THEN (SELECT {{'y': e.y, 'm': e.m, 'd': e.d, 'h': e.h, 'i': e.i, 's': e.s, 'f': '', 'rest': e.rest}} FROM (SELECT regexp_extract(v, '^([A-Za-z]{{3,9}})\\.? (\\d{{1,2}}),? (\\d{{4}})(?:,? (\\d{{1,2}}):(\\d{{2}})(?::(\\d{{2}}))?)?\\s*(.*)$', ['m', 'd', 'y', 'h', 'i', 's', 'rest']) AS e))
          END AS p FROM texts),
        parted AS (SELECT *, CASE WHEN regexp_matches(p.m, '^[A-Za-z]') THEN CAST((instr('janfebmaraprmayjunjulaugsepoctnovdec', lower(p.m[1:3])) + 2) // 3 AS VARCHAR) ELSE p.m END AS month,
            upper(regexp_extract(p.rest, '^([AaPp][Mm])\\b', 1)) AS half, trim(regexp_replace(p.rest, '^[AaPp][Mm]\\b', '')) AS z FROM shaped),
        walls AS (SELECT *, CASE WHEN half <> '' THEN CASE WHEN TRY_CAST(p.h AS INT) BETWEEN 1 AND 12 THEN CAST(TRY_CAST(p.h AS INT) % 12 + CASE half WHEN 'PM' THEN 12 ELSE 0 END AS VARCHAR) END ELSE coalesce(nullif(p.h, ''), '0') END AS hour,
            regexp_replace(regexp_replace(z, '^\\[(.*)\\]$', '\\1'), '^(Z|[+-]\\d{{2}}:?\\d{{2}})\\[[^\\]]+\\]$', '\\1') AS named FROM parted),
        locals AS (SELECT *, CASE WHEN TRY_CAST(hour AS INT) < 24 AND coalesce(TRY_CAST(nullif(p.s, '') AS INT), 0) < 60 THEN TRY_CAST(p.y || '-' || lpad(month, 2, '0') || '-' || lpad(p.d, 2, '0') || ' ' || lpad(hour, 2, '0') || ':' || lpad(coalesce(nullif(p.i, ''), '0'), 2, '0') || ':' || lpad(coalesce(nullif(p.s, ''), '0'), 2, '0') || '.' || rpad(p.f[1:6], 6, '0') AS TIMESTAMP) END AS wall,
            CASE WHEN named = '' THEN NULL
                 WHEN regexp_matches(named, '^(UTC|GMT|utc|gmt)? ?[+-]\\d{{1,2}}(:?[0-5]\\d)?$') THEN CASE WHEN TRY_CAST(regexp_extract(named, '[+-](\\d{{1,2}})', 1) AS INT) <= 18 THEN (TRY_CAST(regexp_extract(named, '[+-](\\d{{1,2}})', 1) AS INT) * 60 + coalesce(TRY_CAST(nullif(regexp_extract(named, '[+-]\\d{{1,2}}:?([0-5]\\d)$', 1), '') AS INT), 0)) * CASE WHEN contains(named, '-') THEN -1 ELSE 1 END END
                 {" ".join(f"WHEN upper(named) = '{k}' THEN {m}" for k, m in _ZONES.items())} END AS minutes,
            CASE WHEN named = '' THEN zone WHEN contains(named, '/') AND named IN (SELECT name FROM pg_timezone_names()) THEN named END AS region FROM walls),
        read AS (SELECT *, CASE
            WHEN regexp_matches(v, '^\\d{{9,10}}$') THEN TRY_CAST(v AS BIGINT) * 1000000
            WHEN regexp_matches(v, '^\\d{{13}}$') THEN TRY_CAST(v AS BIGINT) * 1000
            WHEN minutes IS NOT NULL THEN epoch_us(wall) - CAST(minutes AS BIGINT) * 60000000
            WHEN region IS NOT NULL THEN epoch_us(CASE WHEN timezone(region, timezone(region, wall) - INTERVAL 1 HOUR) = wall THEN timezone(region, wall) - INTERVAL 1 HOUR ELSE timezone(region, wall) END) END AS us FROM locals)"""
SQL: dict[str, str] = {}
SQL["p2_found"] = f"""
        WITH raw AS (
          SELECT DISTINCT 'demo' AS table_name, _id AS row_key, 'start_date' AS field_name, start_date AS text, 'Asia/Shanghai' AS zone FROM demo
          UNION ALL SELECT DISTINCT 'demo', _id, 'created_at', created_at, 'Asia/Shanghai' FROM demo
          UNION ALL SELECT DISTINCT 'site_orders', CAST(order_id AS VARCHAR), 'order_at', order_at, coalesce(time_zone, 'UTC') FROM site_orders
          UNION ALL SELECT DISTINCT 'member_orders', CAST(id AS VARCHAR), 'create_time', create_time, 'Asia/Shanghai' FROM member_orders),{_TIMES}
        SELECT table_name, row_key, field_name, us AS utc_us FROM read
        WHERE us IS NOT NULL AND NOT regexp_matches(text, '^\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}(Z|[+-]\\d{{2}}:\\d{{2}})$')"""
SQL["p3_found"] = f"""
        WITH raw AS (SELECT DISTINCT id, member_id, pay_amount, create_time AS text, 'Asia/Shanghai' AS zone FROM member_orders WHERE member_id IS NOT NULL),{_TIMES},
        daily AS (SELECT member_id, CAST(timezone('Asia/Shanghai', make_timestamptz(us)) AS DATE) AS day, sum(CASE WHEN pay_amount IS NULL OR isnan(pay_amount) THEN 0 ELSE CAST(round(pay_amount * 100) AS BIGINT) END) AS cents FROM read WHERE us IS NOT NULL GROUP BY 1, 2),
        calendar AS (SELECT member_id, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM daily GROUP BY member_id),
        sums AS (SELECT c.member_id, c.day, bool_or(d.day = c.day) AS active, coalesce(sum(d.cents) FILTER (d.day > c.day - 7), 0) AS sum_7, coalesce(sum(d.cents), 0) AS sum_30
                 FROM calendar c LEFT JOIN daily d ON d.member_id = c.member_id AND d.day <= c.day AND d.day > c.day - 30 GROUP BY 1, 2)
        SELECT member_id, strftime(day, '%Y-%m-%d') AS day FROM sums WHERE NOT coalesce(active, false) AND sum_7 * 30 > sum_30 * 7"""


def _meant(x: str) -> str:
    """Text that is itself JSON stands for what it says."""
    return f"CASE WHEN json_type({x}) = 'VARCHAR' AND json_valid({x}->>'$') AND regexp_matches({x}->>'$', '^\\s*([\\[{{\"]|null\\s*$)') THEN CAST({x}->>'$' AS JSON) ELSE {x} END"


def _listed(x: str) -> str:
    """A single value in place of an array is its only element."""
    return f"CASE json_type({x}) WHEN 'ARRAY' THEN CAST({x} AS JSON[]) WHEN 'NULL' THEN NULL ELSE [{x}] END"


SQL["p4_found"] = f"""
        WITH typed AS (
          SELECT 'user_data' AS table_name, u.k AS parent_key, 'goodsId' AS field_name, i - 1 AS pos, u.g[i].goodsId AS child FROM (SELECT DISTINCT "order".orderId AS k, "order".goodses AS g FROM user_data WHERE "order".orderId IS NOT NULL) u, unnest(range(1, len(u.g) + 1)) r(i)
          UNION ALL SELECT 'user_data', u.k, 'payTypes', i - 1, CAST(u.g[i] AS VARCHAR) FROM (SELECT DISTINCT "order".orderId AS k, "order".payInfo.payTypes AS g FROM user_data WHERE "order".orderId IS NOT NULL) u, unnest(range(1, len(u.g) + 1)) r(i)
          UNION ALL SELECT 'demo', u.k, 'timeout_time', i - 1, u.g[i].timeout_time FROM (SELECT DISTINCT _id AS k, rules AS g FROM demo WHERE _id IS NOT NULL) u, unnest(range(1, len(u.g) + 1)) r(i)
          UNION ALL SELECT 'demo', u.k, 'sites', i - 1, CAST(u.g[i] AS VARCHAR) FROM (SELECT DISTINCT _id AS k, sites AS g FROM demo WHERE _id IS NOT NULL) u, unnest(range(1, len(u.g) + 1)) r(i)),
        docs AS (SELECT DISTINCT record_no, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS d FROM raw_records WHERE record_no IS NOT NULL),
        tops AS (SELECT record_no, {_meant("d")} AS d FROM docs),
        fields AS (SELECT record_no, {_meant("d->'$.order'")} AS o, {_meant("d->'$.rules'")} AS rules, {_meant("d->'$.sites'")} AS sites FROM tops),
        inner_ AS (SELECT record_no, {_meant("o->'$.goodses'")} AS goodses, {_meant("o->'$.payInfo'")} AS pay, rules, sites FROM fields),
        pays AS (SELECT record_no, {_meant("pay->'$.payTypes'")} AS types FROM inner_),
        arrays AS (
          SELECT record_no, 'goodsId' AS field_name, '$.goodsId' AS path, {_listed("goodses")} AS a FROM inner_
          UNION ALL SELECT record_no, 'payTypes', '$', {_listed("types")} FROM pays
          UNION ALL SELECT record_no, 'timeout_time', '$.timeout_time', {_listed("rules")} FROM inner_
          UNION ALL SELECT record_no, 'sites', '$', {_listed("sites")} FROM inner_),
        items AS (SELECT record_no, field_name, path, i - 1 AS pos, {_meant("a[i]")} AS x FROM arrays, unnest(range(1, len(a) + 1)) r(i)),
        leaves AS (SELECT record_no, field_name, pos, {_meant("x->path")} AS x FROM items)
        SELECT table_name, parent_key, field_name, CAST(pos AS BIGINT) AS pos, child FROM (
          SELECT * FROM typed UNION ALL SELECT 'raw_records', CAST(record_no AS VARCHAR), field_name, pos, x->>'$' FROM leaves WHERE json_type(x) NOT IN ('OBJECT', 'ARRAY', 'NULL'))
        WHERE child IS NOT NULL"""
