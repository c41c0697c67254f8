"""SQL that computes the same results in DuckDB on the same tables."""

from __future__ import annotations

TRAIN_END = "floor(0.75::DOUBLE * n)"
VAL_END = "floor((0.75::DOUBLE + 0.10::DOUBLE) * n)"
CONTIGUOUS = f"CASE WHEN r < {TRAIN_END} THEN 'train' WHEN r < {VAL_END} THEN 'val' ELSE 'test' END"
GAP = 120
PURGED = f"""CASE WHEN r < floor(0.75::DOUBLE * (n - 2 * {GAP})) THEN 'train'
     WHEN r < floor(0.75::DOUBLE * (n - 2 * {GAP})) + {GAP} THEN NULL
     WHEN r < floor((0.75::DOUBLE + 0.10::DOUBLE) * (n - 2 * {GAP}) + {GAP}) THEN 'val'
     WHEN r < floor((0.75::DOUBLE + 0.10::DOUBLE) * (n - 2 * {GAP}) + 2 * {GAP}) THEN NULL
     ELSE 'test' END"""

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

DATE_PATTERNS = [
    r"^\d{4}-\d{2}-\d{2}$",
    r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$",
    r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$",
    r"^(0?[1-9]|1[0-2])/(0?[1-9]|[12]\d|3[01])/\d{4}$",
    r"^(0?[1-9]|[12]\d|3[01])/(0?[1-9]|1[0-2])/\d{4}$",
    r"^(16(7[89]|[89]\d)|1[7-9]\d\d|2[01]\d\d|22([0-5]\d|6[01]))$",
    r"^([01]?\d|2[0-3]):[0-5]\d$",
    r"^\d{4}Q[1-4]$",
]


def ranked(source: str, order: str) -> str:
    """``source`` with its 0-based position ``r`` and row count ``n``."""
    keys = ", ".join(f"{key.strip()} ASC NULLS LAST" for key in order.split(","))
    return f"SELECT *, row_number() OVER (ORDER BY {keys}) - 1 AS r, count(*) OVER () AS n FROM {source}"


def split(source: str, order: str, output: str, zones: str = CONTIGUOUS) -> str:
    return f"SELECT {output}, {zones} AS split FROM ({ranked(source, order)})"


def uniform(salt: str, key: str, start: int = 1) -> str:
    return f"(('0x' || substr(md5('{salt}|' || {key}), {start}, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def normal(salt: str, key: str) -> str:
    first, second = uniform(salt, key), uniform(salt, key, 17)
    return f"(sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {first})) * cos(6.283185307179586::DOUBLE * {second}))"


def shuffle_number(seed: int, key: str) -> str:
    return f"('0x' || substr(md5('{seed}|' || {key}), 1, 13))::BIGINT"


def is_date_column(source: str, column: str, order: str) -> str:
    fits = " OR ".join(f"bool_and(regexp_matches(v, '{pattern}'))" for pattern in DATE_PATTERNS)
    head = f"SELECT {column} AS v FROM {source} WHERE {column} IS NOT NULL ORDER BY {order} LIMIT 10"
    return f"(SELECT coalesce({fits}, false) FROM ({head}))"


# Table -> (source order, {column: family}).
PROFILED = {
    "lineitem": ("l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice",
                 {"l_orderkey": "int", "l_partkey": "int", "l_suppkey": "int", "l_linenumber": "int",
                  "l_quantity": "real", "l_extendedprice": "real", "l_discount": "real", "l_tax": "real",
                  "l_returnflag": "text", "l_linestatus": "text", "l_shipdate": "time"}),
    "orders": ("o_orderkey", {"o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "text",
                              "o_totalprice": "real", "o_orderdate": "time", "o_orderpriority": "text"}),
    "customer": ("c_custkey", {"c_custkey": "int", "c_name": "text", "c_nationkey": "int", "c_acctbal": "real",
                               "c_mktsegment": "text"}),
    "documents": ("doc_id", {"doc_id": "int", "text": "text", "lang": "text", "source": "text", "n_chars": "int"}),
    "part": ("p_partkey", {"p_partkey": "int", "p_name": "text", "p_brand": "text", "p_type": "text",
                           "p_size": "int", "p_retailprice": "real"}),
    "events": ("event_id", {"event_id": "int", "ts": "time", "user_id": "int", "event_type": "text",
                            "value": "real", "props": "text"}),
    "benchmark": ("item_id", {"item_id": "int", "text": "text"}),
    "pages": ("page_id", {"page_id": "int", "url": "text", "html": "text"}),
}


def all_whole(column: str, family: str) -> str:
    if family == "real":
        return f"bool_and({column} % 1 = 0)"
    return "true" if family == "int" else "NULL::BOOLEAN"


def role_rows(name: str, source: str | None = None) -> str:
    """One row per column of a table: its role by the five rules."""
    source = source or name
    order, columns = PROFILED[name]
    selects = []
    for column, family in columns.items():
        few = f"(count(DISTINCT {column}) <= 200 OR count(DISTINCT {column}) / count(*)::DOUBLE < 0.1)"
        other = f"CASE WHEN {few} THEN 'categorical' ELSE '{'text' if family == 'text' else 'integer'}' END"
        if family == "time":
            role = "'datetime'"
        elif family == "text":
            role = f"CASE WHEN {is_date_column(source, column, order)} THEN 'datetime' ELSE {other} END"
        else:
            role = f"CASE WHEN NOT {all_whole(column, family)} THEN 'continuous' ELSE {other} END"
        selects.append(
            f"SELECT '{name}' AS table_name, '{column}' AS \"column\", "
            f"CASE WHEN count({column}) = 0 THEN NULL ELSE {role} END AS role, "
            f"count(DISTINCT {column}) AS n_unique, count(*) AS n_rows FROM {source}"
        )
    return " UNION ALL ".join(selects)


def profile_rows(name: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, '{column}' AS \"column\", count(*) AS n_rows, count({column}) AS n_filled, "
        f"count(DISTINCT {column}) AS n_unique, {all_whole(column, family)} AS all_whole FROM {name}"
        for column, family in PROFILED[name][1].items()
    )


LABELLED = "SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)"

FLAT = """
SELECT o.o_orderkey, i.l_linenumber, i.l_partkey, i.l_suppkey, i.l_extendedprice,
       CASE WHEN i.l_suppkey % 10 <> 0 THEN i.l_tax END AS freight, p.p_type, p.p_size,
       length(p.p_name) AS p_name_length, o.o_orderstatus, o.o_orderdate, i.l_shipdate,
       e.event_id AS review_id, e.event_id % 5 + 1 AS review_score
FROM orders o JOIN lineitem i ON o.o_orderkey = i.l_orderkey
LEFT JOIN part p ON p.p_partkey = i.l_partkey AND p.p_size > 5
LEFT JOIN events e ON e.user_id = o.o_orderkey
WHERE i.l_suppkey % 10 <> 0 AND i.l_tax IS NOT NULL"""
FLAT_ORDER = "o_orderdate, o_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, review_id"
FLAT_COLUMNS = ("o_orderkey, review_score, l_extendedprice, freight, p_type, p_name_length, p_size, o_orderstatus, "
                "o_orderdate, l_shipdate")  # fmt: skip

FEW_SHOT_HEADER = (
    "You are a tabular data synthesizer. Generate a single, realistic, and unique new data record that follows "
    "the exact JSON format and statistical distributions of the examples below.\n"
    "Output ONLY a single valid JSON object. Do not output any other text or formatting.\n\n"
)
FEW_SHOT_TRAILER = "\n\nNow generate exactly one new record in the exact same JSON format:\n{"

CUSTOMER_LINE = """'{"c_custkey": "' || c_custkey || '", "c_name": "' || c_name || '", "c_nationkey": "' || c_nationkey
    || '", "c_acctbal": "' || c_acctbal::VARCHAR || '", "c_mktsegment": "' || c_mktsegment || '"}'"""


def few_shot_draws() -> str:
    """Common table expressions up to ``shots``: the subset draw, one step after the other."""
    steps = "base AS (SELECT s_suppkey AS prompt_id, (SELECT count(*) FROM customer) AS n FROM supplier)"
    previous, drawn = "base", []
    for i in range(1, 6):
        top = f"(n - 5 + {i})"
        pick = f"floor({uniform(f'42|{i}', 'prompt_id')} * {top})::BIGINT"
        seen = f"{pick} IN ({', '.join(drawn)})" if drawn else "false"
        steps += f", s{i} AS (SELECT *, CASE WHEN {seen} THEN {top} - 1 ELSE {pick} END AS d{i} FROM {previous})"
        previous, drawn = f"s{i}", [*drawn, f"d{i}"]
    shots = " UNION ALL ".join(f"SELECT prompt_id, {i} AS shot, d{i} AS r FROM s5" for i in range(1, 6))
    return f"WITH {steps}, shots AS ({shots})"


def few_shot() -> str:
    header = FEW_SHOT_HEADER.replace("'", "''")
    return f"""{few_shot_draws()}, lines AS (
        SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS r, {CUSTOMER_LINE} AS line FROM customer)
        SELECT prompt_id, '{header}' || string_agg(line, chr(10) ORDER BY shot) || '{FEW_SHOT_TRAILER}' AS prompt
        FROM shots JOIN lines USING (r) GROUP BY prompt_id"""


def last_examples() -> str:
    return f"""{few_shot_draws()}, numbered AS (
        SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS r FROM customer)
        SELECT prompt_id, c_name, c_acctbal::VARCHAR AS c_acctbal FROM shots JOIN numbered USING (r) WHERE shot = 5"""


def manifest() -> str:
    roles = role_rows("lineitem")
    order = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(PROFILED["lineitem"][1]))
    rules = [
        ("role_subset", "categorical", 0, "categorical"), ("role_subset", "integer", 0, "numeric"),
        ("role_subset", "continuous", 0, "numeric"),
        ("role_grouped", "continuous", 0, "numeric"), ("role_grouped", "integer", 1, "numeric"),
        ("role_grouped", "categorical", 2, "categorical"), ("role_grouped", "text", 3, "text"),
        ("all_columns", "categorical", 0, "categorical"), ("all_columns", "integer", 0, "numeric"),
        ("all_columns", "continuous", 0, "numeric"), ("all_columns", "text", 0, "other"),
        ("all_columns", "datetime", 0, "other"),
        ("epoch", "categorical", 0, "categorical"), ("epoch", "continuous", 1, "continuous"),
        ("epoch", "integer", 2, "integer"), ("epoch", "datetime", 3, "continuous"),
    ]
    values = ", ".join(f"('{a}', '{b}', {c}, '{d}')" for a, b, c, d in rules)
    return f"""WITH roles AS (SELECT "column", role, CASE "column" {order} END AS source FROM ({roles})),
        rules(layout, role, grp, kind) AS (VALUES {values}),
        placed AS (SELECT layout, "column", source, grp, kind FROM roles JOIN rules USING (role)
                   UNION ALL SELECT 'role_subset', "column", source, 0, 'other' FROM roles
                   WHERE "column" = 'l_shipdate' AND role NOT IN ('categorical', 'integer', 'continuous'))
        SELECT layout, "column", row_number() OVER (PARTITION BY layout ORDER BY grp, source) - 1 AS position,
               CASE WHEN "column" = 'l_shipdate' AND layout <> 'epoch' THEN 'target' ELSE kind END AS kind,
               "column" = 'l_shipdate' AS is_target FROM placed"""


RULES = [
    ("role_subset", "categorical", 0), ("role_subset", "integer", 0), ("role_subset", "continuous", 0),
    ("role_grouped", "continuous", 0), ("role_grouped", "integer", 1), ("role_grouped", "categorical", 2), ("role_grouped", "text", 3),
    ("all_columns", "categorical", 0), ("all_columns", "integer", 0), ("all_columns", "continuous", 0), ("all_columns", "text", 0),
    ("epoch", "categorical", 0), ("epoch", "continuous", 1), ("epoch", "integer", 2),
]


def customer_layouts() -> str:
    """Common table expressions: split customers, roles of their train rows, and the place of every column in every layout."""
    columns = list(PROFILED["customer"][1])
    order = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(columns))
    values = ", ".join(f"('{layout}', '{role}', {group})" for layout, role, group in RULES)
    return f"""WITH whole AS MATERIALIZED (SELECT * EXCLUDE (r, n), {CONTIGUOUS} AS split FROM ({ranked('customer', 'c_custkey')})),
        train AS MATERIALIZED (SELECT * EXCLUDE (split) FROM whole WHERE split = 'train'),
        roles AS (SELECT "column", role, CASE "column" {order} END AS source FROM ({role_rows('customer', 'train')})),
        rules(layout, role, grp) AS (VALUES {values}),
        placed AS (SELECT layout, "column", role, source,
            row_number() OVER (PARTITION BY layout ORDER BY grp, source) - 1 AS position FROM roles JOIN rules USING (role))"""


def layout_cells() -> str:
    cells = " UNION ALL ".join(
        f"SELECT c_custkey::VARCHAR AS c_custkey, split, '{c}' AS \"column\", {c}::VARCHAR AS cell FROM whole"
        for c in PROFILED["customer"][1] if c != "c_custkey"
    )
    return f"""{customer_layouts()}, cells AS ({cells})
        SELECT layout, split, c_custkey, "column", cell FROM cells JOIN placed USING ("column")"""


def layout_headers() -> str:
    def listed(value: str, order: str, where: str) -> str:
        return f"coalesce(string_agg({value}::VARCHAR, ',' ORDER BY {order}) FILTER (WHERE {where}), '')"

    numeric, target = "role IN ('integer', 'continuous')", "\"column\" = 'c_mktsegment'"
    return f"""{customer_layouts()},
        left_out AS (SELECT layout, "column", source FROM (SELECT DISTINCT layout FROM rules), roles
            WHERE (layout, "column") NOT IN (SELECT (layout, "column") FROM placed)),
        dropped AS (SELECT layout, string_agg("column", ',' ORDER BY source) AS dropped FROM left_out GROUP BY layout)
        SELECT layout, 'customers' AS name, 'binclass' AS task_type, (SELECT count(DISTINCT c_mktsegment) FROM train) AS n_classes,
            {listed('"column"', 'position', 'true')} AS column_names,
            {listed('position', 'position', f'{numeric} AND NOT {target}')} AS num_col_idx,
            {listed('position', 'position', f"role = 'categorical' AND NOT {target}")} AS cat_col_idx,
            {listed('position', 'position', target)} AS target_col_idx, coalesce(any_value(dropped), '') AS dropped
        FROM placed LEFT JOIN dropped USING (layout) GROUP BY layout"""


COMPLETIONS = r"""WITH made AS (SELECT conv_id, turn, CASE (conv_id + turn) % 6
            WHEN 0 THEN '"g_role": "' || role || '", "g_turn": ' || turn || '} tail ' || text
            WHEN 1 THEN text
            WHEN 2 THEN '"g_role": {"x": "' || role || '"}, "g_turn": 1}'
            WHEN 3 THEN ' ' || chr(10) || ' "g_role": "' || role || '", "zz": 3, "g_turn": null}' || chr(9) || ' '
            WHEN 4 THEN '"g_role": "' || role || '", "g_text": ' || to_json(text)::VARCHAR || '}'
            ELSE '"g_role": "' || role || '", "g_turn": tru}' END AS t FROM conversations),
            cut AS (SELECT conv_id, turn,
                regexp_extract('{' || regexp_replace(t, '^\s+|\s+$', '', 'g'), '\{.*?\}', 0, 's') AS m FROM made),
            good AS (SELECT conv_id, turn, CASE WHEN m <> '' AND json_valid(m) THEN m END AS m FROM cut)
            SELECT conv_id, turn, json_extract_string(m, '$.g_role') AS g_role, json_extract_string(m, '$.g_turn') AS g_turn,
            json_extract_string(m, '$.g_text') AS g_text FROM good"""


def structural() -> str:
    key = "o_orderkey"
    return f"""WITH drawn AS (SELECT o_orderkey, {normal('42|root_1', key)} AS root_1, {normal('42|root_2', key)} AS root_2,
            {normal('42|collider', key)} AS noise, {uniform('42|cause', key)} * 6.0::DOUBLE + -3.0::DOUBLE AS cause,
            {normal('42|proxy', key)} AS proxy_noise,
            (['Alpha', 'Beta', 'Gamma', 'Delta'])[floor({uniform('42|category', key)} * 4)::INT + 1] AS distractor_cat
            FROM orders),
        summed AS (SELECT *, root_1 + root_2 + noise * 0.1::DOUBLE AS collider FROM drawn)
        SELECT o_orderkey, round(root_1, 6) AS root_1, round(root_2, 6) AS root_2, round(collider, 6) AS collider,
            round(sin(cause) + proxy_noise * 0.05::DOUBLE, 6) AS proxy_sin, distractor_cat,
            CASE WHEN 1.0::DOUBLE / (1.0::DOUBLE + exp(-(collider + cause))) > 0.5::DOUBLE THEN 1::BIGINT
                 ELSE 0::BIGINT END AS target_class
        FROM summed"""


def all_oracles() -> dict[str, str]:
    events_split = split("events", "ts, event_id", "event_id, event_type")
    written = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')"
    sniffed = f"""(SELECT o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS iso_date,
        strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS iso_second, strftime(o_orderdate, '%m/%d/%Y') AS slashed,
        strftime(o_orderdate, '%Y') AS "year", strftime(o_orderdate, '%H:%M') AS clock,
        CASE WHEN o_orderkey % 2 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS gaps,
        CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d')
             ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M') END AS mixed,
        o_totalprice::VARCHAR AS price FROM orders)"""
    sniffed_columns = ["o_orderstatus", "iso_date", "iso_second", "slashed", "year", "clock", "gaps", "mixed", "price"]
    later = "lead(value, 5) OVER ({})"
    change = "CASE WHEN value <> 0 THEN ({0} - value) / value END"
    oracles = {
        "split_chrono": split("events", "ts, event_id", "event_id"),
        "split_train_rows": f"SELECT event_id, value FROM ({ranked('events', 'ts, event_id')}) WHERE r < {TRAIN_END}",
        "split_by_text": split("orders", "o_orderpriority, o_orderdate, o_orderkey", "o_orderkey"),
        "split_shuffled": split(f"(SELECT *, {shuffle_number(42, 'c_custkey')} AS k FROM customer)", "k, c_custkey",
                                "c_custkey"),
        "split_purged": split("events", "ts, event_id", "event_id", PURGED),
        "global_ordinal": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_no FROM orders",
        "lead_return": f"""SELECT event_id, (later - value) / value AS future_return FROM
            (SELECT *, {later.format('ORDER BY ts, event_id')} AS later FROM events)
            WHERE later IS NOT NULL AND value <> 0""",
        "lead_return_by_series": f"""SELECT event_id, event_type, {change.format('later')} AS future_return FROM
            (SELECT *, {later.format('PARTITION BY user_id ORDER BY ts, event_id')} AS later FROM events)""",
        "dedup_first": """SELECT * EXCLUDE (r) FROM
            (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r FROM part) WHERE r = 1""",
        "dedup_chain": """WITH once AS (SELECT * EXCLUDE (r) FROM
            (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r FROM part) WHERE r = 1)
            SELECT * EXCLUDE (r) FROM
            (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM once) WHERE r = 1""",
        "dedup_text": """SELECT doc_id, lang, text FROM
            (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1""",
        "normalize_newlines": r"SELECT doc_id, regexp_replace(text, '[\r\n]+', ' ', 'g') AS text FROM documents",
        "json_flatten": "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events",
        "json_flatten_nested": """SELECT event_id, CASE WHEN event_id % 5 > 1 THEN user_id END AS a_b,
            CASE WHEN event_id % 5 > 1 THEN event_type END AS a_c,
            CASE WHEN event_id % 5 > 1 THEN '[1,' || event_id || ']' END AS list FROM events""",
        "json_flatten_keys": """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'alone' WHEN 1 THEN NULL ELSE event_type END AS "K",
            CASE WHEN event_id % 4 > 1 THEN user_id END AS k_2, CASE WHEN event_id % 4 > 1 THEN 1::BIGINT END AS in_upper,
            CASE WHEN event_id % 4 > 1 THEN event_id END AS in_lower FROM events""",
        "array_element_default": """SELECT c_custkey,
            CASE WHEN c_custkey % 3 = 2 THEN 'Missing' ELSE split_part(c_name, '#', 1) END AS first,
            CASE WHEN c_custkey % 3 = 1 THEN split_part(c_name, '#', 2) ELSE 'Missing' END AS second FROM customer""",
        "null_tokens": """SELECT o_orderkey, CASE o_orderkey % 8 WHEN 6 THEN ' null' WHEN 7 THEN o_orderstatus END AS status,
            o_orderpriority FROM orders""",
        "parse_timestamps": f"""SELECT event_id, try_cast(CASE event_id % 5 WHEN 0 THEN substr({written}, 1, 10)
            WHEN 1 THEN 'x' || {written} WHEN 2 THEN substr({written}, 1, 5) || '13-41' ELSE {written} END AS TIMESTAMP)
            AS parsed FROM events""",
        "parse_timestamps_strict": "SELECT event_id, date_trunc('second', ts) AS parsed FROM events",
        "format_minute": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS minute FROM events",
        "coerce_numeric": f"""WITH shaped AS (SELECT p_partkey, substr(p_brand, 7, 10) AS brand,
            CASE p_partkey % 9 WHEN 0 THEN ' ' || p_size || ' ' WHEN 1 THEN p_size || 'e3' WHEN 2 THEN '+' || p_size
            WHEN 3 THEN '.' || p_size WHEN 4 THEN p_size || '.' WHEN 5 THEN p_size || 'd' WHEN 6 THEN '0x' || p_size
            WHEN 7 THEN p_name ELSE p_size::VARCHAR END AS shape FROM part)
            SELECT p_partkey, CASE WHEN regexp_matches(brand, '{NUMBER}') THEN try_cast(brand AS DOUBLE) END AS brand_no,
            CASE WHEN regexp_matches(shape, '{NUMBER}') THEN try_cast(ltrim(trim(shape), '+') AS DOUBLE) END AS shaped
            FROM shaped""",
        "dropna_subset": f"SELECT doc_id, quality, toxic FROM ({LABELLED}) WHERE quality IS NOT NULL",
        "dropna_any": f"""SELECT doc_id, lang, quality, n_chars::DOUBLE AS size FROM ({LABELLED})
            WHERE lang <> 'fr' AND quality IS NOT NULL AND n_chars % 7 <> 0""",
        "rename_strip_suffix": "SELECT n_nationkey AS n_nationkey_, n_name AS n_name_, n_regionkey AS n_regionkey_ FROM nation",
        "join_inner": """SELECT o_orderkey, o_orderstatus, l_linenumber, l_partkey, l_suppkey, l_extendedprice
            FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
        "join_left_dim": """SELECT l_orderkey, l_linenumber, l_partkey AS p_partkey, l_suppkey, p_name, p_retailprice
            FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON l_partkey = p_partkey""",
        "join_left_fanout": """SELECT c_custkey, c_name, o_orderkey, o_totalprice
            FROM customer LEFT JOIN orders ON o_custkey = c_custkey * 2""",
        "join_left_unmatched": f"SELECT doc_id, source, quality, toxic FROM ({LABELLED})",
        "join_null_safe": """SELECT c_custkey, nullif(n_regionkey, 0) AS key, r_name FROM customer
            JOIN nation ON c_nationkey = n_nationkey
            JOIN region ON nullif(n_regionkey, 0) IS NOT DISTINCT FROM nullif(r_regionkey, 0)""",
        "profile_columns": profile_rows("lineitem") + " UNION ALL " + profile_rows("customer"),
        "layout_epoch_text": """SELECT o_orderkey, day AS slashed, epoch(date_trunc('year', o_orderdate)) AS "year",
            epoch(date_trunc('minute', o_orderdate)) AS clocked, day AS digits, day AS named, day AS dotted,
            epoch(date_trunc('month', o_orderdate)) AS "month"
            FROM (SELECT *, epoch(date_trunc('day', o_orderdate)) AS day FROM orders)""",
        "sniff_datetime": " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", {is_date_column(sniffed, c, 'o_orderkey')} AS is_datetime" for c in sniffed_columns
        ),
        "infer_roles": " UNION ALL ".join(role_rows(name) for name in PROFILED),
        "infer_roles_screened": "SELECT table_name, \"column\", role FROM ("
        + " UNION ALL ".join(role_rows(name) for name in PROFILED) + ")",
        "infer_roles_train": f"""WITH train AS MATERIALIZED (SELECT * EXCLUDE (r, n) FROM
            ({ranked('orders', 'o_orderdate, o_orderkey')}) WHERE r < {TRAIN_END})
            SELECT "column", role, n_unique, n_rows FROM ({role_rows('orders', 'train')})""",
        "coerce_roles": f"""SELECT doc_id, text, lang, source, n_chars,
            CASE WHEN quality IS NULL THEN 'Missing' ELSE quality::VARCHAR END AS quality,
            CASE WHEN toxic IS NULL THEN 'Missing' ELSE toxic::VARCHAR END AS toxic FROM ({LABELLED})""",
        "layout_role_subset": """SELECT l_orderkey, l_partkey::VARCHAR AS l_partkey, l_suppkey::VARCHAR AS l_suppkey,
            l_linenumber::VARCHAR AS l_linenumber, l_quantity::DECIMAL(20, 1)::VARCHAR AS l_quantity, l_extendedprice,
            l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem""",
        "layout_role_grouped": f"""SELECT doc_id, n_chars, lang, source,
            coalesce(quality::VARCHAR, 'Missing') AS quality, coalesce(toxic::VARCHAR, 'Missing') AS toxic, text
            FROM ({LABELLED})""",
        "layout_all_columns": """SELECT l_orderkey, l_partkey::VARCHAR AS l_partkey, l_suppkey::VARCHAR AS l_suppkey,
            l_linenumber::VARCHAR AS l_linenumber, l_quantity::DECIMAL(20, 1)::VARCHAR AS l_quantity, l_extendedprice,
            l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem""",
        "layout_epoch": """SELECT user_id::VARCHAR AS user_id, event_type, props, value, event_id,
            CASE WHEN event_id % 9 <> 0 THEN floor(epoch(ts))::DOUBLE ELSE 0.0::DOUBLE END AS ts FROM events""",
        "layout_manifest": manifest(),
        "serialize_rows": f"SELECT c_custkey, {CUSTOMER_LINE} AS line FROM customer",
        "fewshot_prompts": few_shot(),
        "parse_completions_rows": COMPLETIONS,
        "completions_csv": f"SELECT conv_id, turn::BIGINT AS turn, g_role, g_turn FROM ({COMPLETIONS})",
        "gen_structural": structural(),
        "gen_structural_split": split(
            f"({structural()})", "o_orderkey", "o_orderkey, root_1, root_2, collider, proxy_sin, distractor_cat, target_class"),
        "csv_scan": """SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 3 THEN o_custkey::DOUBLE END AS o_custkey,
            CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN ' NA' ELSE o_orderstatus END AS o_orderstatus,
            o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders""",
        "csv_line_breaks": """SELECT doc_id, ' "a",' || text || chr(10) || '"b" ' AS text FROM documents""",
        "json_lines_scan": """SELECT event_id, value, props, CASE WHEN event_id % 4 <> 0 THEN user_id::VARCHAR ELSE 'Missing' END
            AS "user", NULL::VARCHAR AS absent FROM events""",
        "layout_csv": layout_cells(),
        "layout_headers": layout_headers(),
        "manifest_file": manifest(),
        "cached_split": events_split,
        "recipe_events_json": split(
            """(SELECT event_id, ts, event_type AS pattern,
                CASE WHEN event_id % 10 = 2 THEN 'Missing' ELSE user_id::VARCHAR END AS source_ip,
                CASE WHEN event_id % 10 IN (1, 2) THEN 'Missing' ELSE '80' END AS source_port,
                json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE event_id % 10 <> 0)""",
            "ts, event_id", "event_id, pattern, source_ip, source_port, k"),
        "recipe_events_text_time": split(
            """(SELECT event_id, event_type, json_extract_string(props, '$.k')::BIGINT AS k,
                CASE WHEN event_id % 10 <> 3 THEN date_trunc('second', ts) END AS moment FROM events)""",
            "moment, event_id", "event_id, event_type, k"),
        "recipe_shuffled": split(
            f"""(SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 10 <> 0 THEN c_acctbal END AS balance,
                c_nationkey AS nation, {shuffle_number(42, 'c_custkey')} AS k FROM customer WHERE c_nationkey <> 3)""",
            "k, c_custkey", "c_custkey, c_mktsegment, balance, nation"),
        "recipe_complete": split(
            f"""(SELECT c_custkey AS c_custkey_, c_nationkey AS c_nationkey_, c_acctbal AS c_acctbal_,
                c_mktsegment AS c_mktsegment_, {shuffle_number(42, 'c_custkey')} AS k FROM customer
                WHERE c_custkey % 4 <> 0)""",
            "k, c_custkey_", "c_custkey_, c_nationkey_, c_acctbal_, c_mktsegment_"),
        "recipe_few_shot": last_examples(),
        "recipe_purged_series": split(
            f"""(SELECT event_id, event_type, ts, (later - value) / value AS future_return FROM
                (SELECT *, {later.format('ORDER BY ts, event_id')} AS later FROM events)
                WHERE later IS NOT NULL AND value <> 0)""",
            "ts, event_id", "event_id, event_type, future_return", PURGED),
        "recipe_dedup_text": r"""WITH once AS (SELECT * EXCLUDE (r) FROM
            (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1),
            twice AS (SELECT * EXCLUDE (r) FROM
            (SELECT *, row_number() OVER (PARTITION BY n_chars ORDER BY doc_id) AS r FROM once) WHERE r = 1)
            """ + split(f"(SELECT *, {shuffle_number(42, 'doc_id')} AS k FROM twice)", "k, doc_id",
                        r"doc_id, lang, n_chars, regexp_replace(text, '[\r\n]+', ' ', 'g') AS text"),
        "recipe_flat_orders": split(f"({FLAT})", FLAT_ORDER, FLAT_COLUMNS),
        "flagship": f"""SELECT o_orderkey, review_id, l_linenumber, l_partkey::VARCHAR AS l_partkey,
            coalesce(review_score::VARCHAR, 'Missing') AS review_score, coalesce(p_type, 'Missing') AS p_type,
            coalesce(p_name_length::VARCHAR, 'Missing') AS p_name_length, coalesce(p_size::VARCHAR, 'Missing') AS p_size,
            o_orderstatus, l_extendedprice, freight, floor(epoch(o_orderdate))::DOUBLE AS o_orderdate,
            floor(epoch(l_shipdate))::DOUBLE AS l_shipdate, split FROM (
            {split(f"({FLAT})", FLAT_ORDER, FLAT_COLUMNS + ", review_id, l_linenumber, l_partkey")})""",
    }
    return oracles
