"""The same results as ``queries``, stated as SQL for an independent engine."""

from __future__ import annotations

from statistics import NormalDist

from claimweave.functions import normal

# Fixed values, stated once more so that a wrong table in the library shows: sign characters in the
# order of the digits, fields of a claim line, and the span of dates.
NEGATIVE_SIGNS = "}ABCDEFGHI"
POSITIVE_SIGNS = "{JKLMNOPQR"
DIGITS = "0123456789"
CLAIM_FIELDS = (
    ("claim_number", 10, "string"), ("patient_id", 8, "string"), ("provider_id", 6, "string"),
    ("service_date", 10, "date"), ("admission_date", 10, "date"), ("diagnosis_code", 7, "string"),
    ("procedure_code", 5, "string"), ("amount_due", 10, "amount"), ("claim_status", 1, "string"),
    ("payer_id", 6, "string"), ("date_of_birth", 10, "date"), ("discharge_date", 10, "date"),
    ("net_amount_due", 10, "amount"), ("social_security_number", 9, "ssn"),
    ("credit_card_number", 16, "credit_card"), ("phone_number", 10, "phone"),
)
FIRST_DATE, DATE_SPAN_DAYS = "2000-01-01", 8765

STEPS = 1000
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def union_all(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def cents(amount: str) -> str:
    return f"CAST(round({amount} * 100) AS BIGINT)"


def md5_of(tag: str, key: str, seed: int = 0) -> str:
    return f"md5('{seed}|{tag}|' || CAST({key} AS VARCHAR))"


def hex_number(digest: str, start: int, length: int) -> str:
    return f"CAST('0x' || substr({digest}, {start}, {length}) AS BIGINT)"


def uniform(digest: str, start: int = 1) -> str:
    return f"(CAST({hex_number(digest, start, 13)} AS DOUBLE) / CAST(4503599627370496 AS DOUBLE))"


def overpunched(value: str, width: int) -> str:
    digits = f"lpad(CAST(abs({value}) AS VARCHAR), {width}, '0')"
    place = f"CAST(right({digits}, 1) AS INTEGER) + 1"
    signs = f"CASE WHEN {value} < 0 THEN '{NEGATIVE_SIGNS}' ELSE '{POSITIVE_SIGNS}' END"
    return f"left({digits}, {width - 1}) || substr({signs}, {place}, 1)"


def decoded(x: str, data_type: str) -> str:
    signs, digits = NEGATIVE_SIGNS + POSITIVE_SIGNS, DIGITS + DIGITS
    body = f"replace({x}, right({x}, 1), translate(right({x}, 1), '{signs}', '{digits}'))"
    number = f"CASE WHEN regexp_matches({body}, '^[+-]?[0-9]+$') THEN TRY_CAST({body} AS {data_type}) END"
    return f"""CASE
      WHEN right({x}, 1) IN ({", ".join(f"'{c}'" for c in NEGATIVE_SIGNS)}) THEN -({number})
      WHEN right({x}, 1) IN ({", ".join(f"'{c}'" for c in POSITIVE_SIGNS + DIGITS)}) THEN {number}
      WHEN length({x}) > 0 THEN CAST(0 AS {data_type}) END"""


def zero_filled(x: str, width: int) -> str:
    text = f"CAST({x} AS VARCHAR)"
    body = f"CAST(abs({x}) AS VARCHAR)"
    return (
        f"CASE WHEN {x} < 0 THEN '-' || lpad({body}, greatest({width - 1}, length({body}))::INTEGER, '0') "
        f"ELSE lpad({text}, greatest({width}, length({text}))::INTEGER, '0') END"
    )


def trailer(count: str, net: str, gross: str, patient: str) -> str:
    return (
        f"left('PT' || {zero_filled(count, 10)} || {zero_filled(net, 11)} || 'A' || "
        f"{zero_filled(gross, 11)} || 'G' || {zero_filled(patient, 11)} || 'D', 48)"
    )


# ---------------------------------------------------------------- order lines

ORDER_LINES = f"""
order_lines AS (
  SELECT o_orderstatus AS file, o_orderkey,
    rpad(CAST(o_orderkey AS VARCHAR), 10, ' ') || rpad(CAST(o_custkey AS VARCHAR), 8, ' ')
    || CASE WHEN o_orderstatus = 'P' THEN ' ' ELSE o_orderstatus END
    || rpad(CAST({cents("o_totalprice")} AS VARCHAR), 12, ' ')
    || strftime(o_orderdate, '%Y%m%d') || rpad(o_orderpriority, 15, ' ') AS value
  FROM orders)"""

FILE_LINES = f"""{ORDER_LINES},
per_file AS (
  SELECT file, lpad(CAST(count(*) AS VARCHAR), 10, '0') AS n, max(o_orderkey) AS last_key
  FROM order_lines GROUP BY file),
file_lines AS (
  SELECT file, 0 AS part, CAST(0 AS BIGINT) AS seq, 'PA' || file || n AS value FROM per_file
  UNION ALL SELECT file, 1, o_orderkey, value FROM order_lines
  UNION ALL SELECT file, 2, 0, 'CD100' || CAST(last_key AS VARCHAR) || ' ' || chr(9) || ' ' FROM per_file
  UNION ALL SELECT file, 3, 0, 'PT' || n FROM per_file)"""

LAYOUT_COLUMNS = {
    ("HDR", "orders"): ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"],
    ("DE", "lineitem"): [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag",
        "l_linestatus",
    ],
}


def layout_offsets() -> str:
    parts, col_id = [], 0
    for (section, table), columns in LAYOUT_COLUMNS.items():
        for c in columns:
            col_id += 1
            shown = cents(c) if c.endswith("price") else c
            parts.append(
                f"SELECT {col_id} AS ColID, '{c}' AS Column_Name, "
                f"CAST(max(length(CAST({shown} AS VARCHAR))) AS INTEGER) AS Length, "
                f"'{section}' AS Type FROM {table}"
            )
    return f"""WITH layout AS ({union_all(parts)})
SELECT *, CAST(1 + coalesce(sum(Length) OVER (PARTITION BY Type ORDER BY ColID
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS Start FROM layout"""


def parse_lines() -> str:
    fields, start = [], 1
    for name, width in (
        ("o_orderkey", 10), ("o_custkey", 8), ("o_orderstatus", 1), ("cents", 12),
        ("o_orderdate", 8), ("o_orderpriority", 15),
    ):
        fields.append(f"trim(substr(value, {start}, {width})) AS {name}")
        start += width
    return f"WITH {ORDER_LINES} SELECT {', '.join(fields)} FROM order_lines"


ROUTE = f"""WITH {FILE_LINES},
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY file ORDER BY part, seq) AS line_no FROM file_lines)
SELECT file, line_no,
  CASE WHEN value LIKE 'CD%' THEN 'control' WHEN line_no = 1 THEN 'header' ELSE 'detail' END AS section,
  CASE WHEN value LIKE 'CD%' THEN trim(value, ' ' || chr(9)) ELSE value END AS record
FROM numbered"""

DATES = """WITH texts AS (
  SELECT o_orderkey, CASE o_orderkey % 21 WHEN 0 THEN 'N/A' WHEN 7 THEN '20011345' WHEN 14 THEN ''
    ELSE strftime(o_orderdate, '%Y%m%d') END AS date_text FROM orders)
SELECT o_orderkey, date_text, try_strptime(date_text, '%Y%m%d') AS parsed FROM texts"""

BALANCES = f"""balances AS (
  SELECT c_custkey, c_nationkey, CASE
    WHEN c_custkey % 11 = 0 THEN '1B2A' WHEN c_custkey % 13 = 5 THEN ''
    WHEN c_custkey % 17 = 3 THEN lpad(CAST(abs({cents("c_acctbal")}) AS VARCHAR), 10, '0')
    WHEN c_custkey % 19 = 7 THEN '1A2A' WHEN c_custkey % 23 = 9 THEN '5Z'
    ELSE {overpunched(cents("c_acctbal"), 10)} END AS amount FROM customer)"""

AMOUNT_TOTALS = f"""WITH {BALANCES},
decoded AS (SELECT c_nationkey, {decoded("amount", "DOUBLE")} AS value FROM balances)
SELECT c_nationkey, count(*) AS n_rows, coalesce(sum(value), 0) AS total,
  count(*) - count(value) AS rejects FROM decoded GROUP BY c_nationkey"""

AMOUNT_VALUES = f"""WITH {BALANCES}
SELECT c_custkey, amount, {decoded("amount", "DOUBLE")} AS value FROM balances"""


def masked(value: str, tag: str, key: str) -> str:
    digest = md5_of(tag, key)

    def block(d: str) -> str:
        return " || ".join(
            f"lpad(CAST({hex_number(d, start, 14)} % 1000000000000 AS VARCHAR), 12, '0')"
            for start in (1, 15)
        )

    first = f"CAST({hex_number(digest, 29, 4)} % 9 + 1 AS VARCHAR)"
    further = f"md5({digest} || '|1')"
    digits = f"{first} || {block(digest)} || {block(further)}"  # 49 digits
    return (
        f"CASE WHEN coalesce(length({value}), 0) = 0 THEN '0' "
        f"ELSE left({digits}, CAST(length({value}) AS INTEGER)) END"
    )


MASK = f"""WITH ids AS (
  SELECT c_custkey, c_name, CAST(c_custkey AS VARCHAR) AS id_text,
    c_name || c_mktsegment || c_name AS long_id, nullif(c_mktsegment, 'BUILDING') AS segment,
    replace(c_mktsegment, 'MACHINERY', '') AS blank FROM customer)
SELECT c_custkey, {", ".join(f"{masked(c, c, 'c_custkey')} AS {c}" for c in ("c_name", "id_text", "long_id", "segment", "blank"))}
FROM ids"""

GAPS = """SELECT o_orderkey, nullif(o_orderstatus, 'P') AS o_orderstatus,
  CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS o_totalprice,
  CASE WHEN o_orderstatus = 'O' THEN '' ELSE o_orderpriority END AS o_orderpriority FROM orders"""

NON_NULL = f"WITH gaps AS ({GAPS}) " + union_all(
    f"""SELECT '{c}' AS "column", count({c}) AS non_null FROM gaps"""
    for c in ("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
)

CLAIM_AMOUNTS = f"""claims AS (
  SELECT o_orderstatus AS file, o_totalprice AS gross,
    CASE WHEN o_orderstatus = 'F' THEN -{cents("o_totalprice")} ELSE {cents("o_totalprice")} END AS net
  FROM orders),
totals AS (
  SELECT file, count(*) AS n, sum(net) AS net, sum({cents("gross")}) AS gross_cents,
    CAST(trunc(sum(CAST(gross AS DECIMAL(28,4)))) AS BIGINT) AS gross
  FROM claims GROUP BY file)"""

TRAILER = f"""WITH {CLAIM_AMOUNTS}
SELECT file, 'zero' AS mode, {trailer("n", "0", "0", "0")} AS line FROM totals
UNION ALL SELECT file, 'decode', {trailer("n", "net", "gross", "0")} FROM totals"""

PARSED_TRAILERS = f"""WITH {CLAIM_AMOUNTS}
SELECT file, {trailer("n", "net", "gross_cents", "0")} AS line FROM totals"""

CLAIM_FILE = f"""WITH {FILE_LINES},
totals AS (
  SELECT o_orderstatus AS file, count(*) AS n, sum({cents("o_totalprice")}) AS net
  FROM orders GROUP BY o_orderstatus)
SELECT file, part AS section_no, seq, trim(value, chr(9) || ' ') AS line FROM file_lines
  WHERE part IN (0, 2)
UNION ALL SELECT file, 1, seq, value FROM file_lines WHERE part = 1
UNION ALL SELECT file, 3, 0, {trailer("n", "net", "0", "0")} FROM totals"""


# ---------------------------------------------------------------- generated claims


def random_text(tag: str, key: str, length: int) -> str:
    value = f"({hex_number(md5_of(tag, key), 1, 15)} % {36**length})"
    return " || ".join(
        f"substr('{ALPHABET}', CAST({value} // {36**k} % 36 AS INTEGER) + 1, 1)"
        for k in range(length - 1, -1, -1)
    )


def random_integer(tag: str, key: str, low: int, count: int) -> str:
    return f"({low} + CAST(floor({uniform(md5_of(tag, key))} * {count}) AS BIGINT))"


def claim_value(name: str, width: int, kind: str, key: str) -> str:
    if kind == "string":
        return random_text(name, key, width)
    if kind == "date":
        days = f"CAST(floor({uniform(md5_of(name, key))} * {DATE_SPAN_DAYS}) AS INTEGER)"
        return f"strftime(DATE '{FIRST_DATE}' + {days}, '%Y%m%d')"
    if kind == "amount":
        return f"lpad(CAST({random_integer(name, key, 1, 100000)} AS VARCHAR), {width}, ' ')"
    if kind == "ssn":
        return f"CAST({random_integer(name, key, 10**8, 9 * 10**8)} AS VARCHAR)"
    if kind == "phone":
        return f"CAST({random_integer(name, key, 10**9, 9 * 10**9)} AS VARCHAR)"
    return " || ".join(
        f"lpad(CAST({random_integer(f'{name}#{b}', key, 0, 10**8)} AS VARCHAR), 8, '0')" for b in (0, 1)
    )


CLAIMS = (
    "claims AS (SELECT o_orderkey, "
    + ", ".join(
        f"rpad({claim_value(name, width, kind, 'o_orderkey')}, {width}, ' ') AS {name}"
        for name, width, kind in CLAIM_FIELDS
    )
    + " FROM orders)"
)
CLAIM_NAMES = [name for name, _, _ in CLAIM_FIELDS]
CLAIM_LINES = f"WITH {CLAIMS} SELECT o_orderkey, {' || '.join(CLAIM_NAMES)} AS line FROM claims"
CLAIM_TABLE = (
    f"WITH {CLAIMS} SELECT o_orderkey, {', '.join(f'trim({n}) AS {n}' for n in CLAIM_NAMES)} FROM claims"
)


def roundtrip() -> str:
    parts, start = [], 1
    for name, width, _ in CLAIM_FIELDS:
        parts.append(
            f"SELECT '{name}' AS field, count(*) AS n_rows, "
            f"count(*) FILTER (WHERE trim(substr(line, {start}, {width})) = trim({name})) AS n_equal "
            f"FROM lines"
        )
        start += width
    return (
        f"WITH {CLAIMS}, lines AS (SELECT *, {' || '.join(CLAIM_NAMES)} AS line FROM claims) "
        + union_all(parts)
    )


# ---------------------------------------------------------------- kinds

TABLE_TYPES = {
    "lineitem": {
        "l_orderkey": "integer", "l_partkey": "integer", "l_suppkey": "integer",
        "l_linenumber": "integer", "l_quantity": "number", "l_extendedprice": "number",
        "l_discount": "number", "l_tax": "number", "l_returnflag": "text", "l_linestatus": "text",
        "l_shipdate": "date",
    },
    "part": {
        "p_partkey": "integer", "p_name": "text", "p_brand": "text", "p_type": "text",
        "p_size": "integer", "p_retailprice": "number",
    },
}


def kinds(table: str) -> str:
    parts = []
    for c, data_type in TABLE_TYPES[table].items():
        dates = f"count(try_strptime({c}, '%Y%m%d'))" if data_type == "text" else "0"
        unique = f"count({c}) > 1 AND count(DISTINCT {c}) >= count({c})"
        kind = {
            "date": "'datetime'",
            "number": "'numerical'",
            "integer": f"CASE WHEN {unique} THEN 'id' WHEN count(DISTINCT {c}) <= 10 "
            "THEN 'categorical' ELSE 'numerical' END",
            "text": f"CASE WHEN count({c}) > 0 AND {dates} = count({c}) THEN 'datetime' "
            f"WHEN {unique} THEN 'id' ELSE 'categorical' END",
        }[data_type]
        parts.append(
            f"""SELECT '{table}' AS table_name, '{c}' AS "column", {kind} AS kind, """
            f"count({c}) AS non_null, count(DISTINCT {c}) AS n_distinct FROM {table}"
        )
    return union_all(parts)


KIND_OVERRIDE = f"""WITH kinds AS ({kinds("part")})
SELECT 'detected' AS case_name, "column", kind FROM kinds
UNION ALL SELECT 'overridden', "column",
  CASE WHEN "column" IN ('p_size', 'p_retailprice') THEN 'categorical' ELSE kind END FROM kinds
UNION ALL SELECT 'not_applicable', "column", kind FROM kinds"""


# ---------------------------------------------------------------- copula

ITEMS = "items AS (SELECT *, l_extendedprice * (1.0::DOUBLE - l_discount) AS net FROM lineitem)"
POINTS = "[" + ", ".join(f"{i}::DOUBLE / {STEPS}" for i in range(STEPS + 1)) + "]"


def marginals() -> str:
    parts = [
        f"""SELECT '{c}' AS "column", i AS idx,
  round(q[i + 1], 6) AS quantile, round(CAST(d[(i * (n - 1)) // {STEPS} + 1] AS DOUBLE), 6) AS lower
FROM (SELECT quantile_cont(CAST({c} AS DOUBLE), {POINTS}) AS q, list(CAST({c} AS DOUBLE) ORDER BY {c}) AS d,
  count({c}) AS n FROM items), (SELECT CAST(unnest(range(0, {STEPS + 1})) AS INTEGER) AS i)"""
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "net", "l_partkey")
    ]
    return f"WITH {ITEMS} {union_all(parts)}"


def polynomial(x: str, coefficients) -> str:
    total = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        total = f"({total} * {x} + {c!r}::DOUBLE)"
    return total


def normal_cdf(z: str) -> str:
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + {normal.CDF_SCALE}::DOUBLE * abs({z})))"
    tail = (
        f"({normal.INVERSE_ROOT_TWO_PI}::DOUBLE * exp(-0.5::DOUBLE * {z} * {z}) * {t} * "
        f"{polynomial(t, tuple(reversed(normal.CDF_TERMS)))})"
    )
    return f"CASE WHEN {z} >= 0 THEN 1.0::DOUBLE - {tail} ELSE {tail} END"


def normal_quantile(u: str) -> str:
    def tail(p: str) -> str:
        q = f"sqrt(-2.0::DOUBLE * ln({p}))"
        return (
            f"{polynomial(q, normal.TAIL_NUMERATOR)} / {polynomial(q, normal.TAIL_DENOMINATOR)}"
        )

    q = f"({u} - 0.5::DOUBLE)"
    r = f"({q} * {q})"
    central = (
        f"{q} * {polynomial(r, normal.CENTRAL_NUMERATOR)} / {polynomial(r, normal.CENTRAL_DENOMINATOR)}"
    )
    return (
        f"CASE WHEN {u} < {normal.TAIL_START} THEN {tail(u)} WHEN {u} > 1 - {normal.TAIL_START} "
        f"THEN -({tail(f'(1.0::DOUBLE - {u})')}) ELSE {central} END"
    )


# Score of each hundredth of probability, for columns without repeated grid points.
LEVELS = "[" + ", ".join(
    repr(NormalDist().inv_cdf((i + 0.5) / STEPS)) + "::DOUBLE" for i in range(STEPS)
) + "]"

MODEL = f"""{ITEMS},
grid AS (
  SELECT quantile_cont(l_extendedprice, {POINTS}) AS price, quantile_cont(net, {POINTS}) AS net,
    count(*) AS n FROM items),
quantity_counts AS (SELECT l_quantity, count(*) AS n FROM items GROUP BY l_quantity),
quantity_before AS (
  SELECT l_quantity, n, coalesce(sum(n) OVER (ORDER BY l_quantity
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total
  FROM quantity_counts),
quantities AS (
  SELECT l_quantity, CAST(before + n AS DOUBLE) / total AS upto,
    CAST(2 * before + n AS DOUBLE) / (2 * total) AS middle FROM quantity_before),
quantity_scores AS (SELECT l_quantity, {normal_quantile("middle")} AS z FROM quantities),
scores AS (
  SELECT s.z AS z1,
    {LEVELS}[1 + len(list_filter(grid.price[2:{STEPS}], lambda g: g <= items.l_extendedprice))] AS z2,
    {LEVELS}[1 + len(list_filter(grid.net[2:{STEPS}], lambda g: g <= items.net))] AS z3
  FROM items JOIN quantity_scores s USING (l_quantity), grid),
r AS (
  SELECT round(corr(z1, z2), 6) AS r12, round(corr(z1, z3), 6) AS r13, round(corr(z2, z3), 6) AS r23
  FROM scores)"""

CORRELATION = f"""WITH {MODEL}
SELECT 'l_quantity' AS first, 'l_extendedprice' AS second, r12 AS correlation FROM r
UNION ALL SELECT 'l_quantity', 'net', r13 FROM r
UNION ALL SELECT 'l_extendedprice', 'net', r23 FROM r"""


def normal_draw(digest: str, function: str) -> str:
    u1 = f"((CAST({hex_number(digest, 1, 13)} AS DOUBLE) + 1) / CAST(4503599627370496 AS DOUBLE))"
    return f"sqrt(ln({u1}) * -2.0::DOUBLE) * {function}({uniform(digest, 14)} * {2 * 3.141592653589793!r}::DOUBLE)"


def grid_value(points: str, u: str) -> str:
    at = f"greatest(0, least(CAST(floor({u} * {STEPS}) AS INTEGER), {STEPS - 1}))"
    return f"{points}[{at} + 1] + ({points}[{at} + 2] - {points}[{at} + 1]) * ({u} * {STEPS} - {at})"


# The factor of the correlation is written out for three columns.
SAMPLE = f"""WITH {MODEL},
a AS (SELECT *, sqrt(1 - r12 * r12) AS l22 FROM r),
b AS (SELECT *, (r23 - r13 * r12) / l22 AS l32 FROM a),
factor AS (SELECT *, sqrt(1 - r13 * r13 - l32 * l32) AS l33 FROM b),
ids AS (SELECT unnest(range(0, (SELECT n FROM grid))) AS id),
normals AS (
  SELECT id, {normal_draw(md5_of("normal0", "id"), "cos")} AS e1,
    {normal_draw(md5_of("normal0", "id"), "sin")} AS e2,
    {normal_draw(md5_of("normal1", "id"), "cos")} AS e3 FROM ids),
mixed AS (
  SELECT id, e1 AS z1, e1 * r12 + e2 * l22 AS z2, e1 * r13 + e2 * l32 + e3 * l33 AS z3
  FROM normals, factor),
uniforms AS (
  SELECT id, {normal_cdf("z1")} AS u1, {normal_cdf("z2")} AS u2, {normal_cdf("z3")} AS u3 FROM mixed),
steps AS (SELECT list(upto ORDER BY l_quantity) AS upto, list(l_quantity ORDER BY l_quantity) AS q FROM quantities)
SELECT id, steps.q[1 + len(list_filter(steps.upto[1:len(steps.upto) - 1], lambda g: g <= u1))] AS l_quantity,
  round({grid_value("grid.price", "u2")}, 2) AS l_extendedprice,
  round({grid_value("grid.net", "u3")}, 4) AS net
FROM uniforms, grid, steps"""

def discrete_draws(column: str) -> str:
    return f"""SELECT '{column}' AS "column", id, value FROM (
  SELECT id, least(CAST(floor(u * (SELECT count(*) FROM keyed)) AS BIGINT), (SELECT count(*) FROM keyed) - 1) AS place FROM uniforms) AS d
ASOF JOIN (
  SELECT value, CAST(coalesce(sum(n) OVER (ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM (SELECT {column} AS value, count(*) AS n FROM keyed GROUP BY {column})) AS v ON d.place >= v.before"""


DISCRETE_NUMBERS = f"""WITH keyed AS (
  SELECT (l_partkey * 7919 + l_orderkey) % 1000 AS thousand, (l_partkey * 7919 + l_orderkey) % 1001 AS one_more,
    l_orderkey AS many FROM lineitem),
ids AS (SELECT unnest(range(0, (SELECT count(*) FROM orders))) AS id),
normals AS (SELECT id, {normal_draw(md5_of("normal0", "id"), "cos")} AS z FROM ids),
uniforms AS (SELECT id, {normal_cdf("z")} AS u FROM normals)
{union_all([discrete_draws(c) for c in ("thousand", "one_more", "many")])}"""

SKETCHED_MARGINALS = union_all([
    f"""SELECT '{c}' AS "column", {STEPS + 1} AS real_points, count(*) AS n_rows, true AS within FROM lineitem"""
    for c in ("l_quantity", "l_extendedprice", "l_discount", "net")])


def date_votes() -> str:
    thirds, all_rows = "count(*) FILTER (o_orderkey % 3 = 0)", "count(*)"
    fifths = "count(*) FILTER (o_orderkey % 5 <> 0)"
    cases = {  # votes of both formats, whether the column is a date
        "mostly_first": (f"{all_rows} - {thirds}", thirds, True),
        "mostly_second": (thirds, f"{all_rows} - {thirds}", True),
        "partly": (fifths, "0 * count(*)", False),
        "o_orderpriority": ("0 * count(*)", "0 * count(*)", False),
    }
    parts = []
    for c, (a, b, is_date) in cases.items():
        for votes, other, name, won in ((a, b, "%Y%m%d", f"{a} > 0 AND {a} >= {b}"), (b, a, "%Y-%m-%d", f"{b} > {a}")):
            stored = f"CASE WHEN {a} >= {b} THEN '%Y%m%d' ELSE '%Y-%m-%d' END" if is_date else "NULL"
            conflicts = f"least({a}, {b})" if is_date else "0"
            parts.append(
                f"""SELECT '{c}' AS "column", '{name}' AS datetime_format, {votes} AS votes, {won} AS won,
  {'\'datetime\'' if is_date else '\'categorical\''} AS kind, {stored} AS stored, {conflicts} AS format_conflicts FROM orders""")
    return union_all(parts)


COMBINATIONS = f"""WITH counted AS (
  SELECT p_brand, p_type, count(*) AS n, '["' || p_brand || '","' || p_type || '"]' AS text
  FROM part GROUP BY p_brand, p_type),
shares AS (
  SELECT p_brand, p_type,
    CAST(coalesce(sum(n) OVER (ORDER BY text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      AS DOUBLE) / sum(n) OVER () AS low,
    CAST(sum(n) OVER (ORDER BY text ROWS UNBOUNDED PRECEDING) AS DOUBLE) / sum(n) OVER () AS high
  FROM counted),
ids AS (SELECT unnest(range(0, 1000)) AS id),
normals AS (SELECT id, {normal_draw(md5_of("normal0", "id"), "cos")} AS z FROM ids),
uniforms AS (SELECT id, {normal_cdf("z")} AS u FROM normals)
SELECT id, p_brand, p_type FROM uniforms JOIN shares ON u >= low AND u < high"""


# ---------------------------------------------------------------- evaluation


def ks(column: str, source: str, is_real: str) -> str:
    return f"""SELECT '{column}' AS "column", 'KSComplement' AS metric,
  1 - max(abs(coalesce(r, 0) / tr - coalesce(s, 0) / ts)) AS score FROM (
  SELECT CAST(sum(real) OVER w AS DOUBLE) AS r, CAST(sum(synthetic) OVER w AS DOUBLE) AS s,
    sum(real) OVER () AS tr, sum(synthetic) OVER () AS ts FROM (
    SELECT {column} AS v, count(*) FILTER (WHERE {is_real}) AS real,
      count(*) FILTER (WHERE NOT ({is_real})) AS synthetic FROM {source} GROUP BY {column})
  WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING))"""


def share_gap(keys: str, source: str, is_real: str) -> str:
    return f"""SELECT 1 - sum(abs(CAST(real AS DOUBLE) / tr - CAST(synthetic AS DOUBLE) / ts)) / 2 AS score
  FROM (SELECT real, synthetic, sum(real) OVER () AS tr, sum(synthetic) OVER () AS ts FROM (
    SELECT count(*) FILTER (WHERE {is_real}) AS real,
      count(*) FILTER (WHERE NOT ({is_real})) AS synthetic FROM {source} GROUP BY {keys}))"""


def tv(column: str, source: str, is_real: str) -> str:
    return (
        f"""SELECT '{column}' AS "column", 'TVComplement' AS metric, score """
        f"FROM ({share_gap(column, source, is_real)})"
    )


def contingency(first: str, second: str, source: str, is_real: str) -> str:
    return (
        f"SELECT '{first}' AS first, '{second}' AS second, 'ContingencySimilarity' AS metric, score "
        f"FROM ({share_gap(f'{first}, {second}', source, is_real)})"
    )


def correlation_gap(first: str, second: str, source: str, is_real: str) -> str:
    return f"""SELECT '{first}' AS first, '{second}' AS second, 'CorrelationSimilarity' AS metric,
  1 - abs(corr({first}, {second}) FILTER (WHERE {is_real})
    - corr({first}, {second}) FILTER (WHERE NOT ({is_real}))) / 2 AS score FROM {source}"""


def rounded(sql: str, ctes: str = "") -> str:
    start = f"WITH {ctes}, scored AS (" if ctes else "WITH scored AS ("
    return f"{start}{sql}) SELECT * REPLACE (round(score, 9) AS score) FROM scored"


FLAG_A, OPEN = "l_returnflag = 'A'", "o_orderstatus = 'O'"
SHAPE_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "net", "l_partkey")
PAIR_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "net")


def cut(column: str) -> str:
    """Place of a value among ten equal ranges between the real limits."""
    return (
        f"CAST(greatest(0, least(9, floor(({column} - low_{column}) "
        f"* (10.0::DOUBLE / (high_{column} - low_{column}))))) AS INTEGER) AS {column}"
    )


CUT_ORDERS = f"""numbers AS (
  SELECT o_custkey, o_orderpriority, o_orderstatus, o_totalprice,
    CAST(epoch_us(o_orderdate) AS DOUBLE) AS o_orderdate FROM orders),
limits AS (
  SELECT min(o_totalprice) AS low_o_totalprice, max(o_totalprice) AS high_o_totalprice,
    min(o_orderdate) AS low_o_orderdate, max(o_orderdate) AS high_o_orderdate
  FROM numbers WHERE {OPEN}),
cut_orders AS (
  SELECT o_custkey, o_orderpriority, o_orderstatus, {cut("o_totalprice")}, {cut("o_orderdate")}
  FROM numbers, limits)"""


def boundary(column: str) -> str:
    return f"""SELECT '{column}' AS "column", 'BoundaryAdherence' AS metric,
  avg(CASE WHEN {column} BETWEEN low AND high THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS score
  FROM orders, (SELECT min({column}) AS low, max({column}) AS high FROM orders WHERE {OPEN})
  WHERE NOT ({OPEN})"""


def adherence(column: str) -> str:
    return f"""SELECT '{column}' AS "column", 'CategoryAdherence' AS metric,
  avg(CASE WHEN {column} IN (SELECT {column} FROM orders WHERE {OPEN}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
    AS score FROM orders WHERE NOT ({OPEN})"""


DIAGNOSTIC = rounded(
    union_all(
        [
            """SELECT '*' AS "column", 'TableStructure' AS metric, 1.0::DOUBLE AS score""",
            *[boundary(c) for c in ("o_totalprice", "o_orderdate")],
            *[adherence(c) for c in ("o_custkey", "o_orderpriority")],
        ]
    )
)

QUALITY = f"""WITH {CUT_ORDERS},
shapes AS ({union_all([
    ks("o_totalprice", "orders", OPEN), ks("o_orderdate", "orders", OPEN),
    tv("o_custkey", "orders", OPEN), tv("o_orderpriority", "orders", OPEN),
])}),
pairs AS ({union_all([
    correlation_gap("o_totalprice", "o_orderdate", "numbers", OPEN),
    *[
        contingency(a, b, "cut_orders", OPEN)
        for a, b in (
            ("o_totalprice", "o_custkey"), ("o_totalprice", "o_orderpriority"),
            ("o_orderdate", "o_custkey"), ("o_orderdate", "o_orderpriority"),
            ("o_custkey", "o_orderpriority"),
        )
    ],
])}),
properties AS (
  SELECT 'Column Shapes' AS property, avg(score) AS score FROM shapes
  UNION ALL SELECT 'Column Pair Trends', avg(score) FROM pairs)
SELECT property, round(score, 9) AS score FROM properties
UNION ALL SELECT 'Overall', round(avg(score), 9) FROM properties"""

VERSIONS = """WITH found AS (SELECT DISTINCT p_brand, p_size AS version FROM part),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY version) AS place FROM found)
SELECT p_brand, max(version) FILTER (WHERE version = place) AS latest_version
FROM placed GROUP BY p_brand"""

HEAD = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem
ORDER BY ALL LIMIT 10"""

# ---------------------------------------------------------------- written and read again

LAYOUT_FILE = f"""SELECT Column_Name, Length, Type, Start, TRUE AS unnumbered FROM ({layout_offsets()})"""

CUSTOMERS = """SELECT c_custkey, c_name, c_acctbal, 'int' AS c_custkey_type, 'double' AS c_acctbal_type
FROM customer"""

STORED_METADATA = f"""WITH kinds AS ({kinds("part")})
SELECT 'first' AS step, "column", kind AS sdtype FROM kinds
UNION ALL SELECT 'latest', 'p_size', 'categorical'"""

GENERATED_FILE = (
    "WITH ids AS (SELECT unnest(range((SELECT count(*) FROM orders))) AS id), made AS (SELECT "
    + ", ".join(f"trim({claim_value(name, width, kind, 'id')}) AS {name}" for name, width, kind in CLAIM_FIELDS)
    + " FROM ids) SELECT * FROM made"
)

FRESH_IDS = """SELECT 'c_custkey' AS "column", count(*) AS n, count(*) AS n_distinct,
  max(length(CAST(c_custkey AS VARCHAR))) AS width, '' AS prefix FROM customer
UNION ALL SELECT 'c_name', count(*), count(*), max(length(c_name)), 'Customer#' FROM customer"""

NUMERIC_TRAILERS = f"""WITH totals AS (
  SELECT o_orderstatus AS file, count(*) AS n, CAST(coalesce(sum(CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0
    THEN CAST(floor(o_totalprice) AS BIGINT) END), 0) AS BIGINT) AS net FROM orders GROUP BY o_orderstatus)
SELECT file, {trailer("n", "net", "0", "0")} AS line FROM totals"""

ID_DIAGNOSTIC = """SELECT * FROM (VALUES ('sampled', '*', 'TableStructure', 1.0), ('repeated', '*', 'TableStructure', 1.0),
  ('sampled', 'c_custkey', 'KeyUniqueness', 1.0), ('sampled', 'c_name', 'KeyUniqueness', 1.0),
  ('repeated', 'c_custkey', 'KeyUniqueness', 0.0), ('repeated', 'c_name', 'KeyUniqueness', 0.0))
  AS t(case_name, "column", metric, score) WHERE (SELECT count(*) FROM customer) > 2"""

HEADERS = """SELECT DISTINCT o_orderstatus AS file, 1 AS line_no, 'PA' AS mark, 10 AS width FROM orders"""

CATEGORIES = """WITH codes AS (
  SELECT CASE WHEN o_orderkey % 12000 <> 7 THEN 'k' || CAST(o_orderkey % 12000 AS VARCHAR) END AS value FROM orders),
counts AS (SELECT value, count(*) AS n FROM codes GROUP BY value)
SELECT value, n, coalesce(sum(n) OVER (ORDER BY value NULLS FIRST
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM counts"""


TRAILER_RECONCILIATION = f"""WITH details AS (
  SELECT o_orderstatus AS file, o_orderkey // 500 AS page, {cents("o_totalprice")} AS amount FROM orders),
pages AS (SELECT file, page, count(*) AS n, sum(amount) AS total FROM details GROUP BY ALL),
closing AS (SELECT file, page FROM pages WHERE file <> 'P' OR page % 9 <> 4),
-- A page without a trailer goes on to the next one, or to the end of the file.
closed AS (
  SELECT p.file, (SELECT min(c.page) FROM closing c WHERE c.file = p.file AND c.page >= p.page) AS page, n, total FROM pages p),
found AS (
  SELECT c.file, c.page, sum(c.n) AS counted_rows, sum(c.total) AS counted_total, any_value(d.n) AS own_n, any_value(d.total) AS own_total
  FROM closed c LEFT JOIN pages d ON d.file = c.file AND d.page = c.page GROUP BY c.file, c.page),
declared AS (
  SELECT *, CASE WHEN page % 11 <> 6 THEN own_n + CASE WHEN page % 7 = 3 THEN 1 ELSE 0 END END AS declared_rows,
    CASE WHEN page % 11 <> 6 THEN own_total + CASE WHEN page % 5 = 2 THEN 100 ELSE 0 END END AS declared_total FROM found)
SELECT file, page * 1000 + 999 AS line_no, declared_rows, counted_rows, declared_total, counted_total,
  CASE WHEN page IS NULL THEN 'unclosed' WHEN declared_rows IS NULL THEN 'unreadable'
    WHEN declared_rows = counted_rows AND declared_total = counted_total THEN 'equal'
    WHEN declared_total = counted_total THEN 'rows' WHEN declared_rows = counted_rows THEN 'total' ELSE 'both' END AS status
FROM declared"""


def sketched_shapes() -> str:
    scores = rounded(union_all([ks(c, "items", FLAG_A) for c in SHAPE_COLUMNS]), ITEMS)
    return f"""SELECT "column", score, true AS held, true AS narrow FROM ({scores})"""


ORACLE = {
    "q01_layout_offsets": layout_offsets(),
    "q02_render_lines": f"WITH {ORDER_LINES} SELECT o_orderkey, value AS line FROM order_lines",
    "q03_parse_lines": parse_lines(),
    "q04_route_records": ROUTE,
    "q05_date_coerce": DATES,
    "q06_amount_decode": AMOUNT_TOTALS,
    "q07_mask_ids": MASK,
    "q08_null_normalise": GAPS,
    "q09_non_null_counts": NON_NULL,
    "q10_page_trailer": TRAILER,
    "q11_positional_to_table": CLAIM_TABLE,
    "q12_generate_claims": CLAIM_LINES,
    "q13_detect_kinds": union_all([kinds("lineitem"), kinds("part")]),
    "q14_copula_marginals": marginals(),
    "q15_copula_correlation": CORRELATION,
    "q16_copula_sample": SAMPLE,
    "q17_fixed_combinations": COMBINATIONS,
    "q41_discrete_numbers": DISCRETE_NUMBERS,
    "q42_sketched_marginals": SKETCHED_MARGINALS,
    "q43_sketched_shapes": sketched_shapes(),
    "q44_date_votes": date_votes(),
    "q45_trailer_reconciliation": TRAILER_RECONCILIATION,
    "q18_shape_numeric": rounded(union_all([ks(c, "items", FLAG_A) for c in SHAPE_COLUMNS]), ITEMS),
    "q19_shape_categorical": rounded(
        union_all([tv(c, "orders", OPEN) for c in ("o_orderpriority", "o_custkey", "o_orderdate")])
    ),
    "q20_pair_correlation": rounded(
        union_all(
            [
                correlation_gap(a, b, "items", FLAG_A)
                for i, a in enumerate(PAIR_COLUMNS)
                for b in PAIR_COLUMNS[i + 1 :]
            ]
        ),
        ITEMS,
    ),
    "q21_pair_contingency": rounded(
        union_all(
            [
                contingency("o_orderpriority", "o_custkey", "cut_orders", OPEN),
                contingency("o_totalprice", "o_orderpriority", "cut_orders", OPEN),
            ]
        ),
        CUT_ORDERS,
    ),
    "q22_diagnostic": DIAGNOSTIC,
    "q23_claim_file": CLAIM_FILE,
    "q24_metadata_versions": VERSIONS,
    "q25_head": HEAD,
    "q26_claims_roundtrip": roundtrip(),
    "q27_kind_override": KIND_OVERRIDE,
    "q28_amount_values": AMOUNT_VALUES,
    "q29_quality_report": QUALITY,
    "q30_parsed_trailers": PARSED_TRAILERS,
    "q31_layout_file": LAYOUT_FILE,
    "q32_written_sections": f"SELECT file, line FROM ({CLAIM_FILE})",
    "q33_delimited_roundtrip": CUSTOMERS,
    "q34_stored_metadata": STORED_METADATA,
    "q35_generated_file": GENERATED_FILE,
    "q36_fresh_ids": FRESH_IDS,
    "q37_header_synthesis": HEADERS,
    "q38_category_marginal": CATEGORIES,
    "q39_numeric_trailers": NUMERIC_TRAILERS,
    "q40_id_diagnostic": ID_DIAGNOSTIC,
}
