"""The canonical tables expressed over a generic star schema.

Every table is a lazy projection of one or two star tables, so unused columns are never
read. ``plans.prelude`` states the same mapping as SQL for checks on another engine.

========================  =====================================================
properties                supplier with nation and region
units                     part
tenants                   customer
leases                    orders
payments                  lineitem
maintenance_requests      events
vendors                   nation
work_orders               events whose request has been dispatched
========================  =====================================================
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SCHEMAS, Tables

AS_OF = date(1998, 7, 1)

_EPOCH = "TIMESTAMP '1995-01-01 00:00:00'"

# Declared, so that opening a file starts no job to infer its schema.
STAR_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(STAR_SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def _count(spark: SparkSession, folder: str, name: str) -> Column:
    """Row count as a scalar subquery (one row, computed from file footers)."""
    return _read(spark, folder, name).agg(F.count("*")).scalar()


def _request_status(key: str) -> str:
    return (
        f"CASE {key} % 10 WHEN 0 THEN 'open' WHEN 1 THEN 'assigned' WHEN 2 THEN 'in_progress' "
        "WHEN 3 THEN 'on_hold' WHEN 4 THEN 'cancelled' ELSE 'closed' END"
    )


def _properties(spark: SparkSession, folder: str) -> DataFrame:
    return (
        _read(spark, folder, "supplier")
        .join(_read(spark, folder, "nation").withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey")
        .join(_read(spark, folder, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
        .selectExpr(
            "s_suppkey AS property_id",
            "concat('S', s_suppkey) AS property_code",
            "s_name AS property_name",
            "concat(s_name, ', ', n_name) AS address_line1",
            "n_name AS city",
            "left(r_name, 2) AS state_code",
            "lpad(string(bigint(floor(abs(s_acctbal)))), 5, '0') AS postal_code",
            "concat('Team ', r_name) AS manager_name",
            "date_add(DATE '1990-01-01', int(s_suppkey % 2000)) AS acquisition_date",
            "s_suppkey % 9 <> 7 AS is_active",
            f"{_EPOCH} AS created_at",
            f"{_EPOCH} AS updated_at",
        )
    )


def _units(spark: SparkSession, folder: str) -> DataFrame:
    # The last property gets no units.
    with_units = _count(spark, folder, "supplier") - 1
    return (
        _read(spark, folder, "part")
        .withColumn("property_id", F.col("p_partkey") % with_units)
        .selectExpr(
            "p_partkey AS unit_id",
            "property_id",
            "concat(p_name, '-', p_partkey) AS unit_number",
            "smallint(p_size % 5) AS bedrooms",
            "CAST(1 + p_size % 4 * 0.5 AS DECIMAL(3,1)) AS bathrooms",
            "300 + p_size * 20 AS square_feet",
            "CAST(p_retailprice AS DECIMAL(12,2)) AS market_rent",
            "CASE WHEN p_size > 48 THEN 'offline' WHEN p_size > 46 THEN 'maintenance' "
            "WHEN p_size > 30 THEN 'vacant' ELSE 'occupied' END AS unit_status",
            f"{_EPOCH} AS created_at",
            f"{_EPOCH} AS updated_at",
        )
    )


def _tenants(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "customer").selectExpr(
        "c_custkey AS tenant_id",
        "c_name AS first_name",
        "c_mktsegment AS last_name",
        "concat(lower(c_mktsegment), '.', c_custkey, '@mail.invalid') AS email",
        "concat('+', 100 + c_nationkey, ' ', c_custkey) AS phone",
        "IF(c_acctbal >= 0, concat('c/o ', c_name), NULL) AS emergency_contact",
        f"{_EPOCH} AS created_at",
        f"{_EPOCH} AS updated_at",
    )


def _leases(spark: SparkSession, folder: str) -> DataFrame:
    return (
        _read(spark, folder, "orders")
        .withColumn("unit_id", F.col("o_orderkey") % _count(spark, folder, "part"))
        .selectExpr(
            "o_orderkey AS lease_id",
            "unit_id",
            "o_custkey AS tenant_id",
            "date(o_orderdate) AS start_date",
            "date_add(o_orderdate, int(30 + o_orderkey % 500)) AS end_date",
            "CAST(o_totalprice AS DECIMAL(12,2)) AS monthly_rent",
            "CAST(o_totalprice AS DECIMAL(12,2)) AS security_deposit",
            "IF(o_orderstatus = 'F', 'expired', 'active') AS lease_status",
            "timestamp(o_orderdate) AS created_at",
            "timestamp(o_orderdate) AS updated_at",
        )
    )


# Columns that together identify a line, and two rows of factors for a surrogate key.
_LINE_KEY = (
    "l_orderkey",
    "l_partkey",
    "l_suppkey",
    "bigint(l_linenumber)",
    "bigint(datediff(l_shipdate, DATE '1970-01-01'))",
)
KEY_MODULUS = 2_147_483_647
KEY_FACTORS = (
    (1_103_515_245, 69_069_931, 16_807_003, 48_271_019, 1_664_525_083),
    (214_013_123, 1_812_433_253, 22_695_477, 134_775_813, 1_140_671_485),
)


def line_key(columns: tuple[str, ...] = _LINE_KEY) -> str:
    """A 62-bit surrogate key: two linear hashes of the line's columns side by side.

    Plain integer arithmetic that cannot overflow and reads the same in every SQL engine.
    """
    high, low = (
        "(" + " + ".join(f"({c} % {KEY_MODULUS}) * {f} % {KEY_MODULUS}" for c, f in zip(columns, factors)) + ")"
        for factors in KEY_FACTORS
    )
    return f"{high} % {KEY_MODULUS} * {KEY_MODULUS} + {low} % {KEY_MODULUS}"


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "lineitem").withColumns(
        {
            "payment_id": F.expr(line_key()),
            "amount_due": F.col("l_extendedprice").cast("decimal(12,2)"),
            "payment_status": F.expr(
                "CASE WHEN l_returnflag = 'R' THEN IF(l_quantity >= 49, 'waived', 'pending') "
                "WHEN l_discount >= 0.08D THEN 'partial' WHEN l_tax >= 0.07D THEN 'late' ELSE 'paid' END"
            ),
        }
    )


def _payments(spark: SparkSession, folder: str) -> DataFrame:
    # Stated on the stored columns: filters on a derived column are inlined down to the scan.
    nothing_paid, part_paid = "l_returnflag = 'R'", "l_discount >= 0.08D"
    return _lines(spark, folder).selectExpr(
        "payment_id",
        "l_orderkey AS lease_id",
        "concat_ws('-', 'PAY', l_orderkey, l_linenumber, l_partkey, l_suppkey, date_format(l_shipdate, 'yyyyMMdd')) "
        "AS payment_reference",
        "date(l_shipdate) AS due_date",
        f"IF({nothing_paid}, NULL, date_add(l_shipdate, 2 + l_linenumber)) AS paid_date",
        "amount_due",
        f"CAST(CASE WHEN {nothing_paid} THEN 0 WHEN {part_paid} THEN round(amount_due * 0.4, 2) "
        "ELSE amount_due END AS DECIMAL(12,2)) AS amount_paid",
        "payment_status",
        f"IF({nothing_paid}, NULL, element_at(array('ach', 'card', 'check', 'bank_transfer'), l_linenumber % 4 + 1)) "
        "AS payment_method",
        "timestamp(l_shipdate) AS created_at",
        "timestamp(l_shipdate) AS updated_at",
    )


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    return (
        _read(spark, folder, "events")
        .withColumn("unit_id", (F.col("user_id") * 101 + F.col("event_id")) % _count(spark, folder, "part"))
        .selectExpr(
            "event_id AS request_id",
            "unit_id",
            "IF(user_id % 12 = 5, NULL, user_id) AS tenant_id",
            "concat(event_type, ' request') AS title",
            "concat('Reported by user ', user_id, ' ', props) AS description",
            "CASE event_type WHEN 'error' THEN 'emergency' WHEN 'signup' THEN 'high' WHEN 'purchase' THEN 'medium' "
            "ELSE 'low' END AS priority",
            f"{_request_status('event_id')} AS request_status",
            "timestamp(ts) AS created_at",
            "IF(event_id % 10 > 4, timestamp(ts) + make_dt_interval(0, 0, 0, floor(value * 3600)), NULL) AS closed_at",
            "timestamp(ts) AS updated_at",
        )
    )


def _vendors(spark: SparkSession, folder: str) -> DataFrame:
    regions = _read(spark, folder, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return _read(spark, folder, "nation").join(regions, "n_regionkey").selectExpr(
        "bigint(n_nationkey) AS vendor_id",
        "n_name AS vendor_name",
        "r_name AS specialty",
        "concat(lower(n_name), '@trade.invalid') AS email",
        "concat('+', 900 + n_regionkey, ' ', n_nationkey) AS phone",
        "CAST(40 + n_regionkey * 3.25 + n_nationkey AS DECIMAL(10,2)) AS hourly_rate",
        "true AS is_active",
        f"{_EPOCH} AS created_at",
    )


def _work_orders(spark: SparkSession, folder: str) -> DataFrame:
    # Some closed requests keep an unfinished order, as in real operations.
    return (
        _requests(spark, folder)
        .filter("request_status <> 'on_hold'")
        .withColumn("vendor", F.col("unit_id") % _count(spark, folder, "nation"))
        .selectExpr(
            "*",
            "created_at + INTERVAL 2 HOURS AS assigned_at",
            "request_status = 'closed' AND request_id % 10 <> 9 AS done",
        )
        .selectExpr(
            "request_id AS work_order_id",
            "request_id",
            "IF(unit_id % 19 = 5, NULL, vendor) AS vendor_id",
            "assigned_at",
            "date_add(created_at, 1) AS scheduled_date",
            "IF(done, greatest(closed_at, assigned_at), NULL) AS completed_at",
            "CAST(IF(done, 9.5 * length(title) + unit_id % 50, 0) AS DECIMAL(12,2)) AS labor_cost",
            "CAST(IF(done, 4.75 * (request_id % 21), 0) AS DECIMAL(12,2)) AS material_cost",
            "CASE WHEN done THEN 'completed' WHEN request_status IN ('closed', 'in_progress') THEN 'in_progress' "
            "WHEN request_status = 'assigned' THEN 'scheduled' WHEN request_status = 'cancelled' THEN 'cancelled' "
            "ELSE 'assigned' END AS work_order_status",
            "concat('Order for request ', request_id) AS notes",
            "assigned_at AS created_at",
            "assigned_at AS updated_at",
        )
    )


_BUILDERS = {
    "properties": _properties,
    "units": _units,
    "tenants": _tenants,
    "leases": _leases,
    "payments": _payments,
    "maintenance_requests": _requests,
    "vendors": _vendors,
    "work_orders": _work_orders,
}


def star_tables(spark: SparkSession, folder: str) -> Tables:
    """The canonical tables over the star files in ``folder``; each is set up when first used."""

    def later(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[], DataFrame]:
        return lambda: build(spark, folder)

    return Tables(**{name: later(build) for name, build in _BUILDERS.items()})


def damaged_tables(spark: SparkSession, folder: str) -> Tables:
    """The same portfolio after a bad import, for the quality rules.

    Some parents are gone, some charges were replayed under a new reference and some
    values break a constraint.
    """
    clean = star_tables(spark, folder)

    def payments() -> DataFrame:
        amount = F.expr("CAST(IF(lease_id % 101 = 1, amount_due + 1, amount_paid) AS DECIMAL(12,2))")
        replayed = clean.payments.filter("lease_id % 500 = 0").withColumns(
            {
                "payment_id": -F.col("payment_id") - 1,
                "payment_reference": F.concat("payment_reference", F.lit("-RETRY")),
            }
        )
        return clean.payments.withColumn("amount_paid", amount).unionByName(replayed)

    def leases() -> DataFrame:
        inverted = F.expr("IF(lease_id % 101 = 0, start_date, end_date)")
        return clean.leases.filter("lease_id % 83 <> 0").withColumn("end_date", inverted)

    def requests() -> DataFrame:
        closed = F.expr("CASE request_id % 101 WHEN 0 THEN NULL WHEN 1 THEN created_at ELSE closed_at END")
        return clean.maintenance_requests.filter("request_id % 79 <> 0").withColumn("closed_at", closed)

    return clean.with_(
        tenants=lambda: clean.tenants.filter("tenant_id % 97 <> 0"),
        units=lambda: clean.units.filter("unit_id % 89 <> 0"),
        leases=leases,
        payments=payments,
        maintenance_requests=requests,
    )


#: Rows of a broken import repeat their kinds of damage after so many keys.
DAMAGE_CYCLE = 31
_OUT_OF_RANGE = {
    "units": {
        "bedrooms": "CAST(9 AS SMALLINT)", "bathrooms": "CAST(9.5 AS DECIMAL(3,1))", "square_feet": "149",
        "market_rent": "CAST(0 AS DECIMAL(12,2))", "unit_status": "'haunted'",
    },
    "leases": {
        "monthly_rent": "CAST(0 AS DECIMAL(12,2))", "security_deposit": "CAST(-1 AS DECIMAL(12,2))", "lease_status": "'lost'",
        "end_date": "start_date",
    },
    "payments": {
        "amount_due": "CAST(0 AS DECIMAL(12,2))", "amount_paid": "CAST(-1 AS DECIMAL(12,2))", "payment_status": "'unknown'",
        "payment_method": "'barter'",
    },
    "maintenance_requests": {"priority": "'whenever'", "request_status": "'lost'", "closed_at": "created_at - INTERVAL 1 DAY"},
    "vendors": {"hourly_rate": "CAST(0 AS DECIMAL(10,2))"},
    "work_orders": {
        "labor_cost": "CAST(-1 AS DECIMAL(12,2))", "material_cost": "CAST(-1 AS DECIMAL(12,2))", "work_order_status": "'lost'",
        "completed_at": "assigned_at - INTERVAL 1 DAY",
    },
}
_PARENTS = {
    "units": ("property_id",), "leases": ("unit_id", "tenant_id"), "payments": ("lease_id",),
    "maintenance_requests": ("unit_id", "tenant_id"), "work_orders": ("request_id", "vendor_id"),
}


def broken_tables(spark: SparkSession, folder: str) -> Tables:
    """The portfolio after an import without any constraint: every rule of the schema is broken somewhere.

    The remainder of a row's key by ``DAMAGE_CYCLE`` says what is wrong with it: required columns are missing in
    turn (from 1 on), the row comes twice (20) or once more without its key (21), values are out of range in turn (22 to
    26), parents do not exist (28), a status contradicts the other columns (29).
    """
    clean = star_tables(spark, folder)

    def broken(name: str) -> DataFrame:
        df, key = getattr(clean, name), SCHEMAS[name][0].name
        kind = F.pmod(F.col(key), F.lit(DAMAGE_CYCLE))
        required = [f.name for f in SCHEMAS[name] if not f.nullable and f.name != key]
        wrong = {column: [(at, "NULL")] for at, column in enumerate(required, start=1)}
        for at, (column, value) in enumerate(_OUT_OF_RANGE.get(name, {}).items(), start=22):
            wrong.setdefault(column, []).append((at, value))
        for column in _PARENTS.get(name, ()):
            wrong.setdefault(column, []).append((28, "-1L"))
        if name == "payments":
            wrong["payment_status"].append((29, "'pending'"))
            wrong.setdefault("paid_date", []).append((29, "due_date"))
            wrong["amount_paid"].append((30, "CAST(amount_due + 1 AS DECIMAL(12,2))"))
        if name == "maintenance_requests":
            wrong["request_status"].append((29, "'closed'"))
            wrong["closed_at"].append((29, "NULL"))
        if name == "work_orders":
            wrong["work_order_status"].append((29, "'completed'"))
            wrong["completed_at"].append((29, "NULL"))
        case = lambda c: F.expr(
            f"CASE pmod({key}, {DAMAGE_CYCLE}) " + " ".join(f"WHEN {at} THEN {value}" for at, value in wrong[c]) + f" ELSE {c} END"
        )
        # Copies are made in the scan, so that the table is read once; remainders 20 and 21 have no other damage.
        copied = df.withColumn("_copy", F.explode(F.when(kind.isin(20, 21), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        nameless = (kind == 21) & (F.col("_copy") == 1)
        values = {c: case(c).cast(df.schema[c].dataType) if c in wrong else F.col(c) for c in df.columns}
        values[key] = F.when(~nameless, F.col(key))
        return copied.select(*[value.alias(c) for c, value in values.items()])

    return Tables(**{name: (lambda name=name: broken(name)) for name in _BUILDERS})


def document_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Maintenance requests whose description is a long text, for the text search."""
    opened = "timestamp(TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, int(doc_id)))"
    return (
        _read(spark, folder, "documents")
        .withColumn("unit_id", F.col("doc_id") * 3 % _count(spark, folder, "part"))
        .selectExpr(
            "doc_id AS request_id",
            "unit_id",
            "CAST(NULL AS BIGINT) AS tenant_id",
            "concat(source, ' ', lang) AS title",
            "text AS description",
            "'medium' AS priority",
            f"{_request_status('doc_id')} AS request_status",
            f"{opened} AS created_at",
            f"IF(doc_id % 10 > 4, {opened}, NULL) AS closed_at",
            f"{opened} AS updated_at",
        )
    )


def lease_proposals(spark: SparkSession, folder: str) -> DataFrame:
    """Renewal proposals, one per order; a few name unknown parties or break a rule."""
    key = F.col("o_orderkey")
    return (
        _read(spark, folder, "orders")
        .withColumn("unit_id", key * 31 % (_count(spark, folder, "part") + 20))
        .withColumn("tenant_id", (key * 11 + 3) % (_count(spark, folder, "customer") + 5))
        .selectExpr(
            "o_orderkey AS proposal_id",
            "IF(o_orderkey % 59 = 0, 'tenant', ' Operations') AS role",
            "IF(o_orderkey % 53 = 0, NULL, unit_id) AS unit_id",
            "tenant_id",
            "date_add(o_orderdate, 200) AS start_date",
            "date_add(o_orderdate, int(196 + o_orderkey % 400)) AS end_date",
            "CAST(IF(o_orderkey % 43 = 0, 0D, o_totalprice) AS DECIMAL(12,2)) AS monthly_rent",
            "CAST(CASE WHEN o_orderkey % 47 = 0 THEN -1D WHEN o_orderkey % 3 = 0 THEN o_totalprice END "
            "AS DECIMAL(12,2)) AS deposit",
        )
    )


# The requested targets, one of them unknown.
TARGETS = ("open", "assigned", "in_progress", "on_hold", "closed", "cancelled", "reopened")


def status_events(spark: SparkSession, folder: str) -> DataFrame:
    """Status changes asked for by three roles; some requests get several."""
    return _read(spark, folder, "events").selectExpr(
        "event_id",
        "IF(event_id % 29 = 0, -event_id - 1, event_id * 3 DIV 4) AS request_id",
        "IF(event_id % 23 = 0, 'guest', element_at(array('vendor', 'tenant', 'property_manager'), int(event_id % 3 + 1))) AS role",
        f"element_at(array{TARGETS}, int(event_id % 7 + 1)) AS new_status",
        "timestamp(ts) + INTERVAL 40 DAYS AS event_ts",
    )


def payment_events(spark: SparkSession, folder: str) -> DataFrame:
    """Requests to pay every charge; those with a line number from 6 on come twice."""
    paid_at = "timestamp(l_shipdate) + make_dt_interval(10 + attempt)"
    return (
        _lines(spark, folder)
        .selectExpr("*", "explode(IF(l_linenumber >= 6, array(0, 1), array(0))) AS attempt")
        .selectExpr(
            "IF(attempt = 0, payment_id, -payment_id - 1) AS event_id",
            "payment_id",
            "element_at(array('tenant', 'property_manager', 'vendor', 'support_engineer', 'tenant'), int(payment_id % 5 + 1)) AS role",
            f"{paid_at} AS event_ts",
        )
    )


def new_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Tickets opened in conversations: every turn is one."""
    key = "(conv_id * 1000 + turn)"
    return (
        _read(spark, folder, "conversations")
        .withColumn("unit_id", F.expr(key) % (_count(spark, folder, "part") + 20))
        .selectExpr(
            f"{key} AS event_id",
            f"IF({key} % 19 = 0, 'vendor', 'tenant') AS role",
            f"CASE WHEN {key} % 37 = 0 THEN NULL WHEN {key} % 47 = 0 THEN -1L ELSE unit_id END AS unit_id",
            f"IF({key} % 41 = 0, NULL, text) AS title",
            "IF(turn > 0, concat(' ', text), NULL) AS description",
            f"element_at(array('HIGH', 'urgent', ' low ', NULL), int({key} % 4 + 1)) AS priority",
            f"CASE WHEN {key} % 43 = 0 THEN -1L WHEN {key} % 5 = 0 THEN NULL ELSE conv_id % 50 END AS tenant_id",
            f"timestamp(TIMESTAMP_NTZ '2024-03-01 00:00:00' + make_dt_interval(0, 0, 0, {key})) AS event_ts",
        )
    )


def rolled_over(leases: DataFrame) -> DataFrame:
    """Leases after the nightly status run: ended ones are no longer active."""
    ended = (F.col("lease_status") == "active") & (F.col("end_date") < F.lit(AS_OF))
    return leases.withColumn("lease_status", F.when(ended, "expired").otherwise(F.col("lease_status")))


# What a batch of changes does to one column of each table.
_ALTERED = {
    "properties": ("manager_name", "concat('New ', manager_name)"),
    "units": ("market_rent", "CAST(market_rent + 10 AS DECIMAL(12,2))"),
    "tenants": ("phone", "concat(phone, '0')"),
    "leases": ("monthly_rent", "CAST(monthly_rent + 25 AS DECIMAL(12,2))"),
    "payments": ("payment_method", "'cash'"),
    "maintenance_requests": ("priority", "'high'"),
    "work_orders": ("notes", "concat(notes, ' (changed)')"),
}


def table_changes(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A batch of changes to one of the tables that keep ``updated_at``, made from its own rows.

    By the remainder of a row's key by 17: deleted (1), altered (2), altered and altered back (3), put with equal
    values (4), put once more under a new key (5), an unknown row deleted (6), put without a key (7).
    """
    table, key = getattr(star_tables(spark, folder), name), SCHEMAS[name][0].name
    column, value = _ALTERED[name]
    batch = table.withColumn("kind", F.pmod(F.col(key), F.lit(17))).filter("kind BETWEEN 1 AND 7")
    steps = batch.withColumn("step", F.expr("explode(IF(kind = 3, array(0, 1), array(0)))"))
    number = f"{key} * 2 + step"
    altered = f"IF(kind = 2 OR (kind = 3 AND step = 0), {value}, {column})"
    new_key = f"CASE kind WHEN 5 THEN -{key} - 1 WHEN 6 THEN -{key} - 1 WHEN 7 THEN NULL ELSE {key} END"
    columns = [c for c in table.columns if c not in (key, "created_at", "updated_at")]
    return steps.selectExpr(
        f"{number} AS change_id",
        "IF(kind IN (1, 6), 'delete', 'put') AS action",
        f"{new_key} AS {key}",
        *[f"{altered} AS {c}" if c == column else c for c in columns],
    )
