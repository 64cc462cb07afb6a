"""From delivered layouts to long readings: customer_id, date, consumption_kwh, fraud_label."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from wattlens import constants as K
from wattlens.functions.columns import num, ratio
from wattlens.operators.clean import coerce_numeric, parse_date
from wattlens.plans.joins import lookup_join
from wattlens.sources.detect import Layout, header_date
from wattlens.sources.readers import generated_ids


SEQUENCE = "_sequence"  # optional column with the place of a row in the delivered file


def in_file_order(df: DataFrame) -> DataFrame:
    """Add the place of each row in the scan, by which the first of several labels is found later."""
    return df.withColumn(SEQUENCE, F.monotonically_increasing_id())


def quoted(name: str):
    return F.col(f"`{name}`")


def latest_days(days: dict[str, dt.date], max_days: int | None) -> dict[str, dt.date]:
    """Day columns in date order, the most recent ones only. Chosen before the unpivot, so that the scan
    reads just these columns."""
    ordered = sorted(days.items(), key=lambda item: item[1])
    if max_days and max_days > 0:
        ordered = ordered[-max_days:]
    return dict(ordered)


def wide_to_long(df: DataFrame, id_column: str, days: dict[str, dt.date], label: str | None = None) -> DataFrame:
    """One row per customer and day column."""
    fixed = [quoted(id_column).cast("string").alias("customer_id")]
    fixed.append(num(quoted(label)).alias("fraud_label") if label
                 else F.lit(None).cast("double").alias("fraud_label"))
    names = [d.isoformat() for d in days.values()]
    if len(set(names)) < len(names):  # the same day under two headers keeps both readings
        names = [f"{n}#{i}" for i, n in enumerate(names)]
    measures = [coerce_numeric(quoted(c).cast("string")).alias(n) for c, n in zip(days, names)]
    order = [SEQUENCE] if SEQUENCE in df.columns else []
    slim = df.select(*fixed, *measures, *order)
    long = slim.unpivot(["customer_id", "fraud_label", *order], [quoted(n) for n in names], "day", "consumption_kwh")
    return long.select("customer_id", F.to_date(F.substring("day", 1, 10)).alias("date"),
                       "consumption_kwh", "fraud_label", *order)


def rename_long(df: DataFrame, id_column: str, date: str, consumption: str, label: str | None = None,
                extras: list[str] | None = None) -> DataFrame:
    """Rename to the canonical columns; every known customer column is carried along."""
    extras = [c for c in [*(K.CUSTOMER_COLUMNS if extras is None else extras), SEQUENCE] if c in df.columns]
    fraud = num(quoted(label)) if label else F.lit(None).cast("double")
    return df.select(quoted(id_column).cast("string").alias("customer_id"),
                     parse_date(quoted(date)).alias("date"),
                     coerce_numeric(quoted(consumption).cast("string")).alias("consumption_kwh"),
                     fraud.alias("fraud_label"), *[quoted(c) for c in extras])


def to_long(df: DataFrame, layout: Layout, max_customers: int | None = None,
            max_days: int | None = None, seed: int = 42) -> DataFrame:
    """Long readings from a table whose layout is known."""
    id_column = layout.id_column
    if id_column is None or id_column not in df.columns:
        id_column = "Generated Customer ID"
        df = generated_ids(df, id_column)
    if max_customers and max_customers > 0:
        df = sample_customers(df, id_column, max_customers, seed)
    if layout.kind == "wide":
        return wide_to_long(df, id_column, latest_days(layout.day_columns, max_days), layout.label_column)
    return rename_long(df, id_column, layout.date_column, layout.consumption_column, layout.label_column)


def mapped_day(name: str) -> dt.date | None:
    """The day of a header that was picked by hand: the strict forms, then dates with a time or with month names."""
    day = header_date(name)
    if day is not None:
        return day
    text = " ".join(name.replace(",", " ").split())
    for form in K.MAPPED_DAY_FORMATS:
        try:
            return dt.datetime.strptime(text, form).date()
        except ValueError:
            continue
    return None


def apply_mapping(df: DataFrame, mapping: dict, max_customers: int | None = None,
                  max_days: int | None = None, seed: int = 42) -> DataFrame:
    """Long readings from a mapping given by hand: schema_type, customer_col, label_col, and date_cols (wide)
    or date_col and consumption_col (long)."""
    id_column, label = mapping.get("customer_col"), mapping.get("label_col")
    if not id_column or id_column not in df.columns:
        raise ValueError("the mapping needs a customer column that exists")
    label = label if label in df.columns else None
    if max_customers and max_customers > 0:
        df = sample_customers(df, id_column, max_customers, seed)
    if str(mapping.get("schema_type", "wide")).lower() == "wide":
        days = {c: mapped_day(c) for c in mapping.get("date_cols", []) if c in df.columns}
        days = {c: d for c, d in days.items() if d is not None}
        if not days:
            raise ValueError("the mapping needs at least one day column")
        return wide_to_long(df, id_column, latest_days(days, max_days), label)
    date, consumption = mapping.get("date_col"), mapping.get("consumption_col")
    if date not in df.columns or consumption not in df.columns:
        raise ValueError("the mapping needs a date and a consumption column that exist")
    return rename_long(df, id_column, date, consumption, label, extras=[])


def hash_order(id_column: str, seed: int) -> list:
    """A repeatable random order of ids that other engines share: the MD5 of id and seed, then the id."""
    return [F.md5(F.concat_ws(":", quoted(id_column).cast("string"), F.lit(str(seed))).cast("binary")), quoted(id_column)]


def sample_ids(ids: DataFrame, id_column: str, n: int, seed: int = 42) -> DataFrame:
    """n ids in the order of a seeded hash: repeatable, independent of row order."""
    return ids.orderBy(*hash_order(id_column, seed)).limit(n)


def sample_customers(df: DataFrame, id_column: str, max_customers: int, seed: int = 42) -> DataFrame:
    """All rows of at most `max_customers` random customers."""
    ids = df.select(quoted(id_column)).filter(quoted(id_column).isNotNull()).distinct()
    kept = sample_ids(ids, id_column, max_customers, seed)
    return df.join(F.broadcast(kept), id_column, "left_semi")  # at most max_customers ids


def sample_balanced(clients: DataFrame, max_clients: int, id_column: str = "client_id",
                    label: str = "target", seed: int = 42) -> DataFrame:
    """At most `max_clients` clients, up to 35 % of them positive; the rest is negative, topped up if needed.

    Each class contributes a bounded top-k, so no class is gathered in one task.
    """
    is_positive = num(quoted(label)) == 1
    key = hash_order(id_column, seed)
    quota = max(1, int(max_clients * 0.35))
    positives = clients.filter(is_positive).orderBy(*key).limit(max_clients).withColumn("_class", F.lit(0))
    others = (clients.filter(~F.coalesce(is_positive, F.lit(False))).orderBy(*key).limit(max_clients)
              .withColumn("_class", F.lit(1)))
    from pyspark.sql import Window
    pool = positives.unionByName(others)  # at most 2 * max_clients rows
    by_class = Window.partitionBy("_class").orderBy(*key)
    ranked = pool.withColumn("_rank", F.row_number().over(by_class))
    # first choice: positives up to the quota; then negatives; then what is left of the positives
    choice = F.when((F.col("_class") == 0) & (F.col("_rank") <= quota), 0).when(F.col("_class") == 1, 1).otherwise(2)
    return (ranked.withColumn("_choice", choice).orderBy("_choice", "_rank", quoted(id_column))
            .limit(max_clients).drop("_class", "_rank", "_choice"))


def recent_days(df: DataFrame, max_days: int | None) -> DataFrame:
    """Rows not older than `max_days` before the newest date (inclusive)."""
    if not max_days or max_days <= 0:
        return df
    newest = df.agg(F.max("date")).scalar()
    return df.filter(F.col("date") >= F.date_sub(newest, max_days))


def prefer_electricity(invoices: DataFrame, column: str = "counter_type") -> DataFrame:
    """Electricity rows if there are any in the whole table, else all rows."""
    if column not in invoices.columns:
        return invoices
    electric = F.coalesce(F.upper(F.col(column)) == "ELEC", F.lit(False))
    any_electric = invoices.agg(F.max(electric)).scalar()
    return invoices.filter(electric | ~F.coalesce(any_electric, F.lit(False)))


def invoice_to_readings(invoices: DataFrame, clients: DataFrame, max_customers: int | None = None,
                        max_days: int | None = None, seed: int = 42) -> DataFrame:
    """Invoices as dated readings: levels summed, times the meter coefficient, per billed month."""
    return invoice_rows(invoices, clients, max_customers, max_days, seed).transform(with_meter_age)


def invoice_rows(invoices: DataFrame, clients: DataFrame, max_customers: int | None = None,
                 max_days: int | None = None, seed: int = 42) -> DataFrame:
    """The same with the clients' creation date (`_created`) in place of the meter's age on each invoice."""
    if max_customers and max_customers > 0:
        clients = sample_balanced(clients, max_customers, seed=seed)
        ids = clients.select("client_id")
        invoices = invoices.join(F.broadcast(ids), "client_id", "left_semi")  # at most max_customers ids
    else:
        invoices = lookup_join(invoices, clients.select("client_id").distinct(), ["client_id"],
                               spread=["client_id", "invoice_date"], how="left_semi")
    invoices = prefer_electricity(invoices)
    have = invoices.columns
    levels = [F.coalesce(num(F.col(c)), F.lit(0.0)) for c in K.INVOICE_LEVELS if c in have]
    kwh = sum(levels, F.lit(0.0))

    def or_one(name: str):
        value = num(F.col(name)) if name in have else F.lit(1.0)
        return F.coalesce(F.nullif(value, F.lit(0.0)), F.lit(1.0))

    rows = invoices.select(F.col("client_id").cast("string").alias("customer_id"),
                           parse_date(F.col("invoice_date")).alias("date"),
                           ratio(kwh * or_one("counter_coefficient"), or_one("months_number"))
                           .alias("consumption_kwh"))
    rows = recent_days(rows, max_days)
    return lookup_join(rows, client_dimension(clients), ["customer_id"], spread=["customer_id", "date", "consumption_kwh"])


def client_dimension(clients: DataFrame) -> DataFrame:
    """One row per client with prefixed area, transformer and type codes."""
    have = clients.columns
    out = [F.col("client_id").cast("string").alias("customer_id"),
           (num(F.col("target")) if "target" in have else F.lit(None).cast("double")).alias("fraud_label")]
    district = "disrict" if "disrict" in have else "district" if "district" in have else None
    for source, prefix, name in ((district, "DISTRICT_", "area_id"), ("region", "REGION_", "transformer_id"),
                                 ("client_catg", "category_", "customer_type")):
        if source and source in have:
            out.append(F.concat(F.lit(prefix), F.col(source).cast("string")).alias(name))
    if "creation_date" in have:
        text = F.col("creation_date").cast("string")
        created = F.coalesce(F.try_to_timestamp(text, F.lit("d/M/yyyy")).cast("date"),
                             F.try_to_timestamp(text, F.lit("d-M-yyyy")).cast("date"), parse_date(F.col("creation_date")))
        out.append(created.alias("_created"))
    return clients.select(*out)


def with_meter_age(rows: DataFrame) -> DataFrame:
    if "_created" not in rows.columns:
        return rows
    years = F.datediff("date", "_created") / 365.25
    return rows.withColumn("meter_age", F.when(years.isNotNull(), F.greatest(years, F.lit(0.0)))).drop("_created")
