"""Finding out what a delivered table holds: header rules on the driver, content checks on the cluster."""
from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from wattlens import constants as K
from wattlens.operators.clean import coerce_numeric, parse_date


SKETCH_BITS = 14
SKETCH_ERROR = 0.05  # relative; six standard errors of a sketch of 2 ** 14 registers


@dataclass
class Layout:
    """Roles of the columns of a delivered table."""
    kind: str
    id_column: str | None
    label_column: str | None = None
    date_column: str | None = None
    consumption_column: str | None = None
    day_columns: dict[str, dt.date] = field(default_factory=dict)
    confidence: float = 0.0
    issues: list[str] = field(default_factory=list)


def header_date(name: str) -> dt.date | None:
    """The day a column header stands for; month first, then day first; years 2000-2100 only."""
    parts = re.fullmatch(r"\s*(\d+)[-/.](\d+)[-/.](\d+)\s*", name)
    if not parts:
        return None
    a, b, c = parts.groups()
    if len(a) == 4 and len(b) <= 2 and len(c) <= 2:
        tries = [(a, b, c), (a, c, b)]
    elif len(c) == 4 and len(a) <= 2 and len(b) <= 2:
        tries = [(c, a, b), (c, b, a)]
    else:
        return None
    for year, month, day in tries:
        if not K.HEADER_YEARS[0] <= int(year) <= K.HEADER_YEARS[1]:
            continue
        try:
            return dt.date(int(year), int(month), int(day))
        except ValueError:
            continue
    return None


def find_header(columns: list[str], accepted: list[str]) -> str | None:
    """First accepted name that occurs; case and underscore/blank differences are ignored."""
    def key(name: str) -> str:
        return name.strip().lower().replace("_", " ")
    present = {key(c): c for c in columns}
    return next((present[key(a)] for a in accepted if key(a) in present), None)


def find_unit_header(columns: list[str], accepted: list[str]) -> str | None:
    """Exact name first, then an accepted name as whole words inside a header (`lat` is not in `flat_id`)."""
    exact = {c.strip().lower(): c for c in columns}
    for a in accepted:
        if a in exact:
            return exact[a]
    for a in accepted:
        words = re.compile(rf"(?:^|[^a-z0-9]){re.escape(a)}(?:$|[^a-z0-9])")
        for c in columns:
            if words.search(c.lower()):
                return c
    return None


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, text, n): every distinct value once, so later checks run on far fewer rows."""
    texts = df.select([F.col(f"`{c}`").cast("string").alias(c) for c in columns])
    return (texts.unpivot([], [F.col(f"`{c}`") for c in columns], "column", "text")
            .filter(F.col("text").isNotNull()).groupBy("column", "text").agg(F.count("*").alias("n")))


def infer_id_column(df: DataFrame, candidates: list[str]) -> DataFrame:
    """Score of every candidate as identifier, best first: unique, long, with letters, not plain numbers."""
    trimmed = (value_counts(df, candidates).withColumn("text", F.trim("text"))
               .groupBy("column", "text").agg(F.sum("n").alias("n")))
    rows, weight = F.sum("n"), F.col("n")
    is_number = coerce_plain(F.col("text")).isNotNull()
    stats = trimmed.groupBy("column").agg(
        (F.count("*") / rows).alias("unique_ratio"),
        (F.sum(F.length("text") * weight) / rows).alias("avg_length"),
        (F.sum(F.when(F.col("text").rlike("[A-Za-z]"), weight).otherwise(0)) / rows).alias("letter_share"),
        (F.sum(F.when(is_number, weight).otherwise(0)) / rows).alias("number_share"))
    score = (F.col("unique_ratio") * 2.0 + F.least(F.col("avg_length") / 20, F.lit(1.0))
             + F.col("letter_share") - F.col("number_share") * 0.25)
    return stats.withColumn("score", score).orderBy(F.desc("score"), F.desc("column"))


def coerce_plain(text):
    """Number written with a decimal point only."""
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


def infer_roles(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Role of every column judged by its content.

    One row per column: shares of values that are dates, numbers, whole and non-negative numbers, distinct
    ratio, and the role: `date`, `label` (0/1 only), `consumption` (non-negative numbers, some with a
    fraction), `id` (whole numbers, or all values different), `category` (repeated text) or `other`.
    """
    columns = columns or df.columns
    counts = value_counts(df, columns)
    value = coerce_numeric(F.col("text"))
    day = parse_date(F.col("text"))
    weight, total = F.col("n"), F.sum("n")

    def share(condition):
        return F.sum(F.when(condition, weight).otherwise(0)) / total

    stats = counts.groupBy("column").agg(
        total.alias("values"),
        F.count("*").alias("distinct_values"),
        share(day.isNotNull()).alias("date_share"),
        share(value.isNotNull()).alias("number_share"),
        share(value >= 0).alias("non_negative_share"),
        share(value == F.floor(value)).alias("whole_share"),
        share(value.isin(0.0, 1.0)).alias("zero_one_share"))
    unique = F.col("distinct_values") / F.col("values")
    role = (F.when(F.col("date_share") >= 0.9, "date")
            .when((F.col("zero_one_share") == 1.0) & (F.col("distinct_values") <= 2), "label")
            .when((F.col("non_negative_share") >= 0.9) & (F.col("whole_share") < F.col("number_share")), "consumption")
            .when((unique == 1.0) | ((F.col("whole_share") >= 0.9) & (F.col("non_negative_share") >= 0.9)), "id")
            .when(F.col("number_share") < 0.5, "category")
            .otherwise("other"))
    return stats.withColumn("unique_ratio", unique).withColumn("role", role)


def column_sketches(df: DataFrame, columns: list[str], trim: bool = False) -> DataFrame:
    """One row per column that has a value, from one scan whose tasks send one row per column.

    values, distinct_estimate (within `SKETCH_ERROR`), avg_length, and the shares of values with letters, that are plain
    numbers, dates, messy numbers, non-negative, whole, and 0 or 1.
    """
    texts = df.select([F.col(f"`{c}`").cast("string").alias(c) for c in columns])
    cells = texts.unpivot([], [F.col(f"`{c}`") for c in columns], "column", "text").filter(F.col("text").isNotNull())
    text = F.trim("text") if trim else F.col("text")
    cells = cells.select("column", text.alias("text"), coerce_numeric(F.col("text")).alias("v"))
    v = F.col("v")

    def share(condition):
        return (F.count_if(condition) / F.count("*"))

    return cells.groupBy("column").agg(
        F.count("*").alias("values"), F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64("text"), F.lit(SKETCH_BITS))).alias("distinct_estimate"),
        F.avg(F.length("text")).alias("avg_length"), share(F.col("text").rlike("[A-Za-z]")).alias("letter_share"),
        share(coerce_plain(F.col("text")).isNotNull()).alias("plain_share"),
        share(parse_date(F.col("text")).isNotNull()).alias("date_share"), share(v.isNotNull()).alias("number_share"),
        share(v >= 0).alias("non_negative_share"), share(v == F.floor(v)).alias("whole_share"),
        share(v.isin(0.0, 1.0)).alias("zero_one_share"))


def distinct_counts(df: DataFrame, columns: list[str], trim: bool = False) -> dict[str, int]:
    """Exact numbers of distinct values; for the few columns that a sketch can't decide."""
    if not columns:
        return {}
    counts = value_counts(df, columns)
    counts = counts.select("column", F.trim("text").alias("text")).distinct() if trim else counts
    return {r["column"]: r["n"] for r in counts.groupBy("column").agg(F.count("*").alias("n")).collect()}  # a row per column


def choose_id_column(df: DataFrame, candidates: list[str]) -> str | None:
    """The candidate that `infer_id_column` puts first. Distinct values are counted exactly only for candidates that could
    still win within the sketches' error; ties go to the last name."""
    def score(row, unique: float) -> float:
        return 2.0 * min(unique, 1.0) + min(row["avg_length"] / 20, 1.0) + row["letter_share"] - row["plain_share"] * 0.25

    rows = column_sketches(df, candidates, trim=True).collect()  # one row per column
    if not rows:
        return None
    ratio = {r["column"]: r["distinct_estimate"] / r["values"] for r in rows}
    least = max(score(r, ratio[r["column"]] / (1 + SKETCH_ERROR)) for r in rows)
    close = [r for r in rows if score(r, ratio[r["column"]] * (1 + SKETCH_ERROR)) >= least]
    if len(close) > 1:
        exact = distinct_counts(df, [r["column"] for r in close], trim=True)
        ratio |= {r["column"]: exact[r["column"]] / r["values"] for r in close}
    return max(close, key=lambda r: (score(r, ratio[r["column"]]), r["column"]))["column"]


def choose_roles(df: DataFrame, columns: list[str] | None = None) -> dict[str, str]:
    """The role of every column that has a value, as `infer_roles` finds it.

    Small numbers of distinct values are exact in a sketch; only where a role hangs on all values being different,
    and the sketch allows for it, they are counted.
    """
    rows = column_sketches(df, columns or df.columns).collect()  # one row per column
    roles, open_columns = {}, {}
    for r in rows:
        late = "category" if r["number_share"] < 0.5 else "other"
        if r["date_share"] >= 0.9:
            roles[r["column"]] = "date"
        elif r["zero_one_share"] == 1.0 and r["distinct_estimate"] <= 2:
            roles[r["column"]] = "label"
        elif r["non_negative_share"] >= 0.9 and r["whole_share"] < r["number_share"]:
            roles[r["column"]] = "consumption"
        elif r["whole_share"] >= 0.9 and r["non_negative_share"] >= 0.9:
            roles[r["column"]] = "id"
        elif r["distinct_estimate"] * (1 + SKETCH_ERROR) < r["values"]:
            roles[r["column"]] = late
        else:
            open_columns[r["column"]] = (r["values"], late)
    exact = distinct_counts(df, list(open_columns))
    return roles | {c: "id" if exact[c] == n else late for c, (n, late) in open_columns.items()}


def detect_layout(df: DataFrame) -> Layout:
    """Wide if at least two headers are days, long if id, date and consumption are found."""
    columns = df.columns
    id_column = find_header(columns, K.ID_HEADERS)
    label = find_header(columns, K.LABEL_HEADERS)
    date = find_header(columns, K.DATE_HEADERS)
    consumption = find_header(columns, K.CONSUMPTION_HEADERS)
    days = {c: d for c in columns if (d := header_date(c)) is not None}
    if len(days) >= 2:
        rest = [c for c in columns if c not in days and c != label]
        if id_column is None and rest:
            id_column = choose_id_column(df, rest) or rest[0]
        layout = Layout("wide", id_column, label, day_columns=days)
        layout.confidence = ((0.45 if len(days) >= 20 else 0.30 if len(days) >= 5 else 0.0)
                             + (0.30 if id_column else 0.0) + (0.15 if label else 0.05) + 0.10)
        if id_column is None:
            layout.issues.append("No column holds customer ids; numbers of the rows stand in for them.")
        if label is None:
            layout.issues.append("No label column; only models that need no labels will run.")
        if len(days) < 30:
            layout.issues.append("Fewer than 30 day columns; scores gain from a longer history.")
    elif id_column and date and consumption:
        layout = Layout("long", id_column, label, date, consumption)
        layout.confidence = 0.35 + 0.25 + 0.25 + (0.15 if label else 0.05)
        if label is None:
            layout.issues.append("No label column; only models that need no labels will run.")
    else:
        raise ValueError("no usable layout: need day columns, or an id, a date and a consumption column")
    layout.confidence = round(min(layout.confidence, 1.0), 3)
    return layout


def profile_table(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing cells and share, surplus copies of rows, day columns, numeric columns."""
    numeric = sum(t in ("int", "bigint", "smallint", "tinyint", "float", "double") or t.startswith("decimal")
                  for _, t in df.dtypes)
    days = sum(header_date(c) is not None for c in df.columns)
    # equal rows are counted by a digest, so rows themselves don't move; equal rows miss equally many cells
    cells = [F.col(f"`{c}`") for c in df.columns]
    digest = F.struct(F.xxhash64(F.lit(1), *[part for c in cells for part in (c.isNull(), c)]).alias("a"),
                      F.xxhash64(F.lit(2), *[part for c in reversed(cells) for part in (c, c.isNull())]).alias("b"))
    absent = sum((c.isNull().cast("long") for c in cells), F.lit(0).cast("long"))
    sets = df.groupBy(digest.alias("_row")).agg(F.count("*").alias("_copies"), F.sum(absent).alias("_missing"))
    copies = F.col("_copies")
    missing = F.coalesce(F.sum("_missing"), F.lit(0))
    width = len(df.columns)
    totals = sets.agg(F.coalesce(F.sum(copies), F.lit(0)).alias("rows"), missing.alias("missing_cells"),
                      F.coalesce(F.sum(copies - 1), F.lit(0)).alias("duplicate_rows"))
    percent = F.coalesce(F.try_divide(F.col("missing_cells") * 100.0, F.col("rows") * width), F.lit(0.0))
    return totals.select("rows", F.lit(width).alias("columns"), "missing_cells",
                         F.round(percent, 2).alias("missing_percent"), "duplicate_rows",
                         F.lit(days).alias("detected_date_columns"), F.lit(numeric).alias("numeric_columns"))


def drop_empty_axes(df: DataFrame) -> DataFrame:
    """Without rows that hold nothing and without columns that hold nothing."""
    rows = df.dropna(how="all")
    filled = rows.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    keep = [c for i, c in enumerate(df.columns) if filled[f"c{i}"] > 0]
    return rows.select([F.col(f"`{c}`") for c in keep])
