"""Column detection, cleaning and the ingest issue report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions.dates import reads_day_first, telling_order, to_moment, year_comes_last
from tallyspark.functions.numeric import ratio, to_number
from tallyspark.schemas import require_columns

ALL_PRODUCTS = "All Products"

# Name fragments per role, matched inside the lower-cased column name.
UPLOAD_KEYWORDS: dict[str, tuple[str, ...]] = {
    "date": ("date", "transaction_date", "order_date", "invoice_date", "timestamp", "created_at"),
    "sales": ("sales", "revenue", "amount", "price", "total"),
    "quantity": ("quantity", "qty", "items_sold", "units"),
    "product": ("product", "item", "sku", "product_name", "item_name", "description", "category"),
    "current_stock": ("stock", "current_stock", "inventory", "stock_on_hand", "units_in_stock", "stock_level"),
}

# Ordered synonyms per role for typed tables; an exact name beats a fragment.
INSIGHT_SYNONYMS: dict[str, tuple[str, ...]] = {
    "date": ("date", "timestamp", "transaction_date", "order_date"),
    "sales": ("sales", "sale_amount", "amount", "revenue"),
    "product": ("product", "item", "product_name", "item_name", "sku"),
    "category": ("category", "product_category", "item_category"),
    "profit": ("profit", "margin", "net_profit"),
    "quantity": ("qty", "quantity", "units_sold"),
    "customer_id": ("customer_id", "cust_id", "customer_name"),
}

# Fragments for the first-column-wins lookup.
FIRST_MATCH_FRAGMENTS: dict[str, tuple[str, ...]] = {
    "date": ("date",),
    "sales": ("sale", "amount", "revenue"),
    "product": ("product", "item", "sku"),
    "quantity": ("qty", "quantity"),
    "profit": ("profit",),
}

PARSE_RATE = 0.7
SIGN_RATE = 0.5
DISTINCT_RATE = 0.8


def candidates(df: DataFrame) -> list[tuple[str, str, int]]:
    """(column, role, position) for every column whose name suits a role."""
    found = []
    for position, field in enumerate(df.schema.fields):
        lowered = field.name.lower()
        for role, words in UPLOAD_KEYWORDS.items():
            if not any(w in lowered for w in words):
                continue
            if role == "product" and not isinstance(field.dataType, T.StringType):
                continue
            found.append((field.name, role, position))
    return found


def profile_columns(df: DataFrame, approximate_distinct: bool = False) -> DataFrame:
    """One row per (column, role) with parse, sign and distinct counts and the chosen column per role.

    Every measure of every candidate comes from a single aggregate over one scan. A date column counts with
    the order of day and month that reads more of it (``n_day_first``: with the day first). A product column
    needs a value that is not a number (``n_numeric``: those that are).
    ``approximate_distinct`` swaps the exact distinct count of product candidates
    for a 1 % sketch on very wide key spaces.
    """
    pairs = candidates(df)
    if not pairs:
        raise ValueError("No column name matches a known role")
    values: list[Column] = []
    measures: list[Column] = [F.count(F.lit(1)).alias("n")]
    for name, role, position in pairs:
        tag = f"{role}_{position}"
        value = F.col(f"v_{tag}")
        if role == "product":
            values.append(F.col(name).alias(f"v_{tag}"))
            distinct = F.approx_count_distinct(value, 0.01) if approximate_distinct else F.count_distinct(value)
            values.append(to_number(df, name).isNotNull().alias(f"n_{tag}"))
            measures += [F.count(value).alias(f"p_{tag}"), distinct.alias(f"d_{tag}"), F.count_if(f"n_{tag}").alias(f"n_{tag}")]
        elif role == "date":
            last = year_comes_last(df, name)
            values += [to_moment(df, name).alias(f"v_{tag}"), last.alias(f"y_{tag}"), F.when(last, to_moment(df, name, True)).alias(f"f_{tag}")]
            first = F.count(F.when(F.col(f"y_{tag}"), F.col(f"f_{tag}")).otherwise(value))
            measures += [F.greatest(F.count(value), first).alias(f"p_{tag}"), first.alias(f"f_{tag}")]
        else:
            values.append(to_number(df, name).alias(f"v_{tag}"))
            signed = value > 0 if role == "sales" else value >= 0
            measures += [F.count(value).alias(f"p_{tag}"), F.count_if(signed).alias(f"s_{tag}")]

    none = F.lit(None).cast("bigint")
    rows = []
    for name, role, position in pairs:
        tag = f"{role}_{position}"
        parsed = F.col(f"p_{tag}")
        signed = none if role in ("date", "product") else F.col(f"s_{tag}")
        distinct = F.col(f"d_{tag}") if role == "product" else none
        if role == "product":
            passes = (distinct > 2) & (distinct < F.col("n") * DISTINCT_RATE) & (F.col(f"n_{tag}") < parsed)
        elif role == "date":
            passes = ratio(parsed, F.col("n")) > PARSE_RATE
        else:
            passes = (ratio(parsed, F.col("n")) > PARSE_RATE) & (ratio(signed, F.col("n")) > SIGN_RATE)
        rows.append(F.struct(
            F.lit(name).alias("column_name"), F.lit(role).alias("role"), F.lit(position).alias("position"),
            F.col("n").alias("n_rows"), parsed.alias("n_parsed"), signed.alias("n_signed"),
            distinct.alias("n_distinct"), (F.col(f"f_{tag}") if role == "date" else none).alias("n_day_first"),
            (F.col(f"n_{tag}") if role == "product" else none).alias("n_numeric"), F.coalesce(passes, F.lit(False)).alias("passes"),
        ))
    # The window runs over the profile, which has one row per candidate column.
    first_hit = F.min(F.when(F.col("passes"), F.col("position"))).over(W.partitionBy("role"))
    return (
        df.select(*values).agg(*measures)
        .select(F.inline(F.array(*rows)))
        .withColumn("selected", F.coalesce(F.col("position") == first_hit, F.lit(False)))
    )


def detect_columns(df: DataFrame, approximate_distinct: bool = False) -> dict[str, str | None]:
    """Role to column mapping; runs the profile job and reads its few rows."""
    mapping: dict[str, str | None] = dict.fromkeys(UPLOAD_KEYWORDS)
    if candidates(df):
        chosen = profile_columns(df, approximate_distinct).filter("selected").select("role", "column_name")
        mapping.update({r["role"]: r["column_name"] for r in chosen.collect()})
    if mapping["sales"] is None:
        mapping["sales"] = mapping["quantity"]
    return mapping


def match_synonyms(columns: Sequence[str]) -> dict[str, str | None]:
    """Role lookup by name for typed tables: synonym order first, exact name before fragment."""
    def pick(names: Sequence[str]) -> str | None:
        for name in names:
            if name in columns:
                return name
            hit = next((c for c in columns if name in c.lower()), None)
            if hit:
                return hit
        return None

    return {role: pick(names) for role, names in INSIGHT_SYNONYMS.items()}


def match_first(columns: Sequence[str]) -> dict[str, str | None]:
    """Role lookup by name: the first column containing any of the role's fragments."""
    return {
        role: next((c for c in columns if any(f in c.lower() for f in fragments)), None)
        for role, fragments in FIRST_MATCH_FRAGMENTS.items()
    }


def insight_table(df: DataFrame) -> DataFrame:
    """Rename the detected columns of a typed table; drop rows whose numeric roles are null.

    A numeric role whose column is not numeric is left out.
    """
    roles = {r: c for r, c in match_synonyms(df.columns).items() if c}
    for role in ("sales", "profit", "quantity"):
        if role in roles and not isinstance(df.schema[roles[role]].dataType, T.NumericType):
            del roles[role]
    out = df.select(*[
        (to_moment(df, c) if r == "date" else to_number(df, c, df.schema[c].dataType.simpleString())
         if r in ("sales", "profit", "quantity") else F.col(c).cast("string")).alias(r)
        for r, c in roles.items()
    ])
    numeric = [r for r in ("sales", "profit", "quantity") if r in roles]
    return out.dropna(subset=numeric) if numeric else out


def clean_sales(
    df: DataFrame,
    mapping: dict[str, str | None],
    number_type: str = "double",
    pandas_compat: bool = False,
    day_first: bool | None = None,
) -> DataFrame:
    """Canonical sales table ``date, sales, quantity, product, current_stock``.

    ``number_type`` may name a wide decimal type to keep money sums exact; ``ingest_issues`` reports amounts
    that it cannot hold.  A null product reads ``Unknown``, or ``nan`` with ``pandas_compat``.  Without
    ``day_first`` the order of day and month is the one that reads more of the date column.
    """
    for role in ("date", "sales"):
        if not mapping.get(role):
            raise ValueError(f"Missing required columns: a {role} column must be mapped")
    require_columns(df, [c for c in mapping.values() if c])
    zero = F.lit(0).cast(number_type)

    def number(role: str) -> Column:
        return F.coalesce(to_number(df, mapping[role], number_type), zero)

    unnamed = "nan" if pandas_compat else "Unknown"
    product = (
        F.coalesce(F.col(mapping["product"]).cast("string"), F.lit(unnamed))
        if mapping.get("product") else F.lit(ALL_PRODUCTS)
    )
    stock = (
        to_number(df, mapping["current_stock"])
        if mapping.get("current_stock") else F.lit(None).cast("double")
    )
    order = reads_day_first(df, mapping["date"]) if day_first is None else day_first
    # Unfolded from an array, the date is read once: the filter cannot go beneath it and read it again.
    return df.select(
        F.explode(F.array(to_moment(df, mapping["date"], order))).alias("date"),
        number("sales").alias("sales"),
        (number("quantity") if mapping.get("quantity") else number("sales")).alias("quantity"),
        product.alias("product"),
        stock.alias("current_stock"),
    ).filter(F.col("date").isNotNull())


def validate_sales(df: DataFrame, number_type: str = "double", day_first: bool | None = None) -> DataFrame:
    """Fill in whatever a canonical-named table lacks: sales from quantity and back, product, stock."""
    require_columns(df, ["date"])
    if "sales" not in df.columns and "quantity" not in df.columns:
        raise ValueError("Missing required columns: a 'sales' or 'quantity' column is needed")
    has = set(df.columns)
    mapping = {
        "date": "date",
        "sales": "sales" if "sales" in has else "quantity",
        "quantity": "quantity" if "quantity" in has else None,
        "product": "product" if "product" in has else None,
        "current_stock": "current_stock" if "current_stock" in has else None,
    }
    return clean_sales(df, mapping, number_type, day_first=day_first)


def ingest_issues(df: DataFrame, mapping: dict[str, str | None], number_type: str = "double", day_first: bool | None = None) -> DataFrame:
    """Rows ``severity, column_name, message, n_failed`` from one aggregate of failure counts over one scan.

    ``info`` rows tell how many dates read with the month first and with the day first, where that differs.
    ``number_type`` is the one that ``clean_sales`` is going to use; readable amounts that it cannot hold count.
    Every date is read once in each order and every count is taken for both; the order is chosen after that.
    """
    date_col, sales_col, qty_col = (mapping.get(r) for r in ("date", "sales", "quantity"))
    none = F.lit(False)
    leads = telling_order(df, date_col) if date_col else (none, none)
    # Dates that do not end in the year read the same both ways.
    month = to_moment(df, date_col).isNotNull() if date_col else F.lit(True)
    day = F.when(year_comes_last(df, date_col), to_moment(df, date_col, True).isNotNull()) if date_col else F.lit(None).cast("boolean")

    def unreadable(name: str | None) -> Column:
        return to_number(df, name).isNull() if name else none

    def too_large(name: str | None) -> Column:
        return to_number(df, name).isNotNull() & to_number(df, name, number_type).isNull() if name else none

    faults = {
        "bad_sales": unreadable(sales_col), "bad_quantity": unreadable(qty_col),
        "large_sales": too_large(sales_col), "large_quantity": too_large(qty_col),
    }
    row = F.struct(
        month.alias("month"), day.alias("day"), *[c.alias(f"{o}_leads") for o, c in zip(("day", "month"), leads, strict=True)],
        *[c.alias(name) for name, c in faults.items()],
    )
    # Unfolded from an array, every value is computed once, however many counts use it.
    read = df.select(F.explode(F.array(row)).alias("_r")).select("_r.*").withColumn("day", F.coalesce("day", "month"))
    orders = ("month", "day")
    totals = read.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(f"{o}_leads") & F.col(o)).alias(f"{o}_tells") for o in orders],
        *[F.count_if(o).alias(f"{o}_first") for o in orders],
        # Coercion of numbers is judged on the rows that keep a date.
        *[F.count_if(F.col(o) & F.col(name)).alias(f"{name}_{o}") for name in faults for o in orders],
    )
    chosen = F.col("day_tells") > F.col("month_tells") if day_first is None else F.lit(day_first)

    def by_order(name: str) -> Column:
        return F.when(chosen, F.col(name.format("day"))).otherwise(F.col(name.format("month")))

    counts = totals.select(
        "n", "month_first", "day_first", (F.col("n") - by_order("{}_first")).alias("bad_dates"),
        *[by_order(f"{name}_{{}}").alias(name) for name in faults],
    )

    def issue(severity: str, column: str | None, message: str, failed: Column, when: Column) -> Column:
        return F.when(when, F.struct(
            F.lit(severity).alias("severity"),
            F.lit(column or "").alias("column_name"),
            F.lit(message).alias("message"),
            failed.cast("bigint").alias("n_failed"),
        ))

    always, n = F.lit(True), F.col("n")
    found = []
    if not date_col:
        found.append(issue("error", None, "A date column is required", n, always))
    else:
        found.append(issue("error", date_col, "No value could be read as a date",
                           F.col("bad_dates"), F.col("bad_dates") == n))
        found.append(issue("warning", date_col, "Rows without a readable date are dropped",
                           F.col("bad_dates"), (F.col("bad_dates") > 0) & (F.col("bad_dates") < n)))
        differ = F.col("month_first") != F.col("day_first")
        found.append(issue("info", date_col, "Dates that read with the month first", F.col("month_first"), differ))
        found.append(issue("info", date_col, "Dates that read with the day first", F.col("day_first"), differ))
    if not sales_col:
        found.append(issue("error", None, "A sales column is required", n, always))
    else:
        found.append(issue("warning", sales_col, "Unreadable sales values are treated as 0",
                           F.col("bad_sales"), F.col("bad_sales") > 0))
    if qty_col:
        found.append(issue("warning", qty_col, "Unreadable quantity values are treated as 0",
                           F.col("bad_quantity"), F.col("bad_quantity") > 0))
    for name, counted in ((sales_col, "large_sales"), (qty_col, "large_quantity")):
        if name:
            found.append(issue("warning", name, "Values too large for the number type are treated as 0", F.col(counted), F.col(counted) > 0))
    return counts.select(F.inline(F.array_compact(F.array(*found))))
