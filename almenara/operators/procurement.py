"""Public tenders: one row per process, quality flags, filters and risk indicators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almenara.functions.numeric import pct, rounded, share, to_number, true
from almenara.functions.text import text_key
from almenara.operators.ordered import quantiles
from almenara.operators.quality import Rule, flag_copies
from almenara.settings import (
    DEPARTMENTS, METHOD_CONCEPTS, METHODS_WITHOUT_EQUIVALENT, NO_EQUIVALENT_CONCEPT, NO_EQUIVALENT_NOTICE,
    NOT_LOCATED, OBJECT_WORDS, RISK,
)


# ---------------------------------------------------------------- one row per process
def latest_snapshot(tenders: DataFrame, key: str = "ocid", month: str = "month_file") -> DataFrame:
    """The row of the latest month of each process; a hash decides between rows of the same month."""
    rest = [c for c in tenders.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct(F.col(month), F.xxhash64(*rest))).alias("_b")
    return tenders.groupBy(key).agg(best).select(key, "_b.*")


def buyers(parties: DataFrame, key: str = "ocid", order: str = "ord") -> DataFrame:
    """First party with the buyer role of each process."""
    rest = [c for c in parties.columns if c not in (key, order)]
    bought = parties.filter(F.contains(F.lower(F.coalesce("roles", F.lit(""))), F.lit("buyer")))
    return bought.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_b")).select(key, "_b.*")


def award_totals(awards: DataFrame, key: str = "ocid") -> DataFrame:
    return awards.groupBy(key).agg(
        F.count("*").alias("awards"), F.coalesce(F.sum("amount"), F.lit(0.0)).alias("awarded_amount"),
        F.max("award_date").alias("award_date"),
    )


def build_processes(tenders: DataFrame, parties: DataFrame, awards: DataFrame) -> DataFrame:
    """Latest snapshot with its buyer and its awards; the buyer's place stays raw."""
    b = buyers(parties).drop("roles")
    return (
        latest_snapshot(tenders).join(b, "ocid", "left").join(award_totals(awards), "ocid", "left")
        .withColumn("awarded", F.coalesce("awards", F.lit(0)) > 0).drop("awards")
    )


def row_counts(steps: dict[str, DataFrame], key: str = "ocid") -> DataFrame:
    """Rows and distinct keys after each step."""
    out = None
    for name, df in steps.items():
        row = df.agg(F.count("*").alias("rows"), F.countDistinct(key).alias("keys")).select(
            F.lit(name).alias("step"), "rows", "keys"
        )
        out = row if out is None else out.unionByName(row)
    return out


def monthly_counts(tenders: DataFrame, key: str = "ocid", month: str = "month_file") -> DataFrame:
    return tenders.groupBy(month).agg(F.count("*").alias("rows"), F.countDistinct(key).alias("keys"))


# ---------------------------------------------------------------- quality
def flag_tenders(
    df: DataFrame, canon: tuple[str, ...] = DEPARTMENTS, key=text_key,
) -> DataFrame:
    """Seven flags and the two fitness columns; copies of a process are flagged on every copy."""
    description = F.trim(F.coalesce("description", F.lit("")))
    locality = key("locality_raw")
    raw = F.trim(F.coalesce("department_raw", F.lit("")))
    return flag_copies(df, "ocid", "flag_duplicate").withColumns({
        "amount": to_number("amount"),
        "flag_no_amount": ~true(to_number("amount") > RISK.min_amount),
        "flag_no_description": F.length(description) < RISK.min_description_chars,
        "flag_locality_not_department": (locality != "") & ~locality.isin(*canon),
        "flag_spelling": (raw != "") & (raw != key("department_raw")),
        "flag_no_department": F.col("department") == NOT_LOCATED,
        "flag_no_date": F.col("published").cast("string").try_cast("timestamp").isNull(),
    }).withColumns({"fit_for_index": ~F.col("flag_no_description"), "fit_for_map": ~F.col("flag_no_department")})


TENDER_RULES = (
    ("duplicados", "flag_duplicate", "El ocid se repite"),
    ("sin_monto", "flag_no_amount", "No hay un importe positivo"),
    ("sin_descripcion", "flag_no_description", "El texto no alcanza la longitud minima"),
    ("localidad_no_dep", "flag_locality_not_department", "El lugar nombra otra cosa que un departamento"),
    ("codificacion", "flag_spelling", "El nombre se escribe de otra manera que en la lista"),
    ("sin_departamento", "flag_no_department", "Ningun paso dio con un departamento"),
    ("sin_fecha", "flag_no_date", "No se puede leer cuando se publico"),
)


def tender_rules() -> list[Rule]:
    return [Rule(code, text, F.col(flag)) for code, flag, text in TENDER_RULES]


# ---------------------------------------------------------------- filters
@dataclass(frozen=True)
class Filters:
    """Structured conditions, all of which must hold."""

    departments: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    amount_min: float | None = None
    amount_max: float | None = None
    date_from: str | None = None
    date_to: str | None = None
    awarded_only: bool = False

    def predicate(self) -> Column:
        """An unknown amount counts as 0; an unknown date passes the date limits."""
        amount = F.coalesce("amount", F.lit(0.0))
        day = F.date_format("published", "yyyy-MM-dd")
        out = F.lit(True)
        if self.departments:
            out &= true(F.col("department").isin(*self.departments))
        if self.categories:
            out &= true(F.col("category").isin(*self.categories))
        if self.amount_min is not None:
            out &= amount >= self.amount_min
        if self.amount_max is not None:
            out &= amount <= self.amount_max
        if self.date_from:
            out &= day.isNull() | (day >= self.date_from)
        if self.date_to:
            out &= day.isNull() | (day <= self.date_to)
        if self.awarded_only:
            out &= true("awarded")
        return out

    def description(self) -> str:
        parts = []
        if self.departments:
            parts.append("departamento en " + ", ".join(self.departments))
        if self.categories:
            parts.append("categoria en " + ", ".join(self.categories))
        if self.amount_min is not None:
            parts.append(f"monto >= {self.amount_min:,.0f} PEN")
        if self.amount_max is not None:
            parts.append(f"monto <= {self.amount_max:,.0f} PEN")
        if self.date_from:
            parts.append(f"desde {self.date_from}")
        if self.date_to:
            parts.append(f"hasta {self.date_to}")
        if self.awarded_only:
            parts.append("solo adjudicados")
        return "; ".join(parts) or "ninguno"


def dashboard_filter(
    df: DataFrame, departments: tuple[str, ...] = (), categories: tuple[str, ...] = (),
    amount: tuple[float, float] | None = None, dates: tuple[str, str] | None = None, awarded_only: bool = False,
) -> DataFrame:
    """Like :class:`Filters`, but rows without an amount or a date pass those limits."""
    out = df
    if departments:
        out = out.filter(F.col("department").isin(*departments))
    if categories:
        out = out.filter(F.col("category").isin(*categories))
    if amount:
        a = to_number("amount")
        out = out.filter(a.between(*amount) | a.isNull())
    if awarded_only:
        out = out.filter(true("awarded"))
    if dates:
        d = F.to_date("published")
        out = out.filter(d.between(F.lit(dates[0]).cast("date"), F.lit(dates[1]).cast("date")) | d.isNull())
    return out


# ---------------------------------------------------------------- risk
def awarded_base(df: DataFrame) -> DataFrame:
    """Awarded processes with at least one known bidder."""
    return df.withColumn("bidders", to_number("bidders")).filter(true("awarded") & (F.col("bidders") >= 1)).withColumn(
        "single_bidder", F.col("bidders") == 1
    )


def _single(n: Column, one: Column) -> list[Column]:
    return [n.alias("awarded_processes"), one.alias("single_bidder"), pct(one, n).alias("pct_single_bidder")]


def _count(condition: Column | None = None) -> Column:
    """What a sum of it counts."""
    return F.lit(1) if condition is None else true(condition).cast("int")


def _awarded() -> dict[str, Column]:
    """Sums of awarded processes, taken together with their median of bidders."""
    return {"n": _count(), "one": _count(F.col("single_bidder"))}


def single_bidder_overall(df: DataFrame) -> DataFrame:
    sums = quantiles(awarded_base(df), [], "bidders", {"median_bidders": 0.5}, _awarded())
    n, one = (F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("n", "one"))
    return sums.select(*_single(n, one), "median_bidders")


def single_bidder_by_department(df: DataFrame) -> DataFrame:
    base = awarded_base(df).filter(F.col("department") != NOT_LOCATED)
    sums = quantiles(base, ["department"], "bidders", {"median_bidders": 0.5}, {**_awarded(), "amount": F.col("amount")})
    amount = rounded(F.coalesce("amount", F.lit(0.0)), 0).alias("amount_total")
    return sums.select("department", *_single(F.col("n"), F.col("one")), amount, "median_bidders")


def single_bidder_by_buyer(df: DataFrame, minimum: int = RISK.min_tenders_per_buyer) -> DataFrame:
    """Every (buyer, department), unknown ones included, and whether it has enough processes."""
    amount = rounded(F.coalesce(F.sum("amount"), F.lit(0.0)), 0).alias("amount_total")
    out = awarded_base(df).groupBy("buyer_id", "department").agg(
        *_single(F.count("*"), F.count_if("single_bidder")), amount
    )
    return out.withColumn("above_minimum", F.col("awarded_processes") >= minimum)


def rank_buyers(by_buyer: DataFrame) -> DataFrame:
    return by_buyer.orderBy(*_buyer_order())


def _buyer_order() -> list[Column]:
    return [F.desc("above_minimum"), F.desc("pct_single_bidder"), F.desc("awarded_processes"),
            F.asc_nulls_last("buyer_id"), F.asc_nulls_last("department")]


def top_buyers(by_buyer: DataFrame, n: int = RISK.top_buyers) -> DataFrame:
    return by_buyer.filter("above_minimum").orderBy(*_buyer_order()).limit(n)


def with_window_days(df: DataFrame) -> DataFrame:
    """Declared length of the consultation window, else the computed one, and which it was."""
    declared = to_number("window_days_declared")
    return df.withColumns({
        "window_days": F.coalesce(declared, to_number("window_days_computed")),
        "window_origin": F.when(declared.isNotNull(), "declarado").otherwise("calculado"),
    })


def days_between(start: Column, end: Column) -> Column:
    """Difference of two instants in fractional days."""
    def micros(c: Column) -> Column:
        return F.unix_micros(c.cast("string").try_cast("timestamp"))

    return (micros(end) - micros(start)) / 86_400_000_000.0


def _with_short_flag(df: DataFrame, days: float) -> DataFrame:
    return with_window_days(df).filter(F.col("window_days") >= 0).withColumn("short_window", F.col("window_days") < days)


def short_window_summary(df: DataFrame, days: float = RISK.short_window_days) -> DataFrame:
    """Coverage and share of short windows, and single-bidder share with and without one; one pass over the rows."""
    rows = with_window_days(df)
    known = F.col("window_days") >= 0
    base = known & true("awarded") & true(to_number("bidders") >= 1)
    one, short = true(to_number("bidders") == 1), true(F.col("window_days") < days)
    q = quantiles(rows.withColumn("_days", F.when(known, F.col("window_days"))), [], "_days", {"median_days": 0.5, "p25_days": 0.25}, {
        "rows": _count(), "with_window": _count(known), "short": _count(known & short), "awarded_short": _count(base & short),
        "awarded_normal": _count(base & ~short), "one_short": _count(base & short & one), "one_normal": _count(base & ~short & one),
    })
    n = {c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in q.columns if not c.endswith("_days")}
    return q.select(
        n["with_window"].alias("with_window"), n["short"].alias("short"), pct(n["short"], n["with_window"]).alias("pct_short"),
        n["awarded_short"].alias("awarded_short"), n["awarded_normal"].alias("awarded_normal"),
        share(n["one_short"], n["awarded_short"], 2).alias("pct_single_short"),
        share(n["one_normal"], n["awarded_normal"], 2).alias("pct_single_normal"),
        pct(n["with_window"], n["rows"]).alias("pct_with_window"),
        rounded(F.col("median_days"), 1).alias("median_days"), rounded(F.col("p25_days"), 1).alias("p25_days"),
    )


def short_window_rows(df: DataFrame, days: float = RISK.short_window_days) -> DataFrame:
    cols = ["ocid", "buyer_id", "department", "category", "amount", "window_days", "window_origin", "bidders", "awarded"]
    known = _with_short_flag(df, days)
    return known.filter("short_window").select(*[c for c in cols if c in known.columns])


# ---------------------------------------------------------------- summaries
def overview(df: DataFrame) -> DataFrame:
    """Header figures; amounts leave out rows without one."""
    located = F.when(F.col("department") != NOT_LOCATED, F.col("department"))
    return df.agg(
        F.count("*").alias("processes"),
        F.coalesce(F.sum(F.when(~F.col("flag_no_amount"), F.col("amount"))), F.lit(0.0)).alias("amount_total"),
        F.countDistinct(located).alias("departments"), F.countDistinct("buyer_id").alias("buyers"),
        F.count_if(true("awarded")).alias("awarded"),
    )


def distribution(df: DataFrame, by: str) -> DataFrame:
    """Processes, amount and median amount per category, department or month; NULL keys left out."""
    rows = df.withColumn("month", F.date_format("published", "yyyy-MM")) if by == "month" else df
    rows = rows.filter(F.col(by).isNotNull()).select(by, "amount")
    sums = quantiles(rows, [by], "amount", {"amount_median": 0.5}, {"processes": _count(), "amount_total": F.col("amount")})
    return sums.select(
        by, "processes", rounded(F.coalesce("amount_total", F.lit(0.0)), 0).alias("amount_total"),
        rounded(F.col("amount_median"), 0).alias("amount_median"),
    )


def largest(df: DataFrame, n: int) -> DataFrame:
    """The ``n`` largest amounts."""
    return df.orderBy(F.desc_nulls_last("amount"), "ocid").limit(n)


def options(df: DataFrame, column: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Sorted distinct choices of a column."""
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*exclude)).select(column).distinct().orderBy(column)


def amount_ceiling(df: DataFrame, q: float = 0.99) -> DataFrame:
    return quantiles(df, [], "amount", {"amount_ceiling": q})


# ---------------------------------------------------------------- bridge to the law
def legal_question(df: DataFrame, method: str = "method", category: str = "category") -> DataFrame:
    """``question`` in the terms of the law in force and a ``notice`` where the method has no equivalent."""
    m = F.col(method)
    concepts = F.create_map(*[F.lit(x) for kv in METHOD_CONCEPTS.items() for x in kv])
    objects = F.create_map(*[F.lit(x) for kv in OBJECT_WORDS.items() for x in kv])
    gone = true(m.isin(*METHODS_WITHOUT_EQUIVALENT))
    concept = F.when(gone, NO_EQUIVALENT_CONCEPT).otherwise(F.coalesce(F.try_element_at(concepts, m), m))
    kind = F.try_element_at(objects, F.lower(F.coalesce(F.col(category), F.lit(""))))
    return df.withColumns({
        "question": F.concat(
            F.lit("¿Que dice la Ley sobre "), concept, F.lit("? ¿En que supuestos procede una contratacion"),
            F.when(kind.isNotNull(), F.concat(F.lit(" de "), kind)).otherwise(""), F.lit(" por esa via?"),
        ),
        "notice": F.when(gone, F.replace(F.lit(NO_EQUIVALENT_NOTICE), F.lit("{metodo}"), m)).otherwise(""),
    })
