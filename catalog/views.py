"""Tables with planted flaws, derived from the given ones by arithmetic on their keys.

The given tables are almost clean. Each view here is a lazy expression over one whole given table, so
it grows with it; the oracle builds the same rows in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qualframe import model as M

KINDS = tuple(M.MENU)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(key: Column, by: int, branches: list[tuple[int, Column]], otherwise: Column) -> Column:
    """First branch whose bound exceeds key % by."""
    rest = key % by
    (bound, value), *more = branches
    out = F.when(rest < bound, value)
    for bound, value in more:
        out = out.when(rest < bound, value)
    return out.otherwise(otherwise)


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All text: three date layouts, stragglers among numbers, blanks, a constant, extremes, copies."""
    key, day, price = F.col("o_orderkey"), F.col("o_orderdate"), F.col("o_totalprice")
    raised = F.when(key % 997 == 0, price * 100).otherwise(price)
    rows = table(spark, sf_dir, "orders").select(
        key.cast("string").alias("order_key"),
        _pick(
            key,
            20,
            [(11, F.date_format(day, "yyyy-MM-dd")), (17, F.date_format(day, "dd/MM/yyyy"))],
            F.date_format(day, "dd MMMM yyyy"),
        ).alias("order_date"),
        _pick(
            key,
            50,
            [(1, F.lit("pending")), (2, F.lit("TBD")), (3, F.lit("N/A")), (4, F.lit("-"))],
            F.format_number(price, 2),
        ).alias("revenue"),
        _pick(key, 5, [(1, F.lit(""))], (key % 4 * 5).cast("string")).alias("discount"),
        _pick(key, 8, [(5, F.lit("")), (6, F.lit("Bulk order")), (7, F.lit("Gift"))], F.lit("Repeat")).alias(
            "notes"
        ),
        F.lit("USD").alias("currency"),
        F.format_string("%.2f", raised).alias("unit_price"),
    )
    again = rows.where(F.col("order_key").cast("bigint") % 25 == 0)
    return rows.unionAll(again)


def dirty_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All text: spellings of a segment, padding, malformed emails and phone numbers."""
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    spelt = (
        F.when(key % 9 == 0, F.lower(segment))
        .when(key % 7 == 0, F.initcap(segment))
        .otherwise(segment)
    )
    number = key.cast("string")
    return table(spark, sf_dir, "customer").select(
        number.alias("cust_key"),
        F.when(key % 13 == 0, F.concat(F.lit("  "), spelt, F.lit("\t"))).otherwise(spelt).alias("segment"),
        F.when(key % 14 == 0, F.concat(F.lit("user"), number, F.lit("@")))
        .otherwise(F.concat(F.lit("user"), number, F.lit("@example.com")))
        .alias("email"),
        F.when(key % 17 == 0, F.lit("call me"))
        .otherwise(F.concat(F.lit("+1 (555) "), F.lpad((key % 10000).cast("string"), 4, "0")))
        .alias("phone"),
        F.col("c_name").alias("name"),
    )


def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed key and time, text value with written-out blanks, gaps in the event type."""
    key = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        F.when(key % 15 == 0, "N/A").otherwise(F.format_string("%.2f", F.col("value"))).alias("value"),
        F.when(key % 16 == 0, "").otherwise(F.col("event_type")).alias("event_type"),
    )


def nested_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each event, copies among them: maps inside structs and arrays, whose entries change places, and variants."""
    key, user, kind = F.col("event_id"), F.col("user_id") % 40, F.col("event_type")
    entries = [F.struct(F.lit("type").alias("k"), kind.alias("v")), F.struct(F.lit("user").alias("k"), user.cast("string").alias("v"))]
    turned = F.when(key % 2 == 0, F.array(*entries)).otherwise(F.array(*reversed(entries)))
    facts = F.map_from_entries(turned)
    text = F.format_string('{"user": %d, "type": "%s"}', user, kind)
    turned_text = F.format_string('{"type": "%s", "user": %d}', kind, user)
    return table(spark, sf_dir, "events").select(
        key.alias("event_id"),
        user.alias("user"),
        F.struct(F.lit(1).alias("one"), facts.alias("facts")).alias("inside"),
        F.array(facts, F.when(user % 3 == 0, F.create_map(F.lit("x"), F.lit("y")))).alias("list"),
        F.parse_json(F.when(key % 3 == 0, text).otherwise(turned_text)).alias("said"),
    )


def wide_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole and decimal numbers that doubles cannot tell apart, with gaps."""
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(line > 1, key + F.lit(9007199254740993)).alias("wide"),
        F.when(line != 2, (key.cast("decimal(30,0)") + F.lit("12345678901234567890").cast("decimal(30,0)")) / 8)
        .cast("decimal(36,3)")
        .alias("exact"),
    )


def dirty_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, with languages and hosts in differing capitals and padded."""
    key, lang, source = F.col("doc_id"), F.col("lang"), F.col("source")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        "text",
        F.when(key % 5 == 0, F.upper(lang)).when(key % 11 == 0, F.initcap(lang)).otherwise(lang).alias("lang"),
        F.when(key % 7 == 0, F.upper(source)).when(key % 13 == 0, F.concat(source, F.lit(" "))).otherwise(source).alias("source"),
        "n_chars",
    )


def issue_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three issues for each of as many runs as there are orders."""
    key, j = F.col("o_orderkey"), F.col("j")
    kinds = F.array(*map(F.lit, KINDS))
    rows = table(spark, sf_dir, "orders").select(
        "*", F.explode(F.array(F.lit(0), F.lit(4), F.lit(8))).alias("j")
    )
    kind = F.get(kinds, ((key + j) % 9).cast("int"))
    column = F.concat(F.lit("c"), (key % 100).cast("string"))
    severities = F.array(*map(F.lit, M.SEVERITY_WEIGHT))
    pct = ((key * 7 + j) % 1000) / 10
    return rows.select(
        key.cast("string").alias("run_id"),
        F.concat(kind, F.lit(":"), column).alias("issue_id"),
        kind.alias("issue_type"),
        F.when(kind != M.DUPLICATES, column).alias("column"),
        F.get(severities, ((key + j) % 4).cast("int")).alias("severity"),
        F.concat(F.lit("Finding in "), column).alias("title"),
        F.col("o_orderpriority").alias("detail"),
        ((key * 7 + j) % 1000).alias("affected_rows"),
        pct.alias("affected_pct"),
        F.array("o_orderstatus", "o_orderpriority").alias("evidence"),
        F.lit("none").alias("default_strategy"),
        F.when(kind == M.MISSING, key % 2 == 0).alias("numeric"),
        F.when((kind == M.OUTLIERS) & (key % 4 > 0), F.lit(0.0)).alias("lower_bound"),
        F.when(kind == M.OUTLIERS, F.lit(10.0)).alias("upper_bound"),
    )


def decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on two thirds of the issues; some off the menu, some without the value they need."""
    issues = issue_log(spark, sf_dir)
    key = F.col("run_id").cast("bigint")
    menu = F.create_map(
        *[x for kind, names in M.MENU.items() for x in (F.lit(kind), F.array(*map(F.lit, names)))]
    )[F.col("issue_type")]
    place = F.pmod(F.floor(key / 9), F.size(menu)).cast("int")
    return issues.where(key % 3 < 2).select(
        "run_id",
        F.when(key % 17 == 0, F.lit("unknown:c0")).otherwise(F.col("issue_id")).alias("issue_id"),
        (key % 4 > 0).alias("approved"),
        F.when(key % 11 == 0, F.lit("drop_column")).otherwise(F.get(menu, place)).alias("strategy"),
        F.when(key % 5 == 0, F.lit("X")).when(key % 5 == 1, F.lit("")).alias("fill_value"),
    )


def reply_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw reply per run, by key % 7: fenced, wrapped, unknown id, off the menu, one issue left out,
    no JSON at all, plain."""
    key = F.col("o_orderkey")
    column = F.concat(F.lit(":c"), (key % 100).cast("string"))
    kinds = F.array(*map(F.lit, KINDS))
    second = F.array(*[F.lit(names[1]) for names in M.MENU.values()])

    def item(j: int) -> Column:
        place = ((key + j) % 9).cast("int")
        ident = F.concat(F.get(kinds, place), column)
        strategy = F.get(second, place)
        if j == 4:
            ident = F.when(key % 7 == 2, F.lit("unknown:c0")).otherwise(ident)
            strategy = F.when(key % 7 == 3, F.lit("rewrite_all")).otherwise(strategy)
        return F.struct(
            ident.alias("id"),
            strategy.alias("strategy"),
            F.concat(F.lit("  because of "), F.col("o_orderpriority"), F.lit(" ")).alias("reasoning"),
            ((key % 101) / 100).alias("confidence"),
        )

    items = F.array(item(0), item(4), item(8))
    text = F.to_json(F.when(key % 7 == 4, F.slice(items, 1, 2)).otherwise(items))
    reply = (
        F.when(key % 7 == 0, F.concat(F.lit("```json\n"), text, F.lit("\n```")))
        .when(key % 7 == 1, F.concat(F.lit('{"note": "n", "results": '), text, F.lit("}")))
        .when(key % 7 == 5, F.lit("I cannot help with that."))
        .otherwise(text)
    )
    return table(spark, sf_dir, "orders").select(key.cast("string").alias("run_id"), reply.alias("reply"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per customer."""
    key = F.col("c_custkey")
    status = F.array(
        *map(F.lit, ("queued", "analyzing", "awaiting_approval", "applying", "completed", "failed"))
    )
    before = (F.lit(50) + key % 40).cast("double")
    return table(spark, sf_dir, "customer").select(
        key.cast("string").alias("run_id"),
        F.col("c_name").alias("filename"),
        F.get(status, (key % 6).cast("int")).alias("status"),
        F.concat(F.lit("t"), F.lpad(key.cast("string"), 12, "0")).alias("created_at"),
        F.when(key % 6 > 3, F.concat(F.lit("u"), F.lpad(key.cast("string"), 12, "0"))).alias("updated_at"),
        (key * 3).alias("rows_before"),
        (key * 2).alias("rows_after"),
        (key % 20).alias("columns_before"),
        (key % 19).alias("columns_after"),
        before.alias("score_before"),
        (before + key % 10 + F.lit(0.5)).alias("score_after"),
        (key % 13).alias("issues_found"),
        (key % 7).alias("fixes_applied"),
        F.lit("rules").alias("provider"),
        F.lit("built-in").alias("model"),
        (key % 3).alias("llm_calls"),
        (key % 500).alias("prompt_tokens"),
        (key % 300).alias("completion_tokens"),
    )


def applied_log_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change records of the approved decisions of the log that name a known issue."""
    kind = F.get(F.split("issue_id", ":"), 0)
    approved = decision_log(spark, sf_dir).where("approved and issue_id != 'unknown:c0'")
    return approved.select(
        "run_id",
        "issue_id",
        F.array_position(F.array(*map(F.lit, KINDS)), kind).alias("step"),
        "strategy",
        (F.col("strategy") != "none").alias("applied"),
        F.lit(0).cast("bigint").alias("rows_changed"),
        F.lit(0).cast("bigint").alias("rows_removed"),
        F.lit(0).cast("bigint").alias("columns_removed"),
        F.concat(F.lit("Changed by "), "strategy").alias("detail"),
    )


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the given table as audit entries of the runs of the same number."""
    actors = F.array(*map(F.lit, ("system", "detector", "ai", "human")))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("run_id"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("e"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("at"),
        F.get(actors, (F.col("event_id") % 4).cast("int")).alias("actor"),
        F.col("event_type").alias("event"),
        F.concat(F.lit("a|b "), F.col("props")).alias("detail"),
    )
