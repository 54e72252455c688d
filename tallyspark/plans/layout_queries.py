"""Queries over rendered statement heads: balances by label, header and anchor; reading by registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import extract, registry
from tallyspark.plans.catalogue import ORDERS_SQL, dealt, orders, query

_HEAD_SQL = f"with {ORDERS_SQL} select ref, amount as opening, (amount + 1)::decimal(18,2) as closing, (amount + 2)::decimal(18,2) as due, (amount + 3)::decimal(18,2) as total, 'AAN' || (1000000 + ref) as reference from orders_t"


@query(_HEAD_SQL)
def layout_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement head per order: a table under a header, a label with doubled letters, a section with a total, a reference."""

    def money(plus: int):
        return F.format_number(F.col("amount") + plus, 2)

    o = orders(spark, sf_dir)
    head = F.concat_ws(
        "\n",
        F.concat(F.lit("Reference No. "), F.concat(F.lit("AAN"), F.col("ref") + 1000000)),
        F.lit("Opening Balance       Purchases             Closing Balance"),
        F.concat(F.rpad(money(0), 22, " "), F.rpad(F.lit("0.10"), 22, " "), money(1)),
        F.lit("AAmmoouunntt  DDuuee"),
        F.lit("05/01/2024"),
        F.concat(F.lit("Rs. "), money(2)),
        F.lit("Outstanding"),
        F.lit("1.00"),
        F.concat(F.lit("Total 9.00 "), money(3)),
    )
    text = o.select("ref", head.alias("t"))
    return text.select(
        "ref",
        extract.column_below_header("t", "Opening Balance", "Opening Balance").alias("opening"),
        extract.column_below_header("t", "Opening Balance", "Closing Balance").alias("closing"),
        extract.amount_below_label("t", "Amount Due").alias("due"),
        extract.section_total("t", "Outstanding").alias("total"),
        extract.reference("t", "Reference No.").alias("reference"),
    )


@query(f"""with {ORDERS_SQL}
select ref, day as date, note as description, (case when mark = 'CR' then amount else 0 end)::decimal(18,2) as credited, (case when mark = 'CR' then 0 else amount end)::decimal(18,2) as debited
from orders_t where account % 5 < 4""")
def read_by_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of four banks and of one without a reader, each written in its bank's layout."""
    o, kind = dealt(orders(spark, sf_dir)), F.col("account") % 5
    day, money = F.date_format("day", "dd/MM/yyyy"), F.format_number("amount", 2)
    line = (
        F.when(kind == 0, F.concat_ws(" ", day, F.lit("R9"), F.col("note"), money, F.col("mark")))
        .when(kind == 1, F.concat(F.date_format("day", "dd-MM-yyyy"), F.lit(" "), F.col("note"), F.lit(" "), money, F.initcap("mark")))
        .when(kind == 2, F.concat_ws(" ", F.date_format("day", "dd-MMM-yyyy"), F.date_format("day", "dd-MMM-yyyy"), F.col("note"), money, F.when(F.col("mark") == "CR", "Cr")))
        .otherwise(F.concat_ws(" ", day, F.col("note"), money, F.initcap("mark")))
    )
    bank = F.element_at(F.array(*(F.lit(b) for b in ("bob", "federal", "pnb", "yes", "none"))), (kind + 1).cast("int"))
    statements = o.select("ref", bank.alias("bank"), F.when(kind == 1, "signet").otherwise("easy").alias("variant"), line.alias("text"))
    return registry.read_statements(statements)[0].select("ref", "date", "description", "credited", "debited")
