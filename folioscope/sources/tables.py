"""Tables and literal rows as DataFrames; literal rows also as SQL, so that both engines read the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(rows: list[tuple], columns: str) -> str:
    """``(VALUES ...) t(columns)`` as both engines read it."""
    return "(VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + f") AS t({columns})"


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, float):
        return f"CAST({x!r} AS DOUBLE)"
    return str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


#: Questions at the limits of the query rules: numbers of words, quotes, codes, references to earlier turns.
QUESTIONS = [
    (1, "What is a lease?"),
    (2, "define reserve"),
    (3, "How do I calculate the premium for a long policy under ASC 944-40?"),
    (4, 'Compare "fair value" versus amortised cost of the asset and the liability in IFRS 9 reports of our group'),
    (5, "what does it say about that document"),
    (6, "tax planning and legal advice please"),
    (7, "Give me an example of a template for intercompany consolidation of a subsidiary in our yearly group cash flow statement of the holding"),
    (8, "How are claims handled by the US statutory rules with statutory reserves, SSAP 61 and the NAIC blanks in the valuation manual, and what do the commissioners standard tables say about them?"),
    (9, "foreign currency translation and hedging of exchange rate risk 830-20"),
    (10, ""),
    (11, "Should we buy or sell the portfolio, and does GAAP of 2023 ask for a 12.5% reserve?"),
    (12, "explain mortality and lapse of universal life policies with VM-20, NPR and LDTI for year 5"),
    (13, "steps to certify an actuarial opinion"),
    (14, "IFRS 17 contractual service margin international financial reporting iasb ias premium allocation approach building block approach and its variable fee approach for long contracts"),
]
