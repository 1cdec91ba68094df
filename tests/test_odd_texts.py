"""Queries over texts against their SQL, on texts that regular expressions, thresholds and roundings of two engines could read differently."""

import shutil

import duckdb
import pytest
from test_queries import DATA, rows

from corpusmill.plans import catalog

WORDS = "the report of the year is a list of plain words and some more of them for all to read in the end"
QUALITY_TEXTS = (
    WORDS + " Übermutig éfooBar größeAbc niñoDel xÜaBc " * 3, WORDS + " " + "a" * 24 + "ü " + WORDS, f"{WORDS}\x0b{WORDS}\x0b ", "one two three four\x0bfive six seven eight nine ten eleven twelve thirteen",
    WORDS + " ÉééÉé ÄäÄäÄä ÖöÖöÖö", WORDS + "\r1. Heading\rSection 4\r\nTable 1\u0085Figure 2", WORDS + "\r\r\r\r\r\r" + WORDS + "     ", "\n".join(["x" * 40, "y" * 240] * 7),
    "\n".join("word " * (n % 60 + 1) for n in (40, 80, 12, 59, 3, 77, 20)), WORDS * 40 + "\x07" * 3, " \x0b \t" + WORDS, "", "short",
)


@pytest.fixture
def same(spark, tmp_path):
    """Whether a query over texts has the rows of its SQL, down to the last digit."""

    def check(name, texts):
        folder = tmp_path / name
        folder.mkdir()
        for table in ("benchmark", "embeddings", "labels"):
            shutil.copy(f"{DATA}/{table}.parquet", folder)
        docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
        docs.coalesce(1).write.parquet(f"file://{folder}/documents.parquet")
        con = duckdb.connect()
        for table in folder.iterdir():
            con.sql(f"create view {table.stem} as select * from '{table}{'/*.parquet' if table.is_dir() else ''}'")
        got = catalog.QUERIES[name](spark, str(folder))
        columns = sorted(got.columns)
        quoted = ", ".join(f'"{c}"' for c in columns)
        assert rows(got.select(*[f"`{c}`" for c in columns]).collect(), columns) == rows(con.sql(f"select {quoted} from ({catalog.ORACLES[name]})").fetchall(), columns)

    return check


@pytest.mark.parametrize("name", ["quality_scores", "quality_tier_counts", "quality_router", "chunk_strategy_route", "quality_metrics"])
def test_quality_of_odd_texts(same, name):
    same(name, QUALITY_TEXTS)


CONTRACT_TEXTS = (
    "A fee of $1234567890123456.78 per month and $9,007,199,254,740,993.01 yearly", "It costs $12345678901234567890 in all, $, or $5.5", "Agreement between\x0bAcme LLC, effective as of\x0b1/2/2023", "governed by the lawſ of the State of Kſy",
    "between Kappa Kſ Inc and others", "ALL CAPITALS LINE\u0085\nparty: Some One", "\x0bMASTER AGREEMENT\x0b\nplain", "", "expires on\n12/31/2025 at $ 1,000.50\nper  week",
)


def test_contracts_of_odd_texts(same):
    same("contract_metadata", CONTRACT_TEXTS)


FINANCIAL_TEXTS = (
    "revenue was $5 million and x$7y $8", "this is $1.5 thouſand\nof\x0b$3", "a b c d $1 e$2$3 was is $4,000.50 billion", "w" * 3000 + " " + "v" * 3000 + " and no amount", "w" * 400 + " is  \n $12", "$9 alone", "Kappa Holdings Corp\nQ1 2023 FYſ 2024",
    "Annual Report of some Widgets Inc", "quarter ended\x0bMarch 3, 2023", "1 $" * 30, "",
)


def test_financial_fields_of_odd_texts(same):
    same("financial_metadata", FINANCIAL_TEXTS)


def test_amounts_are_looked_for_in_linear_time(spark):
    """A long word was tried from and to each of its characters."""
    import time

    from pyspark.sql import functions as F

    from corpusmill.functions import metadata

    frame = spark.createDataFrame([("w" * 6000 + " " + "v" * 6000 + " " * 3000 + " costs of $5 million",)], "text string")
    began = time.monotonic()
    assert [a.context for a in frame.select(metadata.financial(F.col("text")).key_amounts.alias("a")).first().a] == ["v" * 6000 + " " * 3001 + "costs"]
    assert time.monotonic() - began < 20
