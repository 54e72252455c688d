"""Values of accounts that are brought into one form, or refused."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyspark import settings
from tallyspark.functions import text


def test_senders(spark):
    def of(*items):
        return spark.createDataFrame([(list(items),)], "s array<string>").select(text.senders(F.col("s"))).first()[0]

    assert of(" Alerts@Bank.example ", "bank.example", "ALERTS@bank.example", "") == ["alerts@bank.example", "bank.example"]
    assert of() == []
    for bad in ("two words", "@bank.example", "alerts@", "a@b@c"):
        with pytest.raises(PySparkException, match="no sender"):
            of("bank.example", bad)


def test_account_types(spark):
    types = spark.createDataFrame([(None,), ("",), (" Bank Account",), ("CREDIT_CARD",)], "t string")
    assert [r[0] for r in types.select(settings.account_type("t")).collect()] == ["credit_card", "credit_card", "bank_account", "credit_card"]
    with pytest.raises(PySparkException, match="no type of account"):
        spark.range(1).select(settings.account_type(F.lit("loan"))).collect()
