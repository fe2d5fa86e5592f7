import os
import sys
from datetime import datetime
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tillroll import schemas  # noqa: E402
from tillroll.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tillroll-tests", "local[4]", spark__ui__enabled="false", spark__sql__shuffle__partitions="4",
        spark__ui__showConsoleProgress="false",
    )
    if not session.conf.get("spark.checkpoint.dir", None):
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


def stamp(text):
    return datetime.fromisoformat(text)


@pytest.fixture(scope="session")
def make_transactions(spark):
    """Rows of (customer, invoice, date text, amount[, description[, country]])."""
    def build(rows):
        full = []
        for row in rows:
            customer, invoice, date, amount, *rest = row
            description = rest[0] if rest else "lamp"
            country = rest[1] if len(rest) > 1 else "France"
            money = Decimal(str(amount)).quantize(Decimal("0.01"))
            full.append((invoice, "s", description, 1, stamp(date), money, customer, country, money))
        return spark.createDataFrame(full, schemas.TRANSACTIONS)

    return build


@pytest.fixture(scope="session")
def make_customers(spark):
    """Rows of (customer, recency, frequency, monetary)."""
    def build(rows):
        data = [(c, r, f, Decimal(str(m)).quantize(Decimal("0.01"))) for c, r, f, m in rows]
        return spark.createDataFrame(data, "CustomerID bigint, recency bigint, frequency bigint, monetary decimal(28,2)")

    return build
