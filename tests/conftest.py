from __future__ import annotations

import csv
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidemark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[4]", "tests",
        **{
            "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


FLAGS = [f"FLAG_DOCUMENT_{i}" for i in range(2, 22)]


def applicants(n: int = 30, start: int = 100001) -> list[dict]:
    """Applicants by rule: both classes, gaps in scores, some document flags set, one zero income."""
    rows = []
    for i in range(n):
        key = start + i
        rows.append({
            "SK_ID_CURR": key, "TARGET": i % 2, "AMT_INCOME_TOTAL": 0 if i == 4 else 100000 + 7000 * (i * 7 % 13),
            "AMT_CREDIT": 300000 + 11000 * (i * 5 % 17), "AMT_ANNUITY": "" if i == 6 else 20000 + 100 * i,
            "AMT_GOODS_PRICE": 250000 + 900 * i, "DAYS_BIRTH": -8000 - 311 * i,
            "EXT_SOURCE_1": "" if i % 3 == 0 else round(0.1 + 0.02 * i, 2),
            "EXT_SOURCE_2": "" if i % 9 == 0 else round(0.9 - 0.01 * i, 2),
            "EXT_SOURCE_3": "" if i % 2 == 0 else 0.5,
            **{f: int((i + k) % 6 == 0) for k, f in enumerate(FLAGS)},
        })
    return rows


def records(apps: list[dict]) -> list[dict]:
    """Up to three records each, the last applicant has none, some lie after the prediction."""
    rows = []
    for i, app in enumerate(apps[:-1]):
        for j in range(1 + i % 3):
            rows.append({
                "SK_ID_CURR": app["SK_ID_CURR"], "SK_ID_BUREAU": 500 + len(rows),
                "DAYS_CREDIT": -700 + 97 * (i * 3 + j) % 760, "CREDIT_ACTIVE": ("Active", "Closed", "Sold")[(i + j) % 3],
                "AMT_CREDIT_SUM": 1000 * (i + 1) + j, "AMT_CREDIT_SUM_DEBT": "" if j == 1 else 500 * i,
                "AMT_CREDIT_SUM_OVERDUE": 10 * j, "DAYS_CREDIT_ENDDATE": -10,
            })
    return rows


def months(loans: list[dict]) -> list[dict]:
    rows = []
    for i, loan in enumerate(loans):
        for m in range(i % 5):
            rows.append({
                "SK_ID_BUREAU": loan["SK_ID_BUREAU"], "MONTHS_BALANCE": 1 - m, "STATUS": "012345CX"[(i * 3 + m) % 8],
            })
    return rows


def write_csv(folder: Path, name: str, rows: list[dict]) -> None:
    with open(folder / name, "w", newline="") as f:
        writer = csv.DictWriter(f, list(rows[0]), lineterminator="\n")
        writer.writeheader()
        writer.writerows(rows)


@pytest.fixture(scope="session")
def credit_rows():
    apps = applicants()
    loans = records(apps)
    return apps, loans, months(loans)


@pytest.fixture(scope="session")
def credit_files(tmp_path_factory, credit_rows):
    folder = tmp_path_factory.mktemp("csv")
    for name, rows in zip(("application_train.csv", "bureau.csv", "bureau_balance.csv"), credit_rows):
        write_csv(folder, name, rows)
    return folder
