"""The definitions once more in plain Python, over lists of rows."""

from __future__ import annotations

import math
from collections import defaultdict

DELINQUENT = {"1", "2", "3", "4", "5"}


def number(v):
    return None if v in ("", None) else float(v)


def ratio(a, b):
    return None if a is None or b is None or b == 0 else a / b


def total(values):
    kept = [v for v in values if v is not None]
    return sum(kept) if kept else None


def features(apps, loans, months):
    """Entity number to feature id to value."""
    owner = {r["SK_ID_BUREAU"]: r["SK_ID_CURR"] for r in loans}
    by_loan, by_month = defaultdict(list), defaultdict(list)
    for r in loans:
        if r["DAYS_CREDIT"] <= 0:
            by_loan[r["SK_ID_CURR"]].append(r)
    for r in months:
        if r["MONTHS_BALANCE"] <= 0:
            by_month[owner[r["SK_ID_BUREAU"]]].append(r)
    result = {}
    for a in apps:
        income, credit, annuity, goods = [number(a[c]) for c in ("AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE")]
        scores = [number(a[f"EXT_SOURCE_{i}"]) for i in (1, 2, 3)]
        known = [s for s in scores if s is not None]
        f = {
            "app.credit_income_ratio": ratio(credit, income), "app.annuity_income_ratio": ratio(annuity, income),
            "app.credit_annuity_ratio": ratio(credit, annuity), "app.goods_credit_ratio": ratio(goods, credit),
            "app.age_years": a["DAYS_BIRTH"] / -365.25, "app.ext_source_mean": sum(known) / len(known) if known else None,
            "app.ext_source_missing_count": float(3 - len(known)),
            "app.document_flag_count": float(sum(a[f"FLAG_DOCUMENT_{i}"] for i in range(2, 22))),
        }
        rows = by_loan.get(a["SK_ID_CURR"])
        f.update({
            "bureau.record_count": len(rows), "bureau.active_count": sum(r["CREDIT_ACTIVE"] == "Active" for r in rows),
            "bureau.closed_count": sum(r["CREDIT_ACTIVE"] == "Closed" for r in rows),
            "bureau.credit_sum_total": total([number(r["AMT_CREDIT_SUM"]) for r in rows]),
            "bureau.debt_sum_total": total([number(r["AMT_CREDIT_SUM_DEBT"]) for r in rows]),
            "bureau.overdue_sum_total": total([number(r["AMT_CREDIT_SUM_OVERDUE"]) for r in rows]),
            "bureau.days_credit_mean": sum(r["DAYS_CREDIT"] for r in rows) / len(rows),
            "bureau.recent_12m_count": sum(-365 <= r["DAYS_CREDIT"] <= 0 for r in rows),
        } if rows else dict.fromkeys((
            "bureau.record_count", "bureau.active_count", "bureau.closed_count", "bureau.credit_sum_total", "bureau.debt_sum_total",
            "bureau.overdue_sum_total", "bureau.days_credit_mean", "bureau.recent_12m_count")))
        rows = by_month.get(a["SK_ID_CURR"])
        if rows:
            newest = min(rows, key=lambda r: (-r["MONTHS_BALANCE"], r["SK_ID_BUREAU"]))
            levels = [0 if r["STATUS"] in "CX" else int(r["STATUS"]) for r in rows]
            f.update({
                "bureau_balance.month_count": len(rows), "bureau_balance.delinquent_month_count": sum(r["STATUS"] in DELINQUENT for r in rows),
                "bureau_balance.max_delinquency_level": max(levels),
                "bureau_balance.latest_status_delinquent": float(newest["STATUS"] in DELINQUENT),
            })
        else:
            f.update(dict.fromkeys((
                "bureau_balance.month_count", "bureau_balance.delinquent_month_count", "bureau_balance.max_delinquency_level",
                "bureau_balance.latest_status_delinquent")))
        result[a["SK_ID_CURR"]] = f
    return result


def woe(rows, bins=4):
    """Rules of one feature from (value, prediction_id, label) rows: bin to (good, bad, woe, iv, lower, upper)."""
    present = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1]))
    good, bad = sum(r[2] == 0 for r in rows), sum(r[2] == 1 for r in rows)
    if len(present) < 8 or not good or not bad:
        return {}
    groups = {}
    absent = [r for r in rows if r[0] is None]
    if absent:
        groups[-1] = absent
    size = max(len(present) // bins, 1)
    for i in range(bins):
        groups[i] = present[i * size:] if i == bins - 1 else present[i * size:(i + 1) * size]
    rules = {}
    for i, members in groups.items():
        g, b = sum(r[2] == 0 for r in members), sum(r[2] == 1 for r in members)
        gd, bd = (g + 0.5) / (good + 2.0), (b + 0.5) / (bad + 2.0)
        weight = math.log((g + 0.5) / (b + 0.5)) if i == -1 else math.log(gd / bd)
        lower, upper = (None, None) if i == -1 else (members[0][0], members[-1][0])
        rules[i] = (g, b, weight, (gd - bd) * weight, lower, upper)
    return rules
