"""Alerts and values of a portfolio made by hand."""

import datetime as dt
import json

from marlstone.operators import risk


def test_alerts_values_and_report(spark):
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    path = {"fall": [100.0 + k % 2 for k in range(30)] + [60.0], "calm": [50.0 + k % 2 for k in range(31)], "one": [10.0]}
    bars = spark.createDataFrame([(s, day(k), c + 1, c - 1, c) for s, p in path.items() for k, c in enumerate(p)], "symbol string, date date, high double, low double, close double")
    holdings = spark.createDataFrame([("fall", "tech", 10, 100.0), ("calm", "food", 4, 40.0), ("one", None, 1, 20.0), ("gone", "food", 5, 1.0)], "symbol string, sector string, qty int, avg_price double")
    valued = risk.priced(holdings, bars)
    got = {(r["kind"], r["subject"]): r for r in risk.risk_alerts(valued, bars).collect()}
    assert set(got) == {("stop_loss", "fall"), ("circuit_breaker", "portfolio"), ("sector_concentration", "tech"), ("no_price_data", "gone")}
    before, now = 10 * 101 + 4 * 51 + 10, 10 * 60 + 4 * 50 + 10
    assert got["circuit_breaker", "portfolio"]["value"] == round(100 * now / before - 100, 2) and got["sector_concentration", "tech"]["value"] == round(100 * 600 / now, 2)
    assert got["stop_loss", "fall"]["value"] == 60.0 < got["stop_loss", "fall"]["bound"]
    table = {r["sector"]: (r["positions"], r["cost"], r["value"], r["gain"]) for r in risk.valuation_by_sector(valued).collect()}
    assert table == {"tech": (1, 1000.0, 600.0, -400.0), "food": (1, 160.0, 200.0, 40.0), "Unknown": (1, 20.0, 10.0, -10.0), "TOTAL": (3, 1180.0, 810.0, -370.0)}
    report = risk.daily_report(valued, risk.risk_alerts(valued, bars)).first()
    assert (report["critical"], report["warnings"], report["halted"], report["gain"]) == (2, 1, True, -370.0) and json.loads(report["document"])["positions"] == 3
    assert {r["symbol"]: r["prev_close"] for r in risk.latest_prices(bars).collect()} == {"fall": 101.0, "calm": 51.0, "one": 10.0}
    empty = risk.priced(holdings.limit(0), bars)
    assert risk.risk_alerts(empty, bars).count() == 0 and risk.valuation_by_sector(empty).count() == 0
