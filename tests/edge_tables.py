"""Small hand-made lifecycle tables, one row per awkward case, and random ones."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta
from decimal import Decimal

from spanledger.schema import TABLES


def _day(text: str | None) -> date | None:
    return None if text is None else date.fromisoformat(text)


def _account(key, signup, tier="Basic", source="organic", industry="Retail", country="US", flag=False):
    return (key, f"Account {key}", industry, country, _day(signup), source, tier, 5, False, flag)


def _sub(key, account, start, end=None, tier="Basic", mrr="10.00", trial=False):
    amount = Decimal("0.00") if trial else Decimal(mrr)
    return (
        key, account, _day(start), _day(end), tier, 3, amount, amount * 12, trial,
        False, False, end is not None, "monthly", True,
    )


def _use(key, sub, day, feature, count=1, secs=10, errors=0, beta=False):
    return (key, sub, _day(day), feature, count, secs, errors, beta)


def _ticket(key, account, hours, priority, minutes, score, escalated=False, closed_offset=60):
    opened = datetime(2024, 3, 1, 8, 0)
    closed = opened + timedelta(minutes=closed_offset)
    points = None if score is None else Decimal(score)
    return (key, account, opened, closed, Decimal(hours), priority, minutes, points, escalated)


def _churn(key, account, day, reason="budget", refund="0.00", up=False, down=False, back=False, text=None):
    return (key, account, _day(day), reason, Decimal(refund), up, down, back, text)


ACCOUNTS = [
    _account("plain", "2023-01-15"),
    _account("one_day", "2023-01-31", "Pro", "ads"),
    _account("reversed", "2023-02-10", "Pro", "ads", "Health", "DE"),
    _account("edges", "2023-02-01", "Enterprise", "partner", "Health", "DE", True),
    _account("empty_handed", "2023-04-05", "Basic", "event", "Retail", "FR"),
    _account("only_trials", "2023-05-20", "Enterprise", "other", "Health"),
    _account("late_trial", "2023-05-21", "Pro", "organic", "Fin"),
    _account("same_day_trial", "2023-06-30", "Basic", "partner", "Fin", "FR", True),
    _account("early_start", "2023-09-09", "Pro", "event"),
    _account("many", "2023-01-02", "Enterprise", "organic", "Fin", "US", True),
    _account("last_month", "2024-06-11", "Free", "other", "Edu", "JP"),
]

SUBSCRIPTIONS = [
    _sub("s01", "plain", "2023-01-20"),
    _sub("s02", "one_day", "2024-01-31", "2024-01-31", "Pro"),
    _sub("s03", "one_day", "2023-03-05", "2023-03-28", "Pro", "20.50"),
    _sub("s04", "reversed", "2023-05-10", "2023-03-01"),
    _sub("s05", "reversed", "2023-05-20", "2023-05-02", "Pro", "7.77"),
    _sub("s06", "edges", "2023-02-28", "2023-06-01", "Enterprise", "99.99"),
    _sub("s07", "edges", "2023-08-31", "2023-10-01", "Enterprise", "5.01"),
    _sub("s08", "only_trials", "2023-06-01", None, "Pro", trial=True),
    _sub("s09", "only_trials", "2023-07-01", "2023-07-15", "Basic", trial=True),
    _sub("s10", "late_trial", "2023-06-01", "2023-08-01", "Pro", "33.30"),
    _sub("s11", "late_trial", "2023-09-01", None, "Pro", trial=True),
    _sub("s12", "same_day_trial", "2023-07-04", None, "Basic", trial=True),
    _sub("s13", "same_day_trial", "2023-07-04", None, "Basic", "12.00"),
    _sub("s14", "early_start", "2023-07-30", "2023-11-30", "Enterprise", "1.00"),
    _sub("s15", "many", "2022-11-15", "2023-02-14", "Basic", "40.00"),
    _sub("s16", "many", "2023-01-10", "2023-04-10", "Basic", "41.00"),
    _sub("s17", "many", "2023-01-20", "2023-01-25", "Basic", "42.00"),
    _sub("s18", "many", "2023-06-15", None, "Enterprise", "43.00"),
    _sub("s19", "many", "2023-06-16", "2023-12-31", "Enterprise", "44.00", trial=True),
    _sub("s20", "last_month", "2024-06-12", None, "Basic", "3.33"),
    _sub("s21", "no such account", "2023-03-03", "2023-04-04", "Basic", "1000.00"),
]

USAGE = [
    _use("u1", "s01", "2023-01-19", "search", 3, 7),
    _use("u1", "s01", "2023-01-20", "search", 4, 8, 1),
    _use("u1", "s02", "2024-01-31", "search", 1, 0),
    _use("u2", "s02", "2024-02-01", "export", 8, 3, 1, True),
    _use("u3", "s06", "2023-06-01", "export", 0, 9, 2),
    _use("u4", "s06", "2023-06-02", "broken", 0, 5, 4, True),
    _use("u5", "s16", "2023-02-02", "tie_a", 6, 11),
    _use("u6", "s17", "2023-02-02", "tie_b", 6, 12),
    _use("u6", "s18", "2024-09-30", "search", 200, 13, 1),
    _use("u7", "no such record", "2023-02-02", "search", 50, 1),
]

TICKETS = [
    _ticket("t1", "plain", "1.00", "low", 1, None),
    _ticket("t2", "plain", "2.01", "urgent", 2, "3.0", True),
    _ticket("t3", "edges", "0.01", "high", 0, "5.0"),
    _ticket("t4", "edges", "0.02", "medium", 7, None),
    _ticket("t5", "many", "10.05", "low", 8, "4.0"),
    _ticket("t6", "many", "3.33", "other", 9, "4.5", True, closed_offset=-5),
    _ticket("t7", "no such account", "8.00", "high", 3, None),
]

CHURN = [
    _churn("c1", "edges", "2023-06-01", "budget", "10.01"),
    _churn("c2", "many", "2023-03-01", "features", "0.00", True),
    _churn("c3", "many", "2023-03-15", "budget", "5.00", back=True, text="came back"),
    _churn("c4", "many", "2024-02-01", "pricing", "0.02", True, True, True),
    _churn("c5", "late_trial", "2023-05-01", "pricing", "0.01", text="before signup"),
    _churn("c6", "same_day_trial", "2023-07-01", "features", "1.00", text=""),
    _churn("c7", "no such account", "2023-07-01", "unknown"),
]

ROWS = {
    "accounts": ACCOUNTS,
    "subscriptions": SUBSCRIPTIONS,
    "feature_usage": USAGE,
    "support_tickets": TICKETS,
    "churn_events": CHURN,
}


def _frames(spark, rows):
    return {name: spark.createDataFrame(rows[name], schema) for name, schema in TABLES.items()}


def edge_tables(spark):
    return _frames(spark, ROWS)


def empty_tables(spark):
    return _frames(spark, {name: [] for name in TABLES})


def random_tables(spark, seed: int, accounts: int = 60, records: int = 900, hot: float = 0.35):
    """Tables in which one account, record, feature and reason hold a third of the rows."""
    rng = random.Random(seed)
    first = date(2022, 6, 1)

    def day(span=900):
        return first + timedelta(days=rng.randrange(span))

    def skewed(keys):
        return keys[0] if rng.random() < hot else rng.choice(keys)

    keys = [f"a{n}" for n in range(accounts)]
    holders = keys[: accounts - 5] + ["ghost"]
    subs = [f"s{n}" for n in range(records)]
    tiers, sources = ["Basic", "Pro", "Enterprise"], ["organic", "other", "ads", "event", "partner"]
    features = [f"feature_{n}" for n in range(20)]
    reasons = ["budget", "features", "pricing", "support"]
    rows = {
        "accounts": [
            _account(k, day(500).isoformat(), rng.choice(tiers), skewed(sources),
                     rng.choice(["Retail", "Fin", "Edu"]), rng.choice(["US", "DE"]), rng.random() < 0.3)
            for k in keys
        ],
        "subscriptions": [],
        "feature_usage": [
            _use(f"u{rng.randrange(records)}", skewed(subs + ["lost"]), day().isoformat(), skewed(features),
                 rng.randrange(30), rng.randrange(500), rng.randrange(3), rng.random() < 0.2)
            for _ in range(3 * records)
        ],
        "support_tickets": [
            _ticket(f"t{n}", skewed(holders), f"{rng.randrange(9000) / 100:.2f}",
                    rng.choice(["low", "medium", "high", "urgent"]), rng.randrange(300),
                    rng.choice([None, "3.0", "4.0", "5.0"]), rng.random() < 0.1)
            for n in range(records)
        ],
        "churn_events": [
            _churn(f"c{n}", skewed(holders[20:] + ["ghost"]), day().isoformat(), skewed(reasons),
                   f"{rng.randrange(5000) / 100:.2f}", rng.random() < 0.2, rng.random() < 0.2,
                   rng.random() < 0.2, rng.choice([None, "text"]))
            for n in range(records // 4)
        ],
    }
    for key in subs:
        start = day()
        closes = rng.random() < 0.5
        end = start + timedelta(days=rng.randrange(-20, 400)) if closes else None
        rows["subscriptions"].append(
            _sub(key, skewed(holders), start.isoformat(), end and end.isoformat(), rng.choice(tiers),
                 f"{rng.randrange(100000) / 100:.2f}", rng.random() < 0.2)
        )
    return _frames(spark, rows)
