"""DuckDB statements that state each result a second time, in a different form.

Months are matched with the interval-overlap join and conversion with a row-wise
search, where the operators use steps and per-account maxima, so agreement is a
check of both.  A statement names the lifecycle tables; ``statement`` puts the
mapping from the order tables in front of it.
"""

from __future__ import annotations

import re

# Stated here once more, not taken from the operators.
_TABLES = ("accounts", "subscriptions", "feature_usage", "support_tickets", "churn_events")
_LAST_MONTH_REPORTED = 18


def _ratio(num: str, den: str, places: int) -> str:
    """Half away from zero on exact integers; NULL over 0."""
    step = 10**places
    num, den = f"cast({num} as hugeint)", f"nullif(cast({den} as hugeint), 0)"
    return f"cast(sign({num}) * ((2 * abs({num}) * {step} + {den}) // (2 * {den})) as double) / {step}"


def _pct(num: str, den: str, places: int = 1) -> str:
    return _ratio(f"100 * cast({num} as hugeint)", den, places)


def _big(expression: str, name: str) -> str:
    return f"cast({expression} as bigint) as {name}"


def _money(expression: str, name: str) -> str:
    return f"cast({expression} as double) as {name}"


_N = "cast(count(*) as bigint)"

# The order tables as lifecycle tables.
MAPPING = {
    "accounts": """
        select c_custkey as account_id, c_name as account_name, c_mktsegment as industry,
               n_name as country,
               coalesce(first_order, date '1995-01-01') - cast(c_custkey % 430 as int) as signup_date,
               case c_nationkey % 5 when 0 then 'organic' when 1 then 'other' when 2 then 'ads'
                    when 3 then 'event' else 'partner' end as referral_source,
               case cast(floor(abs(c_acctbal)) as bigint) % 3 when 0 then 'Basic' when 1 then 'Pro'
                    else 'Enterprise' end as plan_tier,
               1 + c_custkey % 50 as seats, c_custkey % 5 = 0 as is_trial, c_custkey % 4 = 0 as churn_flag
        from customer left join nation on n_nationkey = c_nationkey
        left join (select o_custkey, min(cast(o_orderdate as date)) as first_order
                   from orders group by o_custkey) on o_custkey = c_custkey""",
    "subscriptions": """
        select o_orderkey as subscription_id, o_custkey as account_id,
               cast(o_orderdate as date) as start_date,
               case when o_orderkey % 10 = 0
                    then cast(o_orderdate as date) + cast(o_orderkey % 365 as int) end as end_date,
               case o_orderstatus when 'F' then 'Basic' when 'O' then 'Pro' else 'Enterprise' end as plan_tier,
               cast(case when o_orderpriority = '5-LOW' then 0 else floor(o_totalprice / 100) end
                    as decimal(12,2)) as mrr_amount,
               cast(12 * case when o_orderpriority = '5-LOW' then 0 else floor(o_totalprice / 100) end
                    as decimal(12,2)) as arr_amount,
               o_orderpriority = '5-LOW' as is_trial, o_orderkey % 10 = 0 as churn_flag
        from orders""",
    "feature_usage": """
        select 'U' || l_orderkey || '-' || l_linenumber as usage_id, l_orderkey as subscription_id,
               cast(l_shipdate as date) as usage_date, 'feature_' || (l_partkey % 40 + 1) as feature_name,
               cast(l_quantity as int) as usage_count,
               cast(floor(l_extendedprice / 10) as int) as usage_duration_secs,
               case when l_partkey % 7 = 0 then l_linenumber else 0 end as error_count,
               l_returnflag = 'R' as is_beta_feature
        from lineitem""",
    "support_tickets": """
        select event_id as ticket_id, user_id as account_id, ts as submitted_at,
               ts + to_minutes(cast(floor(value * 60) as bigint)) as closed_at,
               cast(value as decimal(10,2)) as resolution_time_hours,
               case event_type when 'view' then 'low' when 'click' then 'medium'
                    when 'signup' then 'high' else 'urgent' end as priority,
               cast(event_id % 180 as int) as first_response_time_minutes,
               case when event_id % 5 >= 2
                    then cast(3 + event_id % 3 as decimal(3,1)) end as satisfaction_score,
               event_id % 20 = 0 as escalation_flag
        from events""",
    "churn_events": """
        select o_orderkey as churn_event_id, o_custkey as account_id,
               cast(o_orderdate as date) + cast(o_orderkey % 90 as int) as churn_date,
               case cast(floor(o_totalprice) as bigint) % 6 when 0 then 'features' when 1 then 'budget'
                    when 2 then 'support' when 3 then 'unknown' when 4 then 'competitor'
                    else 'pricing' end as reason_code,
               cast(case when o_orderkey % 2 = 0 then floor(o_totalprice / 1000) else 0 end
                    as decimal(10,2)) as refund_amount_usd,
               o_orderkey % 7 = 0 as preceding_upgrade_flag, o_orderkey % 11 = 0 as preceding_downgrade_flag,
               o_orderkey % 10 = 0 as is_reactivation,
               case when o_orderkey % 4 <> 0 then o_orderpriority end as feedback_text
        from orders where o_orderkey % 9 = 4""",
    "expected": """
        select (select count(*) from customer) as accounts, (select count(*) from orders) as subscriptions,
               (select count(*) from lineitem) as feature_usage, (select count(*) from events) as support_tickets,
               count(*) as churn_events, count(distinct o_custkey) as churned_accounts
        from orders where o_orderkey % 9 = 4""",
}

# What lifecycle tables given as such are expected to hold unless told otherwise.
NOTHING_EXPECTED = {
    "expected": f"""
        select {", ".join(f"0 as {t}" for t in (*_TABLES, "churned_accounts"))}""",
}

# Relations over the lifecycle tables that statements may name.
DERIVED = {
    "dated": """
        select signup_date as day, true as opens from accounts
        union all select start_date, true from subscriptions
        union all select end_date, false from subscriptions
        union all select usage_date, false from feature_usage
        union all select churn_date, false from churn_events""",
    "spine": """
        select cast(m as date) as month_start, last_day(cast(m as date)) as month_end,
               strftime(m, '%Y-%m') as month_label
        from (select unnest(generate_series(
                  date_trunc('month', min(day) filter (opens)),
                  date_trunc('month', max(day)) + interval 3 month,
                  interval 1 month)) as m
              from dated)""",
    "last_start": "select cast(date_trunc('month', max(start_date)) as date) as month from subscriptions",
    "open_months": """
        select s.*, m.month_start, m.month_label
        from spine m join subscriptions s
          on s.start_date <= m.month_end and coalesce(s.end_date, m.month_start) >= m.month_start""",
    "cohorts": "select account_id, cast(date_trunc('month', signup_date) as date) as cohort from accounts",
    "sizes": "select cohort, count(*) as cohort_size from cohorts group by cohort",
    "cohort_months": """
        select c.cohort, date_diff('month', c.cohort, o.month_start) as m, o.*
        from open_months o join cohorts c using (account_id)
        where o.month_start >= c.cohort""",
    "churned": "select distinct account_id from churn_events",
    "account_usage": "select u.*, s.account_id from feature_usage u join subscriptions s using (subscription_id)",
    "usage_split": """
        select *, account_id in (select account_id from churned) as is_churned_account
        from account_usage""",
    "ticket_split": """
        select *, account_id in (select account_id from churned) as is_churned_account
        from support_tickets""",
    "trials": """
        select t.plan_tier, t.subscription_id,
               exists (select 1 from subscriptions p
                       where not p.is_trial and p.account_id = t.account_id
                         and p.start_date >= t.start_date) as converted
        from subscriptions t where t.is_trial""",
    "holdings": """
        select account_id, max(case when is_trial then 1 else 0 end) as trial,
               min(case when is_trial then 1 else 0 end) as only_trial
        from subscriptions group by account_id""",
    "per_churner": """
        select account_id, count(*) as n, min(churn_date) as first_date,
               count(*) filter (is_reactivation) as back
        from churn_events group by account_id""",
    "waits": """
        select a.account_id, a.signup_date, p.first_date, p.first_date - a.signup_date as days
        from per_churner p join accounts a using (account_id)""",
    "open_counts": """
        select account_id, count(*) as n from subscriptions where end_date is null group by account_id""",
    "curve": f"""
        select k.m, count(*) as eligible,
               count(*) filter (exists (
                   select 1 from open_months o where o.account_id = c.account_id
                      and o.month_start = c.cohort + to_months(cast(k.m as int)))) as active
        from (select unnest(range(0, {_LAST_MONTH_REPORTED} + 1)) as m) k, cohorts c, last_start l
        where c.cohort + to_months(cast(k.m as int)) <= l.month
        group by k.m""",
    "feature_totals": """
        select feature_name, count(*) as events, count(distinct account_id) as accounts,
               sum(usage_count) as uses, sum(usage_duration_secs) as secs, sum(error_count) as errors
        from account_usage group by feature_name""",
    "split_totals": """
        select is_churned_account, count(distinct account_id) as accounts, count(*) as events,
               sum(usage_count) as uses, sum(error_count) as errors
        from usage_split group by is_churned_account""",
    "new_per_month": """
        select month_label, month_start,
               (select count(*) from accounts where date_trunc('month', signup_date) = month_start) as n
        from spine where month_start <= (select max(signup_date) from accounts)""",
    "month_totals": """
        select month_label, month_start, count(distinct subscription_id) as records, sum(mrr_amount) as mrr
        from open_months where month_start <= (select month from last_start)
        group by month_label, month_start""",
}

_SCORE = f"""count(*) - count(satisfaction_score)"""


def _counts(of: str, by: str, extra: str = "") -> str:
    """Grouped counts with their share of the whole."""
    return f"""
        select {by}, {_N} as {of}, {_pct('count(*)', '(select count(*) from accounts)')} as pct_of_total_accounts
               {extra}
        from accounts group by {by}"""


def _rank(name: str, measure: str = "count(*)") -> str:
    return f"cast(rank() over (order by {measure} desc) as bigint) as {name}"


def _union(parts: list[str]) -> str:
    return " union all ".join(parts)


_AVG_HOURS = _ratio("sum(resolution_time_hours) * 100", "count(resolution_time_hours) * 100", 2)
_AVG_MINUTES = _ratio("sum(first_response_time_minutes)", "count(first_response_time_minutes)", 1)
_IN_WINDOW = "u.usage_date between s.start_date and coalesce(s.end_date, date '9999-12-31')"
_SIX = """
        select count(*) as eligible, count(*) filter (
                   exists (select 1 from subscriptions s where s.account_id = c.account_id
                           and s.start_date < c.cohort + interval 7 month
                           and (s.end_date is null or s.end_date >= c.cohort + interval 6 month))) as active
        from cohorts c where c.cohort + interval 6 month <= (select month from last_start)"""
_LATEST = """
        select sum(mrr_amount) from subscriptions, last_start
        where start_date < month + interval 1 month and (end_date is null or end_date >= month)"""


def _decimals(sql: str, places: int) -> str:
    return f"cast({sql} as decimal(18,{places}))"


def _filled(template: str | None, values: list[str]) -> str:
    """A summary text; concatenation makes it NULL when a value is."""
    if template is None:
        return "cast(null as varchar)"
    pieces = template.replace("%%", "\0").split("%s")
    parts = [f"'{pieces[0]}'"]
    for value, piece in zip(values, pieces[1:], strict=True):
        parts += [f"cast({value} as varchar)", f"'{piece}'"]
    return " || ".join(parts).replace("\0", "%")


_CONVERTED = "(select count(*) as n, count(*) filter (converted) as good from trials)"
# Metric, value, comparison and context of each summary row; every %s is a value.
_SUMMARY_TEXTS = {
    "accounts": ("Total accounts (%s to %s)", "%s", None, "Every account that signed up in these months"),
    "channel": ("Top acquisition channel", "%s", "%s accounts", "Channel with the most accounts"),
    "revenue": (
        "Latest month Aggregate Subscription-Record MRR (%s)", "$%s", None,
        "Sum over all records open in that month, not revenue per customer",
    ),
    "trials": (
        "Trial subscription records", "%s", "%s with a later paid record", "Counts records, not accounts",
    ),
    "conversion": (
        "Trial->paid conversion rate (subscription-level proxy)", "%s%%", None,
        "Proxy: a paid record of the same account starts on or after the trial",
    ),
    "retention": (
        "6-month observed account subscription retention (pooled)", "%s%%", None,
        "Accounts old enough, with a record open in the sixth month after signup",
    ),
    "feature": (
        "Most-used feature (by total usage_count)", "%s", "%s total usage_count",
        "Usage over whole account histories",
    ),
    "churn_events": (
        "Total churn events", "%s", "%s unique churned accounts",
        "From the churn events, not from the account flag",
    ),
    "churn_rate": (
        "Churned-account rate", "%s%%", None, "Churned accounts over all accounts, not events",
    ),
    "repeat_churn": (
        "Repeat-churn accounts", "%s", "%s reactivation events", "Accounts with two or more churn events",
    ),
    "satisfaction": (
        "Support ticket satisfaction score missingness", "%s%%", "Range observed: %s-%s only",
        "Scores are a biased sample of tickets",
    ),
    "resolution": (
        "Support activity: churned vs non-churned avg resolution time", "%sh (churned)",
        "%sh (non-churned)", "Association only, no causal claim",
    ),
}
# Source relation of each summary row, and the values of its three templates.
_SUMMARY = {
    "accounts": (
        "accounts",
        ["strftime(min(signup_date), '%Y-%m')", "strftime(max(signup_date), '%Y-%m')"],
        ["count(*)"],
        [],
    ),
    "channel": (
        "(select referral_source, count(*) as n from accounts group by 1 order by 2 desc, 1 limit 1)",
        [],
        ["referral_source"],
        ["n"],
    ),
    "revenue": (
        "last_start",
        ["strftime(month, '%Y-%m')"],
        [f"format('{{:,}}', cast(round(({_LATEST}), 0) as bigint))"],
        [],
    ),
    "trials": (_CONVERTED, [], ["n"], ["good"]),
    "conversion": (_CONVERTED, [], [_decimals(_pct("good", "n"), 1)], []),
    "retention": (f"({_SIX})", [], [_decimals(_pct("active", "eligible"), 1)], []),
    "feature": (
        "(select feature_name, sum(usage_count) as n from feature_usage group by 1 order by 2 desc, 1 limit 1)",
        [],
        ["feature_name"],
        ["n"],
    ),
    "churn_events": ("churn_events", [], ["count(*)"], ["count(distinct account_id)"]),
    "churn_rate": (
        "churned",
        [],
        [_decimals(_pct("count(*)", "(select count(*) from accounts)"), 1)],
        [],
    ),
    "repeat_churn": ("per_churner", [], ["count(*) filter (n > 1)"], ["coalesce(sum(back), 0)"]),
    "satisfaction": (
        "support_tickets",
        [],
        [_decimals(_pct(_SCORE, "count(*)"), 1)],
        ["min(satisfaction_score)", "max(satisfaction_score)"],
    ),
    "resolution": (
        "(select 1)",
        [],
        [f"(select {_decimals(_AVG_HOURS, 2)} from ticket_split where is_churned_account)"],
        [f"(select {_decimals(_AVG_HOURS, 2)} from ticket_split where not is_churned_account)"],
    ),
}


def _summary_row(key: str) -> str:
    source, *values = _SUMMARY[key]
    *templates, context = _SUMMARY_TEXTS[key]
    metric, value, comparison = map(_filled, templates, values)
    return f"""select {metric} as metric_name, {value} as metric_value, {comparison} as comparison_value,
               '{context}' as context from {source}"""


STATEMENTS: dict[str, str] = {
    "load_row_counts": _union(
        [f"select 'raw_{t}' as table_name, {_N} as row_count from {t}" for t in _TABLES]
    ),
    "calendar_month_spine": "select * from spine",
    "spine_validate": f"""
        select min(month_start) as spine_starts, max(month_start) as spine_ends, {_N} as total_months,
               {_big('count(*) - count(distinct month_label)', 'duplicate_months')} from spine""",
    "open_month_records": f"""
        select subscription_id, account_id, month_start, {_money('mrr_amount', 'mrr_amount')}
        from open_months""",
    "churn_status": """
        select account_id, plan_tier, account_id in (select account_id from churned) as is_churned_account
        from accounts""",
    "usage_with_account": "select * from account_usage",
    "account_cohorts": "select account_id, cohort as cohort_month from cohorts",
    "cohort_sizes": f"select cohort as cohort_month, {_N} as cohort_size from cohorts group by cohort",
    "dq01_row_counts": _union(
        [
            f"""select 'raw_{t}' as table_name, {_N} as actual_rows,
                       {_big(f'(select {t} from expected)', 'expected_rows')} from {t}"""
            for t in _TABLES
        ]
    ),
    "dq02_key_uniqueness": _union(
        [
            f"""select 'raw_{t}.{k}' as key_column, {_N} as total_rows,
                       {_big(f'count(distinct {k})', 'distinct_values')} from {t}"""
            for t, k in (
                ("accounts", "account_id"),
                ("subscriptions", "subscription_id"),
                ("support_tickets", "ticket_id"),
                ("churn_events", "churn_event_id"),
            )
        ]
    ),
    "dq03_duplicate_keys": f"""
        select usage_id, {_N} as occurrences from feature_usage group by usage_id having count(*) > 1""",
    "dq03_duplicate_summary": f"""
        select {_N} as duplicated_usage_ids, {_big('sum(n) - count(*)', 'surplus_rows')}
        from (select count(*) as n from feature_usage group by usage_id) where n > 1""",
    "dq04_fk_orphans": _union(
        [
            f"""select '{c} -> {p}' as relationship, {_N} as orphan_rows from {c} x
                where not exists (select 1 from {p} y where y.{k} = x.{k})"""
            for c, p, k in (
                ("subscriptions", "accounts", "account_id"),
                ("feature_usage", "subscriptions", "subscription_id"),
                ("support_tickets", "accounts", "account_id"),
                ("churn_events", "accounts", "account_id"),
            )
        ]
    ),
    "dq05_open_sub_histogram": f"""
        select n as open_sub_count, {_N} as accounts_with_this_many_open_subs from open_counts group by n""",
    "dq05_open_sub_summary": f"""
        select min(n) as min_open_subs_per_account, {_ratio('sum(n)', 'count(*)', 2)} as avg_open_subs_per_account,
               max(n) as max_open_subs_per_account from open_counts""",
    "dq06_open_rate": f"""
        select {_N} as total_subscriptions, {_big('count(*) - count(end_date)', 'open_subscriptions')},
               {_pct('count(*) - count(end_date)', 'count(*)')} as pct_open from subscriptions""",
    "dq07_derived_column": f"""
        select {_big('count(*) filter (arr_amount - 12 * mrr_amount <> 0)', 'mismatched_arr_rows')}
        from subscriptions""",
    "dq08_trial_vs_zero_mrr": f"""
        select is_trial, mrr_amount = 0 as mrr_is_zero, {_N} as row_count from subscriptions group by all""",
    "dq08_churn_flag_vs_end": f"""
        select churn_flag, end_date is not null as has_end_date, {_N} as row_count
        from subscriptions group by all""",
    "dq09_flag_vs_events": f"""
        select churn_flag as account_churn_flag,
               exists (select 1 from churn_events e where e.account_id = a.account_id) as has_any_churn_event,
               {_N} as account_count
        from accounts a group by all""",
    "dq10_events_per_account": f"""
        select n as events_per_account, {_N} as accounts_with_this_many_events from per_churner group by n""",
    "dq11_usage_in_window": f"""
        select {_N} as total_usage_rows,
               {_big(f'count(*) filter ({_IN_WINDOW})', 'rows_inside_subscription_window')},
               {_pct(f'count(*) filter ({_IN_WINDOW})', 'count(*)')} as pct_inside_window
        from feature_usage u join subscriptions s using (subscription_id)""",
    "dq12_score_missingness": f"""
        select {_N} as total_tickets, {_big('count(satisfaction_score)', 'tickets_with_score')},
               {_big(_SCORE, 'tickets_missing_score')}, {_pct(_SCORE, 'count(*)')} as pct_missing,
               {_money('min(satisfaction_score)', 'min_observed_score')},
               {_money('max(satisfaction_score)', 'max_observed_score')} from support_tickets""",
    "dq13_feedback_missingness": f"""
        select {_N} as total_churn_events, {_big('count(feedback_text)', 'events_with_feedback')},
               {_big('count(*) filter (feedback_text is null)', 'events_missing_feedback')},
               {_pct('count(*) filter (feedback_text is null)', 'count(*)')} as pct_missing from churn_events""",
    "dq14_impossible_dates": f"""
        select 'subscription end before start' as check_name, {_N} as violation_count
        from subscriptions where start_date > end_date
        union all
        select 'ticket closed before submitted', {_N} from support_tickets where submitted_at > closed_at
        union all
        select 'churn event before account signup', {_N}
        from accounts a join churn_events e on e.account_id = a.account_id and a.signup_date > e.churn_date
        union all
        select 'subscription starts before account signup', {_N}
        from accounts a join subscriptions s on s.account_id = a.account_id and a.signup_date > s.start_date""",
    "dq15_category_inventory": _union(
        [
            f"select '{label}' as field, {c} as value, {_N} as row_count from {t} group by {c}"
            for label, t, c in (
                ("referral_source", "accounts", "referral_source"),
                ("plan_tier (accounts)", "accounts", "plan_tier"),
                ("plan_tier (subscriptions)", "subscriptions", "plan_tier"),
                ("reason_code", "churn_events", "reason_code"),
                ("priority", "support_tickets", "priority"),
            )
        ]
    ),
    "dq16_signup_gap_buckets": f"""
        select case when gap < 0 then 'before signup' when gap = 0 then 'same day as signup'
                    when gap <= 30 then '1-30 days after signup'
                    when gap <= 90 then '31-90 days after signup' else '90+ days after signup' end as gap_bucket,
               {_N} as accounts, {_pct('count(*)', 'sum(count(*)) over ()')} as pct_of_accounts
        from (select min(s.start_date) - any_value(a.signup_date) as gap
              from accounts a join subscriptions s using (account_id) group by a.account_id)
        group by 1""",
    "acq_monthly": f"select month_label, month_start, {_big('n', 'new_accounts')} from new_per_month",
    "acq_by_referral": _counts("accounts_acquired", "referral_source", f", {_rank('acquisition_rank')}"),
    "acq_by_plan": _counts("account_count", "plan_tier"),
    "acq_by_industry": _counts(
        "account_count",
        "industry",
        f""", {_big("sum(case referral_source when 'organic' then 1 else 0 end)", 'organic_accounts')},
            {_big("sum(case referral_source when 'partner' then 1 else 0 end)", 'partner_accounts')},
            {_rank('industry_rank')}""",
    ),
    "acq_by_country": _counts("account_count", "country", f", {_rank('country_rank')}"),
    "acq_referral_by_plan": f"""
        select referral_source,
               {_big("sum(case plan_tier when 'Basic' then 1 else 0 end)", 'basic_accounts')},
               {_big("sum(case plan_tier when 'Pro' then 1 else 0 end)", 'pro_accounts')},
               {_big("sum(case plan_tier when 'Enterprise' then 1 else 0 end)", 'enterprise_accounts')},
               {_N} as total_accounts
        from accounts group by referral_source""",
    "acq_reconcile": f"""
        select {_big('(select sum(n) from new_per_month)', 'total_via_monthly')},
               {_big('(select sum(n) from (select count(*) as n from accounts group by referral_source))',
                     'total_via_referral_source')},
               {_big('(select count(*) from accounts)', 'total_accounts_actual')}""",
    "acq_rolling_mean": f"""
        select month_label, month_start, {_big('n', 'new_accounts')},
               cast(lag(n) over w + n + lead(n) over w as double) / 3 as rolling_avg
        from new_per_month window w as (order by month_start)""",
    "mrr_monthly": f"""
        select month_label, month_start, {_big('records', 'active_subscription_records')},
               {_money('mrr', 'aggregate_subscription_mrr')} from month_totals""",
    "mrr_by_plan": f"""
        select month_label, month_start,
               {_money("sum(case plan_tier when 'Basic' then mrr_amount end)", 'basic_mrr')},
               {_money("sum(case plan_tier when 'Pro' then mrr_amount end)", 'pro_mrr')},
               {_money("sum(case plan_tier when 'Enterprise' then mrr_amount end)", 'enterprise_mrr')},
               {_money('sum(mrr_amount)', 'total_mrr')}
        from open_months, last_start where month_start <= month group by month_label, month_start""",
    "mrr_trial_paid": f"""
        select month_label, month_start, {_big('sum(case when is_trial then 1 else 0 end)', 'open_trial_records')},
               {_big('sum(case when is_trial then 0 else 1 end)', 'open_paid_records')},
               {_money('sum(case when is_trial then null else mrr_amount end)', 'paid_mrr')}
        from open_months, last_start where month_start <= month group by month_label, month_start""",
    "mrr_reconcile": f"""
        select {_money('(select mrr from month_totals where month_start = (select month from last_start))',
                       'latest_month_mrr_direct_calc')},
               {_money('(select sum(mrr_amount) from subscriptions)', 'all_time_sum_mrr_upper_bound')}""",
    "conv_subscription_overall": f"""
        select {_N} as total_trial_subscription_records,
               {_big('count(*) filter (converted)', 'trial_records_with_later_paid_record')},
               {_pct('count(*) filter (converted)', 'count(*)')} as subscription_level_conversion_rate_pct
        from trials""",
    "conv_subscription_by_plan": f"""
        select plan_tier, {_N} as trial_records,
               {_big('count(*) filter (converted)', 'trial_records_with_later_paid_record')},
               {_pct('count(*) filter (converted)', 'count(*)')} as conversion_rate_pct
        from trials group by plan_tier""",
    "conv_account_overall": f"""
        select {_N} as accounts_with_any_trial,
               {_big('count(*) filter (only_trial = 0)', 'accounts_with_trial_and_paid')},
               {_pct('count(*) filter (only_trial = 0)', 'count(*)')} as account_level_conversion_rate_pct
        from holdings where trial = 1""",
    "conv_account_by_cohort": f"""
        select strftime(cohort, '%Y-%m') as cohort_month, {_big('sum(trial)', 'accounts_with_any_trial')},
               {_big('sum(trial * (1 - only_trial))', 'accounts_with_trial_and_paid')},
               {_pct('sum(trial * (1 - only_trial))', 'sum(trial)')} as conversion_rate_pct
        from holdings join cohorts using (account_id) group by cohort""",
    "conv_reconcile": f"""
        select {_big('count(*) filter (is_trial)', 'trial_records_check')},
               {_big('count(*) filter (not is_trial)', 'paid_records_check')} from subscriptions""",
    "ret_matrix": f"""
        select strftime(cohort, '%Y-%m') as cohort_month, m as months_since_signup, cohort_size,
               {_big('count(distinct account_id)', 'active_accounts')},
               {_pct('count(distinct account_id)', 'cohort_size')} as retention_rate_pct,
               {_ratio('count(distinct subscription_id)', 'count(distinct account_id)', 1)}
                   as avg_open_sub_records_per_active_account
        from cohort_months join sizes using (cohort) where m <= {_LAST_MONTH_REPORTED}
        group by cohort, m, cohort_size""",
    "ret_pooled_curve": f"""
        select m as months_since_signup, {_big('eligible', 'eligible_accounts')},
               {_big('active', 'active_accounts')},
               {_pct('active', 'eligible')} as retention_rate_pct_eligible_cohorts_only from curve""",
    "ret_month_m_check": f"""
        select {_big('eligible', 'eligible_accounts_month6')}, {_big('active', 'active_accounts_month6')},
               {_pct('active', 'eligible')} as retention_rate_pct_cross_check from ({_SIX})""",
    "ret_ever_active": f"""
        select {_big('count(*) filter (not held)', 'accounts_never_active')},
               {_big('count(*) filter (held)', 'accounts_active_at_least_once')}
        from (select account_id in (select account_id from subscriptions) as held from accounts)""",
    "ret_active_in_signup_month": f"""
        select {_N} as total_accounts,
               {_big('''count(*) filter (exists (select 1 from subscriptions s
                     where s.account_id = c.account_id and s.start_date < c.cohort + interval 1 month
                       and (s.end_date is null or s.end_date >= c.cohort)))''',
                     'accounts_active_in_own_signup_month')}
        from cohorts c""",
    "value_by_cohort": f"""
        select strftime(cohort, '%Y-%m') as cohort_month, m as months_since_signup, cohort_size,
               {_big('n', 'open_subscription_records')}, {_money('mrr', 'observed_subscription_mrr')},
               {_ratio('mrr * 100', 'cohort_size * 100', 2)} as observed_mrr_per_cohort_account,
               {_money('sum(mrr) over (partition by cohort order by m)', 'cumulative_observed_mrr')}
        from (select cohort, m, count(distinct subscription_id) as n, sum(mrr_amount) as mrr
              from cohort_months where m <= {_LAST_MONTH_REPORTED} group by cohort, m)
        join sizes using (cohort)""",
    "value_first_6_months": f"""
        select strftime(cohort, '%Y-%m') as cohort_month, cohort_size,
               {_money('mrr', 'observed_mrr_first_6_months')},
               {_ratio('mrr * 100', 'cohort_size * 100', 2)} as observed_mrr_per_account_first_6_months
        from (select cohort, sum(mrr_amount) filter (m < 6) as mrr from cohort_months group by cohort)
        join sizes using (cohort)
        where cohort + interval 5 month <= (select month from last_start)""",
    "value_reconcile": f"""
        select month_label as month, {_money('sum(known)', 'mrr_via_cohort_path')},
               {_money('sum(mrr_amount)', 'mrr_via_direct_path')}, sum(known) = sum(mrr_amount) as reconciles
        from (select o.*, case when c.account_id is not null then mrr_amount end as known
              from open_months o left join cohorts c using (account_id))
        group by month_label having count(known) > 0 order by month_label""",
    "eng_top_features": f"""
        select feature_name, {_big('events', 'usage_events')}, {_big('accounts', 'distinct_accounts_using')},
               {_big('uses', 'total_usage_count')}, {_big('secs', 'total_duration_secs')},
               {_ratio('secs', 'events', 1)} as avg_duration_secs_per_event,
               {_rank('usage_volume_rank', 'uses')} from feature_totals""",
    "eng_feature_errors": f"""
        select feature_name, {_big('errors', 'total_errors')}, {_big('uses', 'total_usage_count')},
               {_pct('errors', 'uses', 2)} as error_rate_pct, {_rank('error_count_rank', 'errors')}
        from feature_totals""",
    "eng_beta_vs_ga": f"""
        select is_beta_feature, {_big('count(distinct feature_name)', 'distinct_features')},
               {_N} as usage_events, {_big('sum(usage_count)', 'total_usage_count')},
               {_big('sum(error_count)', 'total_errors')},
               {_pct('sum(error_count)', 'sum(usage_count)', 2)} as error_rate_pct
        from feature_usage group by is_beta_feature""",
    "eng_feature_by_churn": f"""
        select feature_name, is_churned_account, {_big('count(distinct account_id)', 'distinct_accounts')},
               {_big('sum(usage_count)', 'total_usage_count')},
               {_ratio('sum(usage_count)', 'count(*)', 2)} as avg_usage_count_per_event,
               {_ratio('sum(usage_count)', 'count(distinct account_id)', 2)} as usage_per_account
        from usage_split group by feature_name, is_churned_account""",
    "eng_summary_by_churn": f"""
        select is_churned_account, {_big('accounts', 'accounts')}, {_big('events', 'usage_events')},
               {_ratio('events', 'accounts', 1)} as usage_events_per_account,
               {_ratio('uses', 'accounts', 1)} as usage_count_per_account,
               {_ratio('errors', 'accounts', 2)} as errors_per_account from split_totals""",
    "eng_reconcile": f"""
        select {_big('count(distinct feature_name)', 'distinct_features')},
               {_N} as total_usage_events_after_join from account_usage""",
    "eng_top_n": f"""
        select feature_name, {_big('uses', 'total_usage_count')},
               cast(100 * (max(uses) over () - min(uses) over ()) as double) / nullif(max(uses) over (), 0)
                   as spread_pct
        from (select * from feature_totals order by uses desc, feature_name limit 15)""",
    "eng_churn_gap": f"""
        with sides as (select {_ratio('uses', 'accounts', 1)} as per, is_churned_account as gone
                       from split_totals)
        select c as churned_usage_per_account, k as non_churned_usage_per_account,
               100 * abs(c - k) / nullif(k, 0) as diff_pct
        from (select (select per from sides where gone) as c, (select per from sides where not gone) as k)""",
    "churn_monthly": f"""
        select month_label, month_start, {_big('count(churn_event_id)', 'churn_events')},
               {_big('count(distinct account_id)', 'unique_churned_accounts')}
        from spine left join churn_events on churn_date between month_start and month_end
        where month_start <= (select max(churn_date) from churn_events)
        group by month_label, month_start""",
    "churn_by_reason": f"""
        select reason_code, {_N} as churn_events, {_big('count(distinct account_id)', 'unique_accounts')},
               {_pct('count(*)', '(select count(*) from churn_events)')} as pct_of_all_churn_events,
               {_rank('reason_rank')}
        from churn_events group by reason_code""",
    "churn_by_plan": f"""
        with on_plan as (select plan_tier, count(*) as n from accounts group by plan_tier)
        select plan_tier, {_N} as churn_events, {_big('count(distinct account_id)', 'unique_churned_accounts')},
               {_big('any_value(n)', 'accounts_on_this_plan')},
               {_pct('count(distinct account_id)', 'any_value(n)')} as pct_of_plan_accounts_with_churn_event
        from churn_events join accounts using (account_id) join on_plan using (plan_tier)
        group by plan_tier""",
    "churn_time_to_first": f"""
        select account_id, signup_date, first_date as first_churn_date, {_big('days', 'days_to_first_churn')}
        from waits""",
    "churn_time_to_first_summary": f"""
        select {_big('min(days)', 'min_days')}, {_ratio('sum(days)', 'count(*)', 1)} as avg_days,
               cast(quantile_cont(days, 0.5) as double) as median_days, {_big('max(days)', 'max_days')}
        from waits""",
    "churn_repeat_histogram": f"""
        select n as events_per_account, {_N} as accounts from per_churner group by n""",
    "churn_repeat_summary": f"""
        select {_N} as total_churn_events,
               {_big('count(*) filter (is_reactivation)', 'reactivation_events')},
               {_pct('count(*) filter (is_reactivation)', 'count(*)')} as pct_reactivation_events,
               {_big('count(distinct account_id)', 'unique_churned_accounts')},
               {_big('(select count(*) from per_churner where n > 1)', 'repeat_churn_accounts')}
        from churn_events""",
    "churn_refund_by_reason": f"""
        select reason_code, {_N} as churn_events, {_money('sum(refund_amount_usd)', 'total_refund_usd')},
               {_ratio('sum(refund_amount_usd) * 100', 'count(*) * 100', 2)} as avg_refund_usd
        from churn_events group by reason_code""",
    "churn_refund_total": f"""
        select {_money('sum(refund_amount_usd)', 'total_refund_usd_all_events')},
               {_ratio('sum(refund_amount_usd) * 100', 'count(*) * 100', 2)} as avg_refund_usd_per_event
        from churn_events""",
    "churn_preceding_flags": f"""
        select preceding_upgrade_flag, preceding_downgrade_flag, {_N} as churn_events,
               {_pct('count(*)', '(select count(*) from churn_events)')} as pct_of_churn_events
        from churn_events group by preceding_upgrade_flag, preceding_downgrade_flag""",
    "churn_reconcile": f"""
        select {_N} as total_churn_events, {_big('count(distinct account_id)', 'unique_churned_accounts')},
               {_big('(select sum(n) from (select count(*) as n from churn_events group by reason_code))',
                     'total_via_reason_code_sum')}
        from churn_events""",
    "sup_volume_by_churn": f"""
        select is_churned_account, {_big('count(distinct account_id)', 'accounts')}, {_N} as tickets,
               {_ratio('count(*)', 'count(distinct account_id)', 2)} as tickets_per_account,
               {_AVG_HOURS} as avg_resolution_time_hours, {_AVG_MINUTES} as avg_first_response_minutes,
               {_big('count(*) filter (escalation_flag)', 'escalated_tickets')},
               {_pct('count(*) filter (escalation_flag)', 'count(*)')} as escalation_rate_pct
        from ticket_split group by is_churned_account""",
    "sup_priority_mix": f"""
        select is_churned_account,
               {_big("sum(case priority when 'low' then 1 else 0 end)", 'low_priority_tickets')},
               {_big("sum(case priority when 'medium' then 1 else 0 end)", 'medium_priority_tickets')},
               {_big("sum(case priority when 'high' then 1 else 0 end)", 'high_priority_tickets')},
               {_big("sum(case priority when 'urgent' then 1 else 0 end)", 'urgent_priority_tickets')},
               {_N} as total_tickets,
               {_pct("sum(case when priority = 'high' or priority = 'urgent' then 1 else 0 end)", 'count(*)')}
                   as pct_high_or_urgent
        from ticket_split group by is_churned_account""",
    "sup_resolution_by_priority": f"""
        select priority, is_churned_account, {_N} as tickets, {_AVG_HOURS} as avg_resolution_time_hours,
               {_AVG_MINUTES} as avg_first_response_minutes
        from ticket_split group by priority, is_churned_account""",
    "sup_satisfaction": f"""
        select is_churned_account, {_N} as total_tickets, {_big('count(satisfaction_score)', 'tickets_with_score')},
               {_big(_SCORE, 'tickets_missing_score')}, {_pct(_SCORE, 'count(*)')} as pct_missing_score,
               {_ratio('sum(satisfaction_score) * 10', 'count(satisfaction_score) * 10', 2)}
                   as avg_observed_score_biased_sample
        from ticket_split group by is_churned_account""",
    "sup_reconcile": f"""
        select {_N} as total_tickets_actual,
               {_big('(select sum(n) from (select count(*) as n from ticket_split group by is_churned_account))',
                     'total_via_split')},
               {_big('count(distinct account_id)', 'distinct_accounts_with_tickets')}
        from support_tickets""",
    "business_summary": _union([_summary_row(key) for key in _SUMMARY_TEXTS]),
    "summary_reconcile": f"""
        select (select count(*) from accounts) = e.accounts as accounts_check,
               (select count(*) from churn_events) = e.churn_events as churn_events_check,
               (select count(*) from churned) = e.churned_accounts as unique_churned_accounts_check
        from expected e""",
    "overview_headline": f"""
        select {_big('(select sum(n) from new_per_month)', 'total_accounts')},
               {_big('(select count(*) from churn_events)', 'total_churn_events')},
               {_big('(select count(*) from churned)', 'unique_churned_accounts')},
               (select {_pct('count(*) filter (converted)', 'count(*)')} from trials)
                   as subscription_level_conversion_rate_pct,
               month_label as latest_month, {_money('mrr', 'latest_month_mrr')},
               {_big('records', 'latest_month_records')},
               (select {_pct('active', 'eligible')} from curve where m = 0) as retention_month_0,
               (select {_pct('active', 'eligible')} from curve where m = 6) as retention_month_6
        from (select * from month_totals order by month_start desc limit 1)""",
}


def _needed(sql: str, relations: dict[str, str]) -> set[str]:
    found: set[str] = set()
    todo = [sql]
    while todo:
        words = set(re.findall(r"\b[a-z_]+\b", todo.pop()))
        new = (words & relations.keys()) - found
        found |= new
        todo += [relations[name] for name in new]
    return found


def with_relations(sql: str, relations: dict[str, str]) -> str:
    """``sql`` behind the definitions, in order, of the relations it names."""
    needed = _needed(sql, relations)
    ctes = [f"{name} as ({text})" for name, text in relations.items() if name in needed]
    return f"with {', '.join(ctes)} select * from ({sql})" if ctes else sql


def statement(name: str, from_orders: bool = True) -> str:
    """The statement of an operator, over the order tables or over lifecycle tables."""
    return with_relations(STATEMENTS[name], {**MAPPING, **DERIVED} if from_orders else {**NOTHING_EXPECTED, **DERIVED})
