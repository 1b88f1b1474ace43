"""Queries over payments, transfers and accounts."""

from pyspark.sql import functions as F

from faultline import constants as C
from faultline.operators import ledger
from faultline.operators.segments import time_segment
from faultline.plans import adapters as A
from faultline.plans.registry import MAPPINGS, query

MONTH = 30 * 86400.0


def accounts(spark, folder):
    return A.mapped(spark, folder, A.ACCOUNTS)


def transfers(spark, folder):
    return A.mapped(spark, folder, A.TRANSFERS)


def _money(df, *names):
    """Amounts as doubles, which both engines print alike."""
    return df.withColumns({name: F.col(name).cast("double") for name in names})


def _reference(prefix, length, key):
    return f"'{prefix}' || upper(substr(substr(md5(cast({key} as string)), 1, 8) || '-' || substr(md5(cast({key} as string)), 9, 4), 1, {length}))"


MAPPINGS["screened"] = f"""
select request_id, account_number, merchant_name, cast(amount as double) as amount, ts, not (amount is null or amount <= 0) as stored,
       case when amount > 0 then {_reference('PAY', 10, 'request_id')} end as payment_reference,
       case when amount is null or amount <= 0 then 'REJECTED' when amount > 5000 then 'BLOCKED' else 'SUCCESS' end as status,
       case when amount is null or amount <= 0 then '{C.PAYMENT_REJECTED}' when amount > 5000 then '{C.PAYMENT_BLOCKED}' else '{C.PAYMENT_DONE}' end as reason
from {{payments}}
"""


@query("select * from {screened}")
def screen_payments(spark, folder):
    return _money(ledger.screen_payments(A.mapped(spark, folder, A.PAYMENTS)), "amount")


@query("""
select request_id, ts, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ERROR service=payment-service traceId=' || payment_reference
  || ' status=400 failure=PAYMENT_BLOCKED java.lang.IllegalStateException: ' || reason as raw_log
from {screened} where status = 'BLOCKED'
""")
def blocked_payment_logs(spark, folder):
    return ledger.blocked_payment_logs(ledger.screen_payments(A.mapped(spark, folder, A.PAYMENTS)))


MAPPINGS["checked_transfers"] = f"""
select *, case when amount is null or amount <= 0 then '{C.TRANSFER_AMOUNT}'
               when source_account is null or destination_account is null then '{C.TRANSFER_ACCOUNTS}'
               when source_account = destination_account then '{C.TRANSFER_SAME}' end as reject_reason
from {{transfers}}
"""


@query("select request_id, reject_reason from {checked_transfers}")
def validate_transfers(spark, folder):
    return ledger.validate_transfers(transfers(spark, folder)).select("request_id", "reject_reason")


@query(f"""
select request_id, username, cast(coalesce(balance, 0) as double) as balance, 'ACTIVE' as status, {_reference('ACC', 8, 'request_id')} as account_number
from {{account_requests}} where trim(coalesce(password, '')) <> ''
""")
def open_accounts(spark, folder):
    return _money(ledger.open_accounts(A.mapped(spark, folder, A.ACCOUNT_REQUESTS), "request_id"), "balance")


@query("""
select account_number, cast(balance as double) as balance, status from {accounts}
where account_number in (select source_account from {transfers})
""")
def balance_lookup(spark, folder):
    asked = transfers(spark, folder).select(F.col("source_account").alias("account_number"))
    return _money(ledger.balance_lookup(accounts(spark, folder), asked), "balance")


@query("""
select request_id, cast(amount as double) as amount from {transfers}
where source_account = 'ACC00000007' or destination_account = 'ACC00000007'
""")
def ledger_for_account(spark, folder):
    rows = ledger.ledger_for_account(transfers(spark, folder), "ACC00000007")
    return _money(rows.select("request_id", "amount"), "amount")


@query("""
select update_id, cast(sum(amount) over (partition by account_number order by ts, seq rows unbounded preceding) as double) as running_balance
from {balance_updates}
""")
def running_balance(spark, folder):
    rows = ledger.running_balance(A.mapped(spark, folder, A.BALANCE_UPDATES), time_segment("ts", MONTH))
    return _money(rows.select("update_id", "running_balance"), "running_balance")


MAPPINGS["steps"] = """
select *, row_number() over (partition by account_number order by ts, seq) as step from {balance_updates}
"""
MAPPINGS["folded_balances"] = """
with recursive walk as (
  select account_number, balance, 0::bigint as step, null::bigint as update_id, false as applied from {accounts} where status = 'ACTIVE'
  union all
  select w.account_number, case when w.balance + s.amount >= 0 then cast(w.balance + s.amount as decimal(38,2)) else w.balance end,
         s.step, s.update_id, w.balance + s.amount >= 0
  from walk w join {steps} s on s.account_number = w.account_number and s.step = w.step + 1)
select * from walk
"""


@query("""
select u.update_id, u.account_number, coalesce(w.applied, false) as applied,
       case when a.account_number is null then 'Account not found' when a.status <> 'ACTIVE' then 'Account is not active'
            when not w.applied then 'Insufficient balance' else 'Balance updated successfully' end as message,
       cast(coalesce(w.balance, a.balance) as double) as balance_after
from {balance_updates} u left join {accounts} a on a.account_number = u.account_number
left join {folded_balances} w on w.update_id = u.update_id
""")
def apply_balance_updates(spark, folder):
    rows = ledger.apply_balance_updates(accounts(spark, folder), A.mapped(spark, folder, A.BALANCE_UPDATES))
    return _money(rows.select("update_id", "account_number", "applied", "message", "balance_after"), "balance_after")


@query("""
select a.account_number, a.username, a.full_name, a.status,
       cast(coalesce((select w.balance from {folded_balances} w where w.account_number = a.account_number order by w.step desc limit 1), a.balance) as double) as balance
from {accounts} a
""")
def final_balances(spark, folder):
    outcomes = ledger.apply_balance_updates(accounts(spark, folder), A.mapped(spark, folder, A.BALANCE_UPDATES))
    return _money(ledger.final_balances(accounts(spark, folder), outcomes), "balance")


MAPPINGS["transfer_steps"] = """
select request_id, source_account, destination_account, amount, row_number() over (order by ts, request_id) as step
from {checked_transfers} where reject_reason is null
"""
# one transfer per round: rows are account balances and transfer outcomes, keyed by name
MAPPINGS["replayed"] = """
with recursive world(name, amount, note, step) using key (name) as (
  select account_number, balance, status, 0::bigint from {accounts}
  union
  (with current as (select max(step) + 1 as step from world),
        due as (select t.* from {transfer_steps} t join current c on c.step = t.step),
        seen as (select t.*, s.amount as source_balance, s.note as source_status, d.amount as target_balance, d.note as target_status
                 from due t left join recurring.world s on s.name = t.source_account left join recurring.world d on d.name = t.destination_account),
        judged as (select *, case when source_status is null then 'Account not found' when source_status <> 'ACTIVE' then 'Account is not active'
                                  when source_balance < amount then 'Insufficient balance' else 'ok' end as debit,
                          case when target_status is null then 'Account not found' when target_status <> 'ACTIVE' then 'Account is not active' else 'ok' end as credit
                   from seen)
   select source_account, cast(source_balance - amount as decimal(38,2)), source_status, step from judged where debit = 'ok'
   union all
   select destination_account, cast(target_balance + amount as decimal(38,2)), target_status, step from judged where debit = 'ok' and credit = 'ok'
   union all
   select 'T' || cast(request_id as string), amount, case when debit <> 'ok' then 'debit: ' || debit when credit <> 'ok' then 'credit: ' || credit else 'ok' end, step from judged))
select * from world
"""
MAPPINGS["outcomes"] = """
select t.*, r.note from {transfers} t join {replayed} r on r.name = 'T' || cast(t.request_id as string)
"""


def settled(spark, folder):
    return ledger.settle_transfers(accounts(spark, folder), transfers(spark, folder))


@query("""
select request_id, not starts_with(note, 'debit') as debit_applied, case when starts_with(note, 'debit') then null else note = 'ok' end as credit_applied from {outcomes}
""")
def transfer_legs_join(spark, folder):
    return ledger.transfer_legs_join(settled(spark, folder)).select("request_id", "debit_applied", "credit_applied")


@query(f"""
select request_id, {_reference('TXN', 10, 'request_id')} as transaction_reference, source_account, destination_account, cast(amount as double) as amount,
       case when note = 'ok' then 'SUCCESS' else 'FAILED' end as status,
       case when note = 'ok' then description else 'Transfer failed: ' || split_part(note, ': ', 2) end as description, ts as transaction_time
from {{outcomes}}
""")
def build_ledger(spark, folder):
    return _money(ledger.build_ledger(transfers(spark, folder), settled(spark, folder)), "amount")


@query("""
select request_id, split_part(note, ': ', 2) as credit_message from {outcomes} where starts_with(note, 'credit')
""")
def partial_transfers(spark, folder):
    return ledger.partial_transfers(settled(spark, folder)).select("request_id", "credit_message")
