"""Payments, transfers and balances as jobs over request tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import constants as C
from faultline.functions.alertfields import reference_number
from faultline.functions.labels import matches
from faultline.functions.text import chain, is_blank
from faultline.operators import overdraft
from faultline.operators.segments import running_total, time_segment
from faultline.session import stage

MONEY = "decimal(38,2)"
# Time span of one segment of an account's running balance.
SEGMENT_SECONDS = 30 * 86400.0


def screen_payments(requests: DataFrame, repeatable: bool = True) -> DataFrame:
    """Outcome of every payment request; `stored` is false for requests with no positive amount."""
    amount = F.col("amount")
    wrong = amount.isNull() | (amount <= 0)
    blocked = amount > C.PAYMENT_LIMIT
    key = F.col("request_id") if repeatable else None
    return requests.select(
        "*",
        (~wrong).alias("stored"),
        F.when(~wrong, reference_number("PAY", 10, key)).alias("payment_reference"),
        chain([(wrong, F.lit("REJECTED")), (blocked, F.lit("BLOCKED"))], F.lit("SUCCESS")).alias("status"),
        chain(
            [(wrong, F.lit(C.PAYMENT_REJECTED)), (blocked, F.lit(C.PAYMENT_BLOCKED))], F.lit(C.PAYMENT_DONE)
        ).alias("reason"),
    )


def blocked_payment_logs(payments: DataFrame) -> DataFrame:
    """Raw log lines of blocked payments, in the format the log parser reads."""
    line = F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
        F.lit(" ERROR service=payment-service traceId="), "payment_reference",
        F.lit(" status=400 failure=PAYMENT_BLOCKED java.lang.IllegalStateException: "), "reason",
    )
    return payments.filter(F.col("status") == "BLOCKED").select("request_id", "ts", line.alias("raw_log"))


def validate_transfers(requests: DataFrame) -> DataFrame:
    """Add `reject_reason`, null for a valid transfer; checks in fixed order."""
    source, target, amount = F.col("source_account"), F.col("destination_account"), F.col("amount")
    reason = chain(
        [
            (amount.isNull() | (amount <= 0), F.lit(C.TRANSFER_AMOUNT)),
            (source.isNull() | target.isNull(), F.lit(C.TRANSFER_ACCOUNTS)),
            (source == target, F.lit(C.TRANSFER_SAME)),
        ],
        F.lit(None).cast("string"),
    )
    return requests.withColumn("reject_reason", reason)


def open_accounts(requests: DataFrame, key: str | None = None) -> DataFrame:
    """New ACTIVE accounts for requests with a password; the password itself is not carried."""
    valid = requests.filter(~is_blank(F.col("password")))
    return valid.withColumns(
        {
            "account_number": reference_number("ACC", 8, F.col(key) if key else None),
            "balance": F.coalesce(F.col("balance").cast(MONEY), F.lit(0).cast(MONEY)),
            "status": F.lit("ACTIVE"),
        }
    ).drop("password")


def balance_lookup(accounts: DataFrame, numbers: DataFrame) -> DataFrame:
    asked = numbers.select("account_number").distinct()
    return accounts.join(asked, "account_number", "left_semi").select("account_number", "balance", "status")


def ledger_for_account(ledger: DataFrame, account: str) -> DataFrame:
    return ledger.filter((F.col("source_account") == account) | (F.col("destination_account") == account))


def running_balance(updates: DataFrame, segment: Column) -> DataFrame:
    """Cumulative balance per account with no rejection."""
    return running_total(updates, ["account_number"], ["ts", "seq"], segment, F.col("amount"), "running_balance")


# --- balance updates with rejection -----------------------------------------------------------------------

def fold_balances(updates: DataFrame, blocks: int | None = None, segment_seconds: float = SEGMENT_SECONDS) -> DataFrame:
    """Which updates apply when each account takes them in order and never goes below zero, and the balance after each.

    Updates are (update_id, account_number, ts, seq, cents, opening). Debits are decided from bounds of the balance, block by
    block at once (`overdraft`); the balances are a running total of what applies.
    """
    col = F.col
    credit = col("cents") >= 0
    decided, _ = overdraft.decide_debits(
        updates.select(
            col("update_id").alias("paid_by"), (~credit).alias("debit"), "account_number", "ts", "seq",
            F.abs("cents").alias("cents"), "opening", F.when(credit, F.lit(True)).alias("open"),
        ), blocks,
    )
    told = updates.join(decided.withColumnRenamed("paid_by", "update_id"), "update_id", "left")
    told = told.withColumn("applied", credit | F.coalesce("open", F.lit(False)))
    moved = F.when(col("applied"), col("cents")).otherwise(F.lit(0).cast("bigint"))
    order, segment = ["ts", "seq", "update_id"], time_segment("ts", segment_seconds)
    total = running_total(told, ["account_number"], order, segment, moved, "_moved")
    return total.select("update_id", "account_number", "applied", (col("opening") + col("_moved")).alias("cents_after"))


def _cents(amount: Column) -> Column:
    return (amount * 100).cast("bigint")


def apply_balance_updates(accounts: DataFrame, updates: DataFrame, blocks: int | None = None) -> DataFrame:
    """Outcome of every update: applied with the new balance, or rejected with a message; a null amount is rejected."""
    col = F.col
    own = accounts.select("account_number", "balance", col("status").alias("account_status"))
    known = updates.join(own, "account_number", "left")
    active = known.filter((col("account_status") == "ACTIVE") & col("amount").isNotNull()).select(
        "update_id", "account_number", "ts", "seq",
        _cents(col("amount")).alias("cents"), _cents(col("balance")).alias("opening"),
    )
    folded = fold_balances(active, blocks).select("update_id", "applied", "cents_after")
    joined = known.join(folded, "update_id", "left")
    message = chain(
        [
            (col("account_status").isNull(), F.lit(C.ACCOUNT_MISSING)),
            (col("account_status") != "ACTIVE", F.lit(C.ACCOUNT_INACTIVE)),
            (col("amount").isNull(), F.lit(C.TRANSFER_AMOUNT)),
            (~col("applied"), F.lit(C.ACCOUNT_OVERDRAWN)),
        ],
        F.lit(C.ACCOUNT_UPDATED),
    )
    after = F.coalesce((col("cents_after").cast(MONEY) / 100).cast(MONEY), col("balance"))
    return joined.select(
        "update_id", "account_number", "ts", "seq", "amount",
        F.coalesce("applied", F.lit(False)).alias("applied"), message.alias("message"),
        after.alias("balance_after"),
    )


def final_balances(accounts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Accounts after the applied updates; the outcome table is summed before the join."""
    moved = outcomes.filter("applied").groupBy("account_number").agg(F.sum("amount").alias("_moved"))
    joined = accounts.join(moved, "account_number", "left")
    return joined.withColumn(
        "balance", (F.col("balance") + F.coalesce("_moved", F.lit(0))).cast(MONEY)
    ).drop("_moved")


# --- transfers --------------------------------------------------------------------------------------------

def _sides(accounts: DataFrame, transfers: DataFrame) -> DataFrame:
    """Transfers with the status and opening cents of both accounts."""
    def own(prefix: str) -> DataFrame:
        return accounts.select(
            F.col("account_number").alias(f"{prefix}_account"), F.col("status").alias(f"{prefix}_status"),
            _cents(F.col("balance")).alias(f"{prefix}_opening"),
        )

    return transfers.join(own("source"), "source_account", "left").join(own("destination"), "destination_account", "left")


def transfer_legs(sides: DataFrame) -> DataFrame:
    """The rows that can move money, the debit of a transfer before its credit."""
    col = F.col

    def leg(side: str, place: int) -> Column:
        return F.struct(
            F.lit(place == 0).alias("debit"), col(f"{side}_account").alias("account_number"), F.lit(place).alias("place"),
            col(f"{side}_opening").alias("opening"), col(f"{side}_status").alias("status"),
        )

    able = sides.filter(col("source_status") == "ACTIVE")
    legs = able.select("request_id", "ts", "amount", F.explode(F.array(leg("source", 0), leg("destination", 1))).alias("l"))
    return legs.filter(col("l.status") == "ACTIVE").select(
        col("request_id").alias("paid_by"), "l.debit", "l.account_number", "ts",
        (col("request_id") * 2 + col("l.place")).alias("seq"), _cents(col("amount")).alias("cents"), "l.opening",
        F.lit(None).cast("boolean").alias("open"),
    )


def settle_transfers(accounts: DataFrame, transfers: DataFrame, blocks: int | None = None, **limits) -> DataFrame:
    """Outcome of both legs of every valid transfer in time order, exactly as one-by-one processing gives.

    A credit arrives only if its debit applied, and may pay for later debits of its account; a credit whose debit was
    refused is not listed. `overdraft.decide_debits` finds which debits apply and states how many rounds that takes.
    """
    col = F.col
    valid = validate_transfers(transfers).filter(col("reject_reason").isNull())
    sides = stage(_sides(accounts, valid), "sides")
    decided, _ = overdraft.decide_debits(transfer_legs(sides), blocks, **limits)
    told = sides.join(decided.withColumnRenamed("paid_by", "request_id"), "request_id", "left")
    paid = F.coalesce("open", F.lit(False))

    def leg(name: str, side: str, place: int, applied: Column) -> Column:
        message = chain(
            [
                (col(f"{side}_status").isNull(), F.lit(C.ACCOUNT_MISSING)),
                (col(f"{side}_status") != "ACTIVE", F.lit(C.ACCOUNT_INACTIVE)),
                (~applied, F.lit(C.ACCOUNT_OVERDRAWN)),
            ],
            F.lit(C.ACCOUNT_UPDATED),
        )
        return F.struct(
            (col("request_id") * 2 + place).alias("update_id"), F.lit(name).alias("leg"),
            col(f"{side}_account").alias("account_number"), applied.alias("applied"), message.alias("message"),
        )

    debit = leg("debit", "source", 0, paid)
    credit = leg("credit", "destination", 1, F.coalesce(col("destination_status") == "ACTIVE", F.lit(False)))
    both = F.when(paid, F.array(debit, credit)).otherwise(F.array(debit))
    return stage(told.select("request_id", F.explode(both).alias("l")).select("request_id", "l.*"), "settled")


def transfer_legs_join(settled: DataFrame) -> DataFrame:
    """One row per transfer with the outcome of its debit and its credit; an untried credit is null.

    The legs of a transfer lie beside each other, so an aggregate folds them before they are shuffled."""
    col = F.col
    values = [
        F.max(F.when(col("leg") == leg, col(name))).alias(f"{leg}_{name}") for leg in ("debit", "credit") for name in ("applied", "message")
    ]
    return settled.groupBy("request_id").agg(*values).where(col("debit_applied").isNotNull())


def build_ledger(transfers: DataFrame, settled: DataFrame, repeatable: bool = True) -> DataFrame:
    """One ledger row per valid transfer: SUCCESS, or FAILED with the message of the failing leg."""
    col = F.col
    legs = transfer_legs_join(settled)
    rows = transfers.join(legs, "request_id")
    ok = col("debit_applied") & F.coalesce("credit_applied", F.lit(False))
    why = F.when(~col("debit_applied"), col("debit_message")).otherwise(col("credit_message"))
    key = col("request_id") if repeatable else None
    return rows.select(
        "request_id",
        reference_number("TXN", 10, key).alias("transaction_reference"),
        "source_account", "destination_account", "amount",
        F.when(ok, "SUCCESS").otherwise("FAILED").alias("status"),
        F.when(ok, col("description")).otherwise(F.concat(F.lit(C.TRANSFER_FAILED), why)).alias("description"),
        col("ts").alias("transaction_time"),
    )


def partial_transfers(settled: DataFrame) -> DataFrame:
    """Transfers whose debit stands although the credit failed."""
    legs = transfer_legs_join(settled)
    return legs.filter(F.col("debit_applied") & ~F.coalesce("credit_applied", F.lit(False)))


def route_requests(requests: DataFrame, column: str = "uri") -> DataFrame:
    """Service that serves each request path; unrouted paths give null."""
    cases = [(matches(F.col(column), prefix + ".*"), F.lit(service)) for prefix, service in C.ROUTES]
    return requests.withColumn("service", chain(cases, F.lit(None).cast("string")))
