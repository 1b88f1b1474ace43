"""Payments, transfers and balances."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from faultline import schemas
from faultline.operators import ledger, overdraft
from faultline.operators.segments import runs, running_total, time_segment, with_previous

START = datetime(2026, 1, 1)


def accounts(spark, *rows):
    return spark.createDataFrame([(a, a, a, Decimal(b), s) for a, b, s in rows], schemas.ACCOUNT)


def test_payments(spark):
    rows = [(1, "a", "m", Decimal("0.00"), START), (2, "a", "m", Decimal("6000.00"), START), (3, "a", "m", Decimal("49.99"), START), (4, "a", "m", None, START)]
    found = {r.request_id: r for r in ledger.screen_payments(spark.createDataFrame(rows, schemas.PAYMENT_REQUEST)).collect()}
    assert [found[i].status for i in (1, 2, 3, 4)] == ["REJECTED", "BLOCKED", "SUCCESS", "REJECTED"]
    assert found[2].reason == "High value payment blocked for risk review" and not found[1].stored
    assert found[3].payment_reference.startswith("PAY") and len(found[3].payment_reference) == 13


def test_transfer_checks(spark):
    rows = [
        (1, None, "b", Decimal("0"), "d", START), (2, None, "b", Decimal("1"), "d", START),
        (3, "b", "b", Decimal("1"), "d", START), (4, "a", "b", Decimal("1"), "d", START),
    ]
    found = ledger.validate_transfers(spark.createDataFrame(rows, schemas.TRANSFER)).orderBy("request_id").collect()
    assert [r.reject_reason for r in found] == [
        "Amount must be greater than zero", "Source and destination account numbers are required",
        "Source and destination account cannot be same", None,
    ]


def test_balance_rules(spark):
    own = accounts(spark, ("B", "10.00", "BLOCKED"), ("A", "10.00", "ACTIVE"))
    rows = [(1, "B", START, 1, Decimal("5")), (2, "A", START, 2, Decimal("-20")), (3, "A", START, 3, Decimal("15.50")), (4, "Z", START, 4, Decimal("1"))]
    feed = spark.createDataFrame(rows, f"update_id bigint, {schemas.BALANCE_UPDATE}")
    outcomes = ledger.apply_balance_updates(own, feed)
    found = {r.update_id: r for r in outcomes.collect()}
    assert [found[i].message for i in (1, 2, 3, 4)] == [
        "Account is not active", "Insufficient balance", "Balance updated successfully", "Account not found",
    ]
    assert found[3].balance_after == Decimal("25.50")
    final = {r.account_number: r.balance for r in ledger.final_balances(own, outcomes).collect()}
    assert final == {"A": Decimal("25.50"), "B": Decimal("10.00")}


@pytest.mark.parametrize("blocks", [1, 3, 9])
def test_a_hot_account_spreads_over_blocks(spark, blocks):
    random.seed(blocks)
    names = ["hot"] * 6 + ["a", "b", "c"]
    rows = [
        (i, random.choice(names), START + timedelta(minutes=random.randint(0, 40)), i, Decimal(random.randint(-900, 700)) / 100)
        for i in range(600)
    ]
    opening = {"hot": 500, "a": 0, "b": 5000, "c": 20}
    expected, state = {}, {k: v for k, v in opening.items()}
    for key, name, ts, seq, amount in sorted(rows, key=lambda r: (r[2], r[3])):
        cents = int(amount * 100)
        ok = state[name] + cents >= 0
        state[name] += cents if ok else 0
        expected[key] = (ok, state[name])
    own = accounts(spark, *[(k, str(Decimal(v) / 100), "ACTIVE") for k, v in opening.items()])
    feed = spark.createDataFrame(rows, f"update_id bigint, {schemas.BALANCE_UPDATE}")
    found = ledger.apply_balance_updates(own, feed, blocks).collect()
    assert {r.update_id: (r.applied, int(r.balance_after * 100)) for r in found} == expected


def test_transfers_replay_exactly(spark):
    random.seed(11)
    names = ["a", "b", "c", "d", "blocked", "missing"]
    rows = [
        (i, random.choice(names), random.choice(names), Decimal(random.randint(1, 3000)) / 100, f"t{i}", START + timedelta(minutes=i // 3))
        for i in range(250)
    ]
    balance = {"a": 5000, "b": 0, "c": 1000, "d": 10, "blocked": 9000}
    own = accounts(spark, *[(k, str(Decimal(v) / 100), "BLOCKED" if k == "blocked" else "ACTIVE") for k, v in balance.items()])

    def move(name, cents):
        if name not in balance:
            return "Account not found"
        if name == "blocked":
            return "Account is not active"
        if balance[name] + cents < 0:
            return "Insufficient balance"
        balance[name] += cents
        return None

    expected = {}
    for key, source, target, amount, text, ts in rows:
        if source == target:
            continue
        cents = int(amount * 100)
        error = move(source, -cents) or move(target, cents)
        expected[key] = ("FAILED", f"Transfer failed: {error}") if error else ("SUCCESS", text)
    transfers = spark.createDataFrame(rows, schemas.TRANSFER)
    settled = ledger.settle_transfers(own, transfers)
    found = ledger.build_ledger(transfers, settled).collect()
    assert {r.request_id: (r.status, r.description) for r in found} == expected
    assert ledger.partial_transfers(settled).count() == sum(
        1 for key, source, target, *_ in rows
        if key in expected and target in ("blocked", "missing") and "Transfer failed" in expected[key][1]
        and source in ("a", "b", "c", "d") and not expected[key][1].endswith("Insufficient balance")
    )


LEG = "paid_by bigint, debit boolean, account_number string, ts timestamp_ntz, seq bigint, cents bigint, opening bigint, open boolean"


def transfer_rows(moves, opening):
    """Debit and credit rows of (source, destination, cents) moves, one a minute."""
    rows = []
    for i, (source, target, cents) in enumerate(moves):
        at = START + timedelta(minutes=i)
        rows += [(i, True, source, at, 2 * i, cents, opening[source], None), (i, False, target, at, 2 * i + 1, cents, opening[target], None)]
    return rows


def replayed(moves, opening):
    balance, found = dict(opening), {}
    for i, (source, target, cents) in enumerate(moves):
        found[i] = balance[source] >= cents
        if found[i]:
            balance[source] -= cents
            balance[target] += cents
    return found


@pytest.mark.parametrize(("blocks", "rounds", "replay"), [(5, 999, 0), (3, 1, 40), (2, 1, 10_000)])
def test_debits_are_decided_as_one_by_one(spark, blocks, rounds, replay):
    random.seed(blocks * 100 + rounds)
    names = ["hot", "hot", "hot", "a", "b", "c", "d"]
    opening = {"hot": 300, "a": 100, "b": 0, "c": 5000, "d": -50}
    moves = []
    while len(moves) < 80:
        source, target = random.choice(names), random.choice(names)
        if source != target:
            moves.append((source, target, random.choice([random.randint(1, 900), 100])))
    decided, turns = overdraft.decide_debits(spark.createDataFrame(transfer_rows(moves, opening), LEG), blocks, rounds, replay)
    assert {r.paid_by: r.open for r in decided.collect()} == replayed(moves, opening) and decided.count() == len(moves)
    assert turns.count("bounds") <= rounds and (not replay or turns.count("replay") <= 2 * len(moves) // replay + 1)


def test_cascades_take_few_rounds_or_bounded_replays(spark):
    # Each account can pay only with what the one before paid it; the first is refused, so all are.
    names = [f"n{i}" for i in range(60)]
    opening = dict.fromkeys(names, 0)
    chain = [(names[i], names[i + 1], 100) for i in range(59)]
    decided, turns = overdraft.decide_debits(spark.createDataFrame(transfer_rows(chain, opening), LEG), 2)
    assert turns == ["bounds", "replay"] and not any(r.open for r in decided.collect())
    decided, turns = overdraft.decide_debits(spark.createDataFrame(transfer_rows(chain, opening), LEG), 2, rounds=2, replay=20)
    assert not any(r.open for r in decided.collect()) and turns[:2] == ["bounds", "bounds"] and len(turns) <= 2 + 2 * 59 // 20 + 1
    # Enough money: bounds alone decide, whatever the order of accounts.
    rich = dict.fromkeys(names, 10_000)
    decided, turns = overdraft.decide_debits(spark.createDataFrame(transfer_rows(chain, rich), LEG), 3, replay=0)
    assert turns == ["bounds"] and all(r.open for r in decided.collect())


def test_debits_without_rows(spark):
    decided, turns = overdraft.decide_debits(spark.createDataFrame([], LEG))
    assert decided.count() == 0 and turns == []


def test_null_amounts_are_rejected(spark):
    own = accounts(spark, ("A", "10.00", "ACTIVE"))
    rows = [(1, "A", START, 1, None), (2, "A", START, 2, Decimal("-3"))]
    feed = spark.createDataFrame(rows, f"update_id bigint, {schemas.BALANCE_UPDATE}")
    found = {r.update_id: r for r in ledger.apply_balance_updates(own, feed).collect()}
    assert not found[1].applied and found[1].message == "Amount must be greater than zero"
    assert found[2].applied and found[2].balance_after == Decimal("7.00")


def test_open_accounts(spark):
    rows = [("u1", "secret", None), ("u2", " ", Decimal("5"))]
    found = ledger.open_accounts(spark.createDataFrame(rows, "username string, password string, balance decimal(38,2)")).collect()
    assert len(found) == 1 and "password" not in found[0].asDict()
    assert (found[0].balance, found[0].status) == (0, "ACTIVE") and found[0].account_number.startswith("ACC")


@pytest.mark.parametrize("seconds", [60.0, 600.0, 1e9])
def test_segments_equal_plain_windows(spark, seconds):
    random.seed(2)
    rows = [("k" if i % 3 else "other", START + timedelta(seconds=37 * i), i, random.randint(0, 1)) for i in range(200)]
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, seq bigint, state bigint")
    cut = time_segment("ts", seconds)
    order = ["ts", "seq"]
    by_key = {}
    for key, _, seq, state in rows:
        by_key.setdefault(key, []).append((seq, state))
    previous = {r.seq: r.prev_state for r in with_previous(df, ["key"], order, cut, ["state"]).collect()}
    totals = {r.seq: r.total for r in running_total(df, ["key"], order, cut, df.state, "total").collect()}
    stretches = {r.seq: r.run for r in runs(df, ["key"], order, cut, "state").collect()}
    for found in by_key.values():
        total, run, before = 0, 0, None
        for seq, state in found:
            assert previous[seq] == before
            total += state
            run += before != state
            assert (totals[seq], stretches[seq]) == (total, run)
            before = state


def test_legs_of_a_transfer_are_folded_without_a_join(spark):
    rows = [(1, "debit", True, "ok"), (1, "credit", False, "no"), (2, "debit", False, "poor"), (3, "debit", True, "ok"), (3, "credit", True, "ok")]
    legs = ledger.transfer_legs_join(spark.createDataFrame(rows, "request_id long, leg string, applied boolean, message string"))
    assert "Join" not in legs._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in legs.collect()} == {
        (1, True, "ok", False, "no"), (2, False, "poor", None, None), (3, True, "ok", True, "ok")}


def test_a_round_names_the_accounts_that_keep_an_open_debit(spark):
    # a covers its debit; whether b does depends on a's refused or paid credit to it, c has no rows that wait.
    moves, opening = [("c", "a", 5), ("a", "b", 50), ("b", "c", 30)], {"a": 47, "b": 0, "c": 9}
    rows = spark.createDataFrame(transfer_rows(moves, opening), LEG)
    walked = overdraft._round(rows, 2).collect()
    assert {r.waiting for r in walked if r.waiting} == {"a", "b"}
    assert {r.paid_by: r.open for r in walked if r.paid_by is not None} == {0: True}
