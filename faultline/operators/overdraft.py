"""Which debits apply when accounts take their rows in order and never go below zero.

A row is a credit or a debit of an account. A debit applies if the balance covers it; a credit arrives if the debit that pays
for it applied. What is not known yet is enclosed: each account carries the least and the most its balance can be. Certain
credits raise both bounds, possible ones only the upper; a debit below the lower bound applies, one above the upper
does not, and any other widens the gap. Rounds hand each decision to the credits that wait for it and go on with the accounts that
still have an open debit.

Rows are range-partitioned by account and time, so an account of any size spreads over many blocks. The bounds at the start of a
block come from sums of the blocks before it: a row adds to the lower bound or lifts it to a floor, adds to the upper or
lowers it to a ceiling, and such steps add up to one step of the same kind. At most one account crosses a block's border, so these sums
are two rows per block, and all blocks are walked at once.

The earliest open debit has all that lies before it decided, so each round decides something; long chains of refusals that wait
for each other would still take a round for each link. So after `ROUNDS` rounds, or as soon as no more than `REPLAY` rows are left
on accounts with open debits, the earliest `REPLAY` of these rows are replayed one by one in a task, and the rest goes on
from the balances found. With n rows left after the rounds at most n / REPLAY replays follow: that is the worst case.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.session import stage

#: Rows per block: as many blocks as there are cores, within these sizes.
BLOCK_MIN, BLOCK_MAX = 50_000, 1_000_000
#: Rounds of bounds before replays; rows replayed by one task.
ROUNDS, REPLAY = 4, 500_000
TIME = ["ts", "seq", "paid_by"]
ORDER = ["account_number", *TIME]
#: One row: `paid_by` is the debit itself, or the debit that a credit waits for; `open` is what is known of it; cents are positive.
ROWS = ["paid_by", "debit", "account_number", "ts", "seq", "cents", "opening", "open"]
DECIDED = "paid_by long, open boolean"
WALKED = f"{DECIDED}, waiting string"
_NAMES = ("paid_by", "debit", "account_number", "cents", "opening", "open")


def blocks_for(spark: SparkSession, rows: int) -> int:
    most = max(2 * spark.sparkContext.defaultParallelism, -(-rows // BLOCK_MAX))
    return max(1, min(-(-rows // BLOCK_MIN), most))


def _columns(batch: pa.RecordBatch, names: tuple[str, ...] = _NAMES):
    return zip(*(batch.column(batch.schema.names.index(n)).to_pylist() for n in names), strict=True)


def _decisions(found: list[tuple[int, bool]], waiting: list[str]) -> pa.RecordBatch:
    none = [None] * len(waiting)
    return pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in found] + none, pa.int64()), pa.array([o for _, o in found] + none, pa.bool_()),
         pa.array([None] * len(found) + waiting, pa.string())], ["paid_by", "open", "waiting"])


def _walk(start: dict[tuple[str, int], tuple[int, int]]):
    """Decide debits of blocks whose rows are in order; `start` has the bounds of accounts that began in an earlier block.

    Accounts that keep an open debit are named once per block in `waiting`."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, told, low, high, floor = None, None, 0, 0, 0
        for batch in batches:
            found, waiting = [], []
            for key, debit, account, cents, opening, known, block in _columns(batch, (*_NAMES, "block")):
                if (account, block) != current:
                    current, floor = (account, block), min(0, opening)
                    low, high = start.get(current, (opening, opening))
                if not debit:
                    high += cents
                    low += cents if known else 0
                elif known is False:
                    high = min(high, cents - 1)
                elif known or low >= cents:
                    low, high = max(low - cents, 0), high - cents
                    if not known:
                        found.append((key, True))
                elif high < cents:
                    found.append((key, False))
                else:
                    low, high = max(low - cents, floor), max(high - cents, min(high, cents - 1))
                    if told != current:
                        told = current
                        waiting.append(account)
            yield _decisions(found, waiting)

    return walk


SUMS = "account_number string, block int, opening long, low long, floor long, high long, ceiling long"


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each account of each block the step its rows make together: low + low' or the floor, high + high' or the ceiling."""
    out, names = {}, ("account_number", "block", "opening", "low", "floor", "high", "ceiling")
    for batch in batches:
        for _, debit, account, cents, opening, known, block in _columns(batch, (*_NAMES, "block")):
            opening, low, floor, high, ceiling = out.get((account, block)) or (opening, 0, None, 0, None)
            up = 0 if debit and not known else -cents if debit else cents
            down = -cents if debit and known is not False else cents if known and not debit else 0
            low, high = low + down, high + up
            floor = floor if floor is None else floor + down
            ceiling = ceiling if ceiling is None else ceiling + up
            if debit and known is None:
                least = min(0, opening)
                floor = least if floor is None else max(floor, least)
            elif debit and known is False:
                ceiling = cents - 1 if ceiling is None else min(ceiling, cents - 1)
            out[account, block] = (opening, low, floor, high, ceiling)
    types = [pa.string(), pa.int32()] + [pa.int64()] * 5
    rows = [[*key, *value] for key, value in out.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=list(names))


def _starts(placed: DataFrame, ordered: DataFrame) -> dict[tuple[str, int], tuple[int, int]]:
    """Bounds at the start of each block, of the account that crosses into it; at most two rows per block are collected."""
    spans = placed.groupBy("block").agg(F.min("account_number").alias("first"), F.max("account_number").alias("last")).collect()
    seen: dict[str, int] = {}
    for r in spans:
        for name in {r["first"], r["last"]}:
            seen[name] = seen.get(name, 0) + 1
    crossing = [(name,) for name, n in sorted(seen.items()) if n > 1]
    if not crossing:
        return {}
    names = F.broadcast(placed.sparkSession.createDataFrame(crossing, "account_number string"))
    sums = ordered.join(names, "account_number", "left_semi").mapInArrow(_sums, SUMS).collect()
    starts, at = {}, {}
    for r in sorted(sums, key=lambda r: (r["account_number"], r["block"])):
        low, high = at.get(r["account_number"], (r["opening"], r["opening"]))
        starts[r["account_number"], r["block"]] = (low, high)
        low, high = low + r["low"], high + r["high"]
        at[r["account_number"]] = (
            low if r["floor"] is None else max(low, r["floor"]), high if r["ceiling"] is None else min(high, r["ceiling"]))
    return starts


def _round(rows: DataFrame, blocks: int) -> DataFrame:
    """The debits that bounds decide, and the accounts that keep an open one; each block is sorted and walked by one task."""
    placed = stage(rows.repartitionByRange(blocks, *ORDER).withColumn("block", F.spark_partition_id()), "blocks")
    ordered = placed.repartition(blocks, "block").sortWithinPartitions("block", *ORDER)
    return stage(ordered.mapInArrow(_walk(_starts(placed, ordered)), WALKED), "decided")


REPLAYED = "paid_by long, open boolean, account_number string, closing long"


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decisions of rows in order of time, and the balance of each account behind them."""
    balance: dict[str, int] = {}
    decided: dict[int, bool] = {}
    new: list[tuple[int, bool]] = []
    for batch in batches:
        for key, debit, account, cents, opening, known in _columns(batch):
            now = balance.get(account, opening)
            if known is None:
                known = decided.get(key)
            if debit and known is None:
                known = decided[key] = now >= cents
                new.append((key, known))
            balance[account] = now + (0 if not known else -cents if debit else cents)
    none = [None] * len(balance)
    yield pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in new] + none, pa.int64()), pa.array([o for _, o in new] + none, pa.bool_()),
         pa.array([None] * len(new) + list(balance), pa.string()), pa.array([None] * len(new) + list(balance.values()), pa.int64())],
        names=["paid_by", "open", "account_number", "closing"])


def _known(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """Rows with new decisions, without credits that never come."""
    told = decided.select(F.col("paid_by").alias("_key"), F.col("open").alias("_open"))
    joined = rows.join(told, F.col("paid_by") == F.col("_key"), "left").withColumn("open", F.coalesce("open", "_open"))
    return joined.where(F.col("debit") | F.col("open").isNull() | F.col("open")).select(*ROWS)


def _open_accounts(rows: DataFrame) -> DataFrame:
    """The rows of accounts that still have an open debit."""
    waiting = rows.where(F.col("debit") & F.col("open").isNull()).select("account_number").distinct()
    return rows.join(waiting, "account_number", "left_semi").select(*ROWS)


def decide_debits(rows: DataFrame, blocks: int | None = None, rounds: int = ROUNDS, replay: int = REPLAY) -> tuple[DataFrame, list[str]]:
    """(paid_by, open of every debit whose `open` is null; what each round was: `bounds` or `replay`).

    rows: ROWS, with (account_number, ts, seq, paid_by) unique, a credit behind the debit it waits for, and no nulls but in `open`."""
    spark = rows.sparkSession
    rows = stage(rows.select(*ROWS), "rows")
    decided, turns = [spark.createDataFrame([], DECIDED)], []
    left = rows.count()
    while left:
        if len(turns) < rounds and (left > replay or not turns):
            turns.append("bounds")
            walked = _round(rows, blocks or blocks_for(spark, left))
            found = walked.where("paid_by is not null").select("paid_by", "open")
            decided.append(found)
            # Rows of settled accounts go first, so only the others meet the decisions.
            waiting = walked.where("waiting is not null").select(F.col("waiting").alias("account_number")).distinct()
            rows = _known(rows.join(waiting, "account_number", "left_semi"), found)
        else:
            turns.append("replay")
            first = stage(rows.orderBy(*TIME).limit(replay), "first") if left > replay else rows
            told = stage(first.repartition(1).sortWithinPartitions(*TIME).mapInArrow(_replay, REPLAYED), "replayed")
            found = told.where("paid_by is not null").select("paid_by", "open")
            decided.append(found)
            if left <= replay:
                break
            end = first.agg(F.max(F.struct(*TIME)).alias("end"))
            rest = rows.where(F.struct(*TIME) > end.scalar())
            closing = told.where("account_number is not null").select(F.col("account_number").alias("_name"), "closing")
            rest = rest.join(closing, F.col("account_number") == F.col("_name"), "left")
            rows = _open_accounts(_known(rest.withColumn("opening", F.coalesce("closing", "opening")).select(*ROWS), found))
        rows = stage(rows, "rows")
        left = rows.count()
    out = decided[0]
    for part in decided[1:]:
        out = out.unionByName(part)
    return out, turns
